"""Column functions: text, boundaries, fonts, geometry, markup."""
