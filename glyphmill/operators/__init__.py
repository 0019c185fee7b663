"""Operators over positioned text, images, graphics and documents."""
