"""All registered queries of the layout engine and their DuckDB equivalents."""

from .plans import boundary, documents, folds, fonts, items, layout, ocr, render, spatial, text

_PLANS = (layout, items, text, boundary, documents, spatial, fonts, render, folds, ocr)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}

#: Columns whose sums or literals DuckDB would widen to types that the queries do not have.
_TYPES = {
    "regions_islands": {"region_no": "BIGINT"},
    "paragraphs_islands": {"region_no": "BIGINT", "paragraph_no": "BIGINT"},
    "text_blocks": {"block_no": "BIGINT"},
    "split_blocks": {"region_no": "BIGINT", "paragraph_no": "BIGINT"},
    "list_markers": {"item_no": "BIGINT"},
    "obstacle_overlap": {"region_no": "BIGINT"},
    "region_layout": {"region_no": "BIGINT"},
    "annotations": {"y": "DOUBLE", "width": "DOUBLE", "height": "DOUBLE"},
    "forms": {"y": "DOUBLE", "width": "DOUBLE", "height": "DOUBLE"},
    "path_boxes": {"width": "DOUBLE"},
    "char_units": {"units": "DOUBLE"},
}
for _name, _columns in _TYPES.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _columns.items())
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
