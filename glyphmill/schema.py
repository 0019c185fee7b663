"""Tables of the engine: documents, pages and what lies on a page.

Text items and images are in PDF space (origin at the bottom left), paths, annotations and forms in page space (origin at
the top left); every child table is keyed by (doc_id, page_no) and ordered by its last key column.
"""

from __future__ import annotations

from pyspark.sql import types as T

_D, _I, _S, _L = T.DoubleType(), T.IntegerType(), T.StringType(), T.LongType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("doc_id", _L), T.StructField("page_no", _I), *(T.StructField(n, t) for n, t in fields)])


BOX = [("x", _D), ("y", _D), ("width", _D), ("height", _D)]
FONT_METRICS = T.StructType([T.StructField(n, _D) for n in ("ascent", "descent", "cap_height", "x_height", "average_width", "max_width", "units_per_em")])
FONT_INFO = T.StructType([T.StructField("name", _S), T.StructField("embedded", T.BooleanType()), T.StructField("subset", T.BooleanType()), T.StructField("encoding", _S), T.StructField("metrics", FONT_METRICS)])

DOCUMENTS = T.StructType([T.StructField("doc_id", _L), T.StructField("page_count", _I), T.StructField("meta", T.MapType(_S, _S))])
PAGES = _table(("width", _D), ("height", _D))
TEXT_ITEMS = _table(
    ("item_no", _I), ("text", _S), *BOX, ("font_size", _D), ("font_family", _S), ("font_weight", _I), ("font_style", _S), ("color", _S), ("text_decoration", _S), ("rotation", _D), ("font_info", FONT_INFO)
)
IMAGES = _table(
    ("seq", _I), ("data", T.BinaryType()), ("data_url", _S), ("format", _S), *BOX, ("dpi", _D), ("rotation", _D), ("matrix", T.ArrayType(_D)), ("filters", T.ArrayType(_S)), ("pixel_width", _I), ("pixel_height", _I), ("bits_per_pixel", _I), ("color_space", _S)
)
GRAPHICS = _table(
    ("seq", _I), ("type", _S), ("path", _S), *BOX, ("stroke", _S), ("fill", _S), ("fill_rule", _S), ("stroke_width", _D), ("stroke_opacity", _D), ("fill_opacity", _D), ("line_cap", _S), ("line_join", _S), ("data", _S)
)
FORMS = _table(("seq", _I), ("type", _S), ("name", _S), ("value_str", _S), ("value_bool", T.BooleanType()), *BOX, ("required", T.BooleanType()), ("readonly", T.BooleanType()))
ANNOTATIONS = _table(("seq", _I), ("type", _S), *BOX, ("content", _S), ("url", _S))
OPS = _table(("op_no", _I), ("fn", _S), ("args", T.ArrayType(_D)))
GLYPHS = _table(
    ("glyph_no", _I), ("ch", _S), ("left", _D), ("right", _D), ("bottom", _D), ("top", _D), ("font_size", _D), ("font_name", _S), ("font_weight", _I), ("font_style", _S), ("angle", _D), ("color", _S)
)
OCR_WORDS = _table(("word_no", _I), ("text", _S), ("confidence", _D), *BOX)

#: The words that the enumerated columns may hold.
ENUMS = {
    "font_style": ["normal", "italic", "oblique"],
    "text_decoration": ["none", "underline", "line-through", "overline"],
    "graphics.type": ["path", "rectangle", "circle", "line", "curve", "raster"],
    "forms.type": ["text", "checkbox", "radio", "button", "dropdown"],
    "annotations.type": ["link", "note", "highlight", "underline", "strikeout"],
}
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
