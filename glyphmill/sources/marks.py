"""Annotations, forms and images as they stand in a file, mapped to the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _box(page_height: float) -> list[Column]:
    """A rectangle of two corners in PDF space as a box in page space."""
    r = lambda i: F.get("rect", F.lit(i))
    left, right, low, high = F.least(r(0), r(2)), F.greatest(r(0), r(2)), F.least(r(1), r(3)), F.greatest(r(1), r(3))
    return [left.alias("x"), (page_height - high).alias("y"), (right - left).alias("width"), (high - low).alias("height")]


def annotations(raw: DataFrame, page_height: float) -> DataFrame:
    """(doc_id, page_no, subtype, rect, url, contents) -> annotations; without four corners there is none."""
    kind = F.when(F.col("subtype") == "Link", "link").when(F.col("subtype") == "Highlight", "highlight").when(F.col("subtype") == "Underline", "underline").when(F.col("subtype") == "StrikeOut", "strikeout").otherwise("note")
    return raw.where(F.size("rect") >= 4).select("doc_id", "page_no", kind.alias("type"), *_box(page_height), F.col("contents").alias("content"), "url")


def forms(raw: DataFrame, page_height: float) -> DataFrame:
    """Widgets only: Tx is text, Btn a checkbox if its value is a truth value and else a button, Ch a dropdown."""
    kind = F.when(F.col("field_type") == "Btn", F.when(F.col("value_bool").isNotNull(), "checkbox").otherwise("button")).when(F.col("field_type") == "Ch", "dropdown").otherwise("text")
    return raw.where((F.col("subtype") == "Widget") & (F.size("rect") >= 4)).select("doc_id", "page_no", kind.alias("type"), F.col("field_name").alias("name"), "value_str", "value_bool", *_box(page_height))


def image_format(data: Column, hint: Column | None = None) -> Column:
    """The hint, else the first bytes, else jpeg."""
    head = F.hex(F.substring(data, 1, 4))
    sniffed = F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E47", "png").when(head == "47494638", "gif").otherwise("jpeg")
    return sniffed if hint is None else F.coalesce(hint, sniffed)


def format_of_filters(filters: Column) -> Column:
    """jpeg for DCT and JPX data, png for deflated, else jpeg."""
    return F.when(F.arrays_overlap(filters, F.array(F.lit("DCTDecode"), F.lit("JPXDecode"))), "jpeg").when(F.array_contains(filters, "FlateDecode"), "png").otherwise("jpeg")


def data_url(data: Column, fmt: Column) -> Column:
    return F.concat(F.lit("data:image/"), fmt, F.lit(";base64,"), F.base64(data))


def placed_images(ops: DataFrame, objects: DataFrame, store: DataFrame) -> DataFrame:
    """Paint operations (doc_id, page_no, op_no, name, matrix) with the image of their name, else of the shared store, at their place."""
    from ..functions.geometry import placement

    own = objects.select("doc_id", "page_no", "name", F.col("image").alias("own_image"))
    rows = ops.join(own, ["doc_id", "page_no", "name"], "left").join(store.select("name", F.col("image").alias("store_image")), "name", "left")
    image, at = F.coalesce("own_image", "store_image"), placement(F.col("matrix"))
    return rows.where(image.isNotNull()).select("doc_id", "page_no", "op_no", "name", image.alias("image"), at["x"].alias("x"), at["y"].alias("y"), at["width"].alias("width"), at["height"].alias("height"))
