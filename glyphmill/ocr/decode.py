"""Greedy decoding of recogniser output, boxes of detector output, and words as text items.

No model is part of this package: a caller gives two functions, image to probability map and crop to logits, and
``recognise`` runs them on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Detector settings (threshold of the map, least mean of a box, least area, padding by height).
THRESHOLD, BOX_THRESHOLD, LEAST_AREA, PAD_X, PAD_Y = 0.3, 0.6, 20, 0.6, 0.4


def ctc_greedy(steps: Column, labels: Column, blank: int = 0) -> Column:
    """struct<text, confidence>: the best class of each step (the first of equals), repeats and blanks dropped, mean of what is kept.

    ``steps`` is an array of arrays of scores; ``labels`` has the character of class i at place i - 1.
    """
    best = F.transform(steps, lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("k"), F.array_max(s).cast("double").alias("p")))
    return F.get(F.transform(F.array(best), lambda b: _kept(b, labels, blank)), F.lit(0))


def _kept(best: Column, labels: Column, blank: int) -> Column:
    kept = F.filter(best, lambda x, i: (x["k"] != blank) & ((i == 0) | (F.get(best, i - 1)["k"] != x["k"])))
    text = F.array_join(F.transform(kept, lambda x: F.coalesce(F.get(labels, x["k"] - 1), F.lit(""))), "")
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["p"])
    return F.struct(text.alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0).alias("confidence"))


def boxes_of(score: np.ndarray, scale_x: float = 1.0, scale_y: float = 1.0) -> list[tuple[float, float, float, float, float]]:
    """Connected areas of a probability map above THRESHOLD as (x, y, width, height, mean), padded and scaled back."""
    mask, seen, out = score > THRESHOLD, np.zeros(score.shape, bool), []
    for sy, sx in zip(*np.nonzero(mask), strict=True):
        if seen[sy, sx]:
            continue
        todo, cells = [(sy, sx)], []
        seen[sy, sx] = True
        while todo:
            y, x = todo.pop()
            cells.append((y, x))
            for ny, nx in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not seen[ny, nx]:
                    seen[ny, nx] = True
                    todo.append((ny, nx))
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        mean = float(np.mean([score[c] for c in cells]))
        if len(cells) < LEAST_AREA or mean < BOX_THRESHOLD:
            continue
        h = max(ys) - min(ys) + 1
        x0, y0 = max(0.0, min(xs) - PAD_X * h), max(0.0, min(ys) - PAD_Y * h)
        x1, y1 = min(score.shape[1], max(xs) + 1 + PAD_X * h), min(score.shape[0], max(ys) + 1 + PAD_Y * h)
        out.append((x0 * scale_x, y0 * scale_y, (x1 - x0) * scale_x, (y1 - y0) * scale_y, mean))
    return sorted(out, key=lambda b: (b[1], b[0]))


def recognise(images: DataFrame, detect: Callable[[bytes], np.ndarray], read: Callable[[bytes, tuple], np.ndarray]) -> DataFrame:
    """(doc_id, page_no, data) -> (doc_id, page_no, box_no, x, y, width, height, steps); each box keeps its number, so that a failed crop shifts no other."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for i, box in enumerate(boxes_of(detect(r.data))):
                    steps = read(r.data, box)
                    rows.append((r.doc_id, r.page_no, i, *box[:4], [list(map(float, s)) for s in steps]))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "box_no", "x", "y", "width", "height", "steps"])

    return images.select("doc_id", "page_no", "data").mapInPandas(each, "doc_id long, page_no int, box_no int, x double, y double, width double, height double, steps array<array<double>>")


def words_as_items(words: DataFrame, least: float = 0.5) -> DataFrame:
    """Recognised words of enough confidence as text items: size 0.8 of the height, black, upright, in reading order by rows of half a height."""
    row = F.floor((F.col("y") + F.col("height") / 2) / F.greatest(F.lit(1.0), F.col("height")))
    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(row, "x", "y", "text"))
    return words.where(F.col("confidence") >= least).select(
        "doc_id", "page_no", order.alias("item_no"), "text", "x", "y", "width", "height", (F.col("height") * 0.8).alias("font_size"), F.lit("Arial").alias("font_family"), F.lit(400).alias("font_weight"), F.lit("normal").alias("font_style"), F.lit("#000000").alias("color"), F.lit(0.0).alias("rotation")
    )
