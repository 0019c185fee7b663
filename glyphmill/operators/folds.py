"""Folds over one page that carry state: grouping by running anchors, merging of runs, glyphs to runs, drawing operators.

Each is a plain function over the rows of a page, in a fixed total order, behind ``per_page``; the largest state is a page.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

PAGE = ["doc_id", "page_no"]


def per_page(rows: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str, keys: list[str] | None = None) -> DataFrame:
    """``fold`` over the rows of each page as dictionaries; its results get the keys in front.

    Rows are clustered and sorted by page once and read as a stream, so that a page costs its rows and no task holds more
    than a page and a batch.
    """
    keys = keys or PAGE
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names, columns = arrow.names[len(keys) :], rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []

        def flush() -> None:
            out.extend((*last, *(r[n] for n in names)) for r in fold(held))

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(columns, values, strict=True))
                key = tuple(r[k] for k in keys)
                if key != last:
                    if held:
                        flush()
                    last, held = key, []
                held.append(r)
            if len(out) >= 10_000:
                yield table(out)
                out.clear()
        if held:
            flush()
        if out:
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def per_page_columns(rows: DataFrame, fold: Callable[[pa.Table], dict[str, list]], schema: str, order: str | list[str], keys: list[str] | None = None) -> DataFrame:
    """``fold`` over the columns of each page, sorted by ``order``; it returns columns of results, which get the keys in front.

    As ``per_page``, but no row becomes a Python object on the way in.
    """
    keys = keys or PAGE
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the page that is not over yet

        def flush() -> pa.RecordBatch:
            page = pa.Table.from_batches(held)
            out = fold(page)
            n = len(out[arrow.names[-1]])
            own = [pa.array([page.column(k)[0].as_py()] * n, arrow.field(k).type) for k in keys]
            return pa.RecordBatch.from_arrays(own + [pa.array(out[c], arrow.field(c).type) for c in arrow.names[len(keys) :]], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            for c in ids:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            if held:
                last = [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys]
                changed[0] = last != [c[0].as_py() for c in ids]
            edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b and a == 0:
                    if held:
                        yield flush()
                        held.clear()
                    continue
                if a and held:
                    yield flush()
                    held.clear()
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    within = [order] if isinstance(order, str) else order
    return rows.repartition(*keys).sortWithinPartitions(*keys, *within).mapInArrow(each, schema)


def by_line(fold: Callable[[list[dict]], list[dict]]) -> Callable[[list[dict]], list[dict]]:
    """A fold of lines as a fold of pages."""

    def page(rows: list[dict]) -> list[dict]:
        lines: dict[int, list[dict]] = {}
        for r in rows:
            lines.setdefault(r["line_no"], []).append(r)
        return [{"line_no": n} | r for n in sorted(lines) for r in fold(lines[n])]

    return page


def median(values: list[float]) -> float:
    v = sorted(values)
    n = len(v)
    return 0.0 if not n else v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


_PUNCTUATION = re.compile(r"^[^\w\s]+$")


def running_lines(items: list[dict], factor: float = 0.45) -> list[dict]:
    """Lines by a running mean of their tops: an item joins the first line within ``factor`` median heights.

    A line of punctuation alone then joins the nearest other line that it overlaps or touches.  Rows: item_no, line.
    """
    if not items:
        return []
    height = median([max(1.0, r["height"]) for r in items]) or 12.0
    tolerance = max(1.0, factor * height)
    lines: list[dict] = []
    for r in sorted(items, key=lambda r: (-(r["y"] + r["height"]), r["x"], r["item_no"])):
        top, alone = r["y"] + r["height"], bool(_PUNCTUATION.match(r["text"].strip()))
        near = tolerance * (1.6 if alone else 1.0)
        found = next((ln for ln in lines if abs(ln["sum"] / ln["n"] - top) <= near), None)
        if found is None:
            found = {"sum": 0.0, "n": 0, "items": [], "x0": math.inf, "x1": -math.inf, "marks": True}
            lines.append(found)
        found["sum"] += top
        found["n"] += 1
        found["items"].append(r)
        found["x0"], found["x1"] = min(found["x0"], r["x"]), max(found["x1"], r["x"] + r["width"])
        found["marks"] = found["marks"] and alone
    for ln in [x for x in lines if x["marks"]]:
        reach = max(6.0, 2.6 * height)
        others = [o for o in lines if o is not ln and not o["marks"] and abs(o["sum"] / o["n"] - ln["sum"] / ln["n"]) <= reach and o["x0"] - height <= ln["x1"] and ln["x0"] <= o["x1"] + height]
        if others:
            best = min(others, key=lambda o: abs(o["sum"] / o["n"] - ln["sum"] / ln["n"]))
            best["items"] += ln["items"]
            ln["items"] = []
    kept = [ln for ln in lines if ln["items"]]
    return [{"item_no": r["item_no"], "line": i} for i, ln in enumerate(kept) for r in sorted(ln["items"], key=lambda r: (r["x"], r["item_no"]))]


def anchored_lines(items: list[dict], tolerance: float = 3.0) -> list[dict]:
    """Lines by the rounded y of their first item, in the order of the items: the first anchor nearer than ``tolerance``."""
    anchors: list[float] = []
    out = []
    for r in sorted(items, key=lambda r: r["item_no"]):
        y = math.floor(r["y"] + 0.5)
        at = next((i for i, a in enumerate(anchors) if abs(a - y) < tolerance), None)
        if at is None:
            anchors.append(y)
            at = len(anchors) - 1
        out.append({"item_no": r["item_no"], "line": at})
    return out


def clustered_rows(items: list[dict], threshold: float = 8.0) -> list[dict]:
    """Rows from the top, each anchored at the top of its first item."""
    out, row, anchor = [], -1, None
    for r in sorted(items, key=lambda r: (-r["y"], r["x"], r["item_no"])):
        if anchor is None or abs(r["y"] - anchor) > threshold:
            row, anchor = row + 1, r["y"]
        out.append({"item_no": r["item_no"], "row": row})
    return out


def _plain(name: str | None) -> str:
    return re.sub("[^a-z0-9]", "", (name or "").lower())


def may_merge(run: dict, item: dict, word_gap: float = 5.0) -> bool:
    """Same font; for short pieces sizes within three times and a gap under two sizes, else like size, colour and a gap under two word gaps."""
    if _plain(run["font_family"]) != _plain(item["font_family"]):
        return False
    small, large = sorted((run["font_size"], item["font_size"]))
    gap = item["x"] - (run["x"] + run["width"])
    if len(item["text"].strip()) <= 3 or len(run["text"].strip()) <= 5:
        return large <= 3 * small and gap < run["font_size"] + item["font_size"]
    return large - small <= 0.5 * large and run["color"] == item["color"] and gap < 2 * word_gap


def merged_runs(items: list[dict], space: float = 0.25, word_gap: float = 5.0) -> list[dict]:
    """Runs of a line; rows of one line, results (run, text, x, width, n)."""
    out: list[dict] = []
    for r in sorted(items, key=lambda r: (r["x"], r["item_no"])):
        if out and may_merge(out[-1], r, word_gap):
            run = out[-1]
            gap = r["x"] - (run["last_x"] + run["last_w"])
            run["text"] += (" " if gap > space * (run["font_size"] + r["font_size"]) / 2 else "") + r["text"]
            run["width"] = max(0.0, max(run["x"] + run["width"], r["x"] + r["width"]) - run["x"])
            run["n"] += 1
        else:
            out.append({k: r[k] for k in ("text", "x", "width", "font_family", "font_size", "color")} | {"n": 1})
        out[-1]["last_x"], out[-1]["last_w"] = r["x"], r["width"]
    return [{"run": i, "text": r["text"], "x": r["x"], "width": r["width"], "n": r["n"]} for i, r in enumerate(out)]


def needs_space(a: str, b: str, gap: float, size: float) -> bool:
    """A space between two fragments: a gap, and no punctuation that sticks."""
    if not a or not b or a[-1].isspace() or b[0].isspace() or re.match(r"[,.;:!?)\]}]", b) or re.search(r"[(\[{]$", a):
        return False
    return gap > 0.15 * size


def merged_fragments(items: list[dict], most: float = 0.5) -> list[dict]:
    """Neighbours of a row merge while their gap is at most ``most`` sizes and they look alike; (item, text, x, y, width, n)."""
    out: list[dict] = []
    for r in sorted(items, key=lambda r: (-r["y"], r["x"], r["item_no"])):
        last = out[-1] if out else None
        if last is not None and abs(last["y"] - r["y"]) <= 2 and _plain(last["font_family"]) == _plain(r["font_family"]) and abs(last["font_size"] - r["font_size"]) <= 1:
            gap = r["x"] - (last["x"] + last["width"])
            if -r["font_size"] <= gap <= most * r["font_size"]:
                last["text"] += (" " if needs_space(last["text"], r["text"], gap, r["font_size"]) else "") + r["text"]
                last["width"] = max(last["width"], r["x"] + r["width"] - last["x"])
                last["n"] += 1
                continue
        out.append({k: r[k] for k in ("text", "x", "y", "width", "font_family", "font_size")} | {"n": 1})
    return [{"item": i, "text": r["text"], "x": r["x"], "y": r["y"], "width": r["width"], "n": r["n"]} for i, r in enumerate(out)]


def merged_blocks(blocks: list[dict], size: float = 10.0, line_height: float = 12.0) -> list[dict]:
    """Blocks (block_no, kind, list_kind, top, bottom, indent, font_size) from the top: lists of a kind and like paragraphs that follow closely become one; (block_no, merged)."""
    out, last, merged = [], None, -1
    gap_most, indent_most = max(2.0, 0.75 * line_height), max(6.0, 0.8 * size)
    for b in sorted(blocks, key=lambda b: (b["top"], b["block_no"])):
        close = last is not None and b["top"] - last["bottom"] <= gap_most and abs(last["indent"] - b["indent"]) <= indent_most
        alike = last is not None and last["kind"] == b["kind"] and (b["kind"] == "list" and last["list_kind"] == b["list_kind"] or b["kind"] == "paragraph" and abs(last["font_size"] - b["font_size"]) <= max(1.5, 0.18 * size))
        if close and alike:
            last["bottom"] = max(last["bottom"], b["bottom"])
        else:
            merged, last = merged + 1, dict(b)
        out.append({"block_no": b["block_no"], "merged": merged})
    return out


_NOTES = re.compile(r"important notes", re.I)


def rewritten_notes(blocks: list[dict], size: float = 10.0) -> list[dict]:
    """Blocks (block_no, kind, text, indent): a heading of important notes takes the paragraphs that follow as two items.

    The items part at the sentence end nearest to the middle, else at the half.  Rows: block_no, kind, text.
    """
    out, i = [], 0
    rows = sorted(blocks, key=lambda b: b["block_no"])
    while i < len(rows):
        b = rows[i]
        i += 1
        if not _NOTES.search(b["text"]):
            out.append({k: b[k] for k in ("block_no", "kind", "text")})
            continue
        out.append({"block_no": b["block_no"], "kind": "heading", "text": b["text"]})
        taken = []
        while i < len(rows) and rows[i]["kind"] == "paragraph" and abs(rows[i]["indent"] - b["indent"]) <= max(24.0, 3 * size) and not _NOTES.search(rows[i]["text"]):
            taken.append(rows[i])
            i += 1
        text = " ".join(t["text"].strip() for t in taken).strip()
        if text:
            ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=[A-Z])", text)]
            cut = min(ends, key=lambda e: abs(e - len(text) / 2)) if ends else len(text) // 2
            out.append({"block_no": taken[0]["block_no"], "kind": "list", "text": "\n".join(p.strip() for p in (text[:cut], text[cut:]) if p.strip())})
    return out


def _centre(r: dict) -> tuple[float, float]:
    return r["x"] + r["width"] / 2, r["y"] + r["height"] / 2


#: Cells around a cell of a grid; numbers of cells end at ``FAR`` either way.
FAR = 1 << 30
_AROUND = [dx * 4 * FAR + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def _grown(x: np.ndarray, y: np.ndarray, reach: np.ndarray, style: np.ndarray) -> list[list[int]]:
    """The clusters of ``grown_clusters`` over items in order, as places in it.

    Free items stand in grids, one for each style and power of four of the reach, so that a search reads the cells around a
    centre; what a search finds leaves its cell.
    """
    level = (np.frexp(np.maximum(reach, 1.0))[1] + 1) // 2
    size = 4.0**level
    with np.errstate(invalid="ignore"):
        cell_x, cell_y = (np.nan_to_num(np.clip(np.floor(v / size), -FAR, FAR)).astype(np.int64) for v in (x, y))
    keys = (cell_x * 4 * FAR + cell_y).tolist()
    grids: dict[int, dict[float, dict[int, list[int]]]] = {}
    xs, ys, reaches, styles = x.tolist(), y.tolist(), reach.tolist(), style.tolist()
    for i, (c, z, k) in enumerate(zip(styles, size.tolist(), keys, strict=True)):
        grids.setdefault(c, {}).setdefault(z, {}).setdefault(k, []).append(i)
    free, clusters, hypot = [True] * len(xs), [], math.hypot
    for seed, (cx, cy) in enumerate(zip(xs, ys, strict=True)):
        if not free[seed]:
            continue
        free[seed] = False
        members, sum_x, sum_y = [seed], cx, cy
        while math.isfinite(cx + cy):
            new: list[int] = []
            for z, cells in grids[styles[seed]].items():
                at = int(min(max(cx // z, -FAR), FAR)) * 4 * FAR + int(min(max(cy // z, -FAR), FAR))
                for k in _AROUND:
                    if cell := cells.get(at + k):
                        near = [i for i in cell if hypot(xs[i] - cx, ys[i] - cy) <= reaches[i]]
                        if len(near) == len(cell):
                            del cells[at + k]
                        elif near:
                            taken = set(near)
                            cells[at + k] = [i for i in cell if i not in taken]
                        new += near
            new = sorted(i for i in new if free[i])
            if not new:
                break
            for i in new:
                free[i] = False
                sum_x += xs[i]
                sum_y += ys[i]
            members += new
            cx, cy = sum_x / len(members), sum_y / len(members)
        if len(members) >= 2:
            clusters.append(members)
    return clusters


def grown_cluster_columns(page: pa.Table, radius: float = 15.0) -> dict[str, list]:
    """``grown_clusters`` over the columns of a page."""
    get = lambda c: page.column(c).to_numpy()
    item = get("item_no")
    order = np.argsort(item, kind="stable")
    x, y, width, height = (get(c).astype(float)[order] for c in ("x", "y", "width", "height"))
    style = np.zeros(len(item), np.int64)
    for c in ("font_family", "font_weight", "font_style"):
        codes = page.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        style = np.unique(style * (len(item) + 1) + codes, return_inverse=True)[1]
    clusters = _grown(x + width / 2, y + height / 2, radius + np.maximum(width, height) / 2, style[order])
    members = np.array([i for c in clusters for i in c], np.int64)
    return {"item_no": item[order][members].tolist(), "cluster": [k for k, c in enumerate(clusters) for _ in c]}


def grown_clusters(items: list[dict], radius: float = 15.0) -> list[dict]:
    """Clusters of one style: seeds in item order take the free items of their style near the cluster's centre, and again while there are any; two members at least."""
    if not items:
        return []
    found = grown_cluster_columns(pa.Table.from_pylist(items), radius)
    return [{"item_no": i, "cluster": c} for i, c in zip(found["item_no"], found["cluster"], strict=True)]


def spatial_groups(items: list[dict]) -> list[dict]:
    """Groups by nearness of centres: from each free seed, all that is reached in steps under twice the seed's larger side; (item_no, group, kind).

    A grid over the page keeps the search to neighbours.
    """
    rows = sorted(items, key=lambda r: r["item_no"])
    size = max(1.0, median([2 * max(r["width"], r["height"]) for r in rows]))
    grid: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    places = [_centre(r) for r in rows]
    for i, (x, y) in enumerate(places):
        grid.setdefault((int(x // size), int(y // size)), {})[i] = (x, y)
    free, out, group = set(range(len(rows))), [], 0

    def take(i: int) -> None:
        free.discard(i)
        x, y = places[i]
        del grid[(int(x // size), int(y // size))][i]

    for seed in range(len(rows)):
        if seed not in free:
            continue
        step = 2 * max(rows[seed]["width"], rows[seed]["height"], 0.5)
        take(seed)
        members, todo = [], [seed]
        while todo:
            i = todo.pop()
            members.append(i)
            x, y = places[i]
            for cx in range(int((x - step) // size), int((x + step) // size) + 1):
                for cy in range(int((y - step) // size), int((y + step) // size) + 1):
                    for o in [o for o, (ox, oy) in grid.get((cx, cy), {}).items() if math.hypot(ox - x, oy - y) < step]:
                        take(o)
                        todo.append(o)
        members.sort()
        ys = sorted({math.floor(rows[i]["y"] + 0.5) for i in members}, reverse=True)
        steps = [a - b for a, b in zip(ys[:-1], ys[1:], strict=True)]
        kind = "line" if len(ys) == 1 else "paragraph" if sum(steps) / len(steps) < 1.5 * rows[seed]["height"] else "block"
        out += [{"item_no": rows[i]["item_no"], "group": group, "kind": kind} for i in members]
        group += 1
    return out


def chased_paragraph(lines: list[dict]) -> list[dict]:
    """For each line the lines that follow it at 1.5 heights, half a height either way, one after the other; (line_no, length)."""
    ys = sorted(lines, key=lambda r: (-r["y"], r["line_no"]))
    out = []
    for r in ys:
        y, n, h = r["y"], 1, r["height"]
        while (found := next((o for o in ys if abs(o["y"] - (y - 1.5 * h)) < 0.5 * h), None)) is not None:
            y, n = found["y"], n + 1
        out.append({"line_no": r["line_no"], "length": n})
    return out


def separated(lines: list[dict], least: float = 1.0) -> list[dict]:
    """Tops (line_no, top, height) moved down so that no line begins above the adjusted bottom of the one before; (line_no, top)."""
    out, bottom = [], None
    for r in sorted(lines, key=lambda r: (r["top"], r["line_no"])):
        top = r["top"] if bottom is None else max(r["top"], bottom + least)
        bottom = top + r["height"]
        out.append({"line_no": r["line_no"], "top": top})
    return out


def style_paragraphs(lines: list[dict]) -> list[dict]:
    """Lines (line_no, x, top, height, style) of one style and left edge (1.5) without a gap, from the first of the group; (line_no, group)."""
    out, group, first, last = [], -1, None, None
    for r in sorted(lines, key=lambda r: (r["top"], r["line_no"])):
        same = first is not None and r["style"] == first["style"] and abs(r["x"] - first["x"]) <= 1.5 and r["top"] - (last["top"] + last["height"]) <= 0.6 * r["height"]
        if not same:
            group, first = group + 1, r
        last = r
        out.append({"line_no": r["line_no"], "group": group})
    return out


def glyph_runs(glyphs: list[dict]) -> list[dict]:
    """Glyphs (glyph_no, ch, left, right, bottom, top, font_name, font_size) in order -> runs (run, text, x, width, n).

    A run keeps its font and line.  White space is kept unless it is squeezed inside a word; a gap of a third of the size
    is a space, one above 1.6 sizes parts runs; closing punctuation sticks.
    """
    out: list[dict] = []
    for g in sorted(glyphs, key=lambda g: g["glyph_no"]):
        run = out[-1] if out else None
        size = max(1.0, g["font_size"])
        if run is not None and (run["font"], round(run["size"], 3)) == (g["font_name"], round(g["font_size"], 3)) and abs(run["bottom"] - g["bottom"]) <= 0.35 * size:
            gap = g["left"] - run["right"]
            if -size <= gap <= 1.6 * size:
                if g["ch"].isspace():
                    if g["right"] - g["left"] >= 0.08 * size and not run["text"].endswith(" "):
                        run["text"] += " "
                elif gap >= size / 3 and not run["text"].endswith(" ") and not re.match(r"[,.;:!?)\]}]", g["ch"]):
                    run["text"] += " " + g["ch"]
                else:
                    run["text"] += g["ch"]
                run["right"], run["n"] = max(run["right"], g["right"]), run["n"] + 1
                continue
        if not g["ch"].isspace():
            out.append({"text": g["ch"], "x": g["left"], "right": g["right"], "bottom": g["bottom"], "font": g["font_name"], "size": g["font_size"], "n": 1})
    return [{"run": i, "text": r["text"].rstrip(), "x": r["x"], "width": r["right"] - r["x"], "n": r["n"]} for i, r in enumerate(out)]


def glyph_run_columns(page: pa.Table) -> dict[str, list]:
    """``glyph_runs`` over the columns of a page sorted by glyph_no, for pages where the glyph before tells the state of a run.

    That holds if heights change by nothing or by more than a run allows, rights never go back within a run, no run would
    begin with white space and no white space is squeezed; any other page goes through the loop.
    """
    get = lambda c: page.column(c).to_numpy()
    left, right, bottom, size = (get(c).astype(float) for c in ("left", "right", "bottom", "font_size"))
    chars = page.column("ch").to_pylist()
    names = page.column("font_name").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    em, blank = np.maximum(1.0, size), np.array([c.isspace() for c in chars])
    before = lambda v: v[:-1]
    step = np.abs(bottom[1:] - before(bottom))
    gap = left[1:] - before(right)
    same = (names[1:] == before(names)) & (np.round(size[1:], 3) == np.round(before(size), 3)) & (step <= 0.35 * em[1:])
    joins = same & (gap >= -em[1:]) & (gap <= 1.6 * em[1:])
    starts = np.concatenate(([True], ~joins))
    narrow = blank & (right - left < 0.08 * em)
    if (step[same] > 0).any() or (right[1:] < before(right))[joins].any() or blank[starts].any() or narrow.any():
        return _columns(glyph_runs(page.to_pylist()), ("run", "text", "x", "width", "n"))
    spaced = np.concatenate(([False], before(blank)))
    sticks = np.array([c in ",.;:!?)]}" for c in chars])
    wide = ~starts & ~blank & ~spaced & ~sticks & (np.concatenate(([0.0], gap)) >= em / 3)
    pieces = ["" if b and s else " " if b else " " + c if w else c for c, b, s, w in zip(chars, blank.tolist(), spaced.tolist(), wide.tolist(), strict=True)]
    first = np.flatnonzero(starts)
    end = np.append(first[1:], len(left))
    texts = ["".join(pieces[a:b]).rstrip() for a, b in zip(first.tolist(), end.tolist(), strict=True)]
    return {"run": list(range(len(first))), "text": texts, "x": left[first].tolist(), "width": (right[end - 1] - left[first]).tolist(), "n": (end - first).tolist()}


def _columns(rows: list[dict], names: tuple[str, ...]) -> dict[str, list]:
    return {c: [r[c] for r in rows] for c in names}


def _times(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    )


def _number(v: float) -> str:
    v = math.floor(v * 1000 + 0.5) / 1000
    return str(int(v)) if v == int(v) else repr(v)


PAINTS = {"stroke": (True, False, "nonzero"), "fill": (False, True, "nonzero"), "eo_fill": (False, True, "evenodd"), "fill_stroke": (True, True, "nonzero")}


def drawn_paths(page_height: float) -> Callable[[list[dict]], list[dict]]:
    """A fold over drawing operators (op_no, fn, args) that keeps the matrix, its stack and the style; (path_no, path, stroke, fill, fill_rule, line_width).

    Paths come out in page space, origin at the top left.
    """

    def fold(ops: list[dict]) -> list[dict]:
        state = {"m": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "stroke": "#000000", "fill": "#000000", "width": 1.0}
        stack: list[dict] = []
        path: list[str] = []
        out: list[dict] = []

        def point(x: float, y: float) -> str:
            a, b, c, d, e, f = state["m"]
            return f"{_number(a * x + c * y + e)} {_number(page_height - (b * x + d * y + f))}"

        def color(args: list[float]) -> str:
            return "#" + "".join(f"{max(0, min(255, int(math.floor(v + 0.5)))):02x}" for v in args[:3])

        for op in sorted(ops, key=lambda o: o["op_no"]):
            fn, a = op["fn"], list(op["args"] if op["args"] is not None else [])
            if fn == "save":
                stack.append(dict(state))
            elif fn == "restore":
                state = stack.pop() if stack else state
            elif fn == "transform":
                state["m"] = _times(state["m"], tuple(a))
            elif fn == "move":
                path.append("M " + point(*a))
            elif fn == "line":
                path.append("L " + point(*a))
            elif fn == "curve":
                path.append("C " + ", ".join(point(a[i], a[i + 1]) for i in (0, 2, 4)))
            elif fn == "rectangle":
                x, y, w, h = a
                path += ["M " + point(x, y), "L " + point(x + w, y), "L " + point(x + w, y + h), "L " + point(x, y + h), "Z"]
            elif fn == "close":
                path.append("Z")
            elif fn in ("stroke_color", "fill_color"):
                state[fn[:-6]] = color(a)
            elif fn == "line_width":
                state["width"] = a[0]
            elif fn in PAINTS:
                if path:
                    stroke, fill, rule = PAINTS[fn]
                    out.append({"path_no": len(out), "path": " ".join(path), "stroke": state["stroke"] if stroke else None, "fill": state["fill"] if fill else None, "fill_rule": rule, "line_width": state["width"] if stroke else None})
                path = []
            elif fn == "end_path":
                path = []
        return out

    return fold


def smart_boundaries(dictionary: frozenset[str]) -> Callable[[list[dict]], list[dict]]:
    """A fold over the items of a line that knows the word so far; (item_no, space, phase).

    Phases: overlap, wide gap, punctuation, dictionary (the word so far is complete and does not begin a longer one, or the
    joined text is a word), case, gap.
    """
    ordered = sorted(dictionary)

    def begins(start: str) -> bool:
        at = bisect_left(ordered, start)
        return at < len(ordered) and ordered[at].startswith(start)

    def fold(items: list[dict]) -> list[dict]:
        out, word, last = [], "", None
        for r in sorted(items, key=lambda r: (r["x"], r["item_no"])):
            text = r["text"].strip()
            if last is None:
                space, phase = False, "first"
            else:
                gap = (r["x"] - (last["x"] + last["width"])) / max(0.01, last["width"] / max(1, len(last["text"].strip())))
                joined = (word + text).lower()
                if gap < -0.25:
                    space, phase = False, "overlap"
                elif gap >= 1.5:
                    space, phase = True, "wide"
                elif re.match(r"[,.;:!?)]", text):
                    space, phase = False, "punctuation"
                elif joined in dictionary:
                    space, phase = False, "dictionary"
                elif word.lower() in dictionary and not begins(joined):
                    space, phase = True, "dictionary"
                elif re.search("[a-z]$", word) and re.match("[A-Z]", text):
                    space, phase = True, "case"
                else:
                    space, phase = gap >= 0.5, "gap"
            word = text if space or last is None else word + text
            out.append({"item_no": r["item_no"], "space": space, "phase": phase})
            last = r
        return out

    return fold


def suggested_cuts(text: str, dictionary: frozenset[str], longest: int = 24) -> list[tuple[int, float]]:
    """Greedy longest words from the left; (position, confidence) of the cuts between."""
    out, at, lower = [], 0, text.lower()
    while at < len(lower):
        size = next((n for n in range(min(longest, len(lower) - at), 1, -1) if lower[at : at + n] in dictionary), 0)
        if size:
            at += size
            if at < len(lower):
                out.append((at, 0.9 if size >= 4 else 0.7))
        else:
            at += 1
    return out
