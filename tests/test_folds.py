"""Folds against plain loops, and what they must keep."""

import math
import random

from pyspark.sql import functions as F

from glyphmill.functions import boundary as B
from glyphmill.operators import folds as O
from glyphmill.plans.boundary import two_means_of


def items(rng, n=60):
    return [
        {"item_no": i, "text": rng.choice(["ab", "word", ",", "Capital", "x"]), "x": rng.uniform(0, 400), "y": rng.choice(range(0, 400, 12)) + rng.uniform(-1, 1), "width": rng.uniform(5, 40), "height": 10.0, "font_size": rng.choice([10.0, 10.0, 16.0]), "font_family": rng.choice(["A-B", "ab", "C"]), "font_weight": 400, "font_style": "normal", "color": "#000"}
        for i in range(n)
    ]


def test_line_folds_keep_every_item_once():
    rng = random.Random(1)
    for _ in range(20):
        rows = items(rng)
        for fold in (O.running_lines, O.anchored_lines, O.clustered_rows, O.spatial_groups):
            assert sorted(r["item_no"] for r in fold(rows)) == list(range(60))


def test_clusters_have_one_style_and_two_members():
    rng = random.Random(2)
    rows = items(rng, 120)
    by = {r["item_no"]: r for r in rows}
    seen = {}
    for r in O.grown_clusters(rows):
        seen.setdefault(r["cluster"], []).append(by[r["item_no"]]["font_family"])
    assert all(len(v) >= 2 and len(set(v)) == 1 for v in seen.values())


def test_clusters_against_plain_search():
    rng = random.Random(6)
    for k in range(60):
        rows = [r | {"item_no": k % 2 or r["item_no"], "x": rng.choice([r["x"], -r["x"], r["x"] * 50]), "width": rng.choice([r["width"], 0.0, -3.0, 900.0]), "font_weight": rng.choice([400, 700]), "font_family": rng.choice(["A", None])} for r in items(rng, 50)]
        rng.shuffle(rows)
        order = sorted(range(50), key=lambda i: rows[i]["item_no"])
        centre = lambda r: (r["x"] + r["width"] / 2, r["y"] + r["height"] / 2)
        style = lambda r: (r["font_family"], r["font_weight"], r["font_style"])
        want, free = [], list(order)
        while free:
            members = [free.pop(0)]
            new = members
            while new:
                mid = [sum(v) / len(members) for v in zip(*(centre(rows[i]) for i in members), strict=True)]
                new = [i for i in free if style(rows[i]) == style(rows[members[0]]) and math.dist(mid, centre(rows[i])) <= 15 + max(rows[i]["width"], rows[i]["height"]) / 2]
                free, members = [i for i in free if i not in new], members + new
            if len(members) > 1:
                cluster = want[-1]["cluster"] + 1 if want else 0
                want += [{"item_no": rows[i]["item_no"], "cluster": cluster} for i in members]
        assert O.grown_clusters(rows) == want


def test_clusters_of_a_long_line_cost_its_length():
    import time

    rows = [{"item_no": i, "x": i * 8.5, "y": 0.0, "width": 5.5, "height": 10.0, "font_family": "A", "font_weight": 700 if i % 11 == 5 else 400, "font_style": "normal"} for i in range(40_000)]
    began = time.perf_counter()
    found = O.grown_clusters(rows)
    assert time.perf_counter() - began < 5  # all items against each seed's centre took 14 seconds
    assert len({r["item_no"] for r in found}) == len(found) > 36_000


def test_spatial_groups_against_plain_search():
    rng = random.Random(3)
    for _ in range(10):
        rows = items(rng, 40)
        centre = lambda r: (r["x"] + r["width"] / 2, r["y"] + r["height"] / 2)
        want, done = [], set()
        for seed in rows:
            if seed["item_no"] in done:
                continue
            step, group = 2 * max(seed["width"], seed["height"]), [seed]
            done.add(seed["item_no"])
            grown = True
            while grown:
                grown = False
                for r in rows:
                    if r["item_no"] not in done and any(math.dist(centre(r), centre(g)) < step for g in group):
                        group.append(r)
                        done.add(r["item_no"])
                        grown = True
            want.append(sorted(g["item_no"] for g in group))
        got = {}
        for r in O.spatial_groups(rows):
            got.setdefault(r["group"], []).append(r["item_no"])
        assert [sorted(v) for v in got.values()] == want


def test_merged_text_keeps_its_letters():
    rng = random.Random(4)
    for _ in range(20):
        rows = [r | {"y": 0.0, "x": i * 30.0} for i, r in enumerate(items(rng, 20))]
        letters = "".join(r["text"] for r in rows)
        for fold in (O.merged_runs, O.merged_fragments):
            got = fold(rows)
            assert "".join(r["text"] for r in got).replace(" ", "") == letters and sum(r["n"] for r in got) == 20


def test_operators_draw_in_page_space():
    ops = [("transform", [1, 0, 0, 1, 10, 20]), ("save", None), ("rectangle", [5, 5, 100, 50]), ("stroke", None), ("restore", None), ("restore", None), ("fill", [])]
    out = O.drawn_paths(500.0)([{"op_no": i, "fn": f, "args": a} for i, (f, a) in enumerate(ops)])
    assert len(out) == 1 and out[0]["path"].startswith("M 15 475") and out[0]["fill"] is None


def test_glyphs_become_words():
    out = []
    x = 0.0
    for i, ch in enumerate("fl ight, 21:15"):
        out.append({"glyph_no": i, "ch": ch, "left": x, "right": x + (0.4 if ch == " " and i == 2 else 5.0), "bottom": 0.0, "top": 10.0, "font_name": "A", "font_size": 10.0})
        x = out[-1]["right"]
    assert [r["text"] for r in O.glyph_runs(out)] == ["flight, 21:15"]


def test_notes_become_a_list_of_two():
    blocks = [{"block_no": 1, "kind": "paragraph", "text": "IMPORTANT NOTES", "indent": 50.0}, {"block_no": 2, "kind": "paragraph", "text": "One is here. Two comes", "indent": 55.0}, {"block_no": 3, "kind": "paragraph", "text": "after it.", "indent": 55.0}, {"block_no": 4, "kind": "heading", "text": "Next", "indent": 50.0}]
    assert [(r["kind"], r["text"]) for r in O.rewritten_notes(blocks)] == [("heading", "IMPORTANT NOTES"), ("list", "One is here.\nTwo comes after it."), ("heading", "Next")]


def test_separated_lines_do_not_overlap():
    rng = random.Random(5)
    rows = [{"line_no": i, "top": rng.uniform(0, 100), "height": rng.uniform(5, 20)} for i in range(30)]
    h = {r["line_no"]: r["height"] for r in rows}
    tops = sorted((r["top"], h[r["line_no"]]) for r in O.separated(rows))
    assert all(a[0] + a[1] <= b[0] for a, b in zip(tops[:-1], tops[1:], strict=True))


def test_smart_boundary_knows_the_word_so_far():
    fold = O.smart_boundaries(frozenset({"word", "play", "player", "big"}))
    line = [{"item_no": i, "text": t, "x": x, "width": w} for i, (t, x, w) in enumerate([("wo", 0, 10), ("rd", 10.5, 10), ("big", 22.0, 15), ("play", 38.0, 20), ("er", 58.0, 10), (",", 68.0, 3)])]
    assert [r["space"] for r in fold(line)] == [False, False, True, True, False, False]


def test_two_means_on_columns(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([rng.uniform(0, 0.3), rng.uniform(0.8, 2)]) for _ in range(rng.randint(1, 30))]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: (r.c.c0, r.c.c1) for r in df.select("id", B.two_means(F.col("v")).alias("c")).collect()}
    for i, v in rows:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], two_means_of(v), strict=True))


def test_suggested_cuts():
    words = frozenset({"connecting", "finance", "con", "fin"})
    assert O.suggested_cuts("connectingfinance", words) == [(10, 0.9)]
    assert O.suggested_cuts("confinx", words) == [(3, 0.7), (6, 0.7)]


def test_glyph_runs_by_columns_equal_the_loop():
    import random

    import pyarrow as pa

    rng = random.Random(9)
    whole = 0
    for case in range(400):
        rows, x, y = [], 0.0, 700.0
        for i in range(rng.randint(1, 60)):
            odd = case % 2 and rng.random() < 0.1
            if rng.random() < 0.08:
                x, y = 0.0, y - 12
            ch = rng.choice("ab,)  ") if i else "a"
            x += rng.choice([0, 0, 0, 0.5, 3, 4, 14, 17]) - (rng.choice([0.5, 20]) if odd else 0)
            wide = 0.2 if odd else 2.0 if ch == " " else 5.5
            rows.append({"glyph_no": i, "ch": ch, "left": x, "right": x + wide, "bottom": y + (1.0 if odd else 0.0), "top": y + 10, "font_name": rng.choice(["A"] * 9 + ["B", None]) if odd else "A", "font_size": 10.0 if rng.random() < 0.97 else 12.0})
            x += wide
        want = O.glyph_runs(rows)
        got = O.glyph_run_columns(pa.Table.from_pylist(rows))
        assert [dict(zip(got, v, strict=True)) for v in zip(*got.values(), strict=True)] == want
        whole += len(want) > 1
    assert whole > 300


def test_pages_by_columns_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(d, p, i) for d in (1, 2, None) for p in (0, 1, 2) for i in range(d or 10) for _ in range(2)]
        df = spark.createDataFrame([(*r, j) for j, r in enumerate(rows)], "doc_id long, page_no int, i int, seq long")
        got = O.per_page_columns(df, lambda t: {"n": [t.num_rows], "first": [t.column("seq")[0].as_py()]}, "first long, n int", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(d, p): [j for j, r in enumerate(rows) if r[:2] == (d, p)] for d, p, _ in rows}
    assert {(r.doc_id, r.page_no): (r.first, r.n) for r in got} == {k: (v[0], len(v)) for k, v in want.items()} and len(got) == len(want)
