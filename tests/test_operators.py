"""Operators on small tables made here."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import boundary as B
from glyphmill.functions import fonts as N
from glyphmill.functions import geometry as G
from glyphmill.functions import markup as M
from glyphmill.ocr import decode as O
from glyphmill.operators import items as I
from glyphmill.operators import layout as L
from glyphmill.operators import spatial as S
from glyphmill.streaming import pages as P

WORD = "doc_id long, page_no int, line_no int, word_no int, text string, x double, y double, width double, height double, font_size double"


def words(spark, rows):
    return spark.createDataFrame([(1, 0, *r) for r in rows], WORD)


def rules(spark, rows):
    return spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id long, page_no int, seq long, x double, y double, width double, height double, stroke_width double")


def test_rule_under_text_is_taken_and_fill_line_is_left(spark):
    text = words(spark, [(0, 0, "Underlined", 50.0, 700.0, 80.0, 10.0, 10.0), (5, 0, "Name:", 50.0, 600.0, 35.0, 10.0, 10.0)])
    both = rules(spark, [(1, 50.0, 94.0, 80.0, 0.5, 0.5), (2, 90.0, 192.5, 480.0, 0.5, 0.5), (3, 60.0, 194.0, 480.0, 0.5, 0.5)])
    marked, left = S.with_underlines(text, both, 612.0, 792.0)
    assert {r.text: r.text_decoration for r in marked.collect()} == {"Underlined": "underline", "Name:": "none"}
    assert sorted(r.seq for r in left.collect()) == [2, 3]


def test_lines_with_table_gaps_are_structured(spark):
    cells = words(spark, [(0, i, "Cell", x, 700.0, 40.0, 10.0, 10.0) for i, x in enumerate((50.0, 200.0, 350.0))] + [(1, i, "word", 50.0 + 45 * i, 680.0, 40.0, 10.0, 10.0) for i in range(5)])
    width = spark.createDataFrame([(1, 0, 500.0)], "doc_id long, page_no int, region_width double")
    assert {r.line_no: r.structured for r in S.structured_lines(cells, width).collect()} == {0: True, 1: False}


def test_overlapping_items_move_apart(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 50.0, 10.0), (1, 0, 2, 10.0, 5.0, 50.0, 10.0), (1, 0, 3, 200.0, 0.0, 50.0, 10.0)]
    items = spark.createDataFrame(rows, "doc_id long, page_no int, item_no long, x double, y double, width double, height double")
    pairs = S.overlaps(items)
    assert [(r["first"], r["second"], r["ratio"]) for r in pairs.collect()] == [(1, 2, 0.4)]
    assert {r.item_no: r.y for r in S.pushed_apart(items, pairs).collect()} == {1: 0.0, 2: 10.0, 3: 0.0}


def test_clusters_and_medians(spark):
    df = spark.createDataFrame([(1, 0, v) for v in (1.0, 2.0, 6.0, 30.0, 31.0, 90.0)], "doc_id long, page_no int, v double")
    assert sorted((r.centre, r.n) for r in L.clusters(df, L.PAGE, "v", 5).collect()) == [(3.0, 3), (30.5, 2)]
    row = spark.createDataFrame([([1.0, 2.0, 10.0, 20.0],)], "v array<double>").select(L.at_share(F.col("v"), 0.5).alias("a")).first()
    assert row.a == 10.0


def test_intervals_that_touch_and_nest(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 5.0), (1, 10.0, 12.0), (1, 20.0, 21.0), (2, 5.0, 5.0)], "k int, start double, end double")
    assert {r.k: r.covered for r in L.covered_length(df, ["k"]).collect()} == {1: 13.0, 2: 0.0}


def test_boundary_cases(spark):
    rows = [("12:", "30", 9.0, "join"), ("www.a.org", "x", 9.0, "join"), ("word", ",", 9.0, "join"), ("word", "next", 4.0, "space"), ("fl", "ight", 0.2, "join"), ("a", "word", 5.0, "join")]
    df = spark.createDataFrame(rows, "a string, b string, gap double, want string")
    got = df.select("want", B.rule(F.col("a"), F.col("b"), F.col("gap"), F.lit(10.0), F.lit(5.5), F.lit(0.6))["type"].alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert B.profile("no such")[0] == B.DEFAULT_PROFILE and B.profile("cjk-default")[1] == "cjk"
    cjk = spark.createDataFrame([("漢字", "東京", 9.0)], "a string, b string, gap double")
    pick = lambda name: cjk.select(B.rule(F.col("a"), F.col("b"), F.col("gap"), F.lit(10.0), F.lit(5.5), F.lit(0.6), name, F.lit("cjk"))["type"]).first()[0]
    assert (pick("cjk-default"), pick("latin-default")) == ("join", "space")


def test_matrices_and_rounding(spark):
    m = F.array(*[F.lit(v) for v in (0.0, 1.0, -1.0, 0.0, 10.0, 20.0)])
    row = spark.range(1).select(G.rotation_degrees(m).alias("r"), G.round_half_up(F.lit(-2.5)).alias("h"), G.transform_point(m, F.lit(3.0), F.lit(4.0)).alias("p"), G.from_pdf(F.lit(1.0), F.lit(700.0), F.lit(5.0), F.lit(10.0), 792.0).alias("b")).first()
    assert (row.r, row.h, row.p.x, row.p.y, row.b.top) == (90.0, -2.0, 6.0, 23.0, 82.0)


def test_font_helpers(spark):
    df = spark.createDataFrame([("ABCDEF+Arial-BoldMT", 12.0)], "n string, s double")
    row = df.select(N.normalized_family(F.col("n")).alias("f"), I.estimated_font_info(F.col("n"), F.col("s")).alias("i"), N.per_thousand(F.lit(1024.0), F.lit(2048.0)).alias("p")).first()
    assert row.f == "arial mt" and row.i.subset and math.isclose(row.i.metrics.max_width, 14.4) and row.p == 500.0
    fonts = spark.createDataFrame([("Arial", 1), ("Times New Roman", 2), ("My Mono Face", 3)], "font_family string, k int")
    got = {r.font_family: (r.record_id, r.reason) for r in N.resolve_names(fonts, N.aliases(spark)).collect()}
    assert got == {"Arial": ("arial", "alias"), "Times New Roman": ("times_new_roman", "alias"), "My Mono Face": ("default_mono", "fallback")}


def test_markup_escapes_and_overlays(spark):
    row = spark.range(1).select(
        M.positioned_text(F.lit("<a&b>"), F.lit(1.5), F.lit(2.0), F.lit(10.4), F.lit("c")).alias("t"), I.with_overlays(F.lit("<head></head><p></head>"), "x{}").alias("o"), M.number(F.lit(100.0)).alias("n"), M.number(F.lit(0.0)).alias("z")
    ).first()
    assert row.t == '<span class="c" style="position: absolute; left: 1.5px; top: 2px; line-height: 10px">&lt;a&amp;b&gt;</span>'
    assert row.o == "<head><style>x{}</style></head><p></head>" and (row.n, row.z) == ("100", "0")


def test_boxes_of_a_probability_map():
    score = np.zeros((40, 60))
    score[10:15, 10:30] = 0.9
    score[30:32, 2:5] = 0.9  # too small
    score[20:25, 40:50] = 0.4  # too weak
    (x, y, w, h, mean), = O.boxes_of(score, 2.0, 1.0)
    assert (x, y, w, h) == (14.0, 8.0, 52.0, 9.0) and math.isclose(mean, 0.9)


def test_recogniser_keeps_box_numbers(spark):
    images = spark.createDataFrame([(1, 0, b"x")], "doc_id long, page_no int, data binary")
    score = np.zeros((20, 40))
    score[2:8, 2:12] = score[2:8, 20:38] = 0.8
    out = O.recognise(images, lambda data: score, lambda data, box: np.eye(3)[[1, 1, 0, 2]]).select("box_no", O.ctc_greedy(F.col("steps"), F.array(F.lit("a"), F.lit("b")))["text"].alias("text"))
    assert sorted((r.box_no, r.text) for r in out.collect()) == [(0, "ab"), (1, "ab")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    path = str(tmp_path / "events")
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(path)
    stream = P.late_counts(spark.readStream.schema(table.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("late_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("late_counts").agg(F.sum("n"), F.count("*")).first()
    want = P.late_counts(table).agg(F.sum("n"), F.count("*")).first()
    assert tuple(got) == tuple(want) and got[0] == table.where("ts is not null").count()


def test_detector_input_and_turned_crops():
    import numpy as np

    from glyphmill.ocr import prepare as R

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 70, 4), np.uint8)
    tensor, ratio = R.detector_input(image)
    assert tensor.shape == (3, 64, 96) and ratio == 1.0
    for c, y, x in ((0, 0, 0), (1, 39, 69), (2, 17, 33), (0, 40, 0), (2, 63, 95)):
        v = image[y, x, c] / 255 if y < 40 and x < 70 else 0.0
        assert abs(tensor[c, y, x] - (v - R.MEAN[c]) / R.DEVIATION[c]) < 1e-5
    large = np.repeat(np.repeat(image[:30, :48], 40, 0), 40, 1)  # 1920 by 1200, blocks of one colour
    tensor, ratio = R.detector_input(large)
    assert tensor.shape == (3, 608, 960) and ratio == 0.5
    assert abs(tensor[1, 310, 410] - (image[15, 20, 1] / 255 - R.MEAN[1]) / R.DEVIATION[1]) < 1e-5
    half = R.resized(np.array([[[0], [100]], [[50], [150]]], np.uint8), 1, 1)
    assert half.tolist() == [[[75]]]
    crop = image[:9, :13]
    assert R.classifier_input(crop).shape == (3, 48, 192) and abs(R.classifier_input(crop)).max() <= 1
    assert (R.upright(crop, [0.9, 0.1]) == crop).all() and (R.upright(crop, [0.1, 0.9])[0, 0] == crop[8, 12]).all()


def test_html_with_nested_and_unplaced_elements_becomes_rows(spark):
    from glyphmill.operators import adapter as A

    span = lambda text, left, top, extra="", cls="t": f'<span class="{cls}" data-font-family="F" data-font-size="10" style="position: absolute; left: {left}px; top: {top}px{extra}">{text}</span>'
    html = '<div class="page"><br>' + span("ab &amp; c", 5, 20) + span("x", 80, 23, "; width: 30px") + '<div style="left: 2px; top: 40.5px"><p>' + span("in", 1, 1) + "</p></div>"
    html += span("", 0, 300, "; height: 50px") + span("gap", 0, 0, cls="a gap") + '<span style="position: absolute; left: 1px">no font</span></div>'
    rows = A.elements(spark.createDataFrame([(1, 0, html), (2, 0, "plain < text"), (3, 0, None)], "doc_id long, page_no int, html string"))
    got = [(r.body, r.x, r.top, r.width, r.height) for r in rows.orderBy("top", "x").collect()]
    assert got == [("ab &amp; c", 5.0, 20.0, 33.0, 11.5), ("x", 80.0, 23.0, 30.0, 11.5), ("in", 3.0, 41.5, 11.0, 11.5), ("", 0.0, 300.0, 1.0, 50.0)]
    page = A.flex_pages(rows).collect()
    assert len(page) == 1 and (page[0].n_rows, page[0].n_spacers) == (3, 5) and page[0].widths == 5.0 + 42.0 + 3.0 and page[0].heights == 10.0 + 247.0
    assert "absolute" not in page[0].html and page[0].html.count("ab &amp; c") == 1 and '<div class="gap" style="width: 42px; flex-shrink: 0"></div>' in page[0].html


def test_pages_are_adapted_in_one_pass(spark):
    from glyphmill.operators import adapter as A
    from glyphmill.plans.render import flex_adapter

    word = '<b style="left: {}px; top: {}px"><i data-font-family="F" style="position: absolute; left: 7px; left: 9px">w</i></b></p>'
    html = "".join(word.format(i % 60 * 9, i // 60 * 12) for i in range(3000))
    rows = [(1, 0, 2, html[90_000:]), (1, 0, 1, html[:90_000]), (1, 1, 1, "<p>none</p>"), (2, 0, 1, None)]
    pieces = spark.createDataFrame(rows, "doc_id long, page_no int, n int, html string")
    pages = spark.createDataFrame([(1, 0, html), (1, 1, "<p>none</p>"), (2, 0, None)], "doc_id long, page_no int, html string")
    found = A.adapted(pieces, ["n"]).collect()
    assert found == A.flex_pages(A.elements(pages)).collect()
    assert [(r.n_rows, r.n_spacers, round(r.widths, 6)) for r in found] == [(50, 50 * 60, round(50 * (7 + 59 * (9 - 6.6)), 6))]
    # the query deals and sorts words once, as the typesetter does, and no aggregate holds pages
    plan = flex_adapter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("Exchange", "Window ", "Aggregate")] == [1, 1, 0]


def test_respacing_examples(spark):
    from glyphmill.functions import text as X

    cases = {"flight AB123 now": "flight AB 123 now", "toParis we go ZRH 815": "to Pariswe go ZRH 815", "someWord here": "some Word here", "https://a.bc/AB12": "https://a.bc/AB 12", "plain": "plain", "A l o n e": "A l o n e"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.respace(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
