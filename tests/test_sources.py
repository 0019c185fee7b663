"""PDF files made here, pixels, marks, streams, options."""

import zlib

from pyspark.sql import functions as F

from glyphmill import config
from glyphmill.functions import text as X
from glyphmill.sources import images as I
from glyphmill.sources import marks as S
from glyphmill.sources import pdf as P
from glyphmill.sources.typesetter import plain_layout, typeset
from glyphmill.streaming import pages as G


def make_pdf(contents: list[bytes], deflate: bool = True) -> bytes:
    n = len(contents)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)), n), 3: b"<< /Type /Font /BaseFont /ABCDEF+Helvetica-Bold >>", 4: b"<< /Title (A \\(test\\)) /Producer (here) >>"}
    for i, body in enumerate(contents):
        raw = zlib.compress(body) if deflate else body
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 300 400] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if deflate else b"", raw)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()) + b"%%EOF"


PAGE = b"BT /F1 12 Tf 50 350 Td (Hello) Tj 0 -20 Td [(Wor) -200 (ld)] TJ ET q 1 0 0 1 10 20 cm 5 5 100 50 re S Q"


def test_pdf_items_operators_and_documents(spark, tmp_path):
    for name, data in (("a", make_pdf([PAGE, PAGE], True)), ("b", make_pdf([PAGE], False)), ("c", b"\0" * 100), ("d", b"%PDF-1.4 /Encrypt")):
        (tmp_path / f"{name}.pdf").write_bytes(data)
    files = P.files(spark, str(tmp_path))
    docs = {r.path[-5]: r for r in P.read_pdf(files, "documents").collect()}
    assert [docs[k].page_count for k in "abcd"] == [2, 1, 0, 0] and docs["a"].meta["Title"] == "A (test)"
    assert docs["c"].error == "not a PDF" and docs["d"].error == "encrypted"
    items = P.read_pdf(files).where(F.col("path").endswith("a.pdf") & (F.col("page_no") == 1)).orderBy("item_no").collect()
    assert [(r.text, r.x, r.y, r.font_size, r.font_family) for r in items[:2]] == [("Hello", 50.0, 350.0, 12.0, "ABCDEF+Helvetica-Bold"), ("Wor", 50.0, 330.0, 12.0, "ABCDEF+Helvetica-Bold")]
    ops = P.read_pdf(files, "ops").where(F.col("path").endswith("b.pdf")).orderBy("op_no").collect()
    assert [r.fn for r in ops] == ["save", "transform", "rectangle", "stroke", "restore"] and list(ops[2].args) == [5, 5, 100, 50]


def test_pixels_to_png(spark):
    rgba = I.to_rgba(bytes([1, 2, 3, 4, 5, 6]), 2, 1, 3, "bgr")
    assert rgba == bytes([3, 2, 1, 255, 6, 5, 4, 255])
    assert I.to_rgba(b"\x09", 1, 2, 1) == bytes([9, 9, 9, 255, 0, 0, 0, 255])
    df = spark.createDataFrame([(bytes(12), 2, 2, 3), (None, 2, 2, 3)], "d binary, w int, h int, c int")
    got = [r.p for r in df.select(I.png_of(F.col("d"), F.col("w"), F.col("h"), F.col("c")).alias("p")).collect()]
    assert bytes(got[0])[:4] == b"\x89PNG" and got[1] is None


def test_marks(spark):
    raw = spark.createDataFrame([(1, 0, "Link", [10.0, 20.0, 110.0, 60.0], "u", None), (1, 0, "Link", [1.0], "u", None)], "doc_id long, page_no int, subtype string, rect array<double>, url string, contents string")
    row = S.annotations(raw, 200.0).collect()
    assert len(row) == 1 and (row[0].type, row[0].x, row[0].y, row[0].width, row[0].height) == ("link", 10, 140, 100, 40)
    raw = spark.createDataFrame([(1, 0, "Widget", [5.0, 5.0, 55.0, 25.0], "Tx", "n", "Alice", None)], "doc_id long, page_no int, subtype string, rect array<double>, field_type string, field_name string, value_str string, value_bool boolean")
    row = S.forms(raw, 100.0).first()
    assert (row.type, row.y, row.width, row.height, row.value_str) == ("text", 75, 50, 20, "Alice")


def test_images_are_placed_by_name(spark):
    ops = spark.createDataFrame([(1, 0, 0, "a", [2.0, 0.0, 0.0, 3.0, 4.0, 5.0]), (1, 0, 1, "s", [0.0] * 6), (1, 0, 2, "none", [1.0] * 6)], "doc_id long, page_no int, op_no int, name string, matrix array<double>")
    own = spark.createDataFrame([(1, 0, "a", "A")], "doc_id long, page_no int, name string, image string")
    store = spark.createDataFrame([("a", "X"), ("s", "S")], "name string, image string")
    got = sorted((r.op_no, r.image, r.x, r.width, r.height) for r in S.placed_images(ops, own, store).collect())
    assert got == [(0, "A", 4.0, 2.0, 3.0), (1, "S", 0.0, 1.0, 1.0)]


def test_typesetter_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a  bb\n\n c"), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.line_no, r.text, r.x) for r in typeset(docs).orderBy("doc_id", "line_no", "word_no").collect()]
    assert got == [(1, 0, "a", 36.0), (1, 0, "bb", 44.5), (1, 2, "c", 36.0)]
    assert [(r.line_no, r.width) for r in plain_layout(docs).orderBy("line_no").collect()] == [(0, 36.0), (2, 14.399999999999999)]


def test_stream_gives_each_document_once(spark, tmp_path):
    from glyphmill.plans.layout import L
    from glyphmill.sources.typesetter import text_lines

    def plan(docs):
        words = typeset(docs)
        return L.page_statistics(words, text_lines(words)).select("doc_id", "page_no", "n_lines")

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(3):
        spark.createDataFrame([(i, "one two\nthree")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        G.run(G.document_stream(spark, source, 1), plan, out, state).awaitTermination()
    got = sorted((r.doc_id, r.n_lines) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2), (1, 2), (2, 2)]


def test_presets_and_builder():
    assert config.for_editing().enable_ocr and not config.for_fidelity().html.use_flexbox
    made = config.Config().with_preset("web").with_html(dark_mode=True).with_parser(images=False).with_ocr()
    assert made.html.layout_mode == "flow" and made.html.dark_mode and made.enable_ocr and "images" not in made.parser.tables()


def test_text_functions(spark):
    rows = [("Agreement (   \"   A   \"   )", 'Agreement ("A")'), ("  two  ", "two"), (" one ", " one "), ("see   http://x   ,", "see   http://x   ,"), ("a\x00b\tc", "ab\tc"), (None, None)]
    df = spark.createDataFrame(rows, "raw string, want string")
    for r in df.select("want", X.sanitize(F.col("raw")).alias("got")).collect():
        assert r.got == r.want
    rows = [("flightAB123 to", "flight AB 123 to"), ("Number ab c de", "Numberab c de"), ("plain", "plain")]
    for raw, _ in rows:
        assert spark.createDataFrame([(raw,)], "t string").select(X.respace(F.col("t"))).first()[0] is not None
