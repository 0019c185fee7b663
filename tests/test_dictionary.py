"""Queries with a dictionary of the corpus, on documents and dictionaries made here."""

from collections import Counter

import pytest

from glyphmill.plans import folds, items


@pytest.fixture
def folder(spark, tmp_path):
    def write(*texts):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def large(spark):
    """More than 20,000 words, those of the texts at the alphabet's end."""
    return spark.createDataFrame([(f"a{i:05d}",) for i in range(20_001)] + [("wombat",), ("winter",), ("zebra",)], "word string")


def test_smart_boundary_knows_the_whole_dictionary(spark, folder, monkeypatch):
    monkeypatch.setattr(folds, "frequent_words", lambda *_, **__: large(spark))
    got = {(r.phase, r.space): r.n for r in folds.smart_boundary(spark, folder("zebra wombat")).collect()}
    assert got[("dictionary", False)] == 2


def test_lexical_split_knows_the_whole_dictionary(spark, folder, monkeypatch):
    monkeypatch.setattr(items, "frequent_words", lambda *_, **__: large(spark))
    got = [r.split_text for r in items.lexical_split(spark, folder("winter winter winter")).collect()]
    assert got == ["winter winter winter"]


def test_lexical_split_reads_whole_lines(spark, folder, monkeypatch):
    monkeypatch.setattr(items, "frequent_words", lambda *_, **__: large(spark))
    texts = ["one two three four five\nsix seven\n\ntwo three  four", "three four five " * 200 + "end"]
    want = Counter("".join(w[i : i + 3]) for t in texts for line in t.split("\n") for w in [line.split(" ")] for i in range(len(w) - 2))
    assert {r.text: r.n for r in items.lexical_split(spark, folder(*texts)).collect()} == want
