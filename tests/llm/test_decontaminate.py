import random

from glyphmill.llm import decontaminate as d

DOCS = "doc_id long, text string, n_hit string, Items int"


def corpus(rng):
    vocabulary = ["the", "cat", "été", "Größe", "x9", "im"]
    say = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(None, "solo Word"), (99, None), (98, ""), (97, "The CAT été the cat été the cat été the")]
    docs = [(i, say(rng.randint(0, 120)) + rng.choice(["", " SOLO... word "]) + (rng.choice(items)[1] or "")) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, " .,; "), (3, docs[3][1]), (None, docs[4][1]), (103, "the cat " * 9000)], items


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(*x, "clash", 1) for x in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    return d.decontaminate(a, b, **more)


def test_against_brute_force(spark):
    docs, items = corpus(random.Random(5))
    found = run(spark, docs, items)
    got = sorted(map(tuple, d.digest(found).collect()), key=str)
    assert got == sorted(d.brute_force(docs, items), key=str)
    for row in found.where("contaminated").limit(5).collect():
        assert all(0 <= s.start < s.end <= len(row.text) for s in row.spans)
        assert sum(len(d.words_of(row.text[s.start : s.end])) for s in row.spans) == row.n_hit


def test_benchmark_in_blocks_gives_the_same(spark):
    docs, items = corpus(random.Random(6))
    one, many = run(spark, docs, items), run(spark, docs, items, block_bytes=200)
    assert sorted(map(str, d.digest(one).collect())) == sorted(map(str, d.digest(many).collect()))
    assert sorted(map(str, one.select("doc_id", "spans").collect())) == sorted(map(str, many.select("doc_id", "spans").collect()))


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]).count() == 0
    assert [r.n_hit for r in run(spark, [(1, "a b")], []).collect()] == [0]
