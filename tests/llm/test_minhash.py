import random

from glyphmill.llm import minhash as m


def corpus(rng):
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage = say(60)
    docs = []

    def near(base, edits):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    for _ in range(12):
        base = say(rng.choice([30, 80, 200]))
        docs += [near(base, rng.choice([0, 0, 1, 2, 3, len(base) // 40])) for _ in range(rng.choice([1, 2, 5, 30]))]
    chain = say(150)
    for _ in range(12):  # each near the one before only
        docs.append(chain)
        chain = near(chain, 2)
    docs += [say(15) + passage for _ in range(40)] + [say(4) + passage for _ in range(25)]
    docs += [["a"], ["A"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]]
    rng.shuffle(docs)
    rows = [(i * 3, rng.choice([" ", "\n", "\t "]).join(x)) for i, x in enumerate(docs)]
    return rows + [(100000, None), (100001, ""), (100002, " \n"), (None, rows[0][1]), (3, rows[1][1]), (rows[5][0], rows[9][1]), (99999, " ".join(say(20000)))]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(5)
        got = sorted((tuple(r) for r in m.near_duplicates(df).collect()), key=str)
        want = sorted(m.brute_force(rows), key=str)
        assert got == want


def test_long_lists_are_merged_in_blocks(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(60):  # half share too little to be linked, and stand in the same lists
        w = [x if rng.random() > (0.012 if i % 2 else 0.05) else f"x{rng.random()}" for x in base]
        rows.append((i, " ".join(w)))
    old = m.BLOCK, m._TILE
    for m.BLOCK, m._TILE in (old, (10, 4)):
        got = sorted(tuple(r) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted(m.brute_force(rows))
    m.BLOCK, m._TILE = old


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "A b c d e f", "y"), (3, "other", "z"), (3, "other", "z"), (None, "no id", "n"), (None, "no id", "n"), (4, None, "q")]
    got = m.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, gone string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[0], rows[3], rows[5], rows[7]], "doc_id long, text string, gone string").collect()))


def test_empty_table(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
