import random

from pyspark.sql.functions import lit

from glyphmill.llm import repeats as r


def corpus(rng, window):
    say = lambda n, a="abcdefghij  é🙂": "".join(rng.choice(a) for _ in range(n))
    shared = [say(rng.choice([window - 1, window, window + 1, 3 * window, 10 * window])) for _ in range(8)]
    docs = []
    for _ in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            text += say(rng.randint(0, 2 * window)) + (rng.choice(shared)[rng.randint(0, 5) :] if rng.random() < 0.5 else "")
        docs.append(text)
    docs += ["ab" * 3 * window, "ab" * 2 * window, "=" * window, "=" * (window + 1), say(window, "a"), docs[3], docs[3][5:], "", None, say(40 * window, "ab")]
    docs += [docs[7][:k] + "#" + docs[7][k:] for k in range(0, len(docs[7]), 7)]
    rows = [(i, d) for i, d in enumerate(docs)]
    return rows + [(None, docs[7]), (0, docs[0]), (0, docs[0]), (1, docs[9])]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, kept string").withColumn("hit_k", lit(1)).withColumn("key", lit("k")).repartition(4)
    return sorted((tuple(x) for x in r.digest(r.cut_repeats(df, **more)).collect()), key=str)


def test_against_brute_force(spark):
    for seed, window, passage in ((1, 20, 3), (2, 50, 7)):
        rows = corpus(random.Random(seed), window)
        want = r.brute_force(rows, window, passage)
        assert run(spark, rows, window=window, passage=passage) == sorted(want, key=str) and any(w[5] for w in want)


def test_large_buckets_give_the_same(spark):
    rows = corpus(random.Random(4), 20)
    assert run(spark, rows, window=20, passage=3, bucket=2) == sorted(r.brute_force(rows, 20, 3), key=str)


def test_large_buckets_with_joins_by_shuffle(spark):
    rows = corpus(random.Random(4), 20)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = run(spark, rows, window=20, passage=3, bucket=12)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted(r.brute_force(rows, 20, 3), key=str)


def test_long_text_in_pieces(spark):
    rng = random.Random(5)
    block = "".join(rng.choice("abcdefgh") for _ in range(3000))
    long = "".join(rng.choice("abcdefgh") for _ in range(1_300_000))
    text = long[:1_047_000] + block + long[1_047_000:]
    rows = [(1, text), (2, "x" + block)]
    got = run(spark, rows)
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(1, len(text), 3000, 1), (2, 3001, 3000, 1)]


def test_passages_of_other_documents_only(spark):
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, own = say(51), say(60)
    rows = [(1, " ".join(say(30) + passage + say(9))), (2, "\n".join(say(5) + passage).upper()), (3, " ".join(say(9) + passage[:50])), (4, " ".join(own + say(70) + own))]
    rows += [(5, " ".join(own[:50] + say(3))), (6, rows[0][1]), (6, rows[0][1])]
    got = {g[0]: g[5] for g in run(spark, rows)}
    assert got == {1: 90, 2: 51, 3: 0, 4: 0, 5: 0, 6: 90}


def test_empty_table(spark):
    assert run(spark, []) == []
