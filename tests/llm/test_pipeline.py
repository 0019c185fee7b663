import random

import corpus_pipeline as p
from glyphmill.llm import decontaminate, minhash
from test_quality import brute_force


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(400)], [f"b{i}%%" for i in range(400)]
    say = lambda n, words=good: " ".join(rng.choice(words) for _ in range(n))
    item = say(20)
    rows = [(i, say(40, bad if i % 4 == 0 else good), "en", f"s{i % 3}", 0) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(40)]
    rows += [(2000 + i, f"{say(30)} {item} {say(9)}", "en", "s1", 0) for i in range(5)]
    rows += [(3000 + i, f"{say(30)} password = hunter2secret{i} {say(9)}", "en", None, 0) for i in range(5)]
    rows += [(None, None, None, None, None), (4000, "", "en", "s1", 0)]
    save = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(i, int(i % 4 != 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    save("benchmark", [(1, item)], "item_id long, text string")

    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    texts = {r[0]: r[1] for r in rows}
    kept = p.keep_quality(spark, docs, d)
    assert kept.columns == p.DOCUMENT
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r, (_, k) in zip(rows, brute_force(rows, [(i, int(i % 4 != 0)) for i in range(300)]), strict=True) if k}
    good = {i for i, t in texts.items() if t and "%%" not in t}
    assert len(ids & good) > 0.9 * len(good) and len(ids - good) < 0.1 * len(texts)

    one = p.drop_near_duplicates(spark, kept, d)
    want = {i for i, _, _, k in minhash.brute_force([(i, texts[i]) for i in ids]) if k}
    assert {r.doc_id for r in one.collect()} == want and not any(1000 <= i < 1040 and i - 1000 in ids for i in want)

    clean = p.drop_contaminated(spark, one, d)
    left = {i for i, _, hit, *_ in decontaminate.brute_force([(i, texts[i]) for i in want], [(1, item)]) if not hit}
    assert {r.doc_id for r in clean.collect()} == left and not any(2000 <= i < 2005 for i in left)

    masked = {r.doc_id: r.text for r in p.mask_secrets(spark, clean, d).collect()}
    assert set(masked) == left and left & set(range(3000, 3005))
    assert all(("[SECRET]" in t) == (3000 <= i < 3005) and "hunter2" not in t for i, t in masked.items())

    last = p.run(spark, d)
    got = {r.doc_id: r for r in last.collect()}
    assert set(got) <= left and all(0 < r.taken <= 3 * r.size for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - sum(len(t.split()) for t in masked.values())) <= 200
