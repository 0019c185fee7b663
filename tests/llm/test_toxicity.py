import random

from glyphmill.llm import toxicity as t


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_plain_distance():
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(40)})
    stems = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(6)})
    lexicon = t.Lexicon(terms, stems)
    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 13))) if rng.random() < 0.5 else rng.choice(terms)[rng.randint(0, 2) :] + rng.choice(["", "d", "a"])
        begun = {s: min(levenshtein(word[:i], s) for i in range(len(word) + 1)) for s in stems}
        want = {(s + "*", d) for s, d in begun.items() if d <= t.Lexicon.allowed(s, t.FUZZY)} | {(x, d) for x in terms if (d := levenshtein(word, x)) <= t.Lexicon.allowed(x)}
        assert set(lexicon.match(word)) == want


def data():
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("lor", "dol", "sit", "mag") for b in ("em", "or", "um") for c in ("na", "ti", "qu", "es")]
    rows, labels = [], []
    for i in range(800):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "scoundrel", "grotzen" + rng.choice(words)]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_misspelling_and_quotation(spark):
    rows, labels = data()
    hard = [(9000, "dolorna you blokhead sitemti"), (9001, "dolorna scoundrell"), (9002, 'he said "blockhead" was a word'), (9003, None), (9004, ""), (9005, "blocked heads"), (None, "scoundrel")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + hard], "doc_id long, text string, Score string")
    model = t.learn(docs, spark.createDataFrame(labels + [(None, 1), (1, None), (77777, 1)], "doc_id long, toxic int"))
    got = {(r.doc_id, r.text): r for r in t.score_toxicity(docs, model).collect()}
    truth = dict(labels)
    for (d, _), r in got.items():
        if d in truth:
            assert r.predicted == truth[d]
    by = {d: r for (d, _), r in got.items()}
    assert by[9000].predicted == 1 and by[9001].predicted == 1 and by[None].predicted == 1
    assert by[9002].score < by[9000].score and by[9003].predicted == by[9004].predicted == by[9005].predicted == 0
    held = t.digest(t.score_toxicity(docs, model))
    assert held.columns == ["doc_id", "held_out", "score", "predicted"]


def test_short_terms_and_stems_with_edits(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lorem", "dolor", "sitam", "magna") for b in ("ipsum", "elit", "quam", "nec")]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(20)]
        if i % 6 == 0:
            w[3] = rng.choice(["scum", "schelm" + rng.choice(words)])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    more = [(9000, "lorem scvm nec"), (9001, "lorem scuum nec"), (9002, "dolor schlemmagna"), (9003, "dolor sittam")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    model = t.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in t.score_toxicity(docs, model).collect()}
    assert [got[i] for i in (9000, 9001, 9002, 9003)] == [1, 1, 1, 0] and all(got[i] == y for i, y in labels)


def test_sampled_labels_count_at_their_true_rate(spark):
    """The same data with a sample that halves the clean labels: precision, weights and base rate hardly move."""
    rng = random.Random(6)
    words = [f"w{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 20 == 0
        w = [rng.choice(words) for _ in range(15)]
        if toxic:
            w[0] = "grobian"
        elif rng.random() < 0.05:
            w[0] = "mottled"  # among clean documents only
        if toxic and rng.random() < 0.5:
            w[1] = "mottled"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, part = t.learn(docs, known, holdout=False), t.learn(docs, known, holdout=False, sample=800)
    assert "grobian" in whole["words"] + list(whole["stems"]) or any("grobian".startswith(x) for x in whole["stems"])
    assert whole["words"] == part["words"] and not any("mottled".startswith(x) for x in [*part["words"], *part["stems"]])
    assert abs(whole["base"] - part["base"]) < 0.01


def test_score_against_plain_code(spark):
    """Scores from the model by hand: every word against every term by the plain distance."""
    rows, labels = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = t.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in t.score_toxicity(docs, model).collect()}
    for i, text in rows[:150]:
        near: dict[str, list[tuple[str, int]]] = {}
        for w in set(text.split()):
            for x in model["words"]:
                if (d := levenshtein(w, x)) <= t.Lexicon.allowed(x):
                    near.setdefault(w, []).append((x, d))
            for x in model["stems"]:
                if (d := min(levenshtein(w[:j], x) for j in range(len(w) + 1))) <= t.Lexicon.allowed(x, t.FUZZY):
                    near.setdefault(w, []).append((x + "*", d))
        best = {}
        for hits in near.values():
            named = []
            for x, d in hits:
                if x.endswith("*"):
                    n = sum(any(y == x for y, _ in other) for other in near.values())
                    k = max((k for k in model["stems"][x[:-1]] if k <= n), default=0)
                    if not k:
                        continue
                    x += str(k)
                named.append((d, "*" in x, x))
            if named:
                d, _, x = min(named)
                best[x, d] = model["weights"].get((x, d), model["unseen"].get(t.kind_of(x, d), 0.6) if d else 0.45)
        clean = 1 - model["base"]
        for p in best.values():
            clean *= 1 - min(p, 0.9999) if p >= 0.5 else 1
        want = 1 - clean if clean < 1 - model["base"] else min(0.499, max([model["base"], *best.values()]))
        assert abs(got[i] - want) < 1e-9


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = t.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in t.score_toxicity(docs, model).collect()] == [0.0]
    assert t.score_toxicity(docs.limit(0), model).count() == 0
