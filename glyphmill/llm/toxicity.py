"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context windows that part quotation from abuse.

Lexicon: learned from labelled documents.  A term is a whole word, or a stem (the beginning of VARIED or more different
words) together with the number of different words, 1 to 3, that a document must have of it.  Candidates are terms of at
least LEAST toxic documents, of whose documents at least PRECISION are toxic.  Of these a greedy cover of the toxic
documents is taken (each clean document that has a term costs COST), as long as a term adds a share GAIN of them, or the
share AGAIN counting those that one or two terms cover already; so words which only happen to stand in toxic documents stay
out.  A term in fewer than a share GAIN of the toxic documents can never be taken, so only the others come to the driver:
at most the terms of a document divided by GAIN.

Matching: the terms form a trie; its intersection with the Levenshtein automata of all terms (one edit for words of
SHORT letters or more, two from twice FUZZY; for stems from FUZZY letters, as four letters and an edit begin too many
words) is made deterministic as words are read, state by state, and shared by all texts.  A stem matches any beginning of
a word.

The sample may hold the two labels in other shares than all labels do; clean counts are scaled to those, so that precision,
weights and p0 do not depend on the size of the input.

Score: the probability that at least one hit is abuse, 1 - (1 - p0) * product of (1 - p * c) over hits with p * c of a half
or more; without such a hit the largest p * c, or p0.  p is a term's smoothed precision for its number of edits; where the
labelled documents show no such hit, that of all terms of its kind, length and number of edits.  c is 1, or the learned
weight of hits whose context window says that they are quoted: quotation marks around them or a reporting word within
REACH words.  p0 is the share of toxic documents among those without a hit.

Edge cases: null and empty texts score p0; without toxic labels every score is p0 = 0; null labels and labels of unknown
documents are passed over; rows of one doc_id are each scored; columns named like results are replaced; empty tables give
no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, with_results

SAMPLE = 20_000
PRECISION, LEAST, GAIN, AGAIN, COST, TIMES = 0.85, 3, 0.003, 0.02, 4, 3
SHORTEST, LONGEST, VARIED = 4, 8, 4
FUZZY, SHORT = 5, 4
REACH = 5
#: Words that report speech.
REPORTING = frozenset("said says wrote called calls quote quoted quotes word term says dit mot sagte wort dijo palabra".split())
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‘’'"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Lexicon:
    """Trie of words and stems with its lazily determinised Levenshtein automaton."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.edits: list[int] = [0]  # the most that a term below a node allows
        for terms, at, least in ((words, self.word_at, SHORT), (stems, self.stem_at, FUZZY)):
            for term in terms:
                allowed = self.allowed(term, least)
                node = 0
                self.edits[0] = max(self.edits[0], allowed)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.edits.append(0)
                    node = self.children[node][c]
                    self.edits[node] = max(self.edits[node], allowed)
                at[node] = term
        self.letters = {c for d in self.children for c in d}
        self.start = self._close({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple] = {}
        self.begins: dict[frozenset, tuple] = {}
        self.seen: dict[str, tuple] = {}

    @staticmethod
    def allowed(term: str, least: int = SHORT) -> int:
        return 2 if len(term) >= 2 * FUZZY else int(len(term) >= least)

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """Adds what a missing letter leads to; a state with more edits than its subtree allows is dropped."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.edits[child] and (child, e + 1) not in states:
                    states.add((child, e + 1))
                    todo.append((child, e + 1))
        return frozenset(states)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e))
                elif e < self.edits[child]:
                    out.add((child, e + 1))
            if e < self.edits[node]:
                out.add((node, e + 1))
        return self._close(out)

    def _end(self, state: frozenset, at: dict[int, str], least: int) -> tuple:
        """Terms of ``at`` accepted here with their least edits."""
        best: dict[str, int] = {}
        for node, e in state:
            term = at.get(node)
            if term is not None and e <= self.allowed(term, least):
                best[term] = min(e, best.get(term, 9))
        return tuple(sorted(best.items()))

    def match(self, word: str) -> tuple[tuple[str, int], ...]:
        """(term, edits) of all terms that accept the word; stems end in ``*``."""
        found = self.seen.get(word)
        if found is not None:
            return found
        state, stems = self.start, {}
        for c in ("", *word):
            if c:
                key = (state, c if c in self.letters else "")
                after = self.steps.get(key)
                if after is None:
                    after = self.steps[key] = self._step(state, key[1])
                state = after
            begun = self.begins.get(state)
            if begun is None:
                begun = self.begins[state] = self._end(state, self.stem_at, FUZZY)
            for stem, e in begun:
                stems[stem] = min(e, stems.get(stem, 9))
            if not state:
                break
        if state not in self.ends:
            self.ends[state] = self._end(state, self.word_at, SHORT)
        found = tuple(sorted((t + "*", e) for t, e in stems.items())) + self.ends[state]
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[word] = found
        return found


def kind_of(term: str, edits: int) -> tuple[bool, int, int]:
    """Stem or word, letters (the shorter a term, the more words are near it) and edits."""
    return "*" in term, min(len(term.split("*")[0]), 2 * FUZZY), edits


def _quoted(text: str, start: int, end: int) -> bool:
    """Quotation marks around the hit within its window, or a reporting word near."""
    left, right = text[max(0, start - 60) : start], text[end : end + 60]
    before, after = words_of(left)[-REACH:], words_of(right)[:REACH]
    if REPORTING & set(before) or REPORTING & set(after[:2]):
        return True
    return bool(re.search(rf"[{_QUOTES}][^{_QUOTES}\n]*$", left)) and bool(re.search(rf"^[^{_QUOTES}\n]*[{_QUOTES}]", right)) and not re.search(r"\w['’]\w*$", left)


def hits_of(lexicon: Lexicon, times: dict[str, list[int]], text: str | None) -> list[tuple[str, int, bool, int, int]]:
    """(term, edits, quoted, start, end) of each matching word; of several terms the one with fewest edits, words before stems.

    ``times``: for each stem the numbers of different words that are terms; the largest one reached is the hit's.
    """
    if not text:
        return []
    lower = text.lower()
    found = {w: m for w in set(_WORD.findall(lower)) if (m := lexicon.match(w))}
    if not found:
        return []
    begun = Counter(t for m in found.values() for t, _ in m if t[-1] == "*")
    reached = {t: max((k for k in times[t[:-1]] if k <= n), default=0) for t, n in begun.items()}
    best = {}
    for w, terms in found.items():
        terms = [(t + str(reached[t]), e) if t[-1] == "*" else (t, e) for t, e in terms if reached.get(t, 1)]
        if terms:
            best[w] = min(terms, key=lambda t: (t[1], "*" in t[0], t[0]))
    out = []
    for m in _WORD.finditer(lower) if best else ():
        if m[0] in best:
            out.append((*best[m[0]], _quoted(lower, m.start(), m.end()), m.start(), m.end()))
    return out


def _labelled(labels: DataFrame, doc_id: str, label: str, holdout: bool, sample: int) -> tuple[dict[int, int], float]:
    """A sample of at most ``sample`` labelled rows, half of it toxic if there are as many: those with the least hash; and what a clean one counts beside a toxic one."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).dropna().dropDuplicates(["id"])
    if holdout:
        known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    all_ = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    out, scale = {}, {}
    for y in (1, 0):
        got = {r.id: r.y for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2).collect()}
        out |= got
        scale[y] = all_[y] / len(got) if got else 1.0
    return out, scale[0] / scale[1]


def _features(text: str | None) -> tuple[set[str], set[str]]:
    """Different words of a text, and its possible terms: words, and ``stem*k`` if k or more of them begin with the stem."""
    words = set(words_of(text))
    stems = Counter(w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return words, {w for w in words if SHORTEST <= len(w) <= 30} | {f"{s}*{k}" for s, n in stems.items() for k in range(1, min(n, TIMES) + 1)}


def _known_rows(batch: pa.RecordBatch, known: dict[int, int], ids: np.ndarray) -> Iterator[tuple[int, str | None]]:
    """(label, text) of the batch's rows in the sample."""
    own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(np.isin(own, ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)):
        yield known[int(own[i])], batch.column(1)[i].as_py()


def _candidates(docs: DataFrame, sent, scale: float, toxic: int) -> pd.DataFrame:
    """Terms with the number of toxic and (scaled) clean documents that have them; only those that a cover can take come back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        ids = np.array(sorted(known), np.int64)
        counts = (Counter(), Counter())
        begun: dict[str, int] = {}  # 63 bits for the words that a stem begins
        for batch in batches:
            for y, text in _known_rows(batch, known, ids):
                words, terms = _features(text)
                counts[y].update(terms)
                for w in words if y else ():
                    bit = 1 << zlib.crc32(w.encode()) % 63
                    for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
                        begun[w[:n]] = begun.get(w[:n], 0) | bit
        terms = list(counts[0].keys() | counts[1].keys())
        numbers = ([counts[1][t] for t in terms], [counts[0][t] for t in terms], [begun.get(t.split("*")[0], 0) for t in terms])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], ["term", "toxic", "clean", "begun"])

    sums = docs.mapInArrow(released(each), "term string, toxic long, clean long, begun long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("begun").alias("begun"))
    varied = ~F.col("term").contains("*") | (F.bit_count("begun") >= VARIED)
    sums = sums.withColumn("clean", F.col("clean") * scale)
    least = max(LEAST, GAIN * toxic)
    good = sums.where(varied & (F.col("toxic") >= least) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    return good.toPandas().sort_values(["toxic", "term"], ascending=[False, True])


def _cover(docs: DataFrame, sent, terms: list[str], clean: list[float]) -> list[str]:
    """Greedy cover of the sample's toxic documents, of which half of ``sample`` come back at most."""
    wanted = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        ids = np.array(sorted(k for k, y in known.items() if y), np.int64)
        for batch in batches:
            found = [sorted(wanted.value[t] for t in _features(text)[1] if t in wanted.value) for _, text in _known_rows(batch, known, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["terms"])

    having: dict[int, set[int]] = {}
    if not terms:
        return []
    rows = [r.terms for r in docs.mapInArrow(released(each), "terms array<int>").collect()]
    for d, found in enumerate(rows):
        for t in found:
            having.setdefault(t, set()).add(d)
    covers, chosen = [0] * len(rows), []
    while having:
        gains = {t: (sum(covers[d] == 0 for d in v), sum(covers[d] < 3 for d in v)) for t, v in having.items()}
        having = {t: v for t, v in having.items() if gains[t][0] >= max(LEAST, GAIN * len(rows)) or gains[t][1] >= max(LEAST, AGAIN * len(rows))}
        if not having:
            break
        t = max(having, key=lambda t: (gains[t][0] + gains[t][1] / 10 - COST * clean[t], -len(terms[t]), terms[t]))
        chosen.append(terms[t])
        for d in having.pop(t):
            covers[d] += 1
    return chosen


def _split(terms: list[str]) -> tuple[list[str], dict[str, list[int]]]:
    """Words, and stems with their numbers."""
    times: dict[str, list[int]] = {}
    for t in terms:
        if "*" in t:
            times.setdefault(t.split("*")[0], []).append(int(t.split("*")[1]))
    return sorted(t for t in terms if "*" not in t), {k: sorted(v) for k, v in sorted(times.items())}


def _evidence(docs: DataFrame, sent, words: list[str], times: dict[str, list[int]]) -> tuple[dict, dict, tuple[int, int]]:
    """From the labelled documents: (toxic, all) documents by (term, edits), by quoted or not, and of those without a hit."""
    terms_sent = docs.sparkSession.sparkContext.broadcast((words, times))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (words, times) = sent.value, terms_sent.value
        lexicon = Lexicon(words, list(times))
        ids = np.array(sorted(known), np.int64)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in _known_rows(batch, known, ids):
                hits = hits_of(lexicon, times, text)
                for name in {f"t {e} {t}" for t, e, *_ in hits} | ({"q"} if hits and all(h[2] for h in hits) else {"u"} if hits else {"n"}):
                    at = counts.setdefault(name, [0, 0])
                    at[0] += y
                    at[1] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[n][0] for n in names], pa.int64()), pa.array([counts[n][1] for n in names], pa.int64())], ["name", "toxic", "all"])

    rows = docs.mapInArrow(released(each), "name string, toxic long, all long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all")).collect()  # some per term
    got = {r["name"]: (r["toxic"], r["all"]) for r in rows}
    terms = {(n[4:], int(n[2])): v for n, v in got.items() if n.startswith("t ")}
    return terms, {k: got.get(k, (0, 0)) for k in "qu"}, got.get("n", (0, 0))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", holdout: bool = True, sample: int = SAMPLE) -> dict:
    """The model: terms, their weights, the weight of quoted hits and the base rate.  Fitted on ``sample`` documents at most."""
    known, scale = _labelled(labels, doc_id, label, holdout, sample)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    found = _candidates(texts, sent, scale, sum(known.values())) if known else pd.DataFrame({"term": [], "clean": []})
    words, times = _split(_cover(texts, sent, list(found["term"]), list(found["clean"])))
    terms, by, none = _evidence(texts, sent, words, times) if known else ({}, {"q": (0, 0), "u": (0, 0)}, (0, 0))
    every = lambda at: (at[0], at[0] + (at[1] - at[0]) * scale)
    terms, by, none = {k: every(v) for k, v in terms.items()}, {k: every(v) for k, v in by.items()}, every(none)
    kinds: dict[tuple, list[float]] = {}
    for (term, edits), (t, n) in terms.items():
        at = kinds.setdefault(kind_of(term, edits), [0.0, 0.0])
        at[0] += t
        at[1] += n
    # a misspelling that no label shows counts as those of its kind, a kind that none shows as half a term
    weights = {k: (t + (0.5 if k[1] else 0.95)) / (n + 1) for k, (t, n) in terms.items()}
    unseen = {k: (t + 0.6 * 2) / (n + 2) for k, (t, n) in kinds.items() if k[2]}
    plain = (by["u"][0] + 1) / (by["u"][1] + 1)
    quoted = min(1.0, (by["q"][0] + 0.3 * 5) / (by["q"][1] + 5) / plain)
    return {"words": words, "stems": times, "weights": weights, "unseen": unseen, "quoted": quoted, "base": min(0.4, none[0] / none[1]) if none[1] else 0.0}


def probability(model: dict, hits: list) -> float:
    best: dict[tuple, float] = {}
    for term, edits, quoted, *_ in hits:
        p = model["weights"].get((term, edits), model["unseen"].get(kind_of(term, edits), 0.6) if edits else 0.45)
        best[(term, edits)] = max(best.get((term, edits), 0.0), p * (model["quoted"] if quoted else 1.0))
    clean = 1 - model["base"]
    for p in best.values():
        clean *= 1 - min(p, 0.9999) if p >= 0.5 else 1
    return 1 - clean if clean < 1 - model["base"] else min(0.499, max([model["base"], *best.values()]))


def _scored(docs: DataFrame, model: dict, text: Column) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the terms of the cover

    @F.pandas_udf("score double, hits array<struct<term:string,edits:int,quoted:boolean,start:int,end:int>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        lexicon = Lexicon(model["words"], list(model["stems"]))
        for texts in batches:
            hits = [hits_of(lexicon, model["stems"], t) for t in texts]
            yield pd.DataFrame({"score": [probability(model, h) for h in hits], "hits": [[dict(zip(("term", "edits", "quoted", "start", "end"), x, strict=True)) for x in h] for h in hits]})

    return score(text)


def score_toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted and hits (offsets in the lowered text)."""
    got = "toxicity_"
    while got in docs.columns:
        got += "_"
    scored = docs.withColumn(got, _scored(docs, model, F.col(f"`{text}`")))
    score = F.col(f"{got}.score")
    return with_results(scored, {"score": score, "predicted": (score >= 0.5).cast("int"), "hits": F.col(f"{got}.hits")}).drop(got)


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
