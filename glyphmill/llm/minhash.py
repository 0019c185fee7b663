"""MinHash near-duplicates by an inverted join on signature coordinates, confirmed on the full shingle sets.

A document's set is its distinct shingles of five words (see ``sketch.shingle_sets``).  Documents with
100 * |A and B| >= 75 * |A or B| are linked; a group is a connected component.

1. Every text gives its set size, a 128-bit digest of the set and a signature of COORDINATES minima.  Documents of one set
   are a class, represented by the least doc_id; only classes go on.
2. Postings: a class stands under (coordinate, value) tokens.  Two classes that agree in MATCHES coordinates or more
   share a token among the COORDINATES - MATCHES + 1 rarest of each, in any fixed order of tokens; the order is by how
   often a token's cell occurs among all tokens of all classes (a table of 2 ** CELLS counts), so that what many documents
   share comes last.  Tokens outside that prefix are skipped and only probed for pairs that met in it.
3. Pairs of lists up to SMALL, and the least member of longer lists with the others, remain as candidates if their
   signatures agree in MATCHES coordinates; with J >= 0.75 fewer than 32 of 64 has a chance of about 5e-6.  They are
   compared on the full sets, which are computed again from the texts of those documents alone, and form components.
4. Longer lists whose members are not yet all in one component are merged in place: within a list, blocks of BLOCK
   members against each other, signatures are counted and full sets compared for members of different components only,
   and what joins two components comes out.  A pair is compared under the rarest token that both have (which stands in
   both prefixes) and under no other.  No list is cut, and no pairs of it are written.

Edge cases: a null, empty or wordless text has the empty set and no links; a null doc_id has no links, a null component
and is kept; rows of one doc_id count as one document, linked if one of its texts is; repeated rows get equal results; an
empty table gives no rows; other input columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, released, written
from .components import components
from .sketch import U, binary, bloom, counted, in_bloom, map_bits, maybe_in, mixed, numbers, shingle_sets

COORDINATES, MATCHES = 64, 32
CELLS = 17
SMALL = 8
BLOCK = 2000
_RNG = np.random.Generator(np.random.PCG64(7))
_XOR = _RNG.integers(0, 1 << 64, COORDINATES, U, endpoint=False)
_MUL = _RNG.integers(0, 1 << 64, COORDINATES, U, endpoint=False) | U(1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for s in shingle_sets(binary(batch.column(1))):
            sizes.append(len(s))
            digests.append((mixed(s, 11).sum(dtype=U), mixed(s, 12).sum(dtype=U)))
            if len(s):
                signatures.append(np.array([((s ^ x) * m).min() for x, m in zip(_XOR, _MUL, strict=True)]) >> U(32))
        sizes = np.array(sizes, np.int64)
        digests = np.array(digests, U).reshape(-1, 2).view(np.int64)
        flat = np.concatenate(signatures).astype(np.uint32).view(np.int32) if signatures else np.zeros(0, np.int32)
        offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, COORDINATES, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "h1", "h2", "sig"]
        )


def _tokens(values: np.ndarray) -> np.ndarray:
    """Tokens of each signature: a row of COORDINATES hashes."""
    return mixed(values.view(np.uint32).astype(U).reshape(-1, COORDINATES) | (np.arange(1, COORDINATES + 1, dtype=U) << U(32)), 3)


def _flat(signatures: pa.Array) -> np.ndarray:
    return signatures.flatten().to_numpy()


def _frequency(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(tokens >> U(64 - CELLS)).astype(np.int64)]


def _token_counts(classes: DataFrame):
    """How often each cell of tokens occurs among all classes: 2 ** CELLS numbers, broadcast."""
    return classes.sparkSession.sparkContext.broadcast(counted(classes.select("sig"), lambda b: _tokens(_flat(b.column(0))).ravel(), CELLS))


def _postings(classes: DataFrame, sent) -> DataFrame:
    """(token, node, n) for the prefix of each class."""
    keep = COORDINATES - MATCHES + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(_flat(batch.column(2)))
            order = np.lexsort((tokens, _frequency(tokens, sent.value)), axis=1)[:, :keep]
            picked = np.take_along_axis(tokens, order, 1).view(np.int64)
            again = lambda i: np.repeat(batch.column(i).to_numpy(), keep)
            yield pa.RecordBatch.from_arrays([pa.array(picked.ravel()), pa.array(again(0)), pa.array(again(1))], ["token", "node", "n"])

    return classes.select("node", "n", "sig").mapInArrow(released(each), "token long, node long, n long")


_FITS = "4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)"


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that stand in a pair, and of a few others."""
    keys = lambda b: np.concatenate([numbers(b.column(0)), numbers(b.column(1))])
    sent = docs.sparkSession.sparkContext.broadcast(bloom(pairs, keys, map_bits(2 * pairs.count())))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(sent.value, numbers(batch.column(0)))))
            sets = list(shingle_sets(binary(batch.column(1))))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "shingles"])

    return docs.mapInArrow(released(each), "node long, shingles array<long>").where(F.size("shingles") > 0)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (u, v), the pairs whose signatures and then full sets agree enough."""
    sig = lambda side: classes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"))
    agree = F.aggregate(F.zip_with("sig_u", "sig_v", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    pairs = scratch.written(pairs.distinct().join(sig("u"), "u").join(sig("v"), "v").where(agree >= MATCHES).select("u", "v").distinct(), "pairs")
    sets = _sets_of(docs, pairs)
    full = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.join(full("u"), "u").join(full("v"), "v").where(100 * both >= 75 * (F.size("set_u") + F.size("set_v") - both)).select("u", "v").distinct()


class _Merged:
    """Components as they grow."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one side with each of the other."""
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    if not len(both):
        return np.zeros((len(a), len(b)), np.int64)
    sides = []
    for sets, flat in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        held = np.zeros((len(sets), len(both)), np.float32)
        held[row[hit], at[hit]] = 1
        sides.append(held)
    return np.rint(sides[0] @ sides[1].T).astype(np.int64)


_TILE = 256


def _merge_list(rows: list[tuple], token: int, one: int, two: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components among the members (node, n, root, block, signature, set) of blocks ``one`` and ``two`` of a token's list.

    Pairs that share a token that comes before this one in the order of the prefixes are compared in its list.
    """
    merged, out = _Merged(), []
    own = np.array([token], np.int64).view(U)
    often = _frequency(own, counts)[0]
    side = [[r for r in rows if r[3] == b] for b in (one, two)]
    for i in range(0, len(side[0]), _TILE):
        a = side[0][i : i + _TILE]
        sig_a, n_a = np.stack([r[4] for r in a]), np.array([len(r[5]) for r in a])
        tokens = _tokens(sig_a)
        before = _frequency(tokens, counts)
        before = (before < often) | (before == often) & (tokens < own[0])
        for j in range(i if one == two else 0, len(side[1]), _TILE):
            b = side[1][j : j + _TILE]
            root_a, root_b = (np.array([merged.top(r[2]) for r in x]) for x in (a, b))
            n_b = np.array([len(r[5]) for r in b])
            likely = (root_a[:, None] != root_b) & (4 * np.minimum(n_a[:, None], n_b) >= 3 * np.maximum(n_a[:, None], n_b))
            if not likely.any():
                continue
            sig_b, agree, elsewhere = np.stack([r[4] for r in b]), np.zeros(likely.shape, np.uint8), np.zeros(likely.shape, bool)
            for k in range(COORDINATES):
                same = sig_a[:, k, None] == sig_b[:, k]
                agree += same
                if before[:, k].any():
                    elsewhere |= same & before[:, k, None]
            likely &= (agree >= MATCHES) & ~elsewhere
            x, y = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
            if not len(x):
                continue
            common = _shared([a[p][5] for p in x], [b[p][5] for p in y])
            linked = likely[np.ix_(x, y)] & (100 * common >= 75 * (n_a[x][:, None] + n_b[y] - common))
            for p, q in zip(*np.nonzero(linked), strict=True):
                u, v = a[x[p]], b[y[q]]
                if merged.join(u[2], v[2]):
                    out.append((u[0], v[0]))
    return out


def _merge_lists(open_: DataFrame, docs: DataFrame, sent) -> DataFrame:
    """(token, node, n, root, size, sig) -> links (u, v).  A member of a long list stands once for each pair of its block with another."""
    nodes = open_.select(F.col("node").alias("u"), F.col("node").alias("v"))
    sets = _sets_of(docs, nodes)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = open_.select("token", "node", "n", "root", "sig", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.join(sets, "node").select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "n", "root", "block", "sig", "shingles")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, links = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
            numbers_ = [batch.column(i).to_pylist() for i in (3, 4, 5, 6)]
            sig = batch.column(7).flatten().to_numpy().reshape(-1, COORDINATES)
            shingles, ends = batch.column(8).flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.column(8).value_lengths().to_numpy(zero_copy_only=False))))
            for i, key in enumerate(keys):
                if key != last and held:
                    links += _merge_list(held, *last, sent.value)
                    held = []
                last = key
                # copies: a batch's memory must not live as long as a list
                held.append((*(x[i] for x in numbers_), sig[i].copy(), shingles[ends[i] : ends[i + 1]].copy()))
        if held:
            links += _merge_list(held, *last, sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token", "one", "two").sortWithinPartitions("token", "one", "two").mapInArrow(released(each), "u long, v long")


def _stars(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("u"), F.col("root").alias("v"))


def _links(classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Star edges (u, v) of the components of linked classes."""
    sent = _token_counts(classes)
    postings = _postings(classes, sent)
    lists = postings.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("lead")).where("size > 1")
    # sums over tokens are written before rows are joined with them, so that a join can split a long list
    with Scratch(docs.sparkSession) as first:
        lists = first.written(lists, "lists")
        shared = scratch.written(postings.join(lists, "token").select("token", "node", "n", "size", "lead"), "shared")
    stars = shared.where(f"size > {SMALL} and node != lead.node and 4 * least(n, lead.n) >= 3 * greatest(n, lead.n)").select(F.col("lead.node").alias("u"), F.col("node").alias("v"))
    small = shared.where(f"size <= {SMALL}").select("token", "node", "n")
    small = small.alias("a").join(small.alias("b"), F.expr(f"a.token = b.token and a.node < b.node and {_FITS}")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    links = _stars(_confirmed(stars.unionByName(small), classes, docs, scratch))
    own = shared.where(f"size > {SMALL}").select("token", "node", "n", "size").join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    with Scratch(docs.sparkSession) as last:
        own = last.written(own, "members")
        split = last.written(own.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token"), "split")
        open_ = scratch.written(own.join(split, "token").join(classes.select("node", "sig"), "node"), "open")
    if open_.isEmpty():
        return links
    return _stars(_merge_lists(open_, docs, sent).unionByName(links))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    named = texts.where("doc_id is not null")
    rows = written(texts.mapInArrow(released(_sketches), "doc_id long, n long, h1 long, h2 long, sig array<int>"), "sketches")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.min_by("sig", "doc_id").alias("sig"))
    classes = written(classes, "classes")
    with Scratch(docs.sparkSession) as scratch:
        links = _links(classes, named, scratch)
    roots = classes.select("h1", "h2", "n", "node").join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    roots = roots.select("h1", "h2", "n", F.coalesce("root", "node").alias("root"))
    found = rows.select("doc_id", "n", "h1", "h2").join(roots, ["h1", "h2", "n"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The same, pair by pair, for tests."""
    import re

    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None:
                continue
            if docs[i][0] == docs[j][0] and a and sets[j] or a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        r = None if d is None else least[top(i)] if sets[i] else d
        out.append((d, len(sets[i]), r, d == r))
    return out


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the least id.  Repeated rows of an id, or of a text without id, stay once."""
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    gone = written(near_duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias(free_name(docs, "gone"))).distinct(), "gone")
    sent = docs.sparkSession.sparkContext.broadcast(bloom(gone, lambda b: numbers(b.column(0)), map_bits(gone.count())))
    flag = free_name(docs, "maybe")
    rows = docs.withColumn(flag, maybe_in(sent, d.cast("long")))
    # only documents that may go are shuffled
    left = rows.where(~F.col(flag)).unionByName(rows.where(F.col(flag)).join(gone, d == F.col(gone.columns[0]), "left_anti")).drop(flag)
    twice, key = free_name(docs, "twice"), free_name(docs, "key")
    again = docs.groupBy(d.alias(twice)).count().where((F.col("count") > 1) | F.col(twice).isNull()).select(twice)
    if again.isEmpty():
        return left
    again = written(again, "again")
    once = F.coalesce(d.cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(t, F.lit("")), 256)))
    same = d.eqNullSafe(F.col(twice))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").withColumn(key, once).dropDuplicates([key]).drop(key))
