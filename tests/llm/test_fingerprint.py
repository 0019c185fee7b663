import hashlib
import random

import pandas as pd

from glyphmill.llm import fingerprint as f


def plain_digest(raw):
    """The digest byte by byte, in whole numbers; only the hash table is shared."""
    tables = [[[int(v) for v in t] for t in three] for three in f._TABLES]
    counts = [0] * 128
    for at in range(len(raw) - 4):
        for (i, j, k), (x, y, z) in zip(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)), tables, strict=True):
            mix = (((x[raw[at + i]] + y[raw[at + j]]) % 2**32 ^ z[raw[at + k]]) * 0x9E3779B1) % 2**32
            counts[mix // 2**25] += 1
    low, middle, high = (sorted(counts)[n] for n in (31, 63, 95))
    bits = "".join(format((c > low) + (c > middle) + (c > high), "02b") for c in counts)
    length = 0
    while raw and 1.1 ** (length + 1) <= len(raw) and length < 255:
        length += 1
    check = sum(raw) * 167 % 251
    return f"{check:02x}{length:02x}" + "".join(format(15 * q // high if high else 0, "x") for q in (low, middle)) + f"{int(bits, 2):064x}"


def plain_likeness(a, b):
    pairs = [[format(int(x[6:], 16), "0256b")[i : i + 2] for i in range(0, 256, 2)] for x in (a, b)]
    steps = [abs(int(x, 2) - int(y, 2)) for x, y in zip(*pairs, strict=True)]
    length = abs(int(a[2:4], 16) - int(b[2:4], 16))
    total = sum(6 if s == 3 else s for s in steps) + (length if length <= 1 else 4 * length) + 2 * sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (4, 5)) + (a[:2] != b[:2])
    return max(0.0, 1 - total / 400)


def test_digest_and_likeness_against_plain_code():
    rng = random.Random(3)
    texts = [b"", b"a", b"abcd", b"abcde", "é🙂é🙂é🙂".encode()] + [bytes(rng.randrange(97, 97 + rng.choice([2, 8, 26])) for _ in range(rng.randint(5, 2500))) for _ in range(25)]
    texts += [t[: len(t) * 3 // 4] + texts[i - 1][: len(t) // 4] for i, t in enumerate(texts)]
    digests = [plain_digest(t) for t in texts]
    assert digests == [f.digest_of(t) for t in texts]
    again = digests[7:] + digests[:7]
    assert [plain_likeness(a, b) for a, b in zip(digests, again, strict=True)] == list(f.likeness(pd.Series(digests), pd.Series(again)))


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        fp = [f.digest_of(x.encode()) for x in (t, edited, nxt)]
        like = [float(f.likeness(pd.Series([fp[0]]), pd.Series([x]))[0]) for x in fp[1:]]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp[0], fp[1], *like))
    return out


def test_against_plain_order(spark):
    rng = random.Random(1)
    rows = [(i * i - 900, "".join(rng.choice("abc de🙂é") for _ in range(rng.randint(0, 300)))) for i in range(120)]
    rows += [(None, "null id"), (5000, None), (5001, ""), (7, "b tie"), (7, "a tie"), (7, "a tie"), (6000, "long " * 20000)]
    old, f.RANGE_ROWS = f.RANGE_ROWS, 10
    try:
        got = f.edited_pairs(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, range string").repartition(6)).collect()
    finally:
        f.RANGE_ROWS = old
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def test_one_row_and_none(spark):
    row = f.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1
    assert f.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_is_bounded():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    a = pd.Series([f.digest_of(t) for t in texts])
    assert (f.likeness(a, a) == 1).all()
    other = f.likeness(a, a[::-1].reset_index(drop=True))
    assert (other >= 0).all() and (other <= 1).all()
