import hashlib

from glyphmill.llm import chat

HARD = [r"\### Assistant: </turn> ok", "<turn user>\\l\\b\\\\", "a<image 1>b", "\\", "", "</turn>" * 3, "ñ🙂<"]


def test_digest_reads_back_every_text(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 4, HARD))] + [(2, 1, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, None, "we>ird<", "y")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(turns.withColumn("content", chat.text_part(turns["text"])))).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in (1, 2, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=str)
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in mine))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), digest(loss))


def test_parts_become_placeholders_in_order(spark):
    rows = [(1, 0, "user", [("text", "see <image 1>", None, None), ("image", None, "a.png", 1.0), ("audio", None, "b.wav", 2.5), ("image", None, "c.png", None), (None, None, None, None)]), (1, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    row = chat.format_chats(turns).first()
    assert row.formatted == "<turn user>see \\limage 1\\g<image 1><audio 1><image 2></turn><turn assistant></turn>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 256), (0, "audio", "b.wav", 63), (0, "image", "c.png", 256)]
    assert row.placeholder_tokens == 575
    assert [row.formatted[s.start : s.end] for s in row.loss_mask] == [""]


def test_empty_table_and_probe(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = chat.with_probe(none)
    row = chat.digest(chat.format_chats(got.withColumn("content", chat.text_part(got["text"])))).first()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(HARD[0]))
