"""Chat formatting with typed content parts, all in DataFrame functions.

A turn's content is an array of parts ``struct<kind, text, ref, size>``; kind is text, image, audio or document.  The
visitor goes over the parts in order: text parts are escaped, the others become numbered placeholders ``<image 1>``,
their reference and expanded token count are recorded.  A turn is written ``<turn ROLE>CONTENT</turn>``, turns in order
without anything between.

Escape: every control string starts with ``<``, so ``\\`` is written ``\\b``, ``<`` is ``\\l`` and ``>`` is ``\\g``;
escaped text has no bare ``<`` or ``>``, each backslash starts a pair, and the reverse is exact.

Edge cases: null text, role and content are empty; an unknown or null kind is text; a null turn number comes first; rows
equal in turn come by role, then content; a null conv_id is one conversation; an empty table gives no rows.  A
conversation is one row of the result, so its rows meet in one group; nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,size:double>"
#: Tokens of a placeholder: fixed for an image, by second of audio, by page of a document.
TOKENS = {"image": (256, 0), "audio": (0, 25), "document": (16, 400)}


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A single text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0.0).alias("size")))


def _visited(parts: Column) -> Column:
    """Parts as struct(body, kind, ref, tokens); the number of a placeholder counts its kind within the turn."""

    def one(p: Column, i: Column) -> Column:
        kind = F.when(p["kind"].isin(*TOKENS), p["kind"]).otherwise(F.lit("text"))
        nth = F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: q["kind"] == kind))
        tokens = F.lit(0).cast("long")
        for name, (base, each) in TOKENS.items():
            tokens = F.when(kind == name, (F.lit(base) + F.ceil(F.coalesce(p["size"], F.lit(0.0)) * each)).cast("long")).otherwise(tokens)
        body = F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind, F.lit(" "), nth.cast("string"), F.lit(">")))
        return F.struct(body.alias("body"), kind.alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(parts, one)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_mask (code-point spans, end exclusive), attachments, n_turns, placeholder_tokens."""
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{content}`"), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts")
        ).alias("t"),
    )
    rows = rows.select("conv", F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), _visited(F.col("t.parts")).alias("seen"))
    rows = rows.select(
        "conv",
        F.struct(
            "turn",
            "role",
            F.array_join(F.transform("seen", lambda p: p["body"]), "").alias("body"),
            F.filter("seen", lambda p: p["kind"] != "text").alias("parts"),
        ).alias("t"),
    )
    open_tag = lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">"))
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    rows = rows.withColumn("pieces", F.transform("turns", lambda t: F.concat(open_tag(t), t["body"], F.lit("</turn>"))))
    spans = F.aggregate(
        F.arrays_zip("turns", "pieces"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["pieces"])).cast("long").alias("at"),
            F.when(
                x["turns"]["role"] == loss_role,
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(open_tag(x["turns"]))).cast("long").alias("start"), (a["at"] + F.length(x["pieces"]) - len("</turn>")).cast("long").alias("end")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    parts = F.flatten(F.transform("turns", lambda t, i: F.transform(t["parts"], lambda p: F.struct(i.cast("long").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.array_join("pieces", "").alias("formatted"),
        spans.alias("loss_mask"),
        parts.alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("placeholder_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Turns as array<struct<role, text>>, from the formatted string alone."""
    pieces = F.split(formatted, "</turn>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, ">", 1), F.lit(len("<turn ") + 1))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, ">", 1)) + 2)).alias("text"),
        ),
    )


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, computed from the formatted string and its mask."""
    back = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return chats.select(
        "conv_id",
        F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(back, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -7: two turns whose text imitates control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


#: DuckDB: the contract's columns straight from the texts; formatted_chars by the escape's lengths.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text)
    + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(regexp_replace(text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
