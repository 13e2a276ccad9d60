"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become a block by array
aggregation; blocks are concatenated. The template:

    <|block|>ROLE<|body|>TEXT[<|next|>TEXT ...]<|end|>

`<|next|>` stands between merged turns, so the turns can be read back. Inside roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so no control string can occur there, and both steps can be undone.

Defined results: turns sort by (turn, role, text), nulls first, so ties and repeated rows have one order and each row stays
a turn; a null text or role is empty; rows with a null conversation id form one conversation; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK, BODY, NEXT, END = "<|block|>", "<|body|>", "<|next|>", "<|end|>"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the key, `formatted`, and `loss_spans` (start, length in code points of `formatted`).

    Other columns of `turns` are left out. The spans hold escaped assistant texts, one each, without any template string.
    """
    own = turns.select(
        F.col(f"`{key}`").alias("key"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    rows = own.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # places at which another role begins; a block reaches up to the next of them
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[i - 1]["role"]))
    rows = rows.select("key", "turns", starts.alias("starts"))
    blocks = F.transform(
        "starts",
        lambda s, j: F.struct(
            F.col("turns")[s]["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    rows = rows.select("key", blocks.alias("blocks"))
    # every piece of the output in order, and whether the loss counts it
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.flatten(
                F.array(
                    F.array(F.struct(F.concat(F.lit(BLOCK), escape(b["role"]), F.lit(BODY)).alias("s"), F.lit(False).alias("loss"))),
                    F.flatten(
                        F.transform(
                            b["texts"],
                            lambda x, i: F.array(
                                F.struct(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                                F.struct(x.alias("s"), b["role"].isin(*LOSS_ROLES).alias("loss")),
                            ),
                        )
                    ),
                    F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
                )
            ),
        )
    )
    rows = rows.select("key", pieces.alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: p["s"]), "")
    # a running sum of lengths turns the mask into spans
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["s"])).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.char_length(p["s"]).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.select(F.col("key").alias(key), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) structs that `formatted` was made of."""
    blocks = F.filter(F.split(formatted, r"<\|block\|>", -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(F.split_part(b, F.lit(BODY), F.lit(2)), r"<\|end\|>$", ""), r"<\|next\|>", -1),
                lambda x: F.struct(unescape(F.split_part(b, F.lit(BODY), F.lit(1))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


PROBE = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    out = format_chat(turns.unionByName(probe)).withColumns({"back": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op5_chat": op5_chat}

_ESC = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"
ORACLE_SQL = {
    "op5_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}'
  UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), m AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS merged FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('text')}) + CASE WHEN merged THEN {len(NEXT)} ELSE length({_ESC.format('role')}) + {len(BLOCK + BODY + END)} END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""
}
