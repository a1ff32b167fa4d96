"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: a turn is ``###role###text</turn>`` and a line feed. In roles and texts ``\\``, ``#`` and ``<`` become ``\\b``,
``\\h`` and ``\\l``, so neither marker can occur inside one, and three replacements undo it.

Every assistant turn becomes an example of its own: all preceding turns as context, and only the reply's text under the
loss mask. A conversation that does not end with a reply also gets a last example without a trainable part, so that
each turn can be read back.

Defined results: null text or role counts as empty; turns with equal numbers are ordered by role, then text; repeated
rows are turns of their own; a null turn number comes first; rows with a null conv_id form one conversation; other
columns are ignored; an empty table gives no examples. A conversation is one training sequence and is assembled in one
row, so the longest conversation bounds what a task holds; contexts are cut from that row and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import table

TURN, END = "###", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
TRICKY = "\\### Assistant: </turn> ok"


def escaped(text):
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text):
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(conversations: DataFrame, reply: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> one example a reply: conv_id, example, formatted, loss_start, loss_end.

    The mask is the half-open character range [loss_start, loss_end) of ``formatted``.
    """
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv_id",
        "ts",
        F.transform("ts", lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TURN), escaped(t["text"]), F.lit(END))).alias("parts"),
    )
    last = F.size("ts")
    at = F.explode(F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("ts", i)["role"] == reply) | (i == last))).alias("i")
    examples = whole.select("conv_id", "ts", "parts", at)
    own = F.element_at("parts", F.col("i"))
    trained = F.element_at("ts", F.col("i"))["role"] == reply
    examples = examples.select(
        "conv_id",
        F.col("i").alias("example"),
        F.array_join(F.slice("parts", F.lit(1), F.col("i")), "").alias("formatted"),
        F.when(trained, F.length(own) - len(TURN) * 2 - F.length(escaped(F.lit(reply)))).otherwise(len(END)).alias("tail"),
        trained.alias("trained"),
    )
    end = F.length("formatted") - F.when(F.col("trained"), len(END)).otherwise(0)
    start = F.length("formatted") - F.when(F.col("trained"), F.col("tail")).otherwise(0)
    return examples.select("conv_id", "example", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Conversations as the formatted examples hold them: turns from the last, which contains all, and masked text from each."""
    loss = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    held = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_sort(F.collect_list(F.struct("example", unescaped(loss).alias("text")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.split("formatted", END)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.split(p, TURN))
    return held.select(
        "conv_id",
        F.transform(turns, lambda p: F.struct(unescaped(F.element_at(p, 2)).alias("role"), unescaped(F.element_at(p, 3)).alias("text"))).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"),
        "formatted_chars",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    back = read_back(format_chat(rows.unionByName(extra)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 6 + 8
    + length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '#', ''), '<', ''))
    + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS own,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM c),
p AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
