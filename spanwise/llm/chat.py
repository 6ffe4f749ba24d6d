r"""Operator 10: chat formatting by a finite-state machine over roles and a declarative template.

Rows of a conversation are put in order (turn, then role and text for tied turns), the machine checks the
order of roles, and every turn becomes text segments, each with a flag that says whether it counts for the
loss. The template is data: for each role the text before, the text after and the loss flag.

Control strings inside texts are escaped by a backslash after their opening bracket: ``</s>`` becomes
``<\/s>``. A string that already reads like an escaped one gets one more backslash, so undoing it is exact.

Defined cases: a null text or role counts as empty; roles outside the template are kept by name in a generic
frame; a conversation in a wrong order is formatted all the same and marked ``valid_order = false``; null
conv_ids form one conversation; repeated rows are repeated turns; an empty table gives an empty result.
A conversation is one row of output and so must fit a string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.common import let, table

#: role: (text before, text after, counts for the loss)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("<s>[INST]", "[/INST]", False),
    "assistant": ("[OUT]", "</s>", True),
}
#: Any other role: its name stands between the first two.
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")

#: States of the machine and the roles that lead on: a system turn may open; users and assistants take turns.
MACHINE = {
    ("start", "system"): "opened",
    ("start", "user"): "asked",
    ("opened", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
FINAL = ("answered", "asked")

#: What follows the opening bracket of each control string.
_TAIL = r"(?:/?s>|</?SYS>>|/?INST\]|OUT\]|/?ROLE\]|/TURN\])"
_ESCAPE = r"([<\[])(\\*)(" + _TAIL + ")"
_RESTORE = r"([<\[])\\(\\*)(" + _TAIL + ")"



def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit("$1\\\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_RESTORE), F.lit("$1$2$3"))


def _segments(role: Column, text: Column) -> Column:
    """The segments of one turn: array of (text, loss)."""

    def seg(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    made = F.array(seg(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), False), seg(escape(text), False), seg(F.lit(OTHER[2]), False))
    for name, (before, after, loss) in TEMPLATE.items():
        made = F.when(role == name, F.array(seg(F.lit(before), False), seg(escape(text), loss), seg(F.lit(after), False))).otherwise(made)
    return made


def _order(roles: Column) -> Column:
    def step(state: Column, role: Column) -> Column:
        on = F.lit("wrong")
        for (at, name), to in MACHINE.items():
            on = F.when((state == at) & (role == name), F.lit(to)).otherwise(on)
        return on

    return F.aggregate(roles, F.lit("start"), step).isin(*FINAL)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, segments (array of text and loss), formatted (their concatenation), valid_order."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    made = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"]))).alias("segments"),
        _order(F.transform("turns", lambda t: t["role"])).alias("valid_order"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), escapes undone.

    Escaped texts hold no control string, so each turn ends at the first closing string.
    """
    quoted = [(r, "".join("\\" + c if c in "[]<>/" else c for c in b), "".join("\\" + c if c in "[]<>/" else c for c in a)) for r, (b, a, _) in TEMPLATE.items()]
    other = ["".join("\\" + c if c in "[]<>/" else c for c in x) for x in OTHER]
    pieces = [f"{b}[\\s\\S]*?{a}" for _, b, a in quoted] + [f"{other[0]}[\\s\\S]*?{other[2]}"]

    def read(x: Column) -> Column:
        inner = F.substring_index(F.substr(x, F.lit(len(OTHER[0]) + 1)), OTHER[1], 1)
        start = F.length(inner) + len(OTHER[0]) + len(OTHER[1]) + 1
        turn = F.struct(unescape(inner).alias("role"), unescape(F.substr(x, start, F.length(x) - start + 1 - len(OTHER[2]))).alias("text"), F.lit(False).alias("loss"))
        for role, (before, after, loss) in TEMPLATE.items():
            text = F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
            turn = F.when(F.startswith(x, F.lit(before)), F.struct(F.lit(role).alias("role"), unescape(text).alias("text"), F.lit(loss).alias("loss"))).otherwise(turn)
        return turn

    return F.transform(F.regexp_extract_all(formatted, F.lit("|".join(pieces)), F.lit(0)), read)


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's digest columns, read back from the formatted texts."""
    back = formatted.select("conv_id", "valid_order", "formatted", parse(F.col("formatted")).alias("turns"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        let(
            F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""),
            lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x.cast("binary"), 256).alias("sha")),
        ).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    ).select("conv_id", "n_turns", "turns_sha256", F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars", "valid_order")


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digests(format_conversations(rows.unionByName(probe)))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|OUT\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 9
           ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|OUT\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) END AS chars
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 'y' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY k),
                         'y?(ua)*(u|ua)') AS valid_order
FROM turns GROUP BY conv_id
"""
