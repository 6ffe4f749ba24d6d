"""Operator 9: quality rules per document, with host-level verdicts shrunk by an empirical beta prior.

Everything is a DataFrame expression. A document's rule failures are counted from its whole text; hosts
(the ``source`` column, null counted as a host of its own) get a failure rate, shrunk towards the rate of all
hosts by a beta prior whose two parameters are fitted to the hosts by the method of moments; a host is rejected if its
shrunk rate is more than ``HOST_DEVIATIONS`` standard deviations of that prior above its mean, or above ``HOST_RATE``, and
with it those of its documents that fail at least one rule: a document that fails only a soft rule has the benefit of the
doubt on other hosts. A document that fails no rule stays, wherever it comes from.

Defined cases: a null or empty text has no words and fails (fewer than ``MIN_WORDS``); repeated rows and null
ids are judged row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.common import let, materialise, spread, table, unused, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 1
WORD_LENGTH = (2, 15)
MAX_DUP_LINE_PERCENT = 50
HOST_RATE = 0.5
HOST_DEVIATIONS = 1.0
#: Rates nearer than this to a bound aren't above it.
TINY = 1e-9


def repeat_words(w: Column) -> Column:
    """How many words of the array ``w`` lie in 3-word windows that occur at least twice in it.

    Each window becomes one number, the top bits a hash of its words and the low ones its place. Sorted, equal windows
    are neighbours, unless another window shares their hash. So neighbours with equal hashes are compared by
    their words; if any two differ, the text takes the plain way of sorting its windows by their words.
    """
    n = F.size(w)
    out = _by_words(w)
    # The more low bits for places, the fewer for the hash: texts take as few as they need.
    for bits in (28, 20, 16, 12):
        out = F.when(n <= 1 << bits, _by_hash(w, bits, _by_words(w))).otherwise(out)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(out)


def _by_hash(w: Column, bits: int, plain: Column) -> Column:
    def windows(h: Column) -> Column:
        number = lambda x, i: F.shiftleft(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), bits).bitwiseOR(i)
        return F.sort_array(F.slice(F.transform(h, number), F.lit(1), F.size(h) - 2))

    def found(s: Column) -> Column:
        near = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.shiftright(F.get(s, i).bitwiseXOR(F.get(s, i + 1)), bits) == 0)
        place = lambda i: F.get(s, i).bitwiseAND((1 << bits) - 1).cast("int")

        def checked(at: Column) -> Column:
            same = F.forall(at, lambda i: F.slice(w, place(i) + 1, 3) == F.slice(w, place(i + 1) + 1, 3))
            return F.when(same, _covered(F.concat(F.transform(at, place), F.transform(at, lambda i: place(i + 1))))).otherwise(plain)

        return let(near, checked)

    return let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), found)


def _by_words(w: Column) -> Column:
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.slice(w, i + 1, 3).alias("w"), i.alias("p")))

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["p"])

    return _covered(let(F.sort_array(windows), places))


def _covered(places: Column) -> Column:
    """The words in windows at ``places``, which may repeat."""

    def swept(p: Column) -> Column:
        new = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x).cast("long")

    return let(F.sort_array(F.array_distinct(places)), swept)


def with_counts(docs: DataFrame, name: str = "_q") -> DataFrame:
    """``docs`` plus a struct column ``name`` of the counts of each whole text and of the rules that it fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counts = F.struct(
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("r"))).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    )

    def judged(c: Column) -> Column:
        n, r = c["w"]["n"], c["w"]["r"]
        base = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
        soft = (
            (c["n_symbols"] > MAX_SYMBOLS_PER_WORD * n)
            | (c["w"]["chars"] < WORD_LENGTH[0] * n)
            | (c["w"]["chars"] > WORD_LENGTH[1] * n)
            | (100 * c["lines"]["dup"] > MAX_DUP_LINE_PERCENT * c["lines"]["n"])
        )
        return F.struct(
            n.alias("n_words"), c["w"]["chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["lines"]["dup"].alias("n_dup_lines"),
            r.alias("n_repeat_words"), base.alias("base_failed"), (base | soft).alias("any_failed"),
        )

    return docs.withColumn(name, let(counts, judged))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """(source, rejected) from rows of (source, any_failed)."""
    hosts = materialise(failures.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("any_failed").cast("long")).alias("failed")))
    rate = F.col("failed") / F.col("n")
    # One row, whatever the number of hosts. A beta law has mean m and variance m(1-m)/(a+b+1).
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if m is None:
        a = b = 1.0
    else:
        weight = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v else 1e6
        a, b = m * weight, (1 - m) * weight
    bound = min(HOST_RATE, m + HOST_DEVIATIONS * v**0.5 + TINY) if m is not None else HOST_RATE
    return hosts.select("source", ((F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b)) > bound).alias("rejected"))


def judged(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed and kept."""
    stats = materialise(with_counts(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_q.*"))
    verdicts = host_verdicts(stats.select("source", "any_failed")).select(F.col("source").alias("_host"), "rejected")
    joined = stats.join(verdicts, F.col("source").eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & ~(F.col("rejected") & F.col("any_failed"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    The counts are made once: rows are written with their verdicts, which the hosts' rates are then taken from.
    """
    columns, q, host, bad = [f"`{c}`" for c in docs.columns], unused(docs, "_q"), unused(docs, "_host"), unused(docs, "_rejected")
    flags = [F.col(f"{q}.base_failed").alias(f"{q}_base"), F.col(f"{q}.any_failed").alias(f"{q}_any")]
    rows = materialise(with_counts(docs, q).select(*columns, *flags))
    verdicts = host_verdicts(rows.select("source", F.col(f"{q}_any").alias("any_failed"))).where("rejected").select(F.col("source").alias(host), F.col("rejected").alias(bad))
    joined = rows.where(~F.col(f"{q}_base")).join(verdicts, F.col("source").eqNullSafe(F.col(host)), "left")
    return joined.where(~(F.coalesce(F.col(bad), F.lit(False)) & F.col(f"{q}_any"))).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spread(table(spark, sf_dir, "documents")))


COUNTS_SQL = r"""
word AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM word)),
rep AS (
  SELECT doc_id, count(DISTINCT p + k) AS r
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win), (SELECT unnest([0, 1, 2]) AS k)
  WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM word LEFT JOIN rep USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR word_chars < 2 * n_words
         OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines AS any_failed
  FROM counts),
host AS (SELECT source, count(*) AS n, sum(CAST(any_failed AS BIGINT)) AS failed FROM ruled GROUP BY source),
moment AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM host),
prior AS (
  SELECT m, v, CASE WHEN v = 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS k FROM moment),
verdict AS (SELECT source, (failed + m * k) / (n + k) > least(0.5, m + sqrt(v) + 1e-9) AS rejected FROM host, prior)
"""

ORACLE = f"""WITH {COUNTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rejected AND any_failed) AS kept
FROM ruled JOIN verdict ON ruled.source IS NOT DISTINCT FROM verdict.source
"""
