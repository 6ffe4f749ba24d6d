"""Sinks: tables, partitioned stacks, deterministic text, manifests, GeoJSON and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, name: str) -> None:
    """Creates or replaces a managed table."""
    df.write.mode("overwrite").saveAsTable(name)


def write_stack(df: DataFrame, path: str, nodata: float = -9999.0) -> None:
    """Surfaces (mode, month, row, col, value) in a folder per mode and month, nulls as the no-data number.

    Only the folders of the months in ``df`` are replaced.
    """
    rows = df.withColumn("value", F.coalesce("value", F.lit(nodata)).cast("float"))
    rows.repartition("mode", "month").sortWithinPartitions("row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "month").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> str:
    """Text with a header, in a total order, and the SHA-256 of its rows.

    Rows are sorted by ranges over all tasks. The digest is that of the sorted digests of ranges of rows, so it needs no file
    in one piece, and depends on the rows alone.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="", lineSep="\n")
    return digest(text)


def digest(df: DataFrame, buckets: int = 4096) -> str:
    """A digest of a table's rows that doesn't depend on their order."""
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(c) for c in df.columns])), 256)
    # Sums of the digests' parts per bucket; then one row over at most ``buckets`` of them.
    r = df.select(row.alias("r")).withColumn("b", F.pmod(F.xxhash64("r"), F.lit(buckets)))
    part = lambda k: F.sum(F.conv(F.substring("r", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{k}")
    sums = r.groupBy("b").agg(F.count("*").alias("n"), *[part(k) for k in range(8)])
    line = F.concat_ws(":", "b", "n", *[f"s{k}" for k in range(8)])
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    write_text(spark, path, json.dumps(content, indent=1, sort_keys=True))


def write_by(df: DataFrame, path: str, key: str) -> None:
    """One folder per value of ``key``."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def with_aliases(df: DataFrame, aliases: dict[str, str], width: int = 10) -> DataFrame:
    """Columns renamed for formats with short names; a name that stays too long is an error."""
    out = df.withColumnsRenamed(aliases)
    long = [c for c in out.columns if len(c) > width]
    if long:
        raise ValueError(f"names over {width} characters: {', '.join(long)}")
    return out


def features(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """(feature): rows as GeoJSON point features."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))).alias("feature"))


def report(title: str, tables: dict[str, DataFrame], old: str = "", mark: str = "<!-- feedback -->", rows: int = 100) -> str:
    """A Markdown report of small tables; what ``old`` has between two marks is kept. Of a longer table the first ``rows`` rows stand there, and a line says so."""
    kept = old.split(mark)[1] if old.count(mark) >= 2 else "\n"
    out = [f"# {title}"]
    for name, df in tables.items():
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        some = df.limit(rows + 1).collect()
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in some[:rows]]
        out += [f"\nThe first {rows} rows."] if len(some) > rows else []
    return "\n".join([*out, "", f"{mark}{kept}{mark}", ""])


def described(df: DataFrame) -> DataFrame:
    """(column, type, nulls, distinct, low, high) of each column, in one pass."""
    aggs = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{c}"), F.countDistinct(text).alias(f"d_{c}"), F.min(text).alias(f"l_{c}"), F.max(text).alias(f"h_{c}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`n_{c}`").alias("nulls"), F.col(f"`d_{c}`").alias("distinct"), F.col(f"`l_{c}`").alias("low"), F.col(f"`h_{c}`").alias("high")) for c, t in df.dtypes]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
