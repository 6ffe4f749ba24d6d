"""Releases of the inventory: taken in once, told apart from the one before, and checked against their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators import inventory
from spanwise.sources import readers, writers


def _manifest_at(root: str, label: str) -> str:
    return f"{root}/manifests/{label}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ingest(raw: DataFrame, root: str, label: str, mapping: list[dict], schema: list[tuple[str, str]]) -> dict:
    """Snapshot, diff from the release before, and manifest of a release; its note is written only where there is none yet.

    Under ``root``: release=<label>, diffs/<before>_to_<label>, manifests/<label>, notes/<label>. Returns the manifest.
    """
    spark = raw.sparkSession
    snap = readers.snapshot(raw, readers.column_map(mapping, [n for n, _ in schema]), schema)
    path = f"{root}/release={label}"
    snap.write.mode("overwrite").parquet(path)
    snap = spark.read.parquet(path)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows, with_place = snap.agg(F.count("*"), F.count_if(located)).first()
    out = {"release": label, "rows": rows, "rows_with_coordinates": with_place, "columns": [n for n, _ in schema], "digest": writers.digest(snap), "raw_digest": writers.digest(raw)}
    before = [x for x in readers.releases(spark, root) if x < label]
    if before:
        old = spark.read.parquet(f"{root}/release={before[-1]}")
        fields = [c for c in old.columns if c in snap.columns and c not in ("record_id", "source_row")]
        diff_at = f"{root}/diffs/{before[-1]}_to_{label}"
        inventory.release_diff(old, snap, "record_id", fields).write.mode("overwrite").parquet(diff_at)
        told = {r.change: (r.records, r.edits) for r in inventory.diff_summary(spark.read.parquet(diff_at), "record_id").collect()}
        out |= {"diff_from": before[-1], "diff_at": diff_at, "removed": told.get("removed", (0, 0))[0], "added": told.get("added", (0, 0))[0], "edited_beyond_jitter": told.get("edited", (0, 0))[0]}
    writers.write_manifest(spark, _manifest_at(root, label), out)
    note = f"{root}/notes/{label}"
    if not _exists(spark, note):
        writers.write_text(spark, note, f"release {label}: {rows} rows, {with_place} with coordinates; source, date and person to be filled in")
    return out


def previous_diff(spark: SparkSession, root: str, label: str) -> DataFrame | None:
    """The diff that a release came with, if one was before it."""
    told = readers.manifest(spark, _manifest_at(root, label))
    return spark.read.parquet(told["diff_at"]) if "diff_at" in told else None


def checked(spark: SparkSession, root: str, mapping: list[dict], schema: list[tuple[str, str]], raws: dict[str, DataFrame]) -> DataFrame:
    """(release, check, passed): each release against the digest of its manifest, and made anew from its raw table where that is at hand."""
    rows = []
    for label in readers.releases(spark, root):
        if not _exists(spark, _manifest_at(root, label)):
            rows.append((label, "has a manifest", False))
            continue
        told = readers.manifest(spark, _manifest_at(root, label))
        rows.append((label, "digest of the manifest", writers.digest(spark.read.parquet(f"{root}/release={label}")) == told["digest"]))
        if label in raws:
            again = readers.snapshot(raws[label], readers.column_map(mapping, [n for n, _ in schema]), schema)
            rows.append((label, "made anew from the raw table", writers.digest(again) == told["digest"]))
    return spark.createDataFrame(rows, "release string, check string, passed boolean")
