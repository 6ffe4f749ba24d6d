"""A release of the inventory from raw rows to published rows, flags, the review queue and the contract's checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.albers import ALASKA
from spanwise.operators import inventory
from spanwise.sources import readers
from spanwise.sources.scratch import materialise

#: Columns that publishing adds to the schema, in order.
DERIVED = (
    "community_key", "delivery_barge", "delivery_plane", "delivery_road", "community_distance_km", "located_in_place", "community_relation", "corrections_applied",
    "qc_release", "qc_status", "facility_id", "aea_region", "aea_region_relation", "aea_region_distance_km", "capacity_status", "coordinate_source",
)
#: Words that no published column may hold in its name.
CONTACT = ("phone", "email", "contact", "fax")


@dataclass(frozen=True)
class Decisions:
    """What people decided and other stages found; a table that is missing leaves its columns empty.

    exceptions: (record_id); ledger: (record_id, facility_id, id_source), whose release rows have own_id and source_row;
    boundary: (record_id, own_km, inside_of, relation); regions: (record_id, region, relation, km); diff: a release diff;
    fixtures: named predicates that all located rows must meet.
    """

    exceptions: DataFrame | None = None
    ledger: DataFrame | None = None
    boundary: DataFrame | None = None
    regions: DataFrame | None = None
    diff: DataFrame | None = None
    fixtures: list[tuple[str, Column]] = field(default_factory=list)


@dataclass(frozen=True)
class Published:
    rows: DataFrame
    excluded: DataFrame
    corrections_log: DataFrame
    flags: DataFrame
    detectors: DataFrame
    queue: DataFrame
    problems: DataFrame | None
    checks: DataFrame

    def failed(self) -> list[str]:
        """Checks that fail: with any, the release isn't to be written."""
        return [r.check for r in self.checks.where("not passed").collect()]


def _stitched(rows: DataFrame, table: DataFrame | None, columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns (new: old) of a stage's ``table`` by record_id; nulls without it."""
    if table is None:
        return rows.withColumns({new: F.lit(None).cast("string") for new in columns})
    return rows.join(table.select("record_id", *[F.col(old).alias(new) for new, old in columns.items()]), "record_id", "left")


def publish(
    raw: DataFrame, mapping: list[dict], schema: list[tuple[str, str]], corrections: DataFrame, aliases: DataFrame, thresholds: dict[str, float], fields: list[str],
    decisions: Decisions = Decisions(), label: str = "",
) -> Published:
    """Snapshot, exclusions, guarded corrections of ``fields``, map points, keys, detectors, coverage, ids, queue and checks."""
    snapshot = materialise(readers.snapshot(raw, readers.column_map(mapping, [n for n, _ in schema]), schema))
    kept, excluded, drops = inventory.without_excluded(snapshot, corrections)
    edits = corrections.where("field <> 'exclude'")
    fixed, log = inventory.guarded_update(kept, "record_id", fields, edits)
    log = materialise(log)
    done = log.where("outcome = 'applied'").groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ";").alias("corrections_applied"))
    fixed = fixed.join(done, "record_id", "left")
    moved = F.coalesce(F.col("corrections_applied").rlike("latitude|longitude"), F.lit(False))
    if {"map_x", "map_y"} <= set(fixed.columns):
        fixed = inventory.synced_map_point(fixed, where=moved)
    x, y = ALASKA.forward(F.col("longitude"), F.col("latitude"))
    rows = materialise(inventory.normalised(fixed, aliases).withColumn("x", x).withColumn("y", y))

    flags = inventory.detected(rows, thresholds, diff=decisions.diff)
    flags = materialise(inventory.covered(flags, corrections.select(F.col("record_id").cast("string").alias("record_id"), "status"), decisions.exceptions))
    queue = inventory.review_queue(flags, flags.where("false").select("record_id", "detector"))
    ran = inventory.detectors_run(rows, flags, decisions.diff)

    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    assigned, problems = None, None
    if decisions.ledger is not None:
        assigned, problems = inventory.minted_ids(rows.select("record_id", "own_id", "source_row", located.alias("located")), decisions.ledger)
    rows = _stitched(rows, assigned, {"facility_id": "facility_id"})
    rows = _stitched(rows, decisions.boundary, {"community_distance_km": "own_km", "located_in_place": "inside_of", "community_relation": "relation"})
    rows = _stitched(rows, decisions.regions, {"aea_region": "region", "aea_region_relation": "relation", "aea_region_distance_km": "km"})
    waiting = queue.select(F.col("record_id").alias("_open")).distinct()
    rows = rows.join(waiting, F.col("record_id").cast("string") == F.col("_open"), "left")
    rows = rows.withColumns(
        {
            "community_relation": F.coalesce("community_relation", F.lit("untested")),
            "aea_region_relation": F.coalesce("aea_region_relation", F.lit("untested")),
            "qc_release": F.lit(label),
            "qc_status": F.when(F.col("_open").isNotNull(), "pending_review").otherwise("clean"),
            "capacity_status": inventory.capacity_status(thresholds["capacity_mismatch_gal"]),
            "coordinate_source": F.when(~located, "").when(moved, "owner_correction").otherwise("publisher"),
        }
    )
    if "last_inspected" in rows.columns:
        # A date before 1900 is a placeholder: it is published blank, and its flag stays.
        rows = rows.withColumn("last_inspected", F.when(~inventory.placeholder(F.col("last_inspected")), F.col("last_inspected")))
    names = [n for n, _ in schema]
    published = materialise(rows.select(*names, *[c for c in DERIVED if c not in names]))
    every = inventory.publish_checks(published, snapshot, excluded, log.unionByName(drops, allowMissingColumns=True), names, list(DERIVED), CONTACT, decisions.ledger, decisions.regions is not None, decisions.fixtures)
    return Published(published, excluded, log.unionByName(drops, allowMissingColumns=True), flags, ran, queue, problems, every)
