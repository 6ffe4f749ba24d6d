"""Inventory quality control: releases, corrections, detectors, ids, boundaries, the review queue.

Facilities are rows with record_id, community_name, community_key, latitude, longitude, x, y (metres), capacities and dates.
Detectors return flags (record_id, detector, severity, detail, suggested_field, suggested_value, group_key). Their thresholds
come from a table, see ``thresholds``; one that the table lacks is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.functions import scalars as S
from spanwise.functions.albers import ALASKA, in_alaska
from spanwise.operators import spatial
from spanwise.operators.ranking import first_per, numbered
from spanwise.sources.scratch import materialise

SEVERITY = ("high", "medium", "low", "info")
#: Metres around a farm that count as its neighbourhood; how far a map point may be from its coordinates.
FARM_REACH = 3000.0
MAP_AGREES = 100.0
#: Fixed value: map points that move by no more than this, between releases, haven't moved.
MAP_JITTER = 2.0

FUELS = ("gasoline_capacity", "diesel_capacity", "jet_fuel_capacity", "other_fuel_capacity")


def typed_projection(raw: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """``raw`` as (source column, name, type) says, in that order; only these columns are read."""
    return raw.select(*[S.typed(F.col(f"`{source}`"), kind).alias(name) for source, name, kind in columns])


def folded(df: DataFrame, folds: list[tuple[str, str]]) -> DataFrame:
    """(target, second): nulls of the target filled from the second column, which goes."""
    for target, second in folds:
        df = df.withColumn(target, F.coalesce(target, second))
    return df.drop(*{s for _, s in folds})


def fill_counts(df: DataFrame, folds: list[tuple[str, str]]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(t).isNull() & F.col(s).isNotNull()).alias(f"{t}_from_{s}") for t, s in folds])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur twice."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def _long(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(key, pairs.alias("p")).select(key, "p.field", "p.value")


def release_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, field, old_value, new_value): removed and added records, and one row per edited field. Each side is read once."""
    side = lambda df, n: df.select(F.col(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(n))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    gone = F.array(F.struct(F.lit("removed").alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    come = F.array(F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    edits = F.filter(
        F.array(*[F.struct(F.lit("edited").alias("change"), F.lit(f).alias("field"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value")) for f in fields]),
        lambda e: ~e["old_value"].eqNullSafe(e["new_value"]),
    )
    rows = both.select(key, F.explode(F.when(F.col("n").isNull(), gone).when(F.col("o").isNull(), come).otherwise(edits)).alias("e"))
    return rows.select(key, "e.*")


def diff_summary(diff: DataFrame, key: str, jitter: float = MAP_JITTER, points: tuple[str, ...] = ("map_x", "map_y")) -> DataFrame:
    """(change, records, edits): edits of points by at most ``jitter`` don't count."""
    small = F.col("field").isin(*points) & (F.abs(F.col("new_value").try_cast("double") - F.col("old_value").try_cast("double")) <= jitter)
    return diff.where(~F.coalesce(small, F.lit(False))).groupBy("change").agg(F.countDistinct(key).alias("records"), F.count("*").alias("edits"))


def guarded_update(df: DataFrame, key: str, fields: list[str], corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` after approved corrections (key, field, old_value, new_value, status, seq), and their log.

    In the order of ``seq`` each applies only if the value is then still ``old_value`` (numbers within 1e-6); so a later
    one sees what an earlier one wrote.
    """
    ok = corrections.where(F.col("status") == "approved")
    steps = ok.groupBy(key, "field").agg(F.array_sort(F.collect_list(F.struct("seq", "old_value", "new_value"))).alias("steps"))
    now = _long(df, key, fields)
    same = lambda a, b: a.eqNullSafe(b) | F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) <= 1e-6, F.lit(False))

    def fold(acc: Column, s: Column) -> Column:
        hit = same(acc["value"], s["old_value"])
        entry = F.struct(s["seq"].alias("seq"), F.when(hit, "applied").otherwise("skipped-old-value-mismatch").alias("outcome"))
        return F.struct(F.when(hit, s["new_value"]).otherwise(acc["value"]).alias("value"), F.concat(acc["log"], F.array(entry)).alias("log"))

    start = F.struct(F.col("value"), F.array().cast("array<struct<seq:bigint,outcome:string>>").alias("log"))
    run = now.join(steps, [key, "field"]).select(key, "field", F.aggregate("steps", start, fold).alias("r"))
    new = run.groupBy(key).pivot("field", fields).agg(F.first(F.struct("r.value")))
    joined = df.join(new.withColumnsRenamed({f: f"_{f}" for f in fields}), key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value").try_cast(df.schema[f].dataType)).otherwise(F.col(f)))
    known = df.select(key).distinct().withColumn("_known", F.lit(True))
    done = run.select(key, "field", F.explode("r.log").alias("l")).select(key, "field", "l.seq", F.col("l.outcome").alias("_done"))
    log = ok.join(done, [key, "field", "seq"], "left").join(known, key, "left")
    outcome = F.coalesce("_done", F.when(F.col("_known").isNull(), "skipped-record-absent").otherwise("skipped-unknown-field"))
    rest = corrections.where(F.col("status") != "approved").select(key, "field", "seq", F.col("status").alias("outcome"))
    return joined.select(*df.columns), log.select(key, "field", "seq", outcome.alias("outcome")).unionByName(rest)


def without_excluded(df: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, excluded with exclusion_reason, log) of records after approved corrections of the field "exclude".

    An old_value "column=value" guards an exclusion: it holds only while the record still has that value (numbers within 1e-6).
    """
    drops = corrections.where("field = 'exclude' and status = 'approved'")
    column, value = F.split_part("old_value", F.lit("="), F.lit(1)), F.regexp_extract("old_value", "=(.*)$", 1)
    reason = F.col("reason") if "reason" in corrections.columns else F.lit("excluded")
    drops = drops.select("record_id", "seq", F.when(F.contains("old_value", F.lit("=")), column).alias("_c"), value.alias("_v"), reason.alias("exclusion_reason"))
    values = df.select("record_id", F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])).alias("_row"))
    now = F.coalesce(F.try_element_at("_row", F.col("_c")), F.lit(""))
    same = (now == F.col("_v")) | F.coalesce(F.abs(now.try_cast("double") - F.col("_v").try_cast("double")) <= 1e-6, F.lit(False))
    outcome = F.when(F.col("_row").isNull(), "skipped-record-absent").when(F.col("_c").isNull() | same, "applied").otherwise("skipped-old-value-mismatch")
    log = materialise(drops.join(values, "record_id", "left").select("record_id", F.lit("exclude").alias("field"), "seq", outcome.alias("outcome"), "exclusion_reason"))
    gone = log.where("outcome = 'applied'").groupBy("record_id").agg(F.min_by("exclusion_reason", "seq").alias("exclusion_reason"))
    return df.join(gone.select("record_id"), "record_id", "left_anti").select(*df.columns), df.join(gone, "record_id"), log.drop("exclusion_reason")


def synced_map_point(df: DataFrame, agree: float = MAP_AGREES, where: Column | None = None) -> DataFrame:
    """Map points more than ``agree`` metres from their coordinates made anew, to four decimals; only of rows ``where`` holds, if given."""
    x, y = ALASKA.forward(F.col("longitude"), F.col("latitude"))
    off = ~F.coalesce(G.distance(x, y, F.col("map_x"), F.col("map_y")) <= agree, F.lit(False)) & x.isNotNull()
    if where is not None:
        off = off & where
    return df.withColumn("_off", off).withColumn("map_x", F.when(F.col("_off"), F.round(x, 4)).otherwise(F.col("map_x"))).withColumn("map_y", F.when(F.col("_off"), F.round(y, 4)).otherwise(F.col("map_y"))).drop("_off")


def normalised(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds community_key (canonical name, aliases (variant, canonical) followed) and the delivery flags."""
    a = aliases.select(S.canon(F.col("variant")).alias("_v"), S.canon(F.col("canonical")).alias("_c")).dropDuplicates(["_v"])
    df = df.withColumn("_v", S.canon(F.col("community_name"))).join(a, "_v", "left").withColumn("community_key", F.coalesce("_c", "_v")).drop("_v", "_c")
    for m in ("Barge", "Plane", "Road"):
        df = df.withColumn(f"delivery_{m.lower()}", S.delivery_flag(F.col("delivery_method"), m))
    return df


def spellings(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, spellings, n) of keys with more than one spelling."""
    rows = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("s"))
    return rows.where(F.size("s") > 1).select(key, F.array_join("s", ";").alias("spellings"), F.size("s").alias("n"))


Detector = Callable[[DataFrame, dict[str, float]], DataFrame]
DETECTORS: dict[str, tuple[tuple[str, ...], Detector]] = {}


def detector(name: str, *needs: str) -> Callable[[Detector], Detector]:
    """Registers a detector and the columns it needs."""

    def add(fn: Detector) -> Detector:
        DETECTORS[name] = (needs, fn)
        return fn

    return add


FLAG = "record_id string, detector string, severity string, detail string, suggested_field string, suggested_value string, group_key string"


def _flag(df: DataFrame, name: str, severity: Column | str, detail: Column, field: Column | str = "", value: Column | str = "", group: Column | str = "") -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = lambda x, n: c(x).cast("string").alias(n)
    return df.select(
        F.col("record_id"), F.lit(name).alias("detector"), text(severity, "severity"), text(detail, "detail"), text(field, "suggested_field"), text(value, "suggested_value"), text(group, "group_key")
    )


def thresholds(table: DataFrame) -> dict[str, float]:
    """The values of a table (name, value, ...) by name. It has a row per threshold."""
    return {r.name: float(r.value) for r in table.select("name", "value").collect()}


@detector("shared_farm_id", "tank_farm_id", "community_key", "x", "y")
def shared_farm_id(df: DataFrame, th: dict[str, float]) -> DataFrame:
    """Farm ids over several communities, with the community that most neighbours of the first record name."""
    groups = df.where("tank_farm_id is not null").groupBy("tank_farm_id").agg(F.countDistinct("community_key").alias("n"), F.min_by(F.struct("record_id", "x", "y"), "record_id").alias("first")).where("n > 1")
    left = groups.select(F.col("tank_farm_id").alias("id"), "first.x", "first.y")
    right = df.select(F.col("record_id").alias("id"), "x", "y")
    near = spatial.within(left, right, FARM_REACH).join(df.select(F.col("record_id").alias("right_id"), "tank_farm_id", "community_key"), "right_id")
    near = near.where(~F.col("tank_farm_id").eqNullSafe(F.col("left_id")))
    count = near.groupBy("left_id", "community_key").agg(F.count("*").alias("n"))
    sits = count.where("community_key is not null").groupBy("left_id").agg(F.min_by("community_key", F.struct(-F.col("n"), "community_key")).alias("sits")).withColumnRenamed("left_id", "_farm")
    rows = df.join(groups.select("tank_farm_id"), "tank_farm_id").join(sits, F.col("tank_farm_id") == F.col("_farm"), "left")
    own = F.coalesce(F.col("community_key") == F.col("sits"), F.lit(False))
    detail = F.when(own, F.concat(F.lit("the farm's own record, in "), "sits")).otherwise(F.concat(F.lit("sits in "), F.coalesce("sits", F.lit("?")), F.lit(", labelled "), F.coalesce("community_key", F.lit("?"))))
    group = F.concat(F.lit("farm:"), F.col("tank_farm_id").cast("bigint").cast("string"))
    return _flag(rows, "shared_farm_id", F.when(own, "info").otherwise("high"), detail, F.when(own, "").otherwise("latitude;longitude"), "", group)


@detector("within_farm_copies", "tank_farm_id", "community_key", "total_capacity")
def within_farm_copies(df: DataFrame, th: dict[str, float]) -> DataFrame:
    """Records of one farm and community with one total; the first isn't flagged."""
    w = Window.partitionBy("tank_farm_id", "community_key")
    rows = df.where("tank_farm_id is not null and total_capacity is not null").withColumn("_n", F.count("*").over(w)).withColumn("_lo", F.min("total_capacity").over(w)).withColumn("_hi", F.max("total_capacity").over(w)).withColumn("_k", F.row_number().over(w.orderBy("record_id")))
    return _flag(rows.where("_n > 1 and _lo = _hi and _k > 1"), "within_farm_copies", "low", F.concat(F.col("_n").cast("string"), F.lit(" copies")), group=F.concat(F.lit("farm:"), F.col("tank_farm_id").cast("bigint").cast("string")))


@detector("shared_point_labels", "community_key", "x", "y")
def shared_point_labels(df: DataFrame, th: dict[str, float]) -> DataFrame:
    """Points, equal to ``shared_point_m``, with several communities: each record with the names of the others."""
    tol = th["shared_point_m"]
    rows = df.where("x is not null and y is not null").withColumns({"px": F.rint(F.col("x") / tol), "py": F.rint(F.col("y") / tol)})
    many = rows.groupBy("px", "py").agg(F.array_sort(F.collect_set("community_key")).alias("keys")).where(F.size("keys") > 1)
    others = F.filter("keys", lambda k: ~k.eqNullSafe(F.col("community_key")))
    group = F.concat(F.lit("point:"), F.col("px").cast("bigint").cast("string"), F.lit(":"), F.col("py").cast("bigint").cast("string"))
    return _flag(rows.join(many, ["px", "py"]), "shared_point_labels", "high", F.array_join(others, ";"), group=group)


@detector("one_digit_typo", "community_key", "latitude", "longitude", "x", "y")
def one_digit_typo(df: DataFrame, th: dict[str, float]) -> DataFrame:
    """Records far from the middle of their community that a change of one digit brings near; the first such change."""
    mid = medoids(df.where("x is not null").select("record_id", "community_key", "x", "y"), "record_id", "community_key").select("community_key", F.col("x").alias("mx"), F.col("y").alias("my"))
    far = df.join(mid, "community_key").where(G.distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")) > th["label_spread_km"] * 1000)
    tries = lambda field, order: F.transform(S.one_digit_edits(F.col(field)), lambda e: F.struct(F.lit(order).alias("o"), e["position"].alias("position"), e["digit"].alias("digit"), F.lit(field).alias("field"), e["value"].alias("value")))
    rows = far.withColumn("e", F.explode(F.concat(tries("latitude", 0), tries("longitude", 1))))
    lat, lon = F.when(F.col("e.field") == "latitude", F.col("e.value")).otherwise(F.col("latitude")), F.when(F.col("e.field") == "longitude", F.col("e.value")).otherwise(F.col("longitude"))
    x, y = ALASKA.forward(lon, lat)
    rows = rows.where(lat.between(-89.9, 89.9) & (G.distance(x, y, F.col("mx"), F.col("my")) <= th["typo_match_km"] * 1000))
    best = rows.groupBy("record_id").agg(F.min("e").alias("e"))
    return _flag(best, "one_digit_typo", "high", F.concat(F.col("e.field"), F.lit(" "), F.format_string("%.4f", F.col("e.value"))), F.col("e.field"), F.format_string("%.6f", F.col("e.value")))


@detector("map_point_disagrees", "latitude", "longitude", "map_x", "map_y")
def map_point_disagrees(df: DataFrame, th: dict[str, float]) -> DataFrame:
    x, y = ALASKA.forward(F.col("longitude"), F.col("latitude"))
    d = G.distance(x, y, F.col("map_x"), F.col("map_y"))
    lon, lat = ALASKA.inverse(F.col("map_x"), F.col("map_y"))
    value = F.format_string("%.6f;%.6f", lat, lon)
    return _flag(df.where(d > MAP_AGREES), "map_point_disagrees", "high", F.concat(F.round(d, 0).cast("bigint").cast("string"), F.lit(" m")), "latitude;longitude", value)


@detector("missing_fields")
def missing_fields(df: DataFrame, th: dict[str, float]) -> DataFrame:
    """Records without a value in one of five fields; fields that the release doesn't have don't count."""
    fields = [f for f in ("community_name", "latitude", "longitude", "delivery_method", "total_capacity") if f in df.columns]
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields]))
    return _flag(df.where(F.size(missing) > 0), "missing_fields", "info", F.array_join(missing, ";"))


@detector("capacity_mismatch", "total_capacity", *FUELS)
def capacity_mismatch(df: DataFrame, th: dict[str, float]) -> DataFrame:
    total = fuel_sum()
    off = total - F.col("total_capacity")
    some = F.coalesce(*[F.col(f) for f in FUELS]).isNotNull()
    return _flag(df.where(some & (F.abs(off) > th["capacity_mismatch_gal"])), "capacity_mismatch", F.when(off > 0, "high").otherwise("medium"), F.format_string("%.0f", off))


def fuel_sum() -> Column:
    out = F.lit(0.0)
    for f in FUELS:
        out = out + F.coalesce(F.col(f), F.lit(0.0))
    return out


def placeholder(date: Column) -> Column:
    """A date before 1900, which no inspection has; false for null."""
    return F.coalesce(F.substring(date.cast("string"), 1, 4).try_cast("int") < 1900, F.lit(False))


@detector("placeholder_inspection_date", "last_inspected")
def placeholder_date(df: DataFrame, th: dict[str, float]) -> DataFrame:
    return _flag(df.where(placeholder(F.col("last_inspected"))), "placeholder_inspection_date", "info", F.col("last_inspected"), "last_inspected")


@detector("alaska_envelope", "latitude", "longitude")
def envelope(df: DataFrame, th: dict[str, float]) -> DataFrame:
    return _flag(df.where(~in_alaska(F.col("latitude"), F.col("longitude"))), "alaska_envelope", "high", F.concat_ws(",", F.col("latitude"), F.col("longitude")))


@detector("spelling_variants", "community_id", "community_name")
def spelling_variants(df: DataFrame, th: dict[str, float]) -> DataFrame:
    n = df.where("community_id is not null and community_name is not null").groupBy("community_id", "community_name").agg(F.count("*").alias("n"))
    usual = n.groupBy("community_id").agg(F.min_by("community_name", F.struct(-F.col("n"), "community_name")).alias("usual"), F.count("*").alias("k")).where("k > 1")
    return _flag(df.join(usual, "community_id").where("community_name <> usual"), "spelling_variants", "medium", F.col("usual"), "community_name", F.col("usual"), F.concat(F.lit("cid:"), F.col("community_id").cast("string")))


def release_flags(diff: DataFrame) -> DataFrame:
    """Flags of the edits in a ``release_diff`` (key record_id): map points that moved beyond jitter are medium, other fields info."""
    d = diff.where((F.col("change") == "edited") & (F.col("field") != "last_edited"))
    moved = F.col("field").isin("map_x", "map_y")
    by = F.abs(F.col("old_value").try_cast("double") - F.col("new_value").try_cast("double"))
    d = d.where(~moved | F.coalesce(by > MAP_JITTER, F.lit(False)))
    detail = F.concat(F.col("field"), F.lit(": "), F.coalesce("old_value", F.lit("")), F.lit(" -> "), F.coalesce("new_value", F.lit("")))
    return _flag(d, "release_diff", F.when(moved, "medium").otherwise("info"), detail)


def lacking(df: DataFrame) -> dict[str, list[str]]:
    """Per detector the columns it needs that ``df`` doesn't have or holds no value in. One pass."""
    have = [c for c in df.columns if any(c in needs for needs, _ in DETECTORS.values())]
    counts = df.agg(*[F.count(c).alias(c) for c in have]).first().asDict() if have else {}
    return {name: [c for c in needs if not counts.get(c)] for name, (needs, _) in DETECTORS.items()}


def detected(df: DataFrame, thresholds: dict[str, float], only: list[str] | None = None, diff: DataFrame | None = None) -> DataFrame:
    """All flags, the most severe first; a detector whose columns are missing or empty is left out.

    ``diff`` is the ``release_diff`` from the release before; without it there are no flags of that kind.
    """
    missing = lacking(df)
    out = df.sparkSession.createDataFrame([], FLAG)
    rows = lambda flags: flags.withColumn("record_id", F.col("record_id").cast("string"))
    for name, (_, fn) in DETECTORS.items():
        if (only is None or name in only) and not missing[name]:
            out = out.unionByName(rows(fn(df, thresholds)))
    if diff is not None and (only is None or "release_diff" in only):
        out = out.unionByName(rows(release_flags(diff)))
    return out.orderBy(severity_rank(F.col("severity")), "detector", "group_key", "record_id")


def detectors_run(df: DataFrame, flags: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """(detector, status, records_flagged, note): what ran, what was skipped and why."""
    rows = [(name, "skipped" if gone else "ran", f"release lacks {', '.join(gone)}" if gone else "") for name, gone in lacking(df).items()]
    rows.append(("release_diff", "ran", "" if diff is not None else "no release before"))
    ran = df.sparkSession.createDataFrame(rows, "detector string, status string, note string")
    n = flags.groupBy("detector").agg(F.countDistinct("record_id").alias("records_flagged"))
    return ran.join(n, "detector", "left").select("detector", "status", F.coalesce("records_flagged", F.lit(0)).alias("records_flagged"), "note")


#: What can become of a correction.
CORRECTION_STATUS = ("approved", "pending", "rejected", "retired")


def checked_corrections(table: DataFrame) -> DataFrame:
    """``table`` of corrections, if it has its columns and no unknown status; else an error that names them."""
    missing = {"record_id", "field", "old_value", "new_value", "status", "reviewer", "reviewed_on"} - set(table.columns)
    if missing:
        raise ValueError(f"corrections lack {', '.join(sorted(missing))}")
    bad = [r.status for r in table.where(~F.coalesce(F.col("status").isin(*CORRECTION_STATUS), F.lit(False))).select("status").distinct().take(5)]
    if bad:
        raise ValueError(f"corrections have an unknown status: {', '.join(map(str, bad))}")
    return table


def covered(flags: DataFrame, decisions: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Flags with ``covered_by``: the status of decisions (record_id, status), approved before pending before others; else
    "exception" for records among ``exceptions`` (record_id)."""
    rank = F.when(F.col("status") == "approved", 0).when(F.col("status") == "pending", 1).otherwise(2)
    best = decisions.groupBy("record_id").agg(F.min_by("status", rank).alias("covered_by"))
    out = flags.join(best, "record_id", "left")
    if exceptions is None:
        return out
    known = exceptions.select("record_id").distinct().withColumn("_known", F.lit(True))
    return out.join(known, "record_id", "left").withColumn("covered_by", F.coalesce("covered_by", F.when(F.col("_known"), "exception"))).drop("_known")


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for k, s in enumerate(SEVERITY):
        out = F.when(severity == s, k).otherwise(out)
    return out


def review_queue(flags: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Uncovered flags without an exception (record_id, detector), most severe first; what is only told (info) is no item."""
    open_ = flags.where("covered_by is null and severity <> 'info'").join(exceptions.select("record_id", "detector"), ["record_id", "detector"], "left_anti")
    return open_.withColumn("priority", severity_rank(F.col("severity"))).orderBy("priority", "detector", "record_id")


def medoids(df: DataFrame, key: str, label: str) -> DataFrame:
    """(label, key, x, y): of each label the row with the least sum of distances to the others, ties to the smaller key.

    Rows at one place count as one with a weight, so the pairs are those of a label's places.
    """
    places = df.groupBy(label, "x", "y").agg(F.min(key).alias(key), F.count("*").alias("_w"))
    b = places.select(label, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("_w").alias("_wb"))
    sums = places.join(b, label).groupBy(label, key, "x", "y").agg(F.round(F.sum(F.col("_wb") * G.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))), 4).alias("s"))
    return first_per(sums, [label], ["s", key]).select(label, key, "x", "y")


def minted_ids(df: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, problems) of records (record_id, own_id, source_row, located).

    assigned: (record_id, facility_id, id_source, own_differs): a record that isn't located has none; else the id that the ledger
    (record_id, facility_id, id_source) has for it, else its own if the ledger has it for no other, else the next number
    behind all ids of the ledger and all own ids. problems: (problem, facility_id): ids that two records have, and own ids
    that the ledger minted for another record.
    """
    led = ledger.select("record_id", F.col("facility_id").alias("_led"))
    used = ledger.select(F.col("facility_id").alias("own_id")).distinct().withColumn("_used", F.lit(True))
    rows = df.join(led, "record_id", "left").join(used, "own_id", "left")
    source = F.when(~F.col("located"), "unlocated").when(F.col("_led").isNotNull(), "ledger").when(F.col("own_id").isNotNull() & F.col("_used").isNull(), "own").otherwise("synthetic")
    rows = materialise(rows.select("record_id", "own_id", "source_row", "located", "_led", source.alias("id_source")))
    have = rows.where("id_source <> 'synthetic'").select("record_id", F.when(F.col("id_source") == "ledger", F.col("_led")).when(F.col("id_source") == "own", F.col("own_id")).alias("facility_id"), "id_source", "own_id")
    top = ledger.select(F.col("facility_id").alias("v")).unionByName(df.select(F.col("own_id").alias("v"))).agg(F.max("v")).first()[0] or 0
    made = numbered(rows.where("id_source = 'synthetic'").select("record_id", "source_row", "own_id"), ["source_row", "record_id"], "facility_id", int(top) + 1)
    out = materialise(have.unionByName(made.select("record_id", "facility_id", F.lit("synthetic").alias("id_source"), "own_id")))
    assigned = out.select("record_id", "facility_id", "id_source", F.coalesce((F.col("id_source") == "ledger") & (F.col("own_id") != F.col("facility_id")), F.lit(False)).alias("own_differs"))
    twice = out.where("facility_id is not null").groupBy("facility_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("id of two records").alias("problem"), "facility_id")
    minted = ledger.where("id_source = 'synthetic'").select(F.col("facility_id").alias("own_id"), F.col("record_id").alias("_owner"))
    clash = rows.where("located").join(minted, "own_id").where("record_id <> _owner").select(F.lit("own id was minted for another record").alias("problem"), F.col("own_id").alias("facility_id"))
    return assigned, twice.unionByName(clash).distinct()


def boundary_check(points: DataFrame, polygons: DataFrame, near: float = 2000.0, adjacent: float = 20000.0, side: float = 20000.0) -> DataFrame:
    """(id, outcome, relation, own_km, inside_of, priority, note) of points (id, x, y, community_id, key) against (poly, guid, key, rings).

    A point's own polygons are those of its community id if any has it, else of its key. Only a point inside another
    community's polygon and farther than ``adjacent`` from its own is for review; the note says why others aren't tested.
    """
    hit = spatial.in_polygons(points, polygons.select("poly", "rings"), side).join(polygons.select("poly", F.col("key").alias("pk")), "poly").groupBy("id").agg(F.array_sort(F.collect_set("pk")).alias("inside_of"))
    guid = points.join(polygons.select("guid", "rings"), F.col("community_id") == F.col("guid")).select("id", "x", "y", "rings")
    named = points.join(guid.select("id").distinct(), "id", "left_anti").join(polygons.select(F.col("key").alias("pk"), "rings"), F.col("key") == F.col("pk")).select("id", "x", "y", "rings")
    own = guid.unionByName(named).groupBy("id").agg(F.min(G.to_polygon(F.col("x"), F.col("y"), F.col("rings"))).alias("d"))
    rows = points.select("id").join(own, "id", "left").join(hit, "id", "left")
    inside = F.col("inside_of").isNotNull()
    outcome = F.when(F.col("d").isNull(), "untested").when(F.col("d") <= near, "match").when(inside, "mismatch").otherwise("outside")
    relation = F.when(F.col("d").isNull(), "untested").when(F.col("d") <= near, "inside").when(~inside, "remote").when(F.col("d") <= adjacent, "adjacent").otherwise("elsewhere")
    rows = rows.join(points.select("id", F.col("key").isNull().alias("_bare")), "id")
    priority = F.when((outcome == "mismatch") & (F.col("d") > adjacent), "review").when(outcome.isin("mismatch", "outside"), "info")
    note = F.when((outcome == "untested") & F.col("_bare"), "no label").when(outcome == "untested", "no boundary for this community").when(outcome == "outside", "remote site").when((outcome == "mismatch") & (F.col("d") <= adjacent), "a neighbouring place")
    return rows.select("id", outcome.alias("outcome"), relation.alias("relation"), (F.col("d") / 1000).alias("own_km"), F.array_join("inside_of", ";").alias("inside_of"), priority.alias("priority"), note.alias("note"))


def region_of(points: DataFrame, polygons: DataFrame, cap: float = 25000.0) -> DataFrame:
    """(id, region, relation, km): the polygon that holds a point, else the nearest within reach."""
    near = spatial.nearest_polygon(points, polygons, cap)
    rows = points.select("id", "x").join(near, "id", "left")
    relation = F.when(F.col("x").isNull(), "untested").when(F.col("poly").isNull(), "outside").when(F.col("dist") == 0, "inside").otherwise("nearest")
    return rows.select("id", F.col("poly").alias("region"), relation.alias("relation"), (F.col("dist") / 1000).alias("km"))


def counts_with_zeros(rows: DataFrame, dims: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return dims.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def capacity_status(tolerance: float = 1.0) -> Column:
    some = F.coalesce(*[F.col(f) for f in FUELS]).isNotNull()
    return F.when(F.col("total_capacity").isNull(), "missing").when(some & (F.abs(fuel_sum() - F.col("total_capacity")) > tolerance), "mismatch").otherwise("ok")


def checks(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(check, passed, failures): how many rows break each named predicate, in one pass over the rows."""
    counted = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"c{k}") for k, (_, rule) in enumerate(rules)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), (F.col(f"c{k}") == 0).alias("passed"), F.col(f"c{k}").alias("failures")) for k, (n, _) in enumerate(rules)]))
    return counted.select(rows.alias("r")).select("r.*")


def publish_checks(
    rows: DataFrame, release: DataFrame, excluded: DataFrame, log: DataFrame, schema: list[str], derived: list[str], contact: tuple[str, ...],
    ledger: DataFrame | None, regions: bool, fixtures: list[tuple[str, Column]],
) -> DataFrame:
    """(check, passed, failures): the contract of a published table. Rows are counted in one pass, ids in one more."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    has = set(rows.columns)
    undeclared = has - set(schema) - set(derived)
    n_rows, n_release, n_out, no_reason = rows.count(), release.count(), excluded.count(), excluded.where("exclusion_reason is null").count()
    reviewed = {"reviewer", "reviewed_on"} <= set(log.columns)
    unsigned = log.where("outcome = 'applied' and (reviewer is null or reviewed_on is null)").count() if reviewed else 0
    known = [
        ("no undeclared column", len(undeclared)),
        ("row reconciliation", abs(n_release - n_rows - n_out)),
        ("every exclusion has a reason", no_reason),
        ("every applied correction has reviewer and date", unsigned),
        ("no contact columns", sum(any(w in c.lower() for w in contact) for c in has)),
        ("every derived column is present", len(set(derived) - has)),
    ]
    if ledger is not None:
        ids = rows.where(located & F.col("facility_id").isNotNull())
        moved = ids.select("record_id", "facility_id").join(ledger.select("record_id", F.col("facility_id").alias("_led")), "record_id").where("facility_id <> _led").count()
        known += [("facility_id is unique", ids.groupBy("facility_id").count().where("count > 1").count()), ("facility_id never differs from the ledger", moved)]
    spark = rows.sparkSession
    counted = spark.createDataFrame([(n, k == 0, k) for n, k in known], "check string, passed boolean, failures long")
    rules = [("record_id known", F.col("record_id").isNotNull()), ("key where name", F.col("community_name").isNull() | F.col("community_key").isNotNull())]
    if ledger is not None:
        rules.append(("every located record has a facility_id", ~located | F.col("facility_id").isNotNull()))
    if regions:
        rules.append(("every located record has a region or lies outside", ~located | F.col("aea_region").isNotNull() | (F.col("aea_region_relation") == "outside")))
    rules += [(f"fixture: {name}", ~located | rule) for name, rule in fixtures]
    twice = repeated_keys(rows, "record_id").count()
    return counted.unionByName(checks(rows, rules)).unionByName(spark.createDataFrame([("no record twice", twice == 0, twice)], counted.schema))


def queue_counts(queue: DataFrame) -> DataFrame:
    """(severity, detector, n) of a review queue."""
    return queue.groupBy("severity", "detector").agg(F.count("*").alias("n"))


def flagged(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """``left`` with the columns of ``right`` by ``key`` and whether it was there; a key that repeats on either side is an error."""
    for name, df in (("left", left), ("right", right)):
        twice = [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key).take(5)]
        if twice:
            raise ValueError(f"{key} repeats on the {name}: {', '.join(map(str, twice))}")
    found = right.withColumn(flag, F.lit(True))
    return left.join(found, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def null_safe_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where two nulls are equal."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.col(keys[0]).eqNullSafe(F.col(f"_r_{keys[0]}"))
    for k in keys[1:]:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on, "left").drop(*[f"_r_{k}" for k in keys])


def ledger_summary(corrections: DataFrame, log: DataFrame, queue: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counts: corrections by status and outcome, open items by severity, records by status and place."""
    n = lambda df, **conditions: df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])
    is_ = lambda column, value: F.col(column) == value
    a = n(corrections, **{s: is_("status", s) for s in CORRECTION_STATUS})
    b = n(log, applied=is_("outcome", "applied"), stale=is_("outcome", "skipped-old-value-mismatch"), absent=is_("outcome", "skipped-record-absent"), unknown_field=is_("outcome", "skipped-unknown-field"))
    c = n(queue, high=is_("severity", "high"), medium=is_("severity", "medium"), low=is_("severity", "low"))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    d = n(rows, records=F.lit(True), located=located, clean=is_("qc_status", "clean"), pending_review=is_("qc_status", "pending_review"))
    # One row each.
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


def label_review(rows: DataFrame, known: DataFrame, places: DataFrame, reach: float, start: float) -> DataFrame:
    """Labels of records (record_id, community_key, code, x, y) that ``known`` (community_key) lacks: how many records, their
    median place, their codes, and the two nearest of ``places`` (name, x, y) with distances."""
    odd = rows.where("community_key is not null").join(known.select("community_key").distinct(), "community_key", "left_anti")
    label = materialise(odd.groupBy("community_key").agg(F.count("*").alias("records"), F.median("x").alias("x"), F.median("y").alias("y"), F.array_join(F.array_sort(F.collect_set("code")), ";").alias("codes")))
    near = spatial.k_nearest(label.select(F.col("community_key").alias("id"), "x", "y").dropna(), places.select(F.col("name").alias("id"), "x", "y"), 2, start)
    two = near.where(F.col("dist") <= reach).groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("dist", "right_id"))).alias("near"))
    out = label.join(two, F.col("community_key") == F.col("left_id"), "left")
    return out.select("community_key", "records", "x", "y", "codes", F.get("near", 0)["right_id"].alias("nearest"), F.get("near", 0)["dist"].alias("nearest_m"), F.get("near", 1)["right_id"].alias("second"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
