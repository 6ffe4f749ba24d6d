"""Sources: text tables, releases, points, lines, polygons, flight pairs, GeoJSON and rasters as cell tables.

Every reader selects its columns at the scan, so other columns are never parsed.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions import geometry as G
from spanwise.functions import scalars as S
from spanwise.functions.albers import ALASKA
from spanwise.operators import spatial


def text_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all texts; blanks are null."""
    df = spark.read.csv(path, header=True, nullValue="", quote='"', escape='"', multiLine=True, inferSchema=False)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def releases(spark: SparkSession, root: str) -> list[str]:
    """Labels of the releases under ``root`` (folders release=<label>), oldest first; listed by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName()[len("release=") :] for s in found if s.isDirectory() and s.getPath().getName().startswith("release="))


def read_release(spark: SparkSession, root: str, label: str | None = None) -> DataFrame:
    """One release, the latest unless named; only its folder is read."""
    labels = releases(spark, root)
    if not labels or (label and label not in labels):
        raise FileNotFoundError(f"no release {label or ''} under {root}")
    return spark.read.parquet(f"{root}/release={label or labels[-1]}")


def previous_release(spark: SparkSession, root: str, label: str) -> DataFrame | None:
    before = [x for x in releases(spark, root) if x < label]
    return spark.read.parquet(f"{root}/release={before[-1]}") if before else None


#: What a column map may say of a source column.
KEEP = ("yes", "fold", "no", "never")


def column_map(rows: list[dict], schema: list[str]) -> list[dict]:
    """Checked rows of a column map: source_column, schema_column, type, keep, fold_into."""
    names = [r["source_column"] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a source column is mapped twice")
    for r in rows:
        if r["keep"] not in KEEP:
            raise ValueError(f"{r['source_column']}: keep is {r['keep']}")
        target = r["schema_column"] if r["keep"] == "yes" else r["fold_into"] if r["keep"] == "fold" else None
        if r["keep"] in ("yes", "fold") and target not in schema:
            raise ValueError(f"{r['source_column']}: {target} isn't in the schema")
    return rows


def snapshot(raw: DataFrame, mapping: list[dict], schema: list[tuple[str, str]]) -> DataFrame:
    """A typed release of the schema's columns: mapped ones typed, folded ones filling nulls, missing ones null."""
    missing = [r["source_column"] for r in mapping if r["keep"] in ("yes", "fold") and r["source_column"] not in raw.columns]
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    kinds = dict(schema)
    out = []
    for name, kind in schema:
        main = [r["source_column"] for r in mapping if r["keep"] == "yes" and r["schema_column"] == name]
        folds = [r["source_column"] for r in mapping if r["keep"] == "fold" and r["fold_into"] == name]
        values = [S.typed(F.col(f"`{c}`"), kinds[name]) for c in main + folds]
        out.append((F.coalesce(*values) if values else S.typed(F.lit(None).cast("string"), kind)).alias(name))
    return raw.select(*out)


def column_like(df: DataFrame, names: list[str]) -> str:
    """The first of ``names`` that ``df`` has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return have[n.lower()]
    raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")


def points(df: DataFrame, columns: dict[str, str] | None = None, numbers: tuple[str, ...] = (), project: bool = True) -> DataFrame:
    """Rows with coordinates, renamed and with x, y in metres; longitudes and latitudes are found by their usual names."""
    for old, new in (columns or {}).items():
        df = df.withColumnRenamed(old, new)
    lon, lat = column_like(df, ["longitude", "lon", "long", "x"]), column_like(df, ["latitude", "lat", "y"])
    df = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    df = df.withColumn("_lon", F.col(lon).try_cast("double")).withColumn("_lat", F.col(lat).try_cast("double")).where("_lon is not null and _lat is not null")
    x, y = ALASKA.forward(F.col("_lon"), F.col("_lat")) if project else (F.col("_lon"), F.col("_lat"))
    return df.withColumn("x", x).withColumn("y", y).drop("_lon", "_lat")


def lines(df: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Single lines of (id, parts): parts apart, those without length and those off the box (x0, y0, x1, y1) gone."""
    rows = df.where(F.col("parts").isNotNull()).select(*[c for c in df.columns if c != "parts"], F.posexplode("parts").alias("part", "line"))
    rows = rows.where((F.size("line") > 1) & (G.length(F.col("line")) > 0))
    if box:
        x0, y0, x1, y1 = box
        lo = lambda k: F.array_min(F.transform("line", lambda p: p[k]))
        hi = lambda k: F.array_max(F.transform("line", lambda p: p[k]))
        rows = rows.where((hi("x") >= x0) & (lo("x") <= x1) & (hi("y") >= y0) & (lo("y") <= y1))
    return rows


def roads(primary: DataFrame, extra: DataFrame, boundary: DataFrame, side: float = 20000.0) -> DataFrame:
    """Primary lines and those extra ones (id, line) that leave the boundary polygons (poly, rings): some vertex lies outside."""
    vertices = extra.select(F.col("id").alias("line_id"), F.posexplode("line").alias("k", "p")).select(F.concat_ws("#", "line_id", "k").alias("id"), "line_id", "p.x", "p.y")
    held = spatial.in_polygons(vertices.select("id", "x", "y"), boundary, side).select("id").distinct()
    leaving = vertices.join(held, "id", "left_anti").select(F.col("line_id").alias("id")).distinct()
    return primary.select("id", "line").unionByName(extra.join(leaving, "id", "left_semi").select("id", "line"))


def geojson(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Features with the named properties (name: type) and, for points, lon and lat."""
    props = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in properties.items()])
    shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
    feature = T.StructType([T.StructField("properties", props), T.StructField("geometry", shape)])
    df = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True)
    rows = df.select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"))


def flights(df: DataFrame, codes: list[str], places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legs whose both ends are known, with coordinates, and the codes that aren't.

    ``df`` has origin and destination; ``places`` has (x, y) and the code columns, of which the first that matches counts.
    """
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.upper(F.trim(c)).alias("code")) for k, c in enumerate(codes)]))
    table = places.select("x", "y", options.alias("o")).where("o.code is not null and o.code <> ''").groupBy("o.code").agg(F.min(F.struct("o.rank", "x", "y")).alias("b")).select("code", "b.x", "b.y")
    side = lambda n: table.select(F.col("code").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    legs = df.withColumns({c: F.upper(F.trim(c)) for c in ("origin", "destination")})
    ok = legs.join(side("origin"), "origin").join(side("destination"), "destination")
    unknown = legs.select(F.explode(F.array("origin", "destination")).alias("code")).distinct().join(table, "code", "left_anti")
    return ok, unknown


def manual_connections(df: DataFrame, modes: tuple[str, ...] = ("road", "ice_road", "barge", "air")) -> tuple[DataFrame, DataFrame]:
    """Connections with a known mode (as a slug, to be written by mode) and the others."""
    mode = column_like(df, ["mode", "type", "connection_type"])
    rows = df.withColumn("mode_slug", F.regexp_replace(F.lower(F.trim(F.col(mode))), r"[\s\-]+", "_"))
    known = F.coalesce(F.col("mode_slug").isin(*modes), F.lit(False))
    return rows.where(known), rows.where(~known)


def normalised(spark: SparkSession, spec: list[dict]) -> dict[str, DataFrame | None]:
    """Tables of a declarative spec: name, path, format, filter, rename, keep. An optional source without a file is None; any other failure is an error."""
    out: dict[str, DataFrame | None] = {}
    for e in spec:
        try:
            df = text_table(spark, e["path"]) if e.get("format", "csv") == "csv" else spark.read.format(e["format"]).load(e["path"])
        except AnalysisException as x:
            if not e.get("optional") or x.getCondition() != "PATH_NOT_FOUND":
                raise
            out[e["name"]] = None
            continue
        if e.get("filter"):
            df = df.where(e["filter"])
        df = df.withColumnsRenamed(e.get("rename", {}))
        out[e["name"]] = df.select(*e["keep"]) if e.get("keep") else df
    return out


def lookup_tiers(df: DataFrame, key: Column, tiers: list[DataFrame]) -> DataFrame:
    """``df`` with ``found`` and ``tier``: the first of the lookups (name, value) that knows the key, however it is keyed."""
    rows = df.withColumn("_key", key)
    for k, t in enumerate(tiers):
        one = t.select(F.col("name").alias(f"_n{k}"), F.col("value").alias(f"_v{k}")).groupBy(f"_n{k}").agg(F.min(f"_v{k}").alias(f"_v{k}"))
        rows = rows.join(one, F.col("_key") == F.col(f"_n{k}"), "left")
    tier = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), k + 1) for k in range(len(tiers))])
    return rows.select(*df.columns, F.coalesce(*[F.col(f"_v{k}") for k in range(len(tiers))]).alias("found"), tier.alias("tier"))


def manifest(spark: SparkSession, path: str) -> dict:
    """A JSON object kept as a text file."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def matched_places(names: DataFrame, places: DataFrame, fixed: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, x, y, tier): where a name of an airport or place is, by the first way that finds one.

    1 ``fixed`` (name, x, y); 2 ``overrides`` (name, code); 3 a code of three capitals; 4 the whole name; 5 the name without words
    like "airport"; 6 one of the two is a word of the other, for names of four letters or more. ``places`` is (code, name, x, y);
    of several the smallest code counts. Names are compared in lower case, with single spaces. All ways are equal joins.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    at = F.struct(F.col("code").alias("k"), "x", "y")
    rows = names.select("name").distinct().withColumn("_n", norm(F.col("name"))).withColumn("_b", S.base_name(F.col("name")))
    by_code = places.groupBy(F.upper("code").alias("_c")).agg(F.min(at).alias("p"))
    keyed = places.select(S.base_name(F.col("name")).alias("_k"), "code", "x", "y").where("_k is not null")
    by_name = keyed.groupBy("_k").agg(F.min(at).alias("p"))
    hit = lambda df, key, other, n: rows.join(df, F.col(key) == F.col(other)).select("name", F.struct(F.lit(n).alias("tier"), F.col("p.k").cast("string").alias("k"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("h"))
    known = fixed.select(norm(F.col("name")).alias("_f"), F.struct(F.lit("").alias("k"), "x", "y").alias("p"))
    moved = overrides.select(norm(F.col("name")).alias("_o"), F.upper("code").alias("_c")).join(by_code, "_c").select("_o", "p")
    out = hit(known, "_n", "_f", 1).unionByName(hit(moved, "_n", "_o", 2))
    code = F.when(F.trim("name").rlike("^[A-Z]{3}$"), F.trim("name"))
    out = out.unionByName(rows.withColumn("_code", code).join(by_code, F.col("_code") == F.col("_c")).select("name", F.struct(F.lit(3).alias("tier"), F.col("p.k").cast("string").alias("k"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("h")))
    out = out.unionByName(hit(by_name, "_n", "_k", 4)).unionByName(hit(by_name, "_b", "_k", 5))
    long = rows.where(F.length("_b") >= 4)
    words = by_name.select(F.explode(F.split("_k", " ")).alias("_w"), "p")
    own = long.select("name", F.explode(F.split("_b", " ")).alias("_w")).join(by_name, F.col("_w") == F.col("_k"))
    loose = long.join(words, F.col("_b") == F.col("_w")).select("name", "p").unionByName(own.select("name", "p"))
    out = out.unionByName(loose.select("name", F.struct(F.lit(6).alias("tier"), F.col("p.k").cast("string").alias("k"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("h")))
    best = out.groupBy("name").agg(F.min("h").alias("h")).select(F.col("name").alias("_name"), "h")
    return rows.join(best, F.col("name") == F.col("_name"), "left").select("name", "h.x", "h.y", "h.tier")


def road_stitches(primary: DataFrame, extra: DataFrame, reach: float = 5000.0) -> DataFrame:
    """(id, line): from each extra line (id, line) the shortest straight way, at most ``reach`` long, from one of its ends to a primary line."""
    ends = extra.select("id", F.explode(F.array(F.get("line", 0), F.element_at("line", -1))).alias("p")).select(F.struct("id", "p.x", "p.y").alias("id"), "p.x", "p.y").distinct()
    parts = primary.select(F.col("id").alias("line"), F.posexplode(G.segments(F.col("line"))).alias("part", "s")).select("line", "part", *[F.col(f"s.{e}.{k}").alias(f"{k}{n}") for n, e in ((1, "a"), (2, "b")) for k in "xy"])
    near = spatial.nearest_line(ends, parts, reach).join(parts, ["line", "part"])
    along = lambda p, q: F.col(p) + F.col("t") * (F.col(q) - F.col(p))
    best = near.groupBy(F.col("id.id").alias("id")).agg(F.min(F.struct("dist", F.col("id.x").alias("x"), F.col("id.y").alias("y"), along("x1", "x2").alias("px"), along("y1", "y2").alias("py"))).alias("b"))
    return best.where("b.dist > 0").select("id", F.array(spatial.point(F.col("b.x"), F.col("b.y")), spatial.point(F.col("b.px"), F.col("b.py"))).alias("line"))
