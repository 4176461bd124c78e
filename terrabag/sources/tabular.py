"""Cell tables: schema resolution, CSV scans, exported collections, GeoJSON sites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabag.operators.bags import audited_bags

# Names that a column of each role may have, in lower case.
LABEL_NAMES = ("presence", "present", "label", "pa")
ID_NAMES = ("siteno", "site_no", "site_id", "bag_id")
X_NAMES = ("x", "easting", "longitude", "lon")
Y_NAMES = ("y", "northing", "latitude", "lat")

_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


@dataclass(frozen=True)
class TabularConfig:
    """Columns of a cell table; None is detected."""

    label: str | None = None
    bag_id: str | None = None
    x: str | None = None
    y: str | None = None
    features: tuple[str, ...] = field(default_factory=tuple)
    min_unique_cells: int = 3


def _one(columns: Sequence[str], names: Sequence[str], role: str) -> str:
    found = [c for c in columns if c.lower() in names]
    if len(found) != 1:
        raise ValueError(f"{role}: expected one column named like {', '.join(names)}, found {found or 'none'}")
    return found[0]


def resolve(df: DataFrame, config: TabularConfig | None = None) -> TabularConfig:
    """The config with every role named; raises if a role has no or several candidates, or a named column is missing. No job runs."""
    c, cols = config or TabularConfig(), df.columns
    roles = {"label": (c.label, LABEL_NAMES), "bag_id": (c.bag_id, ID_NAMES), "x": (c.x, X_NAMES), "y": (c.y, Y_NAMES)}
    named = {role: given or _one(cols, names, role) for role, (given, names) in roles.items()}
    features = c.features or tuple(n for n, t in df.dtypes if n not in named.values() and not n.lower().startswith("unnamed:") and (t in _NUMERIC or t.startswith("decimal")))
    missing = [n for n in (*named.values(), *features) if n not in cols]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    if not features:
        raise ValueError("no feature columns")
    return TabularConfig(**named, features=features, min_unique_cells=c.min_unique_cells)


def detect_columns(df: DataFrame) -> dict[str, str | None]:
    """The first column of each role, or None: a looser detection than resolve()."""
    low = {c.lower(): c for c in reversed(df.columns)}
    return {role: next((low[n] for n in names if n in low), None) for role, names in (("label", LABEL_NAMES), ("bag_id", ID_NAMES), ("x", X_NAMES), ("y", Y_NAMES))}


def detect_xy(df: DataFrame) -> tuple[str, str] | None:
    """The first matching pair of coordinate columns."""
    low = {c.lower(): c for c in reversed(df.columns)}
    pairs = [("x", "y"), ("easting", "northing"), ("longitude", "latitude"), ("lon", "lat"), ("long", "lat")]
    return next(((low[a], low[b]) for a, b in pairs if a in low and b in low), None)


def read_cells(spark: SparkSession, path: str, config: TabularConfig | None = None, labels: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame, TabularConfig]:
    """(cells, exclusions, config) of CSV files. Rows are ordered by file, then by place in the file for the rule that the first stays."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    config = resolve(df, config)
    df = df.withColumn("__ord", F.monotonically_increasing_id())
    cells, out = audited_bags(df, config.features, config.label, config.bag_id, config.x, config.y, "__ord", labels, config.min_unique_cells)
    return cells, out, config


def read_presences(spark: SparkSession, path: str, columns: Sequence[str], label: str = "presence") -> DataFrame:
    """The presence rows of a CSV with only the columns needed."""
    return spark.read.csv(path, header=True, inferSchema=True).filter(F.col(label) == 1).select(*columns)


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def read_collections(spark: SparkSession, folder: str, features: Sequence[str]) -> DataFrame:
    """Cells of a manifest (index, id, label) and one CSV a bag with collection_index."""
    manifest = spark.read.csv(f"{folder}/manifest.csv", header=True, inferSchema=True).select("index", F.col("id").cast("string").alias("bag_id"), "label")
    rows = spark.read.csv(f"{folder}/r_collection_*.csv", header=True, inferSchema=True)
    cells = rows.select(F.col("collection_index").alias("index"), F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.monotonically_increasing_id().alias("cell_id"))
    return cells.join(manifest, "index").drop("index")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """site_id, geom_type, x, y and ring of each feature of a GeoJSON collection; polygons have a ring, points coordinates."""
    schema = "features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("site_id", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.from_json(raw, "array<double>")
    ring = F.element_at(F.from_json(raw, "array<array<array<double>>>"), 1)
    return f.select(
        F.format_string("site-%05d", "site_id").alias("site_id"), kind.alias("geom_type"), F.when(kind == "Point", F.element_at(point, 1)).alias("x"), F.when(kind == "Point", F.element_at(point, 2)).alias("y"),
        F.when(kind == "Polygon", F.transform(ring, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))).alias("ring"),
    )


def write_geojson(points: DataFrame, path: str) -> None:
    """One GeoJSON feature a line for points with site_id, x and y."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    props = F.struct(F.col("site_id").cast("string").alias("site_id"))
    points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)
