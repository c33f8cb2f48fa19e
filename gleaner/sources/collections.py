"""Keyed collections of embedded chunks as partitioned parquet tables.

A collection is a folder with ``meta`` (one row: width, buckets), ``points``,
partitioned by a hash bucket of the point id, and ``deltas``, one folder per
upsert since the points were last rewritten. A small batch of points has ids in
every bucket, so an upsert only adds its delta; readers put the latest version
of a point before the stored one. Once the deltas hold more than
``COMPACT_SHARE`` of the points, they are merged into them. So a point is
rewritten a bounded number of times on average, however small the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gleaner.functions import text as T
from gleaner.schemas import CHUNK
from gleaner.session import cut_lineage

# Fixed value: prefix of the names that point ids are made from. Pass the
# prefix of an existing store to keep its ids.
ID_PREFIX = "chunk:"
BUCKETS = 64
COMPACT_SHARE = 0.25

PAYLOAD = CHUNK.replace(" id string", " chunk_id string")
POINT = f"point_id string, embedding array<float>, {PAYLOAD}"
NODE_PAYLOAD = (
    "chunk_id string, document_id string, content_type string, provider string, title string, "
    "section string, heading_path array<string>, text string, source_url string, parent_id string, "
    "node_type string, level int, children array<string>, ord bigint"
)
NODE_POINT = f"point_id string, embedding array<float>, {NODE_PAYLOAD}"


def point_id(chunk_id, prefix: str = ID_PREFIX):
    return T.uuid5(F.concat(F.lit(prefix), chunk_id))


def as_points(chunks: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Chunks with ``embedding`` as points: ``id`` becomes ``chunk_id``."""
    return chunks.withColumn("point_id", point_id(F.col("id"), prefix)).withColumnRenamed("id", "chunk_id")


def as_chunks(points: DataFrame) -> DataFrame:
    """The inverse; an empty heading path becomes the section."""
    path = F.when(
        F.coalesce(F.size("heading_path"), F.lit(0)) > 0, F.col("heading_path")
    ).otherwise(F.array("section"))
    return (
        points.withColumnRenamed("chunk_id", "id").withColumn("heading_path", path).drop("point_id", "bucket")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def ensure_collection(spark: SparkSession, path: str, dimensions: int, buckets: int = BUCKETS) -> None:
    """Create the collection if it is missing; an existing one stays as it is."""
    if not _exists(spark, f"{path}/meta"):
        meta = spark.createDataFrame([(dimensions, buckets)], "dimensions int, buckets int")
        meta.coalesce(1).write.parquet(f"{path}/meta")


def describe(spark: SparkSession, path: str) -> tuple[int, int]:
    """Width of the vectors and number of buckets."""
    row = spark.read.parquet(f"{path}/meta").first()
    return row.dimensions, row.buckets


def read_points(spark: SparkSession, path: str, schema: str = POINT) -> DataFrame:
    """All points, in their latest version. Filters on the bucket prune folders of
    the stored points, others use parquet statistics."""
    stored, deltas = _stored(spark, path, schema), _deltas(spark, path, schema)
    if stored is None:
        stored = spark.createDataFrame([], f"{schema}, bucket int")
    if deltas is None:
        return stored
    latest = latest_per_point(deltas, ["seq"]).drop("copies", "seq")
    return merge(stored, latest.select(*stored.columns))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    found = _exists(spark, f"{path}/points")
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/points") if found else None


def _deltas(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The upserts since the last compaction, numbered by ``seq``."""
    if not _exists(spark, f"{path}/deltas"):
        return None
    return spark.read.schema(f"{schema}, bucket int, seq int").parquet(f"{path}/deltas")


def latest_per_point(points: DataFrame, order: list[str]) -> DataFrame:
    """One row per point id, the last in ``order``. Copies of a point are reduced
    before the shuffle, however many there are."""
    rest = [c for c in points.columns if c != "point_id"]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    kept = points.groupBy("point_id").agg(last.alias("_row"), F.count("*").alias("copies"))
    return kept.select("point_id", "_row.*", "copies")


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by point id."""
    return existing.join(incoming.select("point_id"), "point_id", "left_anti").unionByName(incoming)


def upsert(points: DataFrame, path: str, order: list[str], schema: str = POINT) -> int:
    """Write points into an existing collection; returns the number of rows taken in."""
    spark = points.sparkSession
    dimensions, buckets = describe(spark, path)
    columns = [f.split(" ")[0] for f in schema.split(", ")]
    wrong = F.when(
        F.coalesce(F.size("embedding"), F.lit(-1)) != dimensions,
        F.raise_error(F.lit("a vector is missing or has the wrong width")).cast("array<float>"),
    ).otherwise(F.col("embedding"))
    taken = points.select(*columns).withColumn("embedding", wrong)
    bucket = F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int")
    # Materialized once: the vectors are costly and the rows are needed three times.
    staged = cut_lineage(latest_per_point(taken, order).withColumn("bucket", bucket))
    incoming = staged.drop("copies")
    stored, deltas = _stored(spark, path, schema), _deltas(spark, path, schema)
    if stored is None:
        _write_buckets(incoming, path)
    else:
        last = None if deltas is None else deltas.agg(F.max("seq")).first()[0]
        delta = incoming.withColumn("seq", F.lit(0 if last is None else last + 1))
        delta.write.mode("append").partitionBy("seq").parquet(f"{path}/deltas")
        waiting = _deltas(spark, path, schema).count()
        if waiting > COMPACT_SHARE * stored.count():
            compact(spark, path, schema)
    return staged.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]


def _write_buckets(points: DataFrame, path: str) -> None:
    """Replace the buckets that occur in ``points``."""
    (
        points.hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(f"{path}/points")
    )


def compact(spark: SparkSession, path: str, schema: str = POINT) -> None:
    """Merge the deltas into the points. If that is cut off half-way, the deltas
    are still there and say the same."""
    if _deltas(spark, path, schema) is None:
        return
    _write_buckets(cut_lineage(read_points(spark, path, schema)), path)
    nothing = spark.createDataFrame([], f"{schema}, bucket int, seq int")
    nothing.write.mode("overwrite").partitionBy("seq").parquet(f"{path}/deltas")


def copy_collections(spark: SparkSession, names: list[str], source: str, target: str, order: list[str]) -> dict[str, int]:
    """Copy collections below ``source`` into those below ``target`` as they are.

    Missing and empty ones are skipped."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("source and target are the same")
    copied = {}
    for name in names:
        if not _exists(spark, f"{source}/{name}/meta"):
            continue
        points = read_points(spark, f"{source}/{name}")
        if points.isEmpty():
            continue
        dimensions, buckets = describe(spark, f"{source}/{name}")
        ensure_collection(spark, f"{target}/{name}", dimensions, buckets)
        copied[name] = upsert(points.drop("bucket"), f"{target}/{name}", order)
    return copied


def index_report(points: DataFrame) -> DataFrame:
    """Chunks per document, with the grand total as the row without a document."""
    return (
        points.rollup("content_type", "document_id")
        .agg(F.count("*").alias("chunks"), F.grouping_id().alias("_level"))
        .filter(F.col("_level").isin(0, 3))
        .drop("_level")
    )
