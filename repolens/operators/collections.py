"""Set-based maintenance of keyed collections: upsert, delete, replace, look-up, statistics, cache joins.

Every operator takes whole DataFrames; keys that are null never match. Exact repetitions collapse to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last in the given order, later ties by the row's own hash, so the result is stable.

    A partial aggregate (max_by) keeps one row a key before anything moves, so a key with many versions is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, F.xxhash64(*df.columns))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """old with the rows of new put in by key; among rows of new with one key the last in order wins."""
    fresh = latest(new, keys, *order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """old without the rows whose key stands in keys."""
    return old.join(keys.select(*on).distinct(), on, "left_anti")


def replace(old: DataFrame, touched: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """All rows of touched keys give way to the rows of new: a delete and an insert in one statement."""
    return delete(old, touched, on).unionByName(new, allowMissingColumns=True)


def check_vectors(points: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """points with their vectors by key; raises if the two don't have the same keys."""
    joined = points.join(vectors, key, "full_outer")
    bad = joined.filter(F.col("embedding").isNull() | F.coalesce(*[F.col(c).isNotNull() for c in points.columns if c != key][:1]).__invert__()).limit(1)
    if not bad.isEmpty():
        raise ValueError("points and vectors don't match")
    return joined


def lookup(points: DataFrame, wanted: str) -> DataFrame:
    """The point with an id: 32 hex digits or more name it by its UUID form, anything else by itself."""
    hexes = "".join(c for c in wanted if c in "0123456789abcdef")
    uuid = "-".join((wanted[:8], wanted[8:12], wanted[12:16], wanted[16:20], wanted[20:32])) if len(hexes) == len(wanted) >= 32 else wanted
    return points.filter(F.col("point_id") == uuid)


def scroll(points: DataFrame, path: str, project: str) -> DataFrame:
    return points.filter((F.col("file_path") == path) & (F.col("project_id") == project))


def statistics(points: DataFrame, names: list[str] = X.COLLECTIONS) -> DataFrame:
    """(collection, points, populated) for all names, zero for those without points."""
    spark: SparkSession = points.sparkSession
    counts = points.groupBy(F.col("source_collection").alias("collection")).agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(n,) for n in names], "collection string")
    return wanted.join(counts, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("points"), (F.coalesce("n", F.lit(0)) > 0).alias("populated"))


def cache_split(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, distinct misses) of texts(content_hash, ...) against cache(content_hash, embedding)."""
    return texts.join(cache, "content_hash"), texts.join(cache, "content_hash", "left_anti").dropDuplicates(["content_hash"])


def run_statistics(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per project: files, files without any symbol, symbols."""
    n = symbols.groupBy("project_id", "file_path").agg(F.countDistinct("symbol_id").alias("k"))
    return (
        files.select("project_id", "file_path").distinct().join(n, ["project_id", "file_path"], "left").groupBy("project_id")
        .agg(F.count("*").alias("files"), F.count_if(F.col("k").isNull()).alias("files_without_symbols"), F.coalesce(F.sum("k"), F.lit(0)).alias("symbols"))
    )


def top_per_group(df: DataFrame, group: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """At most n rows a group, numbered from 1. Spark prunes each partition to n rows a group before the exchange."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)
