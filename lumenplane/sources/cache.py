"""Opened state kept as Parquet: index tables under a mark of their files' names, sizes and modification times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplane.sources import scan

VERSION = 2


def marks(files: DataFrame) -> DataFrame:
    """dataset_id and mark of the datasets of listed files: a digest of their files' names, sizes and times; folders do not count."""
    one = lambda f: F.concat_ws("/", F.regexp_extract(f["path"], "([^/]*)$", 1), f["length"].cast("string"), F.unix_micros(f["modificationTime"]).cast("string"))
    told = F.array_join(F.array_sort(F.transform("files", one)), "\n")
    return scan.datasets(files).select("dataset_id", F.sha2(F.concat(F.lit(f"{VERSION}\n"), told), 256).alias("mark"))


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    """What has been saved, if anything."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(path)


def save(index: DataFrame, files: DataFrame, path: str) -> None:
    """Add the index rows of datasets that are not there yet; Spark commits them as a whole."""
    kept = _kept(index.sparkSession, path)
    new = index.join(marks(files), "dataset_id")
    (new if kept is None else new.join(kept.select("mark").distinct(), "mark", "left_anti")).write.mode("append").parquet(path)


def load(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """Index rows of files whose mark is still theirs, wherever they lie now; anything else is a miss, never an error."""
    kept = _kept(spark, path)
    if kept is None:
        return marks(files).select("dataset_id").limit(0)
    return kept.drop("dataset_id").dropDuplicates().join(marks(files), "mark").drop("mark")


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files of datasets that the cache does not hold."""
    held = scan.datasets(files).join(cached.select("dataset_id").distinct(), "dataset_id", "left_anti").select(F.explode("files.path").alias("path"))
    return files.join(held, "path", "left_semi")


# The fields that two readings of a level must share.
SHARED = (
    "size_x", "size_y", "size_z", "size_c", "size_t", "pixel_type", "bits_per_pixel", "samples_per_pixel", "image_count", "dimension_order", "is_rgb", "is_interleaved", "is_indexed", "is_false_color", "is_little_endian",
    "resolution_count",
)


def agreeing(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """Levels of fresh that kept tells alike: the same dataset, series and resolution, and all shared fields, null like null."""
    same = [fresh[c].eqNullSafe(kept[c]) if c in SHARED else fresh[c] == kept[c] for c in ("dataset_id", "series", "resolution", *SHARED)]
    return fresh.join(kept, same, "left_semi")
