"""Prediction table: Parquet partitioned by category and a hash bucket of the symbol.

Writes replace symbols, deletes remove them; both touch only the buckets they concern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.schema import PREDICTION_COLUMNS
from tickwright.session import materialize

BUCKETS = 64


def prediction_frame(df: DataFrame) -> DataFrame:
    """The fixed 12-column order with defaults for missing columns, after the keys."""
    cols = [F.col("symbol"), F.col("category")]
    for name, kind, default in PREDICTION_COLUMNS:
        value = F.col(name) if name in df.columns else F.lit(default)
        cols.append(value.cast(kind).alias(name))
    return df.select(*cols)


def _bucket():
    return F.pmod(F.xxhash64(F.col("symbol").cast("string")), F.lit(BUCKETS)).cast("int")


def _folders(df: DataFrame) -> list[tuple[str, int]]:
    """Partitions that rows belong to; at most categories times ``BUCKETS``."""
    return [(r["category"], r["bucket"]) for r in df.select("category", _bucket().alias("bucket")).distinct().collect()]


def _filesystem(spark: SparkSession, path: str):
    """(Hadoop file system of a path, path class): the only way to every store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The whole table with its bucket column; None before the first write and after the last delete."""
    fs, Path = _filesystem(spark, path)
    status = fs.globStatus(Path(f"{path}/category=*/bucket=*"))
    return spark.read.parquet(path) if status and len(status) else None


def _rewrite(spark: SparkSession, path: str, folders: list[tuple[str, int]], rows: DataFrame) -> None:
    """``rows`` become the whole content of the given partitions; partitions left empty go.

    The rows are stored in the shared folder first, so no job reads what it overwrites.
    """
    rows = materialize(rows, "predictions")
    kept = set(_folders(rows))
    if kept:
        out = rows.withColumn("bucket", _bucket())
        out.write.partitionBy("category", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    fs, Path = _filesystem(spark, path)
    for category, bucket in set(folders) - kept:
        fs.delete(Path(f"{path}/category={category}/bucket={bucket}"), True)


def _touched(old: DataFrame | None, folders: list[tuple[str, int]]) -> DataFrame | None:
    if old is None or not folders:
        return None
    keys = old.sparkSession.createDataFrame(folders, "category string, bucket int")
    return old.join(F.broadcast(keys), ["category", "bucket"], "left_semi")


def write_predictions(df: DataFrame, path: str) -> None:
    """Replaces the rows of every (category, symbol) in ``df``; all other symbols stay.

    Only the buckets of those symbols are read and written.
    """
    spark = df.sparkSession
    new = materialize(prediction_frame(df), "predictions")
    folders = _folders(new)
    old = _touched(stored(spark, path), folders)
    rows = new
    if old is not None:
        keep = old.join(new.select("category", "symbol").distinct(), ["category", "symbol"], "left_anti")
        rows = new.unionByName(keep.select(*new.columns))
    _rewrite(spark, path, folders, rows)


def read_predictions(spark: SparkSession, path: str, symbol=None, category: str | None = None) -> DataFrame:
    """Predictions of one symbol and category; both filters reach the scan."""
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(str(symbol))), F.lit(BUCKETS))) & (F.col("symbol") == symbol))
    if category is not None:
        df = df.where(F.col("category") == category)
    return df.drop("bucket")


def replace_predictions_by_horizon(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``old`` whose (category, symbol, horizon) is not in ``new``, plus ``new``."""
    keys = new.select("category", "symbol", "horizon").distinct()
    kept = old.join(keys, ["category", "symbol", "horizon"], "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def delete_predictions(old: DataFrame, symbols: DataFrame) -> DataFrame:
    """``old`` without the symbols listed; absent symbols are no error."""
    return old.join(symbols.select("symbol").distinct(), "symbol", "left_anti").select(*old.columns)


def delete_stored_predictions(spark: SparkSession, path: str, symbols: DataFrame) -> None:
    """Removes the listed symbols from a stored table, with the folders that they leave empty."""
    old = stored(spark, path)
    if old is None:
        return
    gone = symbols.select("symbol").distinct()
    folders = _folders(old.join(gone, "symbol", "left_semi"))
    if folders:
        _rewrite(spark, path, folders, delete_predictions(_touched(old, folders).drop("bucket"), gone))
