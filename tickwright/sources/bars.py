"""CSV bar reader.

Bar files differ in header case, column order and optional columns. One pass over the lines finds
each file's header; files with the same header are then one native CSV scan, which obeys quotes.
Symbol, category and tier come from the path (``<tier>/<category>/individual_files/<symbol>.csv``),
from Hive-style folders, or, for files that hold many symbols, from columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.functions.scalar import bar_date
from tickwright.operators.tiers import pick_per_key
from tickwright.schema import BAR_COLUMNS, BAR_SCHEMA, COLUMN_VARIANTS

PATH_PATTERN = r"([^/]+)/([^/]+)/individual_files/([^/]+)\.csv"
HEADER_WORD = r"(^|,)\"?close\"?(,|$)"


def _from_path(path: Column, group: int, hive_key: str) -> Column:
    hive = F.regexp_extract(path, hive_key + r"=([^/]+)", 1)
    plain = F.regexp_extract(path, PATH_PATTERN, group)
    return F.coalesce(F.nullif(hive, F.lit("")), F.nullif(plain, F.lit("")))


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by header line; as many entries reach the driver as it lists files anyway.

    A cell that runs over several lines would shift rows, so a file with one is an error.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    head = F.when(F.lower("value").rlike(HEADER_WORD), F.col("at"))
    files = lines.groupBy("file").agg(F.min_by("value", head).alias("header"), F.max(quotes % 2).alias("open"))
    out: dict[str, list[str]] = {}
    for r in files.where("header IS NOT NULL").collect():
        if r["open"]:
            raise ValueError(f"{r['file']} has a quoted cell over several lines")
        out.setdefault(r["header"], []).append(r["file"])
    return out


def read_bars(spark: SparkSession, path: str, data_source: str | None = "historical") -> DataFrame:
    """All bar files below ``path``, one row per (tier, category, symbol, date).

    Files without a required column are left out. Of rows that repeat a day the last one counts,
    by file time and place in the file. Thousands separators in quoted numbers are dropped.
    """
    variants = {k.lower(): v for k, v in COLUMN_VARIANTS.items()}
    parts = None
    for header, files in sorted(_headers(spark, path).items()):
        names = [n.strip().strip('"').strip().lower() for n in header.split(",")]
        names = [variants.get(n, n) for n in names]
        if not set(BAR_COLUMNS) <= set(names):
            continue
        raw = (
            spark.read.schema(", ".join(f"_c{i} string" for i in range(len(names))))
            .option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .option("recursiveFileLookup", True)
            .csv(files)
        )

        def cell(name: str) -> Column:
            return F.nullif(F.trim(f"_c{names.index(name)}"), F.lit("")) if name in names else F.lit(None).cast("string")

        fields = []
        for f in BAR_SCHEMA.fields:
            value = bar_date(cell(f.name)) if f.name == "date" else F.translate(cell(f.name), ",", "").try_cast(f.dataType)
            fields.append(value.alias(f.name))
        file = F.col("_metadata.file_path")
        rows = raw.select(
            F.coalesce(cell("symbol"), _from_path(file, 3, "symbol")).alias("symbol"),
            F.coalesce(cell("category"), _from_path(file, 2, "category")).alias("category"),
            F.coalesce(cell("tier"), _from_path(file, 1, "tier")).alias("tier"),
            *fields,
            F.lit(data_source).alias("data_source"),
            F.struct(F.col("_metadata.file_modification_time"), file, F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("_at"),
        )
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR_SCHEMA.fields)
        return spark.createDataFrame([], f"symbol string, category string, tier string, {kinds}, data_source string")
    # rows without a readable date are no repeats of each other
    parts = parts.withColumn("_undated", F.when(F.col("date").isNull(), F.col("_at")))
    keys = ["tier", "category", "symbol", "date", "_undated"]
    return pick_per_key(parts, keys, F.col("_at"), "last").drop("_at", "_undated")


def read_latest_bars(spark: SparkSession, root: str) -> DataFrame:
    """Bars of the ``latest`` tier below ``root`` (only that folder is listed)."""
    return read_bars(spark, f"{root.rstrip('/')}/*latest", "latest")


def write_bars(df: DataFrame, path: str) -> None:
    """CSV export by tier and category; symbols stay a column to keep files few and large."""
    df.write.partitionBy("tier", "category").mode("overwrite").option("header", True).csv(path)
