"""Reading raw tables, renaming, sinks and catalog tables.

Schemas are always explicit (never inferred); raw CSV is read PERMISSIVE
with a corrupt-record column so one bad line does not fail a 100 TB job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.types import FloatType
from pyspark.sql.types import StructField
from pyspark.sql.types import StructType
from pyspark.sql.types import StringType

from panelcraft.session import materialise

CORRUPT = "_corrupt_record"


def read_parquet_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The driver's parquet tables: ``{base}/{name}.parquet``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType,
    columns: list[str] | None = None,
    fmt: str = "csv",
    date_format: str | None = None,
    keep_corrupt: bool = False,
    nan_as_null: bool = True,
) -> DataFrame:
    """Read with an explicit schema and keep the named columns.

    For CSV, DATE/TIMESTAMP fields in ``schema`` are parsed by the reader
    (``date_format`` if given); unparseable lines land in ``_corrupt_record``.
    Floating NaN is turned into NULL (``nan_as_null``), see :func:`nan_to_null`.
    """
    if fmt == "csv":
        full = StructType([*schema.fields, StructField(CORRUPT, StringType(), True)])
        reader = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        if date_format:
            reader = reader.option("dateFormat", date_format)
        df = reader.csv(path)
        if not keep_corrupt:
            df = df.drop(CORRUPT)
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    df = df.select(*columns) if columns else df
    return nan_to_null(df) if nan_as_null else df


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Floating NaN -> NULL at ingestion, so ``avg`` skips it (NaN would poison it) and
    comparisons behave (``NaN >= x`` is true in Spark)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    targets = [c for c in (cols or floats) if c in floats]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in targets}) if targets else df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Raw header -> short name (headers with dots/brackets are handled by the API)."""
    return df.withColumnsRenamed(mapping)


def skip_extra_header(df: DataFrame, header: dict[str, str]) -> DataFrame:
    """S3: drop data rows that repeat a known header line (``{column: header text}``)."""
    same = None
    for c, text in header.items():
        cond = F.col(c).cast("string") == F.lit(text)
        same = cond if same is None else same & cond
    return df.where(~F.coalesce(same, F.lit(False)))


def write_features(df: DataFrame, path: str, split_col: str | None = "split", fmt: str = "parquet") -> None:
    """Write the feature table, partitioned by split (overwrites only the partitions written)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if split_col:
        w = w.partitionBy(split_col)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Materialise an intermediate stage as parquet and read it back (cuts lineage)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def register_table(
    df: DataFrame,
    name: str,
    namespace: str,
    replace: bool = True,
    partitions: int | None = None,
    location: str | None = None,
) -> str:
    """Save as a catalog table ``namespace.name`` (replace when asked).

    ``location`` puts the namespace and table files under a given (shared)
    folder instead of the warehouse directory.
    """
    spark = df.sparkSession
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`{loc}")
    out = df.repartition(partitions) if partitions else df
    full = f"`{namespace}`.`{name}`"
    w = out.write.mode("overwrite" if replace else "errorifexists").format("parquet")
    if location:
        w = w.option("path", f"{location.rstrip('/')}/{name}")
    w.saveAsTable(full)
    return full


def read_registered(spark: SparkSession, name: str, namespace: str) -> DataFrame:
    """Read a registered table."""
    return spark.table(f"`{namespace}`.`{name}`")


def export_headerless(df: DataFrame, path: str, cols: list[str], single_file: bool = False) -> None:
    """``cols`` as CSV without header; one file only on request."""
    out = df.select(*cols)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", False).csv(path)


def read_with_quarantine(
    spark: SparkSession, path: str, schema: StructType, date_format: str | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(typed rows, quarantine)`` of CSV files: every line is in one of the two.

    A line that doesn't fit ``schema`` (a value of another type, too few or too many
    fields) goes to the quarantine with its text, file and reason. The files are parsed once.
    """
    full = StructType([*schema.fields, StructField(CORRUPT, StringType(), True)])
    reader = spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    parsed = materialise(reader.csv(path).withColumn("_file", F.col("_metadata.file_path")), "parsed")
    good = nan_to_null(parsed.where(F.col(CORRUPT).isNull()).select(*schema.names))
    fields = F.size(F.split(CORRUPT, ","))
    reason = F.when(fields < len(schema), "too few fields").when(fields > len(schema), "too many fields").otherwise("unreadable value")
    bad = parsed.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.col("_file").alias("file"), reason.alias("reason"))
    return good, bad


def replace_table(
    df: DataFrame, name: str, namespace: str, location: str, *, bucket_by: list[str], buckets: int, sort_by: list[str] | None = None
) -> str:
    """Replace a bucketed table as a whole: readers see the old version or the new one, never a mixture.

    The new version is written to a folder of its own; then the table's location is
    changed to it, which is one change in the catalog. The folder before it stays, for
    readers that have begun (:func:`drop_versions` removes what isn't current). A
    table keeps its columns and buckets; others raise ``ValueError``.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    full, stage = f"`{namespace}`.`{name}`", f"`{namespace}`.`{name}_{version}`"
    folder = f"{location.rstrip('/')}/{name}/{version}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}` LOCATION '{location}'")
    order = sort_by or bucket_by
    out = df.repartition(buckets, *bucket_by)  # as the buckets are dealt: one file a bucket
    layout = f"CLUSTERED BY ({', '.join(bucket_by)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    properties = f"TBLPROPERTIES ('panelcraft.layout' = '{layout}')"
    if spark.catalog.tableExists(f"{namespace}.{name}"):
        current = spark.table(full)
        held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {full}").collect()}.get("panelcraft.layout")
        if [(f.name, f.dataType) for f in current.schema] != [(f.name, f.dataType) for f in df.schema] or held != layout:
            raise ValueError(f"{full}: other columns or buckets than the table has")
    out.write.format("parquet").bucketBy(buckets, *bucket_by).sortBy(*order).option("path", folder).saveAsTable(stage)
    spark.sql(f"DROP TABLE {stage}")  # an external table: its files stay
    if spark.catalog.tableExists(f"{namespace}.{name}"):
        spark.sql(f"ALTER TABLE {full} SET LOCATION '{folder}'")
    else:
        spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet {layout} {properties} LOCATION '{folder}'")
    return full


def drop_versions(spark: SparkSession, name: str, namespace: str) -> int:
    """Delete the folders of a replaced table's former versions; returns how many. Call when no reader uses them."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{namespace}`.`{name}`").collect()
    current = next(r.data_type for r in rows if r.col_name == "Location")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(current)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    former = [s.getPath() for s in fs.listStatus(at.getParent()) if s.getPath().getName() != at.getName()]
    return sum(bool(fs.delete(p, True)) for p in former)
