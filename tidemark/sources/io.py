"""Reading and writing customer tables, exposures and landing zones (S1-S20). All paths go through Spark's file systems."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from . import keyed

# Separators that are tried, in the order that breaks ties.
SEPARATORS = (",", ";", "\t", "|")


@dataclass
class Parsed:
    df: DataFrame
    detected_format: str
    detected_separator: str | None = None
    warnings: list[str] = field(default_factory=list)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with null for NaN, once on the way in."""
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")})


def detect_separator(spark: SparkSession, path: str, sample: int = 4096) -> str:
    """The candidate that occurs most in the first lines; a comma when none does."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())[:sample]
    best = max(SEPARATORS, key=lambda s: (head.count(s), -SEPARATORS.index(s)))
    return best if head.count(best) else ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema=None) -> DataFrame:
    """Header and types; malformed rows fail."""
    r = spark.read.option("header", True).option("sep", sep or detect_separator(spark, path)).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    return nan_to_null((r.schema(schema) if schema else r.option("inferSchema", True)).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of records, or one a line."""
    return nan_to_null(spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path))


def read_any(spark: SparkSession, path: str) -> Parsed:
    """By extension; unknown ones, and files that can't be parsed, are ValueErrors."""
    ext = re.sub(r".*\.", "", path.rstrip("/").rsplit("/", 1)[-1]).lower()
    try:
        if ext == "csv":
            sep = detect_separator(spark, path)
            return Parsed(_checked(read_csv(spark, path, sep)), "csv", sep)
        if ext == "tsv":
            return Parsed(_checked(read_csv(spark, path, "\t")), "tsv", "\t")
        if ext == "parquet":
            return Parsed(read_parquet(spark, path), "parquet")
        if ext in ("json", "jsonl"):
            return Parsed(_checked(read_json(spark, path, ext == "jsonl")), "json")
    except Exception as e:
        raise ValueError(f"can't read {path}: {str(e)[:300]}") from e
    raise ValueError(f"unsupported format: {ext}")


def _checked(df: DataFrame) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise ValueError("no rows")
    return df


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    """Read, canonical names, flags and categories."""
    df = cleaning.canonical_names(read_any(spark, path).df)
    df = cleaning.yes_no(df, [c for c in ("Churn",) if c in df.columns])
    return df.withColumns({c: cleaning.canonical_category(c) for c in ("InternetService",) if c in df.columns})


def ingest(df: DataFrame, total: str = "Total Charges") -> DataFrame:
    """Total as a number, nulls 0 in all number columns."""
    df = df.withColumn(total, cleaning.to_number(total)) if total in df.columns else df
    return df.fillna(0)


def clean_lake(df: DataFrame) -> DataFrame:
    """The lake's cleaning job: normal names, target, required columns."""
    return cleaning.required_columns(cleaning.coalesce_target(cleaning.normalised_names(df)))


def save_parquet(df: DataFrame, path: str, partition_col: str | None = None, mode: str = "overwrite") -> None:
    """One table, or a partition a date; a date that isn't yyyy-MM-dd is an error."""
    if partition_col is None:
        df.write.mode(mode).parquet(path)
        return
    day = F.to_date(F.col(partition_col).cast("string"), "yyyy-MM-dd")
    df.withColumn(partition_col, day).repartition(partition_col).write.mode(mode).partitionBy(partition_col).parquet(path)


def read_exposures(df: DataFrame) -> DataFrame:
    """Exposures in the order of time, then id."""
    return df.select("id", "customer_id", "ab_group", "event", "ts").orderBy("ts", "id")


def read_jdbc(spark: SparkSession, url: str, dbtable: str, **options) -> DataFrame:
    """The same from a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def read_exposure_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; bad lines are skipped; either spelling of the key."""
    schema = "customer_id string, CustomerID string, ab_group string, event string, ts double"
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("caseSensitive", True).json(path)
    ident = F.coalesce(df["customer_id"], df["CustomerID"])
    return df.select(ident.alias("customer_id"), "ab_group", "event", "ts").where("customer_id is not null")


def append_exposures(df: DataFrame, path: str) -> None:
    """S12."""
    df.withColumn("ts", F.coalesce("ts", F.current_timestamp())).write.mode("append").parquet(path)


def write_landing(df: DataFrame, path: str, dataset_id: str, date, target: str | None = None) -> None:
    """One batch of scored input without target-like columns, under dataset and date."""
    out = cleaning.drop_target_like(df, target).withColumn("dataset_id", F.lit(dataset_id)).withColumn("date", F.lit(date).cast("date"))
    out.write.mode("append").partitionBy("dataset_id", "date").parquet(path)


def read_landing_day(df: DataFrame, date: str, date_col: str = "date") -> DataFrame:
    """One day of the zone; partition pruning does the rest."""
    return df.where(F.col(date_col) == F.lit(date).cast("date"))


def read_landing(spark: SparkSession, path: str, dataset_id: str, date: str) -> DataFrame:
    """Unreadable files are skipped, schemas merged. Only the day's folder is looked into, where it has the plain name."""
    day = f"{path.rstrip('/')}/dataset_id={dataset_id}/date={date}"
    at = [day] if re.fullmatch(r"[\w.-]+", str(dataset_id)) and keyed.exists(spark, day) else [path]
    df = spark.read.option("basePath", path).option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(*at)
    return read_landing_day(df.where(F.col("dataset_id") == dataset_id), date)


def expired_partitions(df: DataFrame, as_of: str, days: int = 30, date_col: str = "date") -> DataFrame:
    """Distinct dates older than the retention; texts that are no dates are left alone."""
    d = F.col(date_col).cast("string").try_cast("date")
    return df.select(d.alias(date_col)).where(d < F.date_sub(F.lit(as_of).cast("date"), days)).distinct()


def drop_expired(spark: SparkSession, path: str, as_of: str | None = None, days: int = 30, date_col: str = "date") -> list[str]:
    """Delete the folders of a zone's date partitions that are older than the retention (before ``as_of``, by
    default today); returns them, one a partition. Files elsewhere and partitions whose value is no date stay."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    day = F.regexp_extract("path", f"/{date_col}=([^/]*)/", 1).try_cast("date")
    limit = F.date_sub(F.lit(as_of).cast("date") if as_of else F.current_date(), days)
    old = files.where(day < limit).select(F.regexp_extract("path", f"^(.*/{date_col}=[^/]*)/", 1).alias("folder")).distinct()
    folders = sorted(r["folder"] for r in old.collect())
    for f in folders:
        keyed.delete(spark, f)
    return folders


def retained(df: DataFrame, as_of: str, days: int = 30, date_col: str = "date") -> DataFrame:
    """The rows that stay."""
    d = F.col(date_col).cast("string").try_cast("date")
    return df.where(d.isNull() | (d >= F.date_sub(F.lit(as_of).cast("date"), days)))


def list_files(spark: SparkSession, prefix: str) -> DataFrame:
    """Path, length and modification time of the files below a prefix."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select("path", "length", "modificationTime")


def files_of(df: DataFrame) -> DataFrame:
    """The files that a table's rows come from, with their rows."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("rows"))


CATALOG_SCHEMA = "id string, name string, file string, separator string, target string, target_type string, status string, id_columns array<string>, rows int"


def catalog(spark: SparkSession, rows: Sequence[tuple], status: str | None = "active") -> DataFrame:
    """The datasets of a status."""
    df = spark.createDataFrame(list(rows), CATALOG_SCHEMA)
    return df.where(F.col("status") == status) if status else df


def read_catalogued(spark: SparkSession, entry, root: str) -> DataFrame:
    """A catalog row drives how its file is read."""
    path = f"{root}/{entry['file']}"
    return read_csv(spark, path, entry["separator"]) if path.endswith(("csv", "tsv")) else read_any(spark, path).df


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """S18."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A JSON report."""
    df.write.mode("overwrite").json(path)


def rewrite_processed(df: DataFrame, score, path: str, name: str = "cpi_score") -> DataFrame:
    """The table with a score column in a new place; the ledger row that points there."""
    df.withColumn(name, score).write.mode("overwrite").parquet(path)
    return df.sparkSession.createDataFrame([(path, name)], "path string, score_column string")


def upload(spark: SparkSession, path: str, to: str, dataset_id: str) -> DataFrame:
    """Land a file as Parquet; the dataset row with its counts (the rows are in the footers of what was written)."""
    parsed = read_any(spark, path)
    parsed.df.write.mode("overwrite").parquet(to)
    rows = spark.read.parquet(to).count()
    return spark.createDataFrame([(dataset_id, to, parsed.detected_format, rows, len(parsed.df.columns))], "dataset_id string, path string, format string, rows long, columns int")
