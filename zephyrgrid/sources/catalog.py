"""Named sources: registry, scans, existence checks and date profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A column counts as temporal when its name holds one of these.
TEMPORAL_MARKS = ["date", "time", "일시", "시간"]


class SourceError(ValueError):
    """A source is missing, unreadable or of an unsupported kind."""


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in name order."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(f.getPath().toString() for f in (found or []))


def file_versions(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of the files behind the paths: what is kept of them is stale once these change."""
    out = []
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        for f in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             encoding: str = "UTF-8") -> DataFrame:
    """CSV (plain or gzip) with a header; a byte-order mark does not end up in a name.

    Declare a schema for large files: inference reads the data twice.
    """
    reader = spark.read.option("header", True).option("encoding", encoding)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).option("preferDate", False).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿"))


def scan_any(spark: SparkSession, data, schema: T.StructType | None = None,
             encoding: str = "UTF-8") -> DataFrame:
    """A DataFrame as it is, or a .csv, .gz or .parquet path."""
    if isinstance(data, DataFrame):
        return data
    path = str(data)
    if not path.lower().endswith((".csv", ".gz", ".parquet")):
        raise SourceError(f"unsupported source: {path}")
    if not path_exists(spark, path):
        raise SourceError(f"no such source: {path}")
    try:
        if path.lower().endswith(".parquet"):
            return spark.read.parquet(path)
        return read_csv(spark, path, schema, encoding)
    except Exception as broken:
        raise SourceError(f"unreadable source: {path}") from broken


class Catalog:
    """Logical names over paths; a scan is planned once per name."""

    def __init__(self, spark: SparkSession, paths: dict[str, str],
                 schemas: dict[str, T.StructType] | None = None):
        self.spark, self.paths, self.schemas = spark, dict(paths), schemas or {}
        self._loaded: dict[str, DataFrame] = {}

    def load(self, name: str, force: bool = False) -> DataFrame:
        if name not in self.paths:
            raise SourceError(f"unknown table: {name}; known: {sorted(self.paths)}")
        if force or name not in self._loaded:
            self._loaded[name] = scan_any(self.spark, self.paths[name], self.schemas.get(name))
        return self._loaded[name]

    __getitem__ = load

    def load_all(self, force: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """All readable tables, and the reason for each that is not."""
        tables, failures = {}, {}
        for name in self.paths:
            try:
                tables[name] = self.load(name, force)
            except SourceError as reason:
                failures[name] = str(reason)
        return tables, failures

    def check_paths(self) -> dict[str, bool]:
        return {name: path_exists(self.spark, path) for name, path in self.paths.items()}

    def register_views(self, prefix: str = "") -> list[str]:
        """Make every readable table available to SQL by its logical name."""
        tables, _ = self.load_all()
        for name, df in tables.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in tables]

    def summarize(self, name: str) -> DataFrame:
        return date_profile(self.load(name))


def temporal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(mark in c.lower() for mark in TEMPORAL_MARKS)]


def date_profile(df: DataFrame) -> DataFrame:
    """(column, first, last) of every column whose name looks temporal, in one pass."""
    names = temporal_columns(df)
    if not names:
        raise SourceError("no column name looks temporal")

    def stamp(c: str):
        if isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            return F.col(c).cast("timestamp_ntz")
        return F.col(c).cast("string").try_cast("timestamp_ntz")
    ends = df.agg(*[F.struct(F.min(stamp(c)).alias("first"), F.max(stamp(c)).alias("last")).alias(c) for c in names])
    return ends.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.first").alias("first"), F.col(f"`{c}`.last").alias("last"))
        for c in names])))
