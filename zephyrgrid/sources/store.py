"""Feature cache, result files, prediction store and submission tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid.sources.catalog import SourceError, list_files

RESULT_COLUMNS = {"group", "model_name", "nmae", "ficr"}


class FeatureCache:
    """Feature tables by split and group, rebuilt as one unit and read with partition pruning.

    Every build writes its rows to a folder of its own and then a manifest: one row for each table, those without rows too.
    The manifest's success mark is the last thing written, so a build that broke off is never seen, and readers of an
    older version are not disturbed.
    """

    MANIFEST = "split string, group string, n_rows bigint, path string"

    def __init__(self, spark: SparkSession, root: str, groups: list[str], splits=("train", "test")):
        self.spark, self.root = spark, root.rstrip("/")
        self.groups, self.splits = groups, splits

    def versions(self) -> list[int]:
        """Finished builds, the oldest first."""
        marks = list_files(self.spark, f"{self.root}/manifest-*/_SUCCESS")
        return sorted(int(m.rsplit("/", 2)[1].removeprefix("manifest-")) for m in marks)

    def manifest(self) -> DataFrame | None:
        """(split, group, n_rows, path) of the newest build."""
        found = self.versions()
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/manifest-{found[-1]}") if found else None

    def is_complete(self) -> bool:
        manifest = self.manifest()
        if manifest is None:
            return False
        listed = {(r["split"], r["group"]) for r in manifest.collect()}  # one row per table
        return listed >= {(s, g) for s in self.splits for g in self.groups}

    def build(self, make, force: bool = False) -> bool:
        """``make()`` returns all rows with ``split`` and ``group``; True if it was run."""
        if self.is_complete() and not force:
            return False
        found = self.versions()
        version = found[-1] + 1 if found else 1
        path = f"{self.root}/data-{version}-{uuid.uuid4().hex[:8]}"
        rows = make().filter(F.col("group").isin(*self.groups) & F.col("split").isin(*self.splits))
        # no repartition by folder: one folder may hold most of the rows and would be one task
        rows.write.partitionBy("split", "group").parquet(path)
        written = self.spark.read.schema(rows.schema).parquet(path).groupBy("split", "group").agg(F.count(F.lit(1)).alias("n"))
        every = self.spark.createDataFrame([(s, g) for s in self.splits for g in self.groups], "split string, group string")
        listed = every.join(written, ["split", "group"], "left").select(
            "split", "group", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"), F.lit(path).alias("path"))
        rows.drop("split", "group").limit(0).write.parquet(f"{path}-schema")
        # another build of the same version is an error, not a mixture
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest-{version}")
        return True

    def load(self, group: str | None = None, split: str | None = None) -> DataFrame:
        manifest = self.manifest()
        if manifest is None:
            raise SourceError(f"no feature cache at {self.root}")
        path = manifest.first()["path"]
        # a build without any rows has no files to tell its columns
        fields = self.spark.read.parquet(f"{path}-schema").schema.fields
        schema = T.StructType([*fields, T.StructField("split", T.StringType()), T.StructField("group", T.StringType())])
        df = self.spark.read.schema(schema).parquet(path)
        if split is not None:
            df = df.filter(F.col("split") == split)
        return df if group is None else df.filter(F.col("group") == group)


# declared columns of result files; a file may hold any of them in any order
RESULT_TYPES = {"group": "string", "model_name": "string", "model_version": "string", "feature_version": "string", "n_features": "bigint",
                "best_epoch": "double", "nmae": "double", "ficr": "double", "score": "double", "mae": "double", "rmse": "double"}
MOST_CELLS = 64


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Union of result files by column name; files without the needed columns are skipped.

    All files are read in one scan, each as a whole: a result file holds a row per group and model. The first line
    of a file names its cells, the declared columns are picked by name and cast; others are ignored.
    """
    if not list_files(spark, pattern):
        raise SourceError(f"no result files match {pattern}")
    files = spark.read.text(pattern, wholetext=True).select(
        F.regexp_replace("value", "^\ufeff", "").alias("_text"),
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^/.]+(?:/part-[^/]*)?$", 1).alias("baseline"))
    cells = F.from_csv(F.col("_line"), ", ".join(f"c{i} string" for i in range(MOST_CELLS)), {"ignoreLeadingWhiteSpace": "true"})
    array = lambda c: F.array(*[F.col(f"{c}.c{i}") for i in range(MOST_CELLS)])
    lines = files.select("baseline", F.split("_text", r"\r?\n").alias("_lines")).select(
        "baseline", F.col("_lines")[0].alias("_head"), F.explode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("_line"))
    rows = lines.filter(F.trim("_line") != "").withColumn("_row", cells).withColumn("_line", F.col("_head")).withColumn("_names", cells)
    named = rows.select("baseline", array("_names").alias("_names"), array("_row").alias("_cells"))
    whole = F.forall(F.array(*[F.lit(c) for c in sorted(RESULT_COLUMNS)]), lambda c: F.array_contains("_names", c))
    place = lambda c: F.array_position("_names", c)
    pick = lambda c: F.when(place(c) > 0, F.col("_cells")[(place(c) - 1).cast("int")])
    found = named.filter(whole).select("baseline", *[pick(c).try_cast(k).alias(c) for c, k in RESULT_TYPES.items()])
    if found.isEmpty():
        raise SourceError(f"no result files match {pattern}")
    return with_model_id(found)


def with_model_id(df: DataFrame) -> DataFrame:
    return df.withColumn("model_id", F.concat_ws("/", "baseline", "model_name"))


def write_results(df: DataFrame, path: str, kind: str = "csv") -> str:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def append_predictions(df: DataFrame, root: str) -> None:
    """Add (group, model_name, ts, pred, actual) rows to the long prediction table."""
    df.write.mode("append").partitionBy("group", "model_name").parquet(root)


def align_submission(sample: DataFrame, predictions: DataFrame, ts: str, targets: list[str],
                     key: str = "forecast_id") -> DataFrame:
    """Predictions in the rows and columns of the sample; a missing stamp stays null."""
    frame = sample.select(*[c for c in sample.columns if c not in targets])
    return frame.join(predictions.select(ts, *targets), ts, "left").select(*sample.columns).orderBy(key)


def dummy_labels(df: DataFrame, ts: str, targets: list[str], out: str = "kst_dtm") -> DataFrame:
    """Zero targets for every stamp, so that test rows take the same path as train rows."""
    return df.select(F.col(ts).alias(out)).distinct().withColumns({t: F.lit(0.0) for t in targets})
