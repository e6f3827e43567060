"""Sources and sinks: tables, text and JSON files, and the writers the pipelines need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table under ``root``, with only ``columns`` if given."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


_own: dict[str, str] = {}


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder all executors share, ``spark.checkpoint.dir``; in local mode, where one process does all, in an own one if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="tessella-work-")
    return f"{named.rstrip('/')}/tessella/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: computed once, and lineage ends there."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``written`` returned, once nothing reads it any more."""
    if path := getattr(df, "_tessella_path", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per JSON file (or array element) with the file it came from; the schema is given, not inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def text_documents(spark: SparkSession, path: str, min_chars: int = 20) -> DataFrame:
    """Whole text files of at least ``min_chars`` characters: (file, text)."""
    rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("file", F.input_file_name())
    return rows.where(F.length(F.trim("text")) >= min_chars).select("file", "text")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists as rows (expr, wording, pos): keys in lower case, keys that start with _ left out."""
    rows = spark.read.text(path, wholetext=True)
    entries = rows.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("expr", "wordings"))
    entries = entries.where(~F.col("expr").startswith("_")).withColumn("expr", F.lower("expr"))
    return entries.select("expr", F.posexplode("wordings").alias("pos", "wording"))


def write_csv(df: DataFrame, path: str) -> None:
    """A report for spreadsheets: semicolons and a header."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_requests(df: DataFrame, path: str) -> None:
    """Request lines, one JSON object each, a folder per batch."""
    df.write.mode("overwrite").partitionBy("batch").json(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the values of ``by`` that ``df`` holds (a section refresh)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def reload(df: DataFrame, path: str, protected: dict[str, str]) -> dict[str, tuple[int, int]]:
    """Full overwrite of ``path``; fails if the row count of any protected table changes meanwhile. Returns the counts before and after."""
    spark = df.sparkSession
    before = {n: spark.read.parquet(p).count() for n, p in protected.items()}
    df.write.mode("overwrite").parquet(path)
    after = {n: spark.read.parquet(p).count() for n, p in protected.items()}
    for n in protected:
        if after[n] != before[n]:
            raise RuntimeError(f"protected table {n} changed: {before[n]} rows before, {after[n]} after")
    return {n: (before[n], after[n]) for n in protected}
