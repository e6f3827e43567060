"""Shared helpers of the training-data operators: shared-folder tables and graph components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode, where one process does all, an own one if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessella/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a DataFrame over those files (lineage ends here)."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``write_table`` returned."""
    path = getattr(df, "_tessella_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more (it acts on the driver's garbage collection)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph, as rows (node, component) where component is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set no longer changes; each step is a
    grouped minimum (combined on the map side) and an equi-join that adaptive execution can split, so
    a hub of any degree stays distributed. Every round is written to the shared folder. Nodes without
    edges, self loops and edges with a null end don't appear in the result, which is a written table.
    """
    now = write_table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v AND isnotnull(u) AND isnotnull(v)").distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen or mark.n == 0:
            break
        seen = (mark.n, mark.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, write_table(small.distinct(), "edges")
        drop_table(before)
    parts = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out = write_table(parts, "components")
    drop_table(now)
    return out
