"""Where intermediate tables go, and how a table is cut from its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.udf import bounded_batches


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one.  Only a local
    session, a test, gets a folder of its own; elsewhere the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("spark.quarry.scratch", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.quarry.scratch", own)
    return own


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/quarry-{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is
    read, and carries no partitioning, so a later join exchanges both sides and
    the skew-join rule can split a hot key.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named by their place, for Arrow functions, which don't take names with dots; its batches are bounded."""
    bounded_batches(df.sparkSession)
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Remove the files behind a table that ``materialize`` returned."""
    files = df.inputFiles()
    for folder in {f.rsplit("/", 1)[0] for f in files if "/quarry-" in f}:
        drop_path(df.sparkSession, folder)
