"""Session settings and the folder that all executors share."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(master)
        .appName("citeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a temporary one, but only on a local master."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(given)
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not the work before it,
    and later reads prune columns. Used where a result is read more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give every worker this package, once a session, however the driver came to import it."""
    if spark.conf.get("citeloom.shipped", None):
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # through the session's file system, so that it can be any that the executors share
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/citeloom-{uuid.uuid4().hex}/citeloom.zip")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(at.toString())
    spark.conf.set("citeloom.shipped", "true")
