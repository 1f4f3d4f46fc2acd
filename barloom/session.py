"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "barloom") -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own session to the operators."""
    cpus = str(cores)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


# The JVM never compiles a method above this many bytes of bytecode. Wide feature stages exceed it
# when fused into one; below the limit Spark splits them instead, which halves their run time.
JIT_LIMIT = "8000"


def prepare(spark: SparkSession) -> SparkSession:
    """Bar edges are UTC instants, so the session has to read zone-less event times as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for local masters that name none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/barloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Used where a plan forks and would otherwise compute its input twice. Being Parquet, each
    branch still reads only its own columns, and a lost executor costs no recomputation.
    """
    path = new_path(df.sparkSession, label)
    plain = {"parquet.enable.dictionary": "false"}  # numbers hardly repeat; names do
    plain |= {f"parquet.enable.dictionary#{c}": "true" for c, t in df.dtypes if t == "string"}
    df.write.options(**plain).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
