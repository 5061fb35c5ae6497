"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session should carry. Nothing here depends on the size of the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", app: str = "ledgerlens", **conf: str) -> SparkSession:
    """A session with SETTINGS; keyword names use ``__`` for the dots of a setting."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder, as every executor is this
    machine there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not (sc.master or "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="ledgerlens-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_cut(df: DataFrame) -> DataFrame:
    """``cut`` whose plan forgets how large ``df`` was estimated to be.

    A checkpoint keeps the estimate of its plan, and a join multiplies those of its sides: over
    rounds of joins the driver holds numbers whose digits double again and again.
    """
    done = cut(df)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), df.sparkSession)


_STORED: list[str] = []


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a written table in the shared folder, laid out by the columns ``by``: later reads take only the columns and parts they need.

    It stays until ``discard_stored``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` wrote in this process; what reads them is void after it."""
    jvm = spark.sparkContext._jvm
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
