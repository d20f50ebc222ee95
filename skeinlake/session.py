"""Session defaults and small helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Settings the results depend on: UTC rendering and filter pushdown into Python data sources.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build_session(app: str = "skeinlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; cluster submissions leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**REQUIRED, "spark.sql.adaptive.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **conf}.items():
        builder = builder.config(k, v)
    return ensure_session(builder.getOrCreate())


def ensure_session(spark: SparkSession) -> SparkSession:
    """Applies the settings that results depend on to a session somebody else made."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return ensure_session(spark).read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local session without one gets a temporary folder, which
    goes with the process; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    made = tempfile.mkdtemp(prefix="skeinlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder that all executors share and reads it back from there. Spark removes a checkpoint
    with its last reference where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def data_root(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer than half as many partitions.

    For operators that spend long on each row. What moves is less than a core's scan partitions; wider tables stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df
