"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "12g", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    # Workers of a local session find the package wherever they are started; on a cluster it is installed, or sent with --py-files.
    root = str(Path(__file__).resolve().parents[1])
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus)} | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return the copy that reads it.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session may leave it
    unset: it gets a folder of its own, removed at the end. On a cluster that is an error, as no folder of
    the driver's machine could be read by the executors.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files under the checkpoint folder, which all executors can read."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can read")
            named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as there are tasks at a time, or more.

    Groups that cost much CPU for few bytes would otherwise be merged into one task by size.
    """
    context = df.sparkSession.sparkContext
    wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * context.defaultParallelism)
    return df.repartition(wanted, *keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of parquet tables."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
