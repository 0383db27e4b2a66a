"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "spark.ledgerloom.own.dir"
_RUN = "spark.ledgerloom.scratch.run"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a local session may go without: it then gets a temporary folder, which
    its single machine shares with itself.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get(_OWN_DIR, None) or tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set(_OWN_DIR, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    run = spark.conf.get(_RUN, None)
    return "/".join(filter(None, [shared_dir(spark), "ledgerloom", run, f"{name}-{uuid.uuid4().hex}"]))


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all that the block stores, removed at its end.

    Results must have been written elsewhere or collected by then: what reads
    stored steps fails afterwards. Blocks may be nested; an inner one has a
    folder in the shared folder, too. One block of a session at a time.
    """
    before, run = spark.conf.get(_RUN, None), f"run-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/ledgerloom/{run}"
    spark.conf.set(_RUN, run)
    try:
        yield folder
    finally:
        spark.conf.set(_RUN, before) if before else spark.conf.unset(_RUN)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage: later steps read files that outlive any executor, and
    the work above is done once however often the result is used.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
