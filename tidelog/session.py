"""Session helpers: reading tables, and cutting lineage into a folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_written: list[str] = []
_own: list[str] = []
_at_exit: list[bool] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made, but only for a local master: on a cluster a
    machine-local folder would not survive the loss of its machine, so that is an error.
    """
    given = spark.conf.get(CHECKPOINT_CONF, None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if _own:
        return _own[0]
    folder = tempfile.mkdtemp(prefix="tidelog-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _own.append(f"file://{folder}")
    spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if not _at_exit:
        _at_exit.append(True)
        atexit.register(_clear_at_exit)
    return path


def _clear_at_exit() -> None:
    """What a process wrote to the shared folder goes with it, as long as there is a session to delete with."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # the session is gone: the folder is the cluster's to clean, as its checkpoints are
        pass


def clear(spark: SparkSession) -> int:
    """Deletes the tables this process wrote to the shared folder; how many there were.

    A result is read from these tables when an action runs on it, so they cannot go before; they go at the end of the
    process, or here in between, after which DataFrames made before can no longer be read. See also scratch().
    """
    n = 0
    while _written:
        n += int(_delete(spark, _written.pop()))
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to the shared folder within it: for results that are used up inside."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _delete(spark, _written.pop())


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This is a columnar reliable checkpoint: the result has no lineage, is read with column pruning, and
    survives the loss of any executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
