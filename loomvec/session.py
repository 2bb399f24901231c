"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loomvec.errors import ConfigError


def get_session(app: str = "loomvec", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


#: Bytes of a table from which it is worth dealing to all cores, and bytes a core from which Spark's own splits do.
DEALT_FROM, DEALT_TO = 4 << 20, 16 << 20
_own_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir.

    Where the session names none, one is created if all runs on this machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ConfigError("spark.checkpoint.dir isn't set; it names the folder that all executors share")
        if not _own_dir:
            own = tempfile.mkdtemp(prefix="loomvec-shared-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own_dir.append("file://" + own)
        named = _own_dir[0]
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table to the shared folder and read again: cuts lineage
    and outlives executors. scratch() or remove_stored() removes it."""
    path = f"{shared_dir(df.sparkSession)}/loomvec/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of any file system that Spark knows; nothing where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_stored(spark: SparkSession, since: int = 0) -> None:
    """Removes what stored() has written since; results that still read it can't be computed then."""
    while len(_written) > since:
        remove(spark, _written.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what is stored inside, whose results have been written by then."""
    since = len(_written)
    try:
        yield
    finally:
        remove_stored(spark, since)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables. A file may be one row group, which one task reads: a table of some size
    in fewer files than there are cores is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return rows.repartition(cores) if DEALT_FROM <= size < cores * DEALT_TO else rows
