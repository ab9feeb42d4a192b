"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


_local_folders: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("packsift")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config(SETTING, shared) if shared else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables, named by ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting (tests) gets a folder of its own. On a
    cluster a missing setting is an error: a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a shared folder")
        folder = _local_folders.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="packsift-")
        _local_folders[context.applicationId] = folder
    return folder.rstrip("/")


def _staged_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/packsift/{spark.sparkContext.applicationId}"


def staged_path(spark: SparkSession) -> str:
    """A fresh path for one staged table of this application."""
    return f"{_staged_root(spark)}/{uuid.uuid4().hex}"


_on_drop: list[Callable[[], None]] = []


def on_drop(forget: Callable[[], None]) -> None:
    """Call something when staged tables are deleted."""
    _on_drop.append(forget)


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application, at the end of a job."""
    for forget in _on_drop:
        forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(_staged_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later stages start from files: a lost executor replays one stage at most, plans stay
    small, column pruning still works, and the planner knows the size of the table.
    """
    path = staged_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A table that grows with the corpus: joins with it shuffle both sides and merge.

    A narrow table is small as a file long before its rows are small, so the planner would send
    it through the driver to every executor, once per join. Joins above filters, projections
    and aggregates of the table follow; fixed tables are broadcast by name.
    """
    return df.hint("merge")


def cut_growing(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of a table that grows with the corpus."""
    return growing(cut_lineage(df))
