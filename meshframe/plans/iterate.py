"""Loops of plans: written tables cut lineage, and a count tells when to stop."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one in local mode
    (one machine); a cluster without one is an error, as its machines share no folder."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's setting that deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task may have open at once, so that a table partitioned by a few values
#: is written as its rows come, not sorted first.
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the queries that run here; the session's come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that later stages
    neither repeat its work nor depend on executors that may be lost. Queries that end here
    leave no shuffle files behind: their tables are written, so nothing reads these again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with settings(df.sparkSession, {_CLEANUP: "true"} | ({_OPEN_FILES: "8"} if partition_by else {})):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables once nothing will read them again."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Unfinished(RuntimeError):
    """A loop reached its bound before its end; there is no result."""


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], tuple], rounds: int | None = None) -> DataFrame:
    """Repeats ``step`` until ``measure`` (a few aggregates) no longer changes. With
    ``rounds`` it raises ``Unfinished`` if that takes more of them."""
    state = stored(state)
    mark = measure(state)
    done = 0
    while rounds is None or done < rounds:
        last, state = state, stored(step(state))
        discard(last)
        was, mark = mark, measure(state)
        done += 1
        if was == mark:
            return state
    raise Unfinished(f"no end after {rounds} rounds")
