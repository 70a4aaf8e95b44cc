"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_written: list[str] = []


def local_session(app: str = "siftgraph", cores: str = "8", memory: str = "16g") -> SparkSession:
    """A local session with the settings the operators are written for (tests, bench)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own; on a cluster a folder that
    one machine alone can see would lose data with that machine, so it is refused.
    """
    global _own_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="spark-siftgraph-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session; results not yet written are lost.

    Returns how many were deleted. On a cluster call it once a run's results are stored.
    """
    n = len(_written)
    _delete(spark, list(_written))
    return n


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Shuffle files of queries run inside end with the query, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str = "stage", after: Sequence[DataFrame] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Survives the loss of executors, stops loops from growing their plans, is columnar, and
    gives the planner true sizes, so a small result is broadcast only when its files are small.
    Tables of earlier cuts in ``after``, which nothing else may read any more, are deleted then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.append(path)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftgraph_path = path
    discard(spark, after)
    return out


def cut_alone(make: Callable[[], DataFrame], name: str = "stage", after: Sequence[DataFrame] = ()) -> DataFrame:
    """``cut`` of what ``make`` returns; all other tables cut meanwhile are deleted, so ``make`` must
    keep none of them for later."""
    begun = len(_written)
    df = make()
    meanwhile = _written[begun:]
    out = cut(df, name, after)
    _delete(df.sparkSession, meanwhile)
    return out


def discard(spark: SparkSession, tables: Sequence[DataFrame]) -> None:
    """Delete tables that ``cut`` returned; others are left alone."""
    _delete(spark, [p for p in (vars(x).get("_siftgraph_path") for x in tables) if p])


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for written in paths:
        path(written).getFileSystem(conf).delete(path(written), True)
        if written in _written:
            _written.remove(written)
