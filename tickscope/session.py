"""Session helpers: time zone, checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup table is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
# A table that is not measured is broadcast only when its files are this small.
PLANNED_BYTES = 256 << 10


def prepare_session(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC throughout, and joins are broadcast by measured sizes.

    The planner takes the size of compressed files for that of a table, and names of millions of items fit into a few MB of
    files. So its own choice is kept to small files. The adaptive planner, which counts the bytes of a shuffle as
    they are in memory, has the session's limit.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit > PLANNED_BYTES:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(limit))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(PLANNED_BYTES))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared checkpoint folder of the cluster, or a scratch one on a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="tickscope-")
        context.setCheckpointDir(configured)


_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``stored`` writes inside the block when it ends.

    For work that has written its results by then, such as a micro-batch. A query that returns a lazy DataFrame
    still reads its tables; those stay with the checkpoint folder of the application.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _scratch.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    For a computed table that is used more than once: it is computed in one job, survives lost
    executors, and its size is known to the optimizer.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has no more than ``rows`` rows and about ``size`` bytes.

    One aggregate with a partial row per task. Texts and nested values count with their length as text, other
    values with 8 bytes.
    """
    def width(name: str, kind: str):
        if kind == "string":
            return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
        return F.lit(8)

    bytes_of = sum((width(*c) for c in df.dtypes), F.lit(0).cast("bigint"))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(bytes_of), F.lit(0)).alias("b")).first()
    return found.n <= rows and found.b <= size
