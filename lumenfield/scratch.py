"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_CLEANING: weakref.WeakKeyDictionary[SparkSession, list] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread of the session is inside, and as it was before once the last one has left."""
    with _LOCK:
        held = _CLEANING.setdefault(spark, [0, spark.conf.get(CLEANUP, "false")])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(CLEANUP, held[1])
                _CLEANING.pop(spark, None)


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset and all tasks run in the driver's process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lumenfield-"))
    return base


def written(df: DataFrame, name: str = "table", spent: Iterable[DataFrame] = (), plain: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a file read and not a recomputation, and gives the
    planner the real size of the table: joins with it are broadcast only under Spark's own size check. The shuffle files
    behind it go once it is written, and so do the ``spent`` tables, which nothing may read any more.

    Numbers in order compress to a hundredth or less, and a table that is small on disk but not in memory would be broadcast through the driver and
    read by one task. With ``plain`` values are stored as they are, so that the size of the files is that of the rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        options = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {"compression": "zstd"}
        df.select("*").write.options(**options).parquet(path)  # a plan made under the setting
    discard(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


#: Rows of a table that one task takes, where the number of tasks is to follow the rows.
ROWS = 16_384


def spread(rows: int, keys: list[str], *sides: DataFrame) -> tuple[DataFrame, ...]:
    """``sides`` of a join on ``keys`` dealt to as many tasks as ``rows`` ask for, so that no task's share grows with the input."""
    tasks = -(-rows // ROWS)
    return sides if tasks < 2 else tuple(side.repartition(tasks, *keys) for side in sides)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``written`` returned; nothing may read them any more."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            folder = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
