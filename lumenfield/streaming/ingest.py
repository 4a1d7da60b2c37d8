"""Files that arrive in a folder, merged into a box as they come: a stream with the state of each exposure.

The stream keeps, for each basename, the file of each of its stages and how often it has changed. A batch emits the changes that
its own files make, as one folder of rows (``v=N``) of the change log, so that it costs its own rows however large the box is; the box
is the last change of each exposure's stage. The state and the files taken are in the checkpoint: a stream that is started again
goes on where it stood, and a batch that runs again writes its folder again.

Defined results: of a stage's files in one batch the last by modification time, then by path, stands; a file that does not follow the
naming scheme is an exposure by its whole name; a batch without files writes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import names

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
CHANGES = "basename string, stage string, filepath string, length long, change long, replaced string, n_stages int"
STATE = "stages array<string>, filepaths array<string>, changes long"


def changes(rows: DataFrame) -> DataFrame:
    """Changes of a stream of files (basename, stage, filepath, length, modificationTime): change is the exposure's count of changes,
    replaced the file that the stage had before, n_stages how many stages the exposure now has."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stages, n = (dict(zip(*state.get[:2])), state.get[2]) if state.exists else ({}, 0)
        latest: dict = {}
        for pdf in batches:
            for r in pdf.itertuples():
                mark = (r.modificationTime, r.filepath)
                if r.stage not in latest or mark > latest[r.stage][0]:
                    latest[r.stage] = (mark, r.length)
        out = []
        for stage, ((_, path), length) in sorted(latest.items()):
            if stages.get(stage) != path:
                n += 1
                before, stages[stage] = stages.get(stage), path
                out.append((key[0], stage, path, length, n, before, len(stages)))
        state.update((list(stages), list(stages.values()), n))
        yield pd.DataFrame(out, columns=["basename", "stage", "filepath", "length", "change", "replaced", "n_stages"])

    return rows.groupBy("basename").applyInPandasWithState(update, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, stage: str, wildcard: str = "*.fits") -> StreamingQuery:
    """Starts a stream over the folder that takes each file once and adds its changes to the log ``table``; it ends when all files are taken."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", wildcard).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(names.basename(name).alias("basename"), F.lit(stage).alias("stage"), F.col("path").alias("filepath"), "length", "modificationTime")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v={epoch}")

    return changes(rows).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The box of a change log: the last change of each exposure's stage."""
    log = spark.read.schema(CHANGES + ", v long").option("basePath", table).parquet(table)
    last = F.max_by(F.struct("filepath", "length", "change"), "change").alias("_v")
    return log.groupBy("basename", "stage").agg(last).select("basename", "stage", "_v.filepath", "_v.length", "_v.change")
