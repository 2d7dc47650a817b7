"""The work queue as events: begun work, done subjects, cleared batches; in batch and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events: space_id, work_id, kind (begin, done, clear), subjects array<string> (begin), subject_id (done), ord.
EVENT = "space_id string, work_id string, kind string, subjects array<string>, subject_id string, ord long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; torn and unreadable lines are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files as they come."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def pending(events: DataFrame) -> DataFrame:
    """(space_id, work_id, subject_id, ord, pos): subjects begun and neither done nor in a cleared batch, in order of submission.

    A done counts whatever the order of events; the last begin of a work id stands.
    """
    last = Window.partitionBy("space_id", "work_id").orderBy(F.desc("ord"))
    begun = events.filter("kind = 'begin'").withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("space_id", "work_id", "ord", F.posexplode("subjects").alias("pos", "subject_id"))
    done = events.filter("kind = 'done'").select("space_id", "work_id", "subject_id").distinct()
    cleared = events.filter("kind = 'clear'").select("space_id", "work_id").distinct()
    return begun.join(done, ["space_id", "work_id", "subject_id"], "left_anti").join(cleared, ["space_id", "work_id"], "left_anti").select("space_id", "work_id", "subject_id", "ord", "pos")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    subjects, done, cleared = state.get if state.exists else ([], [], False)
    subjects, done = list(subjects), set(done)
    for b in batches:
        for r in b.sort_values("ord").itertuples():
            if r.kind == "begin":
                subjects = list(r.subjects)
            elif r.kind == "done":
                done.add(r.subject_id)
            elif r.kind == "clear":
                cleared = True
    state.update((subjects, sorted(done), cleared))
    left = [] if cleared else [s for s in subjects if s not in done]
    yield pd.DataFrame({"space_id": [key[0]], "work_id": [key[1]], "pending": [left]})


def pending_stream(events: DataFrame) -> DataFrame:
    """(space_id, work_id, pending): of a stream of events, the pending subjects of each work id that an event touched (update mode)."""
    return events.groupBy("space_id", "work_id").applyInPandasWithState(
        _step, "space_id string, work_id string, pending array<string>", "subjects array<string>, done array<string>, cleared boolean", "update", GroupStateTimeout.NoTimeout
    )


def drain(events: DataFrame, apply, checkpoint: str):
    """Runs apply(batch DataFrame of pending_stream, batch id) on what has arrived, then stops."""
    return pending_stream(events).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
