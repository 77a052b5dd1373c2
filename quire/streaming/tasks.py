"""The task state machine on a stream: keyed state with a terminal latch.

`transformWithState` needs a state store for each key; here the state of a task
is its latest row, and a cancelled task ignores what follows. Within a batch the
events of a task are applied in order of time and event id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, ts timestamp, event_id long"
OUTPUT = "task_id long, status string, updated_at timestamp, event_id long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, ts, event = state.get if state.exists else (None, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for s, t, e in zip(rows["status"], rows["ts"], rows["event_id"]):
        if status == "cancelled":
            break
        status, ts, event = s, t.to_pydatetime(), int(e)
    state.update((status, ts, event))
    yield pd.DataFrame({"task_id": [key[0]], "status": [status], "updated_at": [ts], "event_id": [event]})


def task_states(log: DataFrame) -> DataFrame:
    """Changes of task states, one row per task and batch that touched it (update mode)."""
    return log.groupBy("task_id").applyInPandasWithState(_advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what is there and return all changes written; each batch once, also after a failure."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
