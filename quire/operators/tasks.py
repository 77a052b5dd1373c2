"""Task log to task state: the batch forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TERMINAL = ("completed", "failed", "cancelled")


def state(log: DataFrame) -> DataFrame:
    """Latest state of each task; from its first cancellation on a task does not change any more."""
    order = F.struct("ts", "event_id")
    cancelled = F.when(F.col("status") == "cancelled", order)
    row = F.struct("status", "ts", "event_id", "value")
    ends = log.groupBy("task_id").agg(F.max_by(row, order).alias("last"), F.min_by(row, cancelled).alias("stop"), F.min("ts").alias("created_at"))
    now = F.coalesce("stop", "last")
    return ends.select("task_id", now["status"].alias("status"), "created_at", now["ts"].alias("updated_at"), now["event_id"].alias("event_id"), now["value"].alias("value"))


def recovered(tasks: DataFrame) -> DataFrame:
    """After a restart: what was queued or running has failed."""
    return tasks.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def unexpired(tasks: DataFrame, now, max_age_seconds: int) -> DataFrame:
    """Without finished tasks that changed longer ago than the age (a task of just that age stays)."""
    old = F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return tasks.filter(~(F.col("status").isin(*TERMINAL) & old))


def cancelled(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested tasks that are queued or running are cancelled; others stay as they are."""
    asked = tasks.join(requests.select("task_id").distinct().withColumn("_asked", F.lit(True)), "task_id", "left")
    hit = F.col("_asked").isNotNull() & F.col("status").isin("queued", "running")
    return asked.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_asked")


def newest(tasks: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    rows = tasks if status is None else tasks.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "task_id").limit(limit)


def enqueued(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks with new ones put in: of one task_id the newest by (ts, event_id) counts, whether stored or new."""
    rows = stored.unionByName(new)
    whole = F.struct(*rows.columns)
    return rows.groupBy("task_id").agg(F.max_by(whole, F.struct("ts", "event_id")).alias("r")).select("r.*")


def feed(log: DataFrame) -> DataFrame:
    """What a reader of a task's events gets: number and event, up to the first that ends the task."""
    w = Window.partitionBy("task_id").orderBy("ts", "event_id")
    ended = F.max(F.col("status").isin(*TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumns({"number": F.row_number().over(w), "_ended": F.coalesce(ended, F.lit(0))})
    return rows.filter("_ended = 0").drop("_ended")


def subscriber_queues(log: DataFrame, subscribers: DataFrame, size: int = 100) -> DataFrame:
    """(subscriber, event_id) of what is in each subscriber's queue: its task's newest events, `size` at most; a subscriber without a task_id hears all tasks.

    Older events give way to newer ones, as that is what a queue of a size does.
    """
    newest = Window.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("event_id"))
    one = log.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= size).select("task_id", "event_id")
    every = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(size).select("event_id")
    own = subscribers.filter("task_id is not null").join(one, "task_id").select("subscriber", "event_id")
    # `size` rows at most, for each of those who hear all.
    return own.unionByName(subscribers.filter("task_id is null").select("subscriber").join(F.broadcast(every)))
