"""Task-state queries, batch and streaming, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import tasks as K
from ..sources.tables import TASKS_SQL, table, task_status, tasks

W = f"WITH {TASKS_SQL}"
STATE = (
    W
    + """, c AS (SELECT task_id, min((ts, event_id)) AS stop FROM tasks WHERE status = 'cancelled' GROUP BY task_id),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.task_id ORDER BY ts DESC, event_id DESC) AS k FROM tasks t LEFT JOIN c USING (task_id) WHERE stop IS NULL OR (ts, event_id) <= stop),
state AS (SELECT r.task_id, status, f.created_at, ts AS updated_at, event_id, value FROM r JOIN (SELECT task_id, min(ts) AS created_at FROM tasks GROUP BY task_id) f USING (task_id) WHERE k = 1)"""
)
AGE = 86_400


def _clock(spark, d):
    return tasks(spark, d).agg(F.max("ts").alias("now"))


def latest(spark, d):
    return K.state(tasks(spark, d))


def recovered(spark, d):
    return K.recovered(K.state(tasks(spark, d))).select("task_id", "status")


def topk(spark, d):
    return K.newest(K.state(tasks(spark, d)), 50, "completed").select("task_id", "status", "created_at")


def by_user(spark, d):
    """The newest task event of each kind for each user."""
    log = tasks(spark, d)
    return log.groupBy("task_id", "status").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def unexpired(spark, d):
    # One row of one column: the clock.
    state = K.state(tasks(spark, d)).join(F.broadcast(_clock(spark, d)))
    return K.unexpired(state, F.col("now"), AGE).select("task_id", "status", "updated_at")


def cancelled(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id")).filter("task_id % 3 = 0")
    return K.cancelled(K.state(tasks(spark, d)), asked).select("task_id", "status")


def enqueued(spark, d):
    log = tasks(spark, d).select("task_id", "ts", "event_id", "status")
    return K.enqueued(log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1 and status = 'queued'"))


def feed(spark, d):
    return K.feed(tasks(spark, d)).select("task_id", "number", "event_id", "status")


def queues(spark, d):
    """Queues of 20 events of subscribers to single tasks, and of two who hear all."""
    log = tasks(spark, d)
    own = log.select("task_id").distinct().filter("task_id % 2 = 0").select(F.col("task_id").alias("subscriber"), "task_id")
    every = spark.range(2).select((-F.col("id") - 1).alias("subscriber"), F.lit(None).cast(dict(own.dtypes)["task_id"]).alias("task_id"))
    return K.subscriber_queues(log, own.unionByName(every), 20)


def janitor(spark, d):
    """Files (events) older than a day that are neither protected by kind nor in use by a running task."""
    files = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    active = K.state(tasks(spark, d)).filter("status in ('queued', 'running')").select(F.col("task_id").alias("user_id"))
    old = files.join(F.broadcast(_clock(spark, d))).filter((F.col("event_type") != "signup") & (F.col("ts") < F.col("now") - F.make_dt_interval(secs=F.lit(AGE))))
    return old.join(active, "user_id", "left_anti").select("event_id")


def audit(spark, d):
    """Events by kind with the share of those that carry a value: an audit summary."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"), F.countDistinct("user_id").alias("n_users"))


def stream(spark, d):
    """The state machine on the events as a file stream, state by state; its last changes are the batch result's."""
    from ..streaming.tasks import run_to_end, task_states

    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    log = events.select(F.col("user_id").alias("task_id"), task_status().alias("status"), "ts", "event_id")
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quire-stream-")
    at = f"{base.rstrip('/')}/quire/tasks-{uuid.uuid4().hex}"
    changes = run_to_end(spark, task_states(log), f"{at}/changes", f"{at}/checkpoint")
    return changes.groupBy("task_id").agg(F.max_by(F.struct("status", "event_id"), F.struct("updated_at", "event_id")).alias("s")).select("task_id", "s.status", "s.event_id")


QUERIES = {
    "str_enqueue": (enqueued, W + " SELECT task_id, ts, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS r FROM tasks WHERE event_id % 2 = 0 OR status = 'queued') WHERE r = 1"),
    "str_event_feed": (feed, W + ", f AS (SELECT *, row_number() OVER w AS number, min(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN (ts, event_id) END) OVER (PARTITION BY task_id) AS stop FROM tasks WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)) SELECT task_id, CAST(number AS INTEGER) AS number, event_id, status FROM f WHERE stop IS NULL OR (ts, event_id) <= stop"),
    "str_subscriber_queues": (queues, W + ", o AS (SELECT task_id AS subscriber, event_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS r FROM tasks WHERE task_id % 2 = 0) WHERE r <= 20), e AS (SELECT event_id FROM tasks ORDER BY ts DESC, event_id DESC LIMIT 20) SELECT * FROM o UNION ALL SELECT s, event_id FROM e, (VALUES (-1), (-2)) AS v(s)"),
    "str_task_state": (latest, STATE + " SELECT * FROM state"),
    "str_recover": (recovered, STATE + " SELECT task_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM state"),
    "win_list_tasks": (topk, STATE + " SELECT task_id, status, created_at FROM state WHERE status = 'completed' ORDER BY created_at DESC, task_id LIMIT 50"),
    "win_latest_by_key": (by_user, W + " SELECT task_id, status, arg_max(event_id, (ts, event_id)) AS event_id FROM tasks GROUP BY task_id, status"),
    "str_ttl": (unexpired, STATE + " SELECT task_id, status, updated_at FROM state WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND updated_at < (SELECT max(ts) FROM tasks) - INTERVAL 1 DAY)"),
    "str_cancel": (cancelled, STATE + " SELECT task_id, CASE WHEN status IN ('queued', 'running') AND task_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'cancelled' ELSE status END AS status FROM state"),
    "join_janitor": (janitor, STATE + " SELECT event_id FROM events WHERE event_type <> 'signup' AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND user_id NOT IN (SELECT task_id FROM state WHERE status IN ('queued', 'running'))"),
    "snk_audit_report": (audit, "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_large, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type"),
    "str_task_stream": (stream, STATE + " SELECT task_id, status, event_id FROM state"),
}
