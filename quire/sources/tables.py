"""Driver tables, and the positioned-text tables derived from them.

The derivations have exact arithmetic: coordinates are small integers or halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAGE_WIDTH, PAGE_HEIGHT = 595.0, 2200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per text line: a document is a page of the book named by its source."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("line_idx")
    lines = docs.select(
        F.col("source").alias("book"), (F.col("doc_id") + 1).alias("page_num"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text")
    )
    x0 = F.lit(60.0) + F.when(i == 0, 21.0).otherwise(0.0)
    y0 = F.lit(72.0) + 18.0 * i + 9.0 * F.floor(i / 5)
    return lines.withColumns(
        {
            "x0": x0,
            "y0": y0,
            "x1": x0 + 7.0 * F.least(F.length("text"), F.lit(60)),
            "y1": y0 + 12.0,
            "font_family": F.when(i == 0, "SimHei").when(i % 11 == 10, "KaiTi").otherwise("SimSun"),
            "font_size": F.when(i == 0, 14.0).when(i % 7 == 6, 9.0).otherwise(10.5),
            "font_flags": F.when(i == 0, 16).otherwise(0),
        }
    )


SPANS_SQL = """
l AS (SELECT source AS book, doc_id + 1 AS page_num, i - 1 AS line_idx, ls[i] AS text
      FROM (SELECT source, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))),
spans AS (SELECT *, x0 + 7.0::DOUBLE * least(length(text), 60) AS x1, y0 + 12.0::DOUBLE AS y1 FROM (SELECT *,
        60.0::DOUBLE + CASE WHEN line_idx = 0 THEN 21.0::DOUBLE ELSE 0.0::DOUBLE END AS x0,
        72.0::DOUBLE + 18.0::DOUBLE * line_idx + 9.0::DOUBLE * (line_idx // 5) AS y0,
        CASE WHEN line_idx = 0 THEN 'SimHei' WHEN line_idx % 11 = 10 THEN 'KaiTi' ELSE 'SimSun' END AS font_family,
        CASE WHEN line_idx = 0 THEN 14.0::DOUBLE WHEN line_idx % 7 = 6 THEN 9.0::DOUBLE ELSE 10.5::DOUBLE END AS font_size,
        CASE WHEN line_idx = 0 THEN 16 ELSE 0 END AS font_flags FROM l))
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored box per lineitem row; a page is an order. box_id numbers a page's boxes by falling score."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_orderkey").alias("page_id"),
        (F.col("l_partkey") % 400).cast("double").alias("x0"),
        (F.col("l_suppkey") % 600).cast("double").alias("y0"),
        F.col("l_discount").cast("double").alias("score"),
        (F.col("l_linenumber") % 2).cast("int").alias("class_id"),
        F.col("l_linenumber").cast("long").alias("seq"),
        (10 + 7 * F.col("l_linenumber")).cast("double").alias("w"),
        (8 + F.col("l_partkey") % 13).cast("double").alias("h"),
    )
    return base.select("page_id", "seq", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "score", "class_id")


BOXES_SQL = """
boxes AS (SELECT page_id, seq, x0, y0, x0 + w AS x1, y0 + h AS y1, score, class_id FROM (SELECT l_orderkey AS page_id, CAST(l_partkey % 400 AS DOUBLE) AS x0,
        CAST(l_suppkey % 600 AS DOUBLE) AS y0, CAST(l_discount AS DOUBLE) AS score, CAST(l_linenumber % 2 AS INTEGER) AS class_id, CAST(l_linenumber AS BIGINT) AS seq,
        CAST(10 + 7 * l_linenumber AS DOUBLE) AS w, CAST(8 + l_partkey % 13 AS DOUBLE) AS h FROM lineitem))
"""


def sections_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements h1, h2, h3 and p of pages, in order: page_id, pos, level (0: paragraph), text (markup removed)."""
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r"<(h[1-3]|p)>([^<]*)"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "m"))
    level = F.when(F.substring("m", 2, 1) == "h", F.substring("m", 3, 1).cast("int")).otherwise(0)
    return rows.select("page_id", "pos", level.alias("level"), F.trim(F.regexp_replace("m", "^<[^>]*>", "")).alias("text")).filter("text <> ''")


SECTIONS_SQL = r"""
el AS (SELECT page_id, i - 1 AS pos, m[i] AS m FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(h[1-3]|p)>([^<]*)') AS m FROM pages))),
sections AS (SELECT * FROM (SELECT page_id, pos, CASE WHEN substr(m, 2, 1) = 'h' THEN CAST(substr(m, 3, 1) AS INTEGER) ELSE 0 END AS level,
        trim(regexp_replace(m, '^<[^>]*>', '')) AS text FROM el) WHERE text <> '')
"""


#: A purchase starts a task anew, but one in a hundred cancels it.
STATUS = {"signup": "queued", "view": "running", "click": "completed", "error": "failed", "purchase": "running"}


def task_status():
    known = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 101 == 0), "cancelled").otherwise(F.element_at(known, F.col("event_type")))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a task log: a user is a task, an event a change of its status."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("task_id"), "ts", "event_id", task_status().alias("status"), "value", F.col("props").alias("payload"))


TASKS_SQL = """
tasks AS (SELECT user_id AS task_id, ts, event_id, CASE WHEN event_type = 'purchase' AND event_id % 101 = 0 THEN 'cancelled' ELSE CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
        WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'running' END END AS status, value, props AS payload FROM events)
"""
