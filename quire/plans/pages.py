"""Paragraph, marker, audit and table-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import skeleton
from ..operators import documents as D, folds, paragraphs as P
from ..sources.tables import SPANS_SQL, boxes, spans, table


def paragraph_breaks(spark, d):
    """The two decisions of every line."""
    return P.boundaries(spans(spark, d), F.lit(18.0), 60.0, 480.0).select("book", "page_num", "line_idx", "break_if_open", "break_if_closed")


BREAKS_SQL = (
    f"WITH {SPANS_SQL}"
    + r""", b AS (SELECT *, round_even(font_size * 2, 0) / 2 AS size, regexp_replace(text, '^\s+|\s+$', '', 'g') AS clean FROM spans WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
p AS (SELECT *, lag(clean) OVER w AS pc, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(size) OVER w AS ps FROM b WINDOW w AS (PARTITION BY book, page_num ORDER BY y0, x0, line_idx)),
e AS (SELECT *, abs(y0 - py0) < 4 AND x0 >= px0 AS same, regexp_matches(pc, '[。！？；!?;][”’"''）\)\]】」』]*$') AS term, regexp_matches(pc, '[，、：:,]$') AS clause, px1 < 480.0 - greatest(20.0, ps * 2) AS short,
  round(x0 - 60.0, 2) >= greatest(10.0, size * 1.4::DOUBLE) AS ind, round((y0 - py0) / 18.0::DOUBLE, 3) >= 1.45::DOUBLE OR y0 - py1 >= ps * 0.9::DOUBLE AS gap FROM p),
f AS (SELECT *, length(pc) <= 30 AND NOT term AND NOT clause AND short AND NOT regexp_matches(pc, '[的了在和与]$') AND (abs(ps - size) >= 1.5 OR gap OR regexp_matches(pc, '^(第|一|二|三|四|1|2|3|附录)')) AS alone FROM e)
SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, coalesce(NOT same AND alone AND ((ind AND (term OR short OR gap)) OR (short AND term)), false) AS break_if_open,
  coalesce(NOT same AND (alone OR (ind AND (term OR short OR gap)) OR gap OR (short AND term)), false) AS break_if_closed FROM f"""
)


def paragraphs(spark, d):
    out = P.paragraphs(spans(spark, d), F.lit(18.0), 60.0, 480.0)
    return out.select("book", "page_num", "para", "first_line", "n_lines", F.sha2("text", 256).alias("digest"))


#: The driver's texts have few markers, so a beginning brings all families into play.
PLANTED = "甲①乙¹²[3]丙〔14〕。a，"


def markers(spark, d):
    """Markers of the planted beginning, whatever text follows it, if any."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit(PLANTED), F.coalesce(F.expr("substring(text, 1, 40)"), F.lit(""))).alias("text"))
    return D.detect_markers(t, "doc_id").filter(F.col("end") <= len(PLANTED)).select("doc_id", "marker", "number", "start", "end", "family")


def markers_whole(spark, d):
    """Markers of documents' whole texts."""
    return D.detect_markers(table(spark, d, "documents"), "doc_id")


MARKERS_SQL = """SELECT doc_id, m.marker, CAST(m.number AS BIGINT) AS number, CAST(m.s AS INTEGER) AS start, CAST(m.e AS INTEGER) AS "end", m.family FROM documents,
(VALUES ('①', 1, 1, 2, 'circled_number'), ('¹²', 12, 3, 5, 'superscript'), ('[3]', 3, 5, 8, 'square_bracket'), ('〔14〕', 14, 9, 13, 'chinese_bracket'), ('a', 1, 14, 15, 'alpha_callout')) AS m(marker, number, s, e, family)"""


def conservation(spark, d):
    """Audit of documents' first characters against a copy with a letter dropped, added or replaced."""
    raw = F.concat(F.lit("x"), skeleton(F.expr("substring(text, 1, 80)")))
    k = F.col("doc_id") % 4
    out = F.when(k == 0, raw).when(k == 1, F.substring(raw, 2, 200)).when(k == 2, F.concat(raw, F.lit("乙"))).otherwise(F.concat(F.lit("甲"), F.substring(raw, 2, 200)))
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw"), out.alias("processed"))
    return D.audited(rows, "doc_id").select("doc_id", "status", F.array_join("dropped", "|").alias("dropped"), F.array_join("added", "|").alias("added"), F.array_join("replaced", "|").alias("replaced"))


CONSERVATION_SQL = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'RED' ELSE 'YELLOW' END AS status, CASE WHEN doc_id % 4 = 1 THEN 'x' ELSE '' END AS dropped, CASE WHEN doc_id % 4 = 2 THEN '乙' ELSE '' END AS added, CASE WHEN doc_id % 4 = 3 THEN 'x -> 甲' ELSE '' END AS replaced FROM documents"


def grid(spark, d):
    """Boxes of a page as a table: rows by bands around their mean, four columns, numbers of the boxes in each cell."""
    rows = folds.gathered(boxes(spark, d).withColumn("yc", (F.col("y0") + F.col("y1")) / 2), ["page_id"], ["yc", "x0", "seq", "score", "x1", "y1"], [])
    flat = rows.select("page_id", F.explode(F.arrays_zip("items", folds.mean_bands(F.col("items"), lambda x: x["yc"], 40.0).alias("row"))).alias("z"))
    cells = flat.select("page_id", "z.row", F.floor(F.col("z.items.x0") / 100).cast("int").alias("col"), "z.items.seq", "z.items.x0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq"))), lambda x: x["seq"].cast("string")), " ")
    return cells.groupBy("page_id", "row").pivot("col", [0, 1, 2, 3]).agg(text).select("page_id", "row", *(F.coalesce(F.col(str(i)), F.lit("")).alias(f"c{i}") for i in range(4)))


QUERIES = {
    "seq_boundary_evidence": (paragraph_breaks, BREAKS_SQL),
    "seq_paragraphs": (paragraphs, None),
    "scl_detect_markers": (markers, MARKERS_SQL),
    "scl_detect_markers_whole": (markers_whole, None),
    "win_conservation_diff": (conservation, CONSERVATION_SQL),
    "win_pivot_grid": (grid, None),
}
