"""Typography, furniture, heading, section, rule and table queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import joins as J, layout as L, sections as S
from ..sources.tables import SECTIONS_SQL, SPANS_SQL, sections_html, spans, table

W, H = f"WITH {SPANS_SQL}", f"WITH {SECTIONS_SQL}"
PAGE = ["book", "page_num"]


def router(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page_num"), "text")
    return L.router(docs)


def recurring(spark, d):
    """Running headers: texts that recur as the first lines of a book's pages."""
    return L.recurring_edges(spans(spark, d), F.col("line_idx") == 0, "y1")


def recurring_bottom(spark, d):
    rows = spans(spark, d)
    last = rows.groupBy(*PAGE).agg(F.max("line_idx").alias("line_idx"))
    return L.recurring_edges(rows.join(last.withColumn("is_last", F.lit(True)), [*PAGE, "line_idx"], "left"), F.col("is_last"), "y0")


def _recurring_sql(edge, at):
    return (
        W
        + rf""", e AS (SELECT *, regexp_replace(regexp_replace(lower(text), '[\s　]+', '', 'g'), '[\d\-_·*•—\s]+$', '') AS norm, line_idx = max(line_idx) OVER (PARTITION BY book, page_num) AS is_last FROM spans),
n AS (SELECT book, count(DISTINCT page_num) AS n FROM spans GROUP BY book),
p AS (SELECT book, norm, page_num, min({at}) AS place FROM e WHERE {edge} AND length(norm) >= 2 GROUP BY book, norm, page_num),
f AS (SELECT book, norm, count(*) AS pages, median(place) AS median_at FROM p GROUP BY book, norm)
SELECT book, norm, pages, median_at FROM f JOIN n USING (book) WHERE pages >= greatest(2, least(3, ceil(n * 0.05)))"""
    )


def modes(spark, d):
    return L.modes(spans(spark, d), PAGE)


LEN = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
MODES_SQL = (
    W
    + f""", r AS (SELECT *, {LEN} AS n, round_even(font_size * 2, 0) / 2 AS size FROM spans WHERE {LEN} > 0),
f AS (SELECT book, page_num, font_family, sum(n) AS c, min(line_idx) AS p FROM r GROUP BY ALL), s AS (SELECT book, page_num, size, sum(n) AS c, min(line_idx) AS p FROM r GROUP BY ALL)
SELECT book, page_num, (SELECT font_family FROM f WHERE f.book = r.book AND f.page_num = r.page_num ORDER BY c DESC, p LIMIT 1) AS dominant_font,
  (SELECT size FROM s WHERE s.book = r.book AND s.page_num = r.page_num ORDER BY c DESC, p LIMIT 1) AS dominant_size,
  sum(CASE WHEN font_flags & 16 <> 0 OR font_family LIKE '%Hei%' THEN n ELSE 0 END)::DOUBLE / sum(n) AS bold_ratio FROM r GROUP BY book, page_num"""
)


def dominant(spark, d):
    return L.dominant_font_and_size(spans(spark, d), PAGE)


def pitch(spark, d):
    return L.line_pitch(spans(spark, d), PAGE)


def baseline(spark, d):
    return L.baseline(spans(spark, d))


BASELINE_SQL = (
    W
    + r""", t AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, floor(font_size * 4 + 0.5) / 4 AS q FROM spans),
p AS (SELECT *, length(x) AS n FROM t WHERE length(x) > 10 AND NOT regexp_matches(x, '(?i)^(?:表|图|圖|Table|Figure)\s*\d+(?:[\-.]\d+)*(?:[.、:：\s]|$)') AND NOT regexp_matches(x, '^第[一二三四五六七八九十百\d]+[章卷篇]')),
z AS (SELECT book, q, count(*) OVER (PARTITION BY book) AS k, row_number() OVER (PARTITION BY book ORDER BY q DESC) AS r FROM (SELECT DISTINCT book, q FROM p)),
c AS (SELECT p.* FROM p JOIN z ON z.book = p.book AND z.q = p.q WHERE k < 4 OR r > greatest(1, ceil(k / 10))),
f AS (SELECT book, font_family, sum(n) AS s FROM c GROUP BY ALL), g AS (SELECT book, arg_min(font_family, (-s, font_family)) AS body_font, CAST(sum(s) AS BIGINT) AS clean_chars FROM f GROUP BY book),
y AS (SELECT c.book, q, sum(n) AS s FROM c JOIN g ON g.book = c.book AND g.body_font = c.font_family GROUP BY ALL)
SELECT book, body_font, clean_chars, body_size FROM g JOIN (SELECT book, arg_min(q, (-s, -q)) AS body_size FROM y GROUP BY book) USING (book) WHERE clean_chars >= 50"""
)


def census(spark, d):
    return L.font_census(spans(spark, d), 400.0)


def duplicates(spark, d):
    """Spans that repeat place and text left out, the first kept."""
    rows = spans(spark, d).withColumns({"x0": F.round("x0", 1), "y0": F.floor(F.col("y0") / 200)})
    w = Window.partitionBy("book", "page_num", "x0", "y0", "text").orderBy("line_idx")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1 and text <> ''").select("book", "page_num", "line_idx", "text")


def heading_roles(spark, d):
    """The heading gate on lines with evidence groups from size, weight and font."""
    rows = spans(spark, d).withColumn("text", F.when(F.col("line_idx") % 5 == 0, F.concat("text", F.lit("。"))).when(F.col("line_idx") % 5 == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    n, score = L.heading_score({
        "spatial": (F.col("line_idx") % 2 == 0, 0.45), "typographic": (F.col("font_size") >= 10.5, 0.35), "lexical": (F.col("page_num") % 3 == 0, 0.35),
    })
    lexical = F.when(F.col("page_num") % 3 == 0, F.when(F.col("line_idx") % 3 == 0, "chapter").when(F.col("line_idx") % 3 == 1, "section").otherwise("subsection"))
    status = F.when(F.col("line_idx") % 4 == 0, "verified_single_line").when(F.col("line_idx") % 4 == 3, "unavailable").otherwise("verified_multiline")
    out = rows.withColumns({"n": n, "score": score, "lexical": lexical, "status": status})
    g = L.heading_gate(F.col("text"), F.col("n"), F.col("score"), F.col("lexical"), F.col("status"))
    return out.select(*PAGE, "line_idx", g.alias("g")).select(*PAGE, "line_idx", "g.*")


ROLES_SQL = (
    W
    + r""", r AS (SELECT *, CASE line_idx % 5 WHEN 0 THEN text || '。' WHEN 1 THEN text || '?' ELSE text END AS t,
  CAST(line_idx % 2 = 0 AS INT) + CAST(font_size >= 10.5 AS INT) + CAST(page_num % 3 = 0 AS INT) AS n,
  least(1.0::DOUBLE, 0.0::DOUBLE + CASE WHEN line_idx % 2 = 0 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN font_size >= 10.5 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN page_num % 3 = 0 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END) AS score,
  CASE WHEN page_num % 3 = 0 THEN CASE line_idx % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'section' ELSE 'subsection' END ELSE '' END AS lex,
  CASE line_idx % 4 WHEN 0 THEN 's' WHEN 3 THEN 'u' ELSE 'm' END AS st FROM spans),
q AS (SELECT *, regexp_matches(t, '。\s*$') AS per, regexp_matches(t, '[?？]\s*$') AND lex <> 'chapter' AS que, CASE lex WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 WHEN 'subsection' THEN 3 ELSE CASE WHEN score >= 0.85 THEN 1 WHEN score >= 0.70 THEN 2 ELSE 3 END END AS lv FROM r),
k AS (SELECT *, CASE WHEN per AND st = 'u' THEN 'unv' WHEN per AND st = 'm' AND n = 0 THEN 'prose' WHEN per THEN 'veto' WHEN que AND st = 'm' THEN 'prose' WHEN que THEN 'que' WHEN n >= 2 AND score >= 0.65 THEN 'head'
  WHEN n >= 2 THEN 'low' WHEN n = 1 AND score >= 0.35 THEN 'one' WHEN st = 'u' THEN 'unv' WHEN st = 'm' THEN 'prose' ELSE 'single' END AS c FROM q)
SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN c = 'head' THEN 'heading_candidate' WHEN c IN ('que', 'low', 'one') THEN 'uncertain' ELSE 'body' END AS role, CASE WHEN c = 'head' THEN lv END AS level,
 CASE c WHEN 'head' THEN CASE WHEN lv = 1 THEN 0.90::DOUBLE ELSE 0.80::DOUBLE END WHEN 'unv' THEN 0.60::DOUBLE WHEN 'single' THEN 0.60::DOUBLE WHEN 'que' THEN 0.35::DOUBLE WHEN 'low' THEN 0.40::DOUBLE WHEN 'one' THEN 0.40::DOUBLE ELSE 0.85::DOUBLE END AS confidence,
 CASE c WHEN 'head' THEN 'heading: level_' || lv || '_candidate' WHEN 'unv' THEN 'body: unverified_lines_single_line_fallback' WHEN 'prose' THEN 'body: multiline_prose_flow' WHEN 'veto' THEN 'body: heading_vetoed_by_period'
  WHEN 'que' THEN 'uncertain: standalone_question_without_prefix' WHEN 'low' THEN 'uncertain: heading_insufficient_score' WHEN 'one' THEN 'uncertain: heading_single_group_quarantine' ELSE 'body: unstyled_single_line' END AS evidence FROM k"""
)

HEADS = ("第三章 总论", "1.2 方法", "3.4.5 细节", "Chapter 4 Begin", "目录", "二、背景与意义", "第二节 问题", "plain text")


def regex_levels(spark, d):
    """Levels by wording of lines after a heading's beginning; every other page has the beginning alone."""
    pick = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("line_idx") % len(HEADS) + 1).cast("int"))
    text = F.concat(pick, F.when(F.col("page_num") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "text")))
    return spans(spark, d).select(*PAGE, "line_idx", L.regex_heading_level(text).alias("level"))


def _plain(pattern):
    """A pattern for SQL, without the flag of Unicode classes, which means another thing there."""
    return "'" + pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"


LEVELS_SQL = (
    W
    + rf""", r AS (SELECT *, list_extract([{', '.join(f"'{x}'" for x in HEADS)}], CAST(line_idx % {len(HEADS)} + 1 AS BIGINT)) || CASE WHEN page_num % 2 = 0 THEN '' ELSE ' ' || text END AS t FROM spans)
SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN regexp_matches(t, {_plain(L.PART_HEADING)}) THEN 1 WHEN regexp_matches(t, {_plain(L.CHAPTER_HEADING)}) OR regexp_matches(t, {_plain(L.SECTION_HEADING)}) THEN 2
 WHEN regexp_matches(t, {_plain(L.SENTENCE)}) THEN 0 WHEN regexp_matches(t, {_plain(L.TRIPLE_DECIMAL)}) THEN 3 WHEN regexp_matches(t, {_plain(L.DECIMAL)}) THEN 2 WHEN regexp_matches(t, {_plain(L.ENUMERATED)}) THEN 3
 WHEN regexp_matches(t, {_plain(L.PARENTHESISED)}) AND length(regexp_replace(t, '[①-⑳\s]', '', 'g')) BETWEEN 2 AND 30 THEN 3 ELSE 0 END AS level FROM r"""
)


def folio(spark, d):
    """Page numbers at the foot: every book's pages carry their rank, some books' are broken."""
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), (F.col("doc_id") + 1).alias("page_num"))
    broken = (F.col("book").endswith("3") & (F.col("page_num") % 97 == 0)).cast("int")
    return L.folio_sequence(docs.filter("page_num % 3 <> 0").withColumn("value", F.floor(F.col("page_num") / 2) - 40 * broken).withColumn("page_num", F.col("page_num")))


FOLIO_SQL = """
WITH n AS (SELECT source AS book, doc_id + 1 AS page_num FROM documents WHERE (doc_id + 1) % 3 <> 0), v AS (SELECT *, page_num // 2 - 40 * CASE WHEN book LIKE '%3' AND page_num % 97 = 0 THEN 1 ELSE 0 END AS value FROM n),
s AS (SELECT *, lead(value) OVER w - value AS dv, lead(page_num) OVER w - page_num AS dp FROM v WINDOW w AS (PARTITION BY book ORDER BY page_num))
SELECT book, count(*) AS pages, CASE WHEN count(*) < 2 THEN 'isolated' WHEN coalesce(bool_and(dv >= 1 AND dv <= dp), true) THEN 'valid' ELSE 'broken' END AS status FROM s GROUP BY book"""


def toc(spark, d):
    rows = spans(spark, d).withColumns({"text": F.when(F.col("line_idx") % 3 == 0, F.concat(F.substring("text", 1, 12), F.lit(" ..... "), F.col("page_num"))).otherwise(F.col("text")), "x0": F.col("x0") + F.col("line_idx") % 4 * 10})
    return L.toc_entries(rows)


TOC_SQL = (
    W
    + r""", r AS (SELECT book, page_num, line_idx, x0 + line_idx % 4 * 10 AS x0, CASE WHEN line_idx % 3 = 0 THEN substr(text, 1, 12) || ' ..... ' || page_num ELSE text END AS t FROM spans),
e AS (SELECT *, x0 - min(x0) OVER (PARTITION BY book, page_num) AS ind FROM r WHERE regexp_matches(t, '[.…·_\-]{2,}\s*\d+$'))
SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, regexp_replace(regexp_replace(t, '\s*[.…·_\-]{2,}\s*\d+$', ''), '^\s+|\s+$', '', 'g') AS title, CAST(regexp_extract(t, '(\d+)$', 1) AS BIGINT) AS target, CASE WHEN ind > 25 THEN 3 WHEN ind > 5 THEN 2 ELSE 1 END AS level FROM e"""
)

FONTS = (("SimHei (14.0pt)", "H1", None), ("SimSun_10.5", "body", "Body Text"), ("KaiTi", None, "Quote"), ("SimSun", "note", None))


def font_lookup(spark, d):
    fonts = spark.createDataFrame(list(FONTS), "key string, role string, docx_style string")
    return J.font_lookup(spans(spark, d), fonts, PAGE)


FONT_SQL = (
    W
    + """, k AS (SELECT *, unnest([font_family || ' (' || CAST(round_even(font_size * 2, 0) / 2 AS VARCHAR) || 'pt)', font_family || '_' || CAST(round_even(font_size * 2, 0) / 2 AS VARCHAR), font_family]) AS key, unnest([0, 1, 2]) AS rank FROM spans),
f(key, role, docx_style) AS (VALUES ('SimHei (14.0pt)', 'H1', NULL), ('SimSun_10.5', 'body', 'Body Text'), ('KaiTi', NULL, 'Quote'), ('SimSun', 'note', NULL))
SELECT book, page_num, role, docx_style, key FROM (SELECT book, page_num, role, docx_style, key, row_number() OVER (PARTITION BY book, page_num ORDER BY length(trim(text)) DESC, line_idx, rank) AS r FROM k JOIN f USING (key)) WHERE r = 1"""
)


def toc_match(spark, d):
    """First lines of pages against those of pages divisible by four, as a table of contents of the book."""
    first = spans(spark, d).filter("line_idx = 0 and length(text) > 0").select("book", F.col("page_num").alias("page"), F.substring(T.normal_title(F.col("text")), 1, 12).alias("title"))
    entries = first.filter("page % 4 = 0").select("book", F.col("page").alias("toc_idx"), (F.col("page") + 1).alias("page"), "title", (F.col("page") % 3 + 1).cast("int").alias("level"))
    return J.toc_match(first.select("book", F.col("page").alias("id"), "page", "title"), entries)


TOCM_SQL = (
    W
    + r""", f AS (SELECT book, page_num AS page, substr(translate(regexp_replace(text, '[\s　①-⑳]+', '', 'g'), '０１２３４５６７８９．：', '0123456789.:'), 1, 12) AS title FROM spans WHERE line_idx = 0 AND length(text) > 0),
t AS (SELECT book, page AS toc_idx, page + 1 AS tp, title AS tt, CAST(page % 3 + 1 AS INTEGER) AS level FROM f WHERE page % 4 = 0),
m AS (SELECT f.book, f.page AS id, level, toc_idx, CASE WHEN title = tt AND abs(tp - page) <= 2 THEN 0 WHEN abs(tp - page) <= 3 AND title <> '' AND tt <> '' AND len(list_intersect(list_distinct(string_split(title, '')), list_distinct(string_split(tt, '')))) / len(list_distinct(list_concat(string_split(title, ''), string_split(tt, '')))) >= 0.8 THEN 1 END AS k
  FROM f LEFT JOIN t ON t.book = f.book AND abs(tp - page) <= 3)
SELECT book, id, coalesce(arg_min(level, (k, toc_idx)) FILTER (k IS NOT NULL), 0) AS level FROM m GROUP BY book, id"""
)


def reviews(spark, d):
    """Labels as model reviews of documents: roles, levels and confidences of all kinds."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("body").alias("role"), F.lit(None).cast("int").alias("level"), F.lit(0.6).alias("confidence"))
    r = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "heading").when(F.col("doc_id") % 4 == 1, "caption").when(F.col("doc_id") % 4 == 2, "nonsense").otherwise("body").alias("role"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 5).cast("int")).alias("level"), ((F.col("doc_id") % 11) / 10).alias("confidence"),
    )
    return J.reviewed(docs, r, "doc_id", ("heading", "body", "caption"))


REVIEWS_SQL = """
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'nonsense' ELSE 'body' END AS role, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS INTEGER) END AS level, (doc_id % 11)::DOUBLE / 10 AS c FROM labels),
j AS (SELECT d.doc_id, r.role, r.level, c, coalesce(r.role <> 'nonsense' AND CASE WHEN r.role = 'heading' THEN coalesce(r.level IN (1, 2, 3), false) ELSE r.level IS NULL END AND c >= 0.75 AND c <= 1.0, false) AS ok FROM documents d LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN ok THEN role ELSE 'body' END AS role, CASE WHEN ok THEN level END AS level, CASE WHEN ok THEN c ELSE 0.6::DOUBLE END AS confidence, CASE WHEN ok THEN 'review' ELSE 'rule' END AS decided_by, role IS NOT NULL AND NOT ok AS refused FROM j"""


def footnotes(spark, d):
    """Orders as pages, their lines as markers and notes."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    rows = li.withColumn("pos", pos)
    m = rows.filter("l_partkey % 3 <> 0").select("l_orderkey", (F.col("l_linenumber") % 3).alias("number"), F.col("pos").alias("marker_pos"))
    n = rows.filter("l_partkey % 3 <> 1").select("l_orderkey", (F.col("l_linenumber") % 3).alias("number"), F.col("pos").alias("note_pos"))
    return J.footnote_match(m, n, ["l_orderkey"])


FOOTNOTE_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
m AS (SELECT l_orderkey, l_linenumber % 3 AS number, pos AS marker_pos, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY pos) AS turn FROM r WHERE l_partkey % 3 <> 0),
n AS (SELECT l_orderkey, l_linenumber % 3 AS number, pos AS note_pos, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY pos) AS turn FROM r WHERE l_partkey % 3 <> 1)
SELECT l_orderkey, number, turn, marker_pos, note_pos, CASE WHEN marker_pos IS NULL THEN 'orphan_note' WHEN note_pos IS NULL THEN 'orphan_marker' ELSE 'matched' END AS status FROM m FULL JOIN n USING (l_orderkey, number, turn)"""


def containment(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.expr("substring(text, 1, 60)").alias("text"))
    b = b.withColumn("text", F.regexp_replace("text", r"\s\S*$", ""))
    return J.contained(b, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def containment_whole(spark, d):
    """Documents with a whole benchmark item."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return J.contained(b, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


CONTAINMENT_SQL = r"""
WITH b AS (SELECT item_id, trim(regexp_replace(regexp_replace(substr(text, 1, 60), '\s\S*$', ''), '\s+', ' ', 'g')) AS s FROM benchmark), d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT item_id AS small_id, doc_id AS large_id FROM b, d WHERE s <> '' AND contains(t, ' ' || s || ' ')"""


def font_map(spark, d):
    """Labels of documents as a map that is extended, guarded by its toxic entries, and cut."""
    old = table(spark, d, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("fixed"))
    new = table(spark, d, "documents").filter("doc_id % 7 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(False).alias("fixed"))
    gone = table(spark, d, "documents").filter("doc_id % 5 = 0").select("doc_id")
    return J.merged_map(old, new, gone, "doc_id", protect="fixed")


FONTMAP_SQL = """
WITH o AS (SELECT doc_id, quality, toxic = 1 AS fixed FROM labels), n AS (SELECT doc_id, 9 AS quality, false AS fixed FROM documents WHERE doc_id % 7 = 0)
SELECT doc_id, CASE WHEN o.fixed OR n.quality IS NULL THEN o.quality ELSE n.quality END AS quality, CASE WHEN o.fixed OR n.quality IS NULL THEN o.fixed ELSE n.fixed END AS fixed
FROM o FULL JOIN n USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)"""


# ---------------------------------------------------------------- sections


def _sections(spark, d):
    return S.section_ids(S.sectioned(sections_html(spark, d), "page_id", "pos", 2))


def sectioned(spark, d):
    return _sections(spark, d).select("page_id", "pos", "sec", "para", "section_id", "para_id", "level")


SECT = H + ", n AS (SELECT *, CAST(sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS sec FROM sections), p AS (SELECT *, row_number() OVER (PARTITION BY page_id, sec ORDER BY pos) AS para FROM n)"


def markdown(spark, d):
    return S.section_texts(_sections(spark, d), "page_id").select("page_id", "sec", F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("n_chars"))


RULES = [
    {"action": "delete_line", "trigger_regex": "^(Les|The) ", "priority": 5},
    {"action": "inject_badge", "inject_prefix_badge": "【Note】", "trigger_regex": "en", "priority": 10},
    {"action": "apply_style", "target_docx_style": "Quote", "trigger_regex": "th", "priority": 20},
    {"action": "apply_style", "target_docx_style": "Key", "trigger_regex": "and", "priority": 30},
    {"action": "apply_style", "target_docx_style": "Alien", "trigger_regex": "zz", "priority": 40},
]


def ruled(spark, d):
    p = _sections(spark, d).select(F.concat_ws("/", "page_id", "sec").alias("section"), "para", (F.col("sec") == 0).alias("is_preamble"), "text")
    return S.apply_rules(p, RULES, ("Quote", "Key"))


def rule_marks(spark, d):
    return ruled(spark, d).select("section", "para", "is_deleted", "custom_style", "injected_badge")


RULE_SQL = (
    SECT
    + """, q AS (SELECT page_id || '/' || sec AS section, para, sec = 0 AS pre, text, regexp_matches(text, '^(Les|The) ') AS is_deleted FROM p),
a AS (SELECT *, NOT is_deleted AND NOT pre AND contains(text, 'en') AND NOT starts_with(text, '【Note】') AS ask FROM q),
f AS (SELECT *, ask AND NOT coalesce(bool_or(ask) OVER (PARTITION BY section ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS first FROM a)
SELECT section, para, is_deleted, CASE WHEN is_deleted OR contains(text, 'zz') THEN '' WHEN contains(text, 'and') THEN 'Key' WHEN contains(text, 'th') THEN 'Quote' ELSE '' END AS custom_style, CASE WHEN first THEN '【Note】' ELSE '' END AS injected_badge FROM f"""
)


def rendered(spark, d):
    """Sections after the rules, as they are written."""
    rows = ruled(spark, d).filter("not is_deleted").withColumn("text", S.effective_text(F.col("text"), F.col("injected_badge"), F.col("custom_style")))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("section").agg(F.sha2(items, 256).alias("digest"))


RENDER_SQL = (
    RULE_SQL.rsplit("SELECT section", 1)[0]
    + """, s AS (SELECT section, para, is_deleted, CASE WHEN contains(text, 'zz') THEN '' WHEN contains(text, 'and') THEN 'Key' WHEN contains(text, 'th') THEN 'Quote' ELSE '' END AS st, CASE WHEN first THEN '【Note】' || text ELSE text END AS t FROM f)
SELECT section, sha256(string_agg(CASE WHEN st <> '' THEN '::: {custom-style="' || st || '"}' || chr(10) || t || chr(10) || ':::' ELSE t END, chr(10) || chr(10) ORDER BY para)) AS digest FROM s WHERE NOT is_deleted GROUP BY section"""
)


def first_match(spark, d):
    rules = [r for r in RULES if r["action"] == "apply_style"]
    return _sections(spark, d).select("page_id", "pos", S.first_rule(F.col("text"), rules).alias("style"))


def audit(spark, d):
    """Status of sections after the rules, rolled up by page."""
    raw = _sections(spark, d).select(F.concat_ws("/", "page_id", "sec").alias("section"), "page_id", "para", F.col("text").alias("raw"))
    both = raw.join(ruled(spark, d), ["section", "para"])
    text = S.effective_text(F.col("text"), F.col("injected_badge"), F.col("custom_style"))
    out = F.when(F.col("is_deleted"), "").otherwise(text)
    status = S.traffic_light(F.col("raw"), out, F.array_compact(F.array(F.when(F.col("custom_style") != "", F.col("custom_style")))), ("Quote",), ("【Note】",))
    return S.audit_rollup(both.select("page_id", status.alias("status")), ["page_id"])


AUDIT_SQL = (
    RULE_SQL.rsplit("SELECT section", 1)[0]
    + """, s AS (SELECT split_part(section, '/', 1)::BIGINT AS page_id, CASE WHEN is_deleted AND regexp_matches(text, '[A-Za-z0-9一-鿿]') THEN 'RED' WHEN NOT is_deleted AND contains(text, 'and') AND NOT contains(text, 'zz') THEN 'RED' ELSE 'GREEN' END AS st FROM f)
SELECT page_id, count(*) AS total, count(*) FILTER (st = 'GREEN') AS green, CAST(0 AS BIGINT) AS yellow, count(*) FILTER (st = 'RED') AS red FROM s GROUP BY page_id"""
)


def numbering(spark, d):
    """Gaps in circled numbers that lines of pages carry."""
    glyph = F.expr(f"substring('{S.CIRCLED}', line_idx * if(page_num % 2 = 0, 2, 1) % 20 + 1, 1)")
    rows = spans(spark, d).filter("line_idx < 5").withColumn("g", glyph).groupBy(*PAGE).agg(F.array_join(F.array_sort(F.collect_list("g")), "").alias("t"))
    return rows.select(*PAGE, F.array_join(S.circled_gaps(F.col("t")), ",").alias("missing"))


NUMBERING_SQL = W + ", g AS (SELECT book, page_num, list_distinct(list(line_idx * CASE WHEN page_num % 2 = 0 THEN 2 ELSE 1 END % 20 + 1)) AS k FROM spans WHERE line_idx < 5 GROUP BY ALL) SELECT book, page_num, CASE WHEN len(k) < 2 THEN '' ELSE array_to_string(list_filter(range(list_min(k), list_min(k) + len(k)), lambda i: NOT list_contains(k, i)), ',') END AS missing FROM g"


def badge_frequency(spark, d):
    """Badges that most turns of a conversation begin with."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("sec"), F.concat(F.when(F.col("turn") % 3 < 2, "【Ask】").otherwise("[Tip one]"), "text").alias("content"))
    return S.mandatory_badges(c, "conv_id")


BADGE_SQL = """
WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN 'Ask' ELSE 'Tip one' END AS badge FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, badge, n_sections FROM (SELECT conv_id, badge, count(DISTINCT turn) AS n_sections FROM b GROUP BY conv_id, badge) JOIN n USING (conv_id) WHERE n_sections >= CASE WHEN n <= 2 THEN 1 ELSE greatest(2, floor(n * 0.6)) END"""


def seeded_prefix(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("sec"), (F.length("text") % 5 != 0).alias("seen"))
    return S.seeded_prefix(rows, "conv_id").select("conv_id", "sec")


def previews(spark, d):
    """First characters of paragraphs, marked where cut."""
    p = _sections(spark, d)
    return p.select("page_id", "para_id", F.length("text").alias("n"), F.concat(F.substring("text", 1, 25), F.when(F.length("text") > 25, "...").otherwise("")).alias("preview"))


QUERIES = {
    "src_engine_router": (router, r"WITH r AS (SELECT source AS book, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), m AS (SELECT book, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g')))::DOUBLE / count(*) AS mean_chars FROM r WHERE r <= 5 GROUP BY book) SELECT book, mean_chars, mean_chars > 100 AS is_vector FROM m"),
    "agg_recurring_headers": (recurring, _recurring_sql("line_idx = 0", "y1")),
    "agg_recurring_footers": (recurring_bottom, _recurring_sql("is_last", "y0")),
    "agg_weighted_typography": (modes, MODES_SQL),
    "agg_dominant_font": (dominant, W + ", r AS (SELECT *, length(text) AS n FROM spans WHERE length(text) > 0), f AS (SELECT book, page_num, font_family, sum(n) AS c FROM r GROUP BY ALL) SELECT r.book, r.page_num, (SELECT font_family FROM f WHERE f.book = r.book AND f.page_num = r.page_num ORDER BY c DESC, font_family LIMIT 1) AS font, sum(font_size * n) / sum(n) AS mean_size FROM r GROUP BY r.book, r.page_num"),
    "agg_line_pitch": (pitch, W + ", g AS (SELECT book, page_num, y0 - lag(y0) OVER (PARTITION BY book, page_num ORDER BY line_idx) AS gap FROM spans) SELECT book, page_num, coalesce(median(CASE WHEN gap BETWEEN 8 AND 45 THEN gap END), 18.0) AS pitch FROM g GROUP BY book, page_num"),
    "agg_typography_baseline": (baseline, BASELINE_SQL),
    "agg_font_census": (census, W + " SELECT font_family, round_even(font_size * 2, 0) / 2 AS size, count(*) AS n_spans, count(DISTINCT (book, page_num)) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (y1 <= 50)::DOUBLE / count(*) AS top_ratio, count(*) FILTER (y0 >= 350)::DOUBLE / count(*) AS bottom_ratio FROM spans GROUP BY ALL"),
    "win_span_duplicates": (duplicates, W + " SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY book, page_num, x0, floor(y0 / 200), text ORDER BY line_idx) AS r FROM spans) WHERE r = 1 AND text <> ''"),
    "seq_heading_gate": (heading_roles, ROLES_SQL),
    "seq_regex_heading_level": (regex_levels, LEVELS_SQL),
    "win_folio_sequence": (folio, FOLIO_SQL),
    "seq_toc_entries": (toc, TOC_SQL),
    "join_font_lookup": (font_lookup, FONT_SQL),
    "join_toc_match": (toc_match, TOCM_SQL),
    "join_reviews": (reviews, REVIEWS_SQL),
    "join_footnotes": (footnotes, FOOTNOTE_SQL),
    "join_containment": (containment, CONTAINMENT_SQL),
    "join_containment_whole": (containment_whole, None),
    "snk_font_map_merge": (font_map, FONTMAP_SQL),
    "seq_sections": (sectioned, SECT + " SELECT page_id, CAST(pos AS INTEGER) AS pos, sec, para, printf('sec_%03d', sec) AS section_id, printf('sec_%03d_p%03d', sec, para) AS para_id, level FROM p"),
    "snk_section_markdown": (markdown, SECT + " SELECT page_id, sec, sha256(c) AS digest, length(c) AS n_chars FROM (SELECT page_id, sec, string_agg(text, chr(10) || chr(10) ORDER BY para) AS c FROM p GROUP BY page_id, sec)"),
    "seq_rule_propagation": (rule_marks, RULE_SQL),
    "agg_effective_content": (rendered, RENDER_SQL),
    "seq_rule_first_match": (first_match, H + " SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN contains(text, 'th') THEN 'Quote' WHEN contains(text, 'and') THEN 'Key' WHEN contains(text, 'zz') THEN 'Alien' ELSE 'Normal' END AS style FROM sections"),
    "agg_audit_rollup": (audit, AUDIT_SQL),
    "win_missing_numbering": (numbering, NUMBERING_SQL),
    "agg_badge_frequency": (badge_frequency, BADGE_SQL),
    "seq_seeded_prefix": (seeded_prefix, "SELECT conv_id, sec FROM (SELECT conv_id, turn AS sec, bool_and(length(text) % 5 <> 0) OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM conversations) WHERE ok"),
    "win_paragraph_previews": (previews, SECT + " SELECT page_id, printf('sec_%03d_p%03d', sec, para) AS para_id, CAST(length(text) AS INTEGER) AS n, substr(text, 1, 25) || CASE WHEN length(text) > 25 THEN '...' ELSE '' END AS preview FROM p"),
}
