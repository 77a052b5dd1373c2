"""Further predicate, heading, table and text queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import sections as S
from ..registry import Registry, Spec
from ..sources.tables import SECTIONS_SQL, SPANS_SQL, sections_html, spans, table

W, H = f"WITH {SPANS_SQL}", f"WITH {SECTIONS_SQL}"
LINE = ["book", "page_num", "line_idx"]
L_SQL = "book, page_num, CAST(line_idx AS INTEGER) AS line_idx"


def picked(options, by="line_idx"):
    return F.element_at(F.array(*(F.lit(x) for x in options)), (F.col(by) % len(options) + 1).cast("int"))


def computed(make, options, expr, column="v", by=None):
    """Query over whole lines after one of the options, and the SQL that computes the result from the same texts (t). by: what follows the option in place of the line."""
    rest = by or (lambda: F.col("text"), "text")

    def run(spark, d):
        return spans(spark, d).withColumn("t", F.concat(picked(options), rest[0]())).select(*LINE, make(F.col("t")).alias(column))

    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in options)
    t = f"list_extract([{quoted}], CAST(line_idx % {len(options)} + 1 AS BIGINT)) || {rest[1]}"
    return run, f"{W}, planted AS (SELECT *, {t} AS t FROM spans) SELECT {L_SQL}, {expr} AS {column} FROM planted"


def _strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _plain(pattern):
    """A pattern for SQL: the flag of Unicode classes is left out, as it means another thing there."""
    return "'" + pattern.replace("(?U)", "").replace("(?mU)", "(?m)").replace("'", "''") + "'"


def _replaced(x, words):
    for w in words:
        x = f"replace({x}, '{w}', '')"
    return x


def _restored(x):
    """SQL of T.restored_symbols, with groups in place of lookarounds."""
    x = rf"regexp_replace({x}, '(?m)^(\s*(?:>|\*|#)*\s*[*#]{{0,3}}\s*)([一二三四五六七八九十]+)[)）]', '\1（\2）', 'g')"
    for n in range(20, 0, -1):
        x = rf"regexp_replace({x}, '(?m)^(\s*(?:>|\*)*\s*){n}([一-龥])', '\1{chr(0x245F + n)}\2', 'g')"
    x = rf"regexp_replace({x}, '(\d)\s*~\s*(\d)', '\1～\2', 'g')"
    return rf"regexp_replace({x}, '(?m)^\s*!\[[^\]]*\]\(\s*\)(?:\{{[^\n}}]*\}})?\s*\n?', '', 'g')"


def _tag(x):
    n = f"trim(lower({x}))"
    return f"CASE WHEN {n} = '' THEN NULL " + " ".join(f"WHEN {_any(n, words)} THEN '{tag}'" for tag, words in T.FONT_FAMILIES) + " END"


_ANSWER = _strip(r"regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '')")
_ANSWER = _strip(rf"regexp_replace(regexp_replace({_ANSWER}, '^```(?:markdown|json|text)?\s*\n?', ''), '\n?```\s*$', '')")
#: What follows a font's name: nothing for every other book.
_OF_BOOK = (lambda: F.when(F.col("page_num") % 2 == 0, "").otherwise(F.concat(F.lit("-"), F.col("book"))), "CASE WHEN page_num % 2 = 0 THEN '' ELSE '-' || book END")
#: The same for texts that may be a tag and nothing else.
_OR_LINE = (lambda: F.when(F.col("page_num") % 2 == 0, "").otherwise(F.col("text")), "CASE WHEN page_num % 2 = 0 THEN '' ELSE text END")


def header(spark, d):
    rows = spans(spark, d).withColumn("t", F.when(F.col("line_idx") % 3 == 0, F.concat(F.substring("text", 1, 6), F.lit("/"), F.col("page_num"))).otherwise(F.col("text")))
    c = F.col
    return rows.select(*LINE, T.page_header(c("t"), c("x0"), c("y0"), c("x1"), c("y1"), 300.0, 1000.0).alias("v"))


HEADER_SQL = (
    W
    + rf""", r AS (SELECT *, regexp_replace(CASE WHEN line_idx % 3 = 0 THEN substr(text, 1, 6) || '/' || page_num ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM spans)
SELECT {L_SQL}, ((x0 > 264.0 OR x1 < 36.0) AND x1 - x0 < 25) OR (y1 <= 130.0 AND t <> '' AND (regexp_matches(t, '^[上下中]篇[:：|｜]|第[一二三四五六七八九十百]+章|^/\s*\d+|^\d+\s*/|^\d{{1,4}}$') OR (y0 < 110.0 AND (regexp_matches(t, '^\d+$') OR (length(t) <= 30 AND contains(t, '/')))))) AS v FROM r"""
)


def footer(spark, d):
    rows = spans(spark, d).withColumn("t", F.when(F.col("line_idx") % 4 == 1, F.concat(F.lit(" "), F.col("page_num"), F.lit(" "))).otherwise(F.col("text")))
    return rows.select(*LINE, T.page_footer(F.col("t"), F.col("y0"), 120.0).alias("v"))


def margins(spark, d):
    """Left and right margins of a page by its long lines that are not centred."""
    rows = spans(spark, d)
    ok = (F.abs((F.col("x0") + F.col("x1")) / 2 - 595.0 / 2) >= 595.0 * 0.12) & (F.length(T.strip(F.col("text"))) > 10)
    out = rows.groupBy("book", "page_num").agg(F.coalesce(F.min(F.when(ok, F.col("x0"))), F.lit(65.0)).alias("base_x0"), F.max(F.when(ok, F.col("x1"))).alias("far"))
    return out.select("book", "page_num", "base_x0", F.coalesce("far", F.lit(595.0) - F.col("base_x0")).alias("max_x1"))


MARGINS_SQL = (
    W
    + r""", r AS (SELECT *, abs((x0 + x1) / 2 - 297.5) >= 595.0::DOUBLE * 0.12::DOUBLE AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 10 AS ok FROM spans),
g AS (SELECT book, page_num, coalesce(min(CASE WHEN ok THEN x0 END), 65.0) AS base_x0, max(CASE WHEN ok THEN x1 END) AS far FROM r GROUP BY book, page_num) SELECT book, page_num, base_x0, coalesce(far, 595.0 - base_x0) AS max_x1 FROM g"""
)


def primary_font(spark, d):
    """The font of the longest line of a page, the first of those."""
    rows = spans(spark, d).filter("length(trim(text)) > 0")
    best = F.min_by(F.struct("font_family", (F.rint(F.col("font_size") * 2) / 2).alias("size")), F.struct(-F.length(F.trim("text")), F.col("line_idx")))
    return rows.groupBy("book", "page_num").agg(best.alias("b")).select("book", "page_num", F.format_string("%s (%spt)", "b.font_family", F.col("b.size").cast("string")).alias("font_key"))


def toc_pages(spark, d):
    """First page of each book with a contents title, and the last of the pages that follow it with entry lines."""
    title = spans(spark, d).filter("line_idx = 0").select("book", "page_num")
    start = title.filter("page_num % 40 in (7, 9)").groupBy("book").agg(F.min("page_num").alias("first"))
    rows = title.join(start, "book").filter("page_num >= first").withColumn("entry", (F.col("page_num") == F.col("first")) | (F.col("page_num") % 3 != 0))
    w = Window.partitionBy("book").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("ok", F.min(F.col("entry").cast("int")).over(w)).filter("ok = 1")
    return run.groupBy("book", "first").agg(F.max("page_num").alias("last"))


def retention(spark, d):
    """Share of characters kept from section to section: the shorter of two neighbours over the first."""
    p = S.section_texts(S.sectioned(sections_html(spark, d), "page_id", "pos", 2), "page_id")
    n = F.length(F.regexp_replace("content", r"[\s#:\-{}\[\]()=]+", ""))
    return p.withColumn("n", n).groupBy("page_id").agg((F.sum(F.least(F.col("n"), F.lit(500))) / F.sum("n")).alias("rate")).select("page_id", "rate", (F.col("rate") >= 0.90).alias("passed"))


def ink_runs(spark, d):
    """Lines of text in a scan: runs of rows with ink, long enough, padded by three. Rows are a page's lines, ink their lengths."""
    rows = spans(spark, d).select("book", "page_num", "line_idx", (F.length("text") > 40).cast("int").alias("ink"))
    w = Window.partitionBy("book", "page_num").orderBy("line_idx")
    runs = rows.withColumn("g", F.col("line_idx") - F.sum("ink").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("ink = 1")
    end = F.max("line_idx").over(Window.partitionBy("book", "page_num"))
    sized = rows.select("book", "page_num", end.alias("last")).distinct()
    got = runs.groupBy("book", "page_num", "g").agg(F.min("line_idx").alias("a"), F.max("line_idx").alias("b")).filter("b - a + 1 >= 2").join(sized, ["book", "page_num"])
    return got.select("book", "page_num", F.greatest(F.lit(0), F.col("a") - 3).alias("y0"), F.least(F.col("last") + 1, F.col("b") + 4).alias("y1"))


INK_SQL = (
    W
    + """, r AS (SELECT book, page_num, CAST(line_idx AS INTEGER) AS i, CASE WHEN length(text) > 40 THEN 1 ELSE 0 END AS ink FROM spans), g AS (SELECT *, i - sum(ink) OVER (PARTITION BY book, page_num ORDER BY i) AS g, max(i) OVER (PARTITION BY book, page_num) AS last FROM r)
SELECT book, page_num, greatest(0, min(i) - 3) AS y0, least(any_value(last) + 1, max(i) + 4) AS y1 FROM g WHERE ink = 1 GROUP BY book, page_num, g HAVING max(i) - min(i) + 1 >= 2"""
)


def sliced(spark, d):
    """What is left of each line of a page when characters 30 to 90 of the page are taken out."""
    w = Window.partitionBy("book", "page_num").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans(spark, d).withColumn("stop", F.sum(F.length("text")).over(w)).withColumn("start", F.col("stop") - F.length("text"))
    left = F.expr("substring(text, 1, cast(greatest(0, least(30 - start, length(text))) as int))")
    right = F.expr("substring(text, cast(least(greatest(90 - start, 0), length(text)) as int) + 1, length(text))")
    inside = (F.col("stop") > 30) & (F.col("start") < 90)
    return rows.select(*LINE, F.when(inside, F.concat(left, right)).otherwise(F.col("text")).alias("rest"))


SLICED_SQL = (
    W
    + f""", r AS (SELECT *, sum(length(text)) OVER (PARTITION BY book, page_num ORDER BY line_idx) AS e FROM spans), q AS (SELECT *, e - length(text) AS s FROM r)
SELECT {L_SQL}, CASE WHEN e > 30 AND s < 90 THEN substr(text, 1, CAST(greatest(0, least(30 - s, length(text))) AS INTEGER)) || substr(text, CAST(least(greatest(90 - s, 0), length(text)) AS INTEGER) + 1) ELSE text END AS rest FROM q"""
)


def patched(spark, d):
    """Paragraphs of pages with patches by id: some deleted, some styled, some with a badge."""
    p = S.section_ids(S.sectioned(sections_html(spark, d), "page_id", "pos", 2)).select("page_id", "para_id", "sec", "para", "text")
    ops = p.filter("page_id % 2 = 0 and para % 2 = 0").select("page_id", "para_id", (F.col("para") % 4 == 0).alias("delete"), F.lit("Quote").alias("style"))
    both = p.join(ops, ["page_id", "para_id"], "left")
    gone = F.coalesce("delete", F.lit(False))
    return both.select("page_id", "para_id", gone.alias("is_deleted"), F.when(~gone, F.coalesce("style", F.lit(""))).otherwise("").alias("custom_style"))


PATCHED_SQL = (
    H
    + """, n AS (SELECT *, CAST(sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS sec FROM sections), p AS (SELECT *, row_number() OVER (PARTITION BY page_id, sec ORDER BY pos) AS para FROM n)
SELECT page_id, printf('sec_%03d_p%03d', sec, para) AS para_id, page_id % 2 = 0 AND para % 4 = 0 AS is_deleted, CASE WHEN page_id % 2 = 0 AND para % 2 = 0 AND para % 4 <> 0 THEN 'Quote' ELSE '' END AS custom_style FROM p"""
)


def largest(spark, d):
    """The largest file (order) for each key (customer)."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


def tables(spark, d):
    """Which pages' first lines make a table of three columns."""
    rows = spans(spark, d).filter("line_idx < 2").groupBy("book", "page_num").agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(F.substring(x["text"], 1, 2), F.when(F.col("page_num") % 2 == 0, F.substring(x["text"], 3, 4)).otherwise(""), F.lit(None).cast("string")))
    return rows.select("book", "page_num", T.valid_table(cells, (F.col("page_num") % 300).cast("double"), F.lit(40.0), 595.0).alias("valid"))


TABLES_SQL = (
    W
    + r""", c AS (SELECT book, page_num, regexp_replace(unnest([substr(text, 1, 2), CASE WHEN page_num % 2 = 0 THEN substr(text, 3, 4) ELSE '' END]), '\s+', '', 'g') AS x FROM spans WHERE line_idx < 2),
g AS (SELECT book, page_num, count(*) FILTER (x <> '') AS k, coalesce(sum(length(x)), 0) AS n, page_num % 300 AS w FROM c GROUP BY book, page_num)
SELECT book, page_num, w > 10 AND NOT (w < 595.0 * 0.28 AND n <= 8) AND k > 1 AND n > 4 AS valid FROM g"""
)


def indents(spark, d):
    """Level of contents titles by indent: below 5 points as it is, below 25 two at least, else three."""
    rows = spans(spark, d).withColumns({"x": F.col("x0") + F.col("line_idx") % 4 * 10, "t": F.concat(picked(TITLES), "text")})
    least = F.min("x").over(Window.partitionBy("book", "page_num"))
    n = F.count("*").over(Window.partitionBy("book", "page_num"))
    rows = rows.withColumns({"ind": F.col("x") - least, "n": n, "base": T.toc_title_level(F.col("t"))})
    deep = F.when(F.col("ind") < 5, 1).when(F.col("ind") < 25, 2).otherwise(3)
    return rows.select(*LINE, F.when(F.col("n") < 3, F.col("base")).otherwise(F.greatest("base", deep)).alias("level"))


TITLES = ("第三章 总论", "第二节 方法", "（三）细节", "附录", "1.2.3 步骤", "其他")
_TITLE = "list_extract([" + ", ".join(f"'{x}'" for x in TITLES) + f"], CAST(line_idx % {len(TITLES)} + 1 AS BIGINT)) || text"
_BASE = (
    f"CASE WHEN regexp_matches({_TITLE}, '^(?:[上下中]\\s*篇|第[一二三四五六七八九十百零]+[章卷篇編]|目錄|目录|序|結語|结语|後記|后记|前言|附錄|附录|主要參考文獻|主要参考文献)') THEN 1 "
    f"WHEN regexp_matches({_TITLE}, '^(?:[(（][一二三四五六七八九十\\d]+[)）]|\\d+\\.\\d+\\.\\d+)') THEN 3 ELSE 2 END"
)
INDENT_SQL = (
    W
    + f""", r AS (SELECT *, x0 + line_idx % 4 * 10 AS x, {_BASE} AS base FROM spans), q AS (SELECT *, x - min(x) OVER (PARTITION BY book, page_num) AS ind, count(*) OVER (PARTITION BY book, page_num) AS n FROM r)
SELECT {L_SQL}, CASE WHEN n < 3 THEN base ELSE greatest(base, CASE WHEN ind < 5 THEN 1 WHEN ind < 25 THEN 2 ELSE 3 END) END AS level FROM q"""
)


def preflight(spark, d):
    """Audit of a conversation's matches: orphans fail it, gaps warn, the rest passes."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.length("text") % 7 == 0).alias("orphans"), F.max("turn").alias("last"))
    return c.select("conv_id", F.when(F.col("orphans") > 0, "FAIL").when(F.col("n") != F.col("last") + 1, "WARNING").when(F.col("n") % 2 == 1, "WARNING").otherwise("PASS").alias("status"))


REGISTRY = Registry()
for _i, (_name, _kind, _on) in enumerate((("layout", "document", True), ("pod", "document", True), ("formula", "image", True), ("images", "tool", True), ("founder", "tool", True), ("annotate", "tool", False))):
    REGISTRY.register(Spec(_name, lambda spark, d: table(spark, d, "region"), _kind, 10 * (6 - _i), _on))


def specs(spark, d):
    rows = [(s.name, s.category, s.order) for s in REGISTRY.specs()]
    return spark.createDataFrame(rows, "name string, category string, spec_order int")


LEVELS = ("第三章 总论", "第二节 方法", "（三）细节", "附录", "1.2 步骤", "正文。", "表 2", "的了在是")
NAMES = ("FZKTK--GBK1-0", "STFangsong", "SimSun", "Microsoft YaHei", "Arial", "", "Unknown")
LOG = ("[INFO] start", "File \"x.py\"", "hello", "", "Page 3", "UserWarning: 處理", "正在處理", "/lib/site-packages/x 頁")
SYMBOLS = ("一)开始", "1外感", "20寒", "3~5天", "![a]() ", "12 apples", "**二)组方**")
TAGS = ("===HUMAN_EDITED_END===", "甲<!-- END_OF_SEED -->", " 【人工整稿截止】 ", "plain")
THINK = ("<think>a</think>b", "<think>open", "```json\n{}\n```", "x")
TOC = ("第一章 绪论 12", "背景……15", "a\t7", "第一章 绪论", "1999 年")

QUERIES = {
    "flt_page_header": (header, HEADER_SQL),
    "flt_page_footer": (footer, W + rf" SELECT {L_SQL}, y0 >= 108.0 AND (line_idx % 4 = 1 AND page_num < 10000 OR line_idx % 4 <> 1 AND regexp_matches(text, '^\s*\d{{1,4}}\s*$')) AS v FROM spans"),
    "flt_valid_table": (tables, TABLES_SQL),
    "flt_progress_line": computed(T.progress_line, LOG, f"{_strip('t')} <> '' AND NOT regexp_matches({_strip('t')}, {_plain(T.NOISE)}) AND {_any('t', T.PROGRESS)}"),
    "flt_function_words": computed(lambda c: T.function_words(c) >= 2, LEVELS, f"length(regexp_replace(t, '[^{T.FUNCTION_WORDS}]', '', 'g')) >= 2"),
    "flt_toc_line": computed(T.toc_line, TOC, r"regexp_matches(t, '[…·.]{2,}\s*\d+|\t\s*\d+\s*$') OR (regexp_matches(t, '^第[一二三四五六七八九十百]+[章節条條篇卷]') AND regexp_matches(t, '\d+\s*$'))", by=_OR_LINE),
    "agg_page_margins": (margins, MARGINS_SQL),
    "agg_primary_font": (primary_font, W + " SELECT book, page_num, arg_min(font_family || ' (' || CAST(round_even(font_size * 2, 0) / 2 AS VARCHAR) || 'pt)', (-length(trim(text)), line_idx)) AS font_key FROM spans WHERE length(trim(text)) > 0 GROUP BY book, page_num"),
    "join_largest_file": (largest, "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey"),
    "join_patch": (patched, PATCHED_SQL),
    "scl_font_tag": computed(T.font_tag, NAMES, _tag("t"), by=_OF_BOOK),
    "scl_restore_symbols": computed(T.restored_symbols, SYMBOLS, _restored("t")),
    "scl_split_circled": computed(T.split_circled, ("①甲 ②乙", "甲③", "x"), r"regexp_replace(t, '([^\n])\s*([①②③④⑤⑥⑦⑧⑨⑩])', '\1' || chr(10) || '\2', 'g')"),
    "scl_boundary_tags": computed(T.without_boundary_tags, TAGS, _strip(_replaced("t", T.BOUNDARY_TAGS)), by=_OR_LINE),
    "scl_is_boundary_tag": computed(T.boundary_tag, TAGS, f"{_strip('t')} IN ({', '.join(repr(x) for x in T.BOUNDARY_TAGS)})", by=_OR_LINE),
    "scl_model_answer": computed(T.without_think, THINK, _ANSWER, by=_OR_LINE),
    "scl_toc_level": (indents, INDENT_SQL),
    "seq_toc_pages": (toc_pages, W + ", t AS (SELECT DISTINCT book, page_num FROM spans WHERE line_idx = 0), s AS (SELECT book, min(page_num) AS first FROM t WHERE page_num % 40 IN (7, 9) GROUP BY book), r AS (SELECT book, page_num, first, min(CASE WHEN page_num = first OR page_num % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page_num) AS ok FROM t JOIN s USING (book) WHERE page_num >= first) SELECT book, first, max(page_num) AS last FROM r WHERE ok = 1 GROUP BY book, first"),
    "seq_retention": (retention, H + r", n AS (SELECT *, sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS sec FROM sections), g AS (SELECT page_id, sec, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS c FROM n GROUP BY page_id, sec), k AS (SELECT page_id, length(regexp_replace(c, '[\s#:\-{}\[\]()=]+', '', 'g')) AS n FROM g) SELECT page_id, sum(least(n, 500))::DOUBLE / sum(n) AS rate, sum(least(n, 500))::DOUBLE / sum(n) >= 0.90 AS passed FROM k GROUP BY page_id"),
    "seq_ink_runs": (ink_runs, INK_SQL),
    "seq_run_slicing": (sliced, SLICED_SQL),
    "udx_preflight": (preflight, "WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) % 7 = 0) AS o, max(turn) AS l FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN o > 0 THEN 'FAIL' WHEN n <> l + 1 OR n % 2 = 1 THEN 'WARNING' ELSE 'PASS' END AS status FROM c"),
    "win_list_specs": (specs, "SELECT * FROM (VALUES ('founder', 'tool', 20), ('images', 'tool', 30), ('formula', 'image', 40), ('pod', 'document', 50), ('layout', 'document', 60)) AS v(name, category, spec_order)"),
}
