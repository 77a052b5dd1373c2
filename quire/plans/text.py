"""Scalar and predicate queries over the lines of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds
from ..sources.tables import SPANS_SQL, spans, table

W = f"WITH {SPANS_SQL}"
LINE = ["book", "page_num", "line_idx"]
#: The driver's texts are Latin, so a prefix brings CJK, numerals and markers into play.
SEEDS = ("", "第三章 ", "①", "（二）", "表 3-1 ", "[M]. 北京: 出版社, 1998 年", "12", "二十五", "一百零三", "¹²", "b. ", "图 4 ", "：", "。", "##", "| a | b |", "注1", "参见", "十", "〇五")
SEED_SQL = "(CASE CAST(line_idx AS BIGINT) % 20 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEEDS)) + " END)"


def seeded(spark, d):
    """Lines with seeds: `t` is the seed and the line, `s` the seed alone."""
    pick = F.element_at(F.array(*(F.lit(s) for s in SEEDS)), (F.col("line_idx") % len(SEEDS) + 1).cast("int"))
    return spans(spark, d).withColumns({"s": pick, "t": F.concat(pick, "text")})


def _line(value, column="v"):
    return lambda spark, d: seeded(spark, d).select(*LINE, value().alias(column))


def _sql(expr, column="v"):
    return f"{W}, q AS (SELECT *, {SEED_SQL} AS s, {SEED_SQL} || text AS t FROM spans) SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, {expr} AS {column} FROM q"


s, t = (lambda: F.col("s")), (lambda: F.col("t"))
PUNCT = "[。！？；!?;][”’\"''）\\)\\]】」』]*$"
STRIP = r"regexp_replace({}, '^[\s　]+|[\s　]+$', '', 'g')"
CHARS = "list_distinct(string_split({}, ''))"


def lines_profile(spark, d):
    """Lines of a document and those that end a sentence."""
    rows = spans(spark, d)
    return rows.groupBy("book", "page_num").agg(F.count("*").alias("n_lines"), F.count_if(T.terminal_punctuation(F.col("text"))).alias("n_terminal"))


def char_boxes(spark, d):
    """Even boxes of the characters of the first lines of pages."""
    rows = spans(spark, d).filter("line_idx = 0 and length(text) > 0")
    chars = rows.select("book", "page_num", "x0", "x1", F.length("text").alias("n"), F.posexplode(F.split("text", "")).alias("pos", "ch"))
    w = (F.col("x1") - F.col("x0")) / F.col("n")
    return chars.select("book", "page_num", "pos", "ch", (F.col("x0") + w * F.col("pos")).alias("cx0"), (F.col("x0") + w * (F.col("pos") + 1)).alias("cx1"))


def suspicious(spark, d):
    """Rare glyphs by class, with their context (one is planted in every seventh line)."""
    rows = spans(spark, d).withColumn("t", F.when(F.col("line_idx") % 7 == 3, F.concat(F.substring("text", 1, 20), F.lit(""), F.substring("text", 21, 20), F.lit("㐂"))).otherwise(F.col("text")))
    chars = rows.select(*LINE, "t", F.posexplode(F.split("t", "")).alias("pos", "ch")).withColumn("kind", T.suspicious_class(F.ascii("ch"))).filter("kind is not null")
    return chars.select(*LINE, "pos", "ch", "kind", F.expr("substring(t, greatest(1, pos - 4), 10)").alias("context"))


def suspicious_whole(spark, d):
    """Rare glyphs by class in whole lines, with 15 characters of context on either side."""
    chars = spans(spark, d).select(*LINE, "text", F.posexplode(F.split("text", "")).alias("pos", "ch")).withColumn("kind", T.suspicious_class(F.ascii("ch"))).filter("kind is not null")
    return chars.select(*LINE, "pos", "ch", "kind", F.expr("substring(text, greatest(1, pos - 14), pos + 16 - greatest(0, pos - 15))").alias("context"))


def rare_report(spark, d):
    return suspicious(spark, d).groupBy("kind", "ch").agg(F.count("*").alias("n"), F.countDistinct("book", "page_num").alias("n_pages"))


SUSPICIOUS_SQL = (
    W
    + """, r AS (SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN line_idx % 7 = 3 THEN substr(text, 1, 20) || '' || substr(text, 21, 20) || '㐂' ELSE text END AS t FROM spans),
c AS (SELECT *, unnest(range(0, length(t))) AS pos FROM r), k AS (SELECT *, substr(t, pos + 1, 1) AS ch FROM c)
SELECT book, page_num, line_idx, CAST(pos AS INTEGER) AS pos, ch, CASE WHEN ch = '' THEN 'private_use' ELSE 'extension_a' END AS kind, substr(t, greatest(1, pos - 4), 10) AS context FROM k WHERE ch IN ('', '㐂')"""
)


def similar_titles(spark, d):
    """Character Jaccard similarity of each page's first two lines."""
    rows = spans(spark, d).filter("line_idx < 2").groupBy("book", "page_num").agg(F.max(F.when(F.col("line_idx") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("line_idx") == 1, F.col("text"))).alias("b"))
    return rows.filter("b is not null").select("book", "page_num", T.char_jaccard(F.col("a"), F.col("b")).alias("sim"))


def corrections(spark, d):
    """Dictionary corrections one after the other, and how often the first one applied."""
    pairs = [("the", "teh"), ("teh ", "the "), ("ing", "in")]
    rows = spans(spark, d).select(*LINE, "text")
    n = ((F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))) / 3).cast("int")
    return rows.select(*LINE, folds.corrected(F.col("text"), pairs).alias("fixed"), n.alias("n_first"))


def poetry(spark, d):
    """Whether pages' first lines have the rhythm of verse, by characters modulo a small number so that some do."""
    n = F.when(F.length("text") % 3 == 0, 5).when(F.length("text") % 3 == 1, 7).otherwise(T.meter_length(F.col("text")) % 2 * 2 + 5)
    rows = spans(spark, d).filter("line_idx < 4").withColumn("n", n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "n"))), lambda x: x["n"])
    return rows.groupBy("book", "page_num").agg(items.alias("ns")).select("book", "page_num", T.poetry_rhythm(F.col("ns")).alias("verse"))


POETRY_SQL = (
    W
    + r""", n AS (SELECT book, page_num, line_idx, CASE WHEN length(text) % 3 = 0 THEN 5 WHEN length(text) % 3 = 1 THEN 7
  ELSE length(regexp_replace(text, '[\s　\x{2000}-\x{200b}，。？！、；：“”‘’（）《》〈〉【】—…·\-.,;:!?''"()\[\]{}]+', '', 'g')) % 2 * 2 + 5 END AS n FROM spans WHERE line_idx < 4),
g AS (SELECT book, page_num, list(n ORDER BY line_idx) AS ns FROM n GROUP BY book, page_num)
SELECT book, page_num, len(ns) >= 3 AND (len(list_filter(ns, lambda x: x <> 5)) = 0 OR len(list_filter(ns, lambda x: x <> 7)) = 0 OR ns = [5, 7, 5, 7] OR ns = [7, 5, 7, 5]) AS verse FROM g"""
)


def joined(spark, d):
    """Lines of a page joined as one paragraph."""
    rows = folds.gathered(spans(spark, d).withColumn("text", F.concat(F.when(F.col("line_idx") % 5 == 2, "連").otherwise(""), "text", F.when(F.col("line_idx") % 4 == 1, "-").otherwise(""))), ["book", "page_num"], ["line_idx"], ["text"])
    return rows.select("book", "page_num", F.sha2(folds.joined_lines(F.transform("items", lambda x: x["text"])), 256).alias("joined"))


_TIGHT = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}！-｠￠-￮‘-‟]"
JOINED_SQL = (
    W
    + rf""", r AS (SELECT book, page_num, line_idx, trim(CASE WHEN line_idx % 5 = 2 THEN '連' ELSE '' END || text || CASE WHEN line_idx % 4 = 1 THEN '-' ELSE '' END) AS x FROM spans),
g AS (SELECT book, page_num, list_prepend('', coalesce(list(x ORDER BY line_idx) FILTER (x <> ''), [])) AS l FROM r GROUP BY book, page_num)
SELECT book, page_num, sha256(list_reduce(l, lambda a, x: CASE WHEN a = '' THEN x WHEN regexp_matches(a, '{_TIGHT}$') OR regexp_matches(x, '^{_TIGHT}') OR ends_with(a, '-') THEN a || x ELSE a || ' ' || x END)) AS joined FROM g"""
)
REDACTED_SQL = r"""substr(trim(regexp_replace(regexp_replace('at /usr/lib/x/y.py ''q'' ' || t, '(?:[A-Za-z]:)?[\\/](?:[^\s\\/:]+[\\/])+[^\s\\/:]*', '<path>', 'g'), '["''\r\n]+', ' ', 'g')), 1, 60)"""


def brackets(spark, d):
    """Brackets left open in lines with some put in."""
    seed = F.element_at(F.array(*(F.lit(x) for x in ("（a【b】", "（【）", "（《【》", "）」", "「『』", "[({", "a"))), (F.col("line_idx") % 7 + 1).cast("int"))
    return spans(spark, d).select(*LINE, F.array_join(folds.open_brackets(F.concat(seed, "text")), "").alias("open"))


_SEEDS = "['（a【b】', '（【）', '（《【》', '）」', '「『』', '[({', 'a']"
_OPENER = f"translate(ch, '{folds.CLOSE}', '{folds.OPEN}')"
BRACKETS_SQL = (
    W
    + rf""", r AS (SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, regexp_replace(list_extract({_SEEDS}, CAST(line_idx % 7 + 1 AS BIGINT)) || text, '[^（(《〈“‘【\[「『{{）)》〉”’】\]」』}}]', '', 'g') AS m FROM spans)
SELECT book, page_num, line_idx, list_reduce(list_prepend('', string_split(m, '')), lambda a, ch: CASE WHEN ch = '' THEN a WHEN NOT contains('{folds.CLOSE}', ch) THEN a || ch
 WHEN contains(a, {_OPENER}) THEN substr(a, 1, length(a) - strpos(reverse(a), {_OPENER})) ELSE a END) AS open FROM r"""
)


def hallucinations(spark, d):
    return table(spark, d, "documents").filter(T.hallucinated(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


def few_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", T.few_distinct(F.substring("text", 1, 200)).alias("v"))


def few_chars_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", T.few_distinct(F.col("text")).alias("v"))


LABELS = (" PageFooter", "list-item", "Section-Header ", "", "Table", "SECTIONHEADER", "textinlinemath", "Text")


def labels(spark, d):
    """Labels of layout models, some with a book's name in them."""
    pick = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("line_idx") % len(LABELS) + 1).cast("int"))
    label = F.concat(pick, F.when(F.col("page_num") % 3 == 0, F.col("book")).otherwise(""))
    return spans(spark, d).select(*LINE, T.layout_label(label).alias("v"))


_QUOTED = ", ".join(f"'{x}'" for x in LABELS)
LABELS_SQL = f"""{W}, r AS (SELECT *, trim(lower(list_extract([{_QUOTED}], CAST(line_idx % {len(LABELS)} + 1 AS BIGINT)) || CASE WHEN page_num % 3 = 0 THEN book ELSE '' END)) AS n FROM spans)
SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN n = '' OR n IN ({', '.join(f"'{x}'" for x in T.PAGE_LABELS_AS_TEXT)}) THEN 'text' WHEN n IN ('sectionheader', 'section-header') THEN 'section-header' ELSE n END AS v FROM r"""

_M = STRIP.format("t")
MARKER_TYPE_SQL = rf"""CASE WHEN {_M} = '' THEN 'empty' WHEN regexp_matches({_M}, '^[①-⓿➀-➓㉑-㉟]') THEN 'circled' WHEN regexp_matches({_M}, '^[\[［〔【]') THEN 'bracket' WHEN regexp_matches({_M}, '^[⁰¹²³⁴⁵⁶⁷⁸⁹]') THEN 'superscript'
 WHEN starts_with({_M}, '注') THEN 'zhu' WHEN regexp_matches({_M}, '^[(（]') THEN 'paren' WHEN regexp_matches({_M}, '^[a-jA-J]') THEN 'alpha' ELSE 'dot' END"""
_K = "(CASE WHEN line_idx % 2 = 0 THEN s ELSE t END)"
MARKER_NUMBER_SQL = rf"""CASE WHEN regexp_matches({_K}, '^[①-⑳]$') THEN unicode({_K}) - 9311 WHEN regexp_matches({_K}, '[⁰¹²³⁴⁵⁶⁷⁸⁹]') THEN TRY_CAST(translate(regexp_replace({_K}, '[^⁰¹²³⁴⁵⁶⁷⁸⁹]', '', 'g'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS INTEGER)
 WHEN regexp_matches({_K}, '[a-zA-Z]') THEN unicode(lower(regexp_extract({_K}, '[a-zA-Z]'))) - 96 WHEN regexp_matches({_K}, '\d') THEN TRY_CAST(regexp_extract({_K}, '\d+') AS INTEGER) ELSE 1 END"""
CAPTION_TYPE_SQL = rf"CASE WHEN regexp_matches({_M}, '(?i)^(?:表|table)\s*[\d\-.]+') THEN 'table' WHEN regexp_matches({_M}, '(?i)^(?:图|圖|figure)\s*[\d\-.]+') THEN 'figure' END"


def numerals(spark, d):
    """Numbers of pages written in digits, as CJK digits one by one, and with tens and hundreds, read back."""
    n = (F.col("page_num") % 999 + 1).cast("int")
    digit = lambda x: F.substring(F.lit("零一二三四五六七八九"), x + 1, F.lit(1))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    tens = F.when(t > 0, F.concat(digit(t), F.lit("十"))).when((h > 0) & (u > 0), "零").otherwise("")
    formal = F.concat(F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""), tens, F.when(u > 0, digit(u)).otherwise(""))
    one_by_one = F.translate(n.cast("string"), "0123456789", "〇一二三四五六七八九")
    written = F.when(F.col("line_idx") % 3 == 0, n.cast("string")).when(F.col("line_idx") % 3 == 1, one_by_one).otherwise(formal)
    text = F.when(F.col("line_idx") % 5 == 4, F.concat("text", written)).otherwise(F.concat(F.lit(" 第"), written, F.lit("页")))
    return spans(spark, d).select(*LINE, T.numeral(text).alias("v"))


#: What was written is read back; a line of text is no number.
NUMERALS_SQL = W + " SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, CAST(CASE WHEN line_idx % 5 < 4 OR text = '' THEN page_num % 999 + 1 END AS INTEGER) AS v FROM spans"


def circled(spark, d):
    return seeded(spark, d).select(*LINE, T.circled_number((F.col("page_num") % 60).cast("int")).alias("v"))


def payload(spark, d):
    """A field of the events' JSON payload."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


QUERIES = {
    "flt_strong_citation": (_line(lambda: T.strong_citation(t())), _sql(r"regexp_matches(t, '\[[A-Z]+(?:/[A-Z]+)?\]|出版社|出版|Press|\d{4}\s*年|\d{4}\s*[:：]\s*\d+|第\s*\d+\s*页|[Pp]\.?\s*\d+|参阅|参见|转引自|主编')")),
    "flt_terminal_punctuation": (lines_profile, W + rf" SELECT book, page_num, count(*) AS n_lines, count(*) FILTER (regexp_matches({STRIP.format('text')}, '{PUNCT}')) AS n_terminal FROM spans GROUP BY book, page_num"),
    "flt_continuing_punctuation": (_line(lambda: T.continuing_punctuation(t())), _sql(rf"regexp_matches({STRIP.format('t')}, '[，、：:,]$')")),
    "flt_hallucination": (hallucinations, None),
    "flt_few_distinct_characters": (few_chars, "SELECT doc_id, length(x) > 15 AND len(list_distinct(string_split(x, ''))) / length(x) < 0.15 AS v FROM (SELECT doc_id, substr(text, 1, 200) AS x FROM documents)"),
    "flt_few_distinct_characters_whole": (few_chars_whole, "SELECT doc_id, length(text) > 15 AND len(list_distinct(string_split(text, ''))) / length(text) < 0.15 AS v FROM documents"),
    "flt_non_prose_item": (_line(lambda: T.non_prose(t(), F.when(F.col("line_idx") % 13 == 0, "Figure").otherwise("text"))), _sql("length(t) = 0 OR line_idx % 13 = 0 OR starts_with(t, '#') OR starts_with(t, '![') OR starts_with(t, '>') OR starts_with(t, '|') OR starts_with(t, '[^')")),
    "scl_layout_label": (labels, LABELS_SQL),
    "scl_marker_type": (_line(lambda: T.marker_type(t())), _sql(MARKER_TYPE_SQL)),
    "scl_marker_number": (_line(lambda: T.marker_number(F.when(F.col("line_idx") % 2 == 0, s()).otherwise(t()))), _sql(MARKER_NUMBER_SQL)),
    "scl_numeral": (numerals, NUMERALS_SQL),
    "scl_circled_number": (circled, W + " SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, CASE WHEN n BETWEEN 1 AND 20 THEN chr(CAST(9311 + n AS INTEGER)) WHEN n BETWEEN 21 AND 35 THEN chr(CAST(12860 + n AS INTEGER)) WHEN n BETWEEN 36 AND 50 THEN chr(CAST(12941 + n AS INTEGER)) ELSE '(' || n || ')' END AS v FROM (SELECT *, page_num % 60 AS n FROM spans)"),
    "scl_kaiti_font": (_line(lambda: T.kaiti_font(F.col("font_family"))), _sql("font_family = 'KaiTi'")),
    "scl_title_font": (_line(lambda: T.title_font(F.col("font_family"))), _sql("font_family = 'SimHei'")),
    "scl_normal_title": (_line(lambda: T.normal_title(t())), _sql(r"translate(regexp_replace(t, '[\s　①-⑳]+', '', 'g'), '０１２３４５６７８９．：', '0123456789.:')")),
    "scl_char_jaccard": (similar_titles, W + f", g AS (SELECT book, page_num, max(CASE WHEN line_idx = 0 THEN text END) AS a, max(CASE WHEN line_idx = 1 THEN text END) AS b FROM spans WHERE line_idx < 2 GROUP BY book, page_num) SELECT book, page_num, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE len(list_intersect({CHARS.format('a')}, {CHARS.format('b')})) / len(list_distinct(list_concat({CHARS.format('a')}, {CHARS.format('b')}))) END AS sim FROM g WHERE b IS NOT NULL"),
    "scl_skeleton": (_line(lambda: T.skeleton(F.concat(F.lit('::: {custom-style="Q"}\n'), t(), F.lit("![x](y.png){width=1}\n:::")))), _sql(r"regexp_replace(t, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}A-Za-z0-9]', '', 'g')")),
    "scl_redact": (_line(lambda: T.redact(F.concat(F.lit("at /usr/lib/x/y.py 'q' "), t()), 60)), _sql(REDACTED_SQL)),
    "scl_katex_fence": (_line(lambda: T.katex_fence(s(), F.col("line_idx") % 2 == 0)), _sql("CASE WHEN trim(s) = '' THEN '' WHEN line_idx % 2 = 0 THEN '$$' || chr(10) || trim(s) || chr(10) || '$$' ELSE '$' || trim(s) || '$' END")),
    "scl_caption_type": (_line(lambda: T.caption_type(t())), _sql(CAPTION_TYPE_SQL)),
    "scl_short_hash": (_line(lambda: T.short_hash(t())), _sql("substr(sha256(t), 1, 16)")),
    "scl_pipe_table": (_line(lambda: T.to_pipe_table(F.concat(F.lit("a  b  c\n"), "text", F.lit("\tz")))), None),
    "scl_image_width": (_line(lambda: T.sized_images(F.concat(F.lit("![__p__](a.png) "), F.substring("text", 1, 10), F.lit(" ![b](c.png){width=1}")))), _sql("'![](a.png){width=60%} ' || substr(text, 1, 10) || ' ![b](c.png){width=1}'")),
    "scl_payload_extract": (payload, "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events"),
    "scl_suspicious_chars": (suspicious, SUSPICIOUS_SQL),
    "scl_suspicious_chars_whole": (suspicious_whole, None),
    "snk_rare_char_report": (rare_report, f"SELECT kind, ch, count(*) AS n, count(DISTINCT (book, page_num)) AS n_pages FROM ({SUSPICIOUS_SQL}) GROUP BY kind, ch"),
    "src_char_boxes": (char_boxes, W + ", c AS (SELECT *, unnest(range(0, length(text))) AS pos FROM spans WHERE line_idx = 0) SELECT book, page_num, CAST(pos AS INTEGER) AS pos, substr(text, pos + 1, 1) AS ch, x0 + (x1 - x0) / length(text) * pos AS cx0, x0 + (x1 - x0) / length(text) * (pos + 1) AS cx1 FROM c"),
    "agg_dictionary_corrections": (corrections, W + " SELECT book, page_num, CAST(line_idx AS INTEGER) AS line_idx, replace(replace(replace(text, 'the', 'teh'), 'teh ', 'the '), 'ing', 'in') AS fixed, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n_first FROM spans"),
    "seq_poetry_rhythm": (poetry, POETRY_SQL),
    "seq_join_lines": (joined, JOINED_SQL),
    "seq_open_brackets": (brackets, BRACKETS_SQL),
}
