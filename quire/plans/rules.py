"""Queries of the rules about citations, endings, headings, styles, reviews and stitched lines, and their SQL.

Lines get planted beginnings and ends by their number; both sides compute the
rule on the whole text that results.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import rules as R, text as T
from ..operators import folds, footnotes, stitching
from ..sources import config
from ..sources.tables import BOXES_SQL, PAGE_WIDTH, SPANS_SQL, boxes, spans, table

W, B = f"WITH {SPANS_SQL}", f"WITH {BOXES_SQL}"
LINE = ["book", "page_num", "line_idx"]
L_SQL = "book, page_num, CAST(line_idx AS INTEGER) AS line_idx"
TAILS = ("", "：", " p.", "第", " 1998年", " 12,", "[M].", " http://a.b/c", " www.x", "。", "①", "？[3]", "等", " Fig.", " et al.", " e.g.", " 1998．", "”", "!)", "[^p1_2]")
HEADS = ("", "第三章 ", "1.2 ", "三、", "（二）", "Chapter 4 ", "附录", "表 3-1 ", "## ", "楔子", "的 ", "3.4.5 ")
MARKERS = ("1998.", "12.", "①", "2050、", "3、", "1700.", "7 ", "(2)")
ENDS = r"'^\s+|\s+$', '', 'g'"


def pick(options, by="line_idx"):
    return F.element_at(F.array(*(F.lit(x) for x in options)), (F.col(by) % len(options) + 1).cast("int"))


def pick_sql(options, by="line_idx"):
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in options)
    return f"list_extract([{quoted}], CAST({by} % {len(options)} + 1 AS BIGINT))"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Whole lines with a planted end (t), a planted beginning (h) and both short (s: the line's first word).
SEED_SQL = f", seeded AS (SELECT *, text || {pick_sql(TAILS)} AS t, {pick_sql(HEADS)} || text AS h, {pick_sql(HEADS)} || string_split(text, ' ')[1] AS s FROM spans)"


def seeded(spark, d):
    head = pick(HEADS)
    return spans(spark, d).withColumns({"t": F.concat("text", pick(TAILS)), "h": F.concat(head, "text"), "s": F.concat(head, F.get(F.split("text", " "), F.lit(0)))})


def line_query(make, column="v"):
    return lambda spark, d: seeded(spark, d).select(*LINE, make().alias(column))


def line_sql(expr, column="v"):
    return f"{W}{SEED_SQL} SELECT {L_SQL}, {expr} AS {column} FROM seeded"


c = F.col


def after_citation(spark, d):
    rows = seeded(spark, d).withColumns({"before": F.when(c("line_idx") % 3 == 0, "  ").otherwise(c("t")), "context": F.when(c("line_idx") % 4 == 0, "").otherwise(c("t"))})
    return rows.select(*LINE, R.after_citation(c("before"), c("context")).alias("v"))


AFTER_SQL = (
    W
    + SEED_SQL
    + rf""", b AS (SELECT *, CASE WHEN line_idx % 3 = 0 THEN '  ' ELSE t END AS p, CASE WHEN line_idx % 4 = 0 THEN '' ELSE t END AS k FROM seeded),
r AS (SELECT *, regexp_replace(CASE WHEN regexp_replace(p, {ENDS}) = '' AND k <> '' THEN k || ' ' || p ELSE p END, '\s+$', '') AS x FROM b)
SELECT {L_SQL}, regexp_matches(x, {q(R.CITED)}) OR regexp_matches(x, {q(R.URL_TAIL + '|' + R.ASCII_TAIL)}) AS v FROM r"""
)


def continuation(spark, d):
    w = Window.partitionBy("book", "page_num").orderBy("line_idx")
    rows = seeded(spark, d).withColumns({"marker": pick(MARKERS), "previous": F.lag("t").over(w)})
    number = F.coalesce(F.try_to_number(F.regexp_extract("marker", r"\d+", 0), F.lit("9999")).cast("int"), F.lit(1))
    return rows.select(*LINE, R.continues_citation(c("marker"), number, c("previous")).alias("v"))


CONTINUATION_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, {pick_sql(MARKERS)} AS m, lag(t) OVER (PARTITION BY book, page_num ORDER BY line_idx) AS p FROM seeded),
n AS (SELECT *, coalesce(try_cast(regexp_extract(m, '\d+') AS INTEGER), 1) AS k FROM r)
SELECT {L_SQL}, (k BETWEEN 1800 AND 2100 AND regexp_matches(m, '^\d{{4}}[.、]')) OR (coalesce(p, '') <> '' AND regexp_full_match(m, '[\d.、\s]+') AND coalesce(regexp_matches(p, {q(R.CITED)}) OR regexp_matches(p, {q(R.URL_TAIL)}), false)) AS v FROM n"""
)

_LEVEL = rf"""(CASE WHEN length(x) = 0 OR length(x) > 25 OR contains('{R.HEAD_ENDS}', right(x, 1)) OR regexp_matches(x, '[。！？].') OR regexp_matches(x, {q(R.CAPTION)}) THEN 0
  {{toc}} WHEN {' OR '.join(f'regexp_matches(x, {q(p)})' for p in R.HEAD_1)} THEN 1 WHEN {' OR '.join(f'regexp_matches(x, {q(p)})' for p in R.HEAD_2)} THEN 2 WHEN {' OR '.join(f'regexp_matches(x, {q(p)})' for p in R.HEAD_3)} THEN 3
  WHEN abs((x0 + x1) / 2 - {PAGE_WIDTH} / 2) < {PAGE_WIDTH * 0.1} AND length(x) < 20 AND w < 2 THEN 2
  WHEN bold AND length(x) < 20 AND w < 2 AND NOT regexp_matches(x, '[的了]$') THEN 3 ELSE 0 END)"""
_WORDS = f"length(regexp_replace(x, '[^{R.BODY_WORDS[1:]}', '', 'g')) + length(regexp_replace(x, '[^從]', '', 'g'))"


def block_level(spark, d):
    toc = F.when(c("page_num") % 7 == 0, (c("line_idx") % 4).cast("int"))
    v = R.block_level(c("s"), F.lit(1), c("font_flags") == 16, c("x0"), c("x1"), PAGE_WIDTH, toc)
    return seeded(spark, d).select(*LINE, v.alias("v"))


LEVEL_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, regexp_replace(s, {ENDS}) AS x, font_flags = 16 AS bold FROM seeded), k AS (SELECT *, {_WORDS} AS w FROM r)
SELECT {L_SQL}, {_LEVEL.format(toc="WHEN page_num % 7 = 0 AND line_idx % 4 > 0 THEN CAST(line_idx % 4 AS INTEGER)")} AS v FROM k"""
)


def heading_like(spark, d):
    return seeded(spark, d).select(*LINE, R.heading_like(c("s"), c("x0"), c("x1"), PAGE_WIDTH).alias("v"))


LIKE_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, regexp_replace(regexp_replace(s, '^#+', ''), {ENDS}) AS x, false AS bold FROM seeded), k AS (SELECT *, {_WORDS} AS w FROM r)
SELECT {L_SQL}, starts_with(s, '#') OR (x <> '' AND (regexp_matches(x, {q(R.HEAD_PREFIX)}) OR {_LEVEL.format(toc='')} > 0
  OR (length(x) <= 20 AND NOT regexp_matches(x, {q(R.HEADLIKE_STOPS)}) AND len(list_distinct(regexp_extract_all(x, '[{R.HEAD_WORDS}]'))) <= 1))) AS v FROM k"""
)


def geometric(spark, d):
    v = R.geometric_level(c("h"), c("font_family"), c("font_flags"), c("font_size"), "SimSun", 10.5, c("x0"), c("x1"), 60.0, PAGE_WIDTH)
    return seeded(spark, d).select(*LINE, v.alias("v"))


GEOMETRIC_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, regexp_matches(lower(font_family), '{R.BOLD_FONTS}') OR font_flags & 16 <> 0 AS bold, NOT regexp_matches(lower(font_family), '{R.LATIN_FONTS}') AND lower(font_family) <> 'simsun' AS other,
  abs((x0 + x1) / 2 - {PAGE_WIDTH} / 2) < {PAGE_WIDTH * 0.12} AND x0 > 70 AND abs(x0 - ({PAGE_WIDTH} - x1)) < {max(25.0, PAGE_WIDTH * 0.08)} AS mid, regexp_matches(h, '[的了在]$') AS e FROM seeded)
SELECT {L_SQL}, CASE WHEN regexp_matches(h, '{R.CHART_END}') OR regexp_matches(h, '^[①-⑩]') THEN 0 WHEN font_size >= 12 OR (mid AND font_size >= 11) THEN 2
  WHEN bold AND (other OR font_size >= 10.5) AND NOT e THEN 3 WHEN mid AND (bold OR other) AND font_size >= 10 AND NOT e THEN 2 ELSE 0 END AS v FROM r"""
)

PLAIN_SQL = rf"regexp_replace(regexp_replace(regexp_replace(t, {q(R.REF_TAGS)}, ''), '\s+$', ''), {q(R.TRAILING_MARKS)}, '')"
TERMINAL_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, {PLAIN_SQL} AS x FROM seeded), k AS (SELECT *, regexp_replace(regexp_replace(x, {q(R.CLOSING)}, ''), '\s+$', '') AS y FROM r)
SELECT {L_SQL}, regexp_matches(x, {q(R.TERMINAL_END)}) OR (ends_with(y, '.') AND NOT regexp_matches(y, {q(R.ABBREVIATION)})) AS v FROM k"""
)

URLS = ("http://localhost:11434//", "http://10.1.2.3/x", "https://192.168.0.9:8080", "http://172.", "", None, "page")


def addresses(spark, d):
    n = c("page_id") % 6
    url = F.when(n == 0, URLS[0]).when(n == 1, URLS[1]).when(n == 2, URLS[2]).when(n == 3, F.concat(F.lit(URLS[3]), (c("page_id") % 40).cast("string"), F.lit(".0.1/"))).when(n == 4, "").otherwise(c("url"))
    return table(spark, d, "pages").select("page_id", R.local_address(url).alias("address"))


ADDRESS_SQL = rf"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '{URLS[0]}' WHEN 1 THEN '{URLS[1]}' WHEN 2 THEN '{URLS[2]}' WHEN 3 THEN '{URLS[3]}' || (page_id % 40) || '.0.1/' WHEN 4 THEN '' ELSE url END AS url FROM pages),
h AS (SELECT *, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)', 1)) AS h FROM u)
SELECT page_id, CASE WHEN h = '' THEN '{R.LOCAL_DEFAULT}' WHEN h IN ('localhost', '127.0.0.1', '0.0.0.0') OR regexp_matches(h, {q(R.PRIVATE_HOST)}) THEN regexp_replace(url, '/+$', '') END AS address FROM h"""


def degenerate(spark, d):
    width, height, contrast = (c("x1") - c("x0")) % 9, (c("y1") - c("y0")) % 7, (c("x0") % 8).cast("int")
    return boxes(spark, d).select("page_id", "seq", R.degenerate(width, height, contrast).alias("v"))


DEGENERATE_SQL = f"{B} SELECT page_id, seq, (x1 - x0) % 9 < 2 OR (y1 - y0) % 7 < 2 OR CAST(x0 % 8 AS INTEGER) < 3 AS v FROM boxes"

BOUNDS = ((0.0, 90.0), (100.0, 180.0), (170.0, 260.0), (300.0, 420.0))


def columns(spark, d):
    bounds = F.array(*(F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in BOUNDS))
    return boxes(spark, d).select("page_id", "seq", R.column_of((c("x0") + c("x1")) / 2, bounds).cast("int").alias("col"))


_MIDDLES = ", ".join(f"abs(m - {(a + b) * 0.5})" for a, b in BOUNDS)
COLUMNS_SQL = f"""{B}, c AS (SELECT page_id, seq, (x0 + x1) / 2 AS m FROM boxes), f AS (SELECT *, [{_MIDDLES}] AS far FROM c)
SELECT page_id, seq, CAST(CASE {' '.join(f'WHEN m BETWEEN {a} AND {b} THEN {i}' for i, (a, b) in enumerate(BOUNDS))} ELSE list_position(far, list_min(far)) - 1 END AS INTEGER) AS col FROM f"""


def tolerance(spark, d):
    return spans(spark, d).groupBy("book", "page_num").agg(R.footer_tolerance(F.max("font_size")).alias("v"))


def unwrapped(spark, d):
    n = c("line_idx") % 4
    block = F.when(n == 0, F.concat(R.styled(c("text"), F.lit("Body 2")), F.lit("[^p1_2] [^p1_3]"))).when(n == 1, R.styled(c("t"), F.lit("楷體2"))).when(n == 2, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(c("t"))
    return seeded(spark, d).select(*LINE, R.unwrapped(block).alias("u")).select(*LINE, "u.text", "u.style", "u.tags")


UNWRAPPED_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, line_idx % 4 AS n FROM seeded)
SELECT {L_SQL}, CASE WHEN n IN (0, 2) THEN regexp_replace(text, {ENDS}) ELSE regexp_replace(t, {ENDS}) END AS text, CASE n WHEN 0 THEN 'Body 2' WHEN 1 THEN '楷體2' END AS style, CASE n WHEN 0 THEN '[^p1_2] [^p1_3]' ELSE '' END AS tags FROM r"""
)


def blocks(spark, d):
    """A line as body, caption and heading block, in the style of its font if that has one, and spliced with the line before."""
    style = F.when(c("font_family") == "KaiTi", "楷體2").when(c("line_idx") % 2 == 0, "").when(c("line_idx") % 3 == 0, "Body")
    w = Window.partitionBy("book", "page_num").orderBy("line_idx")
    rows = seeded(spark, d).withColumns({"style": style, "before": F.coalesce(F.lag("t").over(w), F.lit(""))})
    return rows.select(
        *LINE, R.styled(c("text"), c("style")).alias("body"), R.caption_block(c("text"), c("style")).alias("caption"),
        R.trailing_heading(c("h"), c("style")).alias("heading"), R.spliced(c("before"), c("h")).alias("spliced"),
    )


BLOCKS_SQL = (
    W
    + SEED_SQL
    + rf""", r AS (SELECT *, CASE WHEN font_family = 'KaiTi' THEN '楷體2' WHEN line_idx % 2 = 0 THEN '' WHEN line_idx % 3 = 0 THEN 'Body' END AS style, coalesce(lag(t) OVER (PARTITION BY book, page_num ORDER BY line_idx), '') AS b FROM seeded),
k AS (SELECT *, coalesce(style, '') <> '' AS has, '::: {{custom-style="' || style || '"}}' || chr(10) || text || chr(10) || ':::' AS full_block FROM r)
SELECT {L_SQL}, CASE WHEN has THEN full_block ELSE text END AS body, CASE WHEN has THEN full_block ELSE '*' || text || '*' END AS caption,
 CASE WHEN regexp_matches(h, {q(R.DECIMAL_3)}) THEN '### ' ELSE '## ' END || h || CASE WHEN has THEN ' {{custom-style="' || style || '"}}' ELSE '' END AS heading,
 CASE WHEN b = '' THEN h WHEN regexp_matches(b, '{R.CJK_EDGE}$') AND regexp_matches(h, '^{R.CJK_EDGE}') THEN b || h ELSE b || ' ' || h END AS spliced FROM k"""
)

ROLES = ("H1", "h2", " Caption ", "quote", "unknown", "", "H9", "正文")
STYLES = ("Heading 1", "標題2", "Body", "heading 3 x", "圖說", None, "KaiTi 2", "plain")


def mapped(spark, d):
    """Roles and styles that fonts may be given: the role meant, the level it states and the key of its style."""
    rows = spans(spark, d).withColumns({"role": pick(ROLES), "style": pick(STYLES, "page_num")})
    level = R.mapped_level(c("role"), c("style"), c("line_idx") % 11 == 10)
    return rows.select(*LINE, R.font_role(c("role")).alias("role"), level.alias("level"), R.style_key(c("role"), c("style")).alias("key"))


def _lookup(table, of):
    return f"CASE lower({of}) " + " ".join(f"WHEN '{n.lower()}' THEN '{k}'" for k, names in table.items() for n in names) + " END"


_NULLABLE = "list_extract([" + ", ".join("NULL" if x is None else f"'{x}'" for x in STYLES) + f"], CAST(page_num % {len(STYLES)} + 1 AS BIGINT))"
MAPPED_SQL = (
    W
    + rf""", r AS (SELECT *, {pick_sql(ROLES)} AS role, {_NULLABLE} AS style FROM spans)
SELECT {L_SQL}, {_lookup({k: (k, *v) for k, v in R.FONT_ROLES.items()}, "trim(role)")} AS role,
 CASE WHEN line_idx % 11 = 10 THEN 0 WHEN role <> '' THEN CASE WHEN upper(role) IN ('H1', 'H2', 'H3') THEN CAST(substr(role, 2, 1) AS INTEGER) ELSE 0 END
  {' '.join(f"WHEN regexp_matches(style, {q(p)}) THEN {k}" for k, p in R.STYLE_LEVELS.items())} ELSE 0 END AS level,
 coalesce({_lookup(R.STYLE_KEYS, "trim(role)")}, CASE {' '.join(f"WHEN regexp_matches(style, {q(p)}) THEN '{k}'" for k, p in R.STYLE_NAMES.items())} END) AS key FROM r"""
)

#: A model's names that stand for another.
ALIASES = {"fast-old": "fast-2", "fast-old-lite": "fast-2-lite"}


def model_names(spark, d):
    name = F.when(c("doc_id") % 4 == 0, " Fast-OLD ").when(c("doc_id") % 4 == 1, "fast-old-lite").when(c("doc_id") % 4 == 2, "").otherwise(c("source"))
    return table(spark, d, "documents").select("doc_id", R.model_name(name, ALIASES, "fast-2").alias("model"))


MODEL_SQL = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fast-2' WHEN 1 THEN 'fast-2-lite' WHEN 2 THEN 'fast-2' ELSE source END AS model FROM documents"


def fragments(spark, d):
    """Lines cut into pieces of 20 characters with gaps of 10, 18 and 2."""
    rows = spans(spark, d).filter(F.length("text") > 0)
    rows = rows.select("book", "page_num", "y0", "y1", "font_size", F.posexplode(F.expr("transform(sequence(0, (length(text) - 1) div 20), k -> substr(text, k * 20 + 1, 20))")).alias("k", "text"))
    x0 = F.lit(60.0) + 150.0 * c("k") + F.when(c("k") % 3 == 2, 8.0).otherwise(0.0)
    return rows.withColumn("x0", x0).withColumn("x1", c("x0") + 140.0)


def stitched(spark, d):
    out = stitching.stitched(fragments(spark, d), ["book", "page_num"])
    return out.select("book", "page_num", "text", "x0", "x1", "y0", "n")


_CJK_SQL = r"[\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
STITCHED_SQL = (
    W
    + rf""", p AS (SELECT book, page_num, y0, font_size, k, substr(text, k * 20 + 1, 20) AS x, 60.0::DOUBLE + 150.0 * k + CASE WHEN k % 3 = 2 THEN 8.0 ELSE 0.0 END AS x0
  FROM (SELECT *, unnest(range(0, (length(text) - 1) // 20 + 1)) AS k FROM spans WHERE length(text) > 0)),
g AS (SELECT *, x0 - 140.0 - lag(x0) OVER w AS gap, lag(x) OVER w AS l, font_size >= 10.5 * 0.8 AS big FROM p WINDOW w AS (PARTITION BY book, page_num, y0 ORDER BY k)),
s AS (SELECT *, gap IS NULL OR gap > 10.5 * 1.2 AS new FROM g),
n AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY book, page_num, y0 ORDER BY k) AS grp,
  CASE WHEN NOT new AND gap > 2.625 AND big AND regexp_matches(l, '\S$') AND regexp_matches(x, '^\S') AND NOT regexp_matches(l, '{_CJK_SQL}$') AND NOT regexp_matches(x, '^{_CJK_SQL}') THEN ' ' ELSE '' END AS sp FROM s)
SELECT book, page_num, string_agg(sp || x, '' ORDER BY k) AS text, min(x0) AS x0, max(x0) + 140.0 AS x1, y0, CAST(count(*) AS INTEGER) AS n FROM n GROUP BY book, page_num, y0, grp"""
)


def profile(spark, d):
    """Body size and font of a book by the characters of its first 35 pages' longer spans."""
    rows = spans(spark, d)
    pages = rows.select("book", "page_num").distinct().withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy("page_num"))).filter("r <= 35")
    n = F.length(T.strip(c("text")))
    some = rows.join(pages.drop("r"), ["book", "page_num"]).filter(n >= 5)
    counts = some.groupBy("book", (F.round(c("font_size") * 2) / 2).alias("size"), F.lower("font_family").alias("font")).agg(F.sum(n).alias("n"))
    sizes = counts.groupBy("book", "size").agg(F.sum("n").alias("n")).groupBy("book").agg(F.min_by("size", F.struct(-c("n"), c("size"))).alias("body_size"))
    fonts = counts.groupBy("book", "font").agg(F.sum("n").alias("n")).groupBy("book").agg(F.min_by("font", F.struct(-c("n"), c("font"))).alias("body_font"))
    return sizes.join(fonts, "book")


PROFILE_SQL = (
    W
    + rf""", pg AS (SELECT book, page_num FROM (SELECT book, page_num, row_number() OVER (PARTITION BY book ORDER BY page_num) AS r FROM (SELECT DISTINCT book, page_num FROM spans)) WHERE r <= 35),
s AS (SELECT book, round(font_size * 2) / 2 AS size, lower(font_family) AS font, length(regexp_replace(text, {ENDS})) AS n FROM spans JOIN pg USING (book, page_num)),
k AS (SELECT * FROM s WHERE n >= 5), a AS (SELECT book, size, sum(n) AS n FROM k GROUP BY ALL), b AS (SELECT book, font, sum(n) AS n FROM k GROUP BY ALL)
SELECT book, body_size, body_font FROM (SELECT book, arg_min(size, (-n, size)) AS body_size FROM a GROUP BY book) JOIN (SELECT book, arg_min(font, (-n, font)) AS body_font FROM b GROUP BY book) USING (book)"""
)


def toc_index(spark, d):
    """Of contents entries with one normal title the last counts."""
    rows = spans(spark, d).withColumn("title", T.normal_title(F.get(F.split("text", " "), F.lit(0)))).filter("title <> ''")
    last = F.max_by(F.struct((c("line_idx") % 3 + 1).cast("int").alias("level"), c("page_num").alias("page")), F.struct("page_num", "line_idx"))
    return rows.groupBy("book", "title").agg(last.alias("e")).select("book", "title", "e.level", "e.page")


TOC_SQL = (
    W
    + r""", r AS (SELECT *, translate(regexp_replace(string_split(text, ' ')[1], '[\s　①-⑳]+', '', 'g'), '０１２３４５６７８９．：', '0123456789.:') AS title FROM spans)
SELECT book, title, arg_max(CAST(line_idx % 3 + 1 AS INTEGER), (page_num, line_idx)) AS level, arg_max(page_num, (page_num, line_idx)) AS page FROM r WHERE title <> '' GROUP BY book, title"""
)


def boundary_reviews(spark, d):
    """Answers about pairs of lines: those on known pairs, sure enough, the last of each."""
    lines = spans(spark, d).withColumn("id", F.concat_ws("-", "page_num", "line_idx"))
    known = lines.filter("line_idx > 0").select("id")
    sure = (c("page_num") * 7 + c("line_idx")) % 110 / 100
    answers = lines.filter("line_idx % 3 <> 1").select("id", "line_idx", F.when(c("line_idx") % 4 < 3, c("line_idx") % 2 == 0).alias("should_break"), sure.alias("confidence"))
    good = answers.filter("should_break is not null and confidence between 0.8 and 1")
    return good.join(known, "id").select("id", "should_break", "confidence")


BOUNDARY_SQL = (
    W
    + """, answers AS (SELECT *, page_num || '-' || line_idx AS id, ((page_num * 7 + line_idx) % 110) / 100 AS confidence FROM spans)
SELECT id, line_idx % 2 = 0 AS should_break, confidence FROM answers WHERE line_idx > 0 AND line_idx % 3 <> 1 AND line_idx % 4 < 3 AND confidence >= 0.8 AND confidence <= 1"""
)

SUGGESTED = ("H1", "caption", "nothing", "kaiti", "")


def font_suggestions(spark, d):
    """Suggestions for the fonts of books, checked against the styles there are, in three classes."""
    fonts = spans(spark, d).groupBy("book", "font_family").agg(F.count("*").alias("k"))
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("k") % 13) / 10)), 2)
    role = F.when(c("k") % 6 < 5, R.font_role(pick(SUGGESTED, "k")))
    style = F.when((c("k") % 6 < 5) & (c("k") % 4 < 2), F.concat(F.lit("Style "), c("font_family")))
    rows = fonts.withColumns({"role": role, "style": style, "given": F.when(c("k") % 6 < 5, sure)})
    none = c("role").isNull() & c("style").isNull()
    status = F.when(none, "no_suggestion").when(c("given") < 0.6, "low_confidence").otherwise("suggested")
    return rows.select("book", "font_family", "role", "style", c("given").alias("confidence"), status.alias("status"))


SUGGESTION_SQL = (
    W
    + rf""", f AS (SELECT book, font_family, count(*) AS k FROM spans GROUP BY ALL),
g AS (SELECT *, CASE WHEN k % 6 < 5 THEN {_lookup({k: (k, *v) for k, v in R.FONT_ROLES.items()}, pick_sql(SUGGESTED, "k"))} END AS role, CASE WHEN k % 6 < 5 AND k % 4 < 2 THEN 'Style ' || font_family END AS style, CASE WHEN k % 6 < 5 THEN round(least(1.0, (k % 13) / 10), 2) END AS confidence FROM f)
SELECT book, font_family, role, style, confidence, CASE WHEN role IS NULL AND style IS NULL THEN 'no_suggestion' WHEN confidence < 0.6 THEN 'low_confidence' ELSE 'suggested' END AS status FROM g"""
)


def style_rules(spark, d):
    """Rules (style and the first characters) from styled paragraphs of an edited page that hold, or lie in, one of the raw page."""
    raw = spans(spark, d).select("book", "page_num", T.strip(c("text")).alias("raw")).filter("raw <> ''")
    lines = spans(spark, d).filter("line_idx % 3 = 1").withColumn("style", pick(("Quote", "Note", "Body"), "page_num"))
    edited = lines.select("book", "page_num", "style", T.strip(F.when(c("line_idx") % 2 == 0, F.substring_index("text", " ", 3)).otherwise(F.concat("text", F.lit(" more")))).alias("inner_text")).filter("inner_text <> ''")
    met = edited.join(raw, ["book", "page_num"]).filter(F.contains("raw", "inner_text") | F.contains("inner_text", "raw"))
    start = F.substring(T.strip(F.regexp_replace("raw", r"(?U)^[#\s]+", "")), 1, 8)
    return met.select("book", "page_num", "style", start.alias("prefix")).filter(F.length("prefix") >= 2).distinct()


RULES_SQL = (
    W
    + rf""", r AS (SELECT book, page_num, regexp_replace(text, {ENDS}) AS raw FROM spans),
e AS (SELECT book, page_num, {pick_sql(("Quote", "Note", "Body"), "page_num")} AS style, regexp_replace(CASE WHEN line_idx % 2 = 0 THEN array_to_string(string_split(text, ' ')[1:3], ' ') ELSE text || ' more' END, {ENDS}) AS x FROM spans WHERE line_idx % 3 = 1),
m AS (SELECT DISTINCT book, page_num, style, substr(regexp_replace(regexp_replace(raw, '^[#\s]+', ''), {ENDS}), 1, 8) AS prefix FROM e JOIN r USING (book, page_num) WHERE x <> '' AND raw <> '' AND (contains(raw, x) OR contains(x, raw)))
SELECT * FROM m WHERE length(prefix) >= 2"""
)

FONTS_JSON = '{"SimHei": {"role": "H1", "docx_style": "%s"}, "KaiTi": "sample", "SimSun": {"role": "", "docx_style": "Body", "mapped_by": "user"}, "Old": {"role": "H2", "mapped_by": "legacy"}, "None": {"role": null}}'


def fonts_json(spark, d):
    """Fonts with a role or style that a person or model gave, from each book's file."""
    a, b = FONTS_JSON.split("%s")
    files = spans(spark, d).select("book").distinct().select("book", F.concat(F.lit(a), "book", F.lit(b)).alias("json"))
    return config.font_roles(files, "json").select("book", "font", "role", "docx_style", "mapped_by")


FONTS_SQL = (
    W
    + f""", f AS (SELECT DISTINCT book, replace('{FONTS_JSON}', '%s', book) AS j FROM spans), k AS (SELECT book, j, unnest(json_keys(j)) AS font FROM f),
v AS (SELECT book, font, json_extract_string(j, '$.' || font || '.role') AS role, json_extract_string(j, '$.' || font || '.docx_style') AS docx_style, json_extract_string(j, '$.' || font || '.mapped_by') AS mapped_by FROM k)
SELECT * FROM v WHERE (coalesce(role, '') <> '' OR coalesce(docx_style, '') <> '') AND coalesce(mapped_by, '') <> 'legacy'"""
)


def symbols(spark, d):
    return config.symbol_map(spark)


SYMBOLS_SQL = """SELECT 'circled_numbers' AS kind, CAST(i AS VARCHAR) AS symbol, chr(CAST(9311 + i AS INTEGER)) AS replacement FROM range(1, 21) AS r(i)
UNION ALL SELECT 'chinese_numerals', substr('一二三四五六七八九十', CAST(i AS BIGINT), 1), '（' || substr('一二三四五六七八九十', CAST(i AS BIGINT), 1) || '）' FROM range(1, 11) AS r(i)
UNION ALL SELECT 'numeric_range_tilde', '~', '～'"""

def linked(spark, d):
    """Footnote marks in pages: each page's text carries some marks of its notes, in brackets, circled or not at all."""
    docs = table(spark, d, "documents").select(c("source").alias("book"), (c("doc_id") + 1).alias("page_num"), "text")
    tail = F.expr("array_join(transform(sequence(1, 3), i -> concat('。', CASE (page_num + i) % 4 WHEN 0 THEN concat('[', i, ']') WHEN 1 THEN substr('①②③', i, 1) WHEN 2 THEN concat('【', i, '】') ELSE '' END)), '')")
    pages = docs.withColumn("text", F.concat(c("text"), tail))
    notes = docs.select("book", "page_num", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("id"))
    notes = notes.select("book", "page_num", "id", c("id").alias("seq"), F.when(c("id") == 2, "②").otherwise("※").alias("mark"))
    out = footnotes.linked(pages, notes, ["book"])
    return out.select("book", "page_num", F.sha2("text", 256).alias("digest"), "n_notes", "n_matched")


_TAGS = " || ".join(f"'。' || CASE WHEN (page_num + {i}) % 4 < 3 THEN '[^p' || page_num || '_{i}]' ELSE '' END" for i in (1, 2, 3))
LINKED_SQL = f"""WITH p AS (SELECT source AS book, doc_id + 1 AS page_num, text FROM documents)
SELECT book, page_num, sha256(text || {_TAGS}) AS digest, 3 AS n_notes, CAST({" + ".join(f"CASE WHEN (page_num + {i}) % 4 < 3 THEN 1 ELSE 0 END" for i in (1, 2, 3))} AS INTEGER) AS n_matched FROM p"""

OWN_ENDS = ("", "。", "，", " p. 3", "（未", "、", "”", " etc.", "-")


def _edges(spark, d):
    """First and last lines of pages, with planted ends, in the order of a book's pages."""
    rows = spans(spark, d).withColumn("text", F.concat(c("text"), pick(OWN_ENDS, "page_num"))).filter("text <> ''")
    at = lambda f, n: f(F.struct("text", "font_size", "x0", "x1"), "line_idx").alias(n)
    pages = rows.groupBy("book", "page_num").agg(at(F.min_by, "first"), at(F.max_by, "last"), F.max("x1").alias("far"))
    w = Window.partitionBy("book").orderBy("page_num")
    return pages.withColumns({"before": F.lag("last").over(w), "before_far": F.lag("far").over(w)})


def page_continuations(spark, d):
    """Whether a page goes on with the paragraph that the page before it ended in, and the text that results."""
    e = _edges(spark, d).filter("before is not null")
    names = {"a_text": "before.text", "a_size": "before.font_size", "a_x1": "before.x1", "a_far": "before_far", "b_text": "first.text", "b_size": "first.font_size", "b_raw": "first.text", "b_x1": "first.x1"}
    e = e.select("book", "page_num", *(c(v).alias(k) for k, v in names.items()), F.when(c("page_num") % 2 == 0, c("first.x0") - 21.0).otherwise(c("first.x0")).alias("b_x0"))
    e = e.withColumns({"a_style": F.lit(""), "b_style": F.when(c("page_num") % 5 == 0, "Note").otherwise(""), "a_lines": (c("page_num") % 3 + 1).cast("int"), "b_lines": F.lit(2)})
    e = e.withColumn("b_size", c("a_size") + (c("page_num") % 4) * 0.25).withColumn("open", R.unclosed(R.rstrip(T.strip(c("a_text"))), folds.open_brackets(T.strip(c("a_text")))))
    on = R.goes_on("a", "b", c("open"), 10.5, 60.0, PAGE_WIDTH)
    return e.select("book", "page_num", on.alias("goes_on"), F.when(on, F.sha2(R.spliced(c("a_text"), c("b_text")), 256)).alias("digest"))


def _bare(x):
    return rf"regexp_replace(regexp_replace({x}, '[①-⑳\s]', '', 'g'), {q(R.HEAD_PREFIXES)}, '')"


def _count(x, ch):
    return f"length(regexp_replace({x}, '[^{ch}]', '', 'g'))"


_OPENED = f"translate(ch, '{folds.CLOSE}', '{folds.OPEN}')"
CONTINUATIONS_SQL = (
    W
    + rf""", ended AS (SELECT *, text || {pick_sql(OWN_ENDS, "page_num")} AS t FROM spans), f AS (SELECT book, page_num, arg_min(t, line_idx) AS ft, arg_min(x0, line_idx) AS fx0, arg_min(x1, line_idx) AS fx1,
  arg_max(t, line_idx) AS lt, arg_max(font_size, line_idx) AS ls, arg_max(x1, line_idx) AS lx1, max(x1) AS far FROM ended WHERE t <> '' GROUP BY book, page_num),
e AS (SELECT book, page_num, ft AS b, fx1 AS b1, CASE WHEN page_num % 2 = 0 THEN fx0 - 21.0 ELSE fx0 END AS b0, lag(lt) OVER w AS a, lag(lx1) OVER w AS a1, lag(far) OVER w AS far, page_num % 3 + 1 AS al FROM f WINDOW w AS (PARTITION BY book ORDER BY page_num)),
s AS (SELECT *, regexp_replace(regexp_replace(a, {ENDS}), {q(R.REF_TAGS)}, '') AS x, regexp_replace(b, {ENDS}) AS y, list_reduce(list_prepend('', string_split(regexp_replace(a, '[^（(《〈“‘【\[「『{{）)》〉”’】\]」』}}]', '', 'g'), '')), lambda z, ch: CASE WHEN ch = '' THEN z
  WHEN NOT contains('{folds.CLOSE}', ch) THEN z || ch WHEN contains(z, {_OPENED}) THEN substr(z, 1, length(z) - strpos(reverse(z), {_OPENED})) ELSE z END) AS o FROM e WHERE a IS NOT NULL),
k AS (SELECT *, regexp_matches(x, {q(R.OPENING_END)}) OR o <> '' OR {_count("x", "《")} > {_count("x", "》")} OR {_count("x", "“")} > {_count("x", "”")} OR {_count("x", "（")} > {_count("x", "）")} OR {_count("x", "(")} > {_count("x", ")")} AS un,
  regexp_replace(x, {q(R.TRAILING_MARKS)}, '') AS pl, {_bare("x")} AS h FROM s),
m AS (SELECT *, regexp_replace(regexp_replace(pl, {q(R.CLOSING)}, ''), '\s+$', '') AS core FROM k),
n AS (SELECT *, page_num % 5 <> 0 AND (page_num % 4) * 0.25 <= 0.6 AND x <> '' AND y <> '' AND NOT regexp_matches(regexp_replace(a, {ENDS}), {q(R.CONTENTS_LINE.replace(chr(92) + "x08", ""))}) AND NOT regexp_matches(y, {q(R.CONTENTS_LINE.replace(chr(92) + "x08", ""))})
  AND (un OR NOT (regexp_matches(pl, {q(R.TERMINAL_END)}) OR (ends_with(core, '.') AND NOT regexp_matches(core, {q(R.ABBREVIATION)})) OR (al = 1 AND length(h) BETWEEN 2 AND 35 AND NOT regexp_matches(h, '{R.STOPS}') AND a1 < far - 21.0 AND NOT regexp_matches(h, '[的了在和与]$'))
    OR (a1 < far - 45.0 AND NOT regexp_matches(x, '[，,、；;：:\-—]$'))))
  AND NOT (regexp_matches(y, {q(R.PARAGRAPH_START)}) AND NOT regexp_matches(y, {q(R.YEAR_START)})) AND NOT regexp_matches(b, '^(?:[　 ]| {{2,4}})') AND b0 - 60.0 < 14.7
  AND NOT (abs((b0 + b1) / 2 - {PAGE_WIDTH} / 2) < {PAGE_WIDTH * 0.12} AND b0 > 70 AND abs(b0 - ({PAGE_WIDTH} - b1)) < {max(25.0, PAGE_WIDTH * 0.08)}) AS v FROM m)
SELECT book, page_num, v AS goes_on, CASE WHEN v THEN sha256(CASE WHEN a = '' THEN b WHEN regexp_matches(a, '{R.CJK_EDGE}$') AND regexp_matches(b, '^{R.CJK_EDGE}') THEN a || b ELSE a || ' ' || b END) END AS digest FROM n"""
)

QUERIES = {
    "seq_page_continuations": (page_continuations, CONTINUATIONS_SQL),
    "flt_after_citation": (after_citation, AFTER_SQL),
    "flt_continues_citation": (continuation, CONTINUATION_SQL),
    "flt_heading_like": (heading_like, LIKE_SQL),
    "flt_page_end_terminal": (line_query(lambda: R.ends_sentence(c("t"))), TERMINAL_SQL),
    "flt_local_address": (addresses, ADDRESS_SQL),
    "flt_degenerate_part": (degenerate, DEGENERATE_SQL),
    "seq_block_level": (block_level, LEVEL_SQL),
    "seq_geometric_level": (geometric, GEOMETRIC_SQL),
    "scl_footer_tolerance": (tolerance, f"{W} SELECT book, page_num, greatest(3.0::DOUBLE, max(font_size) * 0.35::DOUBLE) AS v FROM spans GROUP BY ALL"),
    "scl_unwrapped_block": (unwrapped, UNWRAPPED_SQL),
    "scl_styled_blocks": (blocks, BLOCKS_SQL),
    "scl_font_roles": (mapped, MAPPED_SQL),
    "scl_model_name": (model_names, MODEL_SQL),
    "win_column_of": (columns, COLUMNS_SQL),
    "win_stitched_lines": (stitched, STITCHED_SQL),
    "agg_document_profile": (profile, PROFILE_SQL),
    "agg_toc_index": (toc_index, TOC_SQL),
    "join_boundary_reviews": (boundary_reviews, BOUNDARY_SQL),
    "join_font_suggestions": (font_suggestions, SUGGESTION_SQL),
    "join_style_rules": (style_rules, RULES_SQL),
    "join_footnote_marks": (linked, LINKED_SQL),
    "src_font_roles": (fonts_json, FONTS_SQL),
    "src_symbol_map": (symbols, SYMBOLS_SQL),
}
