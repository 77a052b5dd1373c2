"""Typography, page furniture, roles and headings over span and paragraph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.geometry import quantize

# Patterns of captions, chapters, headings and table-of-contents lines.
CAPTION = r"(?iU)^(?:表|图|圖|Table|Figure)\s*\d+(?:[\-.]\d+)*(?=[.、:：\s]|$)"
CHAPTER = r"(?U)^第[一二三四五六七八九十百\d]+[章卷篇]"
PART_HEADING = r"(?U)^(?:[上下中]\s*篇(?:\s+[^\n]+)?|目\s*录|目录|序|后\s*记|后记|结\s*语|结语|主要参考文献)$"
CHAPTER_HEADING = r"(?iU)^(?:第[一二三四五六七八九十百零\d]+[章卷篇]|(?:Chapter|Part)\s*\d+)(?:\s+[^\n]+)?$"
SECTION_HEADING = r"(?U)^第[一二三四五六七八九十百零\d]+[节節回讲講](?:\s+[^\n]+)?$"
TRIPLE_DECIMAL = r"(?U)^\d+\.\d+\.\d+(?:[\s　]+[^\n]{1,40})?$"
DECIMAL = r"(?U)^(?:\d+\.\d+(?:[\s　]+[^\n]{1,40})?|\d+[\s　]+[一-鿿]{2,15})$"
ENUMERATED = r"(?U)^[一二三四五六七八九十百]+[、.· ][^\n]{2,30}$"
PARENTHESISED = r"(?U)^[（(][一二三四五六七八九十\d]+[)）]"
SENTENCE = "[。，；？！“”‘’：:]"
TOC_LINE = r"(?U)[.…·_\-]{2,}\s*\d+$"


def router(docs: DataFrame, pages: int = 5, threshold: int = 100) -> DataFrame:
    """Per book: mean text length of its first pages, and whether that is enough to be read as text."""
    w = Window.partitionBy("book").orderBy("page_num")
    first = docs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= pages)
    mean = F.sum(F.length(T.strip(F.col("text")))) / F.count("*")
    return first.groupBy("book").agg(mean.alias("mean_chars"), (mean > threshold).alias("is_vector"))


def modes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Character-weighted mode of font and half-point size (first seen wins ties) and share of bold characters."""
    n = F.length(T.strip(F.col("text")))
    size = F.rint(F.col("font_size") * 2) / 2
    bold = (F.col("font_flags").bitwiseAND(16) != 0) | T.any_of(F.lower("font_family"), ("bold", "heavy", "hei", "黑"))
    rows = spans.withColumns({"n": n, "size": size, "bold": bold}).filter("n > 0")
    place = F.struct("page_num", "line_idx")

    def mode(column: str, out: str) -> DataFrame:
        sums = rows.groupBy(*keys, column).agg(F.sum("n").alias("c"), F.min(place).alias("p"))
        return sums.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("c"), "p")).alias(out))

    share = rows.groupBy(*keys).agg((F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("bold_ratio"))
    return mode("font_family", "dominant_font").join(mode("size", "dominant_size"), keys).join(share, keys)


def dominant_font_and_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Font of most characters (subset prefix removed; name decides ties) and mean size by characters."""
    rows = spans.withColumns({"n": F.length("text"), "font": F.regexp_replace("font_family", r"^[^+]*\+", "")}).filter("n > 0")
    fonts = rows.groupBy(*keys, "font").agg(F.sum("n").alias("c")).groupBy(*keys).agg(F.min_by("font", F.struct(-F.col("c"), "font")).alias("font"))
    sizes = rows.groupBy(*keys).agg((F.sum(F.col("font_size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    return fonts.join(sizes, keys)


def line_pitch(spans: DataFrame, keys: list[str], fallback: float = 18.0) -> DataFrame:
    """Median step between consecutive lines, of steps from 8 to 45."""
    w = Window.partitionBy("book", "page_num").orderBy("line_idx")
    gap = spans.withColumn("gap", F.col("y0") - F.lag("y0").over(w))
    ok = F.when(F.col("gap").between(8.0, 45.0), F.col("gap"))
    return gap.groupBy(*keys).agg(F.coalesce(F.median(ok), F.lit(fallback)).alias("pitch"))


def baseline(paragraphs: DataFrame) -> DataFrame:
    """Per book: body font and size from the clean pool (long enough, no captions or chapters, largest sizes left out)."""
    t = T.strip(F.col("text"))
    pool = paragraphs.withColumns({"n": F.length(t), "q": quantize(F.col("font_size"))}).filter((F.col("n") > 10) & ~F.rlike(t, F.lit(CAPTION)) & ~F.rlike(t, F.lit(CHAPTER)))
    sizes = pool.select("book", "q").distinct()
    w = Window.partitionBy("book")
    k = F.count("*").over(w)
    ranked = sizes.select("book", "q", k.alias("k"), F.row_number().over(w.orderBy(F.desc("q"))).alias("r"))
    kept = ranked.filter((F.col("k") < 4) | (F.col("r") > F.greatest(F.lit(1), F.ceil(F.col("k") / 10)))).select("book", "q")
    pool = pool.join(kept, ["book", "q"])
    fonts = pool.groupBy("book", "font_family").agg(F.sum("n").alias("c"))
    font = fonts.groupBy("book").agg(F.min_by("font_family", F.struct(-F.col("c"), "font_family")).alias("body_font"), F.sum("c").alias("clean_chars"))
    in_font = pool.join(font.select("book", F.col("body_font").alias("font_family")), ["book", "font_family"])
    size = in_font.groupBy("book", "q").agg(F.sum("n").alias("c")).groupBy("book").agg(F.min_by("q", F.struct(-F.col("c"), -F.col("q"))).alias("body_size"))
    return font.join(size, "book").filter("clean_chars >= 50")


def recurring_edges(lines: DataFrame, edge: Column, at: str) -> DataFrame:
    """Texts that recur at a page edge: on max(2, min(3, 5 % of the pages)) pages or more, with the median place.

    edge: whether a line is at the edge; at: the coordinate to take the median of. The line nearest the edge counts on each page.
    """
    norm = F.regexp_replace(F.regexp_replace(F.lower("text"), r"(?U)[\s　]+", ""), r"(?U)[\d\-_·*•—\s]+$", "")
    rows = lines.withColumn("norm", norm)
    pages = rows.groupBy("book").agg(F.countDistinct("page_num").alias("n"))
    per_page = rows.filter(edge & (F.length("norm") >= 2)).groupBy("book", "norm", "page_num").agg(F.min(at).alias("at"))
    found = per_page.groupBy("book", "norm").agg(F.count("*").alias("pages"), F.median("at").alias("median_at"))
    least = F.greatest(F.lit(2), F.least(F.lit(3), F.ceil(F.col("n") * 0.05)))
    return found.join(pages, "book").filter(F.col("pages") >= least).select("book", "norm", "pages", "median_at")


def font_census(spans: DataFrame, page_height: float) -> DataFrame:
    """Per font and half-point size: spans, pages, characters, shares in the top and bottom eighth."""
    top, bottom = F.col("y1") <= page_height / 8, F.col("y0") >= page_height * 7 / 8
    return spans.groupBy("font_family", (F.rint(F.col("font_size") * 2) / 2).alias("size")).agg(
        F.count("*").alias("n_spans"),
        F.countDistinct("book", "page_num").alias("n_pages"),
        F.sum(F.length("text")).alias("n_chars"),
        (F.count_if(top) / F.count("*")).alias("top_ratio"),
        (F.count_if(bottom) / F.count("*")).alias("bottom_ratio"),
    )


def heading_score(groups: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """Number of groups of evidence that hold, and the sum of their weights (1 at most)."""
    n, score = F.lit(0), F.lit(0.0)
    for holds, weight in groups.values():
        n = n + F.when(holds, 1).otherwise(0)
        score = score + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return n, F.least(F.lit(1.0), score)


def heading_level(lexical: Column, score: Column) -> Column:
    """Chapters 1, sections 2, subsections 3; without such a word by score: .85 and .70 are the bounds."""
    return F.when(lexical == "chapter", 1).when(lexical == "section", 2).when(lexical == "subsection", 3).when(score >= 0.85, 1).when(score >= 0.70, 2).otherwise(3)


def heading_gate(text: Column, n_groups: Column, score: Column, lexical: Column, line_status: Column) -> Column:
    """(role, level, confidence, evidence): the period veto, the question rule, then two groups and a score of .65."""
    out = lambda role, confidence, evidence, level=None: F.struct(
        F.lit(role).alias("role"), (F.lit(level) if not isinstance(level, Column) else level).cast("int").alias("level"), confidence.alias("confidence"), evidence.alias("evidence")
    )
    fixed = lambda role, c, e: out(role, F.lit(c), F.lit(e))
    multi, unknown = line_status == "verified_multiline", line_status == "unavailable"
    level = heading_level(F.coalesce(lexical, F.lit("")), score)
    qualified = out(
        "heading_candidate", F.when(level == 1, 0.90).otherwise(0.80), F.concat(F.lit("heading: level_"), level.cast("string"), F.lit("_candidate")), level
    )
    prose = fixed("body", 0.85, "body: multiline_prose_flow")
    unverified = fixed("body", 0.60, "body: unverified_lines_single_line_fallback")
    period, question = F.rlike(text, F.lit(r"(?U)。\s*$")), F.rlike(text, F.lit(r"(?U)[?？]\s*$")) & (F.coalesce(lexical, F.lit("")) != "chapter")
    return (
        F.when(period & unknown, unverified)
        .when(period & multi & (n_groups == 0), prose)
        .when(period, fixed("body", 0.85, "body: heading_vetoed_by_period"))
        .when(question & multi, prose)
        .when(question, fixed("uncertain", 0.35, "uncertain: standalone_question_without_prefix"))
        .when((n_groups >= 2) & (score >= 0.65), qualified)
        .when(n_groups >= 2, fixed("uncertain", 0.40, "uncertain: heading_insufficient_score"))
        .when((n_groups == 1) & (score >= 0.35), fixed("uncertain", 0.40, "uncertain: heading_single_group_quarantine"))
        .when(unknown, unverified)
        .when(multi, prose)
        .otherwise(fixed("body", 0.60, "body: unstyled_single_line"))
    )


def regex_heading_level(text: Column) -> Column:
    """1 for parts and special pages, 2 for chapters and sections; without sentence punctuation 3 for triple decimals, enumerations and short parenthesised items, 2 for decimals; else 0."""
    m = lambda p: F.rlike(text, F.lit(p))
    bare = F.length(F.regexp_replace(text, "(?U)[①-⑳\\s]", ""))
    return (
        F.when(m(PART_HEADING), 1).when(m(CHAPTER_HEADING) | m(SECTION_HEADING), 2).when(m(SENTENCE), 0).when(m(TRIPLE_DECIMAL), 3)
        .when(m(DECIMAL), 2).when(m(ENUMERATED), 3).when(m(PARENTHESISED) & bare.between(2, 30), 3).otherwise(0)
    )


def folio_sequence(numbers: DataFrame) -> DataFrame:
    """Per book with page numbers (book, page_num, value): whether they rise by at least one and at most the pages between."""
    w = Window.partitionBy("book").orderBy("page_num")
    step = numbers.withColumns({"dv": F.lead("value").over(w) - F.col("value"), "dp": F.lead("page_num").over(w) - F.col("page_num")})
    good = F.coalesce(F.bool_and((F.col("dv") >= 1) & (F.col("dv") <= F.col("dp"))), F.lit(True))
    return step.groupBy("book").agg(F.count("*").alias("pages"), F.when(F.count("*") < 2, "isolated").when(good, "valid").otherwise("broken").alias("status"))


def toc_entries(lines: DataFrame) -> DataFrame:
    """Lines of a table of contents (leaders and a number): title, target page, level by indent (5 and 25 points)."""
    rows = lines.filter(F.rlike("text", F.lit(TOC_LINE)))
    least = F.min("x0").over(Window.partitionBy("book", "page_num"))
    indent = F.col("x0") - least
    return rows.select(
        "book", "page_num", "line_idx",
        T.strip(F.regexp_replace("text", r"(?U)\s*[.…·_\-]{2,}\s*\d+$", "")).alias("title"),
        F.regexp_extract("text", r"(\d+)$", 1).cast("long").alias("target"),
        F.when(indent > 25, 3).when(indent > 5, 2).otherwise(1).alias("level"),
    )
