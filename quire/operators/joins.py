"""Lookups, spatial joins and review joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import area, box, intersection_area, iou
from ..functions.text import char_jaccard


def as_box(p: str = "") -> Column:
    return box(*(f"{p}{n}" for n in ("x0", "y0", "x1", "y1")))


def pairs_on_page(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """Pairs of one page, the columns prefixed a_ and b_: an equality join, whatever condition follows."""
    a = left.select(F.col(page), *(F.col(c).alias(f"a_{c}") for c in left.columns if c != page))
    b = right.select(F.col(page), *(F.col(c).alias(f"b_{c}") for c in right.columns if c != page))
    return a.join(b, page)


def overlapping(blocks: DataFrame, zones: DataFrame, page: str, ratio: float = 0.30, keep: bool = True) -> DataFrame:
    """Blocks that do (keep) or do not lie in a zone of their page with more than that share of their area."""
    z = zones.select(F.col(page).alias("_page"), as_box().alias("_zone"))
    b = as_box()
    hit = (F.col(page) == F.col("_page")) & (intersection_area(b, F.col("_zone")) > ratio * area(b)) & (area(b) > 0)
    return blocks.join(z, hit, "left_semi" if keep else "left_anti")


def best_overlap(blocks: DataFrame, images: DataFrame, page: str, block_id: str, image_id: str, least: float = 0.40, page_area: float | None = None) -> DataFrame:
    """Each block's image with the largest share inside the block, of at least `least`; full-page scans only for blocks nearly as large."""
    both = pairs_on_page(blocks, images, page)
    b, i = as_box("a_"), as_box("b_")
    common, size = intersection_area(b, i), F.greatest(area(i), F.lit(1.0))
    ok = (common > 0) & (common / size >= least)
    if page_area is not None:
        ok = ok & ~((size >= 0.85 * page_area) & (F.greatest(area(b), F.lit(1.0)) < 0.80 * size))
    found = both.withColumn("ratio", common / size).filter(ok)
    return found.groupBy(page, f"a_{block_id}").agg(F.min_by(F.struct(f"b_{image_id}", "ratio"), F.struct(-F.col("ratio"), f"b_{image_id}")).alias("m")).select(
        page, F.col(f"a_{block_id}").alias("block"), F.col(f"m.b_{image_id}").alias("image"), "m.ratio"
    )


def iou_pairs(boxes: DataFrame, page: str, order: str, least: float) -> DataFrame:
    """Pairs of a page's boxes, the first before the second in order, with at least that intersection over union."""
    both = pairs_on_page(boxes, boxes, page).filter(F.col(f"a_{order}") < F.col(f"b_{order}"))
    return both.withColumn("iou", iou(as_box("a_"), as_box("b_"))).filter(F.col("iou") >= least)


def font_lookup(spans: DataFrame, fonts: DataFrame, keys: list[str]) -> DataFrame:
    """Role and style of each block's font: spans by length, then order; spellings of the key by rank; the first that is known.

    fonts: key, role, docx_style. It is a configuration table; Spark broadcasts it if it is small.
    """
    size = F.rint(F.col("font_size") * 2) / 2
    spelled = F.array(F.format_string("%s (%spt)", "font_family", size.cast("string")), F.format_string("%s_%s", "font_family", size.cast("string")), F.col("font_family"))
    rows = spans.select(*keys, (-F.length(F.trim("text"))).alias("long"), "line_idx", F.posexplode(spelled).alias("rank", "key"))
    found = rows.join(fonts.filter("role is not null or docx_style is not null"), "key")
    best = F.min_by(F.struct("role", "docx_style", "key"), F.struct("long", "line_idx", "rank")).alias("m")
    return found.groupBy(*keys).agg(best).select(*keys, "m.role", "m.docx_style", "m.key")


def toc_match(headings: DataFrame, toc: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Level of each heading (id, page, title) by the table of contents (toc_idx, page, title, level) of the same book.

    The same title within two pages first, else the first entry within three pages whose characters are similar enough; 0 without.
    A book may be long, so headings meet entries of their own run of four pages and those beside it.
    """
    part = F.floor(F.col("page") / 4)
    entries = toc.select("book", "toc_idx", F.col("page").alias("toc_page"), F.col("title").alias("toc_title"), "level", F.explode(F.array(part - 1, part, part + 1)).alias("part"))
    both = headings.withColumn("part", part).join(entries, ["book", "part"], "left")
    far = F.abs(F.col("toc_page") - F.col("page"))
    exact = (F.col("title") == F.col("toc_title")) & (far <= 2)
    near = (far <= 3) & (char_jaccard(F.col("title"), F.col("toc_title")) >= threshold)
    rank = F.when(exact, F.struct(F.lit(0).alias("k"), F.col("toc_idx").alias("i"))).when(near, F.struct(F.lit(1).alias("k"), F.col("toc_idx").alias("i")))
    return both.groupBy("book", "id").agg(F.coalesce(F.min_by("level", rank), F.lit(0)).alias("level"))


def reviewed(source: DataFrame, reviews: DataFrame, key: str, roles: tuple[str, ...], threshold: float = 0.75) -> DataFrame:
    """Source rows with the review's role, level and confidence where it is valid and sure enough; else their own.

    A heading needs a level of 1 to 3, any other role none.
    """
    r = reviews.select(F.col(key), F.col("role").alias("r_role"), F.col("level").alias("r_level"), F.col("confidence").alias("r_conf"))
    pair = F.when(F.col("r_role") == "heading", F.coalesce(F.col("r_level").isin(1, 2, 3), F.lit(False))).otherwise(F.col("r_level").isNull())
    ok = F.coalesce(F.col("r_role").isin(*roles) & pair & F.col("r_conf").between(threshold, 1.0), F.lit(False))
    pick = lambda a, b: F.when(ok, F.col(a)).otherwise(F.col(b))
    rest = [c for c in source.columns if c not in ("role", "level", "confidence")]
    return source.join(r, key, "left").select(
        *rest, pick("r_role", "role").alias("role"), pick("r_level", "level").alias("level"), pick("r_conf", "confidence").alias("confidence"),
        F.when(ok, "review").otherwise("rule").alias("decided_by"), (F.col("r_role").isNotNull() & ~ok).alias("refused"),
    )


def footnote_match(markers: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Markers and notes of one number, each used once in order: matched, orphan marker or orphan note."""
    w = lambda o: Window.partitionBy(*keys, "number").orderBy(o)
    m = markers.withColumn("turn", F.row_number().over(w("marker_pos")))
    n = notes.withColumn("turn", F.row_number().over(w("note_pos")))
    both = m.join(n, [*keys, "number", "turn"], "full_outer")
    status = F.when(F.col("marker_pos").isNull(), "orphan_note").when(F.col("note_pos").isNull(), "orphan_marker").otherwise("matched")
    return both.select(*keys, "number", "turn", "marker_pos", "note_pos", status.alias("status"))


def contained(small: DataFrame, large: DataFrame, key_words: int = 3) -> DataFrame:
    """(small_id, large_id) where the small text (id, text) occurs in the large one word for word.

    The small text's first words must be among the large text's runs of as many words: an equality join that keeps pairs few, then the exact test.
    """
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")
    flat = lambda c: F.array_join(words(c), " ")
    s = small.select(F.col("id").alias("small_id"), flat(F.col("text")).alias("s")).filter("s <> ''")
    s = s.withColumn("k", F.array_join(F.slice(F.split("s", " "), 1, key_words), " ")).withColumn("n", F.least(F.size(F.split("s", " ")), F.lit(key_words)))
    lengths = F.transform(F.sequence(F.lit(1), F.lit(key_words)), lambda n: n)
    ll = large.select(F.col("id").alias("large_id"), flat(F.col("text")).alias("t"), words(F.col("text")).alias("w")).withColumn("n", F.explode(lengths)).filter(F.size("w") >= F.col("n"))
    runs = ll.select("large_id", "t", "n", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))"))).alias("k"))
    found = runs.join(s, ["n", "k"]).filter(F.concat(F.lit(" "), F.col("t"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("s"), F.lit(" "))))
    return found.select("small_id", "large_id")


def merged_map(old: DataFrame, new: DataFrame, removed: DataFrame, key: str, protect: str | None = None) -> DataFrame:
    """Key-value table after an upsert: new entries win (not over rows that `protect` names), removed keys go, the rest stays."""
    o = old.select(key, F.struct(*(c for c in old.columns if c != key)).alias("o"))
    n = new.select(key, F.struct(*(c for c in old.columns if c != key)).alias("n"))
    both = o.join(n, key, "full_outer").join(removed.select(key), key, "left_anti")
    value = F.coalesce("n", "o")
    if protect is not None:
        value = F.when(F.expr(f"o.{protect}"), F.col("o")).otherwise(value)
    return both.select(key, value.alias("v")).select(key, "v.*")
