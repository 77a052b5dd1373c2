"""Sections, rewriting rules and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import skeleton

CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
PREAMBLE, DOCUMENT = "__PREAMBLE__", "__DOCUMENT__"


def sectioned(elements: DataFrame, doc: str, order: str, split_level: int) -> DataFrame:
    """Elements with section number (0: before the first heading of that level or above) and place in the section."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("level").between(1, split_level), 1).otherwise(0)
    rows = elements.withColumn("sec", F.sum(starts).over(w))
    return rows.withColumn("para", F.row_number().over(Window.partitionBy(doc, "sec").orderBy(order)))


def section_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"section_id": F.format_string("sec_%03d", "sec"), "para_id": F.format_string("sec_%03d_p%03d", "sec", "para")})


def section_texts(rows: DataFrame, doc: str) -> DataFrame:
    """Per section: its texts in order, apart by a blank line."""
    items = F.array_sort(F.collect_list(F.struct("para", "text")))
    kept = F.filter(F.transform(items, lambda x: F.trim(x["text"])), lambda t: t != "")
    return rows.groupBy(doc, "sec").agg(F.array_join(kept, "\n\n").alias("content"))


def effective_text(text: Column, badge: Column, style: Column) -> Column:
    """A paragraph as it is written: badge before, style fence around, each unless it is there already."""
    t = F.when((badge != "") & ~text.startswith(badge), F.concat(badge, text)).otherwise(text)
    fenced = F.concat(F.lit('::: {custom-style="'), style, F.lit('"}\n'), t, F.lit("\n:::"))
    return F.when((style != "") & (style != "Normal") & ~t.contains("custom-style="), fenced).otherwise(t)


def apply_rules(paragraphs: DataFrame, rules: list[dict], styles: tuple[str, ...] = ()) -> DataFrame:
    """Rules on paragraphs (section, para, is_preamble, text): is_deleted, custom_style, injected_badge.

    Rules in order of priority: a deletion ends the paragraph's rules; the last style that matches stays; a badge goes to the
    section's first paragraph that asks for it and not to preambles; styles outside the closed set are dropped. Rules are data of the
    query, so each is an expression; no join is needed.
    """
    rules = sorted(rules, key=lambda r: r.get("priority", 100))
    deleted, style = F.lit(False), F.lit("")
    wants: dict[str, Column] = {}
    for r in rules:
        hit = F.rlike("text", F.lit(r["trigger_regex"]))
        if r["action"] == "delete_line":
            deleted = deleted | hit
        elif r["action"] == "apply_style":
            style = F.when(hit & ~deleted & ~F.col("text").contains("custom-style="), r["target_docx_style"]).otherwise(style)
        elif r["action"] == "inject_badge":
            badge = r["inject_prefix_badge"]
            # A hit counts while no deletion of higher priority holds, also if a later one deletes the paragraph.
            ask = hit & ~deleted & ~F.col("is_preamble") & ~F.col("text").startswith(badge)
            wants[badge] = wants[badge] | ask if badge in wants else ask
    out = paragraphs.withColumns({"is_deleted": deleted, "custom_style": F.when(style.isin(*styles) | (style == "Normal"), style).otherwise("") if styles else style})
    w = Window.partitionBy("section").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.lit("")
    for i, (badge, ask) in enumerate(wants.items()):
        out = out.withColumn(f"_ask{i}", ask)
        first = F.col(f"_ask{i}") & ~F.coalesce(F.max(f"_ask{i}").over(w), F.lit(False))
        chosen = F.when(first, badge).otherwise(chosen)
    return out.withColumn("injected_badge", chosen).drop(*(f"_ask{i}" for i in range(len(wants))))


def first_rule(text: Column, rules: list[dict], default: str = "Normal") -> Column:
    """Style of the first rule by priority that matches."""
    out = None
    for r in sorted(rules, key=lambda r: r.get("priority", 100)):
        hit = F.rlike(text, F.lit(r["trigger_regex"]))
        out = F.when(hit, r["target_docx_style"]) if out is None else out.when(hit, r["target_docx_style"])
    return F.lit(default) if out is None else out.otherwise(default)


def traffic_light(raw: Column, processed: Column, styles: Column, allowed: tuple[str, ...], badges: tuple[str, ...] = ()) -> Column:
    """GREEN if the skeleton is kept and styles are known; RED for an unknown style or a shorter skeleton; else YELLOW.

    The full difference report (which fragments) is quire.operators.documents.audited.
    """
    a, b = skeleton(raw, badges), skeleton(processed, badges)
    alien = F.size(F.array_except(styles, F.array(*(F.lit(s) for s in (*allowed, "Normal", "Table Caption", "Caption"))))) > 0
    return F.when(alien | (F.length(b) < F.length(a)), "RED").when(a != b, "YELLOW").otherwise("GREEN")


def audit_rollup(audits: DataFrame, keys: list[str]) -> DataFrame:
    """Sections, and those of each status, by document."""
    c = lambda s: F.count_if(F.col("status") == s)
    return audits.groupBy(*keys).agg(F.count("*").alias("total"), c("GREEN").alias("green"), c("YELLOW").alias("yellow"), c("RED").alias("red"))


def circled_gaps(text: Column) -> Column:
    """Circled numbers missing in the run from the smallest present, as long as there are distinct ones (two or more)."""
    there = F.filter(F.sequence(F.lit(1), F.lit(20)), lambda i: text.contains(F.substr(F.lit(CIRCLED), i, F.lit(1))))
    run = F.sequence(F.get(there, F.lit(0)), F.get(there, F.lit(0)) + F.size(there) - 1)
    return F.when(F.size(there) >= 2, F.array_except(run, there)).otherwise(F.array().cast("array<int>"))


def badges(text: Column) -> Column:
    """Bracketed labels of two to ten characters at line starts."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|\n)\s*(?:【[^】]{2,10}】|\[[^\]]{2,10}\]|〔[^〕]{2,10}〕)"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"[\s【】\[\]〔〕]+", " "))), lambda b: F.length(b) <= 8)


def mandatory_badges(sections: DataFrame, doc: str) -> DataFrame:
    """Badges that enough of a book's sections have: one of up to two sections, else 60 % (at least two)."""
    n = sections.groupBy(doc).agg(F.count("*").alias("n"))
    per = sections.select(doc, "sec", F.explode(F.array_distinct(badges(F.col("content")))).alias("badge"))
    found = per.groupBy(doc, "badge").agg(F.count("*").alias("n_sections"))
    least = F.when(F.col("n") <= 2, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("n") * 0.6)))
    return found.join(n, doc).filter(F.col("n_sections") >= least).select(doc, "badge", "n_sections")


def book_type(badge_set: Column) -> Column:
    has = lambda *b: F.arrays_overlap(badge_set, F.array(*(F.lit(x) for x in b)))
    return (
        F.when(has("問", "答", "Q", "A", "問題", "解答"), "qa_dialogue")
        .when(has("導讀", "重點", "摘要", "提示", "範例", "說明", "解析"), "technical_manual")
        .when(F.size(badge_set) == 0, "narrative")
        .otherwise("general")
    )


def seeded_prefix(sections: DataFrame, doc: str) -> DataFrame:
    """Sections up to, without, the first that was not seen."""
    w = Window.partitionBy(doc).orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("_ok", F.min(F.col("seen").cast("int")).over(w)).filter("_ok = 1").drop("_ok")
