"""Paragraphs from lines: a boundary decision for each pair of lines, and one fold for what depends on open brackets.

All evidence but one comes from a line and the one before, so it is computed row
by row. Whether brackets are open depends on everything since the last break.
Each line therefore carries two decisions, one for open brackets and one for
none, and a fold over the page's lines keeps the stack and picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .folds import CLOSE, OPEN, joined_lines

# Words no block ends with, and beginnings of numbered blocks.
HANGING = "[的了在和与]$"
NUMBERED = ("第", "一", "二", "三", "四", "1", "2", "3", "附录")


def boundaries(lines: DataFrame, pitch: Column, base_x0: float, max_x1: float) -> DataFrame:
    """Lines (blank ones left out) with break_if_open and break_if_closed; the first line of a page has neither."""
    rows = lines.filter(T.strip(F.col("text")) != "").withColumn("size", F.rint(F.col("font_size") * 2) / 2)
    w = Window.partitionBy("book", "page_num").orderBy("y0", "x0", "line_idx")
    p = {c: F.lag(c).over(w) for c in ("text", "x0", "x1", "y0", "y1", "size", "font_family")}
    rows = rows.withColumns({f"p_{c}": v for c, v in p.items()})
    c = F.col
    step = c("y0") - c("p_y0")
    same = (F.abs(step) < 4.0) & (c("x0") >= c("p_x0"))
    term, clause = T.terminal_punctuation(c("p_text")), T.continuing_punctuation(c("p_text"))
    short = c("p_x1") < max_x1 - F.greatest(F.lit(20.0), c("p_size") * 2.0)
    indent = F.round(c("x0") - base_x0, 2) >= F.greatest(F.lit(10.0), c("size") * 1.4)
    gap = (F.round(step / F.greatest(pitch, F.lit(1.0)), 3) >= 1.45) | (c("y0") - c("p_y1") >= c("p_size") * 0.9)
    clean = T.strip(c("p_text"))
    numbered = F.lit(False)
    for n in NUMBERED:
        numbered = numbered | clean.startswith(n)
    alone = (F.length(clean) <= 30) & ~term & ~clause & short & ~F.rlike(clean, F.lit(HANGING)) & ((F.abs(c("p_size") - c("size")) >= 1.5) | gap | numbered)
    new_start, ended = indent & (term | short | gap), short & term
    closed = ~same & (alone | new_start | gap | ended)
    opened = ~same & alone & (new_start | ended)
    first = c("p_text").isNull()
    return rows.withColumns({"break_if_closed": ~first & F.coalesce(closed, F.lit(False)), "break_if_open": ~first & F.coalesce(opened, F.lit(False))}).drop(*(f"p_{x}" for x in p))


def _pushed(stack: Column, text: Column) -> Column:
    """The stack after the brackets of a text."""
    marks = F.split(F.regexp_replace(text, "[^（(《〈“‘【\\[「『{）)》〉”’】\\]」』}]", ""), "")

    def step(s: Column, ch: Column) -> Column:
        opener = F.translate(ch, CLOSE, OPEN)
        at = F.size(s) - F.array_position(F.reverse(s), opener)
        cut = F.slice(s, F.lit(1), F.greatest(at.cast("int"), F.lit(0)))
        return F.when(ch == "", s).when(~F.lit(CLOSE).contains(ch), F.concat(s, F.array(ch))).when(F.array_contains(s, opener), cut).otherwise(s)

    return F.aggregate(marks, stack, step)


def paragraphs(lines: DataFrame, pitch: Column, base_x0: float, max_x1: float) -> DataFrame:
    """Per paragraph: book, page_num, para (from 1), first_line, n_lines, text."""
    item = F.struct("y0", "x0", "line_idx", "text", "break_if_open", "break_if_closed")
    pages = boundaries(lines, pitch, base_x0, max_x1).groupBy("book", "page_num").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        breaks = F.when(F.size(acc["stack"]) > 0, x["break_if_open"]).otherwise(x["break_if_closed"])
        para = acc["para"] + F.when(breaks, 1).otherwise(0)
        stack = _pushed(F.when(breaks, none).otherwise(acc["stack"]), x["text"])
        return F.struct(stack.alias("stack"), para.alias("para"), F.concat(acc["out"], F.array(para)).alias("out"))

    start = F.struct(none.alias("stack"), F.lit(1).alias("para"), F.array().cast("array<int>").alias("out"))
    numbered = pages.select("book", "page_num", F.explode(F.arrays_zip("items", F.aggregate("items", start, step, lambda a: a["out"]).alias("para"))).alias("z"))
    rows = numbered.select("book", "page_num", F.col("z.para").alias("para"), F.col("z.items").alias("item"))
    got = rows.groupBy("book", "page_num", "para").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return got.select("book", "page_num", "para", F.col("items")[0]["line_idx"].alias("first_line"), F.size("items").alias("n_lines"), joined_lines(F.transform("items", lambda x: x["text"])).alias("text"))
