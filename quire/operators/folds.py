"""Sequential operators as native folds over a page's sorted array.

A page's items are gathered into one array (pages are small by nature); the fold
runs inside the JVM. Each fold takes and returns an array of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bracket pairs.
OPEN, CLOSE = "（(《〈“‘【[「『{", "）)》〉”’】]」』}"


def gathered(df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str = "items") -> DataFrame:
    """One row per page with its items sorted by `order` (which must be total), as structs of order and fields."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(out))


def anchor_bands(items: Column, value, tolerance: float) -> Column:
    """Band number of each item of an array sorted by value: a band's first item is its anchor, members are within tolerance of it."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        v = value(x)
        same = acc["anchor"].isNotNull() & (v - acc["anchor"] <= tolerance)
        band = F.when(same, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(v).alias("anchor"), band.alias("band"), F.concat(acc["out"], F.array(band)).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def mean_bands(items: Column, value, tolerance: float) -> Column:
    """As anchor_bands, but members are within tolerance of the running mean of their band."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        v = value(x)
        same = (acc["n"] > 0) & (F.abs(v - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= tolerance)
        band = F.when(same, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(
            (F.when(same, acc["sum"]).otherwise(F.lit(0.0)) + v).alias("sum"), (F.when(same, acc["n"]).otherwise(0) + 1).alias("n"), band.alias("band"), F.concat(acc["out"], F.array(band)).alias("out")
        )

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def greedy_nms(boxes: Column, element: str, threshold: float) -> Column:
    """Non-maximum suppression: of boxes in falling order of score, those whose overlap with every box kept so far is below the threshold."""

    def overlaps(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        size = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
        union = size(a) + size(b) - w * h
        return F.when(union > 0, w * h / union).otherwise(F.lit(0.0)) >= threshold

    none = F.array().cast(f"array<{element}>")
    return F.aggregate(boxes, none, lambda kept, b: F.when(F.exists(kept, lambda k: overlaps(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def merged_intervals(items: Column, gap: float = 5.0) -> Column:
    """Envelopes of boxes sorted by y0: a box joins the last envelope if it begins within gap of its end and they overlap across."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"

    def step(acc: Column, b: Column) -> Column:
        t = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (b["y0"] <= t["y1"] + gap) & (F.least(t["x1"], b["x1"]) > F.greatest(t["x0"], b["x0"]))
        grown = F.struct(F.least(t["x0"], b["x0"]).alias("x0"), t["y0"].alias("y0"), F.greatest(t["x1"], b["x1"]).alias("x1"), F.greatest(t["y1"], b["y1"]).alias("y1"))
        whole = F.struct(*(b[n].alias(n) for n in ("x0", "y0", "x1", "y1")))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(whole)))

    return F.aggregate(items, F.array().cast(kind), step)


def open_brackets(text: Column) -> Column:
    """Brackets left open: a close takes its opener off the top, or everything from its last opener on; strays do nothing."""
    marks = F.split(F.regexp_replace(text, "[^（(《〈“‘【\\[「『{）)》〉”’】\\]」』}]", ""), "")
    none = F.array().cast("array<string>")

    def step(stack: Column, ch: Column) -> Column:
        opener = F.translate(ch, CLOSE, OPEN)
        closes = F.lit(CLOSE).contains(ch)
        at = F.size(stack) - F.array_position(F.reverse(stack), opener)
        cut = F.slice(stack, F.lit(1), F.greatest(at.cast("int"), F.lit(0)))
        return F.when(ch == "", stack).when(~closes, F.concat(stack, F.array(ch))).when(F.array_contains(stack, opener), cut).otherwise(stack)

    return F.aggregate(marks, none, step)


CJK = r"[㐀-䶿一-鿿豈-﫿　-〿！-｠￠-￮‘-‟]"


def joined_lines(lines: Column) -> Column:
    """Lines of a paragraph as one text: a hyphen stays and joins, no blank next to CJK, else one blank."""

    def step(acc: Column, x: Column) -> Column:
        x = F.trim(x)
        tight = F.rlike(acc, F.lit(f"{CJK}$")) | F.rlike(x, F.lit(f"^{CJK}")) | acc.endswith("-")
        return F.when(x == "", acc).when(acc == "", x).when(tight, F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x))

    return F.aggregate(lines, F.lit(""), step)


def corrected(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The replacements one after the other, each on the result of those before."""
    for bad, good in pairs:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text
