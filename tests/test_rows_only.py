"""Operators whose queries have no SQL against plain Python versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import folds
from quire.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def merged(boxes, gap=5.0):
    out = []
    for x0, y0, x1, y1 in boxes:
        if out:
            a0, b0, a1, b1 = out[-1]
            if y0 <= b1 + gap and min(a1, x1) > max(a0, x0):
                out[-1] = (min(a0, x0), b0, max(a1, x1), max(b1, y1))
                continue
        out.append((x0, y0, x1, y1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merged_intervals(spark, seed):
    r = random.Random(seed)
    boxes = sorted(((float(a), float(b), float(a + r.randrange(1, 40)), float(b + r.randrange(1, 20))) for a, b in ((r.randrange(100), r.randrange(200)) for _ in range(r.choice([0, 1, 30])))), key=lambda b: (b[1], b[0]))
    df = spark.createDataFrame([(boxes,)], "items array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = [tuple(x) for x in df.select(folds.merged_intervals(F.col("items")).alias("v")).first().v]
    assert got == merged(boxes)


@pytest.mark.parametrize(
    "text,want",
    [("short", False), ("a" * 20, True), ("the quick brown fox jumps", False), ("no no no no no no no no", True), ("abcabcabcabcabcabc and then other words follow", True), ("x" * 15, False), ("", False), ("多" * 16, True)],
)
def test_hallucinated(spark, text, want):
    assert one(spark, T.hallucinated(F.lit(text))) is want
    distinct = len(set(text)) / max(len(text), 1) < 0.15
    assert want == (len(text) > 15 and (distinct or bool(re.search(r"(?s)(.{1,10}?)\1{5,}", text))))


@pytest.mark.parametrize("seed", range(3))
def test_greedy_nms(spark, seed):
    r = random.Random(seed)
    boxes = [(float(x), float(y), float(x + r.randrange(5, 30)), float(y + r.randrange(5, 30))) for x, y in ((r.randrange(60), r.randrange(60)) for _ in range(40))]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        c = max(w, 0.0) * max(h, 0.0)
        return c / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - c)

    kept = []
    for b in boxes:  # in falling order of score
        if all(iou(k, b) <= 0.45 for k in kept):
            kept.append(b)
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([(boxes,)], f"boxes array<{kind}>")
    got = df.select(folds.greedy_nms(F.col("boxes"), kind, 0.45).alias("v")).first().v
    assert [tuple(x) for x in got] == kept


def test_paragraphs_keep_every_character(spark):
    """Paragraphs are runs of a page's lines: nothing but blanks, and hyphens where lines join, comes or goes."""
    from quire.sources.tables import spans

    df = QUERIES["seq_paragraphs"](spark, SF)
    rows = df.collect()
    pages = {(r.book, r.page_num) for r in spans(spark, SF).filter("trim(text) <> ''").collect()}
    assert rows and {(r.book, r.page_num) for r in rows} == pages


def test_pipe_table(spark):
    got = one(spark, T.to_pipe_table(F.lit("a  b\nc\td  e\n\nf")))
    assert got == "| a | b |  |\n| --- | --- | --- |\n| c | d | e |\n| f |  |  |"
    assert one(spark, T.to_pipe_table(F.lit("| a |"))) == "| a |" and one(spark, T.to_pipe_table(F.lit("one line"))) == "one line"
