"""Small cases whose results are known, with CJK text and odd input."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G, text as T
from quire.operators import folds, joins, layout, sections, tasks


def one(spark, value, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], names) if names else spark.range(1)
    return df.select(value.alias("v")).first().v


@pytest.mark.parametrize(
    "raw,want",
    [("12", 12), ("0", None), ("二十五", 25), ("一百零三", 103), ("一二三", 123), ("〇", None), ("十", 10), ("第五页", 5), ("·7·", 7), ("²", None), ("", None), ("abc", None), ("1234567890123", None)],
)
def test_numeral(spark, raw, want):
    assert one(spark, T.numeral(F.lit(raw))) == want


@pytest.mark.parametrize(
    "lengths,want",
    [([5, 5, 5], True), ([7, 7, 7], True), ([5, 7, 5, 7], True), ([7, 5, 7, 5], True), ([5, 7, 5], False), ([6, 6, 6], False), ([5, 5], False), ([], False)],
)
def test_poetry(spark, lengths, want):
    assert one(spark, T.poetry_rhythm(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"))) is want


@pytest.mark.parametrize("text,want", [("（【）", ""), ("（a", "（"), ("）a", ""), ("（《》【", "（【"), ("", ""), ("[({})]", "")])
def test_open_brackets(spark, text, want):
    assert "".join(one(spark, folds.open_brackets(F.lit(text)))) == want


def test_anchor_bands_compare_with_the_anchor(spark):
    items = F.array(*(F.struct(F.lit(float(y)).alias("y")) for y in (1, 2.5, 3.5, 9)))
    assert one(spark, folds.anchor_bands(items, lambda x: x["y"], 2.0)) == [1, 1, 2, 3]


def test_mean_bands(spark):
    items = F.array(*(F.struct(F.lit(float(y)).alias("y")) for y in (0, 5, 8, 20)))
    assert one(spark, folds.mean_bands(items, lambda x: x["y"], 5.5)) == [1, 1, 1, 2]


@pytest.mark.parametrize("lines,want", [(["ab-", "cd"], "ab-cd"), (["ab", "", "cd"], "ab cd"), (["你好", "世界"], "你好世界"), (["ab", "世"], "ab世"), ([], "")])
def test_joined_lines(spark, lines, want):
    assert one(spark, folds.joined_lines(F.lit(lines).cast("array<string>") if lines else F.array().cast("array<string>"))) == want


@pytest.mark.parametrize("size,want", [(10.125, 10.25), (10.1, 10.0), (10.374, 10.25), (10.375, 10.5), (0.0, None), (-1.0, None), (float("nan"), None)])
def test_quantize(spark, size, want):
    assert one(spark, G.quantize(F.lit(size))) == want


@pytest.mark.parametrize("text,want", [("《史记》，中华书局 1959 年版", True), ("[M]. 北京", True), ("参见上文", True), ("hello", False), ("", False), ("p. 12", True)])
def test_citation(spark, text, want):
    assert one(spark, T.strong_citation(F.lit(text))) is want


def test_nms_keeps_the_best(spark):
    rows = [("p", -0.9, 0.0, 0.0, 10.0, 10.0), ("p", -0.8, 1.0, 0.0, 11.0, 10.0), ("p", -0.7, 50.0, 0.0, 60.0, 10.0)]
    df = spark.createDataFrame(rows, "page string, neg double, x0 double, y0 double, x1 double, y1 double")
    g = folds.gathered(df, ["page"], ["neg", "x0", "y0", "x1", "y1"], [])
    kept = g.select(folds.greedy_nms(F.col("items"), "struct<neg:double,x0:double,y0:double,x1:double,y1:double>", 0.5).alias("k")).first().k
    assert [k.x0 for k in kept] == [0.0, 50.0]


@pytest.mark.parametrize(
    "raw,out,styles,want",
    [("甲乙丙", "甲乙丙", [], "GREEN"), ("甲乙丙", "甲乙丁丙", [], "YELLOW"), ("甲乙丙", "甲丙", [], "RED"), ("甲", "甲", ["Alien"], "RED"), ("甲", '::: {custom-style="Quote"}\n甲\n:::', ["Quote"], "GREEN")],
)
def test_traffic_light(spark, raw, out, styles, want):
    s = F.lit(styles).cast("array<string>") if styles else F.array().cast("array<string>")
    assert one(spark, sections.traffic_light(F.lit(raw), F.lit(out), s, ("Quote",))) == want


@pytest.mark.parametrize("text,want", [("①②④", [3]), ("①②③", []), ("⑤", []), ("", []), ("③⑤⑥", [4])])
def test_circled_gaps(spark, text, want):
    assert one(spark, sections.circled_gaps(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,n,score,lexical,status,role,level",
    [
        ("第一章 总论", 2, 0.65, "chapter", "verified_single_line", "heading_candidate", 1),
        ("总论", 2, 0.64, None, "verified_single_line", "uncertain", None),
        ("总论", 1, 0.9, None, "verified_single_line", "uncertain", None),
        ("结束。", 3, 1.0, "chapter", "verified_single_line", "body", None),
        ("为何？", 2, 0.9, None, "verified_single_line", "uncertain", None),
        ("第二章 为何？", 2, 0.9, "chapter", "verified_single_line", "heading_candidate", 1),
        ("x", 2, 0.85, None, "verified_single_line", "heading_candidate", 1),
        ("x", 2, 0.70, None, "verified_single_line", "heading_candidate", 2),
        ("x", 0, 0.0, None, "unavailable", "body", None),
    ],
)
def test_heading_gate(spark, text, n, score, lexical, status, role, level):
    g = one(spark, layout.heading_gate(F.lit(text), F.lit(n), F.lit(score), F.lit(lexical).cast("string"), F.lit(status)))
    assert (g.role, g.level) == (role, level)


def test_cancelled_task_stays(spark):
    log = spark.createDataFrame([(1, 1, 10, "queued", 0.0), (1, 2, 11, "cancelled", 0.0), (1, 3, 12, "running", 0.0), (2, 1, 13, "running", 0.0)], "task_id long, ts long, event_id long, status string, value double")
    got = {r.task_id: r.status for r in tasks.state(log).collect()}
    assert got == {1: "cancelled", 2: "running"}


def test_reviews(spark):
    src = spark.createDataFrame([(i, "body", None, 0.6) for i in range(6)], "id int, role string, level int, confidence double")
    rev = spark.createDataFrame([(0, "heading", 2, 0.75), (1, "heading", None, 0.9), (2, "body", 1, 0.9), (3, "body", None, 0.74), (4, "odd", None, 0.9)], "id int, role string, level int, confidence double")
    got = {r.id: (r.role, r.level, r.decided_by, r.refused) for r in joins.reviewed(src, rev, "id", ("heading", "body")).collect()}
    assert got[0] == ("heading", 2, "review", False) and got[5] == ("body", None, "rule", False)
    assert all(got[i] == ("body", None, "rule", True) for i in (1, 2, 3, 4))


def test_pipe_tables(spark):
    assert one(spark, T.to_pipe_table(F.lit("a  b\nc"))) == "| a | b |\n| --- | --- |\n| c |  |"
    assert one(spark, T.to_pipe_table(F.lit("plain"))) == "plain"
    assert one(spark, T.pipe_rows(F.lit("| a | b |\n|---|---|\n| 1 | 2 |"))) == [["a", "b"], ["1", "2"]]
    assert one(spark, T.pipe_table(F.lit("| a |\n| b |"))) and not one(spark, T.pipe_table(F.lit("a | b")))
