"""Rules, line stitching and settings files on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.operators.stitching import needs_blank, rows_of, stitched
from quire.sources import config


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "before,context,want",
    [("见第", "", True), ("北京: ", "", True), ("1998年", "", True), ("http://a.b/c", "", True), ("末尾。", "", False), ("  ", "第", True), ("  ", "", False), ("说明", "第", False)],
)
def test_after_citation(spark, before, context, want):
    assert one(spark, R.after_citation(F.lit(before), F.lit(context))) is want


@pytest.mark.parametrize("marker,number,previous,want", [("1998.", 1998, None, True), ("1700.", 1700, None, False), ("12.", 12, "第", True), ("12.", 12, "完。", False), ("①", 1, "第", False), ("3、", 3, "", False)])
def test_continues_citation(spark, marker, number, previous, want):
    assert one(spark, R.continues_citation(F.lit(marker), F.lit(number), F.lit(previous).cast("string"))) is want


@pytest.mark.parametrize(
    "text,want", [("他走了。", True), ("他走了。[^p1_2]", True), ("他走了。①", True), ("The end.", True), ("See fig.", False), ("von öst.", True), ("He is J.", True), ("他和", False), ("”好！”", True), ("于1998．", True), ("", False)]
)
def test_ends_sentence(spark, text, want):
    assert one(spark, R.ends_sentence(F.lit(text))) is want


@pytest.mark.parametrize(
    "text,bold,x0,x1,toc,want",
    [
        ("第三章 总论", False, 60, 200, None, 1), ("第二节 方法", False, 60, 200, None, 2), ("1.2 方法", False, 60, 200, None, 2), ("1.2.3 方法", False, 60, 200, None, 3), ("三、方法", False, 60, 200, None, 3),
        ("第三章 总论", False, 60, 200, 2, 2), ("表 3-1 数据", False, 60, 200, None, 0), ("正文。", False, 60, 200, None, 0), ("短题", False, 260, 335, None, 2), ("短题", True, 60, 100, None, 3),
        ("他的是了", True, 60, 100, None, 0), ("从從文", True, 60, 100, None, 0), ("长" * 26, True, 60, 100, None, 0), ("", True, 60, 100, None, 0),
    ],
)
def test_block_level(spark, text, bold, x0, x1, toc, want):
    assert one(spark, R.block_level(F.lit(text), F.lit(1), F.lit(bold), F.lit(x0), F.lit(x1), 595.0, F.lit(toc).cast("int"))) == want


def test_unwrapped_gives_back_what_styled_makes(spark):
    got = one(spark, R.unwrapped(F.concat(R.styled(F.lit("a\nb"), F.lit("Body")), F.lit("[^p1_2]"))))
    assert tuple(got) == ("a\nb", "Body", "[^p1_2]")
    assert tuple(one(spark, R.unwrapped(F.lit(" plain ")))) == ("plain", None, "")
    assert one(spark, R.styled(F.lit("x"), F.lit(None).cast("string"))) == "x"


@pytest.mark.parametrize(
    "url,want",
    [("http://localhost:11434/", "http://localhost:11434"), ("http://172.31.0.1", "http://172.31.0.1"), ("http://172.32.0.1", None), ("https://example.org", None), ("http://[::1]:1/", "http://[::1]:1"), ("", R.LOCAL_DEFAULT), (None, R.LOCAL_DEFAULT), ("http://10.0.0.1@evil.org/", None)],
)
def test_local_address(spark, url, want):
    assert one(spark, R.local_address(F.lit(url).cast("string"))) == want


def test_rows_of_keeps_raised_marks_on_their_line():
    boxes = [(60, 100, 200, 112), (202, 98, 206, 104), (60, 118, 200, 130), (210, 101, 300, 113)]
    assert [sorted(r) for r in rows_of(boxes, 10.5, 0.45)] == [[0, 1, 3], [2]]


def test_needs_blank():
    assert needs_blank("one", "two", 5.0, 10.5, 10.5, 10.5)
    assert not needs_blank("one", "two", 2.0, 10.5, 10.5, 10.5)
    assert not needs_blank("one", "二", 5.0, 10.5, 10.5, 10.5)
    assert not needs_blank("one ", "two", 5.0, 10.5, 10.5, 10.5)
    assert not needs_blank("one", "2", 5.0, 10.5, 10.5, 6.0)


def test_stitched(spark):
    rows = [(1, "one", 60.0, 100.0, 100.0, 112.0, 10.5), (1, "two", 105.0, 100.0, 140.0, 112.0, 10.5), (1, "far", 300.0, 100.0, 340.0, 112.0, 10.5), (1, None, 60.0, 130.0, 70.0, 142.0, 10.5), (2, "x", 60.0, 100.0, 70.0, 112.0, 10.5)]
    df = spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    got = [(r.page, r.line, r.text, r.x1, r.n) for r in stitched(df, ["page"]).orderBy("page", "line").collect()]
    assert got == [(1, 0, "one two", 140.0, 2), (1, 1, "far", 340.0, 1), (1, 2, "", 70.0, 1), (2, 0, "x", 70.0, 1)]
    assert stitched(df.limit(0), ["page"]).count() == 0


def test_settings_files(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"circled_numbers": {"1": "①"}, "numeric_range_tilde": "-"}))
    (tmp_path / "bad.json").write_text("{")
    assert sorted(tuple(r) for r in config.symbol_map(spark, str(tmp_path / "map.json")).collect()) == [("circled_numbers", "1", "①"), ("numeric_range_tilde", "~", "-")]
    assert config.symbol_map(spark, str(tmp_path / "none.json")).count() == config.symbol_map(spark, str(tmp_path / "bad.json")).count() == 31
    assert config.corrections(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "fix.json").write_text(json.dumps({"己经": "已经"}))
    assert [tuple(r) for r in config.corrections(spark, str(tmp_path / "fix.json")).collect()] == [("己经", "已经")]
    fonts = spark.createDataFrame([(1, "A", "H1", "Heading 1", None), (2, "B", "", "標題 1", None), (3, "C", None, "KaiTi", None), (4, "D", "正文", "", None)], "k int, font string, role string, docx_style string, mapped_by string")
    got = {r.key: r.style for r in config.style_mapping(fonts, [], "k").collect()}
    assert got == {"h1": "Heading 1", "kaiti": "KaiTi"}
    files = spark.createDataFrame([("x", "{"), ("y", None), ("z", '{"F": {"role": "H1"}, "G": "s"}')], "book string, json string")
    assert [(r.book, r.font) for r in config.font_roles(files, "json").collect()] == [("z", "F")]


@pytest.mark.parametrize(
    "text,mark,number,want",
    [
        ("正文①继续。", "①", 1, "正文T继续。"), ("正文[2]继续。", "※", 2, "正文T继续。"), ("见第 3. 页，又3. 文", "3.", None, "见第 3. 页，又T 文"), ("他说a。", "a", 1, "他说T。"), ("Latin a b", "a", 1, "Latin a b"),
        ("他说C。", "", 3, "他说T。"), ("没有", "", None, "没有"), ("", "①", 1, ""),
    ],
)
def test_replace_mark(text, mark, number, want):
    from quire.operators.footnotes import replace_mark

    assert replace_mark(text, mark, number, "T") == (want, "T" in want)


def test_linked_footnotes(spark):
    from quire.operators.footnotes import linked

    pages = spark.createDataFrame([("b", 1, "甲①乙②。"), ("b", 2, None), ("b", 3, "无注")], "book string, page_num int, text string")
    notes = spark.createDataFrame([("b", 1, 2, 2, "②"), ("b", 1, 1, 1, "①"), ("b", 1, 3, 3, "③"), ("b", 2, 1, 1, None), ("b", 2, 2, None, None)], "book string, page_num int, seq int, id int, mark string")
    got = {r.page_num: (r.text, r.n_notes, r.n_matched) for r in linked(pages, notes, ["book"]).collect()}
    assert got == {1: ("甲[^p1_1]乙[^p1_2]。", 3, 2), 2: ("", 2, 0), 3: ("无注", 0, 0)}


def test_task_feed_and_queues(spark):
    from quire.operators import tasks as K

    rows = [(1, 1, 1, "queued"), (1, 2, 2, "running"), (1, 3, 3, "completed"), (1, 4, 4, "running"), (2, 1, 5, "queued")]
    log = spark.createDataFrame(rows, "task_id int, ts int, event_id int, status string")
    assert sorted((r.task_id, r.number, r.event_id) for r in K.feed(log).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 5)]
    who = spark.createDataFrame([("x", 1), ("y", None), ("z", 9)], "subscriber string, task_id int")
    assert sorted(tuple(r) for r in K.subscriber_queues(log, who, 2).collect()) == [("x", 3), ("x", 4), ("y", 3), ("y", 4)]
    assert sorted((r.task_id, r.event_id) for r in K.enqueued(log.limit(2), log.filter("event_id = 5")).collect()) == [(1, 2), (2, 5)]
    assert K.feed(log.limit(0)).count() == 0


@pytest.mark.parametrize(
    "prev,curr,want",
    [
        (("他和朋友走到山下看见一条很长很长的河流在那里，", 10.5, "", 3, 400.0), ("水流很急，他们停了下来看着河面上的船只。", 10.5, "", 2, 60.0), True),
        (("他和朋友走到山下。", 10.5, "", 3, 400.0), ("水流很急，他们停了下来看着河面上的船只。", 10.5, "", 2, 60.0), False),
        (("他说：“山下有河。", 10.5, "", 3, 400.0), ("水流很急。”他们停了下来看着河面上的船只。", 10.5, "", 2, 60.0), True),
        (("他和朋友走到山下看见一条很长很长的河流在那里，", 10.5, "", 3, 400.0), ("（一）水流很急，他们停了下来。", 10.5, "", 2, 60.0), False),
        (("他和朋友走到山下看见一条很长很长的河流在那里，", 10.5, "", 3, 400.0), ("水流很急，他们停了下来看着河面上的船只。", 12.0, "", 2, 60.0), False),
        (("他和朋友走到山下看见一条很长很长的河流在那里，", 10.5, "", 3, 400.0), ("水流很急，他们停了下来看着河面上的船只。", 10.5, "", 2, 81.0), False),
        (("山下的河", 10.5, "", 1, 120.0), ("水流很急，他们停了下来看着河面上的船只。", 10.5, "", 2, 60.0), False),
        (("", 10.5, "", 3, 400.0), ("水流很急。", 10.5, "", 2, 60.0), False),
    ],
)
def test_goes_on(spark, prev, curr, want):
    from quire.operators.folds import open_brackets

    row = [(*prev, 400.0, *curr, curr[0], 400.0)]
    df = spark.createDataFrame(row, "a_text string, a_size double, a_style string, a_lines int, a_x1 double, a_far double, b_text string, b_size double, b_style string, b_lines int, b_x0 double, b_raw string, b_x1 double")
    opened = R.unclosed(F.col("a_text"), open_brackets(F.col("a_text")))
    assert df.select(R.goes_on("a", "b", opened, 10.5, 60.0, 595.0).alias("v")).first().v is want
