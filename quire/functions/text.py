"""Scalar text functions as Column expressions.

Patterns that came from a Unicode-aware dialect start with (?U), as the JVM's
\\s, \\d and \\w are ASCII otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns, glyph ranges and word lists that decide results.
CITATIONS = (
    r"\[[A-Z]+(?:/[A-Z]+)?\]",
    r"(?:出版社|出版|Press)",
    r"(?:\d{4}\s*年\s*版|\d{4}\s*年|\d{4}\s*[:：]\s*\d+)",
    r"(?:第\s*\d+\s*页|[Pp]\.?\s*\d+)",
    r"(?:参阅|参见|转引自|主编)",
)
BOOK_TITLE = r"《[^》]+》"
BOOK_CUE = r"(?:\[[MJZD]\]|著|主编|编著|等编|译|\d{4}|第\s*\d+\s*页|[Pp]\.?\s*\d+|出版)"
TERMINAL = "[。！？；!?;][”’\"'）\\)\\]】」』]*$"
CONTINUING = "[，、：:,]$"
KAITI = ("kaiti", "kai_ti", "fzkt", "fzkai", "stkaiti", "kai", "楷")
TITLE_FONTS = ("hei", "黑", "fzht", "fzhei", "simhei", "yahei", "stheiti", "fzlt", "fzdbs", "fzxbs", "fzcs", "fzqk", "fzbw", "fzl2", "fzzys", "sourcehanserifcn-bold", "title")
METER_DROPPED = "[\\s\\u3000\\u2000-\\u200b，。？！、；：“”‘’（）《》〈〉【】—…·\\-.,;:!?'\"()\\[\\]{}]+"
HALF_WIDTH = ("０１２３４５６７８９．：", "0123456789.:")
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
NUMERALS = "一二三四五六七八九"
PAGE_LABELS_AS_TEXT = ("pagefooter", "pageheader", "page-footer", "page-header", "listitem", "list-item", "textinlinemath")
STRUCTURAL_LABELS = ("table", "picture", "figure", "image", "caption", "footnote")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def strong_citation(c: Column) -> Column:
    hit = F.lit(False)
    for p in CITATIONS:
        hit = hit | F.rlike(c, F.lit(f"(?U){p}"))
    return F.coalesce(hit | (F.rlike(c, F.lit(BOOK_TITLE)) & F.rlike(c, F.lit(f"(?U){BOOK_CUE}"))), F.lit(False))


def terminal_punctuation(c: Column) -> Column:
    return F.rlike(strip(c), F.lit(TERMINAL))


def continuing_punctuation(c: Column) -> Column:
    return F.rlike(strip(c), F.lit(CONTINUING))


def hallucinated(c: Column, share: float = 0.15) -> Column:
    """Over 15 characters with few distinct ones, or one unit of up to ten six times in a row."""
    few = F.size(F.array_distinct(F.split(c, ""))) / F.length(c) < share
    return (F.length(c) > 15) & (few | F.rlike(c, F.lit(r"(?s)(.{1,10}?)\1{5,}")))


def few_distinct(c: Column, share: float = 0.15) -> Column:
    return (F.length(c) > 15) & (F.size(F.array_distinct(F.split(c, ""))) / F.length(c) < share)


def non_prose(c: Column, label: Column) -> Column:
    starts = F.lit(False)
    for p in ("#", "![", ">", "|", "[^"):
        starts = starts | c.startswith(p)
    return (F.length(c) == 0) | F.lower(label).isin(*STRUCTURAL_LABELS) | starts


def layout_label(c: Column) -> Column:
    n = F.trim(F.lower(c))
    return F.when(n.isin(*PAGE_LABELS_AS_TEXT) | (n == ""), "text").when(n.isin("sectionheader", "section-header"), "section-header").otherwise(n)


def marker_type(c: Column) -> Column:
    m = strip(c)
    return (
        F.when(m == "", "empty")
        .when(F.rlike(m, F.lit("^[①-⓿➀-➓㉑-㉟]")), "circled")
        .when(F.rlike(m, F.lit(r"^[\[［〔【]")), "bracket")
        .when(F.rlike(m, F.lit("^[⁰¹²³⁴⁵⁶⁷⁸⁹]")), "superscript")
        .when(m.startswith("注"), "zhu")
        .when(F.rlike(m, F.lit("^[(（]")), "paren")
        .when(F.rlike(m, F.lit("^[a-jA-J]")), "alpha")
        .otherwise("dot")
    )


def marker_number(c: Column) -> Column:
    """Circled 1-20, superscript digits, the place of a letter, the first digits, else 1; null for a number beyond 32 bits."""
    supers = F.regexp_replace(c, "[^⁰¹²³⁴⁵⁶⁷⁸⁹]", "")
    letter = F.lower(F.regexp_extract(c, "[a-zA-Z]", 0))
    digits = F.regexp_extract(c, r"\d+", 0)
    return (
        F.when(F.rlike(c, F.lit("^[①-⑳]$")), F.ascii(c) - 0x2460 + 1)
        .when(supers != "", F.translate(supers, *SUPERSCRIPTS).try_cast("int"))
        .when(letter != "", F.ascii(letter) - 96)
        .when(digits != "", digits.try_cast("int"))
        .otherwise(1)
    )


def circled_number(n: Column) -> Column:
    """1-50 as one glyph, else in parentheses."""
    glyph = lambda start, first: F.decode(F.unhex(F.lpad(F.hex(F.lit(start) + n - first), 4, "0")), "UTF-16BE")
    return F.when(n.between(1, 20), glyph(0x2460, 1)).when(n.between(21, 35), glyph(0x3251, 21)).when(n.between(36, 50), glyph(0x32B1, 36)).otherwise(F.concat(F.lit("("), n.cast("string"), F.lit(")")))


def numeral(c: Column) -> Column:
    """ASCII digits, up to four positional CJK digits, or hundreds and tens; null below 1 and for anything else."""
    t = F.regexp_replace(strip(c), r"(?U)^[·*•\-—~第\s]+|[·*•\-—~页頁\s]+$", "")
    value = lambda s: F.translate(s, "零〇" + NUMERALS, "00123456789").cast("int")
    formal = "^(?:([一二三四五六七八九])百)?(?:([一二三四五六七八九]?)十)?(?:[零〇]?([一二三四五六七八九]))?$"
    part = lambda k: F.regexp_extract(t, formal, k)
    worth = lambda s: F.coalesce(F.when(s != "", value(s)), F.lit(0))
    tens = F.when(t.contains("十"), F.when(part(2) != "", value(part(2))).otherwise(1) * 10).otherwise(0)
    n = (
        F.when(F.rlike(t, F.lit("^[0-9]{1,9}$")), t.cast("int"))
        .when(F.rlike(t, F.lit("^[〇零一二三四五六七八九]{1,4}$")), value(t))
        .when((t != "") & F.rlike(t, F.lit(formal)), worth(part(1)) * 100 + tens + worth(part(3)))
    )
    return F.when(n >= 1, n)


def kaiti_font(c: Column) -> Column:
    return any_of(F.trim(F.lower(c)), KAITI)


def title_font(c: Column) -> Column:
    return any_of(F.trim(F.lower(c)), TITLE_FONTS)


def meter_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"(?U){METER_DROPPED}", ""))


def poetry_rhythm(lengths: Column) -> Column:
    """All five or all seven (three lines or more), or five and seven in turns (an even number, four or more)."""
    n = F.size(lengths)
    same = lambda k: F.forall(lengths, lambda x: x == k)
    turns = lambda a, b: F.size(F.filter(lengths, lambda x, i: x != F.when(i % 2 == 0, a).otherwise(b))) == 0
    return (n >= 3) & (same(5) | same(7) | ((n >= 4) & (n % 2 == 0) & (turns(5, 7) | turns(7, 5))))


def normal_title(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "(?U)[\\s①-⑳]+", ""), *HALF_WIDTH)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; 0 where one is empty."""
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def skeleton(c: Column, badges: tuple[str, ...] = ()) -> Column:
    """What must survive a rewrite: CJK, letters and digits, without style fences, images and the given badges."""
    c = F.regexp_replace(c, r":::\s*\{custom-style=\"[^\"]+\"\}|:::|\{custom-style=\"[^\"]+\"\}", "")
    c = F.regexp_replace(c, r"!\[.*?\]\(.*?\)(?:\{.*?\})?", "")
    for b in badges:
        c = F.replace(c, F.lit(b), F.lit(""))
    return F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2ceaf}A-Za-z0-9]", "")


def redact(c: Column, most: int = 200) -> Column:
    """Paths, quotes and line ends out of a diagnostic text, which is cut to length."""
    c = F.regexp_replace(c, r"(?:[A-Za-z]:)?[\\/](?:[^\s\\/:]+[\\/])+[^\s\\/:]*", "<path>")
    return F.substring(F.trim(F.regexp_replace(c, "[\"'\\r\\n]+", " ")), 1, most)


def katex_fence(c: Column, isolated: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", "").when(isolated, F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), t, F.lit("$")))


def caption_type(c: Column) -> Column:
    t = strip(c)
    return F.when(F.rlike(t, F.lit(r"(?iU)^(?:表|table)\s*[\d\-.]+")), "table").when(F.rlike(t, F.lit(r"(?iU)^(?:图|圖|figure)\s*[\d\-.]+")), "figure")


def pipe_table(c: Column) -> Column:
    """Whether a text is a pipe table: two lines or more, all between pipes."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith("|") & x.endswith("|"))


def pipe_rows(c: Column) -> Column:
    """Cells of a pipe table's rows, the ruling row left out."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.rlike(x, F.lit(r"^\|[\s:|-]+\|$")))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))


def to_pipe_table(c: Column) -> Column:
    """Lines with columns apart by two blanks or a tab as a pipe table, ragged rows filled; other texts as they are."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.transform(lines, lambda x: F.split(x, r"\s{2,}|\t"))
    most = F.array_max(F.transform(rows, F.size))
    full = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))))
    text = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    made = F.array_join(F.concat(F.array(text(F.get(full, F.lit(0))), text(F.array_repeat(F.lit("---"), most))), F.transform(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), text)), "\n")
    return F.when(c.startswith("|") | (F.size(lines) < 2) | (most < 2), c).otherwise(made)


def sized_images(c: Column, width: str = "60%") -> Column:
    """Image tags without a width get one; internal alternative texts are emptied."""
    c = F.regexp_replace(c, r"!\[(?:__[^\]]*__|image)\]\(", "![](")
    return F.regexp_replace(c, r"(!\[[^\]]*\]\([^)]+\))(?!\{)", f"$1{{width={width}}}")


def suspicious_class(point: Column) -> Column:
    """Kind of a code point that print rarely has; null for ordinary ones."""
    return (
        F.when(point.between(0xE000, 0xF8FF), "private_use")
        .when(point == 0xFFFD, "replacement")
        .when(point.between(0x2E80, 0x2FDF), "radical")
        .when(point.between(0x3400, 0x4DBF), "extension_a")
        .when(point >= 0x20000, "extension_b")
    )


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def without_think(c: Column) -> Column:
    """A model's answer without its thinking, closed or not, and without an outer code fence."""
    c = strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))
    c = F.regexp_replace(c, r"(?U)^```(?:markdown|json|text)?\s*\n?", "")
    return strip(F.regexp_replace(c, r"(?U)\n?```\s*$", ""))


# Font families by keyword, in order; function words; header patterns; progress lines.
FONT_FAMILIES = (
    ("kaiti", KAITI),
    ("fangsong", ("fangsong", "fang_song", "fzfs", "stfangsong", "仿宋")),
    ("songti", ("songti", "song_ti", "fzss", "fzsong", "stsong", "simsun", "nsimsun", "mingliu", "pmingliu", "宋", "明體", "明朝")),
    ("heiti", ("heiti", "hei_ti", "fzht", "fzhei", "stheiti", "simhei", "yahei", "pingfang", "notosans", "sourcehansans", "黑")),
    ("other", ("helv", "arial", "times", "courier", "calibri", "cambria", "georgia", "verdana", "tahoma", "symbol", "roboto", "opensans", "latin", "italic", "oblique")),
)
FUNCTION_WORDS = "的了在是有与和于为以从到对"
PAGE_HEADERS = r"(?U)^[上下中]篇[:：|｜]|第[一二三四五六七八九十百]+章|^/\s*\d+|^\d+\s*/|^\d{1,4}$|^(?:目\s*录|序|结语|主要参考文献|后\s*记)\s*/|/\s*(?:目\s*录|序|结语|主要参考文献|后\s*记)"
NOISE = r"^(?:Traceback |File \"|UserWarning:|FutureWarning:|DeprecationWarning:|RuntimeWarning:|warnings\.warn\()|site-packages"
PROGRESS = ("[INFO]", "[WARN]", "[ERROR]", "[PROGRESS]", "[STAGE]", "[EngineDispatcher]", "[FontMap]", "[AI-Kaiti]", "Page ", "頁", "完成", "提取", "建構", "正在", "處理")


def font_tag(c: Column) -> Column:
    name = F.trim(F.lower(c))
    out = F.when(name == "", F.lit(None).cast("string"))
    for tag, words in FONT_FAMILIES:
        out = out.when(any_of(name, words), tag)
    return out


def function_words(c: Column) -> Column:
    """Number of function words in a text."""
    return F.length(F.regexp_replace(c, f"[^{FUNCTION_WORDS}]", ""))


def progress_line(c: Column) -> Column:
    s = strip(c)
    return (s != "") & ~F.rlike(s, F.lit(NOISE)) & any_of(s, PROGRESS)


def page_header(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> Column:
    """A narrow strip at a side, or text in the top 13 % that looks like a running head, or a number or short path in the top 11 %."""
    side = ((x0 > width * 0.88) | (x1 < width * 0.12)) & (x1 - x0 < 25)
    t = strip(text)
    looks = F.rlike(t, F.lit(PAGE_HEADERS)) | ((y0 < height * 0.11) & (F.rlike(t, F.lit(r"(?U)^\d+$")) | ((F.length(t) <= 30) & t.contains("/"))))
    return side | ((y1 <= height * 0.13) & (t != "") & looks)


def page_footer(text: Column, y0: Column, height: float) -> Column:
    return (y0 >= height * 0.90) & F.rlike(text, F.lit(r"(?U)^\s*\d{1,4}\s*$"))


def toc_title_level(c: Column) -> Column:
    """3 for parenthesised and triple-decimal titles, 1 for parts, chapters and special pages, else 2."""
    one = r"(?U)^(?:[上下中]\s*篇|第[一二三四五六七八九十百零]+[章卷篇編]|目錄|目录|序|結語|结语|後記|后记|前言|附錄|附录|主要參考文獻|主要参考文献)"
    three = r"(?U)^(?:[(（][一二三四五六七八九十\d]+[)）]|\d+\.\d+\.\d+)"
    return F.when(F.rlike(c, F.lit(one)), 1).when(F.rlike(c, F.lit(three)), 3).otherwise(2)


def toc_line(c: Column) -> Column:
    chapter = F.rlike(c, F.lit("^第[一二三四五六七八九十百]+[章節条條篇卷]")) & F.rlike(c, F.lit(r"(?U)\d+\s*$"))
    return F.rlike(c, F.lit(r"(?U)[…·.]{2,}\s*\d+|\t\s*\d+\s*$")) | chapter


def restored_symbols(c: Column) -> Column:
    """Cut brackets of numerals, circled numbers read as digits, tildes in ranges, image tags without an image."""
    c = F.regexp_replace(c, r"(?mU)^(\s*(?:>|\*|#)*\s*[*#]{0,3}\s*)([一二三四五六七八九十]+)[)）]", "$1（$2）")
    for n in range(20, 0, -1):
        c = F.regexp_replace(c, rf"(?mU)^(\s*(?:>|\*)*\s*){n}(?=[一-龥])", f"$1{chr(0x245F + n)}")
    c = F.regexp_replace(c, r"(?U)(?<=\d)\s*~\s*(?=\d)", "～")
    return F.regexp_replace(c, r"(?mU)^\s*!\[[^\]]*\]\(\s*\)(?:\{[^\n}]*\})?\s*\n?", "")


def split_circled(c: Column) -> Column:
    """A line end before circled numbers that do not begin a line."""
    return F.regexp_replace(c, r"(?U)(?<=[^\n])\s*([①②③④⑤⑥⑦⑧⑨⑩])", "\n$1")


BOUNDARY_TAGS = ("===HUMAN_EDITED_END===", "<!-- END_OF_SEED -->", "【人工整稿截止】", "【人工修改截止】", "===人工修改截止===")


def without_boundary_tags(c: Column) -> Column:
    for tag in BOUNDARY_TAGS:
        c = F.replace(c, F.lit(tag), F.lit(""))
    return strip(c)


def boundary_tag(c: Column) -> Column:
    return strip(c).isin(*BOUNDARY_TAGS)


def valid_table(cells: Column, width: Column, height: Column, page_width: float) -> Column:
    """Cells (array of rows) of a real table: large enough, more than one cell filled, enough characters for its width."""
    texts = F.filter(F.transform(F.flatten(cells), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")), lambda x: x != "")
    chars = F.aggregate(texts, F.lit(0), lambda a, x: a + F.length(x))
    return (width > 10) & (height > 10) & ~((width < page_width * 0.28) & (chars <= 8)) & (F.size(texts) > 1) & (chars > 4)
