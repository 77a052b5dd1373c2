"""Rules about citations, endings, headings, styles and reviews as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Patterns, word lists and limits that decide results.
CITED = (
    r"(?:[:：;；]|[Pp]\.?|[Pp][Pp]\.?|[Vv]ol\.?|[Nn]o\.?|[Pp]ages?\.?|第|[卷页頁册冊部篇期年版]|[\-–—~～/\\]|\d+\s*[,，]"
    r"|(?:^|[^\p{L}\p{N}_])(?:18|19|20)\d{2}[.、,，]?|\[[A-Z]+(?:/[A-Z]+)?\]\.?)\s*$"
)
URL_TAIL = r"https?://[^\s]*$|www\.[^\s]*$"
ASCII_TAIL = r"[a-zA-Z]$"
YEAR_MARKER = r"^\d{4}[.、]"
PLAIN_MARKER = r"^[\d.、\s]+$"
REF_TAGS = r"(?:\[\^p\d+_\d+\])+\s*$"
TRAILING_MARKS = r"(?:\[\d+(?:[-–,，]\d+)*\]|[①-⑳]|\^\[\d+\])+$"
TERMINAL_END = r"(?:[。！？!?…]+|[\x{4e00}-\x{9fff}]．|(?:^|[^\d])(?:18|19|20)\d{2}．)[”’」』）)\]】]*$"
CLOSING = "[”’」』）)\\]】\"']+$"
ABBREVIATION = r"(?i)(?:(?:^|[^\p{L}\p{N}_])(?:p|pp|vol|no|fig|dr|mr|ms|vs|etc|ed|eds|st|ch|sec)|et\s+al|e\.g|i\.e|(?:^|[^\p{L}\p{N}_])[A-Za-z]\.(?:[A-Za-z]\.)*)\.$"
HEAD_1 = r"^第[一二三四五六七八九十百零\d]+[章卷編篇]", r"(?i)^(?:Chapter|Part)\s*\d+", r"^(?:附錄|附录|參考文獻|参考文献|前言|序言|楔子|跋|後記|后记|目錄|目录|序|结语|主要参考文献)$"
HEAD_2 = r"^第[一二三四五六七八九十百零\d]+[節条條节讲講回]", r"^\d+\.\d+(?:[^.]|$)"
HEAD_3 = r"^[一二三四五六七八九十百\d]+[、. ]", r"^\d+\.\d+\.\d+", r"^[(（][一二三四五六七八九十\d]+[)）]", r"^[①-⑩]"
HEAD_PREFIX = r"^(?:第[一二三四五六七八九十\d]+[章节回集卷篇]|(?:[（(]?[一二三四五六七八九十\d]+[)）]?[.、\s]?))"
HEAD_ENDS = "。，.！？；：、"
CAPTION = r"(?i)^(?:表|圖|图|Table|Figure)\s*[\d\-\.]+[.、:：\s]"
BODY_WORDS = "[的了在是有與和於為以從到對但又及]"
HEAD_WORDS = "的了在是有与和于为以从到对"
HEADLIKE_STOPS = "[。，；！？:：]"
CHART_END = r"示意图|表$"
BOLD_FONTS = "hei|黑|bold|bd|heavy"
LATIN_FONTS = "times|arial|helvetica|georgia|courier|symbol"
STYLED = r'(?s)^:::\s*\{custom-style="([^"]+)"\}\s*\n(.*?)\n:::(\s*(?:\[\^p\d+_\d+\]\s*)*)$'
CJK_EDGE = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
DECIMAL_3 = r"^\d+\.\d+\.\d+(?:[\s　]+[^\n]{1,40})?$"
STYLE_LEVELS = {1: r"(?i)標題\s*1|heading\s*1", 2: r"(?i)標題\s*2|heading\s*2", 3: r"(?i)標題\s*3|heading\s*3"}
FONT_ROLES = {
    "H1": ("h1", "heading1", "標題1", "标题1", "一級標題", "一级标题"),
    "H2": ("h2", "heading2", "標題2", "标题2", "二級標題", "二级标题"),
    "H3": ("h3", "heading3", "標題3", "标题3", "三級標題", "三级标题"),
    "圖說": ("caption", "圖說", "图说", "圖片標籤", "圖表說明"),
    "楷體": ("quote", "kaiti", "楷體", "楷体", "引言", "引文"),
    "正文": ("body", "正文"),
    "忽略": ("忽略",),
}
#: Roles of fonts, by the key of the style that they name; then what a style's own name says.
STYLE_KEYS = {
    "h1": ("h1",), "h2": ("h2",), "h3": ("h3",), "body": ("正文", "內文", "body"),
    "image_caption": ("圖說", "图说", "caption", "image_caption"), "kaiti": ("楷體", "楷体", "kaiti", "blockquote"),
}
STYLE_NAMES = {**{f"h{k}": v for k, v in STYLE_LEVELS.items()}, "image_caption": r"(?i)圖說|图说|caption", "kaiti": r"(?i)楷|kai", "body": r"(?i)正文|內文|normal|body"}
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]", "0.0.0.0")
PRIVATE_HOST = r"^10\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\."
LOCAL_DEFAULT = "http://localhost:11434"


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(f"(?U){pattern}"))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def after_citation(prefix: Column, context: Column) -> Column:
    """Whether the text before a place ends like a citation, an address or a Latin word; a blank one is seen after its context."""
    blank = (strip(prefix) == "") & (context != "")
    before = rstrip(F.when(blank, F.concat(context, F.lit(" "), prefix)).otherwise(prefix))
    return matches(before, CITED) | matches(before, f"{URL_TAIL}|{ASCII_TAIL}")


def continues_citation(marker: Column, number: Column, previous: Column) -> Column:
    """Whether a marker is a year, or a number that goes on with the citation before it."""
    year = number.between(1800, 2100) & matches(marker, YEAR_MARKER)
    tail = matches(previous, CITED) | matches(previous, URL_TAIL)
    return year | ((F.coalesce(previous, F.lit("")) != "") & matches(marker, PLAIN_MARKER) & F.coalesce(tail, F.lit(False)))


def ends_sentence(c: Column) -> Column:
    """Whether a paragraph is complete at the end of its page: marks and tags aside, a final stop that is no abbreviation's."""
    plain = F.regexp_replace(rstrip(F.regexp_replace(c, REF_TAGS, "")), TRAILING_MARKS, "")
    core = rstrip(F.regexp_replace(plain, CLOSING, ""))
    return F.rlike(plain, F.lit(TERMINAL_END)) | (core.endswith(".") & ~F.rlike(core, F.lit(ABBREVIATION)))


def body_words(c: Column) -> Column:
    """Whether a text has two function words or more; one of them counts double."""
    count = lambda p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    return count(BODY_WORDS) + count("從") >= 2


def block_level(text: Column, lines: Column, bold: Column, x0: Column, x1: Column, page_width: float, toc: Column | None = None) -> Column:
    """Heading level of a block, 0 for none: its wording, the contents list, its place and weight, in this order."""
    t = strip(text)
    any_of = lambda patterns: F.greatest(*(F.rlike(t, F.lit(p)) for p in patterns))
    worded = F.when(any_of(HEAD_1), 1).when(any_of(HEAD_2), 2).when(any_of(HEAD_3), 3).otherwise(0)
    n = F.length(t)
    stops = F.rlike(t, F.lit(f"[{HEAD_ENDS}]$|[。！？].")) | F.rlike(t, F.lit(CAPTION))
    centred = F.abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.1
    out = F.when((n == 0) | (n > 25) | stops, 0)
    if toc is not None:
        out = out.when(F.coalesce(toc, F.lit(0)) > 0, toc)
    out = out.when(worded > 0, worded).when(centred & (n < 20) & ~body_words(t), 2)
    return out.when(bold & (n < 20) & (lines <= 1) & ~body_words(t) & ~F.rlike(t, F.lit("[的了]$")), 3).otherwise(0)


def heading_like(text: Column, x0: Column, x1: Column, page_width: float) -> Column:
    """Whether a line may be a heading: marked, numbered, placed like one, or short and without stops."""
    t = strip(F.regexp_replace(text, "^#+", ""))
    words = F.lit(0)
    for w in HEAD_WORDS:
        words = words + t.contains(w).cast("int")
    short = (F.length(t) <= 20) & ~F.rlike(t, F.lit(HEADLIKE_STOPS)) & (words <= 1)
    level = block_level(t, F.lit(1), F.lit(False), x0, x1, page_width) > 0
    return text.startswith("#") | ((t != "") & (matches(t, HEAD_PREFIX) | level | short))


def geometric_level(text: Column, font: Column, flags: Column, size: Column, body_font: str, body_size: float, x0: Column, x1: Column, base_x0: float, page_width: float) -> Column:
    """Heading level by size, weight, font and place; 0 for none."""
    name = F.lower(F.regexp_replace(font, r"^[^+]*\+", ""))
    bold = F.rlike(F.lower(font), F.lit(BOLD_FONTS)) | (flags.bitwiseAND(F.lit(16)) != 0)
    other = ~F.rlike(name, F.lit(LATIN_FONTS)) & (name != body_font.lower())
    centred = (F.abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.12) & (x0 > base_x0 + 10) & (F.abs(x0 - (page_width - x1)) < max(25.0, page_width * 0.08))
    ends = F.rlike(text, F.lit("[的了在]$"))
    out = F.when(F.rlike(text, F.lit(CHART_END)) | F.rlike(text, F.lit("^[①-⑩]")), 0)
    out = out.when((size >= body_size + 1.5) | (centred & (size >= body_size + 0.5)), 2)
    return out.when(bold & (other | (size >= body_size)) & ~ends, 3).when(centred & (bold | other) & (size >= body_size - 0.5) & ~ends, 2).otherwise(0)


def mapped_level(role: Column, style: Column, ignored: Column) -> Column:
    """Heading level that a font's role, else its style, states."""
    out = F.when(ignored, 0).when(F.coalesce(role, F.lit("")) != "", F.when(F.upper(role).isin("H1", "H2", "H3"), F.substring(role, 2, 1).cast("int")).otherwise(0))
    for level, pattern in STYLE_LEVELS.items():
        out = out.when(F.rlike(style, F.lit(pattern)), level)
    return out.otherwise(0)


def footer_tolerance(body_size: Column) -> Column:
    return F.greatest(F.lit(3.0), F.coalesce(body_size, F.lit(0.0)) * 0.35)


def unwrapped(c: Column) -> Column:
    """Struct of a styled block's text, style and trailing tags; a plain text has no style."""
    part = lambda i: F.regexp_extract(c, STYLED, i)
    styled = F.rlike(c, F.lit(STYLED))
    text = F.when(styled, strip(part(2))).otherwise(strip(F.coalesce(c, F.lit(""))))
    return F.struct(text.alias("text"), F.when(styled, part(1)).alias("style"), F.when(styled, strip(part(3))).otherwise("").alias("tags"))


def styled(text: Column, style: Column) -> Column:
    """A block in a style; without one the text itself."""
    return F.when(F.coalesce(style, F.lit("")) != "", F.concat(F.lit('::: {custom-style="'), style, F.lit('"}\n'), text, F.lit("\n:::"))).otherwise(text)


def caption_block(text: Column, style: Column) -> Column:
    return F.when(F.coalesce(style, F.lit("")) != "", styled(text, style)).otherwise(F.concat(F.lit("*"), text, F.lit("*")))


def trailing_heading(text: Column, style: Column) -> Column:
    """Markdown of a heading at a paragraph's end: third level if numbered by three parts, else second."""
    marks = F.when(F.rlike(text, F.lit(DECIMAL_3)), "### ").otherwise("## ")
    return F.concat(marks, text, F.when(F.coalesce(style, F.lit("")) != "", F.concat(F.lit(' {custom-style="'), style, F.lit('"}'))).otherwise(""))


def spliced(a: Column, b: Column) -> Column:
    """Two lines of a paragraph: a blank between them unless CJK characters meet."""
    tight = F.rlike(a, F.lit(f"{CJK_EDGE}$")) & F.rlike(b, F.lit(f"^{CJK_EDGE}"))
    return F.when(a == "", b).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def font_role(c: Column) -> Column:
    """The role that a name stands for; null for none."""
    names = {n.lower(): role for role, more in FONT_ROLES.items() for n in (role, *more)}
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.element_at(known, F.lower(strip(c)))


def style_key(role: Column, style: Column) -> Column:
    """The key under which a font's style is used, by its role, else by the style's name."""
    known = F.create_map(*(F.lit(x) for key, names in STYLE_KEYS.items() for n in names for x in (n, key)))
    named = F
    for key, pattern in STYLE_NAMES.items():
        named = named.when(F.rlike(style, F.lit(pattern)), key)
    return F.coalesce(F.element_at(known, F.lower(strip(F.coalesce(role, F.lit(""))))), named)


def model_name(c: Column, aliases: dict[str, str], default: str) -> Column:
    """A model's name with aliases resolved; default for none."""
    t = strip(F.coalesce(c, F.lit("")))
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.when(t == "", default).otherwise(F.coalesce(F.element_at(known, F.lower(t)), t))


def local_address(url: Column) -> Column:
    """The address without closing slashes if its host is this machine or a private network's; the default for none; null if it is refused."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), F.lit("")))
    return F.when(host == "", LOCAL_DEFAULT).when(host.isin(*LOCAL_HOSTS) | F.rlike(host, F.lit(PRIVATE_HOST)), F.regexp_replace(url, "/+$", ""))


def degenerate(width: Column, height: Column, contrast: Column, least: int = 3) -> Column:
    """Whether an image part is too small or too even to be read."""
    return F.coalesce((width < 2) | (height < 2) | (contrast < least), F.lit(True))


def column_of(centre: Column, bounds: Column) -> Column:
    """Number of the first interval (x0, x1) that holds the centre, else of the one whose middle is nearest."""
    inside = F.array_position(F.transform(bounds, lambda b: centre.between(b["x0"], b["x1"])), True) - 1
    far = F.transform(bounds, lambda b: F.abs(centre - (b["x0"] + b["x1"]) * 0.5))
    return F.when(inside >= 0, inside).otherwise(F.array_position(far, F.array_min(far)) - 1)


# Fixed values of paragraphs that go on over a page's end: patterns and limits.
OPENING_END = r"[《“（(\[〈]$"
CONTENTS_LINE = r"[\.…·ć\x08\-_]{2,}\s*\d+$"
PARAGRAPH_START = r"^(?:[（(]?[一二三四五六七八九十\d]+[)）、.．](?:[^0-9%％]|$)|[\[［【]\s*\d+\s*[\]］】](?:[^，。；：、,.]|$)|[①-⑳]|[•●◆■※★\-])"
YEAR_START = r"^(?:18|19|20)\d{2}[.．]"
HEAD_PREFIXES = r"(?i)^(?:第[一二三四五六七八九十百零\d]+[章節條条回讲講篇卷]|(?:Chapter|Part)\s*\d+|[一二三四五六七八九十百\d]+[、. 　]+|[（(][一二三四五六七八九十\d]+[)）]|\d+\.\d+(?:\.\d+)?)\s*"
STOPS = "[。，；？！“”‘’：:]"


def bare_heading(c: Column) -> Column:
    """A text without blanks, circled numbers and a heading's number: what its length as a heading is taken of."""
    return F.regexp_replace(F.regexp_replace(c, r"[①-⑳\s]", ""), HEAD_PREFIXES, "")


def unclosed(c: Column, open_brackets: Column) -> Column:
    """Whether a text stops within brackets or quotes; open_brackets: those left open, in order."""
    more = lambda a, b: F.length(F.regexp_replace(c, f"[^{a}]", "")) > F.length(F.regexp_replace(c, f"[^{b}]", ""))
    return F.rlike(c, F.lit(OPENING_END)) | (F.size(open_brackets) > 0) | more("《", "》") | more("“", "”") | more("（", "）") | more("(", ")")


def goes_on(prev: str, curr: str, is_unclosed: Column, body_size: float, base_x0: float, page_width: float) -> Column:
    """Whether a page's first paragraph (curr) goes on with the last of the page before (prev).

    Columns <p>_text, <p>_size (of font), <p>_style, <p>_lines (number); prev_x1 (end of its
    last line) and prev_far (the page's right margin); curr_raw (its first line), curr_x0 and curr_x1.
    """
    a, b = (lambda n: F.col(f"{prev}_{n}")), (lambda n: F.col(f"{curr}_{n}"))
    before, after = rstrip(F.regexp_replace(strip(a("text")), REF_TAGS, "")), strip(b("text"))
    short = (a("x1") > 0) & (a("x1") < a("far") - max(body_size * 2, 20.0))
    far_short = (a("x1") > 0) & (a("x1") < a("far") - max(body_size * 4, 45.0))
    head, next_head = bare_heading(before), bare_heading(after)
    title = (a("lines") == 1) & F.length(head).between(2, 35) & ~F.rlike(head, F.lit(STOPS)) & short & ~F.rlike(head, F.lit("[的了在和与]$"))
    next_title = (b("lines") == 1) & F.length(next_head).between(2, 35) & ~F.rlike(next_head, F.lit(STOPS)) & ~F.rlike(after, F.lit("[。！？!?…．.]$"))
    middle = F.abs((b("x0") + b("x1")) / 2 - page_width / 2) < page_width * 0.12
    centred = middle & (b("x0") > base_x0 + 10) & (F.abs(b("x0") - (page_width - b("x1"))) < max(25.0, page_width * 0.08))
    starts = (F.rlike(after, F.lit(PARAGRAPH_START)) & ~F.rlike(after, F.lit(YEAR_START))) | F.rlike(b("raw"), F.lit(r"^(?:[　 ]| {2,4})"))
    refused = (
        (F.coalesce(a("style"), F.lit("")) != F.coalesce(b("style"), F.lit(""))) | (F.abs(a("size") - b("size")) > 0.6) | (before == "") | (after == "")
        | F.rlike(strip(a("text")), F.lit(CONTENTS_LINE)) | F.rlike(after, F.lit(CONTENTS_LINE)) | (~is_unclosed & (ends_sentence(before) | title | (far_short & ~F.rlike(before, F.lit(r"[，,、；;：:\-—]$")))))
        | starts | (b("x0") - base_x0 >= max(10.0, body_size * 1.4)) | centred | next_title
    )
    return F.coalesce(~refused, F.lit(False))
