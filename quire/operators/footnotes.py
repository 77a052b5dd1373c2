"""Marks of footnotes in body text replaced by reference tags, page by page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import CITED, URL_TAIL

# What is a letter mark, a weak mark, and the characters a letter mark stands between.
LETTER_MARK = re.compile(r"^[a-zA-Z][.、\s)）]?$")
WEAK_MARK = re.compile(r"^[\d.、\s()（）]+$")
BEFORE_LETTER = "[。，；！？、”’」』）)\\]】一-鿿]"
AFTER_LETTER = "(?=[。，；！？、”’」』）)\\]】\\s\\n]|$)"
FRAMES = ("[{}]", "［{}］", "〔{}〕", "【{}】", "[ {} ]", "［ {} ］")
_CITED, _TAIL = re.compile(CITED.replace(r"[^\p{L}\p{N}_]", r"\W")), re.compile(f"{URL_TAIL}|[a-zA-Z]$")


def cited_before(text: str, at: int, context: str) -> bool:
    """Whether what comes before a place ends like a citation or an address."""
    before = text[:at]
    if context and not before.strip():
        before = f"{context} {before}"
    before = before.rstrip()
    return bool(_CITED.search(before) or _TAIL.search(before))


def _letter(text: str, letter: str, tag: str) -> tuple[str, bool]:
    out, n = re.subn(rf"(?<={BEFORE_LETTER}){re.escape(letter)}(?![a-zA-Z0-9]){AFTER_LETTER}", lambda _: tag, text, count=1)
    return out, n > 0


def replace_mark(text: str, mark: str, number: int | None, tag: str, context: str = "") -> tuple[str, bool]:
    """Text with the first place of a footnote's mark replaced, and whether there was one.

    First the mark as it is written: a letter only next to CJK text, a number or
    number in parentheses only where it is no part of a citation. Then the
    number in brackets or as a circled one, then as a letter.
    """
    if mark and LETTER_MARK.match(mark.strip()):
        out, done = _letter(text, re.search("[a-zA-Z]", mark)[0], tag)
        if done:
            return out, True
    elif mark and WEAK_MARK.match(mark):
        for m in re.finditer(rf"(?<![a-zA-Z\d]){re.escape(mark)}(?!\d)(?!\s*[:：;；])(?!\s*[页頁期卷条條])(?![a-zA-Z0-9/])", text):
            if not cited_before(text, m.start(), context):
                return text[: m.start()] + tag + text[m.end() :], True
    elif mark and mark in text:
        return text.replace(mark, tag, 1), True
    if number is None:
        return text, False
    shapes = [f.format(number) for f in FRAMES]
    if 1 <= number <= 20:
        shapes.append(chr(0x245F + number))
    for shape in shapes:
        if shape in text:
            return text.replace(shape, tag, 1), True
    for letter in (chr(96 + number), chr(64 + number)) if 1 <= number <= 26 else ():
        out, done = _letter(text, letter, tag)
        if done:
            return out, True
    return text, False


def linked(pages: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (keys, page_num, text) with the marks of their notes (keys, page_num, id, mark, in the order of seq) replaced by tags: text, n_notes, n_matched.

    A page and its notes are one group. Pages without notes stay; null texts are
    empty; notes without mark and id match nothing.
    """
    by = [*keys, "page_num"]
    one = notes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "id", "mark"))).alias("notes"))
    rows = pages.select(*by, F.coalesce("text", F.lit("")).alias("text")).join(one, by, "left")
    types = dict(rows.dtypes)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts, total, matched = [], [], []
            for page, text, found in zip(pdf["page_num"], pdf["text"], pdf["notes"]):
                n = k = 0
                for note in found if found is not None else ():
                    n += 1
                    number = None if note["id"] is None or pd.isna(note["id"]) else int(note["id"])
                    text, done = replace_mark(text, note["mark"] or "", number, f"[^p{page}_{number}]")
                    k += done
                texts.append(text)
                total.append(n)
                matched.append(k)
            out = pdf[by].copy()
            out["text"], out["n_notes"], out["n_matched"] = texts, total, matched
            yield out

    ddl = ", ".join(f"{k} {types[k]}" for k in by) + ", text string, n_notes int, n_matched int"
    return rows.mapInPandas(run, ddl)
