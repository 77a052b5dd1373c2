"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single blanks. The patterns
are the items' windows of `width` consecutive words (a shorter item is one
window), framed by blanks so that they match whole words. Each document is
scanned once; matches are kept as word ranges and can be mapped back to
character offsets of the original text.

Defined results: a null or wordless text has no words and no hits; an item
without words has no windows; null ids of items are left out of the list, those
of documents stay; repeated documents are reported once for each row; repeated
item rows count once. Extra columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytesvec import class_table
from .staging import Stage, prepare

WIDTH = 10
#: Patterns in one automaton; more are dealt to further automata, each scanned over the documents.
MAX_PATTERNS = 1_000_000

_SEP = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Lower-cases A-Z and turns every separator into a blank.
_TABLE = bytes(32 if _SEP[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same words in the original text, for offsets.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    n = max(len(words) - width, 0) + 1 if words else 0
    return {b" ".join(words[i : i + width]) for i in range(n)}


def pattern_shards(benchmark: DataFrame, width: int, most: int) -> Iterator[dict[str, tuple[int, frozenset]]]:
    """Window (as Latin-1 of its UTF-8 bytes) -> (number of words, ids of its items); at most about `most` windows at a time.

    The rows come through toLocalIterator, so the driver holds one or two shards.
    All rows of an item are in one shard only if the shard does not overflow;
    the caller unites items over shards.
    """
    shard: dict[str, tuple[int, frozenset]] = {}
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        if len(shard) >= most:
            yield shard
            shard = {}
        for w in windows_of(words_of(text.encode() if text is not None else b""), width):
            key = w.decode("latin-1")
            n, items = shard.get(key, (w.count(b" ") + 1, frozenset()))
            shard[key] = (n, items | {item})
    yield shard


def automaton(patterns: dict[str, tuple[int, frozenset]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, (n, items) in patterns.items():
        a.add_word(f" {w} ", (n, items))
    a.make_automaton()
    return a


def scan(a, text: bytes | None) -> tuple[list[bytes], list[tuple[int, int, frozenset]]]:
    """The words, and each occurrence as (first word, words, items)."""
    words = words_of(text)
    if not words or not len(a):
        return words, []
    norm = " " + b" ".join(words).decode("latin-1") + " "
    hits = [(end, n, items) for end, (n, items) in a.iter(norm)]
    if not hits:
        return words, []
    # A match ends on the blank after its last word: blanks up to there, less the first, number that word.
    blanks = np.cumsum(np.frombuffer(norm.encode("latin-1"), dtype=np.uint8) == 32)
    return words, [(int(blanks[end]) - 1 - n, n, items) for end, n, items in hits]


def original_spans(text: str, hits: list[tuple[int, int, frozenset]]) -> list[tuple[int, int]]:
    """Character ranges of the original text that the united occurrences cover."""
    at = [m.span() for m in WORD.finditer(text)]
    spans: list[list[int]] = []
    for first, n, _ in sorted(hits, key=lambda h: h[:2]):
        start, end = at[first][0], at[first + n - 1][1]
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def _scan_udf(patterns: dict, with_spans: bool):
    held: list = []  # one automaton for each worker task

    def run(batches):
        if not held:
            held.append(automaton(patterns))
        a = held[0]
        for batch in batches:
            n_words, hit_words, items, spans = [], [], [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                words, hits = scan(a, value)
                n_words.append(len(words))
                hit_words.append(sorted({i for first, n, _ in hits for i in range(first, first + n)}))
                items.append(sorted(set().union(*(h[2] for h in hits)) - {None}))
                spans.append([{"start": x, "end": y} for x, y in original_spans(value.decode(), hits)] if with_spans and hits else [])
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(n_words, pa.int64()),
                    pa.array(hit_words, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=[*kept, "n_words", "hit_words", "items", "spans"],
            )

    return run


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = (), with_spans: bool = True, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Per document: doc_id, the `keep` columns, n_words, hit_words (numbers of words in a hit), items, spans (character ranges).

    `keep` columns come back as keep_<name>, so that none can clash.
    """
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"keep_{c}") for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = "n_words long, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"

    def scanned(rows: DataFrame, patterns: dict) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
        return rows.mapInArrow(_scan_udf(patterns, with_spans), f"{fields}, {found}")

    shards = pattern_shards(benchmark, width, max_patterns)
    first = next(shards)
    more = next(shards, None)
    if more is None:
        return scanned(base, first)
    # Several automata: rows are numbered, and their hits united by number.
    stage = Stage(spark, "decontam")
    numbered = stage.write(base.withColumn("_row", F.monotonically_increasing_id()), "rows")
    hits = None
    for patterns in chain((first, more), shards):
        part = stage.write(scanned(numbered.select("_row", "text"), patterns), "hits")
        hits = part if hits is None else hits.unionByName(part)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = hits.groupBy("_row").agg(F.max("n_words").alias("n_words"), united("hit_words"), united("items"), united("spans"))
    return numbered.drop("text").join(hits, "_row").drop("_row")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(contamination(spark, docs, items, with_spans=False))


#: The character class of the words, and A-Z lowered.
_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, win.n AS n FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
