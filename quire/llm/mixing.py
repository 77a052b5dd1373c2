"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a shuffled order, form blocks, one a slot. Weights
are exact: the binary fractions of the given numbers, as integers. In the ideal
a source of weight w and n blocks has min(n, w v) of them at virtual time v, which
is the slot t(v), the sum of that over all sources: a source that is used up
leaves at once, and the others keep their proportions. Its k-th block is released
at slot floor(t(k / w)) and due by slot ceil(t((k + 1) / w)); the blocks are
interleaved earliest deadline first. The ideal itself spreads each block within
its window with one block a slot in all, so every deadline can be met, and a
source is never a whole block ahead of or behind the ideal. The driver plans
blocks, with one or two of each source at a time.

Ranks within a source are row numbers within parts of the source's hash range
plus the sizes of the parts before, so no source is ever in one task.

Defined results: every row gets a place; a null source is a source of its own;
null ids and repeated rows are placed as any others; sources of weight 0 and
unknown ones come, with equal weights, after all others; negative and infinite weights and
NaN are refused; other columns come back as they were.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate
from math import ceil, isfinite, lcm

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .staging import Stage, free_name

BLOCK = 64
#: Parts of a source's hash range (a power of two).
PARTS = 256
#: Slots in one row of the plan.
CHUNK = 4096


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in the proportions of the weights."""
    if not all(isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("a weight is negative or not finite")
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(f.denominator for f in parts.values()))
    return {s: f.numerator * (scale // f.denominator) for s, f in parts.items()}


class Ideal:
    """The slot t(k / w) = P + k S / w, with P the blocks of sources used up by then and S the weights of the others."""

    def __init__(self, blocks: dict[str, int], weight: dict[str, int]):
        self.weight = weight
        order = sorted((Fraction(n, weight[s]), n, weight[s]) for s, n in blocks.items())
        self.ends = [x for x, _, _ in order]
        self.gone = [0, *accumulate(n for _, n, _ in order)]
        self.left = [w - u for w in [sum(w for _, _, w in order)] for u in [0, *accumulate(w for _, _, w in order)]]

    def window(self, s: str, k: int) -> tuple[int, int]:
        """Release and deadline of a source's k-th block."""
        w = self.weight[s]
        i, j = bisect_right(self.ends, Fraction(k, w)), bisect_right(self.ends, Fraction(k + 1, w))
        return self.gone[i] + k * self.left[i] // w, self.gone[j] - (-(k + 1) * self.left[j] // w)


def edf(blocks: dict[str, int], weight: dict[str, int]) -> dict[str, array]:
    """The slot of each block of each source; weights are positive, blocks at least 1."""
    ideal = Ideal(blocks, weight)
    windows = {s: ideal.window(s, 0) for s in blocks}
    waiting = [(a, s, 0, due) for s, (a, due) in windows.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, array] = {s: array("q") for s in blocks}
    for t in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= t:
            _, s, k, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
            if k + 1 < blocks[s]:
                a, due = ideal.window(s, k + 1)
                heapq.heappush(waiting, (a, s, k + 1, due))
        due, s, _ = heapq.heappop(ready)
        assert due > t, "a deadline is missed"
        slots[s].append(t)
    return slots


def edf_period(share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of whole shares."""
    return {s: list(x) for s, x in edf(share, share).items()}


def plan(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slot of each block of each source; sources of weight 0 come last."""
    weight, base, out = exact(weights), 0, {}
    for zero in (False, True):
        some = {s: n for s, n in blocks.items() if n > 0 and (weight[s] == 0) == zero}
        for s, slots in edf(some, {s: weight[s] or 1 for s in some}).items():
            out[s] = array("q", (base + t for t in slots)) if base else slots
        base += sum(some.values())
    return out


def mix(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs and mix_slot (long: the slot of the row's block), mix_place (int: place in the block) and mix_block (long: number of the block in its source).

    weights: by source; without, each source's number of documents to the power of `temper`.
    """
    stage = Stage(spark, "mixing")
    names = docs.columns
    at = {c.lower(): F.col(f"c{i}") for i, c in reversed(list(enumerate(names)))}
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key = F.when(at["source"].isNull(), "null").otherwise(F.concat(F.lit("="), at["source"].cast("string")))
    h = F.xxhash64(at["doc_id"], F.lit(seed))
    rows = rows.withColumns({"src": key, "h": h, "part": F.shiftrightunsigned(h, 64 - (PARTS - 1).bit_length()).cast("int")})
    counts = stage.write(rows.groupBy("src", "part").count(), "counts")
    n = {r.src: r.n for r in counts.groupBy("src").agg(F.sum("count").alias("n")).toLocalIterator()}
    wanted = {s: (weights.get(s[1:], 0.0) if s != "null" else 0.0) if weights is not None else c**temper for s, c in n.items()}
    planned = plan({s: ceil(c / block) for s, c in n.items()}, wanted)
    chunks = [(s, i, x[i : i + CHUNK].tolist()) for s, x in planned.items() for i in range(0, len(x), CHUNK)]
    slots = spark.createDataFrame(chunks, "src string, first long, slots array<long>").select("src", "first", F.posexplode("slots").alias("k", "mix_slot"))
    slots = slots.select("src", (F.col("first") + F.col("k")).alias("mix_block"), "mix_slot")
    slots = stage.write(slots, "slots")
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("src", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("src", "part").orderBy("h", at["doc_id"])
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["src", "part"])
    rank = F.col("rank") + F.col("offset")
    placed = ranked.withColumns({"mix_block": F.floor(rank / block), "mix_place": (rank % block).cast("int")}).join(slots, ["src", "mix_block"])
    return placed.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        *(F.col(c).alias(free_name(c, names)) for c in ("mix_slot", "mix_place", "mix_block")),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
