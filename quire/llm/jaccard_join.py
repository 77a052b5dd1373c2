"""Exact n-gram Jaccard self-join with count-vector R-trees.

Every text becomes its set of distinct word shingles (64-bit hashes). Equal sets
form one class and only classes are compared.

Finding pairs without comparing all: two sets above the threshold differ in few
elements. Elements are hashed into more groups than that number, so at least one
group holds the same elements in both sets; classes meet in buckets keyed by a
group and its content. Group counts are chosen by bands of set sizes; a class
enters its own band's buckets and, if it can have a larger partner there, the
next band's.

In each bucket the classes' count vectors (elements in each of 64 groups) are
the points of an R-tree. A pair's overlap is at most the sum of its coordinates'
minima, a node's at most the sum of minima with the node's upper corner. From
the pairs that survive, a spanning forest is verified exactly; then, until
nothing is left to be found, all surviving pairs whose classes are not connected
yet. No pair that could connect two components is left out, and copies or tight
groups cost a chain of links instead of all pairs.

Defined results: a null text is empty; a text without words has an empty set and
links with nothing; rows are judged by their own text, also when they repeat a
doc_id; a row without a doc_id is in the component of rows with a doc_id whose
set equals its own, else it links with nothing and its component_id is null;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bytesvec import LOWER, R, SPACE, mix, pieces, shingle_hashes, span_hashes, text_buffer, words
from .components import connected_components
from .staging import Stage

DIMS = 64
#: Rows of one bucket in one unit of work; a larger bucket is split into pairs of blocks.
BLOCK = 20_000
#: Largest over smallest size in a band.
BAND = 1.25
LEAF = 32


class Scheme:
    """Sizes, bands and groups for sets whose Jaccard similarity is at least num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 40:  # a band spans den / num at least, so a partner is in the next band at most
            starts.append(max(starts[-1] + 1, int(starts[-1] * BAND), starts[-1] * den // num))
        self.starts = np.array(starts, dtype=np.int64)
        # Sizes below starts[j + 1]: the union is at most max / t, and the sets differ in at most (1 - t) of it.
        self.differ = (self.starts[1:] - 1) * (den - num) // num
        spare = np.where(self.differ < 8, 0, np.where(self.differ < 32, 1, 2))
        self.spare = spare
        self.groups = self.differ + 1 + spare

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1

    def reaches_next(self, sizes: np.ndarray) -> np.ndarray:
        """Whether a set of the next band can be similar enough."""
        return sizes * self.den >= self.num * self.starts[self.band(sizes) + 1]

    def needed(self, a, b):
        """Least overlap of sets of sizes a and b that links them: den * i >= num * (a + b - i)."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingle_sets(col: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, hashes, row of each hash less the first) for ranges of rows of a text column."""
    for start, stop in pieces(col):
        raw, off = text_buffer(col.slice(start, stop - start))
        raw = LOWER[raw]
        s, e, t = words(raw, off, SPACE)
        h, t = shingle_hashes(span_hashes(raw, s, e), t, stop - start, width)
        yield start, stop - start, h, t


def _group_keys(scheme: Scheme, h: np.ndarray, t: np.ndarray, band: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for each group of the active texts, by the given bands."""
    groups = np.where(active, scheme.groups[band], 0)
    base = np.concatenate(([0], np.cumsum(groups)))
    total = int(base[-1])
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keep = active[t]
    h, t = h[keep], t[keep]
    slot = base[t] + (mix(h ^ np.uint64(R)) % groups[t].astype(np.uint64)).astype(np.int64)
    content = np.zeros(total, dtype=np.uint64)
    np.add.at(content, slot, mix(h + np.uint64(0x1F83D9ABFB41BD6B)))
    size = np.bincount(slot, minlength=total)
    text = np.repeat(np.arange(len(groups)), groups)
    place = np.arange(total) - base[text]
    key = mix(content + mix(place.astype(np.uint64) + (band[text].astype(np.uint64) << np.uint64(40)) + (size.astype(np.uint64) << np.uint64(50))))
    # One more equal group than a set has empty ones is a non-empty equal group. So only sets with more empty groups than that need those.
    empty = np.bincount(text, weights=size == 0, minlength=len(groups)).astype(np.int64)
    keep = (size > 0) | (empty > scheme.spare[band])[text]
    return text[keep], key[keep]


def encode_vectors(counts: np.ndarray) -> list[bytes]:
    """A row of counts as bytes: one each if all are below 256, else four."""
    small = counts.max(axis=1, initial=0) < 256
    as8, as32 = counts.astype(np.uint8), counts.astype("<u4")
    return [as8[i].tobytes() if small[i] else as32[i].tobytes() for i in range(len(counts))]


def decode_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if len(data) == DIMS else "<u4").astype(np.int32)


SETS = "doc_id long, n long, cid long, vec binary, keys array<long>"


def _sets_udf(width: int, num: int, den: int):
    scheme = Scheme(num, den)

    def run(batches):
        for batch in batches:
            col = batch.column("text")
            for start, n, h, t in shingle_sets(col, width):
                sizes = np.bincount(t, minlength=n)
                cid = np.zeros(n, dtype=np.uint64)
                np.add.at(cid, t, mix(h ^ np.uint64(0x5BE0CD19137E2179)))
                cid = mix(cid + sizes.astype(np.uint64))
                counts = np.bincount(t * DIMS + (h >> np.uint64(58)).astype(np.int64), minlength=n * DIMS).reshape(n, DIMS)
                band = scheme.band(np.maximum(sizes, 1))
                some = sizes > 0
                t1, k1 = _group_keys(scheme, h, t, band, some)
                t2, k2 = _group_keys(scheme, h, t, band + 1, some & scheme.reaches_next(np.maximum(sizes, 1)))
                text, key = np.concatenate((t1, t2)), np.concatenate((k1, k2))
                order = np.argsort(text, kind="stable")
                offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))
                keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, n), pa.array(sizes, pa.int64()), pa.array(cid.view(np.int64)), pa.array(encode_vectors(counts), pa.binary()), keys],
                    names=["doc_id", "n", "cid", "vec", "keys"],
                )

    return run


# --------------------------------------------------------------------------- the tree


class CountTree:
    """R-tree over count vectors, bulk-loaded by splitting on the widest coordinate; the first is the set size."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray, scheme: Scheme):
        self.scheme, n = scheme, len(sizes)
        self.sizes, self.vectors = sizes, vectors
        self.order = np.arange(n)
        nodes: list[tuple[int, int, int, int]] = []  # start, stop, children's first and last number
        todo = [(0, n)]
        spans = []
        while todo:  # breadth first; children get consecutive numbers
            nxt = []
            for start, stop in todo:
                if stop - start > LEAF:
                    ids = self.order[start:stop]
                    points = np.column_stack((sizes[ids], vectors[ids]))
                    axis = int(np.argmax(points.max(0) - points.min(0)))
                    half = (stop - start) // 2
                    self.order[start:stop] = ids[np.argpartition(points[:, axis], half)]
                    nxt += [(start, start + half), (start + half, stop)]
                    spans.append((start, stop, True))
                else:
                    spans.append((start, stop, False))
            todo = nxt
        first = 1
        for start, stop, inner in spans:
            nodes.append((start, stop, first if inner else -1, first + 1 if inner else -1))
            first += 2 * inner
        self.nodes = np.array(nodes)
        self.upper = np.array([vectors[self.order[a:b]].max(0) for a, b, *_ in nodes])
        self.low = np.array([sizes[self.order[a:b]].min() for a, b, *_ in nodes])
        self.high = np.array([sizes[self.order[a:b]].max() for a, b, *_ in nodes])
        self.left = np.array([b - a for a, b, *_ in nodes])  # points not taken out
        self.leaf_of = np.zeros(n, dtype=np.int64)
        self.parent = np.full(len(nodes), -1)
        for k, (a, b, c, d) in enumerate(nodes):
            if c < 0:
                self.leaf_of[self.order[a:b]] = k
            else:
                self.parent[[c, d]] = k
        self.live = np.ones(n, dtype=bool)

    def take_out(self, points: np.ndarray) -> None:
        for p in points:
            self.live[p] = False
            k = self.leaf_of[p]
            while k >= 0:
                self.left[k] -= 1
                k = self.parent[k]

    def search(self, size: int, vector: np.ndarray) -> np.ndarray:
        """Live points whose overlap bound reaches what their size needs."""
        s, found = self.scheme, []
        level = np.array([0])
        least = -(-s.num * size // s.den)
        most = size * s.den // s.num
        while len(level):
            level = level[(self.left[level] > 0) & (self.high[level] >= least) & (self.low[level] <= most)]
            bound = np.minimum(self.upper[level], vector).sum(1)
            level = level[bound >= s.needed(size, np.maximum(self.low[level], least))]
            leaves = level[self.nodes[level, 2] < 0]
            for k in leaves:
                a, b = self.nodes[k, :2]
                ids = self.order[a:b]
                found.append(ids[self.live[ids]])
            level = self.nodes[level[self.nodes[level, 2] >= 0], 2:4].ravel()
        if not found:
            return np.zeros(0, dtype=np.int64)
        ids = np.concatenate(found)
        bound = np.minimum(self.vectors[ids], vector).sum(1)
        other = self.sizes[ids]
        return ids[(bound >= s.needed(size, other)) & (other >= least) & (other <= most)]


def spanning_forest(sizes: np.ndarray, vectors: np.ndarray, side: np.ndarray | None, scheme: Scheme) -> list[tuple[int, int]]:
    """Pairs that connect whatever the surviving pairs connect. side: only pairs of different sides count, if given."""
    if side is not None:
        return _forest_two_sides(sizes, vectors, side, scheme)
    tree, edges = CountTree(sizes, vectors, scheme), []
    for root in range(len(sizes)):
        if not tree.live[root]:
            continue
        tree.take_out(np.array([root]))
        front = [root]
        while front and tree.left[0]:
            p = front.pop()
            hits = tree.search(int(sizes[p]), vectors[p])
            tree.take_out(hits)
            edges += [(p, int(q)) for q in hits]
            front += hits.tolist()
        if not tree.left[0]:
            break
    return edges


def _forest_two_sides(sizes, vectors, side, scheme) -> list[tuple[int, int]]:
    """As above for the bipartite graph of two blocks: two trees, searched in turns."""
    ids = [np.flatnonzero(side == x) for x in (0, 1)]
    if not len(ids[0]) or not len(ids[1]):
        return []
    trees = [CountTree(sizes[i], vectors[i], scheme) for i in ids]
    edges = []
    for root in range(len(ids[0])):
        if not trees[0].live[root]:
            continue
        trees[0].take_out(np.array([root]))
        front = [(0, root)]
        while front:
            x, p = front.pop()
            if not trees[1 - x].left[0]:
                continue
            at = ids[x][p]
            hits = trees[1 - x].search(int(sizes[at]), vectors[at])
            trees[1 - x].take_out(hits)
            edges += [(int(at), int(ids[1 - x][q])) for q in hits]
            front += [(1 - x, int(q)) for q in hits]
    return edges


def surviving_pairs(sizes: np.ndarray, vectors: np.ndarray, side: np.ndarray | None, comp: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All surviving pairs of different components (and sides, if given)."""
    tree = CountTree(sizes, vectors, scheme)
    for p in range(len(sizes)):
        hits = tree.search(int(sizes[p]), vectors[p])
        hits = hits[(hits > p) & (comp[hits] != comp[p])]
        if side is not None:
            hits = hits[side[hits] != side[p]]
        if len(hits):
            yield np.full(len(hits), p), hits


def _units(batches, columns: list[str]) -> Iterator[dict[str, np.ndarray | list]]:
    """Runs of equal `unit` of rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None

    def out():
        table = pa.Table.from_batches(held)
        return {c: table.column(c).to_pylist() if c == "vec" else table.column(c).to_numpy() for c in columns}

    for batch in batches:
        unit = batch.column("unit").to_numpy()
        if not len(unit):
            continue
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
        for a, b in zip(cuts, cuts[1:]):
            if last is not None and unit[a] != last:
                yield out()
                held = []
            last = unit[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield out()


def _pairs_udf(num: int, den: int, exhaustive: bool):
    scheme = Scheme(num, den)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        seen: set = set()  # repeated pairs of this task, as far as memory allows
        for unit in _units(batches, ["cid", "n", "vec", "side", "two", "comp"]):
            cid, n, side = unit["cid"], unit["n"], unit["side"] if unit["two"][0] else None
            if len(cid) < 2:
                continue
            vectors = np.stack([decode_vector(v) for v in unit["vec"]])
            if exhaustive:
                parts = surviving_pairs(n, vectors, side, unit["comp"], scheme)
            else:
                pairs = np.array(spanning_forest(n, vectors, side, scheme), dtype=np.int64).reshape(-1, 2)
                parts = [(pairs[:, 0], pairs[:, 1])]
            for p, q in parts:
                a, b = np.minimum(cid[p], cid[q]), np.maximum(cid[p], cid[q])
                rows = [x for x in zip(a.tolist(), b.tolist()) if x not in seen]
                if len(seen) < 1_000_000:
                    seen.update(rows)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], schema=schema)

    return run


# --------------------------------------------------------------------------- the join


class JaccardJoin:
    """One run of the join over `docs` (doc_id, text); see the module's description."""

    def __init__(self, spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100):
        self.spark, self.width, self.num, self.den = spark, width, num, den
        self.stage = Stage(spark, "jaccard")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def sets(self) -> DataFrame:
        """Per row: doc_id, n (set size), cid (class of equal sets), vec, keys."""
        return self.stage.write(self.docs.mapInArrow(_sets_udf(self.width, self.num, self.den), SETS), "sets")

    def buckets(self, sets: DataFrame) -> DataFrame:
        """(bucket, cid) of the classes that share a bucket with another; equal buckets are one."""
        reps = sets.filter("n > 0").groupBy("cid").agg(F.first("keys").alias("keys"))
        keyed = reps.select("cid", F.explode("keys").alias("key"))
        w = Window.partitionBy("key")
        met = keyed.select(
            "cid",
            F.min("cid").over(w).alias("low"),
            F.max("cid").over(w).alias("high"),
            F.count("*").over(w).alias("members"),
            F.bit_xor(F.xxhash64("cid")).over(w).alias("all"),
        ).filter("low <> high")
        return self.stage.write(met.select(F.xxhash64("low", "high", "members", "all").alias("bucket"), "members", "cid").distinct(), "buckets")

    def _candidates(self, buckets: DataFrame, vectors: DataFrame, comps: DataFrame | None) -> DataFrame:
        """Pairs (a, b) of classes to be verified: a spanning forest, or all between components."""
        if comps is None:
            rows = buckets.withColumn("comp", F.col("cid"))
        else:
            rows = buckets.join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
            mixed = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
            rows = rows.join(mixed, "bucket")
        # A bucket of more than BLOCK members is split into blocks, and every pair of blocks is a unit.
        blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
        mine = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = rows.select(
            F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"),
            "cid",
            "comp",
            (F.col("mine") > F.col("other")).cast("int").alias("side"),
            (F.col("mine") != F.col("other")).cast("int").alias("two"),
        )
        rows = units.join(vectors, "cid").repartition("unit").sortWithinPartitions("unit", "two", "cid")
        return rows.select("unit", "cid", "n", "vec", "side", "two", "comp").mapInArrow(_pairs_udf(self.num, self.den, comps is not None), "a long, b long").distinct()

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, links) from the sets themselves, made again for the classes in question."""
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted = self.stage.write(sets.join(ids, "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null"), "wanted")
        width = self.width

        def arrays(batches):
            for batch in batches:
                col = batch.column("text")
                for _, n, h, t in shingle_sets(col, width):
                    cid = np.zeros(n, dtype=np.uint64)
                    np.add.at(cid, t, mix(h ^ np.uint64(0x5BE0CD19137E2179)))
                    sizes = np.bincount(t, minlength=n)
                    offsets = np.concatenate(([0], np.cumsum(sizes)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mix(cid + sizes.astype(np.uint64)).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))],
                        names=["cid", "elements"],
                    )

        texts = self.docs.join(wanted.select("doc_id").distinct(), "doc_id").select("text")
        made = texts.mapInArrow(arrays, "cid long, elements array<long>")
        # A repeated doc_id may bring other texts: only wanted classes stay, once each.
        made = self.stage.write(made.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "elements")
        left = pairs.join(made.select(F.col("cid").alias("a"), F.col("elements").alias("x")), "a")
        both = left.join(made.select(F.col("cid").alias("b"), F.col("elements").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        out = both.select("a", "b", (F.lit(self.den) * common >= F.lit(self.num) * union).alias("links"))
        return self.stage.write(out, "verified")

    def components(self) -> DataFrame:
        """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
        st = self.stage
        sets = self.sets()
        classes = st.write(sets.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("vec").alias("vec")), "classes")
        buckets = self.buckets(sets)
        slim = sets.select("doc_id", "cid")
        vectors = classes.select("cid", "n", "vec")
        first = st.write(self._candidates(buckets, vectors, None), "forest")
        done = self.verify(first, slim)
        comps = connected_components(done.filter("links"), st)
        more = self._candidates(buckets, vectors, comps).join(done.select("a", "b"), ["a", "b"], "left_anti")
        more = st.write(more, "rest")
        links = done.filter("links").select("a", "b")
        if more.limit(1).count():
            links = links.unionByName(self.verify(more, slim).filter("links").select("a", "b"))
            comps = connected_components(links, st)
        linked = classes.join(comps.withColumnRenamed("id", "cid"), "cid").select("cid", "component", "rep")
        smallest = linked.groupBy("component").agg(F.min("rep").alias("smallest"))
        named = linked.join(smallest, "component").select("cid", "smallest")
        table = classes.select("cid", "rep").join(named, "cid", "left").select("cid", F.coalesce("smallest", "rep").alias("component_id"))
        table = st.write(table, "components")
        out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(table, "cid", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100).components()


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ranked AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r
           FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS f FROM sh) JOIN n USING (doc_id)),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM ranked x JOIN ranked y ON x.s = y.s AND x.doc_id < y.doc_id
         AND 10 * x.r <= x.n + 10 AND 10 * y.r <= y.n + 10 AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n),
ov AS (SELECT a, b, count(*) AS i FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
link AS (SELECT a, b FROM ov JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS v, b AS u FROM near UNION SELECT reach.v, near.b FROM reach JOIN near ON near.a = reach.u)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce((SELECT min(u) FROM reach WHERE v = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
