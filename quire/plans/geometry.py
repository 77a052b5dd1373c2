"""Box queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import folds, joins
from ..sources.tables import BOXES_SQL, boxes

W = f"WITH {BOXES_SQL}"
B = lambda: joins.as_box()
KEY = ["page_id", "seq", "score"]


def _each(value, *names):
    """Query that gives box columns by an expression on each row."""

    def run(spark, d):
        out = boxes(spark, d).select(*KEY, F.col("x0").alias("in_x0"), F.col("y0").alias("in_y0"), value().alias("v"))
        return out.select(*KEY, "in_x0", "in_y0", *((F.col("v") if n == "v" else F.col(f"v.{n}")).alias(n) for n in names))

    return run


def _sql(**columns):
    return f"{W} SELECT page_id, seq, score, x0 AS in_x0, y0 AS in_y0, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM boxes"


def share_row(spark, d):
    b = boxes(spark, d)
    pairs = joins.pairs_on_page(b, b, "page_id").filter("a_seq < b_seq")
    return pairs.filter(G.same_row(joins.as_box("a_"), joins.as_box("b_"), 10.5)).select("page_id", "a_seq", "b_seq", "a_y0", "b_y0", "a_x0", "b_x0")


def iou(spark, d):
    return joins.iou_pairs(boxes(spark, d), "page_id", "seq", 0.05).select("page_id", "a_seq", "b_seq", "a_x0", "b_x0", "a_y0", "b_y0", "iou")


def unions(spark, d):
    out = boxes(spark, d).groupBy("page_id").agg(G.union_of(F.struct(F.when(F.col("seq") % 3 == 0, F.col("x1")).otherwise(F.col("x0")).alias("x0"), "y0", "x1", "y1")).alias("u"))
    return out.select("page_id", *(f"u.{n}" for n in G.EDGES))


def envelopes(spark, d):
    return boxes(spark, d).groupBy("page_id").agg(G.envelope_of(B()).alias("u")).select("page_id", *(f"u.{n}" for n in G.EDGES))


ORDER = ["neg", "x0", "y0", "x1", "y1", "seq", "class_id"]
BOX_TYPE = "struct<neg:double,x0:double,y0:double,x1:double,y1:double,seq:bigint,class_id:int>"


def nms(spark, d):
    rows = folds.gathered(boxes(spark, d).withColumn("neg", -F.col("score")), ["page_id"], ORDER, [])
    kept = rows.select("page_id", F.explode(folds.greedy_nms(F.col("items"), BOX_TYPE, 0.1)).alias("b"))
    return kept.select("page_id", (-F.col("b.neg")).alias("score"), *(f"b.{n}" for n in ("x0", "y0", "x1", "y1", "seq")))


def bands(spark, d):
    rows = boxes(spark, d).withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    rows = folds.gathered(rows, ["page_id"], ["yc", "x0", "x1", "y0", "seq", "score"], [])
    out = rows.select("page_id", F.explode(F.arrays_zip("items", folds.anchor_bands(F.col("items"), lambda x: x["yc"], 40.0).alias("band"))).alias("z"))
    return out.select("page_id", "z.items.yc", "z.items.x0", "z.items.seq", "z.band")


BANDS_SQL = (
    W
    + """, s AS (SELECT page_id, list(struct_pack(yc := yc, x0 := x0, seq := seq) ORDER BY yc, x0, x1, y0, seq, score) AS items FROM (SELECT *, (y0 + y1) / 2 AS yc FROM boxes) GROUP BY page_id),
g AS (SELECT page_id, items, list_reduce(list_transform(items, lambda x: [x.yc]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] <= 40.0 THEN acc ELSE list_append(acc, x[1]) END) AS anchors FROM s)
SELECT page_id, it.yc AS yc, it.x0 AS x0, it.seq AS seq, CAST(len(list_filter(anchors, lambda a: a <= it.yc)) AS INTEGER) AS band FROM (SELECT page_id, anchors, unnest(items) AS it FROM g)"""
)


def merge(spark, d):
    rows = folds.gathered(boxes(spark, d), ["page_id"], ["y0", "x0", "y1", "x1", "seq"], [])
    return rows.select("page_id", F.posexplode(folds.merged_intervals(F.col("items"), 20.0)).alias("n", "m")).select("page_id", "n", *(f"m.{n}" for n in G.EDGES))


def batches(spark, d):
    """Crops in batches of like shape: by aspect ratio, in each order's crops; original places kept."""
    from pyspark.sql import Window

    ratio = G.aspect_ratio(B())
    w = Window.partitionBy("page_id").orderBy("ratio", "seq", "x0", "y0", "score", "x1", "y1")
    return boxes(spark, d).withColumn("ratio", ratio).select("page_id", "seq", "x0", "y0", "ratio", F.floor((F.row_number().over(w) - 1) / 3).alias("batch"))


def best_image(spark, d):
    b = boxes(spark, d)
    odd, even = b.filter("seq % 2 = 1"), b.filter("seq % 2 = 0")
    one = lambda x: x.groupBy("page_id", "seq").agg(*(F.min(n).alias(n) for n in ("x0", "y0")), *(F.max(n).alias(n) for n in ("x1", "y1")))
    return joins.best_overlap(one(odd), one(even), "page_id", "seq", "seq", 0.40, 595.0 * 842.0)


def overlap_anti(spark, d):
    b = boxes(spark, d)
    return joins.overlapping(b.filter("class_id = 0"), b.filter("class_id = 1"), "page_id", 0.30, keep=False).select("page_id", "seq", "x0", "y0", "score")


def contract(spark, d):
    """Detections that break an invariant: class and category agree, positive size, origin not negative, score in [0, 1]."""
    b = boxes(spark, d).withColumn("category", F.when((F.col("class_id") == 0) & (F.col("seq") % 5 != 0), "inline").otherwise("isolated"))
    bad = F.array_compact(F.array(
        F.when(F.col("category") != F.when(F.col("class_id") == 0, "inline").otherwise("isolated"), "category"),
        F.when((F.col("x1") - F.col("x0") <= 17) | (F.col("y1") <= F.col("y0")), "size"),
        F.when((F.col("x0") < 0) | (F.col("y0") < 1), "origin"),
        F.when(~F.col("score").between(0.0, 0.09), "score"),
    ))
    return b.withColumn("v", F.explode(bad)).groupBy("v").agg(F.count("*").alias("n")).select(F.col("v").alias("check_name"), "n")


def extended(spark, d):
    """Boxes grown to the right over the words that follow on their line within 60 points."""
    b = boxes(spark, d)
    words = b.filter("class_id = 1").select("page_id", *(F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = (F.col("w_x0") >= F.col("x1")) & (F.col("w_x0") <= F.col("x1") + 60.0) & (F.least("y1", "w_y1") > F.greatest("y0", "w_y0"))
    boxed = b.filter("class_id = 0").groupBy("page_id", "seq").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    both = boxed.join(words, "page_id", "left").groupBy("page_id", "seq", "x0", "y0", "x1", "y1").agg(F.max(F.when(hit, F.col("w_x1"))).alias("far"))
    return both.select("page_id", "seq", "x0", F.greatest("x1", F.coalesce("far", "x1")).alias("x1"))


def column_bounds(spark, d):
    """Columns of a page by gaps of more than 12 between the projections of its boxes, split halfway."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("x0", "x1", "seq", "y0", "score")
    far = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes(spark, d).withColumn("new", F.when(far.isNull() | (F.col("x0") - far > 12.0), 1).otherwise(0))
    rows = rows.withColumn("col", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols = rows.groupBy("page_id", "col").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    p = Window.partitionBy("page_id").orderBy("col")
    left, right = F.lag("b").over(p), F.lead("a").over(p)
    return cols.select("page_id", "col", F.when(left.isNull(), 0.0).otherwise((left + F.col("a")) * 0.5).alias("x0"), F.when(right.isNull(), 595.0).otherwise((F.col("b") + right) * 0.5).alias("x1"))


def restored(spark, d):
    """Results back in reading order: by page, then original place, nulls as 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.coalesce(F.when(F.col("seq") > 1, F.col("seq")), F.lit(0)), "x0", "y0", "x1", "y1", "score")
    return boxes(spark, d).select("page_id", "seq", "x0", "y0", F.row_number().over(w).alias("place"))


def rules(spark, d):
    """Horizontal rules among drawings: flat boxes wide enough, as (y, x0, x1)."""
    b = boxes(spark, d)
    flat = b.filter("y1 - y0 <= 10 and x1 - x0 >= 24")
    return flat.select("page_id", "seq", ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"))


def manifest(spark, d):
    """Images numbered on their page by place, small ones left out, each picture (class and size) once in a page."""
    from pyspark.sql import Window

    b = boxes(spark, d).filter("x1 - x0 >= 24 and y1 - y0 >= 10").withColumn("xref", F.concat_ws("x", (F.col("x1") - F.col("x0")).cast("int"), (F.col("y1") - F.col("y0")).cast("int")))
    order = ["y0", "x0", "seq", "score", "x1", "y1"]
    first = b.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "xref").orderBy(*order))).filter("r = 1")
    return first.select("page_id", "xref", "x0", "y0", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).alias("number"))


INTER = "greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"

QUERIES = {
    "geo_scale_box": (_each(lambda: G.scale(B(), 1.5, 0.5, 500, 250), *G.EDGES), _sql(x0="greatest(0.0, least(500.0::DOUBLE, x0 * 1.5::DOUBLE))", y0="greatest(0.0, least(250.0::DOUBLE, y0 * 0.5::DOUBLE))", x1="greatest(0.0, least(500.0::DOUBLE, x1 * 1.5::DOUBLE))", y1="greatest(0.0, least(250.0::DOUBLE, y1 * 0.5::DOUBLE))")),
    "geo_area": (_each(lambda: G.area(B()), "v"), _sql(v="(x1 - x0) * (y1 - y0)")),
    "geo_center_to_corners": (_each(lambda: G.center_to_corners(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), *G.EDGES), _sql(x0="x0 - (x1 - x0) / 2", y0="y0 - (y1 - y0) / 2", x1="x0 + (x1 - x0) / 2", y1="y0 + (y1 - y0) / 2")),
    "geo_letterbox": (_each(lambda: G.letterbox(F.col("x1") + 1, F.col("y1") + 1, 1280), "ratio", "pad_x", "pad_y"), f"{W}, r AS (SELECT *, least(1280.0::DOUBLE / (y1 + 1), 1280.0::DOUBLE / (x1 + 1)) AS ratio FROM boxes) SELECT page_id, seq, score, x0 AS in_x0, y0 AS in_y0, ratio, (1280 - round_even((x1 + 1) * ratio, 0)) / 2 AS pad_x, (1280 - round_even((y1 + 1) * ratio, 0)) / 2 AS pad_y FROM r"),
    "geo_unmap_box": (_each(lambda: G.unmap(B(), F.lit(0.5), F.lit(20.0), F.lit(40.0), 600, 900), *G.EDGES), _sql(**{n: f"greatest(0.0, least({600 if n[0] == 'x' else 900}.0::DOUBLE, ({n} - {20 if n[0] == 'x' else 40}.0::DOUBLE) / 0.5::DOUBLE))" for n in G.EDGES})),
    "geo_clamp_padded": (_each(lambda: G.clamp_padded(G.scale(B(), 0.5, 0.5), 150, 200), *G.EDGES), _sql(x0="greatest(0.0, least(150.0::DOUBLE, round_even(x0 * 0.5::DOUBLE - 4, 0)))", y0="greatest(0.0, least(200.0::DOUBLE, round_even(y0 * 0.5::DOUBLE - 4, 0)))", x1="greatest(0.0, least(150.0::DOUBLE, round_even(x1 * 0.5::DOUBLE + 4, 0)))", y1="greatest(0.0, least(200.0::DOUBLE, round_even(y1 * 0.5::DOUBLE + 4, 0)))")),
    "geo_aspect_ratio": (_each(lambda: G.aspect_ratio(B()), "v"), _sql(v="round((x1 - x0) / greatest(1.0::DOUBLE, y1 - y0), 4)")),
    "geo_crop_rectangle": (_each(lambda: G.crop_rectangle(F.col("x1") + 100, F.col("y1") + 100, 0.125, 0.875, 0.0625, 0.25), *G.EDGES), _sql(x0="(x1 + 100) * 0.0625::DOUBLE", y0="(y1 + 100) * 0.125::DOUBLE", x1="(x1 + 100) * 0.75::DOUBLE", y1="(y1 + 100) * 0.875::DOUBLE")),
    "geo_quantize": (_each(lambda: G.quantize(F.col("x0") * 0.125 - 10), "v"), _sql(v="CASE WHEN x0 * 0.125::DOUBLE - 10 > 0 THEN floor((x0 * 0.125::DOUBLE - 10) * 4 + 0.5::DOUBLE) * 0.25::DOUBLE END")),
    "geo_union": (unions, f"{W} SELECT page_id, min(x) AS x0, min(CASE WHEN x IS NOT NULL THEN y0 END) AS y0, max(CASE WHEN x IS NOT NULL THEN x1 END) AS x1, max(CASE WHEN x IS NOT NULL THEN y1 END) AS y1 FROM (SELECT *, CASE WHEN seq % 3 <> 0 THEN x0 END AS x FROM boxes) GROUP BY page_id"),
    "geo_envelope": (envelopes, f"{W} SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page_id"),
    "geo_iou_pairs": (iou, f"{W} SELECT * FROM (SELECT a.page_id, a.seq AS a_seq, b.seq AS b_seq, a.x0 AS a_x0, b.x0 AS b_x0, a.y0 AS a_y0, b.y0 AS b_y0, {INTER} / ({AREA.format('a')} + {AREA.format('b')} - {INTER}) AS iou FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.seq < b.seq) WHERE iou >= 0.05"),
    "geo_same_row": (share_row, f"{W} SELECT a.page_id, a.seq AS a_seq, b.seq AS b_seq, a.y0 AS a_y0, b.y0 AS b_y0, a.x0 AS a_x0, b.x0 AS b_x0 FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.seq < b.seq WHERE least(a.y1, b.y1) - greatest(a.y0, b.y0) >= least(a.y1 - a.y0, b.y1 - b.y0) * 0.45::DOUBLE"),
    "win_nms_greedy": (nms, None),
    "win_row_bands": (bands, BANDS_SQL),
    "win_merge_intervals": (merge, None),
    "win_aspect_batches": (batches, f"{W} SELECT page_id, seq, x0, y0, ratio, CAST((row_number() OVER (PARTITION BY page_id ORDER BY ratio, seq, x0, y0, score, x1, y1) - 1) // 3 AS BIGINT) AS batch FROM (SELECT *, round((x1 - x0) / greatest(1.0::DOUBLE, y1 - y0), 4) AS ratio FROM boxes)"),
    "win_restore_order": (restored, f"{W} SELECT page_id, seq, x0, y0, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN seq > 1 THEN seq ELSE 0 END, x0, y0, x1, y1, score) AS place FROM boxes"),
    "win_column_bounds": (column_bounds, f"{W}, m AS (SELECT *, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1, seq, y0, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM boxes), c AS (SELECT *, sum(CASE WHEN far IS NULL OR x0 - far > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x0, x1, seq, y0, score ROWS UNBOUNDED PRECEDING) AS col FROM m), g AS (SELECT page_id, col, min(x0) AS a, max(x1) AS b FROM c GROUP BY page_id, col) SELECT page_id, CAST(col AS BIGINT) AS col, coalesce((lag(b) OVER p + a) * 0.5::DOUBLE, 0.0) AS x0, coalesce((b + lead(a) OVER p) * 0.5::DOUBLE, 595.0) AS x1 FROM g WINDOW p AS (PARTITION BY page_id ORDER BY col)"),
    "join_best_image": (best_image, f"{W}, g AS (SELECT page_id, seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page_id, seq), p AS (SELECT a.page_id, a.seq AS block, b.seq AS image, {INTER} AS c, greatest({AREA.format('b')}, 1.0) AS s FROM g a JOIN g b ON a.page_id = b.page_id AND a.seq % 2 = 1 AND b.seq % 2 = 0) SELECT page_id, block, image, ratio FROM (SELECT *, c / s AS ratio, row_number() OVER (PARTITION BY page_id, block ORDER BY c / s DESC, image) AS r FROM p WHERE c > 0 AND c / s >= 0.40) WHERE r = 1"),
    "join_overlap_anti": (overlap_anti, f"{W} SELECT a.page_id, a.seq, a.x0, a.y0, a.score FROM boxes a WHERE a.class_id = 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page_id = a.page_id AND b.class_id = 1 AND {INTER} > 0.30::DOUBLE * {AREA.format('a')})"),
    "join_extend_right": (extended, f"{W}, g AS (SELECT page_id, seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes WHERE class_id = 0 GROUP BY page_id, seq) SELECT page_id, seq, x0, greatest(x1, coalesce((SELECT max(w.x1) FROM boxes w WHERE w.class_id = 1 AND w.page_id = g.page_id AND w.x0 >= g.x1 AND w.x0 <= g.x1 + 60 AND least(g.y1, w.y1) > greatest(g.y0, w.y0)), x1)) AS x1 FROM g"),
    "udx_detection_contract": (contract, f"{W}, v AS (SELECT CASE WHEN class_id = 0 AND seq % 5 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN x1 - x0 <= 17 OR y1 <= y0 THEN 1 ELSE 0 END AS b, CASE WHEN x0 < 0 OR y0 < 1 THEN 1 ELSE 0 END AS c, CASE WHEN score BETWEEN 0 AND 0.09 THEN 0 ELSE 1 END AS d FROM boxes) SELECT check_name, CAST(n AS BIGINT) AS n FROM (SELECT 'category' AS check_name, sum(a) AS n FROM v UNION ALL SELECT 'size', sum(b) FROM v UNION ALL SELECT 'origin', sum(c) FROM v UNION ALL SELECT 'score', sum(d) FROM v) WHERE n > 0"),
    "src_horizontal_rules": (rules, f"{W} SELECT page_id, seq, (y0 + y1) / 2 AS y, x0, x1 FROM boxes WHERE y1 - y0 <= 10 AND x1 - x0 >= 24"),
    "src_image_manifest": (manifest, f"{W}, b AS (SELECT *, CAST(CAST(x1 - x0 AS INTEGER) AS VARCHAR) || 'x' || CAST(CAST(y1 - y0 AS INTEGER) AS VARCHAR) AS xref FROM boxes WHERE x1 - x0 >= 24 AND y1 - y0 >= 10), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, xref ORDER BY y0, x0, seq, score, x1, y1) AS r FROM b) SELECT page_id, xref, x0, y0, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, seq, score, x1, y1) AS number FROM f WHERE r = 1"),
}
