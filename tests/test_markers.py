"""Marker queries on beginnings and numbers that the driver's small tables do not have, against their SQL."""

import duckdb

from quire.plans.catalogue import ORACLE_SQL, QUERIES


def both(spark, tmp_path, name, texts):
    """Rows of the query and of its SQL over documents with these texts."""
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, d)
    cur = c.execute(ORACLE_SQL[name])
    at = [got.columns.index(x[0]) for x in cur.description]
    key = lambda r: [(x is not None, x) for x in r]
    return sorted((tuple(r[i] for i in at) for r in got.collect()), key=key), sorted(cur.fetchall(), key=key)


def test_planted_markers_only(spark, tmp_path):
    """A marker at the text's own beginning is none of the planted ones; texts may be empty or missing."""
    got, want = both(spark, tmp_path, "scl_detect_markers", ["A dog", "①", "[5] b", "²", ")a b", "Of dogs", "", None])
    assert got == want and len(got) == 8 * 5


def test_marker_numbers_beyond_an_int(spark, tmp_path):
    """Numbers that fit no int are null in the SQL and may not fail."""
    lines = ["x"] * 19 + ["9" * 30]  # the seed of this line has no letter
    got, want = both(spark, tmp_path, "scl_marker_number", ["\n".join(lines), "\n2147483648\n\n¹²³⁴⁵⁶⁷⁸⁹⁰¹²", "\n2147483647", ""])
    assert got == want and [r[3] for r in got].count(None) == 3
