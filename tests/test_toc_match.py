"""The table of contents in long books: few pairs, and the same levels as by brute force."""

import random
import re

from quire.operators.joins import toc_match


def level(page, title, entries):
    found = []
    for idx, p, t, lv in entries:
        far = abs(p - page)
        a, b = set(title), set(t)
        if title == t and far <= 2:
            found.append((0, idx, lv))
        elif far <= 3 and a and b and len(a & b) / len(a | b) >= 0.8:
            found.append((1, idx, lv))
    return min(found)[2] if found else 0


def test_long_books(spark):
    r = random.Random(5)
    title = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(5)))
    heads = [(b, i, r.randrange(-20, 60), title()) for b in ("x", "y") for i in range(200)] + [("z", 1, 5, "a"), ("x", 900, None, "a"), (None, 901, 3, "a")]
    toc = [(b, i, r.randrange(-20, 60), title(), i % 3 + 1) for b in ("x", "y") for i in range(90)]
    got = toc_match(spark.createDataFrame(heads, "book string, id long, page long, title string"), spark.createDataFrame(toc, "book string, toc_idx long, page long, title string, level int"))
    want = {(b, i): 0 if p is None else level(p, t, [e[1:] for e in toc if e[0] == b]) for b, i, p, t in heads}
    assert {(x.book, x.id): x.level for x in got.collect()} == want and len(set(want.values())) == 4
    # A book alone is no key: its pages go with the square of its length.
    join = re.search(r"Join LeftOuter, (.*)", got._jdf.queryExecution().optimizedPlan().toString())[1]
    assert join.count(" = ") == 2
