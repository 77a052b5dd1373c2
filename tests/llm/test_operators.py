"""Each training-data operator against a brute-force version, and its defined results for odd input."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (None, "one two three four", "en", "s", 18),
    (3, "one two three four", "en", "s", 18),
    (3, "one two three four", "en", "s", 18),
    (4, " \n\n ", "en", "s", 4),
    (5, "word " * 30_000, "en", "s", 150_000),
]
CLASH = ("vec", "keys", "cid", "component", "text_hash", "score", "n", "rank", "_id", "bucket", "mix_slot", "n_lines_in", "src", "part", "c0", "unit", "count")


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(7) for c in CLASH})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def near_texts(seed, n=60, vocabulary=40):
    """Texts in groups of near copies, with exact copies and short ones."""
    r = random.Random(seed)
    words = [f"W{i}" for i in range(vocabulary)]
    out = []
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 12, 30, 60, 120]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(r.choice([" ", "\n", "  "]).join(t))
    return out[:n]


def groups_of(n, links):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        p[b] = a
    return [root(x) for x in range(n)]


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    from quire.llm.components import connected_components
    from quire.llm.staging import Stage

    r = random.Random(seed)
    n = 60
    links = [(r.randrange(n), r.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(40, 55)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Stage(spark, "t")).collect()
    want = groups_of(n, links)
    assert {x.id: x.component for x in got} == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).count() == 0


# ------------------------------------------------------------------ 1 WARC


def test_warc_round_trip(spark):
    from quire.llm.warc import round_trip

    page = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "u5", page), (3, "u\r\n3", page), (9, None, page), (1, "u1", "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", ""), (None, "n", page), (7, "big", "y" * 5_000_000), (8, "mid", "z" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1)).withColumn("first", F.lit(2))
    got = {r.page_id: r for r in round_trip(spark, df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if html_is(rows, i, page)} == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3)}
    assert all(got[i].record_type == "response" for i in (1, 2, 4, 6, 7, 8))
    assert got[3].url == "u%0D%0A3" and got[9].url is None
    assert round_trip(spark, df.limit(0)).count() == 0


def html_is(rows, page_id, page):
    return any(i == page_id and h == page for i, _, h in rows)


def record(i, payload=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:quire:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage(pack):
    from quire.llm.warc import salvage

    r = random.Random(1)
    for case in range(30):
        parts = [pack(record(i, bytes(r.randrange(256) for _ in range(r.randrange(300))))) for i in range(6)]
        bad = set(r.sample(range(6), r.choice([0, 1, 2])))
        for i in bad:
            b = bytearray(parts[i])
            if r.random() < 0.5:
                del b[len(b) // 2 :]
            else:
                k = len(b) - 12 if pack is bytes else len(b) - 6
                b[k] ^= 0xFF
            parts[i] = bytes(b)
        data = b"".join(parts)
        items = list(salvage(data))
        assert [x[1] for x in items][0] == 0 and items[-1][2] == len(data)
        assert all(a[2] == b[1] for a, b in zip(items, items[1:]))  # each byte once
        kept = {x[3]["warc-record-id"] for x in items if x[0] == "record"}
        assert kept >= {f"<urn:quire:page:{i}>" for i in range(6) if i not in bad}
        assert any(x[0] == "gap" for x in items) == bool(bad)
    assert list(salvage(b"")) == [] and list(salvage(b"junk"))[0][:3] == ("gap", 0, 4)


def test_read_damaged_file(spark, tmp_path):
    from quire.llm.warc import read_archives

    (tmp_path / "a.warc").write_bytes(record(1) + b"garbage" + record(2))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(3)) + gzip.compress(record(4))[:-9] + gzip.compress(record(5)))
    rows = read_archives(spark, [str(tmp_path)]).collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [1, 2, 3, 5]
    assert [(r.length > 0, bool(r.reason)) for r in rows if r.kind == "gap"] == [(True, True)] * 2


# ------------------------------------------------------------------ 2 decontamination


def brute_hits(text, items, width=10):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = find(text), set(), set()
    for item, t in items:
        v = find(t)
        wins = [v[i : i + width] for i in range(max(len(v) - width, 0) + 1)] if v else []
        for x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    ids.add(str(item))
    return len(w), sorted(hit), sorted(ids)


def test_decontamination(spark):
    from quire.llm.decontam import contamination, digest

    r = random.Random(3)
    vocabulary = "ab Cd é1 x9 of ÄB z".split()
    phrase = lambda n: r.choice([" ", "-", ", "]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(r.choice([0, 2, 5, 10, 12, 20]))) for i in range(12)] + [(77, None), (78, "...")]
    texts = [phrase(5) + " " + r.choice(items)[1].upper() + "; " + phrase(8) if r.random() < 0.6 and items else phrase(40) for _ in range(40) if True and (items := [x for x in items if x[1] is not None])]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items + [(77, None)], "item_id long, text string")
    for most in (10_000, 5):
        got = {x.doc_id: x for x in contamination(spark, docs, bench, max_patterns=most).collect()}
        for i, t in enumerate(texts):
            n, hit, ids = brute_hits(t, items)
            assert (got[i].n_words, got[i].hit_words, got[i].items) == (n, hit, ids)
            covered = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)]
            assert sorted(k for k, (a, b) in enumerate(covered) if any(s.start <= a and b <= s.end for s in got[i].spans)) == hit
    assert digest(contamination(spark, odd_docs(spark), bench)).count() == len(ODD)
    assert contamination(spark, empty_docs(spark), bench).count() == 0
    none = digest(contamination(spark, docs, bench.limit(0))).collect()
    assert len(none) == len(texts) and not any(x.contaminated for x in none) and none[0].items_sha256 == hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ 3 HTML


def test_html_known_page(spark):
    from quire.llm.html_crf import extract

    page = (
        "<html><head><title>T</title><script>a('<p>')</script></head><body><header><h1>My site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-banner'>We use cookies.</div><article><h1>Big&nbsp;news &amp; more</h1><p>First  paragraph\n with <b>bold<br>text.<p>Second one, longer than the first one was."
        "<div class=ad>Buy now.</div><p>Third.</p></article><aside class=sidebar><h3>Popular</h3><p>Something else here.</p></aside>"
        "<section id=comments><h2>Comments</h2><div class=comment><p>Nice article, thanks a lot.</p></div></section>"
        "<form><label>Search</label><input><button>Go</button></form><footer>&copy; Me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p>Just one plain paragraph of text, nothing else.</p>"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = extract(spark, df).collect()
    want = "Big news & more\nFirst paragraph with bold text.\nSecond one, longer than the first one was.\nThird."
    assert [x.text for x in got if x.page_id == 1] == [want] * 2
    assert [x.text for x in got if x.page_id in (2, 3)] == ["", ""]
    assert all(x.n_chars == len(x.text) for x in got) and len(got) == 5
    assert extract(spark, df.limit(0)).count() == 0


def test_html_held_out_accuracy():
    from quire.llm.html_crf import labelled, trained
    from quire.llm.html_pages import labelled_pages

    model, wrong, total = trained(), 0, 0
    for found, labels in labelled(labelled_pages(300, seed=12345)):
        wrong += sum(a != b for a, b in zip(model.decode(found), labels))
        total += len(labels)
    assert wrong / total < 0.02


# ------------------------------------------------------------------ 4 line dedup


def brute_lines(texts):
    def normal(x):
        return re.sub(r"[\W_]+", " ", x.lower()).strip()

    def sim(x):
        w = x.split(" ")
        one = lambda t, seed: xxhash.xxh64_intdigest(t.encode(), seed=seed)
        h = [one(b, one(a, 42)) for a, b in zip(w, w[1:])] or [one(x, 42)]  # a hash of two columns seeds the second with the first's
        return sum(1 << b for b in range(63) if 2 * sum(v >> b & 1 for v in h) > len(h))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    lines = sorted({normal(x) for t in texts for x in t.split("\n")} - {""})
    links = [
        (i, j)
        for i in range(len(lines))
        for j in range(i)
        if (sim(lines[i]) ^ sim(lines[j])).bit_count() <= 3 and distance(lines[i], lines[j]) <= (0.2 + 1e-9) * max(len(lines[i]), len(lines[j]))
    ]
    group, seen, out = dict(zip(lines, groups_of(len(lines), links))), set(), []
    for t in texts:
        kept = []
        for x in t.split("\n"):
            g = group.get(normal(x))
            if g is None or g not in seen:
                kept.append(x)
            seen.add(g)
        out.append("\n".join(kept))
    return out, len(links)


def test_line_dedup(spark):
    from quire.llm.line_dedup import dedup_lines

    r = random.Random(5)
    pool = []
    for _ in range(25):
        base = " ".join(f"word{r.randrange(500)}" for _ in range(r.choice([1, 4, 150, 150])))
        pool += [base, base.upper() + "!"] + [base.replace(base[k : k + 1], "q", 1) if False else base[:k] + "x" + base[k + 1 :] for k in r.sample(range(len(base)), 3)]
    texts = ["\n".join(r.choice(pool + ["", "---"]) for _ in range(r.randrange(1, 8))) for _ in range(50)]
    want, links = brute_lines(texts)
    got = {x.doc_id: x for x in dedup_lines(spark, docs_of(spark, texts)).collect()}
    assert links > 10 and [got[i].text for i in range(len(texts))] == want
    assert all(got[i].n_lines_in == t.count("\n") + 1 for i, t in enumerate(texts))


@pytest.mark.parametrize("n_words", [10, 30, 60, 90])
def test_line_dedup_recall(spark, n_words):
    """Of lines with edit similarity of 0.8 or more, with words replaced, inserted, left out or misspelt, nine tenths go; no others do."""
    from quire.llm.line_dedup import dedup_lines

    def similarity(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    r = random.Random(n_words)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(1, 11))) for _ in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    firsts, seconds = [], []
    for k in range(80):
        a = r.choices(vocabulary, weights, k=n_words)
        b = list(a)
        for _ in range(r.randrange(1, max(2, n_words // 5) + 1)):
            i = r.randrange(len(b))
            word = r.choice(vocabulary)
            b[i : i + 1] = r.choice([[word], [word], [b[i], word], [], [b[i][:-1] + "Q"]])
        firsts.append(" ".join(a))
        seconds.append(" ".join(b))
    got = {x.doc_id: x.text for x in dedup_lines(spark, docs_of(spark, firsts + seconds), minhash=True).collect()}
    similar = [similarity(a.lower(), b.lower()) >= 0.8 for a, b in zip(firsts, seconds)]
    gone = [got[80 + i] == "" for i in range(80)]
    assert all(got[i] == firsts[i] for i in range(80))
    assert sum(similar) > 40 and sum(s and g for s, g in zip(similar, gone)) >= 0.9 * sum(similar)
    assert not any(g and not s for s, g in zip(similar, gone))


def test_line_sketch_commonest_last(spark, monkeypatch):
    """Of common words the commonest come last, so that lines of common words meet by the rarer ones."""
    from quire.llm import line_dedup
    from quire.llm.staging import Stage

    monkeypatch.setattr(line_dedup, "COMMON", ((2, 64), (4, 16), (8, 16)))
    often = {"once": 1, "thrice": 3, "five": 5, "nine": 9}
    lines = ["nine five thrice once", *(" ".join(w for w, n in often.items() if n > i) for i in range(1, 9))]
    texts = spark.createDataFrame([("\n".join(lines),)], "norm string")
    common = line_dedup.common_words(texts, Stage(spark, "sketch"))
    row = texts.select(line_dedup._sketch(F.lit(lines[0]), 4, common).alias("s"), F.array(*(line_dedup._word_hash(F.lit(w)) for w in often)).alias("h")).first()
    assert [x % (1 << 29) for x in row.s] == row.h
    assert [x >> 29 for x in row.s] == [0, 1, 2, 3]


def test_edit_links(spark):
    """The cheap bounds settle pairs as the distance itself does."""
    from quire.llm.line_dedup import edit_links

    r = random.Random(5)
    lines = set()
    for _ in range(150):
        a = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(r.choice([1, 2, 3, 6, 12]))]
        lines.add(" ".join(a))
        for _ in range(4):
            b = list(a)
            for _ in range(r.choice([1, 1, 2])):
                i = r.randrange(len(b)) if b else 0
                b[i : i + 1] = r.choice([["cab"], [], [*b[i : i + 1], "dad"], [x[:-1] + "z" for x in b[i : i + 1]]])
            lines.add(" ".join(b))
    lines = sorted(lines - {""})
    texts = spark.createDataFrame(list(enumerate(lines)), "lid long, norm string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i + 1, min(i + 40, len(lines)))], "a long, b long")
    both = pairs.join(texts.toDF("a", "s"), "a").join(texts.toDF("b", "t"), "b")
    want = {(x.a, x.b) for x in both.filter("levenshtein(s, t) <= (0.2 + 1e-9) * greatest(length(s), length(t))").collect()}
    assert len(want) > 100 and {(x.a, x.b) for x in edit_links(pairs, texts).collect()} == want


def test_line_dedup_odd(spark):
    from quire.llm.line_dedup import dedup_lines

    out = dedup_lines(spark, odd_docs(spark))
    assert out.columns[-2:] == ["n_lines_in_", "n_lines_out"]
    got = out.collect()
    assert len(got) == len(ODD) and {x["_id"] for x in got} == {7}
    assert [x.text for x in got if x.doc_id == 3] == ["one two three four"] * 2 and [x.text for x in got if x.doc_id is None] == [""]
    assert [x.text for x in got if x.doc_id == 2] == [None]
    assert dedup_lines(spark, empty_docs(spark)).count() == 0


# ------------------------------------------------------------------ 5 quality


def test_quality_held_out(spark):
    from quire.llm.quality import op5_quality

    sf = "/root/testdata/sf0.01"
    got = op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in got]) > 0.95


def test_quality_odd(spark):
    from quire.llm.quality import fit, with_score

    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    scored = with_score(odd_docs(spark), fit(odd_docs(spark), labels), "score")
    assert scored.columns[-1] == "score_"
    got = scored.collect()
    assert len(got) == len(ODD) and all(0 <= x["score_"] <= 1 for x in got)
    assert with_score(empty_docs(spark), fit(empty_docs(spark), labels)).count() == 0
    none = with_score(docs_of(spark, ["a"]), fit(docs_of(spark, ["a"]), labels.limit(0))).first()
    assert none[-1] == 0.5


# ------------------------------------------------------------------ 6 BM25


@pytest.mark.parametrize("shard_docs,query_block", [(1000, 1000), (17, 7)])
def test_bm25(spark, shard_docs, query_block):
    from quire.llm.bm25 import B, K1, top_k

    r = random.Random(8)
    vocabulary = [f"t{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    texts = [" ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 5, 40, 120]))) for _ in range(150)]
    tf = [Counter(t.lower().split()) for t in texts]
    df = Counter(w for c in tf for w in c)
    mean = sum(sum(c.values()) for c in tf) / len(tf)
    docs = docs_of(spark, texts)
    got = defaultdict(list)
    for x in top_k(spark, docs, docs.filter("doc_id % 20 = 0"), 5, shard_docs, query_block).orderBy("query", "rank").collect():
        got[x["query"]].append((x.doc_id, x.score))
    for q in range(0, 150, 20):
        scores = {}
        for d in range(150):
            s = sum(np.log(1 + (150 - df[w] + 0.5) / (df[w] + 0.5)) * tf[d][w] * (K1 + 1) / (tf[d][w] + K1 * (1 - B + B * sum(tf[d].values()) / mean)) for w in tf[q] if w in tf[d])
            if s > 0 and d != q:
                scores[d] = round(float(s), 9)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-8)
        assert [d for d, _ in got[q]] == [d for d, _ in want]


@pytest.mark.parametrize("long", [2, 64])
def test_bm25_shard_sums(monkeypatch, long):
    """Lists copied one by one or together add up to the same: for each text the rare terms' contributions, by number in the block, then block."""
    from quire.llm import bm25

    monkeypatch.setattr(bm25, "LONG", long)
    r = np.random.default_rng(3)
    n, vocabulary = 150, 400
    counts = (r.random((n, vocabulary)) < np.linspace(0.005, 0.5, vocabulary)) * r.integers(1, 4, (n, vocabulary))
    counts[np.arange(vocabulary) % n, np.arange(vocabulary)] = 1  # every term is there
    counts[:, 0] = np.arange(n) + 1  # no two texts are equal
    row, term = np.nonzero(counts)
    length = counts.sum(1)
    batch = bm25._index_row(np.arange(n), np.zeros(n, dtype=bool), np.arange(n), [(term.astype(np.int64), row.astype(np.int32), counts[row, term].astype(np.int32), length)])
    idf = np.linspace(3, 1, vocabulary)
    data = {c: batch.column(c)[0].as_buffer() for c in ("rows", "counts", *bm25._TYPES) if c != "df"}
    shard = bm25.Shard(length.mean(), np.arange(vocabulary), idf, **data)
    asked = [np.sort(r.choice(vocabulary, 60, replace=False)) for _ in range(3)]
    at, of = np.concatenate(asked), np.repeat(np.arange(3), 60)
    got = shard.sums(at, of, 3)
    damp = bm25.K1 * (1 - bm25.B + bm25.B * length / length.mean())
    part = counts * (bm25.K1 + 1) / (counts + damp[:, None]) * idf
    rare = (counts > 0).sum(0) <= n / bm25.DENSE
    texts = shard.ids  # each text is there once
    for i, terms in enumerate(asked):
        by_row = got[i].T.ravel()[:n]
        assert np.allclose(by_row, part[:, terms[rare[terms]]].sum(1)[texts], rtol=1e-5)
        exact = shard.exact(np.full(n, i), np.arange(n), at, of, 3)
        assert np.allclose(exact, part[:, terms].sum(1)[texts], rtol=1e-12)


def test_bm25_odd(spark):
    from quire.llm.bm25 import top_k

    got = top_k(spark, odd_docs(spark), odd_docs(spark)).collect()
    assert {x["query"] for x in got} <= {None, 3, 5}
    assert top_k(spark, empty_docs(spark), empty_docs(spark)).count() == 0


@pytest.mark.parametrize("shard_docs,query_block,batch,block", [(1000, 1000, 64, 16), (23, 11, 4, 2), (1, 3, 64, 16)])
def test_bm25_repeats(spark, monkeypatch, shard_docs, query_block, batch, block):
    """Repeated and null ids, copies of texts and repeated rows give brute force's rows for any shards, passes and blocks."""
    from quire.llm import bm25

    monkeypatch.setattr(bm25, "BATCH", batch)
    monkeypatch.setattr(bm25, "BLOCK", block)
    r = random.Random(shard_docs)
    pool = [" ".join(r.choices([f"t{i}" for i in range(200)], [1 / (i + 1) for i in range(200)], k=r.choice([1, 3, 30, 90]))) for _ in range(50)]
    rows = [(r.choice([None, *range(0, 60, 3)]), r.choice([None, "", *pool])) for _ in range(120)]
    rows += [(1, "apple pear plum"), (1, "apple pear fig"), (2, "apple"), (2, "apple")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [x for x in rows if x[0] is None or x[0] % 4 < 2]
    tf = [Counter((t or "").split()) for _, t in rows]
    df = Counter(w for c in tf for w in c)
    mean = sum(sum(c.values()) for c in tf) / len(tf)
    want = Counter()
    for i, (q, text) in enumerate(rows):
        if (q, text) not in asked:
            continue
        found = []
        for d, other in enumerate(rows):
            if (q, text or "") == (other[0], other[1] or ""):
                continue
            s = sum(np.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * tf[d][w] * (bm25.K1 + 1) / (tf[d][w] + bm25.K1 * (1 - bm25.B + bm25.B * sum(tf[d].values()) / mean)) for w in tf[i] if w in tf[d])
            if s > 0:
                found.append((-round(round(float(s), 9), 7), other[0] is None, other[0] or 0))
        for rank, (s, null, d) in enumerate(sorted(found)[:6], 1):
            want[q, rank, None if null else d, -s] += 1
    queries = docs.filter("doc_id is null or doc_id % 4 < 2")
    got = Counter((x["query"], x["rank"], x.doc_id, round(x.score, 7)) for x in bm25.top_k(spark, docs, queries, 6, shard_docs, query_block).collect())
    assert got == want


def test_decontamination_by_several_automata(spark):
    """Rows that repeat an id, or have none, are judged singly however many automata there are."""
    from quire.llm.decontam import contamination, digest

    docs = spark.createDataFrame([(7, "one two three four"), (7, "red green blue white"), (None, "one two three four"), (None, "red green blue white"), (8, None), (9, "seven eight nine")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "two three"), ("b", "eight"), ("c", "nothing here"), ("b", "seven")], "item_id string, text string")
    one, many = (sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in digest(contamination(spark, docs, items, max_patterns=n)).collect()) for n in (100, 1))
    assert one == many and [r[5] for r in one if r[0] == "7"] == [False, True] and [r[2] for r in one if r[0] == "9"] == [2]


# ------------------------------------------------------------------ 7 Jaccard join


def brute_jaccard(texts, width, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], groups_of(len(texts), links)


@pytest.mark.parametrize("width,num,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3), (1, 50, 4)])
def test_jaccard(spark, width, num, seed):
    from quire.llm.jaccard_join import JaccardJoin

    texts = near_texts(seed, 120)
    sizes, groups = brute_jaccard(texts, width, num, 100)
    got = {x.doc_id: x for x in JaccardJoin(spark, docs_of(spark, texts), width, num, 100).components().collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == groups


@pytest.mark.parametrize("width,num,seed", [(5, 80, 2), (2, 60, 3)])
def test_near_join(spark, width, num, seed):
    from quire.llm.near_join import NearJoin

    texts = near_texts(seed, 120)
    sizes, groups = brute_jaccard(texts, width, num, 100)
    got = {x.doc_id: x for x in NearJoin(spark, docs_of(spark, texts), width, num, 100).components().collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes and [got[i].component_id for i in range(len(texts))] == groups


def test_jaccard_blocks(spark, monkeypatch):
    """Buckets larger than a block are split, without losing a link."""
    from quire.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(40):
        t = list(base)
        t[r.randrange(80)] = f"v{r.randrange(9)}"
        t[r.randrange(80)] = f"v{r.randrange(9)}"
        texts.append(" ".join(t))
    got = {x.doc_id: x.component_id for x in jaccard_join.JaccardJoin(spark, docs_of(spark, texts), 3, 85, 100).components().collect()}
    assert [got[i] for i in range(40)] == brute_jaccard(texts, 3, 85, 100)[1]


def test_jaccard_tree():
    from quire.llm.jaccard_join import DIMS, CountTree, Scheme

    rng = np.random.default_rng(0)
    vectors = rng.poisson(3, (300, DIMS)).astype(np.int32)
    vectors[100:200] = vectors[:100] + (rng.random((100, DIMS)) < 0.03)
    sizes, s = vectors.sum(1), Scheme(90, 100)
    tree = CountTree(sizes, vectors, s)
    for p in range(0, 300, 7):
        bound = np.minimum(vectors, vectors[p]).sum(1)
        want = {q for q in range(300) if bound[q] >= s.needed(int(sizes[p]), int(sizes[q])) and 10 * min(sizes[p], sizes[q]) >= 9 * max(sizes[p], sizes[q])}
        assert set(tree.search(int(sizes[p]), vectors[p]).tolist()) == want


def test_jaccard_odd(spark):
    from quire.llm.jaccard_join import JaccardJoin

    got = JaccardJoin(spark, odd_docs(spark), 3, 90, 100).components().collect()
    assert len(got) == len(ODD)
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 2, None: 3, 3: 3, 4: 4, 5: 5}
    assert JaccardJoin(spark, empty_docs(spark)).components().count() == 0


# ------------------------------------------------------------------ 8 quotes


def test_quotes(spark):
    from quire.llm.quotes import conversations

    rows = [
        (1, 0, "user", "How do I boil an egg?\nI have a pan."),
        (1, 1, "assistant", "On Monday, user wrote:\n> How do I boil an egg?\n> I have a pan.\n\nPut it in water."),
        (1, 2, "user", ">> How do I boil an egg?\n> Put it in   WATER.\nFor how long?"),
        (2, 0, "user", "> For how long?\nSix minutes."),
        (2, 1, "user", "> nobody said this\nok"),
        (2, 2, "user", None),
        (2, 2, "user", None),
        (3, 0, "user", ""),
        (None, 0, "user", "Six minutes."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1)).withColumn("thread", F.lit(2))
    got = conversations(spark, df).orderBy("thread", "number").collect()
    assert len(got) == len(rows)
    by = {(x.conv_id, x.turn): x for x in got}
    assert [by[k].text for k in ((1, 1), (1, 2), (2, 0))] == ["Put it in water.", "For how long?", "Six minutes."]
    assert [(by[k].reply_to_conv, by[k].reply_to_turn, by[k].depth, by[k].thread) for k in ((1, 1), (1, 2), (2, 0))] == [(1, 0, 1, 1), (1, 1, 2, 1), (1, 2, 3, 1)]
    assert by[2, 1].reply_to_conv is None and by[2, 1].n_quotes == 1
    assert [(x.conv_id, x.turn, x.number) for x in got if x.thread == 1] == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 3)]
    assert conversations(spark, df.limit(0)).count() == 0


def test_partial_and_rewrapped_quotes(spark):
    from quire.llm.quotes import conversations

    one = "The harbour opens at six. Bring the blue folder with you, and ask for Ann at the desk. Yes, please."
    two = "We counted the crates twice last night\nand found that three of them were missing\nso the lorry has to wait until noon."
    rows = [
        (1, 0, "user", one),
        (1, 1, "assistant", two),
        (1, 2, "user", "> Bring the blue folder with you,\n> and ask for Ann at the desk.\nI will."),
        (1, 3, "user", "> found that three of\n> them were missing so the lorry\nWhich ones?"),
        (1, 4, "user", "> Yes, please.\nGood."),
        (1, 5, "user", "> the blue\nToo short to tell."),
        (2, 0, "user", "> the crates twice last night and found\nReally?"),
        (2, 1, "user", "> the crates twice last week and found\nNobody wrote that."),
        (3, 0, "user", "Elsewhere they ask for Ann at the desk."),
        (3, 1, "user", "> and ask for Ann at the desk\nStill she."),
        (3, 2, "user", "> ask for Ann at the desk\nShe again."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    to = {(x.conv_id, x.turn): (x.reply_to_conv, x.reply_to_turn) for x in conversations(spark, df).collect()}
    none = (None, None)
    assert to == {
        (1, 0): none, (1, 1): none, (1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (1, 0), (1, 5): none,
        (2, 0): (1, 1), (2, 1): none, (3, 0): none, (3, 1): (1, 0), (3, 2): (3, 0),
    }


# ------------------------------------------------------------------ 9 mixing


@pytest.mark.parametrize("seed", range(6))
def test_edf_is_pfair(seed):
    from quire.llm.mixing import edf_period

    r = random.Random(seed)
    share = {f"s{i}": r.randrange(1, 40) for i in range(r.randrange(1, 9))}
    slots, m = edf_period(share), sum(share.values())
    assert sorted(t for x in slots.values() for t in x) == list(range(m))
    for s, a in share.items():
        done = 0
        for t in range(m):
            done += t in slots[s]
            assert abs(done - (t + 1) * a / m) < 1


def test_mixing_keeps_exact_weights():
    """Less than one block from the requested weights after many thousands of slots, also once sources run out."""
    from fractions import Fraction

    from quire.llm.mixing import plan

    weights = {"a": 0.1237, "b": 1 / 3, "c": 2.0**0.5, "d": 7.77e-5, "zero": 0.0}
    blocks = {"a": 3000, "b": 6000, "c": 25000, "d": 5, "zero": 9}
    slots = plan(blocks, weights)
    n = sum(blocks.values())
    assert sorted(t for x in slots.values() for t in x) == list(range(n)) and list(slots["zero"]) == list(range(n - 9, n))
    owner = {t: s for s, x in slots.items() for t in x}
    done, ideal, left = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0.0), {s for s in blocks if s != "zero"}
    for t in range(n - 9):
        done[owner[t]] += 1
        rest = 1.0  # of this slot; sources leave the ideal in its midst
        while left and rest > 1e-12:
            whole = sum(weights[s] for s in left)
            step = min(rest, *((blocks[s] - ideal[s]) * whole / weights[s] for s in left))
            for s in left:
                ideal[s] += step * weights[s] / whole
            rest -= step
            left = {s for s in left if blocks[s] - ideal[s] > 1e-7}
        assert all(abs(done[s] - ideal[s]) < 1 + 1e-6 for s in blocks)
    many = {"big": 50.0} | {f"s{i}": 1.0 for i in range(4999)}
    slots = plan({s: 60 if s == "big" else 1 for s in many}, many)
    assert sum(t < 5049 for t in slots["big"]) in (49, 50, 51)
    assert all(abs(sum(t < x for t in slots["big"]) - Fraction(50 * x, 5049)) < 1 for x in range(1, 5000, 7))


def test_mixing_many_sources(spark):
    from quire.llm.mixing import mix

    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    got = mix(spark, rows)
    assert got.agg(F.count("*"), F.countDistinct("mix_slot"), F.max("mix_slot")).first() == (20_500, 20_500, 20_499)


def test_mixing(spark):
    from quire.llm.mixing import mix

    rows = [(i, f"s{min(i % 7, 3)}" if i % 50 else None) for i in range(700)]
    got = mix(spark, spark.createDataFrame(rows, "doc_id long, source string"), {"s0": 3, "s1": 1, "s3": 2}, block=8).collect()
    assert sorted((x.doc_id, x.source) for x in got) == sorted(rows)
    assert len({(x.mix_slot, x.mix_place) for x in got}) == len(rows)
    per = defaultdict(set)
    for x in got:
        per[x.mix_slot].add((x.source, x.mix_block))
    assert all(len(v) == 1 for v in per.values())
    last = mix(spark, odd_docs(spark))
    assert last.columns[-3:] == ["mix_slot_", "mix_place", "mix_block"] and last.count() == len(ODD)
    assert mix(spark, empty_docs(spark)).count() == 0


# ------------------------------------------------------------------ 10 licences


def test_licences(spark):
    from quire.llm.licences import TEXTS, scan_licences

    texts = [
        "Some text.\nReleased under the MIT License.",
        "Intro\n\n" + TEXTS["MIT"] + "\n\nEnd of it.",
        TEXTS["Apache-2.0"].replace("permissions", "rights"),
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        "Nothing of the kind is licensed here",
    ]
    got = {(x.doc_id, x.licence): x for x in scan_licences(spark, docs_of(spark, texts)).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (3, "CC-BY-NC-4.0")}
    assert got[0, "MIT"].dice == 1.0 and got[2, "Apache-2.0"].dice < 1
    assert scan_licences(spark, odd_docs(spark)).count() == 0 and scan_licences(spark, empty_docs(spark)).count() == 0


def test_licences_in_windows(spark):
    """A licence over several paragraphs inside a longer document, and a notice within a line."""
    from quire.llm.licences import TEXTS, scan_licences

    r = random.Random(4)
    prose = lambda n: " ".join(r.choice("tree house of the and in a river stone".split()) for _ in range(n))
    split = TEXTS["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    assert split.count("\n\n") == 2
    texts = [
        prose(400) + "\n\n" + split + "\n\n" + prose(300),
        prose(40) + " This project is licensed under the Zlib License and " + prose(40),
        prose(600),
        None,
    ]
    docs = docs_of(spark, [t or "" for t in texts])
    assert scan_licences(spark, docs).count() == 0
    got = {(x.doc_id, x.licence): (x.dice, x.n_segments) for x in scan_licences(spark, docs, windows=True).collect()}
    assert set(got) == {(0, "MIT"), (1, "Zlib")} and got[0, "MIT"] == got[1, "Zlib"] == (1.0, 1)
    assert scan_licences(spark, odd_docs(spark), windows=True).count() == 0 and scan_licences(spark, empty_docs(spark), windows=True).count() == 0


def test_licences_brute_force(spark):
    from quire.llm.licences import scan_licences

    r = random.Random(2)
    w = [f"w{i}" for i in range(12)]
    known = [(f"L{i}", " ".join(r.choice(w) for _ in range(r.choice([3, 6, 12])))) for i in range(8)]
    texts = ["\n".join(" ".join(r.choice(w) if r.random() < 0.1 else x for x in r.choice(known)[1].split()) for _ in range(3)) for _ in range(40)]
    grams = lambda t: {(a, b) for a, b in zip(t.split(), t.split()[1:])}
    want = {}
    for d, t in enumerate(texts):
        for s in [*t.split("\n"), t.replace("\n", " ")]:
            scored = [(2 * len(grams(s) & grams(x)) / (len(grams(s)) + len(grams(x))), k) for k, x in known if grams(x) and grams(s)]
            best = max((x for x, _ in scored), default=0)
            if best >= 0.8:
                k = min(k for x, k in scored if x == best)
                old = want.get((d, k), (0, 0))
                want[d, k] = (max(old[0], best), old[1] + 1)
    got = {(x.doc_id, x.licence): (x.dice, x.n_segments) for x in scan_licences(spark, docs_of(spark, texts), known).collect()}
    assert got == want


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {x.doc_id: x.text for x in docs.collect()}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        assert 0 < docs.count() <= before
    rows = docs.collect()
    assert len({x.doc_id for x in rows}) == len(rows)
    for x in rows:  # what is left of a text are lines of it, in order
        it = iter(texts[x.doc_id].split("\n"))
        assert all(line in it for line in x.text.split("\n")) and x.n_chars == len(x.text)


def test_near_duplicates_by_row(spark):
    """A text goes only with its own group, also where ids repeat or are missing."""
    import corpus_pipeline as p

    r = random.Random(3)
    text, other = (" ".join(f"w{r.randrange(900)}" for _ in range(80)) for _ in range(2))
    near = text.rsplit(" ", 1)[0] + " x"
    rows = [(1, text), (2, near), (2, other), (3, other), (3, other), (None, text), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, ""), (4, None), (5, "lone words of its own kind")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = Counter((x.doc_id, x.text) for x in p.near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(1, text), (2, other), (None, "a b c d e f g"), (4, ""), (4, None), (5, "lone words of its own kind")])


def test_pipeline_stages_odd(spark):
    import corpus_pipeline

    for _, step in corpus_pipeline.STAGES:
        out = step(spark, odd_docs(spark), SF)
        assert len(out.collect()) > 0 and set(odd_docs(spark).columns) <= set(out.columns)
        assert step(spark, empty_docs(spark), SF).count() == 0
