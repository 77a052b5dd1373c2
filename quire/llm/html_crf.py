"""Main text of web pages by a linear-chain conditional random field.

A page becomes its leaf blocks in order. Each block has features of its
ancestors (tags; words of class, id and role) and of its text (length, share of
linked characters, punctuation); a chain of two labels, furniture and article,
is scored by feature weights and label transitions and decoded by Viterbi.
The weights are trained by maximum likelihood on labelled pages.

Defined results: null or empty html has empty text; a page with no article
block has empty text; repeated rows are treated alike; null ids and urls come
back as they are; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .html_blocks import Block, Element, blocks
from .html_pages import MARK, labelled_pages
from .staging import prepare

PAGES, SEED = 700, 7
STEPS, RATE, PENALTY = 150, 0.2, 2e-5


def path_features(path: tuple[Element, ...]) -> list[str]:
    tags = {e.tag for e in path}
    out = [f"tag={t}" for t in sorted(tags)]
    out += [f"name={w}" for w in sorted({w for e in path for w in e.words})]
    leaf = path[-1] if path else Element("none", ())
    out.append(f"leaf={leaf.tag}")
    out.append(f"leaves={path[-2].tag if len(path) > 1 else 'none'}/{leaf.tag}")
    out += [f"own={w}" for w in leaf.words]
    # The nearest ancestor that says what it is: sections inside an article may be no part of it.
    for e in reversed(path):
        if e.words or e.tag in ("article", "main", "nav", "aside", "footer", "header", "form", "section"):
            out.append(f"near={e.tag}")
            out += [f"nearest={w}" for w in e.words]
            break
    return out


def text_features(text: str, linked: int) -> list[str]:
    n, w = len(text), text.count(" ") + 1
    return [
        f"chars={min(n.bit_length(), 11)}",
        f"words={min(w.bit_length(), 8)}",
        f"links={round(4 * linked / max(n, 1))}",
        f"end={text[-1] in '.!?:\"”»…'}",
        f"sign={'©' in text or text[:9].lower() == 'copyright'}",
    ]


class Crf:
    """index: feature -> row of weights; weights: score of each label; step: of each pair of labels; first: of the first label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.index, self.step, self.first = index, step.tolist(), first.tolist()
        self.margin = (weights[:, 1] - weights[:, 0]).tolist()
        self._paths: dict = {}

    def _sum(self, features: list[str]) -> float:
        return sum(self.margin[k] for k in map(self.index.get, features) if k is not None)

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        s, back = None, []
        step = self.step
        for path, text, linked in page:
            if (x := self._paths.get(path)) is None:
                if len(self._paths) > 20_000:
                    self._paths.clear()
                x = self._paths[path] = self._sum(path_features(path))
            x += self._sum(text_features(text, linked))
            if s is None:
                s = (self.first[0], self.first[1] + x)
                continue
            a0, b0, a1, b1 = s[0] + step[0][0], s[1] + step[1][0], s[0] + step[0][1], s[1] + step[1][1]
            back.append((b0 > a0, b1 > a1))
            s = (max(a0, b0), max(a1, b1) + x)
        if s is None:
            return []
        label = int(s[1] > s[0])
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, label in zip(found, self.decode(found)) if label)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Crf:
    """Maximise the labels' log-likelihood (forward-backward over all pages at once, Adam steps)."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    feature, row, n = [], [], 0
    size, length = len(pages), max(len(p[0]) for p in pages)
    places, gold = [], np.full((size, length), -1)
    for i, (found, labels) in enumerate(pages):
        for t, (b, y) in enumerate(zip(found, labels)):
            for f in path_features(b.path) + text_features(b.text, b.linked):
                feature.append(index.setdefault(f, len(index)))
                row.append(n)
            places.append(i * length + t)
            gold[i, t] = y
            n += 1
    feature, row, at = np.array(feature), np.array(row), np.array(places)
    real = gold >= 0
    both = real[:, 1:]
    w = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    gold_first = np.bincount(gold[:, 0], minlength=2)
    for k in range(1, steps + 1):
        scores = np.stack([np.bincount(row, weights=w[0][feature, y], minlength=n) for y in (0, 1)], 1)
        e = np.zeros((size * length, 2))
        e[at] = scores
        e = e.reshape(size, length, 2)
        forward, backward = np.zeros((size, length, 2)), np.zeros((size, length, 2))
        forward[:, 0] = w[2] + e[:, 0]
        for t in range(1, length):
            nxt = _log_sum(forward[:, t - 1, :, None] + w[1], 1) + e[:, t]
            forward[:, t] = np.where(real[:, t, None], nxt, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = _log_sum(w[1] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], nxt, 0)
        total = _log_sum(forward[:, -1], 1)
        p = np.exp(forward + backward - total[:, None, None]).reshape(-1, 2)[at]
        pair = forward[:, :-1, :, None] + w[1] + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.where(both[:, :, None, None], np.exp(pair), 0).sum((0, 1))
        d = p.copy()
        d[np.arange(n), gold.ravel()[at]] -= 1
        grads = [
            np.stack([np.bincount(feature, weights=d[row, y], minlength=len(index)) for y in (0, 1)], 1) / n + penalty * w[0],
            (pair - gold_pairs) / n + penalty * w[1],
            (np.exp(forward[:, 0] + backward[:, 0] - total[:, None]).sum(0) - gold_first) / n + penalty * w[2],
        ]
        for j, g in enumerate(grads):
            m[j] += 0.1 * (g - m[j])
            v[j] += 0.001 * (g * g - v[j])
            w[j] = w[j] - rate * (1 - k / (steps + 1)) * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.999**k)) + 1e-9)
    return Crf(index, *w)


def labelled(pages: list[str]) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of pages whose article text holds MARK."""
    out = []
    for page in pages:
        found = blocks(page)
        out.append(([b._replace(text=b.text.replace(MARK, "")) for b in found], [int(MARK in b.text) for b in found]))
    return [([b for b in f if b.text], [y for b, y in zip(f, labels) if b.text]) for f, labels in out]


@lru_cache(maxsize=1)
def trained() -> Crf:
    return train(labelled(labelled_pages(PAGES, SEED)))


def extract(spark: SparkSession, pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    prepare(spark)
    crf = model or trained()
    crf._paths.clear()

    def run(batches):
        for batch in batches:
            texts = [crf.text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
