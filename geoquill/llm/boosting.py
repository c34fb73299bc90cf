"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are byte-class shares and word repetition, taken in one pass. Training bins each statistic into
quantile histograms and grows depth-limited trees by Newton gain; a fitted forest is flat arrays, and scoring walks all
rows of a batch down all trees with numpy, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import held_out, labelled_sample, small_batches

#: Most labelled rows that a forest is fitted on; scoring and everything else covers all rows.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 48, 0.15, 2.0
THRESHOLD = 0.3

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10, 13),
    "high": range(128, 256), "stop": (46,), "comma": (44,), "bang": (33, 63), "bar": (124,), "mark": (35, 36, 37, 38, 42, 64, 94, 126),
    "bracket": (40, 41, 60, 62, 91, 93, 123, 125), "dash": (45, 95, 43, 61), "slash": (47, 92, 58, 59), "quote": (34, 39, 96),
}
NAMES = [*_CLASSES, "log_bytes", "words", "unique_words", "word_bytes", "pairs", "line_bytes", "unique_lines", "long_words", "top_byte", "top_word", "tail"]
_SELECT = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _SELECT[list(_bytes), _k] = 1


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of statistics per text; empty and null texts give zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    hist = np.zeros((len(texts), 256))
    for r, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        hist[r] = np.bincount(raw, minlength=256)
        words, lines = text.split(), text.split("\n")
        n, m = len(words), len(lines)
        if n:
            kinds: dict[str, int] = {}
            for w in words:
                kinds[w] = kinds.get(w, 0) + 1
            pairs = len(set(zip(words, words[1:], strict=False)))
            out[r, -10:] = (
                np.log1p(n), len(kinds) / n, len(raw) / n, pairs / max(1, n - 1), np.log1p(len(raw) / m), len(set(lines)) / m,
                sum(len(w) > 20 for w in kinds) / len(kinds), hist[r].max() / len(raw), max(kinds.values()) / n, text[-1] in ".!?",
            )
        out[r, len(_CLASSES)] = np.log1p(len(raw))
    out[:, : len(_CLASSES)] = hist @ _SELECT / np.maximum(hist.sum(1, keepdims=True), 1)
    return out


@dataclass
class Forest:
    """Flat trees: node k of tree t has children 2k+1 and 2k+2; a leaf sends everything left with feature 0."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; left where value <= cut
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            raw += v[at - (len(v) - 1)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees for logistic loss. Without rows, or with one class, the forest is the smoothed base rate."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    n, d = binned.shape
    raw, trees = np.full(n, base), []
    flat = binned + np.arange(d) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = (at - first)[:, None] * (d * BINS) + flat
            hg = np.bincount(slot.ravel(), np.repeat(g, d), width * d * BINS).reshape(width, d, BINS).cumsum(2)
            hh = np.bincount(slot.ravel(), np.repeat(h, d), width * d * BINS).reshape(width, d, BINS).cumsum(2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + L2) + (tg - hg) ** 2 / (th - hh + L2) - tg**2 / (th + L2)
            gain[(hh < 1e-3) | (th - hh < 1e-3)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best):
                j, s = divmod(int(b), BINS)
                if gain[k, j, s] > 1e-6 and s < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][s]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += value[leaf]
        trees.append((feature, cut, value))
    f, c, v = (np.stack(t) for t in zip(*trees, strict=True))
    return Forest(f, c, v, base)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Forest:
    """Fit on at most about ``most`` labelled rows outside the held-out fifth; only their statistics reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = statistics(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "s": list(s)})

    sample = labelled_sample(spark, docs, labels, label, most)
    rows = sample.mapInPandas(stats, "doc_id long, y int, s array<double>").toPandas().sort_values("doc_id")
    if not len(rows):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.stack(rows["s"].tolist()), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with score and predicted; columns of these names are replaced.

    Null and empty texts have statistics of zero and get the score of those. Rows are scored one by one, so repeated
    rows get equal scores and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = forest.score(statistics(b.column("text").to_pylist()))
            b = b.append_column("score", pa.array(s, pa.float64()))
            yield b.append_column("predicted", pa.array((s >= threshold).astype(np.int32), pa.int32()))

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{fields}, score double, predicted int")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a forest fitted on rows outside the held-out fifth.

    Null and empty texts get the score of statistics of zero, repeated rows equal scores; a null id counts as held out
    and is kept; an empty table gives an empty result, empty labels the base rate. Other columns are ignored.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    scored = score_quality(docs, train_quality(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
    return scored
