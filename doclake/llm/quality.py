"""Quality of documents: histogram gradient-boosted trees over statistics of the text.

Trees are grown on binned statistics, one histogram of gradients per node, and laid out as complete trees in
flat arrays; scoring walks all trees of a batch of documents level by level in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import keyed_sample
from doclake.llm.pieces import slices

#: Labelled documents that the trees are fitted on, at most; chosen by a hash of the id.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, PENALTY, LEAST_WEIGHT = 80, 4, 64, 0.15, 1.0, 4.0

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".!?",
    "mark": b",;:'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "bang": b"!",
    "bar": b"|",
}
STATISTICS = [
    *(f"share_{name}" for name in _CLASSES),
    "share_other",
    "entropy",
    "log_bytes",
    "log_words",
    "mean_word",
    "long_words",
    "short_words",
    "distinct_words",
    "top_word",
    "repeated_next",
    "mean_line",
    "distinct_lines",
    "words_with_symbols",
]
_SYMBOLS = _CLASSES["symbol"]


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all zero where there is nothing to count."""
    data = (text or "").encode("utf-8", "replace")
    size = len(data)
    if not size:
        return [0.0] * len(STATISTICS)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [float(bytes_[list(some)].sum()) / size for some in _CLASSES.values()]
    likely = bytes_[bytes_ > 0] / size
    words: Counter = Counter()
    n = repeated = 0
    last = None
    for some in slices(text):
        words.update(some)
        n += len(some)
        repeated += sum(map(eq, some, some[1:])) + (last is not None and some[:1] == [last])
        last = some[-1] if some else last
    lines = data.split(b"\n")
    n = max(n, 1)
    lengths = [(len(w), c) for w, c in words.items()]
    return [
        *shares,
        float(bytes_[128:].sum()) / size,
        float(-(likely * np.log2(likely)).sum()),
        float(np.log1p(size)),
        float(np.log1p(n)),
        sum(k * c for k, c in lengths) / n,
        sum(c for k, c in lengths if k > 15) / n,
        sum(c for k, c in lengths if k < 3) / n,
        len(words) / n,
        max(words.values(), default=0) / n,
        repeated / n,
        size / len(lines),
        len(set(lines)) / len(lines),
        sum(c for w, c in words.items() if len(w.translate(None, _SYMBOLS)) < len(w)) / n,
    ]


# --- trees ---


@dataclass
class Forest:
    """Complete trees: ``feature`` and ``cut`` of the inner nodes and ``value`` of the leaves, tree by tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1. Goes right where a statistic is above the cut."""
        trees = np.arange(len(self.feature))
        total = np.full(len(rows), self.base)
        for begin in range(0, len(rows), 4096):
            some = rows[begin : begin + 4096]
            node = np.zeros((len(some), len(trees)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                above = some[np.arange(len(some))[:, None], self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + above
            total[begin : begin + 4096] += self.value[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def bin_edges(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cuts between bins: quantiles of each statistic."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T]


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosting on the logistic loss with second-order gains."""
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    forest = Forest(float(np.log(share / (1 - share))), feature, cut, value)
    if len(labels) == 0 or labels.min() == labels.max():
        return forest
    edges = bin_edges(rows)
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, rows.T)])
    total = np.full(len(rows), forest.base)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = chance - labels, chance * (1 - chance)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            sums = np.stack([
                np.stack([np.bincount(at * BINS + b, w, count * BINS).reshape(count, BINS) for w in (slope, bend)])
                for b in binned
            ])  # statistic, slope or bend, node, bin
            left = sums.cumsum(3)
            whole = left[..., -1:]
            right = whole - left
            gain = left[:, 0] ** 2 / (left[:, 1] + PENALTY) + right[:, 0] ** 2 / (right[:, 1] + PENALTY)
            gain -= whole[:, 0] ** 2 / (whole[:, 1] + PENALTY)
            gain[(left[:, 1] < LEAST_WEIGHT) | (right[:, 1] < LEAST_WEIGHT)] = 0
            for b, e in enumerate(edges):
                gain[b, :, len(e) :] = 0
            flat = gain.transpose(1, 0, 2).reshape(count, -1)
            best = flat.argmax(1)
            for k in range(count):
                if flat[k, best[k]] > 1e-9:
                    which, bin_ = divmod(int(best[k]), BINS)
                    feature[t, first + k], cut[t, first + k] = which, edges[which][bin_]
            chosen = feature[t, node]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), chosen] > cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        value[t] = -RATE * g / (h + PENALTY)
        total += value[t, leaf]
    return forest


# --- documents ---


def held_out() -> Column:
    """Rows whose labels are never learned; a row without an id is not held out."""
    mark = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return F.coalesce(mark, F.lit(False))


def _measured(docs: DataFrame, keep: list[str], finish, schema: str) -> DataFrame:
    """``finish`` of the kept columns' arrays and the matrix of statistics, batch by batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = np.array([statistics(text.as_py()) for text in batch.column(0)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_pydict(finish(pa, batch, rows))

    return docs.select("text", *keep).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees fitted on at most about ``sample`` labelled documents that are not held out.

    The ids of the sample, bounded by that parameter, are broadcast; one row of numbers for each id comes
    back, the smallest of repeated rows and of rows with one id. Of contradicting labels the larger counts; null labels and labels without a document none.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = keyed_sample(usable.select(F.col("doc_id").cast("long"), "quality"), "doc_id", sample)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_label"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id")

    def finish(pa, batch, rows):
        return {"id": batch.column(1), "label": batch.column(2), "row": pa.array(list(rows), pa.list_(pa.float64()))}

    measured = _measured(rows, ["doc_id", "_label"], finish, "id long, label int, row array<double>")
    found = measured.groupBy("id").agg(F.min(F.struct("label", "row")).alias("one")).select("one.*").toArrow()
    matrix = found.column("row").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    marks = found.column("label").to_numpy().astype(float)
    order = np.lexsort(np.vstack([matrix.T, marks]))
    return fit(matrix[order], marks[order])


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, repeated rows and rows without an
    id included; a null or empty text has statistics of zero. Other columns are no input."""

    def finish(pa, batch, rows):
        scores = forest.scores(rows) if len(rows) else np.zeros(0)
        return {
            "doc_id": batch.column(1),
            "held_out": batch.column(2),
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
        }

    ids = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).withColumn("held_out", held_out())
    return _measured(ids, ["doc_id", "held_out"], finish, "doc_id long, held_out boolean, score double, predicted int")
