"""Severity of toxic language: cumulative-link ordinal regression on sparse text features.

``P(grade <= k) = s(cut_k - w.x)``: one weight per feature, shared by all thresholds, and ordered cuts. A
document's expected severity is the sum of its chances to exceed each cut. Features are words and word
beginnings, counted in whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from doclake.llm.common import keyed_sample
from doclake.llm.quality import held_out

#: Labelled documents that are learned from, at most; chosen by a hash of the id.
SAMPLE = 9_000
#: Features that go into the first count, and those that get a weight.
CANDIDATES, FEATURES = 20_000, 1_500
#: A feature needs so many deviations more or fewer toxic documents than chance gives it.
LEAST_STRENGTH = 3.0
GRADES = 4
BEGINNINGS = (4, 5, 6, 7)
REJECT_FROM = 0.5

_words = re.compile(r"[^\W\d_]+").findall
_SLICE = 1 << 20


def words(text: str | None) -> Iterator[list[str]]:
    """Lower-case words of a text in parts; a word is not cut."""
    text = text or ""
    start = 0
    while start < len(text):
        end = min(start + _SLICE, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _words(text[start:end].lower())
        start = end


def features_of(word: str) -> list[str]:
    """A word and its beginnings, told apart by a mark."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Counted:
    """Counts of known features in a text; each word is looked up in its parts once per worker."""

    def __init__(self, numbers: dict[str, int], entries: int = 500_000):
        self._numbers, self._entries = numbers, entries
        self._held: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        total: Counter = Counter()
        for some in words(text):
            for word, n in Counter(some).items():
                known = self._held.get(word)
                if known is None:
                    if len(self._held) >= self._entries:
                        self._held.clear()
                    numbers = self._numbers
                    known = self._held[word] = tuple(numbers[f] for f in features_of(word) if f in numbers)
                for number in known:
                    total[number] += n
        if not total:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        at = np.fromiter(total.keys(), np.int32, len(total))
        return at, np.log1p(np.fromiter(total.values(), np.float32, len(total)))


@dataclass
class Severity:
    """A fitted model: numbers of the features, their weights, and the ordered cuts."""

    numbers: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, margin: np.ndarray) -> np.ndarray:
        """Chances to exceed each cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - margin[:, None], -60, 60)))


class Sparse:
    """A matrix of ``n`` rows and ``m`` columns by its entries, held by rows and by columns."""

    def __init__(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, m: int):
        self._sides = [self._side(row, at, value, n), self._side(at, row, value, m)]

    @staticmethod
    def _side(line: np.ndarray, other: np.ndarray, value: np.ndarray, lines: int):
        order = np.argsort(line, kind="stable")
        there, starts = np.unique(line[order], return_index=True)
        return lines, there, starts, other[order], value[order].astype(float)

    def _product(self, side: int, vector: np.ndarray) -> np.ndarray:
        lines, there, starts, other, value = self._sides[side]
        out = np.zeros(lines)
        if len(there):
            out[there] = np.add.reduceat(value * vector[other], starts)
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self._product(0, weights)

    def transposed_times(self, slopes: np.ndarray) -> np.ndarray:
        return self._product(1, slopes)


def fit(rows: Sparse, m: int, grades: np.ndarray, n_grades: int, rounds: int = 300, penalty: float = 2e-5):
    """Weights and cuts by gradient steps with momentum on the mean log likelihood.

    The first cut is free; the others follow it at distances that are exponentials, and so stay ordered.
    """
    n = len(grades)
    theta = np.zeros(m + n_grades - 1)
    theta[m] = 2.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, slope = likelihood(theta, rows, m, grades, n_grades, penalty)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:m], _cuts(theta[m:])


def _cuts(tail: np.ndarray) -> np.ndarray:
    return tail[0] + np.r_[0.0, np.cumsum(np.exp(tail[1:]))]


def likelihood(theta: np.ndarray, rows: Sparse, m: int, grades: np.ndarray, n_grades: int, penalty: float):
    """The penalised mean log likelihood at ``theta`` (weights, first cut, logarithms of the gaps) and its slope."""
    n = len(grades)
    weights, cuts = theta[:m], _cuts(theta[m:])
    exceed = 1 / (1 + np.exp(np.clip(cuts[None, :] - rows.times(weights)[:, None], -60, 60)))
    # chance of a grade: exceed[k - 1] - exceed[k], with 1 before the first and 0 after the last
    bounds = np.hstack([np.ones((n, 1)), exceed, np.zeros((n, 1))])
    every = np.arange(n)
    chance = np.maximum(bounds[every, grades] - bounds[every, grades + 1], 1e-12)
    bend = np.hstack([np.zeros((n, 1)), exceed * (1 - exceed), np.zeros((n, 1))])
    by_margin = (bend[every, grades] - bend[every, grades + 1]) / chance
    by_cut = np.zeros((n, n_grades - 1))
    upper = grades < n_grades - 1
    by_cut[every[upper], grades[upper]] += bend[every, grades + 1][upper] / chance[upper]
    lower = grades > 0
    by_cut[every[lower], grades[lower] - 1] -= bend[every, grades][lower] / chance[lower]
    cut_slopes = by_cut.sum(0) / n
    slope = np.empty_like(theta)
    slope[:m] = rows.transposed_times(by_margin) / n - penalty * weights
    slope[m] = cut_slopes.sum()
    slope[m + 1 :] = [cut_slopes[k + 1 :].sum() * np.exp(theta[m + 1 + k]) for k in range(n_grades - 2)]
    return np.log(chance).mean() - penalty / 2 * weights @ weights, slope


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_grades: int = GRADES) -> Severity:
    """A model of ``labels(doc_id, toxic)``, fitted on at most about ``sample`` documents not held out.

    The values of ``toxic`` are the grades, larger ones than ``n_grades - 1`` being that. Labels of 0 and 1 leave
    one cut: severity is then the chance to be toxic. The sample's ids are broadcast; its texts stay on the
    executors, and features and counts of bounded number come back: one row for each id, the smallest of
    repeated rows and of rows with one id. Null labels and labels without a document are left out; of contradicting labels the larger
    counts. Without both kinds of labels every document has severity near zero.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = keyed_sample(usable.select(F.col("doc_id").cast("long"), "toxic"), "doc_id", sample)
    known = F.broadcast(known.groupBy("doc_id").agg(F.max("toxic").alias("_grade")))
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id").select("_grade", "text", "doc_id")

    def appear(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1):
                distinct = {w for some in words(text.as_py()) for w in some}
                seen.update({f for w in distinct for f in features_of(w)})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"]
        )

    counts = chosen.where("_grade > 0").mapInArrow(appear, "feature string, n long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n")).where("n > 1")
    common = counts.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()
    numbers = {row.feature: i for i, row in enumerate(common)}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counted = Counted(numbers)
        for batch in batches:
            found = [counted(text.as_py()) for text in batch.column(1)]
            columns = [
                batch.column(2),
                batch.column(0).cast(pa.int32()),
                pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "grade", "at", "value"])

    found = chosen.mapInArrow(count, "id long, grade int, at array<int>, value array<float>")
    found = found.groupBy("id").agg(F.min(F.struct("grade", "at", "value")).alias("one")).select("one.*").toArrow()
    grade = found.column("grade").to_numpy()
    sizes = np.array([len(a) for a in found.column("at")], np.int64)
    row = np.repeat(np.arange(len(grade)), sizes)
    at = found.column("at").combine_chunks().flatten().to_numpy()
    value = found.column("value").combine_chunks().flatten().to_numpy()
    return _fit_sparse(numbers, grade, row, at, value, n_grades)


def _fit_sparse(numbers, grade, row, at, value, n_grades) -> Severity:
    toxic = grade > 0
    n_grades = min(n_grades, int(grade.max(initial=1)) + 1)
    if not toxic.any() or toxic.all():
        share = 20.0 if not toxic.any() else -20.0
        return Severity({}, np.zeros(0), share + np.arange(n_grades - 1.0))
    m = len(numbers)
    yes = np.bincount(at, toxic[row], m)
    both = np.bincount(at, minlength=m)
    n, n_yes = len(grade), int(toxic.sum())
    expected = both * n_yes / n
    # features that are present more often than by chance, in units of the deviation
    strength = (yes - expected) / np.sqrt(expected * (1 - both / n) * (1 - n_yes / n) + 1e-9)
    strength = np.where(both < n, np.abs(strength), 0)
    kept = np.argsort(-strength, kind="stable")[:FEATURES]
    kept = kept[strength[kept] >= LEAST_STRENGTH]
    place = np.full(m, -1)
    place[kept] = np.arange(len(kept))
    inside = place[at] >= 0
    rows = Sparse(row[inside], place[at[inside]], value[inside], n, len(kept))
    weights, cuts = fit(rows, len(kept), np.minimum(grade, n_grades - 1).astype(np.int64), n_grades)
    names = list(numbers)
    return Severity({names[k]: i for i, k in enumerate(kept.tolist())}, weights, cuts)


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """``doc_id``, ``held_out``, ``severity`` (expected grade), ``p_toxic`` (chance of any grade above 0) and
    ``grade`` (the likeliest) of every row, repeated rows and rows without an id included. A null or empty
    text has no features. Other columns are no input."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counted = Counted(model.numbers)
        for batch in batches:
            margin = []
            for text in batch.column(1):
                at, value = counted(text.as_py())
                margin.append(float(model.weights[at] @ value) if len(at) else 0.0)
            exceed = model.exceed(np.array(margin, float))
            bounds = np.hstack([np.ones((len(margin), 1)), exceed, np.zeros((len(margin), 1))])
            likeliest = (bounds[:, :-1] - bounds[:, 1:]).argmax(1) if len(margin) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(exceed.sum(1), pa.float64()),
                    pa.array(exceed[:, 0], pa.float64()),
                    pa.array(likeliest.astype(np.int32), pa.int32()),
                ],
                names=["doc_id", "held_out", "severity", "p_toxic", "grade"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return read.mapInArrow(run, "doc_id long, held_out boolean, severity double, p_toxic double, grade int")


def drop_toxic(docs: DataFrame, model: Severity, reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs`` whose chance to be toxic is below ``reject_from``, columns unchanged and of any names.

    Null and empty texts have no features and are judged by the first cut alone; repeated rows and rows without
    id are judged each by its text; an empty table stays empty.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counted = Counted(model.numbers)
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("text")):
                at, value = counted(text.as_py())
                margin = np.array([float(model.weights[at] @ value) if len(at) else 0.0])
                keep.append(bool(model.exceed(margin)[0, 0] < reject_from))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
