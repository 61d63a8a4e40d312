"""Subject areas of documents from few labels.

Words (also those inside identifiers) are hashed into a fixed number of cells and stored once as
sparse counts. Complement naive Bayes weighs a word for a subject by how rare it is in all other
subjects. Expectation-maximization then lets every unlabelled document count for its subjects by
its posteriors and estimates the weights anew, over the whole corpus each time. Posteriors of the
subjects are independent of each other: each subject has its own logistic calibration, drawn
towards a common one where its labels are few.

Calibration and deciding posterior are fitted out of fold: a labelled document is scored by weights
from which its own counts are taken away again, exactly, since the counts are sums over documents.

What a document deals with shows in the share of its telling words, so that a passing remark or a
licence header in a longer file stays below a subject's threshold. A word tells of a subject by its
posterior among the subjects and a word that tells of none; how sharp that posterior is and how much
a word must weigh is chosen on the labelled documents, by the loss of the calibrated posteriors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stored

CELLS = 1 << 18
ITERATIONS = 4
#: Labelled documents that the calibration is fitted on at most (all other estimates use all rows).
CALIBRATION_DOCS = 20_000
SMOOTHING = 0.1
#: Documents that a word must occur in for its weight to be estimated.
MIN_DOCS = 3
#: Candidates for how sharply a word's weight tells of a subject, and for the weight of a word that tells of none.
SHAPES = tuple((steepness, level) for steepness in (1.0, 2.0, 3.0) for level in (0.5, 1.0, 1.5))
RIDGE_COMMON, RIDGE_OWN = 1e-2, 1.0
#: Posteriors that may decide; the one with the best F1 on the labelled documents does.
THRESHOLDS = tuple(i / 20 for i in range(4, 17))

_WORD = re.compile(r"[A-Z]+(?![^\W\d_A-Z])|[A-Z]?[^\W\d_A-Z]+")


def words(text: str) -> list[str]:
    """Lower-case words of at least two letters; identifiers fall apart at case changes, digits and underscores."""
    return [w.lower() for w in _WORD.findall(text) if len(w) > 1]


def word_cells(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cells, counts): the hashed words of each whole text; empty lists for null and wordless ones."""
    source = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            cells, counts, borders = [], [], [0]
            for t in batch.column(1).to_pylist():
                for word, n in Counter(words(t or "")).items():
                    cell = known.get(word)
                    if cell is None:
                        if len(known) > CELLS:
                            known.clear()
                        cell = known[word] = zlib.crc32(word.encode()) % CELLS
                    cells.append(cell)
                    counts.append(n)
                borders.append(len(cells))
            lists = [pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, pa.int32())) for values in (cells, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "cells", "counts"])

    return source.mapInArrow(run, f"doc_id {source.schema[doc_id].dataType.simpleString()}, cells array<int>, counts array<int>")


def label_masks(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, mask): the labelled subjects of each document as bits; repeats count once, unknown subjects not at all."""
    numbers = F.create_map(*(x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(1 << i).cast("bigint"))))
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.bit_or(F.try_element_at(numbers, F.col("subject"))), F.lit(0)).alias("mask"))


class Model:
    """Word counts outside each subject, the weights they give, and the calibration of the evidence."""

    def __init__(self, n_subjects: int):
        self.subjects = n_subjects
        self.rest = np.zeros((n_subjects, CELLS), np.float32)
        self.size = np.ones(n_subjects)
        self.docs = np.zeros(CELLS, np.float32)
        self.shape: tuple[float, float] | None = None
        self.centre = self.scale = self.factors = None
        self.threshold = 0.5
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def weigh(self, cells: np.ndarray, sums: np.ndarray, doc_counts: np.ndarray, totals: np.ndarray) -> None:
        """Take over word counts per subject, over all, and the number of documents of each cell."""
        self.rest[:], self.docs[:], self._tables = 0, 0, None
        self.docs[cells] = doc_counts
        self.rest[:, cells] = np.maximum(totals[None] - sums, 0) * (doc_counts >= MIN_DOCS)
        self.size = self.rest.sum(axis=1, dtype=float) + SMOOTHING * (doc_counts >= MIN_DOCS).sum()

    def _weights(self, rest: np.ndarray, size: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Complement weights: how rare a word is outside each subject, against the mean over the subjects."""
        weights = np.log(size) - np.log(rest + SMOOTHING)
        return ((weights - weights.mean(axis=0)) * known).astype(np.float32)

    @staticmethod
    def _telling(weights: np.ndarray, known: np.ndarray, shape: tuple[float, float]) -> np.ndarray:
        """A word's posterior of each subject, against a word of the level weight that tells of none."""
        lift = np.exp(shape[0] * (weights - shape[1]))
        return lift / (1 + lift.sum(axis=0)) * known

    def evidence(self, cells: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Per document and subject: log odds and share of its telling words, their amount, mean weight, and telling words per word."""
        if self._tables is None:
            known = self.docs >= MIN_DOCS
            weights = self._weights(self.rest, self.size[:, None], known)
            self._tables = weights, self._telling(weights, known, self.shape).astype(np.float32)
        weights, telling = self._tables
        return _evidence(weights[:, cells], telling[:, cells], counts, borders)

    def evidence_out_of_fold(self, cells: np.ndarray, counts: np.ndarray, borders: np.ndarray, truth: np.ndarray, shapes: list[tuple[float, float]]) -> list[np.ndarray]:
        """``evidence`` of labelled documents under each shape, by weights without the document's own counts."""
        row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        known = self.docs[cells] > MIN_DOCS
        own = (1 - truth)[row].T * np.log1p(counts) * known
        size = self.size[:, None] - _row_sums(own, borders)
        weights = self._weights(np.maximum(self.rest[:, cells] - own, 0), np.maximum(size, SMOOTHING)[:, row], known)
        return [_evidence(weights, self._telling(weights, known, shape), counts, borders) for shape in shapes]

    def calibrate(self, evidence: np.ndarray, truth: np.ndarray) -> float:
        """Logistic factors per subject from labelled documents: evidence (docs, subjects, features), truth (docs, subjects); returns the mean log loss."""
        flat = evidence.reshape(-1, evidence.shape[2])
        self.centre, self.scale = flat.mean(axis=0), flat.std(axis=0) + 1e-9
        x = (evidence - self.centre) / self.scale
        common = _logistic(x.reshape(flat.shape), truth.ravel(), np.zeros(flat.shape[1] + 1), RIDGE_COMMON)
        self.factors = np.stack([_logistic(x[:, s], truth[:, s], common, RIDGE_OWN) for s in range(self.subjects)])
        p, real = self.posteriors(evidence), truth > 0
        f1 = [2 * (real & (p > t)).sum() / max(1, real.sum() + (p > t).sum()) for t in THRESHOLDS]
        self.threshold = max(zip(f1, THRESHOLDS, strict=True), key=lambda x: (round(float(x[0]), 4), -abs(x[1] - 0.5)))[1]
        return float(-np.log(np.clip(np.where(real, p, 1 - p), 1e-12, 1)).mean())

    def posteriors(self, evidence: np.ndarray) -> np.ndarray:
        x = (evidence - self.centre) / self.scale
        score = np.einsum("dsf,sf->ds", x, self.factors[:, :-1]) + self.factors[:, -1]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _evidence(weights: np.ndarray, telling: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> np.ndarray:
    amount = _row_sums(telling * counts, borders)
    size = np.maximum(_row_sums(counts[None].astype(np.float32), borders), 1)
    mean = _row_sums(weights * counts, borders) / size
    total = amount.sum(axis=0)
    odds = np.log((amount + 0.5) / (total - amount + 0.5))
    density = np.broadcast_to(total / size[0], amount.shape)
    return np.stack([odds, amount / np.maximum(total, 1e-9), np.log1p(amount), mean, density], axis=2).transpose(1, 0, 2)


def _row_sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of the columns between borders, exactly 0 for empty rows."""
    filled = borders[:-1] < borders[1:]
    out = np.zeros((len(values), len(borders) - 1), values.dtype)
    if filled.any():
        out[:, filled] = np.add.reduceat(values, borders[:-1][filled], axis=1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, towards: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps for logistic factors (the last for the constant), held near ``towards``."""
    x = np.column_stack([x, np.ones(len(x))])
    factors = towards.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ factors, -30, 30)))
        slope = x.T @ (y - p) - ridge * (factors - towards)
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(factors))
        step = np.linalg.solve(bend, slope)
        factors = factors + step
        if np.abs(step).max() < 1e-6:
            break
    return factors


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = batch.column(batch.schema.get_field_index("cells"))
    counts = batch.column(batch.schema.get_field_index("counts"))
    borders = cells.offsets.to_numpy() - cells.offsets[0].as_py()
    return cells.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float32), borders


def _masks(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """(docs, subjects) of 0 and 1, and NaN for documents without labels."""
    mask = batch.column(batch.schema.get_field_index("mask"))
    bits = (mask.fill_null(0).to_numpy(zero_copy_only=False)[:, None] >> np.arange(n)) & 1
    return np.where(mask.is_valid().to_numpy(zero_copy_only=False)[:, None], bits, np.nan)


def _count_words(features: DataFrame, model: Model, labelled_only: bool) -> tuple[np.ndarray, ...]:
    """One pass over the corpus: (cells, sums per subject, documents, totals), at most CELLS columns."""
    n = model.subjects
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n + 2, CELLS))
        for batch in batches:
            cells, counts, borders = _arrays(batch)
            weight = _masks(batch, n)
            if not labelled_only:
                unknown = np.isnan(weight[:, 0])
                weight = np.where(unknown[:, None], shared.value.posteriors(shared.value.evidence(cells, counts, borders)), weight)
            row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
            value = np.log1p(counts)
            for s in range(n):
                sums[s] += np.bincount(cells, value * weight[row, s], CELLS)
            sums[n] += np.bincount(cells, None, CELLS)
            sums[n + 1] += np.bincount(cells, value, CELLS)
        seen = np.flatnonzero(sums[n])
        columns = {"cell": seen.astype(np.int32), **{f"s{s}": sums[s, seen].astype(np.float32) for s in range(n + 2)}}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    schema = ", ".join(["cell int", *(f"s{s} float" for s in range(n + 2))])
    rows = features.filter("mask is not null") if labelled_only else features
    sums = rows.mapInArrow(run, schema).groupBy("cell").agg(*(F.sum(f"s{s}").cast("float").alias(f"s{s}") for s in range(n + 2)))
    got = sums.filter(F.col(f"s{n}") >= MIN_DOCS).toPandas()
    shared.destroy()
    table = got.drop(columns="cell").to_numpy(np.float64).T
    return got["cell"].to_numpy(), table[:n], table[n], table[n + 1]


def _evidence_of(labelled: DataFrame, model: Model, shape: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-fold evidence and labels of the documents of ``labelled``, at most CALIBRATION_DOCS."""
    n = model.subjects
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (evidence,) = shared.value.evidence_out_of_fold(*_arrays(batch), _masks(batch, n), [shape])
            rows = evidence.reshape(batch.num_rows, -1).astype(np.float32)
            borders = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("mask")), pa.ListArray.from_arrays(borders, pa.array(rows.ravel()))], names=["mask", "evidence"])

    got = labelled.mapInArrow(run, "mask bigint, evidence array<float>").toPandas()
    shared.destroy()
    if got.empty:
        raise ValueError("no document has a label")
    truth = ((got["mask"].to_numpy()[:, None] >> np.arange(n)) & 1).astype(float)
    return np.stack(got["evidence"].to_list()).astype(float).reshape(len(got), n, -1), truth


def _calibrate(labelled: DataFrame, model: Model) -> None:
    """Fit the calibration out of fold; the first time also choose the shape by the loss."""
    if model.shape is None:
        losses = [model.calibrate(*_evidence_of(labelled, model, shape)) for shape in SHAPES]
        model.shape = SHAPES[int(np.argmin(losses))]
    model.calibrate(*_evidence_of(labelled, model, model.shape))


def train(features: DataFrame, n_subjects: int, iterations: int = ITERATIONS) -> Model:
    """Fit on stored ``features`` (doc_id, cells, counts, mask; null masks are unlabelled documents)."""
    model = Model(n_subjects)
    labelled = stored(features.filter("mask is not null").orderBy(F.xxhash64("doc_id")).limit(CALIBRATION_DOCS), "labelled")
    model.weigh(*_count_words(features, model, labelled_only=True))
    _calibrate(labelled, model)
    for _ in range(iterations):
        model.weigh(*_count_words(features, model, labelled_only=False))
        _calibrate(labelled, model)
    return model


def posteriors(features: DataFrame, model: Model, out_of_fold: bool = False) -> DataFrame:
    """(doc_id, mask, posteriors) of every document, null for texts without words; ``out_of_fold`` is for labelled documents."""
    n = model.subjects
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, counts, borders = _arrays(batch)
            known = shared.value
            evidence = known.evidence_out_of_fold(cells, counts, borders, _masks(batch, n), [known.shape])[0] if out_of_fold else known.evidence(cells, counts, borders)
            p = known.posteriors(evidence).astype(float)
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(p.ravel()), mask=pa.array(borders[:-1] == borders[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("mask")), lists], names=["doc_id", "mask", "posteriors"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, mask bigint, posteriors array<double>")


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model, list[str]]:
    """The stored features of every document, the fitted model, and the subjects in the order of bits and posteriors.

    ``subjects`` (subject) is a short list of up to 60 names, ``labels`` has doc_id and subject.
    Labels of unknown documents or subjects count for nothing; without any labelled document a
    ValueError is raised. doc_id is unique.
    """
    names = sorted(r[0] for r in subjects.select("subject").distinct().collect() if r[0] is not None)
    cells = word_cells(docs, doc_id, text)
    features = stored(cells.join(broadcast_if_small(label_masks(labels, names)), "doc_id", "left"), "features")
    return features, train(features, len(names)), names


def subject_posteriors(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str], float]:
    """(doc_id, mask, posteriors) of every document, the subjects in the order of bits and posteriors, and the deciding threshold.

    Inputs as for ``fit``. Texts without words (empty, blank, null) have null posteriors.
    """
    features, model, names = fit(docs, labels, subjects, doc_id, text)
    return posteriors(features, model), names, model.threshold


def reliability(features: DataFrame, model: Model, bins: int = 10) -> DataFrame:
    """bin, n_pairs, mean_posterior, share_labelled: out-of-fold posteriors of the labelled documents beside their labels."""
    scored = posteriors(features.filter("mask is not null"), model, out_of_fold=True).filter("posteriors is not null")
    pairs = scored.select("mask", F.posexplode("posteriors").alias("at", "p"))
    labelled = F.expr("shiftright(mask, at) & 1")
    binned = pairs.select(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "p", labelled.cast("double").alias("label"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("p").alias("mean_posterior"), F.avg("label").alias("share_labelled"))


def assign(scored: DataFrame, subjects: list[str], threshold: float) -> DataFrame:
    """(doc_id, subject, posterior) of every subject whose posterior passes ``threshold``."""
    pairs = F.arrays_zip(F.array(*map(F.lit, subjects)).alias("subject"), F.col("posteriors").alias("posterior"))
    return scored.filter("posteriors is not null").select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.subject", "x.posterior").filter(F.col("posterior") > threshold)
