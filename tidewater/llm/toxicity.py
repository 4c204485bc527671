"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.chars import Run, runs
from tidewater.llm.shared import written

#: Gradients are summed in so many tasks, each of which sends one vector to the driver.
GRADIENT_TASKS = 8

#: Sums are of whole numbers, in these units: then no partitioning changes them.
_UNIT = 2.0**-44

#: A task unpacks texts until they have so many cells, then works on these; a text has 2^bits at most.
SLICE_CELLS = 1 << 20


@dataclass
class Model:
    """weight: for each hash cell of n-grams, the learned weight times the log-count ratio."""

    weight: np.ndarray
    bias: float
    orders: tuple[int, ...]

    @property
    def bits(self) -> int:
        return len(self.weight).bit_length() - 1


class Present:
    """The distinct cells of each text's n-grams. Each cell is stamped with a place that has it; the last stamp stays."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits, self.stamp = orders, bits, np.zeros(1 << bits, np.int32)

    def of(self, run: Run) -> Iterator[np.ndarray]:
        by_order = [(run.grams(n, seed=n)[0] >> np.uint64(64 - self.bits)).astype(np.int32) for n in self.orders]
        for start, end in zip(run.starts.tolist(), run.ends.tolist(), strict=True):
            cells = np.concatenate([cell[start : max(start, end - n + 1)] for n, cell in zip(self.orders, by_order, strict=True)])
            place = np.arange(len(cells), dtype=np.int32)
            self.stamp[cells] = place
            yield cells[self.stamp[cells] == place]


def _sample(labelled: DataFrame, docs: DataFrame, rows_per_class: int, id_col: str, text_col: str, label_col: str) -> DataFrame | None:
    """(label, text) of about `rows_per_class` rows of each label; None where a label is missing."""
    sizes = {int(r[0]): r[1] for r in labelled.groupBy(label_col).count().collect()}
    if len(sizes) < 2:
        return None
    dice = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col(label_col) == 1, rows_per_class / sizes[1]).otherwise(rows_per_class / sizes[0])
    chosen = labelled.filter(dice < share).groupBy(F.col(id_col).alias("_chosen")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("text is not null")
    return texts.join(F.broadcast(chosen), F.col("_id") == F.col("_chosen")).select("label", "text")


def _listed(sample: DataFrame, orders: tuple[int, ...], bits: int, folds: int) -> DataFrame:
    """(label, fold, cells): each text's cells, sorted and packed, and its fold, chosen by content."""

    def pack(batches):
        import zstandard

        z, present = zstandard.ZstdCompressor(level=1), Present(orders, bits)
        for batch in batches:
            packed, fold = [], []
            for run in runs(batch.column(1).to_pylist()):
                for cells in present.of(run):
                    raw = np.diff(np.sort(cells), prepend=0).astype("<u4").tobytes()
                    packed.append(z.compress(raw))
                    fold.append(zlib.crc32(raw) % folds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold, pa.int32()), pa.array(packed, pa.binary())], ["label", "fold", "cells"])

    return sample.mapInArrow(pack, "label int, fold int, cells binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, all cells, how many of them each text has) of a batch's texts in order, in slices of about SLICE_CELLS cells: a whole batch,
    unpacked, can be hundreds of times as large as it comes."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    labels, packed = batch.column(0).to_numpy(), batch.column(2)
    lists, first, total = [], 0, 0
    for k in range(batch.num_rows):
        lists.append(np.cumsum(np.frombuffer(z.decompress(packed[k].as_py()), "<u4"), dtype=np.int64))
        total += len(lists[-1])
        if total >= SLICE_CELLS or k + 1 == batch.num_rows:
            yield labels[first : k + 1], np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
            lists, first, total = [], k + 1, 0


def _scores(weight: np.ndarray, bias: float, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=weight[cells], minlength=len(sizes)) + bias


def _summed(table: DataFrame, add, shape: int, kind: str) -> np.ndarray:
    """The sum over slices of add(total, labels, cells, sizes), a vector of whole numbers below 2^53 that a task fills for all its batches; in
    GRADIENT_TASKS tasks, which send it as integers of this kind."""

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            for some in _unpacked(batch):
                add(total, *some)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["part"])

    parts = table.coalesce(GRADIENT_TASKS).mapInArrow(partial, "part binary").toArrow()["part"]
    total = np.zeros(shape)
    for part in parts:
        total += np.frombuffer(part.as_py(), kind)
    return total


def _objective(table: DataFrame, scale: np.ndarray, rows: np.ndarray, decay: float):
    """w (cells and, last, the bias) -> (loss, gradient) of the logistic loss over table, both classes with half of the weight."""
    share = 0.5 / np.maximum(rows, 1)
    n = len(scale)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = table.sparkSession.sparkContext.broadcast(((w[:n] * scale).astype(np.float32), float(w[n])))

        def add(total, label, cells, sizes):
            v, b = sent.value
            p = 1 / (1 + np.exp(-np.clip(_scores(v, b, cells, sizes), -35, 35)))
            g = np.rint((p - label) * share[label] / _UNIT)
            total[: len(v)] += np.bincount(cells, weights=np.repeat(g, sizes), minlength=len(v))
            total[len(v)] += g.sum()
            total[len(v) + 1] -= np.rint(share[label] * np.log(np.where(label == 1, p, 1 - p)) / _UNIT).sum()

        total = _summed(table, add, n + 2, "<i8") * _UNIT
        sent.destroy()
        grad = np.append(total[:n] * scale + decay * w[:n], total[n])
        return float(total[n + 1] + 0.5 * decay * (w[:n] ** 2).sum()), grad

    return value


def minimized(value, w: np.ndarray, *, steps: int, history: int = 5, enough: float = 1e-3) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving, until the gradient has shrunk to `enough` of the first."""
    loss, grad = value(w)
    first, past = np.abs(grad).max(), []
    for _ in range(steps):
        if np.abs(grad).max() <= enough * max(first, 1e-12):
            break
        d, used = grad.copy(), []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d -= a * y
            used.append(a)
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(grad), 1e-12)
        for (s, y), a in zip(past, reversed(used), strict=True):
            d += s * (a - y @ d / (s @ y))
        size = 1.0
        while True:
            new = w - size * d
            new_loss, new_grad = value(new)
            if new_loss <= loss - 1e-4 * size * (grad @ d) or size < 1e-3:
                break
            size /= 2
        s, y = (new - w), (new_grad - grad)
        if s @ y > 1e-12:
            past = [*past[-history + 1 :], (s, y)]
        if new_loss > loss:
            break
        w, loss, grad = new, new_loss, new_grad
    return w


def log_count_ratios(counts: np.ndarray, rows: np.ndarray, prior: float) -> np.ndarray:
    """For counts (2 x cells) of texts of each label with a cell: the log of the ratio of its shares among toxic and clean texts.
    Each cell is given `prior` texts more, parted as all texts are; so a cell that is rare says little."""
    of_all = rows[:, None] / rows.sum()
    share = (counts + prior * of_all) / (rows[:, None] + prior * of_all)
    return np.log(share[1] / share[0])


def fit(
    labelled: DataFrame,
    *,
    orders: tuple[int, ...] = (5, 6, 7),
    bits: int = 20,
    rows_per_class: int = 15_000,
    prior: float = 100.0,
    decay: float = 1e-3,
    steps: int = 25,
    folds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    docs: DataFrame,
) -> Model:
    """Learns from labelled (id, label) rows joined with docs (id, text).

    The sample is bounded: about `rows_per_class` rows of each label, those with the smallest hashes of their ids; only those
    ids are broadcast. All n-grams of the sample's whole texts are features: each falls into one of 2^bits hash cells, and a
    cell is present in a text or not, times its log-count ratio. Spark counts the ratios and sums the gradients of a
    logistic regression over the sample, which is written once; a vector of 2^bits numbers is what a task sends and the driver holds.
    The sample has `folds` folds (three or more), and each is scored by a regression over the others. The model is their mean. All these
    scores of texts not learned from say where F1 is best: there the model says 0.5. Sums are exact, so partitions don't matter.

    Rows whose label is not 0 or 1, or whose id or text is null, teach nothing; an id with several labels counts as toxic if
    one of them is. With no row of one label (an empty table too), the model is a constant: sure of the other label. A fold that has
    all texts of a label is scored by no regression.
    """
    if folds < 3:
        raise ValueError("folds must be three or more")
    known = labelled.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sample = _sample(known, docs, rows_per_class, id_col, text_col, label_col)
    constant = Model(np.zeros(1 << bits, np.float32), -4.0, orders)
    if sample is None:
        constant.bias = 4.0 if not known.filter(F.col(label_col) == 1).isEmpty() else -4.0
        return constant
    table = written(_listed(sample, orders, bits, folds), "toxicity")
    weight, bias, fitted, scored = np.zeros(1 << bits), 0.0, 0, []
    for k in range(folds):
        learned = regression(table.filter(f"fold <> {k}"), bits=bits, prior=prior, decay=decay, steps=steps)
        if learned is not None:
            weight, bias, fitted = weight + learned[0], bias + learned[1], fitted + 1
            scored.append(_scored(table.filter(f"fold = {k}"), *learned))
    if not fitted:
        constant.bias = 4.0 if not table.filter("label = 1").isEmpty() else -4.0
        return constant
    label, z = (np.concatenate(x) for x in zip(*scored, strict=True))
    return Model((weight / fitted).astype(np.float32), bias / fitted - _best_middle(label, z), orders)


def regression(table: DataFrame, *, bits: int, prior: float, decay: float, steps: int) -> tuple[np.ndarray, float] | None:
    """(a weight for each cell's presence, bias), learned from a table of labels and cells; None if it lacks a label."""

    def count(total, label, cells, sizes):
        total[: 2 << bits] += np.bincount(np.repeat(label.astype(np.int64), sizes) << bits | cells, minlength=2 << bits)
        total[2 << bits :] += np.bincount(label, minlength=2)

    counts = _summed(table, count, (2 << bits) + 2, "<i4")
    rows = counts[2 << bits :]
    if min(rows) == 0:
        return None
    scale = log_count_ratios(counts[: 2 << bits].reshape(2, -1), rows, prior)
    w = minimized(_objective(table, scale, rows, decay), np.zeros((1 << bits) + 1), steps=steps)
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


def _scored(held: DataFrame, weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, score before the logistic function) of each row of the bounded sample that was held out."""
    sent = held.sparkSession.sparkContext.broadcast((weight, bias))

    def scored(batches):
        v, b = sent.value
        for batch in batches:
            for label, cells, sizes in _unpacked(batch):
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(_scores(v, b, cells, sizes))], ["label", "z"])

    got = held.mapInArrow(scored, "label int, z double").toArrow()
    sent.destroy()
    return got["label"].to_numpy(), got["z"].to_numpy()


def _best_middle(label: np.ndarray, z: np.ndarray) -> float:
    """The lowest score, halfway between two neighbours, from which on F1 is within a hundredth of the best; 0 where the rows have one label."""
    if len(set(label.tolist())) < 2:
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    # equal scores can't be parted
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.flatnonzero(f1 >= f1.max() - 0.01)[-1])
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5, keep: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text: (id, kept columns, score, predicted); predicted is 1 from `threshold` on.

    Null and empty texts have no n-gram and get the model's base score. Very long texts: a text's n-grams are held
    in its task. Null ids and repeated rows: a row each. Extra columns are not read. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or []

    def label(batches):
        m = sent.value
        present = Present(m.orders, m.bits)
        for batch in batches:
            z = np.array([m.weight[cells].sum(dtype=np.float64) for run in runs(batch.column(batch.num_columns - 1).to_pylist()) for cells in present.of(run)])
            p = 1 / (1 + np.exp(-np.clip(z + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    asked = docs.select(id_col, *kept, text_col)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.schema.fields[:-1])
    return asked.mapInArrow(label, f"{fields}score double, predicted int")
