"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.chars import runs


@dataclass
class Model:
    """Codewords (languages x bits, 1 or -1), a linear n-gram classifier a bit, and each bit's scale and weight."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    order: int
    cells: int


def codewords(k: int) -> np.ndarray:
    """k codewords: all splits of the languages in two where there are few, else one bit a language and as many random splits."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 6:
        splits = np.arange(1, 2 ** (k - 1))
        return np.array([[1 if (s >> lang) & 1 else -1 for s in splits] for lang in range(k)], np.int8)
    rng = np.random.default_rng(k)
    single = 2 * np.eye(k, dtype=np.int8) - 1
    mixed = np.array([rng.permutation(np.arange(k) % 2) * 2 - 1 for _ in range(max(k, 24))], np.int8).T
    return np.hstack([single, mixed])


def _cells(run, order: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    h, inside = run.grams(order)
    return (h >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64), inside


def fit(docs: DataFrame, *, order: int = 3, cells: int = 2**15, rows_per_language: int = 5000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows of docs whose language and text are not null.

    The sample is bounded: about `rows_per_language` rows of each language, those
    with the smallest hashes of their ids. Of these, whole texts count: n-grams by
    language, summed by Spark into languages x cells numbers.

    Repeated rows count each. Rows with a null id are in the sample or not together. An empty table, or one
    language only, gives a model without classifiers: it says "und", or that language, for all texts with a letter.
    """
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if len(languages) < 2:
        return Model(languages, codewords(len(languages)), np.zeros((0, cells), np.float32), np.ones(0), np.ones(0), order, cells)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    dice = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) / 1_000_003.0
    sample = docs.filter(dice < F.element_at(share, F.col(lang_col)))
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches):
        total = np.zeros(len(languages) * cells, np.int64)
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for run in runs(batch.column(1).to_pylist()):
                cell, inside = _cells(run, order, cells)
                of = np.repeat(langs[run.first : run.first + len(run.ends)], run.ends - run.starts + 1)[: len(cell)]
                total += np.bincount((of * cells + cell)[inside], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])

    counted = sample.select(lang_col, text_col).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(languages) * cells)
    n[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    n = n.reshape(len(languages), cells)
    p = (n + 0.05) / (n + 0.05).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.stack([np.log(p[bit == 1].mean(axis=0)) - np.log(p[bit == -1].mean(axis=0)) for bit in code.T])
    margins = code * (p @ weights.T)  # languages x bits: the expected margin on the right side
    scale = np.maximum(margins.mean(axis=0), 1e-6)
    return Model(languages, code, weights.astype(np.float32), scale, np.clip(margins.min(axis=0) / scale, 0.05, 1.0), order, cells)


def _decoded(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: (best language, its share of the softmin over losses, that of the second)."""
    z = 4.0 * margins / model.scale
    loss = np.logaddexp(0.0, -model.code[None, :, :] * z[:, None, :]) @ (model.trust / model.trust.sum())
    share = np.exp(4.0 * (loss.min(axis=1, keepdims=True) - loss))
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    top2 = np.sort(share, axis=1)
    return best, top2[:, -1], top2[:, -2]


def predict(docs: DataFrame, model: Model, *, ambiguous_below: float = 0.2, keep: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of every whole text: (id, kept columns, lang_pred, score, ambiguous).

    Each bit's classifier averages its n-gram weights over the text; the language
    whose codeword loses least, bits weighted by how well they part the languages,
    wins; `score` is its share, `ambiguous` says that the runner-up's share comes
    within `ambiguous_below` of it. Equal losses go to the first language by name.

    Null texts and texts without a letter: "und", score 0, not ambiguous; so all
    texts if nothing was learned. Texts shorter than an n-gram have margins 0 and
    are ambiguous. Null ids and repeated rows: a row each. Extra columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or []

    def label(batches):
        import regex

        m, letter = sent.value, regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            margins = np.zeros((len(texts), m.code.shape[1]))
            if m.code.shape[1]:
                for run in runs(texts):
                    cell, inside = _cells(run, m.order, m.cells)
                    to = slice(run.first, run.first + len(run.ends))
                    if len(cell):
                        lo, hi = np.minimum(run.starts, len(cell)), np.minimum(run.ends, len(cell))
                        n = np.concatenate([[0], np.cumsum(inside)])
                        n = np.maximum(n[hi] - n[lo], 1)
                        for b in range(m.code.shape[1]):
                            s = np.concatenate([[0.0], np.cumsum(np.where(inside, m.weights[b][cell], 0), dtype=np.float64)])
                            margins[to, b] = (s[hi] - s[lo]) / n
            if len(m.languages) > 1:
                best, score, second = _decoded(m, margins)
            else:
                best, score, second = np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts))
            known = np.array([bool(m.languages) and t is not None and bool(letter.search(t)) for t in texts], bool)
            langs = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            columns = [pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(known & (score - second < ambiguous_below))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    asked = docs.select(id_col, *kept, text_col)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.schema.fields[:-1])
    return asked.mapInArrow(label, f"{fields}lang_pred string, score double, ambiguous boolean")
