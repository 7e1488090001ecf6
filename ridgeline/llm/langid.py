"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning is one scan: each task counts the n-grams of its labelled rows per
language and bucket and gives the non-zero counts to a sum by (language,
bucket). The matrix of log-probabilities has BUCKETS rows and a column per
language; it is broadcast in slices of SLICE columns (their size doesn't depend
on the rows), and scoring is one scan without a shuffle: the n-grams of a batch
index a slice, and sums over each text's run of n-grams give its
log-likelihoods. What goes on from slice to slice is a text's best language and
the log-sum of all. A task holds one slice at a time, however many languages
there are.

Characters are lower-cased; whatever isn't a letter counts as one space.

The posterior of a longer text is 0 or 1 whatever it is written in, so a filter
also asks how well the language explains the text: the mean log-probability of
its n-grams must not lie further below that of the learned texts than SLACK and
six standard errors.

Defined results: null text or text without a letter is ``und`` with score 0;
if nothing was learned every text is; a tie goes to the first language in code
point order; rows without a label are never learned from; repeated rows are
learned from as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import saved
from ridgeline.llm.text import mix, pieces

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
UND = "und"
#: Languages in a slice of the matrix, which has BUCKETS * SLICE * 4 bytes at most.
SLICE = 128
#: Nats an n-gram of a text may lie below the learned ones on average.
SLACK = 1.5
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For every code point the lower-case letter, or a space."""
    if not _fold:
        out = np.full(0x110000, 0x20, np.uint32)
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _fold.append(out)
    return _fold[0]


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams that start at each character, an array for each order, and the rows' character offsets.

    Bucket 0 stands for nothing: n-grams of spaces only, and those that would leave the row.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[offsets]
    chars = _folded()[points].astype(np.uint64)
    out = []
    code = np.zeros(len(chars), np.uint64)
    for n in ORDERS:
        shifted = np.full(len(chars), 0x20, np.uint64)
        if n <= len(chars):
            shifted[: len(chars) - n + 1] = chars[n - 1 :]
        code = code * np.uint64(1 << 21) + shifted
        blank = sum(0x20 << (21 * j) for j in range(n))
        bucket = (mix(code * np.uint64(4) + np.uint64(n)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        bucket[code == np.uint64(blank)] = 0
        for back in range(1, n):
            at = ends[1:] - back
            bucket[at[at >= ends[:-1]]] = 0
        out.append(bucket)
    return out, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, data, offsets in pieces(batch.column("text")):
            buckets, ends = _features(data, offsets)
            here = langs[row : row + len(offsets) - 1]
            for lang in set(here):
                mine = np.repeat(here == lang, np.diff(ends))
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for b in buckets:
                    total += np.bincount(b[mine], minlength=BUCKETS)
                rows[lang] = rows.get(lang, 0) + int((here == lang).sum())
    for lang, total in counts.items():
        total[0] = rows[lang]  # bucket 0 isn't a feature: it carries the documents
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


@dataclass
class Model:
    """Languages in order, and for each its log-prior and the mean and deviation of its learned n-grams' log-probabilities."""

    names: list[str]
    prior: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    #: Log-probabilities by bucket and language, SLICE languages each.
    slices: list[Broadcast]


def learn(labelled: DataFrame, slice_langs: int = SLICE) -> Model:
    """The model of the columns text and lang. The driver holds one slice at a time, and a few numbers a language."""
    rows = labelled.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = saved(counted)
    docs = dict(counted.filter("bucket = 0").select("lang", "n").collect())  # bucket 0 has the rows of each language
    names = sorted(docs, key=lambda x: x.encode())
    mean, deviation, slices = np.zeros(len(names)), np.zeros(len(names)), []
    for k in range(0, len(names), slice_langs):
        own = names[k : k + slice_langs]
        found = counted.filter(F.col("lang").isin(own) & (F.col("bucket") > 0)).toArrow()
        table, at = np.zeros((BUCKETS, len(own))), {x: i for i, x in enumerate(own)}
        table[found.column("bucket").to_numpy(), [at[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
        logs = np.log(table + ALPHA) - np.log(table.sum(0) + ALPHA * BUCKETS)
        logs[0] = 0
        total = np.maximum(table.sum(0), 1)
        mean[k : k + len(own)] = (table * logs).sum(0) / total
        deviation[k : k + len(own)] = np.sqrt(np.maximum((table * logs**2).sum(0) / total - mean[k : k + len(own)] ** 2, 0))
        slices.append(labelled.sparkSession.sparkContext.broadcast(logs.astype(np.float32)))
    counts = np.array([docs[x] for x in names], float)
    return Model(names, np.log(np.maximum(counts, 1) / max(counts.sum(), 1)), mean, deviation, slices)


def _slices(model: Model) -> Iterator[tuple[int, np.ndarray]]:
    """(first language, log-probabilities) of each slice; of several only the one at hand is held."""
    at = 0
    for shared in model.slices:
        logs = shared.value
        yield at, logs
        at += logs.shape[1]
        if len(model.slices) > 1:
            vars(shared).pop("_value", None)


def _predict(text: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, posteriors, and whether the language explains the text as it does what it was learned from."""
    langs, scores, explained = [], np.zeros(len(text)), np.zeros(len(text), bool)
    for row, data, offsets in pieces(text):
        n = len(offsets) - 1
        if not model.names or not len(data):
            langs += [UND] * n
            continue
        buckets, ends = _features(data, offsets)
        filled = np.flatnonzero(np.diff(ends) > 0)
        letters = np.zeros(n, np.int64)
        letters[filled] = np.add.reduceat(buckets[0] > 0, ends[filled], dtype=np.int64)
        grams = np.zeros(n, np.int64)
        for b in buckets:
            grams[filled] += np.add.reduceat(b > 0, ends[filled], dtype=np.int64)
        best, top, mass = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n)  # mass: the sum of all, over the best
        for first, logs in _slices(model):
            total = np.tile(model.prior[first : first + logs.shape[1]], (n, 1))
            for b in buckets:
                total[filled] += np.add.reduceat(logs[b], ends[filled], axis=0, dtype=np.float64)
            here = total.argmax(1)
            most = total[np.arange(n), here]
            better = most > top
            best[better] = first + here[better]
            now = np.maximum(top, most)
            mass = mass * np.exp(top - now) + np.exp(total - now[:, None]).sum(1)
            top = now
        m = np.maximum(grams, 1)
        explained[row : row + n] = (top - model.prior[best]) / m >= model.mean[best] - SLACK - 6 * model.deviation[best] / np.sqrt(m)
        scores[row : row + n] = np.where(letters > 0, 1 / mass, 0.0)
        langs += [model.names[k] if has else UND for k, has in zip(best.tolist(), (letters > 0).tolist(), strict=True)]
    return langs, scores, explained


def _scorer(model: Model, keep: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, explained = _predict(batch.column("__text"), model)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__text"]
            names = [n for n in batch.schema.names if n != "__text"]
            if keep is not None:
                mask = pa.array((np.array(langs, object) != UND) & (scores >= keep) & explained)
                yield pa.RecordBatch.from_arrays(columns, names).filter(mask)
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, plus lang_pred and score."""
    own = docs.drop("text")
    schema = own.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    rows = docs.select(*[docs[c] for c in schema.names[:-2]], docs["text"].cast("string").alias("__text"))
    return rows.mapInArrow(_scorer(model, None), schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found with at least that posterior and explains them; texts without a letter go."""
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(_scorer(model, least), docs.schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that is never learned from; a null doc_id is in none."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the other folds, predicted for every row."""
    model = learn(docs.filter(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model)
