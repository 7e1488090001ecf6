"""Hard-negative mining with coordinate pruning in length buckets.

Vectors become integer vectors, and scores are exact inner products. Rows are
dealt by ranges of their length, longest first, and written; each task cuts its
rows into length buckets. A bucket holds its directions and, for each coordinate,
the list of its rows sorted by that coordinate. The search for scores of theta or
more from an anchor q goes through a bucket as follows. The longest row of the
bucket gives the least cosine t = theta / (|q| * longest); above 1 the bucket is
left out. On the sphere a row within acos(t) of q lies, in coordinate f, between
cos(acos(q_f) + acos(t)) and cos(acos(q_f) - acos(t)): a slice of the sorted
list. The slices of the anchor's largest (focus) coordinates are intersected, and
what is left is verified with exact products. Theta rises as the best rows of a
task are found. A theta of 0 or less says nothing about directions: then all
rows of the bucket are verified.

The search is run twice: for an anchor's positives (its best rows of the same
label), and for the rows of other labels in each positive's band of scores. A
task gives its best few rows an anchor and positive, and those of all tasks are
ranked. Anchors go through in blocks of about BLOCK, so what is broadcast is
bounded; every block is one scan of the written rows for each search.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part, nor do rows with a component so large that scores could
exceed a long (beyond sqrt(2**62 / dimension) after scaling); a null vec_id is no
anchor and comes last in ties; other rows are those of another vec_id; an anchor
that is repeated in full counts once, other repeated rows are rows of their own;
vectors of different dimensions have no score; a negative positive score has an
empty band; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import saved

SCALE = 256
#: Anchors of a block, about.
BLOCK = 4096
#: Rows of a length bucket at most, and coordinates whose ranges are intersected.
BUCKET = 4096
FOCUS = 8
#: Widening of the ranges, far above the error of the cosines.
SLACK = 1e-6
_LAST = np.iinfo(np.int64).max


def integer_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vec (array of long) and length for the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("x"), F.lit(1)))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = rows.filter(F.forall("x", lambda v: F.abs(v) * scale < most))
    rows = rows.withColumn("vec", F.transform("x", lambda v: F.floor(v * scale)))
    return rows.select("vec_id", "label", "vec", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("length"))


@dataclass
class Anchor:
    number: int
    vec_id: int
    label: int
    vec: np.ndarray
    length: float
    focus: np.ndarray
    angle: np.ndarray
    #: Least and largest score of each band.
    bands: list[tuple[int, int]] = field(default_factory=list)


def _anchor(number: int, vec_id: int, label: int, vec: list[int], bands: list[tuple[int, int]]) -> Anchor:
    v = np.array(vec, np.int64)
    length = float(np.sqrt((v.astype(float) ** 2).sum()))
    way = v / length if length else np.zeros(len(v))
    focus = np.argsort(-np.abs(way), kind="stable")[:FOCUS]
    return Anchor(number, vec_id, label, v, length, focus, np.arccos(np.clip(way[focus], -1, 1)), bands)


class Bucket:
    """Rows of one dimension and similar lengths, with a sorted list of each coordinate."""

    def __init__(self, vecs: np.ndarray) -> None:
        self.vecs = vecs
        self.exact = vecs.astype(float) if np.abs(vecs).max(initial=0) < 1 << 20 and vecs.shape[1] < 1 << 12 else None
        lengths = np.sqrt((vecs.astype(float) ** 2).sum(1))
        self.longest = float(lengths.max(initial=0))
        self.ways = vecs / np.where(lengths > 0, lengths, 1)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.ways[:, f], kind="stable")
            self._lists[f] = order, self.ways[order, f]
        return self._lists[f]

    def candidates(self, a: Anchor, theta: float) -> np.ndarray:
        """Rows that may score theta or more; surely all that do."""
        n = len(self.vecs)
        if theta <= 0:
            return np.arange(n)
        reach = a.length * self.longest
        if not reach or theta / reach > 1 + SLACK:
            return np.arange(0)
        wide = np.arccos(min(max(theta / reach - SLACK, -1.0), 1.0))
        low = np.cos(np.minimum(a.angle + wide, np.pi)) - SLACK
        high = np.cos(np.maximum(a.angle - wide, 0)) + SLACK
        slices = []
        for f, lo, hi in zip(a.focus.tolist(), low, high, strict=True):
            order, values = self._list(f)
            slices.append((int(np.searchsorted(values, lo)), int(np.searchsorted(values, hi, side="right")), f, lo, hi))
        slices.sort(key=lambda s: s[1] - s[0])
        start, end, f, _, _ = slices[0]
        out = self._list(f)[0][start:end]
        for start, end, f, lo, hi in slices[1:]:
            if not len(out) or end - start == n:
                continue
            here = self.ways[out, f]
            out = out[(here >= lo) & (here <= hi)]
        return out

    def scores(self, a: Anchor, rows: np.ndarray) -> np.ndarray:
        if self.exact is not None and np.abs(a.vec).max(initial=0) < 1 << 20:
            return (self.exact[rows] @ a.vec.astype(float)).astype(np.int64)  # sums below 2**52
        return self.vecs[rows] @ a.vec


def _search(shared, most: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each anchor and band the best rows of the task: anchor, band, score and vec_id."""
        by_dim: dict[int, list[Anchor]] = {}
        for row in shared.value:
            a = _anchor(*row)
            by_dim.setdefault(len(a.vec), []).append(a)
        none = np.zeros(0, np.int64)
        best = {(a.number, k): (none, none) for found in by_dim.values() for a in found for k in range(len(a.bands))}
        for batch in batches:
            vecs, dims = batch.column("vec"), batch.column("vec").value_lengths().to_numpy()
            labels = batch.column("label").to_numpy()
            ids = batch.column("vec_id").fill_null(_LAST).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), BUCKET):
                    own = rows[at : at + BUCKET]
                    bucket = Bucket(vecs.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim))
                    for a in by_dim.get(dim, ()):
                        least = [max(lo, int(s[-1])) if len(s := best[a.number, k][0]) == most else lo for k, (lo, _) in enumerate(a.bands)]
                        found = bucket.candidates(a, min(least))
                        found = found[(labels[own[found]] == a.label) == same]
                        found = found[ids[own[found]] != a.vec_id]
                        score = bucket.scores(a, found)
                        for k, (_, hi) in enumerate(a.bands):
                            fits = (score >= least[k]) & (score <= hi)
                            if fits.any():
                                s, i = best[a.number, k]
                                s, i = np.concatenate([s, score[fits]]), np.concatenate([i, ids[own[found[fits]]]])
                                order = np.lexsort((i, -s))[:most]
                                best[a.number, k] = s[order], i[order]
        rows = [(n, k, s, i) for (n, k), (ss, ii) in best.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
        numbers, bands, scores, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [pa.array(numbers, pa.int32()), pa.array(bands, pa.int32()), pa.array(scores, pa.int64()), pa.array([None if i == _LAST else i for i in ids], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "band", "score", "vec_id"])

    return search


def _best(rows: DataFrame, anchors: list[tuple], most: int, same: bool) -> DataFrame:
    """anchor, band, score, vec_id, rank: the best rows of each band; (number, vec_id, label, vec, bands) are the anchors."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)
    found = rows.mapInArrow(_search(shared, most, same), "anchor int, band int, score long, vec_id long")
    turn = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", turn).filter(F.col("rank") <= most)  # most rows a task and band


def mine(rows: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has vec_id, embedding and label. A positive's negatives are rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    own = integer_rows(rows, scale)
    own = saved(own.repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id"))
    is_anchor = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    chosen = saved(own.filter(is_anchor & F.col("vec_id").isNotNull()).select("vec_id", "label", "vec").distinct())
    blocks = -(-chosen.count() // block)
    number = F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(max(blocks, 1)))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        anchors = [(k, r.vec_id, r.label, r.vec) for k, r in enumerate(chosen.filter(number == b).orderBy("vec_id").collect())]  # about block rows
        near: dict[int, list] = {}
        for r in _best(own, [(*a, [(-(1 << 62), 1 << 62)]) for a in anchors], positives, True).orderBy("anchor", "rank").collect():
            near.setdefault(r.anchor, []).append(r)
        asked = [(*a, [(-(-low * r.score // 100), high * r.score // 100) for r in near[a[0]]]) for a in anchors if a[0] in near]
        pairs = [(a[0], k, a[1], r.vec_id, r.score) for a in anchors for k, r in enumerate(near.get(a[0], ()))]
        pairs = spark.createDataFrame(pairs, "anchor int, band int, anchor_id long, positive_id long, positive_score long")
        hard = _best(own, asked, negatives, False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        hard = hard.join(F.broadcast(pairs), ["anchor", "band"])  # positives * block rows
        out = out.unionByName(saved(hard.select(*out.columns)))
    return out


SQL = """
with own as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s
  from own a join own b on a.vec_id % 100 = 0 and a.vec_id != b.vec_id),
positives as (select anchor_id, other as positive_id, s as positive_score from scored where same qualify row_number() over (partition by anchor_id order by s desc, other) <= 5),
found as (
  select p.*, n.other as negative_id, n.s as negative_score, row_number() over (partition by p.anchor_id, positive_id order by n.s desc, n.other)::int as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 80 * positive_score <= 100 * n.s and 100 * n.s <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from found where rank <= 5
"""
