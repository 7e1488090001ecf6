"""Importance resampling towards a target distribution: scores from arrays, ranks by regular sampling.

Features are runs of words, hashed to buckets. One scan of the documents and one
of the target count the buckets in an array a task; the gain of a bucket is an
array of fixed size, and a second scan adds the gains of each text. With Gumbel
noise from the document's id on top, the highest scores are a sample without
replacement.

Ranks come from a parallel sort by regular sampling. Each task writes its rows
as a sorted run. Rows at regular distances in the runs are gathered (MOST_SAMPLES
at most over all runs) and give regular splitters; rows are counted by segment,
and prefix sums of the counts give each segment's first rank. Only the segments
that hold ranks to be drawn are exchanged; each is merged by one task, which
counts on from its first rank. A segment holds about rows / segments, and the
distance of two samples in each run more at most, whatever the scores are: rows
equal in score are told apart by doc_id, size and key.

Defined results: null text has no word; a document without a feature weighs 0; a
null doc_id stands as an empty id in the noise and after all others in ties; rows
repeated in full have one score and consecutive ranks; an empty target gives the
add-one gains of no feature; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ridgeline.llm.common import numbered, row_key, saved
from ridgeline.llm.text import pieces

BUCKETS = 10_000
#: Rows of a segment that is merged by one task, and segments at most.
SEGMENT_ROWS = 1_000_000
MOST_SEGMENTS = 1024
#: Rows gathered on the driver to choose splitters from.
MOST_SAMPLES = 1 << 20
#: Bytes of a word that are hashed for all words together; what is left of longer ones goes to zlib.
TOGETHER = 64

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, of): the words of a piece in order; of has each row's first word, and the count at its end."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of bytes [start, end) for each pair, going on from crc."""
    order = np.argsort(start - end, kind="stable")  # longest first, so those with a byte left are a prefix
    begin, size = start[order], (end - start)[order]
    state = ~(np.zeros(len(start), np.uint32) if crc is None else crc[order])
    left = len(size) - np.searchsorted(size[::-1], np.arange(min(int(size[0]) if len(size) else 0, TOGETHER)), side="right")
    for i, n in enumerate(left.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + i]) & 0xFF] ^ (state[:n] >> 8)
    state = ~state
    for k in range(int(np.searchsorted(-size, -TOGETHER))):
        state[k] = zlib.crc32(data[begin[k] + TOGETHER : begin[k] + size[k]].tobytes(), int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(text: pa.Array, n: int, buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For runs of rows: words of each row, and for every length of 1 to n words the buckets and each row's first feature (the count at its end)."""
    for _, data, offsets in pieces(text):
        data = _LOWER[data]
        start, end, of = _word_spans(data, offsets)
        row = np.repeat(np.arange(len(of) - 1), np.diff(of))
        crc, grams = None, []
        space = np.full(1, 0x20, np.uint8)
        for k in range(n):
            if k:
                whole = np.flatnonzero(row[k:] == row[: len(row) - k]) if len(row) > k else np.zeros(0, np.int64)
                crc = crc32(space, np.zeros(len(whole), np.int64), np.ones(len(whole), np.int64), crc[whole])
                crc = crc32(data, start[whole + k], end[whole + k], crc)
                full = np.zeros(len(row), np.uint32)
                full[whole] = crc
                grams.append(((crc % np.uint32(buckets)).astype(np.int64), np.searchsorted(row[whole], np.arange(len(of)))))
                crc = full
            else:
                crc = crc32(data, start, end)
                grams.append(((crc % np.uint32(buckets)).astype(np.int64), of))
        yield np.diff(of), grams


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of the column text in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, grams in features(batch.column(0), n, buckets):
                for b, _ in grams:
                    total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of the smoothed shares of each bucket, floored."""
    k, s_all, t_all = len(own), float(own.sum()), float(wanted.sum())
    ratio = [(t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)) for s, t in zip(own.tolist(), wanted.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, key, n_words, n_features, weight, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a long a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, count, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n_words, grams in features(batch.column("text"), n, len(gain)):
                words.append(n_words)
                count.append(sum(np.diff(of) for _, of in grams))
                sums = [np.concatenate([[0], np.cumsum(gain[b])]) for b, _ in grams]
                weight.append(sum(np.diff(c[of]) for c, (_, of) in zip(sums, grams, strict=True)))
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (words, count, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id long, key long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5).cast("double")) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


#: The order of the ranks, each ascending.
ORDER = {"__down": "-score", "__none": "cast(doc_id is null as long)", "__id": "coalesce(doc_id, 0L)", "__less": "-n_features", "__key": "key"}


def _regular(step: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every step-th row of the task's runs."""
        seen = 0
        for batch in batches:
            at = np.arange(-(seen + 1) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    return take


def _placed(splitters: np.ndarray, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of splitters that are not after each row."""
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in names]) if batch.num_rows else np.zeros((len(names), 0), np.int64)
            both = np.concatenate([splitters, own], axis=1)
            first = np.arange(both.shape[1]) >= splitters.shape[1]  # a splitter stands before rows equal to it
            order = np.lexsort((first, *both[::-1]))
            passed = np.cumsum(~first[order])
            segment = np.empty(len(order), np.int32)
            segment[order] = passed
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[splitters.shape[1] :])], [*batch.schema.names, "__segment"])

    return place


def _ranked(before: list[int]):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks, from 1, in the order of the rows; a task has whole segments."""
        seen: dict[int, int] = {}
        for batch in batches:
            segment = batch.column("__segment").to_numpy()
            out = np.empty(len(segment), np.int64)
            for s in np.unique(segment).tolist():
                at = np.flatnonzero(segment == s)
                out[at] = before[s] + seen.get(s, 0) + np.arange(1, len(at) + 1)
                seen[s] = seen.get(s, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "rank"])

    return rank


def with_ranks(rows: DataFrame, eligible: str, percent: int) -> DataFrame:
    """rows with rank: 1 to floor(percent % of the eligible), null for the others."""
    spark = rows.sparkSession
    runs = saved(rows.withColumns({n: F.expr(e) for n, e in ORDER.items()}).sortWithinPartitions(*ORDER))
    able = runs.filter(eligible)
    numbers = able.select(F.spark_partition_id().alias("task"))
    total, tasks = numbers.agg(F.count(F.lit(1)), F.coalesce(F.max("task"), F.lit(0)) + 1).first()
    draw = percent * total // 100
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    segments = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT_ROWS)), MOST_SEGMENTS)
    step = max(1, total // min(4 * segments * tasks, MOST_SAMPLES))
    names = list(ORDER)
    samples = able.select(*names).mapInArrow(_regular(step), ", ".join(f"{n} long" for n in names)).toArrow()
    samples = np.stack([samples.column(n).to_numpy() for n in names])
    samples = samples[:, np.lexsort(samples[::-1])]
    splitters = samples[:, [len(samples[0]) * k // segments for k in range(1, segments)]] if samples.size else samples
    placed = saved(able.mapInArrow(_placed(splitters, names), StructType([*able.schema, StructField("__segment", IntegerType())])))
    sizes = dict(placed.groupBy("__segment").count().collect())  # a row a segment
    before = [0]
    for s in range(segments):
        before.append(before[-1] + sizes.get(s, 0))
    holds = F.col("__segment") <= max(s for s in range(segments) if before[s] < draw)
    merged = placed.filter(holds).repartitionById(segments, "__segment").sortWithinPartitions(*names)
    merged = merged.mapInArrow(_ranked(before), StructType([*placed.schema, StructField("rank", LongType())])).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = placed.filter(~holds).unionByName(runs.filter(~F.expr(eligible)), allowMissingColumns=True).withColumn("rank", F.lit(None).cast("long"))
    return merged.select(*rows.columns, "rank").unionByName(rest.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, key, n_words, n_features, weight, score, rank for every row of docs; rank is null for those that are not drawn."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    return with_ranks(scored(docs, gain, n, seed), f"n_words >= {int(least_words)}", percent)


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of docs that are drawn, with score and rank. Rows repeated in full are as many as their ranks."""
    own = docs.drop("score", "rank")
    mine = numbered(own.withColumn("__key", row_key()), "__key", "__copy")
    theirs = ranked.filter("rank is not null").select(F.col("key").alias("__key"), "score", "rank")
    theirs = numbered(theirs, "__key", "__copy")
    return mine.join(saved(theirs), ["__key", "__copy"]).select(*own.columns, "score", "rank")


SQL = r"""
with base as (select list_reduce(list_prepend(b::ubigint, list_transform(range(8), lambda i: i::ubigint)), lambda c, i: xor(c >> 1, case when c % 2 = 1 then 3988292384::ubigint else 0::ubigint end)) as crc, b from range(256) t(b)),
bytes as (select list(crc order by b) as tab from base),
words as (
  select 'd' as side, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws, row_number() over () as r from documents
  union all
  select 't', item_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), null from benchmark),
each as (select side, r, unnest(ws) as w from words),
vocabulary as (select w, hex(encode(w)) as h from (select distinct w from each)),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::ubigint)), lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::bigint])), 4294967295::ubigint) % 10000 as bucket
  from vocabulary, bytes),
found as (select side, r, bucket from each join hashed using (w)),
counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from found group by bucket),
gains as (select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counts) + 10000)::double / ((s + 1)::double * ((select sum(t) from counts) + 10000)::double)))::bigint as gain from counts),
weights as (select r, count(*) as n, sum(gain)::bigint as weight from found join gains using (bucket) where side = 'd' group by r),
scores as (
  select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from words left join weights using (r) where side = 'd'),
able as (select *, n_features >= 20 as may from scores),
ranked as (select *, row_number() over (partition by may order by score desc, doc_id nulls last, n_features desc) as k, count(*) over (partition by may) as n from able)
select doc_id, n_features, weight, score, case when may and k <= 10 * n // 100 then k end as rank from ranked
"""
