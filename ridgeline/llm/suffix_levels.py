"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A string of ``length`` bytes that starts at two places is removed at both.
Documents come in batches. A batch's suffix array holds sampled suffixes in
order: of each window of ``length`` bytes the anchor is the (leftmost) position
whose HEAD bytes hash lowest, so equal windows have equal anchors, and about one
suffix in (length - HEAD) / 2 is kept. An entry has the document and position,
the suffix's first 8 bytes and the hash of its first HEAD bytes, which it is
sorted by (beyond 8 bytes equal prefixes stand together, but not in byte order),
and ladders: short hashes of the text up to 1 to STEPS steps to its
right and left, which bound the length of its match with any other.

A new batch's array is scanned against every existing level by a join on (lead,
head), which finds the suffixes whose HEAD bytes stand elsewhere too. Spark
plans it: it broadcasts the keys of a level that is small by its statistics and
sorts both sides of a large one again, since a plain table doesn't tell it their
order. Then equal-sized levels merge, as in a binary counter, so an entry is rewritten
log(batches) times. Levels are written tables; a family that is opened again on
its folder goes on with the levels that stand there.

Matches are made exact in three steps. Around an anchor all windows that it
anchors form one span; spans with equal hashes repeat as a whole. Entries of the
commonest spans (a line repeated within many texts gives one to each line) are
found where they lie by a broadcast of at most HOT_KEYS keys, the others by a join.
Of the other spans of a head those stay whose ladders allow a match of ``length``
bytes with another. One document for each gives the bytes around the anchor, which meet by
head and are compared window by window (by 64-bit hashes). A hot head has as
many parts as its spans need, dealt by window hash, and each task sends a window
once. So neither a hot passage nor a group of copies gathers in one task.

Texts are read three times: once for the entries, once for those with a match
(a bit map of fixed size drops most of the others before the shuffle), and once
for those that the bit map drops, which are returned as they are.

Defined results: null text is empty; a text shorter than ``length`` loses
nothing; repeated rows repeat each other's text; repeats inside one text
count; extra columns are ignored; an empty table gives an empty result. Texts
end at 2 GB, as Spark's strings do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import maybe_among, saved, shared_folder, surely_not_among
from ridgeline.llm.text import mix, pieces, rolling, window_hash

HEAD = 64
#: Steps of a ladder, and bits of its hashes.
STEPS = 4
RUNG = 14
_AT_BITS = 36
#: Spans of one head that share a part.
PART_SPANS = 4096
#: Windows in a partition of the exact comparison.
PART_WINDOWS = 4_000_000
#: A span is hot that stands at this many places, or at one in HOT_KEYS of all.
HOT_TIMES = 1024
HOT_KEYS = 1 << 16


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row, by doubling."""
    n, width = len(x) - w + 1, 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n])


def _ladder(sums: np.ndarray, at: np.ndarray, room: np.ndarray, step: int, base: int) -> np.ndarray:
    """RUNG bits for each of the steps there is room for, and their number above them; negative steps go left."""
    n = np.minimum(room // abs(step), STEPS)
    out = n.astype(np.uint64) << np.uint64(RUNG * STEPS)
    for i in range(1, STEPS + 1):
        has = np.flatnonzero(n >= i)
        a, b = (at[has], at[has] + base + i * step) if step > 0 else (at[has] + i * step, at[has])
        out[has] |= (window_hash(sums, a, b) >> np.uint64(64 - RUNG)) << np.uint64(RUNG * (i - 1))
    return out.view(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Columns row, lead, head, lft, rgt, span, at, first, last: runs of window starts with one anchor, in order."""
    kinds = {"row": np.int64, "lead": np.int64, "head": np.int64, "lft": np.int64, "rgt": np.int64, "span": np.int64, "at": np.int32, "first": np.int32, "last": np.int32}
    if len(data) < length:
        return {n: np.zeros(0, t) for n, t in kinds.items()}
    sums = rolling(data)
    n = len(data)
    heads = window_hash(sums, slice(0, n - HEAD + 1), slice(HEAD, n + 1))
    low = np.uint64((1 << _AT_BITS) - 1)
    lowest = _sliding_min((heads & ~low) | np.arange(len(heads), dtype=np.uint64), length - HEAD + 1)
    at = (lowest & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + length <= offsets[row + 1]
    starts = valid.copy()
    starts[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(starts)
    ends = valid.copy()
    ends[:-1] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~valid[1:]
    last = np.flatnonzero(ends)
    a = at[first]
    span = window_hash(sums, first, last + length) ^ mix(((a - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64))
    row, base, end = row[first], offsets[row[first]], offsets[row[first] + 1]
    lead = np.zeros(len(a), np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | data[a + i]
    step = -(-(length - HEAD) // STEPS)
    lft, rgt = _ladder(sums, a, a - base, -step, 0), _ladder(sums, a, end - a - HEAD, step, HEAD)
    values = (row, (lead ^ np.uint64(1 << 63)).view(np.int64), heads[a].view(np.int64), lft, rgt, span.view(np.int64), a - base, first - base, last - base)
    return {n: v.astype(t) for (n, t), v in zip(kinds.items(), values, strict=True)}


def _key(digest: str) -> int:
    return int(digest[:15], 16)


#: What a level holds of each sampled suffix; lead, head and rgt are the suffix's order.
ENTRY = "lead long, head long, rgt long, lft long, span long, id long, k long, at int, first int, last int"
_ARRAYS = ("lead", "head", "rgt", "lft", "span", "at", "first", "last")


def _indexed(length: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column("text")):
                n = len(offsets) - 1
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found = anchors(data, offsets, length)
                edges = pa.array(np.searchsorted(found["row"], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(found[c])) for c in _ARRAYS]
                keys = pa.array([_key(d) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), keys, *lists], ["doc_id", "k", *_ARRAYS])

    return index


_INDEX = "doc_id long, k long, lead array<long>, head array<long>, rgt array<long>, lft array<long>, span array<long>, at array<int>, first array<int>, last array<int>"


class LevelFamily:
    """Sparse suffix arrays of batches a to b, each a table in the folder, of doubling sizes.

    A level is named by its batches. Where a merge was cut off, both the merged
    level and its parts may stand there; the wider one counts.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/ridgeline-levels-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if folder is None:
            self._files.deleteOnExit(path)
        self.levels: list[tuple[int, int]] = []
        if self._files.exists(path):
            named = [re.fullmatch(r"batches-(\d+)-(\d+)", s.getPath().getName()) for s in self._files.listStatus(path)]
            found = sorted(((int(m[1]), int(m[2])) for m in named if m and self._files.exists(self._path(f"{m[0]}/_SUCCESS"))), key=lambda x: (x[0], -x[1]))
            for x in found:
                if not self.levels or x[0] > self.levels[-1][1]:
                    self.levels.append(x)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _name(self, level: tuple[int, int]) -> str:
        return f"batches-{level[0]}-{level[1]}"

    def read(self, level: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{self._name(level)}")

    def _write(self, entries: DataFrame, level: tuple[int, int]) -> None:
        order = ("lead", "head", "rgt", "id", "k", "at")
        ordered = entries.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{self._name(level)}")

    def add(self, entries: DataFrame) -> DataFrame:
        """Files a batch; the heads that stand in it more than once, or in it and an existing level."""
        own = self.levels[-1][1] + 1 if self.levels else 0
        run = (own, own)
        self._write(entries.select(*[x.split()[0] for x in ENTRY.split(", ")]), run)
        mine = self.read(run)
        found = mine.groupBy("lead", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("head")
        for level in self.levels:
            found = found.unionByName(mine.join(self.read(level).select("lead", "head"), ["lead", "head"], "left_semi").select("head"))
        found = saved(found.distinct())
        parts, size = [run], 1
        while self.levels and self.levels[-1][1] - self.levels[-1][0] + 1 == size:
            parts.append(self.levels.pop())
            size *= 2
        whole = (parts[-1][0], own)
        if whole != run:
            self._write(_union([self.read(x) for x in parts]), whole)
            for x in parts:
                self._files.delete(self._path(self._name(x)), True)
        self.levels.append(whole)
        return found

    def entries(self, heads: DataFrame) -> DataFrame:
        """The entries of all levels with these heads."""
        return _union([self.read(x) for x in self.levels]).join(heads, "head")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _repeated(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """The entries whose span stands more than once; those of hot spans stay in the partitions they lie in."""
    total = spans.agg(F.sum("times")).first()[0] or 0
    least = max(HOT_TIMES, total // HOT_KEYS + 1)
    hot = F.broadcast(spans.filter(F.col("times") >= least).select("head", "span"))  # at most HOT_KEYS
    cold = spans.filter((F.col("times") > 1) & (F.col("times") < least)).select("head", "span")
    rest = entries.join(hot, ["head", "span"], "left_anti").join(cold, ["head", "span"], "left_semi")
    return entries.join(hot, ["head", "span"], "left_semi").unionByName(rest)


def _may_match(spans: DataFrame) -> DataFrame:
    """The spans (distinct by head and span) whose ladders allow a match of the whole length with another span of the head.

    A match that goes i steps and a part of one to the left goes STEPS - 1 - i
    steps to the right at least; spans that match have equal hashes there.
    """
    rung = lambda c, i: F.shiftright(c, RUNG * (i - 1)).bitwiseAND(F.lit((1 << RUNG) - 1)) if i else F.lit(0)
    steps = lambda c: F.shiftright(c, RUNG * STEPS)
    keys = [F.when((steps("lft") >= i) & (steps("rgt") >= STEPS - 1 - i), F.xxhash64("head", F.lit(i), rung("lft", i), rung("rgt", STEPS - 1 - i))) for i in range(STEPS)]
    keyed = spans.withColumn("key", F.explode(F.array_compact(F.array(*keys))))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keyed.join(often, "key", "left_semi").drop("key").distinct()


def _sent(length: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each asked span the bytes around its anchor; of a hot head window hashes by part, each once a batch, and what repeats within the batch."""
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            plain, doc, head, parts, start, hashes = [], [], [], [], [], []
            for i, (text, spans) in enumerate(zip(texts, batch.column("asked").to_pylist(), strict=True)):
                hot = [x for x in spans or () if x["n"] > PART_SPANS]
                plain += [(i, x["head"], x["first"], text[x["first"] : x["last"] + length]) for x in spans or () if x["n"] <= PART_SPANS]
                sums = rolling(np.frombuffer(text or b"", np.uint8)) if hot else None
                for x in hot:
                    s = np.arange(x["first"], x["last"] + 1)
                    doc.append(np.full(len(s), i))
                    head.append(np.full(len(s), x["head"]))
                    parts.append(np.full(len(s), -(-x["n"] // PART_SPANS), np.uint64))
                    start.append(s)
                    hashes.append(window_hash(sums, s, s + length))
            if plain:
                of, heads, firsts, contexts = zip(*plain, strict=True)
                yield _rows(batch, np.array(of), pa.array(heads, pa.int64()), np.zeros(len(of), np.int32), pa.array(firsts, pa.int32()), pa.array(contexts, pa.binary()), False)
            if not doc:
                continue
            doc, head, parts, start, hashes = map(np.concatenate, (doc, head, parts, start, hashes))
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            new = np.ones(len(order), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            counts = np.diff(np.append(np.flatnonzero(new), len(order)))
            local = np.zeros(len(order), bool)
            local[order] = np.repeat(counts > 1, counts)
            unique = np.zeros(len(order), bool)
            unique[order[new]] = True
            part = ((hashes >> np.uint64(40)) % parts).astype(np.int32)
            for mask, here in ((local, True), (unique, False)):
                at = np.flatnonzero(mask)
                at = at[np.lexsort((start[at], part[at], head[at], doc[at]))]
                if not len(at):
                    continue
                cut = np.flatnonzero((np.diff(doc[at]) != 0) | (np.diff(head[at]) != 0) | (np.diff(part[at]) != 0)) + 1
                edges = np.concatenate([[0], cut, [len(at)]])
                lead = at[edges[:-1]]
                edges = pa.array(edges.astype(np.int32))
                none = pa.array(np.zeros(len(edges), np.int32))
                values = pa.array(np.zeros(0, np.int64) if here else hashes[at].view(np.int64))
                lists = [pa.ListArray.from_arrays(edges, pa.array(start[at].astype(np.int32))), pa.ListArray.from_arrays(none if here else edges, values)]
                yield _rows(batch, doc[lead], pa.array(head[lead]), part[lead], None, None, here, *lists)

    return send


_SENT = "id long, k long, head long, part int, local boolean, first int, context binary, starts array<int>, hashes array<long>"


def _rows(batch: pa.RecordBatch, doc: np.ndarray, head: pa.Array, part: np.ndarray, first: pa.Array | None, context: pa.Array | None, local: bool, *lists: pa.Array) -> pa.RecordBatch:
    n, at = len(doc), pa.array(doc)
    empty = (first or pa.nulls(n, pa.int32()), context or pa.nulls(n, pa.binary()))
    lists = lists or (pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("k").take(at), head, pa.array(part), pa.array(np.full(n, local)), *empty, *lists], [x.split()[0] for x in _SENT.split(", ")])


def _runs(of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive starts of one owner; both sorted."""
    breaks = np.flatnonzero((np.diff(of) != 0) | (np.diff(start) != 1)) + 1
    return np.concatenate([[0], breaks]), np.concatenate([breaks - 1, [len(of) - 1]])


def _met(length: int):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of window starts whose hash stands in the partition more than once."""
        ids, ks, owners, starts, hashes, n = [], [], [], [], [], 0
        for batch in batches:
            rows = batch.num_rows
            ids.append(batch.column("id"))
            ks.append(batch.column("k"))
            lists = batch.column("starts")
            owners.append(np.repeat(np.arange(n, n + rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            starts.append(lists.flatten().to_numpy())
            hashes.append(batch.column("hashes").flatten().to_numpy().view(np.uint64))
            for i, (context, first) in enumerate(zip(batch.column("context"), batch.column("first"), strict=True)):
                if context.is_valid:
                    sums = rolling(np.frombuffer(context.as_buffer(), np.uint8))
                    m = len(sums) - length
                    owners.append(np.full(m, n + i))
                    starts.append(np.arange(first.as_py(), first.as_py() + m, dtype=np.int32))
                    hashes.append(window_hash(sums, slice(0, m), slice(length, None)))
            n += rows
        if not n:
            return
        of, start, values = map(np.concatenate, (owners, starts, hashes))
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        at = at[np.lexsort((start[at], of[at]))]
        of, start = of[at], start[at]
        if len(of):
            first, last = _runs(of, start)
            at = pa.array(of[first])
            yield pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks().take(at), pa.chunked_array(ks).combine_chunks().take(at), pa.array(start[first]), pa.array(start[last])], ["id", "k", "first", "last"])

    return met


_CUT = "doc_id long, text string, spans array<struct<start: long, end: long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, edges, starts, ends, sizes, removed, digests = [], [0], [], [], [], [], []
            for raw, marks in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("marks").to_pylist(), strict=True):
                text, parts, end = raw or b"", [], 0
                for m in sorted((m["first"], m["last"] + length) for m in marks or ()):
                    if len(starts) == edges[-1] or m[0] > end:
                        parts.append(text[end : m[0]])
                        starts.append(m[0])
                        ends.append(m[1])
                    ends[-1] = end = max(end, m[1])
                parts.append(text[end:])
                rest = b"".join(parts)
                kept.append(None if raw is None else rest.decode("utf-8", "replace"))
                edges.append(len(starts))
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                digests.append(hashlib.sha256(rest).hexdigest())
            runs = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"])
            columns = [batch.column("doc_id"), pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs)]
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(edges).astype(np.int64)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in re.split(", (?=[a-z_0-9]+ )", _CUT)])

    return cut


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-1).cast("long"))


def remove_repeats(docs: DataFrame, length: int = 400, batches: int = 4) -> DataFrame:
    """doc_id, text, spans, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    text is what is kept (null stays null; a part of a character becomes U+FFFD),
    spans are the maximal removed runs of bytes [start, end) of the input, n_bytes is
    the length of the input, and the digest is that of the kept bytes as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = rows.mapInArrow(_indexed(length), _INDEX).withColumn("id", _id("doc_id"))
    index = saved(index.withColumn("batch", F.pmod(F.xxhash64("id", "k"), F.lit(batches)).cast("int")), "batch")
    family = LevelFamily(docs.sparkSession)
    found = []
    for b in range(batches):
        arrays = index.filter(F.col("batch") == b).select("id", "k", F.inline(F.arrays_zip(*_ARRAYS)))
        found.append(family.add(arrays))
    heads = saved(_union(found).distinct())  # written, so that the join can split a hot head
    entries = saved(family.entries(heads))
    one = F.min(F.struct("id", "k", "first", "last", "lft", "rgt")).alias("one")
    spans = saved(entries.groupBy("head", "span").agg(F.count(F.lit(1)).alias("times"), one))
    whole = saved(_repeated(entries, spans).select("id", "k", "first", "last"))
    single = _may_match(spans.select("head", "span", "one.*"))
    single = saved(single)
    several = saved(single.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    asked = single.join(several, "head").select("id", "k", F.struct("head", "first", "last", "n").alias("x"))
    asked = saved(asked.groupBy("id", "k").agg(F.collect_list("x").alias("asked")))
    keys = saved(asked.unionByName(whole.select("id", "k").distinct(), allowMissingColumns=True).groupBy("id", "k").agg(F.first("asked", ignorenulls=True).alias("asked")))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = rows.withColumns({"id": _id("doc_id"), "k": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")})
    texts = saved(maybe_among(rows, keys, "id", "k").join(keys, ["id", "k"], "left"))
    windows = asked.select(F.sum(F.aggregate("asked", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1))).first()[0] or 0
    sent = saved(texts.filter("asked is not null").mapInArrow(_sent(length), _SENT))
    met = sent.filter("not local").repartition(windows // PART_WINDOWS + 1, "head", "part").mapInArrow(_met(length), "id long, k long, first int, last int")
    here = sent.filter("local").select("id", "k", F.explode("starts").alias("first")).withColumn("last", F.col("first"))
    marks = whole.unionByName(met).unionByName(here).groupBy("id", "k").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    cut = texts.drop("asked").join(marks, ["id", "k"], "left").select("doc_id", "text", "marks").mapInArrow(_cut_out(length), _CUT)
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start: long, end: long>>")
    same = surely_not_among(rows, keys, "id", "k").withColumns({"spans": none, "n_bytes": F.coalesce(F.octet_length("text").cast("long"), zero), "n_removed": zero, "n_spans": zero, "kept_sha256": digest})
    return cut.unionByName(same.drop("id", "k"))
