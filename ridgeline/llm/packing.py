"""Best-fit packing of token sequences by exact complements.

Only lengths matter for a packing, and there are at most ``capacity`` of them. So
the plan is made from a histogram of lengths, whose size doesn't depend on the
rows, and says how many sequences are filled in which pattern; pieces then find
their place from their length and their number among pieces of that length.

The plan keeps indexes of the lengths still available: single lengths, and how
many pairs of them have each sum (a triple is a length and a pair). The largest
length opens a sequence. If one length, else a pair, else a triple fills the gap
exactly, that is taken, of several the one with the largest length; else the
best fit, the largest length that goes in, narrows the gap and the search goes
on. The pattern is used as often as the available counts allow, so each step
uses a length up (but for less than its times in the pattern), and the number of
patterns is bounded by the capacity, not by the rows.

Pieces are numbered in the tasks that tokenise them: each has its task and turn
among the task's pieces of that length, and what the tasks before hold of a
length is a prefix sum over one row a task and length. Texts are read once, and
only the rows of the layout (no ids) are shuffled.

Defined results: null or empty text is one piece, the end id alone; a text whose
ids fit is never cut; rows repeated in full, or without a doc_id, are pieces of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import row_key, saved

CAPACITY = 2048
END = 0
#: Characters that are tokenised at a time, but for longer texts.
CHARS = 1 << 23
#: Words whose ids a worker keeps, and characters of the longest one that it does.
WORDS, LONGEST = 1 << 20, 64
#: Words that are tokenised as one text, and what stands between them: a character that is one id, and that no other becomes.
TOGETHER, MARK = 256, "~"


# --- the plan, from a histogram


class Available:
    """Counts of lengths 1 to capacity, and for every sum the number of pairs of available lengths that have it."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64)
        self.pairs = np.zeros(2 * len(counts), np.int64)
        self._has = np.zeros(len(counts), bool)
        self._twice = np.zeros(len(counts), bool)
        for n in np.flatnonzero(self.left):
            self._note(int(n))

    def _note(self, n: int) -> None:
        """Brings the index up to date with the count of n."""
        has, twice = self.left[n] > 0, self.left[n] > 1
        if has != self._has[n]:
            self._has[n] = False
            self.pairs[np.flatnonzero(self._has) + n] += 1 if has else -1
            self._has[n] = has
        if twice != self._twice[n]:
            self.pairs[2 * n] += 1 if twice else -1
            self._twice[n] = twice

    def take(self, n: int, times: int = 1) -> None:
        self.left[n] -= times
        self._note(n)

    def largest(self, most: int) -> int:
        """The largest available length up to most; 0 if none."""
        at = np.flatnonzero(self._has[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths with that sum, the larger one as large as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        small = np.arange(1, total // 2 + 1)
        small = small[total - small < len(self.left)]
        fits = self._has[small] & self._has[total - small]
        if total % 2 == 0 and len(small) and small[-1] == total // 2:
            fits[-1] = self._twice[total // 2]
        return (total - int(small[fits][0]), int(small[fits][0]))

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap."""
        if gap < len(self.left) and self._has[gap]:
            return (gap,)
        found = self.pair(gap)
        if found:
            return found
        first = np.flatnonzero(self._has[1 : max(gap - 1, 1)])[::-1] + 1
        for a in first[self.pairs[gap - first] > 0].tolist():
            self.take(a)  # the pair must do without it
            found = self.pair(gap - a)
            self.take(a, -1)
            if found:
                return (a, *found)
        return None


def patterns(counts: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[list[int], int]]:
    """(lengths of a sequence, largest first; number of such sequences); counts[n] pieces have length n."""
    stock = Available(counts)
    while True:
        opened = stock.largest(capacity)
        if not opened:
            return
        lengths, gap = [opened], capacity - opened
        stock.take(opened)
        while gap:
            found = stock.exact(gap)
            if not found:
                fit = stock.largest(gap)
                if not fit:
                    break
                found = (fit,)
            for n in found:
                stock.take(n)
            lengths += found
            gap -= sum(found)
        used = Counter(lengths)
        more = int(min(stock.left[n] // k for n, k in used.items()))
        if more:
            for n, k in used.items():
                stock.take(n, k * more)
        yield sorted(lengths, reverse=True), more + 1


def slots(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of pieces of one length: the run's first number, its sequences' first id, its times a sequence and its offset there."""
    out: dict[str, list[int]] = {n: [] for n in ("length", "number", "sequence", "times", "offset")}
    taken, sequence = Counter(), 0
    for lengths, many in patterns(counts, capacity):
        offset = 0
        for n, k in sorted(Counter(lengths).items(), reverse=True):
            for name, value in zip(out, (n, taken[n], sequence, k, offset), strict=True):
                out[name].append(value)
            taken[n] += k * many
            offset += n * k
        sequence += many
    order = np.lexsort((out["number"], out["length"]))
    return {n: np.array(v, np.int64)[order] for n, v in out.items()}


# --- the pieces

PIECE = "doc_id long, key long, copy long, piece int, start long, length long, ids_crc32 long, task int, turn long"


class Coder:
    """A tokeniser's ids of texts; by_word looks up each different word (run of bytes without ASCII white space) of the texts at hand once, and tokenises only new ones."""

    def __init__(self, path: str, by_word: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._by_word = Tokenizer.from_file(path), by_word
        self._known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        return (x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _words(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word. Many go through the tokeniser as one text, with a mark between them that no word has."""
        mark = np.array(next(self._encoded([MARK])), "<u4")
        plain = [w for w in words if MARK not in w]
        out: dict[str, bytes] = {}
        texts = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for own, coded in zip(texts, self._encoded([f" {MARK} ".join(t) for t in texts]), strict=True):
            ids = np.array(coded, "<u4")
            at = np.ones(max(len(ids) - len(mark) + 1, 0), bool)
            for k, m in enumerate(mark.tolist()):
                at &= ids[k : k + len(at)] == m
            cut = np.flatnonzero(at).tolist()
            packed = ids.tobytes()
            for w, a, b in zip(own, [0, *(c + len(mark) for c in cut)], [*cut, len(ids)], strict=True):
                out[w] = packed[4 * a : 4 * b]
        rest = [w for w in words if MARK in w]
        out.update(zip(rest, (np.array(x, "<u4").tobytes() for x in self._encoded(rest)), strict=True))
        return [out[w] for w in words]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self._by_word:
            yield from (np.array(x, "<u4") for x in self._encoded(texts))
            return
        known = self._known
        if len(known) > WORDS:
            known.clear()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in known]
        known.update(zip(new, self._words(new), strict=True))
        packed = [known[w] for w in words]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        at = coded.indices.to_numpy()
        many = sizes[at]
        ends = np.cumsum(many)
        # A word's ids lie in the table where its kind's begin.
        shift = (np.cumsum(sizes) - sizes)[at] - ends + many
        out = np.frombuffer(b"".join(packed), "<u4")[np.repeat(shift, many) + np.arange(many.sum())]
        bounds = np.append(0, ends)[split.offsets.to_numpy()].tolist()
        yield from (out[a:b] for a, b in pairwise(bounds))
        for w in new:
            if len(w) > LONGEST:
                del known[w]


_coders: dict[tuple[str, bool], Coder] = {}  # kept by the worker


def _cut(path: str, capacity: int, end: int, with_ids: bool, by_word: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, by_word) not in _coders:
            _coders[path, by_word] = Coder(path, by_word)
        coder = _coders[path, by_word]
        task, turns, row = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 0
        names = [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            texts, ids, keys = (batch.column(c).to_pylist() for c in ("text", "doc_id", "key"))
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHARS):
                    size += len(texts[to] or "")
                    to += 1
                out: list[list] = [[] for _ in names]
                tokens = []
                for k, coded in enumerate(coder.ids([t or "" for t in texts[at:to]]), at):
                    all_ids = np.append(coded, np.uint32(end)).astype("<u4")
                    for piece, start in enumerate(range(0, len(all_ids), capacity)):
                        part = all_ids[start : start + capacity]
                        values = (ids[k], keys[k], (task << 40) + row + k, piece, start, len(part), zlib.crc32(part.tobytes()), task, int(turns[len(part)]))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                        turns[len(part)] += 1
                        if with_ids:
                            tokens.append(part.astype(np.int32))
                kinds = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in PIECE.split(", ")]
                columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*names, *["ids"] * with_ids])
                at = to
            row += len(texts)

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, by_word: bool = False) -> DataFrame:
    """doc_id, key, copy, piece, start, length, ids_crc32, task, turn, and ids if asked for: each document's ids and the end id, cut where they are longer than a sequence.

    copy tells the rows of docs apart. The tokeniser's file must lie at path on
    every executor. by_word may be set for tokenisers that drop white space and
    have no token across it: words come again and again, and each is tokenised once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(_cut(path, capacity, end, with_ids, by_word), PIECE + ", ids array<int>" * with_ids))


def _assigned(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        span = np.int64(1) << 50
        keys = plan["length"] * span + plan["number"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(keys, length * span + number, side="right") - 1
            inside, times = number - plan["number"][at], plan["times"][at]
            sequence, offset = plan["sequence"][at] + inside // times, plan["offset"][at] + inside % times * length
            keep = [c for c in batch.schema.names if c != "number"]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return assign


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with their sequence_id (from 0, gapless) and offset there, without ids."""
    cut = cut.drop("ids")
    held = saved(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in held.groupBy("length").agg(F.sum("n")).collect():  # a row a length
        counts[n] = many
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = held.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(saved(before), ["length", "task"]).withColumn("number", F.col("turn") + F.col("before"))
    names = ["doc_id", "key", "copy", "piece", "start", "length", "ids_crc32"]
    shared = cut.sparkSession.sparkContext.broadcast(slots(counts, capacity))  # bounded by the capacity
    kinds = dict(x.split() for x in PIECE.split(", "))
    return numbered.select(*names, "number").mapInArrow(_assigned(shared), ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, by_word: bool = False) -> DataFrame:
    """doc_id, key, copy, piece, start, length, ids_crc32, sequence_id, offset: a row for every piece of every row of docs."""
    return placed(pieces(docs, path, capacity, end, by_word=by_word), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id, ids and doc_ids of every packed sequence: at most capacity ids, so a group is small."""
    cut = pieces(docs, path, capacity, end, with_ids=True)
    whole = placed(cut, capacity).join(cut.select("copy", "piece", "ids"), ["copy", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return whole.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
