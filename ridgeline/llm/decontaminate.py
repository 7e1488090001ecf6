"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits. Numbers, names (capitalised words that
don't begin a sentence) and units (after a number) become typed placeholders,
the rest is lower-cased; windows of WINDOW canonical tokens are hashed. A
document is contaminated by an item if some passage of it holds at least
``least`` of the item's distinct windows and the slots agree: an item's value
must stand for one value of the document wherever it occurs (in ``least`` of
the places of the values that stand more than once). So questions are
caught whose numbers and names were changed throughout.

A passage that holds 80 % of an item's windows holds one of any 20 % plus one
of them. The rarest windows of each item text, of that number, are its keys;
what item_ids a text has is looked up in the result. All documents
are scanned against a bit map of the keys (fixed size, broadcast), what hits
is hash-joined with the keys, and only documents that share a key with an item
are read again and aligned with it.

Windows with fewer than two literal tokens are hashed with their values, so
that tables of numbers don't match each other.

Defined results: null texts match nothing; items of fewer than WINDOW tokens
are not looked for; repeated documents and items are each found, one row per
(doc_id, item_id); a null id stays null, and documents without one are told
apart by their text; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import maybe_among, row_key, saved
from ridgeline.llm.text import combined, pieces, window_hash, words
from ridgeline.llm.text import rolling as _rolling

WINDOW = 5
#: Bits in the map of key windows.
KEY_BITS = 1 << 26
#: Items that go to one document row.
HANDFUL = 64
#: Words that count as a unit after a number (fixed values).
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres"
    " mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres gallon gallons"
    " s sec second seconds min minute minutes h hour hours day days week weeks month months year years"
    " percent dollar dollars euro euros cent cents usd eur gbp kmh mph c f k degrees degree w kw v a hz khz mhz ghz j kj cal kcal n pa bar"
).split()
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?:;\n\""]] = True
NUM, NAME, UNIT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _unit_hashes() -> np.ndarray:
    out = []
    for u in UNITS:
        data = np.frombuffer(u.encode(), np.uint8)
        out.append(window_hash(_rolling(data), np.array([0]), np.array([len(data)]))[0])
    return np.array(out, np.uint64)


_UNIT_HASHES = _unit_hashes()


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(canonical, literal, kind, start, end, of) of a piece's tokens; kind 0 is literal, 1 number, 2 name, 3 unit."""
    literal, start, end, of = words(data, offsets, separators=_SEPARATORS)
    if not len(start):
        zero = np.zeros(0, np.int64)
        return literal, literal, zero, zero, zero, np.zeros(len(offsets), np.int64)
    row = np.searchsorted(offsets, start, side="right")
    first = np.ones(len(start), bool)
    first[1:] = row[1:] != row[:-1]
    number = _DIGIT[data[start]]
    glued = np.zeros(len(start), bool)
    glued[1:] = number[1:] & number[:-1] & ~first[1:] & (start[1:] - end[:-1] == 1) & np.isin(data[start[1:] - 1], (44, 46))
    keep = np.flatnonzero(~glued)  # 1,000.5 is one number
    last = np.append(keep[1:], len(start)) - 1
    end = end[last]
    literal, start, number, first = literal[keep], start[keep], number[keep], first[keep]
    whole = np.flatnonzero(last > keep)
    if len(whole):
        literal[whole] = window_hash(_rolling(data), start[whole], end[whole])
    of = np.searchsorted(start, offsets)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    opening = first.copy()
    opening[1:] |= breaks[start[1:]] > breaks[end[:-1]]
    lead = data[start]
    after = data[np.minimum(start + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & ~first[1:] & np.isin(literal[1:], _UNIT_HASHES)
    kind = np.where(number, 1, np.where(unit, 3, np.where(capital & ~opening, 2, 0)))
    return np.choose(kind, [literal, np.full_like(literal, NUM), np.full_like(literal, NAME), np.full_like(literal, UNIT)]), literal, kind, start, end, of


def windows(canon: np.ndarray, literal: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hash of every WINDOW tokens in a row."""
    out = combined(canon, WINDOW)
    plain = np.convolve(kind == 0, np.ones(WINDOW, np.int64), "valid")[: len(out)] if len(out) else np.zeros(0)
    return np.where(plain >= 2, out, combined(literal, WINDOW)) if len(out) else out


def _row_windows(text: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in pieces(text):
        canon, literal, kind, _, _, of = canonical(data, offsets)
        hashes = windows(canon, literal, kind)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            yield np.unique(hashes[a : max(a, b - WINDOW + 1)])


def _hashed(spots=None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, hash): each text's distinct windows, with spots only those that the bit map holds."""
        bits = None if spots is None else spots.value
        for batch in batches:
            found = []
            for w in _row_windows(batch.column("text")):
                if bits is not None:
                    at = w % np.uint64(KEY_BITS)
                    w = w[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                found.append(w)
            counts = [len(w) for w in found]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["id", "hash"])

    return emit


def _kept(least: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, doc, text, items in zip(*[batch.column(c).to_pylist() for c in ("id", "doc_id", "text", "items")], strict=True):
                mine = _one(text)
                for x in items:
                    hit = aligned(mine, _one(x["item"]), least)
                    if hit:
                        out.append((key, doc, x["print"], *hit))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "doc_id", "print", "n_windows", "n_matched", "containment", "slot_agreement", "verbatim"])

    return align


def _one(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, kinds, literals) of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    canon, literal, kind, _, _, _ = canonical(data, np.array([0, len(data)]))
    return windows(canon, literal, kind), kind, literal


def aligned(doc: tuple, item: tuple, least: float) -> tuple | None:
    """(windows of the item, matched, containment, slot agreement, verbatim) of the best passage, if it is contaminated.

    Stretches of the document are as long as the item and half as much again.
    Wherever one holds enough of the item's different windows, their most
    frequent offset places a copy of the item, and its slots are compared: each
    place of the item with the nearest window that it can stand for. Stretches
    with more different windows than those beside them are also compared
    whole, in whatever order their windows stand. The best that agrees counts.
    """
    of_item: dict[int, list[int]] = defaultdict(list)
    for i, h in enumerate(item[0].tolist()):
        of_item[h].append(i)
    total = len(of_item)
    at = np.flatnonzero(np.isin(doc[0], item[0]))
    if not total or not len(at):
        return None
    hashes, size = doc[0][at].tolist(), len(item[0])
    ends = np.searchsorted(at, at + size * 3 // 2 + WINDOW, side="right").tolist()
    at, need = at.tolist(), least * total
    counts, inside, hi = [], Counter(), 0
    for lo, end in enumerate(ends):
        while hi < end:
            inside[hashes[hi]] += 1
            hi += 1
        counts.append(len(inside))
        inside[hashes[lo]] -= 1
        if not inside[hashes[lo]]:
            del inside[hashes[lo]]
    best, offsets, peaks, rise = None, set(), set(), 0
    for lo, count in enumerate(counts):
        if lo and count > counts[lo - 1]:
            rise = lo
        if rise is not None and (lo + 1 == len(counts) or counts[lo + 1] < count):
            peaks.add(rise)
            rise = None
    for lo, (end, count) in enumerate(zip(ends, counts, strict=True)):
        if count < need or best == (total, 1.0, True):
            continue
        met: set[int] = set()
        first = last = lo
        for k in range(lo, end):
            before = len(met)
            met.add(hashes[k])
            if before < need <= len(met):
                first = k + 1
            if len(met) == count:
                last = k + 1
                break
        offset = Counter(j - i for j, h in zip(at[lo:first], hashes[lo:first], strict=True) for i in of_item[h]).most_common(1)[0][0]
        tries = []
        if lo in peaks:
            tries.append([(_nearest(of_item[h], j - offset), j) for j, h in zip(at[lo:last], hashes[lo:last], strict=True)])
        if offset not in offsets:
            offsets.add(offset)
            slack = size // 2 + WINDOW
            x, y = bisect_left(at, offset - slack), bisect_left(at, offset + size + slack)
            near = [(_nearest(of_item[h], j - offset), j) for j, h in zip(at[x:y], hashes[x:y], strict=True)]
            taken: dict[int, int] = {}
            for i, j in sorted(near, key=lambda p: abs(p[1] - offset - p[0])):  # noqa: B023
                if abs(j - offset - i) <= slack:
                    taken.setdefault(i, j)
            tries.append(list(taken.items()))
        for places in tries:
            matched = len({int(item[0][i]) for i, _ in places})
            if matched >= need and (best is None or (matched, 1.0, True) > best):
                agreement, verbatim = _slots(doc, item, places)
                if agreement >= least:
                    best = max(best or (0, 0.0, False), (matched, agreement, verbatim))
    return best and (total, best[0], best[0] / total, best[1], best[2])


def _slots(doc: tuple, item: tuple, places: list[tuple[int, int]]) -> tuple[float, bool]:
    """(slot agreement, verbatim) of windows of the item and windows of the document that stand for them."""
    pairs: dict[tuple, Counter] = defaultdict(Counter)
    for i, j in {(i + x, j + x) for i, j in places for x in range(WINDOW)}:
        if item[1][i]:
            pairs[int(item[1][i]), int(item[2][i])][int(doc[2][j])] += 1
    repeated = [c for c in pairs.values() if sum(c.values()) > 1]  # a value that stands once agrees with itself
    slots = sum(sum(c.values()) for c in repeated)
    agreement = sum(max(c.values()) for c in repeated) / slots if slots else 1.0
    return agreement, all(set(c) == {value} for (_, value), c in pairs.items())


def _nearest(places: list[int], want: int) -> int:
    k = bisect_left(places, want)
    return min(places[max(k - 1, 0) : k + 1], key=lambda i: abs(i - want))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """key (``row_key``), doc_id, item_id, n_windows, n_matched, containment, slot_agreement, verbatim of contaminated rows, each judged by its own text."""
    text = F.col("text").cast("string")
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("print")).distinct()
    items = benchmark.select(F.xxhash64(text).alias("id"), text.alias("text")).filter("text is not null").distinct()
    held = items.mapInArrow(_hashed(), "id long, hash long").withColumnRenamed("id", "print").distinct()
    held = saved(held)
    often = held.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(Window.partitionBy("print").orderBy("items", "hash"))
    n = F.count(F.lit(1)).over(Window.partitionBy("print"))
    keys = held.join(often, "hash").withColumns({"rank": rank, "n": n}).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("hash", "print")
    keys = saved(keys)
    bits = np.zeros(KEY_BITS // 64, np.uint64)
    spot = F.col("hash").bitwiseAND(F.lit(KEY_BITS - 1))
    words_ = keys.select(F.shiftright(spot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int")).alias("bit"))
    found = words_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most KEY_BITS / 64 rows
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    rows = docs.select(row_key().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = rows.select("id", "text").mapInArrow(_hashed(docs.sparkSession.sparkContext.broadcast(bits)), "id long, hash long")
    pairs = saved(hits.join(keys, "hash").select("id", "print").distinct())
    # A document that shares keys with many items is aligned with them a handful at a time.
    turn = F.floor((F.row_number().over(Window.partitionBy("id").orderBy("print")) - 1) / HANDFUL).alias("turn")
    asked = pairs.select("id", "print", turn).join(items.withColumnsRenamed({"id": "print", "text": "item"}), "print")
    asked = asked.groupBy("id", "turn").agg(F.collect_list(F.struct("print", "item")).alias("items"))
    near = maybe_among(rows, pairs, "id").join(asked, "id")
    schema = "key long, doc_id long, print long, n_windows long, n_matched long, containment double, slot_agreement double, verbatim boolean"
    out = near.mapInArrow(_kept(least), schema)
    return out.join(named, "print").select("key", "doc_id", "item_id", *out.columns[3:])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, containment, slot_agreement, verbatim of each contaminated document and item."""
    out = contaminated_rows(docs, benchmark, least)
    best = F.max(F.struct("containment", "slot_agreement", "n_matched", "n_windows", "verbatim")).alias("x")
    unnamed = F.when(F.col("doc_id").isNull(), F.col("key")).alias("unnamed")
    return out.groupBy("doc_id", unnamed, "item_id").agg(best).select("doc_id", "item_id", "x.n_windows", "x.n_matched", "x.containment", "x.slot_agreement", "x.verbatim")
