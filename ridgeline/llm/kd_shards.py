"""Sharding by a K-d tree over document metadata, with a balancing pass over its leaves.

The tree starts with all rows. A node that must hold m shards picks the widest
of its metadata dimensions (its range over the root's range) and is cut there
where m // 2 / m of its bytes lie below, until every leaf is one shard. The
cuts are distributed weighted quantiles: histograms of bytes per node, summed
on the executors and refined between the two bin edges around the wanted
weight. The driver sees bin sums only, at most nodes * BINS rows a job, and a
row's leaf is an expression of its own columns, so no row moves.

Equal texts are one unit: where many rows share a value, the cut goes on among
them by the hash of the text. A cut misses its weight by up to a unit, and the
levels add up, so the leaves are balanced in the end. Units above ``heavy`` of a
shard (at most n_shards / heavy of them, by their sizes) stay in their leaf as
long as it has room and go to the emptiest otherwise; then leaves that are still
too full give the units of their lowest text hashes, a bucket of them at a time,
to those that have room. Shards end within about ``heavy`` of each other,
unless units alone are larger than a shard.

Only a unit above ``whole`` of a shard is cut, by the hash of doc_id: equal
sizes could not hold otherwise. Its pieces are units of their own.

Defined results: null text counts as empty (size 16, CRC 0); null, NaN or
infinite metadata counts as 0; repeated rows get slots of their own; an empty
table gives an empty result; with fewer rows than shards some shards stay
empty; columns of the input may have any names (``with_shard`` replaces shard).
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heapreplace
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import saved

#: A group of equal texts is cut where it is above this share of a shard.
WHOLE = 1.0
#: Units above this share of a shard are placed one by one.
HEAVY = 0.005
#: Pieces for each whole unit of a unit that is cut.
PIECES = 4
#: Buckets of text hashes that a leaf gives away.
BUCKETS = 2048
BINS = 2048
ROUNDS = 2
TOP = float(2**53)


@dataclass
class Cut:
    """The cut of a node: rows below (value, t) go left. The intervals narrow while it is searched."""

    node: int
    left: int
    right: int
    dim: int
    want: float
    lo: list[float]
    hi: list[float]
    at: int = 0
    below: float = 0.0

    def row(self) -> tuple:
        return (self.node, self.left, self.right, self.dim, self.at, *self.lo, *self.hi)


_CUT = [(n, pa.int32()) for n in ("cut_node", "cut_left", "cut_right", "cut_dim", "cut_at")] + [(f"{e}_{n}", pa.float64()) for e in ("lo", "hi") for n in "vt"]


def _joined(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """rows with the cut of their node: at most one row a shard, so the broadcast is bounded."""
    columns = list(zip(*[c.row() for c in cuts], strict=True))
    small = rows.sparkSession.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(_CUT, columns, strict=True)}))
    return rows.join(F.broadcast(small), F.col("node") == F.col("cut_node"), "left")


def _value(dims: list[str]) -> Column:
    return F.element_at(F.array(*[F.col(d) for d in dims]), F.col("cut_dim") + 1)


def _start(rows: DataFrame) -> DataFrame:
    return rows.withColumn("node", F.lit(0))


def _step(rows: DataFrame, cuts: list[Cut], dims: list[str]) -> DataFrame:
    """rows with their node after one more level of cuts."""
    own = [c for c in rows.columns if c != "node"]
    v, t = _value(dims), F.col("__t")
    left = (v < F.col("lo_v")) | (F.col("cut_at") == 1) & (v >= F.col("lo_v")) & (v < F.col("hi_v")) & (t < F.col("lo_t"))
    node = F.when(F.col("cut_node").isNull(), F.col("node")).when(left, F.col("cut_left")).otherwise(F.col("cut_right"))
    return _joined(rows, cuts).select(*own, node.alias("node"))


def _search(rows: DataFrame, cuts: list[Cut], dims: list[str], tolerance: float) -> None:
    """Narrows the cuts until what lies inside their interval weighs less than the tolerance, or is one text hash."""
    open_ = {c.node: c for c in cuts}
    for at in (0, 1):
        for cut in open_.values():
            cut.at = at
        for step_ in range(ROUNDS):
            if not open_:
                return
            names = ((_value(dims), "lo_v", "hi_v"), (F.col("__t"), "lo_t", "hi_t"))[: at + 1]
            inside = F.col("cut_node").isNotNull()
            for x, lo, hi in names:
                inside = inside & (x >= F.col(lo)) & (x < F.col(hi))
            x, lo, hi = names[at]
            binned = F.least(F.floor((x - F.col(lo)) / ((F.col(hi) - F.col(lo)) / BINS)), F.lit(BINS - 1)).cast("int")
            found = _joined(rows, list(open_.values())).filter(inside).groupBy("node", binned.alias("bin")).agg(F.sum("weight"))
            sums: dict[int, dict[int, float]] = {}
            for k, b, w in found.collect():
                sums.setdefault(k, {})[b] = float(w)
            for k, cut in list(open_.items()):
                mine, below, b = sums.get(k, {}), cut.below, 0
                while b < BINS - 1 and below + mine.get(b, 0.0) < cut.want:
                    below += mine.get(b, 0.0)
                    b += 1
                start, step = cut.lo[at], (cut.hi[at] - cut.lo[at]) / BINS
                cut.below, cut.lo[at] = below, start + b * step
                if b < BINS - 1:
                    cut.hi[at] = start + (b + 1) * step
                if mine.get(b, 0.0) <= tolerance or at == 1 and step_ == ROUNDS - 1:
                    if cut.want - below > mine.get(b, 0.0) / 2:
                        cut.lo[at] = cut.hi[at]
                    del open_[k]


def _leaves(rows: DataFrame, n_shards: int, dims: list[str], tolerance: float) -> tuple[DataFrame, list[list[Cut]]]:
    """rows with their leaf as node, and the levels of cuts that lead there.

    A node is named by its first shard. Each level's nodes are written, so that
    a later level's jobs stay one scan and one broadcast join.
    """
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    width: dict[str, float] = {}
    levels: list[list[Cut]] = []
    nodes = {0: n_shards}  # first shard: number of shards
    most = 0.0
    here = _start(rows)
    while any(m > 1 for m in nodes.values()):
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("weight").alias("weight"), *ends).collect()}
        if not stats:
            break
        if not width:
            width = {d: stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"] for d in dims}
            most = float(stats[0]["weight"]) / n_shards * tolerance
        cuts, grown = [], {}
        for k, m in nodes.items():
            if m == 1 or k not in stats:
                grown[k] = 1
                continue
            s = stats[k]
            wide = [(s[f"hi_{d}"] - s[f"lo_{d}"]) / width[d] if width[d] else 0.0 for d in dims]
            dim = wide.index(max(wide))
            lo, hi = float(s[f"lo_{dims[dim]}"]), float(s[f"hi_{dims[dim]}"])
            hi += max(abs(hi), 1.0) * 1e-9
            cuts.append(Cut(k, k, k + m // 2, dim, float(s["weight"]) * (m // 2) / m, [lo, 0.0], [hi, TOP]))
            grown |= {k: m // 2, k + m // 2: m - m // 2}
        if cuts:
            _search(here, cuts, dims, most)
            levels.append(cuts)
            here = saved(_step(here, cuts, dims))
        nodes = grown
    return here, levels


@dataclass
class Plan:
    """Where rows go: pieces of units that are cut, the tree, and what its balancing moved."""

    pieces: dict[float, int]
    levels: list[list[Cut]]
    placed: dict[float, int]
    moved: dict[tuple[int, int], int]


def _mapped(rows: DataFrame, keys: list[str], names: list[tuple[str, pa.DataType]], values: list[tuple]) -> DataFrame:
    """rows with the last of the names, looked up by the others; the table is bounded by shards and buckets."""
    columns = list(zip(*values, strict=True)) or [()] * len(names)
    small = rows.sparkSession.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(names, columns, strict=True)}))
    on = [F.col(k) == F.col(n) for k, (n, _) in zip(keys, names, strict=False)]
    return rows.join(F.broadcast(small), on, "left").drop(*[n for n, _ in names[:-1]])


def _cut_units(rows: DataFrame, pieces: dict[float, int]) -> DataFrame:
    """rows whose text hash names their piece, where their unit is cut."""
    if not pieces:
        return rows
    out = _mapped(rows, ["__t"], [("cut_t", pa.float64()), ("n_pieces", pa.int32())], list(pieces.items()))
    piece = F.floor(F.col("__h") / (F.lit(TOP) / F.col("n_pieces")))
    return out.withColumn("__t", F.when(F.col("n_pieces").isNull(), F.col("__t")).otherwise(_bits(F.xxhash64("__t", piece)))).drop("n_pieces")


def _settled(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (with their leaf as node) with their shard as node."""
    own = [c for c in rows.columns if c != "node"]
    out = _mapped(rows, ["__t"], [("heavy_t", pa.float64()), ("placed", pa.int32())], list(plan.placed.items()))
    out = _mapped(out.withColumn("__b", _bucket()), ["node", "__b"], [("from_node", pa.int32()), ("from_b", pa.int32()), ("moved", pa.int32())], [(*k, v) for k, v in plan.moved.items()])
    return out.select(*own, F.coalesce("placed", "moved", "node").alias("node"))


def _bucket() -> Column:
    return F.floor(F.col("__t") / (TOP / BUCKETS)).cast("int")


def _balanced(loads: list[dict[int, float]], heavy: list[tuple[float, int, float]], mean: float) -> tuple[dict[float, int], dict[tuple[int, int], int]]:
    """(shard of each heavy unit, shard of each bucket that moves) from the light bytes per leaf and bucket and (t, leaf, bytes) of heavy units.

    Heavy units go first, the heaviest first, and stay at home where there is
    room; buckets follow while that brings both shards closer to the mean.
    """
    held = [0.0] * len(loads)
    placed: dict[float, int] = {}
    for t, leaf, w in sorted(heavy, key=lambda x: (-x[2], x[0])):
        to = leaf if held[leaf] + w <= mean else min(range(len(held)), key=lambda i: (held[i], i))
        placed[t] = to
        held[to] += w
    total = [h + sum(x.values()) for h, x in zip(held, loads, strict=True)]
    moved: dict[tuple[int, int], int] = {}
    room = [(-(mean - t), i) for i, t in enumerate(total) if t < mean]
    heapify(room)
    for leaf in sorted(range(len(total)), key=lambda i: (-total[i], i)):
        for b, w in sorted(loads[leaf].items()):
            if total[leaf] <= mean or not room:
                break
            need, to = room[0]
            if w > total[leaf] - total[to]:  # the shards would only change places
                continue
            moved[leaf, b] = to
            total[leaf] -= w
            total[to] += w
            heapreplace(room, (total[to] - mean, to)) if total[to] < mean else heappop(room)
    # What is left are differences of about a heavy unit: the lightest of the fullest shard go to the emptiest.
    homes: list[list[tuple[float, float]]] = [[] for _ in total]
    weight = {t: w for t, _, w in heavy}
    for t, to in placed.items():
        homes[to].append((weight[t], t))
    for _ in range(4 * len(heavy)):
        full, low = max(range(len(total)), key=lambda i: (total[i], -i)), min(range(len(total)), key=lambda i: (total[i], i))
        gap = total[full] - total[low]
        fit = [x for x in homes[full] if x[0] < gap]
        if not fit or gap < mean * 1e-4:
            break
        w, t = min(fit, key=lambda x: (abs(x[0] - gap / 2), x[1]))
        homes[full].remove((w, t))
        homes[low].append((w, t))
        placed[t] = low
        total[full] -= w
        total[low] += w
    return placed, moved


def plan_shards(rows: DataFrame, n_shards: int, dims: list[str], tolerance: float = 0.005, heavy: float = HEAVY, whole: float = WHOLE) -> tuple[DataFrame, Plan]:
    """rows with their shard as node, and the plan; rows has the dimension columns, weight, __t and __h."""
    mean = float(rows.agg(F.sum("weight")).first()[0] or 0) / n_shards
    units = rows.groupBy("__t").agg(F.sum("weight").alias("w"))
    pieces = {r[0]: ceil(r[1] / mean / whole * PIECES) for r in units.filter(F.col("w") > mean * whole).collect()}  # at most n_shards / whole
    here, levels = _leaves(_cut_units(rows, pieces), n_shards, dims, tolerance)
    if not levels:
        return here, Plan(pieces, levels, {}, {})
    units = saved(here.groupBy("node", "__t").agg(F.sum("weight").alias("w")))
    big = [(r["__t"], r["node"], float(r["w"])) for r in units.filter(F.col("w") > mean * heavy).collect()]  # at most n_shards / heavy
    light = units.filter(F.col("w") <= mean * heavy).groupBy("node", _bucket().alias("b")).agg(F.sum("w"))
    loads: list[dict[int, float]] = [{} for _ in range(n_shards)]
    for node, b, w in light.collect():  # at most n_shards * BUCKETS
        loads[node][b] = float(w)
    plan = Plan(pieces, levels, *_balanced(loads, big, mean))
    return _settled(here, plan), plan


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def _bits(x: Column) -> Column:
    return F.shiftrightunsigned(x, 11).cast("double")


def _described() -> tuple[list[Column], list[str]]:
    """Columns __t, __h, weight and the dimensions, all of them functions of text but __h."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    chars = F.char_length(text)
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    columns = [
        size.alias("weight"),
        F.crc32(text.cast("binary")).alias("__crc"),
        _bits(F.xxhash64(text)).alias("__t"),
        _bits(F.xxhash64(F.col("doc_id"), F.lit(11))).alias("__h"),
        _finite(F.log2(size)).alias("__log_size"),
        _finite((size - 16) / F.greatest(chars, F.lit(1))).alias("__char_bytes"),
        _finite(F.log2(chars / lines + 1)).alias("__line_chars"),
    ]
    return columns, ["__log_size", "__char_bytes", "__line_chars"]


def kd_shards(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.005, slot_rows: int = 8192) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    columns, dims = _described()
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns))
    placed = plan_shards(rows, n_shards, dims, tolerance)[0].select("doc_id", F.col("weight").alias("size"), F.col("__crc").alias("text_crc32"), "__h", F.col("node").alias("shard"))
    # Slots: a running number within a fine bucket of the shard, plus the rows in the buckets before it.
    buckets = max(1, -(-rows.count() // (n_shards * slot_rows)))
    placed = placed.withColumn("__bucket", F.floor(F.col("__h") / F.lit(TOP / buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__h", "doc_id", "text_crc32", "size"))
    out = placed.withColumn("turn", turn).join(offsets, ["shard", "__bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("turn") - 1 + F.col("before")).cast("long").alias("slot"))


def with_shard(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.005) -> DataFrame:
    """docs with a column shard (in place of one that it has); texts stay where they are."""
    columns, dims = _described()
    plan = plan_shards(saved(docs.select(*columns)), n_shards, dims, tolerance)[1]
    own = [c for c in docs.columns if c != "shard"]
    # The input's columns travel in a struct, so that their names can't clash with those of the tree.
    out = _cut_units(docs.select(F.struct(*[docs[c] for c in own]).alias("__doc"), *columns), plan.pieces)
    out = _start(out)
    for cuts in plan.levels:
        out = _step(out, cuts, dims)
    if plan.levels:
        out = _settled(out, plan)
    return out.select("__doc.*", F.col("node").alias("shard"))
