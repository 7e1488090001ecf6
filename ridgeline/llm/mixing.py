"""Mixing sources to target weights by the cube method.

Every source gets a target number of words; a document's expected number of
repeats is target / source size. Whole repeats are certain. The fractional
rest is an inclusion probability, and balanced sampling rounds it: within
blocks of a source, a point of probabilities walks along the null space of
the constraints (sum of documents and sum of words stay fixed) until at most
two documents of the block are undecided. Undecided documents of all blocks
meet again in fewer blocks, and so on; only when one block is left for a
source are its last two documents landed on the nearest whole choice.

A block holds a few thousand rows whatever the size of its source, so a source
with a third of all rows is just many blocks. Each level shrinks the
undecided rows about two-thousandfold.

Defined results: null or wordless text has size 0 (and is sampled like any
other, taking 0 words); null source is a source of its own, ordered last;
repeated rows (equal in source, doc_id and text) are one unit of the walk, which
shares what it takes among them evenly; a doc_id alone, or its absence, joins
nothing; an empty table gives an empty result;
a source without words has target 0. Other columns of the input are ignored
by ``cube_mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import numbered, row_key, running, saved, word_count

EPS = 1e-9
#: Documents of each source, spread over the sizes, that wait for the landing.
LANDING = 12
#: Copies of a unit that are written out together.
PIECE = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """A row per source: source, n_docs, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn. The mix
    holds share * all words, divided by weight; a target stops at max_repeat
    times its source's size and what is above goes to the others by weight.
    That fixed point is found in closed form: in order of cap / weight, the
    first source that isn't above its cap fixes the words per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = F.col("source").asc_nulls_last()
    per = running(per, [by_name], {"turn": F.lit(1)})
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = saved(running(per, [F.col("ratio").asc(), by_name], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}))
    every = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    level = (F.col("words") * float(share) - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    fixed = per.join(F.broadcast(every)).withColumn("level", level).filter("ratio >= level").agg(F.min(F.struct("ratio", "source", "level"))["level"].alias("fixed"))
    per = per.join(F.broadcast(fixed))  # one row
    per = per.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("fixed"), F.col("cap"))))
    return per.select("source", "n_docs", "source_size", "weight", "target")


def _walk(size: list[float], p: list[float], rng: np.random.Generator, land: bool) -> list[float]:
    """The flight phase over one block, and with land also the landing; returns the new probabilities."""
    draws = iter(rng.random(len(p) + 4))
    live: list[int] = []
    kept = sorted({int(x) for x in np.linspace(0, len(p) - 1, min(LANDING, len(p)))}) if land and p else []
    for i in range(len(p)):
        if i in kept:
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            scale = max(map(abs, u))
            u = tuple(x / scale for x in u)
            up = min(((1 - p[k]) / x if x > 0 else p[k] / -x) for k, x in zip(live, u, strict=True) if x)
            down = min((p[k] / x if x > 0 else (1 - p[k]) / -x) for k, x in zip(live, u, strict=True) if x)
            step = up if next(draws) * (up + down) < down else -down
            for k, x in zip(live, u, strict=True):
                p[k] += step * x
                p[k] = 0.0 if p[k] < EPS else 1.0 if p[k] > 1 - EPS else p[k]
            live = [k for k in live if 0 < p[k] < 1]
    if land:
        live += kept
        bits = (np.arange(2 ** len(live))[:, None] >> np.arange(len(live))) & 1
        s, q = np.array([size[k] for k in live]), np.array([p[k] for k in live])
        miss = np.abs(bits @ s - s @ q) / max(1.0, s.mean() if len(s) else 1.0) + 0.01 * np.abs(bits.sum(1) - q.sum())
        for k, bit in zip(live, bits[int(np.argmin(miss))].tolist(), strict=True):
            p[k] = float(bit)
    return p


def _flight(seed: int):
    def flight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "spread", "key"], ascending=[False, True, True], kind="stable", ignore_index=True)
        first = pdf.iloc[0]
        key = f"{seed}|{first['source']}|{first['level']}|{first['block']}|{first['blocks']}"
        rng = np.random.default_rng(zlib.crc32(key.encode()))
        p = _walk(pdf["size"].astype(float).tolist(), pdf["p"].tolist(), rng, first["blocks"] == 1)
        return pdf.assign(p=p)[["doc_id", "key", "source", "size", "copies", "source_size", "target", "whole", "spread", "p"]]

    return flight


_STATE = "doc_id long, key long, source string, size long, copies long, source_size long, target double, whole long, spread long, p double"


def cube_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_repeat: float = 3.0, block_rows: int = 4096, seed: int = 7) -> DataFrame:
    """doc_id, key (``row_key``), source, size, source_size, target, times, taken for every row of docs."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    # Equal rows are one unit, however many they are: a hot one can't fill a block.
    sizes = sizes.groupBy("doc_id", "key", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    sizes = saved(sizes.withColumn("spread", F.xxhash64("key", F.lit(seed))))
    whole_sizes = sizes.select("source", (F.col("size") * F.col("copies")).alias("size"))
    targets = source_targets(whole_sizes, weights, share, max_repeat).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    state = sizes.join(targets, sizes["source"].eqNullSafe(targets["of_source"])).withColumn("rate", rate * F.col("copies"))
    whole = F.floor(F.col("rate") + EPS).cast("long")
    state = state.withColumn("whole", whole).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    state = state.withColumn("p", F.when(F.col("p") < EPS, 0.0).otherwise(F.col("p")))
    columns = [x.split()[0] for x in _STATE.split(", ")]
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    n_open = F.col("n_docs")
    level, done = 0, []
    state = state.select(*columns, n_open.alias("n_open"))
    while True:
        done.append(state.filter(~open_).select(*columns))
        blocks = F.ceil(F.col("n_open") / F.lit(block_rows)).cast("long")
        undecided = state.filter(open_).withColumn("blocks", blocks).withColumn("level", F.lit(level))
        undecided = undecided.withColumn("block", F.pmod(F.xxhash64("spread", F.lit(level)), F.col("blocks")))
        walked = saved(undecided.groupBy("source", "block").applyInPandas(_flight(seed), _STATE))
        left = walked.filter(open_).groupBy(F.col("source").alias("of_source")).agg(F.count(F.lit(1)).alias("n_open"))
        if left.isEmpty():
            done.append(walked)
            break
        done.append(walked.filter(~open_))
        state = walked.filter(open_).join(left, F.col("source").eqNullSafe(F.col("of_source"))).select(*columns, "n_open")
        level += 1
        if level > 1:
            done = [_union(done)]
    out = saved(_union(done).withColumn("total", F.col("whole") + F.col("p").cast("long")))
    own = ["doc_id", "key", "source", "size", "source_size", "target"]
    one = out.filter("copies = 1").select(*own, F.col("total").cast("int").alias("times"))
    # Copies become rows again a piece at a time; the pieces of a hot unit are dealt to many tasks.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE))).alias("first")
    many = out.filter("copies > 1").select(*own, "copies", "total", first).repartition("key", "first")
    many = many.select(*own, "copies", "total", F.explode(F.sequence("first", F.least(F.col("first") + PIECE, "copies") - 1)).alias("turn"))
    many = many.select(*own, (F.floor(F.col("total") / F.col("copies")) + (F.col("turn") < F.col("total") % F.col("copies")).cast("int")).cast("int").alias("times"))
    return one.unionByName(many).withColumn("taken", (F.col("size") * F.col("times")).cast("long"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows equal in doc_id and text share the repeats of their key evenly. The
    join is a sort-merge join at every size: what is taken grows with the rows.
    """
    per = mix.groupBy(F.col("key").alias("__mix_id")).agg(F.sum("times").alias("__mix_times"), F.count(F.lit(1)).alias("__mix_rows"))
    per = saved(per.filter(F.col("__mix_times") > 0))
    out = docs.withColumn("__mix_key", row_key()).join(per.hint("merge"), F.col("__mix_key") == F.col("__mix_id"))
    one = out.filter("__mix_rows = 1").withColumn("__mix_turn", F.lit(1).cast("long"))
    many = numbered(out.filter("__mix_rows > 1"), "__mix_id", "__mix_turn")
    own = F.floor(F.col("__mix_times") / F.col("__mix_rows")) + (F.col("__mix_turn") <= F.col("__mix_times") % F.col("__mix_rows")).cast("int")
    again = F.explode(F.when(own > 0, F.sequence(F.lit(1), own.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("__mix_copy")
    return one.unionByName(many).select(*docs.columns, again).select(*docs.columns)
