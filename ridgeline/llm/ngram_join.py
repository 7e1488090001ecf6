"""Jaccard self-join of n-gram sets by prefixes under several global token orders.

Two sets with Jaccard similarity of at least t share, under any global order
of tokens, a token among the first n - ceil(t n) + 1 of each. Here every order
has the tokens of only one set first (no other set can share those), so sets
with enough unique tokens leave at once; then the rarest come first in one
order, and hashes decide in the others. Candidates must share prefix tokens
under every order.

Candidates are kept as groups, not pairs: under the first order sets that share
a prefix token get one label (components of stars around each token's smallest
set), under the next order only sets with equal labels are joined again, and so
on; a linked pair always keeps equal labels. Linked sets differ in size by less
than 1 - t, so a group is cut into views, each of a size class and the next
smaller one; a set stands in two, and a linked pair in one at least. Views are
then verified exactly, from the texts, by the 64-bit hashes of all tokens. A
view of more than BLOCK sets is dealt as pairs of blocks, and a task gives back
a forest of links, never all pairs.

Sets with equal tokens are one node from the start, so copies cost one row
each. The exchange of tokens that finds the candidates is packed: tasks send,
for each token partition, arrays of 4-byte fingerprints, and get back only those
that several sets hold. There a token is told apart by its partition and
fingerprint; two that fall together can only add candidates. A set's name has
64 bits. A task has one token partition. Common tokens, those that more than
COMMON of a few thousand sets hold, are known to be shared: they skip the
partition of the token, which they could fill, and go to that of the set. How
often they stand there decides only their place in the first order.

Defined results: null or wordless text has an empty set, is linked with
nothing and is its own component; fewer words than n make one token; repeated
rows are copies; null doc_id is ignored as a name of a component; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, maybe_among, row_key, saved, surely_not_among
from ridgeline.llm.graph import components
from ridgeline.llm.text import mix, shingle_sets

ORDERS = 3
#: Sets in a block; tokens in a partition of the exchange, and its fewest partitions.
BLOCK = 512
PART_TOKENS = 2_000_000
#: Tokens that are packed at a time.
PACK_TOKENS = 500_000
LEAST_PARTS = 16
#: Sets that common tokens are looked for in, about, and the share of them that holds one.
LOOK = 8192
COMMON = 0.01


def _node(tokens: np.ndarray) -> int:
    """A set's 64-bit name as a signed integer."""
    both = mix(np.array([tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens + np.uint64(7)))]))
    return int(mix(both[:1] * np.uint64(3) + both[1:]).view(np.int64)[0])


def _named(k: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), _node(s) if len(s) else None) for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([x[1] for x in sets], pa.int64()), pa.array([x[0] for x in sets], pa.int64())], ["doc_id", "key", "node", "n_shingles"])

    return name


_PACK = "part int, at int, node long, n long, nodes binary, counts binary, prints binary, classes binary"


def _pack(part: int, at: int, node: int | None, n: int | None, *arrays: np.ndarray | None) -> tuple:
    return (part, at, node, n, *[None if a is None else a.tobytes() for a in arrays])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PACK.split(", ")])


def _dealt(k: int, parts: int, common: Broadcast):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's sets, cut by token partition: nodes, tokens of each, fingerprints; common tokens by set partition, with their class."""
        known, classes = common.value
        for batch in batches:
            sets = {}
            for s in shingle_sets(batch.column("text"), k):
                if len(s):
                    sets.setdefault(_node(s), s)
            if not sets:
                continue
            nodes, sizes = np.fromiter(sets, np.int64, len(sets)), np.array([len(s) for s in sets.values()])
            every = list(sets.values())
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), PACK_TOKENS)), len(sizes)))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = _packs(nodes[lo:hi], every[lo:hi], known, classes, parts)
                if rows:
                    yield _batch(rows)

    return deal


def _packs(nodes: np.ndarray, sets: list[np.ndarray], known: np.ndarray, classes: np.ndarray, parts: int) -> list[tuple]:
    tokens = np.concatenate(sets)
    of, out = np.repeat(np.arange(len(nodes)), [len(s) for s in sets]), []
    if len(known):
        spot = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        hot = known[spot] == tokens
        if hot.any():
            out = _sent_on(nodes, of[hot], tokens[hot], classes[spot[hot]], parts)
            of, tokens = of[~hot], tokens[~hot]
    if not len(tokens):
        return out
    part = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.uint32)
    order = np.argsort(part, kind="stable")
    of, part, prints = of[order], part[order], tokens[order].astype(np.uint32)
    new = np.ones(len(order), bool)
    new[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order))).astype(np.uint32)
    edges = np.append(np.flatnonzero(np.diff(part[first].astype(np.int64), prepend=-1)), len(first))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        end = first[b] if b < len(first) else len(order)
        out.append(_pack(int(part[first[a]]), 0, None, None, nodes[of[first[a:b]]], counts[a:b], prints[first[a] : end], None))
    return out


def _sent_on(nodes: np.ndarray, of: np.ndarray, tokens: np.ndarray, classes: np.ndarray, parts: int) -> list[tuple]:
    """Packs for the partitions of the sets, one for each of them and token partition."""
    to, at = np.mod(nodes, parts)[of], ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((of, at, to))
    of, to, at, prints, classes = of[order], to[order], at[order], tokens[order].astype(np.uint32), classes[order]
    cuts = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
        first = np.flatnonzero(np.diff(of[a:b], prepend=-1))
        counts = np.diff(np.append(first, b - a)).astype(np.uint32)
        out.append(_pack(int(to[a]), int(at[a]), None, 1, nodes[of[a:b][first]], counts, prints[a:b], classes[a:b]))  # n marks them
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            out.setdefault(r["part"], []).append(r)
    return out


def _joined(rows: list[dict], name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def _shared(parts: int):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each token partition what several nodes hold, sent on by node."""
        for at, rows in _gathered(batches).items():
            once_known = [r for r in rows if r["classes"] is not None]
            if once_known:  # common tokens are where they belong
                yield _batch([tuple(r[x.split()[0]] for x in _PACK.split(", ")) for r in once_known])
            rows = [r for r in rows if r["classes"] is None]
            if not rows:
                continue
            nodes, counts, prints = _joined(rows, "nodes", np.int64), _joined(rows, "counts", np.uint32), _joined(rows, "prints", np.uint32)
            _, once = np.unique(nodes, return_index=True)  # copies in other batches bring the same tokens
            keep = np.zeros(len(nodes), bool)
            keep[once] = True
            of = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
            mask = keep[of]
            of, prints = of[mask], prints[mask]
            _, back, held = np.unique(prints, return_inverse=True, return_counts=True)
            held = held[back]
            mask = held > 1
            of, prints = of[mask], prints[mask]
            classes = np.minimum(np.log2(held[mask]) * 8, 255).astype(np.uint8)
            to = np.mod(nodes, parts)
            order = np.lexsort((of, to[of]))
            of, prints, classes = of[order], prints[order], classes[order]
            if not len(of):
                continue
            first = np.flatnonzero(np.diff(of, prepend=-1))
            many = np.diff(np.append(first, len(of))).astype(np.uint32)
            owner = of[first]
            edges = np.append(np.flatnonzero(np.diff(to[owner], prepend=-1)), len(first))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x, y = first[a], first[b] if b < len(first) else len(of)
                out.append(_pack(int(to[owner[a]]), at, None, None, nodes[owner[a:b]], many[a:b], prints[x:y], classes[x:y]))
            yield _batch(out)

    return share


_CANDIDATE = "node long, n long, " + ", ".join(f"prefix{i} array<long>" for i in range(ORDERS))


def _prefixed(percent: int):
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes whose prefixes hold shared tokens, with those under each order."""
        for rows in _gathered(batches).values():
            sizes = {r["node"]: r["n"] for r in rows if r["node"] is not None}
            packs = [r for r in rows if r["node"] is None]
            if not packs:
                continue
            nodes, counts, prints = _joined(packs, "nodes", np.int64), _joined(packs, "counts", np.uint32), _joined(packs, "prints", np.uint32)
            classes = _joined(packs, "classes", np.uint8)
            at = np.repeat([r["at"] for r in packs], [len(r["prints"]) // 4 for r in packs]).astype(np.uint64)
            tokens = (at << np.uint64(32)) | prints.astype(np.uint64)
            _, of = np.unique(nodes, return_inverse=True)
            names = np.zeros(of.max() + 1, np.int64)
            names[of] = nodes
            owner = np.repeat(of, counts)
            hot = np.repeat([r["n"] is not None for r in packs], [len(r["prints"]) // 4 for r in packs])
            keep = ~hot  # common tokens come from every batch that holds a copy of the set
            some = np.flatnonzero(hot)
            some = some[np.lexsort((tokens[some], owner[some]))]
            new = np.ones(len(some), bool)
            new[1:] = (owner[some[1:]] != owner[some[:-1]]) | (tokens[some[1:]] != tokens[some[:-1]])
            keep[some[new]] = True
            owner, tokens, classes = owner[keep], tokens[keep], classes[keep]
            order = np.argsort(owner, kind="stable")
            owner, tokens, classes = owner[order], tokens[order], classes[order]
            edges = np.searchsorted(owner, np.arange(len(names) + 1))
            out = []
            for i, node in enumerate(names.tolist()):
                n, (a, b) = sizes[node], edges[i : i + 2].tolist()
                need = n + (-percent * n // 100) + 1 - (n - (b - a))
                if need > 0:
                    mine = tokens[a:b]
                    keys = [mix(mine + np.uint64(i)) for i in range(1, ORDERS)]
                    orders = [np.lexsort((mine, classes[a:b])), *[np.argsort(x) for x in keys]]
                    out.append((node, n, *[mine[o[:need]].view(np.int64) for o in orders]))
                if len(out) == 2000 or out and i == len(names) - 1:
                    columns = list(zip(*out, strict=True))
                    lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *lists], [x.split()[0] for x in _CANDIDATE.split(", ")])
                    out = []

    return prefix


def _stars(entries: DataFrame, *keys: str) -> DataFrame:
    """Edges from each node to the smallest node with the same keys."""
    hubs = entries.groupBy(*keys).agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return entries.join(saved(hubs), list(keys)).select(F.col("node").alias("a"), "b").distinct()


def _tokens(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names and all tokens of the texts' sets."""
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "n", "tokens"])

    return read


def _verified(percent: int):
    def verify(group: pa.Table) -> pa.Table:
        """A forest of the links among the group's sets."""
        nodes, sizes = group.column("node").to_numpy(), group.column("n").to_numpy()
        lists = group.column("tokens").combine_chunks()
        owner = np.repeat(np.arange(len(nodes)), lists.value_lengths().to_numpy())
        _, token, held = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        mask = held[token] > 1
        owner, token = owner[mask], token[mask]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        g, step = len(nodes), 4096
        both = np.zeros((g, g), np.float32)
        token = np.cumsum(np.diff(token, prepend=token[:1]) != 0) if len(token) else token
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
            a, b = np.searchsorted(token, (lo, lo + step))
            x = np.zeros((g, min(step, int(token[-1]) + 1 - lo)), np.float32)
            np.add.at(x, (owner[a:b], token[a:b] - lo), 1)
            both += x @ x.T
        shared = both.astype(np.int64)
        linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        labels = np.arange(g)
        while True:
            least = np.where(linked, labels[None, :], g).min(1)
            least = np.minimum(least, labels)[np.minimum(least, labels)]
            if (least == labels).all():
                break
            labels = least
        a, b = nodes, nodes[labels]
        keep = a != b
        return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    return verify


def _common(rows: DataFrame, named: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that more than COMMON of about LOOK sets hold, in order, and their classes among all sets.

    They are at most 1 / COMMON times the sets' mean size. Which tokens are
    found changes what is exchanged and the first order, not what is linked.
    """
    many = named.count()
    look = rows.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(many // LOOK, 1))) == 0)
    sets = look.select("text").mapInArrow(_tokens(k), "node long, n long, tokens array<long>").filter("n > 0").dropDuplicates(["node"])
    sets = saved(sets.select("tokens"))
    seen = sets.count()
    held = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(COMMON * seen, 8)).toArrow()
    tokens, n = held.column("token").to_numpy().view(np.uint64), held.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.minimum(np.log2(np.maximum(n[order] * (many / max(seen, 1)), 2)) * 8, 255).astype(np.uint8)


def similar_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key, n_shingles, component_id, first for every row of docs (columns doc_id, text).

    key is the row's ``row_key``, first that of its component's first row (by
    doc_id, null last, then key); null for an empty set.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("key"))
    named = saved(rows.mapInArrow(_named(k), "doc_id long, key long, node long, n_shingles long"))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(-(-total // PART_TOKENS), LEAST_PARTS)
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, named, k))
    dealt = rows.select("text").mapInArrow(_dealt(k, parts, common), _PACK).repartitionById(parts, "part")
    shared = dealt.mapInArrow(_shared(parts), _PACK)
    sizes = named.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"))
    none = F.lit(None).cast("binary")
    sizes = sizes.select(F.pmod("node", F.lit(parts)).cast("int").alias("part"), F.lit(-1).alias("at"), "node", "n", *[none.alias(c) for c in ("nodes", "counts", "prints", "classes")])
    found = saved(shared.unionByName(sizes).repartitionById(parts, "part").mapInArrow(_prefixed(percent), _CANDIDATE))
    groups = components(_stars(found.select("node", F.explode("prefix0").alias("token")), "token"))
    for i in range(1, ORDERS):
        entries = found.join(saved(groups), "node").select("node", "label", F.explode(f"prefix{i}").alias("token"))
        groups = components(_stars(entries, "label", "token"))
    # A bit more than the least ratio of linked sizes, so that a rounded logarithm never parts a pair by two classes.
    size_class = F.floor(F.log(F.col("n")) / log(100 / percent + 1e-9)).cast("int") if percent < 100 else F.col("n")
    views = saved(found.select("node", "n").join(groups, "node").select("node", "label", F.explode(F.array(size_class, size_class + 1)).alias("view")))
    sizes = views.groupBy("label", "view").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = views.join(saved(sizes), ["label", "view"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != own) | (F.col("blocks") == 1))
    members = members.select("node", "label", "view", own.alias("own"), F.explode(other).alias("other"))
    members = members.select("node", "label", "view", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    members = saved(members)
    # One text for each set that has candidates.
    asked = saved(named.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key"))
    texts = maybe_among(rows.select("key", "text"), asked, "key").join(asked, "key", "left_semi").dropDuplicates(["key"])
    sets = saved(texts.select("text").mapInArrow(_tokens(k), "node long, n long, tokens array<long>"))
    links = sets.join(members, "node").groupBy("label", "view", "i", "j").applyInArrow(_verified(percent), "a long, b long")
    labels = components(saved(links))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    of_node = named.filter("node is not null").groupBy("node").agg(F.min(order).alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_node = saved(of_node)
    least = of_node.groupBy("label").agg(F.min("least").alias("least"))
    ids = of_node.drop("least").join(least, "label").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("first"))
    out = named.join(ids, "node", "left")
    return out.select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first")


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (columns doc_id, text)."""
    return similar_rows(docs, k, percent).drop("key", "first")


def keep_first(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The first row of each component of docs, whatever its doc_id; joined is ``similar_rows`` of docs.

    Rows are judged by ``row_key``, so rows without a doc_id and different
    texts under one doc_id are each judged by their text. Of rows equal in
    doc_id and text one stays. Wordless rows without a doc_id all stay.
    """
    keys = joined.filter("doc_id is not null or n_shingles > 0").groupBy("key")
    keys = keys.agg(F.bool_and(F.coalesce(F.col("key") == F.col("first"), F.lit(True))).alias("stays"), F.count(F.lit(1)).alias("n"))
    asked = saved(keys.filter("not stays or n > 1").select(F.col("key").alias("__key"), F.col("stays").alias("__stays")))
    wordless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    marked = docs.withColumn("__key", row_key())
    own = marked.filter(~wordless)
    # Equal rows fall together before they are joined: what many rows share is no large key then.
    near = maybe_among(own, asked, "__key").dropDuplicates(["__key"]).join(asked, "__key", "left").filter("__stays is null or __stays")
    far = surely_not_among(own, asked, "__key").unionByName(marked.filter(wordless))
    return far.select(*docs.columns).unionByName(near.select(*docs.columns))
