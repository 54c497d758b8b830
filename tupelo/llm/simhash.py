"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints. A-Z of a text become lower case; its words' shingles of `width` words, repeats
included, joined by a space, are hashed by XXH64 (seed 42). A bit of the 64-bit fingerprint is 1 if
it is set in over half of the hashes. A text with fewer words has one shingle, all its words; one
without words (or null) has the fingerprint zero, which links like any other.

Self-join. Fingerprints (each once, however many texts share it) are the leaves of a binary trie.
Pairs of nodes go down together: a pair carries the number of bits in which its two paths differ,
and is given up once that exceeds the budget; two leaves that get through are linked. So that the
trie needn't stand in one place, it is built budget + 1 times, each time with another block of bits
on top: two fingerprints within the budget agree in one block at least, so in one of the tries no
bit differs above the block's end, and the subtree below each value of the block is joined by
itself. A subtree with more than `most` leaves is cut: its next `deeper` levels are walked in the
plan, so that each pair of lower nodes within the budget is a task key of its own, and so on with
pairs that still have more than `most` leaves. Nothing is capped.

A fingerprint has at most C(64,1) + C(64,2) = 2080 others within two bits, so links are linear in
the distinct fingerprints; only a spanning forest of each task's links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, fresh_path, id_keys, own_columns, saved, scratch, ship
from .components import components
from .textvec import bytes_of

BITS = 64


def fingerprint_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of texts with so many hashes each, every one at least one."""
    # Bytes of 0 and 1 add up in lanes of eight, up to 255 rows before one could overflow.
    parts = -(-count // 255)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    text = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS).view(np.uint64)
    lanes = np.add.reduceat(ones, first[text] + 255 * nth, axis=0)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, BITS), np.concatenate([[0], np.cumsum(parts)[:-1]]), axis=0, dtype=np.int64)
    return np.packbits(2 * sums > count[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def _fingerprints(texts: list[bytes], width: int, budget: int = 1 << 18) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    rows: list[int] = []
    counts: list[int] = []

    def done() -> None:
        if rows:
            out[rows] = fingerprint_bits(np.array(hashes, np.uint64), np.array(counts))
            hashes.clear(), rows.clear(), counts.clear()

    h = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            own = [h(joined, 42)]
        else:
            end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            start = np.concatenate([[0], end[:-width]]).tolist()
            own = [h(joined[a:b], 42) for a, b in zip(start, (end[width - 1 :] - 1).tolist(), strict=True)]
        rows.append(i)
        counts.append(len(own))
        hashes += own
        if len(hashes) > budget:
            done()
    done()
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fingerprint") -> DataFrame:
    """docs' other columns, without the text, and the fingerprint (long, its 64 bits)."""
    rest = [c for c in docs.columns if c != text]
    schema = [*[f for f in docs.schema.fields if f.name != text]]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(at))
            raw = data.tobytes()
            found = _fingerprints([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], width)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*rest, name])

    out = type(docs.schema)(schema).add(name, "long")
    return docs.mapInArrow(run, out)


def _children(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where each node's right child starts: the first leaf in lo..hi with the bit below depth set."""
    # Leaves are sorted and share what is above, so it is a binary search in each range at once.
    lo, hi = lo.copy(), hi.copy()
    shift = np.uint64(BITS - 1) - depth
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (bits[np.minimum(mid, len(bits) - 1)] >> shift) & np.uint64(1) > 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def trie_links(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: np.ndarray, budget: int, other: tuple | None = None, width: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of leaves within the budget, from the nodes lo..hi, whose leaves agree in the first
    `top` bits, each joined with itself; or with `other` nodes (lo, hi, bits used so far).

    bits: uint64, ascending and distinct in each node. A frontier of node pairs goes down a level at
    a time, `width` pairs at once, the rest waiting, which bounds the memory.
    """
    lo2, hi2, used = other if other else (lo, hi, np.zeros(len(lo), np.int64))
    todo = [(lo, hi, lo2, hi2, used, top.astype(np.uint64))]
    left, right = [], []
    while todo:
        a, b, c, d, n, depth = todo.pop()
        if len(a) > width:
            todo += [tuple(x[width:] for x in (a, b, c, d, n, depth)), tuple(x[:width] for x in (a, b, c, d, n, depth))]
            continue
        same = a == c
        leaves = (b - a == 1) & (d - c == 1) & ~same
        i, j = a[leaves], c[leaves]
        near = np.bitwise_count(bits[i] ^ bits[j]) <= budget
        left.append(i[near])
        right.append(j[near])
        go = ~leaves & ~(same & (b - a == 1)) & (depth < BITS)
        if not go.any():
            continue
        a, b, c, d, n, depth, same = (x[go] for x in (a, b, c, d, n, depth, same))
        p, q, deeper = _children(bits, a, b, depth), _children(bits, c, d, depth), depth + np.uint64(1)
        ok = n < budget
        parts = [(a, p, c, q, n), (p, b, q, d, n), (a, p, q, d, n + 1), (p, b, c, q, n + 1)]
        keep = [np.ones(len(a), bool), np.ones(len(a), bool), ok, ok & ~same]
        step = [np.concatenate([part[k][m] for part, m in zip(parts, keep, strict=True)]) for k in range(5)]
        down = np.concatenate([deeper[m] for m in keep])
        real = (step[0] < step[1]) & (step[2] < step[3])
        todo.append((*[x[real] for x in step], down[real]))
    return np.concatenate(left or [lo[:0]]), np.concatenate(right or [lo[:0]])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        live = root[i] != root[j]
        i, j = i[live], j[live]
    return root


def _rotated(value: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) % np.uint64(BITS)
    back = (np.uint64(BITS) - by) % np.uint64(BITS)
    return np.where(by == 0, value, (value << by) | (value >> back))


def _join_batch(trie: np.ndarray, group: np.ndarray, whole: np.ndarray, side: np.ndarray, value: np.ndarray, starts: list[int], blocks: list[int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole groups: a `whole` one joins itself, in another side 0 joins side 1."""
    bits = _rotated(value, np.array(starts, np.uint64)[trie])
    order = np.lexsort((bits, side, group))
    trie, group, whole, side, value, bits = (x[order] for x in (trie, group, whole, side, value, bits))
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])]))
    end, top = np.append(cut[1:], len(trie)), np.array(blocks, np.int64)[trie[cut]]
    own = whole[cut]
    i, j = trie_links(bits, cut[own], end[own], top[own], budget)
    at = np.flatnonzero((side[cut[1:]] == 1) & (group[cut[1:]] == group[cut[:-1]]))
    if len(at):
        # The walk starts at the block's end again, so it counts the bits in which the nodes' paths differ.
        k, m = trie_links(bits, cut[at], end[at], top[at], budget, (cut[at + 1], end[at + 1], np.zeros(len(at), np.int64)))
        i, j = np.concatenate([i, k]), np.concatenate([j, m])
    root = forest(len(value), i, j)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return value[moved], value[root[moved]]


def _lower(large: DataFrame, budget: int, deeper: int) -> DataFrame:
    """Leaves (trie, key, t, w, depth, low, high, side, f) of pairs of nodes, `deeper` levels further down.

    low and high are the two nodes' paths below the block; where they are the same node, it is paired
    with itself. Each leaf goes to its own lower node in every pair with one within the budget.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << deeper) if m.bit_count() <= budget])
    spent, same = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))), F.col("low") == F.col("high")
    within = F.filter(masks, lambda m: F.bit_count(m) + F.col("spent") <= budget)
    # As many bits as there are left of the 64.
    own = F.expr(f"shiftrightunsigned(shiftleft(t, w + depth), 64 - {deeper})")
    down = large.withColumns({"spent": spent, "same": same, "own": own}).withColumn("mask", F.explode(within))
    path = lambda node, bits: F.shiftleft(node, deeper).bitwiseOR(bits)
    mine, other = F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high")), F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low"))
    down = down.withColumns({"mine": path(mine, F.col("own")), "other": path(other, F.col("own").bitwiseXOR(F.col("mask")))})
    side = F.when(F.col("same"), (F.col("mine") > F.col("other")).cast("int")).otherwise(F.col("side"))
    first = F.when(side == 0, F.col("mine")).otherwise(F.col("other"))
    second = F.when(side == 0, F.col("other")).otherwise(F.col("mine"))
    return down.select("trie", "key", "t", "w", (F.col("depth") + deeper).alias("depth"), first.alias("low"), second.alias("high"), side.alias("side"), "f")


def node_pairs(distinct: DataFrame, budget: int = 2, most: int = 1 << 18, deeper: int = 4) -> DataFrame:
    """Leaves by the pair of nodes in which they are joined: trie, key, depth, low, high, side and f, no
    pair with more than `most` leaves. distinct: one long column f. Within a scratch."""
    blocks = [BITS // (budget + 1) + (k < BITS % (budget + 1)) for k in range(budget + 1)]
    starts = [sum(blocks[:k]) for k in range(budget + 1)]
    tries = distinct.select("f", F.posexplode(F.array(*[F.lit(s) for s in starts])).alias("trie", "start"))
    width = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("trie") + 1)
    turned = F.expr("CASE WHEN start = 0 THEN f ELSE shiftleft(f, start) | shiftrightunsigned(f, 64 - start) END")
    leaves = tries.select("f", "trie", turned.alias("t"), width.alias("w")).withColumn("key", F.expr("shiftrightunsigned(t, 64 - w)"))
    zero = F.lit(0).cast("long")
    leaves = leaves.select("trie", "key", "t", "w", F.lit(0).alias("depth"), zero.alias("low"), zero.alias("high"), F.lit(0).alias("side"), "f")
    pair, out = ["trie", "key", "depth", "low", "high"], None
    while True:
        # As each large pair has that many leaves, there are few, yet the join is left to Spark.
        large = saved(leaves.groupBy(*pair).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*pair), "large")
        done = large.isEmpty()
        small = (leaves if done else leaves.join(large, pair, "left_anti")).select(*pair, "side", "f")
        out = small if out is None else out.union(small)
        if done:
            return out
        leaves = saved(_lower(leaves.join(large, pair, "left_semi"), budget, deeper), "lower")


def hamming_links(distinct: DataFrame, budget: int = 2, most: int = 1 << 18, deeper: int = 4) -> DataFrame:
    """Links (u, v), saved, whose components are those of all pairs within the budget. distinct: one long column f.

    Null values of f aren't allowed; an empty table gives an empty table.
    """
    with scratch(distinct.sparkSession):
        return saved(_joined(node_pairs(distinct, budget, most, deeper), budget), "found", keep=True)


def _joined(usual: DataFrame, budget: int) -> DataFrame:
    blocks = [BITS // (budget + 1) + (k < BITS % (budget + 1)) for k in range(budget + 1)]
    starts = [sum(blocks[:k]) for k in range(budget + 1)]
    group = F.xxhash64("trie", "key", "depth", "low", "high")
    dealt = usual.withColumn("g", group).repartition("g").sortWithinPartitions("g", "trie", "key", "depth", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def join(table: pa.Table) -> pa.RecordBatch:
            trie, key, depth, low, high, side, f = (table.column(n).to_numpy() for n in ("trie", "key", "depth", "low", "high", "side", "f"))
            # Groups are told apart by number: rows come sorted by group.
            new = np.concatenate([[True], (trie[1:] != trie[:-1]) | (key[1:] != key[:-1]) | (depth[1:] != depth[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            u, v = _join_batch(trie, np.cumsum(new), low == high, side, f.view(np.uint64), starts, blocks, budget)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            g = batch.column("g").to_numpy()
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if cut:
                yield join(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column("g")[0].as_py() != g[-1]:
                yield join(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield join(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2, most: int = 1 << 18) -> DataFrame:
    """One row per row of docs: doc_id, text_hash (long), fingerprint (long), component_id, root (long).

    root is the component's least fingerprint, and so tells components apart even without ids.

    component_id is the smallest doc_id of the rows whose fingerprints are reachable over links of
    `budget` differing bits or fewer. Equal texts have equal fingerprints, so copies count once in
    the join and get their component by a join on the fingerprint. Null texts and texts without
    words have the fingerprint zero; a null doc_id is kept, and component_id is null only if all of
    the component's are. Repeated rows stay as they are. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    base = own_columns(docs, doc_id, text).toDF("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    with scratch(docs.sparkSession):
        rows = saved(fingerprints(base, "text", width), "fingerprints", keep=True)
        distinct = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
        nodes = fresh_path(docs.sparkSession, "nodes")
        with scratch(docs.sparkSession, whole=True):
            roots = saved(components(hamming_links(distinct.select(F.col("fingerprint").alias("f")), budget, most)), "nodes", nodes)
        linked = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
        linked = saved(linked, "roots")
        # Written, so that a large component's fingerprints can be split in the join below.
        least = saved(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
        label = saved(linked.join(least, "root").select("fingerprint", "component_id", "root"), "labels", keep=True)
    return rows.join(label, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id", "root")


def hex16(column: str = "fingerprint") -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id (null last),
    and of those the smallest hash of its text, stays, once. All columns are kept."""
    found = near_duplicates(docs, doc_id, text, width, budget)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))
    stays = found.groupBy("root").agg(best.alias("b")).select(F.col("b.doc_id").alias("_stays_id"), F.col("b.text_hash").alias("_stays_hash"))
    keys = [free_name(docs, f"_own{k}") for k in ("id", "null", "hash")]
    stays = stays.select(*[c.alias(k) for c, k in zip((*id_keys(F.col("_stays_id")), F.col("_stays_hash")), keys, strict=True)])
    own = docs.withColumns(dict(zip(keys, (*id_keys(F.col(f"`{doc_id}`")), F.xxhash64(F.col(f"`{text}`"))), strict=True)))
    # The join has brought rows of one id and text together, so dropping repeats takes no further shuffle.
    return own.join(stays, keys).dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
