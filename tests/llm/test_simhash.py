import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tupelo.llm import simhash
from tupelo.llm._common import scratch, shared_dir
from tupelo.llm.components import components


def slow_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts(seed=1):
    r = random.Random(seed)
    words = ["Aa", "bé", "c,", "dd", "EE", "f g", "héh"]
    out = [" ".join(r.choices(words, k=r.randint(0, 12))) for _ in range(120)]
    out += [" ".join(r.choices(words, k=900)), "x", " \t\n", "", None, "x", "one two", "a  b\nc"]
    base = r.choices(["w%d" % i for i in range(500)], k=400)
    for _ in range(30):
        own = list(base)
        own[r.randrange(400)] = "new"
        out.append(" ".join(own))
    return out


def test_prints_and_components_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [slow_print(t) for _, t in rows]
    assert [got[i].fingerprint & (1 << 64) - 1 for i in range(len(rows))] == prints
    assert [got[i].component_id for i in range(len(rows))] == slow_components(prints)


def test_trie_join_finds_every_link(spark):
    r = random.Random(3)
    centre = [r.getrandbits(64) for _ in range(40)]
    prints = {c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ r.choice([0, 1 << r.randrange(64)]) for c in centre for _ in range(40)}
    prints = sorted(prints | {0, (1 << 64) - 1, 1 << 63})
    df = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in prints], "f long")
    want = slow_components(prints)
    for most, deeper in ((20_000, 8), (5, 4), (2, 3)):
        roots = {x.node & (1 << 64) - 1: x.root & (1 << 64) - 1 for x in components(simhash.hamming_links(df, most=most, deeper=deeper)).collect()}
        groups = {}
        for p, w in zip(prints, want):
            groups.setdefault(w, set()).add(roots.get(p, p))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_chain_star_and_empty(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 50)] + [(3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 50)}}
    fork = components(spark.createDataFrame([(1, 3), (2, 3), (9, 8)], "u long, v long"))  # 3 has two lesser neighbours
    assert {r.node: r.root for r in fork.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_edges(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, t, "a"), (1, t, "a"), (2, t, "b"), (None, t, "c"), (5, None, "d"), (6, "", "e"), (None, "lonely words here", "f"), (None, "another one is here too", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string").withColumn("fingerprint", F.lit(1))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.root) for r in got.collect()) == [(-1, "f"), (-1, "g"), (1, "a"), (5, "d")]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_majority_is_over_half():
    h = np.array([1, 2, 3, 3], np.uint64)
    assert simhash.fingerprint_bits(h, np.array([2, 2])).tolist() == [0, 3]


def test_a_large_subtree_is_cut_again_until_no_pair_is_large(spark):
    """Ten times `most` leaves agree in their first 30 bits, and in most of the next ones too."""
    r = random.Random(8)
    top, most = r.getrandbits(30) << 34, 60
    middle = [r.getrandbits(6) << 12 for _ in range(6)]
    prints = sorted({top | r.choice(middle) | r.getrandbits(12) for _ in range(14 * most)})[: 10 * most]
    assert len(prints) == 10 * most
    df = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in prints], "f long")
    pairs = simhash.node_pairs(df, most=most)
    sizes = pairs.groupBy("trie", "key", "depth", "low", "high").count()
    assert sizes.agg(F.max("count")).first()[0] <= most
    assert sizes.where("depth > 4").count() > 0
    roots = {x.node & (1 << 64) - 1: x.root & (1 << 64) - 1 for x in components(simhash.hamming_links(df, most=most)).collect()}
    groups = {}
    for p, w in zip(prints, slow_components(prints)):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_too_few_rounds_raise(spark):
    with pytest.raises(RuntimeError, match="no fixed point"):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"), rounds=1)


def test_only_what_results_read_is_left(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    before = {x.name for x in folder.iterdir()}
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted(x.name.split("-")[1] for x in folder.iterdir() if x.name not in before)
    assert left == ["fingerprints", "labels"] and out.count() == 60
    with scratch(spark, whole=True):
        simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({x.name for x in folder.iterdir()}) == len(before) + 2
