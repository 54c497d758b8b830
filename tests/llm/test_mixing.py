import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tupelo.llm import _common
from tupelo.llm import mixing as m


def slow_seats(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i), default=None)
        if best is None:
            break
        out[best] += 1
    return out


def test_sainte_lague_matches_highest_quotients():
    r = random.Random(1)
    for _ in range(200):
        votes = [r.choice([0, 1, 10, 53, 53, r.randrange(1000)]) for _ in range(r.randrange(1, 8))]
        caps = [r.randrange(0, 60) for _ in votes]
        seats = r.randrange(0, 100)
        assert m.sainte_lague(np.array(votes), seats, np.array(caps)).tolist() == slow_seats(votes, seats, caps)


def test_targets():
    got = m.targets([100, 100, 100], [5, 2, 1], 1.5, 2)
    assert got[0] == 200 and got[1] == pytest.approx(500 / 3) and got[2] == pytest.approx(250 / 3)
    assert m.targets([0, 0], [5, 2], 1.5, 2) == [0, 0]
    assert m.targets([], [], 1.5, 2) == []


@pytest.mark.parametrize("shard_tokens", [1 << 20, 4000])
def test_mix(spark, shard_tokens):
    r = random.Random(3)
    word = lambda: r.choice(["aa", "b,", "été", " x"])
    rows = [(i, r.choice(["\n", " ", " \t"]).join(word() for _ in range(r.randrange(0, 90))), r.choice(["s1", "s2", "s2", "s2", "Z", None])) for i in range(700)]
    rows += [(7000, None, "s1"), (7001, "", None), (7002, "only", "lonely"), (None, "x y z", "s1"), (7005, "rep eat", "Z"), (7005, "rep eat", "Z"), (7003, "w " * 9000, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'q' as _spans").repartition(3)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, m.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    got = m.plan(df, shard_tokens=shard_tokens).toPandas()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for x in got.itertuples():
        s = x.source if isinstance(x.source, str) else None
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s]) and 0 <= x.taken <= 2 * x.size
        taken[s] += x.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 64 * (1 + sizes[s] // shard_tokens) + 1
    key = ["doc_id", "size", "taken", "g1"]
    again = m.plan(df.repartition(6), shard_tokens=shard_tokens).toPandas()
    assert got[key].sort_values(key, ignore_index=True).equals(again[key].sort_values(key, ignore_index=True))
    out = m.mixed(df, shard_tokens=shard_tokens)
    assert out.columns == df.columns
    by = Counter()
    texts = {(i, s): t for i, t, s in rows}
    for x in out.collect():
        assert x.text in texts[(x.doc_id, x.source)]
        by[x.doc_id] += n(x.text)
    mine = Counter()
    for x in got.itertuples():
        mine[None if np.isnan(x.doc_id) else int(x.doc_id)] += x.taken
    assert {k: v for k, v in mine.items() if v} == dict(by)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.plan(df).count() == 0 and m.mixed(df).count() == 0


def slow_targets(sizes, weights, ratio, most):
    """The level at which weights times it, none over most times its size, add up to ratio times all."""
    goal = min(ratio, most) * sum(sizes)
    low, high = 0.0, 2.0 * most * max(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, most * n) for w, n in zip(weights, sizes)) < goal else (low, mid)
    return [min(high * w, most * n) for w, n in zip(weights, sizes)]


@pytest.mark.parametrize("fan", [2, 4096])
def test_taken_words_match_a_plain_apportionment(spark, fan):
    """Every document's count, from words in lists; only the hashes that deal and order them are Spark's."""
    r = random.Random(12)
    block, shard_tokens, seed = 4, 60, 17
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(r.randrange(0, 25))), r.choice("aabc")) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = m.plan(df, block=block, shard_tokens=shard_tokens, seed=seed, fan=fan)
    got = {x.doc_id: x.taken for x in plan.collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows})
    sizes = [sum(size[i] for i, _, s in rows if s == n) for n in names]
    goal = slow_targets(sizes, (5, 2, 1), 1.5, 2)
    quota = slow_seats(goal, round(sum(goal) / block), [2 * -(-n // block) for n in sizes])
    want = {}
    for k, name in enumerate(names):
        shards = max(1, -(-sizes[k] // shard_tokens))
        own = df.where(F.col("source") == name).withColumns({"g1": F.xxhash64("text"), "nth": F.lit(0).cast("long"), "s": F.lit(k)})
        own = own.withColumn("shard", F.pmod(F.xxhash64("doc_id", "g1", "nth", F.lit(seed)), F.lit(shards).cast("long")))
        own = own.withColumn("at", F.xxhash64("g1", "doc_id", "nth", F.lit(seed + 1))).withColumn("turn", F.xxhash64("s", "shard", F.lit(seed + 2)))
        dealt = defaultdict(list)
        for x in own.collect():
            dealt[x.shard].append(x)
        n = {c: -(-sum(size[x.doc_id] for x in xs) // block) for c, xs in dealt.items()}
        tokens = {c: sum(size[x.doc_id] for x in xs) for c, xs in dealt.items()}
        runs = sorted({c // fan for c in dealt})
        of = {g: [c for c in sorted(dealt) if c // fan == g] for g in runs}
        per_run = slow_seats([sum(tokens[c] for c in of[g]) for g in runs], quota[k], [2 * sum(n[c] for c in of[g]) for g in runs])
        for g, seats in zip(runs, per_run):
            for c, q in zip(of[g], slow_seats([tokens[c] for c in of[g]], seats, [2 * n[c] for c in of[g]])):
                xs = sorted(dealt[c], key=lambda x: (x.at, x.doc_id))
                words = [x.doc_id for x in xs for _ in range(size[x.doc_id])]
                taken = Counter()
                for b in range(n[c]):
                    times = q // n[c] + ((b - xs[0].turn % n[c]) % n[c] < q % n[c])
                    for w in words[b * block : (b + 1) * block]:
                        taken[w] += times
                want |= {x.doc_id: taken[x.doc_id] for x in xs}
    assert got == want


def test_sizes_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(
        r"""
        SELECT doc_id, n AS size, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS source_size
        FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents) ORDER BY doc_id
        """
    ).fetchall()
    from tupelo.llm import queries

    assert [tuple(r) for r in queries.op3_mixing(spark, sf).select("doc_id", "size", "source_size").orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("alike", [1024, 50])
def test_repeated_rows_and_too_many_sources(spark, monkeypatch, alike):
    monkeypatch.setattr(_common, "ALIKE", alike)
    rows = [(None, "one two three", "s")] * 400 + [(i, f"own words {i}", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = m.plan(df, shard_tokens=60, block=1)
    assert plan.groupBy("doc_id", "g1", "nth").count().where("count > 1").count() == 0
    got = plan.agg(F.count("*"), F.sum("taken"), F.max("taken")).first()
    assert got[0] == 600 and abs(got[1] - 1.5 * 1800) <= 1 and got[2] <= 6
    taken = m.mixed(df, shard_tokens=60, block=1)
    assert taken.columns == df.columns
    assert sum(len(x.text.split()) for x in taken.collect()) == got[1]
    with pytest.raises(ValueError, match="more than 2 sources"):
        m.plan(spark.createDataFrame([(i, "x", f"s{i}") for i in range(3)], "doc_id long, text string, source string"), most_sources=2)
