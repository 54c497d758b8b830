import random

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tupelo.llm import quality_rules as q
from tupelo.llm.textvec import pieces

WS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, now = [], ""
    for c in text:
        if c in WS:
            out, now = (out + [now] if now else out), ""
        else:
            now += c
    return out + [now] if now else out


def slow(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


def fast(texts):
    out = []
    for _, _, t in pieces(pa.array(texts, pa.string()), most=40):
        s = q.rule_stats(t)
        out += np.stack([s[c] for c in q.COUNTS], axis=1).tolist()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAé*| \n\t\r\x0b世", max_size=60), max_size=8))
def test_counts_match_brute_force(texts):
    assert fast(texts) == [slow(t) for t in texts]


def thue_morse(k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_counts_are_exact_where_polynomial_hashes_collide():
    for k in (9, 10, 11, 12):
        x, y = thue_morse(k)
        texts = [f"{x}\n{y}", f"{x} {x} {x} z {y} {y} {y}", f"{x}\n{y}\n{x}", f"{x} {y} {x} {y}", "plain text\nplain text"]
        assert fast(texts) == [slow(t) for t in texts]


def test_counts_are_exact_whatever_the_hash(monkeypatch):
    """All spans hash alike: what is counted comes from the bytes."""
    monkeypatch.setattr(q.Texts, "spans", lambda self, prefix, start, end, data=None: np.zeros(len(start), np.uint64))
    texts = ["a b c a b c", "one\ntwo\none\n", "x y z w", None, "a a a a", "p q\np q\nr s"]
    assert fast(texts) == [slow(t) for t in texts]


def slow_path(tree, x):
    """Edges from the root to the leaf of x, and what the leaf adds for the rows it holds."""
    feature, cut, left, path = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + (x[feature[node]] > cut[node])
    return path[node]


def test_forest_scores_match_a_walk_down_each_tree():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 0.3, (300, 4))
    f = q.grow(x, trees=25, sample=64)
    for row in [*x[:10], np.ones(4), np.zeros(4)]:
        mean = np.mean([slow_path(tree, row) for tree in zip(f.feature, f.cut, f.left, f.path)])
        assert abs(f.score(row[None])[0] - 2 ** (-mean / f.norm)) < 1e-12
    # Leaves: as deep as their edges, plus the mean path of the rows that they still hold.
    harmonic = lambda n: sum(1 / k for k in range(1, n))
    assert abs(q._unsuccessful(64) - (2 * harmonic(64) - 2 * 63 / 64)) < 0.02


def test_counts_and_base_rules_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(
        r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY doc_id),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
        r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM h WHERE n > 1) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               coalesce(dl.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
               len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
        FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id) ORDER BY doc_id
        """
    ).fetchall()
    from tupelo.llm import queries

    got = queries.op8_quality_rules(spark, sf).select("doc_id", *q.COUNTS, "base_failed").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def frame(spark):
    r = random.Random(2)
    plain = lambda n: " ".join(r.choice(["river", "stone", "über", "la", "of", "walk"]) + str(r.randrange(999)) for _ in range(n))
    rows = [(i, plain(r.randint(60, 400))) for i in range(150)]
    rows += [(1000 + i, " ".join(x + r.choice(["***", "%%%", "$$$"]) for x in plain(100).split())) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "few words"), (None, plain(80)), (0, rows[0][1]), (2003, "a b c " * 40), (2004, plain(30_000))]
    labels = [(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(20)] + [(None, 1), (5, None), (99999, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_verdicts_and_edges(spark):
    rows, docs, labels = frame(spark)
    got = q.assess(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {*range(150), None, 2004}
    assert {r.doc_id for r in got if r.base_failed} == {2000, 2001, 2002, 2003}
    wide = docs.selectExpr("*", "'x' as good", "1 as n_words", "2 as kept")
    again = q.keep(wide, labels)
    assert again.columns == wide.columns
    assert sorted(str(r.doc_id) for r in again.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert q.assess(docs.limit(0), labels).count() == 0
    assert {r.doc_id for r in q.assess(docs, labels.limit(0)).collect() if not r.kept} == {2000, 2001, 2002, 2003}


def test_forest_isolates_the_odd_one():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 0.05, (500, 3))
    f = q.grow(x)
    assert f.score(np.array([[0.9, 0.02, 0.02]]))[0] > f.score(x).max()
    assert q.calibrate(np.array([0.1, 0.2, 0.9]), np.array([True, True, False]), 0.0) == 0.55
    assert q.calibrate(np.array([0.1, 0.2]), np.array([True, True]), 0.0) == float("inf")


def test_drafts_cut_the_box_of_each_node():
    d = q.draft(3, trees=4, height=5, seed=3)
    for feature, cut in zip(d.feature, d.cut):
        box = {0: (np.zeros(3), np.ones(3))}
        for node, (f, at) in enumerate(zip(feature, cut)):
            lo, hi = box[node]
            assert lo[f] <= at <= hi[f]
            under, over = hi.copy(), lo.copy()
            under[f] = over[f] = at
            box[2 * node + 1], box[2 * node + 2] = (lo, under), (over, hi)
        x = np.random.default_rng(1).uniform(0, 1, (200, 3))
        for row, leaf in zip(x, d.leaf(0, x)):
            node = 0
            while node < 31:
                node = 2 * node + 1 + (row[d.feature[0][node]] > d.cut[0][node])
            assert node - 31 == leaf


def test_calibration_by_counts_is_that_of_the_rows():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.05, 0.5):
        score, good = rng.integers(0, 20, 400) / 20, rng.uniform(size=400) < 0.8
        pairs, times = np.unique(np.stack([score, good]), axis=1, return_counts=True)
        assert q.calibrate(score, good, share) == q.calibrate(pairs[0], pairs[1] > 0, share, times)


def test_fit_counts_every_labelled_row(spark):
    """Against all rows at once in numpy, whatever the partitions."""
    _, docs, labels = frame(spark)
    docs = docs.where("doc_id > 0")
    stats = q.statistics(q._hashed(docs, "doc_id", "text"))
    own = stats.where(~q.base_failed()).join(labels.dropna(), "doc_id").toPandas()
    x, good = q.features(own), own["quality"].to_numpy() > 0
    want = q.grow(x[good])
    for given in (stats, stats.repartition(7)):
        forest, cut = q.fit(given, labels)
        for name in ("feature", "cut", "left", "path", "norm"):
            assert np.array_equal(getattr(forest, name), getattr(want, name))
        score = want.score(x)
        assert (score[~good] > cut).all() and (score[good] <= cut).all()


def test_bad_rows_count_however_many_are_labelled(spark):
    """24,000 labels, of which the ten bad ones have the greatest hashes: a sample by hash would lack them."""
    n = 24_000
    last = [r.id for r in spark.range(n).orderBy(F.xxhash64("id", F.lit(7)).desc()).limit(10).collect()]
    words = F.concat_ws(" ", *[F.concat(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9999)).cast("string"), F.when(F.col("id").isin(last), "***").otherwise("")) for k in range(60)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (~F.col("id").isin(last)).cast("int").alias("quality"))
    assert {r.doc_id for r in q.assess(docs, labels).where("NOT kept").collect()} == set(last)
    assert q.keep(docs, labels).count() == n - 10
