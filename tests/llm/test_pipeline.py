import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from test_decontaminate import slow as slow_overlaps  # noqa: E402
from test_mixing import m as mixing  # noqa: E402
from test_quality_rules import slow as slow_stats  # noqa: E402
from test_simhash import slow_components, slow_print  # noqa: E402

import corpus_pipeline as c  # noqa: E402
from tupelo.llm import _common, quality_rules  # noqa: E402
from tupelo.llm._common import paired, text_keys  # noqa: E402

SF = "/root/testdata/sf0.001"
words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]  # a small fixture
    for _, stage in c.STAGES:
        docs = c.saved(stage(spark, docs, SF), "test")
        out.append(docs.collect())
    return out, docs


def test_each_stage_matches_brute_force_on_its_own_input(spark, steps):
    (given, good, single, clean, mixed, shards), _ = steps
    fails = {r.doc_id for r in given if (s := slow_stats(r.text))[0] < 50 or 100 * s[4] > 50 * s[0]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert not kept & fails and set(good) <= set(given)
    fine = [r.doc_id for r in given if labels.get(r.doc_id) == 1 and r.doc_id not in fails]
    assert sum(i in kept for i in fine) >= 0.99 * len(fine)
    verdict = {r.doc_id for r in quality_rules.assess(spark.createDataFrame(given), spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert verdict == kept

    rows = sorted(good, key=lambda r: r.doc_id)
    root = slow_components([slow_print(r.text) for r in rows])
    assert sorted(r.doc_id for r in single) == sorted(rows[i].doc_id for i in set(root))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _ in slow_overlaps([(r.doc_id, r.text) for r in single], items)}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if r.doc_id not in leaks)

    sizes, taken = Counter(), Counter()
    text = {r.doc_id: r.text for r in clean}
    for r in clean:
        sizes[r.source] += words(r.text)
    per_doc = defaultdict(int)
    for r in mixed:
        assert r.text in text[r.doc_id]
        taken[r.source] += words(r.text)
        per_doc[r.doc_id] += words(r.text)
    names = sorted(sizes)
    want = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    assert all(abs(taken[s] - w) <= 64 for s, w in zip(names, want))
    assert all(n <= 2 * words(text[i]) for i, n in per_doc.items())

    assert sorted(r[:5] for r in shards) == sorted(map(tuple, mixed))
    by = defaultdict(list)
    for r in shards:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(c.SHARDS)) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run_gives_the_last_stage(spark, steps):
    got = c.run(spark, SF)
    assert got.columns == [*steps[1].columns]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[0][-1]))


def test_stages_keep_odd_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 as shard", "2 as g1", "'x' as _take")
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_stages_take_nulls_repeats_long_texts_and_clashing_names(spark):
    """All stages in turn, over rows with a null in every column, a row that makes up a third, and a very long text."""
    r = random.Random(7)
    plain = lambda n: " ".join(r.choice(["river", "stone", "über", "la", "of", "walk"]) + str(r.randrange(9999)) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(i, plain(r.randint(60, 200)), "en", r.choice(["a", "b", None]), 1) for i in range(60)]
    copied = plain(80)
    rows += [(None, copied, None, "a", None)] * 40
    rows += [(100, None, "en", "b", 2), (101, "", None, "b", None), (102, plain(60_000), None, None, 3), (103, f"{plain(60)} {item} {plain(60)}", "en", "a", 4), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as shard", "'x' as salt", "2 as nth", "3 as fingerprint", "4 as root", "5 as _own0", "6 as h").repartition(4)
    names = docs.columns
    seen = []
    for name, stage in c.STAGES:
        docs = c.saved(stage(spark, docs, SF), "odd")
        assert docs.columns[: len(names)] == names
        seen.append(docs.collect())
    good, single, clean, mixed, shards = seen
    assert sorted(str(x.doc_id) for x in good) == sorted([*map(str, range(60)), *["None"] * 40, "102", "103"])
    assert sorted(str(x.doc_id) for x in single) == sorted([*map(str, range(60)), "None", "102", "103"])
    assert sorted(str(x.doc_id) for x in clean) == sorted([*map(str, range(60)), "None", "102"])
    total = sum(words(x.text) for x in clean)
    assert {x.doc_id for x in mixed} <= {x.doc_id for x in clean} and abs(sum(words(x.text) for x in mixed) - 1.5 * total) < 0.2 * total
    assert sorted(tuple(x)[: len(names)] for x in shards if x.doc_id is not None) == sorted(map(tuple, (x for x in mixed if x.doc_id is not None)))
    by = defaultdict(list)
    for x in shards:
        by[x._shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(x.shard == 1 and x.salt == "x" and x.nth == 2 and x.h == 6 for x in shards)


@pytest.mark.parametrize("alike", [1024, 45, 20])
def test_rows_of_one_id_and_text_are_paired_one_to_one(spark, monkeypatch, alike):
    monkeypatch.setattr(_common, "ALIKE", alike)
    docs = spark.createDataFrame([(None, None, k) for k in range(500)] + [(3, "t", k) for k in range(40)] + [(k, "x", k) for k in range(50, 60)], "doc_id long, text string, nth int").repartition(6)
    found = docs.selectExpr("doc_id", "text", "nth as value").withColumns(text_keys(F.col("text"))).repartition(3)
    out = paired(docs, found, "doc_id", "text", {"value": "got"}).collect()
    assert len(out) == 550 and out[0].asDict().keys() == {"doc_id", "text", "nth", "got"}
    for key in ((None, None), (3, "t")):
        own = [x for x in out if (x.doc_id, x.text) == key]
        assert sorted(x.nth for x in own) == sorted(x.got for x in own) == list(range(len(own)))
    assert all(x.nth == x.got for x in out if x.text == "x")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert _common.one_machine(spark)
    for master, one in (("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://h:7077", False)):
        sc = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None)
        fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
        assert _common.one_machine(fake) == one
        if not one:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                _common.shared_dir(fake)


def test_run_leaves_its_last_table_alone(spark):
    folder = Path(_common.shared_dir(spark).removeprefix("file://"))
    before = {x.name for x in folder.iterdir()}
    c.run(spark, SF)
    assert [x.name.split("-")[1:3] for x in folder.iterdir() if x.name not in before] == [["stage", "shard"]]
