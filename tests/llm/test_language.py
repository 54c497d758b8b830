import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tupelo.llm import language
from tupelo.llm.textvec import pieces


def slow_grams(text, order):
    out = "".join(c.lower() if "A" <= c <= "Z" else " " if ord(c) < 128 and not c.isalpha() else c for c in text or "")
    while "  " in out:
        out = out.replace("  ", " ")
    return [[out[i : i + n] for i in range(len(out) - n + 1)] for n in range(1, order + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aBé ,\n世😀", max_size=30), max_size=6))
def test_ngrams_match_brute_force(texts):
    seen: dict[int, str] = {}
    for a, b, t in pieces(pa.array(texts, pa.string()), most=30):
        for n, (bucket, before) in enumerate(language.ngrams(t, 3, 1 << 40)):
            for k in range(b - a):
                want = slow_grams(texts[a + k], 3)[n]
                got = bucket[before[k] : before[k + 1]].tolist()
                assert len(got) == len(want)
                for g, w in zip(got, want):
                    assert seen.setdefault(g, w) == w
    assert len(set(seen.values())) == len(seen)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out()
    model = language.train(docs.where(~out))
    got = language.identify(docs.withColumn("out", out), model).where("out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in got.doc_id)
    odd = spark.createDataFrame([(1, None, "x", 1.0), (None, "", "y", 2.0), (3, "123 !!", "z", 3.0), (3, "123 !!", "z", 3.0), (4, "der " * 50_000, "l", 4.0)], "doc_id long, text string, lang_pred2 string, _lettered double")
    rows = language.identify(odd, model).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 4 + ["de"]
    assert all(0 <= r.score <= 1 for r in rows)
    none = language.train(docs.limit(0))
    assert none.languages == ()
    assert {r.lang_pred for r in language.identify(docs.limit(3), none).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0
    assert docs.select(F.sum(language.held_out().cast("int"))).first()[0] > 0
    assert np.isfinite(model.rows).all()


def test_posteriors_match_counts_in_dictionaries(spark):
    texts = [(1, "the cat sat on the mat", "en"), (2, "a dog and the cat", "en"), (3, "le chat est là", "fr"), (4, "der Hund und die Katze", "de"), (5, "the end", "en"), (6, None, "fr"), (7, "x", None)]
    buckets = 1 << 16
    model = language.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"), buckets=buckets)
    assert model.languages == ("de", "en", "fr")

    def grams(text):
        t = next(pieces(pa.array([text])))[2]
        return [b for bucket, _ in language.ngrams(t, 3, buckets) for b in bucket.tolist()]

    used = [(t, k) for _, t, k in texts if t is not None and k is not None]
    for asked in ("the cat", "le chien", "die Katze ist da", "q"):
        logs = []
        for k in model.languages:
            seen = [b for t, lang in used if lang == k for b in grams(t)]
            counts = {b: seen.count(b) for b in set(seen)}
            share = sum(lang == k for _, lang in used) / len(used)
            logs.append(math.log(share) + sum(math.log((counts.get(b, 0) + 0.5) / (len(seen) + 0.5 * buckets)) for b in grams(asked)))
        best = max(range(3), key=lambda i: logs[i])
        got, score = model.predict(next(pieces(pa.array([asked])))[2])
        assert got[0] == best
        assert abs(score[0] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-4


def test_too_many_languages_raise(spark):
    rows = spark.createDataFrame([(i, "text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert len(language.train(rows, most_languages=4).languages) == 4
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.train(rows, most_languages=3)
