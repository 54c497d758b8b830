import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tupelo.llm import token_orc as o

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def direct(texts, path=PATH):
    return [x.ids for x in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAé'sDΣσİ1²٣ \t\n\x0b\x1c\x85\xa0 ́|<>_-世界😀")), max_size=25) | st.sampled_from(["it's <|endoftext|>x", "<|startoftext|>", "Á ́b", "ΣΑΣ ΣΑΣ", "Œuvre ŠĲ ŉ ĸ ſ", "a\u2028b", "it's don'T 'test 'REx ll'll"]), max_size=5))
def test_encoding_by_runs_is_that_of_whole_texts(texts):
    ids, at = o.Encoder.of(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == direct(texts)


def test_memory_is_bounded_and_other_tokenizers_get_whole_texts():
    e = o.Encoder(PATH, most_known=12)
    texts = [f"word{i} and, more{i} Été été, {chr(0x400 + i)}" for i in range(50)]
    for t in texts:
        ids, _ = e.encode([t])
        assert ids.tolist() == direct([t])[0]
        assert len(e.words) <= 30
    byte = public_tokenizers.path("byte_bpe_50k.json")
    e = o.Encoder(byte)
    assert e.pattern is None
    ids, at = e.encode(["  two  spaces", "", "x"])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == direct(["  two  spaces", "", "x"], byte)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_round_trip(spark, n, tmp_path):
    rows = [(i * 7 % 401, f"Text {i} " + "wörd, " * (i % 50)) for i in range(n)]
    if n > 1:
        rows += [(None, "null id"), (500, None), (501, ""), (502, "long " * 100_000), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as start").repartition(5)
    got = sorted(o.round_trip(df, PATH).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    start = 0
    for r, (i, t), ids in zip(got, want, direct([t or "" for _, t in want]), strict=True):
        own = np.array([*ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    if n > 1:
        path = (tmp_path / "orc").as_uri()
        o.write(df, path, PATH, end_id=2)
        back = o.read(spark, path)
        assert back.where("doc_id = 500").first().ids == [2]
        files = sorted((tmp_path / "orc").glob("part-*.orc"))
        firsts = [pyarrow.orc.read_table(f).column("doc_id").to_pylist() for f in files]
        flat = [x for f in firsts for x in f if x is not None]
        assert flat == sorted(flat)


@pytest.mark.parametrize("same", [None, 7])
@pytest.mark.parametrize("text", ["one text", "text {}"])
def test_a_third_of_all_rows_with_one_id_are_dealt_out(spark, tmp_path, same, text):
    rows = [(same if i % 3 == 0 else 1000 + i, text.format(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = (tmp_path / "orc").as_uri()
    o.write(df, path, PATH)
    back = o.read(spark, path)
    per = [r["count"] for r in back.groupBy("part").count().collect()]
    assert sum(per) == 3000 and max(per) < 700 and len(per) == 8
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in back.collect())
    assert all(a[0] + a[2] == b[0] and (a[1] is not None, a[1]) <= (b[1] is not None, b[1]) for a, b in zip(got, got[1:]) if a[1] is not None and b[1] is not None)
    assert sorted(str(g[1]) for g in got) == sorted(str(r[0]) for r in rows)


def test_files_grow_in_number_with_the_input(spark, tmp_path):
    spark.range(2000).selectExpr("id doc_id", "repeat(sha2(cast(id as string), 256), 30) text").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    size = o.input_bytes(df)
    o.write(df, str(tmp_path / "orc"), PATH, part_bytes=size // 20)
    assert 20 <= len([*(tmp_path / "orc").glob("part-*.orc")]) <= 23
    assert o.input_bytes(spark.createDataFrame([(1, "x")], "doc_id long, text string")) is None
