import gzip
import hashlib
import io

import duckdb
import pytest

from tupelo.llm import queries, warc


def big(i):
    return f"<p>{i} ünïcode\r\n" + "long text " * 30


def test_round_trip_and_edges(spark):
    rows = [(i, f"http://h/{i} ü", big(i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "small"), (103, "u", "small"), (3, "u", big(3)), (3, "u", big(3)), (None, "u", big(1)), (200, "x", "WARC/1.1\r\n\r\n" * 40), (201, "x", "é" * 2_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as digest", "1 as first").repartition(4)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((k for k, _, x in rows if x == h and k is not None), default=None)
        again = len(raw) >= 100 and i is not None and first < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_normaliser_makes_members_that_stand_alone(spark, tmp_path):
    whole, members = (tmp_path / "whole").as_uri(), (tmp_path / "members").as_uri()
    df = spark.createDataFrame([(i, "u", big(i % 3)) for i in range(20)], "page_id long, url string, html string").repartition(3)
    index = warc.normalise(spark, warc.write(df, whole), whole, members)
    rows = index.collect()
    assert len(rows) == 20
    for r in rows:
        raw = (tmp_path / "members" / r["name"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        fields, _, block = next(warc.records(warc.Inflater(io.BytesIO(gzip.compress(gzip.decompress(raw))))))
        assert fields["warc-page-key"] == r["page_key"] and fields["warc-type"] == r["record_type"]
        assert (b"".join(block).decode() == big(int(r["page_key"]) % 3)) == (r["record_type"] == "response")
    full = {r["page_key"]: r["payload"] for r in warc.read(index, members, run_bytes=500).collect()}
    assert len(full) == 20 and sum(v is not None for v in full.values()) == 3


def test_cut_off_streams_raise():
    one = warc.record("response", "1", None, b"body" * 100, 400, "x")
    packed = gzip.compress(one)
    with pytest.raises(EOFError):
        [list(b) for _, _, b in warc.records(warc.Inflater(io.BytesIO(packed[:-20])))]
    with pytest.raises(EOFError):
        [list(b) for _, _, b in warc.records(warc.Inflater(io.BytesIO(gzip.compress(one[:-300]))))]
    with pytest.raises(ValueError):
        list(warc.records(warc.Inflater(io.BytesIO(gzip.compress(b"junk\n")))))
    two = gzip.compress(one) + gzip.compress(one)
    assert [b"".join(b) for _, _, b in warc.records(warc.Inflater(io.BytesIO(two)))] == [b"body" * 100] * 2
    assert list(warc.records(warc.Inflater(io.BytesIO(b"")))) == []


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.sql(queries.OP2_SQL).fetchall())
    assert sorted(map(tuple, queries.op2_warc(spark, sf).collect())) == want


def test_ids_are_unique_and_keys_come_back_as_they_were(spark, tmp_path):
    whole, members = (tmp_path / "whole").as_uri(), (tmp_path / "members").as_uri()
    keys = ["", " padded ", "a%20b", "line\r\nbreak: x", "ü", None, None, "twice", "twice", "z1", "z2"]
    rows = [(k, "u", big(1) if k in ("twice", "z1", "z2") else big(2) if k is None else f"own {k}") for k in keys] + [("b1", "u", big(3)), ("b2", "u", big(3))]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").selectExpr("*", "1 as key", "'x' as digest", "2 as name").repartition(3)
    index = warc.normalise(spark, warc.write(df, whole), whole, members)
    assert sorted(str(r.page_key) for r in index.collect()) == sorted(map(str, [*keys, "b1", "b2"]))
    ids, refers = [], {}
    for r in index.collect():
        raw = (tmp_path / "members" / r["name"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        fields = next(warc.records(warc.Inflater(io.BytesIO(raw))))[0]
        ids.append(fields["warc-record-id"])
        refers[r["page_key"]] = fields.get("warc-refers-to"), fields.get("warc-refers-to-page-key"), fields["warc-record-id"]
    assert len(set(ids)) == len(ids) == len(rows)
    assert refers["b2"][:2] == (refers["b1"][2], "b1")  # named by its id
    assert refers["z2"][:2] == refers["z1"][:2] == (None, "twice")  # two records have that key and payload
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got["z1"] == ("revisit", "twice") and got["b2"] == ("revisit", "b1") and got[""] == ("response", None) and got["line\r\nbreak: x"][0] == "response"


def test_read_back_is_dealt_by_bytes_and_each_file_has_its_index(spark, tmp_path):
    whole, members = (tmp_path / "whole").as_uri(), (tmp_path / "members").as_uri()
    df = spark.range(400).selectExpr("id page_id", "'u' url", "concat('<p>', id, repeat(sha2(cast(id as string), 256), 20)) html").repartition(2)
    index = warc.normalise(spark, warc.write(df, whole), whole, members)
    assert {p.name for p in (tmp_path / "members").iterdir() if p.name.endswith(".idx.parquet")} == {f"{r['name']}.idx.parquet" for r in index.select("name").distinct().collect()}
    total = index.agg({"length": "sum"}).first()[0]
    for size in (total // 2, total // 20):
        got = warc.read(index, members, run_bytes=size)
        assert got.rdd.getNumPartitions() == -(-total // size)
        assert got.count() == 400
    none = warc.normalise(spark, spark.createDataFrame([], "name string"), whole, members)
    assert none.count() == 0 and warc.read(none, members).count() == 0
