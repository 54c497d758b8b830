import duckdb
import pytest

from tupelo import AnalysisError, Catalog, CatalogError, Engine
from tupelo.__main__ import main
from tupelo.sources.datagen import generate, statistics
from tupelo.sources.ddl import parse_det, parse_stats
from tupelo.sources.sink import write_result
from tupelo.sources.text import load_text, read_text
from tupelo.streaming import stream

LIBRARY = {
    "READER": "4\n64\nrid INTEGER 150 PK 4\nsince INTEGER 30 NK 4\nname STRING 12 NK 24\ntown STRING 16 NK 32\n",
    "LOAN": "5\n40\nlid INTEGER 180 PK 4\nrid INTEGER 150 FK 4\ncopy INTEGER 160 FK 4\ndays INTEGER 60 NK 4\nfee REAL 9 NK 4\n",
    "COPY": "3\n24\ncopy INTEGER 160 PK 4\nbook INTEGER 120 FK 4\nshelf STRING 8 NK 16\n",
    "BOOK": "3\n60\nbook INTEGER 120 PK 4\npages INTEGER 900 NK 4\ntitle STRING 26 NK 52\n",
}
TIES = "LOAN.rid=READER.rid,LOAN.copy=COPY.copy,COPY.book=BOOK.book"
ALL = "FROM LOAN,READER,COPY,BOOK"
#: A scan, a filter, joins of two to four tables, ranges, groups, distinct rows and orders; the last column: of the order.
QUERIES = [
    ("SELECT * FROM BOOK", None),
    ('SELECT READER.rid,READER.name FROM READER WHERE READER.since>="12"', None),
    ('SELECT LOAN.lid,LOAN.fee FROM LOAN WHERE LOAN.fee<"4.5",LOAN.days!="7"', None),
    ("SELECT READER.name,LOAN.days FROM LOAN,READER WHERE LOAN.rid=READER.rid", None),
    ("SELECT * FROM READER,LOAN,COPY WHERE LOAN.rid=READER.rid,COPY.copy=LOAN.copy", None),
    (f"SELECT * {ALL} WHERE {TIES}", None),
    (f'SELECT BOOK.title,READER.town {ALL} WHERE {TIES},BOOK.pages>"200",BOOK.pages<="600"', None),
    (f'SELECT READER.since,MAX(BOOK.pages),COUNT(LOAN.lid) {ALL} WHERE {TIES},LOAN.days<"40" GROUPBY READER.since', None),
    ("SELECT DISTINCT LOAN.days FROM LOAN", None),
    ("SELECT COPY.book FROM COPY GROUPBY COPY.book,COPY.shelf", None),
    (f'SELECT * {ALL} WHERE {TIES},BOOK.pages>"300" ORDERBY BOOK.pages', "pages"),
    ("SELECT BOOK.title,BOOK.pages FROM BOOK ORDERBY BOOK.pages DESC", "pages"),
]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    for name, det in LIBRARY.items():
        (folder / f"{name}.det").write_text(det)
        assert main(["gen", str(folder), name, "100", "--seed", "5"], spark) == 0
    return folder


def in_sql(text):
    """The dialect's words as SQL's."""
    where, order = text.partition(" WHERE ")[2], ""
    for word in (" GROUPBY", " ORDERBY"):
        head, found, tail = (where or text).partition(word)
        if found:
            order = f" {word[1:6]} BY{tail}"
            where, text = (head, text) if where else (where, head)
    return (text.partition(" WHERE ")[0] + (f" WHERE {where.replace(',', ' AND ')}" if where else "") + order).replace('"', "'")


@pytest.mark.parametrize("text,key", QUERIES)
def test_scenarios_match_duckdb(spark, library, text, key):
    engine = Engine(spark, Catalog(spark).defined_dir(str(library)))
    con = duckdb.connect()
    for t in LIBRARY:
        con.sql(f"create view {t} as select * from '{library}/{t}.parquet/*.parquet'")
    df = engine.query(text)
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(con.sql(in_sql(text)).fetchall())
    if key:
        values = [r[df.columns.index(key)] for r in got]
        assert values == sorted(values, reverse=text.endswith("DESC"))


def test_generator(spark, library):
    t = parse_det("T", "4\n20\na INTEGER 50 PK 4\nb INTEGER 7 FK 4\nc STRING 3 NK 6\nd REAL 10 NK 4\n")
    made = generate(spark, t, 50, seed=1)
    rows = made.collect()
    assert sorted(r.a for r in rows) == list(range(50))
    assert all(0 <= r.b < 7 and len(r.c) == 3 and r.c.islower() and 0 <= r.d < 10 for r in rows)
    assert rows == generate(spark, t, 50, seed=1).collect() != generate(spark, t, 50, seed=2).collect()
    assert statistics(made, t).distinct == (50, len({r.b for r in rows}), 50, 50)
    with pytest.raises(CatalogError):
        generate(spark, t, 51)
    s = Catalog(spark).defined_dir(str(library)).stats["READER"]
    assert s.rows == 100 and s.distinct == (100, 30, 100, 100)


@pytest.mark.parametrize("det", ["", "1\n", "x\n1\n", "2\n8\na INTEGER 5 PK 4\n", "1\n8\na BLOB 5 PK 4\n", "1\n8\na INTEGER PK 4\n", "2\n8\na INTEGER 5 PK 4\na INTEGER 5 NK 4\n"])
def test_bad_definitions(det):
    with pytest.raises(CatalogError):
        parse_det("T", det)


def test_statistics_files():
    assert parse_stats("T", "10\n5\t10\n", 2).distinct == (5, 10)
    for bad in ("", "10\n", "10 2\n1 2\n", "10\n1\n", "10\n1 x\n"):
        with pytest.raises(CatalogError):
            parse_stats("T", bad, 2)


def test_text_tables(spark, tmp_path):
    schema = parse_det("T", "3\n20\na INTEGER 50 PK 4\nb STRING 7 FK 4\nc REAL 3 NK 6\n").schema
    (tmp_path / "t.txt").write_text("1\tx  0.5\t\n  2 y\t1e2 extra\n\n")
    got = load_text(spark, str(tmp_path / "t.txt"), schema, str(tmp_path / "t.parquet")).collect()
    assert [tuple(r) for r in got] == [(1, "x", 0.5), (2, "y", 100.0)]
    (tmp_path / "d.txt").write_text("1|x y|0.5\n")
    assert [tuple(r) for r in read_text(spark, str(tmp_path / "d.txt"), schema, "|").collect()] == [(1, "x y", 0.5)]
    (tmp_path / "bad.txt").write_text("1 x\n")
    with pytest.raises(Exception, match="values wanted"):
        read_text(spark, str(tmp_path / "bad.txt"), schema).collect()


def test_result_file_and_command_line(spark, library, tmp_path, monkeypatch, capsys):
    df = spark.createDataFrame([(1, None, 0.5), (2, "b", None)], "a int, b string, c float").coalesce(1)
    write_result(df, str(tmp_path / "r.txt"), ["T.a", "T.b", "MAX(T.c)"])
    assert (tmp_path / "r.txt").read_text() == "T.a  T.b  MAX(T.c)  \n1\t-NULL-\t0.5\t\n2\tb\t-NULL-\t\n"
    (tmp_path / "q.sql").write_text(f'SELECT DISTINCT READER.since\nFROM READER\nWHERE READER.since<"3"\nORDERBY READER.since')
    assert main(["run", str(tmp_path / "q.sql"), str(tmp_path / "o.txt"), "8000", "800", "y", "--data", str(library)], spark) == 0
    first, *lines = (tmp_path / "o.txt").read_text().split("\n")
    known = Catalog(spark).defined_dir(str(library)).table("READER").where("since < 3").select("since").distinct().count()
    assert first == "READER.since  " and lines == [f"{k}\t" for k in sorted(int(x) for x in lines if x.strip())] + [""] and len(lines) == known + 1
    assert "estimated rows: READER" in capsys.readouterr().out
    monkeypatch.setattr("builtins.input", lambda *_: "0")
    assert main(["run", str(tmp_path / "q.sql"), str(tmp_path / "p.txt"), "--data", str(library)], spark) == 1
    assert not (tmp_path / "p.txt").exists()
    (tmp_path / "bad.sql").write_text("SELECT *")
    assert main(["run", str(tmp_path / "bad.sql"), str(tmp_path / "p.txt"), "-y", "--data", str(library)], spark) == 2
    assert "line 1" in capsys.readouterr().err


def test_catalog(spark, tmp_path):
    spark.range(3).write.orc(str(tmp_path / "o"))
    c = Catalog(spark).orc("O", str(tmp_path / "o"))
    assert Engine(spark, c).query("SELECT O.id FROM O").count() == 3
    assert c.analyze("O").rows == 3 and c.names() == ["O"]
    with pytest.raises(CatalogError):
        c.table("o")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "cast(id % 2 as int) as k").write.parquet(src)
    c = Catalog(spark).register("S", spark.readStream.schema("id long, k int").parquet(src)).register("T", spark.createDataFrame([(0, "even")], "k int, name string"))
    e = Engine(spark, c)
    out = stream(e, 'SELECT S.id,T.name FROM S,T WHERE S.k=T.k,S.id>"3"')
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(4, "even"), (6, "even"), (8, "even")]
    for bad in ("SELECT T.k FROM T", "SELECT S.id FROM S ORDERBY S.id"):
        with pytest.raises(AnalysisError):
            stream(e, bad)
