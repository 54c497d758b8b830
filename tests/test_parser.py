import pytest
from hypothesis import given
from hypothesis import strategies as st

from tupelo import ParseError, parse
from tupelo.plans.spec import AggRef, ColRef, Literal, Predicate

GOOD = [
    "SELECT * FROM CUSTOMER",
    'SELECT CUSTOMER.cid,CUSTOMER.gender FROM CUSTOMER WHERE CUSTOMER.gender="1"',
    "SELECT A.x FROM A,B WHERE A.id=B.id,A.x<=B.y,A.z!=B.z",
    'SELECT DISTINCT A.x,MAX(A.y) FROM A WHERE A.t>="a b\t\'" GROUPBY A.x ORDERBY A.x,MAX(A.y) DESC'.replace("\t'", "\t"),
    "SELECT FLIGHTS.from,FLIGHTS.to FROM FLIGHTS ORDERBY FLIGHTS.from",
    "SELECT COUNT(A.x),SUM(A.x),MIN(A.x),AVG(A.x) FROM A",
]


@pytest.mark.parametrize("text", GOOD)
def test_accepts_and_prints_back(text):
    spec = parse(text)
    assert parse(str(spec)) == spec


def test_parts():
    q = parse('SELECT DISTINCT A.x\n FROM A,B\nWHERE A.id=B.id,B.t<"9" GROUPBY A.x ORDERBY A.x ASC')
    assert q.distinct and q.tables == ("A", "B") and q.select == (ColRef("A", "x"),) and not q.descending
    assert q.where == (Predicate(ColRef("A", "id"), "=", ColRef("B", "id")), Predicate(ColRef("B", "t"), "<", Literal("9")))
    assert parse("SELECT MAX(MIN(A.x)) FROM A").select == (AggRef("MAX", AggRef("MIN", ColRef("A", "x"))),)
    assert parse(r'SELECT * FROM A WHERE A.x="a\"b\\c"').where[0].right == Literal(r"a\"b\\c")
    assert parse("SELECT * FROM select_").tables == ("select_",)


BAD = [
    ("SELECT x FROM A", 1, 10),
    ("SELECT * FROM A WHERE A.x=1", 1, 27),
    ("SELECT * FROM A WHERE A.x='1'", 1, 27),
    ("select * FROM A", 1, 1),
    ("SELECT * FROM A;", 1, 16),
    ('SELECT *\nFROM A\nWHERE "1"=A.x', 3, 7),
    ('SELECT * FROM A WHERE A.x<>"1"', 1, 27),
    ("SELECT * FROM A GROUP BY A.x", 1, 17),
    ("SELECT * FROM A ORDERBY", 1, 24),
    ("SELECT FROM A", 1, 8),
    ("SELECT * FROM A,", 1, 17),
    ("SELECT * FROM A ORDERBY A.x GROUPBY A.x", 1, 29),
    ("SELECT COUNT(*) FROM A", 1, 14),
    ('SELECT * FROM A WHERE A.x="é"', 1, 27),
    ("", 1, 1),
]


@pytest.mark.parametrize("text,line,column", BAD)
def test_rejects_with_a_place(text, line, column):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert (e.value.line, e.value.column) == (line, column)


@given(st.text(alphabet='SELECTFROM WHERE*.,=<>!"()a_1\n', max_size=40))
def test_any_text_parses_or_raises(text):
    try:
        parse(text)
    except ParseError:
        pass
