"""Expressions, functions and parse errors, on constants and small tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyquery.plans.lexer import QueryError
from skyquery.plans.parser import parse, parse_expression
from skyquery.plans.statements import Session, query
from skyquery.plans.syntax import Binary, Call, Literal, Query, Unary


def calc(spark, *texts):
    out = Session(spark).sql("SELECT " + ", ".join(f"{t} AS c{i}" for i, t in enumerate(texts))).first()
    return list(out)


CONSTANTS = [
    ("10/3", 3), ("-7/2", -3), ("2**10", 1024), ("2**-3", 0), ("-2**2", 4), ("7 // 2", 3), ("7 % 3", 1), ("5.5 % 2", 1.5), ("1.0/4", 0.25), ("6 & 3", 2), ("6 | 3", 7), ("6 ^ 3", 5), ("~5", -6), ("0x1F", 31),
    ("'a' + 1.5", "a1.500000"), ("'x' + 3", "x3"), ("1 = 1.0", True), ("1 ~= 1.000001", True), ("'a' < 'b'", True), ("3 IN [1,2,3]", True), ("3 NOT IN (1,2)", True), ("5 BETWEEN 1 AND 5", True),
    ("'abc' LIKE 'a%'", True), ("'abc' LIKE 'a?c'", True), ("'ABC' ILIKE 'ab_'", True), ("'a.c' LIKE 'a.c'", True), ("'abc' LIKE 'a.c'", False), ("'abc' ~ p/a*/", True), ("'xabc' ~ f/abc/", False), ("'xabc' ~ m/ABC/i", True), ("'abc' !~ 'z'", True),
    ("IIF(1>2, 1, 2.5)", 2.5), ("[1,2,3][1]", 2.0), ("'hello'[1]", "e"), ("[1,2,3,4][1:3]", [2.0, 3.0]), ("5 AROUND 4 IN 1", True), ("NOT NOT TRUE", True), ("T AND NOT F", True),
    ("5deg", math.radians(5)), ("(1+2) km", 3000.0), ("1 MJY", 1e-3), ("PI()", math.pi), ("C()", 299792458.0), ("ABS(-3)", 3.0), ("ROUND(-2.5)", -3.0), ("FLOOR(-2.5)", -3.0), ("LOG(1)", 0.0), ("SIGN(-2)", -1.0),
    ("MIN(3,2)", 2.0), ("NEAR(1,1+1e-14)", True), ("INT(-2.7)", -2), ("STRING(1.5)", "1.500000"), ("NORM(COMPLEX(3,4))", 25.0), ("REAL(2i*2i)", -4.0), ("ABS(COMPLEX(3,4))", 5.0), ("ISDEF(1)", True), ("ISNULL([])", True),
    ("STRLEN('é')", 2), ("UPPER('aé')", "Aé"), ("TRIM('\t a \n')", "a"), ("CAPITALIZE('hello\twOrld x')", "Hello\tWorld X"), ("SREVERSE('abc')", "cba"), ("SUBSTR('hello',1,3)", "ell"), ("SUBSTR('hello',-1)", ""), ("SUBSTR('hello',9)", ""), ("REPLACE('aXbX','X','-')", "a-b-"), ("REPLACE('a','','z')", "a"),
    ("DATE(51544.5)", 51544.0), ("TIME(51544.5)", 43200.0), ("YEAR(60324.25)", 2024), ("MONTH(60324.25)", 1), ("DAY(60324.25)", 15), ("WEEKDAY(60324)", 1), ("CDOW(60324)", "Mon"), ("CMONTH(60324)", "Jan"), ("WEEK(60324)", 3), ("CTOD(51544.5)", "2000/01/01/12:00:00"), ("CTIME(51544.5)", "12:00:00"),
    ("DATETIME('2024/01/15/06:00:00')", 60324.25), ("DATETIME('2024-01-15')", 60324.0), ("HMS(1.0)", "03:49:10.987"), ("DMS(-1.0)", "-57.17.44.806"), ("NORMANGLE(-1.0)", 2 * math.pi - 1), ("ANGDIST(0,0,1,0)", 1.0), ("INCONE(0,0,0.1,0,0.2)", True), ("FINDCONE(0,0,1,0,0.2)", -1), ("CONES3([0,0],[1,1,0,0.1],0.2)", True),
    ("ARRSUM([1,2,3])", 6.0), ("MEDIAN([4,1,3,2])", 2.5), ("VARIANCE([1,2,3])", 2 / 3), ("VARIANCE(5)", 0.0), ("AVDEV([1,3])", 1.0), ("ANY([0,2])", True), ("ALL([0,2])", False), ("NTRUE([0,2,3])", 2), ("FRACTILE([4,1,3,2],0.5)", 2.0), ("ARRAY(2,2,3)", [2.0] * 6), ("RESIZE([1,2],3)", [1.0, 2.0, 0.0]), ("NELEM([1,2])", 2), ("NDIM(1)", 0), ("REVERSE([1,2])", [2.0, 1.0]), ("DIAGONAL([7,8])", 7.0),
    ("MEAS_EPOCH_TAI(57754.0)", 57754.0 + 37 / 86400), ("ARRSUM([1,2]*2+1)", 8.0),
]


def test_constants(spark):
    got = calc(spark, *[t for t, _ in CONSTANTS])
    for (text, expected), value in zip(CONSTANTS, got, strict=True):
        if isinstance(expected, float):
            assert value == pytest.approx(expected, rel=1e-12, abs=1e-12), text
        else:
            assert value == expected, text


@pytest.mark.parametrize("text", ["LOG(0)", "LOG(-1)", "SQRT(-1)", "FMOD(1,0)"])
def test_values_that_are_no_numbers(spark, text):
    value = calc(spark, text)[0]
    assert value == -math.inf if text == "LOG(0)" else math.isnan(value)


@pytest.mark.parametrize("text", ["1/0", "1 % 0", "1.0/0", "INT(1e30)", "[1,2][5]"])
def test_errors_at_run_time(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        calc(spark, text)


@pytest.mark.parametrize(
    "text",
    ["SELECT FROM WHERE", "CALC 1 +", "CALC (1", "CALC 'a", "SELECT a FROM t extra junk", "SELECT a FROM t LEFT b", "CALC a = b = c", "UPDATE t a=1", "INSERT INTO t VALUES", "DELETE t", "CREATE TABLE", "ALTER TABLE t", "DROP", "CALC [1", "CALC 1 BETWEEN 2", "SELECT a FROM t GROUPBY", "CALC #", "SELECT a FROM t JOIN u"],
)
def test_malformed(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["'a' * 2", "NOSUCH(1)", "SIN(1,2)", "'a' BETWEEN 1 AND 2", "'x' & 1", "nocolumn", "'a' ~ '('", "gsum(1) + 1 IN [gsum(2)] OR nocolumn"])
def test_rejected_when_compiled(spark, text):
    with pytest.raises(QueryError):
        Session(spark).sql(f"CALC {text}")


def test_syntax_trees():
    assert parse_expression("1 + 2 * 3") == Binary("+", Literal(1, "int"), Binary("*", Literal(2, "int"), Literal(3, "int")))
    assert parse_expression("2 ** 3 ** 2").right == Binary("**", Literal(3, "int"), Literal(2, "int"))
    assert parse_expression("-2 ** 2") == Binary("**", Unary("-", Literal(2, "int")), Literal(2, "int"))
    assert parse_expression("gcount()") == Call("GCOUNT", ())
    made = parse("SELECT a, b AS c FROM t WHERE a > 1 GROUPBY a HAVING gcount() > 1 ORDERBY a DESC LIMIT 5 OFFSET 2 -- comment")
    assert isinstance(made, Query) and made.items[1].alias == "c" and not made.order[0].ascending and made.limit == Literal(5, "int")


class _Model:
    """What integer and double arithmetic gives, in plain Python."""

    @staticmethod
    def apply(op, a, b):
        if isinstance(a, int) and isinstance(b, int):
            return {"+": a + b, "-": a - b, "*": a * b, "/": int(a / b) if b else None, "%": math.fmod(a, b) if b else None}[op]
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else None, "%": math.fmod(a, b) if b else None}[op]


_number = st.one_of(st.integers(-50, 50), st.floats(-50, 50).map(lambda x: round(x, 2)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(_number, st.sampled_from("+-*/%"), _number), min_size=10, max_size=10))
def test_arithmetic_agrees_with_a_model(spark, cases):
    cases = [(a, op, b) for a, op, b in cases if b != 0] or [(1, "+", 1)]
    show = lambda x: f"({x})"
    got = calc(spark, *[f"{show(a)} {op} {show(b)}" for a, op, b in cases])
    for (a, op, b), value in zip(cases, got, strict=True):
        assert value == pytest.approx(_Model.apply(op, a, b), abs=1e-9)


@pytest.fixture(scope="module")
def tables(spark):
    agg = spark.createDataFrame([("A", 10.0, 1), ("A", 20.0, 0), ("B", 30.0, 1), ("B", 40.0, 1), ("C", 50.0, 0), ("C", 60.0, 0)], "CATEGORY string, AMOUNT double, FLAG int")
    dept = spark.createDataFrame([(1, "Engineering"), (2, "Marketing"), (3, "Sales")], "DEPT_ID int, DEPT_NAME string")
    emp = spark.createDataFrame([(101, "Alice", 1), (102, "Bob", 2), (103, "Carol", 1), (104, "Dave", 3)], "EMP_ID int, EMP_NAME string, DEPT_ID int")
    return {"agg": agg, "dept": dept, "emp": emp, "empty": agg.limit(0)}


def run(tables, text):
    return [tuple(r) for r in query(text, **tables).collect()]


def test_aggregates(tables):
    assert run(tables, "SELECT gsum(AMOUNT), gmean(AMOUNT), gmedian(AMOUNT), gcount() FROM agg") == [(210.0, 35.0, 35.0, 6)]
    assert run(tables, "SELECT gsum(AMOUNT) FROM agg WHERE FLAG = 1") == [(80.0,)]
    assert run(tables, "SELECT gproduct(AMOUNT) FROM agg WHERE AMOUNT <= 30") == [(6000.0,)]
    assert run(tables, "SELECT CATEGORY, gsum(AMOUNT) FROM agg GROUPBY CATEGORY ORDERBY CATEGORY") == [("A", 30.0), ("B", 70.0), ("C", 110.0)]
    assert len(run(tables, "SELECT CATEGORY FROM agg GROUPBY CATEGORY HAVING gcount() > 1")) == 3
    assert run(tables, "SELECT CATEGORY FROM agg GROUPBY CATEGORY HAVING gcount() > 2") == []
    assert run(tables, "SELECT gfirst(AMOUNT), glast(AMOUNT), growid(AMOUNT), gaggr(FLAG) FROM agg") == [(10.0, 60.0, 0, [1.0, 0.0, 1.0, 1.0, 0.0, 0.0])]
    assert run(tables, "SELECT CATEGORY, gvariance(AMOUNT) AS v FROM agg WHERE AMOUNT < 15 GROUPBY CATEGORY") == [("A", 0.0)]
    assert run(tables, "SELECT gsum(AMOUNT), gmean(AMOUNT), gall(FLAG), gany(FLAG), gproduct(AMOUNT), gcount() FROM empty") == [(0.0, None, True, False, 1.0, 0)]


def test_joins(tables):
    assert len(run(tables, "SELECT EMP_NAME FROM emp, dept")) == 12
    assert len(run(tables, "SELECT e.EMP_NAME FROM emp e JOIN dept d ON e.DEPT_ID = d.DEPT_ID")) == 4
    made = query("SELECT * FROM emp e JOIN dept d ON e.DEPT_ID = d.DEPT_ID", **tables)
    assert made.columns == ["e.EMP_ID", "e.EMP_NAME", "e.DEPT_ID", "d.DEPT_ID", "d.DEPT_NAME"]
    assert run(tables, "SELECT d.DEPT_NAME, gcount() AS n FROM emp e JOIN dept d ON e.DEPT_ID = d.DEPT_ID GROUPBY d.DEPT_NAME ORDERBY n DESC LIMIT 1") == [("Engineering", 2)]
    assert run(tables, "SELECT EMP_NAME FROM emp WHERE DEPT_ID IN (SELECT DEPT_ID FROM dept WHERE DEPT_NAME LIKE 'S%')") == [("Dave",)]
    # a name that both have is that of the first
    assert run(tables, "SELECT DEPT_ID FROM emp e JOIN dept d ON e.DEPT_ID < d.DEPT_ID WHERE d.DEPT_NAME = 'Marketing' AND e.EMP_NAME = 'Alice'") == [(1,)]


def test_rows_and_limits(tables):
    assert run(tables, "SELECT FROM agg WHERE AMOUNT > 40") == [(4,), (5,)]
    assert run(tables, "SELECT ROWNR() AS r FROM agg WHERE ROWNR() > 3") == [(4,), (5,)]
    assert run(tables, "SELECT gsum(AMOUNT) FROM agg LIMIT 2") == [(30.0,)]
    assert run(tables, "SELECT DISTINCT CATEGORY FROM agg LIMIT 2") == [("A",), ("B",)]
    assert run(tables, "SELECT AMOUNT FROM agg ORDERBY AMOUNT DESC LIMIT 2 OFFSET 1") == [(50.0,), (40.0,)]
    assert run(tables, "SELECT AMOUNT FROM agg OFFSET 4 LIMIT 5") == [(50.0,), (60.0,)]
    with pytest.raises(QueryError):
        query("SELECT AMOUNT FROM agg LIMIT -1", **tables)
    with pytest.raises(QueryError):
        query("SELECT AMOUNT FROM agg HAVING AMOUNT > 1", **tables)
