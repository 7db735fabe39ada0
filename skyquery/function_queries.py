"""Registered queries of single functions, operators, array expressions and projections, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import regions
from .operators.coordinates import Direction
from .operators.expressions import absolute, arg, conj, evaluate, form_complex, imag, real, reductions
from .operators.image import Image
from .operators.observations.selection import Selection
from .plans.statements import Session
from .queries import _E, _embedding_lattice, _LONG, _MAIN, _observation, query, statement, table

# --- statements ---
statement("query_multi_order", "SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey ORDERBY r.r_name DESC, n.n_name LIMIT 12", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name DESC, n_name LIMIT 12")
statement("query_multi_distinct", "SELECT DISTINCT r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT DISTINCT r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
statement("query_multi_group_order", "SELECT r.r_name AS region, gcount() AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUPBY r.r_name ORDERBY n DESC, region LIMIT 3", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
statement("query_sort", "SELECT s_suppkey, s_nationkey FROM supplier ORDERBY s_nationkey DESC, s_suppkey", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
statement("query_expression_alone", "2**3 + 4*5 - 6/4", "SELECT CAST(27 AS BIGINT) AS expr")
statement("join_unqualified", "SELECT n_name, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey WHERE n_nationkey < 9", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 9")
statement("join_right", "SELECT gcount() AS n FROM nation n RIGHT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND n.n_regionkey = 1", "SELECT count(*) AS n FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
statement("join_full", "SELECT gcount() AS n FROM nation n FULL JOIN region r ON n.n_nationkey = r.r_regionkey + 20", "SELECT count(*) AS n FROM nation FULL JOIN region ON n_nationkey = r_regionkey + 20")

# --- operators ---
statement("expr_real_division", "SELECT p_partkey, p_retailprice / 7 AS d, p_size / 4.0 AS e, p_retailprice // 7 AS f, 7 // 2.0 AS g FROM part", "SELECT p_partkey, round(p_retailprice/7,6) AS d, round(p_size/4.0,6)::DOUBLE AS e, floor(p_retailprice/7) AS f, 3.0::DOUBLE AS g FROM part", 6)
statement("expr_literals", "SELECT gcount() AS n FROM part WHERE TRUE AND NOT FALSE AND (T OR F) AND p_size > 1e1 AND p_brand != \"x\" AND p_size < 0x28", "SELECT count(*) AS n FROM part WHERE p_size > 10 AND p_brand <> 'x' AND p_size < 40")
statement("expr_precedence", "SELECT p_partkey, 2 + 3*p_size**2 - 8/3 AS a, -p_size**2 AS b, p_size > 10 AND p_size < 20 OR p_size = 30 AS c, NOT p_size = 3 AS d FROM part", "SELECT p_partkey, CAST(2 + 3*p_size*p_size - 2 AS BIGINT) AS a, CAST(p_size*p_size AS BIGINT) AS b, (p_size > 10 AND p_size < 20) OR p_size = 30 AS c, p_size <> 3 AS d FROM part")
statement("expr_coercion", "SELECT p_partkey, p_size + 0.5 AS a, p_size = 10.0 AS b, p_brand + p_size AS c, (p_size > 25) + 1 AS d FROM part", "SELECT p_partkey, round(p_size + 0.5,4)::DOUBLE AS a, p_size = 10 AS b, p_brand || CAST(p_size AS VARCHAR) AS c, CAST(CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS BIGINT) AS d FROM part", 4)
statement("expr_patterns", "SELECT gntrue(p_type ~ PATTERN('*STEEL*')) AS a, gntrue(p_type ~ SQLPATTERN('%STEEL%')) AS b, gntrue(p_name ~ REGEX('^[a-m]')) AS c, gntrue(p_brand ~ f/Brand#1./) AS d FROM part", "SELECT count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS a, count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS b, count(*) FILTER (WHERE regexp_matches(p_name, '^[a-m]')) AS c, count(*) FILTER (WHERE regexp_full_match(p_brand, 'Brand#1.')) AS d FROM part")

# --- functions ---
statement("fn_hyperbolic", "SELECT p_partkey, SINH(p_size/25.0) AS a, COSH(p_size/25.0) AS b, TANH(p_size/25.0) AS c, ACOS(p_size/100.0) AS d, ATAN(p_size/10.0) AS e, POW(p_size/10.0, 1.5) AS f FROM part", "SELECT p_partkey, round(sinh(p_size/25.0),6) AS a, round(cosh(p_size/25.0),6) AS b, round(tanh(p_size/25.0),6) AS c, round(acos(p_size/100.0),6) AS d, round(atan(p_size/10.0),6) AS e, round(power(p_size/10.0,1.5),6) AS f FROM part", 6)
statement("fn_near", "SELECT p_partkey, NEAR(p_retailprice, 1000, 50) AS a, NEARABS(p_size, 25, 5.5) AS b, MIN(p_size, 25) AS c, MAX(p_retailprice, 1000) AS d, FMOD(p_retailprice, 11) AS e FROM part", "SELECT p_partkey, abs(p_retailprice-1000) < 50 AS a, abs(p_size-25) < 5.5 AS b, least(p_size,25)::DOUBLE AS c, round(greatest(p_retailprice,1000),6) AS d, round(fmod(p_retailprice,11),6) AS e FROM part", 6)
statement("fn_conversions", "SELECT p_partkey, BOOL(p_size-25) AS a, STRING(p_size) AS b, INT(-p_retailprice) AS c, PI() AS d, E() AS e, C() AS f FROM part", "SELECT p_partkey, p_size <> 25 AS a, CAST(p_size AS VARCHAR) AS b, CAST(trunc(-p_retailprice) AS BIGINT) AS c, round(pi(),6) AS d, round(exp(1),6) AS e, 299792458.0::DOUBLE AS f FROM part", 6)
statement("fn_checks", "SELECT gntrue(ISNAN(SQRT(p_size-25.0))) AS a, gntrue(ISFINITE(p_retailprice)) AS b, gntrue(ISINF(p_retailprice)) AS c, gntrue(ISNULL(p_name)) AS d, gntrue(ISCOLUMN('p_name')) AS e, gntrue(ISKEYWORD('p_name')) AS f FROM part", "SELECT count(*) FILTER (WHERE p_size < 25) AS a, count(*) AS b, CAST(0 AS BIGINT) AS c, count(*) FILTER (WHERE p_name IS NULL) AS d, count(*) AS e, CAST(0 AS BIGINT) AS f FROM part")
statement("fn_complex", "SELECT p_partkey, ARG(COMPLEX(p_size, 3)) AS a, IMAG(CONJ(COMPLEX(p_size, 3))) AS b, ABS(COMPLEX(p_size, 3)) AS c, REAL(COMPLEX(p_size, 3)) AS d FROM part", "SELECT p_partkey, round(atan2(3, p_size),6) AS a, -3.0::DOUBLE AS b, round(sqrt(p_size*p_size+9),6) AS c, CAST(p_size AS DOUBLE) AS d FROM part", 6)
statement("fn_capitalize", "SELECT p_partkey, CAPITALIZE(p_name) AS a, LTRIM('  ' + p_brand) AS b, RTRIM(p_brand + '  ') AS c, SUBSTR(p_name, 3) AS d FROM part", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS a, p_brand AS b, p_brand AS c, substr(p_name, 4) AS d FROM part")
statement("fn_times", "SELECT o_orderkey, TIME(o_orderdate + 0.25) AS a, CTIME(o_orderdate + 0.25) AS b, MJDTODATE(o_orderdate) AS c, MJD(o_orderdate) AS d, CDATE(o_orderdate + 0.5) AS e FROM orders", "SELECT o_orderkey, 21600.0::DOUBLE AS a, '06:00:00' AS b, strftime(o_orderdate,'%Y/%m/%d/00:00:00') AS c, CAST(date_diff('day', DATE '1858-11-17', o_orderdate) AS DOUBLE) AS d, strftime(o_orderdate,'%Y/%m/%d/12:00:00') AS e FROM orders")
_COS = "sin(0.1)*sin(p_size/100.0)+cos(0.1)*cos(p_size/100.0)*cos(1.0-p_size/50.0)"
statement("fn_cones", "SELECT p_partkey, ANGDISTX(p_size/50.0, 0.1, 1.0, p_size/100.0)[0] AS a, FINDCONE(p_size/50.0, 0.1, 1.0, p_size/100.0, 0.3) AS b, ANYCONE3([p_size/50.0, 0.1], [1.0, 0.2, 0.2, 0.2], 0.15) AS c FROM part",
          f"SELECT p_partkey, round(acos({_COS}),5) AS a, CAST(CASE WHEN acos({_COS}) <= 0.3 THEN 0 ELSE -1 END AS BIGINT) AS b, acos(sin(0.1)*sin(0.2)+cos(0.1)*cos(0.2)*cos(1.0-p_size/50.0)) <= 0.15 OR acos(sin(0.1)*sin(0.2)+cos(0.1)*cos(0.2)*cos(0.2-p_size/50.0)) <= 0.15 AS c FROM part", 5)
statement("fn_array_logic", "SELECT vec_id, ARRANY(embedding) AS a, ARRALL(embedding) AS b, ARRNTRUE(embedding) AS c, ARRNFALSE(embedding*0) AS d, ARRFRACTILE(embedding, 0.5) AS e, ARRSUM(ARRFLAT(embedding)) AS f, ARRSUMSQR(embedding) AS g, SHAPE(embedding)[0] AS h FROM embeddings",
          f"SELECT vec_id, len(list_filter(e, lambda x: x <> 0)) > 0 AS a, len(list_filter(e, lambda x: x = 0)) = 0 AS b, CAST(len(list_filter(e, lambda x: x <> 0)) AS BIGINT) AS c, CAST(len(e) AS BIGINT) AS d, round(list_sort(e)[CAST(floor(0.5*(len(e)-1)) AS BIGINT)+1],5) AS e, round(list_sum(e),5) AS f, round(list_sum(list_transform(e, lambda x: x*x)),5) AS g, CAST(len(e) AS DOUBLE) AS h FROM (SELECT vec_id, {_E} AS e FROM embeddings)", 5)

# --- observations ---
for _name, _given, _where in (("array", {"array": "0"}, "true"), ("array_none", {"array": "1"}, "false"), ("feed", {"feed": "0"}, "true"), ("scan_list", {"scan": "2,4~5"}, "scan IN (2,4,5)"), ("field_names", {"field": "F2,F4"}, "f IN (2,4)"), ("uvdist_above", {"uvdist": ">30"}, "sqrt(u*u+v*v) > 30")):
    query(f"select_{_name}", f"SELECT CAST(r AS BIGINT) AS row FROM {_MAIN} WHERE {_where}")(lambda spark, sf_dir, given=_given: Selection(**given).row_numbers(_observation(spark, sf_dir)))


@query("select_where_text", f"SELECT CAST(r AS BIGINT) AS row FROM {_MAIN} WHERE NOT (a1=0 OR a2=0) AND dd IN (0,2) AND scan IN (2,3,5) AND t >= TIMESTAMP '1994-01-01' AND sqrt(u*u+v*v) BETWEEN 5 AND 45 AND f <> 4")
def _where_text(spark, sf_dir):
    """A selection written out as the condition of a statement, which then chooses the rows."""
    o = _observation(spark, sf_dir)
    text = Selection(antenna="!ANT0", spw="1.0~2.0GHz", scan="2~3,5", time=">1993/12/31", uvdist="5~45m", field="!F4").where(o)
    return Session(spark, {"main": o.rows}).sql(f"SELECT ROWNR() AS row FROM main WHERE {text}")


# --- array expressions over lattices ---
_OK = "(i0+i1)%4<>0"
for _name, _text, _value, _mask in (
    ("logic", "iif(e > 0 && e < 0.5 || !(e > -0.5), 1, 0)", "CASE WHEN (v > 0 AND v < 0.5) OR NOT v > -0.5 THEN 1.0 ELSE 0.0 END", _OK), ("unary", "-e + 2*(-e)", "-3*v", _OK), ("two", "atan2(e, 2) + pow(e, 2) + fmod(3, 2) + min(e, 0.1) + max(e, 0.1)", "atan2(v,2) + v*v + 1 + least(v,0.1) + greatest(v,0.1)", _OK),
    ("masked", "value(e) * 2", "v*2", "true"), ("one", "sin(e) + cos(e) + exp(e) + sqrt(abs(e)) + floor(e) + ceil(e)", "sin(v) + cos(v) + exp(v) + sqrt(abs(v)) + floor(v) + ceil(v)", _OK), ("mean_difference", "e - mean(e)", f"v - (SELECT avg(v) FROM {_LONG} WHERE {_OK})", _OK),
):

    def _run(spark, sf_dir, text=_text):
        return evaluate(text, {"e": _embedding_lattice(spark, sf_dir)}).frame.filter("mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("s"))

    query(f"lattice_{_name}", f"SELECT count(*) AS n, round(sum(CAST({_value} AS DOUBLE)),3) AS s FROM {_LONG} WHERE {_mask}", 3)(_run)


@query("lattice_any_all", f"SELECT CAST(bool_or(v > 1) AS INTEGER)::DOUBLE AS a, CAST(bool_and(v > -100) AS INTEGER)::DOUBLE AS b, CAST(count(*) FILTER (WHERE NOT v > 0) AS DOUBLE) AS c FROM {_LONG} WHERE {_OK}")
def _any_all(spark, sf_dir):
    e = {"e": _embedding_lattice(spark, sf_dir)}
    return reductions({"a": "any(e > 1)", "b": "all(e > -100)", "c": "nfalse(e > 0)"}, e).select(*[F.col(c).cast("double").alias(c) for c in "abc"])


@query("lattice_complex", f"SELECT round(sum(v),3) AS re, round(-sum(2*v),3) AS im, round(sum(sqrt(5)*abs(v)),3) AS a, round(sum(atan2(2*v, v)),3) AS g FROM {_LONG}", 3)
def _complex(spark, sf_dir):
    e = _embedding_lattice(spark, sf_dir)
    z = form_complex(e, e.scaled(2.0, 0.0))
    total = lambda lat, n: lat.frame.agg(F.sum("value").alias(n)).first()[0]
    values = {"re": total(real(z), "x"), "im": total(imag(conj(z)), "x"), "a": total(absolute(z), "x"), "g": total(arg(z), "x")}
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


@query("image_scaled", f"SELECT count(*) AS n, round(sum(v*3-1),3) AS s FROM {_LONG}", 3)
def _image_scaled(spark, sf_dir):
    return Image(_embedding_lattice(spark, sf_dir)).scaled(3.0, -1.0).lattice.frame.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


@query("image_masked", f"SELECT count(*) AS n, round(sum(v),4) AS s FROM {_LONG} WHERE {_OK} AND i0 BETWEEN 3 AND 9 AND i1 BETWEEN 2 AND 40", 4)
def _image_masked(spark, sf_dir):
    made = Image(_embedding_lattice(spark, sf_dir)).masked_by(regions.Box((3, 2), (9, 40)))
    return made.lattice.frame.filter("mask").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


# --- projections: pixels of the parts' sizes, and back ---
_X, _Y, _R = "((p_size - 25.0) * -0.01)", "((p_size/2.0 - 10.0) * 0.01)", "sqrt(power((p_size - 25.0)*0.01,2) + power((p_size/2.0 - 10.0)*0.01,2))"
_AIT = f"sqrt(1 - power({_X}/4,2) - power({_Y}/2,2))"
for _name, _phi, _theta in (
    ("SIN", None, f"acos({_R})"), ("TAN", None, f"pi()/2 - atan({_R})"), ("STG", None, f"pi()/2 - 2*atan({_R}/2)"), ("ARC", None, f"pi()/2 - {_R}"), ("ZEA", None, f"pi()/2 - 2*asin({_R}/2)"), ("CAR", _X, _Y), ("CEA", _X, f"asin({_Y})"), ("MER", _X, f"2*atan(exp({_Y})) - pi()/2"),
    ("SFL", f"{_X}/cos({_Y})", _Y), ("PAR", f"{_X}/(1 - power(2*{_Y}/pi(),2))", f"3*asin({_Y}/pi())"), ("AIT", f"2*atan2({_AIT}*{_X}/2, 2*{_AIT}*{_AIT} - 1)", f"asin({_Y}*{_AIT})"),
    ("MOL", f"pi()*{_X}/(2*sqrt(2)*cos(asin({_Y}/sqrt(2))))", f"asin((2*asin({_Y}/sqrt(2)) + sin(2*asin({_Y}/sqrt(2))))/pi())"),
):
    # the native pole: the reference itself, or a quarter turn above it
    _pole = ("1.0", "0.5", "pi()") if _phi is None else ("1.0 + pi()", "pi()/2 - 0.5", "0.0")
    _sql = f"""SELECT p_partkey, round(CASE WHEN l < 0 THEN l + 2*pi() WHEN l >= 2*pi() THEN l - 2*pi() ELSE l END,7) AS lon, round(b,7) AS lat, CAST(p_size AS DOUBLE) AS x, p_size/2.0 AS y FROM (
      SELECT p_partkey, p_size, l0 + atan2(-cos(t)*sin(f - f0), sin(t)*cos(b0) - cos(t)*sin(b0)*cos(f - f0)) AS l, asin(sin(t)*sin(b0) + cos(t)*cos(b0)*cos(f - f0)) AS b FROM (
        SELECT p_partkey, p_size, {_phi or f"atan2({_X}, -{_Y})"} AS f, {_theta} AS t, {_pole[0]} AS l0, {_pole[1]} AS b0, {_pole[2]} AS f0 FROM part))"""

    def _run(spark, sf_dir, kind=_name):
        d = Direction(1.0, 0.5, (-0.01, 0.01), (25.0, 10.0), kind)
        px, py = F.col("p_size").cast("double"), F.col("p_size") / 2.0
        lon, lat = d.to_world(px, py)
        x, y = d.to_pixel(lon, lat)
        return table(spark, sf_dir, "part").select("p_partkey", lon.alias("lon"), lat.alias("lat"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))

    query(f"projection_{_name.lower()}", _sql, 7)(_run)
