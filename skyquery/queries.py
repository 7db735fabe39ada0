"""The registered queries of the table language, the array expressions and the observation operators, with SQL that gives the same rows.

Doubles are rounded on both sides, since sums depend on their order in the last digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import sky, units
from .functions.aggregates import ROWNR
from .operators import regions, views
from .operators.coordinates import Codes, CoordinateSystem, Direction, Linear, Tabular
from .operators.expressions import evaluate, packed, reductions
from .operators.image import Image
from .operators.lattice import Lattice
from .operators.observations.dataset import Observation, concatenate, to_stokes
from .operators.observations.selection import Selection
from .plans.statements import Session
from .sources.tables import by_key
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(frame: DataFrame, digits: int) -> DataFrame:
    kinds = {f.name: f.dataType for f in frame.schema}
    # adding 0.0 makes a negative zero a plain one
    return frame.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`") for c, k in kinds.items()])


def statement(name: str, text: str, sql: str, digits: int = 2, keyed: dict[str, str] | None = None) -> None:
    """Registers a statement. Tables named in it are read as they come; ``keyed`` gives row numbers by a column."""
    words = set(re.findall(r"[a-z_]+", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: table(spark, sf_dir, t) for t in TABLES if t in words}
        for t, key in (keyed or {}).items():
            frames[t] = by_key(frames[t], F.col(key))
        return rounded(Session(spark, frames).sql(text), digits)

    _QUERIES[name], _SQL[name] = run, sql


def query(name: str, sql: str | None = None, digits: int | None = None):
    def put(f: Query) -> Query:
        _QUERIES[name] = (lambda s, d: rounded(f(s, d), digits)) if digits is not None else f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


# --- statements and clauses ---
FLAGSHIP = (
    "SELECT l_returnflag, gsum(l_quantity) AS q, gmean(l_extendedprice) AS p FROM lineitem WHERE l_discount >= 0.05 "
    "GROUPBY l_returnflag HAVING gcount() > 10 ORDERBY l_returnflag"
)
statement("query_flagship", FLAGSHIP, "SELECT l_returnflag, round(sum(l_quantity),2) AS q, round(avg(l_extendedprice),2) AS p FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1 HAVING count(*) > 10")
statement("query_select_arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) AS net, l_linenumber // 2 AS half, l_orderkey % 7 AS m, l_linenumber**2 AS sq, -l_linenumber AS neg FROM lineitem",
     "SELECT l_orderkey, l_linenumber, round(l_extendedprice*(1-l_discount),4) AS net, CAST(l_linenumber // 2 AS BIGINT) AS half, l_orderkey % 7 AS m, CAST(l_linenumber*l_linenumber AS BIGINT) AS sq, CAST(-l_linenumber AS BIGINT) AS neg FROM lineitem".replace("l_linenumber, round", "CAST(l_linenumber AS BIGINT) AS l_linenumber, round"), 4)
statement("query_star", "SELECT * FROM nation WHERE n_regionkey IN [1,3]", "SELECT * FROM nation WHERE n_regionkey IN (1,3)")
statement("query_rows_only", "SELECT FROM part WHERE p_size > 45", "SELECT CAST(p_partkey AS BIGINT) AS rownr FROM part WHERE p_size > 45", keyed={"part": "p_partkey"})
statement("query_rownr", "SELECT ROWNR() AS r, p_brand FROM part WHERE ROWNR() < 25", "SELECT CAST(p_partkey AS BIGINT) AS r, p_brand FROM part WHERE p_partkey < 25", keyed={"part": "p_partkey"})
statement("query_alias_type", "SELECT p_retailprice AS price INT, p_size AS s DOUBLE FROM part", "SELECT CAST(trunc(p_retailprice) AS INTEGER) AS price, CAST(p_size AS DOUBLE) AS s FROM part")
statement("query_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("query_distinct_ordered", "SELECT DISTINCT c_mktsegment FROM customer ORDERBY c_mktsegment DESC LIMIT 3", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 DESC LIMIT 3")
statement("query_order_distinct", "SELECT n_regionkey, n_name FROM nation ORDERBY DISTINCT n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1", keyed={"nation": "n_nationkey"})
statement("query_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDERBY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, round(o_totalprice,2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
statement("query_limit_offset", "SELECT o_orderkey FROM orders ORDERBY o_orderkey LIMIT 20 OFFSET 100", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
statement("query_limit_then_aggregate", "SELECT gsum(p_retailprice) AS s, gcount() AS n FROM part ORDERBY p_partkey LIMIT 50", "SELECT round(sum(p_retailprice),2) AS s, count(*) AS n FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 50)")
statement("query_group_first_row", "SELECT p_brand, p_name, gcount() AS n FROM part GROUPBY p_brand", "SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, count(*) AS n FROM part GROUP BY p_brand", keyed={"part": "p_partkey"})
statement("query_group_order_limit", "SELECT o_custkey, gsum(o_totalprice) AS s FROM orders GROUPBY o_custkey ORDERBY s DESC, o_custkey LIMIT 10", "SELECT o_custkey, round(sum(o_totalprice),2) AS s FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10")
statement("query_rollup", "SELECT l_returnflag, l_linestatus, gsum(l_quantity) AS q, gcount() AS n FROM lineitem GROUPBY ROLLUP l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS q, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
statement("query_having_expression", "SELECT o_orderpriority, gmax(o_totalprice) - gmin(o_totalprice) AS spread FROM orders GROUPBY o_orderpriority HAVING gmean(o_totalprice) > 1000 AND gcount() > 5", "SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice),2) AS spread FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 1000 AND count(*) > 5")
statement("query_count", "COUNT FROM lineitem WHERE l_tax BETWEEN 0.02 AND 0.04", "SELECT count(*) AS n_rows FROM lineitem WHERE l_tax BETWEEN 0.02 AND 0.04")
statement("query_count_columns", "COUNT l_returnflag FROM lineitem", "SELECT l_returnflag, count(*) AS n_rows FROM lineitem GROUP BY 1")
statement("query_calc", "CALC 10/3 + 2**10 FROM region", "SELECT CAST(1027 AS BIGINT) AS expr FROM region")
statement("query_with", "WITH (SELECT o_custkey, gcount() AS n FROM orders GROUPBY o_custkey) AS per SELECT gmax(n) AS most, gmean(n) AS mean FROM per", "SELECT max(n) AS most, round(avg(n),2) AS mean FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
statement("query_subquery", "SELECT c, gcount() AS n FROM (SELECT c_nationkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 0) t GROUPBY c", "SELECT CAST(c_nationkey AS BIGINT) AS c, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
statement("query_giving", "SELECT n_name AS name FROM nation WHERE n_regionkey = 2 GIVING picked", "SELECT n_name AS name FROM nation WHERE n_regionkey = 2")

# --- joins ---
statement("join_equi", "SELECT n.n_name AS nation, gcount() AS n, gsum(o.o_totalprice) AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUPBY n.n_name",
     "SELECT n_name AS nation, count(*) AS n, round(sum(o_totalprice),2) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
statement("join_comma_where", "SELECT r.r_name AS region, gcount() AS n FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey GROUPBY r.r_name", "SELECT r_name AS region, count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey GROUP BY 1")
statement("join_cross", "SELECT gcount() AS n FROM nation n, region r", "SELECT count(*) AS n FROM nation, region")
statement("join_theta", "SELECT gcount() AS n, gsum(s.s_acctbal) AS b FROM region r JOIN supplier s ON s.s_nationkey < r.r_regionkey", "SELECT count(*) AS n, round(coalesce(sum(s_acctbal),0),2) AS b FROM region JOIN supplier ON s_nationkey < r_regionkey")
statement("join_star", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
statement("join_left", "SELECT gcount() AS n, gsum(IIF(ISNULL(o.o_orderkey), 1, 0)) AS without FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT count(*) AS n, round(sum(CASE WHEN o_orderkey IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE,2) AS without FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
statement("join_semi_in", "SELECT gcount() AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
statement("join_anti_in", "SELECT gcount() AS n FROM customer WHERE NOT c_custkey IN (SELECT o_custkey FROM orders)", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
statement("join_exists", "SELECT gcount() AS n FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey > 20)", "SELECT count(*) AS n FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")

# --- aggregates ---
for _name, _call, _sql in (
    ("count", "gcount()", "count(*)"), ("min", "gmin(l_quantity)", "round(min(l_quantity),4)"), ("max", "gmax(l_quantity)", "round(max(l_quantity),4)"), ("sum", "gsum(l_linenumber)", "CAST(sum(l_linenumber) AS DOUBLE)"),
    ("mean", "gmean(l_tax)", "round(avg(l_tax),4)"), ("variance", "gvariance(l_quantity)", "round(var_samp(l_quantity),4)"), ("stddev", "gstddev(l_quantity)", "round(stddev_samp(l_quantity),4)"),
    ("rms", "grms(l_quantity)", "round(sqrt(avg(l_quantity*l_quantity)),4)"), ("any", "gany(l_quantity > 49)", "bool_or(l_quantity > 49)"), ("all", "gall(l_quantity > 0)", "bool_and(l_quantity > 0)"),
    ("ntrue", "gntrue(l_discount > 0.05)", "count(*) FILTER (WHERE l_discount > 0.05)"), ("nfalse", "gnfalse(l_discount > 0.05)", "count(*) FILTER (WHERE NOT l_discount > 0.05)"),
    ("sumsqr", "gsumsqr(l_tax)", "round(sum(l_tax*l_tax),4)"), ("median", "gmedian(l_quantity)", "round(median(l_quantity),4)"), ("fractile", "gfractile(l_quantity, 0.25)", "round(quantile_cont(l_quantity,0.25),4)"),
    ("count_distinct", "gcount(DISTINCT l_suppkey)", "count(DISTINCT l_suppkey)"), ("sums", "gsums(l_linenumber)", "CAST(sum(l_linenumber) AS DOUBLE)"),
):
    statement(f"agg_{_name}", f"SELECT l_returnflag, {_call} AS v FROM lineitem GROUPBY l_returnflag", f"SELECT l_returnflag, {_sql} AS v FROM lineitem GROUP BY 1", 4)
statement("agg_product", "SELECT n_regionkey, gproduct(n_nationkey+1) AS v FROM nation GROUPBY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, round(product(n_nationkey+1),2) AS v FROM nation GROUP BY 1")
statement("agg_first_last", "SELECT p_brand, gfirst(p_retailprice) AS f, glast(p_retailprice) AS l, growid(p_size) AS r FROM part GROUPBY p_brand", "SELECT p_brand, round(arg_min(p_retailprice,p_partkey),2) AS f, round(arg_max(p_retailprice,p_partkey),2) AS l, CAST(min(p_partkey) AS BIGINT) AS r FROM part GROUP BY 1", keyed={"part": "p_partkey"})
statement("agg_hist", "SELECT ghist(l_quantity, 4, 10.0, 50.0) AS h FROM lineitem", "SELECT [CAST(count(*) FILTER (WHERE l_quantity<10) AS DOUBLE), count(*) FILTER (WHERE l_quantity>=10 AND l_quantity<20), count(*) FILTER (WHERE l_quantity>=20 AND l_quantity<30), count(*) FILTER (WHERE l_quantity>=30 AND l_quantity<40), count(*) FILTER (WHERE l_quantity>=40 AND l_quantity<50), count(*) FILTER (WHERE l_quantity>=50)] AS h FROM lineitem")
statement("agg_aggr", "SELECT n_regionkey, gaggr(n_nationkey) AS a FROM nation GROUPBY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, list(CAST(n_nationkey AS DOUBLE) ORDER BY n_nationkey) AS a FROM nation GROUP BY 1", keyed={"nation": "n_nationkey"})
statement("agg_of_expression", "SELECT gsum(l_extendedprice*(1-l_discount)) / gcount() AS mean_net, gmax(l_quantity) + 1 AS m FROM lineitem", "SELECT round(sum(l_extendedprice*(1-l_discount))/count(*),2) AS mean_net, round(max(l_quantity)+1,2) AS m FROM lineitem")

# --- operators and predicates ---
statement("expr_integer_division", "SELECT o_orderkey / 7 AS d, -o_orderkey / 7 AS nd, o_orderkey // 3 AS f FROM orders", "SELECT CAST(trunc(o_orderkey / 7) AS BIGINT) AS d, CAST(trunc(-o_orderkey / 7) AS BIGINT) AS nd, CAST(trunc(o_orderkey / 3) AS BIGINT) AS f FROM orders")
statement("expr_bits", "SELECT o_orderkey & 255 AS a, o_orderkey | 7 AS o, o_orderkey ^ 21 AS x, ~o_orderkey AS n FROM orders", "SELECT o_orderkey & 255 AS a, o_orderkey | 7 AS o, xor(o_orderkey, 21) AS x, -o_orderkey - 1 AS n FROM orders")
statement("expr_power_modulo", "SELECT 2**l_linenumber AS p, l_quantity % 7 AS m, l_quantity**2 AS q FROM lineitem", "SELECT CAST(power(2,l_linenumber) AS BIGINT) AS p, round(fmod(l_quantity,7),4) AS m, round(l_quantity*l_quantity,4) AS q FROM lineitem", 4)
statement("expr_near", "SELECT gcount() AS n FROM lineitem WHERE l_discount ~= 0.05", "SELECT count(*) AS n FROM lineitem WHERE abs(l_discount - 0.05) < 1e-5")
statement("expr_logic", "SELECT gcount() AS n FROM lineitem WHERE (l_quantity > 30 OR l_tax = 0) AND NOT l_returnflag = 'R'", "SELECT count(*) AS n FROM lineitem WHERE (l_quantity > 30 OR l_tax = 0) AND NOT l_returnflag = 'R'")
statement("expr_in_between", "SELECT gcount() AS n FROM lineitem WHERE l_linenumber IN [1,3,5] AND l_quantity NOT BETWEEN 10 AND 20", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber IN (1,3,5) AND NOT l_quantity BETWEEN 10 AND 20")
statement("expr_like", "SELECT gcount() AS n FROM customer WHERE c_name LIKE '%0?1' AND c_mktsegment ILIKE 'b%'", "SELECT count(*) AS n FROM customer WHERE regexp_full_match(c_name, '.*0.1') AND c_mktsegment ILIKE 'b%'")
statement("expr_regex", "SELECT gcount() AS n, gntrue(p_type ~ p/*STEEL*/) AS g, gntrue(p_name ~ m/[aeiou]{2}/i) AS m FROM part WHERE p_brand !~ '5$'", "SELECT count(*) AS n, count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS g, count(*) FILTER (WHERE regexp_matches(lower(p_name), '[aeiou]{2}')) AS m FROM part WHERE NOT regexp_matches(p_brand, '5$')")
statement("expr_iif", "SELECT o_orderstatus, gsum(IIF(o_totalprice > 100000, 1, 0.5)) AS w FROM orders GROUPBY o_orderstatus", "SELECT o_orderstatus, round(sum(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.5 END)::DOUBLE,2) AS w FROM orders GROUP BY 1")
statement("expr_concat", "SELECT c_name + ':' + c_nationkey AS t, 'v' + c_acctbal AS v FROM customer", "SELECT c_name || ':' || CAST(c_nationkey AS VARCHAR) AS t, 'v' || printf('%.6f', c_acctbal) AS v FROM customer")
statement("expr_units", "SELECT gsum(l_quantity km) AS m, gsum(5deg) AS r FROM lineitem WHERE l_linenumber = 1", "SELECT round(sum(l_quantity*1000.0),2) AS m, round(count(*)*5*pi()/180,2) AS r FROM lineitem WHERE l_linenumber = 1")
statement("expr_around", "SELECT gcount() AS n FROM lineitem WHERE l_quantity AROUND 25 IN 3", "SELECT count(*) AS n FROM lineitem WHERE abs(l_quantity - 25) <= 3")
statement("expr_subscript", "SELECT vec_id, embedding[3] AS e, ARRSUM(embedding[2:6]) AS s, c_x AS t FROM (SELECT vec_id, embedding, 'abc'[1] AS c_x FROM embeddings) q", "SELECT vec_id, round(embedding[4]::DOUBLE,6) AS e, round(embedding[3]::DOUBLE+embedding[4]::DOUBLE+embedding[5]::DOUBLE+embedding[6]::DOUBLE,6) AS s, 'b' AS t FROM embeddings", 6)
statement("expr_complex", "SELECT o_orderkey, REAL(COMPLEX(o_orderkey,2)*COMPLEX(1,-3)) AS re, IMAG(COMPLEX(o_orderkey,2)*COMPLEX(1,-3)) AS im, NORM(COMPLEX(3,4)) AS n FROM orders", "SELECT o_orderkey, CAST(o_orderkey + 6 AS DOUBLE) AS re, CAST(2 - 3*o_orderkey AS DOUBLE) AS im, 25.0::DOUBLE AS n FROM orders")
statement("expr_record", "SELECT gcount() AS n FROM nation WHERE ISNULL([]) AND ISDEF(n_name)", "SELECT count(*) AS n FROM nation")

# --- functions ---
statement("fn_trig", "SELECT l_orderkey, l_linenumber, SIN(l_tax) AS s, COS(l_tax) AS c, TAN(l_tax) AS t, ASIN(l_tax) AS a, ATAN2(l_tax, l_discount+1) AS a2, EXP(l_tax) AS e, LOG(l_quantity) AS l, LOG10(l_quantity) AS l10, SQRT(l_quantity) AS q FROM lineitem",
     "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sin(l_tax),6) AS s, round(cos(l_tax),6) AS c, round(tan(l_tax),6) AS t, round(asin(l_tax),6) AS a, round(atan2(l_tax, l_discount+1),6) AS a2, round(exp(l_tax),6) AS e, round(ln(l_quantity),6) AS l, round(log10(l_quantity),6) AS l10, round(sqrt(l_quantity),6) AS q FROM lineitem", 6)
statement("fn_rounding", "SELECT p_partkey, ROUND(p_retailprice) AS r, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, ABS(-p_size) AS a, SIGN(p_size-25) AS s, SQUARE(p_size) AS q, CUBE(p_size) AS u, INT(p_retailprice) AS i, FMOD(p_retailprice,7) AS m, MIN(p_size,20) AS lo, MAX(p_size,20) AS hi FROM part",
     "SELECT p_partkey, round(p_retailprice) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, CAST(p_size AS DOUBLE) AS a, CAST(sign(p_size-25) AS DOUBLE) AS s, CAST(p_size*p_size AS DOUBLE) AS q, CAST(p_size*p_size*p_size AS DOUBLE) AS u, CAST(trunc(p_retailprice) AS BIGINT) AS i, round(fmod(p_retailprice,7),6) AS m, CAST(least(p_size,20) AS DOUBLE) AS lo, CAST(greatest(p_size,20) AS DOUBLE) AS hi FROM part", 6)
statement("fn_strings", "SELECT p_partkey, STRLEN(p_name) AS n, UPPER(p_name) AS u, LOWER(p_type) AS l, TRIM('  '+p_brand+' ') AS t, SREVERSE(p_brand) AS r, SUBSTR(p_name,2,4) AS s, REPLACE(p_type,'E','#') AS x FROM part",
     "SELECT p_partkey, CAST(strlen(p_name) AS BIGINT) AS n, upper(p_name) AS u, lower(p_type) AS l, trim('  '||p_brand||' ') AS t, reverse(p_brand) AS r, substr(p_name,3,4) AS s, replace(p_type,'E','#') AS x FROM part")
statement("fn_dates", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, WEEKDAY(o_orderdate) AS w, WEEK(o_orderdate) AS k, CMONTH(o_orderdate) AS cm, CDOW(o_orderdate) AS cd, CTOD(o_orderdate) AS c, DATE(o_orderdate) AS mjd FROM orders",
     "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS w, CAST((dayofyear(o_orderdate)-1)//7+1 AS BIGINT) AS k, strftime(o_orderdate,'%b') AS cm, strftime(o_orderdate,'%a') AS cd, strftime(o_orderdate,'%Y/%m/%d/%H:%M:%S') AS c, CAST(date_diff('day', DATE '1858-11-17', CAST(o_orderdate AS DATE)) AS DOUBLE) AS mjd FROM orders")
statement("fn_datetime_filter", "COUNT FROM lineitem WHERE l_shipdate >= DATETIME('1995/01/01') AND l_shipdate < DATETIME('1996-01-01')", "SELECT count(*) AS n_rows FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
statement("fn_angles", "SELECT p_partkey, HMS(p_size/10.0) AS h, DMS(p_size/20.0) AS d, NORMANGLE(-p_size) AS n, ANGDIST(p_size/50.0, 0.1, 1.0, p_size/100.0) AS a, INCONE(p_size/50.0, 0.1, 0.5, 0.2, 0.3) AS i FROM part",
     """SELECT p_partkey, printf('%02d:%02d:%06.3f', CAST(floor(h) AS INT), CAST(floor((h-floor(h))*60) AS INT), ((h-floor(h))*60-floor((h-floor(h))*60))*60) AS h,
     printf('+%02d.%02d.%06.3f', CAST(floor(g) AS INT), CAST(floor((g-floor(g))*60) AS INT), ((g-floor(g))*60-floor((g-floor(g))*60))*60) AS d, round(-p_size - floor(-p_size/(2*pi()))*2*pi(),6) AS n,
     round(atan2(sqrt(power(cos(p_size/100.0)*sin(1.0-p_size/50.0),2)+power(cos(0.1)*sin(p_size/100.0)-sin(0.1)*cos(p_size/100.0)*cos(1.0-p_size/50.0),2)), sin(0.1)*sin(p_size/100.0)+cos(0.1)*cos(p_size/100.0)*cos(1.0-p_size/50.0)),6) AS a,
     acos(least(1.0,sin(0.1)*sin(0.2)+cos(0.1)*cos(0.2)*cos(0.5-p_size/50.0))) <= 0.3 AS i
     FROM (SELECT *, (p_size/10.0)*12.0/pi() AS h, (p_size/20.0)*180.0/pi() AS g FROM part)""", 6)  # fmt: skip
_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
statement("fn_arrays", "SELECT vec_id, NELEM(embedding) AS n, NDIM(embedding) AS d, ARRSUM(embedding) AS s, ARRMIN(embedding) AS lo, ARRMAX(embedding) AS hi, ARRMEAN(embedding) AS m, ARRMEDIAN(embedding) AS md, ARRVARIANCE(embedding) AS v, ARRSTDDEV(embedding) AS sd, ARRRMS(embedding) AS r, ARRFRACTILE(embedding,0.25) AS f, ARRNTRUE(embedding) AS t, ARRANY(embedding) AS a FROM embeddings",
     f"SELECT vec_id, CAST(len(e) AS BIGINT) AS n, CAST(1 AS BIGINT) AS d, round(list_sum(e),6) AS s, round(list_min(e),6) AS lo, round(list_max(e),6) AS hi, round(list_avg(e),6) AS m, round(list_median(e),6) AS md, round(list_var_pop(e),6) AS v, round(list_stddev_pop(e),6) AS sd, round(sqrt(list_avg(list_transform(e, lambda x: x*x))),6) AS r, round(list_sort(e)[CAST(floor(0.25*(len(e)-1)) AS INT)+1],6) AS f, CAST(len(list_filter(e, lambda x: x<>0)) AS BIGINT) AS t, len(list_filter(e, lambda x: x<>0)) > 0 AS a FROM (SELECT vec_id, {_E} AS e FROM embeddings)", 6)
statement("fn_array_building", "SELECT vec_id, ARRSUM(RESIZE(embedding,3)) AS a, AREVERSE(embedding)[0] AS b, ARRSUM(ARRAY(2,3,4)) AS c, DIAGONAL(embedding) AS d, ARRSUM(embedding*2+1) AS e, ARRAVDEV(embedding) AS v FROM embeddings",
     f"SELECT vec_id, round(e[1]+e[2]+e[3],6) AS a, round(e[len(e)],6) AS b, 24.0::DOUBLE AS c, round(e[1],6) AS d, round(list_sum(list_transform(e, lambda x: x*2+1)),6) AS e, round(list_avg(list_transform(e, lambda x: abs(x-list_avg(e)))),6) AS v FROM (SELECT vec_id, {_E} AS e FROM embeddings)", 6)
statement("fn_measures", "SELECT s_suppkey, MEAS_EPOCH_TAI(50000.0+s_suppkey%80) AS tai, MEAS_EPOCH_TT(50000.0+s_suppkey%80) AS tt FROM supplier", "SELECT s_suppkey, round(50000.0+s_suppkey%80 + (CASE WHEN 50000.0+s_suppkey%80 >= 50083 THEN 30 ELSE 29 END)/86400.0,8) AS tai, round(50000.0+s_suppkey%80 + ((CASE WHEN 50000.0+s_suppkey%80 >= 50083 THEN 30 ELSE 29 END)+32.184)/86400.0,8) AS tt FROM supplier", 8)


# --- units, coordinates, measures over columns ---
@query("unit_convert", "SELECT p_partkey, round(p_size*1000.0/3600.0,6) AS ms, round(p_size*pi()/180,6) AS rad, round(p_size*1e-26*1e3,30)*0 AS z FROM part", 6)
def _unit_convert(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", (size * units.factor("km/h", "m/s")).alias("ms"), (size * units.factor("deg", "rad")).alias("rad"), (size * units.factor("kJy", "W/m2.s") * 0).alias("z"))


@query("measure_doppler", "SELECT p_partkey, round((1-r*r)/(1+r*r),9) AS beta, round(1/r-1,9) AS z, round((1+r*r)/(2*r),9) AS gamma, round((1-r)*299792458.0,3)*1.0 AS v FROM (SELECT p_partkey, 1-p_size/100.0 AS r FROM part)", 9)
def _doppler(spark, sf_dir):
    radio = F.col("p_size") / 100.0
    return table(spark, sf_dir, "part").select("p_partkey", sky.doppler(radio, "RADIO", "BETA").alias("beta"), sky.doppler(radio, "RADIO", "Z").alias("z"), sky.doppler(radio, "RADIO", "GAMMA").alias("gamma"), F.round(sky.velocity((1 - radio) * 1.42e9, 1.42e9), 3).alias("v"))


def _turned(matrix, lon: str, lat: str) -> str:
    """SQL of a longitude and a latitude, of the columns x, y and z turned by a matrix."""
    x, y, z = (f"({a!r}*x + {b!r}*y + {c!r}*z)" for a, b, c in matrix)
    return f"round(CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2*pi() ELSE atan2({y}, {x}) END,6) AS {lon}, round(asin({z}),6) AS {lat}"


_TILT = f"radians({sky.OBLIQUITY}/3600)"
_ECLIPTIC = f"x, y*cos({_TILT}) + z*sin({_TILT}) AS y, z*cos({_TILT}) - y*sin({_TILT}) AS z"
_SPHERE = "SELECT p_partkey, p_size, cos(p_size/100.0)*cos(p_size/10.0) AS x, cos(p_size/100.0)*sin(p_size/10.0) AS y, sin(p_size/100.0) AS z FROM part"


@query("measure_direction", f"SELECT p_partkey, gl, gb, lat, el, eb FROM (SELECT p_partkey, round(p_size/100.0,6)::DOUBLE AS lat, {_turned(sky.GALACTIC, 'gl', 'gb')} FROM ({_SPHERE})) JOIN (SELECT p_partkey, {_turned(((1, 0, 0), (0, 1, 0), (0, 0, 1)), 'el', 'eb')} FROM (SELECT p_partkey, {_ECLIPTIC} FROM ({_SPHERE}))) USING (p_partkey)", 6)
def _direction(spark, sf_dir):
    lon, lat = F.col("p_size") / 10.0, F.col("p_size") / 100.0
    gl, gb = sky.convert_direction(lon, lat, "J2000", "GALACTIC")
    back = sky.convert_direction(gl, gb, "GALACTIC", "J2000")
    el, eb = sky.convert_direction(lon, lat, "J2000", "ECLIPTIC")
    return table(spark, sf_dir, "part").select("p_partkey", gl.alias("gl"), gb.alias("gb"), back[1].alias("lat"), el.alias("el"), eb.alias("eb"))


@query("coordinate_pixels", "SELECT p_partkey, round(1.4e9 + (p_size - 10)*1e6,3) AS f, round(CASE WHEN p_size < 20 THEN p_size*2.0 ELSE 40.0 + (p_size-20)*0.5 END,6) AS t, CAST([1,2,3,4][p_size%4+1] AS INTEGER) AS s FROM part", 6)
def _coordinates(spark, sf_dir):
    px = F.col("p_size").cast("double")
    system = CoordinateSystem([Linear(1.4e9, 1e6, 10.0, "Hz"), Tabular((0.0, 20.0, 40.0), (0.0, 40.0, 50.0)), Codes((1, 2, 3, 4))])
    f, t, s = system.to_world([px, px, F.col("p_size") % 4])
    return table(spark, sf_dir, "part").select("p_partkey", f.alias("f"), t.alias("t"), s.alias("s"))


# --- array expressions, lattices, regions, images: the embeddings as element x row ---
def _embedding_lattice(spark, sf_dir) -> Lattice:
    frame = table(spark, sf_dir, "embeddings")
    rows, width = (v or 0 for v in frame.agg(F.max("vec_id"), F.max(F.size("embedding"))).first())
    made = Lattice.from_arrays(frame.withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding", (width, int(rows) + 1))
    return made.masked((F.col("i0") + F.col("i1")) % 4 != 0)


_LONG = "(SELECT vec_id AS i1, CAST(unnest(range(len(embedding))) AS BIGINT) AS i0, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("array_packed", f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: x*2+1)),5) AS s, round(list_max(list_transform(e, lambda x: abs(x))),5) AS a, CAST(len(list_filter(e, lambda x: x > 0)) AS DOUBLE) AS p FROM (SELECT vec_id, {_E} AS e FROM embeddings)", 5)
def _array_packed(spark, sf_dir):
    e = {"e": F.col("embedding").cast("array<double>")}
    one = lambda text: packed(text, e)[0][0].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", one("sum(e*2+1)").alias("s"), one("max(abs(e))").alias("a"), one("ntrue(e > 0)").alias("p"))


@query("array_lattice", f"SELECT count(*) AS n, round(sum(CASE WHEN v > 0 THEN v ELSE -2*v END),3) AS s, count(*) FILTER (WHERE (i0+i1)%4<>0) AS good FROM {_LONG}", 3)
def _array_lattice(spark, sf_dir):
    made = evaluate("iif(e > 0, e, -2*e)", {"e": _embedding_lattice(spark, sf_dir)})
    return made.frame.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.count_if("mask").alias("good"))


@query("array_reductions", f"SELECT round(sum(v),4) AS sum, round(min(v),4) AS min, round(max(v),4) AS max, round(avg(v),4) AS mean, round(median(v),4) AS median, round(var_samp(v),4) AS variance, CAST(count(*) FILTER (WHERE v>0) AS DOUBLE) AS ntrue FROM {_LONG} WHERE (i0+i1)%4<>0", 4)
def _array_reductions(spark, sf_dir):
    asked = {f: f"{f}(e)" for f in ("sum", "min", "max", "mean", "median", "variance")} | {"ntrue": "ntrue(e > 0)"}
    made = reductions(asked, {"e": _embedding_lattice(spark, sf_dir)})
    return made.select(*[F.col(c).cast("double").alias(c) for c in made.columns])


@query("lattice_sub", f"SELECT count(*) AS n, round(sum(v),4) AS s, CAST(max(i0) - 2 AS BIGINT) // 3 AS m FROM {_LONG} WHERE i0 BETWEEN 2 AND 29 AND (i0-2)%3=0 AND i1 BETWEEN 10 AND 49", 4)
def _lattice_sub(spark, sf_dir):
    return _embedding_lattice(spark, sf_dir).sub((2, 10), (10, 40), (3, 1)).frame.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max("i0").alias("m"))


@query("lattice_rebin", f"SELECT CAST(i0//8 AS BIGINT) AS i0, CAST(i1//10 AS BIGINT) AS i1, round(avg(v),6) AS value FROM {_LONG} GROUP BY 1,2", 6)
def _lattice_rebin(spark, sf_dir):
    return _embedding_lattice(spark, sf_dir).rebin((8, 10)).frame.select("i0", "i1", "value")


@query("lattice_tiles", f"SELECT CAST(i0//16 AS BIGINT) AS t0, CAST(i1//50 AS BIGINT) AS t1, round(list_sum(list(v ORDER BY i1,i0)),4) AS s, CAST(count(*) AS BIGINT) AS n FROM {_LONG} GROUP BY 1,2", 4)
def _lattice_tiles(spark, sf_dir):
    return _embedding_lattice(spark, sf_dir).tiles((16, 50)).select("t0", "t1", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("s"), F.size("values").cast("long").alias("n"))


@query("lattice_concat", f"SELECT count(*) AS n, CAST(max(i1) AS BIGINT) AS m, round(sum(v),4) AS s FROM (SELECT i0, i1, v FROM {_LONG} UNION ALL SELECT i0, i1 + (SELECT max(vec_id)+1 FROM embeddings), v*2+1 FROM {_LONG})", 4)
def _lattice_concat(spark, sf_dir):
    a = _embedding_lattice(spark, sf_dir)
    return a.concat([a.scaled(2.0, 1.0)], 1).frame.agg(F.count(F.lit(1)).alias("n"), F.max("i1").alias("m"), F.sum("value").alias("s"))


@query("region_algebra", f"SELECT count(*) FILTER (WHERE b OR e) AS u, count(*) FILTER (WHERE b AND e) AS i, count(*) FILTER (WHERE b AND NOT e) AS d, count(*) FILTER (WHERE NOT b) AS c FROM (SELECT i0 BETWEEN 5 AND 20 AND i1 BETWEEN 5 AND 30 AS b, power((i0-20)/10.0,2)+power((i1-25)/12.0,2) <= 1 AS e FROM {_LONG})")
def _region_algebra(spark, sf_dir):
    box, ellipse = regions.Box((5, 5), (20, 30)), regions.Ellipsoid((20.0, 25.0), (10.0, 12.0))
    at = [F.col("i0"), F.col("i1")]
    n = lambda r, name: F.count_if(r.contains(at)).alias(name)
    return _embedding_lattice(spark, sf_dir).frame.agg(n(box | ellipse, "u"), n(box & ellipse, "i"), n(box - ellipse, "d"), n(~box, "c"))


@query("region_polygon", f"SELECT count(*) AS n, round(sum(v),4) AS s FROM {_LONG} WHERE (i0+0.5) > 2 AND (i1+0.5) > 3 AND (i0+0.5)/30.0 + (i1+0.5)/40.0 < 2/30.0 + 43/40.0", 4)
def _region_polygon(spark, sf_dir):
    triangle = regions.Polygon((2.0, 32.0, 2.0), (3.0, 3.0, 43.0))
    return _embedding_lattice(spark, sf_dir).frame.filter(triangle.contains([F.col("i0"), F.col("i1")])).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


@query("image_statistics", f"SELECT count(*) AS n, round(min(v),6) AS min, round(max(v),6) AS max, round(avg(v),6) AS mean, round(sqrt(avg(v*v)),6) AS rms FROM {_LONG}", 6)
def _image_statistics(spark, sf_dir):
    return Image(_embedding_lattice(spark, sf_dir)).statistics()


@query("image_regrid", f"SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, round(coalesce(v,0),6) AS value FROM (SELECT unnest(range(20)) AS i0) a, (SELECT unnest(range(30)) AS i1) b LEFT JOIN (SELECT i0 AS s0, i1 AS s1, v FROM {_LONG}) ON s0 = CAST(floor(i0*2+0.5) AS BIGINT) AND s1 = CAST(floor(i1/2.0+0.5) AS BIGINT)", 6)
def _image_regrid(spark, sf_dir):
    here, there = CoordinateSystem([Linear(), Linear()]), CoordinateSystem([Linear(0.0, 2.0), Linear(0.0, 0.5)])
    return Image(_embedding_lattice(spark, sf_dir), here).regrid((20, 30), there).lattice.frame.select("i0", "i1", "value")


_TAN = "SELECT p_partkey, p_size, atan2((p_size - 25)*-0.001, -(p_size/2.0 - 25)*0.001) - pi() AS f, pi()/2 - atan(sqrt(power((p_size - 25)*0.001,2) + power((p_size/2.0 - 25)*0.001,2))) AS t FROM part"


@query("image_projection", f"SELECT p_partkey, round(1.0 + atan2(-cos(t)*sin(f), sin(t)*cos(0.5) - cos(t)*sin(0.5)*cos(f)),9) AS lon, round(asin(sin(t)*sin(0.5) + cos(t)*cos(0.5)*cos(f)),9) AS lat, CAST(p_size AS DOUBLE) AS x, p_size/2.0 AS y FROM ({_TAN})", 9)
def _image_projection(spark, sf_dir):
    d = Direction(1.0, 0.5, (-1e-3, 1e-3), (25.0, 25.0), "TAN")
    px, py = F.col("p_size").cast("double"), F.col("p_size") / 2.0
    lon, lat = d.to_world(px, py)
    x, y = d.to_pixel(lon, lat)
    return table(spark, sf_dir, "part").select("p_partkey", lon.alias("lon"), lat.alias("lat"), x.alias("x"), y.alias("y"))


# --- observations: order lines as the main table ---
def _observation(spark, sf_dir) -> Observation:
    lines = table(spark, sf_dir, "lineitem")
    days = F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("double") / 86400e6 + 40587.0
    main = lines.select(
        (F.col("l_suppkey") % 7).cast("int").alias("ANTENNA1"), (F.col("l_partkey") % 7).cast("int").alias("ANTENNA2"), (F.col("l_orderkey") % 5).cast("int").alias("FIELD_ID"), (F.col("l_linenumber") % 3).cast("int").alias("DATA_DESC_ID"),
        F.col("l_linenumber").cast("int").alias("SCAN_NUMBER"), F.lit(0).alias("ARRAY_ID"), (F.col("l_orderkey") % 2).cast("int").alias("OBSERVATION_ID"), F.lit(0).alias("STATE_ID"), F.lit(0).alias("FEED1"), F.lit(0).alias("FEED2"),
        (days * 86400.0).alias("TIME"), F.array("l_quantity", "l_tax", F.lit(0.0)).alias("UVW"), (F.col("l_returnflag") == "R").alias("FLAG_ROW"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ROWNR),
    )
    named = lambda prefix, n: spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("NAME"), F.col("id").alias(ROWNR))
    windows_ = spark.range(2).select(F.concat(F.lit("SPW"), F.col("id").cast("string")).alias("NAME"), F.lit(64).alias("NUM_CHAN"), F.when(F.col("id") == 0, 1.4e9).otherwise(3.0e9).alias("REF_FREQUENCY"), F.col("id").alias(ROWNR))
    described = spark.range(3).select((F.col("id") % 2).cast("int").alias("SPECTRAL_WINDOW_ID"), F.floor(F.col("id") / 2).cast("int").alias("POLARIZATION_ID"), F.col("id").alias(ROWNR))
    states = spark.range(1).select(F.lit("OBSERVE_TARGET.ON_SOURCE").alias("OBS_MODE"), F.col("id").alias(ROWNR))
    telescopes = spark.range(2).select(F.lit("T").alias("TELESCOPE_NAME"), F.lit("O").alias("OBSERVER"), F.col("id").alias(ROWNR))
    return Observation(main, {"ANTENNA": named("ANT", 7), "FIELD": named("F", 5), "SPECTRAL_WINDOW": windows_, "DATA_DESCRIPTION": described, "STATE": states, "OBSERVATION": telescopes})


_MAIN = "(SELECT l_orderkey*10+l_linenumber AS r, l_suppkey%7 AS a1, l_partkey%7 AS a2, l_orderkey%5 AS f, l_linenumber%3 AS dd, l_linenumber AS scan, l_orderkey%2 AS obs, l_quantity AS u, l_tax AS v, l_shipdate AS t, l_returnflag='R' AS flag FROM lineitem)"
for _name, _given, _where in (
    ("antenna", {"antenna": "ANT1,ANT3"}, "a1 IN (1,3) OR a2 IN (1,3)"), ("antenna_pair", {"antenna": "0~2&ANT4"}, "(a1 IN (0,1,2) AND a2=4) OR (a2 IN (0,1,2) AND a1=4)"), ("antenna_auto", {"antenna": "2&&&"}, "a1=2 AND a2=2"),
    ("antenna_cross_auto", {"antenna": "1&&*"}, "a1=1 OR a2=1"), ("antenna_not", {"antenna": "!ANT0"}, "NOT (a1=0 OR a2=0)"), ("field", {"field": "F1*,3~4"}, "f IN (1,3,4)"), ("spw", {"spw": "SPW1:0~10"}, "dd IN (1)"), ("spw_frequency", {"spw": "1.4GHz"}, "dd IN (0,2)"),
    ("scan", {"scan": ">4"}, "scan > 4"), ("time", {"time": "1995/01/01~1995/12/31"}, "t BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'"), ("uvdist", {"uvdist": "10~20"}, "sqrt(u*u+v*v) BETWEEN 10 AND 20"),
    ("observation", {"observation": "1"}, "obs = 1"), ("state", {"state": "OBSERVE*"}, "true"), ("expr", {"expr": "SCAN_NUMBER > 2 AND FIELD_ID = 1"}, "scan > 2 AND f = 1"), ("combined", {"antenna": "ANT2", "scan": "1~3", "field": "F0", "uvdist": ">5"}, "(a1=2 OR a2=2) AND scan BETWEEN 1 AND 3 AND f=0 AND sqrt(u*u+v*v)>5"),
):
    query(f"select_{_name}", f"SELECT CAST(r AS BIGINT) AS row FROM {_MAIN} WHERE {_where}")(lambda spark, sf_dir, given=_given: Selection(**given).row_numbers(_observation(spark, sf_dir)))


@query("obs_chunks", f"SELECT CAST(0 AS INTEGER) AS ARRAY_ID, CAST(f AS INTEGER) AS FIELD_ID, CAST(dd AS INTEGER) AS DATA_DESC_ID, count(*) AS n, CAST(min(r) AS BIGINT) AS first FROM {_MAIN} GROUP BY 1,2,3")
def _ms_chunks(spark, sf_dir):
    return _observation(spark, sf_dir).chunk_sizes().drop("last")


@query("obs_time_chunks", f"SELECT CAST(date_diff('day', (SELECT min(l_shipdate) FROM lineitem), t) // 30 AS BIGINT) AS bin, count(*) AS n FROM {_MAIN} GROUP BY 1")
def _ms_time_chunks(spark, sf_dir):
    return _observation(spark, sf_dir).time_chunk_sizes(30 * 86400.0).select("bin", "n")


@query("obs_flags", f"SELECT count(*) AS rows, count(*) FILTER (WHERE flag OR scan = 1) AS flagged FROM {_MAIN}")
def _ms_flags(spark, sf_dir):
    return _observation(spark, sf_dir).flagged_where(F.col("SCAN_NUMBER") == 1).flag_stats()


@query("obs_concat", f"SELECT count(*)*2 AS n, CAST(sum(a1 + f) AS BIGINT) * 2 AS s, CAST(7 AS BIGINT) AS antennas FROM {_MAIN}")
def _ms_concat(spark, sf_dir):
    o = _observation(spark, sf_dir)
    turned = {k: (v.withColumn(ROWNR, F.lit(v.count() - 1) - F.col(ROWNR)) if k in ("ANTENNA", "FIELD") else v) for k, v in o.sub.items()}
    second = Observation(o.main.withColumn("ANTENNA1", 6 - F.col("ANTENNA1")).withColumn("ANTENNA2", 6 - F.col("ANTENNA2")).withColumn("FIELD_ID", 4 - F.col("FIELD_ID")), turned)
    made = concatenate(o, second)
    return made.main.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ANTENNA1") + F.col("FIELD_ID")).cast("long")).alias("s")).withColumn("antennas", F.lit(made.sub["ANTENNA"].count()).cast("long"))


@query("obs_dimensions", f"SELECT 'F' || CAST(f AS VARCHAR) AS field, 'ANT' || CAST(a1 AS VARCHAR) AS antenna, CAST(CASE WHEN dd=1 THEN 1 ELSE 0 END AS INTEGER) AS spw, count(*) AS n FROM {_MAIN} GROUP BY 1,2,3")
def _ms_dimensions(spark, sf_dir):
    return _observation(spark, sf_dir).with_dimensions().groupBy(F.col("FIELD_NAME").alias("field"), F.col("ANTENNA1_NAME").alias("antenna"), F.col("SPECTRAL_WINDOW_ID").alias("spw")).agg(F.count(F.lit(1)).alias("n"))


@query("obs_stokes", "SELECT l_orderkey, l_linenumber, round((l_quantity+l_tax)/2,6) AS i, round((l_quantity-l_tax)/2,6) AS v FROM lineitem", 6)
def _ms_stokes(spark, sf_dir):
    c = lambda x: F.struct(x.alias("re"), F.lit(0.0).alias("im"))
    data = F.array(c(F.col("l_quantity")), c(F.col("l_tax")))
    made = to_stokes(data, ["RR", "LL"], ["I", "V"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made[0]["re"].alias("i"), made[1]["re"].alias("v"))


# --- views, set operations, windows, streams ---
@query("view_rows", "SELECT CAST(p_partkey AS BIGINT) AS base, p_brand, CAST(position AS BIGINT) AS position FROM part JOIN (VALUES (5,0),(3,1),(5,2),(11,3)) x(row, position) ON p_partkey = row")
def _view_rows(spark, sf_dir):
    part = by_key(table(spark, sf_dir, "part"), F.col("p_partkey"))
    return views.rows_view(part, [5, 3, 5, 11]).select(F.col("_base").alias("base"), "p_brand", F.col(ROWNR).alias("position"))


@query("view_concat", "SELECT count(*) AS n, CAST(max(r) AS BIGINT) AS last FROM (SELECT n_nationkey AS r FROM nation UNION ALL SELECT n_nationkey + 25 FROM nation)")
def _view_concat(spark, sf_dir):
    nation = by_key(table(spark, sf_dir, "nation"), F.col("n_nationkey"))
    return views.concatenate([nation, nation]).agg(F.count(F.lit(1)).alias("n"), F.max(ROWNR).alias("last"))


@query("view_groups", "SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1")
def _view_groups(spark, sf_dir):
    return views.groups(by_key(table(spark, sf_dir, "nation"), F.col("n_nationkey")), ["n_regionkey"])


@query("index_lookup", "SELECT CAST(p_partkey AS BIGINT) AS row FROM part WHERE p_brand = 'Brand#12' AND p_size = 10")
def _index_lookup(spark, sf_dir):
    return views.ColumnsIndex(by_key(table(spark, sf_dir, "part"), F.col("p_partkey")), ["p_brand", "p_size"]).rows(p_brand="Brand#12", p_size=10)


@query("as_of_join", "SELECT e.event_id, l.event_id AS last_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1,2) l ON e.user_id = l.user_id AND e.ts >= l.ts")
def _as_of(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return views.as_of_join(events.select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "ts", ["last_id"], F.to_date).select("event_id", "last_id")


@query("range_join", "SELECT count(*) AS n FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice*100 AND p_retailprice*100+500")
def _range_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 500).alias("high"))
    return views.range_join(table(spark, sf_dir, "orders").select("o_totalprice"), part, "o_totalprice", "low", "high", 500.0).agg(F.count(F.lit(1)).alias("n"))


@query("cone_join", "SELECT count(*) AS n FROM part a JOIN supplier b ON acos(greatest(-1,least(1,sin(a.p_size/60.0)*sin((b.s_suppkey%50)/60.0)+cos(a.p_size/60.0)*cos((b.s_suppkey%50)/60.0)*cos((a.p_partkey%100)/50.0-(b.s_suppkey%30)/20.0)))) <= 0.0523")
def _cone_join(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(((F.col("p_partkey") % 100) / 50.0).alias("lon"), (F.col("p_size") / 60.0).alias("lat"))
    b = table(spark, sf_dir, "supplier").select(((F.col("s_suppkey") % 30) / 20.0).alias("clon"), ((F.col("s_suppkey") % 50) / 60.0).alias("clat"), F.lit(0.0523).alias("r"))
    return views.cone_join(a, b, "lon", "lat", "clon", "clat", "r", 0.0523).agg(F.count(F.lit(1)).alias("n"))


@query("set_operations", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS u, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS i, (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)) AS e")
def _set_operations(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    count = lambda f, name: f.agg(F.count(F.lit(1)).alias(name))
    return count(c.union(s).distinct(), "u").crossJoin(count(c.intersect(s), "i")).crossJoin(count(n.subtract(s), "e"))


@query("window_tumbling", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1,2")
def _tumbling(spark, sf_dir):
    made = windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", [F.count(F.lit(1)).alias("n")], keys=["event_type"])
    return made.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("window_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events) WHERE s = 1 GROUP BY 1")
def _sessions(spark, sf_dir):
    made = windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", [F.count(F.lit(1)).alias("n")], keys=["user_id"])
    return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("carried_forward", "SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),4) AS v FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)", 4)
def _carried(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return views.carried_forward(events, ["v"], ["ts", "event_id"], ["user_id"], F.to_date("ts")).select("event_id", "v")


def _register_others() -> None:
    """The modules that register further queries need those above."""
    from . import function_queries, measure_queries, statement_queries

    del function_queries, measure_queries, statement_queries


def queries() -> dict[str, Query]:
    _register_others()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register_others()
    return dict(_SQL)
