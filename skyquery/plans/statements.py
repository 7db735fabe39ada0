"""Statements to DataFrames.

``Session`` holds named tables: DataFrames, or managed tables that can be changed. A SELECT
becomes one lazy DataFrame; the order of rows, where a query has one, is by its keys and then
the row number, which every table carries in ``_rownr`` if the query needs it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import BY_ROW
from ..functions.values import Value
from ..sources import tables as managed
from . import help_text
from .compiler import ROWNR, Compiler, Scope
from .lexer import QueryError
from .parser import parse
from .syntax import AGGREGATES, Binary, Call, Exists, In, Item, Key, Name, Query, Star, Statement, TableRef, Unary, is_aggregate, walk


def _row_mode(q: Query) -> str:
    """What of the rows can show in the result: nothing, their order, or their very numbers (dense)."""
    nodes = list(walk([i.x for i in q.items] + [q.where, q.having, *q.group, *[k.x for k in q.order]]))
    calls = {n.name for n in nodes if isinstance(n, Call)}
    if calls & {"ROWNR", "ROWID", "ROWNUMBER", "GROWID"} or not q.items:
        return "dense"
    plain = any(not is_aggregate(i.x) for i in q.items)
    return "order" if calls & BY_ROW or q.limit is not None or q.offset is not None or q.distinct or q.order_distinct or (q.group and plain) else ""


class Session:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | managed.Table] | None = None, warehouse: str | None = None):
        self.spark, self.tables, self.warehouse = spark, dict(tables or {}), warehouse

    # --- tables ---
    def add(self, name: str, table: DataFrame | managed.Table) -> None:
        self.tables[name] = table

    def table(self, name: str) -> DataFrame | managed.Table:
        if name in self.tables:
            return self.tables[name]
        if self.warehouse is not None and managed.exists(self.spark, self.warehouse, name):
            self.tables[name] = managed.Table.open(self.spark, self.warehouse, name)
            return self.tables[name]
        raise QueryError(f"unknown table {name}")

    def frame(self, name: str) -> tuple[DataFrame, dict]:
        t = self.table(name)
        return (t.frame(), t.keywords()) if isinstance(t, managed.Table) else (t, {})

    def _managed(self, name: str) -> managed.Table:
        t = self.table(name)
        if not isinstance(t, managed.Table):
            raise QueryError(f"{name} is a DataFrame and cannot be changed in place")
        return t

    # --- running ---
    def sql(self, text: str) -> DataFrame:
        """Runs one statement. Commands that change tables return a row with the number of rows they touched."""
        made = parse(text)
        if isinstance(made, Query):
            out = self.select(made)
            if made.giving is not None:
                if self.warehouse is None:
                    out.createOrReplaceTempView(made.giving)
                    self.tables[made.giving] = out
                else:
                    self.tables[made.giving] = managed.Table.save(out, self.warehouse, made.giving)
            return out
        return getattr(self, "_" + made.command.lower())(made.given)

    def _rows(self, n: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n_rows"))

    # --- SELECT ---
    def select(self, q: Query) -> DataFrame:
        q = replace(q)
        session = self
        if q.withs:
            session = Session(self.spark, self.tables, self.warehouse)
            for ref in q.withs:
                session.tables[ref.alias] = session.select(ref.query) if ref.query else session.table(ref.name)
        mode = _row_mode(q)
        if not q.tables:
            scope = Scope(self.spark.range(1).select(F.lit(0).cast("long").alias(ROWNR)))
        else:
            scope = session._source(q.tables, mode)
        if q.where is not None:
            scope = session._where(scope, q.where)
        if mode and ROWNR not in scope.frame.columns:
            scope.frame = scope.frame.withColumn(ROWNR, F.monotonically_increasing_id())
        if any(isinstance(i.x, Star) for i in q.items):
            q.items = [j for i in q.items for j in (session._star(scope) if isinstance(i.x, Star) else [i])]
        if q.group or any(is_aggregate(i.x) for i in q.items):
            return session._grouped(scope, q)
        if q.having is not None:
            raise QueryError("HAVING needs GROUPBY")
        return session._plain(scope, q)

    def _source(self, refs: list[TableRef], mode: str) -> Scope:
        """The tables joined. Rows are numbered before anything is filtered if the numbers can show; for their order alone, later."""
        if len(refs) == 1:
            frame, keywords = self._ref(refs[0])
            frame = managed.numbered(frame) if mode == "dense" else frame
            scope = Scope.of(frame, refs[0].alias, keywords)
            scope.columns |= {("", c): i for (_, c), i in list(scope.columns.items())}
            scope.order = [refs[0].alias]
            return scope
        scope: Scope | None = None
        numbers = []
        for ref in refs:
            frame, keywords = self._ref(ref)
            if mode:
                frame = managed.numbered(frame) if mode == "dense" else managed.ordered(frame)
                numbers.append(f"{ref.alias}.{ROWNR}")
            frame = frame.select(*[F.col(f"`{c}`").alias(f"{ref.alias}.{c}") for c in frame.columns])
            columns = {(ref.alias, c.removeprefix(f"{ref.alias}.")): c for c in frame.columns if not c.endswith(f".{ROWNR}")}
            if scope is None:
                scope = Scope(frame, columns, [ref.alias], keywords)
                continue
            if ref.alias in scope.order:
                raise QueryError(f"two tables are called {ref.alias}")
            both = Scope(None, scope.columns | columns, [*scope.order, ref.alias], scope.keywords)
            if ref.how == "cross" or ref.on is None:
                both.frame = scope.frame.crossJoin(frame)
            else:
                both.frame = _Pair(scope.frame, frame)
                condition = Compiler(both).condition(ref.on)
                both.frame = scope.frame.join(frame, condition, ref.how)
                if ref.how in ("left_semi", "left_anti"):
                    both.columns, both.order = scope.columns, scope.order
                    numbers = numbers[:-1] if mode else numbers
            scope = both
        if mode:
            scope.frame = scope.frame.withColumn(ROWNR, F.struct(*[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(numbers)]))
        return scope

    def _ref(self, ref: TableRef) -> tuple[DataFrame, dict]:
        if ref.query is not None:
            return self.select(ref.query), {}
        return self.frame(ref.name)

    def _star(self, scope: Scope) -> list[Item]:
        if len(scope.order) == 1:
            return [Item(Name(c), c) for c in scope.frame.columns if c != ROWNR]
        return [Item(Name(c, t), inner) for (t, c), inner in scope.columns.items()]

    def _where(self, scope: Scope, where) -> Scope:
        """Conditions joined by AND; EXISTS and IN of a query among them become semi and anti joins."""
        parts, rest = [where], []
        while parts:
            p = parts.pop(0)
            if isinstance(p, Binary) and p.op == "and":
                parts = [p.left, p.right, *parts]
                continue
            negated = isinstance(p, Unary) and p.op == "not"
            inner = p.x if negated else p
            if isinstance(inner, Exists):
                found = self.select(inner.query).limit(1).select(F.lit(1).alias("_one"))
                scope = replace(scope, frame=scope.frame.join(found, F.lit(True), "left_anti" if negated else "left_semi"))
            elif isinstance(inner, In) and isinstance(inner.items, Query):
                found = self.select(inner.items)
                if len(found.columns) != 1:
                    raise QueryError("IN takes a query of one column")
                key = Compiler(Scope.of(found))(Name(found.columns[0]))
                found = found.select(key.col.alias("_in"))
                x = Compiler(scope)(inner.x)
                same = Compiler.compare("=", x, Value(F.col("_in"), key.kind))
                scope = replace(scope, frame=scope.frame.join(found, same, "left_anti" if negated != inner.negated else "left_semi"))
            else:
                rest.append(p)
        for p in rest:
            scope = replace(scope, frame=scope.frame.filter(Compiler(scope).condition(p)))
        return scope

    @staticmethod
    def _label(item: Item, used: set[str]) -> str:
        base = item.alias or (item.x.name if isinstance(item.x, Name) else item.x.name.lower() if isinstance(item.x, Call) and item.x.name in AGGREGATES else "expr")
        name, n = base, 1
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        return name

    def _outputs(self, compiler: Compiler, items: list[Item]):
        used: set[str] = set()
        out = []
        for item in items:
            name = self._label(item, used)
            v = compiler(item.x)
            frame = compiler.scope.frame
            if isinstance(item.x, Name) and (inner := compiler.scope.find(item.x)) and not compiler.scope.aggregated and isinstance(frame.schema[inner].dataType, (T.ArrayType, T.StructType)):
                v = replace(v, col=F.col(f"`{inner}`"))  # arrays and records come out as they are stored
            col = v.col
            if item.type:
                col = col.cast(managed.column_type(item.type))
            out.append(col.alias(name))
        return out

    def _constant(self, node, what: str) -> int:
        v = Compiler(Scope(self.spark.range(1)))(node)
        n = v.constant if isinstance(v.constant, int) else self.spark.range(1).select(v.col).first()[0]
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise QueryError(f"{what} must be a whole number, 0 or more")
        return n

    def _order(self, scope: Scope, keys: list[Key]):
        compiler = Compiler(scope)
        out = [compiler(k.x).col.asc() if k.ascending else compiler(k.x).col.desc() for k in keys]
        return [*out, F.col(ROWNR)] if ROWNR in scope.frame.columns else out

    def _limited(self, frame: DataFrame, q: Query) -> DataFrame:
        if q.offset is not None:
            frame = frame.offset(self._constant(q.offset, "OFFSET"))
        if q.limit is not None:
            frame = frame.limit(self._constant(q.limit, "LIMIT"))
        return frame

    def _plain(self, scope: Scope, q: Query) -> DataFrame:
        if q.order_distinct:
            compiler = Compiler(scope)
            w = Window.partitionBy(*[compiler(k.x).col for k in q.order]).orderBy(ROWNR)
            scope = replace(scope, frame=scope.frame.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth"))
        if not q.items:
            frame = scope.frame.orderBy(*self._order(scope, q.order)) if q.order or q.limit is not None or q.offset is not None else scope.frame
            return self._limited(frame, q).select(F.col(ROWNR).cast("long").alias("rownr"))
        if q.distinct:
            outputs = self._outputs(Compiler(scope), q.items)
            names = [f"_o{i}" for i in range(len(outputs))]
            labels = scope.frame.select(*outputs).columns
            keys = self._order(scope, q.order)[: len(q.order)]
            frame = scope.frame.select(*[c.alias(n) for c, n in zip(outputs, names, strict=True)], F.col(ROWNR), *[self._key(k, scope).alias(f"_k{i}") for i, k in enumerate(q.order)])
            del keys
            # the first of equal rows, in the order asked for
            direction = [F.col(f"_k{i}").asc() if k.ascending else F.col(f"_k{i}").desc() for i, k in enumerate(q.order)]
            if q.order:
                w = Window.partitionBy(*names).orderBy(*direction, ROWNR)
                frame = frame.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1")
            else:
                frame = frame.groupBy(*names).agg(F.min(ROWNR).alias(ROWNR))
            if q.order or q.limit is not None or q.offset is not None:
                frame = self._limited(frame.orderBy(*direction, ROWNR), q)
            return frame.select(*[F.col(n).alias(label) for n, label in zip(names, labels, strict=True)])
        frame = scope.frame
        if q.order or q.limit is not None or q.offset is not None:
            frame = frame.orderBy(*self._order(scope, q.order))
        return self._limited(frame, q).select(*self._outputs(Compiler(scope), q.items))

    def _key(self, k: Key, scope: Scope):
        return Compiler(scope)(k.x).col

    def _grouped(self, scope: Scope, q: Query) -> DataFrame:
        if not q.group:
            if q.having is not None:
                raise QueryError("HAVING needs GROUPBY")
            # rows are limited before they are aggregated
            if q.limit is not None or q.offset is not None:
                scope = replace(scope, frame=self._limited(scope.frame.orderBy(*self._order(scope, q.order)), q))
            made = self._aggregate(scope, q, [])
            return made.select(*[c for c in made.columns if not c.startswith("_")])
        made = self._aggregate(scope, q, q.group)
        labels = [c for c in made.columns if not c.startswith("_")]
        if q.having is not None:
            made = made.filter(F.col("_having"))
        if q.distinct:
            made = made.dropDuplicates(labels)
        if q.order or q.limit is not None or q.offset is not None:
            order = [F.col(f"_k{i}").asc() if k.ascending else F.col(f"_k{i}").desc() for i, k in enumerate(q.order)]
            made = self._limited(made.orderBy(*order, *(["_first"] if "_first" in made.columns else [])), q)
        return made.select(*labels)

    def _aggregate(self, scope: Scope, q: Query, group: list) -> DataFrame:
        """One row a group: the labels, and as hidden columns HAVING, the order keys and the first row's number."""
        plain = Compiler(scope)
        frame = scope.frame
        names = {n: f"_g{i}" for i, n in enumerate(group)}
        frame = frame.withColumns({names[n]: plain(n).col for n in group})
        inner = Compiler(replace(scope, frame=frame))
        grouped: list = []
        first = ROWNR in frame.columns

        def lift(node):
            """The node over the groups: aggregates and group keys become columns of the grouped frame."""
            if node in names:
                return _Made(names[node], inner(node).kind)
            if isinstance(node, Call) and node.name in AGGREGATES:
                v = Compiler(replace(scope, frame=frame, aggregated=True))(node)
                grouped.append(v.col.alias(f"_a{len(grouped)}"))
                return _Made(f"_a{len(grouped) - 1}", v.kind)
            if isinstance(node, Name) and group:
                v = inner(node)
                # a column that is no key is that of the group's first row
                grouped.append((F.min_by(v.col, F.col(ROWNR)) if first else F.first(v.col)).alias(f"_a{len(grouped)}"))
                return _Made(f"_a{len(grouped) - 1}", v.kind)
            if isinstance(node, Name):
                raise QueryError(f"{node.name} stands beside aggregates without GROUPBY")
            if isinstance(node, Call) and node.name in ("ROWNR", "ROWID"):
                grouped.append(F.min(ROWNR).alias(f"_a{len(grouped)}"))
                return _Made(f"_a{len(grouped) - 1}", "int")
            if isinstance(node, tuple):
                return tuple(lift(x) for x in node)
            if isinstance(node, (str, int, float, bool, type(None))) or not hasattr(node, "__dataclass_fields__"):
                return node
            return replace(node, **{k: lift(v) for k, v in vars(node).items()})

        items = [Item(lift(i.x), i.alias or self._default(i), i.type) for i in q.items]
        having = lift(q.having) if q.having is not None else None
        by_label = {i.alias: i.x for i in items if i.alias}
        order = [by_label[k.x.name] if isinstance(k.x, Name) and k.x.name in by_label and scope.find(k.x) is None else lift(k.x) for k in q.order] if group else []
        # a rollup's keys are null in the upper levels; otherwise groups are as they come
        deal = (frame.rollup if q.rollup else frame.groupBy)(*names.values())
        extra = [F.min(ROWNR).alias("_first")] if first and group else []
        made = deal.agg(*grouped, *extra) if grouped or extra else deal.agg(F.count(F.lit(1)).alias("_a"))
        over = _Over(Scope(made))
        used: set[str] = set()
        out = []
        for item in items:
            col = over(item.x).col
            out.append((col.cast(managed.column_type(item.type)) if item.type else col).alias(self._label(item, used)))
        if having is not None:
            out.append(over.condition(having).alias("_having"))
        out += [over(k).col.alias(f"_k{i}") for i, k in enumerate(order)]
        return made.select(*out, *(["_first"] if extra else []))

    @staticmethod
    def _default(item: Item) -> str:
        if isinstance(item.x, Name):
            return item.x.name
        if isinstance(item.x, Call) and item.x.name in AGGREGATES:
            return item.x.name.lower()
        return "expr"

    # --- other commands ---
    def _scope(self, name: str, rows: bool = True) -> Scope:
        frame, keywords = self.frame(name)
        scope = Scope.of(managed.numbered(frame) if rows else frame, name, keywords)
        scope.columns |= {("", c): i for (_, c), i in list(scope.columns.items())}
        return scope

    def _count(self, given: dict) -> DataFrame:
        scope = self._scope(given["table"], False)
        if given["where"] is not None:
            scope = self._where(scope, given["where"])
        if given["columns"]:
            items = [i for i in given["columns"] if not isinstance(i.x, Star)]
            if items:
                keys = self._outputs(Compiler(scope), items)
                return scope.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        return scope.frame.agg(F.count(F.lit(1)).alias("n_rows"))

    def _calc(self, given: dict) -> DataFrame:
        if given["table"] is not None:
            scope = self._scope(given["table"])
            return scope.frame.orderBy(ROWNR).select(Compiler(scope)(given["x"]).col.alias("expr"))
        return self.spark.range(1).select(Compiler(Scope(self.spark.range(1)))(given["x"]).col.alias("expr"))

    def _chosen(self, table: str, given: dict) -> tuple[Scope, object]:
        """The table's scope, and the condition on its rows: WHERE, and of those the first LIMIT rows in the order given."""
        scope = self._scope(table)
        hit = Compiler(scope).condition(given["where"]) if given["where"] is not None else F.lit(True)
        hit = F.coalesce(hit, F.lit(False))
        if given["limit"] is None and given["offset"] is None:
            return scope, hit
        q = Query(limit=given["limit"], offset=given["offset"])
        kept = self._limited(scope.frame.filter(hit).orderBy(*self._order(scope, given["order"] or [])), q).select(F.col(ROWNR).alias("_hit"))
        scope = replace(scope, frame=scope.frame.join(kept, F.col(ROWNR) == F.col("_hit"), "left"))
        return scope, F.col("_hit").isNotNull()

    def _update(self, given: dict) -> DataFrame:
        target = self._managed(given["table"])
        if given["from"]:
            raise QueryError("UPDATE takes values from its own table only")
        scope, hit = self._chosen(given["table"], given)
        schema = {f.name: f.dataType for f in target.frame().schema if f.name != ROWNR}
        new = {}
        compiler = Compiler(scope)
        for column, index, mask, x in given["set"]:
            if column not in schema:
                raise QueryError(f"unknown column {column}")
            if mask is not None:
                raise QueryError("masked updates are not possible")
            v = compiler(x).col
            if index is not None:
                v = _replaced(F.col(column), compiler(index).col, v)
            new[column] = F.when(hit, v.cast(schema[column])).otherwise(F.col(column))
        n = scope.frame.filter(hit).count()
        target.replace(scope.frame.withColumns(new).select(*schema, ROWNR))
        return self._rows(n)

    def _delete(self, given: dict) -> DataFrame:
        target = self._managed(given["table"])
        scope, hit = self._chosen(given["table"], given)
        n = scope.frame.filter(hit).count()
        target.replace(scope.frame.filter(~hit).select(*target.frame().columns, *([ROWNR] if ROWNR not in target.frame().columns else [])), renumber=True)
        return self._rows(n)

    def _insert(self, given: dict) -> DataFrame:
        target = self._managed(given["table"])
        columns = given["columns"] or [c for c in target.frame().columns if c != ROWNR]
        schema = {f.name: f.dataType for f in target.frame().schema}
        if unknown := [c for c in columns if c not in schema]:
            raise QueryError(f"unknown column {unknown[0]}")
        if given["query"] is not None:
            rows = self.select(given["query"])
            if len(rows.columns) != len(columns):
                raise QueryError(f"{len(columns)} columns, but {len(rows.columns)} values")
            rows = rows.toDF(*columns)
        else:
            compiler, made = Compiler(Scope(self.spark.range(1))), []
            for row in given["rows"]:
                if len(row) != len(columns):
                    raise QueryError(f"{len(columns)} columns, but {len(row)} values")
                made.append(F.struct(*[compiler(x).col.cast(schema[c]).alias(c) for c, x in zip(columns, row, strict=True)]))
            rows = self.spark.range(1).select(F.inline(F.array(*made)))
        return self._rows(target.append(rows))

    def _create(self, given: dict) -> DataFrame:
        if self.warehouse is None:
            raise QueryError("tables can be created in a warehouse only")
        if given.get("like"):
            frame, keywords = self.frame(given["like"])
            fields = [f for f in frame.schema if f.name != ROWNR and f.name not in given["drop"]]
            name = given.get("table") or given["like"] + "_copy"
            self.tables[name] = managed.Table.create(self.spark, self.warehouse, name, T.StructType(fields), keywords=keywords)
            return self._rows(0)
        fields = [managed.field(c) for c in given["columns"]]
        t = managed.Table.create(self.spark, self.warehouse, given["table"], T.StructType(fields))
        self.tables[given["table"]] = t
        if given.get("limit") is not None:
            t.add_rows(self._constant(given["limit"], "LIMIT"))
        return self._rows(t.frame().count())

    def _alter(self, given: dict) -> DataFrame:
        t = self._managed(given["table"])
        for what, *args in given["steps"]:
            if what == "addrow":
                t.add_rows(self._constant(args[0], "ADDROW"))
            elif what == "setkey":
                v = Compiler(Scope(self.spark.range(1)))(args[1])
                value = v.constant if v.constant is not None else self.spark.range(1).select(v.col).first()[0]
                t.set_keyword(args[0], value)
            elif what == "dropkey":
                t.drop_keyword(args[0])
            elif what in ("renamekey", "copykey"):
                t.set_keyword(args[1], t.keyword(args[0]))
                if what == "renamekey":
                    t.drop_keyword(args[0])
            elif what == "addcolumn":
                t.add_column(managed.field(args[0]))
            elif what == "copycolumn":
                t.replace(t.frame().withColumn(args[1], F.col(args[0])))
            elif what == "renamecolumn":
                t.replace(t.frame().withColumnRenamed(args[0], args[1]))
            elif what == "dropcolumn":
                if args[0] not in t.frame().columns:
                    raise QueryError(f"unknown column {args[0]}")
                t.replace(t.frame().drop(args[0]))
        return self._rows(t.frame().count())

    def _drop(self, given: dict) -> DataFrame:
        tables = {name: self._managed(name) for name in given["tables"]}
        for name, t in tables.items():
            if t.is_locked():
                raise QueryError(f"table {name} is locked")
        for name, t in tables.items():
            t.drop()
            del self.tables[name]
        return self._rows(len(given["tables"]))

    def _show(self, given: dict) -> DataFrame:
        lines = help_text.topic(given["topic"])
        return self.spark.createDataFrame([(x,) for x in lines], "text string")


def _replaced(array, index, value):
    """The array with another value at an index."""
    return F.transform(array, lambda x, k: F.when(k == index, value).otherwise(x))


class _Made(Name):
    """A column of the grouped frame, whose kind is known."""

    def __init__(self, name: str, kind: str):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "table", None)
        object.__setattr__(self, "kind", kind)


class _Over(Compiler):
    """Compiles expressions over a grouped frame."""

    def __call__(self, node):
        if isinstance(node, _Made):
            return Value(F.col(node.name), node.kind)
        return super().__call__(node)


class _Pair:
    """The schema of two frames that are about to be joined."""

    def __init__(self, left: DataFrame, right: DataFrame):
        self.columns = [*left.columns, *right.columns]
        self.schema = T.StructType([*left.schema.fields, *right.schema.fields])


def query(text: str, **tables: DataFrame) -> DataFrame:
    """Runs a SELECT, COUNT or CALC over DataFrames given by name."""
    frames = [t for t in tables.values() if isinstance(t, DataFrame)]
    spark = frames[0].sparkSession if frames else SparkSession.getActiveSession()
    return Session(spark, tables).sql(text)
