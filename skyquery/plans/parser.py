"""Recursive-descent parser of the table query language.

Precedence, loosest first: OR, AND, NOT, comparison, ``|``, ``^``, ``&``, ``+ -``, ``* / // %``,
``**`` (to the right), unary (tighter than ``**``: -2**2 is 4), postfix. Whatever is left over
at the end of a query is an error.
"""

from __future__ import annotations

from .lexer import QueryError, Token, tokens
from .syntax import AGGREGATES, Around, ArrayOf, Between, Binary, Call, Exists, In, Item, Key, Keyword, Like, Literal, Matches, Name, Pattern, Query, Range, RecordOf, Star, Statement, Subscript, TableRef, Unary, WithUnit
from ..functions.units import LITERAL_UNITS

# Words that cannot be an implicit alias or column.
RESERVED = frozenset(
    "SELECT FROM WHERE GROUPBY GROUP BY ROLLUP HAVING ORDERBY ORDER LIMIT OFFSET GIVING INTO AS JOIN ON LEFT RIGHT FULL INNER OUTER CROSS SEMI ANTI AND OR NOT IN BETWEEN LIKE ILIKE EXISTS AROUND INCONE DMINFO WITH UNION SET VALUES DISTINCT ASC DESC".split()
)


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokens(text), 0

    # --- helpers ---
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def fail(self, what: str):
        raise QueryError(f"{what} expected at {self.now.at}, found {self.now.text or 'the end'!r}")

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead) if ahead else self.now
        return t.kind == "name" and t.value != "quoted" and t.text.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += 1
            return True
        return False

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "op" and self.now.text in ops

    def op(self, *ops: str) -> str | None:
        if self.is_op(*ops):
            self.i += 1
            return self.tokens[self.i - 1].text
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(repr(op))

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail("a name")
        self.i += 1
        return self.tokens[self.i - 1].text

    def table_name(self) -> str:
        if self.now.kind == "string":
            self.i += 1
            return str(self.tokens[self.i - 1].value)
        if self.is_word(*RESERVED):
            self.fail("a table")
        name = self.name()
        while self.is_op(".") and self.peek().kind == "name" and self.peek().glued:
            self.i += 1
            name += "." + self.name()
        return name

    def end(self) -> None:
        self.op(";")
        if self.now.kind != "end":
            self.fail("the end of the query")

    # --- statements ---
    def statement(self) -> Query | Statement:
        while self.is_word("TIMING", "STYLE"):
            style = self.is_word("STYLE")
            self.i += 1
            if style:
                self.name()
        for word, parse in (
            ("SELECT", self.select), ("WITH", self.with_), ("UPDATE", self.update), ("INSERT", self.insert), ("DELETE", self.delete), ("COUNT", self.count),
            ("CALC", self.calc), ("CREATE", self.create), ("ALTER", self.alter), ("DROP", self.drop), ("SHOW", self.show), ("HELP", self.show),
        ):
            if self.is_word(word):
                self.i += 1
                out = parse()
                self.end()
                return out
        query = Query(items=self.items())
        self.clauses(query)
        self.end()
        return query

    def with_(self) -> Query:
        withs = [self.named_table()]
        while self.op(","):
            withs.append(self.named_table())
        self.need_word("SELECT")
        query = self.select()
        query.withs = withs
        return query

    def named_table(self) -> TableRef:
        if self.op("("):
            inner = self.inner_select()
            self.need_word("AS")
            alias = self.name()
            return TableRef(alias, alias, inner)
        name = self.table_name()
        self.need_word("AS")
        if self.is_op("(") and self.is_word("SELECT", ahead=1):  # name AS (SELECT ...)
            self.i += 1
            return TableRef(name, name, self.inner_select())
        return TableRef(name, self.name())

    def inner_select(self) -> Query:
        """What stands in parentheses, the opening one of which is read."""
        self.need_word("SELECT")
        query = self.select()
        self.need(")")
        return query

    def select(self) -> Query:
        query = Query(distinct=self.word("DISTINCT"))
        self.word("ALL")
        if not self.is_word("FROM", "WHERE", "GROUPBY", "ORDERBY", "LIMIT", "OFFSET", "GIVING", "INTO") and self.now.kind != "end" and not self.is_op(")"):
            query.items = self.items()
        self.clauses(query)
        return query

    def items(self) -> list[Item]:
        out = [self.item()]
        while self.op(","):
            out.append(self.item())
        return out

    def item(self) -> Item:
        if self.op("*"):
            return Item(Star())
        x, alias, kind = self.expression(), None, None
        if self.word("AS"):
            alias = self.name()
            if self.now.kind == "name" and self.now.text.upper() not in RESERVED:
                kind = self.name().upper()
        return Item(x, alias, kind)

    def clauses(self, q: Query) -> None:
        if self.word("INTO", "GIVING"):
            q.giving = self.table_name()
            self.options()
        if self.word("FROM"):
            q.tables.append(self.table())
            while True:
                if self.op(","):
                    q.tables.append(self.table())
                elif how := self.join_kind():
                    ref = self.table()
                    on = self.expression() if self.word("ON") else None
                    if on is None and how != "cross":
                        self.fail("ON")
                    q.tables.append(TableRef(ref.name, ref.alias, ref.query, on, how))
                else:
                    break
        if self.word("WHERE"):
            q.where = self.expression()
        if self.word("GROUPBY") or (self.is_word("GROUP") and self.word("GROUP") and (self.need_word("BY") or True)):
            q.rollup = self.word("ROLLUP")
            q.group.append(self.expression())
            while self.op(","):
                q.group.append(self.expression())
        if self.word("HAVING"):
            q.having = self.expression()
        if self.word("ORDERBY") or (self.is_word("ORDER") and self.word("ORDER") and (self.need_word("BY") or True)):
            q.order_distinct = self.word("DISTINCT", "NODUPL")
            q.order.append(self.key())
            while self.op(","):
                q.order.append(self.key())
        while self.is_word("LIMIT", "OFFSET"):
            which = self.name().lower()
            if getattr(q, which) is not None:
                self.fail(f"one {which.upper()}")
            setattr(q, which, self.expression())
        if self.word("GIVING", "INTO"):
            if q.giving is not None:
                self.fail("one GIVING")
            q.giving = self.table_name()
            self.options()
        if self.word("DMINFO"):
            self.skip_brackets()

    def options(self) -> None:
        if self.word("AS"):
            if self.is_op("["):
                self.skip_brackets()
            else:
                self.name()

    def skip_brackets(self) -> None:
        self.need("[")
        depth = 1
        while depth:
            if self.now.kind == "end":
                self.fail("']'")
            depth += {"[": 1, "]": -1}.get(self.now.text, 0) if self.now.kind == "op" else 0
            self.i += 1

    def join_kind(self) -> str | None:
        for words, how in ((("LEFT",), "left"), (("RIGHT",), "right"), (("FULL",), "full"), (("CROSS",), "cross"), (("INNER",), "inner"), (("SEMI",), "left_semi"), (("ANTI",), "left_anti")):
            if self.is_word(*words):
                self.i += 1
                if how == "left" and self.is_word("SEMI", "ANTI"):
                    how = "left_" + self.name().lower()
                self.word("OUTER")
                self.need_word("JOIN")
                return how
        return "inner" if self.word("JOIN") else None

    def table(self) -> TableRef:
        if self.op("("):
            inner = self.inner_select()
            alias = self.name() if self.word("AS") or (self.now.kind == "name" and self.now.text.upper() not in RESERVED) else "_sub"
            return TableRef(alias, alias, inner)
        name = self.table_name()
        if self.word("AS"):
            return TableRef(name, self.name())
        if self.now.kind == "name" and self.now.text.upper() not in RESERVED:
            return TableRef(name, self.name())
        return TableRef(name, name)

    def key(self) -> Key:
        x = self.expression()
        return Key(x, not self.word("DESC") and (self.word("ASC") or True))

    def update(self) -> Statement:
        given = {"table": self.table_name(), "set": []}
        self.need_word("SET")
        while True:
            column, index, mask = None, None, None
            if self.op("("):
                column = self.name()
                self.need(",")
                mask = self.name()
                self.need(")")
            else:
                column = self.name()
                if self.op("["):
                    index = self.expression()
                    self.need("]")
            self.need("=")
            given["set"].append((column, index, mask, self.expression()))
            if not self.op(","):
                break
        return Statement("UPDATE", given | self.restricted())

    def restricted(self) -> dict:
        q = Query()
        self.clauses(q)
        return {"where": q.where, "order": q.order, "limit": q.limit, "offset": q.offset, "from": q.tables}

    def insert(self) -> Statement:
        self.need_word("INTO")
        given: dict = {"table": self.table_name(), "columns": None, "rows": [], "query": None}
        if self.word("SET"):
            given["columns"], row = [], []
            while True:
                given["columns"].append(self.name())
                self.need("=")
                row.append(self.expression())
                if not self.op(","):
                    break
            given["rows"].append(row)
            return Statement("INSERT", given)
        bracket = {"(": ")", "[": "]"}.get(self.now.text) if self.now.kind == "op" else None
        if bracket:
            self.i += 1
            given["columns"] = [self.name()]
            while self.op(","):
                given["columns"].append(self.name())
            self.need(bracket)
        if self.word("SELECT"):
            given["query"] = self.select()
            return Statement("INSERT", given)
        self.need_word("VALUES")
        while True:
            close = {"(": ")", "[": "]"}.get(self.op("(", "[") or "")
            if not close:
                self.fail("'('")
            row = [self.expression()]
            while self.op(","):
                row.append(self.expression())
            self.need(close)
            given["rows"].append(row)
            if not self.op(","):
                break
        return Statement("INSERT", given)

    def delete(self) -> Statement:
        self.need_word("FROM")
        return Statement("DELETE", {"table": self.table_name()} | self.restricted())

    def count(self) -> Statement:
        columns = []
        if not self.is_word("FROM"):
            columns = self.items()
        self.need_word("FROM")
        return Statement("COUNT", {"table": self.table_name(), "columns": columns} | self.restricted())

    def calc(self) -> Statement:
        x = self.expression()
        return Statement("CALC", {"x": x, "table": self.table_name() if self.word("FROM") else None})

    def create(self) -> Statement:
        self.need_word("TABLE")
        if self.word("LIKE"):
            given = {"like": self.table_name(), "drop": []}
            if self.word("DROP"):
                self.need_word("COLUMN")
                given["drop"] = self.names()
            if self.word("AS"):
                given["table"] = self.table_name()
            return Statement("CREATE", given)
        given = {"table": self.table_name(), "columns": [], "like": None}
        if self.word("LIKE"):
            given["like"], given["drop"] = self.table_name(), []
            if self.word("DROP"):
                self.need_word("COLUMN")
                given["drop"] = self.names()
            return Statement("CREATE", given)
        close = {"(": ")", "[": "]"}.get(self.op("(", "[") or "")
        if close:
            while True:
                given["columns"].append(self.column_spec())
                if not self.op(","):
                    break
            self.need(close)
        if self.word("LIMIT"):
            given["limit"] = self.expression()
        if self.word("DMINFO"):
            self.skip_brackets()
        return Statement("CREATE", given)

    def column_spec(self) -> dict:
        spec = {"name": self.name(), "type": self.name().upper()}
        square = self.op("[")
        while self.now.kind == "name" and self.now.text.upper() in ("NDIM", "SHAPE", "UNIT", "COMMENT", "DIRECTION"):
            what = self.name().lower()
            self.need("=")
            if self.now.kind in ("string", "int", "float"):
                spec[what] = self.now.value
                self.i += 1
            elif self.op("["):
                shape = []
                while not self.op("]"):
                    if self.now.kind != "int":
                        self.fail("a number")
                    shape.append(self.now.value)
                    self.i += 1
                    self.op(",")
                spec[what] = shape
            else:
                self.fail("a value")
            if square:
                self.op(",")
        if square:
            self.need("]")
        return spec

    def names(self) -> list[str]:
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        return out

    def alter(self) -> Statement:
        self.need_word("TABLE")
        table, steps = self.table_name(), []
        while self.now.kind == "name":
            if self.word("ADDROW"):
                steps.append(("addrow", self.expression()))
            elif self.word("SET") and (self.word("KEYWORD") or True) or self.word("SETKEY"):
                while True:
                    key = self.keyword_name()
                    self.need("=")
                    steps.append(("setkey", key, self.expression()))
                    if not self.op(",") or (self.now.kind == "name" and self.peek().text not in ("=", ".", "::")):
                        break
            elif self.word("DROPKEY"):
                steps += [("dropkey", k) for k in self.keyword_names()]
            elif self.word("RENAMEKEY", "COPYKEY"):
                what = self.tokens[self.i - 1].text.lower()
                old = self.keyword_name()
                if not self.word("TO", "AS"):
                    self.need("=")
                new = self.keyword_name()
                steps.append((what, *((old, new) if what == "renamekey" or self.tokens[self.i - 2].text.upper() in ("TO", "AS") else (new, old))))
            elif self.word("ADD"):
                self.need_word("COLUMN")
                while True:
                    steps.append(("addcolumn", self.column_spec()))
                    if not self.op(","):
                        break
            elif self.word("COPY", "RENAME"):
                what = self.tokens[self.i - 1].text.lower()
                self.need_word("COLUMN")
                while True:
                    old = self.name()
                    if self.word("TO", "AS"):
                        new = self.name()
                    else:
                        self.need("=")
                        old, new = self.name(), old
                    steps.append((what + "column", old, new))
                    if not self.op(","):
                        break
            elif self.word("DROP"):
                if self.word("KEYWORD"):
                    steps += [("dropkey", k) for k in self.keyword_names()]
                else:
                    self.need_word("COLUMN")
                    steps += [("dropcolumn", c) for c in self.names()]
            else:
                self.fail("an ALTER action")
            self.op(",")
        if not steps:
            self.fail("an ALTER action")
        return Statement("ALTER", {"table": table, "steps": steps})

    def keyword_name(self) -> str:
        name = self.name()
        while self.op("::", "."):
            name += "." + self.name()
        return name

    def keyword_names(self) -> list[str]:
        out = [self.keyword_name()]
        while self.op(","):
            out.append(self.keyword_name())
        return out

    def drop(self) -> Statement:
        self.need_word("TABLE")
        out = [self.table_name()]
        while self.op(","):
            out.append(self.table_name())
        return Statement("DROP", {"tables": out})

    def show(self) -> Statement:
        return Statement("SHOW", {"topic": [self.name().lower() for _ in iter(lambda: self.now.kind == "name", False)]})

    # --- expressions ---
    def expression(self):
        x = self.conjunction()
        while self.word("OR") or self.op("||"):
            x = Binary("or", x, self.conjunction())
        return x

    def conjunction(self):
        x = self.negation()
        while self.word("AND") or self.op("&&"):
            x = Binary("and", x, self.negation())
        return x

    def negation(self):
        if self.word("NOT") or self.op("!"):
            return Unary("not", self.negation())
        return self.comparison()

    def comparison(self):
        if self.is_word("EXISTS") and self.peek().text == "(":
            self.i += 2
            return Exists(self.inner_select())
        x = self.bits_or()
        negated = self.is_word("NOT") and self.is_word("IN", "LIKE", "ILIKE", "BETWEEN", ahead=1) and self.word("NOT")
        if op := self.op("=", "==", "!=", "<>", "<=", ">=", "<", ">", "~=", "!~="):
            return Binary({"==": "=", "<>": "!="}.get(op, op), x, self.bits_or())
        if op := self.op("~", "!~"):
            return Matches(x, self.pattern(), op == "!~")
        if self.word("IN"):
            return self.membership(x, negated)
        if self.word("BETWEEN"):
            low = self.bits_or()
            self.need_word("AND")
            return Between(x, low, self.bits_or(), negated)
        if self.is_word("LIKE", "ILIKE"):
            return self.like(x, negated)
        if self.word("AROUND"):
            centre = self.bits_or()
            self.need_word("IN")
            return Around(x, centre, self.bits_or())
        if self.word("INCONE"):
            return Call("INCONE", (x, self.bits_or()))
        return x

    def like(self, x, negated: bool):
        ignore = self.name().upper() == "ILIKE"
        return Like(x, self.bits_or(), ignore, negated)

    def pattern(self):
        if self.now.kind == "regex":
            self.i += 1
            return Pattern(*self.tokens[self.i - 1].value)
        return self.bits_or()

    def membership(self, x, negated: bool):
        close = {"[": "]", "(": ")", "{": "}"}.get(self.now.text) if self.now.kind == "op" else None
        if not close:
            return In(x, (self.bits_or(),), negated)
        self.i += 1
        if close == ")" and self.is_word("SELECT"):
            return In(x, self.inner_select(), negated)
        items = []
        if not self.is_op(close):
            items.append(self.expression())
            while self.op(","):
                items.append(self.expression())
        self.need(close)
        return In(x, tuple(items), negated)

    def _left(self, below, *ops):
        x = below()
        while op := self.op(*ops):
            x = Binary(op, x, below())
        return x

    def bits_or(self):
        return self._left(self.bits_xor, "|")

    def bits_xor(self):
        return self._left(self.bits_and, "^")

    def bits_and(self):
        return self._left(self.sum, "&")

    def sum(self):
        return self._left(self.product, "+", "-")

    def product(self):
        return self._left(self.power, "*", "/", "//", "%")

    def power(self):
        x = self.unary()
        return Binary("**", x, self.power()) if self.op("**") else x

    def unary(self):
        if op := self.op("-", "+", "~"):
            return Unary(op, self.unary())
        return self.postfix()

    def postfix(self):
        x = self.primary()
        while True:
            if self.is_op("[") and self.now.glued:
                self.i += 1
                index = [self.index()]
                while self.op(","):
                    index.append(self.index())
                self.need("]")
                x = Subscript(x, tuple(index))
            elif self.now.kind == "name" and self.now.value != "quoted" and self.now.text.upper() in LITERAL_UNITS:
                x = WithUnit(x, self.name())
            else:
                return x

    def index(self):
        start = None if self.is_op(":") else self.expression()
        if not self.op(":"):
            return start
        stop = None if self.is_op("]", ",", ":") else self.expression()
        step = self.expression() if self.op(":") and not self.is_op("]", ",") else None
        return Range(start, stop, step)

    def primary(self):
        t = self.now
        if t.kind in ("int", "float", "complex", "string"):
            self.i += 1
            return Literal(t.value, {"int": "int", "float": "double", "complex": "complex", "string": "string"}[t.kind])
        if self.op("("):
            x = self.expression()
            self.need(")")
            return x
        if self.op("["):
            return self.bracket()
        if self.op("::"):
            return Keyword(self.keyword_name())
        if t.kind != "name":
            self.fail("an expression")
        upper = t.text.upper()
        called = self.peek().kind == "op" and self.peek().text == "("
        dotted = self.peek().kind == "op" and self.peek().text in (".", "::")
        if t.value != "quoted" and not called and not dotted:
            if upper in ("TRUE", "FALSE"):
                self.i += 1
                return Literal(upper == "TRUE", "bool")
            if upper in ("T", "F"):
                self.i += 1
                return Name(t.text) if self.peek(0).text == "." else Literal(upper == "T", "bool")
            if upper in RESERVED:
                self.fail("an expression")
        self.i += 1
        if called and t.value != "quoted":
            self.i += 1
            distinct = self.word("DISTINCT")
            args = []
            if not self.is_op(")"):
                args.append(Star() if self.op("*") else self.expression())
                while self.op(","):
                    args.append(self.expression())
            self.need(")")
            if distinct and upper not in AGGREGATES:
                raise QueryError(f"DISTINCT in {t.text}, which is no aggregate")
            return Call(upper, tuple(args), distinct)
        if self.op("::"):
            return Keyword(self.keyword_name(), t.text)
        if self.is_op(".") and self.peek().kind == "name":
            self.i += 1
            return Name(self.name(), t.text)
        return Name(t.text)

    def bracket(self):
        if self.now.kind == "name" and self.peek().text == "=" and self.peek().kind == "op":
            fields = []
            while True:
                name = self.name()
                self.need("=")
                fields.append((name, self.expression()))
                if not self.op(","):
                    break
            self.need("]")
            return RecordOf(tuple(fields))
        items = []
        if not self.is_op("]"):
            items.append(self.expression())
            while self.op(","):
                items.append(self.expression())
        self.need("]")
        return ArrayOf(tuple(items))


def parse(text: str) -> Query | Statement:
    return Parser(text).statement()


def parse_expression(text: str):
    p = Parser(text)
    x = p.expression()
    p.end()
    return x
