"""Recursive descent over the tokens. From loosest to tightest: OR, AND, NOT, IS, = and !=, < and the like, IN, + -, * / %, ^ (all to the left)."""

from __future__ import annotations

from .. import errors
from ..functions.aggregates import NAMES as AGGREGATES
from . import ast
from .lexer import tokens

SIZES = ("tiny", "small", "medium", "big", "large", "huge")
SCOPES = ("scope", "schema", "database")
#: Words that end an alias-less expression or table.
STOP = {"from", "where", "group", "order", "having", "limit", "as", "join", "left", "inner", "on", "and", "or", "not", "is", "in", "between", "when", "then", "else", "end", "asc", "desc", "set", "use", "ignore", "into", "values"}


class Parser:
    def __init__(self, sql: str):
        self.all, self.at = tokens(sql), 0

    # tokens
    @property
    def token(self):
        return self.all[self.at]

    def error(self, wanted: str) -> errors.EngineError:
        return errors.ParserError(f"{wanted} expected, not {self.token.text or 'the end'!r} at {self.token.at}")

    def peek(self, *words: str) -> bool:
        return self.token.kind in ("name", "sign") and self.token.low in words

    def accept(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.all[self.at - 1].low
        return None

    def expect(self, *words: str) -> str:
        if got := self.accept(*words):
            return got
        raise self.error(" or ".join(words).upper())

    def kind(self, kind: str) -> str:
        if self.token.kind != kind:
            raise self.error(f"a {kind}")
        self.at += 1
        return self.all[self.at - 1].text

    def name(self) -> str:
        return self.kind("name")

    def whole(self) -> int:
        text = self.kind("number")
        if "." in text:
            raise errors.ParserError(f"a whole number expected, not {text}")
        return int(text)

    def listed(self, one, open_: str = "(", close: str = ")") -> list:
        self.expect(open_)
        out = []
        if not self.accept(close):
            out.append(one())
            while self.accept(","):
                out.append(one())
            self.expect(close)
        return out

    # statements
    def statements(self) -> list:
        out = []
        while self.token.kind != "end":
            if self.accept(";"):
                continue
            out.append(self.statement())
            if self.token.kind != "end":
                self.expect(";")
        return out

    def statement(self):
        word = self.token.low
        if word == "select":
            return self.select()
        if (f := getattr(self, f"_{word}", None)) and self.token.kind == "name":
            self.at += 1
            return f()
        raise self.error("a statement")

    def _create(self):
        size = self.accept(*SIZES)
        stamped = bool(self.accept("stamped"))
        what = self.expect(*SCOPES, "type", "edge", "index", "storage", "procedure", "proc", "lock")
        what = {"schema": "scope", "database": "scope", "proc": "procedure"}.get(what, what)
        name, args = self.name(), {}
        if what in ("type", "edge"):
            args = {"fields": self.listed(self.field) if self.peek("(") else [], "stamped": stamped}
            if self.accept("storage"):
                self.expect("=")
                args["storage"] = self.name()
        elif what == "index":
            self.expect("on")
            args = {"on": self.name(), "fields": self.listed(self.name), "size": size}
        elif what == "storage":
            args = {"options": {"size": size} if size else {}}
            if self.accept("set"):
                while True:
                    key = self.expect("allocsize", "largesize", "sorters", "compression", "encryption", "stress", "size", "sizing", "disk")
                    self.expect("=")
                    value = self.kind(self.token.kind) if self.token.kind in ("number", "text", "name") else None
                    if value is None:
                        raise self.error("a value")
                    args["options"][key] = int(value) if value.isdigit() else value
                    if not self.accept(","):
                        break
        elif what == "procedure":
            self.expect(".")
            function = self.name()
            params = self.listed(self.field)
            self.expect("language")
            args = {"module": name, "params": params, "language": self.name().lower()}
            name = function
        if self.accept("if"):
            self.expect("not")
            self.expect("exists")
            args["quiet"] = True
        return ast.Statement(f"create {what}", name, args)

    def field(self) -> dict:
        out = {"name": self.name(), "type": self.name()}
        while word := self.accept("pk", "inc", "stamp", "origin", "destin", "destination", "primary", "key"):
            out[{"destination": "destin", "primary": "pk", "key": "pk"}.get(word, word)] = True
        return out

    def _drop(self):
        what = self.expect(*SCOPES, "type", "edge", "index", "storage", "procedure", "proc", "lock", "period")
        what = {"schema": "scope", "database": "scope", "proc": "procedure"}.get(what, what)
        if what == "period":
            self.expect("on")
            name = self.name()
            self.expect("where")
            return ast.Statement("drop period", name, {"where": self.expression()})
        name, args = self.name(), {}
        if self.accept("if"):
            self.expect("exists")
            args["quiet"] = True
        return ast.Statement(f"drop {what}", name, args)

    def _show(self):
        return ast.Statement("show", self.name().lower())

    def _desc(self):
        return ast.Statement("describe", self.name())

    _describe = _desc

    def _use(self):
        return ast.Statement("use", self.name())

    def _fetch(self):
        return ast.Statement("fetch", args={"id": self.whole()})

    def _close(self):
        return ast.Statement("close", args={"id": self.whole()})

    def _exec(self):
        name = self.name()
        if self.accept("."):
            name = self.name()
        return ast.Statement("exec", name, {"values": self.listed(self.expression)})

    _execute = _exec

    def _lock(self):
        name, mode, timeout = self.name(), "writing", None
        if self.accept("for"):
            mode = self.expect("reading", "writing")
        if self.accept("set"):
            self.expect("timeout")
            self.expect("=")
            timeout = self.whole()
        return ast.Statement("lock", name, {"mode": mode, "timeout": timeout})

    def _unlock(self):
        return ast.Statement("unlock", self.name())

    def _load(self):
        path = self.kind("text")
        self.expect("into")
        name, args = self.name(), {"path": path, "header": None, "errors": None}
        while True:
            if how := self.accept("use", "ignore"):
                self.expect("header")
                args["header"] = how
            elif self.accept("set"):
                self.expect("errors")
                self.expect("=")
                args["errors"] = self.kind("text")
            elif self.accept("as"):
                self.name()  # an older form; the target says what it is
            else:
                return ast.Statement("load", name, args)

    def _insert(self):
        self.expect("into")
        name = self.name()
        fields = self.listed(self.name) if self.peek("(") else None
        if self.peek("select"):
            return ast.Statement("insert select", name, {"fields": fields, "query": self.select()})
        if not self.accept("values") and fields is None:
            raise self.error("VALUES")
        return ast.Statement("insert", name, {"fields": fields, "values": self.listed(self.expression)})

    def _update(self):
        name = self.name()
        self.expect("set")
        sets = []
        while True:
            field = self.name()
            self.expect("=")
            sets.append((field, self.expression()))
            if not self.accept(","):
                break
        return ast.Statement("update", name, {"set": sets, "where": self.expression() if self.accept("where") else None})

    def _delete(self):
        self.expect("from")
        return ast.Statement("delete", self.name(), {"where": self.expression() if self.accept("where") else None})

    # queries
    def select(self) -> ast.Select:
        self.expect("select")
        distinct = bool(self.accept("distinct"))
        items = [self.item()]
        while self.accept(","):
            items.append(self.item())
        if not self.accept("from"):
            return ast.Select(tuple(items), distinct=distinct)
        table, alias = self.table()
        joins, q = [], {}
        if self.peek(","):
            raise errors.NotSupportedError("more than one table; use JOIN ... ON origin or destin")
        while self.peek("join", "inner", "left"):
            how = self.accept("inner", "left") or "inner"
            self.accept("outer")
            self.expect("join")
            other, as_ = self.table()
            self.expect("on")
            joins.append(ast.Join(other, self.expect("origin", "destin"), how, as_))
        if self.accept("where"):
            q["where"] = self.expression()
        if self.accept("group"):
            self.expect("by")
            q["group"] = tuple(self.several(self.expression))
        if self.accept("having"):
            q["having"] = self.expression()
        if self.accept("order"):
            self.expect("by")
            q["order"] = tuple(self.several(lambda: (self.expression(), self.accept("asc", "desc") == "desc")))
        if self.accept("limit"):
            q["limit"] = self.whole()
        return ast.Select(tuple(items), table, alias, tuple(joins), distinct=distinct, **q)

    def several(self, one) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    def table(self) -> tuple[str, str | None]:
        name = self.name()
        if self.accept(":"):
            return self.name(), name
        if self.accept("as") or self.token.kind == "name" and self.token.low not in STOP:
            return name, self.name()
        return name, None

    def item(self) -> ast.Item:
        if self.accept("*"):
            return ast.Item(None)
        e = self.expression()
        return ast.Item(e, self.name() if self.accept("as") else None)

    # expressions
    def expression(self):
        a = self.conjunction()
        while self.accept("or"):
            a = ast.Bin("or", a, self.conjunction())
        return a

    def conjunction(self):
        a = self.negation()
        while self.accept("and"):
            a = ast.Bin("and", a, self.negation())
        return a

    def negation(self):
        if op := self.accept("not", "just"):
            return ast.Un(op, self.negation())
        return self.test()

    def test(self):
        a = self.equality()
        while self.accept("is"):
            negated = bool(self.accept("not"))
            self.expect("null")
            a = ast.IsNull(a, negated)
        return a

    def equality(self):
        a = self.order()
        while op := self.accept("=", "!=", "<>"):
            a = ast.Bin(op, a, self.order())
        return a

    def order(self):
        a = self.member()
        while op := self.accept("<=", ">=", "<", ">"):
            a = ast.Bin(op, a, self.member())
        return a

    def member(self):
        a = self.sum()
        while True:
            negated = self.peek("not") and self.all[self.at + 1].low in ("in", "between")
            if not negated and not self.peek("in", "between"):
                return a
            if negated:
                self.at += 1
            if self.accept("in"):
                a = ast.InQuery(a, query, negated) if (query := self.subquery()) else ast.In(a, tuple(self.listed(self.expression)), negated)
            else:
                a = self.between(a)
                a = ast.Un("not", a) if negated else a

    def subquery(self) -> ast.Select | None:
        """A query in parentheses, if there is one."""
        if not (self.peek("(") and self.all[self.at + 1].low == "select"):
            return None
        self.expect("(")
        q = self.select()
        self.expect(")")
        return q

    def between(self, a):
        """BETWEEN x AND y, or an interval: [ ] with the ends, ] [ without."""
        self.expect("between")
        if low := self.accept("[", "]"):
            x = self.sum()
            self.expect(",")
            y = self.sum()
            high = self.expect("[", "]")
            return ast.Bin("and", ast.Bin(">=" if low == "[" else ">", a, x), ast.Bin("<=" if high == "]" else "<", a, y))
        x = self.sum()
        self.expect("and")
        return ast.Bin("and", ast.Bin(">=", a, x), ast.Bin("<=", a, self.sum()))

    def sum(self):
        a = self.product()
        while op := self.accept("+", "-"):
            a = ast.Bin(op, a, self.product())
        return a

    def product(self):
        a = self.power()
        while op := self.accept("*", "/", "%"):
            a = ast.Bin(op, a, self.power())
        return a

    def power(self):
        a = self.signed()
        while self.accept("^"):
            a = ast.Bin("^", a, self.signed())
        return a

    def signed(self):
        if op := self.accept("-", "+"):
            a = self.signed()
            if isinstance(a, ast.Lit) and isinstance(a.value, (int, float)):
                return ast.Lit(-a.value if op == "-" else a.value)
            return ast.Un("-", a) if op == "-" else a
        return self.atom()

    def atom(self):
        t = self.token
        if t.kind == "number":
            self.at += 1
            return ast.Lit(float(t.text) if "." in t.text else int(t.text))
        if t.kind == "text":
            self.at += 1
            return ast.Lit(t.text)
        if query := self.subquery():
            return ast.Scalar(query)
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        if t.kind != "name":
            raise self.error("an expression")
        if (word := t.low) in ("true", "false", "null"):
            self.at += 1
            return ast.Lit({"true": True, "false": False, "null": None}[word])
        if word == "case":
            return self.case()
        if word == "exists" and self.all[self.at + 1].low == "(" and self.all[self.at + 2].low == "select":
            self.at += 1
            return ast.Exists(self.subquery())
        if word in STOP:
            raise self.error("an expression")
        name = self.name()
        if self.accept("."):
            return ast.Field(self.name(), name)
        if not self.peek("("):
            return ast.Field(name)
        if word in AGGREGATES:
            self.expect("(")
            if self.accept("*"):
                self.expect(")")
                return ast.Call(word, (), star=True)
            distinct = bool(self.accept("distinct"))
            args = self.several(self.expression)
            self.expect(")")
            return ast.Call(word, tuple(args), distinct=distinct)
        return ast.Call(word, tuple(self.listed(self.expression)))

    def case(self):
        self.expect("case")
        whens, other = [], ast.Lit(None)
        while self.accept("when"):
            c = self.expression()
            self.expect("then")
            whens.append((c, self.expression()))
        if not whens:
            raise self.error("WHEN")
        if self.accept("else"):
            other = self.expression()
        self.expect("end")
        return ast.Case(tuple(whens), other)


def parse(sql: str) -> list:
    """The statements of a script."""
    return Parser(sql).statements()
