"""Rule text to tree: a recursive-descent parser that points at errors."""

from __future__ import annotations

import re

from sparkrules.functions.allen import ARITY
from sparkrules.functions.exact import MODES
from sparkrules.plans.ir import (
    Accumulate, Call, Collect, Contains, Delete, Focus, Group, GroupBy, In, Insert, Lit, Matches, Modify, Op, Pattern, Program, QueryDef, Ref, RuleDef, RuleError, Temporal,
)

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/|(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?[dD]?|\d+[lLdDB]?(?![\w.]))|(?P<dur>\d+(?:ms|s|m|h|d)\b)
    |(?P<id>[$A-Za-z_][\w$]*(?:-(?:point|group|loop))?)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>=!(){}\[\],;:.?])""",
    re.X | re.S,
)
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
FUNCTIONS = ("sum", "count", "average", "min", "max", "averageExact", "collectList", "collectSet")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                self.fail(f"unexpected character {text[at]!r}", at)
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(m.lastgroup), at))
            at = m.end()
        self.i = 0

    # --- tokens

    def fail(self, what: str, at: int | None = None):
        if at is None:
            at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        line = self.text.count("\n", 0, at) + 1
        column = at - (self.text.rfind("\n", 0, at) + 1)
        source = self.text.splitlines()[line - 1] if self.text else ""
        raise RuleError(f"line {line}, column {column + 1}: {what}\n{source}\n{' ' * column}^")

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.i + k][1] if self.i + k < len(self.tokens) else None

    def kind(self, k: int = 0) -> str | None:
        return self.tokens[self.i + k][0] if self.i + k < len(self.tokens) else None

    def next(self) -> str:
        if self.i >= len(self.tokens):
            self.fail("unexpected end")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def take(self, *words: str) -> str | None:
        if self.peek() in words and self.kind() != "str":
            return self.next()
        return None

    def need(self, word: str) -> str:
        if not self.take(word):
            self.fail(f"expected {word!r}, found {self.peek()!r}")
        return word

    def ident(self) -> str:
        if self.kind() != "id":
            self.fail(f"expected a name, found {self.peek()!r}")
        return self.next()

    @staticmethod
    def unquote(s: str) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1] if m[1] in '"\\' else "\\" + m[1]), s[1:-1])

    # --- program

    def program(self) -> Program:
        out = Program()
        while self.i < len(self.tokens):
            if self.take("package", "import"):
                while self.peek() not in (";", "rule", "query", "import", None):
                    self.next()
                self.take(";")
            elif self.take("rule"):
                out.rules.append(self.rule())
            elif self.take("query"):
                q = self.query()
                out.queries[q.name] = q
            else:
                self.fail(f"expected rule or query, found {self.peek()!r}")
        return out

    def name(self) -> str:
        return self.unquote(self.next()) if self.kind() == "str" else self.ident()

    def rule(self) -> RuleDef:
        name, salience, loop, group = self.name(), 0, False, "MAIN"
        while not self.take("when"):
            if self.take("salience"):
                if self.take("("):
                    salience = self.sum()
                    self.need(")")
                else:
                    minus = self.take("-")
                    salience = int(self.next()) * (-1 if minus else 1)
            elif self.take("no-loop"):
                loop = self.take("true", "false") != "false"
            elif self.take("agenda-group"):
                group = self.name()
            elif self.peek() == "then":
                break
            else:
                self.fail(f"unknown attribute {self.peek()!r}")
        lhs = []
        while not self.take("then"):
            lhs.append(self.condition())
            self.take(";")
        actions = []
        while not self.take("end"):
            actions.append(self.action())
        return RuleDef(name, tuple(lhs), tuple(actions), salience, loop, group)

    def query(self) -> QueryDef:
        name, params = self.name(), []
        if self.take("("):
            while not self.take(")"):
                params.append((self.ident(), self.ident()))
                self.take(",")
        body = []
        while not self.take("end"):
            body.append(self.condition())
            self.take(";")
        if len(body) == 1 and isinstance(body[0], Group) and body[0].kind == "or":
            parts = tuple(p.parts if isinstance(p, Group) and p.kind == "and" else (p,) for p in body[0].parts)
        else:
            parts = (tuple(body),)
        return QueryDef(name, tuple(params), parts)

    # --- conditions

    def condition(self):
        left = [self.conjunction()]
        while self.take("or", "||"):
            left.append(self.conjunction())
        return left[0] if len(left) == 1 else Group("or", tuple(left))

    def conjunction(self):
        left = [self.unary()]
        while self.take("and", "&&"):
            left.append(self.unary())
        return left[0] if len(left) == 1 else Group("and", tuple(left))

    def unary(self):
        for word in ("not", "exists"):
            if self.take(word):
                return Group(word, (self.unary(),))
        if self.peek() == "(":
            self.next()
            word = self.take("or", "and")
            if word:  # prefix form
                parts = []
                while not self.take(")"):
                    parts.append(self.unary())
                return Group(word, tuple(parts))
            inner = self.condition()
            self.need(")")
            return inner
        if self.take("?"):
            return self.call()
        if self.peek() in ("accumulate", "acc"):
            return self.accumulate()
        if self.peek() == "groupby":
            return self.groupby()
        return self.pattern()

    def call(self) -> Call:
        name = self.ident()
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.sum())
            self.take(",", ";")
        return Call(name, tuple(args))

    def pattern(self):
        var = None
        if self.kind() == "id" and self.peek(1) == ":":
            var = self.ident()
            self.next()
        name = self.ident()
        if self.peek() == "(" and name[0].islower() and var is None:  # a query, written without its mark
            self.i -= 1
            return self.call()
        self.need("(")
        bindings, conditions, k = [], [], 0
        while not self.take(")"):
            start = self.i
            if self.kind() in ("id", "num", "str") and self.peek(1) in (",", ";") and self._positional():
                conditions.append(Op("positional", (Lit(k), self.primary())))
                k += 1
            else:
                self.i = start
                conditions.append(self.constraint(bindings))
            self.take(",", ";")
        entry = None
        if self.take("from"):
            if self.take("entry-point"):
                entry = self.name()
            else:
                self.need("collect")
                self.need("(")
                source = self.pattern()
                self.need(")")
                if name not in ("List", "ArrayList", "Collection"):
                    self.fail("collect gives a List")
                return Collect(source, var)
        return Pattern(name, var, tuple(bindings), tuple(conditions), entry)

    def _positional(self) -> bool:
        """The rest up to a semicolon is a list of plain values."""
        k = 0
        while self.kind(k) in ("id", "num", "str"):
            if self.peek(k + 1) == ";":
                return True
            if self.peek(k + 1) != ",":
                # values before this one may already have been taken; a close means none follow
                return False
            k += 2
        return False

    def constraint(self, bindings: list):
        left = self.both(bindings)
        while self.take("||"):
            left = Op("or", (left, self.both(bindings)))
        return left

    def both(self, bindings: list):
        left = self.single(bindings)
        while self.take("&&"):
            left = Op("and", (left, self.single(bindings)))
        return left

    def single(self, bindings: list):
        if self.take("!"):
            self.need("(")
            inner = self.constraint(bindings)
            self.need(")")
            return Op("not", (inner,))
        if self.peek() == "this":
            self.next()
            return self.temporal()
        if self.peek() == "(" and self._boolean_paren():
            self.next()
            inner = self.constraint(bindings)
            self.need(")")
            self.last = getattr(self, "last", None)
            return inner
        if self.peek() in ("==", "!=", "<", "<=", ">", ">=") or (self.peek() in ("in", "not", "matches", "contains") and self.kind() == "id"):
            return self.restriction(self.last)  # abbreviated: the field before
        if self.kind() == "id" and self.peek(1) == ":":
            var = self.ident()
            self.next()
            fieldname = self.ident()
            bindings.append((var, fieldname))
            self.last = Ref(fieldname)
            if self.peek() in (",", ")", ";", "&&", "||"):
                return Lit(True)
            return self.restriction(self.last)
        left = self.sum()
        self.last = left
        if self.peek() in (",", ")", ";") and isinstance(left, Ref):
            return Op("==", (left, Lit(True)))
        return self.restriction(left)

    def _boolean_paren(self) -> bool:
        """Whether a parenthesis holds a comparison rather than arithmetic."""
        depth, k = 0, 0
        while self.peek(k) is not None:
            t = self.peek(k)
            depth += (t == "(") - (t == ")")
            if depth == 0:
                return self.peek(k + 1) in (",", ")", "&&", "||", ";")
            k += 1
        return False

    def restriction(self, left):
        if op := self.take("==", "!=", "<=", ">=", "<", ">"):
            right = self.sum()
            self.last = left
            if isinstance(right, Lit) and right.value is None:
                if op not in ("==", "!="):
                    self.fail("null has no order")
                return Op("is_null" if op == "==" else "is_not_null", (left,))
            return Op(op, (left, right))
        negated = bool(self.take("not"))
        if self.take("in"):
            self.need("(")
            values = []
            while not self.take(")"):
                values.append(self.literal())
                self.take(",")
            return In(left, tuple(values), negated)
        if negated:
            self.fail("not must be followed by in")
        if self.take("matches"):
            return Matches(left, self.unquote(self.next()))
        if self.take("contains"):
            return Contains(left, self.unquote(self.next()))
        self.fail(f"expected a comparison, found {self.peek()!r}")

    def temporal(self):
        negated = bool(self.take("not"))
        name = self.ident()
        if name not in ARITY:
            self.fail(f"no temporal relation {name}")
        bounds = []
        if self.take("["):
            while not self.take("]"):
                bounds.append(self.duration())
                self.take(",")
        return Temporal(name, tuple(bounds), self.ident(), negated)

    def duration(self) -> int:
        if self.kind() == "dur":
            t = self.next()
            m = re.fullmatch(r"(\d+)(\w+)", t)
            return int(m[1]) * _UNITS[m[2]]
        return int(self.next())

    # --- values

    def literal(self):
        minus = self.take("-")
        if self.kind() == "str":
            return Lit(self.unquote(self.next()))
        if self.kind() == "num":
            t = self.next()
            number = float(t.rstrip("dD")) if "." in t or t[-1] in "dD" else int(t.rstrip("lLB"))
            return Lit(-number if minus else number)
        word = self.ident()
        if word in ("true", "false"):
            return Lit(word == "true")
        if word == "null":
            return Lit(None)
        self.fail(f"expected a literal, found {word!r}")

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = Op(op, (left, self.product()))
        return left

    def product(self):
        left = self.primary()
        while op := self.take("*", "/", "%"):
            left = Op(op, (left, self.primary()))
        return left

    def primary(self):
        if self.take("("):
            inner = self.sum()
            self.need(")")
            return inner
        if self.take("-"):
            inner = self.primary()
            return Lit(-inner.value) if isinstance(inner, Lit) else Op("neg", (inner,))
        if self.kind() in ("str", "num") or self.peek() in ("true", "false", "null"):
            return self.literal()
        name = self.ident()
        if self.take("."):
            part = self.ident()
            if self.take("("):
                self.need(")")
                for prefix in ("get", "is"):
                    if part.startswith(prefix) and part[len(prefix) :]:
                        part = part[len(prefix) :]
                        part = part[0].lower() + part[1:]
                        break
            return Ref(name, part)
        return Ref(name)

    # --- aggregates

    def function(self):
        fn = self.ident()
        if fn not in FUNCTIONS:
            self.fail(f"no aggregate {fn}")
        self.need("(")
        args = []
        while not self.take(")"):
            if self.kind() == "id" and self.peek() in MODES:
                args.append(Lit(self.next()))
            else:
                args.append(self.sum())
            self.take(",")
        arg = args[0] if args else None
        params = tuple(a.value for a in args[1:])
        if fn == "averageExact":
            params = (params[0], str(params[1]).lower())
        elif params:
            self.fail(f"{fn} takes one argument")
        return fn, arg, params

    def window(self):
        if not self.take("over"):
            return None
        self.need("window")
        self.need(":")
        kind = self.ident()
        self.need("(")
        n = self.duration()
        self.need(")")
        if kind not in ("time", "length") or n < 1:
            self.fail("a window is time(duration) or length(number), at least 1")
        return kind, n

    def accumulate(self) -> Accumulate:
        self.next()
        self.need("(")
        source = self.pattern()
        window = self.window()
        self.take(";", ",")
        result = self.ident()
        self.need(":")
        fn, arg, params = self.function()
        conditions = []
        if self.take(";"):
            while self.peek() != ")":
                left = self.sum()
                conditions.append(self.restriction(left))
                self.take(",")
        self.need(")")
        return Accumulate(source, fn, arg, result, params, window, tuple(conditions))

    def groupby(self) -> GroupBy:
        self.next()
        self.need("(")
        source = self.pattern()
        self.need(";")
        key = self.ident()
        self.need(";")
        result = self.ident()
        self.need(":")
        fn, arg, params = self.function()
        self.need(")")
        return GroupBy(source, key, fn, arg, result, params)

    # --- consequences

    def action(self):
        start = self.i
        word = self.ident()
        if word in ("insert", "insertLogical"):
            self.need("(")
            self.need("new")
            kind, args = self.ident(), []
            self.need("(")
            while not self.take(")"):
                args.append(self.sum())
                self.take(",")
            self.need(")")
            self.take(";")
            return Insert(kind, tuple(args), word == "insertLogical")
        if word in ("delete", "retract"):
            self.need("(")
            var = self.ident()
            self.need(")")
            self.take(";")
            return Delete(var)
        if word == "update":
            self.need("(")
            var = self.ident()
            self.need(")")
            self.take(";")
            return Modify(var, ())
        if word == "modify":
            self.need("(")
            var = self.ident()
            self.need(")")
            self.need("{")
            changes = []
            while not self.take("}"):
                changes.append(self.setter())
                self.take(",", ";")
            self.take(";")
            return Modify(var, tuple(changes))
        if word == "drools":
            self.need(".")
            self.need("setFocus")
            self.need("(")
            group = self.name()
            self.need(")")
            self.take(";")
            return Focus(group)
        if self.take("."):
            change = self.setter()
            self.take(";")
            return Modify(word, (change,), False)
        self.i = start
        self.fail(f"unknown consequence {word!r}")

    def setter(self):
        name = self.ident()
        if not name.startswith("set"):
            self.fail("expected a setter")
        self.need("(")
        value = self.sum()
        self.need(")")
        name = name[3:]
        return name[0].lower() + name[1:], value


def parse(text: str) -> Program:
    return Parser(text).program()
