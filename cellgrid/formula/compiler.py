"""Formulas to column expressions: a tokenizer, a precedence parser and a typed compiler.

A formula over cells that are columns of a frame (`A1` -> a column) becomes one expression for the
value and one for the error, so a column of copies of a formula is a single projection that Catalyst
sees through. Errors travel beside values; the first one wins. Blanks read as 0, "" or FALSE.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrid.functions.registry import FUNCTIONS

_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<str>\"(?:[^\"]|\"\")*\")|(?P<err>#(?:N/A|DIV/0!|VALUE!|REF!|NAME\?|NUM!|NULL!))"
    r"|(?P<call>[A-Za-z_][\w.]*)\(|(?P<name>(?:'[^']*'!|\w+!)?\$?[A-Za-z_][\w.$]*(?::\$?[A-Za-z]+\$?\d+)?)|(?P<op><=|>=|<>|[-+*/^&=<>%(),]))"
)
#: Binary operators and how tightly they bind. A sign before an operand binds tighter than all of them, a percent sign tighter still.
_BINDING = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}


@dataclass(frozen=True)
class Node:
    kind: str  # num, str, bool, err, ref, call, bin, neg, pct
    value: object = None
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(formula: str) -> Node:
    rest = tokens(formula.removeprefix("="))[::-1]

    def peek():
        return rest[-1] if rest else ("end", "")

    def take(op: str) -> None:
        if not rest or rest.pop() != ("op", op):
            raise ValueError(f"expected {op!r} in {formula!r}")

    def operand() -> Node:
        if not rest:
            raise ValueError(f"{formula!r} ends early")
        kind, text = rest.pop()
        if (kind, text) in (("op", "-"), ("op", "+")):
            inner = operand()
            return Node("neg", args=(inner,)) if text == "-" else inner
        if kind == "num":
            node = Node("num", float(text))
        elif kind == "str":
            node = Node("str", text[1:-1].replace('""', '"'))
        elif kind == "err":
            node = Node("err", text)
        elif kind == "name":
            node = Node("bool", text.upper() == "TRUE") if text.upper() in ("TRUE", "FALSE") else Node("ref", text.replace("$", ""))
        elif kind == "call":
            args: list[Node] = []
            while peek() != ("op", ")"):
                args.append(Node("blank") if peek() == ("op", ",") else binary(1))
                if peek() == ("op", ","):
                    rest.pop()
                elif peek() != ("op", ")"):
                    raise ValueError(f"expected a comma in {formula!r}")
            take(")")
            node = Node("call", text.upper().removeprefix("_XLFN."), tuple(args))
        elif (kind, text) == ("op", "("):
            node = binary(1)
            take(")")
        else:
            raise ValueError(f"unexpected {text!r} in {formula!r}")
        while peek() == ("op", "%"):
            rest.pop()
            node = Node("pct", args=(node,))
        return node

    def binary(least: int) -> Node:
        left = operand()
        while peek()[0] == "op" and _BINDING.get(peek()[1], 0) >= least:
            op = rest.pop()[1]
            left = Node("bin", op, (left, binary(_BINDING[op] + 1)))
        return left

    tree = binary(1)
    if rest:
        raise ValueError(f"{rest[-1][1]!r} is left over in {formula!r}")
    return tree


@dataclass(frozen=True)
class Value:
    """An expression with its type (n, s or b) and the error that it has instead of a value (null: none)."""

    type: str
    col: Column
    err: Column | None = None


def _errors(*values: Value) -> Column | None:
    found = [v.err for v in values if v.err is not None]
    return F.coalesce(*found) if found else None


def _either(first: Column | None, own: Column) -> Column:
    return own if first is None else F.coalesce(first, own)


def as_number(v: Value) -> Value:
    if v.type == "n":
        return Value("n", F.coalesce(v.col, F.lit(0.0)), v.err)
    if v.type == "b":
        return Value("n", F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err)
    number = v.col.try_cast("double")
    return Value("n", F.when(v.col.isNull(), 0.0).otherwise(number), _either(v.err, F.when(v.col.isNotNull() & number.isNull(), "#VALUE!")))


def shown(n: Column) -> Column:
    """A number as text: whole ones without a point."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(n.cast("string"))


def as_text(v: Value) -> Value:
    text = {"s": v.col, "b": F.upper(v.col.cast("string")), "n": shown(v.col)}[v.type]
    return Value("s", F.coalesce(text, F.lit("")), v.err)


def as_boolean(v: Value) -> Value:
    if v.type == "b":
        return Value("b", F.coalesce(v.col, F.lit(False)), v.err)
    if v.type == "n":
        return Value("b", F.coalesce(v.col, F.lit(0.0)) != 0, v.err)
    known = F.upper(v.col).isin("TRUE", "FALSE")
    return Value("b", F.upper(v.col) == "TRUE", _either(v.err, F.when(~known, "#VALUE!")))


_RANK = {"n": 1, "s": 2, "b": 3}


def _compared(op: str, a: Value, b: Value) -> Value:
    """Number < text < boolean; text in any case; a blank takes the other side's type."""
    if a.type != b.type:
        if op in ("=", "<>"):
            return Value("b", F.lit(op == "<>"), _errors(a, b))
        less = _RANK[a.type] < _RANK[b.type]
        return Value("b", F.lit(less if op[0] == "<" else not less), _errors(a, b))
    empty = {"n": F.lit(0.0), "s": F.lit(""), "b": F.lit(False)}[a.type]
    x, y = F.coalesce(a.col, empty), F.coalesce(b.col, empty)
    if a.type == "s":
        x, y = F.upper(x), F.upper(y)
    col = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return Value("b", col, _errors(a, b))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    a, b = as_number(a), as_number(b)
    err = _errors(a, b)
    x, y = a.col, b.col
    if op == "/":
        return Value("n", F.try_divide(x, y), _either(err, F.when(y == 0, "#DIV/0!")))
    if op == "^":
        power = F.pow(x, y)
        bad = F.isnan(power) | (F.abs(power) == float("inf")) | ((x == 0) & (y == 0))
        return Value("n", F.when(~bad, power), _either(err, F.when((x == 0) & (y < 0), "#DIV/0!").when(bad, "#NUM!")))
    return Value("n", {"+": x + y, "-": x - y, "*": x * y}[op], err)


#: Functions of which every argument is text, or the result is; others take and give numbers.
_TEXT = set("LEN UPPER LOWER PROPER LEFT RIGHT MID CONCAT CONCATENATE REPT TRIM CLEAN EXACT FIND SEARCH SUBSTITUTE TEXTBEFORE TEXTAFTER REGEXTEST REGEXREPLACE REGEXEXTRACT CODE UNICODE ENCODEURL".split())
_NUMERIC_ARGUMENT = {"LEFT": {1}, "RIGHT": {1}, "MID": {1, 2}, "REPT": {1}, "FIND": {2}, "SEARCH": {2}}
_GIVES = dict.fromkeys("LEN FIND SEARCH CODE UNICODE".split(), "n") | dict.fromkeys("EXACT REGEXTEST ISEVEN ISODD".split(), "b")


def compiled(node: Node, cells: dict[str, Value]) -> Value:
    if node.kind == "num":
        return Value("n", F.lit(node.value))
    if node.kind == "str":
        return Value("s", F.lit(node.value))
    if node.kind == "bool":
        return Value("b", F.lit(node.value))
    if node.kind == "blank":
        return Value("n", F.lit(None).cast("double"))
    if node.kind == "err":
        return Value("n", F.lit(None).cast("double"), F.lit(node.value))
    if node.kind == "ref":
        if node.value not in cells:
            return Value("n", F.lit(None).cast("double"), F.lit("#NAME?"))
        return cells[node.value]
    if node.kind == "neg":
        v = as_number(compiled(node.args[0], cells))
        return Value("n", -v.col, v.err)
    if node.kind == "pct":
        v = as_number(compiled(node.args[0], cells))
        return Value("n", v.col / 100, v.err)
    if node.kind == "bin":
        a, b = (compiled(x, cells) for x in node.args)
        if node.value == "&":
            a, b = as_text(a), as_text(b)
            return Value("s", F.concat(a.col, b.col), _errors(a, b))
        return _compared(node.value, a, b) if _BINDING[node.value] == 1 else _arithmetic(node.value, a, b)
    return _called(node.value, [compiled(x, cells) for x in node.args])


def _is(kind: str):
    return lambda v, err: Value("b", err.isNull() & v.col.isNotNull() if v.type == kind else F.lit(False))


#: Numbers of errors and of types: fixed values.
_ERROR_TYPES = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8}
_TYPES = {"n": 1.0, "s": 2.0, "b": 4.0}


def _error_type(err):
    number = F.lit(None).cast("double")
    for literal, n in _ERROR_TYPES.items():
        number = F.when(err == literal, float(n)).otherwise(number)
    return Value("n", number, F.when(number.isNull(), "#N/A"))


#: Functions about a value, which take errors and do not pass them on.
_ABOUT = {
    "ISERROR": lambda v, err: Value("b", err.isNotNull()),
    "ISNA": lambda v, err: Value("b", F.coalesce(err == "#N/A", F.lit(False))),
    "ISERR": lambda v, err: Value("b", F.coalesce(err != "#N/A", F.lit(False))),
    "ISBLANK": lambda v, err: Value("b", err.isNull() & v.col.isNull()),
    "ISNUMBER": _is("n"),
    "ISTEXT": _is("s"),
    "ISLOGICAL": _is("b"),
    "ISNONTEXT": lambda v, err: Value("b", ~_is("s")(v, err).col),
    "TYPE": lambda v, err: Value("n", F.when(err.isNotNull(), 16.0).when(v.col.isNull(), 1.0).otherwise(_TYPES[v.type])),
    "ERROR.TYPE": lambda v, err: _error_type(err),
}


def _called(name: str, args: list[Value]) -> Value:
    if name == "IF":
        test, yes, *no = args
        no = no[0] if no else Value("b", F.lit(False))
        test = as_boolean(test)
        if yes.type != no.type:
            yes, no = as_text(yes), as_text(no)
        branch = F.when(test.col, yes.err if yes.err is not None else F.lit(None)).otherwise(no.err if no.err is not None else F.lit(None))
        return Value(yes.type, F.when(test.col, yes.col).otherwise(no.col), _either(test.err, branch.cast("string")))
    if name in ("IFERROR", "IFNA"):
        value, other = args
        if value.err is None:
            return value
        caught = value.err.isNotNull() if name == "IFERROR" else value.err == "#N/A"
        if value.type != other.type:
            value, other = as_text(value), as_text(other)
        other_err = other.err if other.err is not None else F.lit(None).cast("string")
        return Value(value.type, F.when(caught, other.col).otherwise(value.col), F.when(caught, other_err).otherwise(value.err))
    if name == "NA":
        return Value("n", F.lit(None).cast("double"), F.lit("#N/A"))
    if name in _ABOUT:
        (value,) = args
        return _ABOUT[name](value, value.err if value.err is not None else F.lit(None).cast("string"))
    if name in ("AND", "OR", "NOT", "XOR"):
        args = [as_boolean(a) for a in args]
        return Value("b", FUNCTIONS[name](*(a.col for a in args)), _errors(*args))
    if name in ("SUM", "AVERAGE", "MIN", "MAX", "COUNT", "PRODUCT"):  # of the cells of a row; blanks and text don't count
        numbers = [a for a in args if a.type == "n"]
        err = _errors(*args)
        there = F.filter(F.array(*(a.col.cast("double") for a in numbers)), lambda x: x.isNotNull()) if numbers else F.array().cast("array<double>")
        total = F.aggregate(there, F.lit(0.0), lambda t, x: t + x)
        n = F.size(there)
        if name == "AVERAGE":
            return Value("n", F.try_divide(total, n), _either(err, F.when(n == 0, "#DIV/0!")))
        out = {
            "SUM": lambda: total, "COUNT": lambda: n.cast("double"), "MIN": lambda: F.coalesce(F.array_min(there), F.lit(0.0)), "MAX": lambda: F.coalesce(F.array_max(there), F.lit(0.0)),
            "PRODUCT": lambda: F.when(n == 0, 0.0).otherwise(F.aggregate(there, F.lit(1.0), lambda t, x: t * x)),
        }[name]()
        return Value("n", out, None if name == "COUNT" else err)
    if FUNCTIONS.get(name) is None:
        return Value("n", F.lit(None).cast("double"), F.lit("#NAME?"))
    if name in _TEXT:
        numeric = _NUMERIC_ARGUMENT.get(name, set())
        args = [as_number(a) if i in numeric else as_text(a) for i, a in enumerate(args)]
        kind = _GIVES.get(name, "s")
    else:
        args = [as_number(a) for a in args]
        kind = _GIVES.get(name, "n")
    out = FUNCTIONS[name](*(a.col for a in args))
    lacking = "#VALUE!" if name in _TEXT else "#DIV/0!" if name in ("MOD", "QUOTIENT") else "#NUM!"
    out = out.cast("double") if kind == "n" else out
    return Value(kind, out, _either(_errors(*args), F.when(out.isNull(), lacking)))


def typed(name: str, dtype: str) -> Value:
    """A column as a cell's value."""
    kind = "b" if dtype == "boolean" else "s" if dtype == "string" else "n"
    return Value(kind, F.col(name).cast("double") if kind == "n" else F.col(name))


def evaluate(frame, formula: str, cells: dict[str, str], out: str = "value"):
    """`frame` with `out` and `out`_err: the formula over columns, `cells` naming the column behind each reference."""
    kinds = dict(frame.dtypes)
    value = compiled(parse(formula), {ref: typed(c, kinds[c]) for ref, c in cells.items()})
    err = value.err if value.err is not None else F.lit(None).cast("string")
    return frame.withColumns({out: F.when(err.isNull(), value.col), f"{out}_err": err})
