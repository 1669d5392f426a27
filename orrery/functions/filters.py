"""Row predicates: spans, lifecycles, policies, and a small filter language.

All of them are plain columns, so that they stand below ranking and reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open spans; touching is no overlap."""
    return (a_start < b_end) & (b_start < a_end)


def span_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def span_valid(start: Column, end: Column) -> Column:
    """Inverted spans are refused, empty ones are not."""
    return (start >= 0) & (start <= end)


def live(deleted_at: Column) -> Column:
    return deleted_at.isNull()


def unexpired(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at > now)


def allowed(rules: list[tuple[str, Column, Column]], default_allow: bool = False) -> Column:
    """Policy decision by rules (effect, applies, predicate) in order; the first that applies and holds decides."""
    out = F.lit(default_allow)
    for effect, applies, predicate in reversed(rules):
        out = F.when(applies & predicate, F.lit(effect == "allow")).otherwise(out)
    return F.coalesce(out, F.lit(default_allow))


_TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z_][\w.]*)|(?P<number>-?\d+(?:\.\d+)?)|(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<sign><=|>=|!=|=|<|>|:|\(|\)|-|,|\*))")


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the filter at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *want: str) -> str:
        kind, value = self.peek()
        if want and value not in want:
            raise ValueError(f"expected {' or '.join(want)}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def expression(self) -> Column:
        out = self.factor()
        while self.peek()[1] == "AND":
            self.take()
            out = out & self.factor()
        return out

    def factor(self) -> Column:
        """OR binds more tightly than AND, as in AIP-160."""
        out = self.term()
        while self.peek()[1] == "OR":
            self.take()
            out = out | self.term()
        return out

    def term(self) -> Column:
        if self.peek()[1] in ("NOT", "-"):
            self.take()
            return ~self.term()
        if self.peek()[1] == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        return self.comparison()

    def value(self) -> Column:
        kind, value = self.peek()
        self.take()
        if kind == "number":
            return F.lit(float(value) if "." in value else int(value))
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "word" and value in ("true", "false"):
            return F.lit(value == "true")
        if kind == "word" and value == "null":
            return F.lit(None)
        if kind == "word":
            return F.lit(value)
        raise ValueError(f"expected a value, found {value or 'the end'!r}")

    def comparison(self) -> Column:
        kind, name = self.peek()
        if kind != "word":
            raise ValueError(f"expected a field, found {name or 'the end'!r}")
        self.take()
        if self.peek()[1] == "(" and name in ("overlaps", "contains"):
            self.take()
            field = self.take()
            self.take(",")
            start = self.value()
            self.take(",")
            end = self.value()
            self.take(")")
            f = span_overlaps if name == "overlaps" else span_contains
            return f(F.col(f"{field}.start_ms"), F.col(f"{field}.end_ms"), start, end)
        sign = self.take("=", "!=", "<", "<=", ">", ">=", ":")
        field = F.col(name)
        if self.peek() == ("word", "null"):
            self.take()
            return {"=": field.isNull(), "!=": field.isNotNull()}[sign]
        kind, raw = self.peek()
        if sign == ":" and raw == "*":
            self.take()
            return field.isNotNull()
        value = self.value()
        if sign == ":":
            return F.contains(field.cast("string"), value.cast("string"))
        if sign in ("=", "!=") and kind == "text" and "*" in raw:
            like = field.rlike("^" + ".*".join(map(re.escape, raw[1:-1].split("*"))) + "$")
            return like if sign == "=" else ~like
        return {"=": field == value, "!=": field != value, "<": field < value, "<=": field <= value, ">": field > value, ">=": field >= value}[sign]


def parse_filter(text: str) -> Column:
    """A filter string as a column: comparisons, AND, OR, NOT, parentheses, wildcards, overlaps() and contains()."""
    if not text.strip():
        return F.lit(True)
    p = _Parser(text)
    out = p.expression()
    if p.peek()[0] != "end":
        raise ValueError(f"unexpected {p.peek()[1]!r}")
    return out


def parse_order(text: str) -> list[Column]:
    """order_by: fields with an optional asc or desc."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, direction = part.partition(" ")
        if direction.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"cannot read the order {part!r}")
        out.append(F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc())
    return out


def masked(df: DataFrame, mask: str) -> DataFrame:
    """Only the fields of a read mask ("name,span.start_ms"; all for "" or "*"); parts of a struct stay in it, in its order."""
    paths = [p.strip() for p in mask.split(",") if p.strip()]
    if not paths or "*" in paths:
        return df
    parts: dict[str, list[str] | None] = {}
    for path in paths:
        top, _, rest = path.partition(".")
        if top not in df.columns or (rest and rest not in getattr(df.schema[top].dataType, "names", [])):
            raise ValueError(f"no such field: {path!r}")
        if not rest or parts.get(top, []) is None:
            parts[top] = None
        else:
            parts.setdefault(top, []).append(rest)
    whole = lambda n: F.col(n) if parts[n] is None else F.when(F.col(n).isNotNull(), F.struct(*[F.col(n)[x].alias(x) for x in df.schema[n].dataType.names if x in parts[n]])).alias(n)
    return df.select(*[whole(n) for n in df.columns if n in parts])
