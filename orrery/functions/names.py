"""Resource names: slash-separated paths, patterns and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(name: Column) -> Column:
    """No empty segment, no slash at either end."""
    return name.rlike(r"^[^/]+(/[^/]+)*$")


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def parent(name: Column) -> Column:
    """Without the last two segments; null if there is nothing above."""
    n = F.size(F.split(name, "/"))
    return F.when(n > 2, F.array_join(F.slice(F.split(name, "/"), 1, F.greatest(n - 2, F.lit(1))), "/"))


def pattern_regex(pattern: str) -> str:
    """* is one segment, ** at the end one or more."""
    parts = ["[^/]+" if p == "*" else ".+" if p == "**" else re.escape(p) for p in pattern.split("/")]
    if "**" in pattern.split("/")[:-1]:
        raise ValueError("** may only stand at the end")
    return "^" + "/".join(parts) + "$"


def matches(name: Column, pattern: str) -> Column:
    return name.rlike(pattern_regex(pattern))


def placeholders(template: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", template)


def parse(name: Column, template: str) -> Column:
    """struct of the template's placeholders; null where the name does not fit."""
    regex = "^" + "/".join("([^/]+)" if re.fullmatch(r"\{\w+\}", p) else re.escape(p) for p in template.split("/")) + "$"
    fields = [F.regexp_extract(name, regex, i + 1).alias(p) for i, p in enumerate(placeholders(template))]
    return F.when(name.rlike(regex), F.struct(*fields))


def format_name(template: str, **values: Column) -> Column:
    parts = []
    for p in template.split("/"):
        m = re.fullmatch(r"\{(\w+)\}", p)
        parts.append(values[m[1]] if m else F.lit(p))
    return F.concat_ws("/", *parts)


def is_child(name: Column, parent_name: str, kind: str) -> Column:
    """Directly below parent/kind/."""
    prefix = f"{parent_name}/{kind}/"
    return name.startswith(prefix) & ~F.substring(name, F.lit(len(prefix) + 1), F.length(name)).contains("/") & (F.length(name) > len(prefix))
