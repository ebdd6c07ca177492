"""A restricted filter grammar: conjunctions of column-literal comparisons and null tests. All else is refused."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NAME = r'(?:"((?:[^"]|"")+)"|([A-Za-z_]\w*))'
_TERM = re.compile(rf"\s*{_NAME}\s*(?:(<=|>=|<>|!=|=|<|>)\s*('(?:[^']|'')*'|[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(IS\s+NOT\s+NULL|IS\s+NULL))\s*", re.I)
_AND = re.compile(r"AND\b", re.I)


class RefusedFilter(ValueError):
    """The text isn't a conjunction that the grammar has."""


def compile_filter(df: DataFrame, text: str) -> Column:
    """A column expression for a filter text over the columns of df."""
    out, at = None, 0
    while True:
        m = _TERM.match(text, at)
        if not m:
            raise RefusedFilter(text)
        name = m[1].replace('""', '"') if m[1] else m[2]
        if name not in df.columns:
            raise RefusedFilter(f"no column {name}")
        column = F.col(f"`{name}`")
        if m[5]:
            term = column.isNotNull() if "NOT" in m[5].upper() else column.isNull()
        else:
            value = m[4][1:-1].replace("''", "'") if m[4][0] == "'" else float(m[4]) if re.search("[.eE]", m[4]) else int(m[4])
            term = _OPS[m[3]](column, F.lit(value))
        out, at = term if out is None else out & term, m.end()
        if at == len(text):
            return out
        joint = _AND.match(text, at)
        if not joint:
            raise RefusedFilter(text)
        at = joint.end()


def columns_in(df: DataFrame, text: str) -> list[str]:
    """Columns of df that a filter text names outside of string literals."""
    bare = re.sub(r"'(?:[^']|'')*'", "", text)
    named = {name.replace('""', '"') for name in re.findall(r'"((?:[^"]|"")*)"', bare)} | set(re.findall(r"[A-Za-z_]\w*", re.sub(r'"(?:[^"]|"")*"', "", bare)))
    return [c for c in df.columns if c in named]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def cluster_predicate(labels: list[int] | None = None, exclude_noise: bool = True, label: str = "cluster_label") -> Column:
    """Labelled rows, of the given clusters if there are any, else without noise if so asked."""
    ok = F.col(label).isNotNull()
    if labels:
        return ok & F.col(label).isin(labels)
    return ok & (F.col(label) >= 0) if exclude_noise else ok
