"""SQL that Spark's parser lacks, rewritten over tokens before spark.sql: QUALIFY and DISTINCT ON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", re.S)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _depths(parts: list[str]) -> list[int]:
    out, d = [], 0
    for p in parts:
        d -= p == ")"
        out.append(d)
        d += p == "("
    return out


def _at(parts: list[str], word: str, start: int = 0) -> int | None:
    depth = _depths(parts)
    return next((i for i in range(start, len(parts)) if depth[i] == 0 and parts[i].upper() == word), None)


def rewrite(text: str) -> str:
    """One SELECT at the top level; strings, quoted names and comments are left alone."""
    parts = tokens(text.strip().rstrip(";"))
    return "".join(_qualify(tokens("".join(_distinct_on(parts)))))


def _qualify(parts: list[str]) -> list[str]:
    q = _at(parts, "QUALIFY")
    if q is None:
        return parts
    end = next((i for i in (_at(parts, "ORDER", q), _at(parts, "LIMIT", q)) if i is not None), len(parts))
    select, source = _at(parts, "SELECT"), _at(parts, "FROM")
    condition = "".join(parts[q + 1 : end]).strip()
    inner = [*parts[: source], f", ({condition}) AS _qualify ", *parts[source:q]]
    return ["SELECT * EXCEPT (_qualify) FROM (", *inner, ") AS _q WHERE _qualify ", *parts[end:]] if select is not None else parts


def _distinct_on(parts: list[str]) -> list[str]:
    d = _at(parts, "DISTINCT")
    if d is None:
        return parts
    on = next((i for i in range(d + 1, len(parts)) if not parts[i].isspace()), None)
    if on is None or parts[on].upper() != "ON":
        return parts
    depth = _depths(parts)
    opened = next(i for i in range(on, len(parts)) if parts[i] == "(")
    closed = next(i for i in range(opened + 1, len(parts)) if parts[i] == ")" and depth[i] == depth[opened])
    keys = "".join(parts[opened + 1 : closed])
    order = _at(parts, "ORDER")
    by = "".join(parts[order:]) if order is not None else f"ORDER BY {keys}"
    body = parts[closed + 1 : order if order is not None else len(parts)]
    return [*parts[:d], *body, f" QUALIFY row_number() OVER (PARTITION BY {keys} {by}) = 1"]


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """spark.sql of the rewritten text; tables are named in braces."""
    return spark.sql(rewrite(text), **tables)
