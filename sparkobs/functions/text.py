"""Redaction, templates and severities of log bodies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four redactions in the order in which they apply, each with its replacement.
REDACTIONS = (
    (r"""(?i)([?&](?:api[_-]?key|access[_-]?token|auth(?:orization)?|client[_-]?secret|password|passwd|secret|token)=)[^&\s'"]+""", "$1[REDACTED]"),
    (r"(?i)(\b(?:bearer|basic)\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"""(?i)(\b(?:api[_-]?key|access[_-]?token|authorization|client[_-]?secret|password|passwd|secret|token)\b\s*[:=]\s*)(?:"[^"]*"|'[^']*'|[^\s,;&]+(?:\s+\[REDACTED\])?)""", "$1[REDACTED]"),
    (r"""(?i)("(?:api[_-]?key|access[_-]?token|auth(?:orization)?|client[_-]?secret|password|passwd|secret|token)"\s*:\s*)"(?:[^"\\]|\\.)*\"""", '$1"[REDACTED]"'),
)
# The eight template patterns in the order in which they apply, each with its placeholder.
TEMPLATES = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<time>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b", "<ip>"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<email>"),
    (r"\b0x[0-9a-fA-F]{4,}\b|\b[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"(/[a-zA-Z0-9._-]+){2,}(\?[^\s\"]*)?", "<path>"),
    (r'"[^"]{1,200}"', "<str>"),
    (r"\b\d+(\.\d+)?\b", "<num>"),
)
# Severity bands in ascending order, and what else they are called.
BANDS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ALIASES = {
    "fatal": "FATAL", "crit": "FATAL", "critical": "FATAL", "emerg": "FATAL", "emergency": "FATAL", "alert": "FATAL", "panic": "FATAL",
    "error": "ERROR", "err": "ERROR", "severe": "ERROR", "exception": "ERROR",
    "warn": "WARN", "warning": "WARN",
    "info": "INFO", "information": "INFO", "informational": "INFO", "notice": "INFO",
    "debug": "DEBUG", "dbg": "DEBUG", "fine": "DEBUG",
    "trace": "TRACE", "verbose": "TRACE", "finest": "TRACE",
}
#: A word boundary over ASCII alone; the JVM's own also counts other letters.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
BODY_BYTES = 500


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


#: What a body must hold, in lower case, for a pattern to match: one text of each group.
_KEYS = ("api", "access", "auth", "client", "passw", "secret", "token")
REDACTION_HINTS = ((_KEYS, ("=",)), (("bearer", "basic"),), (_KEYS, (":", "=")), (_KEYS, ('"',)))
TEMPLATE_HINTS = ((("-",),), ((":",),), ((".",),), (("@",),), (), (("/",),), (('"',),), ())


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def replaced(body: Column, patterns: Sequence[tuple[str, str]], hints: Sequence[tuple]) -> Column:
    """``body`` under all patterns in turn; a pattern whose hints are missing is not tried."""

    def one(x: Column, pattern: str, to: str, groups: tuple) -> Column:
        new = lambda y: F.regexp_replace(y, F.lit(ascii_edges(pattern)), F.lit(to))
        if not groups:
            return new(x)
        there = lambda low: reduce(and_, (reduce(or_, (F.contains(low, F.lit(h)) for h in g)) for g in groups))
        letters = any(h.isalpha() for g in groups for h in g)
        told = (lambda y: let(F.lower(y), there)) if letters else there
        return let(x, lambda y: F.when(told(y), new(y)).otherwise(y))

    for (pattern, to), groups in zip(patterns, hints, strict=True):
        body = one(body, pattern, to, groups)
    return body


def redacted(body: Column) -> Column:
    return replaced(body, REDACTIONS, REDACTION_HINTS)


def head(body: Column, limit: int = BODY_BYTES) -> Column:
    """The first ``limit`` bytes, without a split character at the end."""
    cut = lambda x: F.regexp_replace(F.make_valid_utf8(F.substring(x.cast("binary"), 1, limit).cast("string")), "�+$", "")
    return let(body, lambda x: F.when(F.octet_length(x) <= limit, x).otherwise(cut(x)))


def plain_template(body: Column) -> Column:
    return replaced(body, TEMPLATES, TEMPLATE_HINTS)


@F.pandas_udf(T.StringType())
def json_template(bodies: pd.Series) -> pd.Series:
    """JSON bodies value by value: texts become templates, numbers <num>, keys are sorted; null if the body is no JSON object."""

    def normal(x):
        if isinstance(x, dict):
            return {k: normal(x[k]) for k in sorted(x)}
        if isinstance(x, list):
            return [normal(y) for y in x]
        if isinstance(x, str):
            return reduce(lambda s, p: re.sub(p[0], p[1], s, flags=re.ASCII), TEMPLATES, x)
        return "<num>" if isinstance(x, int | float) and not isinstance(x, bool) else x

    def one(body):
        try:
            return json.dumps(normal(json.loads(body)), separators=(",", ":"), ensure_ascii=False) if body else None
        except ValueError:
            return None

    return bodies.map(one)


def template(body: Column, with_json: bool = True) -> Column:
    """The pattern a body follows. Only bodies that start with a brace can leave the JVM."""
    flat = plain_template(head(body))
    if not with_json:
        return flat
    own = head(F.when(F.startswith(body, F.lit("{")), body))
    return F.coalesce(json_template(own), flat)


def severity(text: Column, number: Column) -> Column:
    """The band of a number, else of a name; names that are no alias stay as they are, in upper case."""
    name = F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), "[0-9]+$", "")
    band = F.element_at(F.array(*map(F.lit, BANDS)), F.least(F.floor((number - 1) / 4), F.lit(len(BANDS) - 1)).cast("int") + 1)
    aliases = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.when(number > 0, band).otherwise(F.coalesce(aliases[F.lower(name)], F.when(name == "", "UNSPECIFIED").otherwise(name)))


def severity_rank(band: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, BANDS)), band), F.lit(0))
