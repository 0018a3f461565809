"""Filters with the reference semantics of nulls: plain operators keep SQL's, negation includes nulls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkobs.functions.text import BANDS

ALL = object()


def negated(p: Column) -> Column:
    """Rows where ``p`` does not hold, nulls included."""
    return ~F.coalesce(p, F.lit(False))


def contains(field: Column, text: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(field), F.lit(text.lower()))


#: The field that free text searches, by signal.
SEARCHED = {"logs": "body", "spans": "operation"}


def free_text(signal: str, text: str) -> Column:
    return contains(F.col(SEARCHED[signal]), text)


#: Attribute keys that have a typed column of their own, as adapters and sources name them.
DEDICATED = {
    "service.name": "service", "service.namespace": "namespace", "service.version": "service_version", "http.route": "http_route", "http.response.status_code": "status_code", "http.status_code": "status_code",
    "messaging.destination.name": "messaging_destination", "messaging.system": "messaging_system", "peer.service": "peer_service",
}


def attribute(df: DataFrame, key: str, bag: str = "attributes") -> Column:
    """The value of an attribute: of its own column where ``df`` has one, else out of the bag, a map or JSON text."""
    own = DEDICATED.get(key)
    if own in df.columns:
        return F.col(own)
    if dict(df.dtypes)[bag] == "string":
        return F.expr(f"try_variant_get(try_parse_json(`{bag}`), '$[\"{key}\"]', 'string')")
    return F.try_element_at(bag, F.lit(key))


def lacks(field: Column, text: str) -> Column:
    return negated(contains(field, text))


def one_of(field: Column, values: Sequence) -> Column:
    """Membership; of nothing it is false."""
    return field.isin(list(values)) if values else F.lit(False)


def exists(field: Column) -> Column:
    return field.isNotNull()


def severity(field: Column, op: str, band: str) -> Column:
    """A range of severities as membership in bands."""
    i = BANDS.index(band)
    bands = {">": BANDS[i + 1 :], ">=": BANDS[i:], "<": BANDS[:i], "<=": BANDS[: i + 1]}[op]
    if not bands:
        raise ValueError(f"no severity is {op} {band}")
    return field.isin(list(bands))


def either(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, ps)


def window(time_us: Column, start_us: int, end_us: int) -> Column:
    return (time_us >= start_us) & (time_us < end_us)


def variable(make, value) -> Column | None:
    """An entry over a variable: none for ALL, false for an empty choice."""
    if value is ALL:
        return None
    return F.lit(False) if isinstance(value, list | tuple) and not value else make(value)


def where(df: DataFrame, *entries: Column | None) -> DataFrame:
    """Entries are joined by AND; those of a variable set to ALL are left out."""
    return reduce(lambda d, p: d.where(p), (p for p in entries if p is not None), df)
