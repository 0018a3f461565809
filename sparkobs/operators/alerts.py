"""Alert states: none, pending, firing, resolved, with hold, repeat and cooldown."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Rule:
    name: str
    hold_ms: int = 0
    repeat_ms: int = 3_600_000
    cooldown_ms: int = 0


SLACK_MS = 1000
#: What is remembered of an alert: state, since when, last notice, when resolved.
State = tuple[str, int, int, int]
NONE: State = ("none", 0, 0, -(2**62))
EVENTS = "rule string, service string, time_ms long, event string, state string"
STATE = "state string, since long, noticed long, resolved long"


def step(rule: Rule, old: State, now: int, breach: bool) -> tuple[State, str | None]:
    """The state after a tick, and what is told: pending, firing, reminder, resolved or nothing."""
    state, since, noticed, resolved = old
    if breach:
        if state in ("none", "resolved"):
            if state == "resolved" and now - resolved < rule.cooldown_ms:
                return old, None
            return (("pending", now, 0, resolved), "pending") if rule.hold_ms else (("firing", now, now, resolved), "firing")
        if state == "pending":
            return (("firing", since, now, resolved), "firing") if now - since + SLACK_MS >= rule.hold_ms else (old, None)
        return (("firing", since, now, resolved), "reminder") if now - noticed >= rule.repeat_ms else (old, None)
    if state == "pending":
        return ("none", 0, 0, resolved), None
    if state == "firing":
        return ("resolved", since, noticed, now), "resolved"
    return old, None


def _fold(rule: Rule, service: str, state: State, ticks: pd.DataFrame) -> tuple[State, list[tuple]]:
    out = []
    for now, breach in ticks.sort_values("time_ms")[["time_ms", "breach"]].itertuples(index=False):
        state, event = step(rule, state, int(now), bool(breach))
        if event:
            out.append((rule.name, service, int(now), event, state[0]))
    return state, out


COLUMNS = ["rule", "service", "time_ms", "event", "state"]


def notices(ticks: DataFrame, rule: Rule) -> DataFrame:
    """Events of ``rule`` over ticks (service, time_ms, breach): one group per service, of one row per tick."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(rule, key[0], NONE, pdf)[1], columns=COLUMNS)

    return ticks.select("service", "time_ms", "breach").groupBy("service").applyInPandas(run, EVENTS)


def stream(ticks: DataFrame, rule: Rule) -> DataFrame:
    """The same over a stream of ticks; the state of each service outlives batches and restarts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else NONE
        new, out = _fold(rule, key[0], old, pd.concat(list(batches)))
        state.update(new)
        yield pd.DataFrame(out, columns=COLUMNS)

    return ticks.select("service", "time_ms", "breach").groupBy("service").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
