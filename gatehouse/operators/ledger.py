"""Credit ledger: an ordered fold per key that may be refused on the way.

A call is deducted only when the balance covers it, and a negative adjustment stops at zero, so a running
sum is wrong.  Events are range-partitioned by (key, time, id): a hot key spreads over many tasks.

* A key whose first event lies inside a task is folded from zero right there.
* The key that may continue from the task before has an unknown balance.  All its events of the task become one
  effect ``start balance -> result``, kept as the points where the result changes: between two of them the
  balance either moves with the start balance or does not depend on it.  Balances that meet never part again,
  so the points stay few.
* A last pass walks the effects of a key in order: one row per task and key, one lookup each, holding one state.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points at which an effect is handed on and a new one begun; the chain of both is exact.
MOST_POINTS = 512
MERGE_EVERY = 64
NONE = -1

_SUMMARY = ("key string, first_us long, first_id long, starts array<long>, balances array<long>, slopes array<long>, "
            "calls array<long>, created array<long>, seen array<long>")
_LEDGER = "key string, credits long, total_calls long, created_us long, seen_us long"


def ledger_events(payments: DataFrame | None = None, calls: DataFrame | None = None, adjustments: DataFrame | None = None) -> DataFrame:
    """Union of ``key, ts, id, amount`` tables as one event table with ``kind``."""
    parts = [
        df.select(F.col("key").cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id"), F.lit(kind).alias("kind"),
                  F.col("amount").cast("long").alias("amount"))
        for kind, df in (("add", payments), ("call", calls), ("adjust", adjustments)) if df is not None
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_event(state: tuple, kind: str, amount: int, us: int) -> tuple:
    """``state`` is ``(credits, calls, created_us, seen_us)``."""
    credits, calls, created, seen = state
    if kind == "call":
        if credits < amount:
            return state
        credits, calls = credits - amount, calls + 1
    else:
        credits = credits + amount if amount >= 0 else max(0, credits + amount)
    return credits, calls, us if created == NONE else created, us


# Events that are tried in one step at first, and at most.
_FIRST, _MOST = 32, 1 << 16


def fold_events(state: tuple, calls: np.ndarray, amounts: np.ndarray, us: np.ndarray) -> tuple:
    """``state`` after the events in this order, as :func:`apply_event` has it (``calls`` marks those; the others add).

    As long as no call is refused and nothing stops at zero, a balance is a running sum.  Events are taken in growing steps up to the first one for which
    this does not hold; that one and the next few are taken singly.
    """
    credits, done, created, seen = (int(x) for x in state)
    amounts = amounts.astype(np.int64)
    changes = np.where(calls, -amounts, amounts)
    # A call asks for what it takes, also where that is less than nothing; what adds never refuses, but stops at zero.
    at, step = 0, _FIRST
    while at < len(changes):
        end = min(at + step, len(changes))
        after = credits + np.cumsum(changes[at:end])
        short = (after < 0) & ((changes[at:end] < 0) | calls[at:end])
        good = int(short.argmax()) if short.any() else end - at
        if good:
            credits, done, seen = int(after[good - 1]), done + int(np.count_nonzero(calls[at:at + good])), int(us[at + good - 1])
            created = int(us[at]) if created == NONE else created
        at += good
        if at == end:
            step = min(step * 4, _MOST)
            continue
        step, end = _FIRST, min(at + _FIRST, len(changes))
        for call, change, time in zip(calls[at:end].tolist(), changes[at:end].tolist(), us[at:end].tolist()):
            if call:
                if credits < -change:
                    continue
                credits, done = credits + change, done + 1
            else:
                credits = credits + change if change >= 0 else max(0, credits + change)
            created, seen = time if created == NONE else created, time
        at = end
    return credits, done, created, seen


class Effect:
    """What a run of events does to every start balance.

    Point i holds for start balances from ``starts[i]`` up to the next point: the balance at the point, whether it grows with the
    start balance (slope 1) or not (slope 0), and calls, first and last change.  The last point is open-ended.
    """

    def __init__(self, first_us: int, first_id: int):
        self.first, self.events = (first_us, first_id), 0
        self.starts, self.balances, self.slopes, self.calls = (np.array([x], np.int64) for x in (0, 0, 1, 0))
        self.created, self.seen = np.array([NONE], np.int64), np.array([NONE], np.int64)

    def _fields(self) -> list[str]:
        return ["starts", "balances", "slopes", "calls", "created", "seen"]

    def _split(self, amount: int) -> None:
        """A point more where a growing balance reaches ``amount``."""
        top = np.append(self.starts[1:] - self.starts[:-1] + self.balances[:-1], np.iinfo(np.int64).max)
        at = np.flatnonzero((self.slopes == 1) & (self.balances < amount) & (top > amount))
        if len(at):
            new = self.starts[at] + amount - self.balances[at]
            for name in self._fields():
                values = getattr(self, name)
                put = {"starts": new, "balances": np.full(len(at), amount, np.int64)}.get(name, values[at])
                setattr(self, name, np.insert(values, at + 1, put))

    def add(self, kind: str, amount: int, us: int) -> None:
        wrote = np.ones(len(self.starts), bool)
        if kind == "call":
            self._split(amount)
            wrote = self.balances >= amount
            self.balances = np.where(wrote, self.balances - amount, self.balances)
            self.calls = self.calls + wrote
        elif amount >= 0:
            self.balances = self.balances + amount
        else:
            self._split(-amount)
            wrote = np.ones(len(self.starts), bool)
            under = self.balances < -amount
            self.balances, self.slopes = np.where(under, 0, self.balances + amount), np.where(under, 0, self.slopes)
        self.created = np.where(wrote & (self.created == NONE), us, self.created)
        self.seen = np.where(wrote, us, self.seen)
        self.events += 1
        if self.events % MERGE_EVERY == 0:
            self.merge()

    def merge(self) -> None:
        """Takes out points where nothing changes."""
        length = np.diff(self.starts)
        same = (self.calls[1:] == self.calls[:-1]) & (self.created[1:] == self.created[:-1]) & (self.seen[1:] == self.seen[:-1]) & (self.slopes[1:] == self.slopes[:-1])
        same &= self.balances[1:] == self.balances[:-1] + self.slopes[:-1] * length
        keep = np.concatenate([[True], ~same])
        for name in self._fields():
            setattr(self, name, getattr(self, name)[keep])

    def row(self, key: str) -> tuple:
        self.merge()
        return (key, *self.first, *[getattr(self, name).tolist() for name in self._fields()])


def _settled(key: str, start: tuple, state: tuple) -> tuple:
    """An account folded from zero: the same row for any start balance."""
    credits, calls, created, seen = state
    return (key, *start, [0], [credits], [0], [calls], [created], [seen])


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted range of events -> effects of its first key, final states of all others."""
    columns = [c.split()[0] for c in _SUMMARY.split(", ")]
    first_key = key = None
    effect: Effect | None = None
    state, start = None, None

    def close() -> list[tuple]:
        if effect is not None and effect.events:
            return [effect.row(key)]
        return [_settled(key, start, state)] if state is not None else []

    for pdf in batches:
        out = []
        for k, us, i, kind, amount in zip(pdf["key"], pdf["us"], pdf["id"], pdf["kind"], pdf["amount"]):
            if k != key:
                out += close()
                effect = state = None
                if first_key is None:
                    first_key, effect = k, Effect(us, i)
                else:
                    state, start = (0, 0, NONE, NONE), (us, i)
                key = k
            if effect is not None:
                if len(effect.starts) >= MOST_POINTS:
                    out += close()
                    effect = Effect(us, i)
                effect.add(kind, int(amount), int(us))
            else:
                state = apply_event(state, kind, amount, us)
        if out:
            yield pd.DataFrame(out, columns=columns)
    last = close()
    if last:
        yield pd.DataFrame(last, columns=columns)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _LEDGER.split(", ")]
    key, state = None, (0, 0, NONE, NONE)
    for pdf in batches:
        out = []
        for k, starts, balances, slopes, calls, created, seen in zip(*(pdf[c] for c in ("key", "starts", "balances", "slopes", "calls", "created", "seen"))):
            if k != key:
                if key is not None and state[3] != NONE:
                    out.append((key, *state))
                key, state = k, (0, 0, NONE, NONE)
            credits, n, made, last = state
            at = int(np.searchsorted(starts, credits, side="right")) - 1
            now = int(balances[at]) + int(slopes[at]) * (credits - int(starts[at]))
            state = (now, n + int(calls[at]), int(created[at]) if made == NONE else made, last if int(seen[at]) == NONE else int(seen[at]))
        if out:
            yield pd.DataFrame(out, columns=columns)
    if key is not None and state[3] != NONE:
        yield pd.DataFrame([(key, *state)], columns=columns)


def ledger_balances(events: DataFrame) -> DataFrame:
    """Accounts that ever changed: ``key, credits, total_calls, created_at, last_seen``."""
    ordered = (
        events.select("key", F.unix_micros("ts").alias("us"), "id", "kind", "amount")
        .repartitionByRange("key", "us", "id").sortWithinPartitions("key", "us", "id")
    )
    summaries = ordered.mapInPandas(_summarise, _SUMMARY)
    chained = summaries.repartition("key").sortWithinPartitions("key", "first_us", "first_id").mapInPandas(_chain, _LEDGER)
    return chained.select("key", "credits", "total_calls", F.timestamp_micros("created_us").alias("created_at"),
                          F.timestamp_micros("seen_us").alias("last_seen"))
