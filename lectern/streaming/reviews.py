"""Reviews of cards as a stream: each card's SM-2 state and log live in the state store and timers tell when it falls due.

A review that comes in order moves the state on; one that is older than what was folded (a late one) makes the card fold its
log anew, so the last states are those of `scheduling.replay` however the reviews are batched. A review that comes twice (same time
and number) counts once. A card's log is as long as its reviews, which are few by nature.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scheduling import EASE, LEAST_EASE, MOST_DAYS, RETRY_SECONDS
from lectern.streaming.chat import run_available

#: Timers stand no later (milliseconds): times of the longest intervals are beyond what a 64-bit number of milliseconds holds.
LATEST = 2**62
_FIELDS = "reps int, lapses int, state string, ease_factor double, interval_days bigint, is_mistake boolean, mistake_streak int, graduated boolean, next_review bigint"
_QUALITY = {1: 1, 2: 3, 3: 4, 4: 5}


class State(NamedTuple):
    reps: int = 0
    lapses: int = 0
    state: str = "new"
    ease_factor: float = EASE
    interval_days: int = 0
    is_mistake: bool = False
    mistake_streak: int = 0
    graduated: bool = False
    next_review: int | None = None


def _even(x: float, places: str) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(places), ROUND_HALF_EVEN))


def reviewed(s: State, rating: int, at: int) -> State:
    """The state after one review at epoch second `at`, as `scheduling.review` has it."""
    q = _QUALITY.get(rating, max(0, min(5, rating)))
    ease = max(LEAST_EASE, (s.ease_factor if s.ease_factor >= LEAST_EASE else EASE) + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    if q < 3:
        return State(0, s.lapses + 1, "learning", _even(ease, "0.01"), 0, True, 0, False, at + RETRY_SECONDS)
    days = (1, 6)[s.reps] if s.reps < 2 else max(1, int(min(float(MOST_DAYS), _even(s.interval_days * ease, "1"))))
    streak = s.mistake_streak + 1
    freed = s.is_mistake and (streak >= 2 or q == 5)
    return State(
        s.reps + 1, s.lapses, "mastered" if q == 5 else "review", _even(ease, "0.01"), days, s.is_mistake and not freed, 0 if freed else streak if s.is_mistake else s.mistake_streak, freed, at + days * 86400,
    )


def _card_reviews(card: str):
    """Rows of two kinds: `state` after each batch that held reviews of the card, and `due` when its time has come."""

    def row(key: tuple, kind: str, state: State) -> pd.DataFrame:
        return pd.DataFrame([{card: key[0], "kind": kind, **state._asdict()}])

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        ats, nos, ratings, *last = held.get if held.exists else ([], [], [])
        if held.hasTimedOut:
            yield row(key, "due", State(*last))
            return
        log = list(zip(ats, nos, ratings, strict=True))
        todo = sorted({(int(a), int(n), int(r)) for pdf in batches for a, n, r in zip(pdf["at"], pdf["no"], pdf["rating"], strict=True)})
        state = State(*last)
        if not log or todo[0][:2] > log[-1][:2]:
            log += todo
        else:  # some of these belong before what was folded, or came before
            state, todo = State(), sorted(set(log) | set(todo))
            log = todo
        for when, _, rating in todo:
            state = reviewed(state, rating, when // 1_000_000)
        held.update((*map(list, zip(*log, strict=True)), *state))
        now = held.getCurrentProcessingTimeMs()
        held.setTimeoutDuration(min(max(state.next_review * 1000 - now, 1), LATEST - now))
        yield row(key, "state", state)

    return run


def stream_reviews(reviews: DataFrame, card: str) -> DataFrame:
    """card, kind and the card's state; reviews have card, rating, at (epoch microseconds) and no (which parts reviews of one moment)."""
    kind = reviews.schema[card].dataType.simpleString()
    held = f"ats array<bigint>, nos array<bigint>, ratings array<int>, {_FIELDS}"
    return reviews.select(card, "rating", "at", "no").groupBy(card).applyInPandasWithState(_card_reviews(card), f"{card} {kind}, kind string, {_FIELDS}", held, "update", "ProcessingTimeTimeout")


def run_reviews(reviews: DataFrame, card: str, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what there is and gives all its rows with their batch (epoch). Timers that have come fire with the next batch of
    reviews: batches without data are off, since a run over what there is would otherwise wait for timers for ever."""
    session, key = reviews.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = session.conf.get(key, None)
    session.conf.set(key, "false")
    try:
        return run_available(stream_reviews(reviews, card), path, checkpoint, "update")
    finally:
        session.conf.unset(key) if before is None else session.conf.set(key, before)


def last_states(rows: DataFrame, card: str) -> DataFrame:
    """The last state of each card, from the rows of `run_reviews`."""
    fields = F.struct(*State._fields)
    return rows.where("kind = 'state'").groupBy(card).agg(F.max_by(fields, "epoch").alias("s")).select(card, "s.*")
