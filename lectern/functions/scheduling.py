"""Spaced repetition (SM-2) as a fold over a card's reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<reps:int,lapses:int,state:string,ease_factor:double,interval_days:bigint,is_mistake:boolean,mistake_streak:int,graduated:boolean,next_review:bigint>"
EASE, LEAST_EASE, RETRY_SECONDS = 2.5, 1.3, 600
#: Intervals stop here (2.7 billion years): long runs of top ratings multiply them beyond what a 64-bit number of seconds holds.
MOST_DAYS = 10**12


def quality(rating: Column) -> Column:
    """Ratings 1 to 4 as SM-2 qualities 1, 3, 4, 5; 5 stays, and anything else is held within 0 and 5."""
    return F.when(rating == 1, 1).when(rating == 2, 3).when(rating == 3, 4).when(rating == 4, 5).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), rating)))


def initial() -> Column:
    return F.struct(
        F.lit(0).alias("reps"), F.lit(0).alias("lapses"), F.lit("new").alias("state"), F.lit(EASE).alias("ease_factor"), F.lit(0).cast("long").alias("interval_days"),
        F.lit(False).alias("is_mistake"), F.lit(0).alias("mistake_streak"), F.lit(False).alias("graduated"), F.lit(None).cast("long").alias("next_review"),
    ).cast(STATE)


def review(s: Column, rating: Column, at: Column) -> Column:
    """State after one review at epoch second `at`."""
    q = quality(rating)
    miss = F.lit(5) - q
    ease = F.greatest(F.lit(LEAST_EASE), F.when(s["ease_factor"] >= LEAST_EASE, s["ease_factor"]).otherwise(EASE) + (F.lit(0.1) - miss * (F.lit(0.08) + miss * F.lit(0.02))))
    failed = q < 3
    step = F.when(s["reps"] == 0, 1).when(s["reps"] == 1, 6).otherwise(F.greatest(F.lit(1), F.least(F.lit(float(MOST_DAYS)), F.bround(s["interval_days"] * ease)).cast("long"))).cast("long")
    interval = F.when(failed, 0).otherwise(step).cast("long")
    streak = s["mistake_streak"] + 1
    freed = ~failed & s["is_mistake"] & ((streak >= 2) | (q == 5))
    return F.struct(
        F.when(failed, 0).otherwise(s["reps"] + 1).alias("reps"),
        F.when(failed, s["lapses"] + 1).otherwise(s["lapses"]).alias("lapses"),
        F.when(failed, "learning").when(q == 5, "mastered").otherwise("review").alias("state"),
        F.bround(ease, 2).alias("ease_factor"),
        interval.alias("interval_days"),
        F.when(failed, True).when(freed, False).otherwise(s["is_mistake"]).alias("is_mistake"),
        F.when(failed | freed, 0).when(s["is_mistake"], streak).otherwise(s["mistake_streak"]).alias("mistake_streak"),
        freed.alias("graduated"),
        (at + F.when(failed, F.lit(RETRY_SECONDS)).otherwise(interval * 86400)).cast("long").alias("next_review"),
    ).cast(STATE)


def replay(reviews: DataFrame, card: str, order: list[str], rating: str, at: str) -> DataFrame:
    """Card state after all reviews, in the given order. One shuffle by card; a card's reviews are few by nature."""
    log = F.sort_array(F.collect_list(F.struct(*order, F.col(rating).alias("_r"), F.col(at).alias("_at"))))
    grouped = reviews.groupBy(card).agg(log.alias("_log"))
    return grouped.select(card, F.aggregate("_log", initial(), lambda s, r: review(s, r["_r"], r["_at"])).alias("stats"))
