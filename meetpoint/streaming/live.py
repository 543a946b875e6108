"""Keeping results current from streams of changes and logins, one micro-batch at a time.

What a stream knows lies in ``KeptTables``: each batch reads only the buckets of
the meetups (or users) it touches, as the batch before left them, writes these
buckets anew (of people and answers the touched meetups alone), and commits once
all its tables are written.  A batch that is lost
anywhere runs again to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import merge_logins, replace_participants, with_login_keys
from ..sources.dataset import scratch, stored
from .state import KeptTables

#: Tables of a stream of participant changes and the columns they are kept by.
MEETUP_TABLES = {"people": "meetup_id", "applied": "meetup_id", "answers": "meetup_id", "events": "meetup_id"}
ACCOUNT_TABLES = {"accounts": "supabase_user_id"}


def without_redelivered(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop changes that were delivered before: same change_id within the watermark on ts."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["change_id"])


def newer_than_applied(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """Changes whose (seq, change_id) is over the one applied to the participant of the meetup.

    applied: meetup_id, participant_id, seq, change_id.
    """
    known = applied.select(F.col("meetup_id").alias("__m"), F.col("participant_id").alias("__p"), F.struct("seq", "change_id").alias("__last"))
    same = (F.col("meetup_id") == F.col("__m")) & (F.col("participant_id") == F.col("__p"))
    newer = F.col("__last").isNull() | (F.struct("seq", "change_id") > F.col("__last"))
    return changes.join(known, same, "left").where(newer).drop("__m", "__p", "__last")


def watermark(latest: int | None, delay: str) -> Column:
    """The time before which changes are too late, after events up to ``latest`` (microseconds); null at first."""
    return F.timestamp_micros(F.lit(latest).cast("long")) - F.expr(f"INTERVAL {delay}")


def high_water(applied: DataFrame, fresh: DataFrame, before: Column) -> DataFrame:
    """The last change applied to each participant of a meetup; those older than ``before`` are dropped, as no older change can come."""
    columns = ("meetup_id", "participant_id", "seq", "change_id", "ts")
    both = applied.select(*columns).unionByName(fresh.select(*columns))
    last = both.groupBy("meetup_id", "participant_id").agg(F.max(F.struct("seq", "change_id", "ts")).alias("c"))
    return last.select("meetup_id", "participant_id", "c.*").where(before.isNull() | (F.col("ts") >= before))


def apply_batch(batch: DataFrame, participants: DataFrame, answer: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(participants after the batch, answers of the meetups that it touched).

    ``answer(meetup_ids, participants)`` gives the new results of those meetups.
    """
    after = replace_participants(participants, batch)
    touched = batch.select("meetup_id").distinct()
    return after, answer(touched, after.join(touched, "meetup_id", "left_semi"))


def stream_rendezvous(
    changes: DataFrame, kept: KeptTables, answer: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, delay: str = "1 hour",
    events: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Recompute touched meetups in every micro-batch; the results are the tables people, answers and events of ``kept``.

    changes(change_id, seq, ts, meetup_id, participant_id, ...).  ``kept`` starts
    with the table people.  ``answer(meetup_ids, people)`` gives new answers, and
    ``events(answers)`` the events of these, which replace the meetups' stored ones
    (none where an answer failed).  A change that comes after a newer one of its
    participant was applied, or later than ``delay``, has no effect, nor has one
    to an unknown pair of meetup and participant, which is not remembered either.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        state = kept.open(batch_id)
        if state is None:
            return read_through(batch)
        with scratch(kept.spark):
            batch = stored(batch)
            buckets = kept.touched(batch, "meetup_id")
            late = watermark(state.latest, delay)
            touched = stored(batch.select("meetup_id").distinct())
            people = stored(state.read("people", buckets, touched))  # all that the batch needs of them
            applied = state.read("applied", buckets)
            known = batch.where(late.isNull() | (F.col("ts") >= late)).join(people.select("meetup_id", F.col("id").alias("participant_id")), ["meetup_id", "participant_id"], "left_semi")
            fresh = stored(known if applied is None else newer_than_applied(known, applied))
            people = stored(replace_participants(people, fresh))
            state.write("people", people, buckets, True)
            state.write("applied", high_water(fresh.limit(0) if applied is None else applied, fresh, late), buckets)
            answered = stored(answer(touched, people))
            state.write("answers", answered, buckets, True)
            if events:
                now = state.written("answers", buckets, touched)
                state.write("events", events_after(state.read("events", buckets), now, events(now)), buckets)
            state.commit(batch.agg(F.max(F.unix_micros("ts"))).first()[0])
        kept.forget()

    return without_redelivered(changes, delay).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_through(batch: DataFrame) -> None:
    """Run a batch whose results are kept already: the stream's own state needs it."""
    batch.write.format("noop").mode("overwrite").save()


def upsert_answers(stored: DataFrame | None, new: DataFrame, key: str = "meetup_id") -> DataFrame:
    """Stored rows with those of the keys in ``new`` replaced."""
    return new if stored is None else stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def events_after(stored: DataFrame | None, answers: DataFrame, events: DataFrame) -> DataFrame:
    """Events of all meetups after a batch: those of answered meetups are replaced, and cleared where the answer failed."""
    return events if stored is None else stored.join(answers.select("meetup_id").distinct(), "meetup_id", "left_anti").unionByName(events)


def stream_accounts(profiles: DataFrame, kept: KeptTables, checkpoint: str) -> StreamingQuery:
    """Merge accepted logins into the table accounts of ``kept``, batch by batch, in whatever order they come.

    ``kept`` starts with accounts that ``with_login_keys`` prepared.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        state = kept.open(batch_id)
        if state is None:
            return read_through(batch)
        with scratch(kept.spark):
            batch = stored(batch)
            buckets = kept.touched(batch, "supabase_user_id")
            state.write("accounts", merge_logins(state.read("accounts", buckets), batch), buckets)
            state.commit(None)
        kept.forget()

    return profiles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = [
    "ACCOUNT_TABLES", "MEETUP_TABLES", "apply_batch", "events_after", "high_water", "newer_than_applied", "stream_accounts", "stream_rendezvous", "upsert_answers", "with_login_keys", "without_redelivered",
]
