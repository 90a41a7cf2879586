"""Endpointing of voice frames: when a turn ends and why.

A turn ends at the first frame at which it is MAX_TURN long, or has had no speech for NO_SPEECH from its start, or has had
speech and then END_SILENCE without. The batch form is window expressions; the stream form keeps three numbers of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TURN_MS, NO_SPEECH_MS, END_SILENCE_MS = 60_000, 6_000, 1_500
PRE_ROLL_MS, POST_ROLL_MS = 400, 200


def end_reason(elapsed, last_speech, speech, limits=(MAX_TURN_MS, NO_SPEECH_MS, END_SILENCE_MS)):
    return (
        F.when(elapsed >= limits[0], "MAX_TURN")
        .when(last_speech.isNull() & (elapsed >= limits[1]), "NO_SPEECH")
        .when(last_speech.isNotNull() & ~speech & (elapsed - last_speech >= limits[2]), "END_SILENCE")
    )


def ends(frames: DataFrame, session="session_id", order="seq", elapsed="elapsed_ms", speech="is_speech", limits=(MAX_TURN_MS, NO_SPEECH_MS, END_SILENCE_MS)) -> DataFrame:
    """session, reason, ended_ms of each session's turn; sessions that never end are left out."""
    w = Window.partitionBy(session).orderBy(order)
    last = F.max(F.when(F.col(speech), F.col(elapsed))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = frames.withColumn("_last", last).withColumn("reason", end_reason(F.col(elapsed), F.col("_last"), F.col(speech), limits)).filter("reason is not null")
    first = x.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return first.select(session, "reason", F.col(elapsed).alias("ended_ms"))


def segments(frames: DataFrame, session="session_id", order="seq", begin="begin_ms", elapsed="elapsed_ms", speech="is_speech") -> DataFrame:
    """Runs of speech frames, by gaps and islands, and the same widened by the rolls and clamped to the session."""
    w = Window.partitionBy(session).orderBy(order)
    whole = Window.partitionBy(session)
    x = frames.withColumn("_end", F.max(elapsed).over(whole))
    x = x.withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(session, speech).orderBy(order))).filter(F.col(speech))
    runs = x.groupBy(session, "_run").agg(F.min(begin).alias("start_ms"), F.max(elapsed).alias("end_ms"), F.first("_end").alias("_end"))
    return runs.select(session, "start_ms", "end_ms", F.greatest(F.lit(0), F.col("start_ms") - PRE_ROLL_MS).alias("from_ms"), F.least("_end", F.col("end_ms") + POST_ROLL_MS).alias("to_ms"))


def stream_ends(frames: DataFrame, limits=(MAX_TURN_MS, NO_SPEECH_MS, END_SILENCE_MS)) -> DataFrame:
    """As ends, on a stream of session_id, seq, elapsed_ms, is_speech: one row when a session's turn ends, none later."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        ended, last = state.get if state.exists else (False, -1)
        for pdf in batches:
            for row in pdf.sort_values("seq").itertuples():
                if ended:
                    break
                if row.is_speech:
                    last = row.elapsed_ms
                reason = (
                    "MAX_TURN" if row.elapsed_ms >= limits[0]
                    else "NO_SPEECH" if last < 0 and row.elapsed_ms >= limits[1]
                    else "END_SILENCE" if last >= 0 and not row.is_speech and row.elapsed_ms - last >= limits[2]
                    else None
                )
                if reason:
                    ended = True
                    yield pd.DataFrame({"session_id": [key[0]], "reason": [reason], "ended_ms": [int(row.elapsed_ms)]})
        state.update((ended, int(last)))

    return frames.groupBy("session_id").applyInPandasWithState(step, "session_id string, reason string, ended_ms long", "ended boolean, last long", "append", GroupStateTimeout.NoTimeout)
