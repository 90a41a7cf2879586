"""What timers do to a stream of events, as batch plans, with stream forms where a timer is state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAVE_AFTER_MS, SLOW_AFTER_MS, PARTIAL_EVERY_MS, MOST_MESSAGES, LOG_ROWS, LOG_SLACK = 400, 10_000, 500, 500, 500, 100


def _ms(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n / 1000))


def debounced(changes: DataFrame, key: str, ts: str, order: str, after_ms: int = SAVE_AFTER_MS) -> DataFrame:
    """The changes after which a key rests for `after_ms`: those that are saved."""
    gap = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, order)) - F.col(ts)
    return changes.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= _ms(after_ms))).drop("_gap")


def stream_debounced(changes: DataFrame, key: str, ts: str, late: str = "1 minute", after_ms: int = SAVE_AFTER_MS) -> DataFrame:
    """key, saved (the last change's struct): as debounced, on a stream with event time; a change stays until the
    watermark has passed its rest."""
    rest = [c for c in changes.columns if c not in (key, ts)]
    x = changes.withWatermark(ts, late).groupBy(F.session_window(ts, f"{after_ms} milliseconds"), key)
    return x.agg(F.max(F.struct(ts, *rest)).alias("saved")).select(key, "saved")


def slow_steps(steps: DataFrame, begin: str, end: str, now: Column, limit_ms: int = SLOW_AFTER_MS) -> DataFrame:
    """Steps that ran, or have run until `now`, longer than the limit, with the time at which the watchdog told so."""
    return steps.filter(F.coalesce(F.col(end), now) - F.col(begin) > _ms(limit_ms)).withColumn("told_at", F.col(begin) + _ms(limit_ms))


def due_partials(frames: DataFrame, frame_ms: int, session="session_id", order="seq", speech="is_speech", every_ms: int = PARTIAL_EVERY_MS) -> DataFrame:
    """session, seq of the frames at which a partial text of the speech being said is due; the count starts with the run."""
    w = Window.partitionBy(session).orderBy(order)
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(session, speech).orderBy(order))
    x = frames.withColumn("_run", run).filter(F.col(speech))
    nth = F.row_number().over(Window.partitionBy(session, "_run").orderBy(order)) - 1
    return x.withColumn("_nth", nth).filter(f"_nth > 0 and _nth % {-(-every_ms // frame_ms)} = 0").select(session, order)


def accepted(messages: DataFrame, conversation: str, order: str, most: int = MOST_MESSAGES) -> DataFrame:
    """The first `most` messages of a conversation; it takes no more."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(conversation).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def append_log(batch: DataFrame, path: str, ts: str, order: str, most: int = LOG_ROWS, slack: int = LOG_SLACK) -> None:
    """For foreachBatch: adds a batch to a Parquet log and, above most + slack rows, keeps the newest `most`.

    Each call writes a new version beside the old one and then names it in `current`, so a call that is cut off or comes
    again leaves a whole log; the version before the last goes; a batch's rows that the log has are not added twice."""
    from ..sources.files import delete, read_text, replace_text

    spark = batch.sparkSession
    now = read_text(spark, f"{path}/current")
    old = spark.read.schema(batch.schema).parquet(f"{path}/{now}") if now else batch.limit(0)
    log = old.unionByName(batch).dropDuplicates()
    n = log.count()
    if n > most + slack:
        log = log.orderBy(F.col(ts).desc(), F.col(order).desc()).limit(most)
    last = int((now or "v0")[1:])
    version = f"v{last + 1}"
    log.write.mode("overwrite").parquet(f"{path}/{version}")
    replace_text(spark, f"{path}/current", version)
    delete(spark, f"{path}/v{last - 1}")


def read_log(spark, path: str) -> DataFrame:
    from ..sources.files import read_text

    return spark.read.parquet(f"{path}/{read_text(spark, f'{path}/current')}")
