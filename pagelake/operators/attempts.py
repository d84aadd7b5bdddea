"""Logs of scan attempts and device responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..keys import ordered_index

MAX_PAGES = 99
TRIES = 3


def _stops(attempts: DataFrame, total: int, first_tries: int, chunk: int) -> DataFrame:
    """First reason each batch ends, with its position in the log.

    Three failures in a row at p are found by letting every failure vote for
    p, p+1 and p+2 and counting votes per (batch, position): no ordering.
    """
    failed = attempts.where("NOT ok")
    streak = (
        failed.select("batch_id", F.explode(F.array(*[F.col("seq") + k for k in range(TRIES)])).alias("seq"))
        .groupBy("batch_id", "seq").agg(F.count(F.lit(1)).alias("votes")).where(f"votes = {TRIES}")
    )
    full = ordered_index(
        attempts.where("ok").select("batch_id", "seq"), ["batch_id"], F.floor(F.col("seq") / chunk), ["seq"], "page"
    ).where(F.col("page") == total)
    reasons = [
        (attempts.where("cancel"), "cancelled", 1), (streak, "failed", 2), (full, "finished", 3),
    ]
    if first_tries == 1:
        reasons.append((failed.where("seq = 1"), "failed", 0))
    union = None
    for df, status, prio in reasons:
        part = df.select("batch_id", F.struct("seq", F.lit(prio).alias("prio"), F.lit(status).alias("status")).alias("s"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("batch_id").agg(F.min("s").alias("stop"))


def batch_outcome(
    attempts: DataFrame, total: int = MAX_PAGES, first_tries: int = 1, chunk: int = 65536
) -> DataFrame:
    """Pages a batch keeps (batch_id, seq, page), one row per collected page.

    Page 1 has ``first_tries`` attempts, later pages three; a cancel lets the
    running attempt finish. ``first_tries=3`` is the scan-to-folder variant.
    """
    kept = attempts.join(_stops(attempts, total, first_tries, chunk), "batch_id", "left").where(
        "ok AND (stop IS NULL OR seq <= stop.seq)"
    )
    return ordered_index(
        kept.select("batch_id", "seq"), ["batch_id"], F.floor(F.col("seq") / chunk), ["seq"], "page"
    )


def batch_summary(
    attempts: DataFrame, total: int = MAX_PAGES, first_tries: int = 1, chunk: int = 65536
) -> DataFrame:
    """Per batch: pages collected, how it ended, and the page that failed."""
    j = attempts.join(_stops(attempts, total, first_tries, chunk), "batch_id", "left")
    return j.groupBy("batch_id").agg(
        F.count_if(F.expr("ok AND (stop IS NULL OR seq <= stop.seq)")).alias("n_pages"),
        F.coalesce(F.max("stop.status"), F.lit("open")).alias("status"),
    ).withColumn("failed_page", F.expr("CASE WHEN status = 'failed' THEN n_pages + 1 END"))


def retry_policy(responses: DataFrame) -> DataFrame:
    """Attempts that a job start really makes, with waits and outcome.

    At most four rows a job survive the first filter, so nothing is skewed.
    """
    tried = responses.where("seq <= 4")
    final = tried.where("status NOT IN (503, 409)").groupBy("job_id").agg(F.min("seq").alias("_end"))
    return tried.join(final, "job_id", "left").where("_end IS NULL OR seq <= _end").selectExpr(
        "job_id", "seq", "status", "1.5D * (seq - 1) AS wait_s",
        """CASE WHEN status = 201 THEN 'started' WHEN status IN (503, 409) AND seq < 4 THEN 'retry'
             ELSE 'rejected' END AS result""",
    )
