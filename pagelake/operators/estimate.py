"""Sampling, size estimates per preset and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import nearest

LOSSLESS = "verlustfrei"


def sample_pages(pages: DataFrame) -> DataFrame:
    """Pages an estimate is based on: all up to three, else first, middle, last.

    The page count is a map-side combined aggregate; the sample pages are
    generated from it (at most three rows a document), nothing is ranked.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.selectExpr(
        "doc_id", "n_pages",
        """explode(CASE WHEN n_pages <= 3 THEN sequence(1, CAST(n_pages AS INT))
             ELSE array(1, CAST(ceil(n_pages / 2) AS INT), CAST(n_pages AS INT)) END) AS page_no""",
    )


def requested_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """An explicit page list, reduced to the pages a document really has."""
    return wanted.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")


def estimate_savings(pages: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Expected document size and saving under each preset.

    Sample pages meet the measured sizes on (document, page): a document of any
    length contributes three keys, so no key is hot. The lossless preset is
    summed over every page and never extrapolated.
    """
    # One pass over the pages gives count and original size per document; the
    # sampled-size join then carries both along, so no further join by document.
    docs = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("orig_bytes").alias("orig_bytes")
    )
    marks = docs.selectExpr(
        "doc_id", "n_pages", "orig_bytes",
        """explode(CASE WHEN n_pages <= 3 THEN sequence(1, CAST(n_pages AS INT))
             ELSE array(1, CAST(ceil(n_pages / 2) AS INT), CAST(n_pages AS INT)) END) AS page_no""",
    )
    raster = (
        page_sizes.where(F.col("preset") != LOSSLESS)
        .join(marks, ["doc_id", "page_no"])
        .groupBy("doc_id", "preset", "n_pages", "orig_bytes")
        .agg(F.sum("bytes").alias("part"), F.least(F.col("n_pages"), F.lit(3)).alias("k"))
        .selectExpr(
            "doc_id", "preset", f"CAST({nearest('part / k * n_pages')} AS BIGINT) AS est_bytes",
            "n_pages > 3 AS estimated", "orig_bytes",
        )
    )
    exact = (
        page_sizes.where(F.col("preset") == LOSSLESS)
        .groupBy("doc_id", "preset")
        .agg(F.sum("bytes").alias("est_bytes"))
        .join(docs.select("doc_id", "orig_bytes"), "doc_id")
        .selectExpr("doc_id", "preset", "est_bytes", "false AS estimated", "orig_bytes")
    )
    return raster.unionByName(exact).selectExpr(
        "doc_id", "preset", "est_bytes", "estimated",
        "CASE WHEN orig_bytes > 0 THEN round((1 - est_bytes / orig_bytes) * 100, 6) END AS saving_pct",
    )


def compress_report(results: DataFrame) -> DataFrame:
    """Per document: size before and after, share saved, status; failures stay visible."""
    return results.selectExpr(
        "doc_id", "before_bytes", "after_bytes",
        "CASE WHEN error IS NULL THEN round(1 - after_bytes / before_bytes, 6) END AS saved",
        """CASE WHEN error IS NOT NULL THEN 'err' WHEN after_bytes < before_bytes THEN 'ok'
             ELSE 'warn' END AS status""",
        """CASE WHEN error IS NULL AND after_bytes < before_bytes
             THEN round((1 - after_bytes / before_bytes) * 100, 1) END AS saved_pct""",
    )


def report_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("before_bytes").alias("before_bytes"),
        F.sum("after_bytes").alias("after_bytes"),
    )


def codec_choice(sizes: DataFrame, requested: str = "auto") -> DataFrame:
    """The smaller of the two bilevel encodings; the fax code wins ties."""
    if requested in ("g4", "flate"):
        pick = F.lit(requested)
    else:
        pick = F.when(F.col("g4_bytes") <= F.col("flate_bytes"), "g4").otherwise("flate")
    return sizes.withColumn("codec", pick).withColumn(
        "chosen_bytes", F.when(F.col("codec") == "g4", F.col("g4_bytes")).otherwise(F.col("flate_bytes"))
    )
