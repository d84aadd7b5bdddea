"""Preset tables and the resolution of settings into page options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed import PRESET_SCHEMA, PRESETS
from ..functions.numeric import clamp, or_default


def preset_table(spark: SparkSession) -> DataFrame:
    """The seven presets; a fixed-size dimension, safe to broadcast."""
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def resolve_page_options(
    pages: DataFrame, overrides: DataFrame, presets: DataFrame, options: dict
) -> DataFrame:
    """Overlay each page's named preset on the global ``options``.

    Overrides grow with the data, so that join is keyed by (document, page) and
    left to the optimizer; only the fixed preset table is broadcast. Fields the
    override's preset leaves open keep the global value.
    """
    glob = {k: options.get(k) for k in ("mode", "color_mode", "dpi", "quality", "colors", "bias", "contrast", "dark_areas")}

    def lit(name, kind):
        return F.lit(glob[name]).cast(kind)

    if glob["mode"] == "lossless":
        joined = pages.withColumns(
            {"_hit": F.lit(False), "_c": F.lit(None).cast("string"), "_d": F.lit(None).cast("int"),
             "_q": F.lit(None).cast("double"), "_n": F.lit(None).cast("int"), "_b": F.lit(None).cast("int")}
        )
    else:
        # One override a page: as in a map, a later entry replaces the one before.
        order = "order_no" if "order_no" in overrides.columns else "preset"
        last = F.max(F.struct(F.col(order).alias("_order"), "preset", "bias")).alias("_last")
        one = overrides.groupBy("doc_id", "page_no").agg(last).select("doc_id", "page_no", "_last.preset", "_last.bias")
        known = one.join(
            F.broadcast(presets.withColumnRenamed("preset", "_p")), F.col("preset") == F.col("_p")
        ).select(
            "doc_id", "page_no", F.lit(True).alias("_hit"), F.col("color_mode").alias("_c"), F.col("dpi").alias("_d"),
            F.col("quality").alias("_q"), F.col("colors").alias("_n"), F.col("bias").alias("_b"),
        )
        joined = pages.join(known, ["doc_id", "page_no"], "left")
    biased = F.col("_c").isin("bw", "indexed")
    return joined.select(
        *pages.columns,
        lit("mode", "string").alias("mode"),
        F.coalesce("_c", lit("color_mode", "string")).alias("color_mode"),
        F.coalesce("_d", lit("dpi", "int")).alias("dpi"),
        F.coalesce("_q", lit("quality", "double")).alias("quality"),
        F.coalesce("_n", lit("colors", "int")).alias("colors"),
        F.when(biased, F.coalesce("_b", F.lit(0))).otherwise(lit("bias", "int")).alias("bias"),
        lit("contrast", "int").alias("contrast"),
        lit("dark_areas", "string").alias("dark_areas"),
        F.coalesce("_hit", F.lit(False)).alias("overridden"),
    )


def clamp_options(df: DataFrame) -> DataFrame:
    """Defaults and bounds for raw option values (null and 0 mean "unset", quality only null)."""
    return df.withColumns(
        {
            "dpi": F.expr(clamp(or_default("dpi", 150), 50, 600)),
            "colors": F.expr(clamp(or_default("colors", 16), 4, 16)),
            "quality": F.expr("coalesce(quality, 0.6D)"),
            "contrast": F.expr(clamp("CAST(coalesce(contrast, 0) AS INT)", -50, 50)),
            "pages": F.expr(clamp(or_default("pages", 1), 1, 99)),
            "delay": F.expr(clamp("coalesce(delay, 0)", 0, 120)),
        }
    )


def option_set(settings: DataFrame, presets: DataFrame) -> DataFrame:
    """Settings (one row per owner) to the option set a run uses."""
    p = F.broadcast(presets.withColumnsRenamed({"preset": "_p", "mode": "_m", "color_mode": "_cm", "dpi": "_dpi",
                                                "quality": "_q", "colors": "_n"}))
    j = settings.join(p, settings["preset"] == F.col("_p"), "left")
    base = j.selectExpr(
        "*",
        "preset = 'custom' AS _custom",
    ).selectExpr(
        "owner", "preset", "bias AS _bias", "contrast AS _contrast", "dark_areas AS _dark", "ocr AS _ocr",
        "ocr_lang AS _lang", "extreme_dpi",
        "CASE WHEN _custom THEN 'raster' ELSE _m END AS mode",
        "CASE WHEN _custom THEN color_mode ELSE _cm END AS color_mode",
        "CASE WHEN _custom THEN dpi ELSE _dpi END AS base_dpi",
        "CASE WHEN _custom THEN quality_pct / 100D ELSE _q END AS quality",
        "CASE WHEN _custom THEN 16 ELSE _n END AS colors",
    )
    return base.selectExpr(
        "owner", "preset", "mode", "color_mode",
        "CASE WHEN preset LIKE 'extrem%' AND coalesce(extreme_dpi, 0) <> 0 THEN extreme_dpi ELSE base_dpi END AS dpi",
        "quality", "colors",
        "CASE WHEN color_mode IN ('bw', 'indexed') THEN coalesce(_bias, 0) END AS bias",
        "CASE WHEN color_mode = 'bw' THEN coalesce(_contrast, 0) END AS contrast",
        "CASE WHEN color_mode = 'bw' THEN coalesce(nullif(_dark, ''), 'auto') END AS dark_areas",
        "mode <> 'lossless' AND coalesce(_ocr, false) AS ocr",
        "CASE WHEN mode <> 'lossless' AND coalesce(_ocr, false) THEN _lang END AS ocr_lang",
    )


def apply_intake_defaults(settings: DataFrame, presets: DataFrame) -> DataFrame:
    """The intake default preset replaces the current one if it is a known choice."""
    choices = presets.select(F.col("preset").alias("_ok")).union(
        presets.sparkSession.createDataFrame([("custom",)], "_ok string")
    )
    j = settings.join(F.broadcast(choices), settings["intake_preset"] == F.col("_ok"), "left")
    return j.selectExpr(
        "owner", "coalesce(_ok, preset) AS preset",
        """CASE WHEN intake_ocr IS NOT NULL AND coalesce(intake_preset, '') <> 'verlustfrei'
             THEN intake_ocr ELSE ocr END AS ocr""",
    )
