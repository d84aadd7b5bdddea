"""Options, sampling, estimates and reports."""

from __future__ import annotations

from .. import inputs as i
from ..operators import estimate, layout, options
from .views import sql

GLOBAL = {"mode": "raster", "color_mode": "color", "dpi": 150, "quality": 0.62, "colors": None, "bias": 0,
          "contrast": 5, "dark_areas": "auto"}


def _resolved(spark, d):
    return options.resolve_page_options(
        i.page(spark, d), i.page_override(spark, d), options.preset_table(spark), GLOBAL
    )


def q_resolve(spark, d):
    return _resolved(spark, d).select(
        "doc_id", "page_no", "mode", "color_mode", "dpi", "quality", "colors", "bias", "contrast", "dark_areas",
        "overridden")


def q_clamp(spark, d):
    raw = i.page(spark, d).selectExpr(
        "doc_id", "page_no", "CAST(orig_bytes % 900 AS INT) AS dpi", "CAST(orig_bytes % 23 AS INT) AS colors",
        "CASE WHEN orig_bytes % 3 = 0 THEN NULL ELSE (orig_bytes % 10) / 10D END AS quality",
        "(orig_bytes % 1301) / 10D - 65 AS contrast", "CAST(orig_bytes % 120 AS INT) AS pages",
        "CAST(orig_bytes % 150 AS INT) AS delay")
    return options.clamp_options(raw)


def q_target(spark, d):
    return layout.target_size(_resolved(spark, d)).selectExpr(
        "doc_id", "page_no", "w_px", "h_px", "round(out_w_pt, 6) AS out_w_pt", "round(out_h_pt, 6) AS out_h_pt",
        "round(eff_dpi, 6) AS eff_dpi")


def q_ocr_dpi(spark, d):
    return layout.ocr_render_dpi(layout.target_size(_resolved(spark, d))).selectExpr(
        "doc_id", "page_no", "round(ocr_dpi, 6) AS ocr_dpi", "rerender")


def q_sample(spark, d):
    return estimate.sample_pages(i.page(spark, d))


def q_requested(spark, d):
    wanted = i.page_override(spark, d).selectExpr("doc_id", "page_no").unionByName(
        i.page_override(spark, d).selectExpr("doc_id", "page_no * 4 AS page_no"))
    return estimate.requested_pages(i.page(spark, d), wanted)


def q_savings(spark, d):
    pages = i.page(spark, d)
    return estimate.estimate_savings(pages, i.page_bytes(pages))


def _results(spark, d):
    return i.page(spark, d).groupBy("doc_id").agg({"orig_bytes": "sum"}).selectExpr(
        "doc_id", "`sum(orig_bytes)` AS before_bytes",
        "CAST(floor(`sum(orig_bytes)` * (0.2D + (doc_id % 10) * 0.1D)) AS BIGINT) AS after_bytes",
        "CASE WHEN doc_id % 13 = 0 THEN 'File is password protected' END AS error")


def q_report(spark, d):
    return estimate.compress_report(_results(spark, d))


def q_report_summary(spark, d):
    return estimate.report_summary(estimate.compress_report(_results(spark, d)))


def q_codec(spark, d):
    sizes = i.page(spark, d).selectExpr(
        "doc_id", "page_no", "CAST(floor(orig_bytes * 0.05D) AS BIGINT) AS g4_bytes",
        "CAST(floor(orig_bytes * (0.04D + (page_no % 3) * 0.01D)) AS BIGINT) AS flate_bytes")
    return estimate.codec_choice(sizes)


_SETTINGS = """
SELECT c_custkey AS owner,
  CASE c_custkey % 9 WHEN 0 THEN 'verlustfrei' WHEN 1 THEN 'leicht' WHEN 2 THEN 'mittel' WHEN 3 THEN 'stark'
    WHEN 4 THEN 'extrem-grau' WHEN 5 THEN 'extrem-farbe' WHEN 6 THEN 'extrem-sw' ELSE 'custom' END AS preset,
  CASE c_nationkey % 3 WHEN 0 THEN 'gray' WHEN 1 THEN 'bw' ELSE 'indexed' END AS color_mode,
  CAST(72 + c_custkey % 300 AS INT) AS dpi, CAST(c_custkey % 100 AS INT) AS quality_pct,
  CASE WHEN c_custkey % 4 = 0 THEN 200 WHEN c_custkey % 4 = 1 THEN 0 END AS extreme_dpi,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 41 AS INT) - 20 END AS bias,
  CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 31 AS INT) - 15 END AS contrast,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'invert' ELSE 'ignore' END AS dark_areas,
  c_mktsegment = 'BUILDING' AS ocr, 'deu' AS ocr_lang,
  CASE c_custkey % 5 WHEN 0 THEN 'verlustfrei' WHEN 1 THEN 'mittel' WHEN 2 THEN 'nope' WHEN 3 THEN 'custom' END AS intake_preset,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS intake_ocr
FROM customer"""


def _settings(spark, d):
    return spark.sql(_SETTINGS.replace("FROM customer", "FROM {customer}"), customer=i.table(spark, d, "customer"))


def q_option_set(spark, d):
    return options.option_set(_settings(spark, d), options.preset_table(spark))


def q_intake_defaults(spark, d):
    return options.apply_intake_defaults(_settings(spark, d), options.preset_table(spark))


QUERIES = {
    "resolve_page_options": q_resolve, "clamp_options": q_clamp, "target_size": q_target,
    "ocr_render_dpi": q_ocr_dpi, "sample_pages": q_sample, "requested_pages": q_requested,
    "estimate_savings": q_savings, "compress_report": q_report, "report_summary": q_report_summary,
    "codec_choice": q_codec, "option_set": q_option_set, "apply_intake_defaults": q_intake_defaults,
}

_OPT = """
SELECT p.*, 'raster' AS mode, coalesce(k.color_mode, 'color') AS color_mode, coalesce(k.dpi, 150) AS dpi,
  coalesce(k.quality, 0.62::DOUBLE) AS quality, k.colors AS colors,
  CASE WHEN k.color_mode IN ('bw', 'indexed') THEN o.bias ELSE 0 END AS bias, 5 AS contrast, 'auto' AS dark_areas,
  k.preset IS NOT NULL AS overridden
FROM page p LEFT JOIN page_override o ON o.doc_id = p.doc_id AND o.page_no = p.page_no
LEFT JOIN preset k ON k.preset = o.preset"""

_SIZE = """
SELECT doc_id, page_no, color_mode,
  greatest(1, floor(w_pt * scale + 0.5)) AS w_px, greatest(1, floor(h_pt * scale + 0.5)) AS h_px, w_pt * norm AS ow, h_pt * norm AS oh
FROM (SELECT *, CASE WHEN area > cap THEN s * sqrt(cap / area) ELSE s END AS scale
  FROM (SELECT *, w_pt * h_pt * s * s AS area FROM (
    SELECT *, dpi / 72::DOUBLE * norm AS s, CASE WHEN color_mode = 'bw' THEN 16e6::DOUBLE ELSE 12e6::DOUBLE END AS cap FROM (
      SELECT *, CASE WHEN w_pt * h_pt > 1.7e6 THEN least(841.89::DOUBLE / greatest(w_pt, h_pt), 595.28::DOUBLE / least(w_pt, h_pt))
        ELSE 1 END AS norm FROM opt))))"""

_RES = """
SELECT doc_id, CAST(sum(orig_bytes) AS BIGINT) AS before_bytes,
  CAST(floor(sum(orig_bytes) * (0.2::DOUBLE + (doc_id % 10) * 0.1::DOUBLE)) AS BIGINT) AS after_bytes,
  CASE WHEN doc_id % 13 = 0 THEN 'x' END AS error FROM page GROUP BY doc_id"""

_REPORT = """
SELECT doc_id, before_bytes, after_bytes, CASE WHEN error IS NULL THEN round(1 - after_bytes / before_bytes, 6) END AS saved,
  CASE WHEN error IS NOT NULL THEN 'err' WHEN after_bytes < before_bytes THEN 'ok' ELSE 'warn' END AS status,
  CASE WHEN error IS NULL AND after_bytes < before_bytes THEN round((1 - after_bytes / before_bytes) * 100, 1) END AS saved_pct
FROM res"""

SQL = {
    "resolve_page_options": sql(
        """SELECT doc_id, page_no, mode, color_mode, dpi, quality, colors, bias, contrast, dark_areas, overridden FROM opt""",
        "page", "page_override", "preset", opt=_OPT),
    "clamp_options": sql("""
SELECT doc_id, page_no,
  CAST(CASE WHEN orig_bytes % 900 = 0 THEN 150 ELSE greatest(50, least(600, orig_bytes % 900)) END AS INT) AS dpi,
  CAST(CASE WHEN orig_bytes % 23 = 0 THEN 16 ELSE greatest(4, least(16, orig_bytes % 23)) END AS INT) AS colors,
  CASE WHEN orig_bytes % 3 = 0 THEN 0.6::DOUBLE ELSE (orig_bytes % 10) / 10::DOUBLE END AS quality,
  CAST(greatest(-50, least(50, trunc((orig_bytes % 1301) / 10::DOUBLE - 65))) AS INT) AS contrast,
  CAST(CASE WHEN orig_bytes % 120 = 0 THEN 1 ELSE greatest(1, least(99, orig_bytes % 120)) END AS INT) AS pages,
  CAST(least(120, orig_bytes % 150) AS INT) AS delay
FROM page""", "page"),
    "target_size": sql("""
SELECT doc_id, page_no, CAST(w_px AS INT) AS w_px, CAST(h_px AS INT) AS h_px, round(ow, 6) AS out_w_pt,
  round(oh, 6) AS out_h_pt, round(w_px / ow * 72, 6) AS eff_dpi FROM sized""",
        "page", "page_override", "preset", opt=_OPT, sized=_SIZE),
    "ocr_render_dpi": sql("""
SELECT doc_id, page_no, round(CASE WHEN w_px / ow * 72 < 200 THEN 240 ELSE w_px / ow * 72 END, 6) AS ocr_dpi,
  w_px / ow * 72 < 200 AS rerender FROM sized""",
        "page", "page_override", "preset", opt=_OPT, sized=_SIZE),
    "sample_pages": sql("""
SELECT p.doc_id, n AS n_pages, page_no
FROM page p JOIN (SELECT doc_id, count(*) AS n FROM page GROUP BY 1) c ON c.doc_id = p.doc_id
WHERE n <= 3 OR page_no IN (1, (n + 1) // 2, n)""", "page"),
    "requested_pages": sql("""
SELECT w.doc_id, w.page_no FROM (SELECT doc_id, page_no FROM page_override UNION ALL SELECT doc_id, page_no * 4 FROM page_override) w
JOIN (SELECT doc_id, count(*) AS n FROM page GROUP BY 1) c ON c.doc_id = w.doc_id AND w.page_no BETWEEN 1 AND n""",
        "page", "page_override"),
    "estimate_savings": sql("""
SELECT doc_id, preset, CAST(est AS BIGINT) AS est_bytes, estimated, round((1 - est / orig) * 100, 6) AS saving_pct
FROM (SELECT b.doc_id, b.preset, c.orig,
        CASE WHEN b.preset = 'verlustfrei' THEN sum(bytes)
          ELSE floor(sum(bytes) FILTER (n <= 3 OR page_no IN (1, (n + 1) // 2, n)) / least(n, 3) * n + 0.5) END AS est,
        b.preset <> 'verlustfrei' AND n > 3 AS estimated
      FROM page_bytes b JOIN (SELECT doc_id, count(*) AS n, sum(orig_bytes) AS orig FROM page GROUP BY 1) c ON c.doc_id = b.doc_id
      GROUP BY b.doc_id, b.preset, c.orig, n)""", "page", "factor", "page_bytes"),
    "compress_report": sql("SELECT * FROM rep", "page", res=_RES, rep=_REPORT),
    "report_summary": sql("""
SELECT status, count(*) AS n_docs, CAST(sum(before_bytes) AS BIGINT) AS before_bytes, CAST(sum(after_bytes) AS BIGINT) AS after_bytes
FROM rep GROUP BY status""", "page", res=_RES, rep=_REPORT),
    "codec_choice": sql("""
SELECT *, CASE WHEN g4_bytes <= flate_bytes THEN 'g4' ELSE 'flate' END AS codec, least(g4_bytes, flate_bytes) AS chosen_bytes
FROM (SELECT doc_id, page_no, CAST(floor(orig_bytes * 0.05::DOUBLE) AS BIGINT) AS g4_bytes,
  CAST(floor(orig_bytes * (0.04::DOUBLE + (page_no % 3) * 0.01::DOUBLE)) AS BIGINT) AS flate_bytes FROM page)""", "page"),
    "option_set": sql("""
SELECT owner, preset, mode, cm AS color_mode,
  CASE WHEN preset IN ('extrem-grau', 'extrem-farbe', 'extrem-sw') AND extreme_dpi > 0 THEN extreme_dpi ELSE d END AS dpi,
  q AS quality, n AS colors, CASE WHEN cm IN ('bw', 'indexed') THEN coalesce(bias, 0) END AS bias,
  CASE WHEN cm = 'bw' THEN coalesce(contrast, 0) END AS contrast,
  CASE WHEN cm = 'bw' THEN CASE WHEN dark_areas = '' THEN 'auto' ELSE dark_areas END END AS dark_areas,
  ocr AND mode <> 'lossless' AS ocr, CASE WHEN ocr AND mode <> 'lossless' THEN ocr_lang END AS ocr_lang
FROM (SELECT s.owner, s.preset, s.bias, s.contrast, s.dark_areas, s.ocr, s.ocr_lang, s.extreme_dpi,
    CASE WHEN s.preset = 'custom' THEN 'raster' ELSE p.mode END AS mode,
    CASE WHEN s.preset = 'custom' THEN s.color_mode ELSE p.color_mode END AS cm,
    CASE WHEN s.preset = 'custom' THEN s.dpi ELSE p.dpi END AS d,
    CASE WHEN s.preset = 'custom' THEN s.quality_pct / 100::DOUBLE ELSE p.quality END AS q,
    CASE WHEN s.preset = 'custom' THEN 16 ELSE p.colors END AS n
  FROM settings s LEFT JOIN preset p ON p.preset = s.preset)""", "preset", settings=_SETTINGS),
    "apply_intake_defaults": sql("""
SELECT owner, CASE WHEN intake_preset IN ('verlustfrei', 'mittel', 'custom') THEN intake_preset ELSE preset END AS preset,
  CASE WHEN intake_ocr IS NULL OR intake_preset = 'verlustfrei' THEN ocr ELSE intake_ocr END AS ocr FROM settings""",
        settings=_SETTINGS),
}
