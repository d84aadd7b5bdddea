"""Catalogue, names, selection, merge and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as i
from ..operators import intake
from .views import sql

NOW = 1717243200000


def _files(spark, d):
    return i.raw_file(spark, d).selectExpr(
        "*", "CASE WHEN bytes % 5 = 0 THEN 'application/pdf' WHEN bytes % 5 = 1 THEN 'image/png' ELSE 'image/jpeg' END AS mime",
        f"{NOW}L AS now_ms")


def _selected(spark, d):
    """Names picked by the user, some of which are gone."""
    return i.raw_file(spark, d).selectExpr("CASE WHEN bytes % 4 = 0 THEN concat('gone/', name) ELSE name END AS name",
                                           "bytes").where("bytes % 3 <> 0").select("name")


def q_raw_catalog(spark, d):
    return intake.raw_catalog_df(i.raw_file(spark, d))


def q_work_list(spark, d):
    return intake.work_list(_files(spark, d)).select("name", "mime", "out_name")


def q_safe_pdf(spark, d):
    return intake.safe_names(_files(spark, d)).select("name", "pdf_name")


def q_safe_raw(spark, d):
    return intake.safe_names(_files(spark, d)).select("name", "raw_name")


def q_inside(spark, d):
    p = intake.safe_names(_files(spark, d)).selectExpr(
        "name", """concat('/lake/raw/', CASE bytes % 4 WHEN 0 THEN '' WHEN 1 THEN 'sub/' WHEN 2 THEN '../' ELSE './x/../' END,
             raw_name) AS path""")
    return intake.inside_dir(p, "/lake/raw").select("name", "path", "inside")


def q_fmt_size(spark, d):
    return intake.fmt_size(i.page(spark, d).selectExpr("doc_id", "page_no", "orig_bytes * orig_bytes % 5000000 AS b"), "b").select(
        "doc_id", "page_no", "size_text")


def q_output_names(spark, d):
    ev = i.table(spark, d, "events").selectExpr(
        "event_id", "ts", "CASE event_id % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'collection' WHEN 2 THEN 'scan' ELSE 'page' END AS how",
        "concat('Akte ', event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE '.tar.pdf' END) AS name", "event_id % 120 AS page",
        "CASE WHEN event_id % 7 = 3 THEN 'image/png' ELSE 'image/jpeg' END AS mime")
    return intake.output_names(ev).select("event_id", "out_name")


def q_file_kind(spark, d):
    return intake.file_kind(_files(spark, d)).select("name", "kind", "image_ext")


def _uploads(spark, d):
    return i.raw_file(spark, d).selectExpr(
        "name", "CASE WHEN bytes % 11 = 0 THEN 0 WHEN bytes % 13 = 0 THEN bytes * 1000000 ELSE bytes END AS bytes")


def q_validate(spark, d):
    return intake.validate_upload(_uploads(spark, d))


def q_classify(spark, d):
    return intake.classify_error(i.table(spark, d, "documents"), "text").select("doc_id", "error_class")


def q_apply_selection(spark, d):
    return intake.apply_selection(intake.raw_catalog_df(i.raw_file(spark, d)), _selected(spark, d)).select(
        "name", "kind", "modified_ms")


def q_live(spark, d):
    return intake.live_selection(i.raw_file(spark, d), _selected(spark, d))


def q_append(spark, d):
    p = i.page(spark, d).select("doc_id", "page_no")
    extra = i.page_override(spark, d).selectExpr("doc_id", "CAST(page_no AS INT) AS page_no")
    return intake.append_pages(p, extra, p.where("page_no = 1"))


def q_remaining(spark, d):
    return intake.remaining_files(i.raw_file(spark, d), _selected(spark, d))


def q_oldest(spark, d):
    return intake.oldest_first(i.raw_file(spark, d))


def _docs(spark, d):
    p = i.table(spark, d, "pages").withColumn("name", F.expr("""concat(CASE WHEN page_id % 17 = 0 THEN '.' ELSE '' END, url,
        CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '' END)"""))
    # Four sources a document: the group size is fixed by the expression.
    return p.groupBy(F.expr("page_id div 4").alias("doc_id")).agg(F.collect_list("name").alias("raw_sources")).selectExpr(
        "*", "doc_id % 3 <> 0 AS handed_off", "doc_id % 5 = 0 AS raw_cleaned")


def q_lineage(spark, d):
    return intake.lineage_join(_docs(spark, d), i.raw_file(spark, d))


def q_cleanup(spark, d):
    docs = _docs(spark, d)
    return intake.raw_cleanup(i.raw_file(spark, d), docs, docs.selectExpr("doc_id", "doc_id % 7 <> 0 AS accept"))


def _merge_members(spark, d):
    return i.table(spark, d, "orders").selectExpr(
        "o_orderkey div 10 AS merged_id", "9 - o_orderkey % 10 AS order_no", "o_orderkey AS doc_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'image' ELSE 'pdf' END AS kind", "o_orderkey % 97 <> 0 AS readable")


def q_merge(spark, d):
    return intake.merge_documents(_merge_members(spark, d), i.page(spark, d))[0]


def q_merge_aborted(spark, d):
    return intake.merge_documents(_merge_members(spark, d), i.page(spark, d))[1]


def q_handoff_summary(spark, d):
    items = i.table(spark, d, "orders").selectExpr(
        "o_custkey AS owner", "o_orderstatus <> 'P' AS has_result", "o_orderstatus = 'F' AS sent",
        "o_totalprice > 150000 AS delivered")
    return intake.handoff_summary(items)


def q_selection_summary(spark, d):
    return intake.selection_summary(i.raw_file(spark, d), _selected(spark, d))


def q_override_summary(spark, d):
    return intake.override_summary(i.page_override(spark, d), "lossless")


def q_allocate(spark, d):
    arrivals = i.table(spark, d, "events").selectExpr(
        "event_id AS seq", "concat(event_type, user_id % 23, '.pdf') AS name", f"{NOW}L + event_id AS now_ms")
    existing = i.table(spark, d, "pages").selectExpr(
        "concat('view', page_id % 23, CASE WHEN page_id % 9 > 1 THEN concat('_', page_id % 9) ELSE '' END, '.pdf') AS name")
    return intake.allocate_names(arrivals, existing)


def q_allocate_one_stamp(spark, d):
    """Every text arrives under one name and with one stamp."""
    arrivals = i.table(spark, d, "documents").selectExpr("doc_id AS seq", "'Akte.pdf' AS name", "77L AS now_ms")
    return intake.allocate_names(arrivals, spark.sql("SELECT explode(array('Akte_7.pdf', 'Akte_77.pdf', 'Akte_77-3.pdf')) AS name"))


QUERIES = {
    "allocate_names_one_stamp": q_allocate_one_stamp,
    "raw_catalog": q_raw_catalog, "work_list": q_work_list, "safe_pdf_name": q_safe_pdf, "safe_raw_name": q_safe_raw,
    "inside_dir": q_inside, "fmt_size": q_fmt_size, "output_names": q_output_names, "file_kind": q_file_kind,
    "validate_upload": q_validate, "classify_error": q_classify, "apply_selection": q_apply_selection,
    "live_selection": q_live, "append_pages": q_append, "remaining_files": q_remaining, "oldest_first": q_oldest,
    "lineage_join": q_lineage, "raw_cleanup": q_cleanup, "merge_documents": q_merge, "merge_aborted": q_merge_aborted,
    "handoff_summary": q_handoff_summary, "selection_summary": q_selection_summary,
    "override_summary": q_override_summary, "allocate_names": q_allocate,
}

_FILES = """
SELECT *, CASE WHEN bytes % 5 = 0 THEN 'application/pdf' WHEN bytes % 5 = 1 THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM raw_file"""
_SEL = """
SELECT CASE WHEN bytes % 4 = 0 THEN 'gone/' || name ELSE name END AS name FROM raw_file WHERE bytes % 3 <> 0"""
_END = r"(?i)\.(pdf|jpe?g|png|webp|heic|heif|tiff?|bmp)$"
_SAFE = r"""
SELECT name, bytes, regexp_replace(regexp_extract(regexp_replace(trim(name), '/+$', ''), '[^/]*$'), '[^\w.\-() ]+', '_', 'g') AS b FROM raw_file"""
_RAW = f"""
SELECT name, bytes, CASE WHEN regexp_matches(s, '{_END}') THEN s ELSE s || '.pdf' END AS raw_name
FROM (SELECT *, CASE WHEN b = '' OR b[1] = '.' THEN 'datei_{NOW}.pdf' ELSE b END AS s FROM safe)"""
_CAT = f"""
SELECT *, CASE WHEN name ILIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS kind FROM raw_file
WHERE name[1] <> '.' AND regexp_matches(name, '{_END}')"""
_DOCS = """
SELECT page_id // 4 AS doc_id, name, (page_id // 4) % 3 <> 0 AS handed_off, (page_id // 4) % 5 = 0 AS raw_cleaned
FROM (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN '.' ELSE '' END || url ||
  CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '' END AS name FROM pages)"""
_MEM = """
SELECT o_orderkey // 10 AS merged_id, 9 - o_orderkey % 10 AS order_no, o_orderkey AS doc_id, o_orderkey % 4 = 0 AS image,
  o_orderkey % 97 <> 0 AS readable FROM orders"""

SQL = {
    "allocate_names_one_stamp": """
WITH free AS (SELECT CASE WHEN n <= 498 THEN 'Akte' || CASE WHEN n > 1 THEN '_' || n ELSE '' END
    WHEN n = 499 THEN 'Akte_77' ELSE 'Akte_77-' || (n - 498) END || '.pdf' AS free_name, n
  FROM range(1, (SELECT count(*) + 5 FROM documents)) t(n)),
 ranked AS (SELECT free_name, row_number() OVER (ORDER BY n) AS k FROM free WHERE free_name NOT IN ('Akte_7.pdf', 'Akte_77.pdf', 'Akte_77-3.pdf'))
SELECT seq, 'Akte.pdf' AS name, free_name FROM (SELECT doc_id AS seq, row_number() OVER (ORDER BY doc_id) AS k FROM documents) JOIN ranked USING (k)""",
    "raw_catalog": sql("SELECT * FROM cat", "raw_file", cat=_CAT),
    "work_list": sql(r"""SELECT name, mime, regexp_replace(name, '(?i)\.pdf$', '') || '_komprimiert.pdf' AS out_name FROM files
WHERE name ILIKE '%.pdf' OR mime = 'application/pdf'""", "raw_file", files=_FILES),
    "safe_pdf_name": sql(f"""SELECT name, CASE WHEN s ILIKE '%.pdf' THEN s ELSE s || '.pdf' END AS pdf_name
FROM (SELECT *, CASE WHEN b IN ('', '.pdf') THEN 'scan_{NOW}.pdf' ELSE b END AS s FROM safe)""", "raw_file", safe=_SAFE),
    "safe_raw_name": sql("SELECT name, raw_name FROM rawn", "raw_file", safe=_SAFE, rawn=_RAW),
    "inside_dir": sql("""SELECT name, '/lake/raw/' || CASE bytes % 4 WHEN 0 THEN '' WHEN 1 THEN 'sub/' WHEN 2 THEN '../' ELSE './x/../' END
 || raw_name AS path, bytes % 4 IN (0, 3) AS inside FROM rawn""", "raw_file", safe=_SAFE, rawn=_RAW),
    "fmt_size": sql("""SELECT doc_id, page_no, CASE WHEN b < 1024 THEN b || ' B'
  WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024::DOUBLE * 10 + 0.5) / 10)
  ELSE printf('%.2f MB', floor(b / 1048576::DOUBLE * 100 + 0.5) / 100) END AS size_text
FROM (SELECT doc_id, page_no, orig_bytes * orig_bytes % 5000000 AS b FROM page)""", "page"),
    "output_names": r"""
SELECT event_id, CASE event_id % 4
  WHEN 0 THEN 'Akte ' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '.tar' END || '.pdf'
  WHEN 1 THEN 'Sammlung_' || strftime(ts, '%Y-%m-%d-%H-%M') || '.pdf'
  WHEN 2 THEN 'Scan_' || strftime(ts, '%Y-%m-%d_%H-%M') || '.pdf'
  ELSE 'Scan_' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '_S' ||
    CASE WHEN event_id % 120 < 10 THEN '0' ELSE '' END || event_id % 120 || CASE WHEN event_id % 7 = 3 THEN '.png' ELSE '.jpg' END
  END AS out_name FROM events""",
    "file_kind": sql("""SELECT name, CASE WHEN name ILIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS kind,
  CASE WHEN mime = 'image/png' THEN 'png' ELSE 'jpg' END AS image_ext FROM files""", "raw_file", files=_FILES),
    "validate_upload": sql(f"""SELECT name, bytes, CASE WHEN bytes = 0 THEN 'empty' WHEN bytes > 209715200 THEN 'too large'
  WHEN NOT regexp_matches(name, '{_END}') THEN 'unknown ending' END AS reason
FROM (SELECT name, CASE WHEN bytes % 11 = 0 THEN 0 WHEN bytes % 13 = 0 THEN bytes * 1000000 ELSE bytes END AS bytes FROM raw_file)""", "raw_file"),
    "classify_error": """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)password|encrypt') THEN 'protected' ELSE 'error' END AS error_class FROM documents""",
    "apply_selection": sql("SELECT name, kind, modified_ms FROM cat WHERE name IN (SELECT name FROM sel)", "raw_file", cat=_CAT, sel=_SEL),
    "live_selection": sql("SELECT name FROM sel INTERSECT SELECT name FROM raw_file", "raw_file", sel=_SEL),
    "append_pages": sql("""SELECT doc_id, page_no, 0 AS part FROM page UNION ALL SELECT doc_id, page_no, 1 FROM page_override
UNION ALL SELECT doc_id, page_no, 2 FROM page WHERE page_no = 1""", "page", "page_override"),
    "remaining_files": sql("SELECT * FROM raw_file WHERE name NOT IN (SELECT name FROM sel)", "raw_file", sel=_SEL),
    "oldest_first": sql("SELECT * FROM raw_file ORDER BY modified_ms, name", "raw_file"),
    "lineage_join": sql("SELECT doc_id, r.* FROM docs JOIN raw_file r USING (name)", "raw_file", docs=_DOCS),
    "raw_cleanup": sql("""SELECT *, CASE WHEN name IN (SELECT name FROM docs WHERE handed_off AND NOT raw_cleaned AND doc_id % 7 <> 0)
  THEN 'delete' ELSE 'keep' END AS action FROM raw_file""", "raw_file", docs=_DOCS),
    "merge_documents": sql("""
SELECT merged_id, row_number() OVER (PARTITION BY merged_id ORDER BY order_no, page_no) AS pos, doc_id, page_no, image AS a4_sheet
FROM (SELECT merged_id, order_no, m.doc_id, image, CASE WHEN image THEN 1 ELSE page_no END AS page_no
      FROM mem m LEFT JOIN page p ON p.doc_id = m.doc_id AND NOT m.image
      WHERE (image OR page_no IS NOT NULL) AND merged_id NOT IN (SELECT merged_id FROM mem WHERE NOT readable))""", "page", mem=_MEM),
    "merge_aborted": sql("SELECT DISTINCT merged_id, 'member could not be read' AS reason FROM mem WHERE NOT readable", mem=_MEM),
    "handoff_summary": """SELECT o_custkey AS owner, count(*) AS n_ready, count(*) FILTER (o_totalprice > 150000) AS n_delivered,
  bool_and(o_totalprice > 150000) AS complete FROM orders WHERE o_orderstatus NOT IN ('P', 'F') GROUP BY 1""",
    "selection_summary": sql("""SELECT count(*) AS n_files, count(*) FILTER (name IN (SELECT name FROM sel)) AS n_selected FROM raw_file""",
        "raw_file", sel=_SEL),
    "override_summary": sql("SELECT doc_id, count(*) AS n_pages, true AS ignored FROM page_override GROUP BY 1", "page_override"),
    "allocate_names": f"""
WITH arr AS (SELECT event_id AS seq, event_type || user_id % 23 AS stem,
    row_number() OVER (PARTITION BY event_type || user_id % 23 ORDER BY event_id) AS k FROM events),
have AS (SELECT DISTINCT 'view' || page_id % 23 || CASE WHEN page_id % 9 > 1 THEN '_' || page_id % 9 ELSE '' END || '.pdf' AS name FROM pages),
cand AS (SELECT stem, i, stem || CASE WHEN i = 1 THEN '' ELSE '_' || i END || '.pdf' AS name
  FROM (SELECT DISTINCT stem FROM arr), range(1, 499) t(i)),
free AS (SELECT stem, name, row_number() OVER (PARTITION BY stem ORDER BY i) AS k FROM cand WHERE name NOT IN (SELECT name FROM have))
SELECT seq, arr.stem || '.pdf' AS name, coalesce(f.name, arr.stem || '_' || ({NOW} + seq) || '.pdf') AS free_name
FROM arr LEFT JOIN free f ON f.stem = arr.stem AND f.k = arr.k""",
}
