"""DuckDB forms of the logical inputs, joined into a WITH prefix by ``sql``."""

VIEWS = {
    "raw_file": """
SELECT CASE WHEN page_id % 17 = 0 THEN '.' ELSE '' END || url ||
       CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '' END AS name,
       CAST(length(html) AS BIGINT) AS bytes, 1704067200000 + ((page_id * 37) % 101) * 60000 AS modified_ms
FROM pages""",
    "page": """
SELECT l_orderkey AS doc_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_quantity, l_shipdate) AS INT) AS page_no,
       200 + l_quantity * 60 AS w_pt, CAST(280 + (l_partkey % 40) * 60 AS DOUBLE) AS h_pt,
       CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes
FROM lineitem""",
    "factor": """
SELECT * FROM (VALUES ('verlustfrei', 0.97::DOUBLE), ('leicht', 0.6::DOUBLE), ('mittel', 0.4::DOUBLE),
  ('stark', 0.25::DOUBLE), ('extrem-grau', 0.15::DOUBLE), ('extrem-farbe', 0.1::DOUBLE),
  ('extrem-sw', 0.05::DOUBLE)) t(preset, f)""",
    "page_bytes": """
SELECT doc_id, page_no, preset, CAST(floor(orig_bytes * f) AS BIGINT) AS bytes FROM page, factor""",
    "preset": """
SELECT * FROM (VALUES ('verlustfrei', 'lossless', NULL, NULL, NULL, NULL),
  ('leicht', 'raster', 'color', 200, 0.80::DOUBLE, NULL), ('mittel', 'raster', 'color', 150, 0.62::DOUBLE, NULL),
  ('stark', 'raster', 'color', 110, 0.45::DOUBLE, NULL), ('extrem-grau', 'raster', 'gray', 100, 0.40::DOUBLE, NULL),
  ('extrem-farbe', 'raster', 'indexed', 150, NULL, 16), ('extrem-sw', 'raster', 'bw', 300, NULL, NULL))
  t(preset, mode, color_mode, dpi, quality, colors)""",
    "page_override": """
SELECT doc_id, 1 + quality AS page_no,
       CASE doc_id % 8 WHEN 0 THEN 'verlustfrei' WHEN 1 THEN 'leicht' WHEN 2 THEN 'mittel' WHEN 3 THEN 'stark'
         WHEN 4 THEN 'extrem-grau' WHEN 5 THEN 'extrem-farbe' WHEN 6 THEN 'extrem-sw' ELSE 'unknown' END AS preset,
       CAST(doc_id % 81 AS INT) - 40 AS bias
FROM labels""",
    "t_gray": """
SELECT doc_id, 1 AS page_no, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
       CASE WHEN x < length(line) THEN unicode(substring(line, CAST(x AS INT) + 1, 1)) % 256 ELSE 255 END AS g
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS y
      FROM (SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '(?s).{1,64}') END AS l FROM documents)),
     range(0, 64) r(x)""",
    "t_line": """
SELECT doc_id, page_no, y, list(g ORDER BY x) AS px FROM t_gray GROUP BY ALL""",
    "e_gray": """
SELECT vec_id AS doc_id, 1 AS page_no, CAST(floor(i / 8) AS INT) AS y, CAST(i % 8 AS INT) AS x,
       greatest(0, least(255, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) * 3 + 1) * 127.5) AS INT))) AS g
FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)""",
    "e_rgb": """
SELECT doc_id, page_no, y, x, g AS r, (g * 7) % 256 AS g, (g * 13) % 256 AS b FROM e_gray""",
    "word": r"""
SELECT conv_id AS doc_id, CAST(turn AS INT) + 1 AS page_no, CAST(i AS INT) AS idx, w AS text,
       CAST((i * 13 + length(w) * 7) % 100 AS INT) AS confidence,
       CAST((i % 12) * 50 AS DOUBLE) AS x0, CAST(floor(i / 12) * 14 AS DOUBLE) AS y0,
       CAST((i % 12) * 50 + length(w) * 6 AS DOUBLE) AS x1, CAST(floor(i / 12) * 14 + 12 AS DOUBLE) AS y1
FROM (SELECT conv_id, turn, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS i
      FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[ \n\t]+') AS a FROM conversations))""",
    "redaction": """
SELECT DISTINCT conv_id AS doc_id, CAST(turn AS INT) + 1 AS page_no, 40.0::DOUBLE AS rx, 0.0::DOUBLE AS ry,
       180.0::DOUBLE AS rw, 30.0::DOUBLE AS rh
FROM conversations WHERE conv_id % 3 = 0""",
    "scan_attempt": """
SELECT user_id AS batch_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       ts, event_type <> 'error' AS ok, value > 200 AS cancel FROM events""",
    "profile_change": """
SELECT user_id AS owner, event_type AS key, value, ts, event_id AS seq FROM events""",
    "stroke_point": """
SELECT user_id AS stroke_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
       value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events""",
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` behind a WITH list of the named views and of ``extra`` ones."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
