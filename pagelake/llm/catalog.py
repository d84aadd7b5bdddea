"""The dealt operators as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelake.inputs import table
from . import decontaminate, html_text, mixing, near_dedup, passages, quality, search, secrets, sharding, token_files, url_filter, vector_codes, warc


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2).drop("h")


#: All pairs that share a shingle, then everything reachable: exact, for small tables.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) < 2 THEN l ELSE list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
 links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
 c AS (SELECT x, min(y) AS first FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(first, w.doc_id)) AS component_id, w.doc_id <= coalesce(first, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS path", "0L AS version", "text")
    return secrets.digest(secrets.scan_versions(docs, secrets.empty_ledger(spark)))


def op4_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("h")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched at the time of the event of their number; the events of a user change entries for that page's address."""
    pages, events = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "events")
    fetched = events.selectExpr("event_id AS page_id", "ts AS fetched_at")
    host, path = url_filter.host_of(F.col("url")), F.regexp_extract("url", url_filter.PATH, 1)
    pattern = F.when(F.col("event_id") % 3 == 0, host).when(
        F.col("event_id") % 3 == 1, F.regexp_replace(host, r"^[^.]*\.(?=[^.]*\.)", "")
    ).otherwise(F.concat(host, F.regexp_extract(path, r"^/[^/]*", 0)))
    changes = events.join(pages.withColumnRenamed("page_id", "user_id"), "user_id").select(
        F.when(F.col("event_id") % 2 == 0, "spam").otherwise("adult").alias("list"), pattern.alias("pattern"),
        F.when(F.col("event_type").isin("error", "view"), "remove").otherwise("add").alias("action"), F.col("ts").alias("at"),
    )
    return url_filter.judge(pages.join(fetched, "page_id", "left"), changes)


OP7_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '') AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
 changes AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'spam' ELSE 'adult' END AS list,
         CASE event_id % 3 WHEN 0 THEN host
              WHEN 1 THEN CASE WHEN length(host) - length(replace(host, '.', '')) >= 2 THEN substr(host, strpos(host, '.') + 1) ELSE host END
              ELSE host || regexp_extract(path, '^/[^/]*', 0) END AS pattern,
         ts AS "at", max(CASE WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'add' END) AS action
  FROM events JOIN p ON events.user_id = p.page_id GROUP BY ALL),
 spans AS (SELECT list, pattern, action, "at" AS valid_from, lead("at") OVER (PARTITION BY list, pattern ORDER BY "at") AS valid_to FROM changes),
 captures AS (SELECT p.page_id, url, host, path, ts AS fetched_at, string_split(host, '.') AS l,
                     list_filter(string_split(path, '/'), lambda x: x <> '') AS s
              FROM p LEFT JOIN events ON events.event_id = p.page_id),
 keys AS (SELECT DISTINCT page_id, fetched_at, unnest(list_concat(
            list_transform(range(1, greatest(len(l), 2)), lambda i: array_to_string(list_slice(l, i, len(l)), '.')),
            list_transform(range(1, len(s) + 1), lambda i: host || '/' || array_to_string(list_slice(s, 1, i), '/')))) AS pattern
          FROM captures WHERE host <> ''),
 found AS (SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists
           FROM keys JOIN spans USING (pattern)
           WHERE action = 'add' AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
SELECT page_id, url, fetched_at, host, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked
FROM captures LEFT JOIN found USING (page_id)
"""


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


OP11_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
 m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: Every document scored on every item.
OP12_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
 t AS (SELECT row_number() OVER () AS d, doc_id, CAST(len(l) AS BIGINT) AS n, l FROM words WHERE len(l) > 0),
 p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(l) AS term FROM t) GROUP BY ALL),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM t),
 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
 s AS (SELECT item_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
       FROM q JOIN w USING (term) JOIN p USING (term) JOIN t USING (d), c GROUP BY item_id, d)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN t USING (d) WHERE score > 0)
WHERE rank <= 50
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def _op13_sql(rounds: int) -> str:
    """Every part against every entry, round after round."""
    steps = r"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 m AS MATERIALIZED (SELECT r, p, list_slice(x, p * (len(x) // 4) + 1, (p + 1) * (len(x) // 4)) AS x FROM v, range(4) AS g(p)),
 c0 AS MATERIALIZED (SELECT p, r AS e, x FROM m WHERE r < 256)"""
    nearest = """,
 a{k} AS MATERIALIZED (SELECT r, p, x, min(struct_pack(d := d, e := e)) AS best FROM (
   SELECT m.r, m.p, m.x, c.e, CAST(list_sum(list_transform(list_zip(m.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
   FROM m JOIN c{k} c USING (p)) GROUP BY r, p, x)"""
    update = """,
 s{j} AS (SELECT p, best.e AS e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{k}),
 n{j} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
   FROM (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM s{j} GROUP BY ALL) GROUP BY p, e),
 c{j} AS MATERIALIZED (SELECT p, e, coalesce(n{j}.x, c{k}.x) AS x FROM c{k} LEFT JOIN n{j} USING (p, e))"""
    for k in range(rounds):
        steps += nearest.format(k=k) + update.format(k=k, j=k + 1)
    return steps + nearest.format(k=rounds) + f""",
 f AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
 h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (r), h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_decontamination": op2_decontamination, "op3_secrets": op3_secrets, "op4_ring": op4_ring,
            "op5_mix": op5_mix, "op6_quality": op6_quality, "op7_url_filter": op7_url_filter, "op8_html": op8_html, "op9_passages": op9_passages, "op10_tokens": op10_tokens,
            "op11_warc": op11_warc, "op12_search": op12_search, "op13_vector_codes": op13_vector_codes}


def checks() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op7_url_filter": OP7_SQL, "op11_warc": OP11_SQL, "op12_search": OP12_SQL, "op13_vector_codes": _op13_sql(vector_codes.ROUNDS)}
