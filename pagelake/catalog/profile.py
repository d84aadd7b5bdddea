"""Library and profile synchronisation."""

from __future__ import annotations

from .. import inputs as i
from ..operators import profile

NOW = 1717243200000


def _lib(spark, d):
    return i.table(spark, d, "customer").selectExpr(
        "concat('sig', c_custkey) AS id", "c_name AS name", "1700000000000 + c_custkey AS created")


def q_delete(spark, d):
    gone = i.table(spark, d, "customer").where("c_custkey % 10 = 0").selectExpr("concat('sig', c_custkey) AS id")
    return profile.library_delete(_lib(spark, d), gone)


def q_add(spark, d):
    new = i.table(spark, d, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('own', s_suppkey) END AS id", "s_name AS name",
        "CASE WHEN s_suppkey % 3 = 0 THEN 0L WHEN s_suppkey % 3 = 1 THEN 1600000000000L END AS created")
    # Entries without an id come twice: equal entries need ids of their own.
    out = profile.library_add(_lib(spark, d), new.unionByName(new.where("id IS NULL")), NOW)
    return out.selectExpr(
        f"regexp_replace(id, '^sig{NOW}-[0-9a-f]{{32}}-[12]$', 'generated') AS id", "name", "created",
        "count(*) OVER (PARTITION BY id) AS same_id",
    )


def q_pull(spark, d):
    c = i.table(spark, d, "customer").selectExpr("*", "element_at(array('signatures', 'stamps', 'settings'), CAST(c_custkey % 3 + 1 AS INT)) AS key")
    local = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS owner", "key", "c_name AS value", "c_nationkey % 2 = 0 AS changed")
    remote = c.where("c_custkey % 5 <> 0").selectExpr("c_custkey AS owner", "key", "c_mktsegment AS value")
    return profile.profile_pull(local, remote)


def q_export(spark, d):
    c = i.table(spark, d, "customer")
    sig = c.where("c_custkey % 5 < 2").selectExpr("c_custkey div 5 AS owner", "CAST(c_custkey AS STRING) AS id", "c_name AS name")
    st = c.where("c_custkey % 5 = 2").selectExpr("c_custkey div 5 AS owner", "CAST(c_custkey AS STRING) AS id", "c_mktsegment AS title")
    se = c.where("c_custkey % 5 > 2").selectExpr("c_custkey div 5 AS owner", "CASE c_custkey % 5 WHEN 3 THEN 'dpi' ELSE 'preset' END AS key",
                                                 "CAST(c_nationkey AS STRING) AS value")
    return profile.profile_export(sig, st, se, "pagelake", "2024-06-01T12:00:00.000Z")


QUERIES = {"library_delete": q_delete, "library_add": q_add, "profile_pull": q_pull, "profile_export": q_export}

_LIB = "SELECT 'sig' || c_custkey AS id, c_name AS name, 1700000000000 + c_custkey AS created FROM customer"
_KEY = "CASE c_custkey % 3 WHEN 0 THEN 'signatures' WHEN 1 THEN 'stamps' ELSE 'settings' END"

SQL = {
    "library_delete": f"SELECT * FROM ({_LIB} WHERE c_custkey % 10 <> 0)",
    "library_add": f"""SELECT *, 1 AS same_id FROM ({_LIB}) UNION ALL
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'own' || s_suppkey ELSE 'generated' END, s_name,
  CASE WHEN s_suppkey % 3 = 1 THEN 1600000000000 ELSE {NOW} END, 1
FROM supplier, range(2) t(n) WHERE n = 0 OR s_suppkey % 2 = 1""",
    "profile_pull": f"""
SELECT c_custkey AS owner, {_KEY} AS key,
  CASE WHEN c_custkey % 5 <> 0 AND NOT (c_custkey % 4 <> 0 AND c_nationkey % 2 = 0) THEN c_mktsegment ELSE c_name END AS value,
  c_custkey % 5 <> 0 AND NOT (c_custkey % 4 <> 0 AND c_nationkey % 2 = 0) AS pulled
FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 5 <> 0""",
    "profile_export": """
SELECT owner, '{"app":"pagelake","version":1,"exported":"2024-06-01T12:00:00.000Z","signatures":[' || coalesce(string_agg(sig, ',' ORDER BY id), '') ||
  '],"stamps":[' || coalesce(string_agg(st, ',' ORDER BY id), '') || '],"settings":{' || coalesce(string_agg(se, ',' ORDER BY se), '') || '}}' AS document
FROM (SELECT c_custkey // 5 AS owner, CAST(c_custkey AS VARCHAR) AS id,
  CASE WHEN c_custkey % 5 < 2 THEN '{"id":"' || c_custkey || '","name":"' || c_name || '"}' END AS sig,
  CASE WHEN c_custkey % 5 = 2 THEN '{"id":"' || c_custkey || '","title":"' || c_mktsegment || '"}' END AS st,
  CASE WHEN c_custkey % 5 > 2 THEN CASE c_custkey % 5 WHEN 3 THEN '"dpi":"' ELSE '"preset":"' END || c_nationkey || '"' END AS se FROM customer)
GROUP BY owner""",
}
