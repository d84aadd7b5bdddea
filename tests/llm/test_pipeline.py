"""The stages one by one against plain Python, and the registered queries over the small tables."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pagelake.llm import catalog, mixing, near_dedup, quality, token_files
from pagelake.session import cut_lineage
from tools.check import rows_of
from . import cases


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, cases.prose(40)) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    base = [cases.prose(150) for _ in range(12)]
    rows = [(1000 + i, t, "en", "abc"[i % 3] if i % 4 else None) for i, t in enumerate(base)] + cases.awkward_rows()[3:]
    rows += [(1700, base[0], "en", "a"), (1701, base[0] + " more", "en", "b"), (1702, base[1] + " " + items[0][1], "en", "c"), (None, cases.prose(90), "en", "a")]
    cases.table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = docs.collect()
        docs = cut_lineage(stage(spark, docs, data), name)
        after = docs.collect()
        assert docs.columns == columns
        key = lambda r: (r.doc_id, r.text)
        if name == "quality_rules":
            verdict = Counter((r.doc_id, r.kept) for r in quality.judge(spark.createDataFrame(before, docs.schema)).collect())
            assert Counter(r.doc_id for r in after) == Counter({i: n for (i, kept), n in verdict.items() if kept})
        elif name == "near_duplicates":
            sets = {key(r): set(near_dedup.shingles((r.text or "").encode(), 5).tolist()) for r in before}
            for r in before:
                like = [s.doc_id for s in before if s.doc_id is not None and 100 * len(sets[key(r)] & sets[key(s)]) >= 80 * len(sets[key(r)] | sets[key(s)])]
                assert (key(r) in map(key, after)) == (r.doc_id is None or r.doc_id == min(like))
        elif name == "benchmark_decontamination":
            assert {key(r) for r in before} - {key(r) for r in after} == {key(r) for r in before if r.doc_id == 1702}
        else:
            count = lambda t: len((t or "").encode().split())
            mixed, words = mixing.mix(spark.createDataFrame(before, docs.schema)).collect(), defaultdict(int)
            for r in after:
                words[r.doc_id] += count(r.text)
                assert any(s.doc_id == r.doc_id and s.text.startswith(r.text) for s in before) and r.n_chars == len(r.text)
            assert words == {i: n for i, n in ((i, sum(r.taken for r in mixed if r.doc_id == i)) for i in {r.doc_id for r in mixed}) if n}
    out = cp.STAGES[-1][1](spark, docs, data).collect()
    e = token_files.Encoder(token_files.tokenizer_path())
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r.doc_id, len(e(r.text)) // 4 + 1) for r in docs.collect())


def test_run_and_empty_table(spark, data, tmp_path):
    assert cp.run(spark, data).count() > 0
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(name, spark, sf):
    df = catalog.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    kind = "pages" if re.match("op(7|8|11)_", name) else "embeddings" if name.startswith("op13_") else "documents"
    if name not in ("op2_decontamination", "op9_passages", "op12_search"):
        assert len(got) == spark.read.parquet(f"{sf}/{kind}.parquet").count()
    if name in catalog.checks():
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "events", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        cur = con.execute(catalog.checks()[name])
        columns = [d[0] for d in cur.description]
        want = cur.fetchall()
        assert sorted(columns) == sorted(df.columns) and rows_of(df.columns, got) == rows_of(columns, want)


def test_numbers_and_entry():
    import __spark_entry__ as entry

    found = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries())
    assert found == list(range(1, 14)) and catalog.checks().keys() <= catalog.queries().keys()
    assert catalog.queries().keys() | {"pipeline"} <= entry.queries().keys()
