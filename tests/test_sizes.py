"""What must hold as tables grow: folders of parts, long lists of names, no side of a join in the driver."""

import duckdb
import numpy as np
import pytest

from pagelake import catalog
from pagelake.operators import detect, objects, raster
from pagelake.session import cut_lineage, scratch_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_seen(rows):
    return sorted(tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in rows)


# ------------------------------------------------------------- F1: no side of a cell join is broadcast

def test_cell_joins_broadcast_nothing(spark):
    table = lambda rows, schema: cut_lineage(spark.createDataFrame(rows, schema), "small")  # noqa: E731 (files have a size the planner knows)
    points = table([(1, 1, 7, 20.0, 20.0), (1, 1, 8, 900.0, 900.0)], "doc_id long, page_no int, point_id long, px double, py double")
    boxes = table([(1, 1, 1, "rect", 10.0, 10.0, 50.0, 50.0, "", 10.0), (1, 1, 2, "image", 15.0, 15.0, 9.0, 9.0, "", 10.0)],
                                  "doc_id long, page_no int, z int, type string, x double, y double, w double, h double, text string, size double")
    hit = objects.objects_at_points(points, boxes, 0)
    ink = table([(1, 1, 5, 2, 1, 30.0, 30.0), (1, 1, 6, 2, 1, 500.0, 30.0)], "doc_id long, page_no int, stroke_id long, width int, seq int, x double, y double")
    erased = objects.erase_ink(ink, table([(1, 1, 31.0, 31.0)], "doc_id long, page_no int, x double, y double"))
    words = table([(1, 1, 0, 0.0, 0.0, 30.0, 12.0), (1, 1, 1, 300.0, 0.0, 330.0, 12.0)], "doc_id long, page_no int, idx int, x0 double, y0 double, x1 double, y1 double")
    redacted = objects.redact_words(words, table([(1, 1, 10.0, 0.0, 5.0, 5.0)], "doc_id long, page_no int, rx double, ry double, rw double, rh double"))
    for df in (hit, erased, redacted):
        assert "Broadcast" not in plan_of(df)
    assert {r.point_id: r.hit_z for r in hit.collect()} == {7: 2, 8: None}
    assert [r.stroke_id for r in erased.collect()] == [6] and [r.idx for r in redacted.collect()] == [1]


# ------------------------------------------------------------- F5, F6, F7: a table may be a folder of files

@pytest.mark.parametrize("name, source", [("intake_stream", "pages"), ("auto_handoff_stream", "pages"), ("frame_corner_stream", "documents")])
def test_streams_read_folders_of_parts(spark, sf, name, source):
    d = scratch_path(spark, "parts")
    spark.read.parquet(f"{sf}/{source}.parquet").repartition(3).write.parquet(f"{d}/{source}.parquet")
    run = catalog.queries()[name]
    got, want = run(spark, d).collect(), run(spark, sf).collect()
    assert len(got) > 10 and sorted(map(str, got)) == sorted(map(str, want))


# ------------------------------------------------------------- F8: more arrivals of a name than numbers

def test_raw_drop_equals_its_sql_beyond_the_numbers(spark):
    d = scratch_path(spark, "many")
    spark.range(1, 1200).selectExpr("CAST(id * 40 + id % 2 * 20 + 3 AS BIGINT) AS page_id", "concat('u', id) AS url", "repeat('x', CAST(1 + id % 9 AS INT)) AS html").write.parquet(f"{d}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d.removeprefix('file:')}/pages.parquet/*.parquet'")
    got = sorted((r["name"], r["bytes"]) for r in catalog.queries()["raw_drop"](spark, d).collect())
    want = con.execute(f"SELECT name, bytes FROM ({catalog.checks()['raw_drop']})").fetchall()
    assert len(got) > 1100 and got == sorted(want)
    assert any(len(n) > len("Akte_23_498.pdf") for n, _ in got)


# ------------------------------------------------------------- F3, F4, F10-F13, F19: rasters in batches, not by pixel or by page

def test_raster_steps_run_in_batches(spark):
    rng = np.random.default_rng(7)
    img = rng.integers(0, 256, (9, 13))
    lines = spark.createDataFrame([(1, 1, y, row.tolist()) for y, row in enumerate(img)], "doc_id long, page_no int, y int, px array<int>")
    profiles = raster.median_profiles(lines)
    assert "posexplode(px" not in plan_of(profiles)
    inner = np.sort(img[2:7], axis=0)
    assert [r.lum for r in profiles.where("axis = 'col'").orderBy("i").collect()] == inner[len(inner) // 2].tolist()
    plan = plan_of(detect.detect_document(lines))
    assert "FlatMapGroupsInArrow" not in plan and "FlatMapGroupsInPandas" not in plan
