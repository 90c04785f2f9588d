"""Findings of reviews: each test failed before its change."""

import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.functions.params import MapParams
from gridloom.operators import clouds, ndt
from gridloom.operators.walk import walk
from gridloom.plans.catalog import rays_of

#: event_id, user_id of the samples of three voxels in which one sample lies at the limit itself, up to rounding.
TIES = [(6535, 407), (20091, 1274), (302566, 1219), (329503, 316), (579126, 847), (43750, 1139), (265582, 1206), (301964, 1324), (314294, 989), (368984, 1326), (10564, 132), (99676, 146), (227037, 986), (376113, 1343), (477588, 146), (486779, 573)]


def events(folder, rows, files=1):
    """events.parquet with rows (event_id, user_id), dealt over so many files, and the same in order for SQL."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (folder / "events.parquet").mkdir()
    con.execute("CREATE TABLE events AS SELECT *, TIMESTAMP '2024-01-01' + INTERVAL (event_id) SECOND AS ts, 1e0 AS value FROM (" + " UNION ALL ".join(f"SELECT {e}::BIGINT AS event_id, {u}::BIGINT AS user_id" for e, u in rows) + ") ORDER BY event_id")
    for k in range(files):
        con.execute(f"COPY (SELECT * FROM events WHERE event_id % {files} = {k} ORDER BY event_id DESC) TO '{folder}/events.parquet/{k}.parquet' (FORMAT parquet)")
    return con


def test_ellipsoid_filter_does_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Samples at the limit are told apart as by the SQL that adds them in order, whatever the files."""
    for files in (1, 3, 7):
        folder = tmp_path / str(files)
        folder.mkdir()
        want = {r[0] for r in events(folder, TIES, files).execute(entry.oracle_sql()["ellipsoid_filter"]).fetchall()}
        assert {r[0] for r in entry.queries()["ellipsoid_filter"](spark, str(folder)).collect()} == want


def test_line_query_broadcasts_no_visits(spark, tmp_path):
    """Small events are small visits to the planner, which are 31 times as many rows: a join of them must not go through the driver."""
    want = events(tmp_path, TIES).execute(entry.oracle_sql()["line_query"]).fetchall()
    got = entry.queries()["line_query"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_distributions_of_busy_voxels_take_few_steps(spark):
    """20,000 rays through the same 20 voxels, with a sample in every tenth of them: one step a sample, not one a visit."""
    p = MapParams()
    rays = spark.range(20_000).selectExpr("id AS seq", "0.05e0 + 0.1e0 * (id % 3) AS ox", "0.05e0 AS oy", "0.05e0 AS oz", "CASE WHEN id % 10 = 0 THEN 1.01e0 + 0.001e0 * (id % 71) ELSE 2.05e0 END AS sx", "0.02e0 + 0.001e0 * (id % 53) AS sy", "0.03e0 + 0.001e0 * (id % 37) AS sz", "CAST(id % 7 AS FLOAT) AS intensity")
    began = time.time()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in ndt.integrate_rays(rays, p).collect()}
    assert time.time() - began < 30
    # every ray's visits, in the order of the rays: hits and misses of a voxel that none of them leaves out
    visits = walk(rays, p, keep=("ox", "oy", "oz", "sx", "sy", "sz", "intensity"))
    few = visits.where("seq < 300")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in ndt.integrate(few, p).collect()} == {tuple(r)[:3]: tuple(r)[3:] for r in ndt.integrate_rays(rays.where("seq < 300"), p).collect()}
    samples = {tuple(r)[:3]: r["n"] for r in visits.where("sample").groupBy("gx", "gy", "gz").agg(F.count("*").alias("n")).collect()}
    assert {k for k, v in got.items() if v[1] > 0} == set(samples) and len(got) == visits.select("gx", "gy", "gz").distinct().count()


def test_ellipsoids_deal_rays_by_blocks(spark, tmp_path):
    """The axes are those of the fold over single visits; what is shuffled are packed rows."""
    events(tmp_path, TIES)
    got = entry.queries()["ndt_ellipsoids"](spark, str(tmp_path))
    assert "cells" in got._jdf.queryExecution().executedPlan().toString()
    visits = walk(rays_of(spark, str(tmp_path)), MapParams(), keep=("ox", "oy", "oz", "sx", "sy", "sz", "intensity"))
    want = clouds.ellipsoids(ndt.covariance(ndt.integrate(visits).where("n_samples > 0")))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
