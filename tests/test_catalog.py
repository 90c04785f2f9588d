"""Queries against their SQL on a small events table."""

import datetime

import pytest

import __spark_entry__ as entry
from gridloom.plans.catalog import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
CHECKED = ("voxel_keys", "filter_clip_box", "split_long_rays", "walk_ranges", "occupancy_map", "exclude_origin", "clearing_pattern", "voxel_mean", "incident_normal", "tsdf", "trajectory_join", "rays_query", "line_query", "nearest_neighbours", "merge_maps", "compare_maps", "heightmap_planar", "stream_occupancy")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(seconds=7 * i), (i * 13) % 97, "e", float(i % 50), "{}") for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(out / "events.parquet"))
    vectors = [(i, [float((i * 7) % 11) / 20, float((i * 5) % 7) / 20, 0.1], 0) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(out / "embeddings.parquet"))
    return str(out)


def rows(records, columns):
    return sorted(tuple("NULL" if r[c] is None else repr(float(r[c])) if isinstance(r[c], float) else str(r[c]) for c in columns) for r in records)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, folder, name):
    connection = duckdb.connect()
    for table in ("events", "embeddings"):
        connection.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    result = connection.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert rows([r.asDict() for r in got.collect()], columns) == rows(want, columns)


def test_entry_lists_queries_with_sql():
    known = entry.queries()
    assert {*SQL} <= {*known} and {*entry.oracle_sql()} <= {*known}
    assert len(QUERIES) >= 60
