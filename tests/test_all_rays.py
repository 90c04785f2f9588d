"""The queries on a map ask the map of all rays, with all rays."""

import pytest

from gridloom.plans.catalog import QUERIES
from tests import test_catalog
from tests.test_catalog import folder  # noqa: F401

NAMES = ("rays_query", "line_query", "clearance", "nearest_neighbours", "cloud_filter", "merge_maps", "submap", "compare_maps", "voxel_lookup", "colour_by_height", "voxel_cubes", "clearing_pattern")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, folder, name):  # noqa: F811
    test_catalog.test_query_matches_its_sql(spark, folder, name)


def test_no_voxel_or_ray_is_left_out(spark, folder):  # noqa: F811
    run = lambda name: QUERIES[name](spark, folder).collect()
    key = lambda r: (r["gx"], r["gy"], r["gz"])
    whole = {key(r): r["occupancy"] for r in run("occupancy_map")}
    solid = {v for v, o in whole.items() if o >= 0}
    assert {key(r) for r in run("clearance")} == {key(r) for r in run("clearing_pattern")} == {*whole}
    assert {key(r) for r in run("voxel_cubes")} == {key(r) for r in run("colour_by_height")} == solid
    assert {r["seq"] for r in run("rays_query")} == {r["seq"] for r in run("line_query")} == {r["seq"] for r in run("voxel_keys")}
    (counts,) = run("compare_maps")
    assert counts["same"] + counts["different"] + counts["missing"] == len(whole)
