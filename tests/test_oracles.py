"""Each query gives the rows of its SQL on the smallest tables."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"
QUICK = ("tile_pixels event_map lab_grid delta_e2000_pairs hex_roundtrip difference_gain downsample_box resize_area sample_bilinear flatness_sobel "
         "bilateral_r1 gaussian_blur block_artifacts otsu_threshold binary_palette kmeans_step region_area despeckle_target junctions crack_area ring_area "
         "score_metrics ssim image_profile rank_candidates latest_generation coverage_inverse flatten_cubic arc_to_cubics round_half_away number_format scene_rings "
         "lab_to_rgb transparent_keys components_tiles cracks scene_hard scene_slants scene_junctions scene_gradient trace_hard_rects debounced_requests").split()  # fmt: skip


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name[:-8]} as select * from '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    from rastrel.plans import queries

    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    got, want = (x[order].sort_values(order, ignore_index=True) for x in (got, want))
    for c in order:
        if got[c].dtype.kind == "f":
            assert (got[c].astype(float) - want[c].astype(float)).abs().max() < 2e-4, c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["scene_slants", "scene_junctions", "scene_circle_aa", "scene_rings"])
def test_pixels_equal_those_of_sql(spark, duck, name):
    """Every value to its last digit: 0.65625 is 0.6563, so means of samples may not fall below it."""
    from rastrel.plans import queries

    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df()
    got, want = (x.sort_values(["y", "x"], ignore_index=True)[sorted(want.columns)] for x in (got, want))
    assert got.equals(want)
