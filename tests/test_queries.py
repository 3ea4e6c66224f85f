import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from rasterloom.functions import samples as S
from rasterloom.plans import queries as engine
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_query_equals_its_sql(spark, same_rows, name):
    same_rows(entry_point.queries()[name](spark, DATA), entry_point.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE) - {"codec_rollup"}))
def test_query_without_sql_has_rows(spark, name):
    assert entry_point.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    row = entry_point.entry(spark).first()
    assert row["symbols"] == 32000 and 30000 < row["residual_bytes"] < 32000


def test_ladder_descends(spark):
    from rasterloom.plans import studies
    from rasterloom.sources import rasters

    one = rasters.scene(spark, 1, 96, 128)
    rgb = one.selectExpr("media_id", "frame_no", "explode(sequence(0, 2)) AS plane_no", "y", "x", "v").withColumn("v", F.expr("(v + plane_no * 7 + ((x * plane_no) >> 4)) & 255"))
    sizes = {r["name"]: r["n_bytes"] for r in studies.ladder(rgb).collect()}
    assert sizes["raw"] > sizes["huffman"] > sizes["med"] > sizes["adaptive"]


def test_ladder_has_every_rung(spark):
    assert engine.compression_ladder(spark, DATA).count() == 7


def test_context_rules():
    """Values by hand: gradient levels at 2 and 7, the longest ladders, the middle sign pattern at the edges."""
    import duckdb

    levels = {d: duckdb.sql(f"SELECT {S.gradient_level(f'({d})')}").fetchall()[0][0] for d in (0, 1, 2, 3, 7, 8, 21, 22, -2, -7, -21, -22)}
    assert levels == {0: 0, 1: 1, 2: 1, 3: 2, 7: 2, 8: 3, 21: 3, 22: 4, -2: -1, -7: -2, -21: -3, -22: -4}
    assert len(S.ACTIVITY_LADDERS[24]) == 23 and len(S.ACTIVITY_LADDERS[32]) == 31 and S.ACTIVITY_LADDERS[32][-1] == 255
    edge = duckdb.sql(f"SELECT {S.sign_pattern()} FROM (SELECT 0 AS y, 3 AS x, 1 AS n, 2 AS w, 9 AS nw, 4 AS ne)").fetchall()[0][0]
    assert edge == 4


def test_half_steps_move_the_centre():
    """Each half step starts from the best so far, so two may add up; equal whole vectors go to the first."""
    import numpy as np

    from rasterloom.operators import motion

    flat = np.full((16, 16), 7, np.uint8)
    dy, dx, cost = motion.search(flat, flat)
    assert (dy == -2 * motion.SEARCH).all() and (dx == -2 * motion.SEARCH).all() and (cost == 0).all()


def test_comparison_is_lossless(spark):
    rows = engine.codec_comparison(spark, DATA).collect()
    assert all(r["lossless"] and r["max_err"] == 0 for r in rows)


def test_estimate_is_near_the_coded_size(spark):
    for r in engine.static_coder_sizes(spark, DATA).collect():
        assert r["rans_estimate"] <= r["rans_bytes"] <= r["rans_estimate"] + 512


def test_displacement_search_agrees_with_numpy(spark):
    """The DataFrame form and the numpy form name the same whole vectors and costs."""
    import numpy as np

    from rasterloom.operators import motion, stencils
    from rasterloom.sources import rasters

    frames, h, w = engine.SMALL
    samples = engine.small_scene(spark)
    planes = np.zeros((frames, h, w), np.uint8)
    for r in samples.collect():
        planes[r["frame_no"], r["y"], r["x"]] = r["v"]
    best = {(r["brow"], r["bcol"]): r["cost"] for r in motion.best_displacement(motion.displacement_costs(samples, engine.REACH, engine.BLOCK)).collect()}
    order = [(y, x) for y in range(-engine.REACH, engine.REACH + 1) for x in range(-engine.REACH, engine.REACH + 1)]
    costs = np.stack([motion.block_sums(motion.cost(planes[1], planes[0][np.clip(np.arange(h) + y, 0, h - 1)][:, np.clip(np.arange(w) + x, 0, w - 1)]), engine.BLOCK) for y, x in order])
    assert all(costs[:, b, c].min() == v for (b, c), v in best.items())
    spatial = motion.spatial_cost(planes[1], engine.BLOCK)
    found = {(r["brow"], r["bcol"]): r["spatial"] for r in motion.spatial_costs(stencils.med_residuals(samples), engine.BLOCK).where("frame_no = 1").collect()}
    assert all(spatial[k] == v for k, v in found.items())
    assert rasters.unpack(rasters.pack(samples)).exceptAll(samples).count() == 0
