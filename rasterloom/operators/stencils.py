"""Neighbourhood operators over samples: causal neighbours, shifts, half-sample planes, residuals, earlier occurrences.

All of them work in tiles with halos (operators/tiles.py): one exchange each, no window over a whole plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import samples as S
from rasterloom.operators import tiles
from rasterloom.sources.rasters import KEY

#: Raster positions that are searched for earlier occurrences together.
CHUNK = 1 << 16


def neighbours(samples: DataFrame, second_ring: bool = False) -> DataFrame:
    """n, w, nw, ne (and ww, nn, nne): 0 outside the plane; ne of the last column is n.

    In the second ring, what is outside falls back to the neighbour one step nearer.
    """
    up = left = 1 + second_ring
    column, row = tiles.along_columns(), tiles.along_rows()
    out = tiles.tiled(samples, up=up, left=left, right=1).withColumn("_n", F.lag("v").over(column))
    if second_ring:
        out = out.withColumn("_nn", F.lag("v", 2).over(column))
    zero = F.lit(0)
    columns = {
        "w": F.coalesce(F.lag("v").over(row), zero),
        "nw": F.coalesce(F.lag("_n").over(row), zero),
        "ne": F.coalesce(F.lead("_n").over(row), "_n", zero),
    }
    if second_ring:
        columns["_ww"] = F.lag("v", 2).over(row)
        columns["_nne"] = F.lead("_nn").over(row)
    out = out.withColumns(columns).withColumn("n", F.coalesce("_n", zero))
    if second_ring:
        out = out.withColumns({"ww": F.coalesce("_ww", "w"), "nn": F.coalesce("_nn", "n"), "nne": F.coalesce("_nne", "_nn", "ne")})
    kept = [*KEY, "y", "x", "v", "n", "w", "nw", "ne", *(["ww", "nn", "nne"] if second_ring else [])]
    return tiles.own(out).select(*kept)


def repeated_neighbours(samples: DataFrame) -> DataFrame:
    """w, n, nw, ne, ww, nn, nne as studies take them: the plane's edge samples repeat outside it."""
    column, row = tiles.along_columns(), tiles.along_rows()
    out = tiles.tiled(samples, up=2, left=2, right=1)
    out = out.withColumns({"n": F.coalesce(F.lag("v").over(column), "v"), "nn": F.coalesce(F.lag("v", 2).over(column), F.first("v").over(column))})
    sideways = {"w": F.coalesce(F.lag("v").over(row), "v"), "ww": F.coalesce(F.lag("v", 2).over(row), F.first("v").over(row)), "nw": F.coalesce(F.lag("n").over(row), "n")}
    out = out.withColumns(sideways | {"ne": F.coalesce(F.lead("n").over(row), "n"), "nne": F.coalesce(F.lead("nn").over(row), "nn")})
    return tiles.own(out).select(*KEY, "y", "x", "v", "n", "w", "nw", "ne", "ww", "nn", "nne")


def shifted(samples: DataFrame, dy: int, dx: int, top: str = "zero") -> DataFrame:
    """Adds `s`, the sample dy rows up and dx columns left (right, if negative).

    Sideways, edges repeat. Above the first row: `zero`, or `repeat`.
    """
    column, row = tiles.along_columns(), tiles.along_rows()
    out = tiles.tiled(samples, up=dy, left=max(dx, 0), right=max(-dx, 0))
    above = F.coalesce(F.lag("v", dy).over(column), F.lit(0) if top == "zero" else F.first("v").over(column)) if dy else F.col("v")
    out = out.withColumn("_s", above)
    if dx:
        side = F.lag("_s", dx) if dx > 0 else F.lead("_s", -dx)
        edge = F.first("_s") if dx > 0 else F.last("_s")
        out = out.withColumn("_s", F.coalesce(side.over(row), edge.over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return tiles.own(out).withColumnRenamed("_s", "s")


def half_sample_phases(samples: DataFrame) -> DataFrame:
    """`phases`, each sample's values at the four half-sample phases 2 (dy odd) + (dx odd): bilinear, edges repeat."""
    column, row = tiles.along_columns(), tiles.along_rows()
    out = tiles.tiled(samples, down=1, right=1).withColumn("_r", F.coalesce(F.lead("v").over(row), "v"))
    out = out.withColumns({"_d": F.coalesce(F.lead("v").over(column), "v"), "_rd": F.coalesce(F.lead("_r").over(column), "_r")})
    return tiles.own(out).selectExpr(*KEY, "y", "x", "array(v, shiftright(v + _r + 1, 1), shiftright(v + _d + 1, 1), shiftright(v + _r + _d + _rd + 2, 2)) AS phases")


def half_sample_planes(samples: DataFrame) -> DataFrame:
    """The same as four rasters, (phase, v)."""
    return half_sample_phases(samples).selectExpr(*KEY, "y", "x", "posexplode(phases) AS (phase, v)")


def med_residuals(samples: DataFrame) -> DataFrame:
    """pred (MED with edge rules), residual (-128 to 127) and sym (zigzag)."""
    return neighbours(samples).withColumn("pred", F.expr(S.at_edges(S.med("n", "w", "nw")))).withColumn("residual", F.expr(S.centre("v - pred"))).withColumn("sym", F.expr(S.zigzag("residual")))


def med_bundle(samples: DataFrame) -> DataFrame:
    """Residual symbols with activity, its bucket of 16 and the sign pattern of two differences."""
    return med_residuals(samples).withColumn("activity", F.expr(S.activity())).withColumns({"bucket": F.expr(S.bucket("activity", S.ACTIVITY_LADDERS[16])), "signs": F.expr(S.sign_pattern())})


def predictors(samples: DataFrame) -> DataFrame:
    """Predictions by name, one row per sample and predictor: average, planar, med, gap, and the mean of med and gap."""
    near = neighbours(samples, second_ring=True).withColumns({"p_med": F.expr(S.med("n", "w", "nw")), "p_gap": F.expr(S.gap())})
    clipped = "greatest(0, least(255, {}))"
    choices = {"average": S.average("n", "w"), "planar": S.planar("n", "w", "nw"), "med": "p_med", "gap": clipped.format("p_gap"), "med_gap": clipped.format("(p_med + p_gap) >> 1")}
    stack = ", ".join(f"'{k}', {S.at_edges(e)}" for k, e in choices.items())
    return near.selectExpr(*KEY, "y", "x", "v", S.activity() + " AS activity", f"stack({len(choices)}, {stack}) AS (predictor, pred)").withColumn("sym", F.expr(S.zigzag("v - pred")))


def colour_planes(samples: DataFrame, forward: bool = True) -> DataFrame:
    """Planes 0 to 2 through the reversible colour transform, or back; further planes (alpha) stay as they are."""
    # A conditional aggregation (combined before its only shuffle) sets the channels side by side.
    pixels = samples.where("plane_no < 3").groupBy("media_id", "frame_no", "y", "x").agg(*[F.max(F.when(F.col("plane_no") == k, F.col("v"))).alias(c) for k, c in enumerate("abc")])
    made = S.rct_planes("a", "b", "c") if forward else S.rct_colours("a", "b", "c")
    out = pixels.selectExpr("media_id", "frame_no", "y", "x", f"stack(3, 0, {made[0]}, 1, {made[1]}, 2, {made[2]}) AS (plane_no, v)")
    return out.selectExpr(*KEY, "y", "x", "CAST(v AS INT) AS v").unionByName(samples.where("plane_no >= 3").select(*KEY, "y", "x", "v"))


def previous_occurrence(samples: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """For each inner sample, the last raster position before it with the same four causal neighbours.

    Positions are searched within chunks of `chunk`; only a neighbourhood's first position in a chunk looks further back,
    to the neighbourhood's last position in an earlier chunk. So a neighbourhood that much of a plane has is never
    ordered in one task; what is ordered is a row for each neighbourhood and chunk.
    """
    same = [*KEY, "w", "n", "nw", "ne"]
    near = neighbours(samples).where("y > 0 AND x > 0").withColumn("pos", F.expr(f"CAST(y AS BIGINT) * {width} + x"))
    near = near.withColumn("_chunk", F.expr(f"pos div {chunk}"))
    inside = near.withColumn("_match", F.lag("pos").over(Window.partitionBy(*same, "_chunk").orderBy("pos")))
    last = near.groupBy(*same, "_chunk").agg(F.max("pos").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*same).orderBy("_chunk"))).drop("_last")
    out = inside.join(before, [*same, "_chunk"]).withColumn("match_pos", F.coalesce("_match", "_before"))
    return out.select(*KEY, "y", "x", "v", "n", "w", "nw", "ne", "pos", "match_pos")


def match_runs(matches: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """Adds to previous_occurrence()'s rows how long each match has lasted: `run` (from 1) and `run_start`; 0 and null
    without a match.

    A run goes on while both the position and the matched position step by one, within a row of the plane: positions minus
    matched positions are equal along it, so runs are islands of (row, difference). A row is all that is ordered at once.
    """
    found = matches.withColumn("_gap", F.col("pos") - F.col("match_pos"))
    island = Window.partitionBy(*KEY, "y", "_gap").orderBy("x")
    found = found.withColumn("_island", F.col("x") - F.row_number().over(island))
    inner = Window.partitionBy(*KEY, "y", "_gap", "_island").orderBy("x")
    run = F.when(F.col("match_pos").isNull(), 0).otherwise(F.row_number().over(inner))
    start = F.when(F.col("match_pos").isNotNull(), F.first("pos").over(inner))
    return found.withColumns({"run": run.cast("int"), "run_start": start}).drop("_gap", "_island")
