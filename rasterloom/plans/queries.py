"""Registered queries of the raster engine, each with the SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import samples as S
from rasterloom.operators import adaptive, bitpack, codec, coders, entropy, motion, stencils
from rasterloom.operators.stencils import neighbours
from rasterloom.sources import rasters, shared, y4m
from rasterloom.sources.rasters import KEY, table

from . import rules as R
from . import sql, studies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
REACH, BLOCK, SMALL = 2, 8, (2, 16, 24)  # a small scene for tests: frames, rows, columns
PLANES = "media_id, frame_no, plane_no, y, x, v"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


_COARSE = f"SELECT media_id, frame_no, plane_no, y, x, CAST(v // 64 AS INTEGER) AS v FROM ({sql.GRAY})"


def small_scene(spark: SparkSession) -> DataFrame:
    return rasters.scene(spark, *SMALL)


# ---------------------------------------------------------------- rasters


@query(sql.GRAY)
def gray_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.gray(spark, sf_dir)


@query(sql.RGB)
def rgb_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.rgb(spark, sf_dir)


@query(sql.CLIP)
def clip_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.clip(spark, sf_dir)


@query(sql.scene())
def scene_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.scene(spark)


@query("WITH r AS (SELECT CAST(user_id AS VARCHAR) AS media_id, 0 AS frame_no, 0 AS plane_no, 0 AS y, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS x, CAST(CAST(floor(value) AS BIGINT) & 255 AS INTEGER) AS v FROM events) SELECT * FROM r")
def series_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.series(spark, sf_dir)


@query(f"SELECT {sql.KEYS}, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, CAST(count(*) AS BIGINT) AS n_bytes, CAST(sum(v) AS BIGINT) AS total FROM ({sql.CLIP}) GROUP BY ALL")
def packed_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs samples to planes, unpacks them, and sums what came back."""
    packed = rasters.pack(rasters.clip(spark, sf_dir))
    back = rasters.unpack(packed).groupBy(*KEY).agg(F.sum("v").cast("long").alias("total"))
    return packed.select(*KEY, "width", "height", F.octet_length("data").cast("long").alias("n_bytes")).join(back, KEY)


@query(f"SELECT sym, CAST(count(*) AS BIGINT) AS n FROM ({sql.BYTES}) GROUP BY sym")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.byte_counts(rasters.texts(spark, sf_dir)).groupBy("sym").agg(F.sum("n").alias("n"))


@query(f"SELECT {PLANES} FROM ({sql.CLIP}) WHERE frame_no < 3")
def frame_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.clip(spark, sf_dir).where(F.col("frame_no") < 3)


def _clip_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The clip written as y4m files in the shared folder (a short last frame with rows of 0 below), and its planes."""
    planes = rasters.pack(rasters.clip(spark, sf_dir))
    y4m.save(studies.padded(planes), path := shared.scratch(spark, "clip"))
    return path, planes


@query(sql.CLIP)
def y4m_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip through the y4m sink and source: its samples."""
    path, planes = _clip_files(spark, sf_dir)
    back = spark.read.format("y4m").load(path).drop("height", "colourspace", "rate").join(planes.select(*KEY, "height"), KEY)
    return rasters.unpack(back.select(*KEY, "width", "height", F.expr("substring(data, 1, width * height)").alias("data")))


@query(f"SELECT {sql.KEYS}, CAST(sum(v) AS BIGINT) AS total FROM ({sql.CLIP}) WHERE frame_no < 3 AND frame_no >= 1 GROUP BY ALL")
def y4m_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 1 and 2 of the clip's files: the filter reaches the source, which seeks to them and reads no others."""
    path, _ = _clip_files(spark, sf_dir)
    frames = spark.read.format("y4m").load(path).where("frame_no < 3 AND frame_no >= 1")
    return rasters.unpack(frames).groupBy(*KEY).agg(F.sum("v").cast("long").alias("total"))


@query(f"SELECT 'clip' AS media_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, 'mono' AS colourspace, '25:1' AS rate, CAST(count(DISTINCT frame_no) AS BIGINT) AS frames FROM ({sql.CLIP})")
def y4m_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and lengths of the clip's files, added up over its parts."""
    path, _ = _clip_files(spark, sf_dir)
    found = y4m.headers(spark, path).withColumn("media_id", F.regexp_extract("path", "([^/]*)-[0-9]+[.]y4m$", 1))
    return found.groupBy("media_id", "width", "height", "colourspace", "rate").agg(F.sum("frames").alias("frames"))


# ---------------------------------------------------------------- projections

_RGB_PIXELS = f"SELECT media_id, frame_no, y, x, max(CASE WHEN plane_no = 0 THEN v END) AS r, max(CASE WHEN plane_no = 1 THEN v END) AS g, max(CASE WHEN plane_no = 2 THEN v END) AS b FROM ({sql.RGB}) GROUP BY ALL"


@query(" UNION ALL ".join(f"SELECT media_id, frame_no, {k} AS plane_no, y, x, CAST({e} AS INTEGER) AS v FROM ({_RGB_PIXELS})" for k, e in enumerate(R.rct_planes())))
def rct_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.colour_planes(rasters.rgb(spark, sf_dir))


@query(sql.RGB)
def rct_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.colour_planes(stencils.colour_planes(rasters.rgb(spark, sf_dir)), forward=False)


@query(f"SELECT CAST(v AS INTEGER) AS v, CAST({R.centre('v')} AS INTEGER) AS centred, CAST({R.zigzag('v')} AS INTEGER) AS sym, CAST(v AS INTEGER) AS back FROM range(256) t(v)")
def zigzag_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residual, its symbol, and the residual of that symbol."""
    rows = spark.range(256).selectExpr("CAST(id AS INT) AS v").withColumns({"centred": F.expr(S.centre("v")), "sym": F.expr(S.zigzag("v"))})
    return rows.withColumn("back", F.expr(S.unzigzag("sym"))).select("v", "centred", "sym", "back")


@query(f"SELECT a, b, CAST({R.residual_cost('a', 'b')} AS INTEGER) AS cost FROM (SELECT CAST(i AS INTEGER) AS a, CAST(j * 5 AS INTEGER) AS b FROM range(256) s(i), range(52) t(j))")
def residual_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy cost from a literal table."""
    pairs = spark.range(256 * 52).selectExpr("CAST(id div 52 AS INT) AS a", "CAST(id % 52 * 5 AS INT) AS b")
    costs = F.array(*[F.lit(c) for c in S.COST])
    return pairs.select("a", "b", F.element_at(costs, F.expr(f"abs({S.centre('a - b')}) + 1")).alias("cost"))


# ---------------------------------------------------------------- neighbourhoods


@query(f"SELECT {PLANES}, n, w, nw, ne, ww, nn, nne FROM ({sql.near(sql.GRAY)})")
def causal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(rasters.gray(spark, sf_dir), second_ring=True)


_COLUMN, _ROW = f"PARTITION BY {sql.KEYS}, x ORDER BY y", f"PARTITION BY {sql.KEYS}, y ORDER BY x"
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _shift_sql(dy: int, dx: int, top: str) -> str:
    up = "v" if not dy else f"coalesce(lag(v, {dy}) OVER ({_COLUMN}), {'0' if top == 'zero' else f'first_value(v) OVER ({_COLUMN})'})"
    side = "s_" if not dx else f"coalesce({'lag' if dx > 0 else 'lead'}(s_, {abs(dx)}) OVER ({_ROW}), {'first_value' if dx > 0 else 'last_value'}(s_) OVER ({_ROW} {_WHOLE}))"
    return f"SELECT {PLANES}, CAST({side} AS INTEGER) AS s FROM (SELECT *, {up} AS s_ FROM ({sql.GRAY}))"


@query(_shift_sql(2, -1, "zero"))
def shift_zero_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.shifted(rasters.gray(spark, sf_dir), 2, -1)


@query(_shift_sql(1, 2, "repeat"))
def shift_repeat_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.shifted(rasters.gray(spark, sf_dir), 1, 2, top="repeat")


@query(f"SELECT {PLANES}, pred, residual, sym FROM ({sql.med(sql.GRAY)})")
def med_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.med_residuals(rasters.gray(spark, sf_dir)).select(*KEY, "y", "x", "v", "pred", "residual", "sym")


_BUNDLE = f"SELECT *, {R.activity()} AS activity FROM ({sql.med(sql.GRAY)})"


@query(f"SELECT {sql.KEYS}, y, x, sym, activity, {R.bucket('activity', R.LADDERS[16])} AS bucket, {R.signs()} AS signs FROM ({_BUNDLE})")
def activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.med_bundle(rasters.gray(spark, sf_dir)).select(*KEY, "y", "x", "sym", "activity", "bucket", "signs")


@query(sql.predictors(sql.GRAY).replace("SELECT " + sql.KEYS + ", y, x, v, ", "SELECT " + sql.KEYS + ", y, x, v, "))
def predictor_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.predictors(rasters.gray(spark, sf_dir)).select(*KEY, "y", "x", "v", "activity", "predictor", "pred")


@query(f"SELECT {sql.KEYS}, y, x, round({R.gap_float()}, 6) AS pred, {R.med('n', 'w', 'nw')} AS med FROM ({sql.near(sql.GRAY)}) WHERE y >= 2 AND x >= 2")
def gap_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real-valued gradient-adjusted prediction beside MED, inner samples."""
    near = neighbours(rasters.gray(spark, sf_dir), second_ring=True).where("y >= 2 AND x >= 2")
    return near.select(*KEY, "y", "x", F.round(F.expr(S.gap_float()), 6).alias("pred"), F.expr(S.med("n", "w", "nw")).alias("med"))


@query(sql.phases(sql.CLIP))
def half_sample_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencils.half_sample_planes(rasters.clip(spark, sf_dir))


@query(f"SELECT {sql.KEYS}, y, x, v, lag(CAST(y AS BIGINT) * 64 + x) OVER (PARTITION BY {sql.KEYS}, w, n, nw, ne ORDER BY CAST(y AS BIGINT) * 64 + x) AS match_pos FROM ({sql.near(_COARSE)}) WHERE y > 0 AND x > 0")
def previous_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the same four neighbours stood before, in the gray raster of 4 levels."""
    coarse = rasters.gray(spark, sf_dir).withColumn("v", F.expr("CAST(v div 64 AS INT)"))
    return stencils.previous_occurrence(coarse, 64).select(*KEY, "y", "x", "v", "match_pos")


_MATCHES = f"SELECT {sql.KEYS}, y, x, v, CAST(y AS BIGINT) * 64 + x AS pos, lag(CAST(y AS BIGINT) * 64 + x) OVER (PARTITION BY {sql.KEYS}, w, n, nw, ne ORDER BY CAST(y AS BIGINT) * 64 + x) AS match_pos FROM ({sql.near(_COARSE)}) WHERE y > 0 AND x > 0"


@query(f"SELECT {sql.KEYS}, y, x, match_pos, CAST(CASE WHEN match_pos IS NULL THEN 0 ELSE row_number() OVER i END AS INTEGER) AS run, CASE WHEN match_pos IS NOT NULL THEN first_value(pos) OVER i END AS run_start FROM (SELECT *, x - row_number() OVER (PARTITION BY {sql.KEYS}, y, pos - match_pos ORDER BY x) AS island FROM ({_MATCHES})) WINDOW i AS (PARTITION BY {sql.KEYS}, y, pos - match_pos, island ORDER BY x)")
def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each repeated neighbourhood's match has lasted: islands of equal distance within a row."""
    coarse = rasters.gray(spark, sf_dir).withColumn("v", F.expr("CAST(v div 64 AS INT)"))
    return stencils.match_runs(stencils.previous_occurrence(coarse, 64), 64).select(*KEY, "y", "x", "match_pos", "run", "run_start")


_SHIFTS = {"w": (0, 1), "n": (1, 0), "nw": (1, 1), "ne": (1, -1), "ww": (0, 2), "nn": (2, 0), "nne": (2, -1)}


def _ring_sql() -> str:
    """Each row of the plane as a list; neighbours are read from the lists of the row and the two above by clamped places."""
    lines = f"SELECT {sql.KEYS}, y, list(v ORDER BY x) AS a FROM ({sql.GRAY}) GROUP BY ALL"
    taken = ", ".join(f"r{dy}.a[greatest(1, least(len(r{dy}.a), s.x + 1 - ({dx})))] AS {k}" for k, (dy, dx) in _SHIFTS.items())
    return f"WITH s AS ({sql.GRAY}), r AS ({lines}), u AS (SELECT *, greatest(0, y - 1) AS y1, greatest(0, y - 2) AS y2 FROM s) SELECT s.media_id, s.frame_no, s.plane_no, s.y, s.x, s.v, {taken} FROM u s JOIN r r0 ON r0.y = s.y JOIN r r1 ON r1.y = s.y1 JOIN r r2 ON r2.y = s.y2"


@query(_ring_sql())
def repeated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven neighbours of studies, edges repeated: found by coordinates in the SQL."""
    return stencils.repeated_neighbours(rasters.gray(spark, sf_dir))


# ---------------------------------------------------------------- entropy


def _residual_entropy_sql(source: str) -> str:
    raw, res = sql.entropy(sql.hist(source, sql.KEYS, "v"), sql.KEYS), sql.entropy(sql.hist(sql.med(source), sql.KEYS), sql.KEYS)
    return f"SELECT a.media_id, a.frame_no, a.plane_no, a.symbols, a.entropy_bytes AS raw_bytes, b.entropy_bytes AS residual_bytes FROM ({raw}) a JOIN ({res}) b USING ({sql.KEYS})"


@query(_residual_entropy_sql(sql.GRAY))
def residual_entropy_by_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeroth-order entropy of a plane's samples and of its MED residuals."""
    rows = stencils.med_residuals(rasters.gray(spark, sf_dir))
    raw, res = (entropy.entropy(entropy.histogram(rows, KEY, c), KEY) for c in ("v", "sym"))
    return raw.select(*KEY, "symbols", F.col("entropy_bytes").alias("raw_bytes")).join(res.select(*KEY, F.col("entropy_bytes").alias("residual_bytes")), KEY)


@query(f"SELECT 'plain' AS choice, round(sum(entropy_bytes), 4) AS bytes FROM ({sql.entropy(sql.hist(sql.med(sql.RGB), sql.KEYS), sql.KEYS)}) UNION ALL SELECT 'colour' AS choice, round(sum(entropy_bytes), 4) AS bytes FROM ({sql.entropy(sql.hist(sql.med(ORACLE['rct_forward']), sql.KEYS), sql.KEYS)})")
def rct_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an image's residuals take with and without the colour transform."""
    plain = rasters.rgb(spark, sf_dir)
    parts = []
    for name, rows in (("plain", plain), ("colour", stencils.colour_planes(plain))):
        each = entropy.entropy(entropy.histogram(stencils.med_residuals(rows), KEY), KEY)
        parts.append(each.agg(F.round(F.sum("entropy_bytes"), 4).alias("bytes")).select(F.lit(name).alias("choice"), "bytes"))
    return parts[0].unionAll(parts[1])


_ERR = f"SELECT *, coalesce(lag(abs(residual)) OVER ({_ROW}), 0) + coalesce(lag(abs(residual)) OVER ({_COLUMN}), 0) AS err FROM ({_BUNDLE})"
_CTX = f"{R.bucket('activity', R.CODEC_ACTIVITY)} * 7 + {R.bucket('err', R.CODEC_ERROR)}"


def _conditional_sql(source: str, keys: str) -> str:
    each = sql.entropy(sql.hist(source, f"{keys}, ctx"), f"{keys}, ctx")
    return f"SELECT {keys}, count(*) AS contexts, round(sum(entropy_bytes), 4) AS entropy_bytes FROM ({each}) GROUP BY {keys}"


@query(_conditional_sql(f"SELECT *, {_CTX} AS ctx FROM ({_ERR})", sql.KEYS))
def conditional_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual entropy given activity and the neighbours' residual sizes."""
    rows = stencils.med_bundle(rasters.gray(spark, sf_dir)).withColumn("size", F.abs("residual"))
    return entropy.conditional_entropy(studies.with_error(rows, []), KEY)


def _cross(source: str, keys: str = "") -> str:
    """Rows (keys, plane, y, x, activity, sym) with their contexts beside luma."""
    act = R.bucket("c.activity", R.LADDERS[12])
    also = "".join(f" AND l.{k} = c.{k}" for k in keys.split(", ") if k)
    return f"SELECT c.*, CASE WHEN c.plane_no = 0 THEN {act} ELSE {act} * 6 + {R.bucket('l.sym', R.LUMA)} END AS ctx FROM ({source}) c JOIN (SELECT * FROM ({source}) WHERE plane_no = 0) l ON l.media_id = c.media_id AND l.frame_no = c.frame_no AND l.y = c.y AND l.x = c.x{also}"


def _cross_sql() -> str:
    return _conditional_sql(_cross(f"SELECT *, {R.activity()} AS activity FROM ({sql.med(ORACLE['rct_forward'])})"), sql.KEYS)


@query(_cross_sql())
def cross_channel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals given activity and, for chroma, the luma symbol at the same place."""
    return entropy.conditional_entropy(studies.with_luma(stencils.med_bundle(stencils.colour_planes(rasters.rgb(spark, sf_dir))), []), KEY)


def _cost_sql(source: str, keys: str, domain: dict[str, int]) -> str:
    """source: keys, design, ctx, sym."""
    own = f"{keys}, design, ctx"
    cells = f"SELECT *, sym - coalesce(lag(sym) OVER (PARTITION BY {own} ORDER BY sym), -1) - 1 AS gap FROM ({R.normalised(sql.hist(source, own), own)})"
    each = f"SELECT {own}, sum({R.varint_size('gap')} + {R.varint_size('freq - 1')}) AS tb, count(*) AS used, sum(-n * log2(freq / 4096.0)) AS bits FROM ({cells}) GROUP BY {own}"
    sums = f"SELECT {keys}, design, sum(tb + {R.varint_size('used')}) AS h, sum(bits) AS bits, count(*) AS seen FROM ({each}) GROUP BY {keys}, design"
    sizes = ", ".join(f"('{d}', {n})" for d, n in domain.items())
    return f"SELECT {keys}, s.design, CAST(h + nctx - seen AS BIGINT) AS header_bytes, round(bits / 8, 4) AS payload_bytes, round(h + nctx - seen + bits / 8, 4) AS total_bytes FROM ({sums}) s JOIN (VALUES {sizes}) d(design, nctx) ON d.design = s.design"


_DESIGN_SQL = " UNION ALL ".join(f"SELECT {sql.KEYS}, '{d}' AS design, {e} AS ctx, sym FROM ({_BUNDLE})" for d, (_, e) in R.designs().items())
_DESIGN_SIZES = {d: n for d, (n, _) in R.designs().items()}


@query(_cost_sql(_DESIGN_SQL, sql.KEYS, _DESIGN_SIZES))
def context_design_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and payload of each context design."""
    return studies.context_designs(rasters.gray(spark, sf_dir))


@query(f"SELECT {sql.KEYS}, design, total_bytes FROM (SELECT *, row_number() OVER (PARTITION BY {sql.KEYS} ORDER BY total_bytes, design) AS k FROM ({ORACLE['context_design_cost']})) WHERE k = 1")
def best_context_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.best_design(studies.context_designs(rasters.gray(spark, sf_dir)))


_PREDICTED = f"SELECT *, {R.zigzag('v - pred')} AS sym FROM ({sql.predictors(ORACLE['rct_forward'])})"
_PREDICTOR_SQL = f"SELECT {sql.KEYS}, predictor AS design, {R.bucket('activity', R.LADDERS[12])} AS ctx, sym FROM ({_PREDICTED})"
_CROSS_SQL = f"SELECT {sql.KEYS}, predictor || '_cross/' || CASE WHEN plane_no = 0 THEN 'luma' ELSE 'chroma' END AS design, ctx, sym FROM ({_cross(_PREDICTED, 'predictor')}) WHERE predictor IN ('med', 'gap')"
_CROSS_SIZES = {f"{p}_cross/{k}": n for p in ("med", "gap") for k, n in (("luma", 12), ("chroma", 72))}


@query(f"{_cost_sql(_PREDICTOR_SQL, sql.KEYS, {p: 12 for p in ('average', 'planar', 'med', 'gap', 'med_gap')})} UNION ALL SELECT {sql.KEYS}, split_part(design, '/', 1) AS design, header_bytes, payload_bytes, total_bytes FROM ({_cost_sql(_CROSS_SQL, sql.KEYS, _CROSS_SIZES)})")
def predictor_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each predictor's residuals take under twelve activity contexts, and beside luma."""
    return studies.predictor_costs(stencils.colour_planes(rasters.rgb(spark, sf_dir)))


@query()
def headroom_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MED, real-valued GAP and the least-squares linear predictor of each plane, and their conditional entropy."""
    return studies.headroom(rasters.gray(spark, sf_dir))


@query()
def headroom_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal bytes of four predictors beside what the adaptive codec emits."""
    return studies.headroom_gap(rasters.rgb(spark, sf_dir))


@query()
def least_squares_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the least-squares predictor, from sums of products that Spark adds up."""
    return studies.least_squares(rasters.gray(spark, sf_dir))


_FLAGS = f"SELECT {R.bucket('activity', R.LADDERS[16])} AS ctx, CAST(y AS BIGINT) * 64 + x AS pos, CASE WHEN sym = 0 THEN 0 ELSE 1 END AS bit FROM ({_BUNDLE})"
_SURE = "greatest(32, least(65504, p))"
_LEARNED_SQL = f"""
WITH RECURSIVE d AS (SELECT ctx, bit, row_number() OVER (PARTITION BY ctx ORDER BY pos) AS k FROM ({_FLAGS})),
r AS (
  SELECT DISTINCT ctx, CAST(0 AS BIGINT) AS k, CAST(32768 AS BIGINT) AS p, CAST(0 AS DOUBLE) AS bits FROM d
  UNION ALL
  SELECT r.ctx, d.k, CASE WHEN bit = 1 THEN p + ((65535 - p) >> 5) ELSE p - (p >> 5) END, bits - log2(CASE WHEN bit = 1 THEN {_SURE} ELSE 65536 - {_SURE} END / 65536.0) FROM r JOIN d ON d.ctx = r.ctx AND d.k = r.k + 1
)
SELECT CAST(ctx AS INTEGER) AS ctx, k AS n, CAST(p AS INTEGER) AS p, round(bits, 4) AS bits FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY k DESC) AS last FROM r) WHERE last = 1
"""


@query(_LEARNED_SQL)
def adaptive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sixteen activity contexts have learned of their residuals' zero flags, and the bits these take."""
    rows = stencils.med_bundle(rasters.gray(spark, sf_dir)).selectExpr("bucket AS ctx", "CAST(y AS BIGINT) * 64 + x AS pos", "IF(sym = 0, 0, 1) AS bit")
    return adaptive.learned(rows, ["ctx"]).select("ctx", "n", "p", F.round("bits", 4).alias("bits"))


# ---------------------------------------------------------------- tables and static coders

_BYTE_HIST = sql.hist(sql.BYTES, "media_id")


@query(f"SELECT media_id, sym, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (PARTITION BY media_id ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_BYTE_HIST})")
def cumulative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.cumulative(rasters.byte_counts(rasters.texts(spark, sf_dir)), ["media_id"])


_BYTE_FREQ = R.normalised(_BYTE_HIST, "media_id")


@query(f"SELECT media_id, sym, CAST(freq AS BIGINT) AS slots, CAST(sum(freq) OVER (PARTITION BY media_id ORDER BY sym) - freq AS BIGINT) AS first_slot, CAST(sum(freq) OVER (PARTITION BY media_id ORDER BY sym) - 1 AS BIGINT) AS last_slot FROM ({_BYTE_FREQ})")
def slot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder's table of 4096 slots, as the slots that each symbol has."""
    freq = entropy.normalised(rasters.byte_counts(rasters.texts(spark, sf_dir)), ["media_id"])
    slots = entropy.slot_lists(freq, ["media_id"])  # a symbol's slots stand in one row: no aggregation over 4096 rows a text
    return slots.select("media_id", "sym", F.size("slots").cast("long").alias("slots"), F.array_min("slots").cast("long").alias("first_slot"), F.array_max("slots").cast("long").alias("last_slot"))


@query(f"SELECT media_id, count(*) AS used, CAST(sum({R.varint_size('gap')} + {R.varint_size('freq - 1')}) + {R.varint_size('count(*)')} AS BIGINT) AS table_bytes FROM (SELECT *, sym - coalesce(lag(sym) OVER (PARTITION BY media_id ORDER BY sym), -1) - 1 AS gap FROM ({_BYTE_FREQ})) GROUP BY media_id")
def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.table_size(rasters.byte_counts(rasters.texts(spark, sf_dir)), ["media_id"])


@query(f"SELECT media_id, sym, CAST(freq AS BIGINT) AS freq FROM ({_BYTE_FREQ})")
def normalised_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency tables scaled to 4096, as the coders make them."""
    return studies.normalised(rasters.byte_counts(rasters.texts(spark, sf_dir)), "media_id")


@query()
def static_coder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huffman and rANS sizes of each text: coded, and estimated from the histogram."""
    return studies.coder_sizes(rasters.texts(spark, sf_dir)).withColumn("rans_estimate", F.round("rans_estimate", 3))


@query(f"SELECT media_id, round(sum(-n * log2(freq / 4096.0)) / 8, 2) AS estimate, CAST(sum(n) AS BIGINT) AS symbols FROM ({_BYTE_FREQ}) GROUP BY media_id")
def static_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the static coder's estimate says of each text."""
    sizes = studies.coder_estimates(rasters.texts(spark, sf_dir).where("octet_length(data) > 0"))
    return sizes.select("media_id", F.round("rans_estimate", 2).alias("estimate"), "symbols")


@query(f"SELECT media_id, CAST(count(*) AS BIGINT) AS used, true AS complete FROM ({_BYTE_HIST}) GROUP BY media_id HAVING count(*) > 1")
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes by a window over code lengths: whether they fill the code space exactly and none repeats."""
    lengths = studies.huffman_lengths(rasters.byte_counts(rasters.texts(spark, sf_dir)), "media_id")
    codes = entropy.canonical_codes(lengths, ["media_id"])
    full = codes.groupBy("media_id").agg(F.count("*").alias("used"), F.sum(F.expr("shiftleft(1L, 15 - len)")).alias("filled"), F.countDistinct(F.expr("shiftleft(code, 15 - len)")).alias("apart"))
    return full.where("used > 1").select("media_id", "used", ((F.col("filled") == 1 << 15) & (F.col("apart") == F.col("used"))).alias("complete"))


#: Digests of what was decoded, and whether the coded bytes lie between the entropy and the escape from it.
_DECODED = f"SELECT CAST(doc_id AS VARCHAR) AS media_id, CAST(strlen(text) AS BIGINT) AS symbols, md5(text) AS digest, true AS in_bounds FROM documents WHERE text IS NOT NULL"


def _decoded(spark: SparkSession, sf_dir: str, coder: str) -> DataFrame:
    texts = rasters.texts(spark, sf_dir)
    least = entropy.entropy(rasters.byte_counts(rasters.texts(spark, sf_dir)), ["media_id"]).select("media_id", "entropy_bytes")
    back = studies.roundtrip(texts, coder).join(least, "media_id", "left")
    # A coder with one table can't take less than the entropy; an adaptive one can where a text changes.
    least_bytes = F.coalesce("entropy_bytes", F.lit(0.0)) - 1 if coder != "bits" else F.lit(0)
    bounds = (F.col("n_bytes") >= least_bytes) & (F.col("n_bytes") <= F.coalesce(F.col("entropy_bytes") * 1.1, F.lit(0.0)) + 1024)
    return back.select("media_id", F.octet_length("data").cast("long").alias("symbols"), F.md5("data").alias("digest"), bounds.alias("in_bounds"))


@query(_DECODED)
def huffman_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text through Huffman coding and back."""
    return _decoded(spark, sf_dir, "huffman")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS media_id, CAST(strlen(text) AS BIGINT) AS symbols, md5(text) AS digest, true AS in_bounds FROM documents WHERE strlen(text) > 0")
def huffman_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's Huffman bits by stretches, placed by prefix sums and put together by bit_or, then decoded by the coder."""
    data = rasters.texts(spark, sf_dir)
    lengths = studies.kept(studies.huffman_lengths(rasters.byte_counts(data), "media_id"), "lengths")
    body = bitpack.stretch_packed(data, entropy.canonical_codes(lengths, ["media_id"]), "media_id")
    packed = bitpack.length_table(lengths, ["media_id"]).join(body, "media_id").select("media_id", F.concat("head", "data").alias("data"))
    sizes = data.select("media_id", F.octet_length("data").cast("long").alias("symbols"))
    bits = entropy.coded_bits(rasters.byte_counts(data), lengths, ["media_id"])
    back = studies.huffman_decoded(packed.join(sizes, "media_id")).join(bits, "media_id")
    return back.select("media_id", "symbols", F.md5("data").alias("digest"), (F.col("n_bytes") == 128 + F.expr("(bits + 7) div 8")).alias("in_bounds"))


@query(_DECODED)
def rans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "rans")


@query(_DECODED)
def range_coder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the adaptive binary range coder, each byte as a tree of eight decisions."""
    return _decoded(spark, sf_dir, "bits")


# ---------------------------------------------------------------- the adaptive codec


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.pack(rasters.rgb(spark, sf_dir).unionAll(rasters.gray(spark, sf_dir)))


@query(f"{sql.RGB} UNION ALL {sql.GRAY}")
def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images through the adaptive codec and back: the decoded samples."""
    return rasters.unpack(codec.decode_bands(codec.encode_media(_packed(spark, sf_dir)).select("media_id", "payload")))


@query(f"{sql.CLIP} UNION ALL {sql.scene()}")
def clip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips through motion search, the adaptive codec and back: the decoded samples.

    A stream's frames have one size: a short last frame is coded with rows of 0 below, which are cut off again.
    """
    planes = rasters.pack(rasters.clip(spark, sf_dir).unionAll(rasters.scene(spark)))
    back = codec.decode_media(codec.encode_media(studies.padded(planes))).drop("height").join(planes.select(*KEY, "height"), KEY)
    return rasters.unpack(back.withColumn("data", F.expr("substring(data, 1, width * height)")))


@query(f"SELECT media_id, 'image' AS kind, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, CAST(count(DISTINCT plane_no) AS INTEGER) AS planes, 1 AS frames, CAST(count(*) AS BIGINT) AS samples FROM ({sql.RGB} UNION ALL {sql.GRAY}) GROUP BY media_id")
def stream_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streams' headers say, without decoding."""
    return codec.stream_info(codec.encode_media(_packed(spark, sf_dir))).select("media_id", "kind", "width", "height", "planes", "frames", "samples")


@query()
def bit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the encoder: nonzero residuals, plain bits, bits of magnitudes."""
    streams = codec.encode_media(rasters.pack(rasters.rgb(spark, sf_dir)))
    return streams.select("media_id", "n_bytes", "raw_bytes", "nonzero", "plain_bits", "length_bits")


@query("SELECT 'rgb' AS media_id, true AS lossless, 0 AS max_error")
def verify_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded against original samples: nothing missing on either side, and the largest difference."""
    first = rasters.rgb(spark, sf_dir)
    return studies.verified(first, rasters.unpack(codec.decode_bands(codec.encode_media(rasters.pack(first)))))


@query()
def compression_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rungs from raw samples to the adaptive codec, with what each saves against the one before."""
    return studies.ladder(rasters.rgb(spark, sf_dir))


@query()
def codec_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and times of every codec on every raster, verified."""
    return studies.comparison(rasters.pack(rasters.rgb(spark, sf_dir).unionAll(rasters.scene(spark, 1))))


@query()
def codec_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each codec over verified results only, smallest first."""
    return studies.rollup(codec_comparison(spark, sf_dir)).drop("cpu_s")


@query(f"SELECT media_id, codec, CAST(count(DISTINCT frame_no) AS BIGINT) AS frames, CAST(count(*) AS BIGINT) AS raw_bytes, true AS lossless, true AS in_bounds FROM ({sql.CLIP}) CROSS JOIN (VALUES ('deflate'), ('frames'), ('difference'), ('motion')) c(codec) GROUP BY ALL")
def clip_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip codec on the clip: lossless by a full outer join of frames, and within an eighth of the raw samples (the raster is nearly noise)."""
    found = studies.clip_comparison(rasters.pack(rasters.clip(spark, sf_dir)))
    return found.select("media_id", "codec", "frames", "raw_bytes", "lossless", (F.col("n_bytes") < F.col("raw_bytes") * 1.125).alias("in_bounds"))


@query()
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen settings of the adaptive model over every band of the images, the five smallest by real bytes."""
    return studies.sweep(rasters.pack(rasters.rgb(spark, sf_dir)))


@query()
def quick_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings of the adaptive model on the images, by the cost of their decisions alone."""
    return studies.quick(rasters.pack(rasters.rgb(spark, sf_dir)), (10, 16, "e6"), (12, 12, "e3"))


@query()
def motion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of block sizes and move penalties, the five best by motion cost."""
    return studies.motion_sweep(rasters.pack(rasters.clip(spark, sf_dir)))


# ---------------------------------------------------------------- motion

_SMALL = sql.CLIP


@query(f"SELECT media_id, frame_no, CAST(y // {BLOCK} AS INTEGER) AS brow, CAST(x // {BLOCK} AS INTEGER) AS bcol, CAST(sum(v) AS BIGINT) AS total FROM ({sql.CLIP}) GROUP BY ALL")
def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.clip(spark, sf_dir).groupBy("media_id", "frame_no", F.expr(f"CAST(y div {BLOCK} AS INT)").alias("brow"), F.expr(f"CAST(x div {BLOCK} AS INT)").alias("bcol")).agg(F.sum("v").cast("long").alias("total"))


@query(sql.displacement_costs(_SMALL, REACH, BLOCK))
def displacement_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.displacement_costs(rasters.clip(spark, sf_dir), REACH, BLOCK)


@query(sql.best_displacement(sql.displacement_costs(_SMALL, REACH, BLOCK)))
def best_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.best_displacement(motion.displacement_costs(rasters.clip(spark, sf_dir), REACH, BLOCK))


@query(sql.spatial(_SMALL, BLOCK))
def spatial_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.spatial_costs(stencils.med_residuals(rasters.clip(spark, sf_dir)), BLOCK)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = rasters.clip(spark, sf_dir)
    return motion.block_modes(motion.best_displacement(motion.displacement_costs(small, REACH, BLOCK)), motion.spatial_costs(stencils.med_residuals(small), BLOCK))


_MODES = sql.block_modes(_SMALL, REACH, BLOCK, motion.MOVE_PENALTY)


@query(_MODES)
def block_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modes(spark, sf_dir)


def _vectors_sql() -> str:
    out = f"SELECT * FROM ({_MODES})"
    near = f"SELECT *, lag(dy) OVER c AS udy, lag(dx) OVER c AS udx FROM ({out}) WINDOW c AS (PARTITION BY media_id, frame_no, bcol ORDER BY brow)"
    all_ = f"SELECT *, {', '.join(f'coalesce(lag({v}) OVER r, 0) AS l{v}, CASE WHEN lead(bcol) OVER r IS NULL THEN coalesce(lag(u{v}) OVER r, 0) ELSE lead(u{v}) OVER r END AS c{v}' for v in ('dy', 'dx'))} FROM ({near}) WINDOW r AS (PARTITION BY media_id, frame_no, brow ORDER BY bcol)"
    median = ", ".join(f"CASE WHEN brow = 0 THEN l{v} ELSE l{v} + u{v} + c{v} - greatest(l{v}, u{v}, c{v}) - least(l{v}, u{v}, c{v}) END AS p{v}" for v in ("dy", "dx"))
    return f"SELECT media_id, frame_no, brow, bcol, mode, dy, dx, temporal, spatial, {median} FROM ({all_})"


@query(_vectors_sql())
def vector_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.vector_predictions(_modes(spark, sf_dir))


@query(f"WITH s AS ({_SMALL}), z AS (SELECT max(y) AS ym, max(x) AS xm FROM s), b AS ({_MODES}), p AS ({sql.phases(_SMALL)}) SELECT s.media_id, s.frame_no, s.plane_no, s.y, s.x, s.v, p.v AS moved FROM s CROSS JOIN z JOIN b ON b.frame_no = s.frame_no AND b.brow = s.y // {BLOCK} AND b.bcol = s.x // {BLOCK} JOIN p ON p.frame_no = s.frame_no - 1 AND p.phase = 2 * (dy & 1) + (dx & 1) AND p.y = greatest(0, least(ym, s.y + (dy >> 1))) AND p.x = greatest(0, least(xm, s.x + (dx >> 1)))")
def moved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample with the one its block's vector (taken in half samples) points at."""
    return motion.moved_samples(rasters.clip(spark, sf_dir), _modes(spark, sf_dir), BLOCK)


@query()
def motion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production search, one task per frame pair: mode, vector and costs of each block."""
    return studies.searched(rasters.pack(rasters.clip(spark, sf_dir)))


# ---------------------------------------------------------------- harness

_SPLIT = "SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'dev' ELSE 'held_out' END AS split FROM documents d"


@query(_SPLIT)
def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are the development set (semi join), the others held out (anti join)."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(labels, "doc_id", "left_semi").withColumn("split", F.lit("dev")).unionAll(docs.join(labels, "doc_id", "left_anti").withColumn("split", F.lit("held_out")))


@query(f"SELECT split, count(*) AS texts, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, CAST(sum(ceil(strlen(text) / 4.0)) AS BIGINT) AS quarter FROM documents JOIN ({_SPLIT}) USING (doc_id) GROUP BY split")
def split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sizes by split."""
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return sized.join(corpus_split(spark, sf_dir), "doc_id").groupBy("split").agg(F.count("*").alias("texts"), F.sum("n").cast("long").alias("raw_bytes"), F.sum(F.ceil(F.col("n") / 4)).cast("long").alias("quarter"))


@query("SELECT page_id, CASE WHEN ext IN ('png', 'ppm', 'pgm') THEN 'image' WHEN ext IN ('y4m', 'mp4', 'mkv') THEN 'clip' WHEN ext = '' THEN 'none' ELSE 'other' END AS kind FROM (SELECT page_id, lower(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1)) AS ext FROM pages)")
def kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", studies.kind_of(F.col("url")).alias("kind"))


@query("SELECT n, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat(CAST(round(n / 1024.0, 1) AS DECIMAL(12,1)), ' KB') ELSE concat(CAST(round(n / 1048576.0, 1) AS DECIMAL(12,1)), ' MB') END AS text, round(n / 500000.0, 3) AS seconds FROM (SELECT DISTINCT n_chars * 37 AS n FROM documents)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for people, and the seconds that so many samples may take at half a million a second."""
    sizes = table(spark, sf_dir, "documents").selectExpr("n_chars * 37 AS n").distinct()
    return sizes.select("n", F.expr(S.human("n")).alias("text"), F.round(F.col("n") / 500000.0, 3).cast("double").alias("seconds"))


@query("SELECT CAST(b AS INTEGER) AS block, CAST(p AS INTEGER) AS penalty FROM (VALUES (8), (16), (32)) x(b), (VALUES (0), (48), (96)) y(p)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.grid(spark)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_entropy_by_plane(spark, sf_dir)
