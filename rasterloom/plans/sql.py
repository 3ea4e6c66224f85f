"""Oracle SQL: the same rows as the queries of plans.queries, in the SQL of another engine over the same tables."""

from __future__ import annotations

from . import rules as R

CLIP_ROWS, SCENE_FRAMES, SCENE_ROWS, SCENE_COLUMNS = 50, 4, 64, 96
SCENE_VALUE = R.byte("CAST(floor(u * 3 / 2.0) AS INTEGER) + CAST(floor(t / 2.0) AS INTEGER) + CAST(floor(u * t / 128.0) AS INTEGER) + CASE WHEN u + t > 90 THEN 40 ELSE 0 END + CAST(floor((u * 7919 + t * 104729 + u * t * 31) / 16.0) AS INTEGER) % 4")

KEYS = "media_id, frame_no, plane_no"

_Q = "CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 255))) AS INTEGER)"
GRAY = f"SELECT 'gray' AS media_id, 0 AS frame_no, 0 AS plane_no, CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, {_Q} AS v FROM embeddings, range(1, 65) r(i)"
RGB = f"SELECT 'rgb' AS media_id, 0 AS frame_no, CAST((i - 1) % 3 AS INTEGER) AS plane_no, CAST(vec_id AS INTEGER) AS y, CAST((i - 1) // 3 AS INTEGER) AS x, CAST(least(255, greatest(0, floor((coalesce(CAST(embedding[i] AS DOUBLE), 0) + 0.5) * 255))) AS INTEGER) AS v FROM embeddings, range(1, 67) r(i)"
CLIP = f"SELECT 'clip' AS media_id, CAST(vec_id // {CLIP_ROWS} AS INTEGER) AS frame_no, 0 AS plane_no, CAST(vec_id % {CLIP_ROWS} AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, {_Q} AS v FROM embeddings, range(1, 65) r(i)"


def scene(frames: int = SCENE_FRAMES, rows: int = SCENE_ROWS, columns: int = SCENE_COLUMNS) -> str:
    return (
        f"SELECT 'scene' AS media_id, frame_no, 0 AS plane_no, y, x, CAST({SCENE_VALUE} AS INTEGER) AS v FROM ("
        f"SELECT frame_no, y, x, x + 2 * frame_no AS u, y + frame_no AS t FROM (SELECT CAST(id // {rows * columns} AS INTEGER) AS frame_no, CAST(id // {columns} % {rows} AS INTEGER) AS y, CAST(id % {columns} AS INTEGER) AS x FROM range({frames * rows * columns}) q(id)))"
    )


BYTES = "SELECT CAST(doc_id AS VARCHAR) AS media_id, i - 1 AS pos, CAST(('0x' || substr(h, CAST(2 * i - 1 AS INTEGER), 2)) AS INTEGER) AS sym FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL) b, LATERAL (SELECT unnest(range(1, CAST(length(h) // 2 + 1 AS BIGINT))) AS i) u"


def near(source: str) -> str:
    """All neighbours of both rings."""
    col, row = f"PARTITION BY {KEYS}, x ORDER BY y", f"PARTITION BY {KEYS}, y ORDER BY x"
    return (
        f"SELECT *, coalesce(ww_, w) AS ww, coalesce(nn_, n) AS nn, coalesce(nne_, nn_, ne) AS nne FROM ("
        f"SELECT *, coalesce(n_, 0) AS n, coalesce(lag(v) OVER r, 0) AS w, coalesce(lag(n_) OVER r, 0) AS nw, coalesce(lead(n_) OVER r, n_, 0) AS ne, lag(v, 2) OVER r AS ww_, lead(nn_) OVER r AS nne_ FROM ("
        f"SELECT *, lag(v) OVER c AS n_, lag(v, 2) OVER c AS nn_ FROM ({source}) WINDOW c AS ({col})) WINDOW r AS ({row}))"
    )


def med(source: str) -> str:
    """Neighbours with pred, residual and sym."""
    return f"SELECT *, {R.zigzag('residual')} AS sym FROM (SELECT *, {R.centre('v - pred')} AS residual FROM (SELECT *, {R.at_edges(R.med('n', 'w', 'nw'))} AS pred FROM ({near(source)})))"


def entropy(hist: str, keys: str) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}CAST(sum(n) AS BIGINT) AS symbols, count(*) AS distinct_symbols, round(sum(-n * log2(n / total)) / 8, 6) AS entropy_bytes FROM (SELECT *, sum(n) OVER ({by}) AS total FROM ({hist})) {group}"


def hist(source: str, keys: str, sym: str = "sym") -> str:
    return f"SELECT {keys}, {sym} AS sym, count(*) AS n FROM ({source}) GROUP BY ALL"


def predictors(source: str) -> str:
    clip = "greatest(0, least(255, {}))"
    choices = {"average": R.average("n", "w"), "planar": R.planar("n", "w", "nw"), "med": "p_med", "gap": clip.format("p_gap"), "med_gap": clip.format(R.half("p_med + p_gap"))}
    base = f"SELECT *, {R.med('n', 'w', 'nw')} AS p_med, {R.gap()} AS p_gap FROM ({near(source)})"
    return " UNION ALL ".join(f"SELECT {KEYS}, y, x, v, {R.activity()} AS activity, '{k}' AS predictor, {R.at_edges(e)} AS pred FROM ({base})" for k, e in choices.items())


def phases(source: str) -> str:
    col, row = f"PARTITION BY {KEYS}, x ORDER BY y", f"PARTITION BY {KEYS}, y ORDER BY x"
    base = f"SELECT *, coalesce(lead(r_) OVER (PARTITION BY {KEYS}, x ORDER BY y), r_) AS rd_ FROM (SELECT *, coalesce(lead(v) OVER ({row}), v) AS r_, coalesce(lead(v) OVER ({col}), v) AS d_ FROM ({source}))"
    parts = ["v", R.half("v + r_ + 1"), R.half("v + d_ + 1"), R.half("v + r_ + d_ + rd_ + 2", 4)]
    return " UNION ALL ".join(f"SELECT {KEYS}, y, x, {k} AS phase, CAST({e} AS INTEGER) AS v FROM ({base})" for k, e in enumerate(parts))


def displacement_costs(source: str, reach: int, block: int) -> str:
    return (
        f"WITH s AS ({source}), z AS (SELECT media_id AS zm, max(y) AS ym, max(x) AS xm FROM s GROUP BY media_id), d AS (SELECT CAST(a.i AS INTEGER) AS dy, CAST(b.i AS INTEGER) AS dx FROM range({-reach}, {reach + 1}) a(i), range({-reach}, {reach + 1}) b(i))"
        f" SELECT c.media_id, c.frame_no, CAST(c.y // {block} AS INTEGER) AS brow, CAST(c.x // {block} AS INTEGER) AS bcol, d.dy, d.dx, CAST(sum({R.residual_cost('c.v', 'r.v')}) AS BIGINT) AS cost"
        " FROM s c JOIN z ON z.zm = c.media_id CROSS JOIN d JOIN s r ON r.media_id = c.media_id AND r.frame_no = c.frame_no - 1 AND r.y = greatest(0, least(ym, c.y + dy)) AND r.x = greatest(0, least(xm, c.x + dx)) GROUP BY ALL"
    )


def best_displacement(costs: str) -> str:
    return f"SELECT media_id, frame_no, brow, bcol, dy, dx, cost FROM (SELECT *, row_number() OVER (PARTITION BY media_id, frame_no, brow, bcol ORDER BY cost, dy, dx) AS k FROM ({costs})) WHERE k = 1"


def spatial(source: str, block: int) -> str:
    return f"SELECT media_id, frame_no, CAST(y // {block} AS INTEGER) AS brow, CAST(x // {block} AS INTEGER) AS bcol, CAST(sum({R.residual_cost('v', 'pred')}) AS BIGINT) AS spatial FROM ({med(source)}) GROUP BY ALL"


def block_modes(source: str, reach: int, block: int, penalty: int) -> str:
    return f"SELECT media_id, frame_no, brow, bcol, mode, mode * dy AS dy, mode * dx AS dx, cost AS temporal, spatial FROM (SELECT b.*, s.spatial, CASE WHEN cost + CASE WHEN dy <> 0 OR dx <> 0 THEN {penalty} ELSE 0 END < spatial THEN 1 ELSE 0 END AS mode FROM ({best_displacement(displacement_costs(source, reach, block))}) b JOIN ({spatial(source, block)}) s USING (media_id, frame_no, brow, bcol))"
