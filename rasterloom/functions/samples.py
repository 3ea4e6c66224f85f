"""Sample arithmetic as SQL expressions: 8-bit modular values, residual maps, predictors, context buckets.

Functions take and return SQL text, so that expressions nest, stay in whole-stage code generation and read the same
in a DataFrame (F.expr) and in a SQL string. Samples are ints of 0 to 255; `>>` is the arithmetic shift, which floors.
"""

from __future__ import annotations

import math

# ---- fixed values: bucket edges of the context ladders (a value's bucket is the number of edges not above it)
ACTIVITY_LADDERS = {
    4: (1, 4, 12),
    6: (1, 3, 6, 12, 24),
    8: (1, 2, 4, 7, 12, 20, 36),
    12: (1, 2, 3, 4, 6, 9, 13, 20, 30, 46, 72),
    16: (1, 2, 3, 4, 5, 7, 9, 12, 16, 22, 30, 42, 58, 80, 112),
    24: (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24, 29, 35, 42, 51, 62, 76, 94, 118, 150),
    32: (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 21, 24, 28, 32, 37, 43, 50, 58, 68, 80, 94, 110, 130, 154, 182, 215, 255),
}
#: The ladders among which a plane's coder chooses.
CODER_LADDERS = (4, 6, 8, 12, 16)
#: Activity and residual sizes in the adaptive codec's contexts, and the luma symbol beside a chroma sample.
CODEC_ACTIVITY = (1, 2, 3, 4, 6, 8, 11, 15, 20, 27, 36, 48, 64, 88, 120)
CODEC_ERROR = (1, 2, 4, 7, 12, 20)
LUMA = (1, 3, 6, 12, 24)
# ---- end of fixed values

#: Proxy of a residual's cost: 8 log2(1 + d), rounded half to even, d = 0 to 128.
COST = tuple(round(8 * math.log2(1 + d)) for d in range(129))


def wrap(x: str) -> str:
    """x mod 256."""
    return f"(({x}) & 255)"


def centre(x: str) -> str:
    """A modular value as a signed one, -128 to 127."""
    return f"(((({x}) + 128) & 255) - 128)"


def zigzag(residual: str) -> str:
    """Signed residuals to symbols: 0, -1, 1, -2, 2, ... become 0, 1, 2, 3, 4, ..."""
    d = centre(residual)
    return f"(CASE WHEN {d} >= 0 THEN 2 * {d} ELSE -2 * {d} - 1 END)"


def unzigzag(symbol: str) -> str:
    """The modular residual of a symbol."""
    return f"(CASE WHEN ({symbol}) & 1 = 0 THEN ({symbol}) >> 1 ELSE (-((({symbol}) + 1) >> 1)) & 255 END)"


def med(n: str, w: str, nw: str) -> str:
    """The median edge detector: the smaller or larger neighbour at an edge, else the plane through the three."""
    return f"(CASE WHEN {nw} >= greatest({n}, {w}) THEN least({n}, {w}) WHEN {nw} <= least({n}, {w}) THEN greatest({n}, {w}) ELSE {n} + {w} - {nw} END)"


def at_edges(inner: str, n: str = "n", w: str = "w") -> str:
    """inner where both neighbours exist; the one that does on the first row or column; 128 at the corner."""
    return f"(CASE WHEN y = 0 AND x = 0 THEN 128 WHEN x = 0 THEN {n} WHEN y = 0 THEN {w} ELSE {inner} END)"


def average(n: str, w: str) -> str:
    return f"(({n} + {w}) >> 1)"


def planar(n: str, w: str, nw: str) -> str:
    return f"greatest(0, least(255, {n} + {w} - {nw}))"


def gap(w: str = "w", n: str = "n", nw: str = "nw", ne: str = "ne", ww: str = "ww", nn: str = "nn", nne: str = "nne") -> str:
    """Gradient-adjusted prediction: leans to the side along which the picture changes less. Integer, floored, unclipped."""
    dh = f"(abs({w} - {ww}) + abs({n} - {nw}) + abs({n} - {ne}))"
    dv = f"(abs({w} - {nw}) + abs({n} - {nn}) + abs({ne} - {nne}))"
    base = f"((({w} + {n}) >> 1) + (({ne} - {nw}) >> 2))"
    d = f"({dv} - {dh})"
    return (
        f"(CASE WHEN {d} > 80 THEN {w} WHEN {d} < -80 THEN {n}"
        f" WHEN {d} > 32 THEN ({base} + {w}) >> 1 WHEN {d} < -32 THEN ({base} + {n}) >> 1"
        f" WHEN {d} > 8 THEN (3 * {base} + {w}) >> 2 WHEN {d} < -8 THEN (3 * {base} + {n}) >> 2 ELSE {base} END)"
    )


def gap_float(w: str = "w", n: str = "n", nw: str = "nw", ne: str = "ne", ww: str = "ww", nn: str = "nn", nne: str = "nne") -> str:
    """The same rule in real numbers, as studies use it."""
    dh = f"(abs({w} - {ww}) + abs({n} - {nw}) + abs({n} - {ne}))"
    dv = f"(abs({w} - {nw}) + abs({n} - {nn}) + abs({ne} - {nne}))"
    base = f"(({w} + {n}) / CAST(2 AS DOUBLE) + ({ne} - {nw}) / CAST(4 AS DOUBLE))"
    d = f"({dv} - {dh})"
    return (
        f"(CASE WHEN {d} > 80 THEN CAST({w} AS DOUBLE) WHEN {d} < -80 THEN CAST({n} AS DOUBLE)"
        f" WHEN {d} > 32 THEN ({base} + {w}) / 2 WHEN {d} < -32 THEN ({base} + {n}) / 2"
        f" WHEN {d} > 8 THEN (3 * {base} + {w}) / 4 WHEN {d} < -8 THEN (3 * {base} + {n}) / 4 ELSE {base} END)"
    )


def activity(n: str = "n", w: str = "w", nw: str = "nw", ne: str = "ne") -> str:
    """How much the causal neighbours differ; 0 on the first row and column."""
    return f"(CASE WHEN y = 0 OR x = 0 THEN 0 ELSE {spread(n, w, nw, ne)} END)"


def spread(n: str = "n", w: str = "w", nw: str = "nw", ne: str = "ne") -> str:
    """The sizes of the three modular differences around the causal neighbours, added up."""
    return " + ".join(f"abs({d})" for d in differences(n, w, nw, ne))


def bucket(x: str, edges: tuple[int, ...]) -> str:
    """The number of edges that x reaches."""
    return "(" + " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in edges) + ")"


def sign(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1 ELSE 0 END)"


def differences(n: str = "n", w: str = "w", nw: str = "nw", ne: str = "ne") -> tuple[str, str, str]:
    """The three modular differences around the causal neighbours."""
    return centre(f"{w} - {nw}"), centre(f"{nw} - {n}"), centre(f"{n} - {ne}")


def sign_pattern() -> str:
    """The signs of the first two differences as 0 to 8; the middle on the first row and column."""
    a, b, _ = differences()
    return f"(CASE WHEN y = 0 OR x = 0 THEN 4 ELSE 3 * ({sign(a)} + 1) + {sign(b)} + 1 END)"


def gradient_level(d: str) -> str:
    """A gradient as -4 to 4: levels begin at 1, 3, 8 and 22."""
    return f"({sign(d)} * {bucket(f'abs({d})', (1, 3, 8, 22))})"


def gradient_triple() -> str:
    """Three gradient levels as 0 to 364, folded by sign; 0 on the first row and column."""
    a, b, c = (gradient_level(d) for d in differences())
    return f"(CASE WHEN y = 0 OR x = 0 THEN 0 ELSE abs(81 * {a} + 9 * {b} + {c}) END)"


def residual_cost(a: str, b: str) -> str:
    """The proxy cost of the modular difference of two samples: 8 log2(1 + |d|) by thresholds of its rounding."""
    d = f"abs({centre(f'({a}) - ({b})')})"
    steps = [(k, COST[k] - COST[k - 1]) for k in range(1, 129) if COST[k] != COST[k - 1]]
    return "(" + " + ".join(f"CASE WHEN {d} >= {k} THEN {s} ELSE 0 END" for k, s in steps) + ")"


def bit_length(x: str) -> str:
    """The bits of a value of 0 to 255."""
    return bucket(x, tuple(1 << k for k in range(8)))


def varint_size(x: str) -> str:
    """Bytes of a LEB128 varint."""
    return "(1 + " + " + ".join(f"CASE WHEN {x} >= {1 << 7 * k} THEN 1 ELSE 0 END" for k in range(1, 6)) + ")"


def rct_planes(r: str = "r", g: str = "g", b: str = "b") -> tuple[str, str, str]:
    """The reversible colour transform: luma, and chroma with its zero at 128."""
    cb, cr = centre(f"{b} - {g}"), centre(f"{r} - {g}")
    return wrap(f"{g} + (({cb} + {cr}) >> 2)"), wrap(f"{b} - {g} + 128"), wrap(f"{r} - {g} + 128")


def rct_colours(y: str = "p0", cb: str = "p1", cr: str = "p2") -> tuple[str, str, str]:
    """Red, green and blue again."""
    b, r = centre(f"{cb} - 128"), centre(f"{cr} - 128")
    g = wrap(f"{y} - (({b} + {r}) >> 2)")
    return wrap(f"{g} + {r}"), g, wrap(f"{g} + {b}")


def human(n: str) -> str:
    """A byte count for people."""
    return f"(CASE WHEN {n} < 1024 THEN concat(CAST({n} AS STRING), ' B') WHEN {n} < 1048576 THEN concat(CAST(CAST(round({n} / 1024.0, 1) AS DECIMAL(12,1)) AS STRING), ' KB') ELSE concat(CAST(CAST(round({n} / 1048576.0, 1) AS DECIMAL(12,1)) AS STRING), ' MB') END)"
