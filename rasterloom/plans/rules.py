"""Sample rules for the oracle SQL, written by hand in the other engine's functions: nothing here comes from the engine.

Each function gives SQL text; names are those of the rules in functions.samples.
"""

from __future__ import annotations

# ---- fixed values: bucket edges of the context ladders, and of the codec's own contexts
LADDERS = {
    4: [1, 4, 12],
    6: [1, 3, 6, 12, 24],
    8: [1, 2, 4, 7, 12, 20, 36],
    12: [1, 2, 3, 4, 6, 9, 13, 20, 30, 46, 72],
    16: [1, 2, 3, 4, 5, 7, 9, 12, 16, 22, 30, 42, 58, 80, 112],
    24: [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24, 29, 35, 42, 51, 62, 76, 94, 118, 150],
    32: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 21, 24, 28, 32, 37, 43, 50, 58, 68, 80, 94, 110, 130, 154, 182, 215, 255],
}
CODEC_ACTIVITY = [1, 2, 3, 4, 6, 8, 11, 15, 20, 27, 36, 48, 64, 88, 120]
CODEC_ERROR = [1, 2, 4, 7, 12, 20]
LUMA = [1, 3, 6, 12, 24]
# ---- end of fixed values


def byte(x: str) -> str:
    return f"((({x}) % 256 + 256) % 256)"


def centre(x: str) -> str:
    return f"({byte(f'({x}) + 128')} - 128)"


def zigzag(x: str) -> str:
    return f"CAST(abs(2 * {centre(x)} + 0.5) - 0.5 AS INTEGER)"


def med(n: str, w: str, nw: str) -> str:
    """The middle of both neighbours and the plane through the three."""
    return f"list_sort([{n}, {w}, {n} + {w} - {nw}])[2]"


def at_edges(inner: str, n: str = "n", w: str = "w") -> str:
    return f"CASE WHEN x > 0 AND y > 0 THEN {inner} WHEN y > 0 THEN {n} WHEN x > 0 THEN {w} ELSE 128 END"


def half(x: str, k: int = 2) -> str:
    """Division by k, rounded down."""
    return f"CAST(floor(({x}) / {k}.0) AS INTEGER)"


def average(n: str, w: str) -> str:
    return half(f"{n} + {w}")


def planar(n: str, w: str, nw: str) -> str:
    return f"list_sort([0, {n} + {w} - {nw}, 255])[2]"


_DV_DH = "abs(w - nw) + abs(n - nn) + abs(ne - nne) - abs(w - ww) - abs(n - nw) - abs(n - ne)"


def gap() -> str:
    base = f"({half('w + n')} + {half('ne - nw', 4)})"
    d = f"({_DV_DH})"
    steps = [(f"{d} > 80", "w"), (f"{d} > 32", half(f"{base} + w")), (f"{d} > 8", half(f"3 * {base} + w", 4)), (f"{d} >= -8", base), (f"{d} >= -32", half(f"3 * {base} + n", 4)), (f"{d} >= -80", half(f"{base} + n"))]
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + " ELSE n END)"


def gap_float() -> str:
    base, d = "((w + n) / 2.0::DOUBLE + (ne - nw) / 4.0::DOUBLE)", f"({_DV_DH})"
    steps = [(f"{d} > 80", "w::DOUBLE"), (f"{d} > 32", f"({base} + w) / 2"), (f"{d} > 8", f"(3 * {base} + w) / 4"), (f"{d} >= -8", base), (f"{d} >= -32", f"(3 * {base} + n) / 4"), (f"{d} >= -80", f"({base} + n) / 2")]
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + " ELSE n::DOUBLE END)"


D1, D2, D3 = centre("w - nw"), centre("nw - n"), centre("n - ne")


def activity() -> str:
    return f"CASE WHEN x > 0 AND y > 0 THEN abs({D1}) + abs({D2}) + abs({D3}) ELSE 0 END"


def bucket(x: str, edges: list[int]) -> str:
    return f"CAST(len(list_filter({list(edges)}, lambda e: e <= {x})) AS INTEGER)"


def signs() -> str:
    """The signs of the first two differences; the middle at the edges."""
    return f"CASE WHEN x > 0 AND y > 0 THEN CAST(3 * sign({D1}) + sign({D2}) + 4 AS INTEGER) ELSE 4 END"


def gradient(d: str) -> str:
    """0; to 2; to 7; to 21; above: with the gradient's sign."""
    return f"CAST(sign({d}) * CASE WHEN abs({d}) = 0 THEN 0 WHEN abs({d}) <= 2 THEN 1 WHEN abs({d}) <= 7 THEN 2 WHEN abs({d}) <= 21 THEN 3 ELSE 4 END AS INTEGER)"


def folded() -> str:
    return f"CASE WHEN x > 0 AND y > 0 THEN abs(81 * {gradient(D1)} + 9 * {gradient(D2)} + {gradient(D3)}) ELSE 0 END"


def residual_cost(a: str, b: str) -> str:
    return f"CAST(round_even(8 * log2(1 + abs({centre(f'({a}) - ({b})')})), 0) AS INTEGER)"


def varint_size(x: str) -> str:
    return f"CAST(ceil(length(bin(CAST({x} AS BIGINT))) / 7.0) AS INTEGER)"


def rct_planes() -> tuple[str, str, str]:
    cb, cr = centre("b - g"), centre("r - g")
    return byte(f"g + {half(f'{cb} + {cr}', 4)}"), byte(f"b - g + 128"), byte(f"r - g + 128")


def designs() -> dict[str, tuple[int, str]]:
    """Contexts of each design over activity and neighbours."""
    out = {"one": (1, "0")} | {f"act{k}": (k, bucket("activity", LADDERS[k])) for k in (4, 8, 12, 16, 24, 32)}
    out |= {f"act{k}_signs": (9 * k, f"{bucket('activity', LADDERS[k])} * 9 + {signs()}") for k in (8, 12)}
    return out | {"gradients": (365, folded())}


def normalised(hist: str, keys: str) -> str:
    """hist (keys, sym, n) with freq: scaled to 4096, at least 1; too little goes to the most frequent, too much is taken
    from the most frequent first, down to 1."""
    return (
        f"SELECT *, CASE WHEN miss >= 0 THEN raw + CASE WHEN place = 1 THEN miss ELSE 0 END ELSE raw - greatest(0, least(raw - 1, -miss - (room - raw + 1))) END AS freq FROM ("
        f"SELECT *, 4096 - sum(raw) OVER (PARTITION BY {keys}) AS miss, row_number() OVER o AS place, sum(raw - 1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS room FROM ("
        f"SELECT *, CAST(greatest(1, round_even(n * 4096.0::DOUBLE / sum(n) OVER (PARTITION BY {keys}), 0)) AS BIGINT) AS raw FROM ({hist}))"
        f" WINDOW o AS (PARTITION BY {keys} ORDER BY raw DESC, sym))"
    )
