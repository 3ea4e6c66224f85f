"""Fuzzy line deduplication in DataFrame operations only: MinHash, banding, exact Jaccard, distributed union-find.

Lines are what lies between line feeds; they are compared trimmed and in lower case, and empty ones always stay. A
line's set holds its character shingles: the SHINGLE characters (UTF-16 units) from every position on; a shorter line is
its own only shingle, so short lines match only equal ones.

1.  All lines' shingles are hashed and, in the same stage, the minima under BANDS x ROWS xor-shifted orders are taken by
    a hash aggregation; equal lines come together in it and count as one.
2.  Each band is a bucket key. A bucket's smallest id leads; every other line of the bucket is paired with it only, so
    pairs never outnumber bucket entries. Leaders come from an aggregation joined back; hot buckets' leaders, of which
    there is a bounded number, are broadcast, so no bucket meets in one task.
3.  Pairs that agree in AGREE minima or more are verified by the exact Jaccard similarity of their shingle sets; lines
    that fail against their leader choose another leader among themselves, for ROUNDS rounds.
4.  Buckets whose lines (without the first leader, which has met them all) still lie in two components are compared
    whole: lines of two components may be similar only if they share one of their rarest shingles, without which 0.8
    can't be reached, and agree in enough minima, in size and in their bitmaps (WORDS x 64 bits, each the parity of its
    shingles: sets differ in at least as many shingles as bitmaps do in bits). Shingles that the same lines have count
    once. MEETINGS times each of a shingle's lines meets one of them, drawn anew for each shingle; a line's likeliest
    pair is verified, so there are no more pairs than lines, and components grow together. Lines that still lie in two
    then all meet in tiles, and every pair that may be similar is verified.
5.  Verified pairs are links; each component keeps its first line by (doc_id, line number, text hash), all others go.

Two lines at similarity s meet in a band with probability 1 - (1 - s**ROWS)**BANDS: 0.993 at 0.8, 0.9999 at 0.9; of
those with 0.8, two in a thousand agree in fewer than AGREE of the 21 minima.

Defined results: null text has no line; empty text is one empty line, which stays; a document all of whose lines go
keeps an empty text; lines of one document are compared like others; an empty table gives no rows. Rows that repeat a
doc_id are told apart by a hash of their texts: a line that only one of them has stays, one that several have stays in
one of them; rows equal in both keep the same lines. Rows whose doc_id is null stay as they are and are compared with
nothing. A line of any length is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE = 12
BANDS, ROWS, ROUNDS, MEETINGS = 7, 3, 2, 1
NUMERATOR, DENOMINATOR = 8, 10
AGREE = 11
#: Longs of a line's bitmap, and longs that hold the minima's low 14 bits, four each, every 15 bits.
WORDS, MINIMA = 16, -(-BANDS * ROWS // 4)
#: What pairs of lines are told by, as columns, so that conditions on pairs compile to little code.
SIGNS = [f"s{k}" for k in range(MINIMA)]
TOLD = [*SIGNS, *[f"w{k}" for k in range(WORDS)], "size"]
#: Lines of a shingle that make another tile of the rest.
TILE = 256
#: Pairs whose shingles one task compares.
PAIRS = 2048


def norm(line: Column) -> Column:
    return F.lower(F.trim(line))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def once(table: DataFrame, **made: Column) -> DataFrame:
    """table with columns that are made once a row: the optimizer doesn't move them into what uses them."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_once")
    return table.select("*", held).select(*table.columns, *[F.col(f"_once.{n}").alias(n) for n in made])


def wide(line: Column) -> Column:
    """Two bytes a character, so that any character is found at once."""
    return F.encode(line, "UTF-16BE")


def starts(b: str) -> str:
    """Where the shingles of a wide line start (bytes from 1)."""
    return f"sequence(1, greatest(octet_length({b}) - {2 * SHINGLE - 1}, 1), 2)"


def shingle(b: str, i: str) -> str:
    return f"xxhash64(substring({b}, {i}, {2 * SHINGLE}))"


def eligible_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (its text's hash), line_no, line (normalized), and two 64-bit hashes of it, for all lines that are compared."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "raw"))
    lines = lines.select("doc_id", "row", "line_no", norm(F.col("raw")).alias("line")).where("line <> ''")
    return lines.select("doc_id", "row", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def signatures(docs: DataFrame) -> DataFrame:
    """One row per distinct line: its first document, how often it occurs, and its band keys."""
    lines = eligible_lines(docs).select("doc_id", "h1", "h2", wide(F.col("line")).alias("b"))
    grams = lines.select("doc_id", "h1", "h2", "b", F.explode(F.expr(starts("b"))).alias("i"))
    grams = grams.select("doc_id", "h1", "h2", F.expr("if(i = 1, 1, 0)").alias("one"), F.expr(shingle("b", "i")).alias("x"))
    order = [int(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) - (1 << 63) for k in range(BANDS * ROWS)]  # spread evenly
    least = grams.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.sum("one").alias("times"), *[F.min(F.col("x").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(order)])
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    minima = [" | ".join(f"shiftleft(m{k} & 16383, {15 * (k % 4)})" for k in range(4 * g, min(4 * g + 4, BANDS * ROWS))) for g in range(MINIMA)]
    return least.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "doc_id", "times", F.array(*bands).alias("bands"), *[F.expr(m).alias(f"s{g}") for g, m in enumerate(minima)])


def named(columns: list[str], side: str) -> list[Column]:
    """Columns with a letter in front."""
    return [F.col(c).alias(side + c) for c in columns]


def agree(a: str, b: str) -> str:
    """Whether two lines (SIGNS with letters a and b) agree in AGREE minima or more.

    Four are compared at a time: where two differ, adding 14 ones to what they differ in carries to the bit above.
    """
    ones, carries = (sum(bits << 15 * k for k in range(4)) for bits in (16383, 16384))
    unlike = " + ".join(f"bit_count((({a}{s} ^ {b}{s}) + {ones}L) & {carries}L)" for s in SIGNS)
    return f"{unlike} <= {BANDS * ROWS - AGREE}"


def differ(a: str, b: str) -> str:
    """In how many bits the bitmaps of two lines (TOLD with letters a and b) differ."""
    return f"({' + '.join(f'bit_count({a}w{k} ^ {b}w{k})' for k in range(WORDS))})"


def likely(a: str, b: str) -> str:
    """Whether two lines (TOLD with letters a and b) can be similar: by size, minima, and bitmaps.

    Bitmaps may differ in no more bits than sets of such sizes may in shingles.
    """
    sizes = f"least({a}size, {b}size) * {DENOMINATOR} >= greatest({a}size, {b}size) * {NUMERATOR}"
    return f"{sizes} AND {agree(a, b)} AND {differ(a, b)} * {DENOMINATOR + NUMERATOR} <= ({a}size + {b}size) * {DENOMINATOR - NUMERATOR}"


def led(members: DataFrame) -> DataFrame:
    """(key, leader, id) for members (key, id) of buckets with several lines, without the leaders themselves. Stored."""
    spark = members.sparkSession
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).where("leader <> last").drop("last")
    leaders = common.stored(spark, leaders, "leaders")
    total = leaders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = common.spread_join(members, leaders, ["key"], "n", total).where("id <> leader").select("key", "leader", "id")
    out = common.stored(spark, out, "met")
    common.drop(leaders)
    return out


def line_texts(docs: DataFrame, table: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, SIGNS): the lines wanted, taken from their first documents."""
    wanted = table.join(ids, "id", "left_semi").select("id", "doc_id", "h1", "h2", *SIGNS)
    return eligible_lines(docs).select("doc_id", "h1", "h2", "line").join(wanted.hint("shuffle_hash"), ["doc_id", "h1", "h2"]).select("id", "line", *SIGNS).dropDuplicates(["id"])


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (leader, id; a stored table) whose sets have a Jaccard similarity of NUMERATOR / DENOMINATOR or more.

    A pair's shingles are grouped where its lines lie, so they aren't shuffled.
    """
    tasks = pairs.count() // PAIRS + 1
    pairs = pairs.join(texts.select(F.col("id").alias("leader"), *named(SIGNS, "a")), "leader").join(texts.select("id", *named(SIGNS, "b")), "id").where(agree("a", "b")).select("leader", "id")
    left = texts.select(F.col("id").alias("leader"), F.col("line").alias("p"))
    both = pairs.join(left, "leader").join(texts.select("id", F.col("line").alias("q")), "id")
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), wide(F.col(c)).alias("b")) for k, c in ((1, "p"), (2, "q"))])).alias("s")
    both = both.repartition(tasks, "leader", "id").select("leader", "id", sides).select("leader", "id", "s.side", "s.b")
    grams = both.select("leader", "id", "side", "b", F.explode(F.expr(starts("b"))).alias("i")).select("leader", "id", "side", F.expr(shingle("b", "i")).alias("x"))
    met = grams.groupBy("leader", "id", "x").agg(F.bit_or("side").alias("sides")).groupBy("leader", "id").agg(F.count("*").alias("n"), F.count(F.expr("nullif(sides <> 3, true)")).alias("i"))
    return met.where(F.col("i") * DENOMINATOR >= NUMERATOR * F.col("n")).select("leader", "id")


def rest_lines(members: DataFrame, labels: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, id, c): rarest shingles that lines of several components c have, for the buckets (key, id) that hold several; and
    (id, TOLD) of lines. Both stored."""
    spark = members.sparkSession
    placed = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    placed = common.stored(spark, placed, "placed")
    mixed = common.stored(spark, placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n"), "mixed")
    total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = common.spread_join(placed, mixed, ["key"], "n", total).select("id", "c").distinct()
    grams = once(texts.select("id", "line").join(wanted, "id"), b=wide(F.col("line"))).select("id", "c", "b", F.explode(F.expr(starts("b"))).alias("i")).select("id", "c", F.expr(shingle("b", "i")).alias("x")).distinct()
    grams = common.stored(spark, grams, "rest")
    words = [F.bit_xor(F.expr(f"IF((x & {WORDS - 1}) = {k}, shiftleft(1L, CAST(shiftrightunsigned(x, 32) & 63 AS INT)), 0L)")).alias(f"w{k}") for k in range(WORDS)]
    maps = common.stored(spark, grams.groupBy("id").agg(*words, F.count("*").alias("size")), "maps")
    often = common.stored(spark, grams.groupBy("x").agg(F.count("*").alias("n")), "often")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = common.spread_join(grams, often.withColumn("w", F.col("n")), ["x"], "n", total)
    ranked = ranked.groupBy("id", "c").agg(F.sort_array(F.collect_list(F.struct("w", "x"))).alias("r"))  # one line's shingles
    rarest = F.expr(f"slice(r, 1, size(r) - ({NUMERATOR} * size(r) + {DENOMINATOR - 1}) div {DENOMINATOR} + 1)")
    rare = ranked.select("id", "c", F.explode(F.transform(rarest, lambda r: r["x"])).alias("x"))
    rare = common.stored(spark, rare, "rarest")
    for t in (placed, mixed, grams, often):
        common.drop(t)
    several = rare.groupBy("x").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("f"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("g")).where("a <> b")
    several = several.groupBy("first", "n", "f", "g").agg(F.min("x").alias("x"))
    several = common.stored(spark, several.select("x", "n"), "several")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = common.stored(spark, common.spread_join(rare, several, ["x"], "n", total).select("x", "id", "c"), "rows")
    told = common.stored(spark, maps.join(texts.select("id", *SIGNS), "id"), "told")
    for t in (several, rare, maps):
        common.drop(t)
    return rows, told


def drawn_links(rows: DataFrame, told: DataFrame, texts: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """rows of shingles that several components still have, with their components, and the links (leader, id) found; both
    stored. Each line of a shingle meets one that is drawn, if that is of another component; a line's likeliest pair is verified."""
    spark = rows.sparkSession
    drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "x", "id").alias("h"), "id", "c")).alias("d")
    heads = rows.groupBy("x").agg(drawn, F.count("*").alias("n"))
    heads = common.stored(spark, heads.select("x", "n", F.col("d.id").alias("leader"), F.col("d.c").alias("ca")), "heads")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = common.spread_join(rows, heads, ["x"], "n", total).where("c <> ca").select("leader", "ca", "id", "c").distinct()
    met = met.join(told.select(F.col("id").alias("leader"), *named(TOLD, "a")), "leader").join(told.select("id", *named(TOLD, "b")), "id").where(likely("a", "b"))
    best = met.groupBy("id", "c").agg(F.min(F.struct(F.expr(differ("a", "b")).alias("d"), "leader", "ca")).alias("m"))
    pairs = common.stored(spark, best.select("m.leader", "id", "m.ca", "c"), "pairs")
    found = common.stored(spark, similar(pairs.select("leader", "id"), texts), "similar")
    joined = connected_components(pairs.join(found, ["leader", "id"], "left_semi"), "ca", "c")
    now = rows.join(joined, F.col("c") == F.col("node"), "left").select("x", "id", F.coalesce("component", "c").alias("c"))
    now = common.stored(spark, now, "placed")
    mixed = common.stored(spark, now.groupBy("x").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where("a <> b").select("x", "n"), "mixed")
    total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = common.stored(spark, common.spread_join(now, mixed, ["x"], "n", total).select("x", "id", "c"), "rows")
    for t in (heads, pairs, now, mixed, rows):
        common.drop(t)
    return out, found


def rest_pairs(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Pairs (leader, id) of lines of two components that may be similar, of all that share a shingle (x, id, c). Stored."""
    spark = rows.sparkSession
    several = common.stored(spark, rows.groupBy("x").agg(F.count("*").alias("n")).select("x", "n", F.expr(f"CAST(n div {TILE} + 1 AS INT)").alias("tiles")), "several")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tiled = common.stored(spark, common.spread_join(rows, several, ["x"], "n", total).join(told, "id"), "tiled")
    left = tiled.select("x", F.col("id").alias("leader"), F.col("c").alias("ca"), *named(TOLD, "a"), F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"))
    right = tiled.select("x", "id", F.col("c").alias("cb"), *named(TOLD, "b"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    fits = f"ca < cb AND {likely('a', 'b')}"
    met = left.alias("l").join(right.alias("r"), (F.col("l.x") == F.col("r.x")) & (F.col("l.tile") == F.col("r.tile")) & F.expr(fits))
    out = common.stored(spark, met.select("leader", "id").distinct(), "pairs")
    common.drop(several)
    common.drop(tiled)
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, removed): the numbers of the lines that go, for texts that lose any. Stored."""
    spark = docs.sparkSession
    table = common.stored(spark, signatures(docs), "lines")
    members = table.select("id", F.explode("bands").alias("key"))
    links = texts = several = None
    scratch = []
    for _ in range(ROUNDS):
        met = led(members)
        pairs = common.stored(spark, met.select("leader", "id").distinct(), "pairs")
        if texts is None:  # later rounds pair lines of the first only
            several = met.select("key", "id")  # the first leader of a bucket has met all its lines
            ids = pairs.select("id").unionAll(pairs.select(F.col("leader").alias("id"))).distinct()
            texts = common.stored(spark, line_texts(docs, table, ids), "texts")
        found = common.stored(spark, similar(pairs, texts), "similar")
        links = found if links is None else links.unionAll(found)
        scratch += [met, found]
        common.drop(pairs)
        members = met.join(found, ["leader", "id"], "left_anti").select("id", "key")
    labels = connected_components(links, "leader", "id")
    rows, told = rest_lines(several, labels, texts)
    rest = []
    for turn in range(MEETINGS):
        rows, found = drawn_links(rows, told, texts, turn)
        rest.append(found)
    pairs = rest_pairs(rows, told)
    rest.append(common.stored(spark, similar(pairs, texts), "similar"))
    for t in (pairs, rows, told, texts):
        common.drop(t)
    if any(not found.isEmpty() for found in rest):
        for found in rest:
            links = links.unionAll(found)
        labels = connected_components(links, "leader", "id")
    labels = labels.withColumnRenamed("node", "id")
    classes = table.join(labels, "id", "left").where("component is not null or times > 1").select("h1", "h2", F.coalesce("component", "id").alias("c"), "times")
    classes = common.stored(spark, classes, "classes")
    total = classes.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    found_in = common.stored(spark, common.spread_join(eligible_lines(docs).drop("line"), classes, ["h1", "h2"], "times", total).select("doc_id", "row", "line_no", "c"), "found")
    keepers = common.stored(spark, found_in.groupBy("c").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("kept"), F.count("*").alias("n")), "keepers")
    gone = common.spread_join(found_in, keepers, ["c"], "n", total).where("doc_id <> kept.doc_id or line_no <> kept.line_no or row <> kept.row")
    out = common.stored(spark, gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "gone")  # one text's lines
    for t in (table, classes, found_in, keepers, *rest, *scratch):
        common.drop(t)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with their text without the lines that go, and columns n_lines and n_removed (replaced, if there)."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    out = docs.select(*kept).join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left")
    lines = split_lines(F.col("text"))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_removed"), i)), "\n"))
    counts = [F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed")]
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], *counts)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and the digest and length of the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"), F.octet_length(kept).cast("long").alias("kept_bytes"))
