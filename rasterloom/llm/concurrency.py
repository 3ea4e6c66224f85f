"""Peak concurrency: how many intervals of a key are open, and their weight, at each moment where either changes.

Starts and ends are summed up per key and minute, then dealt into chunks of CHUNK minutes: a chunk has one row a minute
at most, whatever its intervals' number, so no key and no time makes a large group. A first pass of grouped Arrow tasks
gives each chunk's totals and the highest of its running sums (DuckDB windows over the sorted deltas); a Spark window over
those totals, a row for each key and chunk, gives what a chunk begins with: the sums and the highest count so far, the next
chunk's first moment, and the key's highest weight. A second pass of grouped Arrow tasks, seeded by these carries, writes
the rows. Nothing but chunk totals is scanned in order: about 32 rows for a key and a year.

Defined results: times are rounded down to minutes; intervals without a start, or whose end isn't after the start, take
no part; without an end an interval stays open; a null weight counts as 0, repeated rows count each; moments where
neither sum changes are left out; a key without any moment, or an empty table, gives no rows.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Minutes of a chunk.
CHUNK = 1 << 14
MINUTE, DAY = 60, 86_400
#: The key that all intervals count for besides their own.
ALL = -2
#: Weights of this size or more, or that aren't numbers, count as 0: in hundredths they don't fit exact integers.
MOST = 9e15
TOTALS = "key int, chunk long, opened long, weight long, most_opened long, most_weight long, first_s long"
ROWS = "key int, from_s long, to_s long, n_open long, open_weight long, high_open long, is_peak boolean"

TOTALS_SQL = """
SELECT min(key) AS key, min(chunk) AS chunk, CAST(sum(opened) AS BIGINT) AS opened, CAST(sum(weight) AS BIGINT) AS weight,
       CAST(max(now_opened) AS BIGINT) AS most_opened, CAST(max(now_weight) AS BIGINT) AS most_weight, min(at_s) AS first_s
FROM (SELECT *, sum(opened) OVER w AS now_opened, sum(weight) OVER w AS now_weight FROM deltas WINDOW w AS (ORDER BY at_s))
"""
ROWS_SQL = """
SELECT key, from_s, CAST(coalesce(to_s, next_s) AS BIGINT) AS to_s, CAST(n_open AS BIGINT) AS n_open, CAST(open_weight AS BIGINT) AS open_weight,
       CAST(greatest(high_before, max(n_open) OVER (ORDER BY from_s)) AS BIGINT) AS high_open, open_weight = peak AS is_peak
FROM (SELECT d.key, d.at_s AS from_s, lead(d.at_s) OVER w AS to_s, opened_before + sum(d.opened) OVER w AS n_open,
             weight_before + sum(d.weight) OVER w AS open_weight, high_before, next_s, peak
      FROM deltas d CROSS JOIN carry WINDOW w AS (ORDER BY d.at_s))
ORDER BY from_s
"""
_connections: list[duckdb.DuckDBPyConnection] = []


def _ask(sql: str, **tables: pa.Table) -> pa.Table:
    """The SQL's rows over Arrow tables, by this process's one-threaded DuckDB."""
    if not _connections:
        _connections.append(duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "autoinstall_known_extensions": False}))
    db = _connections[0]
    for name, table in tables.items():
        db.register(name, table)
    found = db.sql(sql).to_arrow_table()
    for name in tables:
        db.unregister(name)
    return found


def seconds(df: DataFrame, column: str) -> Column:
    """A time as UTC seconds since 1970, rounded down to minutes; times without a zone are taken as UTC."""
    at = F.col(column)
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.unix_date(at.cast("date")).cast("long") * DAY + F.hour(at) * 3600 + F.minute(at) * MINUTE
    return F.unix_seconds(at) - F.pmod(F.unix_seconds(at), F.lit(MINUTE))


def changes(intervals: DataFrame) -> DataFrame:
    """(key, at_s, opened, weight): how the sums of a key change at a moment, from (key, start_s, end_s, weight)."""
    valid = intervals.where("start_s IS NOT NULL AND (end_s IS NULL OR end_s > start_s)")
    start = F.struct(F.col("start_s").alias("at_s"), F.lit(1).cast("long").alias("opened"), F.col("weight").alias("weight"))
    end = F.struct(F.col("end_s").alias("at_s"), F.lit(-1).cast("long").alias("opened"), (-F.col("weight")).alias("weight"))
    moved = valid.select("key", F.inline(F.filter(F.array(start, end), lambda x: x["at_s"].isNotNull())))
    return moved.groupBy("key", "at_s").agg(F.sum("opened").alias("opened"), F.sum("weight").alias("weight")).where("opened <> 0 OR weight <> 0")


def sweep(intervals: DataFrame) -> DataFrame:
    """(key, from_s, to_s, n_open, open_weight, high_open, is_peak) of (key int, start_s, end_s, weight), all longs.

    is_peak: the weight is the key's largest. Rows of a key don't overlap; the last has no to_s.
    """
    spark = intervals.sparkSession
    chunk = F.floor(F.col("at_s") / (CHUNK * MINUTE)).alias("chunk")
    deltas = common.stored(spark, changes(intervals).select("key", chunk, "at_s", "opened", "weight"), "deltas")
    totals = deltas.groupBy("key", "chunk").applyInArrow(lambda t: _ask(TOTALS_SQL, deltas=t), TOTALS)
    ordered = Window.partitionBy("key").orderBy("chunk")
    before, every = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    begins = totals.withColumns({
        "opened_before": F.coalesce(F.sum("opened").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "next_s": F.lead("first_s").over(ordered),
    })
    carries = begins.select("key", "chunk", "opened_before", "weight_before", F.max(F.col("opened_before") + F.col("most_opened")).over(before).alias("high_before"), "next_s", F.max(F.col("weight_before") + F.col("most_weight")).over(every).alias("peak"))

    def rows(key: tuple, own: pa.Table, carry: pa.Table) -> pa.Table:
        return _ask(ROWS_SQL, deltas=own, carry=carry)

    return deltas.groupBy("key", "chunk").cogroup(carries.groupBy("key", "chunk")).applyInArrow(rows, ROWS)


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 7) -> DataFrame:
    """(key, start_s, end_s, weight) of each sale: open from sold_at until `days` days after its first shipment.

    key: the client's nation_id, -1 without one; weight: cents of the total, rounded half up. Repeated sales count each;
    of a client's repeated rows the smallest nation_id counts; sales without sale_id have no end, those without client_id
    or with an unknown one no nation; totals that aren't finite, or don't fit, have weight 0.
    """
    spark = sales.sparkSession
    shipped = lines.select("sale_id", seconds(lines, "shipped_at").alias("at")).where("sale_id IS NOT NULL AND at IS NOT NULL")
    ends = shipped.groupBy("sale_id").agg((F.min("at") + days * DAY).alias("end_s"))
    nations = clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("nation_id").alias("nation_id"))
    # Stored, so that both sides of each join are plain exchanges and a hot sale or client is split where it shows.
    ends, nations = common.stored(spark, ends, "ends"), common.stored(spark, nations, "nations")
    cents = F.when(F.abs("total") < MOST, F.floor(100 * F.col("total") + 0.5)).otherwise(0).cast("long")
    own = sales.select("sale_id", "client_id", seconds(sales, "sold_at").alias("start_s"), cents.alias("weight")).where("start_s IS NOT NULL")
    own = own.join(ends.hint("merge"), "sale_id", "left").select("client_id", "start_s", "end_s", "weight").where("end_s IS NULL OR end_s > start_s")
    own = own.join(nations.hint("merge"), "client_id", "left")
    return own.select(F.coalesce(F.col("nation_id"), F.lit(-1)).cast("int").alias("key"), "start_s", "end_s", "weight")


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak: each nation's open sales, and all of them (ALL)."""
    own = sale_intervals(sales, lines, clients)
    both = own.withColumn("key", F.explode(F.array(F.col("key"), F.lit(ALL))))
    return sweep(both).withColumnsRenamed({"key": "nation_id", "open_weight": "open_cents"})


SQL = """
WITH ends AS (
  SELECT sale_id, min(epoch_us(shipped_at) // 60000000) * 60 + 7 * 86400 AS end_s FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
), own AS (
  SELECT client_id, (epoch_us(sold_at) // 60000000) * 60 AS start_s, end_s, CAST(coalesce(floor(100 * total + 0.5), 0) AS BIGINT) AS cents
  FROM sales s LEFT JOIN ends e ON s.sale_id = e.sale_id
), nations AS (
  SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id
), valid AS (
  SELECT coalesce(nation_id, -1) AS nation_id, start_s, end_s, cents FROM own o LEFT JOIN nations n ON o.client_id = n.client_id
  WHERE start_s IS NOT NULL AND (end_s IS NULL OR end_s > start_s)
), keyed AS (
  SELECT * FROM valid UNION ALL SELECT -2, start_s, end_s, cents FROM valid
), moved AS (
  SELECT nation_id, start_s AS at_s, 1 AS opened, cents FROM keyed
  UNION ALL SELECT nation_id, end_s, -1, -cents FROM keyed WHERE end_s IS NOT NULL
), deltas AS (
  SELECT nation_id, at_s, sum(opened) AS opened, sum(cents) AS cents FROM moved GROUP BY ALL HAVING sum(opened) <> 0 OR sum(cents) <> 0
), running AS (
  SELECT nation_id, at_s AS from_s, lead(at_s) OVER w AS to_s, CAST(sum(opened) OVER w AS BIGINT) AS n_open, CAST(sum(cents) OVER w AS BIGINT) AS open_cents
  FROM deltas WINDOW w AS (PARTITION BY nation_id ORDER BY at_s)
)
SELECT CAST(nation_id AS INTEGER) AS nation_id, from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS high_open,
       open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
FROM running
"""
