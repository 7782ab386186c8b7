"""Joins lines to items on near prices, by adaptive recursive partitioning of the price axis.

Pairs are far too many to list (a cheap item meets a good part of all lines), and what
is asked of them is counts, sums and the nearest ten. So lines are combined first: one
row for each (unit price, item) with the number of lines and the sum of their digests,
and of each unit price the few lines that can be among anybody's first ten.

A histogram of fixed size (a cell a cent at first, then 256 cells an octave) gives the
driver the load of any price region: its items, the lines whose prices lie in the
items' bands, and the pairs of distinct prices that its join would meet. The heaviest
region is split where that leaves the lightest halves, again and again. A region that
no split relieves, a hot price, becomes a grid: its items in parts, its lines in parts,
every part of one with every part of the other. Lines at a border go to all regions
whose bands reach them. DuckDB then joins each region or grid square by itself, on
``u BETWEEN lo AND hi``, and the squares' sums and nearest lines are merged by item.

The nearest lines of a price are found by place: lines in price order are numbered, and
the first few places on either side of a price are looked at. Only an item that owns one
of those looks on, past as many places as it has lines of its own in the band, so the
work follows the number of rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.llm import common

#: The band: a gap of at most NEAR cents, or SHARE thousandths of the smaller price. A report lists the first TOP pairs.
NEAR, SHARE, TOP = 50, 5, 10
#: Load of a region or square, in rows; that many pairs of distinct prices weigh as one row; regions at most; what a split must save.
LOAD, PAIRS_A_ROW, MAX_REGIONS, RELIEF = 50_000, 32, 2048, 0.8
#: Prices are whole cents that a double holds exactly; anything else is no price.
_EXACT = float(1 << 53)
#: Prices below this have a cell each; above, an octave has _STEPS cells.
_FINE, _FINE_BITS, _STEPS_BITS = 2048, 11, 8

_ITEM, _LINES, _LINE = 0, 1, 2
_TOP = "array<struct<gap:bigint,u:bigint,sale_id:bigint,line_no:bigint,line_item_id:bigint>>"


def cents(amount: Column) -> Column:
    """floor(100 * x + 0.5) in doubles as a long; null for what is no amount (null, NaN, infinite, beyond 2**53)."""
    value = F.floor(F.lit(100.0) * amount + F.lit(0.5))
    there = ~F.isnan(amount) & (F.abs(F.lit(100.0) * amount) < _EXACT)
    return F.when(there, value)


def _cell(price: Column) -> Column:
    """The cell of a price in cents; cells are in the order of prices, those of negative prices mirror the others."""
    size = F.abs(price)
    bits = F.length(F.bin(size)) - 1
    high = _FINE + (bits - _FINE_BITS) * (1 << _STEPS_BITS) + F.call_function("shiftright", size, bits - _STEPS_BITS) - (1 << _STEPS_BITS)
    return (F.when(size < _FINE, size).otherwise(high) * F.signum(price)).cast("int")


def _cell_span(cell: int) -> tuple[int, int]:
    """The least and the largest price of a cell."""
    size = abs(cell)
    if size < _FINE:
        return cell, cell
    octave, step = divmod(size - _FINE, 1 << _STEPS_BITS)
    low = ((1 << _STEPS_BITS) + step) << (octave + _FINE_BITS - _STEPS_BITS)
    span = low, low + (1 << (octave + _FINE_BITS - _STEPS_BITS)) - 1
    return span if cell > 0 else (-span[1], -span[0])


def _reach(price: int) -> tuple[int, int]:
    """Unit prices that an item of this price pairs with. Below it, 1000 * (p - u) <= 5 * u is p - u <= p * 5 / 1005."""
    return price - max(NEAR, price * SHARE // (1000 + SHARE)), price + max(NEAR, price * SHARE // 1000)


@dataclass(frozen=True)
class Region:
    """Prices ``first`` to ``last`` of items, unit prices ``low`` to ``high`` of lines, and the parts of its grid."""

    first: int
    last: int
    low: int
    high: int
    item_parts: int = 1
    line_parts: int = 1


def plan_regions(histogram: list[tuple[int, int, int]], load: float = LOAD, most: int = MAX_REGIONS) -> list[Region]:
    """Regions from (cell, items, lines) rows of the histogram.

    Beyond ``most`` regions the allowed load rises instead, so the plan has a bounded size.
    """
    rows = sorted(histogram)
    cells = np.array([r[0] for r in rows], np.int64)
    if not len(cells) or not any(r[1] for r in rows):
        return []
    low, high = (np.array(x, np.int64) for x in zip(*(_cell_span(int(c)) for c in cells)))
    n_items, n_lines = (np.array([r[k] for r in rows], np.float64) for k in (1, 2))
    width = (high - low + 1).astype(np.float64)
    # Band windows of each cell as ranges of cells.
    begin = np.searchsorted(high, [_reach(int(x))[0] for x in low], "left")
    end = np.searchsorted(low, [_reach(int(x))[1] for x in high], "right")
    items, lines, prices = (np.concatenate(([0.0], np.cumsum(x))) for x in (n_items, n_lines, np.minimum(n_lines, width)))
    met = np.concatenate(([0.0], np.cumsum(np.minimum(n_items, width) * (prices[end] - prices[begin]))))

    def weight(a, b):
        return items[b] - items[a] + lines[end[b - 1]] - lines[begin[a]] + (met[b] - met[a]) / PAIRS_A_ROW

    load = max(load, float(items[-1] + lines[-1] + met[-1] / PAIRS_A_ROW) / most)
    heap = [(-weight(0, len(cells)), 0, len(cells))]
    done: list[Region] = []
    while heap:
        heavy, a, b = heapq.heappop(heap)
        heavy = -heavy
        if items[b] == items[a]:
            continue
        if heavy > load and b - a > 1 and len(heap) + len(done) + 1 < most:
            cuts = np.arange(a + 1, b)
            worse = np.maximum(weight(np.full(len(cuts), a), cuts), weight(cuts, np.full(len(cuts), b)))
            best = int(worse.argmin())
            if worse[best] <= RELIEF * heavy:
                for x, y in ((a, int(cuts[best])), (int(cuts[best]), b)):
                    heapq.heappush(heap, (-float(weight(x, y)), x, y))
                continue
        parts = [1, 1]
        own = [items[b] - items[a], lines[end[b - 1]] - lines[begin[a]]]
        while own[0] / parts[0] + own[1] / parts[1] + (met[b] - met[a]) / PAIRS_A_ROW / (parts[0] * parts[1]) > load and parts[0] * parts[1] < most:
            parts[int(own[1] / parts[1] > own[0] / parts[0])] += 1
        done.append(Region(int(low[a]), int(high[b - 1]), _reach(int(low[a]))[0], _reach(int(high[b - 1]))[1], *parts))
    return sorted(done, key=lambda r: r.first)


def combine_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums by (unit price, item), and the lines of each unit price that can be among the first ten of some item.

    Of a unit price the first 2 * TOP lines in order (sale_id, line_no with nulls first,
    item) are enough when each item has at most TOP among them: without any one item's
    lines at least TOP of them stay. Both limits are applied before rows are shuffled.
    """
    quantity = F.col("quantity").cast("long")
    amount = cents(F.col("amount"))
    sign = F.signum(quantity).cast("long")
    over, under = (2 * amount + quantity) * sign, 2 * F.abs(quantity)
    unit = F.when(quantity != 0, F.call_function("div", over - F.pmod(over, under), under))
    key = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    rows = lines.where(F.col("sale_id").isNotNull() & F.col("item_id").isNotNull())
    rows = rows.select(unit.alias("u"), F.col("item_id").cast("long").alias("item"), F.col("sale_id").cast("long").alias("sale"), F.col("line_no").cast("long").alias("line"), F.crc32(key.cast("binary")).alias("crc")).where(F.col("u").isNotNull())
    sums = rows.groupBy("u", "item").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    firsts = rows.drop("crc")
    for keys, most in ((["u", "item"], TOP), (["u"], 2 * TOP)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("sale", "line", "item"))
        firsts = firsts.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return sums, firsts


_LOCAL = f"""
WITH items AS (
  SELECT v AS p, item, n AS copies, v - greatest({NEAR}, v * {SHARE} // {1000 + SHARE}) AS lo, v + greatest({NEAR}, v * {SHARE} // 1000) AS hi
  FROM rows WHERE kind = {_ITEM}),
prices AS (SELECT DISTINCT p, lo, hi FROM items),
lines AS (SELECT v AS u, item, n, crc FROM rows WHERE kind = {_LINES}),
units AS (SELECT u, sum(n) AS n, sum(crc) AS crc FROM lines GROUP BY u),
totals AS (
  SELECT p, sum(n) AS n, sum(abs(u - p) * n) AS gaps, sum(crc) AS crc
  FROM prices JOIN units ON u BETWEEN lo AND hi GROUP BY p),
own AS (
  SELECT p, item, sum(n) AS n, sum(abs(u - p) * n) AS gaps, sum(crc) AS crc
  FROM items JOIN lines USING (item) WHERE u BETWEEN lo AND hi GROUP BY p, item),
firsts AS (
  SELECT v AS u, item, sale, line, row_number() OVER (ORDER BY v DESC, sale, line NULLS FIRST, item) AS down,
         row_number() OVER (ORDER BY v, sale, line NULLS FIRST, item) AS up
  FROM rows WHERE kind = {_LINE}),
edges AS (SELECT u, min(down) AS down, min(up) AS up FROM firsts GROUP BY u),
starts AS (
  SELECT p, lo, hi, below.down, above.up
  FROM prices ASOF LEFT JOIN edges AS below ON p >= below.u ASOF LEFT JOIN edges AS above ON p < above.u),
near AS (
  SELECT p, f.* FROM (SELECT p, lo, unnest(range(down, down + {TOP})) AS place FROM starts) JOIN firsts f ON place = f.down WHERE u >= lo
  UNION ALL
  SELECT p, f.* FROM (SELECT p, hi, unnest(range(up, up + {TOP})) AS place FROM starts) JOIN firsts f ON place = f.up WHERE u <= hi),
ten AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY p ORDER BY abs(u - p), u, sale, line NULLS FIRST, item) <= {TOP}),
owners AS (
  SELECT i.p, i.item, i.lo, i.hi, count(*) AS more
  FROM items i JOIN ten ON ten.p = i.p AND ten.item = i.item JOIN firsts f ON f.item = i.item AND f.u BETWEEN i.lo AND i.hi
  GROUP BY i.p, i.item, i.lo, i.hi),
further AS (
  SELECT x.p, x.item, f.u, f.sale, f.line, f.item AS other
  FROM (SELECT o.p, o.item, o.lo, unnest(range(down, down + {TOP} + more)) AS place FROM owners o JOIN starts USING (p)) x JOIN firsts f ON x.place = f.down
  WHERE f.u >= x.lo AND f.item <> x.item
  UNION ALL
  SELECT x.p, x.item, f.u, f.sale, f.line, f.item AS other
  FROM (SELECT o.p, o.item, o.hi, unnest(range(up, up + {TOP} + more)) AS place FROM owners o JOIN starts USING (p)) x JOIN firsts f ON x.place = f.up
  WHERE f.u <= x.hi AND f.item <> x.item),
others AS (SELECT * FROM further QUALIFY row_number() OVER (PARTITION BY p, item ORDER BY abs(u - p), u, sale, line NULLS FIRST, other) <= {TOP}),
plain_lists AS (SELECT p, list({{'gap': abs(u - p), 'u': u, 'sale_id': sale, 'line_no': line, 'line_item_id': item}}) AS top FROM ten GROUP BY p),
own_lists AS (SELECT p, item, list({{'gap': abs(u - p), 'u': u, 'sale_id': sale, 'line_no': line, 'line_item_id': other}}) AS top FROM others GROUP BY p, item)
SELECT i.item, i.p, i.copies, CAST(coalesce(t.n, 0) - coalesce(o.n, 0) AS BIGINT) AS n_pairs,
       CAST(coalesce(t.gaps, 0) - coalesce(o.gaps, 0) AS BIGINT) AS gap_sum, CAST(coalesce(t.crc, 0) - coalesce(o.crc, 0) AS BIGINT) AS lines_crc,
       CASE WHEN w.p IS NULL THEN l.top ELSE s.top END AS top
FROM items i LEFT JOIN totals t ON t.p = i.p LEFT JOIN own o ON o.p = i.p AND o.item = i.item
LEFT JOIN (SELECT p, item FROM owners) w ON w.p = i.p AND w.item = i.item
LEFT JOIN plain_lists l ON l.p = i.p LEFT JOIN own_lists s ON s.p = i.p AND s.item = i.item
"""

_JOINED = f"item long, p long, copies long, n_pairs long, gap_sum long, lines_crc long, top {_TOP}"


def _join_square(table: pa.Table) -> pa.Table:
    """One region or square, joined by DuckDB in this task."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as here:
        here.register("rows", table)
        out = here.sql(_LOCAL).to_arrow_table()
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("gap", "u", "sale_id", "line_no", "line_item_id")]))
        return pa.table([out.column(k).cast(pa.int64()) for k in range(6)] + [out.column(6).cast(kind)], names=out.column_names)


def _deal(rows: DataFrame, cells: list[int], regions: list[Region]) -> DataFrame:
    """Rows with the regions and squares they go to.

    What is broadcast has a row for each cell of the histogram, whose number is bounded, and holds the regions that reach it.
    """
    first, last, low, high = (np.array([getattr(r, k) for r in regions], np.int64) for k in ("first", "last", "low", "high"))
    base = np.concatenate(([0], np.cumsum([r.item_parts * r.line_parts for r in regions])))
    table = []
    for cell in cells:
        least, most = _cell_span(cell)
        near = range(int(np.searchsorted(high, least, "left")), int(np.searchsorted(low, most, "right")))
        table.append((cell, [(int(base[k]), int(first[k]), int(last[k]), int(low[k]), int(high[k]), regions[k].item_parts, regions[k].line_parts) for k in near]))
    plan = rows.sparkSession.createDataFrame(table, "cell int, regions array<struct<base:int,first:long,last:long,low:long,high:long,item_parts:int,line_parts:int>>")
    found = rows.withColumn("cell", _cell(F.col("v"))).join(F.broadcast(plan), "cell").withColumn("r", F.explode("regions"))
    is_item = F.col("kind") == _ITEM
    found = found.where(F.when(is_item, F.col("v").between(F.col("r.first"), F.col("r.last"))).otherwise(F.col("v").between(F.col("r.low"), F.col("r.high"))))
    own = F.pmod(F.xxhash64("item"), F.when(is_item, F.col("r.item_parts")).otherwise(F.col("r.line_parts"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_item, F.col("r.line_parts")).otherwise(F.col("r.item_parts")) - 1))
    found = found.withColumn("own", own).withColumn("other", other)
    row, column = F.when(is_item, F.col("own")).otherwise(F.col("other")), F.when(is_item, F.col("other")).otherwise(F.col("own"))
    return found.select((F.col("r.base") + row * F.col("r.line_parts") + column).alias("square"), "kind", "v", "item", "n", "crc", "sale", "line")


def near_prices(lines: DataFrame, items: DataFrame, load: float = LOAD, most: int = MAX_REGIONS) -> DataFrame:
    """Each item's first ten pairs with lines of other items near its price, and its counts and sums over all pairs.

    ``lines`` has sale_id, line_no, item_id, quantity, amount, ``items`` has item_id
    and price; further columns are left out, and ids are integers. An item in cents p
    pairs with a line whose amount for one unit is u cents when |u - p| is at most 50
    or 1000 * |u - p| at most 5 * min(u, p).

    Returns item_id, rank (from 1), gap, u, sale_id, line_no, line_item_id, n_pairs,
    gap_sum, lines_crc (of the decimal ``sale_id,line_no,line_item_id``). An item
    without pairs has one row of rank 0 with nulls and zeros; repeated item rows each
    have their rows, repeated lines each count. Lines null in sale_id, item_id,
    quantity or amount, or of quantity 0, and items null in item_id or price never
    pair, nor do prices that are no exact number of cents (NaN, infinite, beyond
    2**53). A null line_no comes first and is empty in the digest.
    """
    none = F.lit(None).cast("long")
    price = cents(F.col("price"))
    named = items.select(F.col("item_id").cast("long").alias("item"), price.alias("p"))
    paired = F.col("item").isNotNull() & F.col("p").isNotNull()
    sums, firsts = combine_lines(lines)
    rows = named.where(paired).groupBy("item", "p").agg(F.count("*").alias("n")).select(F.lit(_ITEM).alias("kind"), F.col("p").alias("v"), "item", "n", none.alias("crc"), none.alias("sale"), none.alias("line"))
    rows = rows.unionByName(sums.select(F.lit(_LINES).alias("kind"), F.col("u").alias("v"), "item", "n", "crc", none.alias("sale"), none.alias("line")))
    rows = rows.unionByName(firsts.select(F.lit(_LINE).alias("kind"), F.col("u").alias("v"), "item", none.alias("n"), none.alias("crc"), "sale", "line"))
    rows = common.materialize(rows, "band-rows")
    is_item = F.col("kind") == _ITEM
    histogram = [tuple(r) for r in rows.groupBy(_cell(F.col("v")).alias("cell")).agg(F.count_if(is_item), F.count_if(~is_item)).collect()]
    regions = plan_regions(histogram, load, most)
    dealt = _deal(rows, [r[0] for r in histogram], regions)
    joined = dealt.groupBy("square").applyInArrow(_join_square, _JOINED)
    # The squares of a grid each have some of an item's lines.
    merged = joined.groupBy("item", "p").agg(F.max("copies").alias("copies"), *(F.sum(k).alias(k) for k in ("n_pairs", "gap_sum", "lines_crc")), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, TOP).alias("top"))
    merged = merged.select(F.col("item").alias("item_id"), "n_pairs", "gap_sum", "lines_crc", "top", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    zero = F.lit(0).cast("long")
    alone = named.where(~paired).select(F.col("item").alias("item_id"), zero.alias("n_pairs"), zero.alias("gap_sum"), zero.alias("lines_crc"), F.array().cast(_TOP).alias("top"), zero.alias("copy"))
    out = merged.unionByName(alone).select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("top").alias("pos", "pair"))
    fields = [F.col(f"pair.{k}").alias(k) for k in ("gap", "u", "sale_id", "line_no", "line_item_id")]
    return out.select("item_id", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("rank"), *fields, "n_pairs", "gap_sum", "lines_crc")
