"""The band join against all pairs, its plan of regions, and awkward rows."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from drift_atlas.llm import band_join

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double"
ITEMS = "item_id long, price double"


def to_cents(x):
    return None if x is None or math.isnan(x) or abs(100.0 * x) >= 2.0**53 else math.floor(100.0 * x + 0.5)


def brute(lines, items):
    """A sorted list of the result's rows, by comparing all pairs."""
    units = []
    for sale, no, item, quantity, amount in lines:
        a = to_cents(amount)
        if None not in (sale, item, quantity, a) and quantity:
            units.append((math.floor((2 * a + quantity) // (2 * quantity)), sale, no, item))
    out = []
    for item, price in items:
        p, pairs = to_cents(price), []
        if item is not None and p is not None:
            pairs = [(abs(u - p), u, s, n, i) for u, s, n, i in units if i != item and (abs(u - p) <= 50 or 1000 * abs(u - p) <= 5 * min(u, p))]
        pairs.sort(key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or 0, x[4]))
        sums = len(pairs), sum(x[0] for x in pairs), sum(zlib.crc32(f"{x[2]},{'' if x[3] is None else x[3]},{x[4]}".encode()) for x in pairs)
        out += [(item, k + 1, *x, *sums) for k, x in enumerate(pairs[:10])] or [(item, 0, *[None] * 5, *sums)]
    return sorted(out, key=str)


def made(seed, n_lines, n_items, top_price=60_000, hot=0.33):
    rng = random.Random(seed)
    prices = [round(math.exp(rng.uniform(0, math.log(top_price / 100))), 2) for _ in range(n_items)]
    items = [(k, 3.0 if rng.random() < hot else x) for k, x in enumerate(prices)]
    lines = []
    for k in range(n_lines):
        item = 7 % n_items if rng.random() < hot else rng.randrange(n_items)
        q = rng.randint(1, 9)
        lines.append((rng.randint(0, n_lines), rng.choice([1, 2, 3, None]), item, q, round(items[item][1] * q * rng.choice([1, 1, 0.99, 0.95]), 2)))
    return lines, items


def run(spark, lines, items, **kw):
    clash = {c: F.lit(f"clash {c}") for c in ("u", "p", "v", "cell", "square", "kind", "item", "n", "crc", "top", "copy", "place")}
    out = band_join.near_prices(spark.createDataFrame(lines, LINES).withColumns(clash), spark.createDataFrame(items, ITEMS).withColumns(clash), **kw)
    assert out.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("load", [40, 400, 50_000])
def test_pairs_against_all_pairs(spark, load):
    """Small loads make many regions and grids, large ones a single region."""
    lines, items = made(5, 700, 90)
    assert run(spark, lines, items, load=load) == brute(lines, items)


def test_an_item_that_owns_its_whole_neighbourhood(spark):
    """Lines of other items lie beyond hundreds of an item's own, at many unit prices and at one."""
    lines = [(k, 1, 1, 1, 5.0 + (k % 40) / 100) for k in range(600)] + [(1000 + k, 1, 1, 1, 5.0) for k in range(90)]
    lines += [(2000 + k, k % 2, 2 + k % 3, 1, 5.3 + k / 100) for k in range(15)]
    items = [(1, 5.0), (2, 5.2), (3, 5.0), (9, 5.41)]
    assert run(spark, lines, items, load=60) == brute(lines, items)
    assert run(spark, lines, items) == brute(lines, items)


def test_awkward_rows(spark):
    """Nulls in every column, broken numbers, repeated lines and items, negative and zero amounts and quantities."""
    lines, items = made(6, 200, 30)
    lines += lines[:20] + lines[:5]
    lines += [(None, 1, 3, 1, 3.0), (1, None, 3, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 3, None, 3.0), (1, 1, 3, 1, None), (1, 1, 3, 0, 3.0), (1, 1, 3, -2, -6.0), (1, 1, 3, -2, 6.0), (1, 2, 3, 1, -0.3)]
    lines += [(2, 1, 3, 1, math.nan), (2, 1, 3, 1, math.inf), (2, 1, 3, 1, -math.inf), (2, 1, 3, 1, 1e300), (2, 2, 4, 1, 123456789.01), (2, 3, 4, 3, 370370367.0)]
    items += items[:3] + [(None, 3.0), (4, None), (None, None), (40, math.nan), (41, math.inf), (42, -0.2), (43, 0.0), (44, 123456800.0), (3, 3.5)]
    got = run(spark, lines, items)
    assert got == brute(lines, items)
    assert run(spark, lines, items, load=50) == got


def test_empty_tables(spark):
    lines, items = made(7, 30, 6)
    assert run(spark, [], []) == [] and run(spark, lines, []) == []
    assert run(spark, [], items) == brute([], items)


def test_cells_are_in_order_and_cover_all_prices(spark):
    rng = random.Random(2)
    values = sorted({0, 1, -1, 2047, 2048, 2049, -2048, *(rng.randint(-(1 << rng.randint(1, 53)), 1 << rng.randint(1, 53)) for _ in range(400))})
    cells = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).select(band_join._cell(F.col("v"))).collect()]
    assert cells == sorted(cells)
    for v, c in zip(values, cells):
        low, high = band_join._cell_span(c)
        assert low <= v <= high


def test_regions_split_the_load():
    rng = random.Random(1)
    histogram = [(c, rng.randint(0, 50), rng.randint(0, 90)) for c in range(200, 3000)] + [(300, 6000, 90_000)]
    regions = band_join.plan_regions(histogram, load=20_000)
    assert len(regions) > 4 and any(r.item_parts * r.line_parts > 1 for r in regions)
    assert all(a.last < b.first for a, b in zip(regions, regions[1:]))
    assert len(band_join.plan_regions(histogram, load=1, most=64)) <= 64
    assert band_join.plan_regions([]) == [] and band_join.plan_regions([(5, 0, 10)]) == []
