"""Fréchet distances of resampled vector sets in any dimension.

Vectors are never repeated. Each row gets its place in its population, and the counts
of all repetitions follow from places (``weights``). A task folds its rows to the
count-weighted moments of every repetition, so what is merged has a size that
depends on repetitions and dimension, not on rows.

A row's place is its rank by a hash of its id: buckets of the hash are counted first, and ranks
within a bucket are added to the counts before it, so no population is sorted in one
task. Vectors move once, in the order of key and hash, so a task meets few
keys and sends few partials. A key with fewer rows than twice its dimension is
smaller than its moments: its rows meet in one task instead, and where they span
less than the space, distances are taken inside their span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.operators import distance as dist
from drift_atlas.operators import order
from drift_atlas.operators.moments import FAN_IN
from drift_atlas.operators.weights import Counts

#: Bits of the hash that make a bucket; rows folded at once; bytes of a partial.
BUCKET_BITS, FOLD_ROWS, PARTIAL_BYTES = 10, 1024, 4 << 20

_PARTIAL = "key string, block int, pop int, part long, reps int, payload binary"
_DISTANCE = "key string, rep long, fmd double"


class Plan:
    """What is resampled. Sides: of two sets (0 and 1) that are compared, or 0 alone for halves."""

    def __init__(self, kind: str, reps: int, seed: str, cap: int | None = None):
        if kind not in ("halves", "drawn", "relabelled"):
            raise ValueError(f"unknown resampling {kind!r}")
        self.kind, self.reps, self.seed, self.cap = kind, reps, seed, cap

    def counts(self, key: str, pop: int, n0: int, n1: int) -> Counts:
        seed = f"{self.seed}|{self.kind}|{key}|{pop}"
        if self.kind == "halves":
            return Counts(seed, n0, self.reps, dealt=(n0 // 2, n0 // 2))
        if self.kind == "relabelled":
            return Counts(seed, n0 + n1, self.reps, dealt=(n0, n1))
        n = n1 if pop else n0
        return Counts(seed, n, self.reps, draws=n if self.cap is None else min(n, self.cap))

    def sides(self) -> int:
        """Sides that one population's counts tell apart."""
        return 1 if self.kind == "drawn" else 2

    def block(self, d: int) -> int:
        """Repetitions whose moments fit into one partial."""
        return max(1, PARTIAL_BYTES // (8 * self.sides() * (1 + d + d * (d + 1) // 2)))


class Moments:
    """Count-weighted n, mean and centred second moment (upper triangle) of some repetitions."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, second: np.ndarray):
        self.n, self.mean, self.second = n, mean, second

    @classmethod
    def of(cls, counts: np.ndarray, rows: np.ndarray) -> Moments:
        """Of rows with counts (repetitions by rows); one product of matrices serves all repetitions."""
        i, j = np.triu_indices(rows.shape[1])
        shift = rows.mean(axis=0)
        moved = rows - shift
        n = counts.sum(axis=1)
        mean = (counts @ moved) / np.maximum(n, 1)[:, None]
        second = counts @ (moved[:, i] * moved[:, j]) - n[:, None] * mean[:, i] * mean[:, j]
        return cls(n, mean + shift, second)

    def merged(self, other: Moments) -> Moments:
        """Chan's update, for all repetitions at once; a side without rows changes nothing."""
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        gap = other.mean - self.mean
        i, j = np.triu_indices(gap.shape[1])
        second = self.second + other.second + gap[:, i] * gap[:, j] * (self.n * share)[:, None]
        return Moments(n, self.mean + gap * share[:, None], second)

    def cov(self, k: int) -> np.ndarray:
        d = self.mean.shape[1]
        out = np.zeros((d, d))
        if self.n[k] > 1:
            out[np.triu_indices(d)] = self.second[k] / (self.n[k] - 1)
            out += np.triu(out, 1).T
        return out

    def pack(self) -> np.ndarray:
        return np.concatenate((self.n[:, None], self.mean, self.second), axis=1)

    @classmethod
    def unpack(cls, packed: np.ndarray) -> Moments:
        width = packed.shape[1]
        d = int(round((np.sqrt(9 + 8 * (width - 1)) - 3) / 2))
        return cls(packed[:, 0], packed[:, 1 : d + 1], packed[:, d + 1 :])


def _send(sides: list[Moments]) -> bytes:
    return np.stack([m.pack() for m in sides]).astype("<f8").tobytes()


def _receive(payload: bytes, sides: int, reps: int) -> list[Moments]:
    return [Moments.unpack(x) for x in np.frombuffer(payload, "<f8").reshape(sides, reps, -1)]


_SENT = pa.schema([("key", pa.string()), ("block", pa.int32()), ("pop", pa.int32()), ("part", pa.int64()), ("reps", pa.int32()), ("payload", pa.binary())])


def _by_side(plan: Plan, counts: np.ndarray) -> list[np.ndarray]:
    return [counts] if plan.sides() == 1 else [np.maximum(counts, 0), np.maximum(-counts, 0)]


def _fold(plan: Plan):
    """A task's partials; rows come in the order of key, population and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, counts, held, waiting = None, None, [], []

        def fold() -> None:
            if not waiting:
                return
            places, rows = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            waiting.clear()
            of_rows = counts.of(places)
            for b, first in enumerate(range(0, plan.reps, step)):
                new = [Moments.of(c[first : first + step], rows) for c in _by_side(plan, of_rows)]
                if b == len(held):
                    held.append(new)
                else:
                    held[b] = [x.merged(y) for x, y in zip(held[b], new)]

        def send() -> Iterator[pa.RecordBatch]:
            fold()
            for b, sides in enumerate(held):
                yield pa.RecordBatch.from_pylist([{"key": current[0], "block": b, "pop": current[1], "part": part, "reps": len(sides[0].n), "payload": _send(sides)}], _SENT)
            held.clear()

        for batch in batches:
            keys, pops = batch.column("key").to_pylist(), batch.column("pop").to_numpy()
            new = np.array([k == 0 or keys[k] != keys[k - 1] or pops[k] != pops[k - 1] for k in range(len(keys))], bool)
            starts = np.flatnonzero(new).tolist()
            for first, last in zip(starts, [*starts[1:], len(keys)]):
                d = len(batch.column("embedding")[first])
                if current != (keys[first], pops[first]):
                    yield from send()
                    current = keys[first], int(pops[first])
                    n0, n1 = (batch.column(c)[first].as_py() for c in ("n0", "n1"))
                    counts, step = plan.counts(*current, n0, n1), plan.block(d)
                for k in range(first, last, FOLD_ROWS):
                    own = batch.slice(k, min(FOLD_ROWS, last - k))
                    waiting.append((own.column("place").to_numpy(), np.array(own.column("embedding").flatten(), float).reshape(own.num_rows, d)))
                    if sum(len(w[0]) for w in waiting) >= FOLD_ROWS:
                        fold()
        yield from send()

    return run


def _total(plan: Plan, group: pd.DataFrame) -> list[Moments]:
    total: list[Moments] | None = None
    for reps, payload in zip(group["reps"], group["payload"]):
        sides = _receive(payload, plan.sides(), reps)
        total = sides if total is None else [x.merged(y) for x, y in zip(total, sides)]
    return total


def _merge(plan: Plan):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[:1]
        return first.assign(part=first["part"] // FAN_IN, payload=[_send(_total(plan, group))])[["key", "block", "pop", "part", "reps", "payload"]]

    return run


def _distances_of_moments(plan: Plan):
    """Distances of one block of repetitions from what is left of its partials."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [m for _, own in group.sort_values("pop").groupby("pop") for m in _total(plan, own)]
        if len(sides) < 2:
            return pd.DataFrame({"key": [], "rep": [], "fmd": []})
        a, b = sides
        first = int(group["block"].iloc[0]) * plan.block(a.mean.shape[1])
        fmd = [dist.frechet(a.mean[k], a.cov(k), b.mean[k], b.cov(k)) if a.n[k] and b.n[k] else None for k in range(len(a.n))]
        return pd.DataFrame({"key": group["key"].iloc[0], "rep": range(first, first + len(fmd)), "fmd": fmd})

    return run


def _distances_of_rows(plan: Plan):
    """Distances of all repetitions of a key whose rows are few."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pop", "ascending"), ("hash", "ascending"), ("name", "ascending"), ("side", "ascending")])
        key, n0, n1 = (table.column(c)[0].as_py() for c in ("key", "n0", "n1"))
        rows = np.array(table.column("embedding").combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        pops = table.column("pop").to_numpy()
        sides: list[tuple[np.ndarray, np.ndarray]] = []
        for pop in np.unique(pops):
            own = rows[pops == pop]
            sides += [(own, c) for c in _by_side(plan, plan.counts(key, int(pop), n0, n1).of(np.arange(len(own))))]
        fmd: list[float | None] = [None] * (plan.reps if len(sides) == 2 else 0)
        for k in range(len(fmd)):
            a, b = (np.repeat(own, c[k].astype(int), axis=0) for own, c in sides)
            if len(a) and len(b):
                fmd[k] = dist.frechet_low_rank(a, b) if len(a) + len(b) <= rows.shape[1] else _dense(a, b)
        return pa.table({"key": pa.array([key] * len(fmd), pa.string()), "rep": pa.array(range(len(fmd)), pa.int64()), "fmd": pa.array(fmd, pa.float64())})

    return run


def _dense(a: np.ndarray, b: np.ndarray) -> float:
    cov = lambda x: np.cov(x, rowvar=False).reshape(x.shape[1], -1) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
    return dist.frechet(a.mean(axis=0), cov(a), b.mean(axis=0), cov(b))


def sized_join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """A join that broadcasts the table if it has few rows, which is checked."""
    return rows.join(order.settled(table), on)


def distances(rows: DataFrame, keys: list[str], plan: Plan, id_col: str = "row_id") -> DataFrame:
    """The distance of every repetition of every key: the keys, rep, fmd.

    ``rows`` has the keys, ``side`` (0 or 1), an id and an embedding whose dimension is
    that of its key. ``halves`` deals the rows of side 0 to two halves (of an odd number,
    one row stays out); ``drawn`` draws from both sides with replacement, as many rows as
    each has or the cap; ``relabelled`` deals the rows of both sides anew to sides of the
    same sizes. A key that lacks a side has no rows; a null embedding counts for nothing;
    a resample without rows on a side has a null distance.
    """
    kinds = rows.select(*keys).schema
    known = rows.where(F.col("embedding").isNotNull())
    known = known.where("side = 0") if plan.kind == "halves" else known
    pop = F.col("side") if plan.kind == "drawn" else F.lit(0)
    named = known.select(F.to_json(F.struct(*keys)).alias("key"), pop.cast("int").alias("pop"), F.col("side").cast("int").alias("side"), F.col(id_col).cast("string").alias("name"), "embedding")
    named = named.withColumn("hash", F.xxhash64("name", "side")).withColumn("bucket", F.shiftright("hash", 64 - BUCKET_BITS))
    counted = named.groupBy("key", "pop", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    whole = Window.partitionBy("key")
    before = F.sum("n").over(Window.partitionBy("key", "pop").orderBy("bucket")) - F.col("n")
    starts = counted.select("key", "pop", "bucket", before.alias("start"), F.sum("c0").over(whole).alias("n0"), F.sum("c1").over(whole).alias("n1"))
    met = sized_join(named, starts, ["key", "pop", "bucket"])
    if plan.kind != "halves":
        met = met.where("n0 > 0 and n1 > 0")
    small = F.col("n0") + F.col("n1") <= 2 * F.size("embedding")
    few = met.where(small).select("key", "pop", "side", "hash", "name", "n0", "n1", "embedding").groupBy("key").applyInArrow(_distances_of_rows(plan), _DISTANCE)

    place = F.row_number().over(Window.partitionBy("key", "pop", "bucket").orderBy("hash", "name", "side")) - 1
    many = met.where(~small).repartitionByRange("key", "pop", "bucket").withColumn("place", F.col("start") + place)
    parts = many.select("key", "pop", "side", "place", "n0", "n1", "embedding").mapInArrow(_fold(plan), _PARTIAL)
    parts = parts.groupBy("key", "block", "pop", F.floor(F.col("part") / FAN_IN).alias("level")).applyInPandas(_merge(plan), _PARTIAL)
    met_again = parts.groupBy("key", "block").applyInPandas(_distances_of_moments(plan), _DISTANCE)
    out = few.unionByName(met_again).select(F.from_json("key", kinds).alias("k"), "rep", "fmd")
    return out.select(*[F.col("k")[k].alias(k) for k in keys], "rep", "fmd")
