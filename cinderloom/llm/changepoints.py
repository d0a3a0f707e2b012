"""Penalised change points of daily series, by best-first search of a range tree over segment starts.

A series is the daily sum of a value, from the first to the last day with rows; days between
count 0. It is cut into segments of at least ``least`` days. With n days, sum S and sum of squares
Q, a segment has spread V = 1 + floor((n Q - S S) / (n n)) and costs n floor(1000 ln V); each cut
costs ``penalty``. The cheapest cutting wins; ties go to the fewest segments, then to the earliest
starts, compared from the last segment backwards.

Search: the best cutting of the first t days ends with a segment that starts at some s. Starts
form a tree of blocks (``FAN`` children a block). For an end day t, a block of starts a to b is
bounded from below by

* the least prefix cost in the block plus the least cost of a segment: the squared error of s..t
  is at least that of b..t (it grows with every day added), and h(n) = n (1000 ln(SSE / n) - 1)
  lies below the cost and is concave in n, so its ends bound it;
* the same with both parts tilted by the series' own cost per day, so that a long prefix with a
  short segment and the reverse are told apart.

The block of least bound opens first, until no block can hold a better or tied start. All series
of a lot take a step together, so the arithmetic is numpy's over the lot.

Defined results: rows with a null value or time are left out; rows whose key is null form one
series with a null key; repeated rows count each; values may be negative; a series shorter than
2 * least days is one segment. An empty table gives no rows. Further columns are ignored. Sums are
exact: series whose squares could leave 64 bits are searched with Python's integers.

Scale: rows become one sum a key and day before any key is gathered, and those sums combine on the
map side, so a key that holds a third of all rows brings as many rows to its task as any other: one
a day. A task holds lots of at most ``CELLS`` days besides its longest series. Nothing is sent to
the driver or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cinderloom.llm.common import map_arrow, pick, slices

LEAST, PENALTY = 14, 40_000
#: Children of a block of starts; days of a lot.
FAN, CELLS = 8, 1 << 19
#: Farther than any cost; a half of it still is.
FAR = 1 << 61


def spread_of(n, s, q):
    """1 + the floored population variance, exactly. Works on 64-bit and on Python integers."""
    return 1 + (n * q - s * s) // (n * n)


def cost_of(n, spread):
    return n * np.floor(1000.0 * np.log(np.asarray(spread).astype(np.float64))).astype(np.int64)


def fits(series: np.ndarray) -> bool:
    """Whether 64 bits hold every n Q - S S of the series."""
    return len(series) * float(np.square(series.astype(np.float64)).sum()) < 2.0**61


class Lot:
    """Series that are searched together. prefix sums are rows padded with their last value."""

    def __init__(self, series: list[np.ndarray], least: int, penalty: int):
        self.n = np.array([len(x) for x in series])
        rows, width = len(series), int(self.n.max()) + 1
        exact = all(map(fits, series))
        kind = np.int64 if exact else object
        self.sum, self.sq = np.zeros((rows, width), kind), np.zeros((rows, width), kind)
        for i, x in enumerate(series):
            x = x if exact else x.astype(object)
            for into, values in ((self.sum, x), (self.sq, x * x)):
                into[i, 1 : len(x) + 1] = np.cumsum(values)
                into[i, len(x) + 1 :] = into[i, len(x)]
        self.least, self.penalty = least, penalty
        self.best = np.full((rows, width), FAR, np.int64)  # of the first t days
        self.parts = np.zeros((rows, width), np.int64)
        self.start = np.zeros((rows, width), np.int64)
        self.best[:, 0] = 0
        every = np.arange(rows)
        whole = cost_of(self.n, spread_of(self.n, self.sum[every, self.n], self.sq[every, self.n]))
        self.tilt = whole / self.n
        # Least prefix cost (with its cut), plain and tilted, of the blocks of FAN, FAN^2, ... starts.
        self.least_of: list[tuple[np.ndarray, np.ndarray]] = []
        blocks = width
        while not self.least_of or blocks > 1:
            blocks = -(-blocks // FAN)
            self.least_of.append((np.full((rows, blocks), np.inf), np.full((rows, blocks), np.inf)))
        self.log = np.log(np.arange(1, width + 1))  # of n, at n - 1
        self.opened = 0

    def _enter(self, lanes: np.ndarray, s: int) -> None:
        """Start s becomes open to later ends."""
        value = (self.best[lanes, s] + (self.penalty if s else 0)).astype(np.float64)
        tilted = value - self.tilt[lanes] * s
        for plain, leaning in self.least_of:
            s //= FAN
            plain[lanes, s] = np.minimum(plain[lanes, s], value)
            leaning[lanes, s] = np.minimum(leaning[lanes, s], tilted)

    def _bounds(self, lanes: np.ndarray, level: int, block: np.ndarray, t: int) -> np.ndarray:
        """No start of the block (one a row and column) ends cheaper at t."""
        plain, leaning = self.least_of[level]
        size = FAN ** (level + 1)
        some = np.minimum(block, plain.shape[1] - 1)
        at = lanes[:, None]
        low = plain[at, some]
        first, last = some * size, np.minimum(some * size + size - 1, t - self.least)
        last = np.maximum(last, 0)
        short, long = t - last, np.maximum(t - first, 1)
        s, q = self.sum[at, t] - self.sum[at, last], self.sq[at, t] - self.sq[at, last]
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.log((short * q - s * s).astype(np.float64)) - self.log[short - 1]  # ln SSE, -inf for 0
            ends = [n * (1000.0 * (error - self.log[n - 1]) - 1.0) for n in (short, long)]
            tilt = self.tilt[at]
            flat = low + np.maximum(np.minimum(*ends), 0.0)
            lean = leaning[at, some] + np.maximum(np.minimum(ends[0] - tilt * short, ends[1] - tilt * long) + tilt * t, tilt * first)
            bound = np.maximum(flat, lean)
            # Lower by more than rounding could have raised it.
            return np.where((block < plain.shape[1]) & np.isfinite(low), bound - 1.0 - 1e-9 * np.abs(bound), np.inf)

    def _offer(self, lanes: np.ndarray, s: np.ndarray, t: int) -> None:
        """Starts s (a row of them for each lane) of the segment that ends at t; the least by cost, segments, start stays."""
        at = lanes[:, None]
        ok = (s <= t - self.least) | ((s == 0) & (t < 2 * self.least))
        s = np.where(ok, s, 0)
        before = self.best[at, s]
        n = t - s
        ok &= before < FAR
        cost = before + np.where(s > 0, self.penalty, 0) + cost_of(n, spread_of(n, self.sum[at, t] - self.sum[at, s], self.sq[at, t] - self.sq[at, s]))
        cost = np.where(ok, cost, FAR)
        parts = self.parts[at, s] + 1
        tied = cost == cost.min(1, keepdims=True)
        few = np.where(tied, parts, FAR)
        tied &= few == few.min(1, keepdims=True)
        pick_ = np.where(tied, s, FAR).argmin(1)  # starts ascend, so the first of the least
        row = np.arange(len(lanes))
        new = (cost[row, pick_], parts[row, pick_], s[row, pick_])
        old = (self.best[lanes, t], self.parts[lanes, t], self.start[lanes, t])
        wins = (new[0] < old[0]) | ((new[0] == old[0]) & ((new[1] < old[1]) | ((new[1] == old[1]) & (new[2] < old[2]))))
        wins &= new[0] < FAR
        to = lanes[wins]
        self.best[to, t], self.parts[to, t], self.start[to, t] = (x[wins] for x in new)

    def _end(self, lanes: np.ndarray, t: int) -> None:
        """The best start for end t of each lane."""
        # Yesterday's best start is a good first offer, and the whole prefix is the other extreme.
        self._offer(lanes, np.stack([np.zeros(len(lanes), np.int64), self.start[lanes, t - 1]], 1), t)
        top = len(self.least_of) - 1
        levels = np.full((len(lanes), 1), top)
        blocks = np.zeros((len(lanes), 1), np.int64)
        bounds = self._bounds(lanes, top, blocks, t)
        child = np.arange(FAN)
        while True:
            row = np.arange(len(lanes))
            first = bounds.argmin(1)
            keep = bounds[row, first] <= self.best[lanes, t]
            if not keep.any():
                return
            if not keep.all():
                lanes, levels, blocks, bounds, first = lanes[keep], levels[keep], blocks[keep], bounds[keep], first[keep]
                row = np.arange(len(lanes))
            self.opened += len(lanes)
            level, block = levels[row, first], blocks[row, first]
            bounds[row, first] = np.inf
            under = block[:, None] * FAN + child
            found = np.full(under.shape, np.inf)
            for k in np.unique(level).tolist():
                of = np.flatnonzero(level == k)
                if k:
                    found[of] = self._bounds(lanes[of], k - 1, under[of], t)
                else:
                    self._offer(lanes[of], under[of], t)
            found[found > self.best[lanes, t][:, None]] = np.inf
            if (useful := np.isfinite(found).any(0)).any():
                some = np.flatnonzero(useful)
                levels = np.concatenate([levels, np.repeat(level[:, None] - 1, len(some), 1)], 1)
                blocks, bounds = np.concatenate([blocks, under[:, some]], 1), np.concatenate([bounds, found[:, some]], 1)

    def solve(self) -> None:
        every = np.arange(len(self.n))
        for t in range(1, int(self.n.max()) + 1):
            s = t - self.least
            if s == 0 or s >= self.least:
                self._enter(every[self.n > s], s)
            lanes = every[(self.n == t) | ((self.n > t) & (t >= self.least))]
            if len(lanes) == 0:
                continue
            if t < 2 * self.least:
                self._offer(lanes, np.zeros((len(lanes), 1), np.int64), t)
            else:
                self._end(lanes, t)

    def segments(self, i: int) -> list[tuple[int, int, int, int, int]]:
        """(first day, days, sum, spread, cost) of series i, in order."""
        out, t = [], int(self.n[i])
        while t:
            s = int(self.start[i, t])
            n, total, squares = t - s, int(self.sum[i, t]) - int(self.sum[i, s]), int(self.sq[i, t]) - int(self.sq[i, s])
            spread = spread_of(n, total, squares)
            out.append((s, n, total, spread, int(cost_of(n, spread))))
            t = s
        return out[::-1]


def solved(series: list[np.ndarray], least: int = LEAST, penalty: int = PENALTY) -> list[tuple[list[tuple[int, int, int, int, int]], int]]:
    """Segments and best cost of each series, by lots of series of like length and the same arithmetic."""
    if least < 1 or penalty < 0:
        raise ValueError("segments have a day at least and cuts cost 0 at least")
    out: list = [None] * len(series)
    exact = [fits(x) for x in series]
    order = sorted(range(len(series)), key=lambda i: (exact[i], len(series[i])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and exact[order[hi]] == exact[order[lo]] and (hi + 1 - lo) * len(series[order[hi]]) <= CELLS:
            hi += 1
        some = order[lo:hi]
        lot = Lot([series[i] for i in some], least, penalty)
        lot.solve()
        for k, i in enumerate(some):
            out[i] = (lot.segments(k), int(lot.best[k, lot.n[k]]))
        lo = hi
    return out


def daily(rows: DataFrame, key: Column | str, value: Column | str, time: Column | str) -> DataFrame:
    """key, days and sums (arrays, any order): one sum a key and day with rows."""
    taken = pick(rows, key=key, value=value, time=time).where(F.col("value").isNotNull() & F.col("time").isNotNull())
    sums = taken.groupBy("key", F.unix_date(F.to_date("time")).cast("long").alias("day")).agg(F.sum(F.col("value").cast("long")).alias("total"))
    by_key = sums.groupBy("key").agg(F.collect_list(F.struct("day", "total")).alias("s"))
    return by_key.select("key", F.col("s.day").alias("days"), F.col("s.total").alias("sums"))


def segments(rows: DataFrame, key: Column | str, value: Column | str, time: Column | str, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """One row a segment: key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost."""
    series = daily(rows, key, value, time)
    kind = series.schema["key"].dataType
    arrow, names = to_arrow_type(kind), ["segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, full = [], []
        for days, sums in zip(*(batch.column(i) for i in (1, 2))):
            days, sums = (x.values.to_numpy() for x in (days, sums))
            first.append(int(days.min()))
            x = np.zeros(int(days.max()) - first[-1] + 1, np.int64)
            x[days - first[-1]] = sums
            full.append(x)
        which, out = [], []
        for i, (parts, best) in enumerate(solved(full, least, penalty)):
            which += [i] * len(parts)
            out += [(k, first[i] + s, n, total, spread, cost, len(parts), best) for k, (s, n, total, spread, cost) in enumerate(parts, 1)]
        columns = list(zip(*out)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())).cast(arrow), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["key", *names])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column(1)).to_pylist()
            for lo, hi in slices(sizes, CELLS):
                yield from one(batch.slice(lo, hi - lo))

    return map_arrow(series, run, f"key {kind.simpleString()}, segment_no int, " + ", ".join(f"{n} bigint" for n in names[1:]))
