"""Exact nearest neighbours: blocks of queries against chunks of points, the best of each chunk merged.

Points are dealt by a hash of their key into groups, and packed there into
blocks that are matrices; so are queries. A task holds one chunk of points, of
bounded size, and a share of the queries goes past it. Rough distances in single
precision or small whole numbers, with a bound on their error, leave out the
pairs that can't be among the ``k`` best of a query so far; the others are
measured in double precision.
A query's lists of the best, one for each chunk, meet by query. Pairs of rows
never exist as rows. If there are several chunks, queries first go past a part
of the points, at most a chunk: what is farther than the ``k``-th of these is in
no list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: Points that a task holds, and those that are compared at once with a block of queries.
CHUNK, TILE = 65_536, 4_096
#: One in so many points gives the bounds that queries start with.
PART = 16
#: Points of the first tile, which give a first bound, and pairs measured at once.
FIRST, PAIRS = 1_024, 1_024
#: Queries whose rough distances from a tile are added up at once, ranges of a variable in bits, and bytes that all bits may take.
ROWS, RANGES, BITS = 64, 48, 1 << 27
METRICS = ("manhattan", "euclidean", "chebyshev")
#: A way to compare rows: its name, the metric, and which of the variables count.
Slot = tuple[str, str, Sequence[int]]


def groups_for(spark, rows: int, block: int = BLOCK) -> int:
    """Groups of points: a block each while there are few, no more than four for each shuffle partition."""
    return max(1, min(-(-rows // block), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _packed(rows: DataFrame, key_type: str, groups: int, block: int, take: str) -> DataFrame:
    """``(g, keys, vals, m)`` from ``(key, val, v)``: blocks of one group in the order of the key; a null component is NaN.

    ``take`` is ``all`` rows, those that are ``whole`` or those with ``gaps``.
    """
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).repartition(groups, "g").sortWithinPartitions("g", "key", "val")

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, vals, ms = None, [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"g": pa.array([now], pa.int32()), "keys": pa.array([keys]), "vals": pa.array([vals], pa.list_(pa.float64())), "m": pa.array([np.concatenate(ms).tobytes()], pa.binary())})

        for batch in it:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten()
            m = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if take != "all":
                mine = np.isnan(m).any(1) == (take == "gaps")
                batch, m = batch.filter(pa.array(mine)), m[mine]
            g, k, v = batch.column("g").to_numpy(), batch.column("key").to_pylist(), batch.column("val").to_pylist()
            at = 0
            while at < len(g):
                end = min(int(np.searchsorted(g, g[at], "right")), at + block - len(keys) if now == g[at] else at + block)
                if now is not None and (g[at] != now or end == at):
                    yield out()
                    keys, vals, ms = [], [], []
                    end = min(int(np.searchsorted(g, g[at], "right")), at + block)
                now = int(g[at])
                keys += k[at:end]
                vals += v[at:end]
                ms.append(m[at:end])
                at = end
        if keys:
            yield out()

    return dealt.select("g", "key", "val", "v").mapInArrow(pack, _blocks(key_type)).withColumn("tops", F.lit(None).cast("binary"))


def _blocks(key_type: str) -> str:
    return f"g int, keys array<{key_type}>, vals array<double>, m binary"


def _exact(a: np.ndarray, b: np.ndarray, q: np.ndarray, p: np.ndarray, metric: str, cols: Sequence[int]) -> np.ndarray:
    """Distances of the pairs ``(q, p)`` in double precision, to nine digits; ``gaps`` is euclidean over the variables that both rows have, scaled up to all of them.

    Rows are fetched whole, some thousand pairs at a time, and their variables added in order.
    """
    out, some = np.zeros(len(q)), list(cols) != list(range(a.shape[1]))
    with np.errstate(all="ignore"):
        for at in range(0, len(q), PAIRS):
            x, y = a[q[at : at + PAIRS]], b[p[at : at + PAIRS]]
            if some:
                x, y = x[:, list(cols)], y[:, list(cols)]
            d = np.ascontiguousarray(np.abs(np.subtract(x, y, out=x), out=x).T)
            total, n = np.zeros(d.shape[1]), 0
            if metric == "gaps":
                there = ~np.isnan(d)
                n = there.sum(0)
                d[~there] = 0.0
            if metric in ("euclidean", "gaps"):
                np.multiply(d, d, out=d)
            for v in d:
                (np.maximum if metric == "chebyshev" else np.add)(total, v, out=total)
            if metric == "gaps":
                total = total * a.shape[1] / n
            out[at : at + PAIRS] = np.round(np.sqrt(total) if metric in ("euclidean", "gaps") else total, 9)
    return out


class Rough:
    """Distances of blocks from a chunk of points, rough, each with a bound on its error.

    They only tell which pairs are measured: all whose rough distance, less the
    bound, is not above the largest one wanted. Squared euclidean distances are
    a product of matrices in single precision. For the other metrics values are
    whole numbers of 16 bits: each variable cut to eight deviations around its
    mean, which makes no distance larger, in steps of one width. Chebyshev
    distances are not added up at all while ``bits`` holds: a bit for each point
    and range of a variable says whether it is near in that one, and a pair is
    close if it is so in all of them.
    """

    def __init__(self, b: np.ndarray, metric: str, cols: Sequence[int]):
        self.metric, self.cols = metric, list(cols)
        self.squared = metric in ("euclidean", "gaps")
        self.scratch: dict[object, np.ndarray] = {}
        b = b[:, self.cols]
        with np.errstate(all="ignore"):
            mean = np.nanmean(b, 0) if len(b) else np.zeros(len(self.cols))
        self.mean = np.where(np.isfinite(mean), mean, 0.0)
        self.large = self._large(b)
        with np.errstate(all="ignore"):
            if not self.squared:
                self._steps(b)
                self.b = self._whole(b)
                #: whether the bits are used, until they leave too many pairs
                self.bits = metric == "chebyshev" and self.fine and 0 < len(self.cols) * (RANGES + 1) * len(b) <= BITS * 4
                if self.bits:
                    self._ranges()
                return
            x = b - self.mean
            there = ~np.isnan(x)
            if metric == "gaps":
                x = np.nan_to_num(x, posinf=np.inf, neginf=-np.inf)
            self.size = self._size(x)
            if metric == "euclidean":
                self.b = np.column_stack([x, np.ones(len(x)), (x * x).sum(1)]).astype(np.float32)
            else:
                self.b, self.there = np.column_stack([there, x * x, x]).astype(np.float32), there.astype(np.float32)

    def _steps(self, b: np.ndarray) -> None:
        """Where each variable starts and ends, and the width of a step: sums of all variables' steps stay within 16 bits."""
        n = max(1, len(self.cols))
        levels = 32_767 if self.metric == "chebyshev" else max(1, min(32_767, 65_535 // n))
        x = np.where(np.isfinite(b), b, np.nan)
        sd, low, top = (f(x, 0) if len(x) else np.zeros(len(self.cols)) for f in (np.nanstd, np.nanmin, np.nanmax))
        self.low, self.top = np.fmax(low, self.mean - 8 * sd), np.fmin(top, self.mean + 8 * sd)
        fine = np.isfinite(self.low) & np.isfinite(self.top) & (self.low <= self.top)
        self.low, self.top = np.where(fine, self.low, 0.0), np.where(fine, self.top, 0.0)
        self.step = float((self.top - self.low).max(initial=0.0) / levels)
        self.fine = 1e-290 < self.step < 1e290
        if not self.fine:  # no steps: every pair is measured
            self.step, self.top = 1.0, self.low
        #: how many steps a distance may be rounded up by
        self.slack = (1 if self.metric == "chebyshev" else n) * (1 + 1e-6) + 1e-3

    def _whole(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.rint((np.clip(x, self.low, self.top) - self.low) / self.step).astype(np.int16).T)

    def _ranges(self) -> None:
        """For each variable the number of the range that a step is in, by ranges of equally many points."""
        self.codes, self.tiles = np.empty(self.b.shape, np.uint8), {}
        self.table = np.empty((len(self.cols), 32_769), np.uint8)
        for table, code, v in zip(self.table, self.codes, self.b):
            ends = np.sort(v[:: max(1, len(v) // 8_192)])
            ends = ends[np.linspace(0, len(ends) - 1, RANGES).astype(int)]
            # the number of ends below a step
            table[:] = np.searchsorted(ends, np.arange(32_769))
            np.take(table, v, out=code)
            table[-1] = RANGES  # beyond all steps

    def _bits(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Points up to the end of each range, and from the start of each range, a bit each."""
        if at.start not in self.tiles:
            n = at.stop - at.start
            up, down = (np.zeros((len(self.cols), RANGES + 1, -(-n // 64)), np.uint64) for _ in range(2))
            ranges = np.arange(RANGES + 1, dtype=np.uint8)[:, None]
            for u, d, code in zip(up, down, self.codes[:, at]):
                u.view(np.uint8)[:, : -(-n // 8)] = np.packbits(code <= ranges, axis=1, bitorder="little")
                d.view(np.uint8)[:, : -(-n // 8)] = np.packbits(code >= ranges, axis=1, bitorder="little")
            self.tiles[at.start] = up, down
        return self.tiles[at.start]

    def within(self, top: np.ndarray, rows: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that ``far`` would leave, or some more: places among ``rows`` and in the tile."""
        up, down = self._bits(at)
        width = np.floor((top + self.shift + 2e-9) / self.step + self.slack)
        width = np.where(width < 65_535, width, 65_535).astype(np.int32)
        a = self.a if len(rows) == self.a.shape[1] else self.a[:, rows]
        found = np.empty((len(rows), up.shape[2]), np.uint64)
        for i in range(0, len(rows), BLOCK):
            x, w, both = a[:, i : i + BLOCK].astype(np.int32), width[i : i + BLOCK], found[i : i + BLOCK]
            both[:] = ~np.uint64(0)
            some = self.room("some", both.shape, np.uint64)
            for v, table, u, d in zip(x, self.table, up, down):
                for steps, bits in ((np.minimum(v + w, 32_768), u), (np.maximum(v - w, 0), d)):
                    np.take(bits, table[steps], axis=0, out=some, mode="clip")
                    np.bitwise_and(both, some, out=both)
        words = np.flatnonzero(found)
        place, bit = np.divmod(np.flatnonzero(np.unpackbits(found.reshape(-1)[words].view(np.uint8), bitorder="little")), 64)
        q, p = np.divmod(words[place], found.shape[1])
        self.bits = len(q) * 16 <= len(rows) * (at.stop - at.start)
        return q, p * 64 + bit

    def _large(self, x: np.ndarray) -> float:
        top = np.nanmax(np.abs(x), initial=0.0)
        return float(top + np.abs(self.mean).max(initial=0.0))

    def _size(self, x: np.ndarray) -> np.ndarray:
        size = (x * x).sum(1)
        return np.where(size < 1e30, size, np.inf)  # what single precision can't hold has no bound

    def queries(self, a: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            a = a[:, self.cols]
            #: what centring may add to a distance, in double precision
            self.shift = 4.0 * 2.0**-53 * (len(self.cols) + 1) * (self.large + self._large(a))
            if not self.squared:
                self.a = self._whole(a)
                return
            x = a - self.mean
            mine = ~np.isnan(x)
            if self.metric == "gaps":
                x = np.nan_to_num(x, posinf=np.inf, neginf=-np.inf)
            self.mine = self._size(x)
            if self.metric == "euclidean":
                self.a = np.column_stack([-2 * x, (x * x).sum(1), np.ones(len(x))]).astype(np.float32)
            else:
                self.a, self.has = np.column_stack([x * x, mine, -2 * x]).astype(np.float32), mine.astype(np.float32)

    def room(self, name: str, shape: tuple[int, int], kind) -> np.ndarray:
        """An array that is used again by the next tile: new ones cost more than what is written into them."""
        size = shape[0] * shape[1]
        if name not in self.scratch or self.scratch[name].size < size:
            self.scratch[name] = np.empty(-(-size // 8) * 8, kind)
        return self.scratch[name][:size].reshape(shape)

    def values(self, at: slice) -> tuple[np.ndarray, np.ndarray | None]:
        """Rough distances, and for ``gaps`` the share of the variables they are over."""
        n = at.stop - at.start
        with np.errstate(all="ignore"):
            if self.squared:
                out = np.matmul(self.a, self.b[at].T, out=self.room("values", (len(self.a), n), np.float32))
                if self.metric == "euclidean":
                    return out, None
                share = np.matmul(self.has, self.there[at].T, out=self.room("share", out.shape, np.float32))
                return out, np.divide(share, np.float32(len(self.cols)), out=share)
        # rows enough that the calls cost little, and few enough that both arrays stay in a core's cache
        out = self.room("values", (self.a.shape[1], n), np.uint16)
        for i in range(0, len(out), ROWS):
            total = out[i : i + ROWS]
            total[:] = 0
            d = self.room("difference", total.shape, np.int16)
            for x, y in zip(self.a[:, i : i + ROWS, None], self.b[:, None, at]):
                np.subtract(x, y, out=d)
                np.abs(d, out=d)
                (np.maximum if self.metric == "chebyshev" else np.add)(total, d.view(np.uint16), out=total)
        return out, None

    def far(self, values: np.ndarray, share: np.ndarray | None, top: np.ndarray, rows: np.ndarray, at: slice) -> np.ndarray:
        """Which pairs of the queries ``rows`` are certainly farther than ``top``; what has no bound isn't."""
        out = self.room("far", values.shape, bool)
        with np.errstate(all="ignore"):
            most = top + self.shift + 2e-9
            if not self.squared:
                most = np.floor(most / self.step + self.slack)
                return np.greater(values, np.where(most < 65_535, most, 65_535).astype(np.uint16)[:, None], out=out)
            most = most * most
            e = 8.0 * 2.0**-24 * (len(self.cols) + 8) * (self.mine[rows] + self.size[at].max(initial=0.0)) + 1e-38
            if share is None:
                most = (np.nextafter(most.astype(np.float32), np.float32(np.inf)) + np.nextafter(e.astype(np.float32), np.float32(np.inf))) * np.float32(1 + 1e-6)
                return np.greater(values, most[:, None], out=out)
            limit = np.multiply(share, (most * (1 + 1e-5)).astype(np.float32)[:, None], out=self.room("limit", values.shape, np.float32))
            limit += (e * (1 + 1e-5)).astype(np.float32)[:, None]
            return np.greater(values, limit, out=out)


def _false(x: np.ndarray) -> np.ndarray:
    """The places of what is false in ``x``, nearly all of which is true; eight at a time."""
    flat = x.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != np.uint64(0x0101010101010101))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[at[~flat[at]], whole + np.flatnonzero(~flat[whole:])]


class Lists:
    """The ``k`` nearest points found so far of the queries ``rows``: flat, in the order of query, distance and point."""

    def __init__(self, rows: np.ndarray, k: int, top: np.ndarray | None = None):
        self.rows, self.k = rows, k
        self.q, self.p, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.top = np.full(len(rows), np.inf) if top is None else top.copy()
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, q: np.ndarray, p: np.ndarray, d: np.ndarray) -> None:
        fine = np.isfinite(d) & (d <= self.top[q])
        self.new.append((q[fine], p[fine], d[fine]))

    def measure(self, a: np.ndarray, b: np.ndarray, rough: Rough, q: np.ndarray, p: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None) -> None:
        if own is not None:
            other = own[0][self.rows[q]] != own[1][p]
            q, p = q[other], p[other]
        self.add(q, p, _exact(a, b, self.rows[q], p, rough.metric, rough.cols))

    def merge(self) -> None:
        q, p, d = (np.concatenate(x) for x in zip((self.q, self.p, self.d), *self.new))
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        first = np.searchsorted(q, np.arange(len(self.rows)))
        rank = np.arange(len(q)) - first[q]
        last = rank == self.k - 1
        self.top[q[last]] = d[last]
        kept = rank < self.k
        self.q, self.p, self.d, self.new = q[kept], p[kept], d[kept], []


def _found(a: np.ndarray, b: np.ndarray, rough: Rough, wanted: Sequence[tuple[np.ndarray, np.ndarray | None]], k: int, own: tuple[np.ndarray, np.ndarray] | None, tops: np.ndarray | None = None) -> list[Lists]:
    """The ``k`` nearest points of each query, exact, for each ``(rows, points)`` of ``wanted``: some of the queries, and a mask of the points that count.

    ``own`` has numbers of the queries and of the points; points of the query's
    number are left out, and so are points farther than ``tops``. After the first tile few pairs are measured: those that
    may be among the ``k`` best so far.
    """
    rough.queries(a)
    lists = [Lists(rows, k, tops) for rows, _ in wanted]
    lo = done = 0
    size = min(FIRST, TILE) if tops is None else TILE
    while lo < len(b):
        at = slice(lo, min(lo + size, len(b)))
        quick = lo > 0 and rough.metric == "chebyshev" and rough.bits
        values, share = (None, None) if quick else rough.values(at)
        last = at.stop >= 2 * done or at.stop == len(b)
        for mine, (rows, points) in zip(lists, wanted):
            there = None if points is None else points[at]
            if quick:
                q, p = rough.within(mine.top, rows, at)
                fine = slice(None) if there is None else there[p]
                mine.measure(a, b, rough, q[fine], p[fine] + lo, own)
                if last:
                    mine.merge()
                continue
            v, s = (values, share) if len(rows) == len(a) else (values[rows], None if share is None else share[rows])
            if lo == 0 and v.shape[1] > k + 1 and not np.isfinite(mine.top).all():
                mine.top = np.fmin(mine.top, _first(a, b, rough, v, s, rows, there, k, own))
            far = rough.far(v, s, mine.top, rows, at)
            if there is not None:
                far |= ~there
            flat = _false(far)
            mine.measure(a, b, rough, flat // far.shape[1], flat % far.shape[1] + lo, own)
            if last:
                mine.merge()
        if last:
            done = at.stop
        lo, size = at.stop, min(2 * size, TILE)
    return lists


def _first(a: np.ndarray, b: np.ndarray, rough: Rough, v: np.ndarray, s: np.ndarray | None, rows: np.ndarray, there: np.ndarray | None, k: int, own: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """For each query a distance that ``k`` points of the first tile are within: those that seem nearest are measured."""
    with np.errstate(all="ignore"):
        near = v.astype(np.float32) if s is None else v / s
        near[np.isnan(near)] = np.inf
    out = np.zeros(near.shape, bool) if there is None else np.broadcast_to(~there, near.shape).copy()
    if own is not None:
        out |= own[0][rows, None] == own[1][None, : near.shape[1]]
    near[out] = np.inf
    p = np.argpartition(near, k, axis=1)[:, :k]
    q = np.repeat(np.arange(len(p)), k)
    d = _exact(a, b, rows[q], p.ravel(), rough.metric, rough.cols)
    d[out[q, p.ravel()] | np.isnan(d)] = np.inf
    return d.reshape(-1, k).max(1)


def _shares(chunks: int, blocks: int, cores: int) -> int:
    """Shares of the queries: some tasks for each core, of numbers that would do the one by which fewest cores wait at the end."""
    least = -(-4 * cores // chunks)
    return max(1, min(blocks, min(range(least, 2 * least + 1), key=lambda n: (-(-chunks * n // cores) / (chunks * n), n))))


def _met(q: DataFrame, p: DataFrame, chunks: int, shares: int) -> DataFrame:
    """``(cell, side, keys, vals, m, tops)``: a partition for each cell, which holds a chunk of the points (side 0) and then a share of the queries (side 1).

    A chunk is bounded, so the lists of a query are as many as there are chunks.
    """

    def dealt(x: DataFrame, mine: int, others: int, side: int) -> DataFrame:
        other, own = F.explode(F.sequence(F.lit(0), F.lit(others - 1))), F.col("g") % mine
        x = x.select(own.alias("own"), other.alias("other"), F.lit(side).alias("side"), "g", "keys", "vals", "m", "tops")
        return x.select((F.col("own") + F.col("other") * chunks if side == 0 else F.col("other") + F.col("own") * chunks).cast("int").alias("cell"), "side", "g", "keys", "vals", "m", "tops")

    both = dealt(p, chunks, shares, 0).unionByName(dealt(q, shares, chunks, 1))
    return both.repartitionById(chunks * shares, "cell").sortWithinPartitions("cell", "side")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``(slot, key, near)``: the best ``k`` of the chunks' lists, as ``(d, other, val)``."""
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return found.groupBy("slot", "key").agg(near.alias("near"))


def _small_batches(spark, size: int = 64 << 20) -> None:
    """Limit what a worker gets at once to ``size`` bytes: a row holds a block. The session keeps the setting, as a plan reads it when it runs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > size:
        spark.conf.set(name, str(size))


def _compare(queries: DataFrame, points: DataFrame, key_type: str, k: int, slots: Sequence[Slot] | None, cols: Sequence[str], apart: bool, block: int, take: tuple[str, str]) -> DataFrame:
    """The lists of ``_met``'s cells, merged; without ``slots`` the donors of each gap, by column."""
    spark = points.sparkSession
    _small_batches(spark)
    kind = f"slot string, key {key_type}, near array<struct<d:double,other:{key_type},val:double>>"
    key = pa.int64() if key_type == "bigint" else pa.string()

    def lists(slot: str, qkeys: pa.Array, got: Lists, keys: pa.Array, vals: pa.Array) -> pa.RecordBatch:
        ends = np.r_[0, np.cumsum(np.bincount(got.q, minlength=len(got.rows)))].astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(got.d), keys.take(pa.array(got.p)), vals.take(pa.array(got.p))], ["d", "other", "val"])
        return pa.RecordBatch.from_arrays([pa.array([slot] * len(got.rows), pa.string()), qkeys.take(pa.array(got.rows)), pa.ListArray.from_arrays(pa.array(ends), items)], ["slot", "key", "near"])

    def asked(qkeys: pa.Array, a: np.ndarray, tops: np.ndarray | None, keys: pa.Array, b: np.ndarray, vals: pa.Array, rough: list[tuple[str, Rough]]) -> Iterator[tuple[str, Lists]]:
        if slots is None:
            gaps, there = np.isnan(a), ~np.isnan(b)
            mine = [j for j in range(a.shape[1]) if gaps[:, j].any() and there[:, j].any()]
            for j, got in zip(mine, _found(a, b, rough[0][1], [(np.flatnonzero(gaps[:, j]), there[:, j]) for j in mine], k, None)):
                yield lists(cols[j], qkeys, got, keys, pa.array(b[:, j])), got
            return
        own = None
        if apart:
            number = {x: i for i, x in enumerate(keys.to_pylist())}
            own = np.array([number.get(x, -1) for x in qkeys.to_pylist()]), np.array([number[x] for x in keys.to_pylist()])
        for i, (name, way) in enumerate(rough):
            got = _found(a, b, way, [(np.arange(len(a)), None)], k, own, None if tops is None else tops[i])[0]
            yield lists(name, qkeys, got, keys, vals), got

    def bounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with the distance of the ``k``-th point for each slot, or infinity."""
        for row, got in run(it, True):
            tops = b"".join(x.top.tobytes() for _, x in got) or None
            kept = [c for c in row.schema.names if c in ("g", "keys", "vals", "m")]
            yield pa.RecordBatch.from_arrays([*[row.column(c) for c in kept], pa.array([tops], pa.binary())], [*kept, "tops"])

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in run(it, False):
            for batch, _ in got:
                yield batch

    def run(it: Iterator[pa.RecordBatch], empty: bool):
        """Each block of queries and its lists; with ``empty`` also blocks that meet no points."""
        cell, held, chunk = None, [], None
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if row["cell"].as_py() != cell:
                    cell, held, chunk = row["cell"].as_py(), [], None
                keys = row["keys"].values.cast(key)
                m = np.frombuffer(row["m"].as_buffer(), np.float64).reshape(len(keys), -1)
                if row["side"].as_py() == 0:
                    held.append((keys, row["vals"].values, m.copy()))
                    continue
                if not held:
                    if empty:
                        yield batch.slice(i, 1), []
                    continue
                if chunk is None:  # points in the order of their keys, so that ties go to the earlier place
                    keys_, vals_, b = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
                    order = pc.sort_indices(pa.table({"key": keys_, "val": vals_}), [("key", "ascending"), ("val", "ascending")])
                    b = b[order.to_numpy()]
                    rough = [(n, Rough(b, w, c)) for n, w, c in slots] if slots is not None else [("", Rough(b, "gaps", range(len(cols))))]
                    chunk, held = (keys_.take(order), b, vals_.take(order), rough), [()]
                tops = row["tops"].as_buffer()
                yield batch.slice(i, 1), list(asked(keys, m, None if tops is None else np.frombuffer(tops, np.float64).reshape(-1, len(keys)), *chunk))

    n, asking, cores = points.count(), queries.count(), spark.sparkContext.defaultParallelism
    chunks, blocks = max(1, -(-n // CHUNK)), -(-asking // block)
    shares, few = _shares(chunks, blocks, cores), _shares(1, blocks, cores)

    def packed(x: DataFrame, rows: int, parts: int, which: str) -> DataFrame:
        return _packed(x, key_type, -(-groups_for(spark, rows, block) // parts) * parts, block, which)

    q = packed(queries, asking, shares, take[0])
    if slots is not None and chunks > 1:
        part = max(PART, chunks)
        some = points.where(F.pmod(F.xxhash64(F.lit(PART), "key"), F.lit(part)) == 0)
        q = _met(q, packed(some, -(-n // part), 1, take[1]), 1, few).mapInArrow(bounds, f"{_blocks(key_type)}, tops binary")
    return _merged(_met(q, packed(points, n, chunks, take[1]), chunks, shares).mapInArrow(found, kind), k)


def _keyed(df: DataFrame, key: str, cols: Sequence[str], val: F.Column) -> tuple[DataFrame, str]:
    kind = "bigint" if dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else "string"
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(F.col(key).cast(kind).alias("key"), val.cast("double").alias("val"), v.alias("v")).where("key is not null"), kind


def nearest(queries: DataFrame, points: DataFrame, key: str, cols: Sequence[str], k: int, val: str | None = None, slots: Sequence[Slot] | None = None, apart: bool = False, block: int = BLOCK) -> DataFrame:
    """``(slot, key, near)``: for each query and slot the ``k`` nearest points as ``(d, other, val)``, nearest first.

    ``d`` is rounded to nine digits, ties go to the smaller key. Rows without a
    key or with a missing value take no part; ``apart`` keeps a row from being
    its own neighbour. Fewer points than ``k`` give shorter lists.
    """
    slots = list(slots or [("euclidean", "euclidean", range(len(cols)))])
    p, kind = _keyed(points, key, cols, F.col(val) if val else F.lit(None))
    q, _ = _keyed(queries, key, cols, F.lit(None))
    return _compare(q, p, kind, k, slots, cols, apart, block, ("whole", "whole"))


def donors(df: DataFrame, key: str, cols: Sequence[str], k: int, block: int = BLOCK) -> DataFrame:
    """``(slot, key, near)``: for each gap, ``slot`` being its column, the ``k`` nearest rows that have the value ``val``."""
    x, kind = _keyed(df, key, cols, F.lit(None))
    return _compare(x, x, kind, k, None, cols, False, block, ("gaps", "all"))


def vote(near: F.Column, k: int) -> F.Column:
    """The most frequent ``val`` of the first ``k``; ties go to the smaller one."""
    votes = F.slice(F.transform(near, lambda x: x["val"]), 1, k)
    return -F.array_max(F.transform(F.array_distinct(votes), lambda x: F.struct(F.size(F.filter(votes, lambda y: y == x)).alias("n"), (-x).alias("m"))))["m"]
