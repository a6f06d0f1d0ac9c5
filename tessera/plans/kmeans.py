"""k-means clustering.

Points are assigned and summed in Arrow batches with numpy: a batch is taken
in blocks of a bounded number of bytes, centre after centre, so memory doesn't
grow with the number of centres. Each task emits one (cluster, count, sums)
row per cluster it met; per round one row per cluster comes back to the
driver. Centres go out as one broadcast variable per round (k x d numbers, a
bound set by the parameters).

``kmeans`` does the same rounds, but a pass over all points serves many of
them. A point whose nearest centre is nearer than any other by more than both
have moved since still belongs to it, so only points near a border are compared
again: those of the last rounds on the driver (``NEAR_BYTES`` at most, the
points nearest to a border), else a kept frame of a sixteenth of the points.
When the centres have moved too far for that, all points are compared again.

Rule: squared Euclidean distance over all dimensions, strict ``<`` so the
lowest centre index wins a tie, and a point whose distances are all NaN goes
to centre 0. A NULL vector belongs to no cluster. ``nearest_center`` is the
same rule as a column expression.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions.exprs import unit_hash

#: Bytes of points that are compared with a centre at once.
BLOCK_BYTES = 4 << 20

#: Bytes of points, as doubles, that a pass hands to the driver for the rounds up to the next
#: pass; sums of tasks that are larger together are added up before they go there.
NEAR_BYTES = 64 << 20

#: A frame of the points near a border has this share of the points.
LEVEL_SHARE = 16

#: The centres of so many rounds are kept, to foresee how they go on.
PATH = 9

#: Margins are counted in this many buckets, four for each power of two.
BUCKETS = 1024


def as_points(df: DataFrame, vector_col: str, id_col: str | None = None) -> DataFrame:
    """(id?, p array<double>) from any numeric array column."""
    cols = ([F.col(id_col)] if id_col else []) + [F.col(vector_col).cast("array<double>").alias("p")]
    return df.select(*cols)


def centers_literal(centers: list[list[float]]) -> Column:
    """The k x d centres as one array<array<double>> constant.

    Sent as a single JSON text (Python's float repr and the JVM's double
    parser round-trip exactly) and folded to a literal by the optimizer, so
    the plan does not grow by k x d expression nodes.
    """
    text = json.dumps([[float(x) for x in c] for c in centers])
    return F.from_json(F.lit(text), "array<array<double>>")


def nearest_center(p: Column, centers: list[list[float]]) -> Column:
    """Index of the closest centre (ties → lowest index; NaN point → 0; NULL → NULL).

    Σ_d (p[d] - c[d])² is folded left to right; the minimum of the
    (distance, index) structs takes the lowest index on a tie and ranks NaN
    last, so an all-NaN point lands on centre 0.
    """
    def dist(c, i):
        sq = F.zip_with(p, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x).alias("d"), i.alias("i"))

    return F.when(p.isNotNull(), F.array_min(F.transform(centers_literal(centers), dist))["i"])


def assign_sql(points: DataFrame, centers: list[list[float]], out: str = "cluster") -> DataFrame:
    return points.withColumn(out, nearest_center(F.col("p"), centers))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The non-null vectors of a batch, as a matrix."""
    column = column.drop_null()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"every point must have {dim} coordinates")
    return flat.reshape(len(column), dim)


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the closest centre of each point, in blocks of bounded size."""
    out = np.zeros(len(points), np.int64)
    rows = max(1, BLOCK_BYTES // (8 * centers.shape[1]))
    for a in range(0, len(points), rows):
        block = points[a : a + rows]
        best = np.full(len(block), np.inf)
        for j, c in enumerate(centers):
            d = block - c
            d *= d
            d = d.sum(axis=1)
            closer = d < best
            best[closer] = d[closer]
            out[a : a + rows][closer] = j
    return out


def assign_arrow(points: DataFrame, centers: list[list[float]], out: str = "cluster") -> DataFrame:
    """Arrow/numpy assignment keeping all input columns."""
    c = np.asarray(centers, dtype=np.float64)
    schema = StructType(list(points.schema.fields) + [StructField(out, IntegerType())])

    def part(batches):
        for b in batches:
            column = b.column("p")
            known = np.flatnonzero(np.asarray(column.is_valid()))
            nearest = np.zeros(len(column), np.int32)
            nearest[known] = _nearest(_vectors(column, c.shape[1]), c)
            mask = np.ones(len(column), bool)
            mask[known] = False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest, pa.int32(), mask=mask)], names=[*b.schema.names, out])

    return points.mapInArrow(part, schema)


def cluster_sums(points: DataFrame, centers: list[list[float]], handle=None) -> DataFrame:
    """(cluster, n, s): points and coordinate sums of every cluster that has points.

    ``handle``: a broadcast variable of the centres, otherwise they travel
    with the task. A task emits one row per cluster, with its sums as an array.
    """
    own = None if handle else np.asarray(centers, dtype=np.float64)

    def part(batches):
        c = handle.value if handle else own
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for b in batches:
            p = _vectors(b.column("p"), c.shape[1])
            if not len(p):
                continue
            nearest = _nearest(p, c)
            order = np.argsort(nearest, kind="stable")
            at, starts, counts = np.unique(nearest[order], return_index=True, return_counts=True)
            n[at] += counts
            rows = max(1, BLOCK_BYTES // (8 * c.shape[1]))
            for j, a, k in zip(at, starts, counts, strict=True):
                for first in range(a, a + k, rows):
                    s[j] += p[order[first : min(first + rows, a + k)]].sum(axis=0)
        met = np.flatnonzero(n)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(list(s[met]), pa.list_(pa.float64()))], names=["cluster", "n", "s"])

    partial = points.select("p").mapInArrow(part, "cluster int, n long, s array<double>")
    sums = partial.select("cluster", "n", F.posexplode("s").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("s"))
    return whole.select("cluster", "n", F.col("s.x").alias("s"))


@dataclass
class KMeansResult:
    centers: list[list[float]]
    rounds: int
    converged: bool
    moves: list[float] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    passes: int = 0  # over frames of points; the other rounds only touched points near a border


def initial_centers(points: DataFrame, k: int, key: str, seed: int = 1) -> list[list[float]]:
    """k distinct points, uniformly by hash of the key (bounded heap of k)."""
    rows = (points.where(F.col("p").isNotNull()).withColumn("__h", unit_hash(key, seed=seed))
            .orderBy("__h", key).limit(int(k)).select("p").collect())
    return [list(r["p"]) for r in rows]


def kmeans_step(points: DataFrame, centers: list[list[float]]):
    """One round: new centres (empty cluster keeps its centre), squared move, sizes."""
    new, sizes = np.array(centers, dtype=np.float64), [0] * len(centers)
    handle = points.sparkSession.sparkContext.broadcast(new.copy())
    try:
        rows = cluster_sums(points, centers, handle).collect()  # one row per cluster
    finally:
        handle.destroy()
    for r in rows:
        new[r["cluster"]] = np.asarray(r["s"]) / r["n"]
        sizes[r["cluster"]] = r["n"]
    move = float(((new - np.asarray(centers)) ** 2).sum())
    return new.tolist(), move, sizes


def _block(points: np.ndarray) -> bytes:
    """The matrix as bytes: of floats where that loses nothing, else of doubles."""
    with np.errstate(over="ignore"):
        short = points.astype(np.float32)
    return (short if np.array_equal(short, points) else points.astype(np.float64)).tobytes()


def _unblock(n: int, block, dim: int) -> np.ndarray:
    kind = np.float32 if len(block) == 4 * n * dim else np.float64
    return np.frombuffer(block, kind).reshape(n, dim).astype(np.float64, copy=False)


def _packed(points: DataFrame, dim: int) -> DataFrame:
    """(n, block): the non-null vectors, so many in a row that they are read at once."""
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def part(batches):
        for b in batches:
            p = _vectors(b.column("p"), dim)
            for a in range(0, len(p), rows):
                x = p[a : a + rows]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([_block(x)], pa.binary())], names=["n", "block"])

    return points.select("p").mapInArrow(part, "n int, block binary")


def _margins(points: np.ndarray, centers: np.ndarray, ahead: np.ndarray, speed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the closest centre, as ``_nearest``, and the margin: that centre stays the closest
    one as long as the centres are on the straight way from ``centers`` to ``ahead`` (all at the
    same part of it), or each centre j not farther from there than margin x speed[j].

    On the way at t, |p - c_j|^2 is its linear interpolation less t (1 - t) |step_j|^2, and the sum
    of two distances is at most that of the farther end.
    """
    k, dim = centers.shape
    near, margin = np.zeros(len(points), np.int64), np.zeros(len(points))
    rows = max(1, BLOCK_BYTES // (8 * (dim + 4 * k)))
    with np.errstate(all="ignore"):
        ends = [(c, np.einsum("ij,ij->i", c, c)) for c in ((centers,) if ahead is centers else (centers, ahead))]
        bend = ((ahead - centers) ** 2).sum(axis=1).max() / 4
        pace = speed[:, None] + speed
        for a in range(0, len(points), rows):
            p = points[a : a + rows]
            at = np.arange(len(p))
            pp = np.einsum("ij,ij->i", p, p)
            err = 16 * (dim + 8) * np.finfo(float).eps * (pp + max(cc.max() for _, cc in ends))  # more than d and _nearest round off
            lead = far = i = clear = None
            for c, cc in ends:
                d = c @ p.T  # a row for each centre
                d *= -2
                d += cc[:, None]
                d += pp
                if i is None:
                    i, first = np.zeros(len(p), np.int64), d[0].copy()
                    for j in range(1, k):
                        i[d[j] < first] = j
                        np.minimum(first, d[j], out=first)
                else:
                    first = d[i, at]
                h = d - first
                h[i, at] = np.inf
                if clear is None:
                    clear = h.min(axis=0) > 2 * err  # not where a distance is NaN or infinite
                d += err
                np.sqrt(d, out=d)
                d += np.sqrt(first + err)
                lead, far = (h, d) if lead is None else (np.minimum(lead, h, out=lead), np.maximum(far, d, out=far))
            lead -= 2 * err + bend
            lead /= far
            lead /= pace[:, i]
            m = lead.min(axis=0)
            if not clear.all():
                i[~clear], m[~clear] = _nearest(p[~clear], centers), 0
            near[a : a + rows], margin[a : a + rows] = i, np.fmax(m, 0)
    return near, margin


def _sums(points: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """Sum of the points of each cluster."""
    s = np.zeros((k, points.shape[1]))
    rows = max(1, BLOCK_BYTES // (8 * k))
    for a in range(0, len(points), rows):
        p, own = points[a : a + rows], nearest[a : a + rows]
        member = np.zeros((k, len(p)))
        member[own, np.arange(len(p))] = 1
        with np.errstate(all="ignore"):
            part = member @ p
        if not np.isfinite(part).all():  # 0 x inf must not reach other clusters
            part = np.array([p[own == j].sum(axis=0) for j in range(k)])
        s += part
    return s


def _bucket(margin: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(4 * np.log2(margin)) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def _reach(counts: np.ndarray, most: int) -> float:
    """A margin that no more than so many points stay below; counts: by ``_bucket``."""
    i = int(np.searchsorted(np.cumsum(counts), most, side="right"))
    return 0.0 if not i else np.inf if i == len(counts) else float(2.0 ** ((i - BUCKETS // 2) / 4))


def _add_up(batches):
    """One row for each slot of a pass, but for points."""
    found: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            if r["slot"] == _POINTS:
                yield pa.RecordBatch.from_pylist([r], b.schema)
                continue
            kind = np.int64 if r["slot"] == _COUNTS else np.float64
            x = np.frombuffer(r["s"], kind)
            if r["slot"] in found:
                was = found[r["slot"]]
                was[0], was[1], was[2] = was[0] + r["n"], min(was[1], r["rim"]), was[2] + x
            else:
                found[r["slot"]] = [r["n"], r["rim"], x]
    for slot, (n, rim, x) in found.items():
        yield _pass_row(slot, n, rim, x.tobytes())


_POINTS, _COUNTS = -2, -1  # slots of a pass that are no cluster
_PASS = "slot int, n long, rim double, s binary"


def _pass_row(slot: int, n: int, rim: float, s: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([rim], pa.float64()), pa.array([s], pa.binary())], names=["slot", "n", "rim", "s"])


def _lowest(points: list, margins: list, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The points of the lowest margins, at most so many, and the margin that the others reach."""
    p, m = np.concatenate(points), np.concatenate(margins)
    if len(m) <= most:
        return p, m, np.inf
    keep = np.argpartition(m, most)[: most + 1]
    rim = float(m[keep].max())
    keep = keep[:most]
    return p[keep], m[keep], rim


@dataclass
class _Level:
    """Points that may change clusters, packed, and the sums of all others.

    ``at``, ``ahead``, ``speed``, ``reach``: the others keep their clusters as long as no
    centre is off the way from ``at`` to ``ahead`` by ``reach`` x its speed.
    """

    frame: DataFrame
    n: np.ndarray
    s: np.ndarray
    at: np.ndarray
    ahead: np.ndarray
    speed: np.ndarray
    reach: float
    handle: object = None
    tasks: float = np.inf

    def holds(self, centers: np.ndarray) -> bool:
        return self.reach == np.inf or _off(self.at, self.ahead, centers, self.speed) < self.reach

    def free(self) -> None:
        self.frame.unpersist()
        if self.handle:
            self.handle.destroy()

    def compare(self, centers: np.ndarray, ahead: np.ndarray, speed: np.ndarray, limit: float | None = None, most: int = 0, total: int = 1):
        """One pass: sizes and sums of all clusters, counts by margin, and with a
        limit the points of lower margins, at most so many, and the margin of the rest."""
        k, dim = centers.shape
        handle = self.frame.sparkSession.sparkContext.broadcast((centers, ahead, speed))

        def part(batches):
            at = handle.value
            n, s, counts = np.zeros(k, np.int64), np.zeros((k, dim)), np.zeros(BUCKETS, np.int64)
            rim = -1.0 if limit is None else limit
            pool, margins, held = [np.zeros((0, dim))], [np.zeros(0)], 0
            for p in _blocks(batches, dim):
                near, margin = _margins(p, *at)
                n += np.bincount(near, minlength=k)
                s += _sums(p, near, k)
                counts += np.bincount(_bucket(margin), minlength=BUCKETS)
                if limit is not None:
                    close = margin <= rim
                    pool.append(p[close])
                    margins.append(margin[close])
                    held += len(margins[-1])
                    if held > 2 * most:
                        p, m, least = _lowest(pool, margins, most)
                        pool, margins, held, rim = [p], [m], len(m), min(rim, least)
            for j in np.flatnonzero(n):
                yield _pass_row(int(j), int(n[j]), np.inf, s[j].tobytes())
            if limit is not None:
                p, m, least = _lowest(pool, margins, -(-most * int(n.sum()) // total))
                rim = min(rim, least)
                if len(p):
                    yield _pass_row(_POINTS, len(p), np.inf, _block(p))
            yield _pass_row(_COUNTS, 1, rim, counts.tobytes())

        found = self.frame.mapInArrow(part, _PASS)
        if self.tasks * (centers.nbytes + 8 * BUCKETS) > NEAR_BYTES:
            found = found.repartition("slot").mapInArrow(_add_up, _PASS)
        n, s, counts, near, rim, tasks = self.n.copy(), self.s.copy(), np.zeros(BUCKETS, np.int64), [np.zeros((0, dim))], np.inf, 0
        try:
            for r in found.collect():
                if r["slot"] == _POINTS:
                    near.append(_unblock(r["n"], r["s"], dim))
                elif r["slot"] == _COUNTS:
                    counts, rim, tasks = counts + np.frombuffer(r["s"], np.int64), min(rim, r["rim"]), tasks + r["n"]
                else:
                    n[r["slot"]] += r["n"]
                    s[r["slot"]] += np.frombuffer(r["s"])
        finally:
            handle.destroy()
        self.tasks = tasks
        return n, s, counts, np.concatenate(near), rim

    def inner(self, at: np.ndarray, ahead: np.ndarray, speed: np.ndarray, reach: float, n: np.ndarray, s: np.ndarray) -> _Level:
        """The points of margins up to ``reach`` only; n, s: sizes and sums of all at these centres."""
        k, dim = at.shape
        handle = self.frame.sparkSession.sparkContext.broadcast((at, ahead, speed))

        def part(batches):
            for p in _blocks(batches, dim):
                p = p[_margins(p, *handle.value)[1] <= reach]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array([len(p)], pa.int32()), pa.array([_block(p)], pa.binary())], names=["n", "block"])

        frame = self.frame.mapInArrow(part, "n int, block binary").persist(StorageLevel.MEMORY_AND_DISK)
        level = _Level(frame, np.zeros(k, np.int64), np.zeros((k, dim)), at, ahead, speed, reach, handle)
        own_n, own_s, *_ = level.compare(at, ahead, speed)
        level.n, level.s = n - own_n, s - own_s
        return level


def _blocks(batches, dim: int):
    for b in batches:
        for n, block in zip(b.column("n").to_pylist(), b.column("block"), strict=True):
            yield _unblock(n, block.as_py(), dim)


def _moved(a: np.ndarray, b: np.ndarray, speed: np.ndarray) -> float:
    """The longest way of a centre, in its speed, rounded up."""
    return float((np.sqrt(((a - b) ** 2).sum(axis=1)) / speed).max()) * (1 + 1e-9)


def _off(at: np.ndarray, ahead: np.ndarray, centers: np.ndarray, speed: np.ndarray) -> float:
    """How far centres are from the way from ``at`` to ``ahead``, in their speed, rounded up."""
    way = (ahead - at) / speed[:, None]
    length = float((way * way).sum())
    part = float((way * (centers - at) / speed[:, None]).sum()) / length if length > 0 else 0.0
    return _moved(at + min(1.0, max(0.0, part)) * (ahead - at), centers, speed)


@dataclass
class _Rounds:
    """Centres and what the rounds so far have brought."""

    centers: np.ndarray
    converge_dist: float
    max_iter: int | None
    path: deque = field(default_factory=lambda: deque(maxlen=PATH))  # the centres before the last rounds
    dist: float = float("inf")
    moves: list[float] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def go_on(self) -> bool:
        return self.dist > self.converge_dist and (self.max_iter is None or len(self.moves) < self.max_iter)

    def update(self, n: np.ndarray, s: np.ndarray) -> None:
        """New centres from sizes and sums; an empty cluster keeps its centre."""
        new, some = self.centers.copy(), n > 0
        new[some] = s[some] / n[some, None]
        self.path.append(self.centers)
        self.centers, self.sizes = new, n.tolist()
        self.dist = float(((new - self.path[-1]) ** 2).sum())
        self.moves.append(self.dist)

    def pace(self, rounds: int) -> np.ndarray:
        """Mean way of the centres in a round, over the last rounds."""
        some = min(max(rounds, 1), len(self.path))
        return (self.centers - self.path[-some]) / some

    def near(self, points: np.ndarray, rim: float, levels: list[_Level], at: np.ndarray, ahead: np.ndarray, speed: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
        """Rounds in which only these points may change clusters; n, s: sizes and sums at these centres."""
        k = len(at)
        own, due = _margins(points, at, at, speed)
        clock = 0.0
        while self.go_on() and (rim == np.inf or _off(at, ahead, self.centers, speed) < rim) and all(x.holds(self.centers) for x in levels):
            clock += _moved(self.path[-1], self.centers, speed)
            stale = np.flatnonzero(~(due > clock))
            now, margin = _margins(points[stale], self.centers, self.centers, speed)
            due[stale] = clock + margin
            other = now != own[stale]
            stale, now = stale[other], now[other]
            n = n + np.bincount(now, minlength=k) - np.bincount(own[stale], minlength=k)
            s = s + _sums(points[stale], now, k) - _sums(points[stale], own[stale], k)
            own[stale] = now
            self.update(n, s)


def kmeans(points: DataFrame, k: int, converge_dist: float, key: str | None = None, seed: int = 1,
           max_iter: int | None = None, init: list[list[float]] | None = None) -> KMeansResult:
    """Lloyd iterations until the total squared centre move ≤ converge_dist.

    At least one round; ``max_iter`` stops earlier if given. Sums of many
    tasks round differently from round to round, so ``converge_dist`` should
    be a little above 0 (1e-12 of squared coordinate units, say).
    """
    centers = init or initial_centers(points, k, key or "p", seed)
    if len(centers) < k:
        raise ValueError(f"only {len(centers)} points for k={k}")
    done = _Rounds(np.array(centers, dtype=np.float64), converge_dist, max_iter)
    (count, dim), passes = done.centers.shape, 0
    most = max(1, NEAR_BYTES // (8 * dim))
    frame = _packed(points, dim).persist(StorageLevel.MEMORY_AND_DISK)
    levels = [_Level(frame, np.zeros(count, np.int64), np.zeros((count, dim)), done.centers, done.centers, np.ones(count), np.inf)]
    speed, limit, total, foreseen = np.ones(count), None, 1, 0
    try:
        while done.go_on():
            while not all(x.holds(done.centers) for x in levels):
                levels.pop().free()
            level, at = levels[-1], done.centers
            ahead = at + foreseen * done.pace(foreseen // 2) if foreseen else at
            n, s, counts, near, rim = level.compare(at, ahead, speed, limit, most, total)
            done.update(n, s)
            passes, rounds = passes + 1, len(done.moves)
            total = max(1, int(counts.sum()))
            off = _off(at, ahead, done.centers, speed)
            if limit is not None:
                done.near(near, rim, levels, at, ahead, speed, n, s)
            if not done.go_on():
                break
            reach = _reach(counts, total // LEVEL_SHARE)
            if total > LEVEL_SHARE * most // 4 and _off(at, ahead, done.centers, speed) + 8 * _moved(done.path[-1], done.centers, speed) < reach:
                levels.append(level.inner(at, ahead, speed, reach, n, s))
                passes, total = passes + 1, max(1, total // LEVEL_SHARE)
            limit = _reach(counts, most * 3 // 4)
            limit = limit if limit > off else None
            foreseen = len(done.moves) - rounds + 2
            step = np.sqrt(((done.centers - at) ** 2).sum(axis=1))
            if np.isfinite(step).all() and step.any():
                speed = np.maximum(step / step.max(), 0.05)
        return KMeansResult(done.centers.tolist(), len(done.moves), done.dist <= converge_dist, done.moves, done.sizes, passes)
    finally:
        for x in reversed(levels):
            x.free()


def step_frame(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """One update as a frame: (cluster, dim, value) for all k centres; a
    cluster without points keeps its centre. Lazy — no driver round trip."""
    sums = cluster_sums(points, centers)
    old = points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, c array<double>")
    new = F.coalesce(F.transform("s", lambda x: x / F.col("n")), F.col("c"))
    return old.join(sums, "cluster", "left").select("cluster", F.posexplode(new).alias("dim", "value"))
