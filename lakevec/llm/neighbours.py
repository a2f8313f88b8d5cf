"""The most similar vectors of every vector: a permutation index over pivots with inverted files."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevec import runtime
from lakevec.llm import vectors as V
from lakevec.llm.cftree import ward

#: Routing: vectors for which a pivot is taken, the fewest and most pivots of a level (a bounded hash sample; the broadcast
#: pivots are at most MOST_PIVOTS x dimension numbers a table), and the nearest pivots whose buckets a vector is posted to.
PER_ROUTE, FEWEST_PIVOTS, MOST_PIVOTS, ROUTES = 128, 64, 4096, 3
#: Vectors planned for a bucket, pivots that a bucket has at least, and postings of a vector at a level, about.
PER_BUCKET, PIVOTS_PER_BUCKET, SPREAD = 1 << 14, 4, 2.5
#: The index in a bucket: vectors for which a pivot is taken, pivots in a vector's permutation, the first of them in
#: whose inverted files it is posted, and in how many of these it looks for neighbours.
PER_PIVOT, LENGTH, POSTED, SEARCHED = 32, 8, 6, 3
#: Vectors of an inverted file, nearest by footrule distance, that are scored for a vector, and vectors with like permutations that are
#: scored together, each against the candidates of all of them.
CANDIDATES, TOGETHER = 512, 16
#: How far a score in single precision may be off, relative to 1 or the score.
ROUGH = 1e-4
#: Vectors handled at once in a task, cells of a block of scores, of one that stays in a core's cache, pairs scored again at once, ids
#: planned for a cell of results, and parts into which the followers of a vector are spread.
BLOCK, SCORES, NEAR, FEW, PER_CELL, SALTS = 1 << 15, 1 << 21, 1 << 18, 1 << 9, 1 << 17, 16


def _codec():  # noqa: ANN202
    """Compressor and decompressor of shuffled blocks."""
    try:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    except ImportError:
        import zlib

        return (lambda b: zlib.compress(b, 1)), zlib.decompress


def to_block(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed block; the bytes of numbers are put plane by plane, which compresses better."""
    import pickle

    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append((a.dtype.str, a.shape, a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size else b""))
    return _codec()[0](pickle.dumps(planes, protocol=5))


def from_block(block: bytes) -> list[np.ndarray]:
    """The arrays of a block."""
    import pickle

    out = []
    for kind, shape, planes in pickle.loads(_codec()[1](block)):  # noqa: S301 - our own blocks
        dtype = np.dtype(kind)
        b = np.frombuffer(planes, dtype=np.uint8).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(b.T).view(dtype).reshape(shape))
    return out


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of ids."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vector_rows(segments: DataFrame | None, upserts: DataFrame | None, chunks: DataFrame | None, chunk_table: str = "knowledge_chunks") -> DataFrame:
    """The vectors of all sources in one form: table_name, keys, deleted, vectors (one after another)."""
    none = F.lit(None).cast("array<boolean>").alias("deleted")
    parts = []
    if segments is not None:
        parts.append(segments.select("table_name", "keys", "deleted", "vectors"))
    if upserts is not None:
        parts.append(upserts.select("table_name", F.array("id").alias("keys"), none, F.col("vector").alias("vectors")))
    if chunks is not None:
        parts.append(chunks.select(F.lit(chunk_table).alias("table_name"), F.array("id").alias("keys"), none, F.col("embedding").alias("vectors")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def _valid(batches: Iterator[pa.RecordBatch], known: list[V.Collection]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (table, ids, vectors): valid vectors with an id that aren't flagged deleted, each id once a block."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def ready(tab: int) -> tuple[int, np.ndarray, np.ndarray]:
        got = held.pop(tab)
        ids, first = np.unique(np.concatenate([i for i, _ in got]), return_index=True)
        return tab, ids, np.concatenate([m for _, m in got])[first]

    for batch in batches:
        names, keys, vec = batch.column("table_name"), batch.column("keys"), batch.column("vectors")
        deleted = batch.column("deleted")
        wide = pc.list_value_length(vec)
        many = pc.list_value_length(keys)
        for tab, c in enumerate(known):
            mine = pc.and_(pc.equal(names, c.name), pc.equal(wide, pc.multiply(many, c.dimension)))
            at = np.flatnonzero(pc.fill_null(mine, False).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            take = pa.array(at)
            ids = pc.list_flatten(keys.take(take))
            flat = pc.list_flatten(vec.take(take)).to_numpy(zero_copy_only=False)
            m = np.asarray(flat, dtype=np.float32).reshape(-1, c.dimension)
            ok = np.isfinite(m).all(axis=1) & ids.is_valid().to_numpy(zero_copy_only=False)
            flags = deleted.take(take)
            if flags.null_count < len(flags):
                count = many.take(take).to_numpy()
                gone = np.concatenate([np.resize(np.array(f or [False], dtype=bool), n) if f is None or len(f) == n else np.array((f + [False] * n)[:n], dtype=bool) for f, n in zip(flags.to_pylist(), count)])
                ok &= ~gone
            got = held.setdefault(tab, [])
            got.append((pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[ok].astype(np.int64), m[ok]))
            if sum(len(i) for i, _ in got) >= BLOCK:
                yield ready(tab)
    for tab in list(held):
        yield ready(tab)


@dataclass(frozen=True)
class Pivots:
    """The pivots of a level in comparable form, and the bucket that each one's vectors go to."""

    points: np.ndarray
    bucket: np.ndarray


def levels(n: int) -> list[int]:
    """The number of buckets that every level of routing cuts a set of n vectors into, so that the last ones have about PER_BUCKET.

    A level has at most MOST_PIVOTS / PIVOTS_PER_BUCKET buckets, whatever n; a larger set gets more levels instead of larger
    buckets, so that the work for a vector grows with the logarithm of n only.
    """
    out, most = [], MOST_PIVOTS // PIVOTS_PER_BUCKET
    left = n * SPREAD
    while True:
        k = max(1, math.ceil(left / PER_BUCKET))
        if k <= most:
            return [*out, k]
        out.append(most)
        left = left / most * SPREAD


def _pivots(points: np.ndarray, buckets: int) -> Pivots:
    """Groups pivots into buckets by Ward's agglomeration; a group of many is cut, so that none has more than twice the average."""
    m = len(points)
    label = ward(np.ones(m), points.astype(np.float64), min(buckets, m))
    each = max(1, 2 * m // max(1, min(buckets, m)))
    place = np.empty(m, dtype=np.int64)
    for g in np.unique(label):
        at = np.flatnonzero(label == g)
        parts = -(-len(at) // each)
        place[at] = np.arange(len(at)) * parts // len(at)
    return Pivots(points, np.unique(label * (m + 1) + place, return_inverse=True)[1].astype(np.int64))


def _wanted(n: float, buckets: int) -> int:
    """The number of pivots of a level for n vectors."""
    return int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, n // PER_ROUTE, PIVOTS_PER_BUCKET * buckets)))


def _xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        x = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        x = turned(x, 27) * p1 + p4
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
    return x ^ (x >> np.uint64(32))


def _below(ids: np.ndarray, rate: float) -> np.ndarray:
    """Whether the hash of an id is in the lowest part of so much."""
    return np.ones(len(ids), dtype=bool) if rate >= 1 else _xxhash64(ids) >> np.uint64(1) < np.uint64(rate * 2.0**63)


def _has_below(name: str, rate: float) -> Column:
    """Whether a row of vector_rows is of a table and has an id that is _below."""
    low = lambda k: F.shiftrightunsigned(F.xxhash64(k.cast("long")), 1) < F.lit(int(rate * 2.0**63))
    mine = F.col("table_name") == name
    return mine if rate >= 1 else mine & F.exists("keys", low)


def sizes(rows: DataFrame, known: list[V.Collection]) -> dict[int, int]:
    """Listed vectors of each table, repeated ones included."""
    index = {c.name: i for i, c in enumerate(known)}
    counted = rows.filter(F.col("table_name").isin(list(index))).groupBy("table_name").agg(F.sum(F.greatest(F.size("keys"), F.lit(0))).alias("n")).collect()
    return {index[r["table_name"]]: r["n"] or 0 for r in counted}


def choose_pivots(rows: DataFrame, known: list[V.Collection], n: dict[int, int]) -> dict[int, Pivots]:
    """Routing pivots of each table's first level: the vectors whose hashed id is below a rate, equal ones once."""
    first = {t: levels(k)[0] for t, k in n.items()}
    rate = {t: _wanted(k, first[t]) / max(k, 1) for t, k in n.items()}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, ids, m in _valid(batches, known):
            on = _below(ids, rate[tab])
            packed = V.pack(m[on])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), tab), pa.int32()), pa.array(ids[on]), pa.array(packed, pa.binary())], names=["tab", "id", "vec"])

    got: dict[int, dict[bytes, None]] = {}
    # rows without such an id needn't go to Python
    some = reduce(or_, (_has_below(known[t].name, r) for t, r in rate.items()), F.lit(False))
    for r in sorted(rows.filter(some).mapInArrow(sample, "tab int, id long, vec binary").collect(), key=lambda r: (r["tab"], r["id"])):
        got.setdefault(r["tab"], {})[bytes(r["vec"])] = None
    return {tab: _pivots(_points(V.unpack(list(packed), known[tab].dimension), known[tab].metric), first[tab]) for tab, packed in got.items()}


def _points(m: np.ndarray, metric: str) -> np.ndarray:
    out = np.empty(m.shape, dtype=np.float32)
    for at in range(0, len(m), FEW):
        out[at : at + FEW] = V.comparable(m[at : at + FEW], metric)
    return out


def permutations(x: np.ndarray, pivots: np.ndarray, metric: str, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; at equal distance the earlier pivot first."""
    k = min(length, len(pivots))
    out = np.empty((len(x), k), dtype=np.uint16)
    half = 0.5 * (pivots * pivots).sum(axis=1)[None, :] if metric == "l2" else None
    step = max(1, NEAR // len(pivots))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ pivots.T
        if half is not None:
            near -= half
        # the greatest is taken k times: for few of many that is faster than a partition, and the first of equal ones comes first
        rows, odd = np.arange(len(near)), np.zeros(len(near), dtype=bool)
        for j in range(k):
            best = near.argmax(axis=1)
            out[at : at + step, j] = best
            odd |= ~np.isfinite(near[rows, best])
            near[rows, best] = -np.inf
        for i in np.flatnonzero(odd).tolist():  # sums that are too large for single precision
            far = -(x[at + i] @ pivots.T) if half is None else half[0] - x[at + i] @ pivots.T
            out[at + i] = np.argsort(far, kind="stable")[:k]
    return out


def _routed(x: np.ndarray, p: Pivots, metric: str) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of a level and the rows of x that go to each: those of a vector's ROUTES nearest pivots."""
    bucket = p.bucket[permutations(x, p.points, metric, ROUTES)]
    at_rows, at_buckets = [], []
    for j in range(bucket.shape[1]):
        new = ~(bucket[:, :j] == bucket[:, j : j + 1]).any(axis=1)
        at_rows.append(np.flatnonzero(new))
        at_buckets.append(bucket[new, j])
    r, b = np.concatenate(at_rows), np.concatenate(at_buckets)
    by = np.argsort(b, kind="stable")
    if len(by):
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            yield int(b[part[0]]), r[part]


def _smaller(m: np.ndarray) -> np.ndarray:
    """Vectors in half precision where that loses nothing."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float16)
    return half if (half.astype(np.float32) == m).all() else m


def _batch(tab: int, bucket: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([bucket], pa.int64()), pa.array([to_block(arrays)], pa.binary())], names=["tab", "bucket", "block"])


_POSTED = "tab int, bucket long, block binary"


def _post(rows: DataFrame, known: list[V.Collection], shared, cells: int) -> DataFrame:  # noqa: ANN001
    """Posts every vector to the buckets of its nearest routing pivots: tab, bucket, block of (ids, whether others follow, vectors).

    Of equal vectors in a block of a task only the top_k + 1 with the smallest ids are posted: they are all that can be
    among the nearest of anything. The others follow the smallest of them and get its result in the end: blocks of
    (leaders, ids) in one of so many cells, as buckets from -1 down (see _followers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, ids, m in _valid(batches, known):
            if not len(ids):
                continue
            c, p = known[tab], shared.value[tab]
            # ids are sorted: of equal vectors the first rows have the smallest
            keep, follow, lead_row = _copies(m, c.top_k + 1)
            if len(follow):
                yield _batch(tab, -1 - int(_mixed(ids[follow[:1]])[0] % np.uint64(cells)), [ids[lead_row], ids[follow]])
            followed = np.zeros(len(ids), dtype=bool)
            followed[lead_row] = True
            ids, m, followed = ids[keep], m[keep], followed[keep]
            small = _smaller(m)
            for bucket, r in _routed(_points(m, c.metric), p, c.metric):
                yield _batch(tab, bucket, [ids[r], followed[r], small[r]])

    return rows.mapInArrow(run, _POSTED)


def _followers(blocks: DataFrame) -> DataFrame:
    """The vectors that _post leaves to a smaller equal one of their block: tab, leader, id, spread over SALTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tab, block in zip(*(batch.column(i).to_pylist() for i in range(2))):
                leader, ids = from_block(block)
                salt = (_mixed(ids) % np.uint64(SALTS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tab), pa.int32()), pa.array(leader), pa.array(ids), pa.array(salt)], names=["tab", "leader", "id", "salt"])

    return blocks.select("tab", "block").mapInArrow(run, "tab int, leader long, id long, salt int")


def _split(posted: DataFrame, known: list[V.Collection], within: dict[int, tuple[float, int]]) -> DataFrame:
    """The next level of routing: every bucket gets pivots from its own vectors, which are posted to its parts.

    within: for each table the vectors that a bucket has, about, and the number of its parts. A bucket's blocks are spread over as
    many tasks as they need, each of which gets the bucket's pivots. Followers stay as they are.
    """
    whole = runtime.written(posted, "posted")
    posted, followers = whole.filter("bucket >= 0"), whole.filter("bucket < 0")
    rate = {t: (_wanted(n, k) if k > 1 else 1) / max(n, 1) for t, (n, k) in within.items()}
    parts = {t: max(1, math.ceil(n / (4 * BLOCK))) for t, (n, _) in within.items()}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tab, bucket, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, _, m = from_block(block)
                on = _below(ids ^ np.int64(bucket + 1), rate[tab])
                if on.any():
                    yield _batch(tab, bucket, [ids[on], m[on]])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        tab, bucket = key[0].as_py(), key[1].as_py()
        got = [from_block(b) for b in table.column("block").to_pylist()]
        ids, first = np.unique(np.concatenate([g[0] for g in got]), return_index=True)
        m = np.unique(np.concatenate([g[1].astype(np.float32) for g in got])[first], axis=0)
        p = _pivots(_points(m, known[tab].metric), within[tab][1])
        return pa.Table.from_batches([_batch(tab, bucket, [p.points, p.bucket])])

    count = F.element_at(F.create_map(*(F.lit(x) for t, k in parts.items() for x in (t, k))), F.col("tab"))
    pivots = posted.mapInArrow(sample, _POSTED).groupBy("tab", "bucket").applyInArrow(choose, _POSTED)
    pivots = runtime.written(pivots, "pivots").withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1))).withColumnRenamed("block", "pivots")
    salted = posted.withColumn("salt", F.pmod(F.xxhash64("block"), count).cast("int"))

    def route(key: tuple, blocks: pa.Table, mine: pa.Table) -> pa.Table:
        tab, bucket = key[0].as_py(), key[1].as_py()
        out = []
        if mine.num_rows and blocks.num_rows:
            p = Pivots(*from_block(mine.column("pivots")[0].as_py()))
            got = [from_block(b) for b in blocks.column("block").to_pylist()]
            ids, followed = (np.concatenate([g[i] for g in got]) for i in range(2))
            m = np.concatenate([g[2].astype(np.float32) for g in got])
            small = _smaller(m)
            out = [_batch(tab, bucket * MOST_PIVOTS + b, [ids[r], followed[r], small[r]]) for b, r in _routed(_points(m, known[tab].metric), p, known[tab].metric)]
        return pa.Table.from_batches(out, schema=pa.schema([("tab", pa.int32()), ("bucket", pa.int64()), ("block", pa.binary())]))

    by = ["tab", "bucket", "salt"]
    return salted.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInArrow(route, _POSTED).unionByName(followers)


def footrule(perm: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How near the permutations of some rows are to all: LENGTH * (LENGTH + 1) less the footrule distance, halved.

    A pivot that a permutation doesn't have counts as being just behind its end. The distance then is a constant less twice
    the sum of the smaller weight of each common pivot, its weight being the number of places up to the end.
    """
    length = perm.shape[1]
    there = np.zeros(int(perm.max()) + 1, dtype=np.int64)
    there[perm] = 1
    inverse = (np.cumsum(there) - 1)[perm]
    # a line for each pivot, so that whole lines are gathered
    weight = np.zeros((int(there.sum()), len(perm)), dtype=np.uint8)
    for j in range(length):
        weight[inverse[:, j], np.arange(len(perm))] = length - j
    mine = inverse[rows]
    out = np.empty((len(rows), len(perm)), dtype=np.uint8)
    step = max(1, NEAR // len(perm))
    for at in range(0, len(rows), step):
        part = out[at : at + step]
        np.minimum(weight[mine[at : at + step, 0]], np.uint8(length), out=part)
        for j in range(1, length):
            line = weight[mine[at : at + step, j]]
            part += np.minimum(line, np.uint8(length - j), out=line)
    return out


def _nearest(near: np.ndarray, most: int) -> np.ndarray:
    """Which are the most greatest of each row, exactly so many; of equal ones the first."""
    size = near.shape[1]
    # the partition of numbers of two bytes is faster than of one
    top = np.partition(near.astype(np.uint16), size - most, axis=1)[:, size - most :]
    room = (top == top[:, :1]).sum(axis=1)
    last = top[:, :1].astype(near.dtype)
    tied = np.flatnonzero(near == last)
    row = tied // size
    out = near > last
    out.ravel()[tied[_place(row) < room[row]]] = True
    return out


def _candidates(perm: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows of q that are handled at once, and the candidates that are scored for them (None: the whole file).

    The vectors of the file are ranked by footrule distance before any score; the CANDIDATES nearest of a row are its candidates. Rows with
    like permutations are handled TOGETHER, with the candidates of all of them, since a block of scores costs less than gathering the
    candidates of each row. Of a file that has no more than CANDIDATES all are candidates, whatever their rank.
    """
    size = len(perm)
    if size <= CANDIDATES:
        step = max(1, SCORES // size)
        for at in range(0, len(q), step):
            yield q[at : at + step], None
        return
    q = q[np.lexsort(perm[q, :SEARCHED].T[::-1])]
    step, part = (TOGETHER * max(1, cells // (size * TOGETHER)) for cells in (SCORES, NEAR))
    for at in range(0, len(q), step):
        near = footrule(perm, q[at : at + step])
        for low in range(0, len(near), part):
            chosen = _nearest(near[low : low + part], CANDIDATES)
            for g in range(0, len(chosen), TOGETHER):
                cand = np.flatnonzero(chosen[g : g + TOGETHER].any(axis=0))
                first = at + low + g
                yield q[first : first + len(chosen[g : g + TOGETHER])], cand if len(cand) < size else None


def _best_in_file(x: np.ndarray, perm: np.ndarray, q: np.ndarray, metric: str, top_k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the rows q of an inverted file their best others among the candidates in it: rows, others, scores in single precision."""
    # the last of top_k, all kept copies of it, and what single precision can't tell from it
    spare = 2 * top_k + 2
    square = (x * x).sum(axis=1) if metric == "l2" else None
    for rows, cand in _candidates(perm, q):
        s = x[rows] @ (x if cand is None else x[cand]).T
        if square is not None:
            s *= -2
            s += square[rows][:, None]
            s += (square if cand is None else square[cand])[None, :]
            np.negative(np.sqrt(np.maximum(s, 0, out=s), out=s), out=s)
        if cand is None:
            s[np.arange(len(rows)), rows] = -np.inf
        else:
            own = np.minimum(np.searchsorted(cand, rows), len(cand) - 1)
            there = np.flatnonzero(cand[own] == rows)
            s[there, own[there]] = -np.inf
        good = s >= least
        many = np.flatnonzero(good.sum(axis=1) > spare)
        if len(many):
            value = s[many]
            last = np.partition(value, s.shape[1] - top_k, axis=1)[:, s.shape[1] - top_k] if top_k else np.full(len(many), np.inf)
            good[many] = value >= (last - ROUGH * np.maximum(1, np.abs(last)))[:, None]
        hit = np.flatnonzero(good)
        i = hit // s.shape[1]
        j = hit - i * s.shape[1]
        yield rows[i], j if cand is None else cand[j], s.ravel()[hit]


def search_bucket(ids: np.ndarray, m: np.ndarray, c: V.Collection) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best top_k found in a bucket for each of its vectors, from min_score on: positions, positions, scores.

    The bucket's own pivots, one for PER_PIVOT vectors by hash of the id, give every vector its permutation; it is posted in the
    inverted files of the first POSTED and looks for neighbours in those of the first SEARCHED. What is found is scored
    again in double precision.
    """
    n = len(ids)
    x = _points(m, c.metric)
    pivots = np.sort(np.argsort(_mixed(ids), kind="stable")[: max(1, n // PER_PIVOT)])
    perm = permutations(x, x[pivots], c.metric, LENGTH)
    posted = min(POSTED, perm.shape[1])
    flat = perm[:, :posted].ravel()
    order = np.argsort(flat, kind="stable")
    member, place = order // posted, order % posted
    edges = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
    least = c.min_score - ROUGH * max(1.0, abs(c.min_score))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for f in range(len(pivots)):
        here, q = member[edges[f] : edges[f + 1]], np.flatnonzero(place[edges[f] : edges[f + 1]] < SEARCHED)
        if len(here) > 1 and len(q):
            found += [(here[i], here[j], s) for i, j, s in _best_in_file(x[here], perm[here], q, c.metric, c.top_k, least)]
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    a, b, rough = (np.concatenate(z) for z in zip(*found))
    pairs, first = np.unique(a * n + b, return_index=True)
    a, b, rough = pairs // n, pairs % n, rough[first]
    # the score at the last of top_k of each, or the lowest it has
    last = np.full(n, -np.inf)
    at_last = _place(a) == c.top_k - 1
    last[a[at_last]] = _descending(a, rough)[at_last]
    top = rough >= (last - ROUGH * np.maximum(1, np.abs(last, where=np.isfinite(last), out=np.ones(n))))[a]
    a, b = a[top], b[top]
    score = np.empty(len(a))
    for at in range(0, len(a), FEW):
        part = slice(at, at + FEW)
        score[part] = V.exact_scores(m[a[part]], m[b[part]][:, None, :], c.metric)[:, 0]
    return best_of(a, b, ids[b], score, c)


def _descending(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The numbers x, in single precision, from the greatest to the least within each of the sorted groups a, by one sort of whole numbers."""
    bits = x.astype(np.float32).view(np.uint32)
    sign = np.uint32(1 << 31)
    key = (a.astype(np.uint64) << np.uint64(32)) | np.where(bits & sign, bits, ~(bits | sign))
    key.sort()
    low = key.astype(np.uint32)
    return np.where(low & sign, low, ~low & ~sign).view(np.float32)


def _place(sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each element among the equal ones before it."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    at = np.arange(len(sorted_keys))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _copies(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a matrix with at most so many of equal ones, the first; the other rows, and for each of these its first equal."""
    same = np.unique(m.view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    place = _place(same[order])
    follow = place >= most
    return np.sort(order[~follow]), order[follow], order[np.flatnonzero(follow) - place[follow]]


def best_of(a: np.ndarray, b: np.ndarray, b_ids: np.ndarray, score: np.ndarray, c: V.Collection) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each a its top_k by score, greatest first, then smaller id, with a score of at least min_score."""
    on = score >= c.min_score
    a, b, b_ids, score = a[on], b[on], b_ids[on], score[on]
    order = np.lexsort((b_ids, -score, a))
    a, b, score = a[order], b[order], score[order]
    top = _place(a) < c.top_k
    return a[top], b[top], score[top]


def nearest_pairs(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """Pairs tab, id_a < id_b, each once, of which at least one is among the top_k most similar others of the other one.

    rows: the result of vector_rows. Metric, top_k and min_score (the least score of a pair) are those of the table in
    collections. Equal scores: the smaller id first. Vectors that are null, of another length or not finite, null ids, deleted
    ones and unknown tables take no part; an id that is listed more than once counts once. Equal vectors under different
    ids are each other's nearest. The result is approximate: a pair is missed if the two share no inverted file that one
    of them searches, or if many others of a large file have nearer permutations; README has the measured recall.
    """
    spark = rows.sparkSession
    runtime.ship(spark)
    known = V.collections(collections)
    n = sizes(rows, known)
    shared = spark.sparkContext.broadcast(choose_pivots(rows, known, n))
    cells = max(runtime.width(spark), -(-max(n.values(), default=0) // PER_CELL))
    plans = {t: levels(k) for t, k in n.items()}
    posted, inside = _post(rows, known, shared, cells), {t: k * SPREAD / plans[t][0] for t, k in n.items()}
    for level in range(1, max(map(len, plans.values()), default=1)):
        # a table with fewer levels keeps its buckets: they are cut into one part
        within = {t: (inside[t], p[level] if level < len(p) else 1) for t, p in plans.items()}
        posted = _split(posted, known, within)
        inside = {t: k * (SPREAD if level < len(plans[t]) else 1) / within[t][1] for t, k in inside.items()}

    def search(key: tuple, table: pa.Table) -> pa.Table:
        tab, bucket = key[0].as_py(), key[1].as_py()
        if bucket < 0:  # followers pass, in cells from -2 down
            return pa.table({"tab": table.column("tab"), "cell": pa.array([bucket - 1] * table.num_rows, pa.int32()), "block": table.column("block")})
        c = known[tab]
        parts = [from_block(b) for b in table.column("block").to_pylist()]
        ids, first, again = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
        followed = np.zeros(len(ids), dtype=bool)
        followed[again[np.concatenate([x[1] for x in parts])]] = True
        m = np.concatenate([x[2].astype(np.float32) for x in parts])[first]
        # of equal vectors from different blocks again only the first take part; the others get the first one's result in merge
        keep, follow, lead_row = _copies(m, c.top_k + 1)
        a, b, score = search_bucket(ids[keep], m[keep], c)
        a, b = keep[a], keep[b]
        # the score of a vector with itself, for those that others follow
        lead = np.union1d(lead_row, np.flatnonzero(followed))
        own = V.exact_scores(m[lead], m[lead][:, None, :], c.metric)[:, 0] if len(lead) else np.zeros(0)
        of = np.searchsorted(lead, lead_row)
        columns = [(ids[a], ids[b], score), (ids[lead], followed[lead], own), (ids[follow], ids[lead_row], own[of] if len(of) else own[:0])]
        # a follower goes to its leader's cell, as what it leads itself does
        final = ids.copy()
        final[follow] = ids[lead_row]
        by_cell = [_cells(z, cells) for z in (ids[a], final[lead], ids[lead_row])]
        out_cells, blocks = [], []
        for cell in np.unique(np.concatenate([k for _, k in by_cell])).tolist():
            arrays = []
            for (order, at), cols in zip(by_cell, columns):
                mine = order[np.searchsorted(at, cell) : np.searchsorted(at, cell, side="right")]
                arrays += [col[mine] for col in cols]
            out_cells.append(cell)
            blocks.append(to_block(arrays))
        return pa.table({"tab": pa.array([tab] * len(blocks), pa.int32()), "cell": pa.array(out_cells, pa.int32()), "block": pa.array(blocks, pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """The best of all buckets, as pairs by cell; and for vectors that others follow (cell -1) who the nearest ones are, itself included. Followers pass."""
        tab = key[0].as_py()
        if key[1].as_py() < 0:
            rest = [pa.nulls(table.num_rows, kind) for kind in (pa.int64(), pa.list_(pa.int64()))]
            return pa.table([*(table.column(x) for x in ("tab", "cell", "block")), *rest], names=["tab", "cell", "block", "leader", "nearest"])
        c = known[tab]
        parts = [from_block(x) for x in table.column("block").to_pylist()]
        a, b, score, lead, followed, own, follower, leader, same = (np.concatenate([x[i] for x in parts]) for i in range(9))
        once = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)[1]
        a, b, score = best_of(a[once], b[once], b[once], score[once], c)
        if len(follower):
            follower, first = np.unique(follower, return_index=True)
            fa, fb, fs = _with_leader(follower, leader[first], same[first], a, b, score)
            fa, fb, fs = best_of(fa, fb, fb, fs, c)
            new = ~np.isin(fa, a)
            order = np.argsort(np.concatenate([a, fa[new]]), kind="stable")
            a, b, score = (np.concatenate(z)[order] for z in ((a, fa[new]), (b, fb[new]), (score, fs[new])))
        lead, first = np.unique(lead, return_index=True)
        lead, own = lead[followed[first]], own[first][followed[first]]
        out = [(cell, block, None, None) for cell, block in _pair_blocks(a, b, cells)]
        start, end = np.searchsorted(a, lead), np.searchsorted(a, lead, side="right")
        for v, s, i, j in zip(lead.tolist(), own.tolist(), start.tolist(), end.tolist()):
            ranked = sorted([*zip((-score[i:j]).tolist(), b[i:j].tolist()), *([(-s, v)] if s >= c.min_score else [])])
            out.append((-1, None, v, [w for _, w in ranked]))
        cell, block, leader_, nearest = zip(*out) if out else ((), (), (), ())
        return pa.table({"tab": pa.array([tab] * len(out), pa.int32()), "cell": pa.array(cell, pa.int32()), "block": pa.array(block, pa.binary()), "leader": pa.array(leader_, pa.int64()), "nearest": pa.array(nearest, pa.list_(pa.int64()))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tab, a, b = (batch.column(i).to_numpy() for i in range(3))
            for t in np.unique(tab):
                on = tab == t
                for cell, block in _pair_blocks(a[on], b[on], cells):
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([cell], pa.int32()), pa.array([block], pa.binary())], names=["tab", "cell", "block"])

    def once(key: tuple, table: pa.Table) -> pa.Table:
        parts = [from_block(x) for x in table.column("block").to_pylist()]
        pairs = np.unique(np.concatenate([np.stack(x, axis=1) for x in parts]), axis=0)
        return pa.table({"tab": pa.array(np.full(len(pairs), key[0].as_py()), pa.int32()), "id_a": pa.array(pairs[:, 0]), "id_b": pa.array(pairs[:, 1])})

    shape = "tab int, cell int, block binary"
    # a task for each bucket: their number grows with the vectors, and no task gets more than a few
    tasks = max(runtime.width(spark), sum(math.prod(p) for p in plans.values()))
    found = posted.repartition(tasks, "tab", "bucket").groupBy("tab", "bucket").applyInArrow(search, shape)
    merged = runtime.written(found.groupBy("tab", "cell").applyInArrow(merge, f"{shape}, leader long, nearest array<long>"), "nearest")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    leaders = merged.filter("cell = -1").select("tab", "leader", "nearest", salts)
    most = F.element_at(F.array(*(F.lit(c.top_k) for c in known)), F.col("tab") + 1) if known else F.lit(0)
    others = F.slice(F.filter("nearest", lambda v: v != F.col("id")), F.lit(1), most)
    copies = _followers(merged.filter("cell < -1")).join(leaders, ["tab", "leader", "salt"]).select("tab", "id", F.explode(others).alias("other"))
    pairs = merged.filter("cell >= 0").select("tab", "cell", "block").unionByName(copies.mapInArrow(pack, shape))
    return pairs.groupBy("tab", "cell").applyInArrow(once, "tab int, id_a long, id_b long")


def _cells(ids: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ids by cell, and the cells in that order."""
    cell = (_mixed(ids) % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    return order, cell[order]


def _with_leader(follower: np.ndarray, leader: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What followers have: their leader, with its own score, and what it has, but not themselves. a is sorted."""
    start, end = np.searchsorted(a, leader), np.searchsorted(a, leader, side="right")
    extra = np.repeat(np.arange(len(leader)), end - start)
    at = np.arange(len(extra)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + np.repeat(start, end - start)
    fa, fb = np.concatenate([follower, follower[extra]]), np.concatenate([leader, b[at]])
    fs = np.concatenate([own, score[at]])
    other = fa != fb
    return fa[other], fb[other], fs[other]


def _pair_blocks(a: np.ndarray, b: np.ndarray, cells: int) -> Iterator[tuple[int, bytes]]:
    """Pairs, the smaller id first, as sorted blocks by cell."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    to = (_mixed(low) % np.uint64(cells)).astype(np.int64)
    order = np.lexsort((high, low, to))
    low, high, to = low[order], high[order], to[order]
    if len(to):
        for g in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
            yield int(to[g[0]]), to_block([low[g], high[g]])
