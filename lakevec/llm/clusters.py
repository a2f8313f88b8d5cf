"""Similarity clusters of vectors: cluster-feature trees, Ward's agglomeration, one assignment pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakevec import runtime
from lakevec.llm import vectors as V
from lakevec.llm.cftree import CFTree, ward

#: Leaf entries of a task's tree and of a merged one; trees merged by one task; both bound memory.
TASK_LEAVES, MERGED_LEAVES, FAN_IN = 512, 2048, 16
#: Vectors for which a region is planned, and the most regions of a table: the broadcast centres are at most
#: REGIONS x dimension numbers a table.
PER_REGION, REGIONS = 1500, 2048
#: Vectors handled at once in a task, leaders of a region compared in one task, representatives in a block of the exact
#: comparison, and scores computed at once.
BLOCK, REGION_LIMIT, SUPER, SCORES = 1 << 15, 1 << 13, 1 << 15, 1 << 21
#: How far a score in single precision may be off, relative to 1 or the score: what is nearer to min_score is scored in double.
ROUGH = 1e-4
#: Representatives that are compared with others at once.
ROWS = 512

_SUMMARY = "tab int, part int, n binary, ls binary, ss binary, threshold double"


def _threshold(c: V.Collection) -> float:
    """Where a tree starts: half the distance at which two vectors still are similar."""
    if c.metric == "l2":
        return max(-c.min_score, 1e-3) / 2
    return float(np.sqrt(max(2 - 2 * c.min_score, 1e-3))) / 2


def _summary(tab: int, part: int, tree: CFTree) -> dict:
    n, ls, ss = tree.leaves()
    return {"tab": tab, "part": part, "n": n.tobytes(), "ls": ls.tobytes(), "ss": ss.tobytes(), "threshold": tree.threshold}


def _live(batches: Iterator[pa.RecordBatch], known: list[V.Collection]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (table, keys, vectors) of the live vectors in segment rows."""
    index = {c.name: i for i, c in enumerate(known)}
    held: dict[int, list] = {}
    for batch in batches:
        name, keys, deleted, vec = (batch.column(c) for c in ("table_name", "keys", "deleted", "vectors"))
        for i in range(batch.num_rows):
            tab = index.get(name[i].as_py())
            if tab is None or not vec[i].is_valid or not keys[i].is_valid:
                continue
            values = vec[i].values.to_numpy(zero_copy_only=False)
            got = held.setdefault(tab, [])
            got.append(V.segment_parts(keys[i].as_py(), values, deleted[i].as_py(), known[tab].dimension))
            if sum(len(k) for k, _ in got) >= BLOCK:
                yield tab, np.concatenate([k for k, _ in got]), np.concatenate([m for _, m in got])
                held[tab] = []
    for tab, got in held.items():
        if got:
            yield tab, np.concatenate([k for k, _ in got]), np.concatenate([m for _, m in got])


def similar(a: np.ndarray, b: np.ndarray, x: np.ndarray, m: np.ndarray, c: V.Collection) -> np.ndarray:
    """Whether rows a and b of a matrix m score at least min_score. x: comparable(m) in single precision; close calls are made in double."""
    near = V.scores(x[a], x[b], c.metric)
    slack = ROUGH * max(1.0, abs(c.min_score)) * (max(1.0, float((x[a] * x[a]).sum(axis=1).max(initial=0))) if c.metric != "cosine" else 1.0)
    out = near >= c.min_score + slack
    i, j = np.nonzero(np.abs(near - c.min_score) < slack)
    for at in range(0, len(i), BLOCK):
        part = slice(at, at + BLOCK)
        out[i[part], j[part]] = V.exact_scores(m[a[i[part]]], m[b[j[part]]][:, None, :], c.metric)[:, 0] >= c.min_score
    return out


def local_clusters(keys: np.ndarray, m: np.ndarray, c: V.Collection) -> np.ndarray:
    """For each vector the smallest key of its cluster among these: those that score at least min_score with a first one.

    Sets of vectors that all are similar to each other, and to no others, come out whole, whichever comes first. A vector
    belongs to the cluster of the smallest key that takes it. Each cluster is found by one row of
    scores against what is still open, so that a cluster of most vectors costs little.
    """
    label = np.full(len(keys), -1, dtype=np.int64)
    x = V.comparable(m, c.metric).astype(np.float32)
    done = np.zeros(len(keys), dtype=bool)
    open_ = np.argsort(keys, kind="stable")
    while len(open_):
        head = open_[: max(16, min(256, SCORES // len(open_)))]
        near = similar(head, open_, x, m, c)
        for i, at in enumerate(head):
            if not done[at]:
                take = open_[near[i]]
                take = take[~done[take]]
                label[take], label[at] = keys[at], keys[at]
                done[take] = True
                done[at] = True
        open_ = open_[~done[open_]]
    return label


@dataclass
class Clusters:
    """vectors: tab, key, label (the smallest key of the cluster) of every live vector, alone ones included."""

    known: list[V.Collection]
    vectors: DataFrame


def region_centres(segments: DataFrame, known: list[V.Collection]) -> dict[int, np.ndarray]:
    """Centres of regions of each table, by cluster features.

    Every task builds a tree of its vectors; the leaf summaries are merged in a tree of tasks, FAN_IN at a time, until one summary
    a table is left, whose leaves Ward's agglomeration joins to one region for PER_REGION vectors. The driver gets the
    centres: at most REGIONS a table.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, CFTree] = {}
        part = TaskContext.get().partitionId()
        for tab, _, m in _live(batches, known):
            c = known[tab]
            tree = trees.setdefault(tab, CFTree(c.dimension, _threshold(c), TASK_LEAVES))
            tree.add(V.comparable(m, c.metric))
        if trees:
            yield pa.RecordBatch.from_pylist([_summary(t, part, x) for t, x in trees.items()], schema=_arrow_summary())

    def merged(pdf: pd.DataFrame, limit: int) -> CFTree:
        c = known[int(pdf["tab"].iloc[0])]
        tree = CFTree(c.dimension, float(pdf["threshold"].max()), limit)
        for r in pdf.sort_values("part").itertuples():
            tree.insert(np.frombuffer(r.n), np.frombuffer(r.ls).reshape(-1, c.dimension), np.frombuffer(r.ss))
        return tree

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_summary(int(pdf["tab"].iloc[0]), int(pdf["part"].iloc[0]) // FAN_IN, merged(pdf, MERGED_LEAVES))])

    def regions(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ls, _ = merged(pdf, MERGED_LEAVES).leaves()
        label = ward(n, ls / n[:, None], int(np.clip(n.sum() // PER_REGION, 1, REGIONS)))
        k = label.max() + 1
        count, sums = np.zeros(k), np.zeros((k, ls.shape[1]))
        np.add.at(count, label, n)
        np.add.at(sums, label, ls)
        return pd.DataFrame([{"tab": int(pdf["tab"].iloc[0]), "centres": (sums / count[:, None]).astype(np.float32).tobytes()}])

    needed = segments.select("table_name", "keys", "deleted", "vectors")
    summaries = runtime.written(needed.mapInArrow(build, _SUMMARY), "leaf-summaries")
    parts = 1 + (summaries.agg(F.max("part")).first()[0] or 0)
    while parts > FAN_IN:
        summaries = summaries.groupBy("tab", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, _SUMMARY)
        parts = -(-parts // FAN_IN)
    rows = summaries.groupBy("tab").applyInPandas(regions, "tab int, centres binary").collect()
    return {r["tab"]: np.frombuffer(bytes(r["centres"]), dtype=np.float32).reshape(-1, known[r["tab"]].dimension) for r in rows}


def _arrow_summary() -> pa.Schema:
    return pa.schema([("tab", pa.int32()), ("part", pa.int32()), ("n", pa.binary()), ("ls", pa.binary()), ("ss", pa.binary()), ("threshold", pa.float64())])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and an upper bound of its distance."""
    near, far = np.empty(len(x), dtype=np.int32), np.empty(len(x))
    square = (centres * centres).sum(axis=1)[None, :]
    step = max(1, SCORES // len(centres))
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        near[part] = (square - 2 * (x[part].astype(np.float32) @ centres.T)).argmin(axis=1)
        far[part] = np.sqrt(((x[part].astype(np.float64) - centres[near[part]]) ** 2).sum(axis=1))
    return near, far * (1 + 1e-9)


def assign(segments: DataFrame, known: list[V.Collection], centres: dict[int, np.ndarray]) -> DataFrame:
    """The assignment pass over all live vectors: tab, key, leader, and of leaders the packed vector, the nearest region and the distance from its centre.

    In a task, the vectors of a block that fall into one region are clustered, and only the smallest key of each
    cluster, its leader, goes on. So of a hot group of similar vectors each task sends one. Written as a table.
    """
    spark = segments.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # bounded by REGIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, keys, m in _live(batches, known):
            c = known[tab]
            keys, first = np.unique(keys, return_index=True)  # a segment may be present twice
            m = m[first]
            near, far = _nearest(V.comparable(m, c.metric), shared.value[tab])
            leader = np.empty(len(keys), dtype=np.int64)
            by_region = np.argsort(near, kind="stable")
            for at in np.split(by_region, np.flatnonzero(np.diff(near[by_region])) + 1):
                leader[at] = local_clusters(keys[at], m[at], c)
            lead = leader == keys
            vec = np.full(len(keys), None, dtype=object)
            vec[lead] = V.pack(m[lead])
            columns = [pa.array(np.full(len(keys), tab), pa.int32()), pa.array(keys), pa.array(leader), pa.array(vec, pa.binary()), pa.array(near), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["tab", "key", "leader", "vec", "region", "far"])

    needed = segments.select("table_name", "keys", "deleted", "vectors")
    return runtime.written(needed.mapInArrow(run, "tab int, key long, leader long, vec binary, region int, far double"), "assigned")


def _representatives(assigned: DataFrame, known: list[V.Collection]) -> DataFrame:
    """Leaders with the smallest leader of their cluster in their region (root), and the vectors of those that are one: the representatives.

    A region of more than REGION_LIMIT leaders is cut by hash, so that no task gets more than about that many. What this leaves apart
    comes together in the exact comparison.
    """
    leaders = assigned.filter("vec IS NOT NULL").dropDuplicates(["tab", "key"])
    # at most REGIONS rows a table
    parts = leaders.groupBy("tab", "region").agg(F.ceil(F.count(F.lit(1)) / REGION_LIMIT).cast("int").alias("parts"))
    cut = leaders.select("tab", "region", "key", "vec", "far").join(F.broadcast(parts), ["tab", "region"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        c = known[key[0].as_py()]
        keys, vec = table.column("key").to_numpy(), table.column("vec").to_pylist()
        root = local_clusters(keys, V.unpack(vec, c.dimension), c)
        vec = [v if a == b else None for v, a, b in zip(vec, root.tolist(), keys.tolist())]
        return pa.table({"tab": table.column("tab"), "key": table.column("key"), "root": pa.array(root), "region": table.column("region"), "far": table.column("far"), "vec": pa.array(vec, pa.binary())})

    found = cut.select("tab", "key", "region", "far", "vec", "part").groupBy("tab", "region", "part").applyInArrow(compare, "tab int, key long, root long, region int, far double, vec binary")
    return runtime.written(found, "representatives")


@dataclass(frozen=True)
class Reach:
    """Which regions of a table can have similar vectors: [i, j] is False only if the triangle inequality proves that none are."""

    regions: dict[int, int]
    may: np.ndarray


def _reach(c: V.Collection, centres: np.ndarray, regions: list[int], radius: np.ndarray, norm: np.ndarray) -> Reach:
    """By the distance of the centres, the greatest distance of a vector from its centre and that of two similar vectors.

    For a dot product the latter follows from the greatest norms of the two regions.
    """
    x = centres[regions].astype(np.float64)
    apart = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (x @ x.T), 0))
    if c.metric == "l2":
        most = np.full_like(apart, -c.min_score)
    elif c.metric == "cosine":
        most = np.full_like(apart, np.sqrt(max(2 - 2 * c.min_score, 0)))
    else:
        most = norm[:, None] ** 2 + norm[None, :] ** 2 - 2 * c.min_score
        most = np.where(most < 0, -np.inf, np.sqrt(np.maximum(most, 0)))
    return Reach({r: i for i, r in enumerate(regions)}, apart <= (radius[:, None] + radius[None, :] + most) * (1 + 1e-6) + 1e-6)


def _close(a: np.ndarray, b: np.ndarray, x: np.ndarray, half: np.ndarray | None, m: np.ndarray, c: V.Collection) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a and b that score at least min_score: single precision finds what may, double what does."""
    q = x[a] @ x[b].T
    if half is None:
        least = c.min_score
    else:  # the distance by dot product and half squares
        q -= half[a][:, None]
        q -= half[b][None, :]
        least = -0.5 * c.min_score * c.min_score
    slack = ROUGH * max(1.0, abs(least), float((x[a] * x[a]).sum(axis=1).max(initial=0)))
    i, j = np.nonzero(q >= np.float32(least - slack))
    sure = q[i, j] >= least + slack
    doubt = np.flatnonzero(~sure)
    for at in range(0, len(doubt), BLOCK):
        d = doubt[at : at + BLOCK]
        sure[d] = V.exact_scores(m[a[i[d]]], m[b[j[d]]][:, None, :], c.metric)[:, 0] >= c.min_score
    return a[i[sure]], b[j[sure]]


def _smallest_similar(keys: np.ndarray, m: np.ndarray, region: np.ndarray, a: np.ndarray, b: np.ndarray, c: V.Collection, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and the smallest other key among the rows of b that are similar to each, of those that have one. b is a, or shares no row with it."""
    x = V.comparable(m, c.metric).astype(np.float32)
    half = 0.5 * (x * x).sum(axis=1) if c.metric == "l2" else None
    at = np.array([reach.regions[r] for r in region.tolist()], dtype=np.int64)
    best = np.full(len(keys), np.iinfo(np.int64).max)
    same = len(a) == len(b) and (a == b).all()
    a, b = (rows[np.argsort(at[rows], kind="stable")] for rows in (a, b))
    edges = [0, *(np.flatnonzero(np.diff(at[a])) + 1).tolist(), len(a)]
    for first, last in zip(edges, edges[1:]):
        for begin in range(first, last, ROWS):
            mine = a[begin : min(begin + ROWS, last)]
            others = b[begin:] if same else b  # of a block with itself each pair once
            others = others[reach.may[at[mine[0]], at[others]]]
            for start in range(0, len(others), SCORES // (8 * ROWS)):
                i, j = _close(mine, others[start : start + SCORES // (8 * ROWS)], x, half, m, c)
                other = i != j
                np.minimum.at(best, i[other], keys[j[other]])
                if same:
                    np.minimum.at(best, j[other], keys[i[other]])
    on = a[best[a] < np.iinfo(np.int64).max]
    return on, best[on]


def _links(found: DataFrame, known: list[V.Collection], centres: dict[int, np.ndarray]) -> DataFrame:
    """Pairs (tab, key, root) of similar representatives of all regions: none is lost between representatives of different sets.

    The representatives of a table are cut into blocks of about SUPER along their regions, and each pair of blocks is
    compared in a task, but for the pairs of regions that the triangle inequality excludes. A task gives every representative at most one link,
    to the smallest similar key of a block; under one block's smallest key its whole set comes together.
    """
    reps = found.filter("vec IS NOT NULL")

    def norms(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tab, vec in parts:
            t, v = tab.to_numpy(), vec.to_pylist()
            out = np.zeros(len(t))
            for k in np.unique(t):
                on = np.flatnonzero(t == k)
                out[on] = np.sqrt((V.comparable(V.unpack([v[i] for i in on], known[k].dimension), known[k].metric).astype(np.float64) ** 2).sum(axis=1))
            yield pa.array(out)

    # at most REGIONS rows a table
    length = F.arrow_udf(norms, "double")("tab", "vec") if any(c.metric == "inner" for c in known) else F.lit(1.0)
    stats = reps.withColumn("norm", length).groupBy("tab", "region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).orderBy("tab", "region").collect()
    reach, blocks, total = {}, [], {}
    for tab in sorted({r["tab"] for r in stats}):
        mine = [r for r in stats if r["tab"] == tab]
        reach[tab] = _reach(known[tab], centres[tab], [r["region"] for r in mine], np.array([r["radius"] for r in mine]), np.array([r["norm"] for r in mine]))
        n = sum(r["n"] for r in mine)
        total[tab] = -(-n // SUPER)
        before = 0
        for r in mine:
            blocks.append((tab, r["region"], before, r["n"], -(-n // total[tab])))
            before += r["n"]
    spark = found.sparkSession
    at = spark.createDataFrame(blocks, "tab int, region int, before long, n long, size long")
    counts = spark.createDataFrame(list(total.items()), "tab int, blocks int")
    shared = spark.sparkContext.broadcast(reach)  # REGIONS x REGIONS flags a table
    # nearly equal blocks along the regions; a region that lies across a cut is divided by hash
    own = F.floor((F.col("before") + F.pmod(F.xxhash64("key"), F.col("n"))) / F.col("size")).cast("int")
    spread = (
        reps.join(F.broadcast(at), ["tab", "region"])
        .join(F.broadcast(counts), "tab")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tab", "key", "vec", "region", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        tab, a, b = (k.as_py() for k in key)
        c = known[tab]
        keys, block = table.column("key").to_numpy(), table.column("own").to_numpy()
        m = V.unpack(table.column("vec").to_pylist(), c.dimension)
        on, root = _smallest_similar(keys, m, table.column("region").to_numpy(), np.flatnonzero(block == a), np.flatnonzero(block == b), c, shared.value[tab])
        return pa.table({"tab": pa.array(np.full(len(on), tab), pa.int32()), "key": pa.array(keys[on]), "root": pa.array(root)})

    tasks = max(runtime.width(spark), sum(k * (k + 1) // 2 for k in total.values()))
    return spread.repartition(tasks, "tab", "a", "b").groupBy("tab", "a", "b").applyInArrow(compare, "tab int, key long, root long")


def _repeated_leaders(assigned: DataFrame) -> DataFrame:
    """Pairs (tab, key, root) of leaders and those that they follow in another block, where their segment is present again."""
    leaders = assigned.filter("vec IS NOT NULL").select("tab", "key")
    return assigned.filter("leader <> key").select("tab", "key", F.col("leader").alias("root")).join(leaders, ["tab", "key"], "left_semi")


def _smallest_labels(links: DataFrame) -> DataFrame:
    """For every key in links the smallest key connected with it: tab, key, label.

    In each round a key takes the smallest label beside it, and then the label of its label, so that the rounds grow with the logarithm of
    the longest way. The rounds before the last are deleted.
    """
    both = runtime.written(links.select("tab", "key", "root").union(links.select("tab", F.col("root").alias("key"), F.col("key").alias("root"))).distinct(), "both-ways")
    labels = runtime.written(both.groupBy("tab", "key").agg(F.least(F.col("key"), F.min("root")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select("tab", F.col("key").alias("root"), F.col("label").alias("theirs")), ["tab", "root"])
        best = seen.groupBy("tab", "key").agg(F.min("theirs").alias("theirs"))
        near = labels.join(best, ["tab", "key"]).select("tab", "key", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select("tab", F.col("key").alias("label"), F.col("label").alias("further"))
        step = runtime.written(near.join(jump, ["tab", "label"], "left").select("tab", "key", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("changed")), "labels")
        runtime.forget(labels)
        labels = step
        if not step.filter("changed").limit(1).count():
            runtime.forget(both)
            return labels.select("tab", "key", "label")


def cluster(segments: DataFrame, collections: DataFrame) -> Clusters:
    """Divides the live vectors of all tables into clusters of mutually similar vectors.

    segments: rows of vector_segments, collections: those of vector_collections (fixed size), whose metric and min_score
    hold. Two vectors are similar from min_score on. Sets that are similar throughout and don't overlap come out
    exactly, whatever regions their vectors are in; in others a vector follows the connected smallest key. Deleted vectors, vectors that
    aren't finite or have no key, segments of unknown tables and repeated segments don't count.
    """
    runtime.ship(segments.sparkSession)
    known = V.collections(collections)
    centres = region_centres(segments, known)
    assigned = assign(segments, known, centres)
    found = _representatives(assigned, known)
    roots = found.select("tab", "key", "root")
    repeated = _repeated_leaders(assigned)
    # links between leaders become links between their roots
    by_root = lambda c: roots.select("tab", F.col("key").alias(c), F.col("root").alias(f"{c}_root"))
    repeated = repeated.join(by_root("key"), ["tab", "key"]).join(by_root("root"), ["tab", "root"]).select("tab", F.col("key_root").alias("key"), F.col("root_root").alias("root")).filter("key <> root")
    labels = _smallest_labels(_links(found, known, centres).union(repeated))
    named = roots.join(labels.select("tab", F.col("key").alias("root"), "label"), ["tab", "root"], "left").select("tab", F.col("key").alias("leader"), F.coalesce("label", "root").alias("label"))
    # a key of a repeated segment may have a leader in each block
    once = assigned.select("tab", "key", "leader").join(named, ["tab", "leader"]).groupBy("tab", "key").agg(F.min("label").alias("label"))
    return Clusters(known, runtime.written(once, "clustered"))


def members(found: Clusters) -> DataFrame:
    """tab, key, label of the vectors in clusters of two or more. The smallest key of a cluster is found by its other members."""
    others = found.vectors.filter("key <> label")
    return others.unionByName(others.select("tab", F.col("label").alias("key"), "label").distinct())


def describe(segments: DataFrame, found: Clusters, typical: int = 3) -> DataFrame:
    """Per cluster of two or more: table_name, cluster_key, size, and the keys of the members nearest its centre, nearest first.

    Centres are means of the comparable vectors. Sums are taken in tasks before they are shuffled, and so are the nearest members, so
    that no task gets all members of a hot cluster. Equal distances: the smaller key first.
    """
    known = found.known
    dims = [c.dimension for c in known]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, keys, m in _live(batches, known):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), tab), pa.int32()), pa.array(keys), pa.array(V.pack(m), pa.binary())], names=["tab", "key", "vec"])

    raw = segments.select("table_name", "keys", "deleted", "vectors").mapInArrow(explode, "tab int, key long, vec binary")
    rows = runtime.written(raw.join(members(found), ["tab", "key"]).dropDuplicates(["tab", "key"]), "members")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tab, label, vec = b.column("tab").to_numpy(), b.column("label").to_numpy(), b.column("vec").to_pylist()
            out = []
            for t in np.unique(tab):
                at = np.flatnonzero(tab == t)
                x = V.comparable(V.unpack([vec[i] for i in at], dims[t]), known[t].metric).astype(np.float64)
                ids, inverse = np.unique(label[at], return_inverse=True)
                total = np.zeros((len(ids), dims[t]))
                np.add.at(total, inverse, x)
                out += [{"tab": int(t), "label": int(i), "n": int(n), "ls": s.tobytes()} for i, n, s in zip(ids, np.bincount(inverse), total)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("tab", pa.int32()), ("label", pa.int64()), ("n", pa.int64()), ("ls", pa.binary())]))

    kinds = pa.schema([("tab", pa.int32()), ("label", pa.int64()), ("size", pa.int64()), ("centre", pa.binary())])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the parts of each label, which come one after another."""
        label, n, total = None, 0, np.zeros(0)
        for b in batches:
            out = []
            for t, at, m, part in zip(*(b.column(c).to_pylist() for c in ("tab", "label", "n", "ls"))):
                if (t, at) == label:
                    n, total = n + m, total + np.frombuffer(part)
                    continue
                if label is not None:
                    out.append({"tab": label[0], "label": label[1], "size": n, "centre": (total / n).tobytes()})
                label, n, total = (t, at), m, np.frombuffer(part)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if label is not None:
            yield pa.RecordBatch.from_pylist([{"tab": label[0], "label": label[1], "size": n, "centre": (total / n).tobytes()}], schema=kinds)

    centres = rows.select("tab", "label", "vec").mapInArrow(sums, "tab int, label long, n long, ls binary")
    centres = centres.repartition("tab", "label").sortWithinPartitions("tab", "label").mapInArrow(totals, "tab int, label long, size long, centre binary")
    centres = runtime.written(centres, "cluster-centres")

    def distance(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for tab, vec, centre in parts:
            t, v, c = tab.to_numpy(), vec.to_pylist(), centre.to_pylist()
            out = np.empty(len(t))
            for k in np.unique(t):
                at = np.flatnonzero(t == k)
                x = V.comparable(V.unpack([v[i] for i in at], dims[k]), known[k].metric).astype(np.float64)
                out[at] = np.sqrt(((x - np.stack([np.frombuffer(c[i]) for i in at])) ** 2).sum(axis=1))
            yield pa.array(out)

    near = rows.join(centres.select("tab", "label", "centre"), ["tab", "label"]).select("tab", "label", "key", F.arrow_udf(distance, "double")("tab", "vec", "centre").alias("d"))
    w = Window.partitionBy("tab", "label").orderBy("d", "key")
    best = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical)
    most = best.groupBy("tab", "label").agg(F.sort_array(F.collect_list(F.struct("r", "key"))).alias("t"))
    names = F.array(*(F.lit(c.name) for c in known))
    return most.join(centres.select("tab", "label", "size"), ["tab", "label"]).select(
        F.element_at(names, F.col("tab") + 1).alias("table_name"), F.col("label").alias("cluster_key"), "size", F.col("t.key").alias("typical_keys")
    )
