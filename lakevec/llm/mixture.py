"""Mixing sources to target shares of tokens by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec import runtime

#: Partitions whose residuals are combined in one task of a level of the reduction tree.
FAN_IN = 32
#: Rows that are paired at once, about: the lowest groups of the tree.
BLOCK = 1 << 17

_STATE = "doc long, source string, size long, copies long, rest double, part int"


def _uniform(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers below 1 from pairs of ids, the same in every run: two rounds of a 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(seed)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def settle(ids: np.ndarray, sizes: np.ndarray, fractions: np.ndarray, seed: int) -> np.ndarray:
    """Fractions of which all but at most one became 0 or 1; the total of size x fraction is kept exactly.

    Open fractions are paired. In a pair, mass (in tokens) moves from one to the other until one of them is
    integral; of the two ways to get there one is drawn so that each fraction keeps its expectation. Every round
    settles at least one of each pair, all pairs at once. Rows without size move no mass: they are drawn alone.
    """
    f = fractions.copy()
    empty = sizes <= 0
    f[empty] = (_uniform(ids[empty], ids[empty], seed) < f[empty]).astype(np.float64)
    open_ = np.flatnonzero((f > 0) & (f < 1))
    while len(open_) > 1:
        i, j = open_[: len(open_) // 2 * 2 : 2], open_[1::2]
        a, b = sizes[i].astype(np.float64), sizes[j].astype(np.float64)
        up = np.minimum((1 - f[i]) * a, f[j] * b)  # tokens that i can take from j
        down = np.minimum(f[i] * a, (1 - f[j]) * b)  # tokens that j can take from i
        raise_i = _uniform(ids[i], ids[j], seed) * (up + down) < down
        moved = np.where(raise_i, up, -down)
        fi, fj = f[i] + moved / a, f[j] - moved / b
        # the one that reached its bound is set to it exactly
        i_done = np.where(raise_i, (1 - f[i]) * a <= f[j] * b, f[i] * a <= (1 - f[j]) * b)
        f[i] = np.where(i_done, np.where(raise_i, 1.0, 0.0), np.clip(fi, 0, 1))
        f[j] = np.where(i_done, np.clip(fj, 0, 1), np.where(raise_i, 0.0, 1.0))
        open_ = open_[(f[open_] > 0) & (f[open_] < 1)]
    return f


def _settled(table: pa.Table, seed: int, part: int) -> Iterator[pa.RecordBatch]:
    """The rows of one task after pairing within each source, in an order that doesn't depend on how they came."""
    table = table.sort_by([("source", "ascending"), ("size", "ascending"), ("doc", "ascending")])
    doc, size = table.column("doc").to_numpy(), table.column("size").to_numpy()
    copies, rest = table.column("copies").to_numpy().copy(), table.column("rest").to_numpy().copy()
    source = table.column("source").combine_chunks().dictionary_encode()
    code = source.indices.to_numpy(zero_copy_only=False)
    for s in np.unique(code):
        at = np.flatnonzero(code == s)
        f = settle(doc[at], size[at], rest[at], seed)
        done = (f == 0) | (f == 1)
        copies[at] += np.where(done, f, 0).astype(np.int64)
        rest[at] = np.where(done, 0, f)
    columns = {"doc": doc, "source": table.column("source"), "size": size, "copies": copies, "rest": rest, "part": np.full(len(doc), part, dtype=np.int32)}
    kinds = pa.schema([("doc", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("copies", pa.int64()), ("rest", pa.float64()), ("part", pa.int32())])
    yield from pa.table({k: pa.chunked_array(v.chunks, type=kinds.field(k).type) if isinstance(v, pa.ChunkedArray) else pa.array(v, type=kinds.field(k).type) for k, v in columns.items()}, schema=kinds).to_batches()


def plan(totals: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """Per source of weights: its share, size, cap, and the copies that every unit of its size must have.

    totals: source, size. weights: source (unique), target_share, max_repeats. Sources without size can't
    contribute; the shares of the others are scaled to sum 1 (goal_share). total: size of the mixture. By default it is the
    largest in which every source reaches its goal within its cap. If a larger one is asked for, sources at
    their cap fall short, and the actual shares show it. Shares that are null or not positive count as 0.
    """
    w = weights.filter(F.col("source").isNotNull()).select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")
    )
    rows = w.join(totals.select(F.col("source").alias("t_source"), "size"), F.col("source") == F.col("t_source"), "left").drop("t_source")
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0)))
    usable = (F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    scale = rows.filter(usable).agg(F.sum("target_share").alias("all_shares"), F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("per_share"))
    goal = F.when(usable, F.col("target_share") / F.col("all_shares")).otherwise(F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(scale)).withColumn("goal_share", goal)  # one row
    wanted = F.lit(float(total)) if total is not None else F.col("per_share") * F.col("all_shares")
    each = F.when(F.col("goal_share") > 0, F.least(F.col("goal_share") * wanted / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return rows.withColumn("each", each).select("source", "target_share", "goal_share", "max_repeats", "size", "each")


def mix(docs: DataFrame, doc_id: str, source: str, size: str, weights: DataFrame, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """A mixture of docs with the target shares of weights: (doc, source, size, copies) and the report of shares.

    docs: doc_id (unique integer), source, size (null or negative: 0). Each document of a source has the same expected copies,
    those of plan(); their integral part is given, and the fractions are rounded by weighted pivotal rounding: in
    groups of about BLOCK by the hash of the id, then the open rows of FAN_IN groups together, and so on in a tree, so that per source at most one
    fraction is left, which is drawn. A source's tokens thus miss its goal by at most one document. No document
    has more than max_repeats copies. Every document comes out once, with 0 copies if it isn't chosen, also
    those without or with an unknown source. Groups, order and draws depend on the ids only, so that the
    result is the same however the rows lie in tasks. Report: source, target_share, goal_share, size, n_docs, n_copies, tokens, actual_share.
    """
    runtime.ship(docs.sparkSession)
    sized = runtime.written(
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{source}`").alias("source"), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("size")),
        "sized",
    )
    totals = runtime.written(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "totals")
    goals = runtime.written(plan(totals.select("source", "size"), weights, total).coalesce(1), "goals")
    # as many rows as weights has sources, a table of fixed size
    each = goals.select(F.col("source").alias("g_source"), "each", "max_repeats")
    started = sized.join(F.broadcast(each), F.col("source") == F.col("g_source"), "left").withColumn("each", F.coalesce("each", F.lit(0.0)))
    whole = F.floor(F.col("each"))
    tasks = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    part = F.pmod(F.xxhash64("doc"), F.lit(tasks)).cast("int")
    rows = started.select("doc", "source", "size", whole.cast("long").alias("copies"), (F.col("each") - whole).alias("rest"), part.alias("part"))

    def settled(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_settled(table.select(["doc", "source", "size", "copies", "rest", "part"]), seed, key[1].as_py())))

    def combined(open_rows: DataFrame) -> DataFrame:
        return runtime.written(open_rows.groupBy("source", "part").applyInArrow(settled, _STATE), "combined")

    level = combined(rows.filter("rest > 0"))
    done = [rows.filter("rest = 0"), level.filter("rest = 0")]
    left = level.filter("rest > 0")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = combined(left.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")))
        done.append(level.filter("rest = 0"))
        left = level.filter("rest > 0")
    last = F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(1 << 30)) / float(1 << 30) < F.col("rest")
    done.append(left.withColumn("copies", F.col("copies") + last.cast("long")))
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    chosen = chosen.select("doc", "source", "size", "copies")
    reached = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("size") * F.col("copies")).alias("tokens"))
    everything = reached.agg(F.sum("tokens").alias("all_tokens"))
    zero = F.lit(0).cast("long")
    report = (
        goals.join(reached.withColumnRenamed("source", "r_source"), F.col("source") == F.col("r_source"), "left")
        .crossJoin(F.broadcast(everything))  # one row
        .select(
            "source",
            "target_share",
            "goal_share",
            "size",
            F.coalesce("n_docs", zero).alias("n_docs"),
            F.coalesce("n_copies", zero).alias("n_copies"),
            F.coalesce("tokens", zero).alias("tokens"),
            F.when(F.col("all_tokens") > 0, F.coalesce("tokens", zero) / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
        )
    )
    return chosen, report
