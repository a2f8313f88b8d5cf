"""Whether a key occurred before: an Elias–Fano index of key fingerprints in hash partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec import runtime

#: Probability that a new key is taken for a seen one. The index needs about 2 + log2(1 / rate) bits a key.
WRONG_RATE = 2.0**-30
#: Keys a partition of the index is planned for.
KEYS_PER_PARTITION = 1 << 18

#: Batches in which the incoming records are taken, in order of arrival.
BATCHES = 3
#: Most bits of a fingerprint.
MARK_BITS = 60

INDEX_SCHEMA = "part int, n long, bits int, low_bits int, high binary, low binary"
_WORD = np.uint64(64)


class EliasFano:
    """A sorted set of n integers below 2 ** bits in about n * (2 + bits - log2 n) bits.

    The upper part of value i is stored in unary: bit (value >> low_bits) + i is set. The lower low_bits are
    packed one after another.
    """

    def __init__(self, n: int, bits: int, low_bits: int, high: bytes, low: bytes):
        self.n, self.bits, self.low_bits = n, bits, low_bits
        self.high, self.low = high, low
        self._words = np.frombuffer(low + bytes(-len(low) % 8 + 16), dtype="<u8")
        self._starts: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray, bits: int) -> EliasFano:
        """values: sorted, distinct, uint64, below 2 ** bits."""
        n = len(values)
        low_bits = max(0, bits - max(0, math.ceil(math.log2(n)))) if n else 0
        if not n:
            return cls(0, bits, 0, b"", b"")
        buckets = 1 << (bits - low_bits)
        unary = np.zeros(n + buckets, dtype=np.uint8)
        unary[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        words = np.zeros((n * low_bits + 63) // 64 + 2, dtype="<u8")
        if low_bits:
            lows = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, lows << shift)
            over = shift + np.uint64(low_bits) > _WORD
            np.bitwise_or.at(words, word[over] + 1, lows[over] >> (_WORD - shift[over]))
        return cls(n, bits, low_bits, np.packbits(unary, bitorder="little").tobytes(), words.tobytes()[: (n * low_bits + 7) // 8])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The lower parts of the values at positions i."""
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self._words[word] >> shift
        crossing = shift > 0
        out[crossing] |= self._words[word[crossing] + 1] << (_WORD - shift[crossing])
        return out & np.uint64((1 << self.low_bits) - 1)

    def _bounds(self) -> np.ndarray:
        """At h, the number of values whose upper part is below h: the select of the h-th zero in the unary part."""
        if self._starts is None:
            buckets = 1 << (self.bits - self.low_bits)
            unary = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), count=self.n + buckets, bitorder="little")
            zeros = np.flatnonzero(unary == 0)
            self._starts = np.concatenate([[0], zeros - np.arange(buckets)])
        return self._starts

    def decode(self) -> np.ndarray:
        """All values, sorted."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        upper = np.repeat(np.arange(1 << (self.bits - self.low_bits), dtype=np.uint64), np.diff(self._bounds()))
        return (upper << np.uint64(self.low_bits)) | self._lows(np.arange(self.n))

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """For each probe whether its successor, the smallest value not below it, equals it.

        The search is confined to the values that share the probe's upper part; the next one follows step by step.
        """
        found = np.zeros(len(probes), dtype=bool)
        if not self.n:
            return found
        starts = self._bounds()
        upper = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        want = probes & np.uint64((1 << self.low_bits) - 1)
        at, end = starts[upper].copy(), starts[upper + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            have = self._lows(at[open_])
            found[open_[have == want[open_]]] = True
            open_ = open_[have < want[open_]]  # else the successor is reached
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return found

    def merge(self, values: np.ndarray) -> EliasFano:
        """The set with further sorted values, merged in one pass over both."""
        mine = self.decode()
        both = np.empty(len(mine) + len(values), dtype=np.uint64)
        place = np.searchsorted(mine, values) + np.arange(len(values))
        taken = np.zeros(len(both), dtype=bool)
        taken[place] = True
        both[taken], both[~taken] = values, mine
        if len(both):
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return EliasFano.encode(both, self.bits)


def plan(keys: int, wrong_rate: float = WRONG_RATE, per_partition: int = KEYS_PER_PARTITION) -> tuple[int, int]:
    """Number of partitions, and bits of a fingerprint within one, for so many keys.

    A new key is wrong with a probability of n / 2 ** bits at most, n being the keys in its partition.
    """
    parts = max(1, -(-keys // per_partition))
    bits = math.ceil(math.log2(max(2, 2 * min(keys, per_partition)))) + math.ceil(-math.log2(wrong_rate))
    return parts, min(bits, MARK_BITS)


def fingerprints(df: DataFrame, key: str, parts: int, bits: int) -> DataFrame:
    """df's rows with a key, with part and mark (the fingerprint). Keys are compared byte by byte.

    Both come from the MD5 sum of the key, a hash that other systems have too, so that an index can be probed and checked elsewhere: mark
    is the upper part of its first 60 bits, part the remainder of its last 60.
    """
    h = F.md5(F.col(f"`{key}`").cast("binary"))
    number = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("long")
    part = F.pmod(number(18), F.lit(parts)).cast("int")
    return df.filter(F.col(f"`{key}`").isNotNull()).withColumns({"part": part, "mark": F.shiftrightunsigned(number(1), MARK_BITS - bits)})


def _encoded(marks: pd.Series, bits: int) -> EliasFano:
    return EliasFano.encode(np.unique(marks.to_numpy().astype(np.uint64)), bits)


def _row(part: int, ef: EliasFano) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [ef.n], "bits": [ef.bits], "low_bits": [ef.low_bits], "high": [ef.high], "low": [ef.low]})


def build_index(history: DataFrame, key: str, parts: int, bits: int) -> DataFrame:
    """The index of all keys of history: a row per partition that has keys. Null keys have no entry.

    Keys are made distinct by fingerprint within tasks before the shuffle, so a hot key arrives once from
    each of them; partitions are even, since they are hashed.
    """
    runtime.ship(history.sparkSession)
    marks = fingerprints(history, key, parts, bits).select("part", "mark").distinct()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return _row(int(pdf["part"].iloc[0]), _encoded(pdf["mark"], bits))

    return marks.groupBy("part").applyInPandas(build, INDEX_SCHEMA)


def _first_of_batch(batch: DataFrame, key: str, order: str, parts: int, bits: int) -> DataFrame:
    """Each key's first arrival in the batch."""
    return fingerprints(batch, key, parts, bits).groupBy("part", "mark").agg(F.min(f"`{order}`").alias("first"))


def unseen(index: DataFrame, batch: DataFrame, key: str, order: str, parts: int, bits: int) -> DataFrame:
    """The order values of the batch's records whose key is new: neither in the index nor in an earlier record."""
    runtime.ship(batch.sparkSession)

    def probe(k: tuple, idx: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        marks = new["mark"].to_numpy().astype(np.uint64)
        if not len(idx):
            return new[["first"]]
        r = idx.iloc[0]
        ef = EliasFano(int(r["n"]), int(r["bits"]), int(r["low_bits"]), r["high"], r["low"])
        return new.loc[~ef.contains(marks), ["first"]]

    first = _first_of_batch(batch, key, order, parts, bits)
    return index.groupBy("part").cogroup(first.groupBy("part")).applyInPandas(probe, "first long")


def merge_batch(index: DataFrame, batch: DataFrame, key: str, parts: int, bits: int) -> DataFrame:
    """The index with the batch's keys merged in, partition by partition, as a table in the shared folder."""
    runtime.ship(batch.sparkSession)
    marks = fingerprints(batch, key, parts, bits).select("part", "mark").distinct()

    def merge(k: tuple, idx: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(new["mark"].to_numpy().astype(np.uint64))
        if not len(idx):
            return _row(int(k[0]), EliasFano.encode(values, bits))
        r = idx.iloc[0]
        ef = EliasFano(int(r["n"]), int(r["bits"]), int(r["low_bits"]), r["high"], r["low"])
        return _row(int(k[0]), ef.merge(values))

    return runtime.written(index.groupBy("part").cogroup(marks.groupBy("part")).applyInPandas(merge, INDEX_SCHEMA), "seen-index")


def seen_before(history: DataFrame, incoming: DataFrame, key: str, order: str, wrong_rate: float = WRONG_RATE, batches: int = BATCHES) -> DataFrame:
    """The rows of incoming whose key occurs in history or in a row of incoming with a smaller order value.

    order: a unique integer column of incoming, its order of arrival. A null key was never seen and never
    comes out; empty strings are keys; repeated history rows count once. The index of history is built once; then the records are taken
    in batches, ranges of order: each is probed against the index and then merged into it, partition by partition. A new key is wrongly said to be seen with
    a probability of at most wrong_rate, a seen one is always found. Memory: the index, 4 bytes a
    key at the default rate. Records are only ever dropped by their unique order value, so a hot key is not
    gathered anywhere.
    """
    o = F.col(f"`{order}`")
    arrived = incoming.agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("first"), F.max(o).alias("last")).first()
    parts, bits = plan(history.count() + arrived["n"], wrong_rate)
    index = runtime.written(build_index(history.select(F.col(f"`{key}`").alias("k")), "k", parts, bits), "seen-index")
    records = incoming.select(F.col(f"`{key}`").alias("k"), o.alias("o"))
    first, last = arrived["first"] or 0, arrived["last"] or 0
    edges = [first + (last + 1 - first) * i // batches for i in range(batches + 1)]
    new = None
    for i in range(batches):
        batch = records.filter((F.col("o") >= edges[i]) & (F.col("o") < edges[i + 1]))
        found = unseen(index, batch, "k", "o", parts, bits)
        new = found if new is None else new.unionByName(found)
        if i + 1 < batches:
            index = merge_batch(index, batch, "k", parts, bits)
    found = incoming.filter(F.col(f"`{key}`").isNotNull()).join(new.withColumnRenamed("first", order), order, "left_anti")
    return found.select(*(f"`{c}`" for c in incoming.columns))


def strictest(configs: DataFrame, rate: str) -> float:
    """The least allowed rate of a table of configurations, which is small; WRONG_RATE if none is given."""
    least = configs.filter(F.col(rate) > 0).agg(F.min(rate)).first()[0]
    return WRONG_RATE if least is None else min(0.5, least)


def report(history: DataFrame, incoming: DataFrame, configs: DataFrame, key: str, order: str, config: str, rate: str, wrong_rate: float | None = None) -> DataFrame:
    """Per configuration: records with a key, said to be seen, wrong answers and their rate among new keys, and the allowed rate.

    The index is made for wrong_rate, by default the strictest allowed rate, since one index serves all configurations.
    Wrong answers are counted against an exact comparison of the keys themselves. A configuration without an
    allowed rate (null) allows none. within: whether the rate keeps to it. Records of no known configuration
    count under a null one.
    """
    wrong_rate = strictest(configs, rate) if wrong_rate is None else wrong_rate
    keyed = incoming.filter(F.col(f"`{key}`").isNotNull()).select(F.col(order).alias("o"), F.col(key).alias("k"), F.col(config).alias("c"))
    stored = history.select(F.col(f"`{key}`").alias("k"))
    said = seen_before(stored, keyed, "k", "o", wrong_rate).select(F.col("o").alias("said"))
    known = stored.filter(F.col("k").isNotNull()).select(F.col("k").alias("known")).distinct()
    truly_new = keyed.groupBy("k").agg(F.min("o").alias("o")).join(known, F.col("k") == F.col("known"), "left_anti").select(F.col("o").alias("new"))
    rows = keyed.join(said, F.col("o") == F.col("said"), "left").join(truly_new, F.col("o") == F.col("new"), "left")
    per = rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count("said").alias("n_seen"),
        F.count("new").alias("n_new"),
        F.count(F.when(F.col("said").isNotNull() == F.col("new").isNotNull(), 1)).alias("n_wrong"),
    )
    limits = configs.select(F.col(config).alias("cc"), F.col(rate).alias("allowed_rate"))
    share = F.when(F.col("n_new") > 0, F.col("n_wrong") / F.col("n_new")).otherwise(F.lit(0.0))
    return per.join(limits, F.col("c") == F.col("cc"), "left").select(
        F.col("c").alias(config), "n_records", "n_seen", "n_wrong", share.alias("wrong_rate"), "allowed_rate", (share <= F.coalesce("allowed_rate", F.lit(0.0))).alias("within")
    )
