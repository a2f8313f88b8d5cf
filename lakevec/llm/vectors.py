"""Packed vectors, metrics and the vector tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Collection:
    """A table of vectors: how they are compared and what counts as similar."""

    name: str
    dimension: int
    metric: str
    top_k: int
    min_score: float


def collections(df: DataFrame) -> list[Collection]:
    """The rows of vector_collections, a table of fixed size, in order of name."""
    rows = df.filter(F.col("table_name").isNotNull()).orderBy("table_name").collect()
    return [Collection(r["table_name"], r["dimension"], r["metric"].strip().lower(), r["top_k"] or 0, r["min_score"]) for r in rows]


def pack(m: np.ndarray) -> list[bytes]:
    """The rows of a float32 matrix as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float16)
    exact = (half.astype(np.float32) == m).all(axis=1)
    return [half[i].tobytes() if exact[i] else m[i].tobytes() for i in range(len(m))]


def unpack(rows: list[bytes], dimension: int) -> np.ndarray:
    """The float32 matrix of packed rows."""
    out = np.empty((len(rows), dimension), dtype=np.float32)
    short = np.fromiter((len(r) == 2 * dimension for r in rows), dtype=bool, count=len(rows))
    if short.all():
        out[:] = np.frombuffer(b"".join(rows), dtype=np.float16).reshape(-1, dimension)
        return out
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, dtype=np.float16 if short[i] else np.float32)
    return out


def comparable(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in which the metric is a dot product or distance: for cosine of length 1, zero vectors staying zero."""
    if metric != "cosine":
        return m
    wide = m.astype(np.float64)
    norm = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return wide / np.where(norm == 0, 1.0, norm)


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all of a against all of b, both comparable(); higher is better, l2 is minus the distance."""
    dot = a @ b.T
    if metric != "l2":
        return dot
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * dot
    return -np.sqrt(np.maximum(square, 0))


def exact_scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores in double precision of each row of a against its rows of b, (n, d) against (n, c, d), raw vectors."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "l2":
        return -np.sqrt(((b - a[:, None, :]) ** 2).sum(axis=2))
    dot = np.einsum("nd,ncd->nc", a, b)
    if metric == "inner":
        return dot
    norm = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=2))
    return np.where(norm == 0, 0.0, dot / np.where(norm == 0, 1.0, norm))


def segment_parts(keys: list, vectors: np.ndarray, deleted: list | None, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a segment that aren't deleted. Vectors of wrong number or not finite, and null keys, are left out."""
    n = min(len(keys), len(vectors) // dimension if dimension else 0)
    m = np.asarray(vectors[: n * dimension], dtype=np.float32).reshape(n, dimension)
    live = np.isfinite(m).all(axis=1)
    for i in range(n):
        if keys[i] is None or (deleted is not None and i < len(deleted) and deleted[i]):
            live[i] = False
    return np.array([k if k is not None else 0 for k in keys[:n]], dtype=np.int64)[live], m[live]
