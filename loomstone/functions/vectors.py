"""Vector column expressions and their numpy twins used inside block scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_CELLS = 250_000  # numbers of vectors that are measured in 64 bits at once

def _dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; empty, unequal or zero vectors give -1."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(F.coalesce(usable, F.lit(False)), _dot(a, b) / norms).otherwise(F.lit(-1.0))


def squared_l2(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, d: s + d * d)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def nearness(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


_HALF = 2.0**-24  # the most by which rounding to 32 bits moves a number near 1


def lifted(rows: np.ndarray, asked: bool) -> np.ndarray:
    """Rows in 32 bits, two columns wider, whose product with the lifted rows of the other side is about their squared distance."""
    squares, ones = np.einsum("ij,ij->i", rows, rows)[:, None], np.ones((len(rows), 1))
    with np.errstate(over="ignore"):
        return np.concatenate([-2.0 * rows, squares, ones] if asked else [rows, ones, squares], axis=1).astype(np.float32)


def _slack(asked: np.ndarray, given: np.ndarray) -> np.ndarray:
    """For every query more than the product in 32 bits can be off."""
    wide = 4 * (asked.shape[1] + 2) * _HALF
    return wide * (asked[:, -2].astype(np.float64) + given[:, -1].max(initial=0.0).astype(np.float64)) + 1e-30


def kth_bound(asked: np.ndarray, given: np.ndarray, k: int, passed: np.ndarray | None = None) -> np.ndarray:
    """For every query a number that its ``k``-th smallest squared distance does not pass; infinite where that is not known.

    Both sides are lifted, ``passed`` marks pairs that take no part.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        about = asked @ given.T
        if passed is not None:
            about[passed] = np.inf
        bound = np.partition(about, k - 1, axis=1)[:, k - 1] + _slack(asked, given)
        small = np.isfinite(bound) & (asked[:, -2] + given[:, -1].max(initial=0.0) < 1e37)  # no sum passed 32 bits
    return np.where(small, bound, np.inf)


def near_pairs(queries: np.ndarray, items: np.ndarray, asked: np.ndarray, given: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, item row, squared distance) of all pairs with a squared distance of at most the query's ``most``.

    ``asked`` and ``given`` are both sides lifted. A product in 32 bits is off
    by less than the slack, so what lies beyond it needs no other look; all
    else is measured in 64 bits, what passes 32 bits too.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        limit = np.nextafter((most + _slack(asked, given)).astype(np.float32), np.float32(np.inf))
        about = asked @ given.T
        near = about <= limit[:, None]
        strange = not np.isfinite(about.sum())  # numbers too large for 32 bits, or none
        at = _places(near | ~np.isfinite(about) if strange else near)
        row, col = np.divmod(at, len(items))
        dist, step = np.empty(len(at)), max(1, PAIR_CELLS // max(queries.shape[1], 1))
        for low in range(0, len(at), step):
            part = slice(low, low + step)
            diff = queries[row[part]] - items[col[part]]
            dist[part] = np.einsum("ij,ij->i", diff, diff)
    near = dist <= most[row]
    return row[near], col[near], dist[near]


def _places(held: np.ndarray) -> np.ndarray:
    """Flat places of what holds, eight at a time, as little does."""
    flat = held.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    inside = np.flatnonzero(flat.reshape(-1, 8)[eights])
    return eights[inside >> 3] * 8 + (inside & 7)


def block_distance(queries: np.ndarray, items: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every query row to every item row of one block, smaller is nearer."""
    both = queries @ items.T
    if metric == "cosine":
        qn, cn = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (queries, items))
        scale = np.outer(qn, cn)
        if np.min(qn, initial=1.0) * np.min(cn, initial=1.0) > 0:
            np.divide(both, scale, out=both)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                both = np.where(scale > 0, both / scale, -1.0)
        return np.negative(both, out=both)
    if metric == "l2sq":
        d = np.add.outer(np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", items, items))
        both *= 2.0
        d -= both
        return np.maximum(d, 0.0, out=d)
    raise ValueError(f"unknown metric {metric}")
