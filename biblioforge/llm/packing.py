"""Containers of fixed capacity filled with texts, by sum-of-squares packing.

A level array counts the open containers by fill level. An item goes where the sum of the squared counts
grows least: into a container of level ``h`` (or a new one) so that levels stay spread and each size finds
its complement; among equals the fullest container wins. An item longer than the capacity is cut into full
containers and a rest; no other item is split. What the online pass leaves open is emptied, least filled
first, into the gaps of the others where its items fit exactly as they are.

Texts are packed in groups of bounded size by a hash of their ids, so no task sees more than one group and
the unused space that a group leaves open stays a fixed small part of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_DOCS = 50_000  # texts packed together; bounds a task
TIDY_BELOW = 0.97  # containers filled less than this are taken apart once more at the end


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers) for items of 1 to ``capacity``."""
    levels = np.zeros(capacity + 1, np.int64)  # open containers by level, 0 and full are never counted
    members: list[list[int]] = [[] for _ in range(capacity)]  # open containers by level
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            out[i] = n
            n += 1
            continue
        last = capacity - s  # highest level that still takes the item
        here, there = levels[: last + 1], levels[s : capacity + 1]
        gain = 2 * (there - here) + 2
        gain[here == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * there[0] + 1
        if here[last]:
            gain[last] = 1 - 2 * here[last]  # a full container leaves the array
        h = last - int(gain[::-1].argmin())
        if h == 0:
            c = n
            n += 1
        else:
            c = members[h].pop()
            levels[h] -= 1
        out[i] = c
        if h + s < capacity:
            levels[h + s] += 1
            members[h + s].append(c)
    return out, n


def tidy(sizes: np.ndarray, where: np.ndarray, n: int, capacity: int) -> np.ndarray:
    """Repack the items of containers that stayed open, largest first, each into the fullest gap that takes it."""
    fill = np.bincount(where, sizes, n).astype(np.int64)
    loose = np.flatnonzero(fill[where] < TIDY_BELOW * capacity)
    if not len(loose):
        return where
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    names = np.unique(where[loose]).tolist()[::-1]
    out = where.copy()
    room = np.zeros(capacity + 1, np.int64)  # containers by free space
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        s = int(sizes[i])
        at = int((room[s:] > 0).argmax()) + s
        if at <= capacity and room[at] > 0:
            c = stacks[at].pop()
            room[at] -= 1
        else:
            c, at = names.pop(), capacity
        out[i] = c
        if at > s:
            room[at - s] += 1
            stacks[at - s].append(c)
    used = len(np.unique(out[loose]))
    return out if used <= len(np.unique(where[loose])) else where


def assign(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """Pieces of texts with their containers. A text of 0 tokens stands in container 0."""
    whole = sizes // capacity
    whole = np.where((sizes % capacity == 0) & (sizes > 0), whole - 1, whole)
    n_pieces = np.where(sizes > 0, whole + 1, 1)
    row = np.repeat(np.arange(len(ids)), n_pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    length = np.where(piece < whole[row], capacity, sizes[row] - whole[row] * capacity)
    where = np.zeros(len(row), np.int64)
    real = length > 0
    if real.any():
        c, n = pack(length[real], capacity)
        c = tidy(length[real], c, n, capacity)
        where[real] = np.unique(c, return_inverse=True)[1]
    return pd.DataFrame({"doc_id": ids[row], "piece": piece.astype(np.int32), "n_tokens": length.astype(np.int32), "container_no": where})


def packed(sized: DataFrame, capacities: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(size_name, container, doc_id, piece, n_tokens) for each size.

    ``sized`` has doc_id and n_tokens, ``capacities`` size_name and capacity_tokens (a fixed small table; null
    or non-positive capacities are ignored). Empty tables give an empty result; repeated ids are packed apart.
    """
    sizes = [(r[0], int(r[1])) for r in capacities.select("size_name", "capacity_tokens").where("capacity_tokens > 0").limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("container sizes are meant to be a small table")
    n = max(1, -(-sized.count() // group_docs))
    each = F.array(*[F.struct(F.lit(a).alias("size_name"), F.lit(c).alias("capacity")) for a, c in sizes]) if sizes else F.array().cast("array<struct<size_name:string,capacity:int>>")
    rows = sized.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("g"), F.explode(each).alias("s")).select("doc_id", "n_tokens", "g", "s.*")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        g, name, capacity = key
        p = p.sort_values("doc_id", kind="stable")
        out = assign(p.doc_id.to_numpy(), p.n_tokens.to_numpy().astype(np.int64), int(capacity))
        out["container"] = [f"{name}-{g}-{c}" for c in out.container_no]
        out.insert(0, "size_name", name)
        return out[["size_name", "container", "doc_id", "piece", "n_tokens"]]

    return rows.groupBy("g", "size_name", "capacity").applyInPandas(run, "size_name string, container string, doc_id bigint, piece int, n_tokens int")
