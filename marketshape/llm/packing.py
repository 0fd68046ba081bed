"""Best-fit packing of items into containers of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


LOOK = 32  # pieces tried ahead when a container is opened; they only inform the choice of its length


def least_cost(s: int, room_of: list[int], smaller: list[int], overhead: int) -> int:
    """The length to open for a piece of ``s``: the one that costs least per token once filled.

    Each length that holds the piece is filled, on trial, with the largest of the
    ``smaller`` pieces still to come (ascending) that fit, and shortened to what it then
    holds; its cost is that length and the ``overhead`` over its contents.
    """
    best = None
    for length in room_of:
        if length < s:
            continue
        held, top = s, len(smaller)
        for _ in range(LOOK):
            top = bisect_right(smaller, length - held, 0, top) - 1
            if top < 0 or smaller[top] == 0:
                break
            held += smaller[top]
        cost = (room_of[bisect_left(room_of, held)] + overhead) / max(1, held)
        if best is None or cost < best[0]:
            best = cost, length
    return best[1]


def best_fit(sizes: np.ndarray, lengths: list[int], opened: int | None = None, overhead: int = 0) -> tuple[np.ndarray, list[int]]:
    """(container of each piece, contents of each container): best-fit decreasing.

    A piece goes into the fullest container that still holds it; if none does, one is
    opened: with the shortest of ``lengths`` that is at least ``opened`` and holds the
    piece, or without ``opened`` with the ``least_cost`` one.
    """
    order = np.argsort(-sizes, kind="stable")
    ascending = np.sort(sizes).tolist()
    where = np.empty(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (left, container), ascending
    for i in order:
        s = int(sizes[i])
        ascending.pop()
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, c = room.pop(at)
        else:
            c, left = len(used), (least_cost(s, lengths, ascending, overhead) if opened is None else lengths[bisect_left(lengths, max(s, opened))])
            used.append(0)
        used[c] += s
        where[i] = c
        insort(room, (left - s, c))
    return where, used


def _pack(lengths_of: dict[str, list[int]], overhead: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        kind, shard = g["container_kind"].iloc[0], int(g["shard"].iloc[0])
        lengths = lengths_of[kind]
        g = g.sort_values(["piece_tokens", "doc_id", "piece"], kind="stable", ignore_index=True)
        sizes = g["piece_tokens"].to_numpy(np.int64)
        tries = []
        for opened in (None, *lengths):  # chosen anew for every container, or always the same one: the cheapest packing counts
            where, used = best_fit(sizes, lengths, opened, overhead)
            final = [lengths[bisect_left(lengths, u)] for u in used]  # each downsized to its contents
            tries.append((sum(final) + overhead * len(final), len(tries), where, used, final))
        _, _, where, used, final = min(tries, key=lambda t: t[:2])
        return pd.DataFrame({"container_kind": kind, "container_id": [f"{kind}-{shard}-{c}" for c in where], "capacity_tokens": np.asarray(final, np.int64)[where], "used_tokens": np.asarray(used, np.int64)[where], "doc_id": g["doc_id"], "piece": g["piece"], "n_pieces": g["n_pieces"], "piece_tokens": sizes})

    return pack


def pack_items(items: DataFrame, kinds: dict[str, int], shard_items: int = 20_000, overhead: int = 0) -> DataFrame:
    """All items packed once for each kind, in containers of at most the kind's capacity.

    For a kind the permitted lengths are the capacities of all kinds up to its own; they
    are optimised jointly: every container is opened with the length that costs least for
    what it could still take, each ends as the shortest permitted length that holds its
    contents, and where always opening one length gives less total length (plus
    ``overhead`` a container), that packing counts. An item is split, into full
    containers and a rest, only if it exceeds the capacity alone.

    Items are spread by a hash of their row, not their id, over shards of about ``shard_items``, each packed by one
    task on sizes alone; a shard loses at most its few last containers. Rows:
    container_kind, container_id, capacity_tokens, used_tokens, doc_id, piece (from 0),
    n_pieces, piece_tokens. Items of size 0 or null take part with 0; a repeated id is
    an item each time; no items give no rows. ``items``: doc_id, size.
    """
    spark = items.sparkSession
    i = cut(items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-i.count() // shard_items))
    caps = spark.createDataFrame([(k, int(c)) for k, c in kinds.items() if c and c > 0], "container_kind string, capacity bigint")
    pieces = i.crossJoin(F.broadcast(caps)).withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))  # one row per kind of container
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))).withColumn("piece_tokens", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")))
    pieces = pieces.select("container_kind", "doc_id", "piece", "n_pieces", "piece_tokens", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    lengths = {k: sorted({int(x) for x in kinds.values() if x and 0 < x <= c}) for k, c in kinds.items() if c and c > 0}
    return pieces.groupBy("container_kind", "shard").applyInPandas(_pack(lengths, overhead), "container_kind string, container_id string, capacity_tokens bigint, used_tokens bigint, doc_id bigint, piece int, n_pieces int, piece_tokens bigint")
