"""Persistent homology of small distance matrices and summaries of its diagrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import spread

INF = float("inf")

#: The rank of a distance that is no edge, and the numbers in a block of simplices times points.
NO_EDGE, BLOCK = 1 << 40, 1 << 20


def _simplices(r: np.ndarray, dim: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (corners, reach) of all simplices of ``dim`` whose edges have a rank of at most ``last``; reach: the longest edge's rank."""
    n = len(r)
    if dim == 0:
        yield np.arange(n)[:, None], np.zeros(n, np.int64)
        return
    for corners, reach in _simplices(r, dim - 1, last):
        for c, far in _blocks(n, corners, reach):  # grow by a corner beyond the last
            new = _grown(r, c, far)
            at, v = np.nonzero((np.arange(n)[None, :] > c[:, -1:]) & (new <= last))
            yield np.column_stack([c[at], v]), new[at, v]


def _blocks(n: int, *arrays: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    step = max(1, BLOCK // n)
    for a in range(0, len(arrays[0]), step):
        yield tuple(x[a : a + step] for x in arrays)


def _grown(r: np.ndarray, corners: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The rank of every simplex with every point (a column each) as one more corner; its own corners give no edge's rank."""
    out = np.repeat(reach[:, None], len(r), axis=1)
    for c in corners.T:
        np.maximum(out, r[c], out=out)
    np.put_along_axis(out, corners, NO_EDGE, axis=1)
    return out


def _code(corners: np.ndarray, n: int) -> np.ndarray:
    """A number for every simplex, by its corners as digits."""
    out = np.zeros(len(corners), np.int64)
    for c in corners.T:
        out = out * n + c
    return out


def _latest_facet(r: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, reach, code) of the facet of every simplex that comes last in the filtration: the longest, of these the one of the highest corners."""
    size = corners.shape[1]
    facets = [np.delete(corners, k, axis=1) for k in range(size)]  # of rising k the corners fall
    reach = np.stack([np.max([r[f[:, i], f[:, j]] for i in range(size - 1) for j in range(i)] or [np.zeros(len(f), np.int64)], axis=0) for f in facets], axis=1)
    which = reach.argmax(axis=1)
    own = np.stack(facets, axis=1)[np.arange(len(corners)), which]
    return own, reach[np.arange(len(corners)), which], _code(own, len(r))


def _pairs(r: np.ndarray, q: int, last: int, cleared: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """((rank of birth, rank of death) of dimension ``q``, -1 for none; codes of the simplices of q + 1 that end one), by cohomology.

    A column is a simplex's cofacets, its pivot the first of them, a simplex later in the
    filtration is added to an earlier one. Most simplices are the last facet of their
    first cofacet: such two are a pair at once and their column, if others need it, is
    made again. Only the rest are reduced. ``cleared``: codes of simplices that end a
    bar of the dimension below.
    """
    n, unit = len(r), len(r) ** (q + 2)
    pairs, ends, rest = [], [], [(np.zeros((0, q + 1), np.int64), np.zeros(0, np.int64))]
    for corners, reach in _simplices(r, q, last):
        stay = ~np.isin(_code(corners, n), cleared)
        for c, far in _blocks(n, corners[stay], reach[stay]):
            grown = _grown(r, c, far)
            v = grown.argmin(axis=1)
            to = grown[np.arange(len(c)), v]
            t = np.sort(np.column_stack([c, v]), axis=1)
            at_once = (to <= last) & (_latest_facet(r, t)[2] == _code(c, n))
            ends.append(_code(t[at_once], n))
            pairs += [(int(a), int(b)) for a, b in zip(far[at_once], to[at_once], strict=True) if b > a]
            rest.append((c[~at_once], far[~at_once]))
    corners, reach = (np.concatenate(x) for x in zip(*rest, strict=True))
    order = np.lexsort((_code(corners, n), reach))[::-1]
    corners, reach = corners[order], reach[order]

    def columns(c: np.ndarray, far: np.ndarray) -> list[set[int]]:
        """Cofacets as numbers in the order of the filtration: rank times ``unit`` plus code."""
        grown = _grown(r, c, far)
        at, v = np.nonzero(grown <= last)
        keys = (_code(np.sort(np.column_stack([c[at], v]), axis=1), n)).tolist()
        keys = [a * unit + b for a, b in zip(grown[at, v].tolist(), keys, strict=True)]
        edges = np.searchsorted(at, np.arange(len(c) + 1)).tolist()
        return [set(keys[a:b]) for a, b in pairwise(edges)]

    @cache
    def at_once_by(key: int) -> frozenset[int] | None:
        """The column of the simplex paired at once with this cofacet, if one is."""
        digits, code = [], key % unit
        for _ in range(q + 2):
            code, x = divmod(code, n)
            digits.append(x)
        c, far, _ = _latest_facet(r, np.array([digits[::-1]]))
        column = columns(c, far)[0]
        return frozenset(column) if min(column) == key else None

    reduced: dict[int, set[int]] = {}
    for c, far in _blocks(n, corners, reach):
        for column, born in zip(columns(c, far), far.tolist(), strict=True):
            while column:
                low = min(column)
                other = reduced.get(low) or at_once_by(low)
                if other is None:
                    break
                column ^= other
            if column:
                reduced[low] = column
                ends.append(np.array([low % unit]))
                if low // unit > born:
                    pairs.append((born, low // unit))
            else:
                pairs.append((born, -1))
    return pairs, np.concatenate(ends) if ends else np.zeros(0, np.int64)


class _Cocycles:
    """The cocycles of one dimension that are alive, one by one a bit of the numbers that simplices have: the values of all cocycles on it.

    One that ends is the youngest of those that can't go on; it is added to the others of
    them. Numbers written before still hold its bit, until ``now`` reads them: each ended
    bit there stands for itself and older ones (``rows``), so from the highest down each
    is replaced once.
    """

    def __init__(self) -> None:
        self.born, self.rows, self.ended, self.alive, self.pairs = [], {}, 0, 0, []

    def begin(self, rank: int) -> int:
        self.born.append(rank)
        self.alive += 1
        return 1 << (len(self.born) - 1)

    def now(self, value: int) -> int:
        while ended := value & self.ended:
            value ^= self.rows[ended.bit_length() - 1]
        return value

    def end(self, those: int, rank: int) -> None:
        youngest = those.bit_length() - 1
        self.rows[youngest] = those
        self.ended |= 1 << youngest
        self.alive -= 1
        if rank > self.born[youngest]:
            self.pairs.append((self.born[youngest], rank))

    def bars(self) -> list[tuple[int, int]]:
        return self.pairs + [(b, -1) for k, b in enumerate(self.born) if not self.ended >> k & 1]


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        x ^= low
        yield low.bit_length() - 1


def _parts(points: int, near: Callable[[int], int]) -> list[int]:
    """The connected parts of some points (bits), the largest first."""
    out = []
    while points:
        reach = todo = points & -points
        while todo and reach != points:
            low = todo & -todo
            new = near(low.bit_length() - 1) & points & ~reach
            reach |= new
            todo = (todo ^ low) | new
        out.append(reach)
        points ^= reach
    return sorted(out, key=int.bit_count, reverse=True) if len(out) > 1 else out


class _Faces:
    """The triangles on which a cocycle isn't zero. ``beside[a][b]``: the third corners of those with the edge a b; ``ends[a]``: these b."""

    def __init__(self, n: int, cocycles: _Cocycles) -> None:
        self.n, self.cocycles, self.values, self.beside, self.ends = n, cocycles, {}, [{} for _ in range(n)], [0] * n

    def _flip(self, a: int, b: int, c: int) -> None:
        for x, y, z in ((a, b, c), (b, a, c), (a, c, b), (c, a, b), (b, c, a), (c, b, a)):
            left = self.beside[x].get(y, 0) ^ 1 << z
            if left:
                self.beside[x][y] = left
                self.ends[x] |= 1 << y
            else:
                del self.beside[x][y]
                self.ends[x] ^= 1 << y

    def get(self, *corners: int) -> int:
        a, b, c = sorted(corners)
        key = (a * self.n + b) * self.n + c
        x = self.values.get(key, 0)
        if x & self.cocycles.ended:
            x = self.values[key] = self.cocycles.now(x)
            if not x:
                del self.values[key]
                self._flip(a, b, c)
        return x

    def put(self, value: int, *corners: int) -> None:
        a, b, c = sorted(corners)
        self.values[(a * self.n + b) * self.n + c] = value
        self._flip(a, b, c)

    def extend(self, u: int, v: int, part: int, near: list[int], rank: int) -> dict[int, int]:
        """The values, where not 0, that cocycles take on the new triangles u v x of a part of the edge's link; those that can't go on are ended.

        On the tetrahedron u v x y the values of its four faces add up to 0. Points joined
        by tetrahedra whose old faces have no value are alike, so only the rest are read.
        """
        unlike = {}
        for x in _bits((self.ends[u] | self.ends[v]) & part):
            d = (self.beside[u].get(x, 0) | self.beside[v].get(x, 0)) & part
            if d:
                unlike[x] = d
        if not unlike:
            return {}
        old = {(x, y): self.get(u, x, y) ^ self.get(v, x, y) for x, d in unlike.items() for y in _bits(d & -(1 << x))}
        alike = _parts(part, lambda x: near[x] & ~unlike.get(x, 0))
        of = {x: k for k, points in enumerate(alike[1:], 1) for x in _bits(points)}
        steps: dict[int, list[tuple[int, int]]] = {}
        for (x, y), s in old.items():
            a, b = of.get(x, 0), of.get(y, 0)
            if a != b:
                steps.setdefault(a, []).append((b, s))
                steps.setdefault(b, []).append((a, s))
        value, todo = {0: 0}, [0]
        while todo:
            a = todo.pop()
            for b, s in steps.get(a, ()):
                if b not in value:
                    value[b] = value[a] ^ s
                    todo.append(b)
        for (x, y), s in old.items():
            those = self.cocycles.now(value[of.get(x, 0)] ^ value[of.get(y, 0)] ^ s)
            if those:
                self.cocycles.end(those, rank)
        return {x: value[k] for x, k in of.items() if value[k]}


def _by_links(r: np.ndarray, last: int, top_dim: int) -> list[tuple[int, int, int]]:
    """(dim, rank of birth, rank of death), -1 for none, up to dimension 2 at most, by cohomology an edge at a time.

    An edge comes with all simplices of which it is the last edge: a triangle for every
    point of its link (the points joined to both of its ends before), a tetrahedron for
    every edge there. Within them all cancel at once but what the link's shape leaves: an
    edge without a link joins two parts or starts a loop, every further part of a link
    ends a loop or starts a void, and a void ends where its cocycle can't be carried over
    the link's edges. Those few are all that is stored, with the triangles that a living
    cocycle is not zero on; the other simplices are never made.
    """
    n = len(r)
    order = np.argsort(np.minimum(r, last + 1).sum(axis=1), kind="stable")  # the most central point is the lowest bit: it reaches most of a link at once
    r = r[np.ix_(order, order)]
    i, j = np.nonzero(np.triu(r <= last, 1))
    in_order = np.argsort(r[i, j], kind="stable")
    i, j = i[in_order], j[in_order]
    root, near, out = list(range(n)), [0] * n, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    loops, voids = _Cocycles(), _Cocycles()
    on_edge: dict[int, int] = {}
    on_face = _Faces(n, voids)

    def across(u: int, v: int, part: int) -> int:
        """What the loops' cocycles must be on an edge for its triangles with a part of its link; the same for each of the part's points."""
        x = (part & -part).bit_length() - 1
        return loops.now(on_edge.get(min(u, x) * n + max(u, x), 0) ^ on_edge.get(min(v, x) * n + max(v, x), 0))

    for u, v, rank in zip(i.tolist(), j.tolist(), r[i, j].tolist(), strict=True):
        link = near[u] & near[v]
        if not link:
            a, b = find(u), find(v)
            if a != b:
                root[a] = b
                out.append((0, -1, rank))
            elif top_dim:
                on_edge[u * n + v] = loops.begin(rank)
        elif top_dim:
            parts, starts = _parts(link, near.__getitem__), []
            value = across(u, v, parts[0]) if loops.alive else 0
            for p in parts[1:]:
                those = loops.now(value ^ across(u, v, p))
                if those:
                    loops.end(those, rank)
                else:
                    starts.append(p)
            value = loops.now(value)
            if value:
                on_edge[u * n + v] = value
            if top_dim > 1:
                new: dict[int, int] = {}
                if voids.alive:
                    for p in parts:
                        new |= on_face.extend(u, v, p, near, rank)
                for p in starts:
                    bit = voids.begin(rank)
                    for x in _bits(p):
                        new[x] = new.get(x, 0) | bit
                for x, value in new.items():
                    value = voids.now(value)
                    if value:
                        on_face.put(value, u, v, x)
        near[u] |= 1 << v
        near[v] |= 1 << u
    out += [(0, -1, -1)] * sum(find(x) == x for x in range(n))
    return out + [(q, a, b) for q, c in ((1, loops), (2, voids)) if q <= top_dim for a, b in c.bars()]


def _bars(m: np.ndarray, top_dim: int) -> list[tuple[int, float, float]]:
    """(dim, birth, death) from a matrix of distances, infinite where there is no edge."""
    np.fill_diagonal(m, 0.0)
    enclosing = float(m.max(axis=1, initial=0.0).min(initial=INF))
    levels = np.unique(m[(m <= enclosing) & (m < INF)])
    r = np.where((m <= enclosing) & (m < INF), np.searchsorted(levels, m), NO_EDGE)
    of = lambda q, a, b: (q, float(levels[a]) if q else 0.0, float(levels[b]) if b >= 0 else INF)
    bars = [of(*x) for x in _by_links(r, len(levels) - 1, top_dim if top_dim < 3 else 0)]
    if top_dim > 2:
        cleared = np.zeros(0, np.int64)
        for q in range(top_dim + 1):
            pairs, cleared = _pairs(r, q, len(levels) - 1, cleared)
            bars += [of(q, a, b) for a, b in pairs if q]
    return bars


def persistence(names: list, d: dict[tuple[int, int], float], top_dim: int = 1, longest: float = INF) -> list[tuple[int, float, float]]:
    """(dim, birth, death) of the Vietoris-Rips filtration of a small set of points.

    In dimension 0 each merge of components is a bar from 0, each component left an
    infinite one. Dimensions 1 and 2 are reduced by cohomology an edge at a time
    (``_by_links``); if ``top_dim`` is more, all from 1 up by cohomology a simplex at a
    time (``_pairs``): there one that ends a bar of the dimension below can't start
    another, so its column is cleared unseen, and simplices of ``top_dim`` + 1 are never
    stored, only made around a simplex. Those longer than the distance within which one
    point sees all others can't start or end a bar of any length and are never made. Bars
    of no length are dropped, but for merges at distance 0. An absent distance, or one above
    ``longest``, is no edge.
    """
    m = np.full((len(names), len(names)), INF)
    for (i, j), w in d.items():
        if w is not None and w <= longest:
            m[i, j] = m[j, i] = w
    return _bars(m, top_dim)


def diagrams(distances: DataFrame, top_dim: int = 1, longest: float = INF) -> DataFrame:
    """(window_id, dim, birth, death), infinite deaths as Infinity, from (window_id, i, j, d), i < j; null distances are no edges.

    A window is one group of N(N-1)/2 rows; in memory are, up to dimension 2, the triangles
    that a living cocycle is not zero on, beyond it blocks of its simplices of ``top_dim``
    and the columns of those not paired at once.
    """

    def f(g: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(pd.concat([g["i"], g["j"]]), sort=True)
        i, j = at[: len(g)], at[len(g) :]
        d = g["d"].to_numpy(float)
        edge = (i != j) & (d <= longest)  # not so for NaN, which null is
        m = np.full((len(names), len(names)), INF)
        m[i[edge], j[edge]] = m[j[edge], i[edge]] = d[edge]
        bars = _bars(m, top_dim)
        return pd.DataFrame({"window_id": g["window_id"].iloc[0], "dim": [b[0] for b in bars], "birth": [b[1] for b in bars], "death": [b[2] for b in bars]})

    return spread(distances.select("window_id", "i", "j", "d"), "window_id").groupBy("window_id").applyInPandas(f, "window_id bigint, dim int, birth double, death double")


def diagrams_of_returns(panel: DataFrame, top_dim: int = 1, signed: bool = False, use_correlation: bool = True, longest: float = INF) -> DataFrame:
    """The diagrams of a panel (asset, seq, ret) as a whole, window_id 0: assets by correlation distance, or without
    ``use_correlation`` periods by the Euclidean distance of their returns (those of all assets only)."""
    if use_correlation:
        from ..functions.rules import abs_distance, signed_distance
        from .matrix import correlation_matrix

        d = correlation_matrix(panel).where("i < j").select(F.lit(0).cast("bigint").alias("window_id"), "i", "j", (signed_distance("c") if signed else abs_distance("c")).alias("d"))
        return diagrams(d, top_dim, longest)
    p = panel.where("ret is not null").select("seq", "asset", "ret")
    assets = p.select("asset").distinct().count()
    a, b = (p.select("asset", F.format_string("%012d", "seq").alias(k), F.col("ret").alias(x)) for k, x in (("i", "x"), ("j", "y")))
    d = a.join(b, "asset").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("d"))
    return diagrams(d.where(F.col("n") == assets).select(F.lit(0).cast("bigint").alias("window_id"), "i", "j", "d"), top_dim, longest)


def finite_bars(diagram: DataFrame, dim: int) -> DataFrame:
    """The finite bars of one dimension: (window_id, birth, death); none if it has none."""
    return diagram.where((F.col("dim") == dim) & (F.col("death") < F.lit(INF))).select("window_id", "birth", "death")


def diagram_features(diagram: DataFrame, dim: int, windows: DataFrame) -> DataFrame:
    """Per window: n, max, mean, std (population), total and entropy of the finite bars' lengths; zeros without any."""
    p = finite_bars(diagram, dim).withColumn("p", F.col("death") - F.col("birth"))
    s = F.sum("p")
    entropy = F.when(s > 0, F.ln(s) - F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)) / s)
    f = p.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("max_persistence"), F.avg("p").alias("mean_persistence"), F.stddev_pop("p").alias("std_persistence"), s.alias("total_persistence"), entropy.alias("persistence_entropy"))
    return windows.select("window_id").distinct().join(f, "window_id", "left").fillna(0)


def landscape(diagram: DataFrame, dim: int, k: int = 5, samples: int = 100) -> DataFrame:
    """(window_id, k, x_idx, value): the k largest tents at each of the samples, zeros where fewer; no bars, no rows."""
    bars = finite_bars(diagram, dim)
    span = bars.groupBy("window_id").agg(F.min("birth").alias("a"), F.max("death").alias("z"))
    grid = span.select("window_id", "a", "z", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("x_idx")).withColumn("x", F.col("a") + F.col("x_idx") * (F.col("z") - F.col("a")) / (samples - 1))
    tents = grid.join(bars, "window_id").where("x >= birth and x <= death").select("window_id", "x_idx", F.least(F.col("x") - F.col("birth"), F.col("death") - F.col("x")).alias("v"))
    top = tents.withColumn("k", F.row_number().over(W.partitionBy("window_id", "x_idx").orderBy(F.desc("v")))).where(F.col("k") <= k)
    frame = grid.select("window_id", "x_idx", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    return frame.join(top, ["window_id", "x_idx", "k"], "left").select("window_id", "k", "x_idx", F.coalesce("v", F.lit(0.0)).alias("value"))


def image(diagram: DataFrame, dim: int, height: int = 20, width: int = 20, sigma: float = 0.1) -> DataFrame:
    """(window_id, row, col, value): bars as Gaussian bumps weighted by length over (birth, length), padded by a tenth."""
    bars = finite_bars(diagram, dim).select("window_id", "birth", (F.col("death") - F.col("birth")).alias("p"))
    e = bars.groupBy("window_id").agg(F.min("birth").alias("x0"), F.max("birth").alias("x1"), F.min("p").alias("y0"), F.max("p").alias("y1"))
    pad_x, pad_y = 0.1 * (F.col("x1") - F.col("x0")), F.when(F.col("y1") > F.col("y0"), 0.1 * (F.col("y1") - F.col("y0"))).otherwise(0.1)
    at = lambda lo, hi, i, n: lo + F.col(i) * (hi - lo) / (n - 1)
    grid = e.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    grid = grid.select("window_id", "row", "col", at(F.col("x0") - pad_x, F.col("x1") + pad_x, "col", width).alias("x"), at(F.col("y0"), F.col("y1") + pad_y, "row", height).alias("y"))
    d = grid.join(bars, "window_id")
    bump = F.col("p") * F.exp(-((F.col("x") - F.col("birth")) * (F.col("x") - F.col("birth")) + (F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))) / (2 * sigma * sigma))
    return d.groupBy("window_id", "row", "col").agg(F.sum(bump).alias("value"))


def vectorize(diagram: DataFrame, windows: DataFrame, dims: tuple[int, ...] = (0, 1), method: str = "statistics") -> DataFrame:
    """One dimension after another as landscape, image, or, for any other method, statistics."""
    how = {"landscape": lambda d: landscape(diagram, d), "image": lambda d: image(diagram, d)}.get(method, lambda d: diagram_features(diagram, d, windows))
    out = None
    for d in dims:
        x = how(d).withColumn("dim", F.lit(d))
        out = x if out is None else out.unionByName(x)
    return out


def adaptive_threshold(scores: DataFrame, by: list[str], keep: int = 30, n_std: float = 2.0, least: int = 5) -> DataFrame:
    """Adds baseline_mean, baseline_std, baseline_count, threshold, z_score, adaptive, is_anomaly to (by, seq, score).

    The baseline is the last ``keep`` scores, the current one included; below ``least``
    of them the threshold is 0.5 and nothing adaptive.
    """
    w = W.partitionBy(*by).orderBy("seq").rowsBetween(1 - keep, 0)
    d = scores.withColumns({"m": F.avg("score").over(w), "s": F.stddev_pop("score").over(w), "baseline_count": F.count("score").over(w)})
    own = F.col("baseline_count") >= least
    d = d.withColumns({"adaptive": own, "baseline_mean": F.when(own, F.col("m")).otherwise(0.0), "baseline_std": F.when(own, F.col("s")).otherwise(0.0), "threshold": F.when(own, F.col("m") + n_std * F.col("s")).otherwise(0.5)})
    z = F.when(own & (F.col("s") > 1e-12), (F.col("score") - F.col("m")) / F.col("s")).otherwise(0.0)
    return d.withColumns({"z_score": z, "is_anomaly": F.round(F.col("score") - F.col("threshold"), 9) > 0}).drop("m", "s")


def point_distances(points: np.ndarray) -> pd.DataFrame:
    """Euclidean distances (window_id 0, i, j, d) of a small point cloud."""
    rows = [(0, f"{i:04d}", f"{j:04d}", float(np.linalg.norm(points[i] - points[j]))) for i in range(len(points)) for j in range(i + 1, len(points))]
    return pd.DataFrame(rows, columns=["window_id", "i", "j", "d"])
