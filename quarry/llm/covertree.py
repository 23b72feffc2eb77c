"""Exact cosine-threshold links between vectors by dual traversal of cover trees.

Vectors are scaled to length 1, where cosine >= c means a distance of at most
t = sqrt(2 - 2c).  A cover tree has nested levels with halving radii: every
point of a level stays a point of the next, all points of a level are further
apart than its radius (the last level holds every vector), and a point hangs
under the nearest point of the level above, which is within that level's radius;
every point below a node lies within the node's own covering radius.  Two trees are traversed together from the top: a pair of nodes
whose centres are further apart than t plus both covering radii is dropped with
all that is below it, a pair that is surely within t is counted as a whole, and
the others are opened.  At the bottom the cosine itself, in double precision,
decides.

Where covering radii are above t, nothing can be counted as a whole, and in many
dimensions hardly a pair of nodes is dropped, so a traversal begins at the level
where they are within t.  Its nodes lie by their angle to the middle of their
tree; only ranges of nodes whose angles to it are near enough meet.  Their pairs
are sifted in single precision by their distance in the ``SIFT`` directions in which vectors of a bounded sample
differ most: it is never above their distance, so what is too far there is
dropped, and the rest is compared in full.

Distribution: equal vectors are one class.  Classes go to the nearest of a
bounded number of pivots, a spread-out part of a bounded sample, and a pivot's
classes are cut into blocks of about ``BLOCK`` rows by a hash, however many they
are.  A block's tree is grown once; the trees of blocks of about ``GROUP_BYTES``
in all are a group, a forest that is traversed as one tree.  Groups meet by a
product of the table that holds them, so no tree is shuffled or written again;
groups whose pivots are all further apart than the threshold and both covering
radii don't meet, and pairs of trees whose roots are don't either.  A meeting
emits a number of links and one edge for each vector, never the pairs.  (In many
dimensions unrelated vectors are all about equally far apart, so few pairs of
trees can be dropped: the work grows with the square of the number of different
vectors, and what the trees save is below their nodes.)

What the driver holds grows with the pairs of groups that may link, at worst the
square of their number: see the README.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths don't link.  Rows
that share a vec_id, and repeated rows, are separate vectors, alike if they are
equal.  A row without vec_id links like any other; a component without any
vec_id is null.  An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded_batches, materialize, release

THRESHOLD = 0.95
BLOCK = 4096
GROUP_BYTES = 3 << 20
GROUPS = 4
SAMPLE = 4096
PIVOTS = 256
SLACK = 1e-6
SIFT = 24
SIFT_SLACK = 1e-5
TURN_SLACK = 0.01
SIFT_ROWS, SIFT_COLUMNS = 512, 2048
LEAF_RADIUS = 2.0**-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def angles(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ middle, -1, 1))


class CoverTree:
    """Nested levels over unit vectors.

    ``levels[k]`` has the points (rows) of level k, the node of level k-1 that
    each hangs under, and each node's covering radius; ``order`` lists all rows
    so that a node's rows are ``order[first:last]``.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        points, near, away = np.zeros(1, np.int64), np.zeros(n, np.int64), distances(x[:1], x)[0]
        nets = [(points, near)]  # each net holds the one before it, and every row's nearest point of it
        radius = 1.0
        while away.max(initial=0.0) > LEAF_RADIUS and len(points) < n:
            points, near, away = self._next(points, near.copy(), away, radius)
            nets.append((points, near))
            radius /= 2
        if len(points) < n:  # the last level holds every row
            nets.append((np.r_[points, np.setdiff1d(np.arange(n), points)], near))
        # A point hangs under the nearest point of the level above it (itself, if it is there already).
        parents = [np.zeros(1, np.int64)]
        for (old, close), (new, _) in zip(nets, nets[1:], strict=False):
            parents.append(np.r_[np.arange(len(old)), close[new[len(old) :]]])
        at = np.empty(n, np.int64)
        at[nets[-1][0]] = np.arange(len(nets[-1][0]))
        if len(nets[-1][0]) < n:
            at = nets[-1][1]
        nodes = [at]
        for parent in reversed(parents[1:]):
            nodes.append(parent[nodes[-1]])
        nodes.reverse()
        self.order = np.lexsort(nodes[::-1])
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.levels, self.children = [], []
        for (points, _), parent, at in zip(nets, parents, nodes, strict=True):
            away = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, x[points[at]]), 0))
            away[points] = 0.0
            cover = np.zeros(len(points))
            np.maximum.at(cover, at, away)
            first = np.full(len(points), n)
            np.minimum.at(first, at, place)
            self.levels.append((points, parent, cover, first, first + np.bincount(at, minlength=len(points))))
        self.cuts = [np.array([0, len(points)]) for points, *_ in self.levels]
        self._hang()

    def _hang(self) -> None:
        """Each node's children, from their parents."""
        for (points, *_), (_, parent, *_) in zip(self.levels, self.levels[1:], strict=False):
            order = np.argsort(parent, kind="stable")
            self.children.append((order, np.searchsorted(parent[order], np.arange(len(points) + 1))))

    def _next(self, points: np.ndarray, near: np.ndarray, away: np.ndarray, radius: float):
        """``points`` with a greedy net of ``radius`` added: no two of a level are within it, and every row is within it of one."""
        away, found = away.copy(), [points]
        count = len(points)
        loose = np.flatnonzero(away > radius)
        while len(loose):
            # Some candidates at once: the first that no earlier one covers are new points.
            lot = loose[:256]
            close = distances(self.x[lot], self.x[lot]) <= radius
            take, covered = [], np.zeros(len(lot), bool)
            for k in range(len(lot)):
                if not covered[k]:
                    take.append(k)
                    covered |= close[k]
            chosen = lot[take]
            d = distances(self.x, self.x[chosen])
            best = d.argmin(1)
            d = d[np.arange(len(d)), best]
            closer = d < away
            near[closer], away[closer] = count + best[closer], d[closer]
            near[chosen], away[chosen] = count + np.arange(len(chosen)), 0.0
            found.append(chosen)
            count += len(chosen)
            loose = loose[away[loose] > radius]
        return np.concatenate(found), near, away


class Forest(CoverTree):
    """Trees side by side, as one whose levels hold the nodes of all: ``cuts[k]`` says where each tree's nodes of level k begin."""

    def __init__(self, trees: list[CoverTree]):
        self.x = np.concatenate([t.x for t in trees])
        rows = np.cumsum([0] + [len(t.x) for t in trees])
        self.order = np.concatenate([t.order + r for t, r in zip(trees, rows, strict=False)])
        self.levels, self.children, self.cuts = [], [], [np.arange(len(trees) + 1)]
        for k in range(max(len(t.levels) for t in trees)):
            parts = []
            for tree, row, above in zip(trees, rows, self.cuts[-1], strict=False):
                points, parent, cover, first, last = tree.levels[min(k, len(tree.levels) - 1)]
                parts.append((points + row, (parent if k < len(tree.levels) else np.arange(len(points))) + above, cover, first + row, last + row))
            self.levels.append(tuple(np.concatenate(column) for column in zip(*parts, strict=True)))
            self.cuts.append(np.cumsum([0] + [len(part[0]) for part in parts]))
        del self.cuts[0]
        self._hang()


class Links:
    """What a dual traversal finds: links of each row, and a forest over both sides' rows."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.parent = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[i]
            if (up == i).all():
                return i
            self.parent[i] = self.parent[up]
            i = self.parent[i]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _expand(a: np.ndarray, b: np.ndarray, ka, kb) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs."""
    (ca, fa), (cb, fb) = ka, kb
    na, nb = fa[a + 1] - fa[a], fb[b + 1] - fb[b]
    each = na * nb
    pair = np.repeat(np.arange(len(a)), each)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    return ca[fa[a][pair] + within // nb[pair]], cb[fb[b][pair] + within % nb[pair]]


def coordinates(x: np.ndarray) -> np.ndarray | None:
    """The directions in which rows like ``x`` differ most, as columns; none if they have few coordinates."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :SIFT] if x.shape[1] > SIFT else None


def dual_traversal(left: CoverTree, right: CoverTree, weight_l: np.ndarray, weight_r: np.ndarray, threshold: float, same: bool, lot: int = 1 << 21, basis: np.ndarray | None = None) -> Links:
    """Links between the rows of two trees or forests (of one with itself if ``same``).

    Rows are numbered left first; a row's count is the weight of the rows it links with.  ``basis`` holds orthonormal
    columns; which they are matters for speed only.  ``lot`` bounds the coordinates that are gathered at once.
    """
    lot = max(4096, lot // max(1, left.x.shape[1]))
    t = float(np.sqrt(2 - 2 * threshold))
    nl = len(left.x)
    shift = 0 if same else nl
    links = Links(nl if same else nl + len(right.x))
    wl, wr = np.r_[0, np.cumsum(weight_l[left.order])], np.r_[0, np.cumsum(weight_r[right.order])]
    depth = max(len(left.levels), len(right.levels))

    def level(tree: CoverTree, k: int):
        return tree.levels[min(k, len(tree.levels) - 1)]

    def stay(tree: CoverTree, k: int):
        if k + 1 < len(tree.levels):
            return tree.children[k]
        n = len(tree.levels[-1][0])
        return np.arange(n), np.arange(n + 1)

    def whole(k: int, a: np.ndarray, b: np.ndarray) -> None:
        """Every row below a links with every row below b."""
        _, _, _, fa, la = level(left, k)
        _, _, _, fb, lb = level(right, k)
        add_l, add_r = np.zeros(nl + 1, np.int64), np.zeros(len(right.x) + 1, np.int64)
        np.add.at(add_l, fa[a], wr[lb[b]] - wr[fb[b]])
        np.subtract.at(add_l, la[a], wr[lb[b]] - wr[fb[b]])
        links.count[left.order] += np.cumsum(add_l[:-1])
        if not same:
            np.add.at(add_r, fb[b], wl[la[a]] - wl[fa[a]])
            np.subtract.at(add_r, lb[b], wl[la[a]] - wl[fa[a]])
            links.count[shift + right.order] += np.cumsum(add_r[:-1])
        # All rows of both sides hang together: each with the first of its own node, through the other's first.
        head_a, head_b = left.order[fa[a]], shift + right.order[fb[b]]
        links.join(head_a, head_b)
        for tree, first, last, nodes, other, off in ((left, fa, la, a, head_b, 0), (right, fb, lb, b, head_a, shift)):
            one, where = np.unique(nodes, return_index=True)
            size = last[one] - first[one]
            many = size > 1
            one, where, size = one[many], where[many], size[many]
            ends = np.cumsum(size)
            rows = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first[one], size)
            links.join(off + tree.order[rows], np.repeat(other[where], size))

    def visit(k: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        pa_, _, ra, _, _ = level(left, k)
        pb_, _, rb, _, _ = level(right, k)
        cos = np.einsum("ij,ij->i", left.x[pa_[a]], right.x[pb_[b]])
        if k >= depth - 1:
            hit = cos >= threshold
            a, b = pa_[a[hit]], pb_[b[hit]]
            np.add.at(links.count, a, weight_r[b])
            if not same:
                np.add.at(links.count, shift + b, weight_l[a])
            links.join(a, shift + b)
            return []
        d = np.sqrt(np.maximum(2 - 2 * cos, 0))
        reach = ra[a] + rb[b]
        sure = d + reach <= t - SLACK
        if sure.any():
            whole(k, a[sure], b[sure])
        keep = ~sure & (d <= t + reach + SLACK)
        return [(k, a[keep], b[keep])] if keep.any() else []

    def dense(k: int, at_l: np.ndarray, at_r: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """All pairs of some nodes of a level, tile by tile: far pairs go before they become rows."""
        pa_, _, ra, _, _ = level(left, k)
        pb_, _, rb, _, _ = level(right, k)
        out, other = [], right.x[pb_[at_r]].T
        step = max(1, 8 * lot // max(1, len(at_r)))
        for s in range(0, len(at_l), step):
            own = at_l[s : s + step]
            cos = left.x[pa_[own]] @ other
            reach = t + SLACK + ra[own].max() + rb[at_r].max()
            i, j = np.nonzero(cos >= (-1.5 if reach >= 2 else 1 - reach * reach / 2 - SLACK))
            if len(i):
                out += visit(k, own[i], at_r[j])
        return out

    def drain(stack: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        while stack:
            k, a, b = stack.pop()
            (ca, fa), (cb, fb) = kids_l, kids_r = stay(left, k), stay(right, k)
            each = (fa[a + 1] - fa[a]) * (fb[b + 1] - fb[b])
            for i in np.flatnonzero(each > lot // 4):
                stack += dense(k + 1, ca[fa[a[i]] : fa[a[i] + 1]], cb[fb[b[i]] : fb[b[i] + 1]])
            few = np.flatnonzero(each <= lot // 4)
            bins = np.cumsum(each[few]) // lot
            for part in np.split(few, np.flatnonzero(np.diff(bins)) + 1) if len(few) else []:
                stack += visit(k + 1, *_expand(a[part], b[part], kids_l, kids_r))

    # Above the level whose covering radii are within the threshold no pair of nodes can be counted as a whole, and in many
    # dimensions hardly one is dropped: the traversal begins there.  Its pairs are sifted in single precision, by their
    # angles to the trees' middles and by their distance in a few directions, which is never above their distance.
    start = max(next(k for k, r in enumerate(tree.levels) if r[2].max() <= t or k == len(tree.levels) - 1) for tree in (left, right))

    def sides(tree: CoverTree) -> list[tuple[np.ndarray, list[tuple]]]:
        """For each tree its middle, and the nodes that are one point and the others by their angle to it."""
        points, _, cover, _, _ = level(tree, start)
        cut, out = tree.cuts[min(start, len(tree.levels) - 1)], []
        for a, b in zip(cut, cut[1:], strict=False):
            mean = tree.x[points[a:b]].mean(0)
            middle = (mean / np.sqrt(mean @ mean) if mean @ mean > SLACK else tree.x[points[a]]).astype(np.float32)
            out.append((middle, []))
            for nodes in (a + np.flatnonzero(cover[a:b] == 0), a + np.flatnonzero(cover[a:b] > 0)):
                if len(nodes):
                    x = tree.x[points[nodes]].astype(np.float32)
                    angle = angles(x, middle)
                    order = np.argsort(angle)
                    nodes, x = nodes[order], x[order]
                    low = x if basis is None else (tree.x[points[nodes]] @ basis).astype(np.float32)
                    half = np.einsum("ij,ij->i", low, low)[:, None] / 2
                    out[-1][1].append((nodes, cover[nodes].max(), angle[order], x, np.hstack([low, -half, np.ones_like(half)]), np.hstack([low, np.ones_like(half), -half])))
        return out

    def sift(g: tuple, h: tuple, middle_l: np.ndarray, middle_r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes that may be near enough, and few others."""
        (own, ra, angle_l, x_l, low_l, _), (other, rb, angle_r, x_r, _, low_r) = g, h
        reach = t + ra + rb + SLACK
        bound, turn = np.float32(-(reach**2) / 2 - SIFT_SLACK), 2 * np.arcsin(min(1.0, reach / 2)) + TURN_SLACK
        # Angles to a third vector differ by no more than the angle between two.
        back, away = angles(x_l, middle_r), angles(x_r, middle_l)
        some, order = np.flatnonzero((back >= angle_r[0] - turn) & (back <= angle_r[-1] + turn)), np.argsort(away)
        away, low_r = away[order], low_r[order].T
        for s in range(0, len(some), SIFT_ROWS):
            rows = some[s : s + SIFT_ROWS]
            first, last = np.searchsorted(away, (angle_l[rows[0]] - turn, angle_l[rows[-1]] + turn))
            for u in range(first, last, SIFT_COLUMNS):
                columns = order[u : min(u + SIFT_COLUMNS, last)]
                z = low_l[rows] @ low_r[:, u : u + len(columns)]
                hit = np.flatnonzero(z.ravel() >= bound)
                if basis is not None and len(hit) > z.size // 64:
                    z = x_l[rows] @ x_r[columns].T
                    hit = np.flatnonzero(z.ravel() >= 1 + bound)
                if len(hit):
                    yield own[rows[hit // len(columns)]], other[columns[hit % len(columns)]]

    sides_l = sides(left)
    sides_r = sides_l if same else sides(right)
    roots = distances(left.x[left.levels[0][0]], right.x[right.levels[0][0]]) <= t + left.levels[0][2][:, None] + right.levels[0][2] + SLACK
    found, size = [], 0
    for i, j in np.argwhere(roots):
        (middle_l, parts_l), (middle_r, parts_r) = sides_l[i], sides_r[j]
        for g in parts_l:
            for h in parts_r:
                for pair in sift(g, h, middle_l, middle_r):
                    found.append(pair)
                    size += len(pair[0])
                    if size >= lot:
                        drain(visit(start, *map(np.concatenate, zip(*found, strict=True))))
                        found, size = [], 0
    if found:
        drain(visit(start, *map(np.concatenate, zip(*found, strict=True))))
    return links



def _plain(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.dtype == np.int64 else x


def pack_tree(tree: CoverTree, raw: np.ndarray, rep: np.ndarray, weight: np.ndarray) -> bytes:
    """A tree over ``unit(raw)`` with its rows' ids and weights, as bytes."""
    return pickle.dumps((raw, _plain(tree.order), [tuple(map(_plain, r)) for r in tree.levels], [tuple(map(_plain, r)) for r in tree.children], rep, weight), protocol=5)


def unpack_tree(raw: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    x, order, levels, children, rep, weight = pickle.loads(raw)
    tree = CoverTree.__new__(CoverTree)
    wide = lambda r: tuple(v.astype(np.int64) if v.dtype == np.int32 else v for v in r)
    tree.x, tree.order, tree.levels, tree.children = unit(x), order.astype(np.int64), [wide(r) for r in levels], [wide(r) for r in children]
    tree.cuts = [np.array([0, len(points)]) for points, *_ in tree.levels]
    return tree, rep, weight


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x``, each the furthest from those before it."""
    take = [0]
    away = distances(x[:1], x)[0]
    while len(take) < min(n, len(x)) and away.max() > LEAF_RADIUS:
        take.append(int(away.argmax()))
        away = np.minimum(away, distances(x[take[-1] :][:1], x)[0])
    return x[take]


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(vec_id, h1, h2)`` and classes ``(rep, n, h1, h2, v, dim)`` of equal vectors that can link."""
    v = F.col(vec_col)
    infinite = F.lit(float("inf"))
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fit, F.lit(False)), v).alias("v"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(5), "v")).alias("h2")), "vectors")
    # The vector follows its class's first row through a join: only ids and hashes are grouped.
    groups = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.min("row").alias("row"), F.count("*").alias("n"))
    met = groups.join(rows.select("row", "v"), "row")
    classes = met.select(F.monotonically_increasing_id().alias("cid"), "rep", "n", "h1", "h2", "v", F.size("v").alias("dim"))
    return rows.select("vec_id", "h1", "h2"), materialize(classes, "classes")


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    rows, classes = _classes(vectors, id_col, vec_col)
    total = classes.count()
    t = float(np.sqrt(2 - 2 * threshold))

    # Pivots: spread-out rows of a bounded sample of each length of vectors.
    sample = classes.orderBy(F.xxhash64("h1"), "h1", "h2").select("dim", "v").limit(SAMPLE).toArrow()
    pivots: dict[int, np.ndarray] = {}
    basis: dict[int, np.ndarray | None] = {}
    dims = np.array(sample["dim"].to_pylist(), np.int64)
    for dim in np.unique(dims).tolist():
        part = unit(_matrix(sample["v"].combine_chunks().filter(pa.array(dims == dim))))
        basis[dim] = coordinates(part)
        pivots[dim] = spread(part, min(PIVOTS, max(1, -(-total // (BLOCK // 2)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            cell, away = np.zeros(len(dim), np.int64), np.full(len(dim), 2.0)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d in pivots:
                    for own in np.split(at, range(1024, len(at), 1024)):
                        dist = distances(unit(_matrix(batch.column("v").take(pa.array(own)))), pivots[d])
                        cell[own] = dist.argmin(1)
                        away[own] = dist[np.arange(len(own)), cell[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("cid", "n", "v", "dim").mapInArrow(assign, f"cid long, n long, v {kind}, dim int, cell long, away double")
    cells = sorted((r["dim"], r["cell"], r["n"], r["far"]) for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect())
    # A cell is some blocks; a group is some blocks of one length of vectors, and meets the groups of its cells' partners.
    blocks = [-(-n // BLOCK) for _, _, n, _ in cells]
    place, groups, filled, held = {}, [], 0, 0.0
    for (d, c, n, _), number_of in zip(cells, blocks, strict=True):
        place[d, c] = (len(groups), number_of)
        for _ in range(number_of):
            new = not groups or groups[-1][0] != d or filled * GROUPS >= sum(blocks) or held + n / number_of > GROUP_BYTES / (4 * d)
            filled, held = (1, n / number_of) if new else (filled + 1, held + n / number_of)
            groups.append((d, (groups[-1][1] + new) if groups else 0))
    group_of = np.array([g for _, g in groups], np.int64)
    inside = [set(group_of[place[d, c][0] : place[d, c][0] + place[d, c][1]].tolist()) for d, c, _, _ in cells]
    partners: dict[int, set[int]] = {g: set() for g in group_of.tolist()}
    for i, (d, c, _, far) in enumerate(cells):
        for j, (e, o, _, reach) in enumerate(cells):
            if d != e or (d in pivots and float(distances(pivots[d][c : c + 1], pivots[e][o : o + 1])[0, 0]) > t + far + reach + SLACK and i != j):
                continue
            for g in inside[i]:
                partners[g] |= inside[j]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell, luck = (batch.column(n).to_numpy() for n in ("dim", "cell", "luck"))
            block = np.array([place[d, c][0] + k % place[d, c][1] for d, c, k in zip(dim.tolist(), cell.tolist(), luck.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("cid", "n", "v")] + [pa.array(block), pa.array(group_of[block])], ["cid", "n", "v", "block", "grp"])

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors, cid, n, block = _matrix(table["v"].combine_chunks()), *(table[c].to_numpy() for c in ("cid", "n", "block"))
        trees = []
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            trees.append(pack_tree(CoverTree(unit(vectors[at])), vectors[at], cid[at], n[at]))
        grp = table["grp"][0].as_py()
        return pa.table({"grp": pa.array([grp], pa.int64()), "trees": pa.array([pickle.dumps(trees, protocol=5)], pa.binary()), "meets": pa.array([sorted(partners[grp])], pa.list_(pa.int64()))})

    spots = dealt.select("cid", "n", "v", "dim", "cell", F.abs(F.xxhash64("v", F.lit(3)) % 1000003).alias("luck")).mapInArrow(number, f"cid long, n long, v {kind}, block long, grp long")
    trees = materialize(spots.groupBy("grp").applyInArrow(grow, "grp long, trees binary, meets array<long>"), "trees")

    def planted(raw: bytes) -> tuple[Forest, np.ndarray, np.ndarray]:
        trees, rep, weight = zip(*map(unpack_tree, pickle.loads(raw)), strict=True)
        return Forest(list(trees)), np.concatenate(rep), np.concatenate(weight)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links between the rows of two groups."""
        last = None, None
        for batch in batches:
            for p, q, a, b in zip(*(batch.column(n) for n in ("p", "q", "a", "b")), strict=True):
                same = p == q
                last = last if last[0] == p else (p, planted(a.as_buffer()))
                lt, lr, lw = last[1]
                rt, rr, rw = last[1] if same else planted(b.as_buffer())
                links = dual_traversal(lt, rt, lw, rw, threshold, same, basis=basis.get(lt.x.shape[1]))
                ids = lr if same else np.r_[lr, rr]
                count = links.count - 1 if same else links.count
                root = links.root(np.arange(len(ids)))
                some = np.flatnonzero((count > 0) | (root != np.arange(len(ids))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[root[some]])], ["cid", "links", "root"])

    # Groups meet by a product of the table's files, which is read again for each part of it: nothing is sent twice to disk.
    bounded_batches(vectors.sparkSession)
    left = trees.select(F.col("grp").alias("p"), F.col("trees").alias("a"), "meets").hint("shuffle_replicate_nl")
    right = trees.select(F.col("grp").alias("q"), F.col("trees").alias("b"))
    pairs = left.join(right, (F.col("p") <= F.col("q")) & F.array_contains("meets", F.col("q")))
    found = materialize(pairs.select("p", "q", "a", "b").mapInArrow(meet, "cid long, links long, root long"), "links")
    release(trees)

    names = classes.select("cid", "rep")
    counts = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
    parts = materialize(connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "parts")
    least = parts.join(names, parts.node == names.cid).groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = parts.join(least, "component").select(F.col("node").alias("cid"), "component_id")
    named = materialize(classes.select("cid", "rep", "h1", "h2").join(counts, "cid", "left").join(labels, "cid", "left").select("h1", "h2", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
