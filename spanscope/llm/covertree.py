"""Exact top-k inner products by dual-tree search over cover trees.

Both sides of a (query block, reference shard) group are indexed by a cover
tree: the children of a node are its own centre and points farther than the
next covering radius from each other, each point below its nearest child, so
children are separated and covered.  Nodes of few points, or of equal ones, are
leaves.  A pair of nodes with centres p, q and covering radii a, b can hold no
score above  <p,q> + a|q| + b|p| + ab ; it is dropped when that is below the
worst k-th score any query of the group has so far.  Bounds get a relative
slack for rounding, so a drop is always right; ties are kept.

Components become floor(scale * x).  Scores are whole numbers: where norms
allow sums beyond 2**53 they are computed with Python's integers, and one
beyond 64 bits raises OverflowError.  Vectors null, or holding null or
non-finite components, and rows without an id take no part; shorter vectors
count as filled with zeros, empty ones score 0.  A query's candidates are the
rows of other ids; repeated rows are candidates each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import pick
from ._grid import best, matrix, search, vectors


class Node:
    __slots__ = ("centre", "norm", "points", "radius", "kids", "worst", "kid_centre", "kid_norm", "kid_radius")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray | None, kids: list):
        self.centre, self.radius, self.points, self.kids = centre, radius, points, kids
        self.norm, self.worst = float(np.sqrt(centre @ centre)), -np.inf
        if kids:
            self.kid_centre = np.array([c.centre for c in kids])
            self.kid_norm = np.array([c.norm for c in kids])
            self.kid_radius = np.array([c.radius for c in kids])


def _squares(x: np.ndarray, xx: np.ndarray, i: int) -> np.ndarray:
    """Squared distances to row i; whole numbers, hence exact, for whole-number rows of moderate norm."""
    return np.maximum(xx - 2 * (x @ x[i]) + xx[i], 0)


def build(x: np.ndarray, members: np.ndarray | None = None, leaf: int = 24, base: float = 1.6) -> Node:
    """A cover tree over the rows of x; ``points`` of a node are rows held by it directly."""
    members = np.arange(len(x)) if members is None else members
    root: list = [None]
    todo = [(members, members[0], root, 0)]
    made = []
    while todo:
        rows, top, into, slot = todo.pop()
        centre = x[top]
        own = x[rows]
        xx = np.einsum("ij,ij->i", own, own)
        near = _squares(own, xx, int(np.flatnonzero(rows == top)[0]))
        radius = float(np.sqrt(near.max()))
        node = [centre, radius, None, []]
        into[slot] = node
        made.append(node)
        if len(rows) <= leaf or radius == 0:
            node[2] = rows
            continue
        cover, owner, tops = (radius / base) ** 2, np.zeros(len(rows), np.int64), [top]
        while True:
            far = int(near.argmax())
            if near[far] <= cover:
                break
            d = _squares(own, xx, far)
            closer = d < near
            near[closer], owner[closer] = d[closer], len(tops)
            near[far], owner[far] = 0.0, len(tops)
            tops.append(rows[far])
        size = np.bincount(owner, minlength=len(tops))
        single = size[owner] == 1
        node[2] = rows[single] if single.any() else None
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(size)
        for i in np.flatnonzero(size > 1):
            node[3].append(None)
            todo.append((rows[order[ends[i] - size[i] : ends[i]]], tops[i], node[3], len(node[3]) - 1))
    finished: dict[int, Node] = {}
    for n in reversed(made):
        finished[id(n)] = Node(n[0], n[1], n[2], [finished[id(c)] for c in n[3]])
    return finished[id(root[0])]


def _slack(bound):
    return bound + 1e-9 * np.abs(bound) + 1e-6


class Search:
    """Best k of every row of q among the rows of r, by a walk over both trees."""

    def __init__(self, r: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
        self.r, self.ids, self.q, self.own, self.k = r, ids, q, own, k
        self.norm = np.sqrt(np.einsum("ij,ij->i", r, r))
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.pairs = 0

    def run(self) -> None:
        top = build(self.r)
        roots = build(self.q)
        self._visit(roots, top)

    def _rows(self, rows: np.ndarray, points: np.ndarray) -> None:
        s = self.q[rows] @ self.r[points].T
        self.pairs += s.size
        ids = np.broadcast_to(self.ids[points], s.shape)
        s[ids == self.own[rows][:, None]] = -np.inf
        useful = (s >= self.score[rows, -1][:, None]).any(0) & np.isfinite(s).any(0)
        if not useful.any():
            return
        both = np.concatenate([self.score[rows], s[:, useful]], 1)
        names = np.concatenate([self.found[rows], np.where(np.isfinite(s[:, useful]), ids[:, useful], np.iinfo(np.int64).max)], 1)
        self.score[rows], self.found[rows] = best(both, names, self.k)

    def _settle(self, qn: Node) -> float:
        worst = np.inf
        if qn.points is not None:
            worst = float(self.score[qn.points, -1].min())
        for c in qn.kids:
            worst = min(worst, c.worst)
        qn.worst = worst
        return worst

    def _visit(self, qn: Node, rn: Node) -> None:
        """Depth first, the most promising children first."""
        if qn.kids and qn.radius > rn.radius:
            for c in qn.kids:
                if self._open(c, rn):
                    self._visit(c, rn)
            if qn.points is not None:
                self._group(qn, qn.points, rn)
            self._settle(qn)
            return
        if not qn.kids:
            self._group(qn, qn.points, rn)
            self._settle(qn)
            return
        if rn.points is not None:
            for c in qn.kids:
                self._only_points(c, rn)
            if qn.points is not None:
                self._direct(qn, qn.points, rn)
            self._settle(qn)
        for i in self._order(qn, rn):
            if self._open(qn, rn.kids[i]):
                self._visit(qn, rn.kids[i])

    def _only_points(self, qn: Node, rn: Node) -> None:
        for c in qn.kids:
            self._only_points(c, rn)
        if qn.points is not None:
            self._direct(qn, qn.points, rn)
        self._settle(qn)

    def _bound(self, qn: Node, rn: Node) -> float:
        return _slack(float(qn.centre @ rn.centre) + qn.radius * rn.norm + rn.radius * qn.norm + qn.radius * rn.radius)

    def _open(self, qn: Node, rn: Node) -> bool:
        return self._bound(qn, rn) >= qn.worst

    def _order(self, qn: Node, rn: Node) -> np.ndarray:
        if not rn.kids:
            return np.zeros(0, np.int64)
        bound = rn.kid_centre @ qn.centre + qn.radius * rn.kid_norm + rn.kid_radius * (qn.norm + qn.radius)
        bound = _slack(bound)
        keep = np.flatnonzero(bound >= qn.worst)
        return keep[np.argsort(-bound[keep], kind="stable")]

    def _direct(self, qn: Node, rows: np.ndarray, rn: Node) -> None:
        """Score the points a reference node holds itself, those its bound leaves."""
        points = rn.points
        worst = float(self.score[rows, -1].min())
        if worst > -np.inf:
            bound = _slack(self.r[points] @ qn.centre + qn.radius * self.norm[points])
            points = points[bound >= worst]
        if len(points):
            self._rows(rows, points)

    def _group(self, qn: Node, rows: np.ndarray, rn: Node) -> None:
        """Walk the reference side for the queries a query node holds itself."""
        stack = [(np.inf, rn)]
        while stack:
            bound, node = stack.pop()
            if bound < self.score[rows, -1].min():
                continue
            if node.points is not None:
                self._direct(qn, rows, node)
            if node.kids:
                b = _slack(node.kid_centre @ qn.centre + qn.radius * node.kid_norm + node.kid_radius * (qn.norm + qn.radius))
                keep = np.flatnonzero(b >= self.score[rows, -1].min())
                stack += [(b[i], node.kids[i]) for i in keep[np.argsort(b[keep], kind="stable")]]


def _few_equal(r: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best: of equal vectors those of the k + 1 smallest ids."""
    order = np.lexsort((ids, *r.T[::-1]))
    s, i = r[order], ids[order]
    same = np.zeros(len(r), bool)
    same[1:] = (s[1:] == s[:-1]).all(1)
    fresh = ~same
    fresh[1:] |= i[1:] != i[:-1]
    group = np.cumsum(~same) - 1
    rank = np.cumsum(fresh)
    return np.sort(order[rank - rank[np.flatnonzero(~same)][group] <= k])


def top_k(r: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
    """(query row, id, score) of each query's k best among whole-number vectors."""
    r, q = (np.pad(m, ((0, 0), (0, max(r.shape[1], q.shape[1], 1) - m.shape[1]))) for m in (r, q))
    keep = _few_equal(r, ids, k)
    r, ids = r[keep], ids[keep]
    big = float(np.sqrt((r * r).sum(1).max()) * np.sqrt((q * q).sum(1).max()))
    if big >= 2.0**53:
        whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
        rows, out_ids, scores = [], [], []
        ro = whole(r)
        for i, row in enumerate(whole(q)):
            s = [(-int((row * c).sum()), int(j)) for c, j in zip(ro, ids, strict=True) if j != own[i]]
            for neg, j in sorted(s)[:k]:
                rows.append(i), out_ids.append(j), scores.append(-neg)
        if any(abs(s) >= 2**63 for s in scores):
            raise OverflowError("an inner product exceeds 64 bits")
        return np.array(rows, np.int64), np.array(out_ids, np.int64), np.array(scores, np.int64)
    walk = Search(r, ids, q, own, k)
    walk.run()
    real = np.isfinite(walk.score)
    return np.nonzero(real)[0], walk.found[real], walk.score[real].astype(np.int64)


def search_top_k(refs: DataFrame, queries: DataFrame, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 2048, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest inner products, ties to smaller ids."""

    def find(r, q):
        fixed = lambda t: np.floor(scale * matrix(t.column("v")))
        return top_k(fixed(r), np.asarray(r.column("id").to_numpy()), fixed(q), np.asarray(q.column("id").to_numpy()), k)

    return search(vectors(refs, id_col, vector_col, zero=True), vectors(queries, id_col, vector_col, zero=True), find, k, "bigint", shard_rows, block_rows)


def every(df: DataFrame, n: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The query set: id and vector of the rows whose id is divisible by n, whatever else the table's columns are called."""
    return pick(df, **{id_col: "bigint", vector_col: "array<double>"}).where(F.col(id_col) % n == 0)
