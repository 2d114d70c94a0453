"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard.

The tree holds directions, so vectors of unlike length do not disturb it; every node knows the least and the greatest
length of its vectors. Equal vectors are one point with its smallest ids. A node splits its points at the median distance
from a vantage point; a block of queries goes through the tree together, nearer side first. A query at distance d from
the vantage point is, by the triangle inequality, at least gap = |d - edge| from every direction of the other side, so no
inner product there exceeds length * (1 - gap^2 / 2). The side is left out if that bound, with factor * gap in place of
gap, is below the query's k-th best so far: nothing is lost at factor 1, and a larger factor leaves out more.

The tests measure recall at the query's factor against brute force, for lengths that are equal, unlike or log-normal, for
outliers, clusters and few dimensions. Every vector is indexed. Scores are inner products in double precision of the
original vectors; the search itself works on vectors scaled by the shard's greatest component, so that squares neither
overflow nor vanish.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; rows without id
neither; of rows that share a vec_id the least vector counts; only vectors of a query's own length are candidates; ties
go to the smaller vec_id; extra columns stay out; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cardloom.llm.blocks import best, search_shards, sound_vectors

LEAF = 128
#: Pruning is this many times as eager as the triangle inequality allows; 1 is exact.
FACTOR = 2.0
#: Candidates beyond k whose exact scores are compared too, as the search's own are rounded.
SPARE = 4


def _unit(X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, lengths) of rows."""
    most = np.abs(X).max(1)
    X = X / most[:, None]
    length = np.sqrt((X * X).sum(1))
    return X / length[:, None], length * most


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Tree:
    """Points in index order; a node is (start, end, vantage, inner edge, outer edge, inner child, outer child, least length, greatest length)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.unit, self.length = _unit(points)
        self.order = np.arange(len(points))
        self.nodes: list[list] = []
        stack = [(0, len(points), None, 0)] if len(points) else []
        while stack:
            start, end, parent, side = stack.pop()
            at, own = len(self.nodes), self.order[start:end]
            self.nodes.append([start, end, None, 0.0, 0.0, None, None, self.length[own].min(), self.length[own].max()])
            if parent is not None:
                self.nodes[parent][side] = at
            if end - start <= leaf:
                continue
            vantage = self.unit[own[(end - start) * 7 // 13]]
            d = _chord(self.unit[own] @ vantage)
            half = len(own) // 2
            split = np.argpartition(d, half)
            self.order[start:end] = own[split]
            self.nodes[at][2:5] = vantage, float(d[split[:half]].max()), float(d[split[half:]].min())
            stack += [(start, start + half, at, 5), (start + half, end, at, 6)]
        self.points = points[self.order]


class Search:
    """The k points of largest inner product with each query direction; places are those in the tree's order."""

    def __init__(self, tree: Tree, directions: np.ndarray, k: int, factor: float):
        self.tree, self.q, self.k, self.factor, self.visited = tree, directions, k, factor, 0
        self.score = np.full((len(directions), k), -np.inf)
        self.place = np.full((len(directions), k), -1)
        if tree.nodes:
            self._visit(0, np.arange(len(directions)))

    def _visit(self, at: int, asks: np.ndarray) -> None:
        start, end, vantage, inner, outer, one, two = self.tree.nodes[at][:7]
        if vantage is None:
            self.visited += len(asks) * (end - start)
            s = np.concatenate([self.score[asks], self.q[asks] @ self.tree.points[start:end].T], 1)
            p = np.concatenate([self.place[asks], np.broadcast_to(np.arange(start, end), (len(asks), end - start))], 1)
            top = np.argpartition(s, s.shape[1] - self.k, 1)[:, -self.k :]
            self.score[asks], self.place[asks] = np.take_along_axis(s, top, 1), np.take_along_axis(p, top, 1)
            return
        d = _chord(self.q[asks] @ vantage)
        close = d <= (inner + outer) / 2
        for near, child, other, gap in ((close, one, two, outer - d), (~close, two, one, d - inner)):
            if near.any():
                self._visit(child, asks[near])
                left = asks[near]
                least, greatest = self.tree.nodes[other][7:]
                cosine = 1 - np.clip(self.factor * (gap[near] - 1e-7), 0, 2) ** 2 / 2  # 1e-7: distances are rounded
                bound = np.where(cosine > 0, greatest, least) * cosine + 1e-12 * greatest
                far = left[bound >= self.score[left].min(1)]
                if len(far):
                    self._visit(other, far)


def vantage_point_index(k: int, factor: float = FACTOR, leaf: int = LEAF):
    def index(ids, X):
        unique, inverse = np.unique(X, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by_point = np.lexsort((ids, inverse))
        starts = np.searchsorted(inverse[by_point], np.arange(len(unique) + 1))
        scale = np.abs(unique).max() if len(unique) else 1.0
        tree = Tree(unique / scale, leaf)
        wanted = k + 1 + SPARE  # the query itself may be among them

        def ask(query_ids, Q):
            near = Search(tree, _unit(Q)[0], wanted, factor)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for i, qi in enumerate(query_ids):
                scores = np.sort(near.score[i])[::-1]
                edge = scores[k] - 1e-9 * (abs(scores[k]) + 1e-300) if np.isfinite(scores[-1]) else -np.inf
                places = near.place[i][near.place[i] >= 0]
                if scores[-1] >= edge > -np.inf:  # more points tie with the last that counts than were kept
                    places = np.flatnonzero(tree.points @ near.q[i] >= edge)
                places = tree.order[places]
                own = np.concatenate([by_point[starts[p] : min(starts[p + 1], starts[p] + k + 1)] for p in places])
                own = own[ids[own] != qi]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.nan_to_num((X[own] * Q[i]).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # row by row alike, so that equal vectors tie
                at = best(k, score, ids[own])
                found.append((np.full(len(at), qi), ids[own][at], score[at]))
            return [np.concatenate(c) for c in zip(*found)]

        return ask

    return index


def nearest_neighbours(df: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by every, against all rows but themselves."""
    return search_shards(sound_vectors(df, id_col, vec_col, allow_zero=False), every, k, vantage_point_index(k, factor), "double")
