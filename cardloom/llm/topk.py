"""Exact top-k search by columnar branch and bound.

A shard lies in vertical layout, dimension by dimension. For a block of queries scores grow dimension block by dimension
block; what the dimensions still to come can add is at most the product of the remaining norms of query and vector. A
candidate whose score so far plus that bound is below the query's k-th best guaranteed score is dropped, and the survivors
are compacted before the next block. The bound is exact, so the result is the true top k.

Components are floor(256 * x), and scores integer inner products. Vectors of length 2^26 and less multiply exactly in double
precision. A pair with a longer vector gets its score in double precision with a bound on its error; the pairs that this
bound leaves among the k best are multiplied again in whole numbers of any size. Scores outside 64 bits are held at the
ends of that range.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; rows without id
neither; of rows that share a vec_id the least vector counts; only vectors of a query's own length are candidates; zero
vectors count; ties go to the smaller vec_id; extra columns stay out; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from cardloom.llm.blocks import best, search_shards, sound_vectors

DIM_BLOCK = 16
#: Vectors up to this length have exact products in double precision: 2^26 * 2^26 < 2^53.
EXACT = 2.0**26
LOW, HIGH = -(2**63), 2**63 - 1


def _whole(x: float) -> int:
    """floor(256 * x), also where 256 * x is no double."""
    return math.floor(256 * x) if abs(x) < 2.0**900 else 256 * int(x)


class Long:
    """Vectors of any size: norms and directions in double precision, exact components on demand."""

    def __init__(self, ids: np.ndarray, X: np.ndarray):
        self.ids, self.X = ids, X
        self.most = np.maximum(np.abs(X).max(1, initial=0.0), 1 / 256)
        self.unit = X / self.most[:, None]

    def top(self, k: int, qi: int, q: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best for a query."""
        most = max(float(np.abs(q).max()), 1 / 256)
        with np.errstate(over="ignore", invalid="ignore"):
            scale = self.most * most * 65536.0
            near = np.where(np.isinf(scale), 0.0, (self.unit @ (q / most)) * np.where(np.isinf(scale), 0.0, scale))
            # rounding, and flooring by less than one in each component of either side
            off = len(q) * (1e-14 * scale + 256.0 * (self.most + most) + 1)
            low, high = np.clip(near - off, LOW, HIGH), np.clip(near + off, LOW, HIGH)
        other = np.flatnonzero(self.ids != qi)
        if len(other) > k:
            edge = np.partition(low[other], len(other) - k)[len(other) - k]
            other = other[high[other] >= edge]
        own = [_whole(float(v)) for v in q]
        found = []
        for i in other.tolist():
            score = sum(_whole(float(v)) * w for v, w in zip(self.X[i], own))
            found.append((min(max(score, LOW), HIGH), int(self.ids[i])))
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def branch_and_bound(k: int, dim_block: int = DIM_BLOCK):
    def index(ids, X):
        with np.errstate(over="ignore"):
            whole = np.floor(256.0 * X)
            fits = np.sqrt((whole * whole).sum(1)) <= EXACT
        own_ids, whole = ids[fits], whole[fits]
        longer = Long(ids[~fits], X[~fits])
        every: list[Long] = []
        order = np.argsort(-np.abs(whole).sum(0), kind="stable")  # heavy dimensions first
        columns = np.ascontiguousarray(whole[:, order].T)
        edges = [*range(0, len(columns), dim_block), len(columns)]
        mass = np.array([np.sqrt((columns[e:] ** 2).sum(0)) for e in edges[1:]])  # what is left of each vector after each block

        def one(qi, q, first, q_mass):
            score, alive = first, None
            for b in range(len(edges) - 1):
                if b:
                    part = columns[edges[b] : edges[b + 1]]
                    score = score + q[edges[b] : edges[b + 1]] @ (part if alive is None else part[:, alive])
                if b == len(edges) - 2:
                    break
                left = q_mass[b] * (mass[b] if alive is None else mass[b][alive])
                left += 1e-6 * left + 1e-6  # rounding of the norms must not drop a candidate
                lower = score - left
                if len(lower) > k + 1:  # one more than k, as the query itself may be among them
                    floor_ = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1]
                    stay = np.flatnonzero(score + left >= floor_)
                    if len(stay) < 0.8 * len(score):
                        alive = stay if alive is None else alive[stay]
                        score = score[stay]
            own = own_ids if alive is None else own_ids[alive]
            other = own != qi
            own, score = own[other], score[other]
            at = best(k, score, own)
            return own[at], score[at].astype(np.int64)

        def ask(query_ids, Q):
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            with np.errstate(over="ignore"):
                W = np.floor(256.0 * Q)
                short = np.sqrt((W * W).sum(1)) <= EXACT
            W = np.ascontiguousarray(np.where(short[:, None], W, 0)[:, order])
            q_mass = np.array([np.sqrt((W[:, e:] ** 2).sum(1)) for e in edges[1:]]).T
            first = W[:, : edges[1]] @ columns[: edges[1]]
            for i, qi in enumerate(query_ids.tolist()):
                if short[i]:
                    top, score = one(qi, W[i], first[i], q_mass[i])
                    more = longer.top(k, qi, Q[i]) if len(longer.ids) else []
                else:
                    top, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if not every:
                        every.append(Long(ids, X))
                    more = every[0].top(k, qi, Q[i])
                if more:
                    top, score = np.r_[top, [m[1] for m in more]], np.r_[score, [m[0] for m in more]]
                    at = np.lexsort((top, -score.astype(object) if (score == LOW).any() else -score))[:k]
                    top, score = top[at], score[at]
                found.append((np.full(len(top), qi), top, score))
            return [np.concatenate(c) for c in zip(*found)]

        return ask

    return index


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by every, against all rows but themselves."""
    return search_shards(sound_vectors(df, id_col, vec_col, allow_zero=True), every, k, branch_and_bound(k), "long")
