"""Vector code compression: product codes by Yinyang Lloyd on whole numbers.

A component x becomes floor(256 * x); vectors are cut into ``parts`` equal consecutive parts. The codebook of a part starts as
that part of the first vectors by id. A round gives every part to its nearest entry and then replaces each entry by the
floored mean of its parts.

The first round compares with every entry. From then on a row carries, for each of its parts, its entry and one lower bound
for each group of entries (a clustering of the first codebook, fixed from the start). When entries move, a group's bound falls
by its furthest drift; only groups whose bound does not exceed the exact distance to the row's own entry are scanned. Bounds
are rounded down, and a bound that equals the distance fails, so an entry of lower index at the same distance is seen.
Scans are in double precision; entries within its rounding of the nearest are compared again in whole numbers.

Each pass is one table in the shared folder: rows with their bounds (the upper half of a float each), and for each task one
row of sums, which Spark adds up. What the driver gets is the codebook and its sums, of a size that parameters and the width
of vectors fix.

Defined results: vectors that are null or hold null or non-finite components are dropped; a vector shorter than the longest,
and that one up to a multiple of ``parts``, counts as followed by zeros (an empty one is all zeros); components beyond
2^26 are held at it, so that sums stay whole numbers of 64 bits; of rows that share an id all are coded, and the first
codebook takes them in order of their vectors; null ids are coded and come last there; fewer rows than ``entries`` give as
many entries; ties go to the lower index; an entry without parts stays; null labels are one label; extra columns stay out; an
empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cardloom.llm.common import Scratch, meet, slices

PARTS, ENTRIES, ROUNDS, GROUPS = 16, 64, 2, 8
MOST = 1 << 26
#: Components worked on together.
RUN = 1 << 19


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept; v: array<int>, components floored."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), v.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    held = F.transform("x", lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(256.0 * F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c))))).cast("int"))
    return rows.select("vec_id", "label", held.alias("v"))


class Codebook:
    """Entries (parts, entries, width) in whole numbers, and the group of each."""

    def __init__(self, entries: np.ndarray, groups: int):
        self.e = entries
        self.group = np.stack([_grouped(e, groups) for e in entries]) if entries.size else np.zeros(entries.shape[:2], np.int64)
        self.n_groups = groups
        self.drift = np.zeros((len(entries), groups))

    def move(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Entries become floored means; drift: how far each group's furthest entry went, rounded up."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.e)
        gone = np.sqrt(((new - self.e).astype(float) ** 2).sum(2)) * (1 + 1e-9)
        self.drift = np.array([[d[g == i].max(initial=0.0) for i in range(self.n_groups)] for g, d in zip(self.group, gone)])
        self.e = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.e.ravel().tolist())).encode()).hexdigest()


def _grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry, by a few rounds of means that start from entries spread over their order along the widest axis."""
    at = entries.astype(float)
    order = np.argsort(at[:, np.argmax(at.var(0))], kind="stable")
    centre = at[order[np.linspace(0, len(at) - 1, min(groups, len(at))).astype(int)]]
    for _ in range(5):
        near = ((at[:, None] - centre) ** 2).sum(2).argmin(1)
        for g in range(len(centre)):
            if (near == g).any():
                centre[g] = at[near == g].mean(0)
    return near


def _whole_distance(X: np.ndarray, E: np.ndarray) -> np.ndarray:
    d = X - E
    return (d * d).sum(-1)


def _nearest(D: np.ndarray, room: np.ndarray, X: np.ndarray, E: np.ndarray) -> np.ndarray:
    """The nearest entry of each row by distances D (inf: not scanned), which are right within room; whole numbers decide among those that near."""
    best = D.argmin(1)
    close = D <= D[np.arange(len(D)), best][:, None] + 2 * room[:, None]
    several = np.flatnonzero(close.sum(1) > 1)
    if len(several):
        row, entry = np.nonzero(close[several])
        exact = _whole_distance(X[several[row]], E[entry])
        order = np.lexsort((entry, exact, row))
        first = order[np.r_[True, np.diff(row[order]) > 0]]
        best[several] = entry[first]
    return best


def _scan(X: np.ndarray, E: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances in double precision, and how far they may be off."""
    x, e = X.astype(float), E.astype(float)
    xx, ee = (x * x).sum(1), (e * e).sum(1)
    room = 1e-14 * (xx + ee.max(initial=0.0)) * (4 + X.shape[1])
    return xx[:, None] - 2 * (x @ e.T) + ee, room


def _low(D: np.ndarray, room: np.ndarray, own: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The least distance of each row to the members of a group other than its own entry, rounded down."""
    d = np.where(own[:, None] == members, np.inf, D[:, members])
    return np.sqrt(np.maximum(d.min(1, initial=np.inf) - room, 0)) * (1 - 1e-9)


class Part:
    """One part's entries, and the passes over rows."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, drift: np.ndarray):
        self.e, self.drift = entries, drift
        self.members = [np.flatnonzero(group == g) for g in range(len(drift))]
        self.group = group

    def first(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each row, lower bounds): every entry is compared."""
        D, room = _scan(X, self.e)
        own = _nearest(D, room, X, self.e)
        return own, np.stack([_low(D, room, own, m) for m in self.members], 1)

    def again(self, X: np.ndarray, own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry of each row, lower bounds, comparisons made) after the entries moved."""
        low = np.maximum(low - self.drift - 1e-6, 0)
        exact = _whole_distance(X, self.e[own]).astype(float)
        scan = low <= (np.sqrt(exact) * (1 + 1e-9))[:, None]
        some = np.flatnonzero(scan.any(1))
        if not len(some):
            return own, low, len(X)
        D, made = np.full((len(some), len(self.e)), np.inf), len(X)
        part, was = X[some], own[some]
        room = np.zeros(len(some))
        for g, m in enumerate(self.members):
            at = np.flatnonzero(scan[some, g])
            if len(at) and len(m):
                d, off = _scan(part[at], self.e[m])
                D[at[:, None], m] = d
                room[at] = np.maximum(room[at], off)
                made += d.size
        D[np.arange(len(some)), was] = exact[some]
        new = _nearest(D, room, part, self.e)
        bounds = low[some]
        for g, m in enumerate(self.members):
            at = np.flatnonzero(scan[some, g])
            if len(at):
                bounds[at, g] = _low(D[at], room[at], new[at], m)
        left = np.flatnonzero((new != was) & ~scan[some, self.group[was]])  # its old entry joins a group that was not scanned
        bounds[left, self.group[was[left]]] = np.minimum(bounds[left, self.group[was[left]]], np.sqrt(exact[some[left]]) * (1 - 1e-9))
        own, low = own.copy(), low.copy()
        own[some], low[some] = new, bounds
        return own, low, made


def _packed(low: np.ndarray) -> np.ndarray:
    """The upper halves of the bounds as floats: rounded down, as bounds are not negative."""
    return (np.minimum(low, 3e38).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return (packed.astype(np.uint32) << 16).view(np.float32).astype(float) * (1 - 1e-6)


def _fixed(column, width: int, kind) -> np.ndarray:
    """An Arrow binary column whose values have one length."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), width)


def _pass(book: Codebook, last: bool, started: bool):
    """Rows (vec_id, label, v, code, low): their entries and bounds with the codebook; the last pass gives (vec_id, label, code, error)."""

    def run(batches):
        import pyarrow as pa

        parts, entries, width = book.e.shape
        own_parts = [Part(book.e[p], book.group[p], book.drift[p]) for p in range(parts)]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        kind = None
        for batch in slices(batches, max(1, RUN // (parts * width))):
            n, kind = batch.num_rows, batch.column(1).type
            V = np.asarray(batch.column(2).flatten()).astype(np.int64).reshape(n, parts, width)
            if started:
                codes, lows = _fixed(batch.column(3), parts, np.uint8), _unpacked(_fixed(batch.column(4), parts * book.n_groups, np.uint16)).reshape(n, parts, -1)
            code, low = np.empty((n, parts), np.int64), np.empty((n, parts, book.n_groups))
            for p, part in enumerate(own_parts):
                X = V[:, p]
                if started:
                    code[:, p], low[:, p], _ = part.again(X, codes[:, p].astype(np.int64), lows[:, p])
                else:
                    code[:, p], low[:, p] = part.first(X)
                if not last:
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(sums[p], code[:, p], X)
            packed = pa.array([x.tobytes() for x in code.astype(np.uint8)], pa.binary())
            if last:
                error = sum(_whole_distance(V[:, p], book.e[p][code[:, p]]) for p in range(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
                continue
            bounds = pa.array([x.tobytes() for x in _packed(low)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed, bounds, pa.nulls(n, pa.list_(pa.int64()))], names=["vec_id", "label", "v", "code", "low", "sums"])
        if kind is not None and not last:
            flat = pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))
            none = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.list_(pa.int32()), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, flat], names=["vec_id", "label", "v", "code", "low", "sums"])

    return run


def first_codebook(rows: DataFrame, width: int, parts: int, entries: int, groups: int) -> Codebook:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # entries rows at most
    return Codebook(np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2), groups)


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, Codebook | None]:
    """((vec_id, label, code, error), codebook); code: an entry's index for each part, a byte each; no codebook without rows."""
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte: 256 entries at most")
    s = Scratch(df.sparkSession, "codes")
    rows = whole_vectors(df, id_col, vec_col, label_col)
    label = rows.schema["label"].dataType
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    done = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if longest is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = max(1, -(-longest // parts))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v"))))
    book = first_codebook(rows, width, parts, entries, groups)
    state = T.StructType([*done.fields[:2], T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType()), T.StructField("low", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    now = None
    for _ in range(rounds):
        new = s.put((now.where("v IS NOT NULL").drop("sums") if now is not None else rows).mapInArrow(_pass(book, False, now is not None), state), "state")
        total = {r["pos"]: r["n"] for r in new.where("sums IS NOT NULL").select(F.posexplode("sums").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
        flat = np.array([total[i] for i in range(len(total))], np.int64)
        book.move(flat[: book.e.size].reshape(book.e.shape), flat[book.e.size :].reshape(book.e.shape[:2]))
        if now is not None:
            s.drop(now)
        now = new
    final = s.put((now.where("v IS NOT NULL").drop("sums") if now is not None else rows).mapInArrow(_pass(book, True, now is not None), done), "coded")
    if now is not None:
        s.drop(now)
    return final, book


def _label_key(label: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def code_report(df: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes in hexadecimal, errors summed over equal labels."""
    coded, book = vector_codes(df, **how)
    coded = coded.withColumn("_label", _label_key(F.col("label")))
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    out = meet(coded, sums, ["_label"], "inner", F.col("vec_id"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book.sha256() if book else "").alias("codebooks_sha256"))
