"""Variable-capacity best-fit packing: documents into sequences of several permitted lengths.

Lengths are dealt to domains of about ``domain_rows`` pieces each by a hash of id, length, piece and the number of the
repeated row, so neither one key nor the layout of files decides, and every domain is packed by best-fit decreasing. A piece goes to the open bin whose free space it leaves smallest. If it fits none, a bin is opened
at that permitted length whose cost for a token is least when it is filled with the largest pieces still to come that
fit; lengths so compete jointly. At the end each bin is downsized to the least permitted length that holds its contents.

A text longer than the greatest length is cut into pieces of that length and a rest. A task holds lengths and ids of one
domain, never texts.

Defined results: a document counts one token more, for its end, so that null and empty texts have length 1; rows that
share a doc_id are packed each, as are those with a null doc_id; equal lengths go in order of doc_id; extra columns stay
out; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import Scratch, text_batches
from cardloom.llm.tokenbin import Encoder

LENGTHS = (512, 1024, 2048, 4096)
DOMAIN_ROWS = 50_000


def pack(sizes: list[int], capacities: tuple[int, ...], costs: tuple[float, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size and the permitted length of each bin. sizes: descending, at most the last capacity."""
    left: dict[int, int] = {}
    for x in sizes:
        left[x] = left.get(x, 0) + 1
    waiting = 0  # bit x: pieces of size x are still to come
    for x in left:
        waiting |= 1 << x
    free: dict[int, list[int]] = {}
    spaces = 0  # bit r: some open bin has r free
    capacity, used = [], []
    where, offset = [], []

    def fill(c: int, x: int) -> int:
        """Content of a bin of capacity c that begins with x, filled with the largest pieces to come."""
        room, taken = c - x, {x: 1}
        while room:
            fits = waiting & ((1 << (room + 1)) - 1)
            y = 0
            while fits:
                y = fits.bit_length() - 1
                if left[y] > taken.get(y, 0):
                    break
                fits ^= 1 << y
                y = 0
            if not y:
                break
            n = min(room // y, left[y] - taken.get(y, 0))
            taken[y] = taken.get(y, 0) + n
            room -= n * y
        return c - room

    for x in sizes:
        above = spaces >> x
        if above:
            r = x + (above & -above).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                spaces ^= 1 << r
        else:
            _, _, c = min((cost / fill(c, x), -c, c) for c, cost in zip(capacities, costs) if c >= x)
            b, r = len(capacity), c
            capacity.append(c)
            used.append(0)
        left[x] -= 1
        if not left[x]:
            waiting ^= 1 << x
        where.append(b)
        offset.append(used[b])
        used[b] += x
        r -= x
        if r:
            free.setdefault(r, []).append(b)
            spaces |= 1 << r
    return where, offset, [next(c for c in capacities if c >= u) for u in used]


def _packing(capacities, costs):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        t = t.take(pc.sort_indices(t, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        where, offset, size = pack(t.column("length").to_pylist(), capacities, costs)
        first = TaskContext.get().partitionId() << 32
        t = t.append_column("bin_id", pa.array([first + b for b in where], pa.int64()))
        t = t.append_column("bin_length", pa.array([size[b] for b in where], pa.int32()))
        yield from t.append_column("bin_offset", pa.array(offset, pa.int32())).combine_chunks().to_batches(max_chunksize=10_000)

    return run


def best_fit(lengths: DataFrame, capacities: tuple[int, ...] = LENGTHS, costs: tuple[float, ...] | None = None, domain_rows: int = DOMAIN_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_length, bin_offset) of lengths (doc_id, length >= 1).

    costs: of a sequence of each permitted length; a token's share is compared. Left out, a sequence costs its length.
    """
    s = Scratch(lengths.sparkSession, "packing")
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    alike = lengths.select("doc_id", F.col("length").cast("long").alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("rows"))
    each = alike.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / most).cast("long") - 1))
    pieces = each.select("doc_id", "row", "n", cuts.alias("piece"))
    start = F.col("piece") * most
    pieces = s.put(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(most).cast("long")).cast("int").alias("length"), "row"), "pieces")
    domains = max(1, math.ceil(pieces.count() / domain_rows))
    dealt = pieces.repartition(domains, F.xxhash64("doc_id", "row", "piece", "length")).select("doc_id", "piece", "start", "length")
    return dealt.mapInArrow(_packing(capacities, tuple(costs or map(float, capacities))), "doc_id long, piece long, start long, length int, bin_id long, bin_length int, bin_offset int")


_encoders: dict = {}


def _counting(tokenizer: str):
    def run(batches):
        import pyarrow as pa

        if tokenizer not in _encoders:  # stays while the worker lives
            _encoders[tokenizer] = Encoder(tokenizer, count_only=True)
        for batch in batches:
            n = [n + 1 for n, _ in _encoders[tokenizer].pieces.of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "length"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacities: tuple[int, ...] = LENGTHS, costs: tuple[float, ...] | None = None, domain_rows: int = DOMAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """best_fit of the token counts of docs; tokenizer: a byte-level file that every executor can open."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with text_batches(docs.sparkSession):  # best_fit writes the lengths before it returns
        return best_fit(rows.mapInArrow(_counting(tokenizer), "doc_id long, length long"), capacities, costs, domain_rows)
