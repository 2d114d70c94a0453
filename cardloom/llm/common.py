"""What the training-data operators share: scratch tables, size-checked joins, hashing of words, cached word splits."""

from __future__ import annotations

import hashlib
import os
import secrets
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that a size-checked broadcast may hold, by its rows and the width of its schema; beyond it a shuffled join does the same work.
BROADCAST_BYTES = 16 << 20
#: What a row of a broadcast table takes besides its columns: header, links and its share of a hash table that grows by doubling.
ENTRY = 64
#: What a string or an array counts as in that width.
WIDE = 64
#: Copies of the small side of a salted join: a key with a third of the rows lands in so many tasks.
SALTS = 16
#: Rows from which a key is spread over SALTS tasks.
HOT = 1000
#: Texts in an Arrow batch.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a single machine (local[*], as in
    tests) gets one of its own; a cluster gets an error, as no folder of one machine would do."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. ``drop`` removes those that the result no longer reads; the rest, which lazy
    results still read, goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.named = 0, {}
        store, path = self._store(self.at)
        store.mkdirs(path)
        store.deleteOnExit(path)

    def _store(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.at}/{name}-{self.n}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: lineage ends at files that every executor sees."""
        at = self.path(name)
        df.write.parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.scratch_path = self.named[name] = at
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t.scratch_path)

    def drop_named(self, name: str) -> None:
        """The last table put under the name."""
        self.remove(self.named.pop(name))

    def remove(self, at: str) -> None:
        store, path = self._store(at)
        store.delete(path, True)


@contextmanager
def _at_most(spark: SparkSession, key: str, most: int):
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_batches(spark: SparkSession, most: int = TEXT_ROWS):
    """Arrow batches of at most most rows for what is computed inside, as a batch holds whole texts, which may be long, on both
    sides of the pipe. Spark bounds a batch's bytes besides (spark.sql.execution.arrow.maxBytesPerBatch)."""
    return _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", most)


def read_batches(spark: SparkSession, most: int):
    """At most most rows are decoded at once from the Parquet files that what is computed inside reads: Spark's 4,096 rows of
    arrays are a whole row group, decoded with levels beside each entry."""
    return _at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", most)


def slices(batches, rows: int = TEXT_ROWS):
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---------------------------------------------------------------- joins with a side that may be small


def row_bytes(df: DataFrame) -> int:
    """Bytes that a row of df counts as in a broadcast: ENTRY, its fixed-width columns, and WIDE for each other one."""
    return ENTRY + sum({"bigint": 8, "double": 8, "int": 4, "boolean": 1}.get(f.dataType.simpleString(), WIDE) for f in df.schema.fields)


def small(df: DataFrame) -> bool:
    return df.count() * row_bytes(df) <= BROADCAST_BYTES


def meet(big: DataFrame, few: DataFrame, on: list[str], how: str = "inner", salt: Column | None = None) -> DataFrame:
    """big joined with few, whose keys are distinct. few is broadcast if it is counted and its bytes are bounded; else both
    sides shuffle, with salt (a column of big that differs among the rows of a key) spreading a key over SALTS tasks. Spark
    reckons a salted table by the files under it, SALTS times too small, so it is told to merge and not to broadcast."""
    if small(few):
        return big.join(F.broadcast(few), on, how)
    if salt is None:
        return big.join(few.hint("merge"), on, how)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def spread(big: DataFrame, few: DataFrame, on: str, hot: DataFrame, salt: Column) -> DataFrame:
    """big joined with few on a key that hot rows may crowd: those of the keys in hot are dealt to SALTS tasks by salt."""
    hot = hot.select(on).withColumn("_hot", F.lit(True))
    n = hot.count()
    if not n:
        return big.join(few, on)
    if n * row_bytes(hot) <= BROADCAST_BYTES:
        hot = F.broadcast(hot)
    big = big.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    all_ = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    few = few.join(hot, on, "left").withColumn("_salt", F.explode(all_)).drop("_hot")
    return big.join(few, [on, "_salt"]).drop("_salt")


# ---------------------------------------------------------------- hashes of words and shingles

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts worked on together, and of a word that is hashed eight bytes at a time; longer words go to BLAKE2.
_RUN, _SHORT = 1 << 20, 64
_BLANK, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER[65:91] += 32  # A-Z count as a-z


def new_key() -> bytes:
    """A secret for the hashes of one job, so that no text can be written whose words collide."""
    return secrets.token_bytes(16)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; zeros follow the end."""
    return np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))


_KEPT = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def span_hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """A keyed 64-bit hash of each span of bytes."""
    k0, k1 = np.frombuffer(key, np.uint64)
    length = end - at
    window = eights(data)
    h = mix(length.astype(np.uint64) * _GOLD + k0)
    alive, done = np.flatnonzero(length <= _SHORT), 0
    while len(alive):
        own = h[alive] ^ (window[at[alive] + done] & _KEPT[np.minimum(length[alive] - done, 8)])
        h[alive] = mix(own * _GOLD + k1)
        done += 8
        alive = alive[length[alive] > done]
    for i in np.flatnonzero(length > _SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[at[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def word_spans(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word. first: places at which a text begins."""
    full = ~_BLANK[data]
    start, stop = full.copy(), full.copy()
    start[1:] &= ~full[:-1]
    first = first[first < len(data)]
    start[first] = full[first]
    stop[:-1] &= ~full[1:] | start[1:]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _runs(texts):
    """(bytes, edges) of texts that lie together, about _RUN bytes each; a longer text comes in parts that end at white space,
    the last of them marked: (bytes, edges, goes on)."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _RUN, "right")) - 1
        if j > i:
            j = min(j, n)
            yield whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False
            i = j
            continue
        at, last = int(offsets[i]), int(offsets[i + 1])
        while at < last:
            end = min(last, at + _RUN)
            while end < last and not _BLANK[whole[end - 1]]:  # up to the next blank, however far
                gap = np.flatnonzero(_BLANK[whole[end : end + _RUN]])
                end = min(last, end + (int(gap[0]) + 1 if len(gap) else _RUN))
            yield whole[at:end], np.array([0, end - at]), end < last
            at = end
        i += 1


def word_hashes(texts, key: bytes):
    """Yields (hashes of all words, number of words of each text) for runs of the Arrow string array's texts, in order.
    Words are the runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z; a null text has none."""
    held: list[np.ndarray] = []
    for data, edges, goes_on in _runs(texts):
        data = _LOWER[data]
        at, end = word_spans(data, edges[:-1])
        words = span_hashes(data, at, end, key)
        if goes_on or held:
            held.append(words)
            if not goes_on:
                words = np.concatenate(held)
                held = []
                yield words, np.array([len(words)])
            continue
        yield words, np.diff(np.searchsorted(at, edges))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; fewer words count as one shingle, none as none."""
    factor = mix(np.arange(1, k + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    if len(words) >= k:
        n = len(words) - k + 1
        rolled = words[:n] * factor[0]
        for j in range(1, k):
            rolled += words[j : j + n] * factor[j]
        rolled = mix(rolled)
    at = 0
    for c in counts.tolist():
        if c >= k:
            yield np.unique(rolled[at : at + c - k + 1])
        elif c:
            with np.errstate(over="ignore"):
                yield mix(np.array([(words[at : at + c] * factor[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c


# ---------------------------------------------------------------- texts cut where a byte-level tokenizer cuts them too


_ALPHA, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_STOP[[ord(c) for c in ".,!?;:"]] = True
_WIDE = ((0xC2, None, (0x85, 0xA0)), (0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,)))


class Pieces:
    """Token ids of texts by pieces, kept in a table with one place for each hash: a new piece takes the place of an old one.

    Where a single space or line feed stands between other characters, the byte-level pattern always begins a new
    pre-token at it, and merges never cross pre-tokens; so a text is cut before each, behind a line feed, and between a
    letter and a stop, where a pre-token ends too, and a piece's ids do not depend on its surroundings. A text with any other
    white space, with two in a row, at an end, or with ``<|`` is taken whole. Pieces are told apart by all their bytes: up to
    15 of them and their number are the key itself; longer pieces have a keyed 128-bit BLAKE2 digest in its place. The
    table's size is fixed, and a text with a piece of more than ``WIDTH`` ids is taken whole.
    """

    WIDTH, BITS, RUN = 16, 21, 1 << 20

    def __init__(self, compute, vocabulary: int, ids: bool = True):
        """compute: texts -> a list of ids of each, or with ids False the number of them."""
        self.compute, self.with_ids = compute, ids
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        if not ids:  # counts alone: half the run and the table, as other stages share the worker's memory
            self.BITS, self.RUN = self.BITS - 1, self.RUN // 2
        n = 1 << self.BITS
        self.one, self.two, self.n = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)
        self.ids = np.zeros((n, self.WIDTH), self.kind) if ids else None
        self.secret = os.urandom(16)

    def of(self, column):
        """For each text of an Arrow string array the number of its ids and, if they are kept, the ids as little-endian 32-bit integers."""
        import pyarrow as pa

        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + self.RUN, "right")) - 1))
            yield from self._run(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j

    def _apart(self, data: np.ndarray, sep: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Places of bytes that make a text one to be taken whole."""
        odd = (data < 0x20) & (data != 0x0A) & ((data >= 0x1C) | (data >= 0x09) & (data <= 0x0D))
        odd[1:] |= sep[1:] & sep[:-1] | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        at = [np.flatnonzero(odd)]
        for lead in sorted({w[0] for w in _WIDE}):
            place = np.flatnonzero(data == lead)
            second, third = data[np.minimum(place + 1, len(data) - 1)], data[np.minimum(place + 2, len(data) - 1)]
            for first, middle, last in _WIDE:
                if first == lead:
                    at.append(place[np.isin(second, last) if middle is None else (second == middle) & np.isin(third, last)])
        full = edges[1:] > edges[:-1]
        starts, ends = edges[:-1][full], edges[1:][full] - 1
        return np.concatenate([*at, starts[sep[starts]], ends[sep[ends]]])

    @staticmethod
    def _letter(data: np.ndarray) -> np.ndarray:
        """Bytes that end an ASCII or Latin-1 letter."""
        out = _ALPHA[data]
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        out[at] = (data[at] != 0x97) & (data[at] != 0xB7)
        return out

    def _run(self, data: np.ndarray, edges: np.ndarray):
        counts = np.zeros(len(edges) - 1, np.int64)
        out: list = [b""] * len(counts)
        if len(data):
            sep = (data == 0x20) | (data == 0x0A)
            simple = edges[1:] > edges[:-1]
            simple[np.searchsorted(edges, self._apart(data, sep, edges), "right") - 1] = False
            cut = sep.copy()
            cut[1:] |= _STOP[data[1:]] & self._letter(data)[:-1]
            cut[1:] |= data[:-1] == 0x0A
            cut[edges[:-1][simple]] = True
            at = np.flatnonzero(cut)
            text = np.searchsorted(edges, at, "right") - 1
            at, text = at[simple[text]], text[simple[text]]
            if len(at):
                self._simple(data, edges, at, text, simple, counts, out)
            rest = np.flatnonzero(~simple & (edges[1:] > edges[:-1]))
            if len(rest):
                found = self.compute([data[edges[r] : edges[r + 1]].tobytes().decode() for r in rest])
                for r, ids in zip(rest, found):
                    counts[r] = len(ids) if self.with_ids else ids
                    if self.with_ids:
                        out[r] = np.array(ids, "<u4").tobytes()
        return zip(counts.tolist(), out)

    def _keys(self, data, at, end) -> tuple[np.ndarray, np.ndarray]:
        """A piece's first bytes, and the rest with its length on top; the two halves of the digest of a longer one."""
        window, length = eights(data), end - at
        one = window[at]
        one &= _KEPT[np.minimum(length, 8)]
        two = length.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(length > 8)
        two[more] |= window[at[more] + 8] & _KEPT[np.minimum(length[more] - 8, 7)]
        for i in np.flatnonzero(length > 15).tolist():
            digest = hashlib.blake2b(data[at[i] : end[i]].tobytes(), digest_size=16, key=self.secret).digest()
            one[i], two[i] = np.frombuffer(digest, np.uint64)
            two[i] |= np.uint64(16 << 56)  # no short piece has this length
        return one, two

    def _simple(self, data, edges, at, text, simple, counts, out):
        last = np.r_[text[1:] != text[:-1], True]
        end = np.where(last, edges[text + 1], np.r_[at[1:], 0])
        one, two = self._keys(data, at, end)
        h = mix(one * _GOLD ^ two * _M1)
        unique, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if (other := np.flatnonzero((one[first][inv] != one) | (two[first][inv] != two))).size:  # pieces whose 64 bits are those of another: their texts are taken whole
            simple[text[other]] = False
        slot = (unique >> np.uint64(64 - self.BITS)).astype(np.int64)
        one, two = one[first], two[first]
        hit = (self.one[slot] == one) & (self.two[slot] == two)
        n = np.where(hit, self.n[slot], 0)
        ids = self.ids[slot] if self.with_ids else None
        new = np.flatnonzero(~hit)
        if len(new):
            pieces = [data[a:b].tobytes().decode() for a, b in zip(at[first[new]].tolist(), end[first[new]].tolist())]
            got = self.compute(pieces)
            if self.with_ids:
                n[new] = np.fromiter(map(len, got), np.int32, len(got))
                fits = n[new] <= self.WIDTH
                flat = np.fromiter((x for g, f in zip(got, fits.tolist()) if f for x in g), self.kind)
                block = np.zeros((len(new), self.WIDTH), self.kind)
                block[(np.arange(self.WIDTH) < n[new, None]) & fits[:, None]] = flat
                ids[new] = block
                kept = new[fits]
                self.ids[slot[kept]] = ids[kept]
            else:
                n[new] = got
                kept = new
            self.one[slot[kept]], self.two[slot[kept]], self.n[slot[kept]] = one[kept], two[kept], n[kept]
        each = n[inv]
        begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        own = text[begin]
        counts[own] = np.add.reduceat(each, begin)
        if not self.with_ids:
            return
        wide = each > self.WIDTH
        simple[text[wide]] = False
        block = ids[inv]
        flat = block[np.arange(self.WIDTH) < np.where(wide, 0, each)[:, None]].astype("<u4").tobytes()
        done = np.r_[0, np.cumsum(np.add.reduceat(np.where(wide, 0, each), begin))] * 4
        for t, a, b in zip(own.tolist(), done[:-1].tolist(), done[1:].tolist()):
            out[t] = flat[a:b]
