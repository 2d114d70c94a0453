"""Token ids as binary shards of independent zstandard frames with a seek table.

``write_token_shards`` encodes texts and writes their ids in ascending doc_id order: partitions are ranges of doc_id and a
hash of the text, so one id may hold many rows; each is one shard file, of ``SHARD_BYTES`` of text or less on average. A shard is a run of zstandard frames, each holding the ids (little-endian unsigned 32-bit) of whole
documents up to about ``frame_bytes``, followed by the seek table of the public zstandard seekable format: a skippable
frame with each frame's compressed size, size and checksum. Frames carry zstandard's own checksum too. A Parquet index
gives each document's shard, frame and place, so ``read_documents`` seeks to the frames asked for and to no others.

Shards and index lie in the shared folder. A task writes under a name of its own attempt and renames at its end; a lost
task is run again and puts the same bytes in place.

Defined results: a null or empty text holds only the end id; rows with equal doc_id are ordered by a hash of their text,
then by the text, repeated rows are written each; a null doc_id comes first; extra columns stay out; an empty table gives no documents.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cardloom.llm.bpecount import visible_bytes
from cardloom.llm.common import Pieces, Scratch, slices, text_batches

FRAME_BYTES = 1 << 20
#: Ids that a reading task gives out at a time, by their bytes; a document of more comes alone.
READ_BYTES = 32 << 20
READ = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
#: Text of a shard; a table that has less of it for each shuffle partition gets one shard for each of those.
SHARD_BYTES = 256 << 20
#: Fixed values of the public zstandard seekable format: magic of a skippable frame, magic of the seek table, flag "has checksums".
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


def open_store(uri: str):
    """(file system, path) of a folder that every executor can open."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame of an open shard, from its end alone."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table with checksums")
    file.seek(end - 9 - 12 * n)
    out, at = [], 0
    for packed, size, check in struct.iter_unpack("<III", file.read(12 * n)):
        out.append((at, packed, size, check))
        at += packed
    return out


def read_frame(file, entry: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard

    at, packed, size, check = entry
    file.seek(at)
    raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError(f"frame at {at} is damaged")
    return raw


class ShardWriter:
    """Frames and seek table of one shard."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.most, self.entries, self.held, self.size = out, frame_bytes, [], [], 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, ids: bytes) -> tuple[int, int]:
        """Frame and byte offset in it of a document's ids."""
        if self.held and self.size + len(ids) > self.most:
            self.flush()
        place = len(self.entries), self.size
        self.held.append(ids)
        self.size += len(ids)
        return place

    def flush(self):
        import xxhash

        if self.held:
            raw = b"".join(self.held)
            frame = self.pack.compress(raw)
            self.out.write(frame)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self):
        self.flush()
        self.out.write(seek_table(self.entries))


class Encoder:
    """Ids of whole texts as the library gives them, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, count_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.visible = self.tokenizer.model, dict(enumerate(visible_bytes()))
        compute = (lambda texts: list(map(len, self.of(texts)))) if count_only else self.of
        self.pieces = Pieces(compute, self.tokenizer.get_vocab_size(), ids=not count_only)

    def of(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Letters alone, with a space before or not, are one pre-token, which the library's model takes as it is."""
        out, rest = [], []
        for i, p in enumerate(texts):
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) or p.isalpha():
                out.append([t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.visible))])
            else:
                out.append(None)
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def ids(self, column):
        """Ids of each text of an Arrow array."""
        for _, ids in self.pieces.of(column):
            yield ids


_encoders: dict = {}


def _writing(folder: str, tokenizer: str, end: bytes, frame_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, store = task.partitionId(), None
        if tokenizer not in _encoders:  # stays while the worker lives
            _encoders[tokenizer] = Encoder(tokenizer)
        encode, start = _encoders[tokenizer].ids, 0
        for batch in batches:
            if store is None:
                store, root = open_store(folder)
                own = f"{root}/.{task.taskAttemptId()}-{shard:06d}"
                out = store.open_output_stream(own, compression=None)
                shards = ShardWriter(out, frame_bytes)
            rows = []
            for ids in encode(batch.column(1)):
                ids += end
                frame, at = shards.add(ids)
                rows.append((frame, at, start, len(ids) // 4))
                start += len(ids) // 4
            frames, ats, starts, ns = (pa.array(c, pa.int64()) for c in zip(*rows)) if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * len(rows), pa.int32()), frames, ats, starts, ns], names=["doc_id", "shard", "frame", "at", "start", "n_tokens"])
        if store is not None:
            shards.close()
            out.close()
            store.move(own, f"{root}/shard-{shard:06d}.bin")

    return run


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards and index under folder and returns the index: (doc_id, shard, frame, at, start, n_tokens), start counted over all shards."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keys = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys, "text")
    store, root = open_store(folder)
    store.create_dir(root)
    written = rows.mapInArrow(_writing(folder, tokenizer, struct.pack("<I", end_id), frame_bytes), "doc_id long, shard int, frame long, at long, start long, n_tokens long")
    with text_batches(spark):
        written.write.parquet(f"{folder}/index")
    index = spark.read.schema(written.schema).parquet(f"{folder}/index")
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    base = sums.select("shard", before.alias("base"))
    return index.join(F.broadcast(base), "shard").withColumn("start", F.col("start") + F.col("base")).select("doc_id", "shard", "frame", "at", "start", "n_tokens")


def _reading(folder: str, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        store, root = open_store(folder)
        now, file, table, raw = (None, None), None, None, b""

        def given(batch, at, crcs, ids):
            part = batch.slice(at, len(crcs))
            columns = [part.column(0), part.column(4), part.column(5), pa.array(crcs, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=READ[: len(columns) + with_ids])

        for batch in slices(batches):
            begun, crcs, ids, size = 0, [], [], 0
            for i, (shard, frame, at, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 5)))):
                if now != (shard, frame):
                    if now[0] != shard:
                        file = store.open_input_file(f"{root}/shard-{shard:06d}.bin")
                        table = read_seek_table(file)
                    raw, now = read_frame(file, table[frame]), (shard, frame)
                if with_ids and crcs and size + 4 * n > READ_BYTES:  # what is held is given out before it grows past the bound
                    yield given(batch, begun, crcs, ids)
                    begun, crcs, ids, size = i, [], [], 0
                own = memoryview(raw)[at : at + 4 * n]
                crcs.append(zlib.crc32(own))
                if with_ids:
                    ids.append(bytes(own))
                    size += 4 * n
            if crcs:
                yield given(batch, begun, crcs, ids)

    return run


def read_documents(index: DataFrame, folder: str, partitions: int | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the index rows given, all or some; only their frames are decompressed. A task holds
    one frame, which is one document where that is longer than a frame, and READ_BYTES of ids, none without with_ids."""
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("doc_id", "shard", "frame", "at", "start", "n_tokens").repartition(n, "shard", "frame").sortWithinPartitions("shard", "frame", "at")
    return rows.mapInArrow(_reading(folder, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Writes docs to shards in the shared folder and reads every document back."""
    folder = Scratch(docs.sparkSession, "tokens").at
    return read_documents(write_token_shards(docs, folder, tokenizer, end_id), folder, with_ids=with_ids)
