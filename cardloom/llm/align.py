"""Cross-tokenizer alignment: where the tokens of two tokenizers meet, and which of their ids overlap how often.

A is a byte-level BPE over a space and the text, B a piece BPE with byte fallback that puts the space there itself. The texts
of a batch lie in one run of bytes. The byte at which a token ends is its mark: A's and B's marks are counted once over the
whole run, and where both stand the tokens are cut into groups. Between two marks that follow one another lies exactly one
pair of overlapping tokens, so marks are links as well; what a document has of each comes from segmented sums over the run.

A run is about ``RUN`` bytes of documents. Longer texts come in parts, cut before a single space between letters: there both
tokenizers end a token, whatever follows, so parts give what the whole would. B's model is asked for pieces: as it has no
entry with a space behind another character, it never merges across the beginning of a word.

An id pair's count is the number of documents that hold it linked. A run keeps its distinct pairs with the number of its
documents that hold each, and its documents' pairs as places in that list: one row a run. Counts of pairs are summed over
runs, broadcast if their bytes are counted and few, else joined with salted keys, and meet their run, a run at a time, as rows
of two numbers: sorts of such rows go to disk where memory ends, which lists of them in an aggregate do not.

Defined results: texts that are null, empty, or whose tokens of either kind do not spell out space and text (one with U+2581
in it) have no tokens: zeros and an empty digest; special strings inside texts are plain text; rows are aligned each,
whatever their ids, and each counts as a document; extra columns stay out; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from cardloom.llm.bpecount import visible_bytes
from cardloom.llm.common import Pieces, Scratch, meet, read_batches, slices, text_batches
from cardloom.llm.tokenbin import Encoder

RUN = 1 << 20
#: Ids are written into a digest so many at a time.
SHOWN = 1 << 19
#: Rows of runs, some MB each, in a batch that is read.
RUN_ROWS = 8
LOW = np.uint64(32)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class _Spaced(Pieces):
    """Pieces of texts that begin with a single space, which a byte-level pre-token takes with what follows."""

    def _apart(self, data, sep, edges):
        at = super()._apart(data, sep, edges)
        first = np.zeros(len(data) + 1, bool)
        first[edges[:-1]] = True
        return at[~(first[at] & (data[at] == 0x20))]


class _Words(Pieces):
    """Pieces that begin with their spaces: a text is cut before each space behind another character."""

    def _run(self, data, edges):
        counts, out = np.zeros(len(edges) - 1, np.int64), [b""] * (len(edges) - 1)
        full = edges[1:] > edges[:-1]
        if full.any():
            space = data == 0x20
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut[edges[:-1][full]] = True
            at = np.flatnonzero(cut)
            text, simple = np.searchsorted(edges, at, "right") - 1, full.copy()
            self._simple(data, edges, at, text, simple, counts, out)
            for r in np.flatnonzero(full & ~simple).tolist():  # a piece too long for the table
                found = self.compute([data[edges[r] : edges[r + 1]].tobytes().decode()])[0]
                counts[r], out[r] = len(found), np.array(found, "<u4").tobytes()
        return zip(counts.tolist(), out)


class _Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        first = np.cumsum(n) - n
        return self.all[np.repeat(self.at[ids] - first, n) + np.arange(int(n.sum()))]


class ByteSide:
    """Ids of a byte-level BPE with special strings as plain text."""

    def __init__(self, path: str):
        encoder = Encoder(path)
        encoder.tokenizer.encode_special_tokens = True
        self.pieces = _Spaced(encoder.of, encoder.tokenizer.get_vocab_size())
        back = {c: b for b, c in enumerate(visible_bytes())}
        names = [encoder.tokenizer.id_to_token(i) or "" for i in range(encoder.tokenizer.get_vocab_size())]
        self.spelling = _Spelling([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names])


class PieceSide:
    """Ids of a sentencepiece model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        if any(b == "▁" != a for t in names for a, b in zip(t, t[1:])):
            raise ValueError("an entry goes beyond the beginning of a word")
        alone = [model.piece_to_id("▁")]  # the model gives an empty text nothing
        self.pieces = _Words(lambda texts: [ids or alone for ids in model.encode([t[1:] for t in texts], num_threads=1)], n)
        self.spelling = _Spelling([bytes([int(t[1:-1], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)])


class _Digits:
    """Ids as decimal numbers, each followed by a place for its separator."""

    def __init__(self, n: int):
        self.spelling = _Spelling([b"%d." % i for i in range(n)])

    def of(self, ids: np.ndarray, separators: np.ndarray) -> np.ndarray:
        out = self.spelling.of(ids)
        out[np.cumsum(self.spelling.length[ids]) - 1] = separators
        return out


class Aligned:
    """A run's parts: tokens, groups and links of each part, ids in the order of groups."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, sides):
        spelt = np.ones(len(edges) - 1, bool)
        for ids, n, side in ((a, na, sides[0]), (b, nb, sides[1])):
            spelt &= self._spelt(data, edges, ids, n, side.spelling)
        if not spelt.all():  # their tokens and bytes go
            part = np.repeat(np.arange(len(spelt)), np.diff(edges))
            data = data[spelt[part]]
            edges = np.r_[0, np.cumsum(np.where(spelt, np.diff(edges), 0))]
            a, b = a[np.repeat(spelt, na)], b[np.repeat(spelt, nb)]
            na, nb = np.where(spelt, na, 0), np.where(spelt, nb, 0)
        self.spelt, self.n_a, self.n_b = spelt, na, nb
        end_a, end_b = np.cumsum(sides[0].spelling.length[a]), np.cumsum(sides[1].spelling.length[b])
        marks_a, marks_b = (np.bincount(e, minlength=len(data) + 1) > 0 for e in (end_a, end_b))  # at the byte behind a token
        both = marks_a & marks_b
        upto = np.cumsum(both)
        self.n_groups = upto[edges[1:]] - upto[edges[:-1]]
        # between two marks lies one pair: the tokens that are open there
        at = np.flatnonzero(marks_a | marks_b)
        open_a, open_b = (np.cumsum(m[at]) - m[at] for m in (marks_a, marks_b))
        self.pairs = a[open_a].astype(np.uint64) << LOW | b[open_b].astype(np.uint64)
        self.part_of = np.searchsorted(edges, at, "left") - 1
        self.n_links = na + nb - self.n_groups
        # ids in the order of groups: first A's of a group, then B's
        group_a, group_b = upto[end_a] - both[end_a], upto[end_b] - both[end_b]
        groups = int(upto[-1])
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        self.ids, self.separators = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        self.ids[place_a], self.ids[place_b] = a, b
        self.separators[place_a[both[end_a]]] = ord("|")
        self.separators[place_b[both[end_b]]] = ord(";")

    @staticmethod
    def _spelt(data, edges, ids, n, spelling) -> np.ndarray:
        """Which parts' tokens spell out their bytes."""
        size = np.zeros(len(n), np.int64)
        np.add.at(size, np.repeat(np.arange(len(n)), n), spelling.length[ids])
        right = size == np.diff(edges)
        got = spelling.of(ids if right.all() else ids[np.repeat(right, n)])
        part = np.repeat(np.arange(len(n)), np.diff(edges))
        kept = data if right.all() else data[right[part]]
        wrong = np.flatnonzero(got != kept)
        if len(wrong):
            right[(part if right.all() else part[right[part]])[wrong]] = False
        return right


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteSide(path_a), PieceSide(path_b)
        self.digits = _Digits(max(len(s.spelling.length) for s in self.sides))

    def run(self, texts) -> Aligned:
        """texts: an Arrow large_binary array of parts, each with its space."""
        import pyarrow as pa

        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        found = []
        for side in self.sides:
            counts, ids = zip(*side.pieces.of(texts))
            found += [np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.array(counts, np.int64)]
        return Aligned(data, offsets - offsets[0], *found, self.sides)

    def write(self, digest, ids: np.ndarray, separators: np.ndarray) -> None:
        for i in range(0, len(ids), SHOWN):
            digest.update(self.digits.of(ids[i : i + SHOWN], separators[i : i + SHOWN]))


def _parts(text: bytes):
    """A space and the text in parts of about RUN bytes, cut before a single space between letters."""
    text, at = b" " + text, 0
    data = np.frombuffer(text, np.uint8)
    while at < len(text):
        end = at + RUN
        while end < len(text):
            piece = data[end - 1 : end + RUN]
            cut = np.flatnonzero((piece[1:-1] == 0x20) & _LETTER[piece[:-2]] & _LETTER[piece[2:]])
            if len(cut):
                end += int(cut[0])
                break
            end += len(piece) - 2 if len(piece) > 2 else RUN
        yield text[at : min(end, len(text))]
        at = min(end, len(text))


_aligners: dict = {}


def _of_runs(path_a: str, path_b: str):
    """One row for each run of documents."""

    def documents(batches):
        """(ids, texts) of runs; a text longer than a run comes alone."""
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN, "right")) - 1)
                yield batch.column(0).slice(i, j - i), texts.slice(i, j - i)
                i = j

    def short(aligner, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        full = np.asarray(pc.greater(pc.binary_length(texts), 0).cast(pa.int8())) > 0
        spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts.filter(pa.array(full)), pa.scalar(b"", pa.large_binary()))
        columns, digests = np.zeros((4, len(full)), np.int64), np.full(len(full), "", object)
        at = np.flatnonzero(full)
        if not len(at):
            return columns, digests, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = aligner.run(spaced)
        columns[:, at] = run.n_a, run.n_b, run.n_groups, run.n_links
        last = np.cumsum(run.n_a + run.n_b)
        shown = aligner.digits.of(run.ids, run.separators)
        ends = np.cumsum(aligner.digits.spelling.length[run.ids])
        view = memoryview(shown)
        for d, a, b in zip(at.tolist(), (last - run.n_a - run.n_b).tolist(), last.tolist()):
            if b > a:  # without the separator behind the last id
                digests[d] = hashlib.sha256(view[int(ends[a - 1]) if a else 0 : int(ends[b - 1]) - 1]).hexdigest()
        return columns, digests, run.pairs, at[run.part_of]

    def long(aligner, text: bytes):
        import pyarrow as pa

        columns, digest, pairs, times = np.zeros((4, 1), np.int64), hashlib.sha256(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = None
        for part in _parts(text):
            run = aligner.run(pa.array([part], pa.large_binary()))
            if not run.spelt[0]:
                return np.zeros((4, 1), np.int64), [""], np.zeros(0, np.uint64), np.zeros(0, np.int64)
            columns[:, 0] += [int(x[0]) for x in (run.n_a, run.n_b, run.n_groups, run.n_links)]
            if held:
                digest.update(held)
            aligner.write(digest, run.ids[:-1], run.separators[:-1])
            tail = aligner.digits.of(run.ids[-1:], run.separators[-1:]).tobytes()
            digest.update(tail[:-1])
            held = tail[-1:]
            own, n = np.unique(run.pairs, return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            times = np.bincount(place, weights=np.concatenate([times, n])).astype(np.int64)
        return columns, [digest.hexdigest()], pairs, times

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if (path_a, path_b) not in _aligners:  # stays while the worker lives
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner, task, k = _aligners[path_a, path_b], TaskContext.get().partitionId(), 0
        for ids, texts in documents(slices(batches)):
            if len(texts) == 1 and len(texts[0].as_buffer()) > RUN:
                columns, digests, distinct, times = long(aligner, texts[0].as_py())
                first, place = np.array([0, len(distinct)]), np.arange(len(distinct))
                holders = np.ones(len(distinct), np.int64)
            else:
                columns, digests, pairs, doc = short(aligner, texts)
                distinct, place = np.unique(pairs, return_inverse=True)
                own, times = np.unique(doc.astype(np.uint64) << LOW | place.astype(np.uint64), return_counts=True)
                place, doc = (own & np.uint64(0xFFFFFFFF)).astype(np.int64), (own >> LOW).astype(np.int64)
                holders = np.bincount(place, minlength=len(distinct))
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
            whole = lambda x, kind: pa.array([np.asarray(x)], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[whole(c, pa.int64()) for c in columns],
                 pa.array([list(digests)], pa.list_(pa.string())), whole(distinct.view(np.int64), pa.int64()), whole(holders, pa.int32()), whole(first, pa.int32()), whole(place, pa.int32()), whole(times, pa.int32())],
                names=[f.name for f in RUNS.fields])
            k += 1

    return run


_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
#: pairs: distinct pairs of the run, holders: how many of its documents hold each; the pairs of document i are at place[first[i] : first[i + 1]].
RUNS = T.StructType([T.StructField("run", T.LongType())] + [T.StructField(c, _LONGS) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + [T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("pairs", _LONGS)] + [T.StructField(c, _INTS) for c in ("holders", "first", "place", "times")])


def _counted(run, counts):
    """A run, with the counts of its pairs by their place (negative where it is its A id's highest), to a row a document."""
    import pyarrow as pa

    whole = run.select(run.column_names[1:]).combine_chunks()
    get = lambda c: np.asarray(whole.column(c).combine_chunks().flatten())
    first, place, times, count = get("first"), get("place"), get("times").astype(np.int64), np.zeros(counts.num_rows, np.int64)
    count[np.asarray(counts.column("pos"))] = np.asarray(counts.column("count"))
    best, count = (count < 0)[place], np.abs(count)[place]
    total = [np.r_[0, np.cumsum(x)] for x in (times * best, times * count)]
    sums = [pa.array(t[first[1:]] - t[first[:-1]], pa.int64()) for t in total]
    flat = [whole.column(c).combine_chunks().flatten() for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")]
    return pa.Table.from_arrays(flat[:5] + sums + flat[5:], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned_runs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of RUNS, one for each run of documents."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_of_runs(path_a, path_b), RUNS)


def pair_counts(runs: DataFrame) -> DataFrame:
    """(pair, a, b, count): in how many documents A's id a and B's id b are linked."""
    each = runs.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").cast("long").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count"))
    return counts.select("pair", F.call_function("shiftright", "pair", F.lit(32)).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "count")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    s = Scratch(docs.sparkSession, "align")
    with text_batches(docs.sparkSession):
        runs = s.put(aligned_runs(docs, path_a, path_b, id_col, text_col), "runs")
    counts = s.put(pair_counts(runs), "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of A
    marked = s.put(meet(counts, highest, ["a"]).select("pair", F.when(F.col("count") == F.col("most"), -F.col("count")).otherwise(F.col("count")).alias("count")), "marked")
    s.drop(counts)
    with read_batches(docs.sparkSession, RUN_ROWS):
        each = runs.select("run", F.posexplode("pairs").alias("pos", "pair"))
        known = meet(each, marked, ["pair"], "inner", F.col("run")).select(F.col("run").alias("of"), "pos", "count")  # a name of its own: both sides read runs
        whole = runs.select("run", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "first", "place", "times")
        out = whole.groupBy("run").cogroup(known.groupBy("of")).applyInArrow(_counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        out = s.put(out, "aligned")
    s.drop(runs, marked)
    return out
