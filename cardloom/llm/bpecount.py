"""Token counts by byte-pair merging without emitting tokens.

A pre-token's bytes form a linked list; a heap holds its adjacent pairs by merge rank, then place. The lowest pair is
popped and joined until none is left, and the count is the initial symbols minus the merges. Counts of pre-tokens, and of
pieces between white space, are kept in each Python worker in maps of a bounded number of entries.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special string inside a text counts as one token, as
the library takes it by default; repeated rows are counted each; extra columns stay out; an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import Pieces, slices


def visible_bytes() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + i)
    return [chars[b] for b in range(256)]


class Counter:
    def __init__(self, path: str, pattern: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        merges = spec["model"]["merges"]
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.find = regex.compile(pattern).findall
        self.bytes = visible_bytes()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.known: dict[str, int] = {}
        self.pieces = Pieces(self.of, len(spec["model"]["vocab"]), ids=False)

    def merged(self, pretoken: str) -> int:
        """Symbols of one pre-token that are left after all merges."""
        symbol = [self.bytes[b] for b in pretoken.encode()]
        n = len(symbol)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if symbol[i] != left:
                continue  # gone, or grown since
            j = after[i]
            if j >= n or symbol[j] != right:
                continue
            merges += 1
            symbol[i], symbol[j] = left + right, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (r := rank((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return n - merges

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        if len(known) > 400_000:
            known.clear()
        for p in self.find(text):
            n = known.get(p)
            if n is None:
                n = known[p] = self.merged(p)
            total += n
        return total

    def of(self, texts: list[str]) -> list[int]:
        if self.cut is None:
            return [self._plain(t) for t in texts]
        return [sum(map(self._plain, self.cut.split(t))) + len(self.cut.findall(t)) for t in texts]

    def counts(self, column) -> list[int]:
        """Tokens of each text of an Arrow array."""
        return [n for n, _ in self.pieces.of(column)]


_counters: dict = {}


def _counting(path: str, pattern: str):
    def run(batches):
        import pyarrow as pa

        if path not in _counters:  # stays while the worker lives
            _counters[path] = Counter(path, pattern)
        for batch in slices(batches):
            n = _counters[path].counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit). path: a byte-level tokenizer file that every executor can open; pattern: its pre-token pattern."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(_counting(path, pattern), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
