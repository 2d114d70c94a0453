"""MinHash near-duplicates: universal hash minima, bands, signature check, full-set check, connected components.

``near_duplicates`` groups documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

1. A document's words, shingles, minima and a 128-bit key of its set are computed where its partition lies.
2. Documents with equal sets form a class by their key; one document stands for it, so copies cost one row each.
3. Bands of the signature are buckets. In each round every member of a bucket is paired with one leader of the bucket,
   never with every other member; pairs are checked by signature, then on full sets.
4. Large-star and small-star turn the links into components. Members of a bucket that are already together need no
   further check; others meet a new leader once. At the end the full sets of members of buckets that still hold several
   components are compared by prefix: with shingles in one order, rarest first, two sets that are similar enough share
   one among the first fifth of each, at places that leave room for the overlap they need. This leaves out no such pair.

With 32 bands of 4 minima a pair of similarity 0.8 shares no band with a probability of 5e-8; the signature check lets a
true pair go with one below 1e-9. Words are hashed with a secret of the run, so no text can be made to collide, and a link
is confirmed on the words of both whole texts, not on hashes. Keys with more than HOT rows, be they
leaders with their texts, buckets or centres of stars, are counted and dealt to SALTS tasks each. A batch of texts to confirm is bounded by TEXT_ROWS rows and by Spark's own bound on its bytes.

Defined results: null and empty texts have empty sets and link with nothing; rows that share a doc_id are one document;
a null doc_id links with nothing and is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from cardloom.llm.common import HOT, Scratch, meet, mix, new_key, shingle_hashes, spread, text_batches, word_hashes

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: 64-bit words of a set's parities.
MARKS = 8
#: A signature agrees in 128 * 0.8 = 102 places on average at the threshold, deviation 4.5; fewer than threshold less this share is no link.
SLACK = 0.22


def _universal(n: int):
    r = np.random.default_rng(7919)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**64, n, dtype=np.uint64)


def _signatures(k: int, key: bytes):
    def run(batches):
        import pyarrow as pa

        a, b = _universal(HASHES)
        for batch in batches:
            n_all, hi_all, lo_all, sig_all = [], [], [], []
            for words, counts in word_hashes(batch.column(1), key):
                sets = list(shingle_hashes(words, counts, k))
                n = np.array([len(s) for s in sets])
                hi, lo, sig = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), HASHES), np.uint32)
                some = np.flatnonzero(n)
                if len(some):
                    x = np.concatenate([sets[i] for i in some])
                    at = np.r_[0, np.cumsum(n[some])[:-1]]
                    hi[some] = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), at)
                    lo[some] = np.add.reduceat(mix(x ^ np.uint64(0x14057B7EF767814F)), at)
                    for i in range(HASHES):
                        sig[some, i] = np.minimum.reduceat(x * a[i] + b[i], at) >> np.uint64(32)
                n_all.append(n)
                hi_all.append(hi)
                lo_all.append(lo)
                sig_all += [s.tobytes() if c else None for s, c in zip(sig, n)]
            if n_all:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_all).astype(np.int64)), pa.array(np.concatenate(hi_all).view(np.int64)), pa.array(np.concatenate(lo_all).view(np.int64)), pa.array(sig_all, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "sig"])

    return run


def _grams(a: bytes, b: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of two texts of k words and more, numbered alike where their words are alike."""
    names: dict[bytes, int] = {}
    both = [[names.setdefault(w, len(names)) for w in t.lower().split()] for t in (a, b)]  # of bytes: A-Z alone, and blanks 0x20, 0x09-0x0D
    x, y = (np.array(c, np.int64) for c in both)
    p, q, n = x, y, len(names)
    for i in range(1, k):
        codes = np.concatenate([p[:-1] * len(names) + x[i:], q[:-1] * len(names) + y[i:]])  # below 2^63: both factors are below 2^31
        cut = len(p) - 1
        codes = np.unique(codes, return_inverse=True)[1]
        p, q = codes[:cut], codes[cut:]
    return np.unique(p), np.unique(q)


def similar(a: bytes, b: bytes, k: int, percent: int) -> bool:
    """Whether the sets of k-word shingles of two texts have the similarity; texts of fewer words are one shingle."""
    short = [len(t.split(None, k)) < k for t in (a, b)]
    if any(short):
        return all(short) and a.lower().split() == b.lower().split() != []
    p, q = _grams(a, b, k)
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def _confirm(k: int, percent: int):
    """Pairs whose whole texts are similar enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [similar(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), k, percent) for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of edges (a, b), comp the smallest node reachable, by alternating large-star and small-star."""
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    seen, n = None, now.count()
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = scratch.put(both.groupBy("u").count().where(F.col("count") > HOT), "hubs") if n > HOT else None  # fewer edges make no hub

        def centred(rows, least):
            return rows.join(least, "u") if hubs is None else spread(rows, least, "u", hubs, F.col("v"))

        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = centred(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = centred(large, least).select(F.greatest("v", "m").alias("p"), F.col("m"), F.col("u"))
        pairs = F.array(F.struct(F.col("p").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        new = small.select(F.inline(pairs)).where("u <> v").distinct()
        new = scratch.put(new, "star")
        scratch.drop(now, *([hubs] if hubs is not None else []))
        now = new
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        n = mark[0]
        if mark == seen:
            break
        seen = mark
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = scratch.put(nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "comp")
    scratch.drop(now)
    return out


def _tokens(k: int, key: bytes):
    """(node, n, token) for every shingle of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [s for words, counts in word_hashes(batch.column(1), key) for s in shingle_hashes(words, counts, k)]
            n = np.array([len(s) for s in sets], np.int64)
            all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            whole = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), n)), pa.array(np.repeat(n, n)), pa.array(all_.view(np.int64))], names=["node", "n", "token"])
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)

    return run


def prefix_pairs(docs: DataFrame, nodes: DataFrame, k: int, percent: int, scratch: Scratch, key: bytes) -> DataFrame:
    """Pairs (a < b) that can be similar, of nodes (node, comp, outside): of two components, at least one of them outside.

    Sizes n and m need an overlap of percent (n + m) / (100 + percent); so, in one order of all shingles, the first that
    both have stands at a place that leaves as many behind it in either set. Besides, shingles are dealt to MARKS * 64
    bits, each holding whether an odd number came: bits that differ tell of as many shingles at least that one set has alone.
    """
    ids = nodes.select(F.col("node").alias("doc_id"))
    tokens = scratch.put(meet(docs, ids, ["doc_id"], "left_semi").mapInArrow(_tokens(k, key), "node long, n long, token long").dropDuplicates(["node", "token"]), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("f"))
    ranked = tokens.join(common, "token").withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("f", "token")))
    first = ranked.where("f > 1").where(100 * (F.col("n") - F.col("pos") + 1) >= percent * F.col("n"))
    slot = F.pmod(F.xxhash64("token"), F.lit(64 * MARKS))
    odd = [F.bit_xor(F.when(F.floor(slot / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(MARKS)]
    marks = [f"m{i}" for i in range(MARKS)]
    marked = scratch.put(nodes.join(tokens.groupBy("node").agg(*odd), "node"), "marks")
    first = scratch.put(first.join(marked, "node").select("token", "node", "comp", "outside", "n", "pos", *marks), "prefixes")
    x, y = first.where("outside").alias("x"), first.alias("y")
    room = (100 + percent) * (1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))) >= percent * (F.col("x.n") + F.col("y.n"))
    apart = (F.col("x.comp") != F.col("y.comp")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    alone = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in marks), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & room & ((100 + percent) * (both - alone) >= 2 * percent * both))
    pairs = scratch.put(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "met")
    scratch.drop(tokens, marked, first)
    return pairs


class _Links:
    """Checks candidate pairs and keeps the links found."""

    def __init__(self, docs, classes, scratch, k, percent):
        self.docs, self.classes, self.scratch, self.k, self.percent = docs, classes, scratch, k, percent
        self.links, self.tried, self.comp = [], [], None

    def check(self, pairs: DataFrame, by_signature: bool = True) -> bool:
        """pairs: a < b, distinct. True if some are links. Pairs that the prefixes gave go to their full sets at once."""
        s = self.scratch
        for t in self.tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = s.put(pairs, "pairs")
        likely = s.put(self._likely(pairs), "likely") if by_signature else pairs
        self.tried.append(pairs)
        if not likely.count():
            return False
        nodes = s.put(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct(), "nodes")
        texts = meet(self.docs, nodes, ["doc_id"], "left_semi").select("doc_id", F.col("text").cast("binary").alias("x"))
        texts = s.put(texts, "texts")
        held = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("x").alias("y")), "b")
        held = spread(held, texts.withColumnRenamed("doc_id", "a"), "a", self._leaders(likely), F.col("b"))
        found = s.put(held.select("a", "b", "x", "y").mapInArrow(_confirm(self.k, self.percent), "a long, b long").distinct(), "links")
        s.drop(nodes, texts)
        self.links.append(found)
        return bool(found.count())

    @staticmethod
    def _leaders(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").count().where(F.col("count") > HOT)

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow a link."""
        sig = self.classes.select("node", "sig", "n_shingles")
        places = F.sequence(F.lit(0), F.lit(HASHES - 1))
        same = F.size(F.filter(places, lambda i: F.substring(F.col("sa"), i * 4 + 1, F.lit(4)) == F.substring(F.col("sb"), i * 4 + 1, F.lit(4))))
        with_sigs = pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b")
        with_sigs = spread(with_sigs, sig.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a", self._leaders(pairs), F.col("b"))
        likely = with_sigs.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")).where(same >= int(HASHES * (self.percent / 100 - SLACK)))
        return likely.select("a", "b").distinct()

    def join_up(self):
        edges = self.links[0]
        for t in self.links[1:]:
            edges = edges.union(t)
        old, self.comp = self.comp, connected_components(edges, self.scratch)
        if old is not None:
            self.scratch.drop(old)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", leader_rounds: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    with text_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent, id_col, text_col, leader_rounds, scratch or Scratch(docs.sparkSession, "neardup"))


def _near_duplicates(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, leader_rounds: int, s: Scratch) -> DataFrame:
    key = new_key()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = s.put(docs.mapInArrow(_signatures(words, key), "doc_id long, n_shingles long, hi long, lo long, sig binary"), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = s.put(classes, "classes")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS)), i))
    entries = classes.select("node", "n_shingles", F.explode(band).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low < high")
    shared = s.put(shared.select("bucket", "size", F.col("low").alias("leader")), "shared")
    crowded = s.put(shared.where(F.col("size") > HOT).select("bucket"), "crowded")
    members = s.put(spread(entries, shared, "bucket", crowded, F.col("node")), "members")
    s.drop(shared)

    links = _Links(docs, classes, s, words, percent)
    any_link = links.check(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    if any_link:
        links.join_up()

    def apart():
        """Members of buckets of three and more that lie in several components; a bucket of two has had its only pair."""
        own = members.where("size > 2").select("bucket", "node", "n_shingles")
        own = own.join(links.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if links.comp is not None else own.withColumn("comp", F.col("node"))
        per = own.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(len(links.tried)))).alias("pick"))
        top = per.groupBy("bucket").agg(F.max_by(F.struct("comp", "pick"), F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        return spread(own, top.select("bucket", F.col("top.comp").alias("main"), F.col("top.pick").alias("pick")), "bucket", crowded, F.col("node"))

    def ordered(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    for _ in range(leader_rounds - 1):
        rest = s.put(apart(), "rest")
        if not rest.count():
            break
        any_link = links.check(rest.where("comp <> main").select(*ordered("node", "pick")).where("a <> b").distinct())
        s.drop(rest)
        if not any_link:
            rest = s.put(apart(), "rest")
            break
        links.join_up()
    else:
        rest = s.put(apart(), "rest")
    if rest.count():
        nodes = s.put(rest.groupBy("node").agg(F.first("comp").alias("comp"), F.bool_or(F.col("comp") != F.col("main")).alias("outside")), "apart")
        met = prefix_pairs(docs, nodes, words, percent, s, key)
        if links.check(met, by_signature=False):
            links.join_up()
        s.drop(met, nodes)
    s.drop(rest, members, crowded, *links.tried, *links.links)

    by_key = classes.select("hi", "lo", "node")
    if links.comp is not None:
        by_key = by_key.join(links.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        by_key = by_key.withColumn("comp", F.col("node"))
    by_key = s.put(by_key.select("hi", "lo", "comp"), "by_key")
    s.drop(classes)
    out = signed.drop("sig").withColumn("linked", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), True)).join(by_key.withColumn("linked", F.lit(True)), ["hi", "lo", "linked"], "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group; repeated rows of a kept doc_id count once, of unlike texts the least. Only the
    ids that go are joined back, not the texts."""
    s, inner = Scratch(docs.sparkSession, "neardup-keep"), Scratch(docs.sparkSession, "neardup")
    found = s.put(near_duplicates(docs, words, percent, scratch=inner), "found")
    inner.remove(inner.at)
    gone = s.put(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    twice = s.put(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    s.drop(found)
    kept = meet(docs, gone, ["doc_id"], "left_anti")
    if twice.count():
        once = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        one = meet(kept, twice, ["doc_id"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        kept = meet(kept, twice, ["doc_id"], "left_anti").unionByName(one)
    return kept
