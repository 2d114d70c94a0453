"""Line dedup with a log-template tree: lines whose template recurs across documents are dropped.

The tree has a fixed depth: a line goes to a leaf by its number of tokens and its leading tokens, a leading token with a
digit counting as a field. In a leaf of ``min_docs`` lines a token stays in the template if as many lines have it at its
place; the others become the field ``<*>``. A line with too few constant tokens is its own template. Nothing depends on
the order of lines.

A template is frequent if it stands in ``min_docs`` different texts, and it recurs if so many of them are no near copies of one
another. A text is a near copy of an earlier one (in the order of their hashes) if at least a third of what it says outside
frequent templates also stands, anywhere, in that one: the first, middle and last words of its lines are compared, of
which a line with a word changed keeps most. A text whose every line is of frequent templates, as a log is, is compared by
whole lines. So a passage goes as a whole, whatever stands around its lines and however much of a page it is; pages of shared
parts count each, and so do logs of other numbers; near copies, be they thousands, count once and are not emptied.

A line of ``long_words`` words or more also recurs, as it stands, in two texts and more (fewer than ``min_docs``, from which
on its template decides), if one of them is unlike the first: if less than ``COPY`` of their runs of three words are common,
as estimated from the ``SKETCH`` least hashes of both.

The lines are split once and kept as numbers (some 50 bytes a line, compressed less) in the shared folder; texts are read again
only for one example of each line of a crowded leaf, and for the result. Leaves, lines, templates and cuts are joined by broadcast only if their bytes are counted and few, else by shuffle with
salted keys, as a third of all rows may hold one leaf, line or text.

Defined results: a null text stays null with no lines; an empty one has one empty line; lines without tokens are never
dropped; a document whose every line is dropped stays with an empty text; documents with equal texts count as one and are
treated alike; other columns are kept as they are; an empty table gives none. Result columns that docs has already are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.llm.common import BROADCAST_BYTES, ENTRY, HOT, SALTS, Scratch, meet, spread

BLANK = "\t\x0b\f\r"
FIELD = "<*>"
#: Jaccard similarity of runs of RUN words from which two texts are copies.
COPY, RUN, SKETCH = 0.5, 3, 64
#: Words compared at three places of a line; the share of them in one earlier text from which a text is its copy, as 1 / SHARE.
ENDS, SHARE = 3, 3


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, BLANK + "\n", " " * (len(BLANK) + 1)), " ", -1), "")


def text_keys(text: Column) -> list[Column]:
    """Two numbers of 60 bits that stand for a text: t1, t2."""
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "t1"), (16, "t2"))]


def _lines(docs: DataFrame, text_col: str, depth: int, long_words: int) -> DataFrame:
    """(t1, t2, pos, leaf, lh, long, first, mid, last) for each line; leaf: null without tokens; first, mid, last: hashes of words there."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*text_keys(text), F.split(text, "\n", -1).alias("arr"))  # once a text, not once a line
    rows = rows.select("t1", "t2", F.posexplode("arr").alias("pos", "line")).withColumn("w", tokens(F.col("line")))
    lead = F.transform(F.slice("w", 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    last = F.when(F.size("w") <= ENDS, F.col("w")).otherwise(F.slice("w", -ENDS, ENDS))
    middle = F.slice("w", F.greatest(F.lit(1), F.floor(F.size("w") / 2).cast("int")), F.lit(ENDS))
    # null for lines without tokens; a filter here would be pushed below and split every line twice
    leaf = F.when(F.size("w") > 0, F.xxhash64(F.size("w"), lead))
    return rows.select("t1", "t2", "pos", leaf.alias("leaf"), F.xxhash64("line").alias("lh"), (F.size("w") >= long_words).alias("long"), F.xxhash64(F.lit(0), F.slice("w", 1, ENDS)).alias("first"), F.xxhash64(F.lit(2), middle).alias("mid"), F.xxhash64(F.lit(1), last).alias("last"))


def _with_places(rows: DataFrame, places: DataFrame, column: str, how: str, width: int = 4) -> DataFrame:
    """rows with the array, of entries of so many bytes, that places hold for their text."""
    size = places.agg(F.sum(width * F.size(column) + 2 * ENTRY + 32)).first()[0] or 0  # the key lies in an entry twice
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(places), ["t1", "t2"], how)
    salted = places.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["t1", "t2", "_salt"], how)


def _templates(docs: DataFrame, text_col: str, held: DataFrame, s: Scratch, min_docs: int, min_constant: float) -> DataFrame:
    """(lh, template) for the lines of leaves with min_docs lines."""
    distinct = held.groupBy("leaf", "lh").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "pos")).alias("at"))
    example = F.struct(F.col("at.pos").alias("pos"), "leaf", "lh", "n")
    places = s.put(distinct.groupBy("at.t1", "at.t2").agg(F.collect_list(example).alias("_e")), "examples")
    text = F.col(f"`{text_col}`").cast("string")
    found = _with_places(docs.select(*text_keys(text), text.alias("_text")), places, "_e", "inner", 48)
    found = found.select("_e", F.split("_text", "\n", -1).alias("arr")).select(F.explode(F.transform("_e", lambda e: F.struct(e["leaf"].alias("leaf"), e["lh"].alias("lh"), e["n"].alias("n"), F.get("arr", e["pos"]).alias("line")))).alias("e"))
    distinct = found.select("e.*").groupBy("leaf", "lh").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    words = s.put(distinct.select("leaf", "lh", "n", F.posexplode(tokens(F.col("line"))).alias("p", "token")), "words")
    common = words.groupBy("leaf", "p", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf", "p", "token", F.lit(True).alias("stays"))
    common = s.put(common, "common")
    marked = meet(words, common, ["leaf", "p", "token"], "left", F.col("lh"))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("p", F.when(F.col("stays"), F.col("token")).otherwise(F.lit(FIELD)).alias("t")))), lambda x: x["t"])
    shapes = marked.groupBy("leaf", "lh").agg(F.xxhash64(F.array_join(shape, " ")).alias("shape"), (F.count("stays") / F.count("*")).alias("share"))
    found = s.put(shapes.select("lh", F.xxhash64("leaf", F.when(F.col("share") >= min_constant, F.col("shape")).otherwise(F.col("lh"))).alias("template")), "templates")
    s.drop(places, words, common)
    return found


def _copies(lines: DataFrame, often: DataFrame, frequent: DataFrame, s: Scratch) -> DataFrame:
    """(t1, class) for the texts with frequent lines that are near copies of an earlier one of them."""
    texts = s.put(often.select("t1").distinct(), "texts")
    own = s.put(meet(lines, texts, ["t1"], "left_semi", F.col("pos")).select("t1", "pos", "lh", "first", "mid", "last"), "own")
    whole = F.xxhash64(F.lit(3), "lh").alias("f")
    rest = meet(own, frequent.select("lh").distinct(), ["lh"], "left_anti", F.col("t1"))
    rest = s.put(rest.select("t1", F.explode(F.array("first", "mid", "last")).alias("f")).distinct(), "rest")
    bare = s.put(texts.join(rest.select("t1").distinct(), "t1", "left_anti"), "bare")
    asked = s.put(rest.union(meet(own, bare, ["t1"], "left_semi", F.col("pos")).select("t1", whole).distinct()), "asked")
    holders = own.select("t1", F.explode(F.array("first", "mid", "last", whole)).alias("f")).groupBy("f").agg(F.min("t1").alias("holder"), F.max("t1").alias("other")).where("holder <> other").select("f", "holder")
    hot = s.put(asked.groupBy("f").count().where(F.col("count") > HOT), "hot")
    met = spread(asked, s.put(holders, "holders"), "f", hot, F.col("t1")).where("holder < t1")
    most = met.groupBy("t1", "holder").agg(F.count("*").alias("n")).groupBy("t1").agg(F.max(F.struct("n", (-F.col("holder")).alias("h"))).alias("m"))
    all_ = asked.groupBy("t1").agg(F.count("*").alias("n"))
    copies = s.put(all_.join(most, "t1").where(SHARE * F.col("m.n") >= F.col("n")).select("t1", (-F.col("m.h")).alias("class")), "copies")
    first = copies.select(F.col("t1").alias("class"), F.col("class").alias("_of"))  # what a copy is a copy of may be one too
    found = s.put(meet(copies, first, ["class"], "left", F.col("t1")).select("t1", F.coalesce("_of", "class").alias("class")), "classes")
    s.drop(texts, own, rest, bare, asked, hot, copies)
    s.drop_named("holders")
    return found


def _unlike(docs: DataFrame, text_col: str, holds: DataFrame, s: Scratch, min_docs: int) -> DataFrame:
    """(lh) of long lines whose few texts are not all copies of the first. holds: (lh, t1, t2), distinct."""
    per = holds.groupBy("lh").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2")).alias("f")).where((F.col("n") > 1) & (F.col("n") < min_docs)).select("lh", F.col("f.t1").alias("f1"), F.col("f.t2").alias("f2"))
    pairs = s.put(holds.join(per, "lh").where("t1 <> f1 OR t2 <> f2"), "pairs")
    nodes = s.put(pairs.select("t1", "t2").union(pairs.select("f1", "f2")).distinct(), "nodes")
    text = F.col(f"`{text_col}`").cast("string")
    words = meet(docs.select(*text_keys(text), text.alias("x")), nodes, ["t1", "t2"], "left_semi").select("t1", "t2", tokens(F.col("x")).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - RUN), lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get("w", i + j) for j in range(RUN)]).cast("binary")), 1, 12))
    least = words.withColumn("r", F.slice(F.array_sort(F.array_distinct(runs)), 1, SKETCH))
    sketch = least.groupBy("t1", "t2").agg(F.first(F.transform("r", lambda h: F.conv(h, 16, 10).cast("long"))).alias("x"))
    sketch = s.put(sketch, "sketches")
    both = pairs.select("f1", "f2", "t1", "t2").distinct().join(sketch, ["t1", "t2"]).join(sketch.select(F.col("t1").alias("f1"), F.col("t2").alias("f2"), F.col("x").alias("y")), ["f1", "f2"])
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH))
    unlike = both.where(F.size(F.array_intersect(F.array_intersect("u", "x"), F.col("y"))) < COPY * F.size("u")).select("f1", "f2", "t1", "t2")
    found = s.put(pairs.join(unlike, ["f1", "f2", "t1", "t2"]).select("lh").distinct(), "unlike")
    s.drop(pairs, nodes, sketch)
    return found


def drop_recurring_lines(docs: DataFrame, min_docs: int = 20, depth: int = 3, min_constant: float = 0.5, text_col: str = "text", long_words: int = 20) -> DataFrame:
    """docs with the text less its recurring lines, and n_lines and n_dropped."""
    s = Scratch(docs.sparkSession, "lines")
    lines = s.put(_lines(docs, text_col, depth, long_words), "lines").where("leaf IS NOT NULL")
    differ = F.min("t1") != F.max("t1")
    leaves = s.put(lines.groupBy("leaf").agg(F.count("*").alias("n"), differ.alias("differ")).where(F.col("differ") & (F.col("n") >= min_docs)).select("leaf"), "leaves")
    at = F.col("t1") + F.col("pos")
    held = s.put(meet(lines.select("t1", "t2", "pos", "leaf", "lh"), leaves, ["leaf"], "left_semi", at), "held")
    templates = _templates(docs, text_col, held, s, min_docs, min_constant)
    stands = s.put(meet(held.drop("leaf"), templates, ["lh"], "inner", at), "stands")
    many = stands.select("template", "t1").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    frequent = s.put(meet(templates, s.put(many, "many"), ["template"], "left_semi", F.col("lh")), "frequent")  # (lh, template)
    often = s.put(meet(stands.drop("template"), frequent, ["lh"], "inner", at), "often")
    copies = _copies(lines, often, frequent, s)
    support = meet(often.select("template", "t1").distinct(), copies, ["t1"], "left", F.col("template")).select("template", F.coalesce("class", "t1").alias("class")).distinct()
    support = support.groupBy("template").agg(F.count("*").alias("n"))
    recurring = s.put(support.where(F.col("n") >= min_docs).select("template"), "recurring")

    long = lines.where("long").select("t1", "t2", "pos", "lh")
    twice = s.put(long.groupBy("lh").agg(differ.alias("differ")).where("differ").select("lh"), "twice")
    long = s.put(meet(long, twice, ["lh"], "left_semi", at), "long")
    unlike = _unlike(docs, text_col, long.select("lh", "t1", "t2").distinct(), s, min_docs)
    gone = meet(often, recurring, ["template"], "left_semi", at).select("t1", "t2", "pos")
    gone = gone.union(meet(long, unlike, ["lh"], "left_semi", at).select("t1", "t2", "pos"))
    cut = s.put(gone.groupBy("t1", "t2").agg(F.collect_set("pos").alias("_cut")), "cut")
    for name in ("lines", "held", "stands", "often", "long"):
        s.drop_named(name)

    text = F.col(f"`{text_col}`").cast("string")
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in rest], text.alias("_text"), *text_keys(text))
    rows = _with_places(rows, cut, "_cut", "left")
    rows = rows.withColumn("arr", F.split("_text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("arr") - 1), F.col("_cut"))
    new = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("arr", i)), "\n"))
    out = {c: F.col(f"`c_{c}`").alias(c) for c in rest} | {text_col: new.alias(text_col)}
    n_lines = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("arr"))
    return rows.select(*[out[c] for c in docs.columns if c in out], n_lines.alias("n_lines"), F.coalesce(F.size("_cut"), F.lit(0)).alias("n_dropped"))
