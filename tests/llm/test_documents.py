"""Operators on documents against brute-force versions, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cardloom.llm import bpecount, linededup, mixing, neardup, packing, tokenbin, toxicity
from cardloom.llm.common import Scratch, new_key

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randint(0, vocabulary)}" for _ in range(n))


ODD = ["", None, " ", "\n", "a\tb", "tab\t end", "x" * 5000, "é ü ß  double", "<|endoftext|> here", "don't I'll we've", "line\n\nline", "日本語 テキスト", "a\u00a0b c", "1,234.5 and more...", "trailing ", " leading", "mixed\r\nends", "½ ² ⅷ", "\x1c sep"]


# ---------------------------------------------------------------- tokens


def test_counts_and_ids_are_the_library_s(spark):
    t = Tokenizer.from_file(PATH)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "Bc", "é", " ", "\n", ".", ",", "!!", "9", "'s", "—", "\t"]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    rows = [(i, x, "s") for i, x in enumerate(texts)]
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    docs = frame(spark, rows, ["n_tokens", "start", "shard"])
    counted = {x["doc_id"]: x for x in bpecount.count_tokens(docs, PATH, public_tokenizers.PATTERN, limit=20).collect()}
    assert {i: x["n_tokens"] for i, x in counted.items()} == {i: len(v) for i, v in want.items()}
    assert all(x["n_bytes"] == len((texts[i] or "").encode()) and x["over_limit"] == (len(want[i]) > 20) for i, x in counted.items())
    back = sorted(tokenbin.token_round_trip(docs, PATH, 0).collect(), key=lambda x: x["doc_id"])
    start = 0
    for x in back:
        ids = np.array([*want[x["doc_id"]], 0], "<u4").tobytes()
        assert (x["start"], x["n_tokens"], x["ids_crc32"], bytes(x["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_reading_holds_few_bytes(spark, monkeypatch, tmp_path):
    """Documents of more ids than a task gives out at a time come one by one, in the rows of the index."""
    texts = ["word " * 3000, "a b c", "x", *["some longer text here " * 200] * 8]
    docs = frame(spark, [(i, x, "s") for i, x in enumerate(texts)])
    index = tokenbin.write_token_shards(docs, f"file://{tmp_path}/t", PATH, frame_bytes=4000)
    monkeypatch.setattr(tokenbin, "READ_BYTES", 2000)
    rows = [r.asDict() for r in index.orderBy("shard", "frame", "at").collect()]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int32() if c == "shard" else pa.int64()) for c in ("doc_id", "shard", "frame", "at", "start", "n_tokens")]))
    given = list(tokenbin._reading(f"file://{tmp_path}/t", True)([batch]))
    assert all(b.num_rows == 1 or b.column(4).nbytes <= 2100 for b in given) and len(given) > 8
    back = [x for b in given for x in b.to_pylist()]
    assert [x["doc_id"] for x in back] == [r["doc_id"] for r in rows] and all(len(x["ids"]) == 4 * x["n_tokens"] and zlib.crc32(x["ids"]) == x["ids_crc32"] for x in back)
    bare = [x for b in tokenbin._reading(f"file://{tmp_path}/t", False)([batch]) for x in b.to_pylist()]
    assert [x["ids_crc32"] for x in bare] == [x["ids_crc32"] for x in back] and "ids" not in bare[0]



def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "b b", "s"), (1, "a", "s"), (None, "n", "s"), (1, "a", "s")]
    back = tokenbin.token_round_trip(frame(spark, rows), PATH, 0).collect()
    assert sorted(x["start"] for x in back) == sorted({x["start"] for x in back}) and len(back) == 4
    assert tokenbin.token_round_trip(frame(spark, []), PATH, 0).count() == 0
    assert bpecount.count_tokens(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_readers_decompress_only_frames_asked_for(spark, tmp_path, monkeypatch):
    folder = Scratch(spark, "t").at
    docs = frame(spark, [(i, words(random.Random(i), 80), "s") for i in range(60)])
    index = tokenbin.write_token_shards(docs, folder, PATH, shards=2, frame_bytes=2000).cache()
    frames = {(x["shard"], x["frame"]) for x in index.collect()}
    assert len(frames) > 10
    some = tokenbin.read_documents(index.where("doc_id in (3, 40)"), folder).collect()
    assert {x["doc_id"] for x in some} == {3, 40}
    store, root = tokenbin.open_store(folder)
    shard = index.where("doc_id = 3").first()
    name = f"{root}/shard-{shard['shard']:06d}.bin"
    with store.open_input_file(name) as f:
        table = tokenbin.read_seek_table(f)
        first = len(tokenbin.read_frame(f, table[0]))
    assert first <= 2000 and sum(e[1] for e in table) < store.get_file_info(name).size
    at, packed, size, check = table[0]
    with store.open_input_file(name) as f, pytest.raises(ValueError):
        tokenbin.read_frame(f, (at, packed, size, check ^ 1))


def thue_morse(n):
    """Two texts of n letters that sums of bytes times powers cannot tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_words_that_polynomial_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    rows = [(0, a, "s"), (1, b, "s"), (2, f"q {a} z", "s"), (3, f"q {b} z", "s"), (4, f"{a}\n{b}", "s")]
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x, _ in rows}
    docs = frame(spark, rows)
    assert {x["doc_id"]: x["n_tokens"] for x in bpecount.count_tokens(docs, PATH, public_tokenizers.PATTERN).collect()} == {i: len(v) for i, v in want.items()}
    for x in tokenbin.token_round_trip(docs, PATH, 0).collect():
        assert bytes(x["ids"]) == np.array([*want[x["doc_id"]], 0], "<u4").tobytes()
    lengths = Counter()
    for x in packing.pack_documents(docs, PATH).collect():
        lengths[x["doc_id"]] += x["length"]
    assert lengths == {i: len(v) + 1 for i, v in want.items()}
    found = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs, 2, 80).collect()}
    assert found == {i: i for i in range(5)}


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    r = random.Random(k)
    rows = [(i, t, "s") for i, t in enumerate(["", None, "one", "ONE", "one two", " \t\n", "One  Two"])]
    for _ in range(12):  # chains of edits: members apart from the base, near to one another, and just below the threshold
        base = words(r, r.randint(30, 150)).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // r.choice([6, 12, 24])))):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(copy).upper() if r.random() < 0.3 else " ".join(copy), "s"))
            if r.random() < 0.5:
                base = copy
    rows += [(len(rows) + i, words(r, 60, 30), "s") for i in range(40)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(frame(spark, rows, ["component_id", "sig"]), k, 80).collect()}
    assert got == brute_components(rows, k, 80)


def test_prefix_filter_loses_no_pair(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    base = words(r, 60).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(60)] = f"x{r.randint(0, 40)}"
        rows.append((i, " ".join(copy), "s"))
    docs = frame(spark, rows)
    nodes = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp"), F.lit(True).alias("outside"))
    found = {(x["a"], x["b"]) for x in neardup.prefix_pairs(docs.select("doc_id", "text"), nodes, 2, 80, Scratch(spark, "t"), new_key()).collect()}
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(59)} for i, t, _ in rows}
    links = {(a, b) for a, b in itertools.combinations(range(60), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links <= found and links


def test_very_long_texts_and_words(spark):
    r = random.Random(9)
    long = words(r, 150_000, 9000)
    word = "".join(r.choice("abc") for _ in range(1_300_000))
    rows = [(0, long, "s"), (1, long + " more", "s"), (2, f"{word} b", "s"), (3, f"{word.upper()}\tB", "s"), (4, f"{word}c b", "s"), (5, word, "s"), (6, "", "s")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)


def test_crowded_keys_are_spread(spark, monkeypatch):
    from cardloom.llm import common

    for m in (common, neardup):
        monkeypatch.setattr(m, "HOT", 5)
    r = random.Random(3)
    base = words(r, 80, 3000).split()
    rows = []
    for i in range(60):
        copy = list(base)
        copy[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy), "s"))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)


def test_large_buckets_and_stars_are_spread(spark, monkeypatch):
    """A bucket of all documents and a star of all nodes: their rows are dealt to several tasks by every join that meets them."""
    from cardloom.llm import common

    calls, plain = [], common.spread

    def watched(big, few, on, hot, salt):
        out, keys = plain(big, few, on, hot, salt), [x[0] for x in hot.select(on).distinct().collect()]
        for key in keys:
            own = big.where(big[on] == key)
            calls.append((on, own.count(), own.select((salt % common.SALTS).alias("s")).distinct().count()))
        return out

    monkeypatch.setattr(neardup, "HOT", 30)
    monkeypatch.setattr(neardup, "spread", watched)
    r = random.Random(8)
    base = words(r, 200, 9000).split()
    texts = []
    for i in range(120):  # all alike, each with a word of its own
        copy = list(base)
        copy[i] = f"own{i}"
        texts.append(" ".join(copy))
    got = neardup.near_duplicates(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), words=2, percent=80).collect()
    assert {x["component_id"] for x in got} == {0} and sum(x["kept"] for x in got) == 1
    large = {(on, n > 30 and tasks > 4) for on, n, tasks in calls if n > 30}
    assert ("bucket", True) in large and ("u", True) in large and not any(not ok for _, ok in large)



def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "s"), (3, "a b c d e f g", "s"), (3, "a b c d e f g", "s"), (9, "", "s"), (8, None, "s"), (None, "a b c d e f g", "s"), (7, "h i j k l m", "s")]
    kept = neardup.drop_near_duplicates(frame(spark, rows, ["hi", "kept"]))
    assert sorted((x["doc_id"] is None, x["doc_id"]) for x in kept.collect() if x["doc_id"] is not None) == [(False, 3), (False, 7), (False, 8), (False, 9)]
    assert kept.columns[-2:] == ["hi", "kept"]
    assert neardup.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {x["node"]: x["comp"] for x in neardup.connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# ---------------------------------------------------------------- lines


def brute_lines(texts, min_docs, depth=3, min_constant=0.5, long_words=20):
    """Lines dropped, by text, from the module's contract: templates, near copies of earlier texts, long lines in unlike texts."""
    cut = lambda line: re.findall(r"[^ \t\n\x0b\f\r]+", line)
    key = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    texts = sorted({t for t in texts if t is not None}, key=key)
    rows = [(t, p, line, cut(line)) for t in texts for p, line in enumerate(t.split("\n")) if cut(line)]
    return texts, rows, cut


def brute_kept(given, min_docs, depth=3, min_constant=0.5, long_words=20):
    texts, rows, cut = brute_lines(given, min_docs)
    key = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    copies = Counter(t for t in given if t is not None)
    leaf = lambda toks: (len(toks), tuple("<*>" if re.search("[0-9]", x) else x for x in toks[:depth]))
    leaves = defaultdict(list)
    for t, p, line, toks in rows:
        leaves[leaf(toks)].append((t, p, line, toks))
    template, stands = {}, defaultdict(set)
    for where, own in leaves.items():
        if sum(copies[t] for t, *_ in own) < min_docs or len({t for t, *_ in own}) < 2:
            continue
        seen = Counter()
        for t, _, _, toks in own:
            for q, x in enumerate(toks):
                seen[q, x] += copies[t]
        for t, p, line, toks in own:
            stays = [seen[q, x] >= min_docs for q, x in enumerate(toks)]
            shape = tuple(x if s else "<*>" for x, s in zip(toks, stays)) if sum(stays) >= min_constant * len(toks) else ("line", line)
            template[t, p] = where, shape
            stands[where, shape].add(t)
    often = {x for x, own in stands.items() if len(own) >= min_docs}
    with_frequent = {t for x in often for t in stands[x]}
    said, lines, holder = defaultdict(set), defaultdict(set), {}
    for t, p, line, toks in rows:
        if t in with_frequent:
            at = max(0, len(toks) // 2 - 1)
            places = {(0, *toks[:3]), (1, *toks[-3:]), (2, *toks[at : at + 3])}
            lines[t].add((3, line))
            for f in places | {(3, line)}:
                holder[f] = min(holder.get(f, t), t, key=key)
            if template.get((t, p)) not in often:
                said[t] |= places
    copy_of = {}
    for t in with_frequent:
        own = said[t] or lines[t]
        found = Counter(holder[f] for f in own if key(holder[f]) < key(t))
        if found:
            best = max(found, key=lambda h: (found[h], -key(h)))
            if 3 * found[best] >= len(own):
                copy_of[t] = best
    group = {t: copy_of.get(copy_of.get(t, t), copy_of.get(t, t)) for t in with_frequent}
    gone = {x for x in often if len({group[t] for t in stands[x]}) >= min_docs}
    held = defaultdict(list)
    for t, p, line, toks in rows:
        if len(toks) >= long_words and t not in held[line]:
            held[line].append(t)
    runs = {t: sorted({hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:12] for i in range(len(w) - 2)})[:64] for t in texts for w in [cut(t)]}

    def apart(a, b):
        least = sorted({*a, *b})[:64]
        return len({*least} & {*a} & {*b}) < 0.5 * len(least)

    unlike = {line for line, own_ in held.items() if 2 <= len(own_) < min_docs and any(apart(runs[own_[0]], runs[t]) for t in own_[1:])}
    dropped = {(t, p) for t, p, line, _ in rows if template.get((t, p)) in gone or line in unlike}
    return {t: "\n".join(x for p, x in enumerate(t.split("\n")) if (t, p) not in dropped) for t in texts}


def test_recurring_lines_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, t, "s") for i, t in enumerate(["", None, "\n", "  \n x", "only boilerplate line here 1"])]
    for i in range(5, 60):
        own = [words(r, 8, 5000) for _ in range(3)]
        own.insert(r.randrange(3), f"only boilerplate line here {r.randint(0, 99)}")
        if i % 2:
            own.append(f"page {i} of the report by {r.choice(['ann', 'bob'])} today")
        rows.append((i, "\n".join(own), "s"))
    rows += [(100 + i, "copied first line of text\ncopied second line of text", "s") for i in range(12)] + [(5, rows[5][1], "s")]
    passage = words(r, 30, 5000)
    rows += [(200 + i, f"{words(r, 9, 5000)}\n{passage}\n{words(r, 9, 5000)}", "s") for i in range(3)]
    base = [words(r, 12, 5000) for _ in range(6)]
    for i in range(30):
        copy = [line.split() for line in base]
        for _ in range(4):
            copy[r.randrange(6)][r.randrange(12)] = f"w{r.randint(0, 5000)}"
        rows.append((300 + i, "\n".join(map(" ".join, copy)), "s"))
    got = linededup.drop_recurring_lines(frame(spark, rows, ["n_dropped", "t1", "_cut"]), min_docs=8)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "t1", "_cut", "n_lines", "n_dropped"]
    result = sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str)
    kept = brute_kept([t for _, t, _ in rows], 8)
    assert result == sorted(((i, kept.get(t)) for i, t, _ in rows), key=str)
    assert dict(result)[4] == "" and dict(result)[100].count("\n") == 1  # boilerplate goes, copies stay
    assert all(passage not in dict(result)[200 + i] for i in range(3)) and all(dict(result)[300 + i].count("\n") == 5 for i in range(30))
    assert linededup.drop_recurring_lines(frame(spark, [])).count() == 0


def test_large_sides_are_joined_by_shuffle(spark, monkeypatch):
    from cardloom.llm import common

    rows = [(i, f"boiler plate line\nown {words(random.Random(i), 5)}", "s") for i in range(30)] + [(50, "boiler plate line\nown w1 words", "s")] * 20
    want = sorted((x["doc_id"], x["text"]) for x in linededup.drop_recurring_lines(frame(spark, rows), min_docs=10).collect())
    assert all("boiler" not in t for _, t in want)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert sorted((x["doc_id"], x["text"]) for x in linededup.drop_recurring_lines(frame(spark, rows), min_docs=10).collect()) == want


def test_a_salted_table_is_never_broadcast(spark, monkeypatch):
    """Spark reckons it by its files, which hold each row once: below its threshold it would send all copies to the driver."""
    from pyspark.sql import functions as F

    from cardloom.llm import common

    s = common.Scratch(spark, "salted")
    few = s.put(spark.range(100).select("id", F.col("id").alias("t1"), F.col("id").alias("t2"), F.array("id").alias("_cut")), "few")
    big = spark.range(1000).select("id", F.col("id").alias("t1"), F.col("id").alias("t2"))
    for name in (common, linededup):
        monkeypatch.setattr(name, "BROADCAST_BYTES", -1)
    met = [common.meet(big, few.select("id"), ["id"], how, F.col("t1")) for how in ("inner", "left", "left_semi", "left_anti")]
    for df, rows in zip([*met, linededup._with_places(big, few.drop("id"), "_cut", "left")], (100, 1000, 100, 900, 1000)):
        assert df.count() == rows
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_broadcast_is_counted_with_what_its_entries_take(spark):
    """A million rows of one number, 8 MB of columns, are a relation of 67 MB on the driver and every executor."""
    from cardloom.llm import common

    assert not common.small(spark.range(1_000_000))
    assert common.small(spark.range(200_000))


def test_a_shared_block_goes_as_a_whole(spark):
    r = random.Random(21)
    block = ["licensed under some licence", "you may not use this file", "except in compliance with it", "see the licence for limits"]
    got = kept_lines(spark, ["\n".join([words(r, 9, 50000), *block, words(r, 9, 50000)]) for _ in range(100)] + ["\n".join([*block, words(r, 4, 50000)]) for _ in range(100)])
    assert all(not set(block) & set(lines) and lines for lines in got.values())


def kept_lines(spark, texts):
    got = linededup.drop_recurring_lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    return {x["doc_id"]: x["text"].split("\n") for x in got.collect()}


def test_passages_recur_whatever_stands_around_their_lines(spark):
    r = random.Random(11)
    block = ["about us and our pages", "terms of use apply here", "all rights are reserved now", "ask before you copy this"]
    header = ["home news sport weather", "log in or register today"]
    own = lambda: words(r, 8, 5000)
    texts = ["\n".join([*header, own(), *block, own(), "", "share this with friends", "", own()]) for _ in range(40)]
    mail = ["dear reader of this list", own()]
    texts += ["\n".join(["please send replies back soon", *mail]) for _ in range(200)] + ["\n".join([own(), "please send replies back soon", own()]) for _ in range(30)]
    copied = [own() for _ in range(10)]  # near copies, each with a word changed
    texts += ["\n".join([*copied[: i % 10], copied[i % 10] + f" w{i}", *copied[i % 10 + 1 :]]) for i in range(40)]
    got = kept_lines(spark, texts)
    assert all(len(got[i]) == 5 for i in range(40))
    assert all(got[i] == mail for i in range(40, 240)) and all(len(got[i]) == 2 for i in range(240, 270))
    assert all("\n".join(got[i]) == texts[i] for i in range(270, 310))


def test_boilerplate_of_pages_of_shared_parts_goes(spark):
    r = random.Random(31)
    pool = [words(r, 8, 50000) for _ in range(400)]
    said = "subscribe to our letter and never miss a thing"
    parts = [r.sample(pool, 10) for _ in range(400)]
    often = {line for line, n in Counter(x for own in parts for x in own).items() if n >= 20}
    got = kept_lines(spark, ["\n".join([*own, said]) for own in parts])
    assert all(got[i] == [x for x in own if x not in often] for i, own in enumerate(parts)) and len(often) < 8


def test_recurring_lines_of_logs_go(spark):
    r = random.Random(32)
    log = lambda: "\n".join(f"host {r.randint(0, 10**9)} served {r.randint(0, 10**9)} bytes to user {r.randint(0, 10**9)} today" for _ in range(6))
    texts = [log() for _ in range(60)]
    assert all(lines == [""] for lines in kept_lines(spark, texts).values())


def test_near_copies_are_not_emptied_whatever_changed(spark):
    """Groups of hundreds of copies: a word changed, several words changed, a line left out, a line put in."""
    r = random.Random(33)
    texts = []
    for kind in range(4):
        base = [words(r, 14, 50000).split() for _ in range(12)]
        for _ in range(150):
            copy = [list(line) for line in base]
            for _ in range((1, 6, 0, 0)[kind]):
                copy[r.randrange(12)][r.randrange(14)] = f"w{r.randint(0, 50000)}"
            if kind == 2:
                del copy[r.randrange(12)]
            if kind == 3:
                copy.insert(r.randrange(12), words(r, 14, 50000).split())
            texts.append("\n".join(map(" ".join, copy)))
    got = kept_lines(spark, texts)
    lost = [i for i, t in enumerate(texts) if "\n".join(got[i]) != t]
    assert [sum(i // 150 == k for i in lost) for k in range(3)] == [0, 0, 0]


def test_long_passages_recur_in_few_documents(spark):
    r = random.Random(12)
    own = lambda: words(r, 30, 50000)
    planted = {n: [words(r, 60, 50000), words(r, 25, 50000)] for n in (2, 5, 19)}
    texts = [(n, "\n".join([own(), own(), *planted[n], own(), own()])) for n in planted for _ in range(n)]
    copied = [own() for _ in range(10)]
    texts += [(0, "\n".join([*copied[:k], copied[k] + " x", *copied[k + 1 :]])) for k in (3, 4)]
    got = kept_lines(spark, [t for _, t in texts])
    for i, (n, t) in enumerate(texts):
        assert got[i] == [x for x in t.split("\n") if not n or x not in planted[n]]


# ---------------------------------------------------------------- mixing


def test_copies_are_the_inverted_poisson_draw(spark):
    r = random.Random(2)
    rows = [(i, words(r, r.randint(0, 40)) if i % 9 else None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(150)] + [(7, "again", "a"), (None, "no id", "b")]
    weights, rest, ratio = {"a": 0.2, "b": 0.5, "gone": 0.4}, 0.3, 2.0
    got = mixing.mix_sources(frame(spark, rows, ["copy", "grp"]), weights, rest, ratio, seed=9, partitions=3)
    size = defaultdict(int)
    for i, t, s in rows:
        size[s if s in weights else None] += len(t or "") + 1
    present = {g: weights.get(g, rest) for g in size}
    want = Counter()
    for i, t, s in rows:
        g = s if s in weights else None
        rate = ratio * sum(size.values()) * present[g] / sum(present.values()) / size[g]
        u = int(hashlib.md5(f"9:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, total = 0, math.exp(-rate)
        p = total
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        want[i, t] += n
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == +want
    assert "grp" in got.columns and got.columns[-3:] == ["n_copies", "copy", "mix_key"]
    assert mixing.mix_sources(frame(spark, []), weights, rest).count() == 0


# ---------------------------------------------------------------- packing


def naive_pack(sizes, capacities, costs):
    bins = []
    left = sorted(sizes, reverse=True)
    while left:
        x = left[0]
        open_ = [b for b in bins if b[0] - b[1] >= x]
        if open_:
            room = min(b[0] - b[1] for b in open_)
            b = [b for b in open_ if b[0] - b[1] == room][0]
        else:
            def filled(c):
                room, rest = c - x, left[1:]
                for y in rest:
                    if y <= room:
                        room -= y
                return c - room

            c = min((cost / filled(c), -c, c) for c, cost in zip(capacities, costs) if c >= x)[2]
            b = [c, 0]
            bins.append(b)
        b[1] += x
        left.pop(0)
    return sorted(next(c for c in capacities if c >= b[1]) for b in bins)


def test_packing_against_a_plain_version():
    r = random.Random(6)
    for costs in ((10.0, 20.0, 40.0), (10.0, 30.0, 90.0), (10.0, 15.0, 25.0)):
        sizes = sorted((r.randint(1, 40) for _ in range(150)), reverse=True)
        where, offset, size = packing.pack(sizes, (10, 20, 40), costs)
        assert sorted(size) == naive_pack(sizes, (10, 20, 40), costs)
        used = defaultdict(int)
        for x, b, o in zip(sizes, where, offset):
            assert o == used[b]
            used[b] += x
        assert all(used[b] <= size[b] and (size[b] == 10 or used[b] > size[b] // 2) for b in used)


def test_packing_does_not_hang_on_the_layout_of_files(spark):
    rows = [(i % 40, i * 37 % 90 + 1) for i in range(300)] + [(7, 5)] * 100
    find = lambda n: sorted(map(tuple, packing.best_fit(spark.createDataFrame(rows, "doc_id long, length long").repartition(n), (32, 64), domain_rows=90).collect()))
    assert find(1) == find(7)
    least = min(find(1), key=lambda x: x[4])[4]  # of equal lengths in a bin's domain the smaller doc_id goes first
    own = [x for x in find(1) if x[4] >> 32 == least >> 32 and x[3] == 32]
    assert [x[0] for x in sorted(own, key=lambda x: x[4])] == sorted(x[0] for x in own)


def test_packed_documents_lie_whole_in_their_bins(spark):
    rows = [(i, words(random.Random(i), i * 7), "s") for i in range(40)] + [(3, "again", "s"), (None, None, "s"), (60, words(random.Random(1), 3000), "s")]
    docs = frame(spark, rows, ["length", "n"])
    counted = Counter()
    for x in bpecount.count_tokens(docs, PATH, public_tokenizers.PATTERN).collect():
        counted[x["doc_id"]] += x["n_tokens"] + 1
    got = packing.pack_documents(docs, PATH, (64, 256, 1024), domain_rows=20).collect()
    per, bins = Counter(), defaultdict(list)
    for x in got:
        per[x["doc_id"]] += x["length"]
        bins[x["bin_id"], x["bin_length"]].append((x["bin_offset"], x["length"]))
    assert per == counted and len({b for b, _ in bins}) == len(bins)
    for (_, size), pieces in bins.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= size and size == min(c for c in (64, 256, 1024) if c >= at)
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        own = words(r, r.randint(5, 120), 3000).split()
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(3):
                own.insert(r.randrange(len(own)), r.choice(["vile", "Wretch!", f"scumm{r.choice('abcdefgh')}x"]))
        rows.append((i, " ".join(own), "s"))
        labels.append((i, toxic))
    rows += [(5000, "", "s"), (5001, None, "s"), (None, "nothing here", "s"), (5002, "ok " * 400 + "vile wretch scummax " + "ok " * 400, "s")]
    docs, given = frame(spark, rows, ["score", "held_out"]), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    got = toxicity.score(docs, model).collect()
    truth = dict(labels)
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all((zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) == x["held_out"] for x in got if x["doc_id"] is not None)
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.95
    assert next(x for x in got if x["doc_id"] == 5002)["predicted"] == 1  # in the middle of a long text


def test_long_texts_are_scored_in_whole(monkeypatch):
    r = random.Random(1)
    texts = [words(r, 60, 500) for _ in range(120)] + [words(r, 50, 500) + " vile wretch" for _ in range(60)]
    model = toxicity.train(pa.array(texts, pa.large_string()), np.r_[np.zeros(120), np.ones(60)], 0.3, rounds=2, epochs=2)
    long = pa.array([words(r, 5000, 500), words(r, 3000, 500) + " vile wretch " + words(r, 3000, 500), "", None], pa.large_string())
    whole = model.scores(long)
    monkeypatch.setattr(toxicity, "CHUNK", 2000)
    parts = model.scores(long)
    assert whole[1] > whole[0] and parts[1] > 0.5 and whole[2] == whole[3] == parts[2]


def test_the_network_sees_more_than_counts_of_words():
    """Two words offend in one order only: their odds are even, so counting them tells nothing; the network must read the order."""
    r = random.Random(3)

    def text(toxic):
        own = words(r, r.randint(8, 25), 60).split()
        pair = ["zorp", "blick"] if toxic else ["blick", "zorp"]
        at = r.randrange(len(own))
        own[at:at] = pair
        return " ".join(own)

    labels = np.array([i % 2 for i in range(1200)])
    texts = [text(y) for y in labels]
    model = toxicity.train(pa.array(texts[:900], pa.large_string()), labels[:900], 0.5, rounds=3, epochs=12)
    found = model.scores(pa.array(texts[900:], pa.large_string())) >= 0.5
    run = toxicity.Words(np.frombuffer(" ".join(texts[900:]).encode(), np.uint8), np.array([0, len(" ".join(texts[900:]).encode())]))
    odds = model.features(run, np.arange(len(run.hash)))[:, 0]
    own = np.array([len(t.split()) for t in texts[900:]])
    worst = np.maximum.reduceat(odds, np.cumsum(own) - own)
    by_odds = max(((worst >= cut) == labels[900:]).mean() for cut in np.unique(worst))
    assert (found == labels[900:]).mean() > 0.9 > by_odds + 0.2


def test_scores_of_clashing_columns(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, None, "s")], ["predicted", "score", "k_text"])
    got = toxicity.score(docs, 0.4, keep=["doc_id", "k_text", "predicted"])
    assert got.columns == ["doc_id", "k_text", "held_out", "score", "predicted"] and {x["predicted"] for x in got.collect()} == {1}


def test_toxicity_without_two_kinds_of_label(spark):
    docs = frame(spark, [(1, "a", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] for x in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), 0.0).count() == 0


def test_texts_of_the_toxicity_stage_cross_once_in_small_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    texts = [f"w{i} w{i % 7}" for i in range(1500)] + ["", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = f"{tmp_path}/seen"

    def slices(batches):
        for batch in batches:
            with open(seen, "a") as f:
                f.write(f"{batch.num_rows} {sum(pa.types.is_string(x.type) or pa.types.is_large_string(x.type) for x in batch.columns)}\n")
            yield batch

    monkeypatch.setattr(toxicity, "slices", slices)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        got = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((x["doc_id"], x["text"]) for x in got) == list(enumerate(texts))
    batches = [tuple(map(int, line.split())) for line in open(seen)]
    assert sum(n for n, _ in batches) == len(texts) and max(n for n, _ in batches) <= 512 and {k for _, k in batches} == {3}  # text, lang, source


def test_planted_cases_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    rows = [(i, "\n".join(words(r, 25, 3000) for _ in range(4)), f"src{i % 8}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "src0") for i in range(10)] + [(300, "", "src1"), (301, None, "src1")]
    labels = []
    for i in range(120):
        if i % 3 == 0:
            rows[i] = (i, rows[i][1] + "\nvile wretch scum", rows[i][2])
        labels.append((i, 1, int(i % 3 == 0)))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        new = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name != "packing":
            assert new.columns == corpus_pipeline.COLUMNS
        ids = {x["doc_id"] for x in new.select("doc_id").distinct().collect()}
        if name == "toxicity":
            clean = {i for i, *_ in rows if not (i < 120 and i % 3 == 0) and not (200 <= i < 210)}
            assert len(clean - ids) <= 3 and len([i for i in range(0, 120, 3) if i in ids]) <= 3
        if name == "near_duplicates":
            assert all(200 + i not in ids or i not in ids for i in range(10))
        docs = new
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
