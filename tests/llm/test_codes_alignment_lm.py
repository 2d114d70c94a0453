"""Vector codes, alignment of tokenizers and LM scores against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardloom.llm import align, lm, vectorcodes
from cardloom.llm.bpecount import visible_bytes
from cardloom.llm.common import Scratch

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None):
    rows = [(i, t, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


# ---------------------------------------------------------------- vector codes


def lloyd(rows, parts=16, entries=64, rounds=2):
    """(codes, errors, codebook) by comparing everything with everything."""
    V = np.array([v for _, v, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))], np.int64)
    width = V.shape[1] // parts
    X = V.reshape(len(V), parts, width)
    book = X[:entries].transpose(1, 0, 2).copy()

    def assign():
        return ((X.transpose(1, 0, 2)[:, :, None] - book[:, None]) ** 2).sum(-1).argmin(2)

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in range(book.shape[1]):
                mine = X[own[p] == e, p]
                if len(mine):
                    book[p, e] = mine.sum(0) // len(mine)
    own = assign()
    error = sum(((X[:, p] - book[p][own[p]]) ** 2).sum(-1) for p in range(parts))
    return own.T, error, book


@pytest.mark.parametrize("seed,entries", [(0, 64), (1, 64), (2, 7), (3, 200)])
def test_codes_are_those_of_plain_lloyd(spark, seed, entries):
    r = np.random.default_rng(seed)
    X = r.normal(0, 0.02 if seed else 0.3, (400, 32)).astype(np.float32)  # small ones tie often
    X[50:180] = X[3]  # a third is one vector
    X[7] = 0
    rows = [(int(i * 3 % 400), [float(c) for c in x], None if i % 5 == 0 else i % 3) for i, x in enumerate(X)]
    rows += [(1, rows[20][1], 1), (None, rows[30][1], 2)]  # an id that comes twice, and none
    bad = [(900, None, 1), (901, [1.0] * 31 + [float("nan")], 1), (902, [float("inf")] * 32, 1), (903, [None] * 32, 1)]
    df = spark.createDataFrame([(*x, "clash") for x in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    coded = vectorcodes.code_report(df, entries=entries).collect()
    whole = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows]
    codes, errors, book = lloyd(whole, entries=entries)
    ordered = sorted(whole, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    by_label = Counter()
    for (_, _, label), e in zip(ordered, errors.tolist()):
        by_label[label] += e
    want = sorted((-1 if i is None else i, bytes(c.astype(np.uint8)).hex(), e, by_label[label]) for (i, _, label), c, e in zip(ordered, codes, errors.tolist()))
    assert sorted((-1 if x["vec_id"] is None else x["vec_id"], x["code"], x["error"], x["label_error"]) for x in coded) == want
    assert {x["codebooks_sha256"] for x in coded} == {hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()}


def test_bounds_save_comparisons_and_change_nothing():
    r = np.random.default_rng(5)
    X = r.integers(-40, 40, (3000, 4))
    X[:1500] += 300
    book = vectorcodes.Codebook(X[r.permutation(3000)[:64]][None], 8)
    own, low = vectorcodes.Part(book.e[0], book.group[0], book.drift[0]).first(X)
    made = 0
    for _ in range(4):
        sums, counts = np.zeros((1, 64, 4), np.int64), np.bincount(own, minlength=64)[None]
        np.add.at(sums[0], own, X)
        book.move(sums, counts)
        low = vectorcodes._unpacked(vectorcodes._packed(low))
        own, low, n = vectorcodes.Part(book.e[0], book.group[0], book.drift[0]).again(X, own, low)
        assert (own == ((X[:, None] - book.e[0]) ** 2).sum(2).argmin(1)).all()
        made += n
    assert made < 0.6 * 4 * 64 * len(X)


def test_vectors_of_unlike_lengths_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [1.0] * 17), (4, [1e30] * 3)], "vec_id long, embedding array<double>")
    got = vectorcodes.code_report(df, label_col=None).collect()
    assert {x["vec_id"] for x in got} == {1, 2, 3, 4} and all(x["error"] == 0 for x in got)
    assert vectorcodes.code_report(df.where("false"), label_col=None).collect() == []


# ---------------------------------------------------------------- alignment

_T, _M = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
_T.encode_special_tokens = True
_BACK = {c: b for b, c in enumerate(visible_bytes())}


def aligned(text):
    """(n_a, n_b, groups, links) token by token."""
    if not text:
        return None
    a, b = _T.encode(" " + text, add_special_tokens=False).ids, _M.encode(text)
    spelt_a = [bytes(_BACK[c] for c in _T.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(_M.id_to_piece(i)[1:-1], 16)]) if _M.is_byte(i) else _M.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([*map(len, spelt_a)]).tolist(), np.cumsum([*map(len, spelt_b)]).tolist()
    groups, links, i, j, own = [], [], 0, 0, ([a[0]], [b[0]])
    while True:
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append("|".join(",".join(map(str, g)) for g in own))
            if i == len(a):
                return len(a), len(b), groups, links
            own = [a[i]], [b[j]]
        elif x < y:
            own[0].append(a[i])
        else:
            own[1].append(b[j])


def alignment(texts):
    found = [aligned(t) for t in texts]
    count = Counter(p for f in found if f for p in set(f[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for f in found:
        links = f[3] if f else []
        digest = hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f else ""
        out.append((f[0] if f else 0, f[1] if f else 0, len(f[2]) if f else 0, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


PARTS = ["a", "The", "é", " ", "  ", "\n", "\n\n", ".", "'s", "日本", "<|endoftext|>", "<s>", "\t", " ", "x1", "☃", "\x00", "　", "ﬁ", "straße", "\r\n"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_is_that_of_single_tokens(spark, monkeypatch):
    r = random.Random(4)
    texts = [None, "", " ", "  ", "a ", " a", "a▁b", "x" * 3000, "the end", "the end", *["".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(300)]]
    texts += [" ".join(r.choice(["alpha", "Beta", "gamma-ray", "größe", "123"]) for _ in range(40)) for _ in range(40)]
    got = sorted(align.align_documents(documents(spark, texts), A, B).collect())
    assert [tuple(x[c] for c in COLUMNS) for x in got] == alignment(texts)


def test_long_texts_are_aligned_in_parts():
    r = random.Random(6)
    text = " ".join(r.choice(["alpha", "Beta", "gamma-ray", "größe", "123", "ab  cd", "e\n", "日本 語", "."]) for _ in range(4000))
    old, align.RUN = align.RUN, 500
    try:
        parts = list(align._parts(text.encode()))
    finally:
        align.RUN = old
    assert b"".join(parts) == (" " + text).encode() and len(parts) > 20
    import pyarrow as pa

    run = align.Aligner(A, B).run(pa.array(parts, pa.large_binary()))
    n_a, n_b, groups, links = aligned(text)
    assert (run.n_a.sum(), run.n_b.sum(), run.n_groups.sum()) == (n_a, n_b, len(groups))
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in run.pairs] == links


def test_alignment_of_a_table_without_rows_and_of_repeated_ids(spark):
    assert align.align_documents(documents(spark, ["x"]).where("false"), A, B).collect() == []
    got = align.align_documents(documents(spark, ["same text", "same text", None], [5, 5, None]), A, B).collect()
    assert sorted((x["doc_id"] or 0, x["n_links"], x["count_sum"]) for x in got) == [(0, 0, 0), (5, 2, 4), (5, 2, 4)]


def test_counts_meet_their_run_as_rows_that_can_go_to_disk(spark, monkeypatch):
    """Lists in an aggregate stay in memory, and so does a row group of runs that is decoded at once."""
    key, put, seen = "spark.sql.parquet.columnarReaderBatchSize", align.Scratch.put, {}

    def watched(self, df, name):
        seen[name] = df._jdf.queryExecution().executedPlan().toString(), int(spark.conf.get(key))
        return put(self, df, name)

    monkeypatch.setattr(align.Scratch, "put", watched)
    assert align.align_documents(documents(spark, ["the end", "an end", None]), A, B).count() == 3
    plan, rows = seen["aligned"]
    assert "collect_list" not in plan and rows <= align.RUN_ROWS < int(spark.conf.get(key))


# ---------------------------------------------------------------- LM scores


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_scores(texts, ids):
    count = Counter(w for i, t in zip(ids, texts) if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return n, {(i, t): (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in zip(ids, texts)}


def speech(r, n):
    """Two languages, so that a word tells which words follow."""
    own = [[f"{side}{i}" for i in range(60)] for side in ("un", "der")]
    return [" ".join(r.choice(own[i % 2]) for _ in range(r.randint(5, 60))) for i in range(n)]


def test_counts_and_base_scores(spark, monkeypatch):
    r = random.Random(3)
    texts = [None, "", "  \n", "One one ONE", "é É", "x" * 5000, "a b a\x1cb", *speech(r, 120), *[f"only{i} here" for i in range(40)]]
    ids = [None, *range(len(texts) - 1)]
    monkeypatch.setattr(lm, "FREQUENT", 20)
    n, want = base_scores(texts, ids)
    got = lm.score_texts(documents(spark, texts, ids)).collect()
    assert len(got) == len(texts) and {x["train_tokens"] for x in got} == {n}
    by_id = {x["doc_id"]: x for x in got}
    for i, t in zip(ids, texts):
        x = by_id[i]
        assert (x["n_tokens"], x["n_known"], x["held_out"]) == (*want[i, t][:2], held(i))
        assert math.isclose(x["base_score"], want[i, t][2], rel_tol=1e-9) and x["score"] < 0


def test_probabilities_are_normalised_and_context_helps(spark):
    r = random.Random(9)
    texts = speech(r, 1500)
    docs = documents(spark, texts)
    s = Scratch(spark, "lm-test")
    runs = lm.split_texts(docs, s)
    counts, table = lm.count_tokens(runs, s, targets=100)
    known = lm.known_runs(runs, counts, table, s, most=30)
    model = lm.train(known, counts, rounds=3, share=0.8)
    contexts = np.random.default_rng(0).integers(0, 1 << lm.BUCKET_BITS, (50, lm.CONTEXT))
    p = np.exp(model.log_probabilities(contexts).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    # what all others share is one too: those known by their counts, one unknown token by half
    others = counts.total - counts.count.sum() + 0.5 * (counts.distinct - len(counts.count) + 1)
    assert math.isclose(others, counts.rest)
    got = [x for x in lm.score_texts(docs, rounds=6, share=1.0).collect() if x["held_out"]]
    base, own = (sum(x[c] for x in got) for c in ("base_score", "score"))
    n = sum(x["n_tokens"] for x in got)
    assert own / n > base / n + 0.1  # log10: the language alone is worth 0.3 a word


def test_rounds_learn_from_every_training_position(spark, monkeypatch):
    r = random.Random(4)
    long = " ".join(f"w{r.randint(0, 90)}" for _ in range(400_000))  # 1.5 MB: several rows
    s = Scratch(spark, "lm-test")
    runs = lm.split_texts(documents(spark, [*speech(r, 300), long], [*range(300), next(i for i in range(300, 400) if not held(i))]), s)
    counts, table = lm.count_tokens(runs, s)
    batches = lm.known_runs(runs, counts, table, s).toArrow().to_batches(max_chunksize=1)
    monkeypatch.setattr(lm, "HELD", 1000)
    learnt = []
    monkeypatch.setattr(lm.Learner, "step", lambda self, contexts, target: learnt.append(len(target)) or setattr(self, "seen", self.seen + len(target)))
    start = SimpleNamespace(value=lm.Model(counts))
    for turn in range(lm.ROUNDS):
        list(lm._learning(start, turn, lm.SHARE)(iter(batches)))
    assert sum(learnt) == counts.total and max(learnt) <= lm.BATCH


def test_a_step_is_that_of_the_plain_formulas():
    counts, r = lm.Counts(1000, 50, [(i, 20 - i) for i in range(20)]), np.random.default_rng(7)
    model = lm.Model(counts)
    model.w["bias"] += r.normal(0, 40, 21).astype(np.float32)  # beyond what exponents hold, too
    contexts, target = r.integers(0, 30, (200, lm.CONTEXT)), r.integers(0, 21, 200)
    learner = lm.Learner(model, 3)
    noise = np.searchsorted(learner.drawn, np.random.default_rng(3).random(lm.NOISE))
    w, log_noise = {k: v.astype(float) for k, v in model.w.items()}, np.log(lm.NOISE * counts.share)
    grad = {k: np.zeros(v.shape) for k, v in w.items()}
    for c, t in zip(contexts, target):
        v = (w["context"][c] * w["places"]).sum(0)
        for k, real in [(t, 1), *((k, 0) for k in noise)]:
            y = v @ w["targets"][k] + w["bias"][k] - log_noise[k]
            g = (1 / (1 + math.exp(-min(max(y, -700), 700))) - real) / len(target)
            grad["targets"][k] += g * v
            grad["bias"][k] += g
            for i, x in enumerate(c):
                grad["context"][x] += g * w["targets"][k] * w["places"][i]
                grad["places"][i] += g * w["targets"][k] * w["context"][x]
    with np.errstate(all="raise", under="ignore", over="ignore"):
        learner.step(contexts, target)
    for k, g in grad.items():
        np.testing.assert_allclose(learner.m.w[k], w[k] - learner.rate * g / np.sqrt(1e-4 + g * g), rtol=2e-4, atol=2e-5, err_msg=k)


def test_texts_of_places_and_one_product_with_biases():
    run = lm.Run.__new__(lm.Run)
    run.first = np.array([0, 3, 4, 9])
    at = np.array([0, 2, 3, 4, 8])
    assert run.text(at).tolist() == [0, 0, 1, 2, 2] and run.text(at[:0]).tolist() == [] and run.text(at[3:]).tolist() == [2, 2]
    model, v = lm.Model(lm.Counts(1000, 50, [(i, 20 - i) for i in range(20)])), np.random.default_rng(1).normal(size=(9, lm.WIDTH)).astype(np.float32)
    np.testing.assert_allclose(lm.biased(v) @ model.tied(), v @ model.w["targets"].T + model.w["bias"], rtol=1e-5, atol=1e-5)


def test_one_probability_of_many(spark):
    counts = lm.Counts(1000, 50, [(i, 20 - i) for i in range(20)])
    model, r = lm.Model(counts), np.random.default_rng(5)
    contexts, target = r.integers(0, 1 << lm.BUCKET_BITS, (300, lm.CONTEXT)), r.integers(0, 21, 300)
    for bias in (0, 1000, -1000):  # beyond what a float's exponent holds, too
        model.w["bias"] = (np.log(counts.share) + bias).astype(np.float32)
        assert np.allclose(model.log_probability(contexts, target), model.log_probabilities(contexts)[np.arange(300), target], atol=1e-3)


def test_sums_of_powers_are_those_of_exponentials():
    r = np.random.default_rng(11)
    for scale in (0.01, 1, 8, lm.REACH / 3.5):
        y = np.clip(r.normal(0, scale, (300, 77)), -lm.REACH, lm.REACH).astype(np.float32)
        y[0], y[1], y[2] = lm.REACH, -lm.REACH, np.arange(77) * 0.5 - 19  # edges of the range, and of the rest
        want = np.exp2(y.astype(float) / math.log(2)).sum(1)
        z = (y / np.float32(math.log(2))).astype(np.float32)
        exact = np.exp2(z.astype(float)).sum(1)
        got = lm.powers_sum(z, np.empty_like(z), np.empty_like(z))
        assert np.isfinite(got).all() and np.allclose(got, exact, rtol=1e-6, atol=0) and np.allclose(got, want, rtol=2e-5, atol=0)


def test_scores_on_both_sides_of_the_reach():
    counts = lm.Counts(1000, 50, [(i, 20 - i) for i in range(20)])
    model, r = lm.Model(counts), np.random.default_rng(6)
    model.w["context"][::3] *= 150  # some contexts lie beyond, some within
    contexts, target = r.integers(0, 1 << lm.BUCKET_BITS, (1500, lm.CONTEXT)), r.integers(0, 21, 1500)
    v = model.vectors(contexts).astype(float)
    y = v @ model.w["targets"].T.astype(float) + model.w["bias"]
    far = np.sqrt((v * v).sum(1)) * np.sqrt((model.w["targets"] ** 2).sum(1).max()) + np.abs(model.w["bias"]).max() > lm.REACH
    assert 100 < far.sum() < 1400
    want = y[np.arange(1500), target] - y.max(1) - np.log(np.exp(y - y.max(1)[:, None]).sum(1))
    np.testing.assert_allclose(model.log_probability(contexts, target), want, rtol=1e-5, atol=2e-5)
    assert len(model.log_probability(contexts[:0], target[:0])) == 0


def test_gradients_of_a_row_are_summed_however_often_it_comes():
    r = np.random.default_rng(8)
    for often in ([1], [5], [1, 2, 3, 4, 5, 6, 1, 90], [1] * 50, [4] * 9):
        rows = np.repeat(r.permutation(1000)[: len(often)], often).astype(np.uint16)
        rows = rows[r.permutation(len(rows))]
        grad = r.normal(size=(len(rows), 16)).astype(np.float32)
        own, total = lm.summed(rows, grad)
        assert own.tolist() == sorted(set(rows.tolist()))
        np.testing.assert_allclose(total, [grad[rows == i].astype(float).sum(0) for i in own], rtol=1e-4, atol=1e-5)


def test_a_task_sends_its_weights_in_rows_of_many(spark):
    s = Scratch(spark, "lm-test")
    runs = lm.split_texts(documents(spark, speech(random.Random(4), 300)), s)
    counts, table = lm.count_tokens(runs, s)
    known = lm.known_runs(runs, counts, table, s)
    start = lm.Model(counts)
    rows = [b for b in lm._learning(SimpleNamespace(value=start), 0, 1.0)(iter(known.toArrow().to_batches(max_chunksize=1)))]
    size = len(start.flat())
    sent = {x["place"]: [x[f"v{i}"] for i in range(lm.WIDTH)] for b in rows for x in b.to_pylist()}
    assert sum(b.num_rows for b in rows) == len(sent) <= -(-size // lm.WIDTH) + 1 and set(sent[-1]) == {float(counts.total)}
    change = np.zeros(-(-size // lm.WIDTH) * lm.WIDTH)
    for place, values in sent.items():
        if place >= 0:
            change[place * lm.WIDTH : (place + 1) * lm.WIDTH] = values
    whole = known.coalesce(1)
    np.testing.assert_allclose(lm.train(whole, counts, 1, 1.0).flat(), start.flat() + change[:size] / counts.total, rtol=1e-5, atol=1e-6)


def test_a_long_part_without_words(spark):
    texts, ids = ["a b", "a" + " " * 2_500_000 + "b", " " * 2_500_000, "a"], [10, 12, 13, 14]
    _, want = base_scores(texts, ids)
    got = {x["doc_id"]: x for x in lm.score_texts(documents(spark, texts, ids)).collect()}
    for i, t in zip(ids, texts):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == want[i, t][:2] and math.isclose(got[i]["base_score"], want[i, t][2], rel_tol=1e-9)


def test_texts_longer_than_a_run_of_bytes(spark, monkeypatch):
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 900)}" for _ in range(400_000))  # 1.8 MB
    texts, ids = ["a b", long, "c d", "w1 w2"], [10, 11, 12, 13]
    _, want = base_scores(texts, ids)
    got = {x["doc_id"]: x for x in lm.score_texts(documents(spark, texts, ids)).collect()}
    for i, t in zip(ids, texts):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == want[i, t][:2] and math.isclose(got[i]["base_score"], want[i, t][2], rel_tol=1e-9)


def test_scores_without_training_texts_and_of_no_rows(spark):
    only = next(i for i in range(100) if held(i))
    got = lm.score_texts(documents(spark, ["a b"], [only])).collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in got] == [(3, 0, 0, 0.0, 0.0)]
    assert lm.score_texts(documents(spark, ["x"]).where("false")).collect() == []
