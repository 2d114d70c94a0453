"""LM scoring: a log-bilinear model trained by noise-contrastive estimation in numpy.

Tokens are words and one end a text. Counts of tokens come from all training texts. The model predicts a token from the
``CONTEXT`` tokens before it: their embeddings, each weighted by its place, add up to a vector whose product with a token's
embedding, plus its bias, is the token's score. It tells apart the ``TARGETS`` most frequent tokens and all others together;
these share their part by their smoothed counts, an unknown token counting half. Context words have embeddings by a hash, so
rare and unknown ones count too. Probabilities are normalised over all tokens by one matrix product for a block of contexts,
whose powers are taken by a polynomial to a float's precision, or by exponentials where scores may lie beyond ``REACH``.

Training never normalises: scores learn to tell tokens of the texts from ones drawn by frequency (noise-contrastive
estimation), starting from the frequencies. The positions of every training text are dealt to the rounds, so that together
they learn from all of them, each once. A task learns from those of its texts, by gradients of its own from the weights that
the round starts with; Spark averages the weights of all tasks by the positions they saw. The weights have a fixed size, what
they learn from grows with the corpus.

Texts are split once. A run of about ``RUN`` bytes becomes a row: its distinct tokens and the order in which they stand. Counts
are summed over runs and come back to each run: those of the ``FREQUENT`` most frequent tokens are sent to every task, those
of the others, which stand in few runs each, are joined by token. A text of more than a megabyte spans several rows, each with
the words before it, and is put together at the end.

Tokens are told apart by a 64-bit hash with a secret of the run, so no text can be written whose tokens collide.

Defined results: null and empty texts are one end; a null doc_id is not held out; rows are scored each, whatever their ids;
extra columns stay out; without training texts every token has probability 1; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from cardloom.llm.common import _LOWER, _runs, Scratch, new_key, slices, span_hashes, text_batches, word_spans

CONTEXT, TARGETS, WIDTH, BUCKET_BITS = 4, 512, 16, 14
#: Draws that a batch of positions shares, positions of a batch, rounds, share of positions dealt to each: all together.
NOISE, BATCH, ROUNDS = 64, 2048, 2
SHARE = 1 / ROUNDS
#: Positions whose contexts are held together for learning, and those scored together: their scores fit the cache.
HELD, BLOCK = 1 << 16, 512
#: Rows of runs in an Arrow batch.
RUN_ROWS = 4
#: Bytes of texts in a run.
RUN = 8 << 20
#: Tokens whose counts every task gets, at most: 8 MB.
FREQUENT = 1 << 19
#: Gives the places of embeddings; the hash that tells tokens apart has a secret key.
OPEN_KEY = bytes(range(16))
END, END_BUCKET = np.uint64(0x656E64), 0
#: Scores of targets that may lie beyond are normalised by exponentials, those within by powers_sum.
REACH = 60
#: Added to a float, leaves it as a whole number in its last bits.
ROUNDING = np.float32(1.5 * 2**23)
#: 2**(f / 2) for -0.5 <= f <= 0.5 is sqrt(LEAD) * (f**4 + ROOT[3] * f**3 + ... + ROOT[0]), to 1e-7 of it.
_FIT = np.polynomial.Polynomial.cast(np.polynomial.Chebyshev.interpolate(lambda f: np.exp2(f / 2), 4, (-0.5, 0.5))).coef
ROOT, LEAD = (_FIT[:4] / _FIT[4]).astype(np.float32), np.float32(_FIT[4] ** 2)

_LONGS, _INTS, _BOOLS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.BooleanType())
#: Texts i of a run stand at order[first[i] : first[i + 1]], in places of its distinct tokens, the most frequent first; skip: words before the first text's part.
_OWN = [T.StructField("run", T.LongType()), T.StructField("rows", _LONGS), T.StructField("doc_ids", _LONGS), T.StructField("held", _BOOLS), T.StructField("skip", T.IntegerType()), T.StructField("first", _INTS), T.StructField("order", T.BinaryType()), T.StructField("bucket", _INTS)]
RUNS = T.StructType([*_OWN, T.StructField("token", _LONGS), T.StructField("learnt", _INTS), T.StructField("times", _INTS)])


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _packed(order: np.ndarray) -> bytes:
    """Places in planes of bytes, compressed; most planes hold little."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(order.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=4 * n), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def one_row(x: np.ndarray, kind):
    """One list of all of x, as an Arrow array."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


def _splitting(secret: bytes):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, k, row = TaskContext.get().partitionId() << 32, 0, 0

        def table(at, counts, tokens, buckets, ids, held, skip):
            """A row for the texts from at on."""
            nonlocal k
            by = np.argsort(tokens)
            token = tokens.take(by)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(by)])
            token, one, times = token.take(first), by.take(first), np.diff(first, append=len(by))
            order = np.argsort(-times, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            place = np.empty_like(by)
            place[by] = np.repeat(rank, times)
            learns = np.repeat(~np.asarray(held), counts)
            learns[:skip] = False
            learnt = np.bincount(place[learns], minlength=len(order))
            times = np.bincount(place[skip:], minlength=len(order))
            n = len(counts)
            out = [pa.array([base + k], pa.int64()), one_row(base + at + np.arange(n), pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held), pa.array([skip], pa.int32())]
            out += [one_row(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array([_packed(place)], pa.binary()), one_row(buckets.take(one)[order], pa.int32()), one_row(token[order].view(np.int64), pa.int64()), one_row(learnt, pa.int32()), one_row(times, pa.int32())]
            k += 1
            return pa.RecordBatch.from_arrays(out, names=[f.name for f in RUNS.fields])

        size, waiting = 0, []

        def flush():
            nonlocal size, waiting, row
            parts, size, waiting = waiting, 0, []
            counts, tokens, buckets = (np.concatenate([p[i] for p in parts]) for i in range(3))
            out = table(row, counts, tokens, buckets, *(pa.concat_arrays([p[i] for p in parts]) for i in (3, 4)), 0)
            row += len(counts)
            return out

        for batch in slices(batches):
            at, before = 0, None
            for data, edges, goes_on in _runs(batch.column(2)):
                data, n = _LOWER[data], len(edges) - 1
                start, end = word_spans(data, edges[:-1])
                tokens, buckets = span_hashes(data, start, end, secret), (span_hashes(data, start, end, OPEN_KEY) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                counts = np.diff(np.searchsorted(start, edges))
                if before:
                    tokens, buckets, counts = np.concatenate([before[0], tokens]), np.concatenate([before[1], buckets]), counts + len(before[0])
                if not goes_on:  # an end behind each text
                    tokens, buckets, counts = np.insert(tokens, np.cumsum(counts), END), np.insert(buckets, np.cumsum(counts), END_BUCKET), counts + 1
                ids, held = batch.column(0).slice(at, n), batch.column(1).slice(at, n)
                at += 0 if goes_on else n
                if before or goes_on:  # part of a text that is longer than a run of bytes
                    if waiting:
                        yield flush()
                    yield table(row, counts, tokens, buckets, ids, held, len(before[0]) if before else 0)
                    before, row = ((tokens[-CONTEXT:], buckets[-CONTEXT:]), row) if goes_on else (None, row + 1)
                    continue
                waiting.append((counts, tokens, buckets, ids, held))
                size += len(data)
                if size >= RUN:
                    yield flush()
        if waiting:
            yield flush()

    return run


class Counts:
    """What the corpus says: tokens in all, distinct tokens, the targets and their counts, counts of all others together."""

    def __init__(self, total: int, distinct: int, targets: list):
        self.total, self.distinct = total, distinct
        self.token, self.count = (np.array(c, np.int64) for c in zip(*targets)) if targets else (np.zeros(0, np.int64),) * 2
        self.rest = total - int(self.count.sum()) + 0.5 * (distinct - len(self.count) + 1)
        self.all = total + 0.5 * (distinct + 1)
        self.share = np.r_[self.count + 0.5, self.rest] / self.all
        self.sorted = np.argsort(self.token)

    def target(self, token: np.ndarray) -> np.ndarray:
        """Place among the targets, or that of all others."""
        at, hit = found(self.token[self.sorted], token)
        return np.where(hit, self.sorted[at] if len(self.sorted) else 0, len(self.count))


def found(known: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of tokens in a sorted array."""
    at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
    return at, known[at] == token if len(known) else np.zeros(len(token), bool)


class Model:
    """Weights: context embeddings (one place more for what stands before a text), weights of places, target embeddings, biases."""

    def __init__(self, counts: Counts, weights: dict | None = None):
        self.counts = counts
        n, r = len(counts.share), np.random.default_rng(17)
        self.w = weights or {
            "context": r.normal(0, 0.1, ((1 << BUCKET_BITS) + 1, WIDTH)).astype(np.float32), "places": np.full((CONTEXT, WIDTH), 1.0, np.float32),
            "targets": r.normal(0, 0.1, (n, WIDTH)).astype(np.float32), "bias": np.log(counts.share).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def with_flat(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in sorted(self.w):
            n = self.w[k].size
            out[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        return Model(self.counts, out)

    def vectors(self, contexts: np.ndarray) -> np.ndarray:
        """What is predicted from contexts (n, CONTEXT) of embedding places."""
        return np.einsum("niw,iw->nw", self.w["context"].take(contexts, axis=0), self.w["places"][: contexts.shape[1]])

    def tied(self) -> np.ndarray:
        """(WIDTH + 1, targets + 1): target embeddings above their biases."""
        return np.concatenate([self.w["targets"].T, self.w["bias"][None]])

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """(n, targets + 1): natural logarithms, normalised."""
        y = self.vectors(contexts) @ self.w["targets"].T + self.w["bias"]
        top = y.max(1)
        return y - (top + np.log(np.exp(y - top[:, None]).sum(1)))[:, None]

    def log_probability(self, contexts: np.ndarray, target: np.ndarray) -> np.ndarray:
        """(n): that of one target each."""
        placed, tie = [self.w["context"] * p for p in self.w["places"]], self.tied() * np.float32(1 / np.log(2))
        long, high = np.sqrt((self.w["targets"] ** 2).sum(1).max()), np.abs(self.w["bias"]).max()
        out, room = np.empty(len(contexts), np.float32), np.empty((3, BLOCK, tie.shape[1]), np.float32)
        for i in range(0, len(out), BLOCK):
            part, own = contexts[i : i + BLOCK], target[i : i + BLOCK]
            v = placed[0].take(part[:, 0], axis=0)
            for j in range(1, part.shape[1]):
                v += placed[j].take(part[:, j], axis=0)
            y, *spare = room[:, : len(v)]
            np.matmul(biased(v), tie, out=y)
            own_y = y[np.arange(len(v)), own]
            with np.errstate(all="ignore"):
                out[i : i + BLOCK] = (own_y - np.log2(powers_sum(y, *spare))) * np.float32(np.log(2))
            odd = np.flatnonzero(~(np.sqrt(np.vecdot(v, v)) * long + high < REACH))  # perhaps beyond what exponents hold
            if len(odd):
                out[i + odd] = self.log_probabilities(part[odd])[np.arange(len(odd)), own[odd]]
        return out


def powers_sum(y: np.ndarray, whole: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Sums of the rows of 2**y, for |y| <= REACH / log(2), to a float's precision; all three arrays are overwritten.

    y is a whole number and a rest f. The square root of 2**f is a polynomial; the whole number goes into the exponent of one of
    two factors of its square. These are a few additions and products of arrays, which take less than exponentials do."""
    np.add(y, ROUNDING, out=whole)  # its last bits are the whole number
    y -= np.subtract(whole, ROUNDING, out=root)
    exponent = whole.view(np.int32)
    exponent <<= 23
    np.add(y, ROOT[-1], out=root)
    for c in ROOT[-2::-1]:
        root *= y
        root += c
    exponent += root.view(np.int32)
    return np.vecdot(whole, root) * LEAD


def biased(v: np.ndarray) -> np.ndarray:
    """v with a column of ones, so that one product adds the bias too."""
    out = np.ones((len(v), v.shape[1] + 1), v.dtype)
    out[:, :-1] = v
    return out


def whole_rows(x: np.ndarray) -> np.ndarray:
    """The rows of x as one element each, which are put in place faster."""
    return x.view(f"V{x.shape[1] * x.itemsize}").ravel()


def summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order and the sum of each one's gradients. Most rows come once or a few times: these are added place
    by place, as a sum costs reduceat a call for each component."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    new = np.empty(len(rows), bool)
    new[:1] = True
    np.not_equal(rows[1:], rows[:-1], out=new[1:])
    first = np.flatnonzero(new)
    times = np.diff(first, append=len(rows))
    out, more = grad.take(order[first], axis=0), np.flatnonzero(times > 1)
    for i in (1, 2, 3):
        out[more] += grad.take(order[first[more] + i], axis=0)
        more = more[times[more] > i + 1]
    if len(more):
        left = times[more] - 4
        start = np.cumsum(left) - left
        out[more] += np.add.reduceat(grad.take(order[np.repeat(first[more] + 4 - start, left) + np.arange(left.sum())], axis=0), start, axis=0)
    return rows[first].astype(np.int64), out


class Learner:
    """Steps of noise-contrastive estimation with gradients scaled by their history."""

    def __init__(self, model: Model, seed: int, rate: float = 0.15):
        self.m, self.rate, self.r = Model(model.counts, {k: v.copy() for k, v in model.w.items()}), rate, np.random.default_rng(seed)
        self.past = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.m.w.items()}
        self.drawn = np.cumsum(model.counts.share)
        self.log_noise = np.log(NOISE * model.counts.share).astype(np.float32)
        self.seen = 0

    def _move(self, name: str, at, grad: np.ndarray) -> None:
        past = grad * grad
        past += self.past[name][at]
        self.past[name][at] = past
        self.m.w[name][at] -= self.rate * grad / np.sqrt(past)

    def _move_rows(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        rows = rows.astype(np.uint16 if len(self.past[name]) <= 1 << 16 else np.uint32)  # 16 bits are sorted by radix
        rows, grad = summed(rows, grad)
        past, w = self.past[name], self.m.w[name]
        total = grad * grad
        total += past.take(rows, axis=0)
        whole_rows(past)[rows] = whole_rows(total)
        np.divide(grad, np.sqrt(total, out=total), out=total)
        total *= -self.rate
        total += w.take(rows, axis=0)
        whole_rows(w)[rows] = whole_rows(total)

    def step(self, contexts: np.ndarray, target: np.ndarray) -> None:
        w, n = self.m.w, len(target)
        noise = np.minimum(np.searchsorted(self.drawn, self.r.random(NOISE)), len(self.drawn) - 1)
        parts = w["context"].take(contexts, axis=0)
        v = np.einsum("niw,iw->nw", parts, w["places"])
        near, tie = w["targets"].take(target, axis=0), np.concatenate([-w["targets"][noise].T, (self.log_noise - w["bias"])[noise][None]])
        with np.errstate(over="ignore"):
            g_own = (1 / (1 + np.exp(self.log_noise[target] - w["bias"][target] - (v * near).sum(1))) - 1) / n
            g_other = np.exp(other := biased(v) @ tie, out=other)
        g_other += 1
        np.reciprocal(g_other, out=g_other)
        dv = g_own[:, None] * near + g_other @ (w["targets"][noise] / n)
        rows, grad = np.r_[target, noise], np.concatenate([g_own[:, None] * v, g_other.T @ (v / n)])
        bias = np.bincount(rows, weights=np.r_[g_own, np.ones(n, np.float32) @ g_other / n], minlength=len(self.drawn)).astype(np.float32)
        places = np.einsum("nw,niw->iw", dv, parts)
        self._move_rows("context", contexts.ravel(), (np.tile(dv, CONTEXT) * w["places"].ravel()).reshape(-1, WIDTH))
        self._move_rows("targets", rows, grad)
        self._move("places", slice(None), places)
        self._move("bias", slice(None), bias)
        self.seen += n


class Run:
    """One row of known runs, as arrays."""

    def __init__(self, batch, columns: dict[str, int]):
        get = lambda c: np.asarray(batch.column(columns[c]).flatten())
        self.held, self.first, self.count = get("held"), get("first").astype(np.int64), get("counts")
        self.order = _unpacked(batch.column(columns["order"])[0].as_py(), int(self.first[-1]))
        self.target, self.bucket = get("target"), get("bucket")
        self.skip, self.run = batch.column(columns["skip"])[0].as_py(), batch.column(columns["run"])[0].as_py()

    def text(self, at: np.ndarray) -> np.ndarray:
        """Number of the text at each of the places, which ascend."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(np.searchsorted(at, self.first)))

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Embedding places of the words before those at the places."""
        start = self.first[self.text(at)]
        back = at[:, None] - np.arange(1, CONTEXT + 1)
        inside = back >= start[:, None]
        return np.where(inside, self.bucket.take(self.order.take(np.maximum(back, 0))), 1 << BUCKET_BITS)

    def places(self) -> np.ndarray:
        """All but the words that an earlier row has."""
        return np.arange(self.skip, len(self.order))


def _rare(sent):
    """(run, pos, token) of the distinct tokens of runs that are not frequent."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            token = np.asarray(batch.column(1).flatten())
            at = np.flatnonzero(~found(sent.value[0], token)[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column(0)[0].as_py()), pa.int64()), pa.array(at, pa.int32()), pa.array(token[at], pa.int64())], names=["run", "pos", "token"])

    return run


def _known(counts: Counts, sent):
    """Runs with the count and the target of each distinct token in place of its hash."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            token, rare, their = (np.asarray(batch.column(i).flatten()) for i in (8, 9, 10))
            at, hit = found(sent.value[0], token)
            count = np.where(hit, sent.value[1][at] if len(sent.value[0]) else 0, 0)
            count[rare] = their
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], one_row(count, pa.int64()), one_row(counts.target(token), pa.int32())], names=[f.name for f in KNOWN.fields])

    return run


KNOWN = T.StructType([*_OWN, T.StructField("counts", _LONGS), T.StructField("target", _INTS)])
_AT = {f.name: i for i, f in enumerate(KNOWN.fields)}
_SUMS = [f"v{i}" for i in range(WIDTH)]


def _learning(model, turn: int, share: float):
    """Weights of a task times the positions it learnt from, WIDTH of them a row; at place -1 the positions."""

    def run(batches):
        import pyarrow as pa

        learner, contexts, targets, n = None, [], [], 0
        start = model.value
        for batch in slices(batches, 1):
            own = Run(batch, _AT)
            r = np.random.default_rng((own.run, turn))
            if learner is None:
                learner = Learner(start, own.run & 0x7FFFFFFF)
            at = own.places()
            dealt = np.random.default_rng(own.run).random(len(at))  # the same in every round
            at = at[(dealt - turn * share) % 1.0 < share]
            at = at[~own.held[own.text(at)]]
            parts = -(-len(at) // HELD)
            for i in range(parts):
                part = at[i::parts]
                contexts.append(own.contexts(part))
                targets.append(own.target[own.order[part]])
                n += len(part)
                if n >= BATCH * 4:
                    _steps(learner, contexts, targets, r, n - n % BATCH)
                    n %= BATCH
        if learner is None:
            return
        if n:
            _steps(learner, contexts, targets, np.random.default_rng(turn), n)
        if learner.seen:
            change = (learner.m.flat().astype(np.float64) - start.flat()) * learner.seen
            change = np.r_[np.full(WIDTH, float(learner.seen)), change, np.zeros(-len(change) % WIDTH)].reshape(-1, WIDTH)
            at = np.flatnonzero(change.any(1))
            for i in range(0, len(at), 1 << 12):
                part = at[i : i + (1 << 12)]
                yield pa.RecordBatch.from_arrays([pa.array((part - 1).astype(np.int32)), *(pa.array(x) for x in change[part].T.copy())], names=["place", *_SUMS])

    return run


def _steps(learner: Learner, contexts: list, targets: list, r, n: int) -> None:
    """Learns from n of the positions held, in an order of its own, and leaves the rest."""
    c, t = np.concatenate(contexts), np.concatenate(targets)
    order = r.permutation(len(t))
    for i in range(0, n, BATCH):
        b = order[i : min(i + BATCH, n)]
        learner.step(c.take(b, axis=0), t[b])
    contexts[:], targets[:] = [c[order[n:]]], [t[order[n:]]]


def train(known: DataFrame, counts: Counts, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """The model after rounds over all training texts, each from the next share of their positions; round the clock, if they are more."""
    model, sc = Model(counts), known.sparkSession.sparkContext
    for turn in range(rounds):
        sent = sc.broadcast(model)
        changes = known.mapInArrow(_learning(sent, turn, share), "place int, " + ", ".join(f"{c} double" for c in _SUMS))
        sums = changes.groupBy("place").agg(*[F.sum(c).alias(c) for c in _SUMS]).toArrow()  # as many values as weights, at most
        place, *values = (np.asarray(sums.column(c).combine_chunks()) for c in ("place", *_SUMS))
        sent.destroy()
        if not len(place):
            break
        flat = model.flat().astype(np.float64)
        change = np.zeros((-(-len(flat) // WIDTH) + 1, WIDTH))
        change[place + 1] = np.stack(values, axis=1)
        model = model.with_flat(flat + change[1:].ravel()[: len(flat)] / change[0, 0])
    return model


def score_run(own: Run, model: Model | None, counts: Counts) -> list[np.ndarray]:
    """For each text of a run: tokens, known ones, base score, score."""
    at = own.places()
    c = own.count[own.order[at]]
    base = np.log10((c + 0.5) / counts.all)
    score = base if model is None else np.empty(len(at))
    if model is not None:
        target, others = own.target[own.order[at]], len(counts.count)
        for i in range(0, len(at), HELD):
            score[i : i + HELD] = model.log_probability(own.contexts(at[i : i + HELD]), target[i : i + HELD])
        score = (score + np.where(target == others, np.log((c + 0.5) / counts.rest), 0.0)) / np.log(10)
    edges = np.maximum(own.first - own.skip, 0)
    return [s[edges[1:]] - s[edges[:-1]] for s in (np.r_[0, np.cumsum(x)] for x in (np.ones(len(at), np.int64), (c > 0).astype(np.int64), base, score))]


def _scoring(sent, counts: Counts):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            found = score_run(Run(batch, _AT), sent.value, counts)
            yield pa.RecordBatch.from_arrays([batch.column(_AT[c]).flatten() for c in ("rows", "doc_ids", "held")] + [pa.array(x) for x in found], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def count_tokens(runs: DataFrame, s: Scratch, targets: int = TARGETS) -> tuple[Counts, DataFrame]:
    """Counts over all training texts, and a table (token, bucket, count, times) of all tokens: count in training, times in all."""
    each = runs.select(F.posexplode("token").alias("i", "token"), "bucket", "learnt", "times").select("token", *[F.col(c)[F.col("i")].cast(kind).alias(c) for c, kind in (("bucket", "int"), ("learnt", "long"), ("times", "long"))])
    table = s.put(each.groupBy("token", "bucket").agg(F.sum("learnt").alias("count"), F.sum("times").alias("times")), "counts")
    seen = table.where("count > 0")
    total, distinct = seen.agg(F.sum("count"), F.count("*")).first()
    most = seen.orderBy(F.desc("count"), "bucket", "token").limit(targets).collect()
    ends = seen.where(F.col("token") == int(END)).collect()  # a row at most
    return Counts(total or 0, distinct, [(r["token"], r["count"]) for r in dict.fromkeys([*ends, *most])]), table


def frequent_tokens(table: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens in order, their counts, least): those that stand least times and more in the corpus; most of them, at most."""
    size = F.floor(F.log2(F.col("times").cast("double"))).cast("int")
    held = {r["size"]: r["n"] for r in table.where("times > 0").groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # a row for each power of two
    least, n = 63, 0
    while least > 0 and n + held.get(least - 1, 0) <= most:
        least -= 1
        n += held.get(least, 0)
    rows = table.where(F.col("times") >= 1 << least).select("token", "count").toArrow().sort_by("token")
    return *(np.asarray(rows.column(c).combine_chunks()) for c in ("token", "count")), 1 << least


def split_texts(docs: DataFrame, s: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of RUNS."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    with text_batches(docs.sparkSession):
        return s.put(rows.mapInArrow(_splitting(new_key()), RUNS), "runs")


def known_runs(runs: DataFrame, counts: Counts, table: DataFrame, s: Scratch, most: int = FREQUENT) -> DataFrame:
    """Runs with the counts of their tokens: frequent ones are sent to every task, the others, each in few runs, are joined."""
    *frequent, least = frequent_tokens(table, most)
    spark = runs.sparkSession
    sent = spark.sparkContext.broadcast(frequent)
    with text_batches(spark, RUN_ROWS):
        each = runs.select("run", "token").mapInArrow(_rare(sent), "run long, pos int, token long")
        others = table.where((F.col("times") < least) & (F.col("count") > 0)).select("token", "count")
        rare = each.join(others, "token").groupBy("run").agg(F.collect_list(F.struct("pos", "count")).alias("r")).select("run", F.col("r.pos").alias("rare"), F.col("r.count").alias("their"))
        none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
        whole = runs.drop("learnt", "times").join(rare, "run", "left").select(*[f.name for f in _OWN], "token", none("rare", "int"), none("their", "bigint"))
        return s.put(whole.mapInArrow(_known(counts, sent), KNOWN), "known")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: int = TARGETS, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    s = Scratch(spark, "lm")
    runs = split_texts(docs, s, id_col, text_col)
    counts, table = count_tokens(runs, s, targets)
    known = known_runs(runs, counts, table, s)
    s.drop(runs, table)
    with text_batches(spark, RUN_ROWS):
        model = train(known, counts, rounds, share) if counts.total else None
        sent = spark.sparkContext.broadcast(model)
        parts = s.put(known.mapInArrow(_scoring(sent, counts), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    s.drop(known)
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")
