"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Words are runs of ASCII letters and digits and of bytes above 127, with A-Z as a-z. A word's input has an embedding of the word
and one of its characters, the sum of embeddings of its 3-byte grams with its ends; both are learnt with the network, by its
gradients. Beside them stand what counting gives before training: the log-odds that documents with the word are toxic and
whether enough documents had it, mean and greatest log-odds of its 3- and 5-byte grams, its length. So words that training
never saw are still judged by their characters. A forward and a backward gated recurrent unit read a window
of words, attention pools their states, and a logistic unit gives the window's score. Windows overlap by a quarter and
cover the whole text; a text's score is that of its worst window.

``fit`` learns from at most ``MOST_DOCS`` labelled documents of each label, the first by a hash of doc_id among those with
at most ``MOST_CHARS`` characters: a bounded sample, so the model and its broadcast have a fixed size. Training takes the
worst window of each document, chosen anew with the model as it improves, and hides word features at random to make the
network learn characters. ``score`` reads whole texts where they lie, without a shuffle.

Defined results: null and empty texts have the score of no words; rows are scored each, whatever their ids; labels join
by doc_id, and a doc_id with two labels counts as toxic if one says so; without labels of both kinds every score is the
share of toxic ones (0 if there are none); extra columns stay out; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cardloom.llm.common import _GOLD, mix, slices

MOST_DOCS, MOST_CHARS = 2000, 20_000
WINDOW, STRIDE = 48, 36
HIDDEN = 12
WORD_BITS, TRI_BITS, FIVE_BITS = 18, 14, 18
#: Slots (2^bits) and places of the learnt embeddings of words and of 3-byte grams.
EMBED_BITS, EMBED = 16, 3
#: Words and grams of fewer training documents have no log-odds.
LEAST_DOCS = 4
CHUNK = 1 << 19
FEATURES = 13
#: Where the learnt embeddings stand among them.
WORD_AT, GRAM_AT = slice(2, 2 + EMBED), slice(9, 9 + EMBED)


# ---------------------------------------------------------------- words and their features

_bytes: dict = {}


def _byte_table() -> np.ndarray:
    """What a byte counts as: 0 between words, else 1 to 255, A-Z as a-z."""
    if not _bytes:
        t = np.zeros(256, np.uint64)
        for c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
            t[c] = c
        for c in range(65, 91):
            t[c] = c + 32
        _bytes["t"] = t
    return _bytes["t"]


class Words:
    """The words of a run of bytes: hash of each, and the grams of chosen ones."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        """edges: where texts begin and end in data; counts has the number of words of each."""
        b = _byte_table()[data]
        full = b > 0
        start = full.copy()
        start[1:] &= ~full[:-1]
        inner = edges[:-1][edges[:-1] < len(data)]
        start[inner] = full[inner]
        self.at = np.flatnonzero(start)
        self.counts = np.diff(np.searchsorted(self.at, edges))
        stop = full.copy()
        stop[:-1] &= ~full[1:] | start[1:]
        self.end = np.flatnonzero(stop) + 1
        self.b = b
        length = self.end - self.at
        h = np.zeros(len(self.at), np.uint64)
        # eight bytes at a time: as many rounds as the longest word needs, each over the words still going
        alive, k = np.arange(len(self.at)), 0
        padded = np.concatenate([b, np.zeros(8, np.uint64)])
        while len(alive):
            x = np.zeros(len(alive), np.uint64)
            for j in range(8):
                inside = length[alive] > k + j
                x |= np.where(inside, padded[np.minimum(self.at[alive] + k + j, len(padded) - 1)], 0).astype(np.uint64) << np.uint64(8 * j)
            h[alive] = mix(h[alive] ^ x) + _GOLD
            k += 8
            alive = alive[length[alive] > k]
        self.hash = h

    def grams(self, which: np.ndarray):
        """(places of each word's first gram, 3-gram slots, 5-gram slots) for the words at which; a gram for each byte."""
        length = (self.end - self.at)[which]
        first = np.cumsum(length) - length
        place = np.repeat(self.at[which] - first, length) + np.arange(length.sum())
        lo, hi = np.repeat(self.at[which], length), np.repeat(self.end[which], length)

        def byte(d):
            p = place + d
            return np.where((p >= lo) & (p < hi), self.b[np.clip(p, 0, len(self.b) - 1)], np.uint64(0))

        three = byte(-1) | byte(0) << np.uint64(8) | byte(1) << np.uint64(16)
        five = three | byte(-2) << np.uint64(24) | byte(2) << np.uint64(32)
        return first, _slot(three, TRI_BITS), _slot(five + np.uint64(1 << 40), FIVE_BITS), length


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix(x + _GOLD) >> np.uint64(64 - bits)).astype(np.int64)


def _signs(bits: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-0.3, 0.3], np.float32), (1 << bits, n))


def texts_of(column):
    """(bytes, edges) for runs of about CHUNK bytes of an Arrow string array; a longer text is a run of its own."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1))
        yield whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# ---------------------------------------------------------------- the network


class Model:
    """Feature tables and weights."""

    def __init__(self, word_odds, tri_odds, five_odds, prior: float):
        self.word_odds, self.tri_odds, self.five_odds, self.prior = word_odds, tri_odds, five_odds, prior
        r = np.random.default_rng(11)
        h, d = HIDDEN, FEATURES
        self.p = {}
        for side in "fb":
            self.p["Wx" + side] = (r.normal(0, 0.4, (d, 3 * h)) / np.sqrt(d)).astype(np.float32)
            self.p["Wh" + side] = (r.normal(0, 0.4, (h, 3 * h)) / np.sqrt(h)).astype(np.float32)
            self.p["b" + side] = np.zeros(3 * h, np.float32)
        self.p["va"] = r.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["wo"] = r.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["bo"] = np.zeros(1, np.float32)
        self.p["words"], self.p["grams"] = _signs(EMBED_BITS, EMBED, 5), _signs(TRI_BITS, EMBED, 6)

    def features(self, words: Words, which: np.ndarray) -> np.ndarray:
        """(len(which), FEATURES): word features in columns 0 to 4, character features in the rest."""
        out = np.zeros((len(which), FEATURES), np.float32)
        if not len(which):
            return out
        w = _slot(words.hash[which], WORD_BITS)
        out[:, 0] = self.word_odds[w]
        out[:, 1] = out[:, 0] != 0
        out[:, WORD_AT] = self.p["words"][_slot(words.hash[which], EMBED_BITS)]
        first, three, five, length = words.grams(which)
        n = length.astype(np.float32)
        t, f = self.tri_odds[three], self.five_odds[five]
        out[:, 5] = np.add.reduceat(t, first) / n
        out[:, 6] = np.maximum.reduceat(t, first)
        out[:, 7] = np.add.reduceat(f, first) / n
        out[:, 8] = np.maximum.reduceat(f, first)
        out[:, GRAM_AT] = np.add.reduceat(self.p["grams"][three], first) / np.sqrt(n)[:, None]
        out[:, 12] = np.log1p(n) - 1.8
        return out

    # states of one direction: xs (T, n, 3h) holds the input's part of the gates; mask (T, n) is 0 where no word is
    def _run(self, xs, mask, Wh, keep=False):
        h = HIDDEN
        state = np.zeros((xs.shape[1], h), np.float32)
        out, saved = np.empty((len(xs), xs.shape[1], h), np.float32), []
        for t in range(len(xs)):
            g = state @ Wh
            zr = np.tanh(0.5 * (xs[t, :, : 2 * h] + g[:, : 2 * h]))
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(xs[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = c + z * (state - c)
            m = mask[t][:, None]
            if keep:
                saved.append((state, g, z.copy(), r.copy(), c))
            state = state + m * (new - state)
            out[t] = state
        return out, saved

    def logits(self, inputs, mask, keep=False):
        """inputs: for each direction (T, n, 3h); mask (T, n)."""
        f, sf = self._run(inputs[0], mask, self.p["Whf"], keep)
        b, sb = self._run(inputs[1][::-1], mask[::-1], self.p["Whb"], keep)
        H = np.concatenate([f, b[::-1]], 2)
        e = H @ self.p["va"] + (mask - 1) * 30
        a = np.exp(e - e.max(0))
        a *= np.maximum(mask, 1e-9)
        a /= a.sum(0)
        pooled = (a[:, :, None] * H).sum(0)
        y = pooled @ self.p["wo"] + self.p["bo"]
        return (y, (H, a, pooled, sf, sb)) if keep else y

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p["Wx" + s] + self.p["b" + s] for s in "fb"]

    # ------------------------------------------------------------ whole texts

    def windows(self, counts: np.ndarray):
        """(text of each window, first word of each) for texts with counts words."""
        n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
        text = np.repeat(np.arange(len(counts)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return text, k * STRIDE

    def window_scores(self, data: np.ndarray, edges: np.ndarray):
        """(text, first word, logit) of every window of the texts between edges."""
        words = Words(data, edges)
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        tables = [np.concatenate([g, pad]) for g in self.gates(self.features(words, first))]
        text, start = self.windows(words.counts)
        begin = np.cumsum(words.counts) - words.counts
        out = np.empty(len(text), np.float32)
        step = np.arange(WINDOW)[:, None]
        for i in range(0, len(text), 1024):
            part = slice(i, i + 1024)
            left = words.counts[text[part]] - start[part]
            mask = step < left
            place = np.where(mask, begin[text[part]] + start[part] + step, 0)
            slot = np.where(mask, inverse[place], len(unique)) if len(inverse) else np.full(mask.shape, len(unique))
            tall = int(mask.sum(0).max()) or 1
            slot, m = slot[:tall], mask[:tall].astype(np.float32)
            out[part] = self.logits([t[slot] for t in tables], m)
        return text, start, out, words

    def scores(self, column) -> np.ndarray:
        """Scores of an Arrow array of texts."""
        found = []
        for data, edges in texts_of(column):
            worst = np.full(len(edges) - 1, -np.inf)
            for text, y in self._of_run(data, edges):
                np.maximum.at(worst, text, y)
            found.append(worst)
        y = np.concatenate(found) if found else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(y + self.prior, -30, 30)))

    def _of_run(self, data, edges):
        if len(data) <= 4 * CHUNK:
            text, _, y, _ = self.window_scores(data, edges)
            yield text, y
            return
        # one very long text: overlapping parts, each of bounded size, that no window of words falls between
        b = _byte_table()
        at = 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data) and b[data[end]]:
                end += 1
            text, _, y, _ = self.window_scores(data[at:end], np.array([0, end - at]))
            yield text, y
            if end == len(data):
                return
            full = b[data[at:end]] > 0
            starts = np.flatnonzero(full & ~np.r_[False, full[:-1]])
            back = at + int(starts[-WINDOW]) if len(starts) > WINDOW else end
            at = back if back > at else end


# ---------------------------------------------------------------- training


class _Odds:
    """Log-odds of slots from the documents that have them, shrunk where these are few; documents come in runs."""

    def __init__(self, bits: int):
        self.n, self.ones = np.zeros(1 << bits), np.zeros(1 << bits)

    def add(self, docs: np.ndarray, slots: np.ndarray, toxic: np.ndarray) -> None:
        """docs: place in toxic of the document of each slot."""
        pairs = np.unique(docs.astype(np.int64) << 32 | slots)
        slot = pairs & 0xFFFFFFFF
        self.n += np.bincount(slot, minlength=len(self.n))
        self.ones += np.bincount(slot, weights=toxic[pairs >> 32], minlength=len(self.n))

    def table(self, toxic: np.ndarray) -> np.ndarray:
        n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
        odds = np.log((self.ones + 0.5) / (n1 + 1)) - np.log((self.n - self.ones + 0.5) / (n0 + 1))
        return np.where(self.n >= LEAST_DOCS, odds * self.n / (self.n + 5), 0).astype(np.float32)


def _gradients(model: Model, x, mask, y, weight):
    """Gradients of the logistic loss on windows, those of weights and those of x (T, n, FEATURES)."""
    p, h = model.p, HIDDEN
    T, n, _ = x.shape
    inputs = model.gates(x.reshape(T * n, -1))
    inputs = [g.reshape(T, n, 3 * h) for g in inputs]
    logit, (H, a, pooled, sf, sb) = model.logits(inputs, mask, keep=True)
    prob = 1 / (1 + np.exp(-logit))
    d = ((prob - y) * weight / n).astype(np.float32)
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["wo"]
    da = (H * dp).sum(2)
    de = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tn,tnh->h", de, H)
    dH = a[:, :, None] * dp + de[:, :, None] * p["va"]
    for side, saved, part, order in (("f", sf, dH[:, :, :h], range(T - 1, -1, -1)), ("b", sb, dH[::-1, :, h:], range(T - 1, -1, -1))):
        Wh = p["Wh" + side]
        m_all, x_all = (mask, x) if side == "f" else (mask[::-1], x[::-1])
        dxs = np.empty((T, n, 3 * h), np.float32)
        dWh, ds = np.zeros_like(Wh), np.zeros((n, h), np.float32)
        for t in order:
            state, gt, z, r, c = saved[t]
            ds = ds + part[t]
            m = m_all[t][:, None]
            dn = ds * m
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (state - c) * z * (1 - z)
            dr = dc * gt[:, 2 * h :] * r * (1 - r)
            dxs[t] = np.concatenate([dz, dr, dc], 1)
            dg = np.concatenate([dz, dr, dc * r], 1)
            dWh += state.T @ dg
            ds = ds * (1 - m) + dn * z + dg @ Wh.T
        flat = dxs.reshape(T * n, -1)
        g["Wh" + side], g["Wx" + side], g["b" + side] = dWh, x_all.reshape(T * n, -1).T @ flat, flat.sum(0)
        back = (flat @ p["Wx" + side].T).reshape(x.shape)
        dx = back if side == "f" else dx + back[::-1]
    return g, dx


class _Vocabulary:
    """The distinct words of the windows of a round: counted features, and where their embeddings lie."""

    def __init__(self):
        self.hash, self.fixed, self.three, self.length = [], [], [], []

    def add(self, words: Words, model: Model, flat: np.ndarray) -> None:
        own, first = np.unique(words.hash[flat], return_index=True)
        self.hash.append(own)
        self.fixed.append(model.features(words, flat[first]))
        _, three, _, length = words.grams(flat[first])
        self.three.append(three)
        self.length.append(length)

    def close(self) -> None:
        every = np.concatenate(self.hash)
        self.length, three = np.concatenate(self.length), np.concatenate(self.three)
        start = np.cumsum(self.length) - self.length
        self.hash, first = np.unique(every, return_index=True)
        self.fixed = np.concatenate(self.fixed)[first]
        self.start, self.length, self.three = start[first], self.length[first], three
        self.slot = _slot(self.hash, EMBED_BITS)

    def grams_of(self, which: np.ndarray):
        """(places of each word's first gram, slots of the grams) for the words at which."""
        n = self.length[which]
        first = np.cumsum(n) - n
        return first, self.three[np.repeat(self.start[which] - first, n) + np.arange(n.sum())], n

    def inputs(self, model: Model, index: np.ndarray):
        """(inputs of words at index, how to bring their gradients back)."""
        which, inverse = np.unique(index, return_inverse=True)
        x = self.fixed[which]
        first, three, n = self.grams_of(which)
        x[:, WORD_AT] = model.p["words"][self.slot[which]]
        x[:, GRAM_AT] = np.add.reduceat(model.p["grams"][three], first) / np.sqrt(n)[:, None].astype(np.float32)

        def back(dx: np.ndarray, shown: np.ndarray) -> dict[str, np.ndarray]:
            """dx: (words, FEATURES); shown: whether the word's own features were."""
            flat = inverse.ravel()
            by_word = np.stack([np.bincount(flat, weights=dx[:, WORD_AT.start + c] * shown, minlength=len(which)) for c in range(EMBED)], 1)
            by_gram = np.stack([np.bincount(flat, weights=dx[:, GRAM_AT.start + c], minlength=len(which)) for c in range(EMBED)], 1) / np.sqrt(n)[:, None]
            by_gram = np.repeat(by_gram, n, 0)
            out = {}
            for name, slot, d in (("words", self.slot[which], by_word), ("grams", three, by_gram)):
                out[name] = np.stack([np.bincount(slot, weights=d[:, c], minlength=len(model.p[name])) for c in range(EMBED)], 1).astype(np.float32)
            return out

        return x[inverse].reshape(*index.shape, FEATURES), back


def train(texts, toxic: np.ndarray, share: float, rounds: int = 4, epochs: int = 3) -> Model:
    """texts: Arrow array; toxic: 0 or 1 of each; share: of toxic ones among all labelled documents."""
    toxic = np.asarray(toxic, float)
    runs = list(texts_of(texts))
    odds, at = [_Odds(WORD_BITS), _Odds(TRI_BITS), _Odds(FIVE_BITS)], 0
    for data, edges in runs:
        words = Words(data, edges)
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        own = toxic[at : at + len(words.counts)]
        odds[0].add(doc, _slot(words.hash, WORD_BITS), own)
        once = np.unique(doc.astype(np.uint64) * _GOLD ^ words.hash, return_index=True)[1]
        _, three, five, length = words.grams(once)
        odds[1].add(np.repeat(doc[once], length), three, own)
        odds[2].add(np.repeat(doc[once], length), five, own)
        at += len(words.counts)
    model = Model(*[o.table(toxic) for o in odds], 0.0)
    r = np.random.default_rng(3)
    moment, square, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    balance = np.where(toxic > 0, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9))
    for turn in range(rounds):
        X, Y, W, vocabulary = [], [], [], _Vocabulary()
        at = 0
        for data, edges in runs:
            text, start, y, words = model.window_scores(data, edges)
            if turn == 0:  # before any training: the window with the most telling word
                x = model.features(words, np.arange(len(words.hash)))
                tell = np.maximum(x[:, 0], x[:, 8])
                begin = np.cumsum(words.counts) - words.counts
                y = np.array([tell[b : b + WINDOW].max(initial=-9) for b in (begin[text] + start)])
            best = np.lexsort((-y, text))
            best = best[np.r_[True, np.diff(text[best]) > 0]]
            own = np.arange(len(edges) - 1)
            more = np.flatnonzero(r.random(len(text)) < 0.15)  # other windows of clean documents
            more = more[toxic[at + text[more]] == 0]
            for pick, label in ((best, toxic[at + own]), (more, np.zeros(len(more)))):
                begin = (np.cumsum(words.counts) - words.counts)[text[pick]] + start[pick]
                left = words.counts[text[pick]] - start[pick]
                place = begin[:, None] + np.arange(WINDOW)
                mask = np.arange(WINDOW) < left[:, None]
                flat = np.unique(place[mask]) if mask.any() else np.zeros(0, np.int64)
                rows = np.zeros((len(pick), WINDOW), np.uint64)
                if len(flat):
                    vocabulary.add(words, model, flat)
                    rows[mask] = words.hash[place[mask]]
                X.append(rows)
                Y.append(np.c_[label, mask.sum(1)])
                W.append(balance[at + text[pick]] * (0.5 if pick is more else 1))
            at += len(edges) - 1
        X, Y, W = np.concatenate(X), np.concatenate(Y), np.concatenate(W).astype(np.float32)
        if not vocabulary.hash:
            break  # no text has a word
        vocabulary.close()
        X = np.minimum(np.searchsorted(vocabulary.hash, X), len(vocabulary.hash) - 1)
        size = int(np.clip(len(X) // 10, 16, 256))
        passes = max(epochs, -(-40 * size // len(X)))  # few labels: 40 steps at least
        for epoch in range(passes):
            order = r.permutation(len(X))
            for i in range(0, len(order), size):
                b = order[i : i + size]
                x, back = vocabulary.inputs(model, X[b].T)
                mask = (np.arange(WINDOW)[:, None] < Y[b, 1]).astype(np.float32)
                hide = r.random((WINDOW, len(b))) < 0.4
                x[hide, :5] = 0
                g, dx = _gradients(model, x, mask, Y[b, 0].astype(np.float32), W[b])
                g |= back((dx * mask[:, :, None]).reshape(-1, FEATURES), ~hide.ravel())
                step += 1
                rate = 0.01 * (1 - 0.8 * (turn + epoch / passes) / rounds)
                for k in model.p:
                    moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                    square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                    model.p[k] = (model.p[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    model.prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return model


# ---------------------------------------------------------------- on Spark


def held_out(id_col: str = "doc_id"):
    """Rows that training must not see."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_chars: int = MOST_CHARS):
    """A model (or, if one kind of label is missing, the share of toxic ones) from at most most_docs documents of each label."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") <= most_chars)).select("doc_id", F.col("text").cast("string").alias("text"))
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    first = None
    ids = texts.select("doc_id").distinct()  # of texts that are short enough, so that longer ones are replaced by others
    for label in (0, 1):
        own = given.where(F.col("toxic") == label).join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
        first = own if first is None else first.union(own)
    chosen = texts.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    import pyarrow as pa

    got = chosen.toArrow().sort_by("doc_id")
    toxic = np.asarray(got.column("toxic").combine_chunks(), float) if got.num_rows else np.zeros(0)
    if not 0 < toxic.sum() < len(toxic):
        return share
    texts = got.column("text").cast(pa.large_string()).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    return train(texts, toxic, share)


def score(docs: DataFrame, model, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), with the columns of docs named in keep before them, if they are no result column."""
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = [c for c in keep or [] if c not in ("held_out", "score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    once = "text" in keep and docs.schema["text"].dataType == T.StringType()  # a text that is kept crosses to Python once
    own_text = [] if once else [F.col("text").cast("string").alias("text")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), *own_text)
    fields = [f for f in rows.schema.fields if f.name != "text"] + [T.StructField("score", T.DoubleType())]
    text_at, kept = keep.index("text") if once else len(fields) - 1, len(fields) - 1

    def run(batches):
        own = sent.value
        for batch in slices(batches):
            s = np.full(batch.num_rows, own, float) if isinstance(own, float) else own.scores(batch.column(text_at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(s, pa.float64())], names=[f.name for f in fields])

    scored = rows.mapInArrow(run, T.StructType(fields))
    return scored.select(*[F.col(f"`k_{c}`").alias(c) for c in keep], *[] if "doc_id" in keep else ["doc_id"], "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
