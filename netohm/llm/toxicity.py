"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A step's input is a word: a learnt vector for words that several training documents hold, joined to the sum of learnt
vectors of the word's hashed character 3- and 4-grams. Two gated recurrent layers read a window of words in both
directions; attention pools their states; a logistic unit gives the window's score. Windows of WIDTH words start at every
STRIDE-th word and overlap, so that any WIDTH - STRIDE + 1 words in a row lie whole in one; a document scores as its highest
window. Training takes the highest window of each document (multiple instances) of those at every LEARN_STRIDE-th word, by
Adam and back-propagation through time.

The fit uses at most PER_CLASS labelled documents of each class, those with the least hash of doc_id among texts
of up to MAX_CHARS characters; scoring covers every window of every whole text.

Defined cases: null and empty texts, and texts without a letter or digit, score 0; with no labels or one class the
score is that class's share (0 without labels); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm import hashing as H
from netohm.llm.work import ship

PER_CLASS, MAX_CHARS = 1500, 20_000
WIDTH, STRIDE, LEARN_STRIDE = 48, 20, 32
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 12
#: Tables learn more slowly, so that the network reads them before they learn single documents by heart.
TABLE_RATE = 0.05
CHAR_TABLE, MOST_WORDS, MIN_DOCS = 1 << 13, 20_000, 3
EPOCHS, LEAST_STEPS, PATIENCE, BATCH, RATE, DECAY = 8, 400, 6, 64, 0.01, 1e-5

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[97:123] = BETWEEN[128:] = False


def _text(words: H.Words, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the picked words, flat, and how many each word has."""
    start, size = words.starts[picked], (words.ends - words.starts)[picked]
    own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at, left = np.repeat(start, size) + own, np.repeat(size, size) - own
    padded = np.concatenate([words.data, np.zeros(3, np.uint8)]).astype(np.uint64)
    back = np.where(own > 0, padded[at - 1], 1)
    a, b, c = padded[at], np.where(left > 1, padded[at + 1], 2), np.where(left > 2, padded[at + 2], 3)
    three = back + (a << np.uint64(8)) + (b << np.uint64(16))
    both = np.stack([H.mix(three), H.mix(three + (c << np.uint64(24)) + np.uint64(1 << 40))], 1)
    return (both % np.uint64(CHAR_TABLE)).astype(np.int32).reshape(-1), 2 * size


class Inputs:
    """The distinct words of a batch of texts as inputs, and the windows of its texts as indices of them."""

    def __init__(self, texts: pa.Array, stride: int = STRIDE):
        words = H.Words(texts, BETWEEN, FOLD)
        self.hash, first, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.grams, self.gram_count = _text(words, first)
        n = words.counts
        per = np.where(n > 0, np.maximum(-(-(n - WIDTH) // stride), 0) + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), per)
        start = np.repeat(words.first[:-1], per) + stride * (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))
        self.size = np.minimum(WIDTH, np.repeat(words.first[1:], per) - start)
        self.at = start
        self.n_docs = len(n)

    def window(self, rows: np.ndarray) -> np.ndarray:
        """Word indices, WIDTH for each window; -1 past its end."""
        step = np.arange(WIDTH)
        i = np.minimum(self.at[rows, None] + step, max(len(self.word) - 1, 0))
        return np.where(step < self.size[rows, None], self.word[i], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, vocabulary: np.ndarray, word: np.ndarray, char: np.ndarray, seed: int = 1):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": word, "char": char, "w": draw(2 * h), "b": np.full(1, -1.0, np.float32), "v": draw(2 * h)}
        for k in "fb":
            self.p |= {f"W{k}": draw(d, 3 * h), f"U{k}": draw(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; its length for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i, len(self.vocabulary))

    def embed(self, ids: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.p["char"][grams], np.cumsum(count) - count, axis=0) if len(grams) else np.zeros((len(ids), CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][ids], sums / np.sqrt(count)[:, None].astype(np.float32)], 1)

    def run(self, gates: dict[str, np.ndarray], window: np.ndarray, keep: bool = False):
        """Scores (logits) of windows; gates: for each direction, the input part of the gates of each word, and zeros last."""
        n, h = len(window), HIDDEN
        live = (window >= 0).astype(np.float32)
        states = np.zeros((WIDTH, n, 2 * h), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for k, steps, cols in (("f", range(WIDTH), slice(0, h)), ("b", range(WIDTH - 1, -1, -1), slice(h, 2 * h))):
            s = np.zeros((n, h), np.float32)
            U = self.p[f"U{k}"]
            for t in steps:
                x = gates[k][window[:, t]]
                rec = s @ U
                zr = _sigmoid(x[:, : 2 * h] + rec[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * rec[:, 2 * h :])
                m = live[:, t : t + 1]
                nxt = s + m * (1 - z) * (new - s)
                if keep:
                    tape[k].append((t, s, z, r, new, rec[:, 2 * h :], m))
                s = nxt
                states[t, :, cols] = s
        att = states @ self.p["v"]
        att = np.where(live.T > 0, att, -1e9)
        att = np.exp(att - att.max(axis=0))
        att /= att.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", att, states)
        return pooled @ self.p["w"] + self.p["b"][0], (states, att, pooled, tape)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        zero = np.zeros((1, 3 * HIDDEN), np.float32)
        return {k: np.concatenate([x @ self.p[f"W{k}"] + self.p[f"c{k}"], zero]) for k in "fb"}

    def gradient(self, x: np.ndarray, window: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss, by parameter and by the rows of x."""
        n, h = len(window), HIDDEN
        logit, (states, att, pooled, tape) = self.run(self.gates(x), window, True)
        d = ((_sigmoid(logit) - y) / n).astype(np.float32)
        g = {"w": pooled.T @ d, "b": d.sum(keepdims=True)}
        dpool = d[:, None] * self.p["w"]
        datt = np.einsum("tnh,nh->tn", states, dpool)
        datt = att * (datt - (att * datt).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", datt, states)
        dstates = att[:, :, None] * dpool + datt[:, :, None] * self.p["v"]
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for k, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            U, Wk = self.p[f"U{k}"], self.p[f"W{k}"]
            gU, dgate = np.zeros_like(U), np.zeros((len(x) + 1, 3 * h), np.float32)
            ds = np.zeros((n, h), np.float32)
            for t, s, z, r, new, rn, m in reversed(tape[k]):
                ds = ds + dstates[t, :, cols]
                dn = ds * m * (1 - z) * (1 - new * new)
                dz = ds * m * (s - new) * z * (1 - z)
                dr = dn * rn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn], 1)
                drec = np.concatenate([dz, dr, dn * r], 1)
                gU += s.T @ drec
                np.add.at(dgate, window[:, t], dg)
                ds = ds * (1 - m * (1 - z)) + drec @ U.T
            dgate = dgate[:-1]
            g |= {f"U{k}": gU, f"W{k}": x.T @ dgate, f"c{k}": dgate.sum(axis=0)}
            dx[:-1] += dgate @ Wk.T
        return g, dx[:-1]

    def scores(self, texts: pa.Array, most: int = 8192) -> np.ndarray:
        """The highest window score of every text."""
        inp = Inputs(texts)
        best = np.full(inp.n_docs, -np.inf)
        if len(inp.doc):
            gates = self.gates(self.embed(self.word_ids(inp.hash), inp.grams, inp.gram_count))
            for i in range(0, len(inp.doc), most):
                rows = np.arange(i, min(i + most, len(inp.doc)))
                logit, _ = self.run(gates, inp.window(rows))
                np.maximum.at(best, inp.doc[rows], logit)
        return np.where(np.isfinite(best), _sigmoid(best), 0.0)


def fit(texts: list[str], labels: np.ndarray, seed: int = 1) -> Network:
    """Train on whole texts and their 0/1 labels."""
    inp = Inputs(pa.array(texts, pa.string()), LEARN_STRIDE)
    y = labels.astype(np.float32)
    # every fifth document only tells when to stop
    teach = np.arange(len(y)) % 5 != 4 if len(y) >= 20 else np.ones(len(y), bool)
    positives = max(float(y[teach].sum()), 1.0)
    negatives = max(float(teach.sum()) - float(y[teach].sum()), 1.0)
    # how many documents of each class hold each word and each n-gram
    words = H.Words(pa.array(texts, pa.string()), BETWEEN, FOLD)
    pair = np.unique(words.text_of() * np.int64(len(inp.hash)) + inp.word)
    doc, word = pair // len(inp.hash), pair % len(inp.hash)
    with_pos = np.bincount(word, (y * teach)[doc], len(inp.hash))
    with_any = np.bincount(word, teach[doc].astype(float), len(inp.hash))
    odds = _odds(with_pos, with_any, positives, negatives)
    common = np.flatnonzero(with_any >= MIN_DOCS)
    common = np.sort(common[np.argsort(-with_any[common], kind="stable")[:MOST_WORDS]])
    r = np.random.default_rng(seed)
    table = (0.1 * r.standard_normal((len(common) + 1, WORD_DIM))).astype(np.float32)
    table[:-1, 0] = odds[common]
    table[-1] = 0
    begin = np.cumsum(inp.gram_count) - inp.gram_count
    gram_pos, gram_any = np.zeros(CHAR_TABLE), np.zeros(CHAR_TABLE)
    for low in range(0, len(y), 100):  # some documents at a time: their n-grams are many
        some = slice(*np.searchsorted(doc, [low, low + 100]))
        size = inp.gram_count[word[some]]
        own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        gram = np.unique(np.repeat(doc[some], size) * np.int64(CHAR_TABLE) + inp.grams[np.repeat(begin[word[some]], size) + own])
        gram_doc, gram = gram // CHAR_TABLE, gram % CHAR_TABLE
        gram_pos += np.bincount(gram, (y * teach)[gram_doc], CHAR_TABLE)
        gram_any += np.bincount(gram, teach[gram_doc].astype(float), CHAR_TABLE)
    char = (0.1 * r.standard_normal((CHAR_TABLE, CHAR_DIM))).astype(np.float32)
    char[:, 0] = _odds(gram_pos, gram_any, positives, negatives)
    net = Network(inp.hash[common], table, char, seed)
    ids = net.word_ids(inp.hash)
    first, last = np.searchsorted(inp.doc, np.arange(inp.n_docs)), np.searchsorted(inp.doc, np.arange(inp.n_docs), "right")
    usable = np.flatnonzero((last > first) & teach)
    held = np.flatnonzero((last > first) & ~teach)
    memory = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    tick, least, kept, worse = 0, np.inf, None, 0
    per_epoch = max(1, len(usable) // BATCH)
    epochs, patience = max(EPOCHS, -(-LEAST_STEPS // per_epoch)), max(PATIENCE, LEAST_STEPS // 2 // per_epoch)
    for epoch in range(epochs + 1):
        gates = net.gates(net.embed(ids, inp.grams, inp.gram_count))
        logit = np.concatenate([net.run(gates, inp.window(np.arange(i, min(i + 2048, len(inp.doc)))))[0] for i in range(0, len(inp.doc), 2048)])
        if len(held):
            top = np.array([logit[first[i] : last[i]].max() for i in held])
            loss = float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -top, top))))
            worse = 0 if loss < least else worse + 1
            if loss < least:
                least, kept = loss, {k: v.copy() for k, v in net.p.items()}
            if worse >= patience:
                break
        if epoch == epochs:
            break
        best = np.array([first[i] + int(np.argmax(logit[first[i] : last[i]])) for i in usable])
        for some in np.array_split(r.permutation(len(usable)), max(1, len(usable) // BATCH)):
            window = inp.window(best[some])
            there, flat = np.unique(window, return_inverse=True)
            lead = int(there[0] == -1)
            there = there[lead:]
            window = flat.reshape(window.shape) - lead
            size = inp.gram_count[there]
            own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            grams = inp.grams[np.repeat(begin[there], size) + own]
            g, dx = net.gradient(net.embed(ids[there], grams, size), window, y[usable[some]])
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], ids[there], dx[:, :WORD_DIM])
            g["word"][-1] = 0
            g["char"] = np.zeros_like(net.p["char"])
            np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM:] / np.sqrt(size)[:, None], size, axis=0).astype(np.float32))
            tick += 1
            for k, v in net.p.items():
                m, s = memory[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= RATE * (TABLE_RATE if k in ("word", "char") else 1) * ((m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.999**tick)) + 1e-8) + DECAY * v)
    if kept is not None:
        net.p = kept
    return net


def _odds(with_pos: np.ndarray, with_any: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """Smoothed log odds of holding it, less for what few documents hold, and 0 where too few do."""
    pos = (with_pos + 0.5) / (positives + 1)
    neg = (with_any - with_pos + 0.5) / (negatives + 1)
    return np.where(with_any >= MIN_DOCS, np.clip(np.log(pos / neg), -3, 3) * with_any / (with_any + 10), 0).astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "toxic") -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample, the same for the same rows."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").distinct()
    texts = docs.where(F.length("text").between(1, MAX_CHARS)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = texts.select("doc_id").join(marked, "doc_id").distinct()
    picked = None
    for y in (0, 1):
        part = both.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in found.collect())
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of every document, learnt from labels."""
    spark = docs.sparkSession
    ship(spark)
    texts, y = training_sample(docs, labels)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))
    net = fit(texts, y)
    model = spark.sparkContext.broadcast(net)  # its size is bounded by MOST_WORDS and CHAR_TABLE

    def run(batches):
        for big in batches:
            for b in H.pieces(big, most=1 << 20):
                s = model.value.scores(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
