"""Substring deduplication by seed and extend on winnowed anchors.

A passage is a run of `length` words. A word goes if a passage that covers it also starts in a document with
a smaller doc_id; passages are judged on the input. Seeds are winnowed k-word anchors: among any
`length - k + 1` consecutive k-grams the one with the least hash is an anchor, so two equal passages hold the same
anchor at the same place. Documents meet on anchors; around each shared seed the match is extended both ways by
comparing the passages that reach to either side of it, and overlapping hits join to maximal repeats.

Defined cases: null and empty texts have no words and lose none; texts with fewer words than `length` lose none; of
texts with equal words the least doc_id keeps them; rows that repeat a doc_id with other text are separate
texts under one doc_id and are not compared with each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm import hashing as H
from netohm.llm.work import ship, written

LENGTH, SEED = 50, 25


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value (the last of equals) in each window of `width` values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # doubling: the best of 1, 2, 4, ... values, then two overlapping blocks
    best, size = np.arange(len(x)), 1
    while size * 2 <= width:
        a, b = best[:-size], best[size:]
        best = np.where(x[b] <= x[a], b, a)
        size *= 2
    a, b = best[:n], best[width - size : width - size + n]
    return np.where(x[b] <= x[a], b, a)


def _passages(words: H.Words, hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all passages within one text, the anchor of each, and the hashes of all k-grams."""
    k_grams = H.grams(hashes, seed)
    anchor = _least_in_windows(k_grams, length - seed + 1)
    at = np.arange(len(anchor))
    text = words.text_of()
    inside = text[at] == text[at + length - 1] if len(at) else np.zeros(0, bool)
    return at[inside], anchor[inside], k_grams


def _signatures(length: int, seed: int):
    def run(batches):
        for big in batches:
            for b in H.pieces(big):
                w = H.Words(b.column("text"))
                h = w.hashes()
                at, anchor, k_grams = _passages(w, h, length, seed)
                text = w.text_of()
                anchors = np.unique(anchor)
                owner = text[anchors] if len(anchors) else np.zeros(0, np.int64)
                pair = np.unique(np.stack([owner.astype(np.uint64), k_grams[anchors]], 1), axis=0) if len(anchors) else np.zeros((0, 2), np.uint64)
                counts = np.bincount(pair[:, 0].astype(np.int64), minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").cast(pa.int64()),
                        b.column("t"),
                        pa.array(w.counts, pa.int64()),
                        pa.array(H.signed(H.spans(h, w.first[:-1], w.first[1:], H.BASES[1])), pa.int64()),
                        pa.array(H.signed(H.spans(h, w.first[:-1], w.first[1:], H.BASES[2])), pa.int64()),
                        H.lists(H.signed(np.ascontiguousarray(pair[:, 1])), counts, pa.int64()),
                    ],
                    names=["doc_id", "t", "n_words", "d1", "d2", "anchors"],
                )

    return run


def _extend(length: int, seed: int):
    """Passages around shared seeds: two hashes, the document and the start."""

    def run(batches):
        for big in batches:
            for b in H.pieces(big):
                w = H.Words(b.column("text"))
                h = w.hashes()
                at, anchor, k_grams = _passages(w, h, length, seed)
                text = w.text_of()
                shared = b.column("shared")
                flat = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(b.num_rows), np.diff(shared.offsets.to_numpy()))
                mine = _pair_key(text[at], k_grams[anchor])
                hit = np.isin(mine, _pair_key(owner, flat))
                at = at[hit]
                ids, digests = (b.column(c).to_numpy(zero_copy_only=False)[text[at]] if len(at) else np.zeros(0, np.int64) for c in ("doc_id", "t"))
                own = at - w.first[text[at]] if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(H.signed(H.spans(h, at, at + length, H.BASES[1])), pa.int64()),
                        pa.array((H.spans(h, at, at + length, H.BASES[2]) >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()),
                        pa.array(ids, pa.int64()),
                        pa.array(digests, pa.int64()),
                        pa.array(own.astype(np.int32), pa.int32()),
                    ],
                    names=["w1", "w2", "doc_id", "t", "start"],
                )

    return run


def _pair_key(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    return H.mix(value.astype(np.uint64) + owner.astype(np.uint64) * np.uint64(H.BASES[0]))


def _cut(length: int, texts: bool):
    def run(batches):
        for big in batches:
            for b in H.pieces(big):
                out = []
                for i, (text, starts, whole) in enumerate(zip(b.column("text"), b.column("starts"), b.column("copy"))):
                    words = (text.as_py() or "").encode().split()
                    n = len(words)
                    if whole.as_py() and n >= length:
                        kept = []
                    elif starts.as_py():
                        gone = np.zeros(n + 1, np.int64)
                        s = np.asarray(starts.as_py())
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + length, -1)
                        covered = np.cumsum(gone[:-1]) > 0
                        kept = [x for x, g in zip(words, covered) if not g]
                    else:
                        kept = words
                    joined = b" ".join(kept)
                    out.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None))
                cols = list(zip(*out)) if out else [[], [], [], []]
                arrays = [b.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    arrays.append(pa.array(cols[3], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, a hash t of the text, text: a doc_id may have several texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def repeated_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, starts) of passages that start in an earlier document too, and (doc_id, t) of whole copies; t is the text's xxhash64."""
    docs, key = _texts(docs), ["doc_id", "t"]
    ship(docs.sparkSession)
    sig = written(docs.mapInArrow(_signatures(length, seed), "doc_id long, t long, n_words long, d1 long, d2 long, anchors array<long>"), "signatures")
    long_enough = sig.where(F.col("n_words") >= length)
    least = long_enough.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = written(least.where("least < most").drop("most"), "least")  # a table on both sides of a join lets Spark split a hot key
    copies = long_enough.select(*key, "d1", "d2", "n_words").join(least, ["d1", "d2", "n_words"]).where("doc_id > least").select(*key).distinct()
    copies = written(copies, "copies")
    seeds = long_enough.join(copies, key, "left_anti").select(*key, F.explode("anchors").alias("a"))
    shared = seeds.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    shared = written(shared, "shared")
    by_doc = seeds.join(shared, "a").groupBy(*key).agg(F.collect_set("a").alias("shared"))
    passages = written(docs.join(by_doc, key).select(*key, "text", "shared").mapInArrow(_extend(length, seed), "w1 long, w2 int, doc_id long, t long, start int"), "passages")
    first = passages.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    first = written(first, "first")
    hits = passages.join(first, ["w1", "w2"]).where("doc_id > lo").groupBy(*key).agg(F.collect_set("start").alias("starts"))
    return hits, copies


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as text) of every document."""
    hits, copies = repeated_passages(docs, length, seed)
    marks = hits.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("starts", F.array().cast("array<int>")).withColumn("copy", F.lit(True)))
    joined = _texts(docs).join(marks, ["doc_id", "t"], "left").select("doc_id", "text", "starts", "copy")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts
    return joined.mapInArrow(_cut(length, texts), schema)
