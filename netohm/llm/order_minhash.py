"""Near duplicates by order MinHash with banded alignment.

Shingles are `k` words, labelled with their occurrence number in the text, so that all labels of a text differ. A sketch
takes the `least` labels with the smallest hash values and keeps them in text order; texts agree on a sketch
if the same labels are least and stand in the same order, which follows edit similarity. Texts that agree on
one of `sketches` sketches (or on two neighbouring ones together) are candidates: all pairs in groups of up to `small`
texts; in larger groups first each text with the group's hub, whose choice differs from sketch to sketch. Candidates are
verified by alignment: labels of one text are matched to the other's inside a diagonal band, the longest chain in order
is aligned, and a pair is linked if aligned / (labels of both - aligned) >= threshold.

Then every pair of a larger group whose texts are not yet in one class is linked or ruled out. First by rare labels: with
the labels of all such texts ordered by the number of texts that hold them, two texts that reach the threshold share one of
the first ones of both, as many as a text may lack of the other's (a prefix filter). Texts whose first labels are held by no text of another class are done; their number does not
multiply anything, so pages that share a frame and differ in the rest cost a pass over their labels. What is left
of a group is cut into blocks of up to about `block` texts, and for each two blocks the labels that all pairs
share are counted. Aligned labels are shared ones, so only pairs that share enough are aligned. The largest class of a
group is not compared with itself, and a pair is compared on the first sketch that it agrees on. Which groups count as larger
decides the way, not the classes.

Classes are the components of the links. Texts with equal words are one class before sketching, so copies cost nothing.

Defined cases: null and empty texts (no words) are classes of their own; texts under k words have one shingle, all
their words; repeated rows of a doc_id get the same class; extra columns are ignored here and pass through keep_one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm import hashing as H
from netohm.llm.components import components
from netohm.llm.work import ship, written

K, LEAST, SKETCHES, SMALL, THRESHOLD, BLOCK = 5, 3, 14, 16, 0.8, 512


def _labels(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of all texts in order, and how many each text has."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = np.repeat(first[:-1], count) + _own(count)
    end = np.minimum(start + k, np.repeat(first[1:], count))
    g = H.spans(h, start, end, H.BASES[1])
    text = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((g, text))
    same = np.zeros(len(g), bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1])
    at = np.arange(len(g))
    run = np.maximum.accumulate(np.where(same, 0, at)) if len(g) else at
    occurrence = np.empty(len(g), np.uint64)
    occurrence[order] = (at - run).astype(np.uint64)
    return H.mix(g + occurrence * np.uint64(H.BASES[2])), count


def _own(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each text."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def _sketches(labels: np.ndarray, count: np.ndarray, sketches: int, least: int) -> np.ndarray:
    """One key for each text with labels and each sketch."""
    full = count[count > 0]
    begin = np.cumsum(full) - full
    keys = np.zeros((len(full), sketches), np.uint64)
    if not len(full):
        return keys
    text = np.repeat(np.arange(len(full)), full)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        v = H.mix(labels ^ H.mix(np.array([s + 1], np.uint64))[0])
        places = np.full((len(full), least), len(v), np.int64)
        for j in range(least):
            low = np.minimum.reduceat(v, begin)
            hit = np.flatnonzero((v == low[text]) & (v != top))
            t = text[hit]
            lone = np.ones(len(hit), bool)
            lone[1:] = t[1:] != t[:-1]
            places[t[lone], j] = hit[lone]
            v[hit[lone]] = top
        places.sort(axis=1)
        key = np.full(len(full), s + 1, np.uint64)
        padded = np.append(labels, np.uint64(0))
        for j in range(least):
            key = H.mix(key * np.uint64(H.BASES[0]) + padded[places[:, j]])
        keys[:, s] = key
    return keys


def _signatures(k: int, sketches: int, least: int):
    def run(batches):
        for big in batches:
            for b in H.pieces(big):
                w = H.Words(b.column("text"))
                h = w.hashes()
                labels, count = _labels(h, w.first, k)
                keys = _sketches(labels, count, sketches, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").cast(pa.int64()),
                        pa.array(w.counts, pa.int64()),
                        pa.array(H.signed(H.spans(h, w.first[:-1], w.first[1:], H.BASES[1])), pa.int64()),
                        pa.array(H.signed(H.spans(h, w.first[:-1], w.first[1:], H.BASES[2])), pa.int64()),
                        H.lists(H.signed(keys.reshape(-1)), np.where(count > 0, sketches, 0), pa.int64()),
                    ],
                    names=["doc_id", "n_words", "d1", "d2", "keys"],
                )

    return run


def _sequences(batches):
    """Texts as 32-bit word hashes."""
    for big in batches:
        for b in H.pieces(big):
            w = H.Words(b.column("text"))
            short = (w.hashes() >> np.uint64(32)).astype(np.uint32)
            seq = [short[s:e].tobytes() for s, e in zip(w.first[:-1], w.first[1:])]
            d1, d2 = (pa.array(H.signed(H.spans(w.hashes(), w.first[:-1], w.first[1:], x)), pa.int64()) for x in H.BASES[1:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), d1, d2, pa.array(seq, pa.binary())], names=["doc_id", "d1", "d2", "seq"])


def aligned(a: np.ndarray, b: np.ndarray, k: int, threshold: float) -> float:
    """Aligned labels of two word sequences over all their labels; 0 where the band or the lengths rule a link out."""
    la, _ = _labels(a.astype(np.uint64), np.array([0, len(a)]), k)
    lb, _ = _labels(b.astype(np.uint64), np.array([0, len(b)]), k)
    short, long = sorted((len(la), len(lb)))
    if not short or short < threshold * long:
        return 0.0
    _, pa_, pb = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    # in a link at most (1 - threshold) of the labels of both stand alone, so no aligned pair lies further off
    band = int((1 - threshold) * (short + long)) + 1
    near = np.abs(pa_ - pb) <= band
    pa_, pb = pa_[near], pb[near]
    steps = pb[np.argsort(pa_)]
    if np.all(steps[1:] > steps[:-1]):
        chain = len(steps)
    else:
        tails: list[int] = []
        for x in steps.tolist():
            i = bisect_left(tails, x)
            tails[i : i + 1] = [x]
        chain = len(tails)
    return chain / (short + long - chain)


def _verify(k: int, threshold: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint32) for s in (x, y))
                keep.append(aligned(x, y, k, threshold) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shared(labels: np.ndarray, text: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """How many labels each two of n texts share."""
    out = np.zeros((n, n), np.float32)
    _, column, times = np.unique(labels, return_inverse=True, return_counts=True)
    several = times > 1  # labels of a text differ, so these are in several texts
    number = np.cumsum(several) - 1
    keep = several[column]
    column, text = number[column[keep]], text[keep]
    order = np.argsort(column, kind="stable")
    column, text = column[order], text[order]
    for low in range(0, int(several.sum()), width):
        s, e = np.searchsorted(column, [low, low + width])
        held = np.zeros((n, width), np.float32)
        held[text[s:e], column[s:e] - low] = 1
        out += held @ held.T
    return out


def _settle(k: int, threshold: float):
    """Links between the classes that meet in one or two blocks of a group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        ids, block, cls = (table.column(c).to_numpy() for c in ("doc_id", "block", "class_id"))
        seqs = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("seq")]
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        first = np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
        labels, count = _labels(np.concatenate(seqs).astype(np.uint64), first, k)
        left = np.triu(cls[:, None] != cls[None, :], 1)
        if table.column("bi")[0] != table.column("bj")[0]:
            left &= block[:, None] != block[None, :]
        for t in range(table.column("s")[0].as_py()):
            left &= keys[:, t][:, None] != keys[:, t][None, :]
        both = count[:, None] + count[None, :]
        left &= np.minimum(count[:, None], count[None, :]) >= threshold * np.maximum(count[:, None], count[None, :]) - 1e-9
        a, b = [], []
        if left.any():
            shared = _shared(labels, np.repeat(np.arange(len(ids)), count), len(ids)).astype(np.float64)
            left &= shared >= threshold * (both - shared) - 1e-9
            i, j = np.nonzero(left)
            order = np.argsort(-(shared[i, j] / (both[i, j] - shared[i, j])), kind="stable")
            root = {c: c for c in cls.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for x, y in zip(i[order].tolist(), j[order].tolist()):
                u, v = top(int(cls[x])), top(int(cls[y]))
                if u != v and aligned(seqs[x], seqs[y], k, threshold) >= threshold - 1e-12:
                    root[max(u, v)] = min(u, v)
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _label_rows(k: int):
    """A row for each label of each text."""

    def run(batches):
        for b in batches:
            seqs = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column("seq")]
            if not seqs:
                continue
            first = np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
            labels, count = _labels(np.concatenate(seqs).astype(np.uint64), first, k)
            at = pa.array(np.repeat(np.arange(len(seqs)), count))
            columns = [b.column("doc_id").take(at), b.column("class_id").take(at), pa.array(np.repeat(count, count), pa.int64()), pa.array(H.signed(labels), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "class_id", "n", "label"])

    return run


def _in_reach(texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of texts (doc_id, class_id, seq) the doc_ids that share one of their first labels, by rising number of texts, with a text of another class."""
    rows = texts.select("doc_id", "class_id", "seq").mapInArrow(_label_rows(k), "doc_id long, class_id long, n long, label long")
    held = rows.groupBy("label").agg(F.count("*").alias("times"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("times > 1")
    held = written(held.select("label", "times", (F.col("low") != F.col("high")).alias("mixed")), "labels")
    # labels of one text only come first of all
    own = rows.join(held, "label").groupBy("doc_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("times", "label", "mixed"))).alias("x"))
    first = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("x"))
    return own.where((first > 0) & F.exists(F.slice("x", F.lit(1), F.greatest(first, F.lit(0)).cast("int")), lambda y: y["mixed"])).select("doc_id")


def _rest(large: DataFrame, classes: DataFrame, reps: DataFrame, seqs: DataFrame, k: int, threshold: float, block: int) -> DataFrame | None:
    """Links of all pairs in large groups whose texts are in different classes; None where there are no such pairs."""
    rows = large.join(classes, "doc_id", "left").select("key", "s", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    rows = written(rows, "large_classes")

    def mixed_of(rows: DataFrame, name: str) -> DataFrame:
        held = rows.groupBy("key", "class_id").agg(F.count("*").alias("m"))
        mixed = held.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("c"), F.max(F.struct("m", "class_id")).alias("most")).where("c > 1")
        return written(mixed.select("key", "n", "most"), name)

    mixed = mixed_of(rows, "mixed")
    if mixed.isEmpty():
        return None
    unsure = written(rows.join(mixed.select("key"), "key", "left_semi").select("doc_id", "class_id").distinct(), "unsure")
    texts = written(seqs.join(unsure, "doc_id").join(reps.select("doc_id", "keys"), "doc_id"), "unsure_texts")
    near = written(_in_reach(texts, k, threshold), "in_reach")
    rows = written(rows.join(near, "doc_id", "left_semi"), "reach_classes")
    mixed = mixed_of(rows, "mixed_in_reach")
    if mixed.isEmpty():
        return None
    main, others = F.ceil(F.col("most.m") / block), F.ceil((F.col("n") - F.col("most.m")) / block)
    inside = F.col("class_id") == F.col("most.class_id")
    salt = F.xxhash64("key", "doc_id")
    rows = rows.join(mixed, "key").select(
        "key", "s", "doc_id", "class_id",
        F.when(inside, F.pmod(salt, main)).otherwise(main + F.pmod(salt, others)).alias("block"),
        F.sequence(F.when(inside, main).otherwise(F.lit(0).cast("long")), main + others - 1).alias("with"),
    )
    rows = written(rows, "blocks")
    wide = rows.join(texts.drop("class_id"), "doc_id").withColumn("other", F.explode("with"))
    wide = wide.select("key", "s", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "doc_id", "class_id", "keys", "seq")
    return wide.groupBy("key", "bi", "bj").applyInArrow(_settle(k, threshold), "a long, b long").distinct()


def _candidates(reps: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify, and the rows of groups of over `small` texts that agree on sketch s."""
    both = F.array_union(
        F.transform("keys", lambda x, i: F.xxhash64(i, x)),
        F.transform("keys", lambda x, i: F.xxhash64(F.lit("two"), i, x, F.element_at("keys", (i + 1) % F.size("keys") + 1))),
    )
    rows = reps.select("doc_id", F.size("keys").alias("sketches"), F.posexplode(both).alias("s", "key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", "doc_id").alias("x"), "doc_id")).alias("hub")).where("n > 1")
    groups = written(groups.select("key", "n", F.col("hub.doc_id").alias("hub")), "groups")  # as a table, its join can split hot keys
    rows = rows.join(groups, "key")
    large = written(rows.where(F.col("n") > small), "large")
    star = large.where(F.col("doc_id") != F.col("hub")).select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
    few = rows.where(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("g"))
    pairs = few.select(F.explode(F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, small), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    # texts that agree on two neighbouring sketches agree on one
    return star.unionByName(pairs.select("p.a", "p.b")).distinct(), large.where("s < sketches").select("key", "s", "doc_id")


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, sketches: int = SKETCHES, least: int = LEAST, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least doc_id of the class."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(docs.mapInArrow(_signatures(k, sketches, least), "doc_id long, n_words long, d1 long, d2 long, keys array<long>"), "signatures")
    copies = sig.where("n_words > 0").groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("rep"))
    copies = written(copies, "copies")  # a table on both sides of the join lets Spark split a hot text
    named = sig.drop("keys").join(copies, ["d1", "d2", "n_words"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    named = written(named, "named")
    least = lambda c: F.min_by(c, F.struct("d1", "d2")).alias(c)  # noqa: E731  one text for a repeated doc_id
    reps = sig.where("n_words > 0").join(named.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(least("keys"))
    pairs, large = _candidates(reps, small)
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # the same join at every size: ids of candidates grow with the documents
    seqs = written(docs.join(ends.hint("merge"), "doc_id", "left_semi").mapInArrow(_sequences, "doc_id long, d1 long, d2 long, seq binary").groupBy("doc_id").agg(least("seq")), "sequences")
    right = pairs.join(seqs.select(F.col("doc_id").alias("b"), F.col("seq").alias("sb")), "b")
    wide = right.join(seqs.select(F.col("doc_id").alias("a"), F.col("seq").alias("sa")), "a").select("a", "b", "sa", "sb")
    links = written(wide.mapInArrow(_verify(k, threshold), "a long, b long"), "links")
    classes = components(links)
    more = _rest(large, classes, reps, seqs, k, threshold, block)
    if more is not None:
        links = written(links.unionByName(more), "all_links")
        classes = components(links)
    classes = written(classes.withColumnRenamed("doc_id", "rep"), "classes")
    return named.join(classes, "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those rows whose class has a smaller doc_id."""
    gone = near_duplicates(docs, **options).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
