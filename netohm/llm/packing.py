"""Sequence packing by non-negative least squares over shallow length combinations.

A document's ids are cut into windows of `window` ids and a rest. Rests are packed whole: combinations of up
to three lengths that fill a window exactly are enumerated, repeat counts come from non-negative least squares against
the histogram of rests, and are rounded down to what the histogram holds; what is left is packed greedily, longest
first with the longest that still fits. All of that works on the histogram, whose size is bounded by the window;
documents get their place from their rank among rests of equal length. Ranks come from salted groups, so a length
that a third of all documents share is not ranked in one task.

A sequence is padded to the window, or to the next power of two where it is shorter.

Defined cases: null and empty texts hold the end id only; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netohm.llm.hashing import lists
from netohm.llm.tokens import encoder
from netohm.llm.work import ship, written

WINDOW, SWEEPS, GROUP = 1024, 30, 20_000
#: Combinations of three lengths that are tried for each first length; leaving some out costs padding, not rests.
SPREAD = 6


def patterns(window: int, spread: int = SPREAD) -> list[tuple[int, ...]]:
    """Combinations of two lengths, and `spread` of those of three for each first length, that fill a window."""
    two = [(i, window - i) for i in range(1, window // 2 + 1)]
    three = []
    for i in range(1, window // 3 + 1):
        top = (window - i) // 2
        three += [(i, j, window - i - j) for j in sorted({int(x) for x in np.linspace(i, top, spread)})]
    return two + three


def repeats(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Filled windows as (lengths, how often) that use the histogram (index: length) up."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    pats = patterns(window)
    x = np.zeros(len(pats))
    resid = left.astype(float)
    for _ in range(SWEEPS):
        moved = 0.0
        for p, ls in enumerate(pats):
            norm = 4.0 if len(ls) == 2 and ls[0] == ls[1] else float(len(ls)) if len(set(ls)) == len(ls) else 5.0
            new = max(0.0, x[p] + sum(resid[n] for n in ls) / norm)
            step = new - x[p]
            if step:
                x[p] = new
                for n in ls:
                    resid[n] -= step
                moved += abs(step)
        if moved < 1e-3 * max(1, left.sum()):
            break
    for p in np.argsort(-x, kind="stable"):
        use: dict[int, int] = {}
        for n in pats[p]:
            use[n] = use.get(n, 0) + 1
        times = min(int(x[p]), *(int(left[n]) // k for n, k in use.items()))
        if times > 0:
            out.append((pats[p], times))
            for n, k in use.items():
                left[n] -= k * times
    while True:
        held = np.flatnonzero(left)
        if not len(held):
            return out
        ls: list[int] = []
        free = window
        have = left.copy()
        while free:
            fits = held[(held <= free) & (have[held] > 0)]
            if not len(fits):
                break
            n = int(fits[-1])
            ls.append(n)
            have[n] -= 1
            free -= n
        use = {n: ls.count(n) for n in ls}
        times = min(int(left[n]) // k for n, k in use.items())
        out.append((tuple(ls), times))
        for n, k in use.items():
            left[n] -= k * times


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence, offset and padded size of each slot that rests fill in rank order."""
    used: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for ls, times in plan:
        total = sum(ls)
        size, offset = 1 << (total - 1).bit_length(), 0
        for n in ls:
            found.setdefault(n, []).append((used.get(n, 0), sequence, offset, size))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c) for c in zip(*v)) for n, v in found.items()}


def _measure(path: str, end_id: int, window: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n, crcs, count = [], [], []
            for t in b.column("text"):
                ids = enc.ids(t.as_py()) + tail
                n.append(len(ids) // 4)
                cut = [zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)]
                crcs += cut
                count.append(len(cut))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), lists(np.array(crcs, np.int64), np.array(count, np.int64), pa.int64())], names=["doc_id", "doc_tokens", "crcs"]
            )

    return run


def _place(where: dict, window: int):
    def run(batches):
        for b in batches:
            length = b.column("rest").to_numpy()
            rank = b.column("rank").to_numpy()
            seq, off, size = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length[length > 0]):
                at = np.flatnonzero(length == n)
                first, sequence, offset, padded = where[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at] = sequence[k] + rank[at] - first[k]
                off[at], size[at] = offset[k], padded[k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "doc_tokens", "crcs", "rest", "full_rank")), pa.array(seq), pa.array(off), pa.array(size)],
                names=["doc_id", "doc_tokens", "crcs", "rest", "full_rank", "seq", "off", "size"],
            )

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_size (padded)."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    ship(spark)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure(path, end_id, window), "doc_id long, doc_tokens long, crcs array<long>")
    got = written(got.withColumn("rest", F.col("doc_tokens") % window), "lengths")
    bins = {r["rest"]: (r["n"], r["full"]) for r in got.groupBy("rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("full")).collect()}
    total = sum(n for n, _ in bins.values())
    histogram = np.zeros(window + 1, np.int64)
    for rest, (n, _) in bins.items():
        histogram[rest] = n
    histogram[0] = 0
    plan = repeats(histogram, window)
    rest_sequences = sum(times for _, times in plan)
    salts = max(1, -(-total // GROUP))
    keyed = got.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).withColumn("fulls", F.floor(F.col("doc_tokens") / window))
    groups = keyed.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("fulls").alias("f"))
    before = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    full_before, run = {}, 0
    for rest in sorted(bins):
        full_before[rest] = run
        run += bins[rest][1]
    base = F.create_map(*[F.lit(x) for kv in full_before.items() for x in kv]) if full_before else F.create_map(F.lit(0), F.lit(0))
    groups = groups.select("rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), (F.coalesce(F.sum("f").over(before), F.lit(0)) + base[F.col("rest")]).alias("f0"))
    inside = W.partitionBy("rest", "salt").orderBy("doc_id", "doc_tokens")
    ranked = keyed.select(
        "*", F.row_number().over(inside).alias("rn"), F.coalesce(F.sum("fulls").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("fn")
    ).join(groups, ["rest", "salt"])
    ranked = ranked.select("doc_id", "doc_tokens", "crcs", "rest", (F.col("n0") + F.col("rn") - 1).cast("long").alias("rank"), (F.col("f0") + F.col("fn")).cast("long").alias("full_rank"))
    placed = ranked.mapInArrow(_place(slots(plan), window), "doc_id long, doc_tokens long, crcs array<long>, rest long, full_rank long, seq long, off long, size long")
    piece = placed.select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
    full = (F.col("k") + 1) * window <= F.col("doc_tokens")
    return piece.select(
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.when(full, F.lit(window)).otherwise(F.col("rest")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(full, F.lit(rest_sequences) + F.col("full_rank") + F.col("k")).otherwise(F.col("seq")).cast("long").alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("off")).cast("long").alias("offset"),
        F.when(full, F.lit(window)).otherwise(F.col("size")).cast("long").alias("sequence_size"),
    )
