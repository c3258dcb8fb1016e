"""Token-id files: documents in ascending doc_id order, ids in independently coded blocks.

A table row holds whole documents: their ids and token counts, a payload of blocks as context_coder makes them, and the
row's token ids by falling frequency, which its blocks share. Every block is reset and checksummed, so any row can be
read alone. Spark writes the rows, which gives atomic commits and recovery of lost tasks; shard and place give the order.

Defined cases: null and empty texts hold the end id only; a doc_id's repeated rows stand side by side; an empty
table gives an empty file set; ids from 65535 on raise ValueError when written, and so does a damaged block when read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netohm.llm import context_coder
from netohm.llm.hashing import pieces
from netohm.llm.tokens import encoder
from netohm.llm.work import ship

END_ID, BLOCK, ROW, LANES = 2, 4096, 1 << 18, 2000
#: Bytes of text that are encoded together.
TEXT = 16 << 20
FILE_SCHEMA = "place long, doc_ids array<long>, n_tokens array<long>, ranked binary, block_bytes array<int>, payload binary"


def _encode(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        place = 0
        docs: list[int] = []
        sizes: list[int] = []
        buffer: list[np.ndarray] = []
        rows: list[tuple[list[int], list[int], np.ndarray]] = []
        held = in_row = 0

        def close():
            nonlocal docs, sizes, buffer, in_row
            if docs:
                rows.append((docs, sizes, np.concatenate(buffer)))
                docs, sizes, buffer, in_row = [], [], [], 0

        def flush():
            nonlocal place, rows, held
            cuts = [[ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)] for _, _, ids in rows]
            tables = [context_coder.by_frequency(ids) for _, _, ids in rows]
            coded = iter(context_coder.encode_blocks([b for c in cuts for b in c], [t for t, c in zip(tables, cuts) for _ in c]))
            packed = [[next(coded) for _ in c] for c in cuts]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(range(place, place + len(rows)), pa.int64()),
                    pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([t.astype("<u2").tobytes() for t in tables], pa.binary()),
                    pa.array([[len(x) for x in p] for p in packed], pa.list_(pa.int32())),
                    pa.array([b"".join(p) for p in packed], pa.binary()),
                ],
                names=["place", "doc_ids", "n_tokens", "ranked", "block_bytes", "payload"],
            )
            place += len(rows)
            rows, held = [], 0
            return out

        for b in (p for x in batches for p in pieces(x, most=TEXT)):
            ids, n_tokens = enc.batch(b.column("text"), end_id)
            if len(ids) and ids.max() >= context_coder.NONE:
                raise ValueError(f"ids must be below {context_coder.NONE}")
            ids, at = ids.astype(np.uint16), 0
            for i, n in zip(b.column("doc_id").to_pylist(), n_tokens.tolist()):
                if in_row + n > ROW:
                    close()
                docs.append(i)
                sizes.append(n)
                buffer.append(ids[at : at + n])
                at += n
                in_row += n
                held += n
                if held >= LANES * BLOCK:
                    close()
                    yield flush()
        close()
        if rows:
            yield flush()

    return run


def _decode(batches):
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("block_bytes")).to_numpy())
        start = 0
        while start < b.num_rows:
            # rows of LANES blocks together, one at least
            done = ends[start - 1] if start else 0
            part = b.slice(start, max(1, int(np.searchsorted(ends, done + LANES, side="right")) - start))
            start += part.num_rows
            sizes = part.column("block_bytes").to_pylist()
            blocks, tables = [], []
            for s, p, r in zip(sizes, part.column("payload"), part.column("ranked")):
                at, p, table = 0, p.as_py(), np.frombuffer(r.as_py(), "<u2")
                for n in s:
                    blocks.append(p[at : at + n])
                    tables.append(table)
                    at += n
            ids = iter(context_coder.decode_blocks(blocks, tables))
            out = []
            for shard, place, docs, n_tokens, s in zip(*(part.column(c).to_pylist() for c in ("shard", "place", "doc_ids", "n_tokens", "block_bytes"))):
                flat = np.concatenate([next(ids) for _ in s]).astype("<u4")
                at = 0
                for k, (d, n) in enumerate(zip(docs, n_tokens)):
                    out.append((shard, place, k, d, at, n, zlib.crc32(flat[at : at + n].tobytes())))
                    at += n
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "place", "k", "doc_id", "own", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, target: str, path: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write documents in ascending doc_id order; part files hold rising, disjoint ranges of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    shards = shards or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode(path, end_id), FILE_SCHEMA).withColumn("shard", F.spark_partition_id().cast("long")).write.option("compression", "none").parquet(target)


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document."""
    ship(spark)
    files = spark.read.schema(FILE_SCHEMA + ", shard long").parquet(target)
    sizes = files.select("shard", "place", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shard = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shard = shard.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.select("shard", "place", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("row_start")).join(shard, "shard")
    docs = files.select("shard", "place", "doc_ids", "n_tokens", "ranked", "block_bytes", "payload").mapInArrow(
        _decode, "shard long, place long, k long, doc_id long, own long, n_tokens long, ids_crc32 long"
    )
    return docs.join(rows, ["shard", "place"]).select("doc_id", (F.col("shard_start") + F.col("row_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
