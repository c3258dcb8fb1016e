"""Token counts of whole texts without their ids: each distinct pre-token is counted once.

A byte-level BPE vocabulary splits text by a fixed pattern first, and no token spans two pre-tokens. So the count of a text
is the sum over its pre-tokens of frequency times tokens. One pass gathers the distinct pre-tokens of all texts with their
frequencies, and the library's model splits each of them once. A second pass makes each document's own frequencies and
joins them to those counts: the `head` most frequent pre-tokens, which hold most of all occurrences and every hot key, are
broadcast (at most HEAD keys of 65 bytes), all others meet their counts in a shuffled join. Pre-tokens of over 64 bytes go by their SHA-256.

Strings of special tokens inside a text are one token each and end the pre-tokens beside them, as is the library's default.

Defined cases: null and empty texts have no bytes and no tokens; rows that repeat a doc_id are counted each by its own text;
equal rows give equal rows; an empty table gives no rows; extra columns are ignored. Files of other kinds than byte-level
BPE without a normaliser raise an error.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from operator import mul
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm import hashing as H
from netohm.llm.tokens import PATTERN, byte_table, encoder
from netohm.llm.work import ship, written

LIMIT = 1024
#: Pre-tokens that are broadcast, and the bytes above which a digest stands for one.
HEAD, LONG = 200_000, 64
#: Distinct strings that a task holds before it hands its frequencies on.
MOST = 300_000
#: Chunks whose tokens a task remembers.
MEMO = 700_000


def key_of(piece: str) -> str:
    """The pre-token, or the digest of a long one, which no pre-token of up to LONG bytes equals."""
    if len(piece) * 4 <= LONG or len(b := piece.encode()) <= LONG:
        return piece
    return "#" + hashlib.sha256(b).hexdigest()


class Splitter:
    """Texts as pre-tokens, or as chunks between single spaces that are split into pre-tokens once for each distinct chunk."""

    def __init__(self, special: tuple[str, ...]):
        longest = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if special else None
        self.good: set[str] = set()  # chunks without white space at their ends

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and the number of those."""
        parts = self.special.split(text) if self.special else [text]
        return [p for p in parts if p], len(parts) - 1

    def pieces(self, part: str) -> tuple[list[str], list[str]]:
        """(pre-tokens, chunks) of a stretch: chunks stand for what follows a space, the front for itself. White space beside a space is for the pattern to divide, in whole."""
        first, *rest = part.split(" ")
        if not self.good.issuperset(rest):
            if len(self.good) >= MEMO:
                self.good.clear()
            for c in set(rest) - self.good:
                if not c or c[0].isspace() or c[-1].isspace():
                    return PATTERN.findall(part), []
                self.good.add(c)
        return (PATTERN.findall(part), []) if first[-1:].isspace() else (PATTERN.findall(first), rest)


def of_chunk(chunk: str) -> list[str]:
    """The pre-tokens of a chunk and the space before it."""
    if chunk.isalpha():  # letters are one
        return [" " + chunk]
    if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return PATTERN.findall(" " + chunk)


def _special(path: str) -> tuple[str, ...]:
    """Strings of special tokens; an error for a vocabulary that pre-tokens don't cut."""
    conf = json.loads(Path(path).read_text())
    cut = conf.get("pre_tokenizer") or {}
    if conf["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or conf.get("normalizer"):
        raise ValueError(f"{path} is no byte-level BPE without normaliser")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take in what stands beside them")
    return tuple(t["content"] for t in conf["added_tokens"])


def _gathered(special: tuple[str, ...]):
    """Frequencies of keys by task; piece is null where it is the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, alone, chunks = Splitter(special), Counter(), Counter()

        def rows():
            for c, f in chunks.items():
                for p in of_chunk(c):
                    alone[p] += f
            keys = [key_of(p) for p in alone]
            pieces = [None if k == p else p for k, p in zip(keys, alone)]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pieces, pa.string()), pa.array(alone.values(), pa.int64())], names=["key", "piece", "n"])
            alone.clear()
            chunks.clear()
            return out

        for batch in batches:
            for b in H.pieces(batch):
                for text in b.column("text").to_pylist():
                    for part in splitter.parts(text or "")[0]:
                        own, rest = splitter.pieces(part)
                        alone.update(own)
                        chunks.update(rest)
                if len(alone) + len(chunks) >= MOST:
                    yield rows()
        if alone or chunks:
            yield rows()

    return run


def _counted(path: str):
    """Tokens of each distinct pre-token by the library's model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = encoder(path).whole.model, byte_table()
        for b in batches:
            shown = (x.encode().decode("latin-1").translate(table) for x in b.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array([len(model.tokenize(x)) for x in shown], pa.int64())], names=["key", "n", "tokens"])

    return run


class _Costs(dict):
    """Tokens of a chunk in broadcast pre-tokens; rest has the others of chunks that hold some."""

    def __init__(self, known: dict[str, int]):
        self.known, self.rest = known, {}

    def bound(self) -> None:
        """Between texts: forget chunks where there are too many."""
        if len(self) >= MEMO:
            self.clear()
            self.rest.clear()

    def of(self, pieces: list[str]) -> tuple[int, list[str]]:
        total, others = 0, []
        for p in pieces:
            n = self.known.get(p)
            if n is None and len(p) * 4 > LONG:
                p = key_of(p)
                n = self.known.get(p)
            if n is None:
                others.append(p)
            else:
                total += n
        return total, others

    def __missing__(self, chunk: str) -> int:
        total, others = self.of(of_chunk(chunk))
        self[chunk] = total
        if others:
            self.rest[chunk] = others
        return total


def _met(special: tuple[str, ...], head):
    """Each document's tokens in broadcast pre-tokens, and the frequencies of its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, costs = Splitter(special), _Costs(head.value)
        for batch in batches:
            for b in H.pieces(batch):
                tokens, keys, freqs, sizes = [], [], [], []
                for text in b.column("text").to_pylist():
                    costs.bound()
                    parts, total = splitter.parts(text or "")
                    others: dict[str, int] = {}
                    for part in parts:
                        own, rest = splitter.pieces(part)
                        more, left = costs.of(own)
                        chunks = Counter(rest)
                        total += more + sum(map(mul, map(costs.__getitem__, chunks), chunks.values()))
                        for k in left:
                            others[k] = others.get(k, 0) + 1
                        for c in [c for c in chunks if c in costs.rest]:
                            for k in costs.rest[c]:
                                others[k] = others.get(k, 0) + chunks[c]
                    tokens.append(total)
                    keys += others
                    freqs += others.values()
                    sizes.append(len(others))
                rest = [H.lists(keys, sizes, pa.string()), H.lists(freqs, sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), b.column("n_bytes"), pa.array(tokens, pa.int64()), *rest], names=["doc_id", "t", "n_bytes", "tokens", "keys", "freqs"])

    return run


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """key, n, tokens: every distinct pre-token of the texts with its frequency and its tokens."""
    ship(docs.sparkSession)
    found = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(_gathered(_special(path)), "key string, piece string, n long")
    each = found.groupBy("key").agg(F.coalesce(F.max("piece"), F.col("key")).alias("piece"), F.sum("n").alias("n"))
    return written(each.select("key", "piece", "n").mapInArrow(_counted(path), "key string, n long, tokens long"), "pieces")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document by the byte-level BPE file at path."""
    spark = docs.sparkSession
    counts = piece_counts(docs, path)
    top = counts.orderBy(F.desc("n"), "key").limit(head).select("key", "tokens").toArrow()  # at most `head` rows
    known = spark.sparkContext.broadcast(dict(zip(top.column("key").to_pylist(), top.column("tokens").to_pylist())))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    met = written(texts.mapInArrow(_met(_special(path), known), f"doc_id {kind}, t long, n_bytes long, tokens long, keys array<string>, freqs array<long>"), "met")
    others = met.where(F.size("keys") > 0).select("doc_id", "t", F.posexplode(F.arrays_zip("keys", "freqs")).alias("k", "x")).select("doc_id", "t", "k", F.col("x.keys").alias("key"), "x.freqs")
    # equal rows count together here, each with its own pre-token 0
    sums = others.join(counts.select("key", F.col("tokens").alias("each")), "key").groupBy("doc_id", "t").agg((F.sum(F.col("freqs") * F.col("each")) / F.count_if(F.col("k") == 0)).cast("long").alias("more"))
    sums = sums.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), "more")
    # a null doc_id is an id like any other here
    rows = met.select("doc_id", "t", "n_bytes", "tokens").join(sums, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("t") == F.col("__t")), "left")
    n = F.col("tokens") + F.coalesce("more", F.lit(0))
    return rows.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
