"""Token ids of whole texts with the tokenizers library, with memory of frequent words.

A byte-level BPE vocabulary splits text by a fixed pattern first. No piece of that pattern spans a single space
between two other characters, but for the space at a piece's front, so ids of a text are those of its
space-separated chunks in order. Chunks and pieces seen before come from bounded dictionaries;
texts with other white space runs or special token strings go through the library whole.

Of a batch of texts, Arrow cuts and tells apart the chunks, so that each distinct one is looked up once, and the new words
go to the library's model JOINED at a time, with the space or line end between them that parts words in texts; where a
token of the vocabulary could reach over it into a word, they go one by one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of this kind of vocabulary (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MOST = 700_000
MARKS = ".,;:!?"
#: Words in one call, and chunks whose ids are laid out at once.
JOINED, SPAN = 64, 1 << 16
#: In place of a chunk's ids: its text must be encoded whole.
WHOLE = b"\xff" * 4
_ENCODERS: dict[str, Encoder] = {}


def byte_table() -> dict[int, str]:
    """Printable stand-ins for bytes: printable Latin-1 characters for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Whole(Exception):
    """This text must be encoded whole."""


class _Pieces(dict):
    def __init__(self, model):
        self.model, self.table = model, byte_table()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST:
            self.clear()
        self[piece] = out = self.make(piece)
        return out

    def make(self, piece: str) -> bytes:
        # of printable ASCII only the space has a stand-in
        shown = piece.replace(" ", self.table[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids of a chunk between spaces; front is the space before it or nothing."""

    def __init__(self, front: str, pieces: _Pieces):
        self.front, self.pieces = front, pieces
        self.head: _Chunks = self

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Whole
        if "\n" in chunk:
            a, *rest = chunk.split("\n")
            line = self.pieces["\n"]
            return self[a] + b"".join(line + self.head[x] for x in rest)
        if len(self) >= MOST:
            self.clear()
        if chunk.isalpha():  # letters are one piece
            self[chunk] = out = self.pieces.make(self.front + chunk)
            return out
        if chunk[-1] in MARKS and chunk[:-1].isalpha():  # so are they before one mark
            self[chunk] = out = self[chunk[:-1]] + self.pieces[chunk[-1]]
            return out
        self[chunk] = out = b"".join(map(self.pieces.__getitem__, PATTERN.findall(self.front + chunk)))
        return out


class _Batch:
    """Ids of chunks for many at once. A chunk that begins with a line end has that end's id first, others stand behind a space.

    Only those that one batch holds twice are remembered: most of the others never come again.
    """

    def __init__(self, pieces: _Pieces, vocabulary: dict[str, int]):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}
        self.shown = np.array([ord(pieces.table[b]) for b in range(256)], "<u2")
        byte = {c: b for b, c in pieces.table.items()}
        self.starts, self.apart = {}, {}
        for mark in " \n":
            shown = pieces.table[ord(mark)]
            self.starts[mark] = np.zeros(max(vocabulary.values()) + 1, bool)
            self.starts[mark][[i for t, i in vocabulary.items() if t.startswith(shown)]] = True
            inside = [t for t in vocabulary if shown in t[mark == " " :] and t != shown]  # a word's first token may hold the space before it
            self.apart[mark] = all(bytes(byte.get(c, 0) for c in t).decode(errors="replace").isspace() for t in inside)

    def _one(self, chunk: str) -> bytes:
        line, word = chunk[0] == "\n", chunk.removeprefix("\n")
        if not word or word[0].isspace() or word[-1].isspace():
            return WHOLE
        if line:
            return b"".join(map(self.pieces.__getitem__, ["\n", *PATTERN.findall(word)]))
        return b"".join(map(self.pieces.__getitem__, PATTERN.findall(" " + word)))

    def _letters(self, words: list[str], mark: str, made: dict[str, bytes]) -> None:
        """Make words of letters, each behind the mark."""
        if not self.apart[mark]:
            first = self.pieces["\n"] if mark == "\n" else b""
            made.update((w, first + self.pieces.make(" " + w if mark == " " else w[1:])) for w in words)
            return
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            text = "".join(some) if mark == "\n" else " " + " ".join(some)
            shown = self.shown.take(np.frombuffer(text.encode(), np.uint8)).tobytes().decode("utf-16-le")
            ids = np.array([t.id for t in self.pieces.model.tokenize(shown)], "<u4")
            at = (4 * np.flatnonzero(self.starts[mark].take(ids))).tolist()
            raw = ids.tobytes()
            made.update((w, raw[a:b]) for w, a, b in zip(some, at, [*at[1:], len(raw)], strict=True))

    def ids(self, chunks: list[str], again: list[bool]) -> list[bytes]:
        """The ids of distinct chunks, or WHOLE; again tells which to remember."""
        known = self.known
        found = list(map(known.get, chunks))
        lost = [i for i, ids in enumerate(found) if ids is None]
        made: dict[str, bytes] = {}
        words: dict[str, set[str]] = {" ": set(), "\n": set()}
        marked, others = [], []
        for c in map(chunks.__getitem__, lost):
            mark, letters = ("\n", c[1:]) if c[:1] == "\n" else (" ", c)
            if letters.isalpha():  # letters are one piece
                words[mark].add(c)
            elif letters[-1:] in MARKS and letters[:-1].isalpha():  # so are they before one mark
                marked.append(c)
                if c[:-1] not in known:
                    words[mark].add(c[:-1])
            else:
                others.append(c)
        for mark, new in words.items():
            self._letters(list(new), mark, made)
        for c in marked:
            made[c] = (made.get(c[:-1]) or known[c[:-1]]) + self.pieces[c[-1]]
        for c in others:
            made[c] = self._one(c) if c else WHOLE
        for i in lost:
            found[i] = made[chunks[i]]
        if len(known) >= MOST:
            known.clear()
        known.update((chunks[i], found[i]) for i in lost if again[i])
        return found


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        pieces = _Pieces(self.whole.model)
        self.head, self.mid = _Chunks("", pieces), _Chunks(" ", pieces)
        self.mid.head = self.head
        self.many = _Batch(pieces, self.whole.get_vocab(with_added_tokens=False))
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        try:
            if any(s in text for s in self.special):
                raise _Whole
            first, *rest = text.split(" ")
            return self.head[first] + b"".join(map(self.mid.__getitem__, rest))
        except _Whole:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id behind them, and their numbers."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts, nothing = pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string())
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # a line end stands before each text, where the end of the text before it goes, and begins a chunk wherever it is
        lines = pc.replace_substring(texts, "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), lines, nothing), " ")
        chunks = cut.flatten().dictionary_encode()
        at = chunks.indices.to_numpy()
        made = self.many.ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), (np.bincount(at) > 1).tolist())
        pool = np.frombuffer(b"".join(made), "<u4")
        size = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        n = size.take(at)
        ends, begins = np.cumsum(n), np.cumsum(size) - size
        flat = np.empty(ends[-1], "<u4")
        for k in range(0, len(at), SPAN):
            a, e = at[k : k + SPAN], ends[k : k + SPAN]
            own = n[k : k + SPAN]
            flat[e[0] - own[0] : e[-1]] = pool.take(np.repeat(begins.take(a) - e + own, own) + np.arange(e[0] - own[0], e[-1]))
        start = (ends - n)[cut.offsets.to_numpy()[:-1]]
        whole[np.searchsorted(start, np.flatnonzero(flat == np.frombuffer(WHOLE, "<u4")), side="right") - 1] = True
        flat[start] = end_id
        flat = np.append(flat[1:], np.uint32(end_id))
        sizes = np.diff(start, append=len(flat))
        if whole.any():
            parts = np.split(flat, start[1:])
            for k in np.flatnonzero(whole):
                parts[k] = np.array([*self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, end_id], "<u4")
                sizes[k] = len(parts[k])
            flat = np.concatenate(parts)
        return flat, sizes


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
