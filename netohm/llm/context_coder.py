"""Adaptive context-mixing range coder for token ids, run over many blocks at once.

Ids are coded as ranks in a table of ids by falling frequency (`by_frequency`), which a block brings with it or shares
with others. Each block starts with a reset model and carries a checksum. Three orders predict the next rank: a table of
the rank that last followed the two ranks before (order 2), one of the rank that last followed the rank before (order 1),
and adaptive counts of classes of ranks (order 0). A rank is coded as one of EVENTS: the order-2 guess holds, the order-1
guess holds, or its class, with its place in it; classes hold 1 to 2**15 ranks, two or more of them an octave below 4096.

The event's distribution mixes three adaptive count vectors: one for the block, one chosen by how well the order-1
guess at this context has done, one by the order-2 guess. Counts add up, so a context weighs more as it learns more;
they are held as running sums, which is how coding reads them.

The range has 48 bits and leaves in 16-bit words; a word's carry is added to the words before it at the end. Numbers
are whole and below 2**53, so doubles hold them exactly. Blocks are lanes of numpy arrays: step t codes id t of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR4"
HEAD = struct.Struct("<4sIIII")
STATES = 4
SIZES = [1] * 4 + [1 << k - 1 for k in range(2, 12) for _ in range(2)] + [1 << k for k in range(12, 16)]
EVENTS, WIDTH = 2 + len(SIZES), 32
ROWS = 1 + 2 * STATES
TABLE1, TABLE2 = 1 << 10, 1 << 11
GAIN, LIMIT, REFRESH = 24, 1 << 12, 16
#: Steps whose ranks are laid out together.
SPAN = 128
#: While a range is below BOT, 16 bits leave. A rank takes two words at most: 14 bits of counts, 15 within the class.
FULL, BOT, WORD = float(1 << 48), float(1 << 32), float(1 << 16)
NONE = 65535

#: Of an event: its first rank, and one over the number of its ranks. Of a rank: its event, and its place there.
FIRST = np.array([0, 0, *np.cumsum([0, *SIZES[:-1]]), *[0] * (WIDTH - EVENTS)]).astype(np.uint16)
SHARE = 1 / np.array([1.0, 1.0, *SIZES])
EVENT = np.repeat(np.arange(2, EVENTS), SIZES).astype(np.uint8)
PLACE = (np.arange(len(EVENT)) - FIRST[EVENT]).astype(np.uint16)
#: Running sums of one count for each event, and what an event adds to them.
START = np.minimum(np.arange(WIDTH), EVENTS).astype(np.uint16)
STEP = (np.arange(WIDTH) > np.arange(EVENTS)[:, None]).astype(np.uint16) * np.uint16(GAIN)
#: A context's trust after a guess that failed, and after one that held.
NEXT = np.array([s >> 1 for s in range(STATES)] + [min(s + 1, STATES - 1) for s in range(STATES)], np.uint32) << 16
BYTES = np.uint64(0x0101010101010101)


def by_frequency(ids: np.ndarray) -> np.ndarray:
    """The distinct ids by falling frequency."""
    n = np.bincount(ids, minlength=1)
    order = np.argsort(-n, kind="stable")
    return order[: np.count_nonzero(n)].astype(np.uint16)


class _Model:
    """State of n blocks; row 0 of a pair is order 1, row 1 order 2."""

    def __init__(self, n: int):
        lane = np.arange(n)
        slots = TABLE1 + TABLE2
        self.slot = np.full(n * slots, NONE, np.uint32)  # the guess, and trust in the bits above it
        self.base = np.stack([lane * slots, lane * slots + TABLE1])
        self.at, self.last = self.base.copy(), np.zeros(n, np.int64)
        self.row = np.stack([lane * ROWS, lane * ROWS + 1, lane * ROWS + 1 + STATES])
        self.sums = np.tile(START, (n * ROWS, 1))
        self.whole = self.sums.view(f"V{2 * WIDTH}").reshape(-1)  # a row as one item: faster to write back
        self.cell = lane * WIDTH
        self.step = 0

    def look(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of both orders, mixed running sums, and their totals."""
        slot = self.slot.take(self.at[:, :m])
        self.guessed, self.trusted = slot.astype(np.uint16), slot >> 16
        self.rows = self.row[:, :m].copy()
        self.rows[1:] += self.trusted
        self.three = self.sums.take(self.rows, axis=0)
        mixed = self.three[0] + self.three[1]
        mixed += self.three[2]
        return self.guessed, mixed, mixed[:, -1].astype(np.float64)

    def learn(self, m: int, ranks: np.ndarray, event: np.ndarray) -> None:
        self.three += STEP.take(event, axis=0)
        np.put(self.whole, self.rows, self.three.view(self.whole.dtype), mode="clip")
        held = (self.guessed == ranks).view(np.uint8)
        held <<= 2
        self.slot[self.at[:, :m]] = NEXT.take(held | self.trusted) | ranks
        ranks = ranks.astype(np.int64)
        np.add(self.base[0, :m], ranks & (TABLE1 - 1), out=self.at[0, :m])
        np.add(self.base[1, :m], (ranks + self.last[:m]) & (TABLE2 - 1), out=self.at[1, :m])
        np.multiply(ranks, 613, out=self.last[:m])
        self.step += 1
        if self.step % REFRESH == 0:
            heavy = np.flatnonzero(self.sums[:, -1] > LIMIT)
            if len(heavy):
                self.sums[heavy] = (self.sums.take(heavy, axis=0) - START >> 1) + START


def encode_blocks(blocks: list[np.ndarray], tables: list[np.ndarray] | None = None) -> list[bytes]:
    """Each block of ids below 65535 as bytes: magic, numbers of ids, checksum, numbers of its own table and of words, that table, words.

    tables has a table for each block, which must then be given to decode_blocks too; without it each block brings its own.
    """
    if not blocks:
        return []
    if any(len(b) and int(np.max(b)) >= NONE for b in blocks):
        raise ValueError("ids must be below 65535")
    own = [by_frequency(b) for b in blocks] if tables is None else []
    rank, ranks, known = np.zeros(NONE, np.uint16), [], None
    for b, table in zip(blocks, tables or own):
        if table is not known:
            rank[table], known = np.arange(len(table)), table
        ranks.append(rank.take(b))
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    size = np.array([len(blocks[i]) for i in order])
    n, longest = len(order), int(size[0])
    model = _Model(n)
    low, span = np.zeros(n), np.full(n, FULL)
    room = longest * 2 + 8
    words, begin = np.zeros((n, room), np.uint32), np.arange(n) * room
    flat, end = words.reshape(-1), begin.copy()

    def emit(act):
        word = np.floor(low[act] / BOT)
        flat[end[act]] = word
        end[act] += 1
        low[act] = (low[act] - word * BOT) * WORD

    live = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        m = int(live[t])
        if t % SPAN == 0:
            some = np.zeros((SPAN, n), np.uint16)
            for j, i in enumerate(order[:m]):
                part = ranks[i][t : t + SPAN]
                some[: len(part), j] = part
        x = some[t % SPAN, :m]
        (one, two), mixed, total = model.look(m)
        event, place = EVENT.take(x), PLACE.take(x)
        first, second = one == x, two == x
        np.putmask(event, first, 1)
        np.putmask(event, second, 0)
        np.putmask(place, first | second, 0)
        at = model.cell[:m] + event
        mixed = mixed.reshape(-1)
        bottom = mixed.take(at).astype(np.float64)
        at += 1
        top = mixed.take(at).astype(np.float64)
        lo, sp = low[:m], span[:m]
        r = np.floor(sp / total)
        top -= bottom
        top *= r
        top *= SHARE.take(event)
        np.floor(top, out=sp)
        bottom *= r
        lo += bottom
        lo += sp * place
        # one word leaves where it must, without a selection; few ranks need a second
        word = np.floor(lo * (1 / BOT))
        full = sp < BOT
        flat[end[:m]] = word
        end[:m] += full
        word *= full
        word *= BOT
        lo -= word
        shift = full * (WORD - 1)
        shift += 1
        lo *= shift
        sp *= shift
        act = np.flatnonzero(sp < BOT)
        if len(act):
            emit(act)
            sp[act] *= WORD
        model.learn(m, x, event)
    for _ in range(3):
        emit(np.arange(n))
    fill = end - begin
    words = words[:, : int(fill.max())]
    while len(act := np.flatnonzero((words >> 16).any(axis=1))):
        carry = words[act] >> 16
        words[act] &= 0xFFFF
        words[act, :-1] += carry[:, 1:]
    out: list[bytes] = [b""] * n
    for j, i in enumerate(order):
        table = own[i].astype("<u2").tobytes() if own else b""
        out[i] = HEAD.pack(MAGIC, size[j], zlib.crc32(blocks[i].astype("<u4").tobytes()), len(table) // 2, fill[j]) + table + words[j, : fill[j]].astype("<u2").tobytes()
    return out


def decode_blocks(coded: list[bytes], tables: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The ids of each block; a damaged block raises ValueError."""
    if not coded:
        return []
    if any(len(c) < HEAD.size for c in coded):
        raise ValueError("not a block of this format")
    heads = [HEAD.unpack_from(c) for c in coded]
    if any(h[0] != MAGIC or len(c) != HEAD.size + 2 * (h[3] + h[4]) or not 3 <= h[4] <= 2 * h[1] + 3 for h, c in zip(heads, coded)):
        raise ValueError("not a block of this format")
    tables = tables or [np.frombuffer(c, "<u2", h[3], HEAD.size) for h, c in zip(heads, coded)]
    order = np.argsort([-h[1] for h in heads], kind="stable")
    size = np.array([heads[i][1] for i in order])
    n, longest = len(order), int(size[0])
    most = max(h[4] for h in heads) + 2
    words = np.zeros((n, most), np.uint16)
    for j, i in enumerate(order):
        words[j, : heads[i][4]] = np.frombuffer(coded[i], "<u2", heads[i][4], HEAD.size + 2 * heads[i][3])
    ranks = np.zeros((n, longest), np.uint16)
    model = _Model(n)
    w = words[:, :3].astype(np.float64)
    code, span, at = (w[:, 0] * WORD + w[:, 1]) * WORD + w[:, 2], np.full(n, FULL), np.arange(n) * most + 3
    flat = words.reshape(-1)
    first = np.tile(FIRST, (n, 1))
    live = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        m = int(live[t])
        (one, two), mixed, total = model.look(m)
        co, sp = code[:m], span[:m]
        r = np.floor(sp / total)
        value = np.minimum(np.floor(co / r), total - 1).astype(np.uint16)
        below = (mixed <= value[:, None]).view(np.uint64)  # eight answers of 0 or 1 an item
        event = below[:, 0] + below[:, 1]
        event += below[:, 2]
        event += below[:, 3]
        event *= BYTES
        event >>= np.uint64(56)
        event = event.view(np.int64)
        event -= 1
        i, mixed = model.cell[:m] + event, mixed.reshape(-1)
        first[:m, 0], first[:m, 1] = two, one
        x = first.reshape(-1).take(i)
        bottom = mixed.take(i).astype(np.float64)
        i += 1
        top = mixed.take(i).astype(np.float64)
        share = SHARE.take(event)
        top -= bottom
        top *= r
        top *= share
        np.floor(top, out=sp)
        bottom *= r
        co -= bottom
        place = np.minimum(np.floor(co / sp), 1 / share - 1)
        co -= place * sp
        x += place.astype(np.uint16)
        ranks[:m, t] = x
        full = sp < BOT
        shift = full * (WORD - 1)
        shift += 1
        sp *= shift
        co *= shift
        co += flat.take(at[:m], mode="clip") * full
        at[:m] += full
        act = np.flatnonzero(sp < BOT)
        if len(act):
            code[act] = code[act] * WORD + flat.take(at[act], mode="clip")
            at[act] += 1
            sp[act] *= WORD
        model.learn(m, x, event)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * n
    for j, i in enumerate(order):
        out[i] = tables[i].take(ranks[j, : size[j]], mode="clip") if size[j] and len(tables[i]) else np.zeros(size[j], np.uint16)
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][2]:
            raise ValueError("a block's checksum does not match")
    return out
