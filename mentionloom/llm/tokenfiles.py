"""Token files: ids of documents, coded by an adaptive context-mixing range coder in independent, checksummed blocks.

A block starts with an empty model. Three orders predict each id: order 2 and order 1 the id that followed last after the
two ids or the one id before, order 0 all ids of the block so far, each by its count. The probability of an id is the sum
of what the orders give to it, by shares that are learnt for every state of the predictions (how often each has held in a
row, and whether they agree); the rest of the interval spells ids out that are new in the block. Counts and shares are
renewed as a block grows. An arithmetic coder with carries narrows the interval and gives off 32 bits at a time. The blocks of
a segment are coded side by side, one step of all of them at a time, so that every step is a few array operations.

File: segments, one after the other. Segment: "<4s5I" magic, documents, ids, block length, blocks, index bytes, and the
crc32 of these; the index (zlib: null mask, document ids as int64, counts as uint32) and its crc32; "<II" a block (16-bit
words of its code, low one of two first, crc32 of its ids as little-endian uint16) and the crc32 of them all; then the words
of all blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionloom.llm.common import input_bytes, mix64, shared_dir, small_batches, written

MAGIC, HEAD, CRC = b"MLT3", struct.Struct("<4s5I"), struct.Struct("<I")
#: Ids of a block at most, and blocks that are coded side by side; a segment holds no more.
BLOCK, LANES = 1024, 2048
#: Slots of the order-2 and order-1 tables of a block.
SLOTS = 1024
#: The order-0 counts and the shares are renewed after so many ids of a block.
RENEW = (16, 32, 64, 128, 256, 512)
#: Most times in a row that count, and weight of an outcome that happened.
SURE, STEP = 3, 16
#: The interval is cut into 2 ** TOTAL parts; shares are multiples of 2 ** ID_BITS parts, and add up to all of them.
TOTAL, ID_BITS = 30, 16
SHARES = 1 << (TOTAL - ID_BITS)
#: Intervals have 62 bits; those that get narrower than SMALL give off 32.
WINDOW, SMALL = (1 << 62) - 1, 1 << 30
#: Bytes of texts that are encoded at once, about.
TEXTS = 6 << 20
#: Blocks that are looked at together, so that what is known of them stays near the processor.
NEAR = 128
#: Stands for no id in the tables of a block.
NOTHING = 1 << 16


class Shares:
    """How order 2, order 1, order 0 and ids that are new share the interval, by block and state of the predictions."""

    def __init__(self, lanes: int):
        two, one, same = np.arange(32) >> 3, (np.arange(32) >> 1) & 3, np.arange(32) & 1
        self.start = np.tile(np.stack([8 * two, 4 * one * (1 - same), np.full(32, 8), np.full(32, 4)], 1), (lanes, 1))
        self.seen = np.zeros((lanes * 32, 4), np.int64)
        self.renew(np.zeros(0, np.int64), 0)

    def renew(self, happened: np.ndarray, history: int) -> None:
        """``happened``: (block * 32 + state) * 4 + outcome of the ids since the last renewal, an outcome being the first
        that knew the id; ``history``: number of ids that order 0 counts. ``packed``: four shares of 16 bits."""
        self.seen += np.bincount(happened, minlength=self.seen.size).reshape(self.seen.shape)
        counts = (self.start + STEP * self.seen).astype(np.int32)
        by = counts.T
        total = by[0] + by[1] + by[2] + by[3]
        # a share that may be needed isn't nothing; new ids have what is left over by rounding
        two, one, known = ((c * np.int32(SHARES - 4) / total).astype(np.int64) + some for c, some in zip(by[:3], (self.start.T > 0)[:3], strict=True))
        if not history:
            known[:] = 0
        self.packed = (two << 48) | (one << 32) | (known << 16) | (SHARES - two - one - known)


def _history(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every id (a row a block) its run when the ids of its block are sorted: start and length in one number,
    place * 1024 + count, by position; and as sorted, below the id itself, id << 32."""
    lanes, length = ids.shape
    order = np.argsort(ids.astype(np.uint16), axis=1, kind="stable").astype(np.int32)
    order += (np.arange(lanes, dtype=np.int32) * length)[:, None]
    order = order.ravel()
    x = ids.ravel().take(order)
    new = np.empty(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[::length] = True
    starts = np.flatnonzero(new).astype(np.int32)
    runs = (starts % np.int32(length) << 10) + np.diff(starts, append=np.int32(len(x)))
    run = runs.take(np.cumsum(new, dtype=np.int32) - 1)
    out = np.empty(len(x), np.int32)
    out[order] = run
    return out.reshape(ids.shape), (x.astype(np.int64) << 32) | run


def _histories(ids: np.ndarray, begins: list[int]) -> dict[int, np.ndarray]:
    """By beginning of a period: of every id up to the period's end its run among the ids before the period, when these
    are sorted, as in ``_history``. One sort serves all periods."""
    lanes, length = ids.shape
    order = np.argsort(ids.astype(np.uint16), axis=1, kind="stable").astype(np.int32)
    order += (np.arange(lanes, dtype=np.int32) * length)[:, None]
    order, found = order.ravel(), {}
    place = order % np.int32(length)
    for begin, end in zip(reversed(begins), [length, *reversed(begins)], strict=False):
        if end < length:
            some = np.flatnonzero(place < end)
            order, place = order.take(some), place.take(some)
        x = ids.ravel().take(order)
        new = np.empty(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        new[::end] = True
        starts = np.flatnonzero(new)
        upto = np.cumsum(place < begin, dtype=np.int32)
        before = np.append(0, upto)[starts].astype(np.int32)
        count = np.diff(before, append=upto[-1])
        before -= (starts // end * begin).astype(np.int32)
        run = ((before << 10) + count).take(np.cumsum(new, dtype=np.int32) - 1)
        out = np.empty(lanes * length, np.int32) if end == length else np.zeros(lanes * length, np.int32)
        out[order] = run
        found[begin] = out.reshape(ids.shape)
    return found


def _slots(before1: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = before1 * 40503
    return (a >> 3) & (SLOTS - 1), ((a + before2 * 60493) >> 2) & (SLOTS - 1)


def _followed(slot: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an order's table says before each id, for all blocks at once (a row a block): the place of the id that
    followed last in the same slot, counted over all blocks, and how often it has held in a row, 1 to SURE (0: none)."""
    lanes, length = ids.shape
    # narrow numbers, row by row: a sort in linear time
    order = np.argsort(slot.astype(np.uint16), axis=1, kind="stable").astype(np.int32)
    order += (np.arange(lanes, dtype=np.int32) * length)[:, None]
    order = order.ravel()
    k, x = slot.ravel().take(order), ids.ravel().take(order)
    again = np.empty(len(k), bool)
    again[0] = False
    np.equal(k[1:], k[:-1], out=again[1:])
    again[::length] = False
    hit = np.zeros(len(k), bool)
    np.logical_and(again[1:], x[1:] == x[:-1], out=hit[1:])
    # ids in a row that were as said, up to SURE with the one that is kept
    sure, held = np.ones(len(k), np.int8), hit.copy()
    for _ in range(SURE - 1):
        sure += held
        held[1:] = hit[1:] & held[:-1]
    said = np.zeros(len(k), np.int32)
    said[1:] = (order[:-1] << 2) + sure[:-1]
    said *= again
    out = np.empty(len(k), np.int32)
    out[order] = said
    return (out >> 2).reshape(ids.shape), (out & 3).reshape(ids.shape)


def _periods(block: int) -> list[tuple[int, int]]:
    edges = [0, *[r for r in RENEW if r < block], block]
    return list(zip(edges, edges[1:], strict=False))


def _active(total: int, block: int) -> tuple[int, int]:
    """Number of blocks, and ids of the last one; the others are full."""
    blocks = -(-total // block)
    return blocks, total - (blocks - 1) * block if blocks else 0


def _parts(known: np.ndarray, rest: int, starts: np.ndarray, lengths: np.ndarray) -> None:
    """What the model says of all ids of some blocks (a row a block, of which the last one has ``rest`` ids): where each
    starts in the interval and how long it is, into a column a block."""
    blocks, block = known.shape
    before1, before2 = np.zeros_like(known), np.zeros_like(known)
    before1[:, 1:], before2[:, 2:] = known[:, :-1], known[:, :-2]
    slot1, slot2 = _slots(before1, before2)
    (at1, sure1), (at2, sure2) = _followed(slot1, known), _followed(slot2, known)
    shares, lane32 = Shares(blocks), (np.arange(blocks, dtype=np.int32) << 5)[:, None]
    histories = _histories(known, [begin for begin, _ in _periods(block)[1:]])
    for begin, end in _periods(block):
        span, log = np.s_[:, begin:end], max(0, begin.bit_length() - 1)
        x, s1, s2 = known[span], sure1[span], sure2[span]
        i1, i2 = at1[span], at2[span]
        p1, p2 = known.ravel().take(i1), known.ravel().take(i2)
        two = s2 > 0
        same = (p1 == p2) & two & (s1 > 0)
        one = (s1 > 0) & ~same
        state = (s2 << 3) + (s1 << 1) + same + lane32
        share = shares.packed.take(state)
        w2, w1, w0, new = ((share >> k).astype(np.int32) & 0xFFFF for k in (48, 32, 16, 0))
        w2 <<= ID_BITS
        w1 <<= ID_BITS
        each = (w0 << ID_BITS) >> log
        if begin:
            upto = histories.pop(begin)
            run, n1, n2 = upto[span], upto.ravel().take(i1) & 1023, upto.ravel().take(i2) & 1023
            n1 *= one
            n2 *= two
            first, count = run >> 10, run & 1023
            w2 += each * n2
            w1 += each * n1
            first -= n2 * (p2 < x)
            first -= n1 * (p1 < x)
        else:
            first = count = np.zeros_like(x)
        # later answers overwrite earlier ones: spelt out, order 0, order 1, order 2
        start, length, outcome = (1 << TOTAL) + new * (x - (1 << ID_BITS)), new, np.full(x.shape, 3, np.int32)
        for k, holds, at, parts in ((2, count > 0, w2 + w1 + each * first, each * count), (1, one & (p1 == x), w2, w1), (0, two & (p2 == x), 0, w2)):
            mask = -holds.astype(np.int32)
            start ^= (start ^ at) & mask
            length ^= (length ^ parts) & mask
            outcome ^= (outcome ^ k) & mask
        starts[begin:end], lengths[begin:end] = start.T, length.T
        if end < block:
            happened = (state << 2) + outcome
            if end > rest:
                happened[-1, max(0, rest - begin) :] = ((blocks - 1) * 32 << 2) + 3  # never read: the last block ends before
            shares.renew(happened.ravel(), end)


def encode_blocks(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of every block, one block after the other, and their number by block. The model's view of all ids is
    worked out for whole blocks at once; only the narrowing of the intervals goes step by step."""
    blocks, rest = _active(len(ids), block)
    if not blocks:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    known = np.zeros((blocks, block), np.int32)
    known.reshape(-1)[: len(ids)] = ids
    start, length = np.empty((block, blocks), np.int32), np.empty((block, blocks), np.int32)
    for k in range(0, blocks, NEAR):
        some = np.s_[k : k + NEAR]
        _parts(known[some], rest if k + NEAR >= blocks else block, start[:, some], length[:, some])
    low, width = np.zeros(blocks, np.int64), np.full(blocks, WINDOW, np.int64)
    out_lane, out_word = [], []
    for t in range(block):
        n = blocks if t < rest else blocks - 1
        if not n:
            break
        a, w = low[:n], width[:n]
        r = w >> TOTAL
        a += r * start[t, :n]
        np.multiply(r, length[t, :n], out=w)
        go = np.flatnonzero(w < SMALL)
        if len(go):
            now = a.take(go)
            out_lane.append(go.astype(np.uint16)), out_word.append(now >> TOTAL)
            a[go], w[go] = (now & (SMALL - 1)) << 32, w.take(go) << 32
    every = np.arange(blocks, dtype=np.uint16)
    lane = np.concatenate([*out_lane, every, every])
    words = np.concatenate([*out_word, low >> TOTAL, (low & (SMALL - 1)) << 2])[np.argsort(lane, kind="stable")]
    # sums that outgrew their word carry into the one before; a block's first never does
    while len(over := np.flatnonzero(words >> 32)):
        words[over] &= 0xFFFFFFFF
        words[over - 1] += 1
    return words.astype("<u4").view("<u2"), 2 * np.bincount(lane, minlength=blocks)


def decode_blocks(words: np.ndarray, sizes: np.ndarray, total: int, block: int) -> np.ndarray:
    """The ids of all blocks of a segment, one step of all blocks at a time."""
    blocks, rest = _active(total, block)
    if not blocks:
        return np.zeros(0, np.uint16)
    words = np.append(np.ascontiguousarray(words, "<u2").view("<u4"), np.zeros(2, np.uint32)).astype(np.int64)
    at = (np.cumsum(sizes) - sizes) // 2
    # the window isn't a multiple of 32 bits: two bits of each word come with the next one
    late = ((words[:-1] & 3) << 30) | (words[1:] >> 2)
    code = (words.take(at, mode="clip") << 30) | (words.take(at + 1, mode="clip") >> 2)
    at += 1
    width = np.full(blocks, WINDOW, np.int64)
    # entries of the tables: the id's step in the block, the id, how often it has held; NOTHING is no id, with no run
    lane = np.arange(blocks, dtype=np.int32)
    one, two = np.full(blocks * SLOTS, (block << 19) | (NOTHING << 2), np.int32), np.full(blocks * SLOTS, (block << 19) | ((NOTHING + 1) << 2), np.int32)
    base, lane32 = lane * SLOTS, lane << 5
    hist, run, shares = np.zeros((block + 2, blocks), np.int32), np.zeros((block + 1) * blocks, np.int32), Shares(blocks)
    for begin, end in _periods(block):
        log = max(0, begin.bit_length() - 1)
        if begin:
            past, by_rank, first_of = hist[2 : begin + 2], np.empty(begin * blocks, np.int64), lane * begin
            for k in range(0, blocks, NEAR):
                some = np.s_[k : k + NEAR]
                by_place, by_rank[k * begin : (k + NEAR) * begin] = _history(np.ascontiguousarray(past[:, some].T))
                run[: begin * blocks].reshape(begin, blocks)[:, some] = by_place.T
        happened = np.zeros((end - begin, blocks), np.int32)
        for t in range(begin, end):
            n = blocks if t < rest else blocks - 1
            if not n:
                break
            # two rows of zeros stand before the first id
            at1, at2 = _slots(hist[t + 1, :n], hist[t, :n])
            at1 += base[:n]
            at2 += base[:n]
            e1, e2 = one.take(at1), two.take(at2)
            p1, p2 = (e1 >> 2) & 0x1FFFF, (e2 >> 2) & 0x1FFFF
            c1, c2 = e1 & 3, e2 & 3
            same = p1 == p2
            state = (((c2 << 2) + c1) << 1) + same + lane32[:n]
            share = shares.packed.take(state)
            e1 >>= 19
            e1 *= blocks
            e1 += lane[:n]
            e2 >>= 19
            e2 *= blocks
            e2 += lane[:n]
            r1, r2 = run.take(e1), run.take(e2)
            n1, n2 = (r1 & 1023) * ~same, r2 & 1023
            new = share.astype(np.int32)
            each = (new & -65536) >> log
            new &= 0xFFFF
            share >>= 16
            upto2 = (share >> 16).astype(np.int32) & -65536
            only1 = share.astype(np.int32) & -65536
            upto2 += each * n2
            only1 += each * n1
            w, v = width[:n], code[:n]
            r = w >> TOTAL
            # what lies beyond all parts is damage
            u = np.minimum(v // r, (1 << TOTAL) - 1).astype(np.int32)
            upto1 = upto2 + only1
            over = u - upto1
            # all bits set where order 2, order 2 or 1, or any order has known the id
            by2, by1 = (u - upto2) >> 31, over >> 31
            room = each * (begin - n1 - n2)
            beyond = over - room
            known = beyond >> 31
            # quotients of numbers below 2 ** 30 are exact as doubles
            x = np.minimum(beyond / new, 0xFFFF).astype(np.int32)
            add, length = (upto1 + room) + new * x, new
            ran = np.zeros(n, np.int32)
            if begin:
                rank = (over / each).astype(np.int32)
                # the places of what the other orders have said are left out
                f1, f2 = r1 >> 10, r2 >> 10
                swap = (p2 - p1) >> 31
                flip, turn = (n1 ^ n2) & swap, (f1 ^ f2) & swap
                place = rank + (n1 ^ flip) * (rank >= (f1 ^ turn))
                place += (n2 ^ flip) * (place >= (f2 ^ turn))
                got = by_rank.take(first_of[:n] + place, mode="clip")
                ran = got.astype(np.int32) & known & ~by1
                x ^= (x ^ (got >> 32).astype(np.int32)) & known
                add ^= (add ^ (upto1 + each * ((ran >> 10) - (place - rank)))) & known
                length ^= (length ^ (each * (ran & 1023))) & known
            x ^= (x ^ p1) & by1
            add ^= (add ^ upto2) & by1
            length ^= (length ^ only1) & by1
            x ^= (x ^ p2) & by2
            add &= ~by2
            length ^= (length ^ upto2) & by2
            happened[t - begin, :n] = (state << 2) + (by2 + by1 + known + 3)
            v -= r * add
            np.multiply(r, length, out=w)
            go = np.flatnonzero(w < SMALL)
            if len(go):
                place = at.take(go)
                v[go], w[go] = ((v.take(go) & (SMALL - 1)) << 32) | late.take(place, mode="clip"), w.take(go) << 32
                at[go] = place + 1
            hist[t + 2, :n] = x
            hit1, hit2 = p1 == x, p2 == x
            # what a run is stays the same within a period: known from the order that knew the id, else just looked up
            np.copyto(ran, r1, where=hit1)
            np.copyto(ran, r2, where=hit2)
            run[t * blocks : t * blocks + n] = ran
            entry = (x << 2) + ((t << 19) + 1)
            one[at1] = entry + np.minimum(c1, SURE - 1) * hit1
            two[at2] = entry + np.minimum(c2, SURE - 1) * hit2
        if end < block:
            if end > rest:
                happened[max(0, rest - begin) :, -1] = ((blocks - 1) * 32 << 2) + 3
            shares.renew(happened.ravel(), end)
    out = np.empty((blocks, block), np.uint16)
    for k in range(0, blocks, NEAR):
        out[k : k + NEAR] = hist[2:, k : k + NEAR].T
    return out.reshape(-1)[:total]


def write_segment(file, keys: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
    """Append documents to an open file: their keys (any number where null is set), counts of ids, and all ids."""
    if len(ids) and ids.max() >= 1 << ID_BITS:
        raise ValueError("ids must be below 65536")
    block = int(min(BLOCK, max(256, len(ids) // LANES)))
    words, sizes = encode_blocks(ids.astype(np.uint16), block)
    index = zlib.compress(null.astype(np.uint8).tobytes() + keys.astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 1)
    raw = ids.astype("<u2")
    crcs = [zlib.crc32(raw[i : i + block].tobytes()) for i in range(0, len(raw), block)]
    table = np.stack([sizes, np.array(crcs, np.int64)], 1).astype("<u4").tobytes() if len(sizes) else b""
    for part in (HEAD.pack(MAGIC, len(keys), len(ids), block, len(sizes), len(index)), index, table):
        file.write(part + CRC.pack(zlib.crc32(part)))
    file.write(words.astype("<u2").tobytes())


def _checked(file, size: int, what: str) -> bytes:
    """The next ``size`` bytes, if the checksum after them holds."""
    part, crc = file.read(size), file.read(CRC.size)
    if len(part) < size or crc != CRC.pack(zlib.crc32(part)):
        raise ValueError(f"damaged {what}")
    return part


def read_segments(file):
    """(keys, null mask, counts, ids) of every segment; raises ValueError where a checksum doesn't hold. Nothing is made
    room for before the numbers that ask for it have been checked."""
    while head := file.read(HEAD.size):
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        if len(head) < HEAD.size or file.read(CRC.size) != CRC.pack(zlib.crc32(head)):
            raise ValueError("damaged head")
        _, docs, n, block, blocks, size = HEAD.unpack(head)
        index, table = zlib.decompress(_checked(file, size, "index")), _checked(file, 8 * blocks, "table")
        null, keys, counts = np.frombuffer(index[:docs], np.uint8).astype(bool), np.frombuffer(index[docs : 9 * docs], "<i8"), np.frombuffer(index[9 * docs :], "<u4").astype(np.int64)
        table = np.frombuffer(table, "<u4").reshape(-1, 2).astype(np.int64)
        size = 2 * int(table[:, 0].sum())
        words = file.read(size)
        if len(words) < size:
            raise ValueError("the file ends within a segment")
        ids = decode_blocks(np.frombuffer(words, "<u2"), table[:, 0], n, block)
        raw = ids.astype("<u2")
        for i, crc in enumerate(table[:, 1]):
            if zlib.crc32(raw[i * block : (i + 1) * block].tobytes()) != crc:
                raise ValueError(f"damaged block {i}")
        yield keys, null, counts, ids


#: What a tokenizer file must say for its texts to be taken apart into words and these into pieces here (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: The same pieces of words of printable ASCII characters.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Below it no letter is changed by the normal form, and one that lower-casing splits is no letter any more.
LATIN = "\u0250"


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words of an array of strings, and where each starts and the last one ends."""
    _, borders, data = words.buffers()
    borders = np.frombuffer(borders, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), borders


class Words:
    """Numbers of words, in the order they were added: of those of up to 16 bytes by an open table over two numbers, their
    bytes, and their size; of longer ones by a dict."""

    MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self):
        self.keys, self.size = np.zeros((2, 0), np.uint64), np.zeros(0, np.uint8)
        self.long: dict[bytes, int] = {}
        self.table = np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return len(self.size)

    def _key(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, borders = _characters(words)
        at, size = borders[:-1] - borders[0], np.diff(borders)
        data = np.concatenate([data[borders[0] : borders[-1]], np.zeros(16, np.uint8)])
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        # no short word has the size of long ones
        return np.stack([eight[at] & self.MASK[np.minimum(size, 8)], eight[at + 8] & self.MASK[np.clip(size - 8, 0, 8)]]), np.minimum(size, 17).astype(np.uint8)

    def _slots(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix64(keys[0] + mix64(keys[1] + size)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words, -1 for those that aren't known."""
        (low, high), size = keys, size = self._key(words)
        out, slot, left = np.full(len(words), -1, np.int64), self._slots(keys, size), np.flatnonzero(size <= 16)
        while len(left):
            row = self.table.take(slot[left])
            left, row = left[row >= 0], row[row >= 0]
            hit = (self.keys[0].take(row) == low[left]) & (self.keys[1].take(row) == high[left]) & (self.size.take(row) == size[left])
            out[left[hit]] = row[hit]
            left = left[~hit]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
        for i, w in self._longs(words, size):
            out[i] = self.long.get(w, -1)
        return out

    def add(self, words: pa.Array) -> None:
        """Add words that aren't known, none of them twice."""
        known, (keys, size) = len(self), self._key(words)
        for i, w in self._longs(words, size):
            self.long[w] = known + i
        self.keys, self.size = np.concatenate([self.keys, keys], axis=1), np.concatenate([self.size, size])
        if 2 * len(self) > len(self.table):
            self._fill()
        else:
            self._place(known)

    def keep(self, some: np.ndarray) -> None:
        """Forget all others, and number the words anew, in the same order."""
        to = np.cumsum(some) - 1
        self.long = {w: int(to[i]) for w, i in self.long.items() if some[i]}
        self.keys, self.size = self.keys[:, some], self.size[some]
        self._fill()

    def _longs(self, words: pa.Array, size: np.ndarray):
        at = np.flatnonzero(size > 16)
        return zip(at.tolist(), words.take(at).cast(pa.binary()).to_pylist(), strict=True)

    def _fill(self) -> None:
        self.table = np.full(1 << max(12, (4 * len(self)).bit_length() - 1), -1, np.int32)
        self._place(0)

    def _place(self, first: int) -> None:
        row = first + np.flatnonzero(self.size[first:] <= 16).astype(np.int32)
        slot = self._slots(self.keys[:, row], self.size[row])
        while len(row):
            free = self.table.take(slot) < 0
            self.table[slot[free]] = row[free]
            # of several for one place the last has got it
            left = self.table.take(slot) != row
            row, slot = row[left], (slot[left] + 1) & (len(self.table) - 1)


class Encoder:
    """Ids by the tokenizers library. For a vocabulary that lower-cases and drops white space between words, as the
    file's normaliser and pre-tokenizer say, a text's ids are those of its words, so each distinct word is encoded once;
    a full stop or comma after an ASCII letter is a piece of its own, so it is cut off first. The pieces of plain words go
    to the library's model as they are, all others through the whole tokenizer; so do whole texts for any other file."""

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        said = json.loads(self.tokenizer.to_str())
        suffix, vocabulary = said["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.by_word = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER and bool(suffix) and any(t.special for t in added.values()) and said.get("post_processor") is None and all(t.content.startswith("<|") for t in added.values())
        if not self.by_word:
            return
        self.special = [t.content for t in added.values()]
        # any special token will do as a border
        self.between_id, self.between = next((i, t.content) for i, t in sorted(added.items()) if t.special)
        self.tails = {c: self._alone(chr(c)) for c in b".,"}
        # bytes of printable ASCII stand for themselves
        self.ascii_pieces, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.ascii_pieces.normalizer = self.pieces.normalizer = None
        self.ascii_pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids that end a piece.
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._clear()

    def _alone(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.words = Words()
        #: Of each word: how often it has come, where its ids start in flat, their number, and the id of its cut-off sign.
        self.seen, self.start, self.length, self.tail = (np.zeros(0, np.int32) for _ in range(4))
        self.flat = np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Forget the words that have come once."""
        often = self.seen > 1
        if often.sum() > self.most // 2:
            return self._clear()
        self.words.keep(often)
        start, length, self.tail = self.start[often], self.length[often], self.tail[often]
        own = length - (self.tail >= 0)
        ends = np.cumsum(own, dtype=np.int64)
        self.flat = self.flat[np.repeat(start - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        self.seen, self.start, self.length = np.ones(len(start), np.int32), (ends - own).astype(np.int32), length

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stems one after the other, and how many each has. Pieces go with spaces between, and end where an id ends
        one; stems that aren't plain with a special token between, and one that holds a special token alone."""
        data, borders = _characters(stems)
        others = np.append(0, np.cumsum(((data | 32) < 97) | ((data | 32) > 122)))
        letters = (np.diff(others[borders]) == 0) & (np.diff(borders) > 0)  # of ASCII
        kind, length, pieces, latin, rest, alone = np.zeros(len(stems), np.int8), np.zeros(len(stems), np.int64), [], [], [], []
        per: list[int] = []
        odd = np.flatnonzero(~letters)
        for i, word in zip(odd.tolist(), stems.take(odd).to_numpy(zero_copy_only=False), strict=True):
            if word.isascii() and word.isprintable() and "<|" not in word:
                kind[i], found = 1, ASCII_PIECES.findall(word.lower())
                pieces += found
                per.append(len(found))
            elif word.isalpha() and max(word) < LATIN and (low := word.lower()).isalpha():
                kind[i] = 4
                latin.append(low)
            elif "<" in word and any(x in word for x in self.special):
                kind[i] = 3
                alone.append(self._alone(word))
            else:
                kind[i] = 2
                rest.append(word)
        plain = pc.ascii_lower(stems.filter(pa.array(letters)))
        plain_lists = pa.ListArray.from_arrays(np.append(np.arange(0, len(plain), 500), len(plain)).astype(np.int32), plain)
        flat = [self._pieces(self.ascii_pieces, pc.binary_join(plain_lists, " ").to_pylist(), np.ones(len(plain), np.int64))]
        flat.append(self._pieces(self.ascii_pieces, [" ".join(pieces[k : k + 500]) for k in range(0, len(pieces), 500)], np.array(per, np.int64)))
        strings = [self.between.join(rest[k : k + 500]) for k in range(0, len(rest), 500)]
        found = [np.array([*e.ids, self.between_id], np.int64) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        joined = np.concatenate([np.zeros(0, np.int64), *found])
        borders = joined == self.between_id
        flat.append((joined[~borders], np.diff(np.flatnonzero(borders), prepend=-1) - 1))
        flat.append((np.array([x for ids in alone for x in ids], np.int64), np.array([len(ids) for ids in alone], np.int64)))
        flat.append(self._pieces(self.pieces, [" ".join(latin[k : k + 500]) for k in range(0, len(latin), 500)], np.ones(len(latin), np.int64)))
        for k, (_, n) in enumerate(flat):
            length[kind == k] = n
        of, out = np.repeat(kind, length), np.empty(length.sum(), np.int32)
        for k, (ids, _) in enumerate(flat):
            out[of == k] = ids
        return out, length

    def _pieces(self, tokenizer, strings: list[str], per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with spaces between, and how many each stem has, of ``per`` pieces."""
        found = [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.int64), *found])
        upto = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
        if len(upto) != per.sum() + 1:
            raise ValueError("the pieces of words can't be told apart")
        return flat, np.diff(upto[np.concatenate([[0], np.cumsum(per)])])

    def _learn(self, words: pa.Array) -> None:
        known, signs = len(self.start), [c for c, ids in self.tails.items() if len(ids) == 1]
        data, borders = _characters(words)
        last, before = (data.take(borders[1:] - k, mode="clip") for k in (1, 2))
        cut = np.flatnonzero((np.diff(borders) > 1) & np.isin(last, signs) & (before >= 97) & (before <= 122))
        self.words.add(words)
        # a stem ends with a letter, so nothing is cut off it; it is a word of its own
        stems = pc.binary_slice(words.take(cut).cast(pa.binary()), 0, -1).cast(pa.string()).dictionary_encode()
        new = stems.dictionary.filter(pa.array(self.words.find(stems.dictionary) < 0))
        self.words.add(new)
        stem_of = self.words.find(stems.dictionary)[np.asarray(stems.indices)]
        tails, words = last[cut], pa.concat_arrays([words, new])
        whole = np.ones(len(words), bool)
        whole[cut] = False
        start, length, tail = (np.full(len(words), x, np.int32) for x in (0, 0, -1))
        flat, length[whole] = self._stems(words.filter(pa.array(whole)))
        ends = np.cumsum(length[whole], dtype=np.int64)
        start[whole] = len(self.flat) + ends - length[whole]
        self.flat = np.concatenate([self.flat, flat])
        self.start, self.length, self.tail = (np.concatenate([x, y]) for x, y in ((self.start, start), (self.length, length), (self.tail, tail)))
        if len(cut):
            at = known + cut
            self.start[at], self.length[at], self.tail[at] = self.start[stem_of], self.length[stem_of] + 1, [self.tails[c][0] for c in tails.tolist()]
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int32)])

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each text has."""
        if not self.by_word:
            found = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int64), *found]), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.words) > self.most or len(self.flat) > 8 * self.most:
            self._thin()
        raw = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # special tokens are told apart by case
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw)))
        # space at the ends of a text makes empty words, which have no ids
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        row = self.words.find(distinct)
        if len(new := np.flatnonzero(row < 0)):
            row[new] = len(self.words) + np.arange(len(new))
            self._learn(distinct.take(new))
        of = np.asarray(coded.indices)
        self.seen[row] += np.bincount(of, minlength=len(row)).astype(np.int32)
        length, tail = self.length[row].take(of), self.tail[row].take(of)
        ends = np.cumsum(length, dtype=np.int64)
        at = np.repeat(self.start[row].take(of) - (ends - length), length)
        at += np.arange(len(at))
        # the place of a cut-off sign is one beyond its stem
        ids = self.flat.take(at, mode="clip").astype(np.int64) if len(self.flat) else np.zeros(0, np.int64)
        cut = np.flatnonzero(tail >= 0)
        ids[ends[cut] - 1] = tail[cut]
        return ids, np.diff(np.append(0, ends)[np.asarray(words.offsets)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker: what it has learnt serves the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _grouped(batches):
    """Batches joined to about TEXTS bytes, so that a word that comes often is looked up once for many texts."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > TEXTS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(counts), end)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents to files in ``folder``, in ascending order of keys, and return the list of files:
    part (ascending), file, documents, ids.

    Every document ends with the id ``end``; null and empty texts have only that. Null keys come first. Rows with one key are in
    the order of a hash of their texts, equal rows are documents of their own, an empty table gives no files. A file
    is written under a name of its own by each attempt of a task, and only those that the returned table names count."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = int(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (12 << 20)))
    ordered = rows.repartitionByRange(n, F.col("key"), F.xxhash64("text")).sortWithinPartitions(F.col("key"), F.xxhash64("text"))

    def write(batches):
        encode = encoder(tokenizer).encode
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, file, documents, total = f"part-{part:06d}-{uuid.uuid4().hex}.tok", None, 0, 0
        held, size = [], 0

        def flush():
            nonlocal file
            if held:
                if file is None:
                    fs.create_dir(at, recursive=True)
                    file = fs.open_output_stream(f"{at}/{name}")
                keys, null, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                write_segment(file, keys, null, counts, ids)

        for b in _grouped(batches):
            keys = b.column(0)
            ids, counts = encode(b.column(1))
            held.append((keys.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(keys.is_null()), counts + 1, _with_end(ids, counts, end)))
            documents, total, size = documents + len(keys), total + len(held[-1][3]), size + len(held[-1][3])
            if size >= BLOCK * LANES:
                flush()
                held, size = [], 0
        flush()
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([documents], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "documents", "ids"])

    return written(ordered.mapInArrow(write, "part long, file string, documents long, ids long"), "token-files")


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """From the files: key, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian uint32),
    and the ids themselves if asked for."""
    small_batches(files.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    count = max(1, files.count())

    def read(batches):
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                with fs.open_input_stream(f"{at}/{name}") as file:
                    for keys, null, counts, ids in read_segments(file):
                        ends = np.cumsum(counts)
                        whole = ids.astype("<u4")
                        for i in range(0, len(keys), 1000):
                            part = range(i, min(i + 1000, len(keys)))
                            crcs = [zlib.crc32(whole[ends[k] - counts[k] : ends[k]].tobytes()) for k in part]
                            s = slice(i, i + 1000)
                            columns = [pa.array(keys[s], mask=null[s]), pa.array(start + ends[s] - counts[s]), pa.array(counts[s]), pa.array(crcs, pa.int64())]
                            if with_ids:
                                columns.append(pa.array([ids[ends[k] - counts[k] : ends[k]].astype(np.int32) for k in part], pa.list_(pa.int32())))
                            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                        start += len(ids)

    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return placed.select("part", "file", "start").repartition(count, "part").mapInArrow(read, schema)


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents, written to token files in the shared folder and read back from them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, folder)
    return read_tokens(files, folder).withColumnRenamed("key", "doc_id")
