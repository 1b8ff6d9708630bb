"""Language-model scores by online logistic context mixing.

What is coded is a text's token sequence: its lower-cased words, a space after
each, and an end mark.  A byte is a path of binary decisions in the Huffman tree
that the byte before it selects (built from the corpus' counts of byte pairs).
Three predictors look at each decision under a hash of their context and its
place in the tree: the last 3 and 5 bytes, and the word so far (its last 16
bytes), each with a table of hashed slots.  Each gives the log-odds of the bit counts gathered from the training
rows.  A gate selects the weights of their sum by how often the word and the 5
bytes were seen at this place; a last stage with two adaptive parameters refines
the mixture.  Costs of all decisions sum to the text's bits.

Weights start from what training rows teach: one in ``FOLDS`` training texts
(by hash, so copies stay together) is left out of the counts, and weights are
fitted to its decisions by Newton steps.  From there a text's weights follow its own coding errors, moved
after every ``STEP`` bytes and carried to its end.  Texts of like length are
coded side by side, a segment at a time, so a long text takes no more memory.
A text's score depends on the counts, the start weights and the text alone.

The tables grow with the training decisions, the word's up to 2**24 slots: they
are broadcast, 21 MB at most.  What grows without bound, the counts of words for
the base score, is joined by word: what a task asks for is packed per word, and
the most frequent words (a stated number) are known to every task.

Edge cases: a null text counts as empty: its score is that of the end mark.
Rows without id learn (the held-out rule needs an id) and are scored.  Repeated
rows get a row each.  Without training rows every predictor is silent and each
decision costs one bit.  Extra columns are neither read nor returned.  Empty
table: empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import drop_written, written

#: log2 of the least and the most slots of each table (3 bytes, 5 bytes, word), and the training decisions that a slot is for.
LEAST_SLOTS, MOST_SLOTS, DECISIONS_PER_SLOT = (18, 20, 22), (20, 22, 24), (2048, 512, 256)
BACK = 16
STEP = 32
SIDE_BY_SIDE = 256
SEGMENT_BYTES = 1 << 16
FOLDS = 32
GATES = 16
START = np.array([0.3, 0.4, 0.5], np.float32)
RATE, RATE_LAST = 0.01, 0.003
#: Counts of a task are sent in pieces of so many slots.
PIECE = 1 << 16
CHUNK = 1 << 20
_SPACE, _END = 32, 10
#: Keys that a task counts before it merges or sends them.
HELD = 1_000_000
#: A slot's state in a byte: log-odds in quarters (6 bits, 32 is none), and how often it was seen: never, up to 3, up to 30, more.
_SILENT = np.uint8(32)
#: The lowest bytes of a number, by how many.
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def states(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The state byte of bit counts."""
    n = zero + one
    odds = np.clip(np.rint(np.log((one + 0.35) / (zero + 0.35)) * 4), -31, 31).astype(np.int64) + 32
    return (odds | np.digitize(n, [1, 4, 31]) << 6).astype(np.uint8)


def slots_for(decisions: int) -> tuple[int, ...]:
    """log2 of each table's slots."""
    return tuple(min(most, max(least, (decisions // each).bit_length())) for least, most, each in zip(LEAST_SLOTS, MOST_SLOTS, DECISIONS_PER_SLOT))


def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Huffman code: for each symbol its (node, bit), from the root."""
    heap = [(int(n), i, (i,)) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    number = len(counts)
    while len(heap) > 1:
        pair = heapq.heappop(heap), heapq.heappop(heap)
        for bit, (_, _, leaves) in enumerate(pair):
            for leaf in leaves:
                paths[leaf].append((number, bit))
        heapq.heappush(heap, (pair[0][0] + pair[1][0], number, pair[0][2] + pair[1][2]))
        number += 1
    return [p[::-1] for p in paths]


@dataclass(frozen=True)
class Tree:
    """A code for each byte before: ``length`` decisions for a byte, each with a place and a bit.

    Places of a tree are numbered from the root on by how often they are met, so that a context's common decisions are
    neighbours in the tables; trees differ in the bits above.
    """

    length: np.ndarray
    place: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> Tree:
        """``pairs``: counts of (byte before, byte), 256 by 256. Every code has all bytes; the rare ones share a floor."""
        floored = pairs + 1 + pairs.sum(axis=1, keepdims=True) // 8192
        seen = pairs.any(axis=1)
        common = _paths(np.ones(256, np.int64))
        codes = [_paths(floored[k]) if seen[k] else common for k in range(256)]
        deep = max(len(p) for code in codes for p in code)
        length, node, bits = np.zeros((256, 256), np.int32), np.zeros((256, 256, deep), np.uint32), np.zeros((256, 256, deep), np.int8)
        for k, code in enumerate(codes):
            for leaf, path in enumerate(code):
                length[k, leaf] = len(path)
                node[k, leaf, : len(path)] = [510 - n + 256 * (k & 127) for n, _ in path]
                bits[k, leaf, : len(path)] = [b for _, b in path]
        return cls(length.ravel(), node.reshape(256 * 256, deep), bits.reshape(256 * 256, deep))


# -- texts ------------------------------------------------------------------------------------------------------------------


_CODED = tv.LOWER.copy()
_CODED[~tv.IS_WORD] = _SPACE


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of some texts, and their offsets."""
    n, coded = len(off) - 1, _CODED[data]
    space = coded == _SPACE
    drop = np.empty_like(space)
    if len(drop):
        drop[0] = True
        drop[1:] = space[:-1]
        drop[off[:-1][off[:-1] < len(drop)]] = True
    drop &= space
    size = np.diff(off - np.searchsorted(np.flatnonzero(drop), off))
    coded = coded[~drop]
    last = np.cumsum(size) - 1
    bare = (size > 0) & (coded[np.maximum(last, 0)] != _SPACE) if len(coded) else np.zeros(n, bool)
    length = size + bare + 1
    out, ends = np.full(int(length.sum()), _SPACE, np.uint8), np.cumsum(length)
    own = np.ones(len(out), bool)
    own[ends - 1] = own[ends[bare] - 2] = False
    out[own] = coded
    out[ends - 1] = _END
    return out, np.concatenate([[0], ends])


def _texts(batches: Iterator[pa.RecordBatch], k: int, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, coded bytes, offsets) of whole texts, about ``limit`` bytes at a time, of like length."""
    for b in batches:
        data, off = tv.flat(b.column(k))
        order = np.argsort(np.diff(off), kind="stable")
        b = b.take(pa.array(order))
        data, off = tv.flat(b.column(k))
        for x, y in tv.chunks(off, limit):
            yield (b.slice(x, y - x), *tokens_of(data[off[x] : off[y]], off[x : y + 1] - off[x]))


def count_pairs(docs: DataFrame) -> DataFrame:
    """(key, n) over training texts: 256 * before + byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, np.int64)
        for _, data, off in _texts(batches, 0):
            before = np.empty(len(data), np.uint16)
            before[1:], before[off[:-1]] = data[:-1], _END
            pairs += np.bincount(before << np.uint16(8) | data, minlength=1 << 16)
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(pairs[seen])], names=["key", "n"])

    return docs.where("not held_out").select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# -- decisions --------------------------------------------------------------------------------------------------------------


@dataclass
class Segment:
    """A stretch of some texts, decisions in the order of coding: step, text, byte."""

    bit: np.ndarray
    slots: list[np.ndarray]  # by predictor
    text: np.ndarray  # of each run (a text's decisions in a step): which text
    begin: np.ndarray  # decisions before each run
    steps: np.ndarray  # runs before each step


def segments(data: np.ndarray, offsets: np.ndarray, texts: np.ndarray, tree: Tree, bits: tuple[int, ...], most: int | None = None) -> Iterator[Segment]:
    """The decisions of ``texts`` (numbers, by length, shortest first), which are coded side by side."""
    begin, length = offsets[texts], offsets[texts + 1] - offsets[texts]
    most, at = most or SEGMENT_BYTES, 0
    while len(length) and at < length[-1]:
        alive = int(np.searchsorted(length, at, "right"))
        n = len(length) - alive
        size = min(max(STEP, most // n // STEP * STEP), -(-int(length[-1] - at) // STEP) * STEP)
        m = np.full((n, BACK + size), _END, np.uint8)
        own = np.minimum(length[alive:] - at, size)
        back = min(at, BACK)
        for r, (b, w) in enumerate(zip(begin[alive:].tolist(), own.tolist())):
            m[r, BACK - back : BACK + w] = data[b + at - back : b + at + w]
        yield _coded(m, own, np.arange(alive, len(length), dtype=np.int32), tree, bits)
        at += size


def _coded(m: np.ndarray, own: np.ndarray, texts: np.ndarray, tree: Tree, bits: tuple[int, ...]) -> Segment:
    n, size = len(m), m.shape[1] - BACK

    here = (np.arange(size) < own[:, None]).reshape(n, size // STEP, STEP).transpose(1, 0, 2)
    at = np.arange(m.size).reshape(m.shape)[:, BACK:].reshape(n, size // STEP, STEP).transpose(1, 0, 2)[here]
    symbol, contexts = _contexts(m.ravel(), at)
    many = tree.length[symbol]
    byte, until = _owners(many)
    path = (symbol * tree.place.shape[1] - until)[byte]
    path += np.arange(len(byte))
    place = tree.place.ravel()[path].astype(np.intp)
    slots = [_slots(c, k, b, byte, place) for k, (c, b) in enumerate(zip(contexts, bits))]
    length = here.sum(axis=2)  # bytes, by step and text
    at, row = np.nonzero(length)
    begin = np.append(until, len(byte))[np.append(0, np.cumsum(length[at, row]))]
    return Segment(tree.bit.ravel()[path], slots, texts[row], begin, np.searchsorted(at, np.arange(size // STEP + 1)))


def _owners(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``many`` entries (one at least): the run of each entry, and the entries before each run."""
    upto = np.cumsum(many, dtype=np.intp)
    new = np.zeros(upto[-1] if len(upto) else 0, np.int8)
    new[upto[:-1]] = 1
    return np.cumsum(new, dtype=np.intp), upto - many  # indices of the machine's width are not copied


def _contexts(m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the bytes of ``m`` at ``at``: 256 * the byte before + the byte, and each predictor's context (3 bytes as they are, others by hash).

    ``BACK`` bytes are before each of ``at``, end marks where the text has none.
    """
    past = m.astype(np.uint64)
    for k in (1, 2, 4):  # the last 2, 4, 8 bytes up to each
        past[k:] |= past[:-k] << np.uint64(8 * k)
    bound = np.where((m == _SPACE) | (m == _END), np.arange(len(m), dtype=np.int32), np.int32(-BACK))
    before = at - 1
    size = before - np.maximum.accumulate(bound)[before]
    near = past[before]
    word = near & _LAST[np.minimum(size, 8)]
    word += np.minimum(size, BACK).astype(np.uint64) * tv._BASE
    long = np.flatnonzero(size > 8)
    word[long] ^= tv.mix(past[before[long] - 8] & _LAST[np.minimum(size[long], BACK) - 8])
    three = (near & _LAST[3]).astype(np.uint32)
    symbol = (near & _LAST[1]).astype(np.intp) << 8 | m[at]
    return symbol, [three, _high(near & _LAST[5]), _high(word)]


def _high(x: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each number, which is overwritten."""
    x *= tv._M1
    x ^= x >> np.uint64(32)
    x *= tv._M2
    x >>= np.uint64(32)
    return x.astype(np.uint32)


def _slots(contexts: np.ndarray, k: int, bits: int, which: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Slots of predictor ``k``: a context (by number, ``which``) and a place in its tree for each decision.

    Hashes in ascending order have slots in ascending order but for the place's bits.
    """
    slot = ((contexts if k else _mix32(contexts)) >> np.uint32(32 - bits)).astype(np.intp)[which]
    slot ^= place
    return slot


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def sides(offsets: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
    """Texts to code side by side, each group by length."""
    order = which[np.argsort(np.diff(offsets)[which], kind="stable")]
    for a in range(0, len(order), SIDE_BY_SIDE):
        yield order[a : a + SIDE_BY_SIDE]


# -- counting ---------------------------------------------------------------------------------------------------------------


def _keys(data: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By predictor, for the coded bytes from ``a`` to ``b``: context, then the byte before and the byte in the lowest 16 bits."""
    cuts = off[np.searchsorted(off, a, "right") : np.searchsorted(off, b)]
    size = np.diff(np.concatenate([[a], cuts, [b]]))
    at = np.arange(b - a) + np.repeat(np.arange(1, len(size) + 1) * BACK, size)
    m = np.full(b - a + len(size) * BACK, _END, np.uint8)  # nothing is seen of the text before
    m[at] = data[a:b]
    back = min(BACK, a - int(off[np.searchsorted(off, a, "right") - 1]))
    m[BACK - back : BACK] = data[a - back : a]
    symbol, (three, five, word) = _contexts(m, at)
    symbol = symbol.astype(np.uint64)
    return three << np.uint32(8) | m[at], five.astype(np.uint64) << np.uint64(16) | symbol, word.astype(np.uint64) << np.uint64(16) | symbol


def count_bits(data: np.ndarray, off: np.ndarray, tree: Tree, bits: tuple[int, ...], counts: list[np.ndarray]) -> None:
    """Adds the decisions of all texts to ``counts`` (two to a slot).

    The order of decisions doesn't matter here: equal contexts with equal bytes are brought together by a sort, and
    their decisions are found once.
    """
    place, bit, deep = tree.place.ravel(), tree.bit.ravel(), tree.place.shape[1]
    for a in range(0, len(data), CHUNK):
        blocks = [_keys(data, off, x, min(x + SEGMENT_BYTES, a + CHUNK, len(data))) for x in range(a, min(a + CHUNK, len(data)), SEGMENT_BYTES)]
        for k, (table, b, context) in enumerate(zip(counts, bits, (8, 16, 16))):
            keys = np.concatenate([block[k] for block in blocks])
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys = keys[first]
            symbol = (keys & keys.dtype.type(0xFFFF)).astype(np.intp)
            keys = (keys >> keys.dtype.type(context)).astype(np.uint32)
            for x in range(0, len(keys), SEGMENT_BYTES):
                own = symbol[x : x + SEGMENT_BYTES]
                which, until = _owners(tree.length[own])
                path = (own * deep - until)[which]
                path += np.arange(len(which))
                slot = _slots(keys[x : x + SEGMENT_BYTES], k, b, which, place[path].astype(np.intp))
                np.add.at(table, 2 * slot + bit[path], n[x : x + SEGMENT_BYTES][which])


def learn(docs: DataFrame, tree: Tree, bits: tuple[int, ...]) -> list[np.ndarray]:
    """States of every slot. Tasks send the counts of the slots that they met, in pieces that are summed apart."""
    first = np.cumsum([0, *(-(-(2 << b) // PIECE) for b in bits)]).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, counts = zstandard.ZstdCompressor(level=1), [np.zeros(2 << b, np.uint32) for b in bits]
        for _, data, off in _texts(batches, 0):
            count_bits(data, off, tree, bits, counts)
        for begin, table in zip(first, counts):
            rows = []
            for k in range(0, len(table), PIECE):
                seen = np.flatnonzero(table[k : k + PIECE]).astype(np.uint32)
                if len(seen):
                    both = np.concatenate([np.diff(seen, prepend=np.uint32(0)), table[k : k + PIECE][seen]])
                    rows.append((begin + k // PIECE, press.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["piece", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, total = -1, np.zeros(PIECE, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([press.compress(states(total[0::2], total[1::2]).tobytes())], pa.binary())], names=["piece", "body"])

        for b in batches:
            for k, body in zip(b.column(0).to_pylist(), b.column(1)):
                if k != now:
                    if now >= 0:
                        yield out()
                    now = k
                    total[:] = 0
                both = np.ascontiguousarray(np.frombuffer(unpress.decompress(body.as_py()), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                n = len(both) // 2
                total[np.cumsum(both[:n], dtype=np.int64)] += both[n:]
        if now >= 0:
            yield out()

    counted = docs.where("learns = 1").select("text").mapInArrow(count, "piece int, body binary")
    out, half = np.full(first[-1] * PIECE // 2, _SILENT, np.uint8), PIECE // 2
    for row in counted.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, body binary").toLocalIterator():
        out[row["piece"] * half : (row["piece"] + 1) * half] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["body"])), np.uint8)
    return [out[f * half : f * half + (1 << b)].copy() for f, b in zip(first, bits)]


# -- mixing -----------------------------------------------------------------------------------------------------------------


def _states(s: Segment, tables: list[np.ndarray]) -> list[np.ndarray]:
    return [table[slot] for table, slot in zip(tables, s.slots)]


def _mixed(state: list[np.ndarray] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs by predictor, gate) of states."""
    x = np.empty((len(state), len(state[0])), np.float32)
    for row, own in zip(x, state):
        row[:] = own & np.uint8(63)
    x -= np.float32(32)
    x *= np.float32(0.25)
    return x, (state[-1] >> np.uint8(6)) * np.uint8(4) + (state[-2] >> np.uint8(6))


def newton_sums(state: np.ndarray, bit: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per gate the curvature and the pull of the logistic loss at ``w``: GATES x (k * k + k). ``state``: by predictor; ``n``: how often."""
    x, gate = _mixed(state)
    k = len(x)
    p = 1 / (1 + np.exp(-np.clip((w[gate].T * x).sum(axis=0), -12, 12)))
    parts = [x[i] * x[j] * p * (1 - p) * n for i in range(k) for j in range(k)] + [x[i] * (bit - p) * n for i in range(k)]
    return np.stack([np.bincount(gate, v, GATES) for v in parts], axis=1)


class _Sums:
    """Counts of keys, merged when many have come in."""

    def __init__(self) -> None:
        self.keys, self.counts, self.fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.fresh.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.fresh) > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self.keys, where = np.unique(np.concatenate([self.keys, *(k for k, _ in self.fresh)]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, *(n for _, n in self.fresh)]), len(self.keys)).astype(np.int64)
        self.fresh = []
        return self.keys, self.counts


def start_weights(docs: DataFrame, tree: Tree, bits: tuple[int, ...], tables: object, rounds: int = 6) -> np.ndarray:
    """Weights of each gate from the texts that are kept for them, by Newton steps over counts of (states, bit)."""
    k = len(START)

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for _, data, off in _texts(batches, 0):
            for texts in sides(off, np.arange(len(off) - 1)):
                for s in segments(data, off, texts, tree, bits):
                    key = s.bit.astype(np.int64)
                    for own in _states(s, tables.value):
                        key = key << 8 | own
                    sums.add(key)
        keys, n = sums.merge()
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["key", "n"])

    # 2 * 256 ** k rows at most, whatever the corpus
    seen = written(docs.where("learns = 2").select("text").mapInArrow(cases, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-cases")
    w = np.tile(START.astype(np.float64), (GATES, 1))
    for _ in range(rounds):

        def add(found: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((GATES, k * k + k))
            for b in found:
                key = b.column(0).to_numpy()
                state = np.stack([(key >> (8 * (k - 1 - i)) & 255).astype(np.uint8) for i in range(k)])
                total += newton_sums(state, (key >> (8 * k)).astype(np.float64), b.column(1).to_numpy().astype(np.float64), w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

        total = np.zeros(GATES * (k * k + k))
        for r in seen.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # GATES * 12 rows
            total[r["at"]] = r["v"]
        total = total.reshape(GATES, -1)
        step = np.linalg.solve(total[:, : k * k].reshape(GATES, k, k) + np.eye(k), (total[:, k * k :] - (w - START))[:, :, None])[:, :, 0]
        w = w + np.clip(step, -1, 1)
    drop_written(seen)
    return w.astype(np.float32)


def cost(data: np.ndarray, offsets: np.ndarray, tree: Tree, bits: tuple[int, ...], tables: list[np.ndarray], start: np.ndarray, rate: float = RATE, rate_last: float = RATE_LAST) -> np.ndarray:
    """Bits of each text."""
    spent = np.zeros(len(offsets) - 1)
    for texts in sides(offsets, np.arange(len(offsets) - 1)):
        n, k = len(texts), start.shape[1]
        w = np.zeros((n * GATES, 4), np.float32)  # by text and gate; a row is fetched as one number of 16 bytes
        w[:, :k] = np.tile(start, (n, 1))
        rows = w.view(np.complex128).ravel()
        scale, shift = np.ones(n, np.float32), np.zeros(n, np.float32)
        bill = np.zeros(n)
        for s in segments(data, offsets, texts, tree, bits):
            x, gate = _mixed(_states(s, tables))
            many = np.diff(s.begin)
            row = np.repeat(s.text.astype(np.intp) * GATES, many)
            row += gate
            sign = s.bit.astype(np.float32) * np.float32(2) - np.float32(1)
            for r, e in zip(s.steps[:-1].tolist(), s.steps[1:].tolist()):
                if r == e:
                    continue
                a, b = int(s.begin[r]), int(s.begin[e])
                who = slice(int(s.text[r]), int(s.text[e - 1]) + 1)  # the longer texts are left: neighbours
                own, first, count = many[r:e], who.start * GATES, (who.stop - who.start) * GATES
                near, one, xs = row[a:b] - first, sign[a:b], x[:, a:b]
                wx = rows[first : first + count].take(near, mode="clip").view(np.float32).reshape(-1, 4)
                z = wx[:, 0] * xs[0]
                for j in range(1, k):
                    z += wx[:, j] * xs[j]
                np.clip(z, -12, 12, out=z)
                miss = one / (1 + np.exp(one * z))  # bit - probability
                for j in range(k):
                    w[first : first + count, j] += np.float32(rate) * np.bincount(near, miss * xs[j], count).astype(np.float32)
                # the last stage, text by text: decisions of a text are together
                begin = s.begin[r:e] - a
                y = np.repeat(scale[who], own)
                y *= z
                y += np.repeat(shift[who], own)
                y *= one
                t = np.exp(np.negative(y, out=y)) + np.float32(1)
                bill[who] += _logs(t, begin)
                miss = one - one / t
                scale[who] = np.clip(scale[who] + np.float32(rate_last / 4) * np.add.reduceat(miss * z, begin), 0.5, 2)
                shift[who] = np.clip(shift[who] + np.float32(rate_last) * np.add.reduceat(miss, begin), -1, 1)
        spent[texts] = bill / np.log(2.0)
    return spent


def _logs(t: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of logs from each of ``begin`` on: logs of products, or of each number where a product is too large."""
    with np.errstate(over="ignore"):
        out = np.log(np.multiply.reduceat(t, begin, dtype=np.float64))
    return out if np.isfinite(out).all() else np.add.reduceat(np.log(t), begin, dtype=np.float64)


# -- base score -------------------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over training rows, words by hash; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

        for b in batches:
            for _, _, c in tv.each(b.column(0), lower=True):
                held.append(c.word_hash())
                if sum(map(len, held)) > HELD:
                    yield out()
        yield out()

    return docs.where("not held_out").select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_SUMS = np.dtype([("row_key", "<i8"), ("logs", "<f8"), ("known", "<i8"), ("times", "<i8")])
#: Texts whose sums travel in one row, on average.
GROUP_TEXTS = 4096
#: The most frequent words, whose counts every task has: they would meet in few tasks otherwise.
COMMON_WORDS = 4096


def words_asked(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(word, direct, posts): per batch and word, which texts hold it how often.

    Words of ``common`` (ascending) are summed at once: ``direct`` rows hold these sums, with an entry for every text.
    """
    logs = np.log10(counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            found = [(np.zeros(0, np.uint64), keys[:0], np.zeros(0, np.int32))]
            sums = np.zeros(len(keys), _SUMS)
            sums["row_key"], sums["times"] = keys, 1
            for a, e, c in tv.each(b.column(1), lower=True):
                words, docs_ = c.word_hash(), c.doc_of()
                if len(common):
                    at = np.minimum(np.searchsorted(common, words), len(common) - 1)
                    here = common[at] == words
                    sums["logs"][a:e] = np.bincount(docs_[here], logs[at[here]], e - a)
                    sums["known"][a:e] = np.bincount(docs_[here], minlength=e - a)
                    words, docs_ = words[~here], docs_[~here]
                distinct, rank = np.unique(words, return_inverse=True)
                pair, n = np.unique(rank * np.int64(c.n_docs) + docs_, return_counts=True)
                found.append((distinct[pair // c.n_docs], keys[a + pair % c.n_docs], n.astype(np.int32)))
            word, doc, n = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(word, kind="stable")
            word, posts = word[order], np.zeros(len(word), [("doc", "<i8"), ("n", "<i4")])
            posts["doc"], posts["n"] = doc[order], n[order]
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            at = np.flatnonzero(new)
            off = np.append(at, len(word)).astype(np.int64) * posts.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(posts.tobytes())]).cast(pa.binary())
            names = ["word", "direct", "posts"]
            for s in range(0, len(at), 50_000):
                own = word[at][s : s + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), bool)), packed.slice(s, 50_000)], names=names)
            # a word by which these rows are spread
            yield pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array(np.ones(len(keys[:1]), bool)), pa.array([sums.tobytes()][: len(keys)], pa.binary())], names=names)

    return docs.select("row_key", "text").mapInArrow(run, "word long, direct boolean, posts binary")


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """One entry per text key."""
    rows = np.concatenate([np.zeros(0, _SUMS), *parts])
    keys, where = np.unique(rows["row_key"], return_inverse=True)
    out = np.zeros(len(keys), _SUMS)
    out["row_key"] = keys
    for name in ("logs", "known", "times"):
        out[name] = np.bincount(where, rows[name], len(keys))
    return out


def base_sums(asked: DataFrame, counts: DataFrame, groups: int) -> DataFrame:
    """(row_key, logs, known): sum of log10(count + 1) over a text's words, and how many of its words are known.

    Texts are dealt to ``groups``; a task packs what it has summed for a group's texts into one row.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            sums = _summed(held)
            held.clear()
            group = (tv.mix(sums["row_key"].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            sums, group = sums[order], group[order]
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else [0]
            spans = list(zip(cuts, cuts[1:]))
            return pa.RecordBatch.from_arrays([pa.array([int(group[x]) for x, _ in spans], pa.int64()), pa.array([sums[x:y].tobytes() for x, y in spans], pa.binary())], names=["part", "sums"])

        for whole in batches:
            held += [np.frombuffer(x, _SUMS) for x in whole.column(1).filter(whole.column(3)).to_pylist()]
            b = whole.filter(pa.compute.invert(whole.column(3)))
            raw, off = tv.flat(b.column(1).cast(pa.large_binary()))
            posts = np.frombuffer(raw.tobytes(), [("doc", "<i8"), ("n", "<i4")])
            many = np.diff(off) // posts.itemsize
            each = np.repeat(b.column(2).fill_null(0).to_numpy(), many)
            part = np.zeros(len(posts), _SUMS)
            part["row_key"], part["logs"], part["known"] = posts["doc"], posts["n"] * np.log10(each + 1.0), posts["n"] * (each > 0)
            held.append(part)
            if sum(map(len, held)) > 1_000_000:
                yield out()
        yield out()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held += [np.frombuffer(x, _SUMS) for x in b.column(1).to_pylist()]
            if sum(map(len, held)) > 1_000_000:
                held = [_summed(held)]
        sums = _summed(held)
        # copies of a text share a key: each asks for all its words once
        times = np.maximum(sums["times"], 1)
        yield pa.RecordBatch.from_arrays([pa.array(sums["row_key"]), pa.array(sums["logs"] / times), pa.array(sums["known"] // times)], names=["row_key", "logs", "known"])

    packed = asked.join(counts, "word", "left").select("word", "posts", "n", "direct").mapInArrow(first, "part long, sums binary")
    return packed.repartition("part").mapInArrow(second, "row_key long, logs double, known long")


# -- all together -----------------------------------------------------------------------------------------------------------


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte (of the coded tokens)."""
    spark = docs.sparkSession
    text, held = F.coalesce(F.col(text_col), F.lit("")), held_out(F.col(id_col))
    learns = F.when(held, 0).when(F.pmod(F.xxhash64(text, F.lit(5)), F.lit(FOLDS)) == 0, 2).otherwise(1)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), held.alias("held_out"), learns.alias("learns"), F.xxhash64(text).alias("row_key"))
    pairs = np.zeros(1 << 16, np.int64)
    for r in count_pairs(rows).collect():  # 65,536 at most
        pairs[r["key"]] = r["n"]
    tree = Tree.of(pairs.reshape(256, 256))
    bits = slots_for(int((pairs * tree.length).sum()))
    tables = spark.sparkContext.broadcast(learn(rows, tree, bits))
    start = start_weights(rows, tree, bits, tables)
    words = written(count_words(rows), "lm-words")
    n_rows, total = rows.agg(F.count_if(~F.col("held_out")), F.count(F.lit(1))).first()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = n_words + n_rows, distinct + (n_rows > 0)
    top = sorted((r["word"] & (1 << 64) - 1, r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect())
    common, often = np.array([w for w, _ in top], np.uint64), np.array([n for _, n in top], np.int64)
    base = written(base_sums(words_asked(rows, common, often), words, max(1, total // GROUP_TEXTS)), "lm-base")
    drop_written(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [t.copy() for t in tables.value]  # numpy asks for large pages, those read from a broadcast have small ones
        for b, data, off in _texts(batches, 2, 4 * CHUNK):
            spent = cost(data, off, tree, bits, own, start)
            n = np.add.reduceat(data == _SPACE, off[:-1], dtype=np.int64) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n), pa.array(-spent * np.log10(2.0)), pa.array(spent / np.diff(off))], names=["id", "held_out", "row_key", "n_tokens", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.select("id", "held_out", "text", "row_key").mapInArrow(run, f"id {kind}, held_out boolean, row_key long, n_tokens long, score double, bits_per_byte double")
    less = float(np.log10(float(tokens + kinds + 1)))
    logs = F.col("logs") + F.lit(float(np.log10(n_rows + 1.0))) - F.col("n_tokens") * F.lit(less)
    return scored.join(base, "row_key").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.lit(int(n_rows > 0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), logs.alias("base_score"), "score", "bits_per_byte",
    )
