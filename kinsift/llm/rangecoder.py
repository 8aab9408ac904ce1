"""Token ids in an adaptive context-mixing range coder.

A block holds whole documents' ids, dealt to up to LANES lanes of consecutive ids. All lanes share
the block's model and have a range coder each, so that one numpy operation moves every lane of many
blocks by one id. A block starts from an empty model, knows nothing of other blocks, and carries
checksums of its bytes and its ids.

The model predicts an id from three orders. Order 2 (the two ids before) and order 1 (the one before)
each remember the id that last followed and how often it was right in a row; order 0 counts all ids.
The distribution that is coded mixes them: shares for the order-2 and order-1 ids, learned per pair of
confidences from how often such predictions were right, and the rest spread by order 0. An id is coded
in the first share that has it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids a block should have, lanes, and blocks that are coded side by side.
BLOCK, LANES, SIDE = 1 << 17, 128, 48

#: Mixed weights are in 1/64. Order 0 has 2**ORDER0 parts at least and 2**FINE at most, 8 or more for each id of a usual block.
MIX, ORDER0, FINE = 6, 16, 20
#: Slots of the order-2 memory per block.
SLOTS = 1 << 15

#: A lane's range has at most 60 bits; when it gets below BOTTOM, the upper 16 bits leave. Later carries are added to them at the end.
UNIT, BOTTOM = 44, 1 << 36
FULL, REST = 1 << 60, (1 << UNIT) - 1

MAGIC, HEAD = b"KRC2", struct.Struct("<4sIIIHHI")


class Model:
    """The shared state of each of several blocks, whose order 0 has 2**order0 parts; every method takes the lanes in block order."""

    def __init__(self, sizes: list[int], lanes: int, order0: int, inverse: bool):
        blocks, self.alphabet, self.order0 = len(sizes), max(sizes), order0
        self.sizes, self.total, self.inverse = np.array(sizes, np.int64)[:, None], order0 + MIX, inverse
        self.known = np.arange(self.alphabet) < self.sizes
        block = np.repeat(np.arange(blocks, dtype=np.int64), lanes)
        self.off0, self.off2, self.off64 = block * self.alphabet, block * SLOTS, block << 6
        self.key = block << order0
        self.one = np.zeros(blocks * self.alphabet, np.int32)  # id * 8 + confidence; confidence 0: nothing known
        self.two = np.zeros(blocks * SLOTS, np.int32)
        self.tried = np.zeros((blocks, 8, 8, 4), np.int64)  # for both confidences: neither was right, order 1, order 2, both
        self.counts = np.zeros((blocks, self.alphabet), np.int64)
        self.at1, self.at2, self.mixed = self.off0.copy(), self.off2.copy(), np.zeros(len(block), np.int64)
        self.step, self.seen, self.results = 0, [], []
        self._level()
        self._weights()

    def _level(self) -> None:
        """Order 0 anew from the counts: every id of the block's alphabet has at least one part."""
        seen = self.counts.sum(1, keepdims=True)
        parts = self.known + (self.counts * (((1 << self.order0) - self.sizes) / np.maximum(1, seen))).astype(np.int64)
        parts[:, 0] += (1 << self.order0) - parts.sum(1)
        low = np.cumsum(parts, axis=1) - parts
        self.parts = (low << 32 | parts).reshape(-1)
        if self.inverse:  # the id of every part
            self.ids = np.repeat(np.tile(np.arange(self.alphabet, dtype=np.uint16 if self.alphabet <= 1 << 16 else np.int32), len(parts)), parts.reshape(-1))

    def _weights(self) -> None:
        """Shares of orders 2 and 1 by their confidences; an order that knows nothing has none."""
        seen = self.tried.sum(3) + 1
        two = np.clip((self.tried[..., 2] + self.tried[..., 3] + 0.4) / seen * (1 << MIX), 0, 62).astype(np.int64)
        one = np.minimum(np.clip((self.tried[..., 1] + 0.4) / seen * (1 << MIX), 0, 60).astype(np.int64), 63 - two)
        two[:, 0] = 0
        one[:, :, 0] = 0
        self.w2, self.w12 = (two << self.order0).reshape(-1), (two + one << self.order0).reshape(-1)
        self.w0 = ((1 << MIX) - two - one).reshape(-1)

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """Of the first n lanes: predicted ids of orders 1 and 2, where their shares end, and the weight of order 0."""
        self.m1, self.m2 = self.one.take(self.at1[:n]), self.two.take(self.at2[:n])
        self.c1, self.c2 = self.m1 & 7, self.m2 & 7
        self.pair = (self.c2 << 3) + self.c1 + self.off64[:n]
        return self.m1 >> 3, self.m2 >> 3, self.w2.take(self.pair), self.w12.take(self.pair), self.w0.take(self.pair)

    def interval(self, ids: np.ndarray, p1: np.ndarray, p2: np.ndarray, k2: np.ndarray, k12: np.ndarray, k0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the share that each id is coded in."""
        self.place = self.off0[: len(ids)] + ids
        own = self.parts.take(self.place)
        self.right1, self.right2 = p1 == ids, p2 == ids
        # a prediction without a share is not used
        two = self.right2 & (k2 > 0)
        one = self.right1 & (k12 > k2) > two
        start, size = k12 + k0 * (own >> 32), k0 * (own & 0xFFFFFFFF)
        at = np.flatnonzero(one)
        start[at] = mid = k2.take(at)
        size[at] = k12.take(at) - mid
        at = np.flatnonzero(two)
        start[at] = 0
        size[at] = k2.take(at)
        return start, size

    def find(self, target: np.ndarray, p1: np.ndarray, p2: np.ndarray, k2: np.ndarray, k12: np.ndarray, k0: np.ndarray) -> np.ndarray:
        """The id in whose share each target falls."""
        part = np.maximum(target - k12, 0)
        part //= k0
        part += self.key[: len(part)]
        ids = self.ids.take(part).astype(np.int64)
        np.copyto(ids, np.where(target < k2, p2, p1), where=target < k12)
        return ids

    def update(self, ids: np.ndarray) -> None:
        """After interval(): remembers what followed."""
        n = len(ids)
        following = ids.astype(np.int32) << 3
        self.two[self.at2[:n]] = following + np.minimum(self.c2 * self.right2 + 1, 7)
        self.one[self.at1[:n]] = following + np.minimum(self.c1 * self.right1 + 1, 7)
        self.results.append((self.pair << 2) + self.right1 + 2 * self.right2)
        self.at1[:n] = self.place
        self.at2[:n] = self.off2[:n] + (ids * 40503 + self.mixed[:n] & SLOTS - 1)
        self.mixed[:n] = ids * 9973
        self.seen.append(self.place)
        self.step += 1
        if self.step % 16 == 0 or self.step in (1, 2, 4, 8):
            self.tried += np.bincount(np.concatenate(self.results), minlength=self.tried.size).reshape(self.tried.shape)
            self.results = []
            self._weights()
        if self.step % 64 == 0 or self.step & (self.step - 1) == 0:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.counts.size).reshape(self.counts.shape)
            self.seen = []
            self._level()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids; short blocks have fewer lanes, so that steps stay about 64."""
    lanes = max(1, min(LANES, -(-n // 64)))
    return lanes, -(-n // lanes)


def _order0(used: int) -> int:
    """Bits of order 0's parts for an alphabet."""
    return min(FINE, max(ORDER0, (used - 1).bit_length() + 3))


def _alike(members: list[int], steps: list[int], order0: int) -> Iterator[list[int]]:
    """At most SIDE members (fewer when order 0 is fine) at a time, in order of falling steps, none with less than half the steps of the first:
    their common arrays are hardly larger than what they hold, whatever the longest block."""
    part: list[int] = []
    for i in members:
        if part and (len(part) == max(1, SIDE >> order0 - ORDER0) or 2 * steps[i] < steps[part[0]]):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each array of ids as one block of bytes: the ids that it uses, then their places in that list, coded. Blocks of the same number of lanes and parts are coded side by side."""
    out: list[bytes] = [b""] * len(blocks)
    alphabets = [_used(x) for x in blocks]
    steps = [_shape(len(b))[1] for b in blocks]
    groups: dict[tuple[int, int], list[int]] = {}
    for i in sorted(range(len(blocks)), key=lambda i: -steps[i]):
        groups.setdefault((_shape(len(blocks[i]))[0], _order0(len(alphabets[i]))), []).append(i)
    for (lanes, order0), members in groups.items():
        for part in _alike(members, steps, order0):
            for i, data in zip(part, _encode([blocks[i] for i in part], [alphabets[i] for i in part], lanes, order0), strict=True):
                out[i] = data
    return out


def _used(ids: np.ndarray) -> np.ndarray:
    """The distinct ids, and 0, which fills up lanes, in order."""
    if len(ids) and ids.max() >= 1 << 20:
        return np.unique(np.append(ids, 0))
    there = np.bincount(ids.astype(np.int64), minlength=1)
    there[0] = 1
    return np.flatnonzero(there)


def _numbers(ids: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The place of each id among the used ones."""
    if used[-1] >= 1 << 20:
        return np.searchsorted(used, ids)
    number = np.zeros(used[-1] + 1, np.int64)
    number[used] = np.arange(len(used))
    return number.take(ids.astype(np.int64))


def _alphabet(ids: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes(), 1)


def _encode(blocks: list[np.ndarray], used: list[np.ndarray], lanes: int, order0: int) -> list[bytes]:
    steps = [_shape(len(x))[1] for x in blocks]  # descending
    ids = np.zeros((max(steps), len(blocks) * lanes), np.int32)
    for k, x in enumerate(blocks):
        own = np.zeros(lanes * steps[k], np.int32)
        own[: len(x)] = _numbers(x, used[k])
        ids[: steps[k], k * lanes : (k + 1) * lanes] = own.reshape(lanes, -1).T
    model = Model([len(u) for u in used], lanes, order0, inverse=False)
    low, size = np.zeros(len(model.off0), np.int64), np.full(len(model.off0), FULL, np.int64)
    # digits of 16 bits, and what was carried to them
    words, line = np.zeros((2 * max(steps) + 8, len(low)), np.int32), np.arange(len(low))
    flat, wide = words.reshape(-1), len(low)
    for t in range(max(steps)):
        n = sum(s > t for s in steps) * lanes
        now = ids[t, :n].astype(np.int64)
        start, share = model.interval(now, *model.predict(n))
        unit = size[:n] >> model.total
        start *= unit
        low[:n] += start
        np.multiply(unit, share, out=size[:n])
        at = np.flatnonzero(size[:n] < BOTTOM)
        while len(at):
            mine, own = low.take(at), size.take(at) << 16
            place = line.take(at)
            flat[place] = mine >> UNIT
            line[at] = place + wide
            low[at], size[at] = (mine & REST) << 16, own
            at = at[own < BOTTOM]
        model.update(now)
    for _ in range(4):  # what is left of low
        flat[line] = low >> UNIT
        line += wide
        low = (low & REST) << 16
    held = line // wide
    for t in range(held.max() - 1, 0, -1):
        words[t - 1] += words[t] >> 16
    words = words[: held.max()].astype("<u2").T
    out = []
    for k, x in enumerate(blocks):
        mine = slice(k * lanes, (k + 1) * lanes)
        table = _alphabet(used[k])
        data = table + held[mine].astype("<u4").tobytes() + b"".join(w[:h].tobytes() for w, h in zip(words[mine], held[mine].tolist(), strict=True))
        out.append(HEAD.pack(MAGIC, len(x), zlib.crc32(data), zlib.crc32(np.asarray(x, "<u4").tobytes()), lanes, 0, len(table)) + data)
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block. A block whose bytes or ids do not match its checksums is an error."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(blocks)
    steps = [_shape(h[1])[1] for h in heads]
    tables = [HEAD.size + h[6] for h in heads]
    used: list[np.ndarray] = []
    for head, data, table in zip(heads, blocks, tables, strict=True):
        if head[0] != MAGIC or zlib.crc32(data[HEAD.size :]) != head[2]:
            raise ValueError("damaged block")
        used.append(np.cumsum(np.frombuffer(zlib.decompress(data[HEAD.size : table]), "<u4")))
    groups: dict[tuple[int, int], list[int]] = {}
    for i in sorted(range(len(blocks)), key=lambda i: -steps[i]):
        groups.setdefault((heads[i][4], _order0(len(used[i]))), []).append(i)
    for (lanes, order0), members in groups.items():
        for part in _alike(members, steps, order0):
            for i, ids in zip(part, _decode([blocks[i][tables[i] :] for i in part], [heads[i][1] for i in part], [used[i] for i in part], lanes, order0), strict=True):
                if zlib.crc32(ids.tobytes()) != heads[i][3]:
                    raise ValueError("damaged block")
                out[i] = ids
    return out


def _decode(blocks: list[bytes], sizes: list[int], used: list[np.ndarray], lanes: int, order0: int) -> list[np.ndarray]:
    steps = [_shape(n)[1] for n in sizes]
    model = Model([len(u) for u in used], lanes, order0, inverse=True)
    own = np.concatenate([np.frombuffer(b, "<u4", lanes) for b in blocks]).astype(np.int64)
    words = np.concatenate([np.frombuffer(b, "<u2", offset=4 * lanes) for b in blocks]).astype(np.int64)
    at = np.cumsum(own) - own
    words = np.append(words, np.zeros(8, np.int64))
    size, code = np.full(len(at), FULL, np.int64), np.zeros(len(at), np.int64)  # code: of the stream, less the low end of the range
    for shift in (UNIT, UNIT - 16, UNIT - 32):
        code |= words[at] << shift
        at += 1
    code |= words[at] >> 4  # 60 bits are three words and 12 bits of the fourth
    words = (words[:-1] << 16 | words[1:]) >> 4 & 0xFFFF  # from a place's last 4 bits on: the next 16
    ids = np.zeros((max(steps), len(at)), np.int32)
    for t in range(max(steps)):
        n = sum(s > t for s in steps) * lanes
        mixed = model.predict(n)
        unit = size[:n] >> model.total
        now = model.find(code[:n] // unit, *mixed)
        start, share = model.interval(now, *mixed)
        start *= unit
        code[:n] -= start
        np.multiply(unit, share, out=size[:n])
        go = np.flatnonzero(size[:n] < BOTTOM)
        while len(go):
            place, own = at.take(go), size.take(go) << 16
            code[go] = code.take(go) << 16 | words.take(place)
            at[go] = place + 1
            size[go] = own
            go = go[own < BOTTOM]
        ids[t, :n] = now
        model.update(now)
    return [used[k][np.ascontiguousarray(ids[: steps[k], k * lanes : (k + 1) * lanes].T).reshape(-1)[: sizes[k]]].astype("<u4") for k in range(len(blocks))]
