"""Range coding of token ids by mixed predictions, many blocks side by side.

An id is predicted by three orders. Order 2 and order 1 each name one id: the one that
followed the last time that the two ids (the one id) before it stood in the block, with
a state of trust: unused, missed last, hit once, hit more often. Order 0 is a whole distribution: the counts
of the file, which stand in its head. The mixture gives order 2 and order 1 each a weight
for its id and order 0 the rest; weights are learnt in the block for every joint state of
the two, from how often each was right. The mixture drives a range coder. A block starts
without any of this, so any block can be decoded without another.

numpy steps through the k-th id of all blocks at a time. All arithmetic is on integers,
so that encoder and decoder agree on any machine.
"""

from __future__ import annotations

import numpy as np

#: Ids a block, and blocks that are coded side by side.
BLOCK, LANES = 2048, 4096
SLOTS1, SLOTS2 = 9, 9  # bits of the tables of order 1 and 2; larger ones cost more in cache misses than they save
STATES, RATE = 32, 5
_U = np.uint64
#: The coder's interval has 63 bits; below 31 bits it gives out 32.
WHOLE, LEAST = 1 << 63, _U(1 << 31)
_16, _31, _32, _LOW, _LOW32 = _U(16), _U(31), _U(32), _U((1 << 31) - 1), _U((1 << 32) - 1)
#: Order 0 has so many bits at most; the least width of an interval is then still 1.
MOST_BITS = 24


class Shares:
    """Order 0: each place (of a file's distinct ids) has a share of 2**bits, after its count; the last entry is a whole that isn't divided."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        if n > 1 << MOST_BITS:
            raise ValueError(f"{n} different ids in a segment, {1 << MOST_BITS} are the most")
        self.bits = max(12, min(n.bit_length() + 3, MOST_BITS))
        total = 1 << self.bits
        share = 1 + counts.astype(np.int64) * (total - n) // max(int(counts.sum()), 1)
        share[int(np.argmax(counts))] += total - int(share.sum())
        # narrow types, as most time goes by waiting for memory
        self.kind = np.uint16 if n < 1 << 14 else np.uint32
        self.find = np.repeat(np.arange(n, dtype=self.kind), share)
        # start in the upper, share in the lower 32 bits
        self.parts = np.append((np.cumsum(share) - share) << 32 | share, 1).astype(_U)
        self.whole = n


class _Mixture:
    """Orders 1 and 2 of all blocks, and the weights of the mixture. Rows 0 and 1 of an array are order 2 and order 1.

    Ids are given as place + 1: 0 is none."""

    def __init__(self, lanes: int, shares: Shares) -> None:
        lane = np.arange(lanes, dtype=np.int64)
        # entries: (place + 1) * 4 + state of trust
        self.kind = shares.kind
        self.table = np.zeros((lanes << SLOTS2) + (lanes << SLOTS1), self.kind)
        self.first = np.stack([lane << SLOTS2, (lanes << SLOTS2) + (lane << SLOTS1)])
        self.at = self.first
        # weights, of 65536: order 2 in the lower, order 1 in the upper 16 bits
        self.weights = np.tile(_FIRST[0] | _FIRST[1] << 16, lanes).astype(np.uint32)
        self.lane = lane * STATES
        self.before = np.zeros(lanes, np.uint32)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids that order 2 and order 1 name, and their weights."""
        if self.at.shape[1] > m:  # the last block has ended
            self.at, self.first, self.lane, self.before = self.at[:, :m].copy(), self.first[:, :m].copy(), self.lane[:m], self.before[:m]
        entry = self.table.take(self.at)
        self.trust = entry & 3
        self.named = entry >> 2
        state = (self.trust[0] << 3) + (self.trust[1] << 1)
        state += self.named[0] == self.named[1]
        self.state = self.lane + state
        both = self.weights.take(self.state)
        self.known = np.empty((2, m), np.uint32)
        np.bitwise_and(both, 0xFFFF, out=self.known[0])
        np.right_shift(both, 16, out=self.known[1])
        return self.named, self.known

    def learn(self, own: np.ndarray, hit: np.ndarray, right: np.ndarray) -> None:
        """hit: which orders named the id; right: which one it was coded by."""
        known = self.known.view(np.int32)
        known += (right * _RISE + _LEAST - known) >> RATE
        self.weights[self.state] = self.known[0] | self.known[1] << 16
        entry = np.minimum(self.trust, 2)
        entry *= hit
        entry += (own << 2) + self.kind(1)
        self.table[self.at] = entry
        value = own * np.uint32(0x9E3779B1)
        h = np.empty((2, len(own)), np.uint32)
        np.multiply(self.before * np.uint32(0x2545F491) + value, np.uint32(0x85EBCA6B), out=h[0])
        h[1] = self.before = value
        h >>= _SLOT_SHIFT
        self.at = self.first + h


_SLOT_SHIFT = np.array([[32 - SLOTS2], [32 - SLOTS1]], np.uint32)
# weights of a fresh block by state, of order 2 by its own trust, of order 1 by both
_TRUST2, _TRUST1 = np.arange(STATES) >> 3, np.arange(STATES) >> 1 & 3
_FIRST = np.stack([np.array([100, 3000, 24000, 48000])[_TRUST2], np.array([100, 3000, 12000, 24000])[_TRUST1] >> np.maximum(_TRUST2 - 1, 0)]).astype(np.int64)
# a weight moves between these two: none is 0, and order 0 keeps a hundredth at least
_LEAST, _RISE, _ALL = np.int32(64), np.int32(64512 - 64), np.uint32(65536)


def encode(places: np.ndarray, lengths: np.ndarray, shares: Shares) -> list[bytes]:
    """Codes of blocks of places, one after the other; all blocks but the last are equally long, none is empty."""
    lanes, length, last = len(lengths), int(lengths[0]), int(lengths[-1])
    model = _Mixture(lanes, shares)
    data = np.zeros((length, lanes), model.kind)
    data[:, : lanes - 1] = places[: (lanes - 1) * length].reshape(lanes - 1, length).T
    data[:last, lanes - 1] = places[(lanes - 1) * length :]
    low, span = np.zeros(lanes, _U), np.full(lanes, WHOLE, _U)
    words = np.zeros((length + 1, lanes), _U)  # an id takes a word at most; blocks go on at much the same pace, so this is written row by row
    flat, to = words.reshape(-1), np.arange(lanes)
    bits = _U(shares.bits)

    def renew(who: np.ndarray) -> None:
        out, at = low[who], to[who]
        flat[at] = out >> _31
        to[who] = at + lanes
        low[who] = (out & _LOW) << _32
        span[who] <<= _32

    for i in range(length):
        m = lanes if i < last else lanes - 1
        place = data[i, :m]
        own = place + model.kind(1)
        named, weight = model.predict(m)
        hit = named == own
        right = hit.copy()
        right[1] &= ~hit[0]
        neither = ~(hit[0] | hit[1])
        both = weight[0] + weight[1]
        start = np.where(neither, both, weight[0] * right[1])
        width = np.where(neither, _ALL - both, np.where(hit[0], weight[0], weight[1]))
        part = shares.parts.take(np.where(neither, place, shares.whole))
        step = span[:m] >> _16
        inner = step * width >> neither * bits
        low[:m] += step * start + inner * (part >> _32)
        np.multiply(inner, part & _LOW32, out=span[:m])
        small = np.flatnonzero(span[:m] < LEAST)
        if small.size:
            renew(small)
        model.learn(own, hit, right)
    # the interval holds a number that ends in 31 zeros; zeros aren't written
    low += _LOW
    renew(np.arange(lanes))
    filled = to // lanes
    # what overflowed 32 bits goes to the word before
    words = words[: int(filled.max())]
    while (over := words >> _32).any():
        words &= _LOW32
        words[:-1] += over[1:]
    out = np.ascontiguousarray(words.T, "<u4")
    return [out[k, : filled[k]].tobytes() for k in range(lanes)]


def decode(codes: list[bytes], lengths: np.ndarray, shares: Shares) -> np.ndarray:
    """The places of all blocks, one after the other."""
    lanes, length, last = len(codes), int(lengths[0]), int(lengths[-1])
    model = _Mixture(lanes, shares)
    size = max(map(len, codes)) // 4 + 2
    words = np.zeros((lanes, size), "<u4")
    for k, c in enumerate(codes):
        words[k, : len(c) // 4] = np.frombuffer(c, "<u4")
    words = np.ascontiguousarray(words.T, np.uint32)
    code = words[0].astype(_U) << _31 | words[1] >> 1
    # the interval's 63 bits end within a word, so these are 32 bits from there on
    words[:-1] = words[:-1] << 31 | words[1:] >> 1
    flat, at, end = words.reshape(-1), np.arange(lanes) + lanes, (size - 1) * lanes
    span = np.full(lanes, WHOLE, _U)
    out = np.zeros((length, lanes), model.kind)
    bits, most = _U(shares.bits), _U((1 << shares.bits) - 1)
    for i in range(length):
        m = lanes if i < last else lanes - 1
        named, weight = model.predict(m)
        step = span[:m] >> _16
        both = weight[0] + weight[1]
        first, second = step * weight[0], step * both
        rest = code[:m]
        neither, later = rest >= second, rest >= first
        rest = rest - np.where(neither, second, first * later)
        width = np.where(neither, _ALL - both, np.where(later, weight[1], weight[0]))
        inner = step * width >> neither * bits
        place = shares.find.take(np.minimum(rest // inner, most).view(np.int64))
        part = shares.parts.take(np.where(neither, place, shares.whole))
        np.subtract(rest, inner * (part >> _32), out=code[:m])
        np.multiply(inner, part & _LOW32, out=span[:m])
        own = np.where(neither, place + model.kind(1), np.where(later, named[1], named[0]))
        small = np.flatnonzero(span[:m] < LEAST)
        if small.size:
            where = at[small]
            code[small] = code[small] << _32 | flat[where]
            at[small] = np.minimum(where + lanes, end)
            span[small] <<= _32
        hit = named == own
        right = hit.copy()
        right[1] &= ~hit[0]
        model.learn(own, hit, right)
        out[i, :m] = own
    out -= model.kind(1)
    return out.T.reshape(-1)[: int(lengths.sum())]
