"""Adaptive context-mixing range coder for token ids, in blocks that stand alone.

A block maps its distinct ids to symbols 0..k-1 (the sorted ids are in its header) and deals
its symbols to lanes, contiguous runs of equal length. At each step every lane codes its next
symbol in one NumPy operation over the lanes, so the coder costs a few array operations a
step, not interpreter time a token. All lanes share one model that starts empty in each block:

order 0   symbol frequencies, scaled to 2^17, renewed every few steps;
order 1   for each previous symbol a predicted symbol and how often it held (0-7);
order 2   the same for a hash of the two previous symbols.

A symbol's probability mixes the three: the predicted symbols get the weights that
predictions of their confidence have earned in this block so far, the frequencies the rest.
The mixed interval drives a carry-less range coder (64-bit low and range, 16-bit output).
Encoder and decoder run the same model code, in integers only.
"""

import struct
import zlib

import numpy as np

MAGIC = b"BYT2"
_HEAD = struct.Struct("<4sIIIIIII")
_F0, _W = 17, 8
_TOTAL = _F0 + _W
_RENEW = 16
_H2 = 18
_A, _B = 0x9E3779B1, 0x85EBCA77
_TOP, _BOT, _16, _48 = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16), np.uint64(48)
_SCALE, _LAST = np.uint64(_TOTAL), np.uint64((1 << _TOTAL) - 1)
_MAX_LANES, _LEAST_STEPS = 4096, 256


class _Model:
    """Predictions are kept as 8 * symbol + confidence, below 0 while there is none; all counts of lanes are 32-bit."""

    def __init__(self, k: int, lanes: int, decodes: bool):
        self.k, self.decodes = k, decodes
        self.counts = np.ones(k, np.int64)
        self.known1, self.known2 = np.full(k, -8, np.int32), np.full(1 << _H2, -8, np.int32)
        self.last, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        # For each confidence pair: codings, hits of order 2, hits of order 1.
        self.tried, self.hit2, self.hit1 = np.full(128, 8, np.int64), np.full(128, 2, np.int64), np.full(128, 2, np.int64)
        self.seen: list[np.ndarray] = []
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []
        self.steps = 0
        # What orders 1 and 2 say of each lane's next symbol.
        self.known = np.empty((2, lanes), np.int32)
        self._renew()

    def _renew(self) -> None:
        """Frequencies and weights from what has been coded."""
        if self.seen:
            self.counts += 32 * np.bincount(np.concatenate(self.seen), minlength=self.k)
            cell = np.concatenate([c for c, _ in self.cells])
            hit = np.concatenate([h for _, h in self.cells], 1)
            self.tried += np.bincount(cell, minlength=128)
            self.hit1 += np.bincount(cell[hit[0]], minlength=128)
            self.hit2 += np.bincount(cell[hit[1]], minlength=128)
            self.seen, self.cells = [], []
        f = 1 + self.counts * ((1 << _F0) - self.k) // int(self.counts.sum())
        f[np.argmax(f)] += (1 << _F0) - int(f.sum())
        self.freq = f.astype(np.int32)
        self.cum = np.cumsum(self.freq, dtype=np.int32) - self.freq
        if self.decodes:
            self.inverse = np.repeat(np.arange(self.k, dtype=np.int32), f)
        full = (1 << _W) - 2
        w2 = np.minimum(self.hit2 * full // self.tried, full)
        w2[:8] = w2[64:72] = 0  # no order-2 prediction yet
        w1 = np.minimum(self.hit1 * full // self.tried, full - w2)
        w1[:64:8] = 0  # no order-1 prediction yet
        w1[64:] = 0  # both predict one symbol: order 2 speaks
        self.w1, self.w2 = (w1 << _F0).astype(np.int32), (w2 << _F0).astype(np.int32)
        self.w0 = ((1 << _W) - w1 - w2).astype(np.int32)

    def predict(self) -> None:
        self.at2 = ((self.last * _A ^ self.last2 * _B) >> 14) & ((1 << _H2) - 1)
        self.known1.take(self.last, out=self.known[0], mode="clip")
        self.known2.take(self.at2, out=self.known[1], mode="clip")
        self.p, self.c = self.known >> 3, self.known & 7
        self.cell = ((self.c[1] << 3) + self.c[0] + ((self.p[0] == self.p[1]).view(np.int8) << np.int32(6))).astype(np.int64)
        self.m0, self.m1, self.m2 = (w.take(self.cell, mode="clip") for w in (self.w0, self.w1, self.w2))

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the interval of each lane's symbol starts and its size. A prediction that is missing has no weight."""
        below, self.hit, self.now = self.p < x, self.p == x, x.astype(np.int64)
        low = self.m0 * self.cum.take(self.now, mode="clip")
        low += self.m1 * below[0]
        low += self.m2 * below[1]
        size = self.m0 * self.freq.take(self.now, mode="clip")
        size += self.m1 * self.hit[0]
        size += self.m2 * self.hit[1]
        return low.astype(np.uint64), size.astype(np.uint64)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The symbols whose intervals hold v: by the frequencies, once the predictions' weights below v are taken off."""
        p1, p2 = self.p
        low1, low2 = (self.m0 * self.cum.take(p, mode="clip") for p in self.p)
        low1 += self.m2 * (p2 < p1)
        low2 += self.m1 * (p1 < p2)
        u = v - np.minimum(np.maximum(v - low1, 0), self.m1)
        u -= np.minimum(np.maximum(v - low2, 0), self.m2)
        return self.inverse.take((u.view(np.uint32) // self.m0.view(np.uint32)).astype(np.int64), mode="clip")

    def learn(self, x: np.ndarray) -> None:
        """A hit raises a prediction's confidence, a miss halves it; at 0 the symbol takes the prediction's place."""
        missed = np.where(self.c > 1, self.known - self.c + (self.c >> 1), (x << 3) + 1)
        new = np.where(self.hit, self.known + (self.c < 7), missed)
        self.known1[self.last] = new[0]
        self.known2[self.at2] = new[1]
        self.seen.append(x)
        self.cells.append((self.cell, self.hit))
        self.last2, self.last = self.last, self.now
        self.steps += 1
        if self.steps % _RENEW == 0 or self.steps in (1, 2, 4, 8):
            self._renew()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(_MAX_LANES, n // _LEAST_STEPS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    """ids (unsigned 32-bit) to a block."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    alphabet, symbols = _alphabet(ids)
    lanes, steps = _shape(n)
    known = zlib.compress(np.diff(alphabet, prepend=np.uint32(0)).astype("<u4").tobytes(), 6)
    if n and len(alphabet) > 1:
        grid = np.zeros(lanes * steps, np.int32)
        grid[:n] = symbols
        lengths, words = _encode(np.ascontiguousarray(grid.reshape(lanes, steps).T), len(alphabet))
    else:  # an empty block, or one id throughout: the header says it all
        lengths, words = np.zeros(lanes, np.uint32), np.zeros(0, np.uint16)
    sizes = zlib.compress(lengths.astype("<u4").tobytes(), 6)
    body = known + sizes + words.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, n, lanes, len(alphabet), len(known), len(sizes), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if a checksum is wrong."""
    magic, n, lanes, k, known, sizes, ids_crc, body_crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(body[:known]), "<u4").astype(np.uint64)).astype(np.uint32)
    if n and k > 1:
        lengths = np.frombuffer(zlib.decompress(body[known : known + sizes]), "<u4").astype(np.int64)
        words = np.frombuffer(body[known + sizes :], "<u2")
        ids = alphabet[_decode(words, lengths, -(-n // lanes), k).T.reshape(-1)[:n]]
    else:
        ids = np.repeat(alphabet, n)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return ids


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) and int(ids.max()) < 1 << 22:
        known = np.zeros(int(ids.max()) + 1, bool)
        known[ids] = True
        return np.flatnonzero(known).astype(np.uint32), (np.cumsum(known) - 1)[ids]
    return np.unique(ids, return_inverse=True)


def _encode(grid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    steps, lanes = grid.shape
    model = _Model(k, lanes, False)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, used = np.zeros((lanes, steps + 64), np.uint16), np.zeros(lanes, np.int64)
    for x in grid:
        model.predict()
        start, width = model.interval(x)
        size >>= _SCALE
        low += size * start
        size *= width
        if int(used.max()) + 8 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        for at in _unsettled(low, size):
            out[at, used[at]] = low[at] >> _48
            used[at] += 1
            low[at] <<= _16
            size[at] <<= _16
        model.learn(x)
    for _ in range(4):
        out[np.arange(lanes), used] = low >> _48
        used += 1
        low <<= _16
        if int(used.max()) + 1 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
    return used.astype(np.uint32), out[np.arange(out.shape[1]) < used[:, None]]


def _decode(words: np.ndarray, lengths: np.ndarray, steps: int, k: int) -> np.ndarray:
    lanes = len(lengths)
    stream = np.concatenate([words, np.zeros(8, words.dtype)]).astype(np.uint64)
    at_word = np.cumsum(lengths) - lengths
    code = np.zeros(lanes, np.uint64)  # what is read of the stream, less low
    for _ in range(4):
        code = (code << _16) | stream[at_word]
        at_word += 1
    model = _Model(k, lanes, True)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    grid = np.empty((steps, lanes), np.int32)
    for x in grid:
        model.predict()
        size >>= _SCALE
        x[:] = model.find(np.minimum(code // size, _LAST).astype(np.int32))
        start, width = model.interval(x)
        start *= size
        code -= start
        low += start
        size *= width
        for at in _unsettled(low, size):
            code[at] = (code[at] << _16) | stream[at_word[at]]
            at_word[at] += 1
            low[at] <<= _16
            size[at] <<= _16
        model.learn(x)
    return grid


def _unsettled(low: np.ndarray, size: np.ndarray):
    """Yields the lanes whose leading 16 bits must move out; the caller moves them."""
    equal = (low ^ (low + size)) < _TOP
    at = np.flatnonzero(equal | (size < _BOT))
    equal = equal[at]
    while len(at):
        if not equal.all():
            cut = at[~equal]
            size[cut] = (~low[cut] + np.uint64(1)) & (_BOT - np.uint64(1))
        yield at
        sub_low, sub_size = low[at], size[at]
        equal = (sub_low ^ (sub_low + sub_size)) < _TOP
        still = equal | (sub_size < _BOT)
        at, equal = at[still], equal[still]
