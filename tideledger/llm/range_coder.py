"""Blocks of token ids, coded by an adaptive context-mixing range coder.

A block is coded on its own: tables start afresh, and a checksum covers the ids.  Its ids are
dealt to lanes, consecutive stretches that are coded side by side; one numpy step codes one
id of every lane, and all lanes teach the same tables.  Each id is coded as

1. a bit: is it the id predicted by order 2 (the two ids before), or, where that is unknown,
   by order 1?  The bit's probability mixes, in the logistic domain with weights learned on
   the way, what the order-2, order-1 and order-0 tables say about that id;
2. on a miss the id itself by adaptive order-0 frequencies.

The mix depends on three small counters only (trust of order 2, trust of order 1 and whether
both agree, level of the id's frequency), so each step mixes once for all CONTEXTS of them.
All model arithmetic is on integers: a block decodes alike on every machine.

Layout (little-endian): magic, crc32 of all that follows, number of ids, lanes, vocabulary,
crc32 of the ids, words per lane (uint32), then the lanes' 16-bit words one after another.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
LANES = 4096
LANE_IDS = 128
TOTAL_BITS = 20
NEAR_BITS = 4
ORDER2 = 1 << 18
CONTEXTS = 8 * 16 * 16
_HEAD = struct.Struct("<4sI")
_BODY = struct.Struct("<IIII")
_U = np.uint64
_FULL, _LEAST = _U((1 << 48) - 1), _U(1 << 32)

_x = [math.log(max(i, 0.5) / (4096 - max(i, 0.5))) for i in range(4096)]
STRETCH = np.array([max(-2047, min(2047, round(v * 256))) for v in _x], np.int64)
SQUASH = np.array([max(16, min(4080, round(4096 / (1 + math.exp(-v / 256))))) for v in range(-2048, 2048)], np.int64)
#: New trust of a prediction: after a miss (0..7: the trust before) and after a hit (8..15).
TRUST = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int32)


class Model:
    """Tables of one block; encoder and decoder bring them through the same states.

    A prediction is one number: 8 * id + trust.
    """

    def __init__(self, lanes: int, vocabulary: int):
        self.size = vocabulary
        self.first = np.zeros(lanes, np.int32)  # the id before
        self.second = np.zeros(lanes, np.int32)  # the one before that
        self.order1 = np.zeros(vocabulary, np.int32)
        self.order2 = np.zeros(ORDER2, np.int32)
        self.odds = [np.full(8, 20000, np.int64), np.full(16, 16000, np.int64), np.full(16, 8000, np.int64)]
        self.weights = [24000, 20000, 16000]
        self.seen = np.zeros(vocabulary, np.int64)
        self.recent: list[np.ndarray] = []
        self.step = 0
        self._rebuild()
        self._mix()

    def _rebuild(self) -> None:
        """Order-0 frequencies of all ids so far."""
        if self.recent:
            self.seen += np.bincount(np.concatenate(self.recent), minlength=self.size)
            self.recent = []
        sums = np.cumsum(1 + 32 * self.seen)
        spare = (1 << TOTAL_BITS) - self.size
        self.upto = np.zeros(self.size + 1, np.int64)
        self.upto[1:] = np.arange(1, self.size + 1) + sums * spare // sums[-1]
        self.width = np.diff(self.upto)
        self.level = np.minimum(15, np.log2(1.0 + self.seen).astype(np.int32)).astype(np.int32)
        steps = np.diff((self.upto + (1 << NEAR_BITS) - 1) >> NEAR_BITS)
        self.near = np.repeat(np.arange(self.size, dtype=np.int32), steps)

    def _mix(self) -> None:
        self.inputs = [STRETCH[odds >> 4] for odds in self.odds]
        a, b, c = (w * s for w, s in zip(self.weights, self.inputs, strict=True))
        dot = (a[:, None, None] + b[None, :, None] + c[None, None, :]) >> 16
        self.chance = SQUASH[np.minimum(np.maximum(dot, -2048), 2047) + 2048].reshape(-1)

    def predict(self) -> None:
        """The predicted ids of this step and the probabilities (of 4096) that they are right."""
        self.slot = ((self.second * np.int32(40503) + self.first * np.int32(30341)) >> np.int32(3)) & np.int32(ORDER2 - 1)
        self.g2, self.g1 = self.order2[self.slot], self.order1[self.first]
        trust2 = self.g2 & 7
        self.main = np.where(trust2 > 0, self.g2, self.g1) >> 3
        agree = (self.g1 >> 3) == self.main
        self.context = (((trust2 << 1) | agree) << 7) | ((self.g1 & 7) << 4) | self.level[self.main]
        self.p = self.chance[self.context]

    @staticmethod
    def _learn(odds: np.ndarray, times: np.ndarray, right: np.ndarray) -> None:
        used = times > 0
        goal = right[used] * 65535 // times[used]
        odds[used] += (goal - odds[used]) * np.minimum(times[used], 48) // 64
        np.minimum(np.maximum(odds, 64, out=odds), 65471, out=odds)

    def update(self, ids: np.ndarray, hits: np.ndarray) -> None:
        shape = (8, 16, 16)
        times = np.bincount(self.context, minlength=CONTEXTS)
        right = np.bincount(self.context[hits], minlength=CONTEXTS)
        error = ((right << 12) - times * self.chance).reshape(shape)
        times, right = times.reshape(shape), right.reshape(shape)
        for k, rest in enumerate(((1, 2), (0, 2), (0, 1))):
            push = int(np.dot(error.sum(rest), self.inputs[k])) // (len(ids) * 256)
            self.weights[k] = min(131072, max(-65536, self.weights[k] + push))
            self._learn(self.odds[k], times.sum(rest), right.sum(rest))
        self._mix()
        for table, where, guess in ((self.order1, self.first, self.g1), (self.order2, self.slot, self.g2)):
            trust, known = guess & 7, guess >> 3
            good = known == ids
            table[where] = (np.where(good | (trust > 1), known, ids) << 3) | TRUST[trust + (good.astype(np.int32) << 3)]
        self.second, self.first = self.first, ids
        self.recent.append(ids)
        self.step += 1
        if self.step & (self.step - 1) == 0:
            self._rebuild()

    def symbol(self, value: np.ndarray) -> np.ndarray:
        """The id whose frequency range holds each value."""
        s = self.near[value >> NEAR_BITS]
        for _ in range(3):  # `near` is at or below
            up = self.upto[s + 1] <= value
            if not up.any():
                return s
            s = s + up
        late = np.flatnonzero(self.upto[s + 1] <= value)
        s[late] = np.searchsorted(self.upto, value[late], "right") - 1
        return s


class Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, _FULL, _U)
        self.room = 3 * steps + 8
        self.words = np.zeros(lanes * self.room, np.uint16)
        self.at = np.arange(lanes) * self.room

    def code(self, hit: np.ndarray, p: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Codes the bits, and for misses the part [start, start + width) of 2**TOTAL_BITS."""
        part = (self.range >> _U(12)) * p.astype(_U)
        miss = self.range - part
        unit = miss >> _U(TOTAL_BITS)
        self.low = np.where(hit, self.low, self.low + part + unit * start.astype(_U))
        self.range = np.where(hit, part, unit * width.astype(_U))
        over = np.flatnonzero(self.low > _FULL)
        if len(over):
            self.low[over] &= _FULL
            place = self.at[over] - 1
            while len(place):
                value = self.words[place] + np.uint16(1)
                self.words[place] = value
                place = place[value == 0] - 1
        small = self.range < _LEAST
        while small.any():
            self.words[self.at] = (self.low >> _U(32)).astype(np.uint16)  # of lanes that stay, written over later
            self.at += small
            self.low = np.where(small, (self.low & _U((1 << 32) - 1)) << _U(16), self.low)
            self.range = np.where(small, self.range << _U(16), self.range)
            small = self.range < _LEAST

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        for shift in (32, 16, 0):
            self.words[self.at] = (self.low >> _U(shift)).astype(np.uint16)
            self.at += 1
        used = self.at - np.arange(len(self.at)) * self.room
        mask = np.arange(self.room)[None, :] < used[:, None]
        return used.astype(np.uint32), self.words.reshape(-1, self.room)[mask]


class Decoder:
    def __init__(self, used: np.ndarray, words: np.ndarray):
        self.words = np.concatenate((words, np.zeros(4, np.uint16))).astype(_U)
        self.at = np.cumsum(used.astype(np.int64)) - used
        self.value = np.zeros(len(used), _U)
        for _ in range(3):
            self.value = (self.value << _U(16)) | self.words[self.at]
            self.at = self.at + 1
        self.range = np.full(len(used), _FULL, _U)

    def code(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """The ids of this step and which of them were predicted."""
        part = (self.range >> _U(12)) * model.p.astype(_U)
        hit = self.value < part
        rest = np.flatnonzero(~hit)
        ids, rng = model.main.copy(), part
        if len(rest):
            below = part[rest]
            unit = (self.range[rest] - below) >> _U(TOTAL_BITS)
            value = self.value[rest] - below
            x = model.symbol(np.minimum(value // unit, _U((1 << TOTAL_BITS) - 1)).astype(np.int64))
            ids[rest] = x
            self.value[rest] = value - unit * model.upto[x].astype(_U)
            rng[rest] = unit * model.width[x].astype(_U)
        small = rng < _LEAST
        while small.any():
            self.value = np.where(small, (self.value << _U(16)) | self.words[self.at], self.value)
            self.at += small
            rng = np.where(small, rng << _U(16), rng)
            small = rng < _LEAST
        self.range = rng
        return ids, hit


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    if n and (int(ids.max()) >= vocabulary or int(ids.min()) < 0):
        raise ValueError("an id lies outside the vocabulary")
    lanes, steps = _shape(n)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, out = Model(lanes, vocabulary), Encoder(lanes, steps)
    for own in columns:
        model.predict()
        hit = own == model.main
        out.code(hit, model.p, model.upto[own], model.width[own])
        model.update(own, hit)
    used, words = out.finish()
    body = _BODY.pack(n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes())) + used.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    magic, checksum = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != checksum:
        raise ValueError("damaged block of token ids")
    n, lanes, vocabulary, ids_checksum = _BODY.unpack_from(body)
    used = np.frombuffer(body, "<u4", lanes, _BODY.size)
    words = np.frombuffer(body, "<u2", -1, _BODY.size + 4 * lanes)
    steps = -(-n // lanes) if n else 0
    columns = np.zeros((steps, lanes), np.int32)
    model, source = Model(lanes, vocabulary), Decoder(used, words)
    for k in range(steps):
        model.predict()
        columns[k], hit = source.code(model)
        model.update(columns[k], hit)
    ids = columns.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_checksum:
        raise ValueError("decoded ids do not match their checksum")
    return ids
