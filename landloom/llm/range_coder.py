"""Adaptive context-mixing range coder for token ids, run over many blocks in step.

Blocks are independent: every block starts from the same empty model. The coder advances all blocks ("lanes") by one id
at a time with numpy, so the cost of Python is shared by the lanes and a block can still be decoded by itself.

The probability of an id mixes three predictions, ``g2 * [id = p2] + g1 * [id = p1] + g0 * P0(id)``:

* p2 and p1 are the ids last seen in the block's contexts of order 2 and 1 (the two ids before, the one before);
* P0 is order 0: the frequencies of the block's ids so far, and an escape for ids not counted yet, whose bits stand in
  their order at the head of the payload, as many for each as the largest of them has;
* the gates g adapt under the confidences of the two contexts (how often each was right lately).

P0 is brought up to date at fixed places, after 32, 64, 128, ... and then every ``STRIDE`` ids, so between them an id is one
table lookup. An id is one interval of ``2 ** 27`` parts, the product of gate and P0. Arithmetic is in integers only, so a
block decodes alike on every machine.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block, at most, and the bits of an id.
BLOCK = 16384
ID_BITS = 17
STRIDE = 2048
_SLOTS1, _SLOTS2 = 1 << 12, 1 << 13
_STATES = 8
_GATE, _FREQ = 12, 15
_ALL0 = 1 << _FREQ
_U = np.uint64
_TOP, _LOW = _U(1 << 48), _U((1 << 32) - 1)
#: Gates are kept in 16 bits; each of the three keeps at least this share.
_ROOM, _RATE = 384, 5


def _bounds(steps: int) -> list[int]:
    """Places at which order 0 is brought up to date."""
    out = [0]
    while out[-1] < steps:
        out.append(min(steps, out[-1] + min(max(out[-1], 32), STRIDE)))
    return out


class _Order0:
    """Frequencies of one block's ids, in id order."""

    def __init__(self):
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.start = np.array([0, _ALL0], np.int64)

    def learn(self, seen: np.ndarray) -> None:
        found, times = np.unique(seen, return_counts=True)
        at = np.searchsorted(self.ids, found)
        old = at < len(self.ids)
        old[old] = self.ids[at[old]] == found[old]
        self.counts[at[old]] += times[old]
        fresh = ~old
        self.ids = np.insert(self.ids, at[fresh], found[fresh])
        self.counts = np.insert(self.counts, at[fresh], times[fresh])
        n, total = len(self.ids), int(self.counts.sum())
        escape = min(max(8, _ALL0 * int(fresh.sum()) // len(seen)), _ALL0 - n >> 1)
        freq = 1 + self.counts * (_ALL0 - n - escape) // total
        self.start = np.concatenate(([0], np.cumsum(np.concatenate(([_ALL0 - int(freq.sum())], freq)))))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id (from 1), 0 where it has none yet."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at + 1, 0)


class _Contexts:
    """Predictions of order 2 and 1 and the gates, for all lanes."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.t1, self.t2 = np.full(lanes * _SLOTS1, -1, np.int32), np.full(lanes * _SLOTS2, -1, np.int32)
        self.c1, self.c2 = np.zeros(lanes * _SLOTS1, np.int8), np.zeros(lanes * _SLOTS2, np.int8)
        self.a, self.b = np.full(lanes * _STATES**2, 1024, np.int64), np.full(lanes * _STATES**2, 2048, np.int64)

    def predict(self, n: int):
        """(order 2's id, order 1's id, end of order 2's gate, end of order 1's) for the first n lanes."""
        lane, p1 = self.lane[:n], self.p1[:n]
        h = p1 * 0x9E3B1
        self.k1 = (h >> 6 & _SLOTS1 - 1) + lane * _SLOTS1
        self.k2 = (h + self.p2[:n] * 0x1F35B7 >> 5 & _SLOTS2 - 1) + lane * _SLOTS2
        self.q1, self.q2 = self.t1.take(self.k1), self.t2.take(self.k2)
        self.s1, self.s2 = self.c1.take(self.k1), self.c2.take(self.k2)
        self.g = lane * _STATES**2 + (self.s2 * np.int8(_STATES) + self.s1)
        self.ga, self.gb = self.a.take(self.g), self.b.take(self.g)
        return self.q2, self.q1, self.ga >> 4, self.gb >> 4

    def learn(self, n: int, x: np.ndarray, hit2: np.ndarray, miss: np.ndarray) -> None:
        self.a[self.g] = self.ga + (np.where(hit2, 65536 - 2 * _ROOM, _ROOM) - self.ga >> _RATE)
        self.b[self.g] = self.gb + (np.where(miss, 2 * _ROOM, 65536 - _ROOM) - self.gb >> _RATE)
        for t, c, k, q, s in ((self.t2, self.c2, self.k2, self.q2, self.s2), (self.t1, self.c1, self.k1, self.q1, self.s1)):
            hit = q == x
            t[k] = np.where(hit | (s <= 1), x, q)
            c[k] = np.where(hit, np.minimum(s + 1, _STATES - 1), s >> 1)
        self.p2[:n] = self.p1[:n]
        self.p1[:n] = x


def _pack(ids: np.ndarray) -> bytes:
    """Number and width of ids (32 and 8 bits), and their bits."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    bits = (ids[:, None] >> np.arange(width)) & 1
    return np.array([len(ids)], "<u4").tobytes() + bytes([width]) + np.packbits(bits.astype(np.uint8)).tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, int]:
    """The ids that ``_pack`` wrote, and where they end."""
    n, width = int(np.frombuffer(payload, "<u4", 1)[0]), payload[4]
    end = 5 + -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, end - 5, 5), count=n * width).reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)), end


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of at most ``BLOCK`` ids below 2 ** ``ID_BITS``."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    lengths = np.array([len(blocks[k]) for k in order], np.int64)
    lanes, steps = len(order), int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than the step
    contexts, zeroth = _Contexts(lanes), [_Order0() for _ in order]
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    out: list[list[np.ndarray]] = [[] for _ in order]
    fresh: list[list[np.ndarray]] = [[] for _ in order]
    words, pos = np.zeros((lanes, 2 * STRIDE + 16), np.uint16), np.zeros(lanes, np.int64)

    def shift(n):
        """Emit settled words of the first n lanes until their ranges are wide enough."""
        at = None
        while True:
            lo, sp = (low[:n], span[:n]) if at is None else (low[at], span[at])
            settled = (lo ^ (lo + sp)) < _TOP
            need = np.flatnonzero(settled | (sp <= _LOW))
            if not len(need):
                return
            lo, sp, settled = lo.take(need), sp.take(need), settled.take(need)
            at = need if at is None else at.take(need)
            sp = np.where(settled, sp, -lo & _LOW)
            words[at, pos[at]] = (lo >> _U(48)).astype(np.uint16)
            pos[at] += 1
            low[at], span[at] = lo << _U(16), sp << _U(16)

    bounds = _bounds(steps)
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(active[begin])
        ids, start, size = (np.zeros((end - begin, n), np.int32) for _ in range(3))
        missed = np.zeros((end - begin, n), bool)
        for lane in range(n):
            own, z = blocks[order[lane]][begin:end], zeroth[lane]
            j = z.places(own)
            m = len(own)
            ids[:m, lane], start[:m, lane], size[:m, lane] = own, z.start[j], z.start[j + 1] - z.start[j]
        for t in range(begin, end):
            n = int(active[t])
            x = ids[t - begin, :n]
            q2, q1, a, b = contexts.predict(n)
            hit2, hit1 = q2 == x, q1 == x
            miss = ~(hit2 | hit1)
            first = np.where(miss, b, np.where(hit2, 0, a)).astype(np.int64)
            gate = np.where(miss, 1 << _GATE, np.where(hit2, a, b)) - first
            cum = (first << _FREQ) + np.where(miss, gate * start[t - begin, :n], 0)
            part = gate * np.where(miss, size[t - begin, :n], _ALL0)
            r = span[:n] >> _U(_GATE + _FREQ)
            low[:n] += r * cum.astype(_U)
            span[:n] = r * part.astype(_U)
            shift(n)
            missed[t - begin, :n] = miss
            contexts.learn(n, x, hit2, miss)
        for lane in range(int(active[begin])):
            z, own = zeroth[lane], blocks[order[lane]][begin:end]
            out[lane].append(words[lane, : pos[lane]].astype("<u2"))
            fresh[lane].append(own[missed[: len(own), lane] & (start[: len(own), lane] == 0)])
            z.learn(own.astype(np.int64))
        pos[:] = 0
    payloads: list[bytes] = [b""] * lanes
    for lane, k in enumerate(order):
        tail = (low[lane] >> np.array([48, 32, 16, 0], _U)).astype("<u2")
        payloads[k] = _pack(np.concatenate(fresh[lane]).astype(np.int64)) + np.concatenate([*out[lane], tail]).tobytes() if lengths[lane] else b""
    return payloads


def decode(payloads: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Ids of blocks (int32) from their payloads and numbers of ids."""
    order = sorted(range(len(payloads)), key=lambda k: -counts[k])
    lengths = np.array([counts[k] for k in order], np.int64)
    lanes, steps = len(order), int(lengths.max(initial=0))
    width = max((len(p) // 2 for p in payloads), default=0) + 8
    words, fresh = np.zeros((lanes, width), np.uint16), []
    for lane, k in enumerate(order):
        raw, at = _unpack(payloads[k]) if lengths[lane] else (np.zeros(0, np.int64), 0)
        fresh.append(raw)
        w = np.frombuffer(payloads[k], "<u2", offset=at) if lengths[lane] else np.zeros(0, "<u2")
        words[lane, : len(w)] = w
    # New ids of all lanes in one array; where each lane's next one stands.
    next_new = np.cumsum([0, *map(len, fresh)])[:lanes]
    new_ids = np.concatenate([*fresh, np.zeros(1, np.int64)])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    contexts, zeroth = _Contexts(lanes), [_Order0() for _ in order]
    out: list[list[np.ndarray]] = [[] for _ in order]
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    value, pos = np.zeros(lanes, _U), np.full(lanes, 4, np.int64)
    for k in range(4):
        value = value << _U(16) | words[:, k].astype(_U)

    def shift(n):
        at = None
        while True:
            lo, sp = (low[:n], span[:n]) if at is None else (low[at], span[at])
            settled = (lo ^ (lo + sp)) < _TOP
            need = np.flatnonzero(settled | (sp <= _LOW))
            if not len(need):
                return
            lo, sp, settled = lo.take(need), sp.take(need), settled.take(need)
            at = need if at is None else at.take(need)
            sp = np.where(settled, sp, -lo & _LOW)
            value[at] = value[at] << _U(16) | words[at, np.minimum(pos[at], width - 1)].astype(_U)
            pos[at] += 1
            low[at], span[at] = lo << _U(16), sp << _U(16)

    slots = np.zeros((lanes, _ALL0), np.uint16)
    bounds = _bounds(steps)
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(active[begin])
        ids = np.zeros((end - begin, n), np.int64)
        wide = max(len(z.ids) for z in zeroth[:n]) + 2
        starts, known = np.zeros((n, wide), np.int32), np.zeros((n, wide), np.int32)
        for lane in range(n):
            z = zeroth[lane]
            starts[lane, : len(z.start)], known[lane, 1 : len(z.ids) + 1] = z.start, z.ids
            slots[lane] = np.repeat(np.arange(len(z.start) - 1, dtype=np.uint16), np.diff(z.start))
        flat, flat_starts, flat_known = slots.reshape(-1), starts.reshape(-1), known.reshape(-1)
        for t in range(begin, end):
            n = int(active[t])
            lane = contexts.lane[:n]
            q2, q1, a, b = contexts.predict(n)
            r = span[:n] >> _U(_GATE + _FREQ)
            f = np.minimum((value[:n] - low[:n]) // r, _U((1 << _GATE + _FREQ) - 1)).astype(np.int64)
            gate_at = f >> _FREQ
            hit2, miss = gate_at < a, gate_at >= b
            first = np.where(miss, b, np.where(hit2, 0, a)).astype(np.int64)
            gate = np.where(miss, 1 << _GATE, np.where(hit2, a, b)) - first
            slot = np.where(miss, (f - (first << _FREQ)) // gate, 0)
            j = lane * wide + flat.take(lane * _ALL0 + slot)
            start = flat_starts.take(j)
            size = np.where(miss, flat_starts.take(j + 1) - start, _ALL0)
            cum = (first << _FREQ) + np.where(miss, gate * start, 0)
            low[:n] += r * cum.astype(_U)
            span[:n] = r * (gate * size).astype(_U)
            shift(n)
            x = np.where(miss, flat_known.take(j), np.where(hit2, q2, q1)).astype(np.int64)
            at = np.flatnonzero(miss & (start == 0))  # the escape stands first
            if len(at):
                x[at] = new_ids.take(next_new[at], mode="clip")
                next_new[at] += 1
            ids[t - begin, :n] = x
            contexts.learn(n, x, hit2, miss)
        for lane in range(int(active[begin])):
            own = ids[: max(0, min(end, int(lengths[lane])) - begin), lane].copy()
            out[lane].append(own.astype(np.int32))
            zeroth[lane].learn(own)
    ids_of: list[np.ndarray] = [np.zeros(0, np.int32)] * lanes
    for lane, k in enumerate(order):
        if out[lane]:
            ids_of[k] = np.concatenate(out[lane])
    return ids_of
