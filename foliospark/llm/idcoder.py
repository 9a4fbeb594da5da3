"""Adaptive context-mixing range coder for token ids below 65536.

Blocks are independent: each starts with an empty model, and its bytes do not depend on other blocks.  A block is cut into
up to ``MAX_LANES`` lanes of consecutive ids, which numpy codes side by side, one id of every lane per step.  The lanes have
coders of their own and share the block's model, which learns from all of them after each step.

For the next id, order 2 (the last two ids) and order 1 (the last id) each name the id that followed their context, with a
confidence, and order 0 counts ids.  The first candidate is order 2's where its context was seen before, else order 1's.
The confidences of both orders and the order-0 share of the candidate select three adaptive probabilities, which a small
integer logistic mixer joins into the probability of a hit.  After a miss order 1's id, if it is another one, is checked
under its confidence and its share.  After a second miss the id is coded by order 0 alone: the ids that came this far are
counted, half a count of each distinct one goes to the 64 ids around it, and the shares are drawn up anew as the block grows.
All arithmetic is in integers, so every machine decodes what any other has written.

The range coder holds 48 bits, writes 16-bit words and settles carries afterwards.  The words of all lanes are stored in the
order in which the decoder asks for them.
"""

from __future__ import annotations

import numpy as np

MAX_ID = 1 << 16
MAX_LANES, LEAST_STEPS = 4096, 512
#: Bits of a hit's probability, of the three-way choice and of order 0's shares.
_HIT, _CHOICE, _SHARE = 12, 24, 22
_TOP = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_W, _D = np.uint64(16), np.uint64(32)
_START, _WHOLE = np.uint64((1 << 48) - 1), np.uint64(1 << _CHOICE)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """4096 / (1 + e^(-x / 256)) for x from -2048 and its inverse, in integers only."""
    one = 1 << 96
    root = term = one
    k = 0
    while term := term // (256 * (k := k + 1)):
        root += term  # e^(1 / 256) by its series
    grown = [one]
    for _ in range(2048):
        grown.append(grown[-1] * root >> 96)
    curve = [4096 * one // (one + grown[-x]) if x < 0 else 4096 * grown[x] // (one + grown[x]) for x in range(-2048, 2048)]
    squash = np.clip(np.array(curve, np.int64), 1, 4095)
    return squash, (np.searchsorted(squash, np.arange(4096)).clip(0, 4095) - 2048).astype(np.int64)


_SQUASH, _STRETCH = _tables()
#: Next entry's confidence by the old one, after a miss (first 8) and after a hit; a miss at 0 or 1 replaces the id.
_SURER = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int64) << 16
#: Share of an id not seen yet, 2048 being that of one seen: vocabularies give low ids to frequent tokens.
_FLOOR = 1 + (1 << 14) // (np.arange(MAX_ID, dtype=np.int64) + 64)
_POWERS = 1 << np.arange(31)
#: Sum at which odds are halved; most ids between two drawings of the shares; most lanes whose errors add up in the mixer.
_FULL, _REFRESH, _SPEED = 4096, 1 << 17, 8


class _Odds:
    """Adaptive probabilities (of 4096) by small contexts."""

    def __init__(self, contexts: int):
        self.seen = np.ones((2, contexts), np.int64)  # misses, hits
        self.seen[0] = 2
        self.contexts = contexts

    def p(self) -> np.ndarray:
        return np.clip((self.seen[1] << _HIT) // self.seen.sum(0), 1, 4095)

    def learn(self, context_and_hit: np.ndarray) -> None:
        self.seen += np.bincount(context_and_hit, minlength=2 * self.contexts).reshape(2, -1) << 1
        full = self.seen.sum(0) > _FULL
        if full.any():
            self.seen[:, full] = (self.seen[:, full] >> 1) + 1


class _Model:
    """What a block has taught so far, and its lanes' contexts."""

    def __init__(self, lanes: int, n: int):
        bits = min(20, max(12, n.bit_length()))
        self.shift, self.mask = 32 - bits, (1 << bits) - 1
        self.follow2, self.follow1 = np.zeros(1 << bits, np.int32), np.zeros(MAX_ID, np.int32)  # id | confidence << 16
        self.odds = _Odds(64)  # 16 of order 2, 16 of order 1, 32 of order 0
        self.second_odds = _Odds(256)
        self.weight = [24_000, 24_000, 24_000]
        self.counts, self.coded = np.zeros(MAX_ID, np.int64), np.zeros(MAX_ID, np.int64)
        self.held_ids: list[np.ndarray] = []
        self.held_coded: list[np.ndarray] = []
        self.n = self.due = 0
        self.last, self.at2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self._share()

    def _share(self) -> None:
        """Order 0's shares by all counts so far."""
        if self.held_ids:
            self.counts += np.bincount(np.concatenate(self.held_ids), minlength=MAX_ID)
            self.coded += np.bincount(np.concatenate(self.held_coded), minlength=MAX_ID)
            self.held_ids, self.held_coded = [], []
        known = self.coded > 0
        around = known.reshape(-1, 64).sum(1)
        part = (self.coded << 11) - (known << 10) + _FLOOR
        part = (part.reshape(-1, 64) + (around << 4)[:, None]).ravel()
        upto = np.zeros(MAX_ID + 1, np.int64)
        np.cumsum(part, out=upto[1:])
        scale = (((1 << _SHARE) - MAX_ID) << 30) // int(upto[-1])
        upto = (upto * scale >> 30) + np.arange(MAX_ID + 1)  # no share is empty
        upto[-1] = 1 << _SHARE
        self.upto = upto.astype(np.uint32)
        self.level = np.searchsorted(_POWERS, self.counts * (1 << 16) // max(1, self.n), side="right")
        self.due = self.n + min(_REFRESH, max(64, self.n >> 3))

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second candidate of the first n lanes; the ends of their parts of the three-way choice."""
        self.at = at2, at1 = self.at2[:n], self.last[:n]
        self.entry = e2, e1 = self.follow2.take(at2).astype(np.int64), self.follow1.take(at1).astype(np.int64)
        id2, id1 = e2 & 0xFFFF, e1 & 0xFFFF
        self.sure = sure2, sure1 = e2 >> 16, e1 >> 16
        known2 = sure2 > 0
        best = np.where(known2, id2, id1)
        agree = id1 == best
        self.contexts = (sure2 << 1) + agree, (sure1 << 1) + agree + 16, self.level.take(best) + 32
        p = self.odds.p()
        stretch = _STRETCH.take(p)
        self.inputs = [stretch.take(c) for c in self.contexts]
        mixed = self.inputs[0] * self.weight[0] + self.inputs[1] * self.weight[1] + self.inputs[2] * self.weight[2] >> 16
        mixed += 2048
        self.p = _SQUASH.take(mixed, mode="clip")
        self.other = (sure1 > 0) > agree
        self.second_at = (sure1 << 5) + self.level.take(id1)
        end1 = self.p << (_CHOICE - _HIT)
        end2 = end1 + ((1 << _HIT) - self.p) * (self.second_odds.p().take(self.second_at) * self.other)
        self.known = id2, id1
        return best, id1, end1.astype(np.uint64), end2.astype(np.uint64)

    def learn(self, n: int, ids: np.ndarray, hit: np.ndarray, left: np.ndarray) -> None:
        """``left``: lanes of ids coded by order 0."""
        target = hit.astype(np.int64)
        error = (target << _HIT) - self.p
        for i, (x, context) in enumerate(zip(self.inputs, self.contexts)):
            self.weight[i] += int(np.dot(x, error)) * 6 * _SPEED // (n + _SPEED - 1) >> 10
        half = self.odds.contexts
        self.odds.learn(np.concatenate([c + half * target for c in self.contexts]))
        tried = np.flatnonzero(self.other > hit)
        if len(tried):
            self.second_odds.learn(self.second_at.take(tried) + 256 * (self.known[1].take(tried) == ids.take(tried)))
        for table, at, entry, known, sure in zip((self.follow2, self.follow1), self.at, self.entry, self.known, self.sure):
            state = sure + ((known == ids) << 3)
            table[at] = np.where(state > 1, known, ids) | _SURER.take(state)  # of equal places the last lane's holds
        self.at2[:n] = ((ids * 2654435761 ^ self.last[:n] * 2246822519) >> self.shift) & self.mask
        self.last[:n] = ids
        self.held_ids.append(ids)
        self.held_coded.append(ids.take(left))
        self.n += n
        if self.n >= self.due:
            self._share()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block."""
    steps = min(n, max(LEAST_STEPS, -(-n // MAX_LANES)))
    return -(-n // steps), steps


def _active(n: int, lanes: int, steps: int, t: int) -> int:
    return lanes if t < n - (lanes - 1) * steps else lanes - 1


def _encode(block: np.ndarray) -> bytes:
    n = len(block)
    lanes, steps = _shape(n)
    ids = np.zeros(lanes * steps, np.uint16)
    ids[:n] = block
    ids = np.ascontiguousarray(ids.reshape(lanes, steps).T)
    model = _Model(lanes, n)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, _START)
    words, owners = [], []

    def put(lane, unit, start, width):
        """Narrow the interval of these lanes; unit: size of one count."""
        new = unit * width
        low[lane] += unit * start
        small = np.flatnonzero(new < _TOP)
        while len(small):
            s = lane.take(small) if isinstance(lane, np.ndarray) else small
            at = low.take(s)
            words.append((at >> _D).astype(np.uint32))
            owners.append(s.astype(np.uint16))
            low[s] = (at & _LOW) << _W
            new[small] <<= _W
            small = small[new.take(small) < _TOP]
        size[lane] = new

    for t in range(steps):
        m = _active(n, lanes, steps, t)
        now = ids[t, :m].astype(np.int64)
        best, second, end1, end2 = model.predict(m)
        hit = now == best
        again = (now == second) & model.other
        start = np.where(again, end1, end2)
        start[hit] = 0
        end = np.where(hit, end1, _WHOLE)
        np.copyto(end, end2, where=again)
        put(slice(0, m), size[:m] >> np.uint64(_CHOICE), start, end - start)
        left = np.flatnonzero(~(hit | again))
        if len(left):
            x = now.take(left)
            start = model.upto.take(x)
            width = model.upto.take(x + 1) - start
            put(left, size.take(left) >> np.uint64(_SHARE), start.astype(np.uint64), width.astype(np.uint64))
        model.learn(m, now, hit, left)
    # Each lane ends with the three words it still holds; grouped by lane, carries go to the word before.
    words += [(low >> _D).astype(np.uint32), (low >> _W & np.uint64(0xFFFF)).astype(np.uint32), (low & np.uint64(0xFFFF)).astype(np.uint32)]
    owners += [np.arange(lanes, dtype=np.uint16)] * 3
    words, owners = np.concatenate(words), np.concatenate(owners)
    by_lane = np.argsort(owners, kind="stable")
    grouped = words[by_lane]
    while (over := grouped >> np.uint32(16)).any():
        grouped &= np.uint32(0xFFFF)
        grouped[:-1] += over[1:]
    # The decoder holds three words of a lane and asks for the next when the coder writes one.
    begins = np.searchsorted(owners[by_lane], np.arange(lanes))
    place = np.empty(len(words), np.int64)
    place[by_lane] = np.arange(len(words))
    ahead = place[: len(words) - 3 * lanes] + 3
    first = grouped[begins[:, None] + np.arange(3)].ravel()
    return np.concatenate([first, grouped[ahead]]).astype("<u2").tobytes()


def _decode(code: bytes, n: int) -> np.ndarray:
    lanes, steps = _shape(n)
    words = np.frombuffer(code, "<u2").astype(np.uint64)
    if len(words) < 3 * lanes:
        raise ValueError("damaged block")
    held = words[: 3 * lanes].reshape(lanes, 3)
    value = held[:, 0] << _D | held[:, 1] << _W | held[:, 2]
    size, used = np.full(lanes, _START), 3 * lanes
    model = _Model(lanes, n)
    ids = np.zeros((steps, lanes), np.uint16)

    def take(lane, unit, start, width):
        nonlocal used
        new = unit * width
        value[lane] -= unit * start
        small = np.flatnonzero(new < _TOP)
        while len(small):
            s = lane.take(small) if isinstance(lane, np.ndarray) else small
            if used + len(s) > len(words):
                raise ValueError("damaged block")
            value[s] = value.take(s) << _W | words[used : used + len(s)]
            used += len(s)
            new[small] <<= _W
            small = small[new.take(small) < _TOP]
        size[lane] = new

    for t in range(steps):
        m = _active(n, lanes, steps, t)
        best, second, end1, end2 = model.predict(m)
        unit, v = size[:m] >> np.uint64(_CHOICE), value[:m]
        hit = v < unit * end1
        again = (v < unit * end2) > hit
        start = np.where(again, end1, end2)
        start[hit] = 0
        end = np.where(hit, end1, _WHOLE)
        np.copyto(end, end2, where=again)
        take(slice(0, m), unit, start, end - start)
        now = np.where(again, second, best)
        left = np.flatnonzero(~(hit | again))
        if len(left):
            unit = size.take(left) >> np.uint64(_SHARE)
            at = np.minimum(value.take(left) // unit, np.uint64((1 << _SHARE) - 1)).astype(np.uint32)
            x = np.searchsorted(model.upto, at, side="right") - 1
            start = model.upto.take(x)
            take(left, unit, start.astype(np.uint64), (model.upto.take(x + 1) - start).astype(np.uint64))
            now[left] = x
        ids[t, :m] = now
        model.learn(m, now, hit, left)
    if used != len(words):
        raise ValueError("damaged block")
    return ids.T.ravel()[:n]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids, in the given order."""
    if any(len(b) and int(b.max()) >= MAX_ID for b in blocks):
        raise ValueError("ids must be below 65536")
    return [_encode(b) if len(b) else b"" for b in blocks]


def decode_blocks(codes: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """Inverse of ``encode_blocks``; lengths: ids of each block."""
    return [_decode(c, int(n)) if n else np.zeros(0, np.int64) for c, n in zip(codes, lengths)]
