"""Adaptive context-mixing range coder for token ids.

A block of ids is coded with a model that starts empty and counts what has passed:

* order 0 counts the block's ids; ids that aren't in its counts share an escape probability and follow
  in a stream of their own, coded by counts of the upper bits of such ids;
* order 1 (by the previous id) and order 2 (by a hash of the two previous ids) hold for each context
  a candidate, how often it has followed and how often the context has passed; both change with each id.

The probability of an id is the weighted sum of what the three orders give it.  The weights stand for
each cell, the levels of the two candidates' counts and whether both name one id, and are learned in
each block from how often candidates of such a cell came.  Weights, escapes and order 0's counts are
taken over at marks (MARKS), which lie closer at the block's start, so between two marks a cell's
units are one entry of a table.  Each id has one interval: order 0's, widened where a candidate
names it.

Blocks don't depend on each other, so many blocks are coded in step: every operation works on one id
of each block at once (a lane for each block).  Floating point is confined to sums, products and
quotients of single numbers, which every machine rounds alike.  Words are written with room for a
carry; carries run through each lane's words at the end.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: most ids of a block and units of the mixture.
MOST_BLOCK = 4096
UNIT_BITS = 22
#: The escape's start and bounds, and the ids that its last value counts for.
ESCAPE_START, ESCAPE_LEAST, ESCAPE_MOST, ESCAPE_KEEP = 0.9, 1 / 256, 0.9, 12
#: Bits of an unseen id that are counted, and what one adds.
HIGH_BITS = 4
HIGH_STEP = 12
#: Lanes that are coded in step.
LANES = 2048

#: The range lies in [BOTTOM, BOTTOM << 16); a word of 16 bits leaves or enters below.
_LOW_BITS = 32
_BOTTOM = 1 << 32
_REST = _BOTTOM - 1
_FULL = (1 << 48) - 1
_WORD = 16
_UNITS = 1 << UNIT_BITS

#: Bits of a count of order 0.
COUNT_BITS = 13
_COUNT = (1 << COUNT_BITS) - 1
#: A slot: candidate << STATE_BITS | state; a state: twice the candidate's count << 5 | the context's count.
STATE_BITS = 11
_STATES = 1 << STATE_BITS
#: A cell: order 2's level << 3 | order 1's; the latter is 6 or 7 where both name one id.
CELLS = 64
_SAME = 6
#: Weights of the candidates by level (order 1's last two: both name one id) before a block has shown its own, and the ids that they count for.
START2 = (0.0, 0.03, 0.03, 0.08, 0.3, 0.45, 0.52, 0.94)
START1 = (0.0, 0.04, 0.13, 0.06, 0.12, 0.45)
START_SAME = (0.27, 0.2)
KEEP = 12
#: What candidates get at most of a cell.
CERTAIN = 0.985
#: Units of a cell: order 2's candidate << 40 | order 1's << ONE_BITS | those of one count of order 0.
ONE_BITS = 18
_ONE = (1 << ONE_BITS) - 1


#: Fixed value: marks are this part of what has passed apart.
MARK_SHARE = 6


def _ahead(mark: int) -> int:
    """How far behind a mark the next one lies."""
    return max(16, mark // MARK_SHARE)


def _marks() -> list[int]:
    out = [16]
    while out[-1] < MOST_BLOCK:
        out.append(out[-1] + _ahead(out[-1]))
    return out




#: Weights, escapes and order 0's counts are taken over before these ids.
MARKS = _marks()


def _tables():
    """A state's level in order 1 and in order 2 (<< 3); the next states after a miss and a hit (negative, less -_STATES: a new candidate)."""
    level1, level2, after = np.zeros(_STATES, np.int64), np.zeros(_STATES, np.int64), np.zeros(2 * _STATES, np.int32)
    for s in range(_STATES):
        twice, n = s >> 5, s & 31
        if n:
            q = twice / 2 / (n + 0.5)
            level2[s] = 8 * (1 if n == 1 else 2 if q < 0.3 else 3 if q < 0.5 else 4 if q < 0.65 else 5 if q < 0.8 else 6 if q < 0.88 else 7)
            level1[s] = 1 if n == 1 else 2 if q < 0.15 else 4 if q < 0.35 else 3 if q < 0.65 else 5
        for hit in (0, 1):
            a, m, new = twice + (2 if hit else -1), n + 1, 0
            if a <= 1 or not n:
                a, m, new = 2, min(max(n, 1), 2), _STATES
            if m > 30 or a > 63:
                a, m = a // 2, m // 2
            after[s + hit * _STATES] = (a << 5 | m) - new
    return level1, level2, after


_LEVEL1, _LEVEL2, _AFTER = _tables()


def _starts() -> tuple[np.ndarray, np.ndarray]:
    """KEEP times the first weights of the two candidates in each cell."""
    both = np.zeros((8, 8, 2))
    for two in range(8):
        for one in range(8):
            if one >= _SAME:
                both[two, one] = max(START2[two], START_SAME[one - _SAME]), 0.0
            else:
                both[two, one] = START2[two], START1[one] * (1 - START2[two])
    return KEEP * both[:, :, 0].ravel(), KEEP * both[:, :, 1].ravel()


_START_A, _START_B = _starts()
#: row p: what an unseen id adds to the sums after place p
_LATER = (np.arange(1 << HIGH_BITS)[None, :] > np.arange(1 << HIGH_BITS)[:, None]).astype(np.uint16) * np.uint16(HIGH_STEP)


class _Model:
    """The counts and weights of n lanes. Ids are numbered by their first place in the block. Pairs of rows hold order 2's, then order 1's."""

    def __init__(self, n: int, block: int):
        self.size = size = 1 << max(4, (block - 1).bit_length())  # numbers, and slots of a context table
        self.lanes, self.next = n, np.empty(2 * n * size, np.int32)
        self.next[: n * size], self.next[n * size :] = -1 << STATE_BITS, -2 << STATE_BITS  # candidates that no number equals
        self.counts = np.zeros((n, size), np.uint16)
        self.order0 = np.zeros((n, size), np.int32)  # sum before << COUNT_BITS | count
        self.total = self.distinct = self.since = 0
        self.escape = np.full(n, ESCAPE_START)
        self.plane = max(STATE_BITS, (n * CELLS - 1).bit_length())
        self.tally = np.zeros((4, n, CELLS), np.int32)  # of each cell: came neither, order 2's candidate, order 1's, both
        self.keys = np.zeros((_ahead(block), n), np.int32)  # of each id since the mark: what came << plane | cell
        self.hash, self.contexts = np.zeros(n, np.int32), np.zeros((2, n), np.int64)
        self.contexts += np.arange(2 * n, dtype=np.int64).reshape(2, n) * size
        self.keep(n)
        self.weigh()

    def keep(self, n: int) -> None:
        """Go on with the first n lanes."""
        self.n, self.hash, self.contexts = n, self.hash[:n], np.ascontiguousarray(self.contexts[:, :n])
        self.base, self.cells = np.arange(n, dtype=np.int64) * self.size, np.arange(n, dtype=np.int64) * CELLS
        self.last = self.base + self.lanes * self.size
        self.slots, self.candidates, self.states, self.f, self.t, self.after = np.empty((6, 2, n), np.int32)
        self.key, self.one, self.start, self.units = np.empty((4, n), np.int32)
        self.cell, self.found, self.index = np.empty(n, np.int64), np.empty(n, np.int64), np.empty((2, n), np.int64)

    def weigh(self) -> None:
        """Units of all cells."""
        none, two, one, both = self.tally[:, : self.n]
        two = two + both
        share = CERTAIN * _UNITS / (none + one + two + KEEP)
        a, b = ((two + _START_A) * share).astype(np.int64), ((one + _START_B) * share).astype(np.int64)
        each = (_UNITS - a - b) * ((1.0 - self.escape[: self.n]) / self.total)[:, None] if self.total else np.ones(a.shape)
        a <<= UNIT_BITS
        a |= b
        a <<= ONE_BITS
        a |= each.astype(np.int64)
        self.packed = a.ravel()

    def take_over(self, passed: np.ndarray, unseen: np.ndarray) -> None:
        """At a mark; passed: one row for each id so far; unseen: how many ids of each lane escaped since the last mark."""
        n, since, now = self.n, self.since, len(passed)
        own = passed[since:, :n].T.astype(np.int64)
        self.distinct = max(self.distinct, int(own.max()) + 1)
        own += self.base[:, None]
        np.add.at(self.counts.ravel(), own.ravel(), np.uint16(1))
        self.total = self.since = now
        upto = min(self.size, self.distinct + _ahead(now))  # numbers that may come before the next mark
        counts = self.counts[:n, :upto]
        sums = np.cumsum(counts, axis=1, dtype=np.int32)
        sums -= counts
        sums <<= COUNT_BITS
        np.bitwise_or(sums, counts, out=self.order0[:n, :upto])
        new = np.bincount(self.keys[: now - since, :n].ravel(), minlength=4 << self.plane).reshape(4, -1)[:, : n * CELLS].reshape(4, n, CELLS)
        self.tally[:, :n] += new
        plain = new[0].sum(axis=1)
        self.escape[:n] = np.clip((unseen[:n] + ESCAPE_KEEP * self.escape[:n]) / (plain + ESCAPE_KEEP), ESCAPE_LEAST, ESCAPE_MOST)
        self.weigh()

    def predict(self) -> None:
        """The candidates, and units for each and for a count of order 0."""
        slots, states, f, cell, found, index = self.slots, self.states, self.f, self.cell, self.found, self.index
        self.next.take(self.contexts, out=slots, mode="wrap")
        np.right_shift(slots, STATE_BITS, out=self.candidates)
        np.bitwise_and(slots, _STATES - 1, out=states)
        index[...] = states
        a, b = self.candidates
        _LEVEL1.take(index[1], out=cell, mode="wrap")
        np.multiply(a == b, _SAME, out=found)
        cell |= found
        _LEVEL2.take(index[0], out=found, mode="wrap")
        cell += found
        cell += self.cells
        self.packed.take(cell, out=found, mode="wrap")
        self.one[...] = found
        self.one &= _ONE
        found >>= ONE_BITS
        f[1] = found
        f[1] &= _UNITS - 1
        found >>= UNIT_BITS
        f[0] = found

    def interval(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of x in units, without escapes; own: x's entries in order 0."""
        size, start, t = self.units, self.start, self.t
        np.bitwise_and(own, _COUNT, out=size)
        size *= self.one
        np.right_shift(own, COUNT_BITS, out=start)
        start *= self.one
        np.multiply(self.f, self.candidates < x, out=t)
        start += t[0]
        start += t[1]
        self.hits = self.candidates == x
        np.multiply(self.f, self.hits, out=t)
        size += t[0]
        size += t[1]
        return start, size

    def escaped(self, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Give the lanes in `at` the escape's interval."""
        end = self.one.take(at)
        end *= self.total
        end += self.f[0].take(at)
        end += self.f[1].take(at)
        start[at] = end
        np.subtract(_UNITS, end, out=end)
        size[at] = end

    def learn(self, t: int, x: np.ndarray) -> None:
        """x: the numbers that came as id t."""
        own, after, states, index, key = self.t, self.after, self.states, self.index, self.key
        np.multiply(self.hits, _STATES, out=own, dtype=np.int32)
        states += own
        index[...] = states
        _AFTER.take(index, out=after, mode="wrap")
        own <<= self.plane - STATE_BITS
        key[...] = self.cell
        key += own[0]
        own[1] <<= 1
        key += own[1]
        self.keys[t - self.since, : self.n] = key
        np.right_shift(after, 31, out=own)  # all bits: a new candidate
        after &= _STATES - 1
        np.bitwise_xor(self.candidates, x, out=states)
        own &= states
        own ^= self.candidates
        own <<= STATE_BITS
        own |= after
        self.next[self.contexts] = own
        np.multiply(x, 60493, out=key)
        key += self.hash
        np.right_shift(key, 7, out=own[0])
        key ^= own[0]
        key &= self.size - 1
        i, last = self.contexts
        i[...] = key
        i += self.base
        np.multiply(x, 40503, out=self.hash)
        last[...] = x
        last += self.last


def _lengths(total: int, block: int) -> np.ndarray:
    n = -(-total // block)
    out = np.full(n, block, np.int64)
    if n:
        out[-1] = total - block * (n - 1)
    return out


def _carry(words: np.ndarray, ends: np.ndarray) -> None:
    """Add the carries (bit 16) of each lane's words to the words before them, in place."""
    over = np.zeros(len(words), np.uint32)
    for k in range(int(ends.max()) - 1, -1, -1):
        w = words[:, k]
        w += over
        over = w >> 16
        w &= 0xFFFF


def _numbered(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each id's number by first place; first: room for a number for each id there may be."""
    places = np.arange(len(ids), dtype=np.uint16)
    first[ids[::-1]] = places[::-1]  # the last one assigned stays: the first place
    at = first[ids]
    return (np.cumsum(at == places) - 1)[at].astype(np.uint16)


class _Writer:
    """Words of each lane."""

    def __init__(self, lanes: int, most: int):
        self.lanes, self.most = lanes, most
        self.out = np.zeros(lanes * most, np.uint32)
        self.at = np.arange(lanes, dtype=np.int64) * most
        self.low, self.span = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
        self.shift, self.word = np.empty(lanes, np.int64), np.empty(lanes, np.int64)

    def room(self, words: int) -> None:
        if int((self.at - np.arange(self.lanes) * self.most).max()) + words > self.most:
            more = self.most // 2 + words
            self.out = np.pad(self.out.reshape(self.lanes, self.most), ((0, 0), (0, more))).ravel()
            self.at += np.arange(self.lanes) * more
            self.most += more

    def settle(self, n: int) -> None:
        """Write words of the first n lanes until their spans are large."""
        low, span, at, shift, word = self.low[:n], self.span[:n], self.at[:n], self.shift[:n], self.word[:n]
        narrow = span < _BOTTOM
        while True:
            np.right_shift(low, _LOW_BITS, out=word)
            self.out[at] = word  # lanes that aren't narrow write here again
            at += narrow
            np.multiply(narrow, _WORD, out=shift)
            span <<= shift
            np.subtract(narrow, 1, out=word, dtype=np.int64)
            word |= _REST  # the bits that stay: all, or those below the word
            low &= word
            low <<= shift
            narrow = span < _BOTTOM
            if not narrow.any():
                return

    def done(self) -> list[bytes]:
        self.room(8)
        for _ in range(3):  # the rest of low
            self.out[self.at] = self.low >> _LOW_BITS
            self.at += 1
            self.low = (self.low & _REST) << _WORD
        ends = self.at - np.arange(self.lanes) * self.most
        words = self.out.reshape(self.lanes, self.most)
        _carry(words, ends)
        return [words[i, : ends[i]].astype("<u2").tobytes() for i in range(self.lanes)]


class _Reader:
    """Words of each lane's bytes."""

    def __init__(self, coded: list[bytes]):
        lanes, most = len(coded), max(map(len, coded)) // 2 + 8
        data = np.zeros((lanes, most), np.uint16)
        for i, b in enumerate(coded):
            data[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        self.span = np.full(lanes, _FULL, np.int64)
        self.code = np.zeros(lanes, np.int64)  # the code's distance from the range's low end
        for k in range(3):
            self.code = (self.code << _WORD) | data[:, k]
        self.data = data.ravel()
        self.at = np.arange(lanes, dtype=np.int64) * most + 3
        self.shift, self.word = np.empty(lanes, np.int64), np.empty(lanes, np.int64)

    def settle(self, n: int) -> None:
        """Read words of the first n lanes until their spans are large."""
        code, span, at, shift, word = self.code[:n], self.span[:n], self.at[:n], self.shift[:n], self.word[:n]
        narrow = span < _BOTTOM
        for _ in range(3):
            np.multiply(narrow, _WORD, out=shift)
            span <<= shift
            code <<= shift
            word[...] = self.data.take(at, mode="clip")
            word *= narrow
            code |= word
            at += narrow
            narrow = span < _BOTTOM
            if not narrow.any():
                return
        raise ValueError("no block of this coder")


def _quotient(value: np.ndarray, unit) -> np.ndarray:
    """Whole quotients of numbers below 2**48; they are below 2**28, so rounding can't reach the next whole number."""
    return (value / unit).astype(np.int64)


class _Upper:
    """Counts and running sums of the upper bits of unseen ids in each lane; all lanes have had equally many."""

    def __init__(self, lanes: int, width: int):
        self.low_bits = max(0, width - HIGH_BITS)
        self.base = np.arange(lanes, dtype=np.int64) << HIGH_BITS
        self.counts = np.ones(lanes << HIGH_BITS, np.int64)
        self.sums = np.tile(np.arange(1 << HIGH_BITS, dtype=np.uint16), lanes).reshape(lanes, -1)
        self.total = 1 << HIGH_BITS

    def interval(self, n: int, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[:n] + high
        return self.sums.ravel().take(place).astype(np.int64) << self.low_bits, self.counts.take(place)

    def add(self, n: int, high: np.ndarray) -> None:
        self.counts[self.base[:n] + high] += HIGH_STEP
        self.sums[:n] += _LATER.take(high, axis=0)
        self.total += HIGH_STEP


def _encode_unseen(ids: list[np.ndarray], width: int) -> list[bytes]:
    """One byte string for each list of ids, whatever their lengths."""
    order = np.argsort([-len(x) for x in ids], kind="stable")
    sizes = np.array([len(ids[i]) for i in order])
    most = int(sizes[0])
    steps = np.zeros((most, len(ids)), np.int64)
    for k, i in enumerate(order.tolist()):
        steps[: sizes[k], k] = ids[i]
    m, w = _Upper(len(ids), width), _Writer(len(ids), 2 * most + 16)
    alive = np.searchsorted(-sizes, -np.arange(most), side="left").tolist()
    for t, n in enumerate(alive):
        high = steps[t, :n] >> m.low_bits
        start, size = m.interval(n, high)
        start += (steps[t, :n] & ((1 << m.low_bits) - 1)) * size
        unit = w.span[:n] // (m.total << m.low_bits)
        w.low[:n] += unit * start
        np.multiply(unit, size, out=w.span[:n])
        m.add(n, high)
        w.settle(n)
    out: list[bytes] = [b""] * len(ids)
    for i, coded in zip(order.tolist(), w.done()):
        out[i] = coded
    return out


def _decode_unseen(coded: list[bytes], sizes: np.ndarray, width: int) -> list[np.ndarray]:
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    most = int(sizes[0])
    m, r = _Upper(len(coded), width), _Reader([coded[i] for i in order.tolist()])
    steps = np.zeros((most, len(coded)), np.uint32)
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(most), side="left").tolist()):
        total = m.total << m.low_bits
        unit = r.span[:n] // total
        value = np.minimum(_quotient(r.code[:n], unit), total - 1)
        high = (m.sums[:n] <= (value >> m.low_bits).astype(np.uint16)[:, None]).sum(axis=1) - 1
        start, size = m.interval(n, high)
        low = (value - start) // size
        start += low * size
        r.code[:n] -= unit * start
        np.multiply(unit, size, out=r.span[:n])
        steps[t, :n] = (high << m.low_bits) + low
        m.add(n, high)
        r.settle(n)
    out: list[np.ndarray] = [steps[:0, 0]] * len(coded)
    for k, i in enumerate(order.tolist()):
        out[i] = steps[: sizes[k], k]
    return out


#: Before a block's two streams: the first one's bytes and the number of unseen ids.
_HEAD = struct.Struct("<IH")


def _ends(block: int) -> dict[int, int]:
    """Where the stretches between marks begin, and where they end."""
    at = [0, *(m for m in MARKS if m < block), block]
    return dict(zip(at, at[1:]))


def _encode(ids: np.ndarray, block: int, width: int) -> list[bytes]:
    sizes = _lengths(len(ids), block)
    lanes = n = len(sizes)
    own = [ids[i * block : i * block + k] for i, k in enumerate(sizes.tolist())]
    numbers, first = np.zeros((lanes, block), np.uint16), np.zeros(1 << width, np.uint16)
    for i, x in enumerate(own):
        numbers[i, : len(x)] = _numbered(x, first)
    steps = np.ascontiguousarray(numbers.T)  # one row for each step
    escaped = np.zeros((block, lanes), bool)
    m, w = _Model(lanes, block), _Writer(lanes, block // 2 + 64)
    ends, since, bases = _ends(block), 0, m.base[:, None]
    for t in range(block):
        if t == sizes[-1]:
            n = lanes - 1
            if not n:
                break
            m.keep(n)
        if t % 16 == 0:
            w.room(3 * 16 + 8)
        if t in ends:
            if t:
                m.take_over(steps[:t], escaped[since:t].sum(axis=0))
            since = t
            places = numbers[:, t : ends[t]] + bases
            entries, xs = m.order0.ravel().take(places, mode="wrap").T.astype(np.int32, order="C"), steps[t : ends[t]].astype(np.int32)
        x = xs[t - since, :n]
        m.predict()
        start, size = m.interval(x, entries[t - since, :n])
        unseen = (size == 0).nonzero()[0]
        if len(unseen):
            m.escaped(unseen, start, size)
            escaped[t, unseen] = True
        low, span = w.low[:n], w.span[:n]
        span >>= UNIT_BITS
        low += start.astype(np.int64) * span
        span *= size.astype(np.int64)
        w.settle(n)
        m.learn(t, x)
    rest = [x[escaped[: len(x), i]] for i, x in enumerate(own)]
    return [_HEAD.pack(len(a), len(x)) + a + b for a, b, x in zip(w.done(), _encode_unseen(rest, width), rest)]


def _groups(blocks: int) -> list[slice]:
    """Blocks that are coded in step: equally many, at most LANES."""
    each = -(-blocks // max(1, -(-blocks // LANES)))
    return [slice(k, k + each) for k in range(0, blocks, max(1, each))]


def encode(ids: np.ndarray, block: int, width: int) -> list[bytes]:
    """One byte string for each block of `block` ids (the last may be shorter); ids below 2**width, width <= 20, block <= MOST_BLOCK."""
    if block > MOST_BLOCK or width > 20:
        raise ValueError("blocks or ids are too large for the coder")
    return [b for s in _groups(-(-len(ids) // block)) for b in _encode(ids[s.start * block : s.stop * block], block, width)]


def _decode(blocks: list[bytes], total: int, block: int, width: int) -> np.ndarray:
    sizes = _lengths(total, block)
    lanes = n = len(sizes)
    heads = [_HEAD.unpack_from(b) for b in blocks]
    rest = _decode_unseen([b[_HEAD.size + k :] for b, (k, _) in zip(blocks, heads)], np.array([k for _, k in heads]), width)
    m = _Model(lanes, block)
    names, first = np.zeros((lanes, m.size), np.uint16 if width <= 16 else np.uint32), np.zeros(1 << width, np.uint16)
    numbers = []
    for i, x in enumerate(rest):
        numbers.append(_numbered(x, first))
        names[i][numbers[-1]] = x
    next_ = np.cumsum([0, *map(len, rest)])[:-1]  # the place of each lane's next unseen id
    numbers, before = np.concatenate([*numbers, np.zeros(1, np.uint16)]), next_.copy()
    r = _Reader([b[_HEAD.size : _HEAD.size + k] for b, (k, _) in zip(blocks, heads)])
    out, ends, order0 = np.zeros((block, lanes), np.uint16), _ends(block), m.order0.ravel()
    slots, lane_slots = np.zeros(lanes, np.uint16), np.arange(lanes, dtype=np.int64)
    for t in range(block):
        if t == sizes[-1]:
            n = lanes - 1
            if not n:
                break
            m.keep(n)
        if t in ends and t:
            m.take_over(out[:t], next_ - before)
            before = next_.copy()
            # order 0's ids, one slot for each count
            slots = np.repeat(np.tile(np.arange(m.distinct, dtype=np.uint16), n), m.counts[:n, : m.distinct].ravel())
            lane_slots = np.arange(lanes, dtype=np.int64) * t
        m.predict()
        (a, b), (fa, fb), one, at = m.candidates, m.f, m.one, m.after
        code, unit = r.code[:n], r.span[:n]
        unit >>= UNIT_BITS
        value = (code / unit).astype(np.int32)
        np.minimum(value, _UNITS - 1, out=value)
        # how far the value lies behind the start of the candidates' own units
        m.index[...] = m.candidates
        m.index += m.base
        order0.take(m.index, out=at, mode="wrap")
        at >>= COUNT_BITS
        at *= one
        less = b < a
        work = m.t[0]
        np.multiply(fb, less, out=work)
        at[0] += work
        np.multiply(fa, less, out=work)
        at[1] += fa
        at[1] -= work
        np.subtract(value, at, out=at)
        named_a, named_b = at.view(np.uint32) < m.f.view(np.uint32)
        np.maximum(at, 0, out=at)
        np.minimum(at, m.f, out=at)
        left = value - at[0]
        left -= at[1]
        np.multiply(one, m.total, out=work)
        work += fa
        work += fb
        unseen = (value >= work).nonzero()[0]
        c = _quotient(left, one)
        np.minimum(c, max(0, m.total - 1), out=c)  # lanes that have an unseen id
        c += lane_slots[:n]
        x = np.where(named_a, a, np.where(named_b, b, slots.take(c, mode="wrap").astype(np.int32)))
        if len(unseen):
            place = next_.take(unseen)
            x[unseen] = numbers.take(place, mode="clip")
            place += 1
            next_[unseen] = place
        m.found[...] = x
        m.found += m.base
        order0.take(m.found, out=work, mode="wrap")
        start, size = m.interval(x, work.copy())
        if len(unseen):
            m.escaped(unseen, start, size)
        code -= start.astype(np.int64) * unit
        unit *= size.astype(np.int64)
        r.settle(n)
        out[t, :n] = x
        m.learn(t, x)
    plain = np.empty(lanes * block, np.uint32)
    for i in range(lanes):
        plain[i * block : (i + 1) * block] = names[i].take(out[:, i], mode="clip")
    return plain[:total]


def decode(blocks: list[bytes], total: int, block: int, width: int) -> np.ndarray:
    """The ids (unsigned 32-bit) of all blocks."""
    out = [np.empty(0, np.uint32)]
    for s in _groups(len(blocks)):
        out.append(_decode(blocks[s], min(total, s.stop * block) - s.start * block, block, width))
    return np.concatenate(out)
