"""An adaptive context-mixing range coder for token ids (NumPy; used inside tasks).

Each id is coded once, from one mixed table of frequencies: order 0 gives every id seen its count at the last
renewal (after RENEWALS ids), order 1 and order 2 each add weight to the id that followed the last id, or the
last two, when they were seen before, more the more often they were right; an escape stands for ids not seen,
which follow as 16 plain bits beside the code. A range coder turns the tables into bytes and everything adapts.

A block is coded in lanes of nearly equal length, SEGMENT ids at most, each from a fresh state. The lanes of all
blocks go side by side, in groups of at most GROUP: one NumPy step codes the next id of every lane. So working
arrays are bounded whatever is given, and steps run on full groups however long the blocks are. A block is a
header (magic, number of ids, CRC-32 of the ids), the sizes of its lanes and their codes; reading checks all.
"""

import struct
import zlib

import numpy as np

LIMIT = 1 << 16
BLOCK_IDS = 16384
SEGMENT, GROUP = 1024, 3072
# Ids given at a time that fill a group, as lanes are a bit shorter.
GROUP_IDS = SEGMENT * GROUP * 15 // 16
STEPS = 128
RENEWALS = (128, 512)
# Bits of a context of order 1, and of the entries it has: its own, then those of order 2 below it.
_LINES, _LINE = 8, 3
_TRUST = np.array([0, 64, 256, 768, 1536, 3072, 6144, 8192], np.float32)
# What is added to how sure a guess is: when it was wrong, then when it was right. A guess that was last right too
# long ago (below 2) gives way to another that is as sure as one right once.
_CHANGE = np.array([1, 0] + [(n >> 1) - n for n in range(2, 8)] + [min(n + 1, 7) - n for n in range(8)], np.int32)
# Registers hold whole numbers of 48 bits as doubles; 16 bits leave at a time, once a range is below _LEAST.
_FULL, _LEAST, _WORD = 2.0**48, 2.0**32, 2.0**16
_HEADER = "<4sII"
_HEADER_BYTES = struct.calcsize(_HEADER)
_MAGIC = b"CMR3"


def _escape(history: int) -> int:
    return 64 + history // 8


def _lanes(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, begin and end of every lane of blocks of so many ids."""
    sizes = np.array(sizes, np.int64)
    count = -(-sizes // SEGMENT)
    block = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    return block, sizes[block] * k // count[block], sizes[block] * (k + 1) // count[block]


def _groups(length: np.ndarray):
    """Lanes in groups of at most GROUP, the longest first."""
    order = np.argsort(-length, kind="stable")
    return np.array_split(order, -(-len(order) // GROUP)) if len(order) else []


def _pieces(longest: int):
    """(renewal, from, to): runs of at most STEPS places between renewals."""
    bounds = [0, *(x for x in RENEWALS if x < longest), longest]
    for a, b in zip(bounds, bounds[1:], strict=False):
        for t in range(a, b, STEPS):
            yield a, t, min(t + STEPS, b)


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each id among the different ids of its lane [lane, step]; one more than the largest."""
    rank = np.empty(ids.shape, np.uint16)
    for i in range(0, len(ids), 64):
        own = ids[i : i + 64]
        order = np.argsort(own, axis=1, kind="stable")
        found = np.take_along_axis(own, order, 1)
        new = np.zeros(own.shape, np.uint16)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        np.put_along_axis(rank[i : i + 64], order, np.cumsum(new, axis=1, dtype=np.uint16), 1)
    return rank, int(rank.max()) + 1


def _counted(rank: np.ndarray, distinct: int, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Order 0 of lanes that are known, flat by lane and rank: where runs start among the first ``a`` ids, sorted, and their sizes."""
    start, size = np.empty((2, len(rank), distinct), np.float32)
    esc = _escape(a)
    for i in range(0, len(rank), 256):
        own = rank[i : i + 256, :a]
        row = np.arange(len(own))[:, None] * distinct
        count = np.bincount((own + row).ravel(), minlength=len(own) * distinct).reshape(-1, distinct)
        seen = count > 0
        # An escape is at 0.
        start[i : i + 256] = (np.cumsum(count, axis=1) - count + esc) * seen
        size[i : i + 256] = count + esc * ~seen
    return start.ravel(), size.ravel()


def _table(ids: np.ndarray, esc: int) -> np.ndarray:
    """Order 0 of lanes that are read: [lane, place] of the escape and the first ids, sorted; id, start and size of the run in 16, 24, 24 bits."""
    t, n = ids.shape
    out = np.full((n, esc + t), esc << 40, np.int64)
    place = np.arange(t, dtype=np.int32)[None, :]
    for i in range(0, n, 64):
        found = np.sort(ids[:, i : i + 64].T.astype(np.uint16), axis=1, kind="stable")
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        start = np.maximum.accumulate(np.where(new, place, np.int32(0)), axis=1)
        last = np.ones_like(new)
        last[:, :-1] = new[:, 1:]
        end = np.minimum.accumulate(np.where(last, place + np.int32(1), np.int32(t))[:, ::-1], axis=1)[:, ::-1]
        out[i : i + 64, esc:] = ((end - start).astype(np.int64) << 40) | ((start.astype(np.int64) + esc) << 16) | found
    return out


class _Guesses:
    """Orders 1 and 2 of n lanes, side by side: an entry is the id that followed and, in 3 bits, how often that was right.

    What the last id says lies beside what the last two say, so that one place in memory is met for each id.
    """

    def __init__(self, n: int):
        self.entries = np.full(n << _LINES + _LINE, LIMIT << 3, np.int32)
        self.lane = np.arange(n) << _LINES + _LINE

    def look(self, slots: np.ndarray):
        """Guesses [order, lane] and their weights; LIMIT where there is none."""
        self.slots = slots
        self.found = self.entries.take(slots, mode="clip")
        self.sure = self.found & 7
        self.guess = self.found >> 3
        return self.guess, _TRUST.take(self.sure, mode="clip")

    def learn(self, x: np.ndarray) -> np.ndarray:
        """The ids that came; which guesses were right."""
        off = x - self.guess
        hit = off == 0
        case = self.sure + (hit.view(np.int8) << 3)
        self.sure -= 2
        self.sure >>= 31  # all bits where it was below 2
        off &= self.sure
        off <<= 3
        off += self.found
        off += _CHANGE.take(case, mode="clip")
        self.entries[self.slots.ravel()] = off.ravel()
        return hit


def _choose(start, size, w, known: float, hit: np.ndarray):
    """Put where an id is in the mixed table, and its weight there, in place of what order 0 says (no branches, as they cost more)."""
    one, two = hit.astype(np.float32)
    either = np.maximum(one, two)
    rest = 1 - either
    start *= rest
    size *= rest
    # Order 2 goes before order 1; its share lies behind that of order 1.
    w1, w2 = w
    one = either - two
    one *= w1
    size += one
    size += two * w2
    two *= w1
    start += two
    either *= known
    start += either


def _line(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the last id begin, and which of those belongs to the id before the last."""
    mixed = x * 40503
    return (mixed >> 3 & (1 << _LINES) - 1) << _LINE, (mixed >> 7 & 255) * ((1 << _LINE) - 1) >> 8


def _contexts(ids: np.ndarray, begin: int, stop: int, lane: np.ndarray) -> np.ndarray:
    """Slots [step, order, lane] of known ids [step, lane]."""
    line, below = _line(ids[max(begin - 2, 0) : stop - 1].astype(np.int64))
    missing = max(2 - begin, 0)
    line, below = (np.concatenate([np.zeros((missing, ids.shape[1]), np.int64), v]) for v in (line, below))
    line = line[1:] + lane[: ids.shape[1]]
    return np.stack([line, line + below[:-1] + 1], axis=1)


def _encode_lanes(known: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes [lane, step], the longest first, coded: all words and their number for each lane, then the same for plain ids."""
    n, longest = known.shape
    ids = known.T.astype(np.int32, order="C")
    guesses, low, width = _Guesses(n), np.zeros(n), np.full(n, _FULL)
    shorter = -lengths
    words, given, escaped = np.zeros((longest + 3, n), np.int32), np.zeros((longest + 3, n), bool), np.zeros((longest, n), bool)
    rank, distinct = _ranks(known) if longest > RENEWALS[0] else (None, 0)
    counted = -1
    for a, begin, stop in _pieces(longest):
        wide = int((lengths > begin).sum())
        esc = float(_escape(a))
        slots = _contexts(ids[:, :wide], begin, stop, guesses.lane)
        if a:
            if counted != a:
                starts, sizes = _counted(rank[:wide], distinct, a)
                counted = a
            place = rank[:wide, begin:stop].T + np.arange(wide) * distinct
            start_of, size_of = starts.take(place), sizes.take(place)
        else:
            start_of, size_of = np.zeros((stop - begin, wide), np.float32), np.full((stop - begin, wide), esc, np.float32)
        ends = np.searchsorted(shorter, -np.arange(begin, stop)).tolist()
        for t, live in enumerate(ends):
            lo, wd, start, size = low[:live], width[:live], start_of[t, :live], size_of[t, :live]
            _, w = guesses.look(slots[t, :, :live])
            hit = guesses.learn(ids[begin + t, :live])
            r = wd / (w[0] + w[1] + (esc + a)).astype(float)
            np.floor(r, out=r)
            _choose(start, size, w, esc + a, hit)
            np.multiply(r, size, out=wd)
            r *= start
            lo += r
            # A word leaves every lane; it counts where the range is small.
            due = np.less(wd, _LEAST, out=given[begin + t, :live]).astype(float)
            np.multiply(lo, 1 / _LEAST, out=r)
            np.floor(r, out=r)
            words[begin + t, :live] = r
            r *= due
            r *= _LEAST
            lo -= r
            due *= _WORD - 1
            due += 1
            lo *= due
            wd *= due
        escaped[begin:stop, :wide] = (start_of == 0) & (np.arange(begin, stop)[:, None] < lengths[:wide])
    given[longest:] = True
    for k, shift in enumerate((_LEAST, _WORD, 1.0)):
        word = np.floor(low / shift)
        words[longest + k] = word
        low -= word * shift
    out = words.T[given.T]
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:-1] += carry[1:]
    return out.astype("<u2"), given.sum(axis=0), known[escaped.T].astype("<u2"), escaped.sum(axis=0)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (0 to LIMIT - 1) as bytes; larger ids are an error."""
    if any(len(b) and (int(b.min()) < 0 or int(b.max()) >= LIMIT) for b in blocks):
        raise ValueError(f"ids must be from 0 to {LIMIT - 1}")
    block, begin, end = _lanes([len(b) for b in blocks])
    made = [None] * len(block)
    for group in _groups(end - begin):
        lengths = (end - begin)[group]
        known = np.zeros((len(group), int(lengths[0])), np.uint16)
        for row, lane in zip(known, group.tolist(), strict=True):
            part = blocks[block[lane]][begin[lane] : end[lane]]
            row[: len(part)] = part
        words, n_words, plain, n_plain = _encode_lanes(known, lengths)
        to, to_plain = np.cumsum(n_words), np.cumsum(n_plain)
        for lane, a, b, c, d in zip(group.tolist(), to - n_words, to, to_plain - n_plain, to_plain, strict=True):
            made[lane] = struct.pack("<HH", b - a, d - c), words[a:b].tobytes() + plain[c:d].tobytes()
    bounds = np.searchsorted(block, np.arange(len(blocks) + 1)).tolist()
    codes = []
    for own, i, j in zip(blocks, bounds, bounds[1:], strict=False):
        head = struct.pack(_HEADER, _MAGIC, len(own), zlib.crc32(own.astype("<u4").tobytes()))
        codes.append(b"".join([head, *(m[0] for m in made[i:j]), *(m[1] for m in made[i:j])]))
    return codes


def _decode_lanes(lengths: np.ndarray, data: np.ndarray, at: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Lanes back [step, lane], the longest first; data has words from ``at`` on and plain ids from ``plain`` on."""
    n, longest = len(lengths), int(lengths[0])
    guesses, width, code = _Guesses(n), np.full(n, _FULL), np.zeros(n)
    shorter = -lengths
    for _ in range(3):
        code = code * _WORD + data.take(at, mode="clip")
        at = at + 1
    plain, made = plain.copy(), np.zeros((longest, n), np.int32)
    slots, below, made_for = np.stack([guesses.lane, guesses.lane + 1]), np.zeros(n, np.int64), -1
    for a, begin, stop in _pieces(longest):
        esc = _escape(a)
        if a and made_for != a:
            table = _table(made[:a, : int((lengths > a).sum())], esc)
            rows, last, made_for = np.arange(len(table)) * float(esc + a), float(esc + a - 1), a
            table = table.ravel()
        for t, live in enumerate(np.searchsorted(shorter, -np.arange(begin, stop)).tolist(), begin):
            cd, wd, to, x = code[:live], width[:live], at[:live], made[t, :live]
            guess, w = guesses.look(slots[:, :live])
            base = w[0] + (esc + a)
            r = wd / (base + w[1]).astype(float)
            np.floor(r, out=r)
            value = cd / r
            np.floor(value, out=value)
            new = np.flatnonzero(value < esc)
            hit1, hit2 = (value >= esc + a).view(np.int8), (value >= base).view(np.int8)
            if a:
                value = np.minimum(value, last, out=value)
                value += rows[:live]
                entry = table.take(value.astype(np.int64), mode="clip")
                np.bitwise_and(entry, LIMIT - 1, out=x, casting="same_kind")
                size = (entry >> 40).astype(np.float32)
                entry >>= 16
                entry &= 0xFFFFFF
                start = entry.astype(np.float32)
            else:
                start, size = np.zeros(live, np.float32), np.full(live, esc, np.float32)
            # The id of order 0, 1 or 2, without branches.
            hit1 -= hit2
            x *= 1 - hit1 - hit2
            x += guess[0] * hit1
            x += guess[1] * hit2
            _choose(start, size, w, float(esc + a), np.stack([hit1, hit2]))
            start = r * start
            cd -= start
            np.multiply(r, size, out=wd)
            due = (wd < _LEAST).astype(np.int8)
            more = due * (_WORD - 1)
            more += 1
            cd *= more
            wd *= more
            cd += data.take(to, mode="clip") * due.view(np.uint8)
            to += due
            if len(new):
                own = plain[new]
                x[new] = data.take(own, mode="clip")
                plain[new] = own + 1
            guesses.learn(x)
            line, after = _line(x.astype(np.int64))
            np.add(line, guesses.lane[:live], out=slots[0, :live])
            below[:live] += 1
            np.add(slots[0, :live], below[:live], out=slots[1, :live])
            below[:live] = after
    return made


def decode(codes: list[bytes]) -> list[np.ndarray]:
    """The blocks back; raises if a header or checksum is wrong."""
    heads = [struct.unpack_from(_HEADER, c) for c in codes]
    if any(h[0] != _MAGIC for h in heads):
        raise ValueError("not a token block")
    block, begin, end = _lanes([h[1] for h in heads])
    count = np.bincount(block, minlength=len(codes)).tolist()
    data, sizes, firsts, at = [], [], [], 0
    for c, k in zip(codes, count, strict=True):
        body = np.frombuffer(c, "<u2", -1, _HEADER_BYTES) if len(c) % 2 == 0 else np.zeros(0, "<u2")
        own = body[: 2 * k].astype(np.int64)
        if len(own) != 2 * k or int(own.sum()) != len(body) - 2 * k:
            raise ValueError("a token block fails its checksum")
        sizes.append(own)
        firsts.append(at + 2 * k + np.cumsum(own) - own)
        data.append(body)
        at += len(body)
    blocks = [np.empty(h[1], np.uint32) for h in heads]
    if len(block):
        data = np.concatenate([*data, np.zeros(1, "<u2")])
        # A lane's words, then its plain ids.
        words, plain = np.concatenate(firsts).reshape(-1, 2).T
        with np.errstate(all="ignore"):
            for group in _groups(end - begin):
                made = _decode_lanes((end - begin)[group], data, words[group], plain[group])
                for lane, ids in zip(group.tolist(), made.T.astype(np.uint32), strict=True):
                    blocks[block[lane]][begin[lane] : end[lane]] = ids[: end[lane] - begin[lane]]
    if any(zlib.crc32(b.astype("<u4").tobytes()) != h[2] for b, h in zip(blocks, heads, strict=True)):
        raise ValueError("a token block fails its checksum")
    return blocks
