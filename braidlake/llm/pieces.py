"""SentencePiece encoding and decoding: a streaming Viterbi search over a piece model read from its file.

The search goes over a text character by character and keeps, for each end position, the best path to it with a
backpointer. Pieces have a largest length M, so a position more than M back can't be extended: paths that end there
die. As soon as all surviving paths run through one boundary, the ids up to it are committed and the window moves on.

Between two characters that stand side by side in no piece every path has a boundary: all paths converge there
whatever comes before or after, so the search commits and starts afresh. What it finds between two such boundaries
depends on that run alone. ``Search`` therefore takes a block of text, finds these boundaries first, and runs the search
over all different runs of the block side by side (``_lanes``: one step of every run's window at a time, in NumPy). Runs
longer than LANE characters have windows of their own (``Model.search``), which commit wherever their paths converge.
A table of at most MEMO runs with their ids lives as long as the task.

Two kinds of model are read. In a unigram model any piece may follow any other and the sum of scores decides. In a
BPE model a path is valid if no two neighbouring pieces would be merged otherwise when their strings are tokenized
together; there is one such path to each position that has any, and it is the merges' result. Characters without a
piece become byte pieces. Models with user-defined or unused pieces, without byte pieces, or that change characters
or white space are refused.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import Ranges, mix
from .frame_tables import batch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of a block; a longer text is taken in blocks that end at a boundary of all paths.
BLOCK = 1 << 20
#: Runs of up to so many characters are searched side by side.
LANE = 64
#: Runs that are remembered: 24 bytes and their ids each.
MEMO = 1 << 17
START, NONE, RAW = -2, -1, -3


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed and counted fields come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and settings of a model file's bytes."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix = UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave characters and white space as they are can be read")
                self.prefix = bool(spec.get(3, 1))
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be read")
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces can't be read")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("models without byte pieces can't be read")
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        #: No piece has the space sign behind another character: there is a boundary before each word.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._follows: dict[tuple[str, str], bool] = {}

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def merges(self, text: str) -> list[tuple[int, str, str]]:
        """BPE by its definition: again and again the leftmost best pair of neighbours becomes one. (place, left, right) of each."""
        parts, out = list(text), []
        while True:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return [*out, (len(parts), "", "")]
            k = min(found)[1]
            out.append((k, parts[k], parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        for k, a, b in self.merges(text)[:-1]:
            parts[k : k + 2] = [a + b]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a."""
        if self.type == UNIGRAM or a not in self.ids or b not in self.ids:
            return True
        known = self._follows.get((a, b))
        if known is None:
            if len(self._follows) >= 1 << 14:
                self._follows.clear()
            known = self._follows[a, b] = self.merged(a + b) == [a, b]
        return known

    def search(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the best path, in runs, each given as soon as no surviving path can change it."""
        ids, tails, scores, longest, follows = self.ids, self.tails, self.scores, self.longest, self.follows
        # position: [score, position before, ids of the last piece, the last piece, positions after]
        nodes: dict[int, list] = {0: [0.0, -1, [], "", []]}
        window, n, base = "", 0, 0
        for c in chars:
            n += 1
            window = (window + c)[-longest:]
            best = None
            for size in range(1, len(window) + 1):
                piece = window[-size:]
                if piece not in tails and size > 1:
                    break
                before = nodes.get(n - size)
                if before is None:
                    continue
                i = ids.get(piece)
                if i is None:
                    if size > 1:
                        continue
                    own, score = self.fallback(c), before[0] + self.floor
                elif follows(before[3], piece):
                    own, score = [i], before[0] + scores[i]
                else:
                    continue
                if best is None or score >= best[0]:
                    best = [score, n - size, own, piece, []]
            if best is not None:
                nodes[n] = best
                nodes[best[1]][4].append(n)
            old = n - longest
            at = old
            while at > base and (node := nodes.get(at)) is not None and not node[4]:
                del nodes[at]
                after = nodes[node[1]][4]
                after.remove(at)
                at = node[1] if node[1] <= old else -1
            done: list[int] = []
            while base <= old and len(nodes[base][4]) == 1:
                ahead = nodes.pop(base)[4][0]
                done += nodes[ahead][2]
                nodes[ahead][1] = -1
                base = ahead
            if done:
                yield done
        out: list[list[int]] = []
        while n > base:
            out.append(nodes[n][2])
            n = nodes[n][1]
        if out:
            yield [i for part in reversed(out) for i in part]


class _Table:
    """64-bit keys to ints, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        self.log2 = max(8, int(4 * len(keys)).bit_length())
        self.keys, self.values, self.absent = np.zeros(1 << self.log2, np.uint64), np.full(1 << self.log2, absent, np.int32), absent
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left], self.probes)
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            take = free[one]
            self.keys[at[take]], self.values[at[take]] = keys[left[take]], values[left[take]]
            left = np.delete(left, take)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.log2)).astype(np.int64) + probe) & ((1 << self.log2) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys, 0)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.absent)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(keys[open_], probe)
            found = self.keys[at]
            same = found == keys[open_]
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (found != 0)]
        return out


def _char_codes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


class Lattice:
    """What the search asks of a model, as arrays of a fixed size."""

    def __init__(self, data: bytes):
        m = self.model = Model(data)
        valid = m.ids
        if m.type == BPE:  # how each piece comes about; those that merging never gives are on no path
            self.rank = np.full(len(m.pieces), -1, np.int32)
            self.left, self.right = np.arange(len(m.pieces)), np.arange(len(m.pieces))
            order = {i: r for r, i in enumerate(sorted(m.ids.values(), key=lambda i: (-m.scores[i], i)))}
            equal = {x for x, n in Counter(m.scores[i] for i in m.ids.values()).items() if n > 1}
            valid, self.odd = {}, np.zeros(len(m.pieces), bool)
            for p, i in m.ids.items():
                *steps, (n, _, _) = m.merges(p)
                if n == 1:
                    valid[p] = i
                    if steps:
                        a, b = (m.ids.get(x, NONE) for x in steps[-1][1:])
                        self.rank[i] = order[i]
                        self.left[i], self.right[i] = (x if x >= 0 else i for x in (a, b))
                        self.odd[i] = a < 0 or b < 0 or m.scores[i] in equal
            # pieces that a piece of no lower rank went into, or one of a rank that others have: they are tokenized to be judged
            inner = np.flatnonzero(self.rank >= 0)
            self.odd[inner] |= np.maximum(self.rank[self.left[inner]], self.rank[self.right[inner]]) >= self.rank[inner]
            for i in inner[np.argsort(self.rank[inner])]:
                self.odd[i] |= self.odd[self.left[i]] | self.odd[self.right[i]]
            pairs = [(a, b, order[i]) for p, i in m.ids.items() for k in range(1, len(p)) if (a := valid.get(p[:k])) is not None and (b := valid.get(p[k:])) is not None]
            a, b, r = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 3
            self.joint = _Table(_pair_keys(a, b), r.astype(np.int32), 1 << 30)
        starts: dict[str, int] = {p[:k]: NONE for p in valid for k in range(1, len(p))} | valid
        text = "".join(starts)
        end = np.cumsum([len(p) for p in starts])
        names = Ranges(_char_codes(_points(text)))
        self.known = _Table(names.of(end - [len(p) for p in starts], end) | np.uint64(1), np.array(list(starts.values()), np.int32), START)
        self.scores = np.append(np.array(m.scores), [m.floor, 0, 0])  # the floor stands at RAW
        self.longest = m.longest
        # classes of characters that stand next to another in a piece
        inside = sorted({p[i : i + 2] for p in valid for i in range(len(p) - 1)})
        chars = sorted({c for x in inside for c in x})
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        at = {c: i for i, c in enumerate(chars, 1)}
        self.inside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        if inside:
            self.inside[[at[x[0]] for x in inside], [at[x[1]] for x in inside]] = True
        self.raw_end = np.cumsum([len(r) for r in m.raw])
        self.raw_size = np.diff(self.raw_end, prepend=0)
        self.raw = np.frombuffer(b"".join(m.raw), np.uint8)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each piece b may follow a (pieces' ids, or START or RAW).

        The merges that make a and b are undone, last first; a merge across the border that would have come before
        one of them stands against it. Of merges of one rank the left one comes first.
        """
        ok = np.ones(len(a), bool)
        if self.model.type == UNIGRAM:
            return ok
        real, pieces = (a >= 0) & (b >= 0), self.model.pieces
        slow = real & (self.odd[a] | self.odd[b])
        if slow.any():
            ok[slow] = [self.model.follows(pieces[x], pieces[y]) for x, y in zip(a[slow].tolist(), b[slow].tolist(), strict=True)]
        at = np.flatnonzero(real & ~slow)
        x, y, limit = a[at], b[at], np.full(len(at), 1 << 29, np.int32)
        while len(at):
            bad = self.joint.get(_pair_keys(x, y)) < limit
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's bytes end)."""
        size = self.raw_size[ids]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.raw_end[ids] - end, size)
        return self.raw[at], end


class Search:
    """The search over blocks of text, with the ids of runs that were searched before."""

    def __init__(self, lattice: Lattice, memo: int = MEMO):
        self.lattice, self.limit = lattice, memo
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def block(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the parts in them). Parts begin and end at boundaries of all paths; spaces are signs already."""
        t = self.lattice
        points = _points("".join(parts))
        off = np.cumsum([0, *map(len, parts)])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        kind = t.class_of[points]
        new = np.ones(len(points), bool)
        new[1:] = ~t.inside[kind[:-1], kind[1:]]
        new[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(points))
        names = Ranges(_char_codes(points))
        key, first, which = np.unique(names.of(start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        missing = first[~hit]
        ids, count = self._searched(points, names, start[missing], end[missing])
        at, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at[hit], n[hit] = self.at[place[hit]], self.count[place[hit]]
        at[~hit], n[~hit] = len(self.flat) + np.cumsum(count) - count, count
        self.flat = np.concatenate([self.flat, ids])
        size = n[which]
        stop = np.cumsum(size)
        out = self.flat[np.arange(int(stop[-1])) + np.repeat(at[which] - stop + size, size)]
        if len(self.keys) + len(missing) > self.limit:  # only what this block has asked for stays
            self.keys, self.at, self.count = key[: self.limit], at[: self.limit], n[: self.limit]
            stop_ = np.cumsum(self.count)
            self.flat = self.flat[np.arange(int(stop_[-1])) + np.repeat(self.at - stop_ + self.count, self.count)]
            self.at = stop_ - self.count
        elif len(missing):
            keys = np.concatenate([self.keys, key[~hit]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.count = keys[order], np.concatenate([self.at, at[~hit]])[order], np.concatenate([self.count, count])[order]
        return out, np.append(0, stop)[np.searchsorted(start, off)]

    def _searched(self, points: np.ndarray, names: Ranges, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs one after the other, number of ids of each)."""
        short = end - start <= LANE
        ids, lane = self._lanes(points, names, start[short], end[short])
        lane = np.flatnonzero(short)[lane]
        if not short.all():
            m = self.lattice.model
            for k in np.flatnonzero(~short):
                own = [i for run in m.search(map(chr, points[start[k] : end[k]].tolist())) for i in run]
                ids, lane = np.append(ids, np.array(own, np.int32)), np.append(lane, np.full(len(own), k))
            order = np.argsort(lane, kind="stable")
            ids, lane = ids[order], lane[order]
        return ids.astype(np.int32), np.bincount(lane, minlength=len(start))

    def _lanes(self, points: np.ndarray, names: Ranges, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The search over many runs at once, step by step: (ids, run of each)."""
        t = self.lattice
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = end - start
        lane = np.repeat(np.arange(len(size)), size)
        j = np.arange(len(lane)) - np.repeat(np.cumsum(size) - size, size)
        p, root = start[lane] + j, np.cumsum(size + 1) - size - 1
        node, room = root[lane] + j, size[lane] - j
        edges = []
        alive = np.arange(len(lane))
        for k in range(1, t.longest + 1):
            alive = alive[room[alive] >= k]
            if not len(alive):
                break
            found = t.known.get(names.of(p[alive], p[alive] + k) | np.uint64(1))
            if k == 1:
                none = alive[found < 0]
                edges.append((none, np.full(len(none), 1), np.full(len(none), RAW)))
            piece = found >= 0
            edges.append((alive[piece], np.full(int(piece.sum()), k), found[piece].astype(np.int64)))
            alive = alive[found != START]
        at, width, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        step = j[at] + width
        order = np.argsort(step, kind="stable")
        before, width, piece, step = node[at[order]], width[order], piece[order], step[order]
        last, back, score = np.full(int((size + 1).sum()), NONE), np.zeros(int((size + 1).sum()), np.int64), np.zeros(int((size + 1).sum()))
        last[root] = START
        cuts = np.searchsorted(step, np.arange(1, int(step[-1]) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, w, q = before[a:b], width[a:b], piece[a:b]
            own = last[x]
            ok = np.flatnonzero(own != NONE)
            ok = ok[t.may_follow(own[ok], q[ok])]
            x, w, q = x[ok], w[ok], q[ok]
            to, s = x + w, score[x] + t.scores[q]
            if t.model.type == UNIGRAM:
                best = np.lexsort((w, s, to))  # of equal sums the longest last piece
                best = best[np.append(to[best][1:] != to[best][:-1], True)] if len(best) else best
                to, s, w, q = to[best], s[best], w[best], q[best]
            last[to], back[to], score[to] = q, w, s
        ends, owner, found = root + size, np.arange(len(size)), []
        while len(ends):
            found.append((ends, owner))
            ends = ends - back[ends]
            go = ends > root[owner]
            ends, owner = ends[go], owner[go]
        ends, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ends)
        ends, owner = ends[order], owner[order]
        ids = last[ends]
        raw = np.flatnonzero(ids == RAW)
        if len(raw):
            each = [t.model.fallback(chr(points[i])) for i in (start[owner[raw]] + ends[raw] - root[owner[raw]] - 1).tolist()]
            times = np.ones(len(ids), np.int64)
            times[raw] = [len(x) for x in each]
            spread = np.repeat(np.arange(len(ids)), times)
            is_raw = ids[spread] == RAW
            ids, owner = ids[spread], owner[spread]
            ids[is_raw] = [i for x in each for i in x]
        return ids, owner


def _parts(text: str, model: Model) -> Iterator[str]:
    """The text with the prefix and space signs, in parts of up to BLOCK characters that end at boundaries of all paths.

    A text in which no such place is found within a block is one part.
    """
    text = ((SPACE if model.prefix else "") + text.replace(" ", SPACE)) if text else ""
    at = 0
    while len(text) - at > BLOCK and model.by_word:
        cut = at + BLOCK
        while cut > at and (text[cut] != SPACE or text[cut - 1] == SPACE):
            cut -= 1
        if cut == at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Codec:
    def __init__(self, lattice: Lattice, memo: int = MEMO):
        self.lattice, self.search = lattice, Search(lattice, memo)

    def rows(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, bool]]:
        """(text, ids, decoded bytes, whether it is the text's first part, its last) for all parts of the texts in order."""
        group: list[tuple[int, str, bool, bool]] = []
        held = 0
        for i, text in enumerate(texts):
            first, parts = True, _parts(text, self.lattice.model)
            part = next(parts)
            while part is not None:
                after = next(parts, None)
                group.append((i, part, first, after is None))
                held += len(part)
                part, first = after, False
                if held >= BLOCK // 2:
                    yield from self._done(group)
                    group, held = [], 0
        yield from self._done(group)

    def _done(self, group):
        if not group:
            return
        ids, off = self.search.block([g[1] for g in group])
        raw, end = self.lattice.decode(ids)
        cut = np.append(0, end)[off]
        for (i, _, first, last), a, b, c, d in zip(group, off[:-1], off[1:], cut[:-1], cut[1:], strict=True):
            own = raw[c:d]
            yield i, ids[a:b], own[1:] if first and self.lattice.model.prefix and d > c and own[0] == 32 else own, first, last

    def encode(self, text: str) -> list[int]:
        return [x for _, ids, _, _, _ in self.rows([text]) for x in ids.tolist()]

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that make no character become U+FFFD."""
        raw = self.lattice.decode(np.asarray(ids, np.int64))[0].tobytes()
        return (raw[1:] if self.lattice.model.prefix and raw[:1] == b" " else raw).decode(errors="replace")


@lru_cache(maxsize=1)
def lattice(data: bytes) -> Lattice:
    """The model's arrays, the same for every task of a worker. What tasks look up isn't kept here."""
    return Lattice(data)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Each whole text as piece ids, and decoded again.

    Returns a row for each row of docs: doc_id, n_bytes (of the text), n_ids, lossless (the decoded text is the text),
    and those named in ``keep``: ids, decoded, ids_sha256 (of the ids as little-endian int32), decoded_sha256.

    A null text is an empty one: no ids, lossless. A text with the sign U+2581 decodes to one with spaces and is not
    lossless. A very long text is searched, hashed and compared in parts; only the columns ids and decoded hold it whole.
    Equal texts get equal values; where two paths of a unigram model are equally good, the longer last piece wins.
    Ids may be null or repeat; other columns, whatever their names, are ignored. No rows in, none out. No shuffle:
    documents are independent. The model is read by the driver and sent along; executors need no file.
    """
    data = _model_bytes(model)
    extra = {"ids": "ids array<int>", "decoded": "decoded string", "ids_sha256": "ids_sha256 string", "decoded_sha256": "decoded_sha256 string"}
    schema = ", ".join(["doc_id long, n_bytes long, n_ids long, lossless boolean", *(extra[k] for k in keep)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lattice(data))
        for x in batches:
            for at in range(0, x.num_rows, 1024):
                part = x.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns: dict[str, list] = {k: [] for k in ("n_bytes", "n_ids", "lossless", *keep)}
                for i, ids, back, first, last in codec.rows(texts):
                    if first:
                        raw, n, count, same, whole, text = texts[i].encode(), 0, 0, True, [], []
                        of_ids, of_text = hashlib.sha256(), hashlib.sha256()
                    same &= raw[n : n + len(back)] == back.tobytes()
                    n, count = n + len(back), count + len(ids)
                    if "ids_sha256" in keep:
                        of_ids.update(ids.astype("<i4").tobytes())
                    if "decoded_sha256" in keep:
                        of_text.update(back.tobytes())
                    if "ids" in keep:
                        whole.append(ids)
                    if "decoded" in keep:
                        text.append(back.tobytes())
                    if last:
                        row = {"n_bytes": len(raw), "n_ids": count, "lossless": same and n == len(raw), "ids_sha256": of_ids.hexdigest(), "decoded_sha256": of_text.hexdigest(), "ids": whole, "decoded": text}
                        for k, v in columns.items():
                            v.append(row[k])
                if "ids" in keep:
                    cut = np.cumsum([0, *(sum(map(len, w)) for w in columns["ids"])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.int32), *(i for w in columns["ids"] for i in w)]), pa.int32()))
                if "decoded" in keep:
                    columns["decoded"] = [b"".join(t).decode() for t in columns["decoded"]]
                yield batch(schema, [part.column(0), *columns.values()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(make, schema)
