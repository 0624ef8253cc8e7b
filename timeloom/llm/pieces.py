"""SentencePiece vocabularies: N-best segmentation and decoding.

The lattice of a text has an edge for each piece that matches at a position; a
path's score is the sum of its pieces' weights.  The forward Viterbi pass gives
the best score of every prefix.  These scores are exact heuristics for an A*
search from the end of the text backwards, which therefore yields the best,
second best and further segmentations one after the other without ever
expanding a partial path that can't be next.

No piece of such a vocabulary has a word mark after another sign, so the
lattice falls apart before each run of word marks; the parts are searched
alone and their lists joined, again best first.  The first path that the search
of a part meets is the forward pass's own backtrace, and many short parts take
their forward passes together; the queue is needed for the parts in which the
further segmentations of a text differ from its best.

Weights are whole numbers (of ``1 / SCALE``), so sums are exact and don't depend
on their order.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trim_memory

MARK = "▁"
#: A weight of 1.0 in the whole numbers that are added.
SCALE = 1 << 16
#: A merge rank r of a BPE model, whose scores are no probabilities, weighs as a
#: word of that rank does by the Zipf-Mandelbrot law: 1 / (r + RANK_SHIFT).
RANK_SHIFT = 500
#: What a byte costs below the lowest weight of a piece, so that bytes stand in
#: for signs that the vocabulary lacks and for nothing else.
BYTE_PENALTY = 10.0
#: Parts of texts whose segmentation a worker remembers, and the longest of them.
REMEMBERED = 150_000
REMEMBERED_LENGTH = 64
#: Bytes of texts whose new parts are searched together.
TOGETHER = 3 << 20
#: Bytes of ids, one for each part, after which a worker hands its rows on.
HANDED_ON = 1 << 22
#: Below any score of a path, of a short part's path.
NONE, FEW = -(1 << 60), -(1 << 29)


def _splitter(normal, lone: str) -> re.Pattern:
    """Cuts a text where no piece can cross: before each run of spaces, around
    white space that no piece has, and between a letter, digit or sign beyond
    ASCII and an ASCII sign that no piece has right after such a one."""
    pairs = {(a, b) for p in normal for a, b in zip(p, p[1:])}
    if any(b == " " and a != " " for a, b in pairs):
        return re.compile("(?s:.+)")
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    joined = {b for a, b in pairs if b in signs and not (a in signs or a == " ")}
    word = "".join(re.escape(c) for c in [" ", *signs]) + lone
    sign, kept = ("".join(map(re.escape, x)) for x in (signs, sorted(joined)))
    more = f"(?:[{kept}][{sign}]*[^{word}]*)*" if kept else ""
    return re.compile((f"[{lone}]|(?=[^{lone}])" if lone else "(?s:(?=.))") + f" *[{sign}]*[^{word}]*{more}")


class _Table:
    """Pieces by the hash of their signs, for many lookups at once."""

    BITS = 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, normal):
        self.words = sorted(normal)
        self.ids = np.array([normal[p][0] for p in self.words] + [-1], np.int32)
        self.weights = np.array([normal[p][1] for p in self.words] + [FEW], np.int32)
        self.longest = min(max(map(len, self.words), default=1), REMEMBERED_LENGTH)
        self.keys = np.zeros(len(self.words) + 1, np.uint64)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by.setdefault(len(w), []).append(k)
        for n, ks in by.items():
            self.keys[ks] = self.prefixes(self.codes([self.words[k] for k in ks], n))[:, n]
        if len(np.unique(self.keys[:-1])) < len(self.words):
            raise ValueError("two pieces have one hash")
        # a slot has a piece, or several that go on to the next table, or none
        self.slots = []
        left = np.arange(len(self.words))
        while len(left):
            at = self.slot(self.keys[left], len(self.slots))
            several = np.bincount(at, minlength=1 << self.BITS) > 1
            t = np.full(1 << self.BITS, len(self.words), np.int32)
            t[at] = left
            t[several] = -1
            self.slots.append(t)
            left = left[several[at]]

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)) >> np.uint64(64 - self.BITS)).view(np.int64)

    @staticmethod
    def codes(parts: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(parts), n)

    def prefixes(self, codes: np.ndarray) -> np.ndarray:
        v = codes.astype(np.uint64) + np.uint64(1)
        v = (v ^ (v << np.uint64(21))) * np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(29)
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for e in range(codes.shape[1]):
            out[:, e + 1] = out[:, e] * self.BASE + v[:, e]
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of the piece with hash ``h`` in the lists, or that after the last."""
        none = len(self.words)
        out = self.slots[0][self.slot(h, 0)]
        for k in range(1, len(self.slots)):
            more = np.flatnonzero(out < 0)
            out[more] = self.slots[k][self.slot(h[more], k)]
        out[self.keys[out] != h] = none
        return out


def _weights(scores: list[float]) -> list[int]:
    """Weights of pieces by their scores: log probabilities as they are; merge
    ranks, which whole numbers of all pieces are, by the law above."""
    if not all(x == int(x) and x <= 0 for x in scores):
        return [round(x * SCALE) for x in scores]
    share = [1 / (RANK_SHIFT - x) for x in scores]
    total = math.fsum(share)
    return [round(math.log(x / total) * SCALE) for x in share]


class _Known:
    """Remembered parts: their best segmentation in flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.parts: list[str] = []
        self.score, self.gap, self.whole = array("q"), array("q"), array("b")
        self.ends, self.ids = array("q", [0]), array("i")
        self.uses = np.zeros(0, np.int64)

    def add(self, parts: list[str], score: np.ndarray, gap: np.ndarray, whole: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """``gap``: to the second best, -1 if there is none; ``ids`` of all parts
        one after the other, ``size`` of each."""
        at = len(self.score)
        self.at.update(zip(parts, range(at, at + len(parts))))
        self.parts += parts
        for column, values, kind in ((self.score, score, np.int64), (self.gap, gap, np.int64), (self.whole, whole, np.int8), (self.ends, self.ends[-1] + np.cumsum(size), np.int64), (self.ids, ids, np.int32)):
            column.frombytes(np.asarray(values, kind).tobytes())

    def count(self, places: np.ndarray) -> None:
        n = np.bincount(places, minlength=len(self.score))
        n[: len(self.uses)] += self.uses
        self.uses = n

    def shed(self) -> None:
        """Forget the parts that came no more than once, or all where most came again."""
        often = np.zeros(len(self.score), bool)
        often[: len(self.uses)] = self.uses > 1
        if 2 * often.sum() > REMEMBERED:
            often[:] = False
        parts = [p for p, keep in zip(self.parts, often.tolist()) if keep]
        score, gap, whole, ends, ids = (np.array(x) for x in (self.score, self.gap, self.whole, self.ends, self.ids))
        size = np.diff(ends)
        self.clear()
        self.add(parts, score[often], gap[often], whole[often], size[often], ids[np.repeat(often, size)])


class PieceModel:
    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        #: Pieces with the space for the word mark, as texts have it here.
        self.pieces = [sp.id_to_piece(i).replace(MARK, " ") for i in range(size)]
        self.bytes_of = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.unknown = sp.unk_id()
        self.skip = {i for i in range(size) if sp.is_control(i) or sp.is_unused(i)}
        scores = {self.pieces[i]: (i, sp.get_score(i)) for i in range(size) if i not in self.skip and i not in self.bytes_of and i != self.unknown}
        #: Of each piece its id and weight.
        self.normal = normal = {p: (i, w) for (p, (i, _)), w in zip(scores.items(), _weights([x for _, x in scores.values()]))}
        self.longest = max(map(len, normal), default=1)
        self.begun = {p[:k] for p in normal for k in range(1, len(p) + 1)}
        self.floor = min((w for w in (x for _, x in normal.values()) if w > -1000 * SCALE), default=0) - int(BYTE_PENALTY * SCALE)
        signs = {c for p in normal for c in p}
        lone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in signs)
        self.split = _splitter(normal, lone)
        self.known = _Known()
        self.lists: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        #: What each piece adds to the UTF-8 text that decoding gives.
        self.plain = pa.array([bytes([self.bytes_of[i]]) if i in self.bytes_of else (" ⁇ " if i == self.unknown else "" if i in self.skip else p).encode() for i, p in enumerate(self.pieces)], pa.binary())
        self.table = _Table(normal)

    def normalise(self, text: str) -> str:
        """A space before the text, and in place of each word mark in it."""
        return " " + text.replace(MARK, " ") if text else ""

    def parts(self, text: str) -> list[str]:
        return self.split.findall(self.normalise(text))

    def lone(self, sign: str) -> tuple[tuple[int, ...], int]:
        """Ids and weight of a sign that no piece is."""
        raw = sign.encode("utf-8", "replace")
        ids = tuple(self.byte_id.get(b, self.unknown) for b in raw) if self.byte_id else (self.unknown,)
        return ids, self.floor * len(ids)

    def forward(self, part: str) -> list[int]:
        """Viterbi: the best score of each prefix."""
        normal, begun, n = self.normal, self.begun, len(part)
        best = [0] + [NONE] * n
        for s in range(n):
            here, e = best[s], s + 1
            if part[s] not in normal:
                best[e] = max(best[e], here + self.lone(part[s])[1])
            while e <= n and (p := part[s:e]) in begun:
                v = normal.get(p)
                if v is not None and here + v[1] > best[e]:
                    best[e] = here + v[1]
                e += 1
        return best

    def search(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations of ``part``: (score, ids), best first; of
        equal ones that with the longest last piece in which they differ, as far
        as the search meets it first.

        Each open path has a completion as good as its bound, so no more than
        the ``n`` best open paths are ever needed: memory is linear in the part,
        and ties cost nothing."""
        best, normal, longest = self.forward(part), self.normal, self.longest
        out: list[tuple[int, tuple[int, ...]]] = []
        # (bound negated, later ones first, position, score of what follows, what follows)
        live: list = [(-best[-1], 0, len(part), 0, None)]
        met = 0
        while live and len(out) < n:
            _, _, at, done, after = live.pop(0)
            if at == 0:
                ids: list[int] = []
                while after:
                    ids += after[0]
                    after = after[1]
                out.append((done, tuple(ids)))
                continue
            most = n - len(out)
            for s in range(at - 1, max(0, at - longest) - 1, -1):
                v = normal.get(part[s:at])
                if v is not None:
                    ids, weight = (v[0],), v[1]
                elif s == at - 1:
                    ids, weight = self.lone(part[s])
                else:
                    continue
                bound = -(best[s] + weight + done)
                if len(live) < most or bound <= live[-1][0]:
                    insort(live, (bound, met := met - 1, s, done + weight, (ids, after)))
                    del live[most:]
        return out

    def leads(self, parts: list[str], cells: int = 1_000_000) -> None:
        """Remember many parts: the forward and backward Viterbi passes of all
        parts of one length at once.  The second best path is the best one
        through an edge that the best path hasn't."""
        by: dict[int, list[str]] = {}
        for p in parts:
            by.setdefault(len(p) if len(p) <= REMEMBERED_LENGTH else 0, []).append(p)
        for p in by.pop(0, []):
            self._lead(p)
        for n, group in by.items():
            # a cell for each part, start and length: so many at a time
            block = max(64, cells // (n * min(n, self.table.longest)))
            for i in range(0, len(group), block):
                self._leads(group[i : i + block], n)

    def _lead(self, part: str) -> None:
        found = self.search(part, 2)
        score, ids = found[0]
        self.known.add([part], [score], [score - found[1][0] if len(found) > 1 else -1], [self._joined(ids) == part], [len(ids)], ids)

    def _leads(self, parts: list[str], n: int) -> None:
        t, w = self.table, len(parts)
        codes = t.codes(parts, n)
        prefix = t.prefixes(codes)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(n):
                power.append(power[-1] * t.BASE)
            place = {}
            for s in range(n):
                for e in range(s + 1, min(n, s + t.longest) + 1):
                    place[s, e] = t.find(prefix[:, e] - prefix[:, s] * power[e - s])
        score = {k: t.weights[v] for k, v in place.items()}
        lone = np.zeros(w, bool)
        for s in range(n):
            lone |= score[s, s + 1] == FEW
        if lone.any():  # signs that no piece is: few parts have any
            for k in np.flatnonzero(lone):
                self._lead(parts[k])
            if lone.all():
                return
        fwd, back = np.full((n + 1, w), FEW, np.int32), np.zeros((n + 1, w), np.int8)
        fwd[0] = 0
        for e in range(1, n + 1):
            for s in range(max(0, e - t.longest), e):
                c = np.maximum(fwd[s] + score[s, e], FEW)
                np.copyto(back[e], e - s, where=c > fwd[e])
                np.maximum(fwd[e], c, out=fwd[e])
        bwd = np.full((n + 1, w), FEW, np.int32)
        bwd[n] = 0
        for s in range(n - 1, -1, -1):
            for e in range(s + 1, min(n, s + t.longest) + 1):
                np.maximum(bwd[s], bwd[e] + score[s, e], out=bwd[s])
        rows = np.arange(w)
        at, chosen = np.where(lone, 0, n), np.zeros((n, w), np.int8)
        live = at > 0
        while live.any():
            size = back[at[live], rows[live]]
            chosen[at[live] - size, rows[live]] = size
            at[live] -= size
            live = at > 0
        second = np.full(w, FEW, np.int32)
        for (s, e), sc in score.items():
            through = np.maximum(fwd[s] + sc, FEW) + bwd[e]
            through[chosen[s] == e - s] = FEW
            np.maximum(second, through, out=second)
        ids = np.full((w, n), -1, np.int32)
        for (s, e), v in place.items():
            hit = np.flatnonzero(chosen[s] == e - s)
            ids[hit, s] = t.ids[v[hit]]
        gap = np.where(second > FEW >> 1, fwd[n] - second, np.int32(-1))
        keep = ~lone
        if lone.any():
            parts, ids = [p for p, k in zip(parts, keep.tolist()) if k], ids[keep]
        size = (ids >= 0).sum(1)
        self.known.add(parts, fwd[n][keep], gap[keep], np.ones(len(parts)), size, ids[ids >= 0])

    def remember(self, parts: set[str]) -> None:
        """Make all of ``parts`` known."""
        new = parts - self.known.at.keys()
        if len(new) + len(self.known.at) > REMEMBERED:
            self.known.shed()
            new = parts - self.known.at.keys()
        self.leads(list(new))

    def forget(self) -> None:
        self.known.clear()
        self.lists.clear()

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a whole text: (score, ids)."""
        parts = self.parts(text)
        lists = [self.search(p, n) for p in parts]
        base = sum(x[0][0] for x in lists)
        out = []
        for cost, picks in _combine([[x[0][0] - s for s, _ in x] for x in lists], n):
            ids = [i for k, x in enumerate(lists) for i in x[picks.get(k, 0)][1]]
            out.append(((base - cost) / SCALE, ids))
        return out

    def choices(self, part: str, n: int) -> list[tuple[int, bytes]]:
        """Distance to the best and ids (as int32 bytes) of the ``n`` best of a part."""
        got = self.lists.get((part, n))
        if got is None:
            found = self.search(part, n)
            got = [(found[0][0] - s, array("i", ids).tobytes()) for s, ids in found]
            if len(part) <= REMEMBERED_LENGTH:
                if len(self.lists) >= REMEMBERED // 16:
                    self.lists.clear()
                self.lists[part, n] = got
        return got

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' parts among the known ones, until the next call;
        where each text's begin and end."""
        parts = [self.parts(t) for t in texts]
        self.remember(set().union(*parts))
        cut = np.cumsum([0, *map(len, parts)])
        at = np.fromiter(map(self.known.at.__getitem__, chain.from_iterable(parts)), np.int64, int(cut[-1]))
        self.known.count(at)
        return at, cut

    def segment(self, at: np.ndarray, cut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, bytes]]], np.ndarray]:
        """Of each text: the ids of its best segmentation (all in one array, with
        the ends), score and ids of the second and further ones, and the best score.

        Only the n - 1 parts whose second choice is nearest can differ from the
        best in the further ones: a path with another part's further choice has
        n - 1 single changes and the best itself before it."""
        known = self.known
        ends = np.frombuffer(known.ends, np.int64)
        start, size = ends[at], ends[at + 1] - ends[at]
        stop = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(known.ids, np.int32)[np.repeat(start - stop[:-1], size) + np.arange(stop[-1])] if len(at) else np.zeros(0, np.int32)
        score = np.concatenate([[0], np.cumsum(np.frombuffer(known.score, np.int64)[at])])[cut] if len(at) else np.zeros(len(cut), np.int64)
        gap = np.frombuffer(known.gap, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        del ends
        gap = np.where(gap < 0, -NONE, gap)
        more = []
        raw = flat.tobytes()
        for k, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            more.append(self._further(at[a:b], gap[a:b], stop[a : b + 1], raw, int(score[k + 1] - score[k]), n))
        return flat, stop[cut], more, np.diff(score)

    def _further(self, places: np.ndarray, gap: np.ndarray, stop: np.ndarray, raw: bytes, total: int, n: int) -> list[tuple[int, bytes]]:
        if n < 2 or not len(gap):
            return []
        if len(gap) >= n:
            kth = np.partition(gap, n - 2)[n - 2]
            near = np.concatenate([np.flatnonzero(gap < kth), np.flatnonzero(gap == kth)])[: n - 1]
        else:
            near = np.arange(len(gap))
        near = [int(k) for k in near if gap[k] < -NONE]
        lists = [self.choices(self.known.parts[places[k]], n) for k in near]
        out, end = [], 4 * int(stop[-1])
        for cost, picks in _combine([[c for c, _ in x] for x in lists], n)[1:]:
            ids, at = [], 4 * int(stop[0])
            for j in sorted(picks, key=lambda j: near[j]):
                ids += [raw[at : 4 * int(stop[near[j]])], lists[j][picks[j]][1]]
                at = 4 * int(stop[near[j] + 1])
            out.append((total - cost, b"".join([*ids, raw[at:end]])))
        return out

    def _joined(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.skip:
                out.append(self.pieces[i])
        return "".join(out) + raw.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """The text of a list of ids."""
        return self._joined(ids).removeprefix(" ")

    def decode_many(self, lists: pa.ListArray) -> list[str]:
        """The texts of many lists of ids."""
        signs = pa.ListArray.from_arrays(lists.offsets, self.plain.take(lists.values))
        return [s.decode("utf-8", "replace").removeprefix(" ") for s in pc.binary_join(signs, b"").to_pylist()]


def _combine(costs: list[list[int]], n: int) -> list[tuple[int, dict[int, int]]]:
    """The ``n`` cheapest ways to take one entry of each list (each sorted, its
    first entry 0): (cost, entries other than the first by list)."""
    order = sorted((k for k, c in enumerate(costs) if len(c) > 1), key=lambda k: (costs[k][1], k))
    out = [(0, {})]
    heap: list = []
    seen = 0
    if order:
        heap.append((costs[order[0]][1], seen, 0, {order[0]: 1}))
    while heap and len(out) < n:
        cost, _, at, picks = heapq.heappop(heap)
        out.append((cost, picks))
        k = order[at]
        if picks[k] + 1 < len(costs[k]):
            heapq.heappush(heap, (cost - costs[k][picks[k]] + costs[k][picks[k] + 1], seen := seen + 1, at, picks | {k: picks[k] + 1}))
        if at + 1 < len(order):
            nxt = order[at + 1]
            heapq.heappush(heap, (cost + costs[nxt][1], seen := seen + 1, at + 1, picks | {nxt: 1}))
            if picks[k] == 1:
                rest = {a: b for a, b in picks.items() if a != k}
                heapq.heappush(heap, (cost - costs[k][1] + costs[nxt][1], seen := seen + 1, at + 1, rest | {nxt: 1}))
    return out


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _lists(values: np.ndarray | bytes, ends: np.ndarray) -> pa.ListArray:
    """Lists of int32 from their flat values and ends."""
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _rows(m: PieceModel, keys: pa.Array, texts: list[str], at: np.ndarray, cut: np.ndarray, n: int) -> pa.RecordBatch:
    flat, ends, more, score = m.segment(at, cut, n)
    raws = [ids for x in more for _, ids in x]
    ids, others = _lists(flat, ends), _lists(b"".join(raws), np.cumsum([0, *map(len, raws)]) // 4)
    same = [a == s for a, s in zip(m.decode_many(ids), texts)]
    again = iter(m.decode_many(others))
    for k, x in enumerate(more):
        for _ in x:
            same[k] = (next(again) == texts[k]) and same[k]
    score = (score / SCALE).tolist()
    return pa.RecordBatch.from_arrays(
        [
            keys, pa.array(np.diff(ends), pa.int64()), pa.array(score, pa.float64()), pa.array([[a, *(s / SCALE for s, _ in x)] for a, x in zip(score, more)], pa.list_(pa.float64())),
            ids, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, more)]), pa.int32()), others), pa.array(same, pa.bool_()),
        ],
        ["key", "n_pieces", "score", "scores", "ids", "more_ids", "round_trip"],
    )


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list where the sum of a group's sizes has reached ``most``."""
    first, total = 0, 0
    for k, n in enumerate(sizes, 1):
        total += n
        if total >= most or k == len(sizes):
            yield first, k
            first, total = k, 0


def _segment(path: str, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model_of(path)
    for batch in batches:
        keys, column = batch.column("key"), batch.column("text")
        for a, b in _groups(pc.binary_length(column).to_pylist(), TOGETHER):
            texts = column.slice(a, b - a).to_pylist()
            at, cut = m.places(texts)
            for i, j in _groups((4 * n * np.diff(cut)).tolist(), HANDED_ON):
                yield _rows(m, keys.slice(a + i, j - i), texts[i:j], at[cut[i] : cut[j]], cut[i : j + 1] - cut[i], n)
            del texts, at, cut
        del batch, keys, column
        trim_memory()
    m.forget()  # the next stage may run in this worker
    trim_memory()


def segment(docs: DataFrame, model_path: str, n: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, ``n_pieces`` and ``score`` of the best
    segmentation, ``scores`` of the ``n`` best (fewer where the lattice has
    fewer paths), ``ids`` of the best one, ``more_ids`` of the second and
    further ones in the order of their scores, and ``round_trip``, whether each
    list, decoded, equals the text (it can't where a text itself holds the word
    mark).

    A null or empty text has no pieces, score 0 and the one score 0; repeated
    rows stay repeated, a null key stays null.  Whole texts, no shuffle, time and
    memory linear in a text, one without spaces included; a worker remembers at
    most ``REMEMBERED`` short parts besides those of the texts at hand.  Of
    segmentations with equal scores the one that changes an earlier part goes
    first, and within a part the order is that of :meth:`PieceModel.search`.
    """
    return (
        docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
        .mapInArrow(
            lambda it, p=model_path, n=n: _segment(p, n, it),
            "key long, n_pieces long, score double, scores array<double>, ids array<int>, more_ids array<array<int>>, round_trip boolean",
        )
        .withColumnRenamed("key", key)
    )


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model_of(path)
    for batch in batches:
        texts = [m.decode(x or []) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts)], ["key", "text"])


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the text of ``ids``; a null list gives the empty text."""
    return (
        encoded.select(F.col(key).cast("long").alias("key"), "ids")
        .mapInArrow(lambda it, p=model_path: _decode(p, it), "key long, text string")
        .withColumnRenamed("key", key)
    )
