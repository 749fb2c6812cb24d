"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model compiles into three machines.  The normaliser reads characters and writes characters: the dummy prefix, white
space as its mark.  The pieces' machine reads characters and writes pieces; its states are the beginnings of pieces, and a
character that is no piece has an arc that writes its bytes' pieces.  The third machine reads pieces and gives weights of
the tropical semiring: for a unigram model the negated scores; for a BPE model 0 where merging the text of two
neighbouring pieces by the model's ranks gives back just these two, infinite elsewhere.  The composition of the three with
an input is expanded as far as the search for its shortest path goes.

At a gap between words, and around a line feed that no piece holds, every path of the composed machine is in the same
state, so an input falls apart there into segments, and the path of a distinct segment is searched once for a batch.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .kernels import chunks, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: bytes of the memo of segments and number of pairs in that of pairs before they start anew; longest segment in the memo
CACHE, PAIRS, LONGEST = 16 << 20, 250_000, 64
#: bytes of texts that are encoded together, and segments that are searched together
LOT, FREE = 1 << 20, 1 << 14
BEGIN, TEXT, GAP = range(3)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return n, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        elif kind == 2:
            size, i = number(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Normaliser:
    """A transducer of characters, its arcs by (state, whether the character is a space): (what it writes, next state).

    What is written holds the character itself where it says None.
    """

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        space = MARK if escape else " "
        first = [space, None] if prefix else [None]
        self.arcs = {(BEGIN, False): (first, TEXT), (TEXT, False): ([None], TEXT)}
        if squeeze:  # spaces at both ends go, runs of them become one, which is written when a character follows
            self.arcs |= {(BEGIN, True): ([], BEGIN), (TEXT, True): ([], GAP), (GAP, True): ([], GAP), (GAP, False): ([space, None], TEXT)}
        else:
            self.arcs |= {(BEGIN, True): ([*first[:-1], space], TEXT), (TEXT, True): ([space], TEXT)}

    def __call__(self, text: str) -> str:
        out, state = [], BEGIN
        for c in text:
            written, state = self.arcs[state, c == " "]
            out += [c if w is None else w for w in written]
        return "".join(out)


class Merges:
    """The weights of neighbouring pieces in a BPE model."""

    def __init__(self, text: list[str], rank: dict[str, float]):
        self.text, self.rank = text, rank
        self.last: dict[str, tuple[str, str]] = {}
        self.memo: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """A text's pieces by the definition of BPE: the best-ranked pair is merged first, the leftmost of equals."""
        parts, rank, pair = list(text), self.rank.get, None
        while True:
            best, at = np.inf, -1
            for i in range(len(parts) - 1):
                found = rank(parts[i] + parts[i + 1])
                if found is not None and found < best:
                    best, at = found, i
            if at < 0:
                if pair and len(parts) == 1:
                    self.last[text] = pair
                return parts
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(pair)]

    def meet(self, left: int, right: int) -> bool:
        """Whether merging two pieces' text leaves both as they are.

        Their merges are undone from the last one back.  Two parts that stood side by side until one of them was merged
        would have merged with each other if their rank comes first; of equal ranks, the leftmost does.
        """
        a, b, rank, last = self.text[left], self.text[right], self.rank, self.last
        until, on_left, ok = np.inf, True, True
        while True:
            r = rank.get(a + b)
            if r is not None and (r < until or r == until and not on_left):
                ok = False
                break
            ra, rb = rank[a] if a in last else -np.inf, rank[b] if b in last else -np.inf
            if ra == rb == -np.inf:
                break
            # the later of the two; of equals the one on the right, since the left one was merged before it
            if ra > rb:
                until, on_left, a = ra, True, last[a][1]
            else:
                until, on_left, b = rb, False, last[b][0]
        return ok

    def meet_again(self, left: int, right: int) -> bool:
        """``meet``, remembered."""
        key = left << 32 | right
        ok = self.memo.get(key)
        if ok is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            ok = self.memo[key] = self.meet(left, right)
        return ok


class Machine:
    """A compiled model; ``encode`` gives int32 ids packed as bytes, ``decode`` takes ids."""

    def __init__(self, model: bytes):
        pieces, kind, norm = [], UNIGRAM, {}
        for n, value in _fields(model):
            if n == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif n == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif n == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise NotImplementedError("a model whose normaliser has a character map")
        if kind not in (UNIGRAM, BPE):
            raise NotImplementedError("a model that is neither unigram nor BPE")
        if any(k == USER for _, _, k in pieces):
            raise NotImplementedError("a model with user-defined pieces")
        self.prefix, self.squeeze, escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.normal = Normaliser(self.prefix, self.squeeze, escape)
        self.bpe = kind == BPE
        self.rank = {p: -s for p, s, k in pieces if k == NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.worst = max(self.rank.values(), default=0.0) + 10
        self.merges = Merges([p for p, _, _ in pieces], self.rank)
        self.forget()
        if self.bpe:  # pieces that merging can't reach are on no path
            self.id = {p: i for p, i in self.id.items() if len(p) == 1 or self.merges.merged(p) == [p]}
        self.compile()
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
               for p, _, k in pieces]
        self.raw, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        # no piece goes from another character into a mark: paths meet at gaps; nor over a line feed, if no piece holds one
        self.gaps = all(MARK not in p.lstrip(MARK) for p in self.id) and escape
        self.feeds = not any("\n" in p for p in self.id)
        feed = "\n" if self.feeds else ""
        self.cut = re.compile(f"{MARK}*[^{MARK}{feed}]+|{MARK}+" + "|\n" * self.feeds if self.gaps else r"[\s\S]+")

    def compile(self) -> None:
        """The pieces' states: what begins a piece, as a table of the next states; "" has a whole piece's id and weight."""
        self.begin: dict = {}
        for p, i in self.id.items():
            state = self.begin
            for c in p:
                state = state.setdefault(c, {})
            state[""] = (i, self.rank[p])

        # the same states by bytes, a space for the mark, for many segments at a time: arcs as sorted (state, byte) numbers
        arcs: dict[int, int] = {}
        piece = [-1]
        for p, i in self.id.items():
            state = 0
            for c in p.replace(MARK, " ").encode():
                key = state << 8 | c
                if (to := arcs.get(key)) is None:
                    to = arcs[key] = len(piece)
                    piece.append(-1)
                state = to
            piece[state] = i
        self.arc = np.sort(np.fromiter(arcs, np.int64, len(arcs)))
        self.to = np.fromiter((arcs[k] for k in self.arc.tolist()), np.int32, len(arcs))
        self.piece = np.array(piece, np.int32)
        self.pair_keys, self.pair_ok, self.pairs = np.zeros(0, np.int64), np.zeros(0, bool), {}

    def forget(self) -> None:
        """Segments seen so far; workers live on after a task and share an executor's memory with others."""
        none = np.zeros(0, np.int64)
        self.memo = none.astype(np.uint64), none, none.astype(np.int32), none.astype(np.int32)

    def _fallback(self, char: str) -> list[int]:
        found = [self.byte.get(b) for b in char.encode("utf-8", "replace")]
        return [self.unknown] if None in found else found

    def path(self, text: str) -> list[int]:
        """The ids on the shortest path through the composition of a normal text, the pieces and the weights."""
        chain = self._free(text) if self.bpe else self._weighted(text)
        out: list[int] = []
        while chain:
            chain, piece = chain
            if isinstance(piece, str):
                out += reversed(self._fallback(piece))
            else:
                out.append(piece)
        out.reverse()
        return out

    def _free(self, text: str):
        """Weights of 0 or infinite: the paths of weight 0 are followed furthest piece first; states are places with a last piece."""
        n, begin, meet = len(text), self.begin, self.merges.meet_again
        stack, seen = [(0, -1, None)], set()
        while stack:
            i, last, chain = stack.pop()
            if i == n:
                return chain
            if last >= 0:
                key = i << 32 | last
                if key in seen:
                    continue
                seen.add(key)
            state, known = begin, False
            for j in range(i, n):
                state = state.get(text[j])
                if state is None:
                    break
                found = state.get("")
                if found is not None:
                    piece = found[0]
                    known = known or i == j
                    if last >= 0 and not meet(last, piece):
                        continue
                    stack.append((j + 1, piece, (chain, piece)))
            if not known:
                stack.append((i + 1, -1, (chain, text[i])))
        raise ValueError(f"no path for {text!r}")

    def _meets(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may follow each other."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        known = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(len(key), bool)
        out = np.zeros(len(key), bool)
        out[known] = self.pair_ok[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            new, back = np.unique(key[rest], return_inverse=True)
            get, meet = self.pairs.get, self.merges.meet
            found = [get(k) for k in new.tolist()]
            for n, k in enumerate(new.tolist()):
                if found[n] is None:
                    found[n] = self.pairs[k] = meet(k >> 32, k & 0xFFFFFFFF)
            out[rest] = np.array(found, bool)[back]
        return out

    def _remember_pairs(self) -> None:
        if len(self.pair_keys) + len(self.pairs) > PAIRS:
            self.pair_keys, self.pair_ok, self.pairs = np.zeros(0, np.int64), np.zeros(0, bool), {}
        elif len(self.pairs) > 4096 + len(self.pair_keys) // 16:
            keys = np.concatenate([self.pair_keys, np.fromiter(self.pairs, np.int64, len(self.pairs))])
            ok = np.concatenate([self.pair_ok, np.fromiter(self.pairs.values(), bool, len(self.pairs))])
            order = np.argsort(keys)
            self.pair_keys, self.pair_ok, self.pairs = keys[order], ok[order], {}

    def _free_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """``_free`` for many segments of at most ``LONGEST`` bytes, each a step further in a round: ids, -1 after the last,
        and which segments came to an end.  Those with a character that is no piece don't."""
        n, length = len(start), end - start
        text = np.zeros((n, LONGEST), np.uint8)
        text[np.repeat(np.arange(n), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = data[
            np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        ]
        out = np.full((n, LONGEST), -1, np.int32)
        places = np.zeros((n, LONGEST + 1), np.int16)  # where each piece of a path begins
        depth, limit, done = np.zeros(n, np.int64), np.full(n, LONGEST + 1), np.zeros(n, bool)
        live = np.arange(n)
        for _ in range(rounds):
            if len(live) == 0:
                break
            place = places[live, depth[live]].astype(np.int64)
            # the longest piece from here that is shorter than the limit
            best, size = np.full(len(live), -1, np.int32), np.zeros(len(live), np.int64)
            walking, state = np.arange(len(live)), np.zeros(len(live), np.int64)
            for step in range(1, LONGEST + 1):
                ahead = (place[walking] + step <= length[live[walking]]) & (step < limit[live[walking]])
                walking, state = walking[ahead], state[ahead]
                if len(walking) == 0:
                    break
                key = state << 8 | text[live[walking], place[walking] + step - 1]
                at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                there = self.arc[at] == key
                walking, state = walking[there], self.to[at[there]].astype(np.int64)
                found = self.piece[state]
                whole = found >= 0
                best[walking[whole]], size[walking[whole]] = found[whole], step
            some = np.flatnonzero(best >= 0)
            before = depth[live[some]] - 1
            ok = before < 0
            old = np.flatnonzero(~ok)
            ok[old] = self._meets(out[live[some[old]], before[old]], best[some[old]])
            limit[live[some[~ok]]] = size[some[~ok]]  # the next shorter one in the next round
            go = some[ok]
            w = live[go]
            out[w, depth[w]] = best[go]
            depth[w] += 1
            places[w, depth[w]] = place[go] + size[go]
            limit[w] = LONGEST + 1
            ended = np.zeros(len(live), bool)
            ended[go] = place[go] + size[go] == length[w]
            done[live[ended]] = True
            # none is left: the piece before gets shorter; a place that no piece at all leaves ends the search
            none = np.flatnonzero(best < 0)
            stuck = (limit[live[none]] > LONGEST) | (depth[live[none]] == 0)
            ended[none[stuck]] = True
            w = live[none[~stuck]]
            depth[w] -= 1
            limit[w] = places[w, depth[w] + 1] - places[w, depth[w]]
            out[w, depth[w]] = -1
            live = live[~ended]
        return out, done

    def _weighted(self, text: str):
        """Any weights: places are in order, so each is left by its least total."""
        n, begin = len(text), self.begin
        cost, chains = [0.0] + [np.inf] * n, [None] * (n + 1)
        for i in range(n):
            here, chain, state, known = cost[i], chains[i], begin, False
            chains[i] = None
            for j in range(i, n):
                state = state.get(text[j])
                if state is None:
                    break
                found = state.get("")
                if found is not None:
                    known = known or i == j
                    if here + found[1] < cost[j + 1]:
                        cost[j + 1], chains[j + 1] = here + found[1], (chain, found[0])
            if not known and here + self.worst < cost[i + 1]:
                cost[i + 1], chains[i + 1] = here + self.worst, (chain, text[i])
        return chains[n]

    def encode(self, text: str) -> bytes:
        return np.array([i for part in self.cut.findall(self.normal(text)) for i in self.path(part)], np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        out = self._raw(ids, size).tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out

    def _raw(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.raw[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin, and whether decoding gives the text back."""
        n, mark = len(offsets) - 1, np.frombuffer(MARK.encode(), np.uint8)
        if not self.gaps or self.squeeze or self._holds(data, mark):
            return self._each(data, offsets)
        some = np.diff(offsets) > 0
        if self.prefix:  # the arc that leaves the normaliser's first state
            data, offsets = np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.ones(n, bool)
        space = data == 32
        new = np.empty(len(data), bool)
        new[0], new[1:] = True, space[1:] & ~space[:-1]
        if self.feeds:
            feed = data == 10
            new |= feed
            new[1:] |= feed[:-1]
        new[offsets[:-1][some]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))
        _, at, inverse = np.unique(slices(data, start, end), return_index=True, return_inverse=True)
        a, b = start[at], end[at]
        ids, count = self._paths(data, a, b)
        # whether a segment's pieces are its bytes
        size = np.add.reduceat(np.append(self.size[ids], 0), np.cumsum(count) - count)
        same = size == b - a
        whole = np.repeat(same, count)
        mine, length = ids[whole], (b - a)[same]
        at_data = np.repeat(a[same] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        differ = self._raw(mine, self.size[mine]) != data[at_data]
        if differ.any():
            same[np.flatnonzero(same)[np.repeat(np.arange(len(length)), length)[differ]]] = False
        begin, many = (np.cumsum(count) - count)[inverse], count[inverse]
        out = ids[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        first = np.searchsorted(start, offsets)
        wrong = np.concatenate([[0], np.cumsum(~same[inverse])])
        return out, np.concatenate([[0], np.cumsum(many)])[first], wrong[first[1:]] == wrong[first[:-1]]

    @staticmethod
    def _holds(data: np.ndarray, part: np.ndarray) -> bool:
        return len(data) >= len(part) and bool(np.logical_and.reduce([data[i : len(data) - len(part) + 1 + i] == c for i, c in enumerate(part)]).any())

    def _paths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct segments, one segment after the other, and how many each has."""
        order = np.argsort(start)
        hashes = np.empty(len(start), np.uint64)
        hashes[order] = slices(data, start[order], end[order])
        keys, begins, counts, held = self.memo
        at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
        known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        short = new[end[new] - start[new] <= LONGEST] if self.bpe else new[:0]
        rows, sizes, parts, done = [], [], [held], np.zeros(len(start), bool)
        for first in range(0, len(short), FREE):
            some = short[first : first + FREE]
            ids, ended = self._free_many(data, start[some], end[some])
            some, ids = some[ended], ids[ended]
            done[some] = True
            rows.append(some)
            sizes.append((ids >= 0).sum(1))
            parts.append(ids[ids >= 0])
        self._remember_pairs()
        rest = new[~done[new]]
        found = [np.array(self.path(data[start[k] : end[k]].tobytes().decode().replace(" ", MARK)), np.int32) for k in rest.tolist()]
        rows = np.concatenate([*rows, rest])
        sizes = np.concatenate([*sizes, np.array([len(f) for f in found], np.int64)])
        ids = np.concatenate([*parts, *found])
        at_ids = len(held) + np.cumsum(sizes) - sizes
        begin, many = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        begin[known], many[known] = begins[at[known]], counts[at[known]]
        begin[rows], many[rows] = at_ids, sizes
        keep = end[rows] - start[rows] <= LONGEST
        self._remember(hashes[rows[keep]], begin[rows[keep]], many[rows[keep]], ids)
        return ids[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())], many

    def _remember(self, hashes: np.ndarray, begin: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
        """Short segments whose ids stand at ``begin`` in ``ids``, which begins with the ids remembered so far."""
        keys, begins, counts, held = self.memo
        if 20 * (len(keys) + len(hashes)) + 4 * (len(held) + int(many.sum())) > CACHE:
            self.forget()
            keys, begins, counts, held = self.memo
        ids = np.concatenate([held, ids[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]])
        keys = np.concatenate([keys, hashes])
        begins = np.concatenate([begins, len(held) + np.cumsum(many) - many])
        order = np.argsort(keys)
        self.memo = keys[order], begins[order], np.concatenate([counts, many.astype(np.int32)])[order], ids

    def _each(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One text after the other, by the normaliser's arcs."""
        whole, found, same = data.tobytes(), [], []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = whole[i:j]
            found.append(self.encode(text.decode()))
            same.append(self.decode(np.frombuffer(found[-1], np.int32)) == (re.sub(b" +", b" ", text.strip(b" ")) if self.squeeze else text))
        return np.frombuffer(b"".join(found), np.int32), np.cumsum([0, *(len(f) // 4 for f in found)]), np.array(same, bool)


@lru_cache(maxsize=2)
def machine(name: str) -> Machine:
    """The compiled model that Spark has brought to this executor."""
    with open(SparkFiles.get(name), "rb") as f:
        return Machine(f.read())


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(name)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1), LOT):
                ids, ends, same = m.encode_all(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(same)],
                    ["doc_id", "n_tokens", "tokens", "round_trip"],
                )
        m.forget()

    return run


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(name)
        for batch in batches:
            ids = [np.array(x if x is not None else [], np.int64) for x in batch.column(1).to_pylist()]
            texts = [m.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _bring(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens array<int>, round_trip) for each row of ``docs``.

    ``model`` is the path of a SentencePiece model.  A null or empty text has no tokens.  Whole texts are encoded, in
    time that grows with their length also where they have no gaps; what a worker remembers is bounded in bytes.
    Repeated rows and rows without an id are encoded like any other, an empty table gives an empty result, and other
    columns are not carried, so names cannot clash.  Of paths of equal weight the one with the longest first pieces is
    taken.  ``round_trip``: decoding the tokens gives back the text.
    """
    name = _bring(docs.sparkSession, model or model_path())
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _encode(name), "doc_id long, n_tokens long, tokens array<int>, round_trip boolean"
    )


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens); null tokens give an empty text."""
    name = _bring(tokens.sparkSession, model or model_path())
    return tokens.select("doc_id", "tokens").mapInArrow(_decode(name), "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
