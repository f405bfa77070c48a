"""SentencePiece encoding and decoding by a streaming Viterbi trellis.

The trellis has a state for each boundary in the last ``longest piece``
characters; a state holds the best sum of piece scores that reaches it, the
last piece and a pointer back.  Text is pushed in parts of any size; whenever
the pointers of all states that can still be extended lead back to one
boundary, the ids up to it are final, are handed out and forgotten, so memory
is bounded by the window and not by the text (``Encoder``).

All paths also meet before a space mark, if no piece holds one after another
character.  ``Lanes`` runs the same trellis for all distinct runs between such
boundaries in a slice of texts at once, a character of each at a time, as array
operations; runs that are longer than nearly all others are streamed.

Which steps the trellis has depends on the kind of model.  In a unigram model
any piece may follow any other.  A BPE model (the public vocabulary file is
one) is defined by merging and not by its sums, so there a step from piece a to
piece b is admitted exactly if merging their joint text gives a, b; the paths
of such steps are what merging the whole text gives, and one is left for each
boundary, so that the ids are the library's.  Characters outside the vocabulary
are byte pieces, with the library's penalty.

Normalisation: none but a space before the text and "▁" for spaces (the
file's own settings); ``decode`` undoes both, so a round trip is exact.

Cases: a null or empty text has no ids and decodes to the empty text; null and
repeated ids and other columns do not matter; a very long text comes alone in
its slice.  A text that holds the mark "▁" itself decodes to a space
there, as in the library; ``round_trip`` says so.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.common import map_texts, texts

SPACE = "▁"
#: texts whose runs are traced together
SLICE = 2000
SCHEMA = "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean"


class Vocabulary:
    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.ids, self.scores, self.bytes, self.raw = kind, {}, {}, {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.byte_ids = frozenset(self.bytes.values())
        self.longest = max(map(len, self.ids), default=1)
        #: no piece holds a space mark after another character, so all paths meet before a word
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: the score of a character outside the vocabulary
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.pairs: dict[tuple[str, str], bool] = {}

    def follows(self, a: str, b: str) -> bool:
        """Whether a, b are the pieces that merging the text a + b ends in."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def merged(self, text: str) -> list[str]:
        """Join the neighbours of the highest score, leftmost first, until no two form a piece."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Push text, get final ids; ``finish`` gives the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text, self.base = "", 0  # what is not final yet, and how much was
        self.states: list[tuple | None] = [(0.0, "", 0)]  # by boundary from base: score, last piece, start of it
        self.last = ""  # the piece before base

    def push(self, more: str) -> list[int]:
        self.text += more
        v, text, states = self.v, self.text, self.states
        for end in range(len(states), len(text) + 1):
            best = None
            for start in range(max(0, end - v.longest), end):
                state = states[start]
                piece = text[start:end]
                score = v.scores.get(piece)
                if state is None or score is None:
                    continue
                before = state[1] if start else self.last
                if v.kind == "bpe" and before in v.ids and not v.follows(before, piece):
                    continue
                if best is None or state[0] + score > best[0]:
                    best = (state[0] + score, piece, start)
            if text[end - 1] not in v.ids and states[end - 1] is not None and (best is None or states[end - 1][0] + v.unknown > best[0]):
                best = (states[end - 1][0] + v.unknown, text[end - 1], end - 1)
            states.append(best)
        return self._settle(False)

    def _settle(self, final: bool) -> list[int]:
        states, n = self.states, len(self.text)
        open_ = {n} if final else {k for k in range(max(0, n - self.v.longest + 1), n + 1) if states[k] is not None}
        while len(open_) > 1:  # step the furthest pointer back until all are one
            k = max(open_)
            open_.remove(k)
            open_.add(states[k][2])
        (common,) = open_
        ids: list[int] = []
        k, pieces = common, []
        while k:
            pieces.append(states[k][1])
            k = states[k][2]
        for p in reversed(pieces):
            i = self.v.ids.get(p)
            ids.extend([i] if i is not None else [self.v.bytes[b] for b in p.encode()])
        if common:
            self.last = pieces[0]
            self.text, self.base = self.text[common:], self.base + common
            self.states = [s and (s[0], s[1], s[2] - common) for s in states[common:]]
            self.states[0] = (0.0, self.last, 0)
        return ids

    def finish(self) -> list[int]:
        return self._settle(True)


class Lanes:
    """The trellis over many short runs at once.

    Runs are sorted by length, the longest first, and stored row by row: row r
    has the r-th characters of all runs that are so long.  A boundary's number is
    that of the character before it plus the number of runs.
    """

    #: slots of the table of known pairs of pieces, in each of two ways
    SLOTS = 1 << 20

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        many = sorted({c for p in v.ids if len(p) > 1 for c in p})
        self.klass = np.zeros(0x110000, np.uint16)  # characters of longer pieces; the others are met one by one
        self.klass[[ord(c) for c in many]] = np.arange(1, len(many) + 1)
        klass = {c: k + 1 for k, c in enumerate(many)}
        nodes: dict[str, int] = {"": 0}
        for p in v.ids:
            if len(p) > 1:
                for k in range(1, len(p) + 1):
                    nodes.setdefault(p[:k], len(nodes))
        self.next = np.zeros((len(nodes), len(many) + 1), np.int32)  # 0: no such child
        self.piece = np.full(len(nodes), -1, np.int32)
        for p, n in nodes.items():
            if p:
                self.next[nodes[p[:-1]], klass[p[-1]]] = n
                if len(p) > 1:
                    self.piece[n] = v.ids.get(p, -1)
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in v.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.names = {i: p for p, i in v.ids.items()}
        self.scores = np.full(max(len(v.raw), 1), v.unknown)
        for p, i in v.ids.items():
            self.scores[i] = v.scores[p]
        self.pairs = np.full((2, self.SLOTS), -1, np.int64)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.scores) + b
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (self.SLOTS - 1)
        got = self.pairs[0, slot]
        other = np.flatnonzero(got >> 1 != key)
        got[other] = self.pairs[1, slot[other]]
        other = other[got[other] >> 1 != key[other]]
        if len(other):
            new, at, back = np.unique(key[other], return_index=True, return_inverse=True)
            ok = np.fromiter((self.v.merged(x + y) == [x, y] for x, y in ((self.names[k // len(self.scores)], self.names[k % len(self.scores)]) for k in new.tolist())), np.int64, len(new))
            got[other] = ok[back]
            here = slot[other][at]
            way = (self.pairs[0, here] >= 0).astype(np.int64)
            self.pairs[way, here] = new * 2 + ok
        return (got & 1).astype(bool)

    def __call__(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all (not empty) runs, and the number of each run."""
        n = len(runs)
        lengths = np.fromiter(map(len, runs), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        chars = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4")
        first = (np.cumsum(lengths) - lengths)[order]
        most = int(sizes[0]) if n else 0
        width = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")  # runs with a character in row r
        row0 = np.concatenate([[0], np.cumsum(width)])
        lane = np.concatenate([np.arange(w) for w in width]) if most else np.zeros(0, np.int64)
        row = np.repeat(np.arange(most), width)
        text = chars[first[lane] + row]
        code = self.klass[text]
        after = row0[row + 1] + lane
        after[lane >= np.append(width, 0)[row + 1]] = -1
        start = np.where(row > 0, n + row0[np.maximum(row - 1, 0)] + lane, lane)  # the boundary before a character
        # all pieces in the runs, by length: the first and last character, the piece
        alone = self.single[text]
        lost = np.flatnonzero(alone < 0)
        alone[lost] = [self.v.bytes.get(c, -1) if c < 128 else -1 for c in text[lost].tolist()] if len(lost) else alone[lost]
        found = [(np.arange(len(text)), np.arange(len(text)), alone)]
        at = np.flatnonzero(code)
        end, node = at, self.next[0, code[at]]
        for _ in range(self.v.longest - 1):
            live = np.flatnonzero((node > 0) & (after[end] >= 0))
            at, end = at[live], after[end[live]]
            node = self.next[node[live], code[end]]
            hit = np.flatnonzero(self.piece[node] >= 0)
            if len(hit):
                found.append((at[hit], end[hit], self.piece[node[hit]]))
            if not len(at):
                break
        begin, end, piece = (np.concatenate(x) for x in zip(*found))
        by_row = np.argsort(row[end].astype(np.uint16 if most < 65536 else np.int64), kind="stable")
        begin, end, piece = begin[by_row], end[by_row], piece[by_row]
        cuts = np.searchsorted(row[end], np.arange(most + 1))
        total = n + len(text)
        score, last, back = np.full(total, -np.inf), np.full(total, -1, np.int32), np.zeros(total, np.int64)
        score[:n] = 0.0
        known = np.zeros(len(self.scores) + 1, bool)  # pieces that are no bytes; the last place is for none
        known[list(self.names)] = True
        merging = self.v.kind == "bpe"
        costs = np.append(self.scores, self.v.unknown)
        for r in range(most):
            part = slice(cuts[r], cuts[r + 1])
            p, s = piece[part], start[begin[part]]
            sums = score[s] + costs[p]
            ok = sums > -np.inf
            if merging:
                tied = np.flatnonzero(ok & known[last[s]] & known[p])
                ok[tied] = self.follows(last[s[tied]], p[tied])
            at = np.flatnonzero(ok)
            at = at[np.argsort(sums[at], kind="stable")]  # the best one is written last, of equals the longest
            e = n + end[part][at]
            score[e], last[e], back[e] = sums[at], p[at], s[at]
        # walk back from the ends of all runs together
        now = np.where(sizes > 0, n + row0[np.maximum(sizes - 1, 0)] + np.arange(n), 0)
        if np.isinf(score[now]).any():
            raise ValueError("the vocabulary has no path for a text")
        steps, lanes = [], np.arange(n)
        while len(lanes):
            steps.append((lanes, last[now], now - n))
            now = back[now]
            more = now >= n
            now, lanes = now[more], lanes[more]
        counts = np.bincount(np.concatenate([x[0] for x in steps]), minlength=n) if steps else np.zeros(n, np.int64)
        ends = np.cumsum(counts)
        ids, char = np.empty(int(ends[-1]) if n else 0, np.int64), np.empty(int(ends[-1]) if n else 0, np.int64)
        for k, (lanes, p, c) in enumerate(steps):
            ids[ends[lanes] - 1 - k], char[ends[lanes] - 1 - k] = p, c
        wide = np.flatnonzero(ids < 0)
        if len(wide):  # characters of several byte pieces
            parts = [[self.v.bytes[b] for b in chr(text[c]).encode("utf-8", "surrogatepass")] for c in char[wide].tolist()]
            size = np.ones(len(ids), np.int64)
            size[wide] = list(map(len, parts))
            owner = np.repeat(np.arange(n), counts)
            ids, whole = np.repeat(ids, size), np.repeat(np.isin(np.arange(len(size)), wide), size)
            ids[whole] = np.concatenate([np.array(x) for x in parts])
            counts = np.bincount(owner, size, n).astype(np.int64)
        # back to the order of the runs
        result = np.empty(n, np.int64)
        result[order] = counts
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(counts) - counts
        return ranges(ids.astype(np.uint32), place, result), result


def ranges(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of values[start : start + count]."""
    ends = np.cumsum(count)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)]


class Coder:
    """Whole texts, a slice of them at a time."""

    #: a run is streamed if fewer runs of the slice than this are so long
    FEW, PART = 16, 4096

    def __init__(self, path: str | Vocabulary, kind: str = "bpe"):
        self.v = path if isinstance(path, Vocabulary) else Vocabulary(path, kind)
        self.lanes = Lanes(self.v)

    def stream(self, text: str) -> list[int]:
        """ids of a marked text, from a window alone."""
        coder, ids = Encoder(self.v), []
        for k in range(0, len(text), self.PART):
            ids += coder.push(text[k : k + self.PART])
        return ids + coder.finish()

    @staticmethod
    def _runs(text: str) -> list[str]:
        """The text between boundaries, each without the space mark before it; further marks belong to the run after them."""
        if "  " not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return [m[1:].replace(" ", SPACE) for m in re.findall(" +[^ ]*", " " + text)]

    def encode(self, values: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        split: list = []
        for t in values:
            split.append([] if not t else self._runs(t) if self.v.words_apart and SPACE not in t else None)
        number: dict[str, int] = {}
        for runs in split:
            if runs:
                number.update(dict.fromkeys(runs))
        distinct = list(number)
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
        limit = int(np.sort(lengths)[-self.FEW]) if len(lengths) >= self.FEW else 0
        short = [SPACE + w for w in distinct if len(w) < limit]
        ids, counts = self.lanes(short) if short else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        long_ = [np.array(self.stream(SPACE + w), np.uint32) for w in distinct if len(w) >= limit]
        for k, w in enumerate([*(w for w in distinct if len(w) < limit), *(w for w in distinct if len(w) >= limit)]):
            number[w] = k
        ids = np.concatenate([ids, *long_])
        counts = np.concatenate([counts, np.array(list(map(len, long_)), np.int64)])
        first = np.cumsum(counts) - counts
        out = []
        for t, runs in zip(values, split):
            if runs is None:
                out.append(np.array(self.stream(SPACE + t.replace(" ", SPACE)), np.uint32))
            else:
                at = np.fromiter(map(number.__getitem__, runs), np.int64, len(runs))
                out.append(ranges(ids, first[at], counts[at]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, kind: str) -> Coder:
    if (path, kind) not in _CODERS:
        _CODERS[path, kind] = Coder(path, kind)
    return _CODERS[path, kind]


def digests(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """One row per document: number and checksum of its ids, byte pieces, and whether decoding gives the text."""

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(path, kind)
        single = np.zeros(len(c.v.raw), bool)
        single[list(c.v.byte_ids)] = True
        values = texts(batch)
        found = c.encode(values)
        return {
            "doc_id": batch.column("doc_id"), "n_ids": list(map(len, found)), "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False)) for x in found],
            "n_byte_ids": [int(single[x].sum()) for x in found], "round_trip": [c.decode(x) == t for x, t in zip(found, values)],
        }

    return map_texts(docs, ["doc_id", "text"], run, SCHEMA, rows=SLICE)


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": [x.view(np.int32) for x in coder(path, kind).encode(texts(batch))]}

    return map_texts(docs, ["doc_id", "text"], run, "doc_id long, ids array<int>", rows=SLICE)


def decode(rows: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """doc_id and the text of ``ids`` (null ids: the empty text)."""

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(path, kind)
        return {"doc_id": batch.column("doc_id"), "text": [c.decode(np.array(x or [], np.uint32)) for x in batch.column("ids").to_pylist()]}

    return map_texts(rows.withColumn("text", F.lit("")), ["doc_id", "ids", "text"], run, "doc_id long, text string")
