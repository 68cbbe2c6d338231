"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is what merging yields exactly when every neighbouring pair is what merging its joined
text yields. So the encoder takes the longest piece at each place (Aho-Corasick), checks it against the piece
before by merging the two again, falls back to shorter pieces, and marks places from which no sequence goes
on in a bit field. White space starts a new run of pieces; runs are remembered. Runs of any length are encoded so.

The rule of pairs needs merges in one order. Pieces of several space marks share one score, so that among them
place decides; the leftmost grows first, which pairs reproduce. The constructor compares both for runs of marks
up to four times the longest such piece, with and without a letter after them, and refuses a model in which
they differ, or in which other pieces share a score.

Defined results: null text counts as empty (begin and end id only); characters without a piece become byte
pieces; a text of any length is encoded whole; repeated rows give repeated results; null doc_id is carried.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

SPACE = "▁"
#: Letters, and what is neither letter nor space mark, each with the space marks before it.
RUN = re.compile(rf"{SPACE}*(?:[^\W\d_²³¹]+|(?:(?!{SPACE})[\W\d_²³¹])+)|{SPACE}+")


class BacktrackingEncoder:
    """encode(text) -> ids, equal to the library's; decode(ids) -> text by the library."""

    def __init__(self, model_path: str, remember: int = 500_000):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        m = self.model
        normal = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.pieces = {i: m.id_to_piece(i) for i in normal}
        self.ids = {p: i for i, p in self.pieces.items()}
        self.score = {p: m.get_score(i) for i, p in self.pieces.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (m.bos_id(), m.eos_id()))
        self.letters = {p for p in self.ids if len(p) == 1}
        if not all({*p} <= self.letters for p in self.ids):
            raise ValueError("a piece holds a character that is no piece")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a space mark")
        if any(len(RUN.findall(p)) > 1 for p in self.ids):
            raise ValueError("a piece spans a border of runs")
        self.remember, self.runs, self.pairs = remember, {}, {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.ids, key=len):
            if self.merge(p) != [self.ids[p]]:
                continue
            self.automaton.add_word(p, self.ids[p])
            self.shorter[self.ids[p]] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if self.ids.get(p[:k]) in self.shorter), -1)
        self.automaton.make_automaton()
        marks = [p for p in self.ids if not p.strip(SPACE)]
        others = [s for p, s in self.score.items() if p.strip(SPACE) and len(p) > 1]
        if len({*others}) < len(others):
            raise ValueError("pieces share a score")
        for k in range(1, 4 * max(map(len, marks), default=0) + 1):
            for end in ("", "a"):
                if {*end} <= self.letters and self.backtrack(SPACE * k + end) != self.merge(SPACE * k + end):
                    raise ValueError("pairs of space marks don't settle their pieces")

    def merge(self, text: str) -> list[int]:
        """Merging itself: the best-scored neighbouring pair first, the leftmost of equals."""
        part, after, before = [*text], [*range(1, len(text) + 1)], [*range(-1, len(text) - 1)]
        score = self.score
        queue = [(-score[w], i, w) for i in range(len(text) - 1) if (w := text[i : i + 2]) in score]
        heapq.heapify(queue)
        while queue:
            _, i, w = heapq.heappop(queue)
            j = after[i]
            if not part[i] or j >= len(part) or part[i] + part[j] != w:
                continue
            part[i], part[j], after[i] = w, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
                if (x := w + part[after[j]]) in score:
                    heapq.heappush(queue, (-score[x], i, x))
            if before[i] >= 0 and (x := part[before[i]] + w) in score:
                heapq.heappush(queue, (-score[x], before[i], x))
        return [k for p in part if p for k in ((self.ids[p],) if p in self.ids else [self.bytes[b] for b in p.encode()])]

    def fits(self, left: int, right: int) -> bool:
        """Merging the joined text of two pieces gives these two again."""
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= self.remember:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a run whose characters are all pieces."""
        longest = [-1] * len(text)
        for end, i in self.automaton.iter(text):
            start = end + 1 - len(self.pieces[i])
            if longest[start] < 0 or len(self.pieces[i]) > len(self.pieces[longest[start]]):
                longest[start] = i
        failed, out, at, piece = bytearray(len(text) // 8 + 1), [], 0, longest[0]
        while at < len(text):
            end = at + len(self.pieces[piece])
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.fits(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest[at] if at < len(text) else -1
            elif self.shorter[piece] >= 0:
                piece = self.shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(self.pieces[piece])
        return out

    def run(self, text: str) -> list[int]:
        out, start = [], 0
        if {*text} <= self.letters:
            return self.backtrack(text)
        for k, c in enumerate(text):
            if c not in self.letters:
                if k > start:
                    out += self.run(text[start:k])
                out += [self.bytes[b] for b in c.encode()]
                start = k + 1
        return out + (self.run(text[start:]) if start < len(text) else [])

    def encode_bytes(self, text: str | None, begin_end: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        runs = self.runs
        if len(runs) > self.remember:
            runs.clear()
        words = RUN.findall(self.model.normalize(text)) if text else []
        get = runs.get
        got = [get(w) for w in words]
        if None in got:
            for i, w in enumerate(words):
                if got[i] is None:
                    got[i] = get(w) or np.array(self.run(w), "<u4").tobytes()
                    if len(w) < 100:
                        runs[w] = got[i]
        if begin_end:
            got = [self.begin, *got, self.end]
        return b"".join(got)

    def encode(self, text: str | None, begin_end: bool = True) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, begin_end), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(2)
def encoder(model_path: str) -> BacktrackingEncoder:
    """One for each Python worker, kept between tasks."""
    return BacktrackingEncoder(model_path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded text. One pass, no exchange."""

    def start():
        coder = encoder(model_path)

        def row(doc_id, text):
            ids = coder.encode(text)
            return doc_id, ids, coder.decode(ids)

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", start)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text: the ids stay in the worker, as only digests are asked for."""

    def start():
        coder = encoder(model_path)

        def row(doc_id, text):
            raw = coder.encode_bytes(text)
            ids = np.frombuffer(raw, "<u4").tolist()
            return doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
