"""Exact merge-type piece encoding by backtracking, and decoding.

An encoding is the one of the merges exactly if each of its pieces is and each
two neighbours are: merging their joined text again gives the two. So pieces are
taken greedily, the longest match first; where a neighbour does not fit, the next
shorter prefix is tried, and a position from which nothing fits is marked in a
bitfield and never tried again. Each word is encoded once and remembered.
"""

from __future__ import annotations

import heapq
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retinue.llm.words import small_batches

#: Stands for a space in pieces (fixed value of the model format).
SPACE = "▁"
#: Words a worker remembers before it begins anew; results do not depend on it.
REMEMBERED = 300_000
#: Pairs of neighbours a worker remembers.
REMEMBERED_PAIRS = 1_000_000


class Pieces:
    """A merge-type model with a leading space, byte fallback and no other normalisation."""

    def __init__(self, model: bytes) -> None:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(processor.get_piece_size())
        text = [processor.id_to_piece(i) for i in every]
        special = [processor.is_control(i) or processor.is_unknown(i) for i in every]
        is_byte = [processor.is_byte(i) for i in every]
        self.piece = {text[i]: i for i in every if not (special[i] or is_byte[i])}
        self.text = text
        self.score = [processor.get_score(i) for i in every]
        self.byte = {int(text[i][3:5], 16): i for i in every if is_byte[i]}
        self._check_model(processor)
        self.pairs: dict[int, bool] = {}
        self.size = list(map(len, text))
        self.chars = frozenset(c for piece in self.piece for c in piece)
        # Only pieces that their own merges end in can be part of an encoding.
        whole = {p: i for p, i in self.piece.items() if SPACE * 2 not in p and self.merge(p) == [i]}
        self.automaton = ahocorasick.Automaton()
        #: Longest shorter piece that a piece begins with; -1 if there is none.
        self.shorter = [-1] * len(text)
        for piece, i in whole.items():
            self.automaton.add_word(piece, (i, len(piece) - 1))
            self.shorter[i] = next((whole[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in whole), -1)
        self.automaton.make_automaton()
        surface = [b"" if special[i] else bytes([int(text[i][3:5], 16)]) if is_byte[i] else text[i].replace(SPACE, " ").encode() for i in every]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.ends = np.cumsum([len(s) for s in surface])
        self.begins_with_space = np.array([text[i].startswith(SPACE) for i in every])
        self.forget()

    def _check_model(self, processor) -> None:
        if len(self.byte) != 256 or any(map(processor.is_unused, range(processor.get_piece_size()))):
            raise ValueError("the model needs byte fallback and no unused pieces")
        for piece in self.piece:
            if SPACE in piece.lstrip(SPACE) or not all(c in self.piece for c in piece):
                raise ValueError(f"piece {piece!r} joins words or has an unknown character")

    def forget(self) -> None:
        self.known, self.ids, self.starts = _Known(self), array("i"), array("q", [0])

    def merge(self, text: str) -> list[int]:
        """Pieces of ``text`` (known characters only) by carrying out its merges one after the other."""
        part, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                joined = part[left] + part[right]
                found = self.piece.get(joined)
                if found is not None:
                    heapq.heappush(heap, (-self.score[found], left, joined))

        for left in range(n - 1):
            offer(left)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            if not part[left] or right >= n or part[left] + part[right] != joined:
                continue
            part[left], part[right] = joined, ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [self.piece[p] for p in part if p]

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges of the two pieces' joined text end in these two."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.text[left] + self.text[right]) == [left, right]
        return found

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a word of known characters, with at most one space sign, at its start."""
        longest = [-1] * len(text)
        for end, (piece, back) in self.automaton.iter(text):
            longest[end - back] = piece
        failed = bytearray(len(text) + 1)
        size, shorter, pairs = self.size, self.shorter, self.pairs
        taken: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                end = at + size[piece]
                if not failed[end]:
                    fits = last < 0 or pairs.get(last << 32 | piece)
                    if fits is None:
                        fits = self.fit(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                if end == len(text):
                    return taken
                at, last, piece = end, piece, longest[end]
            else:
                # Nothing fits from here, so the piece before has to be a shorter one.
                failed[at] = 1
                piece = taken.pop()
                at -= size[piece]
                last, piece = taken[-1] if taken else -1, shorter[piece]

    def word(self, text: str) -> list[int]:
        """Ids of a run of space signs and the word after it."""
        if self.chars.issuperset(text) and not text.startswith(SPACE * 2):
            return self.backtrack(text)
        ids: list[int] = []
        start = 0
        for end in [*(n for n, c in enumerate(text) if c not in self.chars), len(text)]:
            known = text[start:end]
            if known:
                # Runs of spaces have pieces of equal rank, which only the merges in order settle.
                ids += self.merge(known) if known.startswith(SPACE * 2) else self.backtrack(known)
            if end < len(text):
                ids += [self.byte[b] for b in text[end].encode()]
            start = end + 1
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        places = []
        for text in texts:
            words = text.replace(SPACE, " ").split(" ") if text else []
            if "" in words:
                words = _runs(words)
            places.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        ids, starts = np.frombuffer(self.ids, np.int32), np.frombuffer(self.starts, np.int64)
        out = []
        for own in places:
            begin = starts[own]
            sizes = starts[own + 1] - begin
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(ids[np.repeat(begin - ends + sizes, sizes) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids; bytes that are no text become one replacement character each."""
        if not len(ids):
            return ""
        ends = self.ends[ids]
        sizes = ends - np.where(ids > 0, self.ends[ids - 1], 0)
        stops = np.cumsum(sizes)
        data = self.surface[np.repeat(ends - stops, sizes) + np.arange(stops[-1])].tobytes()
        return data[int(self.begins_with_space[ids[0]]) :].decode("utf-8", "one_each")


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _runs(words: list[str]) -> list[str]:
    """Every word with the further spaces before it; spaces at the end stand alone."""
    out, spaces = [], 0
    for word in words:
        if word:
            out.append(SPACE * spaces + word)
            spaces = 0
        else:
            spaces += 1
    # The space sign before each entry is the last of its run.
    return [*out, SPACE * (spaces - 1)] if spaces else out


class _Known(dict):
    """Word without its leading space sign -> place of its ids."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, word: str) -> int:
        pieces = self.pieces
        place = self[word] = len(pieces.starts) - 1
        pieces.ids.extend(pieces.word(SPACE + word))
        pieces.starts.append(len(pieces.ids))
        return place


@lru_cache(maxsize=1)
def pieces_of(model: bytes) -> Pieces:
    import codecs

    codecs.register_error("one_each", _each)
    return Pieces(model)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``<doc_id, ids, decoded>``, one row for every row of ``docs``.

    ``ids`` are those of the model at ``model_path`` (read by the driver)
    without begin and end ids; ``decoded`` is the text that these ids give.
    Null and empty texts have no ids and decode to an empty text; null ids and
    repeated rows are rows like others; an empty table gives an empty result.
    Only ``doc_id`` and ``text`` are read.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            ids = pieces.encode([text or "" for text in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            decoded = pa.array([pieces.decode(own) for own in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])
        # The worker stays for tasks of other kinds, so it gives back what it remembers.
        pieces.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
