"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a task stand one after the other in the order of the input. A
window may end at the end of a document, at the end of a sentence (at a small
penalty) or, where neither is near, inside a sentence (at a larger one). The cuts
minimise padding plus penalties; as padding is linear in the length of a window,
the best predecessor of a cut is a sliding-window minimum, kept in a monotone
queue.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from bisect import bisect_left
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retinue.llm.words import small_batches

#: Tokens of a full sequence. A sequence as long as a power of two is not padded.
WINDOW = 2048
#: Appended to every document.
END_ID = 1
#: Tokens of padding that a cut at a sentence end, or inside a sentence, is worth.
SENTENCE_PENALTY = 2
INSIDE_PENALTY = 8
#: A stretch of more tokens without a sentence end may be cut inside, every so many tokens.
STRETCH = 16
#: Tokens that are packed at once; the last window of a block goes on into the next.
BLOCK_TOKENS = 1 << 20
#: Pieces of text a worker remembers before it begins anew; results do not depend on it.
REMEMBERED = 200_000
#: Splits text before the merges of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of texts by a byte-level vocabulary, with a memory of the pieces between single spaces.

    The split pattern never joins a space to what stands before it, so what
    follows a single space can be encoded on its own. A text is first split at
    the ``added`` tokens, whose ids stand between those of the parts.
    """

    def __init__(self, ranks: bytes, added: tuple[tuple[str, int], ...] = ()) -> None:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.ends_sentence = np.zeros(max(merges.values()) + 1, bool)
        for token, rank in merges.items():
            self.ends_sentence[rank] = token.endswith((b".", b"!", b"?", b"\n"))
        self.added = dict(added)
        # The longest of those that begin at one place is taken.
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.starts = _Known(self), array("I"), array("q", [0])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        heads, tails, found = [], [], []
        for text in texts:
            if self.split is not None and self.split.search(text):
                heads.append(self._between_added(text))
                tails.append([])
                found.append(np.empty(0, np.int64))
                continue
            first, *rest = text.split(" ")
            places = np.fromiter(map(self.known.__getitem__, rest), np.int64, len(rest))
            last = ""
            if (places < 0).any() or first[-1:].isspace():
                first, *rest = _CUT.split(text)
                last = rest.pop() if rest else ""
                places = np.fromiter(map(self.known.__getitem__, rest), np.int64, len(rest))
            heads.append(self.encoding.encode_ordinary(first))
            tails.append(self.encoding.encode_ordinary(" " + last) if last else [])
            found.append(places)
        ids, starts = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.int64)
        out = []
        for head, places, tail in zip(heads, found, tails):
            begin = starts[places]
            sizes = starts[places + 1] - begin
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            own = np.empty(len(head) + total + len(tail) + 1, np.uint32)
            own[: len(head)] = head
            own[len(head) : len(head) + total] = ids[np.repeat(begin - ends + sizes, sizes) + np.arange(total)]
            own[len(head) + total : -1] = tail
            own[-1] = END_ID
            out.append(own)
        return out

    def _between_added(self, text: str) -> list[int]:
        ids: list[int] = []
        for n, part in enumerate(self.split.split(text)):
            ids += [self.added[part]] if n % 2 else self.encoding.encode_ordinary(part)
        return ids


class _Known(dict):
    """Text after a space -> place of its ids; -1 if it cannot be encoded on its own."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return -1
        encoder = self.encoder
        place = self[piece] = len(encoder.starts) - 1
        encoder.ids.extend(encoder.encoding.encode_ordinary(" " + piece))
        encoder.starts.append(len(encoder.ids))
        return place


@lru_cache(maxsize=1)
def encoder_of(ranks: bytes, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(ranks, added)


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """Text and id of the added tokens of a ``tokenizers`` file, which are taken out of a text as they stand."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} takes in or needs what stands beside it")
    return tuple((token["content"], token["id"]) for token in added)


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Where the windows of least padding plus penalties end.

    ``places`` ascend from 0, no two neighbours further apart than ``window``;
    the last one is the end. With g = cost + place, g of a cut is its penalty
    plus ``window`` plus the least g at most ``window`` tokens before it. The
    last window costs nothing: it goes on in the next block or needs no padding.
    """
    least = [0] * len(places)
    before = [0] * len(places)
    queue = deque([0])
    for j in range(1, len(places) - 1):
        earliest = places[j] - window
        while places[queue[0]] < earliest:
            queue.popleft()
        best = before[j] = queue[0]
        value = least[j] = least[best] + window + penalties[j]
        while queue and least[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts = []
    j = len(places) - 1
    if j > 0:
        before[j] = min((i for i in range(bisect_left(places, places[j] - window), j)), key=lambda i: (least[i] - places[i], -i))
    while j > 0:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[list[int], list[int]]:
    """All places where a window may end, with their penalties; the first is 0, the last the end."""
    known = ids < len(ends_sentence)
    sentence = np.flatnonzero(ends_sentence[np.where(known, ids, 0)] & known) + 1
    places = np.union1d(np.r_[0, sentence], doc_ends)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > STRETCH)
    inside = [np.arange(places[k] + STRETCH, places[k + 1], STRETCH) for k in wide]
    every = np.union1d(places, np.concatenate(inside)) if inside else places
    penalties = np.full(len(every), INSIDE_PENALTY)
    penalties[np.searchsorted(every, places)] = SENTENCE_PENALTY
    penalties[np.searchsorted(every, doc_ends)] = 0
    return every.tolist(), penalties.tolist()


def powers(length: int) -> list[int]:
    """Ends of the pieces of a last window: powers of two, the largest first, which need no padding."""
    ends, at = [], 0
    while at < length:
        at += 1 << ((length - at).bit_length() - 1)
        ends.append(at)
    return ends


class Packer:
    """Packs a stream of documents; ``rows`` gather what is finished."""

    def __init__(self, encoder: Encoder, first_sequence: int) -> None:
        self.encoder, self.sequence = encoder, first_sequence
        #: Not yet packed: id, token ids left, tokens before these, all tokens.
        self.waiting: list[tuple[int | None, np.ndarray, int, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, ids, 0, len(ids)))
        self.tokens += len(ids)

    def pack(self, final: bool) -> list[tuple]:
        """Rows of all windows but the last, which goes on waiting unless this is the ``final`` call."""
        if not self.waiting:
            return []
        ids = np.concatenate([row[1] for row in self.waiting])
        ends = np.cumsum([len(row[1]) for row in self.waiting])
        cuts = best_cuts(*cut_places(ids, ends, self.encoder.ends_sentence))
        last = cuts[-2] if len(cuts) > 1 else 0
        if final:
            cuts = cuts[:-1] + ([len(ids)] if len(ids) - last == WINDOW else [last + p for p in powers(len(ids) - last)])
        else:
            cuts = cuts[:-1]
        stop = cuts[-1] if cuts else 0
        begins = np.union1d(np.r_[0, cuts], ends - [len(row[1]) for row in self.waiting])
        begins = begins[begins < stop]
        stops = np.r_[begins[1:], stop]
        which = np.searchsorted(ends, begins, side="right")
        windows = np.searchsorted(cuts, begins, side="right")
        window_begins = np.r_[0, cuts]
        rows = []
        for begin, end, k, w in zip(begins.tolist(), stops.tolist(), which.tolist(), windows.tolist()):
            doc_id, own, earlier, total = self.waiting[k]
            start = earlier + begin - (int(ends[k]) - len(own))
            rows.append((doc_id, start, end - begin, ids[begin:end].tobytes(), total, self.sequence + w, begin - int(window_begins[w])))
        self.sequence += len(cuts)
        left = []
        for (doc_id, own, earlier, total), end in zip(self.waiting, ends.tolist()):
            if end > stop:
                done = max(0, stop - (end - len(own)))
                left.append((doc_id, own[done:], earlier + done, total))
        self.waiting, self.tokens = left, len(ids) - stop
        return rows


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def pack_documents(docs: DataFrame, ranks_path: str, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """``<doc_id, start, length, ids, doc_tokens, sequence_id, offset>``, one row per piece of a document.

    ``ids`` are little-endian unsigned 32-bit token ids. Every task packs its
    split of the input in its order, so no text is moved; its last window is cut
    into powers of two, which need no padding. ``ranks_path`` is a byte-level
    vocabulary as ranks; it is read by the driver. ``added`` are the tokens
    beside the ranks (:func:`added_tokens`); without them their texts are
    ordinary text.

    * Null and empty texts are the end id alone; null ids and repeated rows are
      documents of their own.
    * A document of any length is cut as often as needed; at most
      ``BLOCK_TOKENS`` tokens and one document are held at once.
    * An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        ranks = file.read()

    def pack(batches):
        encoder = encoder_of(ranks, added)
        packer = Packer(encoder, TaskContext.get().partitionId() << 32)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                packer.add(doc_id, ids)
                if packer.tokens >= BLOCK_TOKENS and (rows := packer.pack(final=False)):
                    yield table(rows)
        if rows := packer.pack(final=True):
            yield table(rows)
        # The worker stays for tasks of other kinds, so it gives back what it remembers.
        encoder.forget()
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, schema)
