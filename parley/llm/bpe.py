"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

A word's part boundaries and the ranks of its adjacent pairs lie side by side in two short
lists. The least rank is found by a scan, its boundary deleted, and the two neighbouring ranks
are looked up again, until no pair has a rank. The different short words of a batch that are not
known yet are merged together: the rows of one table are the rank arrays of words of one length, and
every round scans, deletes and looks up in all rows. Words beyond ``SCAN_PARTS`` parts, where
repeated scans would cost the square of the length, take the same merges from a heap. A worker keeps
the vocabulary and the ids of the words it met last from task to task.

Rows: every input row gives one output row, repeated rows included. A null text counts as
empty; a null id stays null. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from parley.llm.common import Known, map_rows, text_bytes, worker_kept

SCAN_PARTS = 256  # longest word, in bytes, that is merged by scans
ROW_PARTS = 24  # longest word, in bytes, that is merged in a table
CACHED_WORDS = 300_000  # words whose ids a worker remembers, in two generations
CACHED_BYTES = 64  # longest word that is remembered
SLICE = 1 << 18  # characters of texts whose words are looked at together
#: The pattern that cuts text into words, as the vocabulary file's kind has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 24  # a pair is one number, left id above right id; so are a rank and the merged id
BELOW = (1 << SHIFT) - 1
NEVER = 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return letters


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        value = {letter: byte for byte, letter in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair_key = vocab[left] << SHIFT | vocab[right]
            self.ranks.setdefault(pair_key, rank << SHIFT | vocab[left + right])
        self.pieces = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces.update({i: t.encode() for t, i in self.added.items()})
        self.words = regex.compile(WORDS)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = (
            regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
            if self.added
            else None
        )
        self.known = Known(cached, self.word, lambda word: len(word) <= CACHED_BYTES)
        pairs = np.array(sorted(self.ranks), np.int64)
        self.pairs = np.append(pairs, NEVER)
        self.found = np.array([*(self.ranks[p] for p in pairs.tolist()), NEVER], np.int64)

    @classmethod
    def shared(cls, path: str, cached: int = CACHED_WORDS) -> Codec:
        """One codec for all tasks of a worker."""
        return worker_kept(f"codec {cached} {path}", lambda: cls(path, cached))

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        ids = list(map(self.first.__getitem__, word.encode("utf-8", "surrogatepass")))
        if len(ids) > 1:
            ids = self._scan(ids) if len(ids) <= SCAN_PARTS else self._heap(ids)
        return pack(f"<{len(ids)}I", *ids)

    def _scan(self, ids: list[int]) -> list[int]:
        look = self.ranks.get
        ranks = [look(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            merged = ids[at] = best & BELOW
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = look(merged << SHIFT | ids[at + 1], NEVER)
            if at:
                ranks[at - 1] = look(ids[at - 1] << SHIFT | merged, NEVER)
        return ids

    def _looked_up(self, pairs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.found[at], NEVER)

    def table(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length in bytes, merged row by row at once."""
        size = len(words[0])
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        ids = np.array(self.first, np.int64)[letters]
        ranks = self._looked_up(ids[:, :-1] << SHIFT | ids[:, 1:])
        out = np.zeros((len(words), size), "<u4")
        counts = np.full(len(words), size)
        rows = np.arange(len(words))
        while size > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NEVER
            if done.any():
                out[rows[done], :size] = ids[done]
                counts[rows[done]] = size
                live = ~done
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
            every = np.arange(len(rows))
            ids[every, at] = best & BELOW
            # the part after the merged one goes, and so does the rank of the merged pair
            size -= 1
            keep = np.arange(size)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            if size > 1:
                keep = keep[:, :-1]
                ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), 1)
                for place, inside in ((at, at < size - 1), (at - 1, at > 0)):
                    row, i = every[inside], place[inside]
                    ranks[row, i] = self._looked_up(ids[row, i] << SHIFT | ids[row, i + 1])
        else:
            out[rows, :size] = ids
            counts[rows] = size
        return [row[: 4 * n] for row, n in zip(map(bytes, out), counts.tolist())]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The words of texts; the ids of short ones are known from now on."""
        parts = [self.words.findall(text) for text in texts]
        known, old = self.known, self.known.old
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in set().union(*parts):
            if word not in known and word not in old:
                raw = word.encode("utf-8", "surrogatepass")
                if 1 < len(raw) <= ROW_PARTS:
                    by_size.setdefault(len(raw), []).append((word, raw))
        for pairs in by_size.values():
            for (word, _), ids in zip(pairs, self.table([raw for _, raw in pairs])):
                known.learnt(word, ids)
        return parts

    def _heap(self, ids: list[int]) -> list[int]:
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        look = self.ranks.get
        queue = []

        def offer(left: int) -> None:
            right = after[left]
            if right < size and (found := look(ids[left] << SHIFT | ids[right])) is not None:
                heapq.heappush(queue, (found, left, ids[left], ids[right]))

        for left in range(size - 1):
            offer(left)
        while queue:
            found, left, a, b = heapq.heappop(queue)
            right = after[left]
            if ids[left] != a or right >= size or ids[right] != b:
                continue  # an older offer
            ids[left], ids[right] = found & BELOW, -1
            after[left] = after[right]
            if after[right] < size:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [i for i in ids if i >= 0]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of whole texts, in slices of bounded size; strings of added tokens become those tokens."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= SLICE:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        look = self.known.__getitem__
        if self.specials is None:
            return [b"".join(map(look, words)) for words in self.learn(texts)]
        split = [self.specials.split(text) for text in texts]
        words = iter(self.learn([piece for pieces in split for piece in pieces if piece not in self.added]))
        return [
            b"".join(
                pack("<I", self.added[piece]) if piece in self.added else b"".join(map(look, next(words)))
                for piece in pieces
            )
            for pieces in split
        ]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self._encoded([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of ids; broken UTF-8 becomes replacement characters."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.pieces.__getitem__, numbers)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>``: the ids of every text."""

    def make():
        codec = Codec.shared(path)

        def work(rows):
            for key, ids in zip(rows["key"], codec.encode_all(rows["text"])):
                yield key, np.frombuffer(ids, "<u4").tolist()

        return work

    source = docs.select(docs[id_col].alias("key"), text_bytes(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return map_rows(source, f"key {kind}, ids array<int>", make).withColumnRenamed("key", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id, text``: the text of every row of ids; null ids give a null text."""

    def make():
        codec = Codec.shared(path)

        def work(rows):
            for key, ids in zip(rows["key"], rows["ids"]):
                yield key, None if ids is None else codec.decode(np.array(ids, "<u4").tobytes())

        return work

    source = tokens.select(tokens[id_col].alias("key"), "ids")
    kind = source.schema["key"].dataType.simpleString()
    return map_rows(source, f"key {kind}, text string", make).withColumnRenamed("key", id_col)


def round_trip(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cached_words: int = CACHED_WORDS,
    kept: bool = True,
) -> DataFrame:
    """Encode every text and decode the ids again, in one pass that keeps digests only.

    ``cached_words`` bounds the words a worker remembers, and ``kept`` says whether it does so from task
    to task; neither changes a result. ``id, n_tokens, ids_sha256, decoded_sha256``; see the module for nulls and repeated rows.
    """

    def make():
        codec = Codec.shared(path, cached_words) if kept else Codec(path, cached_words)

        def work(rows):
            for key, ids in zip(rows["key"], codec.encode_all(rows["text"])):
                back = codec.decode(ids).encode("utf-8", "surrogatepass")
                yield (
                    key,
                    len(ids) // 4,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(back).hexdigest(),
                )

        return work

    source = docs.select(docs[id_col].alias("key"), text_bytes(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(source, schema, make).withColumnRenamed("key", id_col)
