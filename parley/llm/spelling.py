"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

Words are counted over all documents, first by the tasks. The frequent ones form the vocabulary.
Every length has a blocked Bloom filter: a word sets ``BITS`` bits in each of the two 64-bit words
of its block, so a probe touches one cache line. Blocks are dealt in shards of ``SHARD`` blocks, each
built by a task, and broadcast in rounds of at most ``ROUND`` blocks, a bound that does not grow with
the vocabulary.

Every word generates its edits as hashes only: each deletion, and each replacement by a greater letter.
An insertion is a deletion seen from the other word, a replacement by a lesser letter a replacement seen
from the other, so all pairs are met. Only edits that a filter lets pass become strings and are shuffled
to an exact join with the vocabulary, which removes false positives.

A word's form is its most frequent near word if that is ``TIMES`` times as frequent; roots are
found by doubling the pointers to forms, which lead to ever more frequent words and end.

Rows: one row per word of the vocabulary. Texts that are null or empty have no words; in the
string that is hashed to choose the words whose letter is deleted a null id is empty. Repeated
rows count each. Other columns are ignored, whatever their names. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import split, text_bytes
from parley.session import stage

LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
DROP = 199  # one in so many runs loses a letter
LENGTH = 6  # code points of a word at least
RUN = re.compile(f"[a-z\u00C0-\u00FF]{{{LENGTH},}}")  # in lower case
HELD = 400_000  # words that a task counts before it passes them on
OFTEN = 5  # occurrences of a word at least
TIMES = 5  # how much more frequent a word's form is
WORD_BITS = 24  # bits of a filter for each word
BITS = 3  # bits that a word sets in each of its two 64-bit words
BLOCK_BYTES = 16
SHARD = 1 << 14  # blocks of a shard
ROUND = 1 << 21  # blocks that are broadcast together, 32 MB
STEP = 1 << 21  # edits that a task holds as hashes at once
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers of 64-bit mixers
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the vocabulary: lower-cased runs of letters, some without one letter."""
    source = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")), text_bytes(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for part in split(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = crc32(f"{key}:".encode())
                    # shorter runs are no words, whether they lose a letter or not
                    for word in RUN.findall(text.encode().lower().decode()):
                        h = crc32(word.encode(), start)
                        if h % DROP == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LENGTH:
                                continue
                        counts[word] = counts.get(word, 0) + 1
                    if len(counts) > HELD:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    words = source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= OFTEN)


def powers(size: int) -> np.ndarray:
    return np.cumprod(np.full(size, ODD, np.uint64))


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * ODD2
    return hashes ^ (hashes >> np.uint64(29))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def hashes_of(points: np.ndarray) -> np.ndarray:
    """A hash of every row, the sum of its letters' values at their places."""
    return (points.astype(np.uint64) * powers(points.shape[1])).sum(1, dtype=np.uint64)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The bits of every hash in the two words of its block."""
    spread = hashes * ODD
    out = np.zeros((len(hashes), 2), np.uint64)
    for k in range(2 * BITS):
        out[:, k % 2] |= np.uint64(1) << (spread >> np.uint64(64 - 6 * (k + 1)) & np.uint64(63))
    return out


class Filter:
    """The blocks of a length that a round holds: a range of all its blocks."""

    def __init__(self, blocks: int, first: int, rows: np.ndarray):
        self.blocks, self.first, self.rows = blocks, first, rows
        self.whole = len(rows) >= blocks

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that these blocks hold."""
        hashes = mixed(hashes)
        at = block_of(hashes, self.blocks)
        if self.whole:
            bits = bits_of(hashes)
            return np.flatnonzero(((self.rows[at] & bits) == bits).all(1))
        own = np.flatnonzero((at >= self.first) & (at < self.first + len(self.rows)))
        bits = bits_of(hashes[own])
        return own[((self.rows[at[own] - self.first] & bits) == bits).all(1)]


def deletions(points: np.ndarray) -> np.ndarray:
    """Hashes of the rows without each of their letters, a row for each word."""
    values = points.astype(np.uint64)
    size = points.shape[1]
    steps = powers(size)
    before = np.zeros(points.shape, np.uint64)
    before[:, 1:] = np.cumsum(values[:, :-1] * steps[:-1], 1, dtype=np.uint64)
    after = np.zeros(points.shape, np.uint64)
    after[:, :-1] = np.cumsum((values[:, 1:] * steps[:-1])[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
    return before + after


def replacements(points: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with each letter replaced by each of ``LETTERS``, and which of these are greater."""
    change = LETTERS.astype(np.uint64)[None, None, :] - points.astype(np.uint64)[:, :, None]
    return hashes[:, None, None] + change * powers(points.shape[1])[None, :, None], LETTERS > points[:, :, None]


def _shards(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """``length, shard, rows``: every shard's blocks, built by the task that holds its words."""

    @F.pandas_udf("int")
    def shard(words: pd.Series) -> pd.Series:
        out = np.zeros(len(words), np.int32)
        lengths = words.str.len().to_numpy()
        for size in set(lengths.tolist()):
            own = np.flatnonzero(lengths == size)
            hashes = mixed(hashes_of(letters_of(words.iloc[own].tolist())))
            out[own] = block_of(hashes, blocks[size]) // SHARD
        return pd.Series(out)

    def build(group: pa.Table) -> pa.Table:
        head = group.slice(0, 1).select(["length", "shard"])
        size, first = head.column(0)[0].as_py(), head.column(1)[0].as_py() * SHARD
        hashes = mixed(hashes_of(letters_of(group.column("word").to_pylist())))
        at, bits = block_of(hashes, blocks[size]) - first, bits_of(hashes)
        rows = np.zeros((min(SHARD, blocks[size] - first), 2), np.uint64)
        for half in range(2):
            np.bitwise_or.at(rows[:, half], at, bits[:, half])
        return head.append_column("rows", pa.array([zlib.compress(rows.tobytes(), 1)], pa.binary()))

    keyed = words.select("word", F.length("word").alias("length"), shard("word").alias("shard"))
    return keyed.groupBy("length", "shard").applyInArrow(build, "length int, shard int, rows binary")


def _rounds(blocks: dict[int, int]) -> list[list[tuple[int, int]]]:
    """Which shards are broadcast together: runs of shards of at most ``ROUND`` blocks."""
    rounds, held = [[]], 0
    for size, n in sorted(blocks.items()):
        for i in range(-(-n // SHARD)):
            own = min(SHARD, n - i * SHARD)
            if held + own > ROUND and rounds[-1]:
                rounds.append([])
                held = 0
            rounds[-1].append((size, i))
            held += own
    return rounds


def _positives(words: DataFrame, blocks: dict[int, int], shards: dict[tuple[int, int], bytes]) -> DataFrame:
    """``word, edit``: the edits that the shards of this round let pass."""
    shared = words.sparkSession.sparkContext.broadcast(shards)  # at most ROUND blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Filter] = {}
        for size in {size for size, _ in shared.value}:
            own = sorted(i for length, i in shared.value if length == size)
            bodies = []
            for i in range(own[0], own[-1] + 1):  # a shard without a word has no row
                rows = shared.value.get((size, i))
                empty = np.zeros((min(SHARD, blocks[size] - i * SHARD), 2), np.uint64)
                bodies.append(np.frombuffer(zlib.decompress(rows), np.uint64).reshape(-1, 2) if rows else empty)
            known[size] = Filter(blocks[size], own[0] * SHARD, np.concatenate(bodies))

        def edits(words: list[str]) -> Iterator[tuple[str, str]]:
            size = len(words[0])
            points = letters_of(words)
            if size - 1 in known:
                for at in known[size - 1].passing(deletions(points).ravel()).tolist():
                    word, i = words[at // size], at % size
                    yield word, word[:i] + word[i + 1 :]
            if size not in known:
                return
            hashes, greater = replacements(points, hashes_of(points))
            places = np.flatnonzero(greater)
            for at in places[known[size].passing(hashes.ravel()[places])].tolist():
                at, letter = divmod(at, len(LETTERS))
                word, i = words[at // size], at % size
                yield word, word[:i] + chr(LETTERS[letter]) + word[i + 1 :]

        for batch in batches:
            for part in split(batch, 1 << 18):
                by_length: dict[int, list[str]] = {}
                for word in part.column(0).to_pylist():
                    by_length.setdefault(len(word), []).append(word)
                for size, words in by_length.items():
                    step = max(1, STEP // (size * len(LETTERS)))
                    for start in range(0, len(words), step):
                        if pairs := list(edits(words[start : start + step])):
                            columns = [pa.array(c, pa.string()) for c in zip(*pairs)]
                            yield pa.RecordBatch.from_arrays(columns, names=["word", "edit"])

    return words.select("word").mapInArrow(run, "word string, edit string")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: both directions of every pair of words one edit apart."""
    words = vocabulary.select("word", "n")
    lengths = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    # one row for each length that occurs
    sizes = {r["length"]: r["n"] for r in lengths.toLocalIterator()}
    blocks = {size: -(-n * WORD_BITS // (8 * BLOCK_BYTES)) for size, n in sizes.items()}
    shards, found = stage(_shards(words, blocks)) if sizes else None, None
    for wanted in _rounds(blocks):
        held = {}
        if wanted:
            (low, first), (high, last) = wanted[0], wanted[-1]
            place = F.struct("length", "shard")
            inside = shards.where(
                (place >= F.struct(F.lit(low).alias("length"), F.lit(first).alias("shard")))
                & (place <= F.struct(F.lit(high).alias("length"), F.lit(last).alias("shard")))
            )
            held = {(r["length"], r["shard"]): r["rows"] for r in inside.toLocalIterator()}
        positives = stage(_positives(words, blocks, held))
        found = positives if found is None else found.unionByName(positives)
    # a word may give the same edit twice, by deleting either of two equal letters
    exact = found.distinct().join(words.select(F.col("word").alias("edit"), F.col("n").alias("near_n")), "edit")
    one = exact.join(words, "word").select("word", "n", F.col("edit").alias("near"), "near_n")
    two = one.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return one.unionByName(two)


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words that have a form, by doubling pointers."""
    state = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = stage(
            state.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    vocabulary = stage(counted(docs, id_col, text_col))
    pairs = near_pairs(vocabulary)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = vocabulary.join(near, "word", "left")
    has = -F.col("best.order") >= TIMES * F.col("n")
    rows = stage(
        rows.select(
            "word",
            F.when(has, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has, -F.col("best.order")).alias("form_n"),
        )
    )
    roots = roots_of(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The same rows in SQL: crc32 bit by bit, and near words by what is left without one letter.
ORACLE = r"""
WITH RECURSIVE run AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS r
  FROM documents
), seen AS (
  SELECT doc_id, r, count(*) AS times FROM run WHERE length(r) >= 6 GROUP BY ALL
), byte AS (
  SELECT r, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM seen
), crc AS (
  SELECT r, times, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2),
      lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS h
  FROM byte
), spelt AS (
  SELECT CASE WHEN h % 199 = 0
    THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, times
  FROM crc
), vocabulary AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM vocabulary, unnest(range(1, length(word) + 1)) AS t(i)
), pair AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION
  SELECT DISTINCT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION
  SELECT DISTINCT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place
  FROM pair
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND next IS NULL
"""
