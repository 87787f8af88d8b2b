"""Repeated passages: every byte inside a string of ``span`` bytes that starts anywhere else.

Texts of any length are cut down to short strings first. Each window of ``span`` bytes picks
the least hash of its ``gram``-byte grams (the leftmost of equals) as its anchor, so equal windows
pick equal anchors at equal places. Neighbouring windows with one anchor form one context, a
string of less than two spans. Only contexts whose anchor occurs in another text go on, and
equal contexts go on once.

All contexts of an anchor, lined up at it, are then sorted column by column, from the right:
each round puts one symbol before every string, and updates the order of the strings and the
common prefixes of neighbours, which is the positional form of the collection's
Burrows-Wheeler transform. A window is repeated where a neighbour shares ``span`` symbols.
Rounds are bounded by the length of contexts, not by that of texts; between the steps, rows
lie in files of the shared folder.

An anchor with more than ``BLOCK`` different contexts is not sorted in one task: its windows
are halved by their place, and go on only together with contexts that share the string that all
windows of the half have in common. Halves that are still too many are halved again, down to
single windows, which are then equal by their key.

Windows are compared in the input, case and white space included; digests of 128 bits stand
for equal texts and contexts. Rows: every input row gives one output row. A null text counts as
empty; repeated rows are copies of each other, and a text that occurs twice is removed whole if
it has ``span`` bytes. A null id stays null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_batches, map_rows, text_bytes
from parley.session import release, stage

SPAN = 400  # bytes
GRAM = 32  # bytes; a power of two
BLOCK = 4096  # contexts that are sorted together
SEGMENT = 1 << 20  # places told apart by a key's low bits
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers of 64-bit mixers
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
STEPS = "array<struct<a:int,b:int>>"
WORDS = 50  # words of a passage that is cut from a corpus
CODE = 8  # letters that stand for a word, 6 bits each
CODED_WORDS = 200_000  # words whose letters a task remembers
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    mixed = (left ^ (left >> np.uint64(29))) * MIX + right * MIX2
    return mixed ^ (mixed >> np.uint64(32))


def _levels(raw: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Hashes of all strings whose length is a power of two up to ``length``."""
    hashes = {1: (raw.astype(np.uint64) + np.uint64(1)) * MIX}
    size = 1
    while 2 * size <= length and len(hashes[size]) > size:
        own = hashes[size]
        hashes[2 * size] = _pair(own[:-size], own[size:])
        size *= 2
    return hashes


def _strings(levels: dict[int, np.ndarray], length: int, starts: np.ndarray) -> np.ndarray:
    """128-bit hashes, as two columns, of the strings of a length at the given starts."""
    first, second, at = None, None, 0
    for size in sorted(levels, reverse=True):
        while length - at >= size:
            part = levels[size][starts + at]
            first = part if first is None else _pair(first, part)
            second = part * MIX2 if second is None else _pair(part * MIX2, second)
            at += size
    return np.stack((first, second), 1)


def _least(keys: np.ndarray, run: int) -> np.ndarray:
    """Minimum of every ``run`` neighbouring keys."""
    n = len(keys) - run + 1
    padded = np.full(-(-len(keys) // run) * run, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, run)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[run - 1 : run - 1 + n])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


class Windows:
    """Anchors of all windows of a text, and its windows that occur in it twice."""

    def __init__(self, raw: bytes, span: int, gram: int):
        self.raw, self.span = raw, span
        self.count = max(0, len(raw) - span + 1)
        if not self.count:
            self.marks = np.zeros(0, np.int64)
            self.twice = np.zeros(0, bool)
            return
        symbols = np.frombuffer(raw, np.uint8)
        levels = _levels(symbols, gram)
        hashes = _pair(levels[gram], levels[gram] * MIX)
        at = np.empty(self.count, np.int64)
        mask, run = np.uint64(SEGMENT - 1), span - gram + 1
        for start in range(0, self.count, SEGMENT - run + 1):
            part = hashes[start : start + SEGMENT]
            keys = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
            least = _least(keys, run)
            at[start : start + len(least)] = (least & mask).astype(np.int64) + start
        self.first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        self.last = np.append(self.first[1:] - 1, self.count - 1)
        self.at = at[self.first]
        self.marks = hashes[self.at].view(np.int64)
        self._repeated(symbols)

    def _repeated(self, symbols: np.ndarray) -> None:
        """Flags of windows that occur twice in this text, and of those after the first."""
        self.twice = np.zeros(self.count, bool)
        self.later = np.zeros(self.count, bool)
        _, inverse, times = np.unique(self.marks, return_inverse=True, return_counts=True)
        suspect = np.flatnonzero(times[inverse] > 1)
        if not len(suspect):
            return
        starts = np.concatenate([np.arange(self.first[i], self.last[i] + 1) for i in suspect])
        names = _strings(_levels(symbols, self.span), self.span, starts)
        names = names.view([("a", np.uint64), ("b", np.uint64)]).ravel()
        _, index, inverse, times = np.unique(
            names, return_index=True, return_inverse=True, return_counts=True
        )
        self.twice[starts] = times[inverse] > 1
        self.later[starts] = True
        self.later[starts[index]] = False

    def contexts(self, wanted: set[int]) -> Iterator[tuple[int, int, int, int]]:
        """``mark, anchor, first, last`` of windows with a wanted anchor, each window once."""
        for mark, at, first, last in zip(self.marks.tolist(), self.at, self.first, self.last):
            if mark in wanted:
                for a, b in _runs(~self.later[first : last + 1]):
                    yield mark, int(at), int(first) + a, int(first) + b


def spans(starts: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Maximal byte runs, half open, that windows beginning in the given runs cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + span))
        else:
            out.append((a, b + span))
    return out


def without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in cut:
        kept.append(raw[at:a])
        at = b
    return b"".join((*kept, raw[at:]))


def shared_windows(
    groups: np.ndarray, strings: list[bytes], offsets: list[int], allowed: list[tuple[int, int]], span: int
) -> list[list[tuple[int, int]]]:
    """For every string the runs of window starts that another string of its group holds too.

    Strings are lined up at their offsets; ``allowed`` holds the first and last start asked
    for. Column by column from the right, the strings of each group are kept in the order of
    what begins at the column, ``common[k]`` being the common prefix of places k - 1 and k.
    """
    m, left = len(strings), max(offsets)
    width = left + max(len(s) - o for s, o in zip(strings, offsets))
    end = 256  # stands where a string has no symbol
    table = np.full((width, m), end, np.int16)
    for i, (s, o) in enumerate(zip(strings, offsets)):
        table[left - o : left - o + len(s), i] = np.frombuffer(s, np.uint8)
    order = np.argsort(groups, kind="stable")
    _, group = np.unique(groups, return_inverse=True)
    group = group.astype(np.int64) * (end + 1)
    common = np.zeros(m + 1, np.int32)
    shift = left - np.array(offsets)
    first = np.array([a for a, _ in allowed]) + shift
    last = np.array([b for _, b in allowed]) + shift
    found = np.zeros((width, m), bool)
    for column in range(width - 1, -1, -1):
        key = group[order] + table[column, order]
        put = np.argsort(key, kind="stable")
        key, order = key[put], order[put]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % (end + 1) != end))
        fresh = np.zeros(m + 1, np.int32)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[::2], between[1::2] = put[same] + 1, put[same + 1] + 1
            fresh[same + 1] = np.minimum.reduceat(common, between)[::2] + 1
        common = fresh
        repeated = order[np.maximum(common[:-1], common[1:]) >= span]
        found[column, repeated] = (first[repeated] <= column) & (column <= last[repeated])
    return [
        [(int(a - s), int(b - s)) for a, b in _runs(found[:, i])] for i, s in zip(range(m), shift)
    ]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(docs[id_col].alias("key"), text_bytes(text_col).alias("text"))
    return source.withColumn("digest", F.md5("text"))


def _scan(source: DataFrame, span: int, gram: int) -> DataFrame:
    """One row per text: its anchors, and what it repeats by itself."""
    kind = source.schema["key"].dataType.simpleString()

    def make():
        def work(rows):
            for key, digest, text in zip(rows["key"], rows["digest"], rows["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                own = Windows(raw, span, gram)
                cut = spans(_runs(own.twice), span)
                rest = hashlib.sha256(without(raw, cut)).hexdigest()
                yield key, digest, len(raw), np.unique(own.marks).tolist(), as_rows(cut), rest

        return work

    return map_rows(
        source,
        f"key {kind}, digest string, n_bytes bigint, marks array<bigint>, cut {STEPS}, rest string",
        make,
    )


def as_rows(pairs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"a": a, "b": b} for a, b in pairs]


def _contexts(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """The contexts of anchors that occur in another text too."""

    def make():
        def work(rows):
            for digest, text, marks in zip(rows["digest"], rows["text"], rows["marks"]):
                raw = text.encode("utf-8", "surrogatepass")
                for mark, at, a, b in Windows(raw, span, gram).contexts(set(marks)):
                    body = raw[a : b + span]
                    yield mark, hashlib.md5(body).digest(), digest, a, at - a, body

        return work

    return map_rows(
        texts,
        "mark bigint, name binary, digest string, start int, offset int, body binary",
        make,
    )


NODE = "group bigint, mark bigint, name binary, offset int, body binary, a int, b int, low int, high int"
FOUND = f"mark bigint, name binary, runs {STEPS}"


def _halves(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes of both halves of the places, grouped by what all windows of a half hold."""

    def make():
        def work(rows):
            for row in zip(*(rows[c] for c in ("mark", "name", "offset", "body", "a", "b", "low", "high"))):
                mark, name, offset, body, a, b, low, high = row
                middle = (low + high) // 2
                for lower, upper in ((low, middle), (middle + 1, high)):
                    first, last = max(a, lower + offset), min(b, upper + offset)
                    if first > last:
                        continue
                    core = body[upper + offset : lower + offset + span]
                    key = hashlib.md5(b"%d %d %d " % (mark, lower, upper) + core).digest()
                    group = int.from_bytes(key[:8], "little", signed=True)
                    yield group, mark, name, offset, body, first, last, lower, upper

        return work

    return map_rows(nodes, NODE, make)


def _sorted(nodes: DataFrame, span: int) -> DataFrame:
    """Repeated windows of groups that one task can sort, several groups at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(FOUND))

    def solve(rows: list[dict]) -> pa.RecordBatch:
        found = shared_windows(
            np.array([r["group"] for r in rows]),
            [r["body"] for r in rows],
            [r["offset"] for r in rows],
            [(r["a"], r["b"]) for r in rows],
            span,
        )
        hit = [(r["mark"], r["name"], as_rows(f)) for r, f in zip(rows, found) if f]
        columns = list(zip(*hit)) or [(), (), ()]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, target)]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= BLOCK and row["group"] != held[-1]["group"]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return map_batches(nodes.repartition("group").sortWithinPartitions("group"), run, FOUND)


def _sized(nodes: DataFrame, passing: list[str]) -> DataFrame:
    """Nodes with the number of contexts of their group; those alone are left out."""
    # counted on its own, so that the join is free to split the rows of a crowded group
    sizes = stage(nodes.groupBy("group").agg(F.count("*").alias("members")).where("members > 1"), passing)
    return stage(nodes.join(sizes.hint("merge"), "group"), passing)


def _distinct(contexts: DataFrame, passing: list[str]) -> DataFrame:
    """Each different context once, and whether texts share it whole."""
    text = F.xxhash64("digest")
    return stage(
        contexts.groupBy("mark", "name").agg(
            (F.min(text) < F.max(text)).alias("whole"),
            F.first("offset").alias("offset"),
            F.first("body").alias("body"),
        ),
        passing,
    )


def _compare(distinct: DataFrame, span: int, gram: int, taken: list[str], passing: list[str]) -> DataFrame:
    """``mark, name, runs``: which windows of each different context occur in another text.

    The copies listed in ``taken``, those of the contexts, are removed as soon as they have been read.
    """
    last = (F.octet_length("body") - span).alias("b")
    zero = F.lit(0)
    whole = distinct.where("whole").select(
        "mark", "name", F.array(F.struct(zero.alias("a"), last)).alias("runs")
    )
    nodes = distinct.select(
        F.col("mark").alias("group"), "mark", "name", "offset", "body", zero.alias("a"), last,
        F.lit(gram - span).alias("low"), zero.alias("high"),
    )
    nodes = _sized(nodes, passing)
    found = [stage(whole, passing)]
    release(distinct.sparkSession, taken)
    while True:
        found.append(_sorted(nodes.where(F.col("members") <= BLOCK).drop("members"), span))
        crowded = nodes.where(F.col("members") > BLOCK)
        if crowded.isEmpty():
            break
        nodes = _sized(stage(_halves(crowded, span), passing), passing)
        single = F.col("low") == F.col("high")
        runs = F.array(F.struct("a", "b")).alias("runs")
        found.append(nodes.where(single).select("mark", "name", runs))
        nodes = nodes.where(~single)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def joined(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs, half open, as maximal runs."""
    return spans([(a, b) for a, b in cuts], 0)


def analyse(
    docs: DataFrame, id_col: str, text_col: str, span: int = SPAN, gram: int = GRAM
) -> tuple[DataFrame, DataFrame]:
    """A slim row per document, and per repeated text what is removed of it.

    The first has ``key, digest, n_bytes, cut, rest`` of what each text repeats by itself, the
    second ``digest, copies, all_cut, all_rest`` where other texts add to that.
    """
    source = _source(docs, id_col, text_col)
    scan = stage(_scan(source, span, gram))
    marks = scan.select("digest", F.explode("marks").alias("mark"))
    text = F.xxhash64("digest")
    shared = marks.groupBy("mark").agg(F.min(text).alias("low"), F.max(text).alias("high"))
    # merged, as all that grows with the texts: what comes out of an explode is taken for few rows and broadcast
    met = marks.join(shared.where("low < high").select("mark").hint("merge"), "mark")
    copies = scan.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("key").alias("rep"), F.first("cut").alias("cut")
    )
    wanted = (
        met.groupBy("digest").agg(F.collect_set("mark").alias("marks")).join(copies.hint("merge"), "digest")
    ).select(F.col("digest").alias("wanted"), "rep", "cut", "marks")
    wanted = wanted.hint("merge")  # one plan for every size
    one = (F.col("digest") == F.col("wanted")) & F.col("key").eqNullSafe(F.col("rep"))
    # copies that are removed as soon as nothing reads them: texts and contexts take more room than the input
    spark, whole, parts, passing = docs.sparkSession, [], [], []
    texts = stage(source.join(wanted, one).select("digest", "text", "cut", "marks"), passing)
    contexts = stage(_contexts(texts, span, gram), whole)
    distinct = _distinct(contexts, parts)
    starts = stage(contexts.select("mark", "name", "digest", "start"), passing)
    release(spark, whole)
    starts = starts.join(_compare(distinct, span, gram, parts, passing).hint("merge"), ["mark", "name"])
    run = F.explode("runs").alias("run")
    cross = (
        starts.select("digest", "start", run)
        .groupBy("digest")
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("start") + F.col("run.a")).alias("a"),
                    (F.col("start") + F.col("run.b") + span).alias("b"),
                )
            ).alias("met")
        )
    )

    def make():
        def work(rows):
            for digest, text, own, met in zip(*(rows[c] for c in ("digest", "text", "cut", "met"))):
                raw = text.encode("utf-8", "surrogatepass")
                cut = joined([(r["a"], r["b"]) for r in own + met])
                yield digest, as_rows(cut), hashlib.sha256(without(raw, cut)).hexdigest()

        return work

    resolved = map_rows(
        texts.join(cross.hint("merge"), "digest").select("digest", "text", "cut", "met"),
        f"digest string, all_cut {STEPS}, all_rest string",
        make,
    ).dropDuplicates(["digest"])
    repeated = copies.where("copies > 1").select("digest", "copies")
    facts = stage(repeated.join(resolved, "digest", "full"))
    release(spark, passing)
    return scan, facts


def report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    scan, facts = analyse(docs, id_col, text_col, span, gram)
    rows = scan.drop("marks").join(facts, "digest", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= span)
    cut = F.coalesce("all_cut", "cut")
    removed = F.aggregate(cut, F.lit(0), lambda n, r: n + r["b"] - r["a"]).cast("bigint")
    return rows.select(
        F.col("key").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(removed).alias("n_removed"),
        F.when(gone, 1).otherwise(F.size(cut)).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("all_rest", "rest")).alias("kept_sha256"),
    )


def _cuts(scan: DataFrame, facts: DataFrame) -> DataFrame:
    """``digest, cut, copied``: what goes of each text, and whether it occurs twice as a whole."""
    own = scan.where(F.size("cut") > 0).select("digest", "cut").dropDuplicates(["digest"])
    return facts.join(own, "digest", "full").select(
        "digest",
        F.coalesce("all_cut", "cut", F.array().cast(STEPS)).alias("cut"),
        F.col("copies").isNotNull().alias("copied"),
    )


def cut(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """The documents, all columns, with texts freed of their repeated bytes.

    A character of which only some bytes are removed goes as a whole; null texts stay null.
    """
    facts = _cuts(*analyse(docs, id_col, text_col, span, gram))

    @F.pandas_udf("string")
    def freed(texts: pd.Series, cuts: pd.Series, copied: pd.Series) -> pd.Series:
        def one(text, cut, twice):
            if text is None or cut is None:
                return text
            raw = text.encode("utf-8", "surrogatepass")
            runs = [(0, len(raw))] if twice and len(raw) >= span else [(r["a"], r["b"]) for r in cut]
            return without(raw, runs).decode("utf-8", "ignore") if runs else text

        return pd.Series([one(*r) for r in zip(texts, cuts, copied)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.md5(text_bytes(text_col)).alias("digest"))
    text = F.col(f"row.{text_col}")
    rows = rows.join(facts.hint("merge"), "digest", "left").select(
        F.col("row").withField(text_col, freed(text, "cut", "copied")).alias("row")
    )
    return rows.select("row.*")


class Coder:
    """Texts as strings of ``CODE`` letters a word, so that runs of words are strings of bytes."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def code(self, text: str | None) -> str:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if len(self.known) > CODED_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            digest = hashlib.blake2b(word, digest_size=CODE * 3 // 4).digest()
            self.known[word] = base64.b64encode(digest)
        return b"".join(map(self.known.__getitem__, words)).decode("ascii")


def without_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words, each with the blanks after it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    kept, at = [], 0
    for first, after in runs:
        kept.append(text[at : starts[first]])
        at = starts[after]
    return "".join(kept) + text[at:]


def cut_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
) -> DataFrame:
    """The documents, all columns, with texts freed of runs of ``words`` words that occur elsewhere.

    Words are runs between ASCII blanks, compared as they are; the blanks between them do not
    count. Every occurrence goes, in the same document too, as in :func:`report`. A word is
    coded by ``CODE`` letters, so a run of words is a string of that many letters, and the
    strings are found like passages of bytes. Texts of fewer words, and null texts, stay.
    """
    source = docs.select(docs[id_col].alias("key"), F.col(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def make():
        coder = Coder()

        def work(rows):
            for key, text in zip(rows["key"], rows["text"]):
                yield key, coder.code(text)

        return work

    coded = map_rows(source, f"key {kind}, code string", make)
    span = CODE * words
    facts = _cuts(*analyse(coded, "key", "code", span, GRAM))

    @F.pandas_udf("string")
    def named(texts: pd.Series) -> pd.Series:
        coder = Coder()
        return texts.map(lambda t: hashlib.md5(coder.code(t).encode()).hexdigest())

    @F.pandas_udf("string")
    def freed(texts: pd.Series, cuts: pd.Series, copied: pd.Series) -> pd.Series:
        def one(text, cut, twice):
            if text is None or cut is None:
                return text
            # ends that agree by part of a word's code are no words
            runs = [(-(-r["a"] // CODE), r["b"] // CODE) for r in cut]
            if twice and len(found := text.encode("utf-8", "surrogatepass").split()) >= words:
                runs = [(0, len(found))]
            return without_words(text, [r for r in runs if r[1] > r[0]]) if runs else text

        return pd.Series([one(*r) for r in zip(texts, cuts, copied)], dtype=object)

    rows = docs.select(F.struct("*").alias("row"), named(docs[text_col]).alias("digest"))
    text = F.col(f"row.{text_col}")
    rows = rows.join(facts.hint("merge"), "digest", "left").select(
        F.col("row").withField(text_col, freed(text, "cut", "copied")).alias("row")
    )
    return rows.select("row.*")
