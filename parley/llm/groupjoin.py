"""N-gram Jaccard join by a token-group matrix: only groups that can hold a partner are opened.

Every distinct set of word shingles has a short signature. Sets that agree in any of ``TREES`` stretches of
it meet in a bucket, and those whose whole signatures are alike are partitioned into one group. Inside a
group full sets are compared, and what links becomes a part of the group; sets without a partner are
parts of one. A group is cut into blocks of about ``GROUP`` sets: a large part has blocks of its own,
small parts lie in blocks together.

The matrix has a row for each bundle of tokens and block that holds it. A set is cut into bundles by
the hashes of its tokens, one more than there are tokens by which two sets of its size may differ and
still link; so two that link have at least one whole bundle in common. The number of bundles follows from
a class of sizes: a set has the bundles of each class that a partner no smaller can be of. About nine tokens
make a bundle, so a passage or line that many sets share brings hardly any two of them together;
bundles that one part alone holds are not stored. A set that meets a block of the
matrix with another part in it is dealt to it. There the overlap with the whole union of the block bounds the
overlap with each member; below nine tenths of the set the block stays closed, otherwise the overlaps
with all members are counted from the union's tokens and their holders, on full sets.

Links are those on full sets, and the matrix alone finds all of them; signatures only decide which
sets are compared first. Full sets are only made of documents that share a bundle, in a second pass over
their texts.

Rows: every input row gives one output row. Equal sets are linked, repeated rows included.
Rows that share an id are one document and are linked with each other. A null or empty text
has no shingles and is linked with nothing. Rows without an id are linked with nothing and
have no component. Shingles and sets are compared by hashes of 64 and 128 bits. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import Known, map_batches, map_rows, solve_groups, text_bytes, worker_kept
from parley.llm.components import components
from parley.llm.nearcopies import Union, linked
from parley.session import stage

WORDS = 3
PERCENT = 90  # of the union that two linked sets share
SIGNED = 32  # values of a signature
TREES, KEY = 6, 2  # stretches of a signature that name its buckets, and the values of each
LOOSE = 18  # equal values of two signatures that are compared inside a group
GROUP = 256  # sets of a block
CLASS = 5, 4  # the ratio of the least sizes of neighbouring classes
CENTRES = 8  # sets of a crowded group that all its blocks hold
QUERIES = 512  # sets that are looked up in a block by one task
WORDS_KEPT = 300_000  # words whose hashes a worker remembers, in two generations
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers of 64-bit mixers
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def needed(size, percent: int):
    """Tokens that a set of a size shares at least with any that it links with."""
    return (percent * size + 99) // 100


def classes() -> list[int]:
    """The least size of each class of sizes."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, least[-1] * CLASS[0] // CLASS[1]))
    return least


LEAST_SIZES = classes()


class Sets:
    """Shingle sets with their names and signatures."""

    def __init__(self, words: int):
        self.words = words
        self.known = Known(WORDS_KEPT, lambda word: int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        draw = np.random.default_rng(11).integers(1, 1 << 63, (2, SIGNED), dtype=np.uint64)
        self.times, self.plus = draw[0] | np.uint64(1), draw[1]
        self.known_edges: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def shared(cls, words: int) -> Sets:
        return worker_kept(f"shingle sets {words}", lambda: cls(words))

    def codes(self, text: str) -> np.ndarray:
        """Hashes of the words between ASCII blanks, A-Z in lower case."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def runs(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of all runs of words, the whole if there are fewer."""
        size = min(self.words, len(codes))
        places = len(codes) - size + 1 if size else 0
        runs = codes[:places] * ODD + np.uint64(size)
        for k in range(1, size):
            runs = (runs ^ (runs >> np.uint64(29))) * ODD2 + codes[k : places + k]
        return (runs ^ (runs >> np.uint64(32))) * ODD

    def shingles(self, text: str) -> np.ndarray:
        return np.unique(self.runs(self.codes(text)))

    def edges(self, number: int, percent: int) -> np.ndarray:
        """Least tokens of the bundles of a class: one more than the tokens by which two that link differ."""
        known = self.known_edges.get((number, percent))
        if known is None:
            most = LEAST_SIZES[number + 1] - 1
            count = (100 - percent) * 2 * most // (100 + percent) + 1
            known = np.array([(j << 64) // count for j in range(count)], np.uint64)
            self.known_edges[number, percent] = known
        return known

    def bundles(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Hashes of the bundles of a set; any that it links with has one of them at least."""
        first = bisect_right(LEAST_SIZES, len(own)) - 1
        sums = np.concatenate(([np.uint64(0)], np.cumsum((own ^ (own >> np.uint64(29))) * ODD2)))
        out = []
        for number in range(first, bisect_right(LEAST_SIZES, 100 * len(own) // percent)):
            edges = self.edges(number, percent)
            at = np.append(np.searchsorted(own, edges), len(own))
            out.append((np.diff(sums[at]) ^ (edges + np.uint64(number))) * ODD)
        keys = np.concatenate(out)
        return keys ^ (keys >> np.uint64(32))

    def signature(self, own: np.ndarray) -> bytes:
        least = np.full(SIGNED, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(own), 1 << 14):
            part = own[start : start + (1 << 14), None]
            least = np.minimum(least, (part * self.times + self.plus).min(0))
        return ((least * ODD) >> np.uint64(48)).astype(">u2").tobytes()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_bytes(text_col)
    return docs.select(docs[id_col].alias("key"), text.alias("text"), F.md5(text).alias("name"))


def _scan(source: DataFrame, words: int, percent: int) -> DataFrame:
    """A slim row per document, with the bundles of its set."""
    kind = source.schema["key"].dataType.simpleString()

    def make():
        sets = Sets.shared(words)

        def work(rows):
            for key, text, name in zip(rows["key"], rows["text"], rows["name"]):
                own = sets.shingles(text)
                sid = hashlib.md5(own.tobytes()).digest()
                if len(own):
                    bundles = sets.bundles(own, percent).astype(np.int64)
                    yield key, name, len(own), sid, sets.signature(own), bundles
                else:
                    yield key, name, 0, sid, None, None

        return work

    schema = f"key {kind}, name string, size bigint, sid binary, sketch binary, bundles array<bigint>"
    return map_rows(source, schema, make)


def _held_twice(rows: DataFrame) -> DataFrame:
    """``token, sid`` rows, different ones, whose token more than one set holds."""
    names = ["token", "sid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False  # the last row, and whether its token is known to be shared
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if last is not None:
                table = pa.concat_tables([last, table])
            tokens = table.column(0).to_numpy()
            same = tokens[1:] == tokens[:-1]
            keep = np.append(same, False) | np.append(False, same)
            if last is not None:
                first = keep[0] and not told
                told = (told or bool(keep[0])) if len(tokens) > 1 and bool(same.all()) else bool(same[-1])
                keep[0] = first
            else:
                told = bool(same[-1]) if len(same) else False
            # the last row is looked at again with the next batch, unless it goes out now
            last = table.slice(table.num_rows - 1)
            out = table.filter(pa.array(keep)).combine_chunks()
            yield from out.to_batches()

    dealt = rows.select(*names).repartition("token").sortWithinPartitions("token")
    return map_batches(dealt, run, rows.select(*names).schema)


def _shared(rows: DataFrame, of: Column) -> DataFrame:
    """Rows whose token more than one thing holds."""
    ends = rows.groupBy("token").agg(F.min(of).alias("low"), F.max(of).alias("high"))
    return rows.join(ends.where("low <> high").select("token"), "token")


def _pairs(placed: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """``sid, group, block``: sets that meet a block with sets of another part in the matrix.

    Of two sets in different blocks, that of the greater block asks.
    """
    tokens = stage(_shared(held.join(placed, "sid"), F.col("part")))
    matrix = tokens.groupBy("token", "group", "block").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    asking = tokens.select("token", "sid", "size", "part", F.struct("group", "block").alias("own"))
    fits = (100 * F.col("most") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("least"))
    apart = (F.col("low") != F.col("part")) | (F.col("high") != F.col("part"))
    met = asking.join(matrix, "token").where((F.struct("group", "block") <= F.col("own")) & apart & fits)
    return met.select("sid", "group", "block").distinct()


def _dealt(pairs: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks with the sets that ask them, some at a time: rows of ``group, block, heap``."""
    loads = pairs.groupBy("group", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("heaps"))
    loads = stage(loads)
    own = F.pmod(F.xxhash64("sid", F.lit(2)), F.col("heaps")).cast("int").alias("heap")
    every = F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)).alias("heap")
    asking = pairs.join(loads, ["group", "block"]).select("group", "block", "sid", own, F.lit(True).alias("asks"))
    held = blocks.join(loads, ["group", "block"]).select("group", "block", "sid", every, F.lit(False).alias("asks"))
    return asking.unionByName(held).join(sets, "sid")


def _in_blocks(members: DataFrame, name: str) -> DataFrame:
    """``name, block, sid`` of all that have a partner of that name; some of a crowded one are in all its blocks."""
    crowd = members.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")
    members = members.select(name, "sid").join(crowd, name)
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    rank = F.row_number().over(W.partitionBy(name).orderBy(F.xxhash64("sid", F.lit(1)), "sid"))
    centres = members.where(F.col("n") > GROUP).withColumn("rank", rank).where(F.col("rank") <= CENTRES)
    every = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    return members.select(name, "sid", own.alias("block")).unionByName(centres.select(name, "sid", every))


def _agreeing(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose signatures are alike, the most alike first."""
    sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), ">u2").reshape(len(rows), SIGNED)
    same = (sketches[:, None, :] == sketches[None, :, :]).sum(2)
    left, right = np.nonzero(np.triu(same >= LOOSE, 1))
    order = np.argsort(-same[left, right], kind="stable")
    return left[order], right[order]


def _partition(sets: DataFrame) -> DataFrame:
    """``sid, loose``: the group of every set that has alike ones, by signatures alone."""

    def solve(rows: list[dict]) -> Iterator[tuple]:
        if len(rows) > 1:
            found = Union(len(rows))
            for i, j in zip(*(side.tolist() for side in _agreeing(rows))):
                if found.join(i, j):
                    yield rows[i]["sid"], rows[j]["sid"]

    stretches = [
        F.xxhash64(F.lit(t), F.substring("sketch", 2 * KEY * t + 1, 2 * KEY)) for t in range(TREES)
    ]
    buckets = _in_blocks(sets.select("sid", F.explode(F.array(*stretches)).alias("bucket")), "bucket")
    dealt = buckets.join(sets.select("sid", "sketch"), "sid")
    links = solve_groups(dealt, ["bucket", "block"], ["sid"], "a binary, b binary", solve)
    return components(links).select(F.col("node").alias("sid"), F.col("root").alias("loose"))


def _grouped(loose: DataFrame, sets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups of alike signatures, on full sets."""

    def solve(rows: list[dict]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        tokens = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
        found = Union(len(rows))
        for i, j in zip(*(side.tolist() for side in _agreeing(rows))):
            if found.root(i) != found.root(j) and linked(tokens[i], tokens[j], percent):
                found.join(i, j)
                yield rows[i]["sid"], rows[j]["sid"]

    bodies = full.select("sid", "tokens").join(sets.select("sid", "sketch"), "sid")
    dealt = _in_blocks(loose, "loose").join(bodies, "sid")
    return solve_groups(dealt, ["loose", "block"], ["sid"], "a binary, b binary", solve)


def _opened(pairs: DataFrame, blocks: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links of the sets ``sid`` with the blocks that they are dealt to, enough to join what links.

    Sets of one ``part``, if full sets come with it, are linked already.
    """

    def solve(rows: list[dict]) -> Iterator[tuple]:
        sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
        members = [i for i, r in enumerate(rows) if not r["asks"]]
        if not members:
            return
        _, part = np.unique([bytes(r.get("part", r["sid"])).hex() for r in rows], return_inverse=True)
        part = part.tolist()
        found = Union(len(rows))
        sizes = np.array([len(sets[i]) for i in members])
        tokens = np.concatenate([sets[i] for i in members])
        order = np.argsort(tokens, kind="stable")
        holder = np.repeat(np.arange(len(members)), sizes)[order]
        union, first, times = np.unique(tokens[order], return_index=True, return_counts=True)
        for i, own in enumerate(sets):
            if not rows[i]["asks"]:
                continue
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            at = at[union[at] == own]
            if len(at) < needed(len(own), percent):
                continue  # no member can share enough: the block stays closed
            held = times[at]
            spots = np.repeat(first[at] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            common = np.bincount(holder[spots], minlength=len(members))
            near = 100 * common >= percent * (len(own) + sizes - common)
            for k in np.flatnonzero(near).tolist():
                if found.join(part[i], part[members[k]]):
                    yield rows[i]["sid"], rows[members[k]]["sid"]

    keys = ["group", "block", "heap"]
    return solve_groups(_dealt(pairs, blocks, full), keys, ["asks", "sid"], "a binary, b binary", solve)


def _part_of(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sid, size, group`` of every set, the group being its least linked set."""
    found = components(links)
    return sets.join(found.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "size", F.coalesce("root", "sid").alias("group")
    )


def _blocked(parts: DataFrame) -> DataFrame:
    """``sid, size, part, group, block``: groups in blocks of about ``GROUP`` sets, small parts together."""
    sizes = parts.groupBy("group", "part").agg(F.count("*").alias("n"))
    small = F.col("n") <= GROUP // 4
    rest = sizes.where(small).groupBy("group").agg(F.sum("n").alias("rest"))
    sizes = sizes.join(rest, "group", "left")
    shared = F.xxhash64(F.pmod(F.xxhash64("part"), F.ceil(F.col("rest") / GROUP)))
    own = F.xxhash64("part", F.pmod(F.xxhash64("sid"), F.ceil(F.col("n") / GROUP)))
    block = F.when(small, shared).otherwise(own).alias("block")
    return parts.join(sizes, ["group", "part"]).select("sid", "size", "part", "group", block)


def _matrix_links(sets: DataFrame, loose: DataFrame, grouped: DataFrame, held: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between parts: the token-group matrix looked up, bounded, and opened."""
    parts = _part_of(sets, grouped).withColumnRenamed("group", "part").join(loose, "sid", "left")
    parts = parts.select("sid", "size", "part", F.coalesce("loose", "sid").alias("group"))
    placed = stage(_blocked(stage(parts)))
    pairs = stage(_pairs(placed, held, percent))
    bodies = full.join(placed.select("sid", "part"), "sid")
    return _opened(pairs, placed, bodies, percent).unionByName(grouped)


def components_of(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every document: the least id that links reach."""
    source = _source(docs, id_col, text_col)
    scan = stage(_scan(source, words, percent))
    rows = scan.select("key", "name", "size", "sid", "sketch")
    first = F.min(F.struct("key", "name", "sketch", "size")).alias("first")
    sets = rows.where("size > 0 and key is not null").groupBy("sid").agg(first)
    sets = stage(sets.select("sid", "first.*"))
    named = sets.select("sid", "key", "name")
    # rows that repeat an id and its text give a set once more
    again = rows.where("size > 0").groupBy("key", "name").agg(F.count("*").alias("times")).where("times > 1")
    held = scan.where("size > 0").select("key", "name", "bundles").join(named, ["key", "name"])
    held = held.select("sid", F.explode("bundles").alias("token"))
    if not again.isEmpty():
        held = held.distinct()
    held = stage(_held_twice(held))
    wanted_sets = stage(held.select("sid").distinct())
    near = stage(sets.join(wanted_sets, "sid", "left_semi"))
    loose = stage(_partition(near))

    def make():
        sets = Sets.shared(words)

        def work(batch):
            for sid, text in zip(batch["sid"], batch["text"]):
                yield sid, sets.shingles(text).tobytes()

        return work

    # one plan for every size
    texts = named.join(wanted_sets, "sid").hint("merge").join(source, ["key", "name"])
    full = stage(map_rows(texts.select("sid", "text"), "sid binary, tokens binary", make))
    grouped = stage(_grouped(loose, near, full, percent))
    links = _matrix_links(near, loose, grouped, held, full, percent)
    # rows that share an id are one document
    held = rows.where("size > 0 and key is not null")
    again = held.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z")
    again = held.join(again, "key").select("a", F.col("sid").alias("b"))
    parts = _part_of(sets, links.unionByName(again)).join(sets.select("sid", "key"), "sid")
    least = parts.groupBy("group").agg(F.min("key").alias("component"))
    placed = parts.join(least, "group").select("sid", "component")
    own = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return rows.join(placed, "sid", "left").select(
        F.col("key").alias(id_col), F.col("size").alias("n_shingles"), own.alias("component_id")
    )


#: The same rows in SQL: all pairs that share a shingle, and the transitive links.
ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS l
    FROM doc WHERE len(w) > 0), unnest(l) AS t(s)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * k >= 90 * (x.n + y.n - k)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS doc_id, a AS other FROM edge
  UNION
  SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""
