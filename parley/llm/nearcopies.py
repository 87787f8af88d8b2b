"""Near-duplicate documents: an LSH forest of MinHash signatures, confirmed on full sets.

Every distinct set of word shingles gets a signature. Each tree of the forest is an order of
the signature's values; sets that share the first ``DEPTH`` values of an order form a region of
that tree. A region with more than ``CROWD`` members is parted by the next value, again and
again, so its depth adapts to how crowded it is. Inside a region the members lie in the sorted
order of their signatures, all are neighbours by their common prefix, and those whose whole
signatures agree in ``LOOSE`` of the values are joined.

The joined sets form loose groups. In these, links are confirmed on the full sets, the most
alike first, and pairs already linked through others are skipped: only components are asked for.
Groups of more than ``CROWD`` sets are worked off in blocks: all against some centres, then
those outside the largest component against all.

The parts of a crowded region meet once their own links are known: of its members, those outside
its largest loose group are compared with all others, in blocks that tasks share. So any two sets
of one region at ``DEPTH`` are compared or already linked, whatever its size, and a pair at the
threshold of 0.8 is missed by all 32 trees with a chance of 3 in a million.

Rows: every input row gives one output row. Equal sets are linked, repeated rows included.
Rows that share an id are one document and are linked with each other. A null or empty text
has no shingles and is linked with nothing. Rows without an id are linked with nothing, have
no component, and are not ``kept``. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import map_rows, solve_groups, text_bytes
from parley.llm.components import components
from parley.session import stage

TREES, DEPTH = 32, 5
HASHES = TREES * DEPTH
DEEPEST = 40  # values of a region's prefix at most
LOOSE = 0.65  # share of equal values that makes a candidate; four deviations below 0.8
CROWD = 2048  # members that one task compares
BLOCK = 512  # members of a block of a crowded group
SEAM = 8192  # members of a block of a crowded region, of whom only signatures travel
CENTRES = 16
PERCENT = 80  # of the union that two linked sets share
WORDS = 2
ORDER = ["sketch", "node"]  # inside a region: the sorted order of signatures
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd multipliers of 64-bit mixers
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, and their signatures."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        draw = np.random.default_rng(7).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64)
        self.times, self.plus = draw[0] | np.uint64(1), draw[1]

    def shingles(self, text: str) -> np.ndarray:
        """Lower-case A-Z, words between ASCII blanks, runs of words; the whole if shorter."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        for word in set(words).difference(self.known):
            digest = hashlib.blake2b(word, digest_size=8).digest()
            self.known[word] = int.from_bytes(digest, "little")
        codes = np.array([self.known[w] for w in words], np.uint64)
        size = min(self.words, len(words))
        runs = codes[: len(codes) - size + 1] * ODD + np.uint64(size)
        for k in range(1, size):
            mixed = (runs ^ (runs >> np.uint64(29))) * ODD2
            runs = mixed + codes[k : len(codes) - size + 1 + k]
        runs = (runs ^ (runs >> np.uint64(32))) * ODD
        return np.unique(runs)

    def signature(self, shingles: np.ndarray) -> bytes:
        """The upper 16 bits of each least hash, big-endian, so that bytes sort as values."""
        least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(shingles), 4096):
            part = shingles[start : start + 4096, None]
            least = np.minimum(least, (part * self.times + self.plus).min(0))
        mixed = (least ^ (least >> np.uint64(31))) * ODD
        return (mixed >> np.uint64(48)).astype(">u2").tobytes()


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    source = docs.select(docs[id_col].alias("key"), text_bytes(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def make():
        shingler = Shingler(words)

        def work(rows):
            for key, text in zip(rows["key"], rows["text"]):
                own = shingler.shingles(text)
                digest = hashlib.md5(own.tobytes()).digest()
                yield key, len(own), digest, shingler.signature(own) if len(own) else None

        return work

    return map_rows(source, f"key {kind}, size bigint, digest binary, sketch binary", make)


def _prefix(depth: int):
    """Name of a row's region at a depth: the tree, and the first values of its order."""
    at = 2 * DEPTH * F.col("tree")
    turned = F.concat(
        F.substring("sketch", at + 1, F.lit(2 * depth)), F.substring("sketch", F.lit(1), F.lit(2 * depth))
    )
    return F.xxhash64("tree", F.lit(depth), F.substring(turned, 1, 2 * depth))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of regions with two members or more, with their number."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    # merged at any size: the planner takes rows that come out of an explode for few, and would broadcast them
    return rows.join(sizes.hint("merge"), "region")


def _regions(sets: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``region, node`` rows of regions of bearable size, links of regions at the bottom, and the crowded regions."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = sets.select("node", "sketch", trees).select("node", "tree", _prefix(DEPTH).alias("region"))
    rows = stage(_counted(rows))
    done, bottom, depth = [rows.where(F.col("n") <= CROWD)], None, DEPTH
    parted = rows.where(F.col("n") > CROWD).select("region", "node", "n")
    while True:
        crowded = rows.where(F.col("n") > CROWD)
        if crowded.isEmpty():
            break
        if depth == DEEPEST:
            first = crowded.groupBy("region").agg(F.min("node").alias("b"))
            bottom = crowded.join(first.hint("merge"), "region").select(F.col("node").alias("a"), "b")
            break
        depth += 1
        deeper = crowded.select("node", "tree").join(sets.select("node", "sketch").hint("merge"), "node")
        rows = stage(_counted(deeper.select("node", "tree", _prefix(depth).alias("region"))))
        done.append(rows.where(F.col("n") <= CROWD))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("region", "node"), bottom, parted if depth > DEPTH else None


class Union:
    """Components of numbered things."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = i = self.above[self.above[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.above[max(i, j)] = min(i, j)
        return i != j


def alike(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of signature rows that agree in ``LOOSE`` of their values, and in how many."""
    rows, columns, counts = [], [], []
    step = max(1, (1 << 24) // max(1, right.size))
    for start in range(0, len(left), step):
        same = (left[start : start + step, None, :] == right[None, :, :]).sum(2)
        i, j = np.nonzero(same >= LOOSE * HASHES)
        rows.append(i + start)
        columns.append(j)
        counts.append(same[i, j])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(counts)


def _sketches(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["sketch"] for r in rows), ">u2").reshape(len(rows), HASHES)


def _loose(members: DataFrame, kind: str) -> DataFrame:
    """Links that span what is alike in each region."""

    def solve(rows):
        if len(rows) < 2:
            return
        sketches = _sketches(rows)
        if len(rows) == 2:
            if (sketches[0] == sketches[1]).sum() >= LOOSE * HASHES:
                yield rows[0]["node"], rows[1]["node"]
            return
        found = Union(len(rows))
        left, right, _ = alike(sketches, sketches)
        for i, j in zip(left.tolist(), right.tolist()):
            if i < j and found.join(i, j):
                yield rows[i]["node"], rows[j]["node"]

    return solve_groups(members, ["region"], ORDER, f"a {kind}, b {kind}", solve)


def _seams(parted: DataFrame, signed: DataFrame, groups: DataFrame, kind: str) -> DataFrame:
    """Loose links between the parts of crowded regions: what is outside the largest loose group against all."""
    found = groups.select("node", F.col("root").alias("part")).hint("merge")
    held = parted.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    held = stage(held)
    sizes = held.groupBy("region", "part").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("region").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("n"))
    # a row for each crowded region, of more than CROWD rows each
    heaps = F.ceil((F.col("n") - F.col("top.size")) / SEAM).cast("int").alias("heaps")
    plan = stage(largest.where("n > top.size").select("region", F.col("top.part").alias("top"), heaps))
    blocks = F.ceil(F.col("n") / SEAM).cast("int")
    marked = held.join(F.broadcast(plan), "region").withColumn("blocks", blocks)
    marked = marked.join(signed.select("node", "sketch").hint("merge"), "node")
    columns = ["region", "node", "sketch", "part"]
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    heap = F.pmod(F.xxhash64("node", F.lit(1)), F.col("heaps")).cast("int").alias("heap")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    every_heap = F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)).alias("heap")
    pairs = marked.select(*columns, block, every_heap, F.lit(False).alias("stray")).unionByName(
        marked.where("part <> top").select(*columns, every_block, heap, F.lit(True).alias("stray"))
    )

    def solve(rows):
        known, found = {}, Union(len(rows))
        for i, r in enumerate(rows):
            found.join(i, known.setdefault(r["part"], i))
        stray = [i for i, r in enumerate(rows) if r["stray"]]
        others = [i for i, r in enumerate(rows) if not r["stray"]]
        if not stray or not others:
            return
        sketches = _sketches(rows)
        left, right, _ = alike(sketches[stray], sketches[others])
        for i, j in zip(left.tolist(), right.tolist()):
            i, j = stray[i], others[j]
            if found.join(i, j):
                yield rows[i]["node"], rows[j]["node"]

    return solve_groups(pairs, ["region", "block", "heap"], ORDER, f"a {kind}, b {kind}", solve)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(rows: list[dict], left: list[int], right: list[int], percent: int, found: Union):
    """Confirmed links between rows that are not linked through others, most alike first."""
    sketches = _sketches(rows)
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    i, j, same = alike(sketches[left], sketches[right])
    i, j = np.array(left)[i], np.array(right)[j]
    order = np.argsort(-same, kind="stable")
    i, j = i[order], j[order]
    while len(i):
        for a, b in zip(i[:1000].tolist(), j[:1000].tolist()):
            if found.root(a) != found.root(b) and linked(sets[a], sets[b], percent):
                found.join(a, b)
                yield rows[a]["node"], rows[b]["node"]
        i, j = i[1000:], j[1000:]
        roots = np.array([found.root(k) for k in range(len(rows))])
        apart = roots[i] != roots[j]
        i, j = i[apart], j[apart]


def _confirmed(members: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links of every loose group, on full sets."""
    schema = f"a {kind}, b {kind}"

    def whole(rows):
        every = list(range(len(rows)))
        yield from _confirm(rows, every, every, percent, Union(len(rows)))

    small = solve_groups(members.where(F.col("n") <= CROWD), ["root"], ORDER, schema, whole)
    crowded = members.where(F.col("n") > CROWD)
    if crowded.isEmpty():
        return small
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    crowded = crowded.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    centres = crowded.withColumn("rank", rank).where(F.col("rank") <= CENTRES)
    columns = ["root", "node", "sketch", "shingles"]
    dealt = crowded.select(*columns, "block", F.lit(False).alias("centre")).unionByName(
        centres.select(*columns, all_blocks, F.lit(True).alias("centre"))
    )

    def stars(rows):
        centre = [i for i, r in enumerate(rows) if r["centre"]]
        yield from _confirm(rows, list(range(len(rows))), centre, percent, Union(len(rows)))

    first = stage(solve_groups(dealt, ["root", "block"], ORDER, schema, stars))
    found = components(first).withColumnRenamed("root", "part")
    parted = crowded.join(found.hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parted = stage(parted)
    sizes = parted.groupBy("root", "part").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("size", "part")).alias("top"))
    marked = parted.join(largest.select("root", F.col("top.part").alias("top")), "root")
    strays = marked.where("part <> top")
    counts = strays.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("heaps"))
    strays = strays.join(counts, "root").withColumn(
        "heap", F.pmod(F.xxhash64("node", F.lit(2)), F.col("heaps")).cast("int")
    )
    columns += ["part"]
    all_heaps = F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)).alias("heap")
    pairs = (
        marked.join(counts, "root")
        .select(*columns, "block", all_heaps, F.lit(False).alias("stray"))
        .unionByName(strays.select(*columns, all_blocks, "heap", F.lit(True).alias("stray")))
    )

    def rest(rows):
        known, found = {}, Union(len(rows))
        for i, r in enumerate(rows):
            found.join(i, known.setdefault(r["part"], i))
        stray = [i for i, r in enumerate(rows) if r["stray"]]
        others = [i for i, r in enumerate(rows) if not r["stray"]]
        if stray and others:
            yield from _confirm(rows, stray, others, percent, found)

    second = solve_groups(pairs, ["root", "block", "heap"], ORDER, schema, rest)
    return small.unionByName(first).unionByName(second)


def components_of(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every document."""
    rows = stage(_signatures(docs, id_col, text_col, words))
    kind = rows.schema["key"].dataType.simpleString()
    # sets are named by the least id that has them
    sets = rows.where("size > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("node"))
    sets = stage(sets)
    own = rows.select("digest", F.col("key").alias("node"), "sketch").where("sketch is not null")
    # all tables that grow with the documents are merged: one plan for every size, and nothing on the driver
    signed = stage(own.join(sets.hint("merge"), ["digest", "node"], "left_semi").dropDuplicates(["digest"]))
    regions, bottom, parted = _regions(signed)
    members = regions.join(signed.select("node", "sketch").hint("merge"), "node")
    loose = _loose(members, kind)
    groups = components(loose if bottom is None else loose.unionByName(bottom))
    groups = stage(groups)
    if parted is not None:
        seams = _seams(parted, signed, groups, kind)
        again = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
        groups = stage(components(again.unionByName(seams)))
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    held = groups.join(sizes, "root").join(signed.hint("merge"), "node")

    def make():
        shingler = Shingler(words)

        def work(batch):
            for *own, text in zip(*(batch[c] for c in ("root", "n", "node", "sketch", "text"))):
                yield (*own, shingler.shingles(text).tobytes())

        return work

    texts = docs.select(docs[id_col].alias("node"), text_bytes(text_col).alias("text"))
    held = held.select("root", "n", "node", "sketch").hint("merge").join(texts, "node")
    full = map_rows(
        held, f"root {kind}, n bigint, node {kind}, sketch binary, shingles binary", make
    )
    links = _confirmed(stage(full), kind, percent)
    # rows that share an id are one document
    named = rows.where("size > 0").join(sets.hint("merge"), "digest").select("key", "node")
    again = named.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    again = named.join(again.where("a <> b").hint("merge"), "key").select("a", F.col("node").alias("b"))
    found = components(links.unionByName(again))
    placed = sets.join(found.hint("merge"), "node", "left").select(
        "digest", F.coalesce("root", "node").alias("component")
    )
    nothing = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return rows.join(placed.hint("merge"), "digest", "left").select(
        F.col("key").alias(id_col),
        F.col("size").alias("n_shingles"),
        nothing.alias("component_id"),
        F.coalesce(F.col("key") == nothing, F.lit(False)).alias("kept"),
    )


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """One document of each group, all columns; documents without an id all stay.

    Of rows that repeat an id, the one with the greatest text stays.
    """
    verdicts = components_of(docs, id_col, text_col, words, percent)
    kept = stage(verdicts.where("kept").groupBy(id_col).agg(F.count("*").alias("times")))
    kept = kept.withColumnRenamed(id_col, "kept_id").withColumnRenamed("times", "kept_times")
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("own_id"))
    found = rows.join(kept.hint("merge"), rows["own_id"] == kept["kept_id"], "left").where(
        "kept_id is not null or own_id is null"
    )
    if not kept.where("kept_times > 1").isEmpty():
        order = W.partitionBy("own_id").orderBy(F.desc(f"row.{text_col}"))
        found = found.withColumn("turn", F.row_number().over(order))
        found = found.where("own_id is null or turn = 1")
    return found.select("row.*")


#: The same rows in SQL: all pairs that share a shingle, and the transitive links.
ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS l
    FROM doc WHERE len(w) > 0), unnest(l) AS t(s)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS doc_id, a AS other FROM edge
  UNION
  SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""
