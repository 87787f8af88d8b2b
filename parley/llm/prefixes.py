"""Prefix trie of rebuilt conversations, its totals by time-forward processing.

Turns lie in the order of a range partitioning by conversation and turn, so a conversation of any
length is dealt to many tasks. Every task hashes its stretch of a conversation; the hash of a
sequence is a polynomial in the values of its turns, so stretches compose: one row for each end of
a partition carries position and hash into the next. The hash of a rebuilt prefix follows from those
of the two conversations it is made of, and names a node of the trie.

Subtree totals travel from the leaves to the root in reverse level order: nodes are sorted by
falling depth, every node takes from a priority queue what its children sent, and sends its total to
its parent, which comes later. The queue keeps ``HELD`` messages and spills the rest as sorted runs
into the folder where Spark itself spills.

The trie is cut into shards, each a tree of at most ``LIMIT`` conversations and ``BAND`` levels,
whatever the length of a dialogue or the number of its copies. Shard roots are processed first: the
total of a shard's own nodes is a plain sum, these sums are sent along the shard roots
that lie below one cut, and from the cuts to the nodes above, which more than ``LIMIT`` conversations
share. Then each shard is processed with what arrived from below.

Rows: one row per node. A null role or text is empty. Turns of equal number are ordered by the
SHA-256 of role and text; repeated rows are turns of their own. Rows without a conversation id
are left out. An id is reduced by 20 as SQL does, towards zero. Other columns are ignored, whatever
their names. An empty table has no conversation and no node, not even a root. Prefixes are compared by
hashes of 127 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_rows, solve_groups, split
from parley.session import stage

BLOCK = 20  # conversations that share the start of the first of them
STARTS = 4  # one more than the turns they share at most
PRIME = (1 << 127) - 1  # fixed value: a Mersenne prime
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME  # fixed value: where the polynomial is taken
INVERSE = pow(BASE, -1, PRIME)
ROOT = bytes(16)  # the hash of no turns
LIMIT = 10_000  # conversations of a shard
BAND = 4096  # levels of a shard
HELD = 100_000  # messages that a queue keeps in memory
CHUNK = 1 << 18  # characters of ids that are hashed as one row
WORD = r"[^\x20\x09-\x0D]+"


def packed(value: int) -> bytes:
    return value.to_bytes(16, "big")


def number(value: bytes | None) -> int:
    return int.from_bytes(value or b"", "big")


def _stream(rows: DataFrame, schema: str, work) -> DataFrame:
    """Run a generator of output tuples over the rows of every partition, in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in split(batch) for row in zip(*(c.to_pylist() for c in part.columns)))
        held = []

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*held), target)]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for row in work(rows):
            held.append(row)
            if len(held) >= 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.mapInArrow(run, schema)


def _placed(turns: DataFrame) -> DataFrame:
    """``conv, pos, value, sofar, words, last``: the turns of every conversation with their place.

    ``sofar`` is the hash of the conversation up to the turn, ``last`` marks the last turn.
    """
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv", "digest", "words", F.spark_partition_id().alias("pid"))

    def stretches(rows):
        before, n, sofar = None, 0, 0
        for conv, digest, words, pid in rows:
            value = int(digest[:32], 16) % PRIME or 1
            if before is not None and before[1] != conv:
                yield (*before, True)
                before, n, sofar = None, 0, 0
            if before is not None:
                yield (*before, False)
            n, sofar = n + 1, (sofar * BASE + value) % PRIME
            before = pid, conv, n, packed(value), packed(sofar), words
        if before is not None:
            yield (*before, True)

    schema = "pid int, conv bigint, n bigint, value binary, sofar binary, words bigint, ends boolean"
    rows = stage(_stream(dealt, schema, stretches))

    def carried(parts: list[dict]) -> Iterator[tuple]:
        n, sofar = 0, 0
        for i, part in enumerate(parts):
            yield part["conv"], part["pid"], n, packed(sofar), i + 1 == len(parts)
            n, sofar = n + part["n"], (sofar * pow(BASE, part["n"], PRIME) + number(part["sofar"])) % PRIME

    # at most two stretches of a partition go on in another one
    ends = rows.where("ends").select("conv", "pid", "n", "sofar")
    torn = ends.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")
    carry = solve_groups(
        ends.join(torn, "conv"), ["conv"], ["pid"], "conv bigint, pid int, n0 bigint, sofar0 binary, final boolean", carried
    )
    return rows.join(stage(carry), ["conv", "pid"], "left").select(
        "conv",
        (F.col("n") + F.coalesce("n0", F.lit(0))).alias("pos"),
        "n",
        "value",
        "sofar",
        "sofar0",
        "words",
        (F.col("ends") & F.coalesce("final", F.lit(True))).alias("last"),
    )


def _whole(rows: DataFrame) -> DataFrame:
    """The places with the hash of the whole conversation so far."""

    def make():
        def work(batch):
            columns = (batch[c] for c in ("conv", "pos", "n", "value", "sofar", "sofar0", "words", "last"))
            for conv, pos, n, value, sofar, before, words, last in zip(*columns):
                if before is not None:
                    sofar = packed((number(before) * pow(BASE, n, PRIME) + number(sofar)) % PRIME)
                yield conv, pos, value, sofar, words, last

        return work

    return map_rows(rows, "conv bigint, pos bigint, value binary, sofar binary, words bigint, last boolean", make)


def _memberships(turns: DataFrame) -> DataFrame:
    """``conv, depth, node, parent, words, ends``: every prefix of every rebuilt conversation."""
    placed = stage(_whole(_placed(turns)))
    heads = placed.where(F.col("pos") <= STARTS)
    at = [F.col("pos") == i for i in range(1, STARTS)]
    starts = heads.groupBy("conv").agg(
        *[F.max(F.when(on, F.col("sofar"))).alias(f"sofar{i}") for i, on in enumerate(at, 1)],
        *[F.max(F.when(on, F.col("words"))).alias(f"words{i}") for i, on in enumerate(at, 1)],
        F.max("pos").alias("n"),
    )
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % STARTS
    sofar = F.array(*[F.col(f"sofar{i}") for i in range(1, STARTS)])
    words = F.array(*[F.col(f"words{i}") for i in range(1, STARTS)])
    heads = starts.select(F.col("conv").alias("first"), "n", sofar.alias("sofars"), words.alias("counts"))
    # n is exact below STARTS only, which is all that is asked of it: more turns than are shared, or not
    convs = (
        starts.select("conv", shared.cast("int").alias("h"), F.col("n").alias("own"), sofar.alias("own_sofars"))
        .withColumn("first", F.col("conv") - F.col("conv") % BLOCK)
        .join(heads, "first", "left")
        .withColumn("k", F.least("h", F.coalesce("n", F.lit(0))).cast("int"))
    )
    convs = stage(convs.select("conv", "h", "k", "own", "own_sofars", "sofars", "counts"))

    def make_starts():
        def work(batch):
            columns = (batch[c] for c in ("conv", "h", "k", "own", "sofars", "counts"))
            for conv, h, k, own, sofars, counts in zip(*columns):
                ends = own <= h  # no turns of its own follow
                yield conv, 0, ROOT, None, 0, ends and k == 0
                for d in range(1, k + 1):
                    yield conv, d, sofars[d - 1], sofars[d - 2] if d > 1 else ROOT, counts[d - 1], ends and d == k

        return work

    def make_rest():
        def work(batch):
            names = ("conv", "pos", "value", "sofar", "words", "last", "h", "k", "taken", "left")
            for conv, pos, value, sofar, words, last, h, k, taken, left in zip(*(batch[c] for c in names)):
                # the own start is replaced by that of the first conversation
                change = (number(taken) - number(left)) * pow(BASE, pos - h, PRIME)
                node = (number(sofar) + change) % PRIME
                parent = (node - number(value)) * INVERSE % PRIME
                yield conv, k + pos - h, packed(node), packed(parent), words, last

        return work

    schema = "conv bigint, depth bigint, node binary, parent binary, words bigint, ends boolean"
    slim = convs.select(
        "conv",
        "h",
        "k",
        F.when(F.col("k") > 0, F.element_at("sofars", F.greatest("k", F.lit(1)))).alias("taken"),
        F.when(F.col("h") > 0, F.element_at("own_sofars", F.greatest("h", F.lit(1)))).alias("left"),
    )
    rest = placed.join(slim, "conv").where("pos > h")
    return map_rows(convs, schema, make_starts).unionByName(map_rows(rest, schema, make_rest))


class Queue:
    """Priority queue of tuples that keeps ``held`` of them in memory and the others in sorted runs."""

    def __init__(self, held: int):
        self.held = held
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # first of each run that is left, with the run's number
        self.runs: list = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run = tempfile.TemporaryFile(dir=folder)  # goes with the task
        self.heap.sort()
        keep = self.heap[: self.held // 2]
        for item in self.heap[self.held // 2 :]:
            pickle.dump(item, run)
        self.heap = keep
        run.seek(0)
        self.runs.append(run)
        self._next(len(self.runs) - 1)

    def _next(self, i: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(self.runs[i]), i))
        except EOFError:
            self.runs[i].close()

    def least(self) -> tuple | None:
        fronts = ([self.heap[0]] if self.heap else []) + ([self.heads[0][0]] if self.heads else [])
        return min(fronts, default=None)

    def pop(self) -> tuple:
        if not self.heads or self.heap and self.heap[0] <= self.heads[0][0]:
            return heapq.heappop(self.heap)
        item, i = heapq.heappop(self.heads)
        self._next(i)
        return item


def forwarded(rows: Iterator[tuple], held: int) -> Iterator[tuple]:
    """``node, leaves, saved`` totals of subtrees.

    Rows ``shard, depth, node, parent, leaves, saved`` come shard by shard, by falling depth and
    then by node; the root of a shard bears its name.
    """
    shard, queue = None, Queue(held)
    for own, depth, node, parent, leaves, saved in rows:
        if own != shard:
            shard, queue = own, Queue(held)
        while (front := queue.least()) is not None and front[:2] == (-depth, node):
            message = queue.pop()
            leaves, saved = leaves + message[2], saved + message[3]
        if node != shard:
            queue.push((1 - depth, parent, leaves, saved))
        yield node, leaves, saved


def _totals(rows: DataFrame, *deal) -> DataFrame:
    """Totals of all shards; ``depth`` may be any number that grows by one from parent to child."""
    held = HELD
    order = ["shard", F.desc("depth"), "node"]
    dealt = rows.repartition(*deal).sortWithinPartitions(*order)
    dealt = dealt.select("shard", "depth", "node", "parent", "leaves", "saved")
    schema = "node binary, leaves decimal(38,0), saved decimal(38,0)"

    def work(rows):
        from decimal import Decimal

        for node, leaves, saved in forwarded(rows, held):
            yield node, Decimal(leaves), Decimal(saved)

    return _stream(dealt, schema, work)


def _summed(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _with(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows with sums of other rows for the same node added to their own."""
    more = more.select("node", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    plus = [(F.col(c) + F.coalesce(o, F.lit(0))).cast("bigint").alias(c) for c, o in (("leaves", "l"), ("saved", "s"))]
    kept = [c for c in rows.columns if c not in ("leaves", "saved")]
    return rows.join(more, "node", "left").select(*kept, *plus)


def _ends(members: DataFrame) -> DataFrame:
    """``node, ends_sha256``: ids of a node are joined where they lie, then hashed in their order."""
    ends = members.where("ends").select("node", "conv")
    dealt = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    limit = CHUNK

    def pieces(rows):
        node, first, held, size = None, 0, [], 0
        for own, conv in rows:
            if held and (own != node or size >= limit):
                yield node, first, ",".join(held)
                held, size = [], 0
            if not held:
                node, first = own, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        if held:
            yield node, first, ",".join(held)

    def digests(rows):
        node, digest = None, None
        for own, piece in rows:
            if own == node:
                digest.update(b"," + piece.encode())
                continue
            if node is not None:
                yield node, digest.hexdigest()
            node, digest = own, hashlib.sha256(piece.encode())
        if node is not None:
            yield node, digest.hexdigest()

    chunks = _stream(dealt, "node binary, first bigint, piece string", pieces)
    chunks = chunks.repartition("node").sortWithinPartitions("node", "first").select("node", "piece")
    return _stream(chunks, "node binary, ends_sha256 string", digests)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("bigint").alias("conv"),
        conversations["turn"].alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    members = stage(_memberships(turns))
    nodes = members.groupBy("node").agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("depth", "parent", "words")],
    )
    nodes = stage(nodes)
    above = nodes.select(
        F.col("node").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n_convs").alias("parent_n")
    )
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), "node", "left").join(above, "parent", "left")
    nodes = stage(
        nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("bigint"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
        .withColumn("band", F.floor(F.col("depth") / BAND))
    )
    slim = ["node", "parent", "depth", "conv", "band", "leaves", "saved"]
    heavy = nodes.where(F.col("n_convs") > LIMIT)
    light = nodes.where(F.col("n_convs") <= LIMIT)
    cuts_here = F.coalesce(F.col("parent_n"), F.lit(LIMIT + 1)) > LIMIT
    tops = stage(light.where(cuts_here | (F.col("depth") % BAND == 0)).select(*slim, cuts_here.alias("cut")))

    # a conversation passes at most one shard root in a band of levels, and one cut in all
    met = stage(members.join(tops.select("node", "band", "cut"), "node").select("conv", "band", F.col("node").alias("shard"), "cut"))
    sharded = stage(light.select(*slim).join(met.drop("cut"), ["conv", "band"]))

    # across the shard roots below one cut; a shard's own sum needs no order
    sums = _summed(sharded, "shard").withColumnRenamed("shard", "node")
    of = sharded.select(F.col("node").alias("parent"), F.col("shard").alias("above"))
    cut_of = met.where("cut").select("conv", F.col("shard").alias("cut_name"))
    roots = tops.select("node", "parent", "depth", "conv", "band", "cut").join(sums, "node")
    roots = stage(roots.join(cut_of, "conv").join(of, "parent", "left"))
    upper = roots.select(
        F.col("cut_name").alias("shard"), F.col("band").alias("depth"), "node", F.col("above").alias("parent"),
        F.col("leaves").cast("bigint").alias("leaves"), F.col("saved").cast("bigint").alias("saved"),
    )
    full = stage(_totals(upper, "shard").join(roots.select("node", "parent", "cut"), "node"))
    arrived = _summed(full, "parent").withColumnRenamed("parent", "node")

    # above the cuts: the nodes that many conversations share
    shared = _with(heavy.select(*slim), arrived).withColumn("shard", F.lit(ROOT))
    high = _totals(shared, F.lit(0))
    low = _totals(_with(sharded.select(*slim, "shard"), arrived), "shard")
    rows = nodes.join(high.unionByName(low).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "node")
    rows = rows.join(_ends(members), "node", "left")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("n_leaves").cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: The same rows in SQL: prefixes as joined hashes, totals over all pairs of node and ancestor.
ORACLE = r"""
WITH turn AS (
  SELECT conv_id AS c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(x ORDER BY turn NULLS FIRST, x) AS xs, list(words ORDER BY turn NULLS FIRST, x) AS ws FROM turn GROUP BY c
), shared AS (
  SELECT *, c - c % 20 AS first, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(c::VARCHAR))) + 1, 2),
      lambda i: (instr('0123456789ABCDEF', hex(encode(c::VARCHAR))[i]) - 1) * 16
        + instr('0123456789ABCDEF', hex(encode(c::VARCHAR))[i + 1]) - 1)),
    lambda v, b: list_reduce(list_prepend(xor(v, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda u, z: xor(u >> 1, 3988292384 * (u & 1))))) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.xs[1:a.h], []), a.xs[a.h + 1:]) AS xs,
    list_concat(coalesce(b.ws[1:a.h], []), a.ws[a.h + 1:]) AS ws
  FROM shared a LEFT JOIN own b ON b.c = a.first
), path AS (
  SELECT c, d, array_to_string(xs[1:d], ',') AS name, array_to_string(xs[1:d - 1], ',') AS above,
    CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words, d = len(xs) AS ends
  FROM rebuilt, unnest(range(0, len(xs) + 1)) AS t(d)
), node AS (
  SELECT name, min(c) AS c, min(d) AS d, min(CASE WHEN d > 0 THEN above END) AS above, count(*) AS n,
    (count(*) - 1) * min(words) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends
  FROM path GROUP BY name
), child AS (
  SELECT above AS name, count(*) AS n_children FROM node WHERE above IS NOT NULL GROUP BY above
), valued AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (name)
), total AS (
  SELECT path.name, sum(v.saved)::BIGINT AS saved_tokens, sum((v.n_children = 0)::INT)::BIGINT AS n_leaves
  FROM valued v JOIN path ON path.c = v.c AND path.d <= v.d GROUP BY path.name
)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, p.c AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens,
  v.ends AS ends_sha256
FROM valued v JOIN total USING (name) LEFT JOIN valued p ON p.name = v.above
"""
