"""Quality rules: counted rules, and a hashed n-gram classifier with calibrated probabilities.

Two logistic regressions, one for low quality and one for toxic text, read the presence of
hashed words, word pairs and character n-grams. They learn from a bounded sample of labelled
rows, part of which only calibrates the probabilities. The tasks count in how many rows of the
sample each slot occurs; only the slots that a model weighs reach the driver. Every text is scored in Arrow batches
and rejected when a probability passes its fixed threshold, or when it fails the counted rules.

Rows: every input row gives one output row, repeated rows included. A null text has no words
and fails; so does an empty one. A null id stays null. Labels that are null, or whose id is
not in the table, are left out; an id labelled twice counts as labelled with the largest
values. Without labels of both kinds a model rejects nothing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import ngrams
from parley.llm.common import give_back, map_batches, map_rows, split
from parley.session import stage

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3
SYMBOLS = b"#*$%&|<>"  # fixed value: characters counted as symbols
BITS = 23
LETTERS = range(3, 7)  # sizes of the character n-grams
SAMPLE_ROWS = 6000  # labelled rows learned from
FEW = 5  # rows of the sample that must hold a slot for it to count
KEPT = 1000  # slots that a model weighs, those that part its classes best
STEPS, RATE, DECAY = 150, 0.1, 1e-4
LOW_QUALITY, TOXIC = 0.8, 0.5  # thresholds on the calibrated probabilities


def counted(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly the six ASCII blanks part words
    blanks = len(raw) - sum(map(len, words))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - blanks,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    code = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    window = code
    for k in range(1, WINDOW):
        window = window[: len(words) - k] * len(numbers) + code[k:]
        _, window, times = np.unique(window, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), bool)
    for at in range(WINDOW):
        covered[at : at + n] |= times[window] > 1
    return int(covered.sum())


def slots(text: str) -> np.ndarray:
    """Hashed words and word pairs, without marks at their ends, and character n-grams."""
    lower = text.lower()
    words = [w.strip(b".,;:!?\"'()") for w in lower.encode("utf-8", "surrogatepass").split()]
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = zlib.crc32(w)
    single = np.array([known[w] for w in words], np.uint64) * ngrams.ODD
    pairs = ((single[:-1] ^ (single[:-1] >> np.uint64(31))) * ngrams.ODD + single[1:]) * ngrams.ODD
    by_word = (np.concatenate((single, pairs)) >> np.uint64(64 - BITS)).astype(np.int64)
    points = ngrams.code_points(f" {lower} ").astype(np.uint64)
    return np.concatenate((by_word, *ngrams.grams(points, LETTERS, BITS)))


@dataclass
class Model:
    """Weights by slot; a margin becomes a probability by the calibration line."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    line: tuple[float, float] = (1.0, 0.0)

    def table(self) -> np.ndarray:
        """Which slots are weighed, a byte each; each task lays it out once."""
        table = np.zeros(1 << BITS, bool)
        table[self.places] = True
        return table

    def margin(self, table: np.ndarray, found: np.ndarray) -> float:
        held = np.unique(found[table[found]])
        return self.bias + float(self.weights[np.searchsorted(self.places, held)].sum(dtype=np.float64))

    def probability(self, margin: float) -> float:
        return float(sigmoid(self.line[0] * margin + self.line[1]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def parting(rows: list[bytes], y: np.ndarray) -> np.ndarray:
    """The slots whose presence parts the classes best, by the chi-square of each."""
    held = np.zeros((2, 1 << BITS), np.uint16)  # the sample has fewer rows than that holds
    for row, label in zip(rows, y):
        held[int(label), unpacked(row)] += 1
    places = np.flatnonzero(held[0] + held[1] >= FEW)
    yes, both, share = held[1, places], held[:, places].sum(0), y.mean()
    spread = both * share * (1 - share) * (1 - both / len(y))
    strength = np.where(spread > 0, (yes - both * share) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-strength, kind="stable")[:KEPT]
    return np.sort(places[best[strength[best] > 0]])


def descend(columns: np.ndarray, lengths: np.ndarray, y: np.ndarray, width: int):
    """Logistic regression on rows of present columns, by Adam on the whole sample.

    Column ``width`` is the bias, held by every row.
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    share = np.full(width + 1, DECAY)
    share[-1] = 0
    for step in range(1, STEPS + 1):
        error = (sigmoid(np.add.reduceat(w[columns], starts)) - y) / len(y)
        slope = np.bincount(columns, np.repeat(error, lengths), width + 1) + share * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The line that turns margins into log odds, by damped Newton steps on smoothed targets."""
    yes, no = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    line = np.array([1.0, 0.0])
    points = np.stack((margin, np.ones(len(margin))), 1)
    for _ in range(100):
        p = sigmoid(points @ line)
        slope = points.T @ (p - target) + 0.1 * (line - (1, 0))
        bend = (points * (p * (1 - p))[:, None]).T @ points + 0.1 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        line = line - move / max(1.0, 4 * np.abs(move).max())
    return float(max(line[0], 1e-3)), float(line[1])


def packed(found: np.ndarray) -> bytes:
    """Distinct slots of a row in a few bytes each, as they travel to the driver and lie there."""
    steps = np.diff(np.unique(found), prepend=0).astype("<u4")
    return zlib.compress(steps.tobytes(), 1)


def unpacked(row: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(row), "<u4"), dtype=np.int64)


def taught(y: np.ndarray) -> np.ndarray | None:
    """Which rows, in sample order, are learned from: two of three, if both parts have both classes."""
    learn = np.arange(len(y)) % 3 != 2
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        return None
    return learn


def columns_of(found: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the sorted places a row holds."""
    return np.flatnonzero(np.isin(places, found))


def solved(places: np.ndarray, rows: list[np.ndarray], y: np.ndarray, learn: np.ndarray) -> Model:
    """Fit on the learned rows, each the columns it holds, and calibrate on the others."""
    learned = [np.append(row, len(places)) for row, used in zip(rows, learn) if used]
    lengths = np.array([len(row) for row in learned])
    weights, bias = descend(np.concatenate(learned), lengths, y[learn], len(places))
    model = Model(places, weights.astype(np.float32), bias)
    margins = [
        bias + float(model.weights[row].sum(dtype=np.float64)) for row, used in zip(rows, learn) if not used
    ]
    model.line = calibrate(np.array(margins), y[~learn])
    return model


def fit(packed_rows: list[bytes], y: np.ndarray) -> Model | None:
    """Fit on two rows of three, calibrate on the third; rows are in sample order.

    Rows stay packed and are opened one at a time.
    """
    learn = taught(y)
    if learn is None:
        return None
    places = parting([row for row, used in zip(packed_rows, learn) if used], y[learn])
    return solved(places, [columns_of(unpacked(row), places) for row in packed_rows], y, learn)


def _counted_slots(sample: DataFrame, classes: dict[int, int]) -> DataFrame:
    """``slot, n_rows, low_quality, toxic``: learned rows that hold a slot, in all and by class.

    ``classes`` holds, by the tag of each learned row, 2 for low quality plus 1 for toxic text.
    """
    target = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split(batch):
                pairs = zip(part["tag"].to_pylist(), part["slots"].to_pylist())
                codes = [(unpacked(row) * 4 + classes[tag]).astype(np.int32) for tag, row in pairs if tag in classes]
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    columns = (code >> 2).astype(np.int32), (code & 3).astype(np.int32), n
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=target)

    found = map_batches(sample.select("tag", "slots"), run, "slot int, kind int, n bigint")
    return (
        found.groupBy("slot")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("kind") >= 2, F.col("n")).otherwise(0)).alias("low_quality"),
            F.sum(F.when(F.col("kind") % 2 == 1, F.col("n")).otherwise(0)).alias("toxic"),
        )
        .where(F.col("n_rows") >= FEW)
    )


def _parting(counts: DataFrame, name: str, y: np.ndarray) -> np.ndarray:
    """As :func:`parting`, from the counts of slots."""
    share, both = float(y.mean()), F.col("n_rows")
    spread = both * share * (1 - share) * (1 - both / len(y))
    gap = F.col(name) - both * share
    strength = F.when(spread > 0, gap * gap / F.greatest(spread, F.lit(1e-9))).otherwise(0.0)
    ranked = counts.select("slot", strength.alias("strength")).where("strength > 0")
    best = ranked.orderBy(F.desc("strength"), "slot").limit(KEPT).select("slot").toArrow()
    return np.sort(best["slot"].to_numpy()).astype(np.int64)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> dict[str, Model | None]:
    """Learn both models from the first labelled rows by hash, at most ``SAMPLE_ROWS``."""
    marked = (
        labels.select(labels[id_col].alias("id"), "quality", "toxic")
        .where("id is not null and quality is not null and toxic is not null")
        .groupBy("id")
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    ids = docs.select(docs[id_col].alias("id")).where(docs[text_col].isNotNull()).distinct()
    chosen = marked.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")

    def make():
        def work(rows):
            for key, text, good, bad in zip(*(rows[c] for c in ("id", "text", "quality", "toxic"))):
                if text is not None:
                    yield zlib.crc32(str(key).encode()), str(key), packed(slots(text)), good, bad

        return work

    schema = "turn bigint, id string, slots binary, quality int, toxic int"
    sample = stage(map_rows(picked, schema, make).withColumn("tag", F.monotonically_increasing_id()))
    found = sample.select("turn", "id", F.md5("slots"), "tag", "quality", "toxic").toArrow()
    rows = sorted(zip(*(column.to_pylist() for column in found.columns)))
    tags = [row[3] for row in rows]
    good, bad = (np.array([row[c] for row in rows], float) for c in (4, 5))
    wanted = {"low_quality": 1.0 - (good > 0), "toxic": 1.0 * (bad > 0)}
    learned = {name: taught(y) for name, y in wanted.items()}
    names = [name for name, learn in learned.items() if learn is not None]
    models: dict[str, Model | None] = dict.fromkeys(wanted)
    if not names:
        return models
    kinds = (2 * wanted["low_quality"] + wanted["toxic"]).astype(int).tolist()
    classes = {tag: kind for tag, kind, used in zip(tags, kinds, learned[names[0]]) if used}
    counts = stage(_counted_slots(sample, classes))
    places = {name: _parting(counts, name, wanted[name][learned[name]]) for name in names}

    def make_held():
        def work(rows):
            for tag, row in zip(rows["tag"], rows["slots"]):
                row = unpacked(row)
                yield (tag, *(columns_of(row, places[name]).tolist() for name in names))

        return work

    kept = ", ".join(f"{name} array<int>" for name in names)
    held = map_rows(sample.select("tag", "slots"), f"tag bigint, {kept}", make_held).toArrow()
    at = {tag: i for i, tag in enumerate(held["tag"].to_pylist())}
    for name in names:
        own = [np.array(held[name][at[tag]].as_py(), np.int64) for tag in tags]
        models[name] = solved(places[name], own, wanted[name], learned[name])
    return models


def score(
    docs: DataFrame,
    models: dict[str, Model | None],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and both probabilities of every whole text."""
    source = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def make():
        tables = {name: model.table() for name, model in models.items() if model}

        def probability(name, found):
            model = models[name]
            return model.probability(model.margin(tables[name], found)) if model else 0.0

        def work(rows):
            for key, text in zip(rows["key"], rows["text"]):
                counts = counted(text)
                n_words, repeated = counts[0], counts[-1]
                failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
                low = toxic = 0.0
                if n_words:
                    found = slots(text)
                    low, toxic = probability("low_quality", found), probability("toxic", found)
                kept = not failed and low <= LOW_QUALITY and toxic <= TOXIC
                yield (key, *counts, failed, kept, low, toxic)

        return work

    return map_rows(
        source,
        f"key {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, p_low_quality double, "
        "p_toxic double",
        make,
    ).withColumnRenamed("key", id_col)


def passes(text: str | None, models: dict[str, Model | None], tables: dict[str, np.ndarray]) -> bool:
    """Whether a text passes the counted rules and both thresholds."""
    n_words, *_, repeated = counted(text)
    if n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words:
        return False
    found = slots(text)
    limits = {"low_quality": LOW_QUALITY, "toxic": TOXIC}
    return all(
        m.probability(m.margin(tables[name], found)) <= limits[name]
        for name, m in models.items()
        if m
    )


def keep(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that pass, all columns; judged where they lie, without a shuffle."""
    models = train(docs, labels, id_col, text_col)

    @F.arrow_udf("boolean")
    def passed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = {name: model.table() for name, model in models.items() if model}
        for texts in batches:
            parts = split(pa.RecordBatch.from_arrays([texts], names=["text"]))
            yield pa.array([passes(t, models, tables) for part in parts for t in part[0].to_pylist()], pa.bool_())
        give_back()

    return docs.where(passed(docs[text_col]))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Train on the labelled rows of a table and judge every row of it."""
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
