"""Language identification by a string kernel, Nyström landmarks and ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: the n-grams of one to four
letters that both hold, over the geometric mean of how many each holds. A bounded sample of
labelled rows is learned from; some of its rows are landmarks. A text is mapped to its kernel
values with the landmarks, whitened by the landmarks' own kernel matrix, and one ridge
regression per language (+1 for it, -1 for the rest) scores it. Scoring takes two matrix
products per batch.

Rows: every input row gives one output row, repeated rows included. Null texts and texts without
a letter give ``und`` with score 0, and so does everything if no labelled row can be learned
from. A null id has a null ``held_out`` and is not learned from. Ties of the score go to the
first language by name. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm import ngrams
from parley.llm.common import map_rows

SIZES = range(1, 5)
BITS = 15
PER_LANGUAGE = 400  # labelled rows learned from, for each language
SAMPLE_ROWS = 4000  # and in all
PARTS = 64  # parts into which the rows of a language are dealt to be ranked
LANDMARKS = 160
RIDGE = 1e-3
BATCH = 128  # texts of one matrix product
FOLDS = 5
UNDETERMINED = "und"


@dataclass
class Model:
    """Landmarks as rows of presence bits, and the weights from kernel values to scores."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores of presence rows, a column per language."""
        return kernel(rows, self.landmarks) @ self.weights


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of both counts."""
    shared = left @ right.T
    norms = np.sqrt(np.outer(left.sum(1), right.sum(1)))
    return shared / np.maximum(norms, 1.0)


def fit(languages: list[str], rows: np.ndarray) -> Model:
    """Fit on presence rows with their languages; rows are in sample order."""
    names = sorted(set(languages))
    marks = rows[: min(LANDMARKS, len(rows))]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    strong = values > 1e-6 * values.max()
    whiten = vectors[:, strong] / np.sqrt(values[strong])
    mapped = kernel(rows, marks).astype(np.float64) @ whiten
    targets = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    gram = mapped.T @ mapped + RIDGE * len(rows) * np.eye(mapped.shape[1])
    weights = whiten @ np.linalg.solve(gram, mapped.T @ targets)
    return Model(names, marks.astype(np.float32), weights.astype(np.float32))


def sample_ids(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The rows to learn from: first by hash in each language, then in all."""
    order = [F.xxhash64("id"), F.col("id")]
    slim = docs.select(
        docs[id_col].alias("id"), docs[lang_col].alias("lang"), F.sha2(docs[text_col], 256).alias("name")
    ).where("lang is not null and name is not null")
    slim = slim.where(F.crc32(F.col("id").cast("string")) % FOLDS != 0)
    part = F.pmod(F.xxhash64("id", "name"), F.lit(PARTS))
    for groups in (["lang", part], ["lang"]):  # a common language is not ranked by one task
        turn = F.row_number().over(W.partitionBy(*groups).orderBy(*order, "name"))
        slim = slim.withColumn("rank", turn).where(F.col("rank") <= PER_LANGUAGE)
    return slim.orderBy("rank", *order, "lang", "name").limit(SAMPLE_ROWS)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model | None:
    """Learn from the training folds; only presence bits of the sample reach the driver."""
    chosen = sample_ids(docs, id_col, text_col, lang_col)
    texts = docs.select(
        docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")
    ).withColumn("name", F.sha2("text", 256))
    picked = texts.join(F.broadcast(chosen), ["id", "name", "lang"]).select(
        "rank", "id", "lang", "text"
    )

    def make():
        letters = ngrams.letter_table()

        def work(rows):
            for rank, lang, text in zip(rows["rank"], rows["lang"], rows["text"]):
                points = ngrams.letters_only(text, letters)
                if len(points) > 1:
                    bits = np.packbits(ngrams.presence(points, SIZES, BITS))
                    yield rank, lang, bits.tobytes()

        return work

    found = map_rows(picked, "rank int, lang string, bits binary", make).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.rank, r.lang, r.bits))
    rows = np.unpackbits(
        np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -1), axis=1
    )
    return fit([r.lang for r in found], rows.astype(np.float32))


def predict(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, held_out, lang_pred, score`` of every whole text."""
    source = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def make():
        letters = ngrams.letter_table()

        def scored(keys, texts) -> Iterator[tuple]:
            points = [
                None if t is None else ngrams.letters_only(t, letters) for t in texts
            ]
            usable = [
                i for i, p in enumerate(points) if model is not None and p is not None and len(p) > 1
            ]
            best = {}
            if usable:
                rows = np.stack([ngrams.presence(points[i], SIZES, BITS) for i in usable])
                scores = model.score(rows.astype(np.float32))
                for i, row in zip(usable, scores):
                    at = int(row.argmax())
                    best[i] = model.languages[at], float(min(1.0, max(0.0, (row[at] + 1) / 2)))
            for i, key in enumerate(keys):
                yield (key, *best.get(i, (UNDETERMINED, 0.0)))

        def work(rows):
            for start in range(0, len(rows["key"]), BATCH):
                part = slice(start, start + BATCH)
                yield from scored(rows["key"][part], rows["text"][part])

        return work

    found = map_rows(source, f"key {kind}, lang_pred string, score double", make)
    held_out = F.crc32(F.col("key").cast("string")) % FOLDS == 0
    return found.select(
        F.col("key").alias(id_col), held_out.alias("held_out"), "lang_pred", "score"
    )


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Train on the training folds of a table and predict every row of it."""
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
