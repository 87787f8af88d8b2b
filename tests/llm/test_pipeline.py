"""The pipeline against the operators' brute-force twins, stage by stage."""

import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
import test_decontaminate
import test_nearcopies
import tokenizers

from parley.llm import quality
from parley.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def removed(texts, words=50):
    """Texts without the runs of words that occur twice, by counting all windows."""
    spans = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    lists = [[m.group() for m in s] for s in spans]
    times = Counter(tuple(w[i : i + words]) for w in lists for i in range(len(w) - words + 1))
    out = []
    for text, span, own in zip(texts, spans, lists):
        gone = bytearray(len(own))
        for i in range(len(own) - words + 1):
            if times[tuple(own[i : i + words])] > 1:
                gone[i : i + words] = b"\1" * words
        starts = [m.start() for m in span] + [len(text)]
        left = [text[starts[i] : starts[i + 1]] for i in range(len(own)) if not gone[i]]
        out.append(text[: starts[0]] + "".join(left))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        rows = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(rows)
        if name != "token_ids":
            assert out.columns == columns
        texts = [(i, r.text) for i, r in sorted(before.items())]
        if name == "quality_rules":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            verdicts = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
            assert set(rows) == {i for i, kept in verdicts.items() if kept}
            assert 0 < len(rows) < len(before)
        elif name == "near_dedup":
            want = test_nearcopies.by_hand(texts, words=5)
            assert set(rows) == {key for key, _, _, kept in want if kept}
        elif name == "passage_dedup":
            cut = removed([t for _, t in texts])
            assert {i: r.text for i, r in rows.items()} == {i: c for (i, _), c in zip(texts, cut)}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            windows = set()
            for _, text in items:
                w = test_decontaminate.word_list(text)
                n = min(10, len(w))
                windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
            sizes = {len(w) for w in windows}
            clean = set()
            for i, text in texts:
                w = test_decontaminate.word_list(text)
                if not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1)):
                    clean.add(i)
            assert set(rows) == clean
        else:
            assert set(rows) == set(before)
            library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
            for i, text in texts:
                assert rows[i].n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        docs = spark.createDataFrame(list(rows.values()), out.schema) if name != "token_ids" else docs
        before = rows
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) and all(re.fullmatch("[a-z_]+", n) for n in names)


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0), (None, text, None, None, None), (2, text + " more", "en", "s", 9), (2, text + " more", "en", "s", 9)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {None, 2}


def test_passages_of_just_over_and_under_50_words(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    shared, short = words("s", 51), words("t", 49)
    texts = {
        1: f"{words('a', 30)}\n{shared} {words('b', 20)}",
        2: f"{shared}\n{words('c', 60)}",
        3: f"{words('d', 60)} {shared.replace(' ', '  ')}",
        4: f"{words('e', 60)} {short} {words('f', 9)}",
        5: f"{words('g', 60)} {short}",
        6: words("h", 200),
        7: None,
        8: "",
    }
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.passage_dedup(spark, docs, SF).collect()}
    assert out[1] == f"{words('a', 30)}\n{words('b', 20)}"
    assert out[2] == words("c", 60)
    assert out[3] == words("d", 60) + " "
    assert all(out[i] == texts[i] for i in (4, 5, 6, 7, 8))
