"""Language identification against a plain PPM coder, and held-out accuracy."""

from __future__ import annotations

import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rows import no_docs, odd_docs, odd_texts  # noqa: E402

from perfsieve.llm import language_id  # noqa: E402

SF = "/root/testdata/sf0.01"


class Plain:
    """The tree of one language as dictionaries, coded byte by byte by the textbook's recursion."""

    def __init__(self, texts: list[bytes], order: int, least: int = 1):
        counts = Counter()
        for text in texts:
            padded = b"\xff" * order + text
            for i in range(order, len(padded)):
                counts.update(padded[i - k : i + 1] for k in range(order + 1))
        self.order = order
        self.tree = defaultdict(dict)
        for run, n in counts.items():
            if n >= least:
                self.tree[run[:-1]][run[-1]] = n

    def bits(self, context: bytes, byte: int) -> float:
        seen = self.tree.get(context)
        if seen and byte in seen:
            return -math.log2(seen[byte] / (sum(seen.values()) + len(seen)))
        escape = -math.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0.0
        return escape + (self.bits(context[1:], byte) if context else 8.0)

    def length(self, text: bytes) -> float:
        padded = b"\xff" * self.order + text
        return sum(self.bits(padded[i - self.order : i], padded[i]) for i in range(self.order, len(padded)))


TRAIN = {"a": ["the cat sat on the mat", "then there they were", "the the the"], "b": ["le chat était là", "elle est là", "été"], "c": ["xyz"]}
ASKED = ["the", "", "là-bas", "xyzzy", "the cat était", "\x00\x01", "日本語", "there then " * 30, "e"]


def fitted(order: int) -> language_id.Model:
    names = sorted(TRAIN)
    counts = []
    for k in range(order + 1):
        rows = Counter()
        for i, name in enumerate(names):
            for text in TRAIN[name]:
                padded = b"\xff" * order + text.encode()
                rows.update((i, int.from_bytes(padded[j - k : j + 1], "big")) for j in range(order, len(padded)))
        counts.append((np.array([i for i, _ in rows]), np.array([c for _, c in rows], np.uint64), np.array(list(rows.values()))))
    return language_id.build(counts, names)


@pytest.mark.parametrize("order", [0, 1, 2, 4, 6])
@pytest.mark.parametrize("size", [1 << 20, 7])
def test_code_lengths_equal_the_plain_coder(order, size, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", size)
    found = language_id.code_lengths(fitted(order), [t.encode() for t in ASKED])
    for column, name in enumerate(sorted(TRAIN)):
        plain = Plain([t.encode() for t in TRAIN[name]], order)
        assert found[:, column] == pytest.approx([plain.length(t.encode()) for t in ASKED])


def test_fit_and_prediction_equal_the_plain_coder(spark):
    rows = [(100 * i + j, t, lang) for i, (lang, texts) in enumerate(TRAIN.items()) for j, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (900, None, "a"), (901, "no lang", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.repartition(3))
    asked = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate([*ASKED, None, "12 + 3!", "½"])], "doc_id long, text string, lang_pred string, score double")
    found = {r["doc_id"]: r for r in language_id.identify(asked, model).collect()}
    trees = {name: Plain([t.encode() for t in texts], language_id.ORDER) for name, texts in TRAIN.items()}
    for i, text in enumerate(ASKED):
        if not any(c.isalpha() for c in text):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        bits = {name: tree.length(text.encode()) for name, tree in trees.items()}
        best = min(bits, key=lambda name: (bits[name], name))
        assert found[i]["lang_pred"] == best
        assert found[i]["score"] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()))
    assert all(found[i]["lang_pred"] == "und" for i in range(len(ASKED), len(ASKED) + 3))


def test_rare_pairs_leave_when_the_model_is_too_large(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, lang) for lang, texts in TRAIN.items() for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "MODEL_BYTES", 16 * 3 * 60)
    model = language_id.fit(docs)
    assert 0 < sum(len(level.codes) for level in model.pairs) <= 60
    found = language_id.code_lengths(model, [t.encode() for t in ASKED])
    for least in (2, 4):
        plain = [Plain([t.encode() for t in TRAIN[name]], language_id.ORDER, least) for name in sorted(TRAIN)]
        want = np.array([[tree.length(t.encode()) for tree in plain] for t in ASKED])
        if np.allclose(found, want):
            return
    raise AssertionError("no count limit explains the code lengths")


def test_sample_is_bounded_and_takes_repeated_ids_once(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 5)
    rows = [(7, "hot text", "en")] * 300 + [(i, "x" * 10, "en") for i in range(100)] + [(i, "y" * 10, "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    taken = Counter(r["lang"] for r in language_id.sample(docs, "lang", "text", "doc_id").collect())
    assert taken == {"en": 5, "fr": 3}
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 25)
    taken = Counter(r["lang"] for r in language_id.sample(docs, "lang", "text", "doc_id").collect())
    assert taken["en"] in (3, 4) and taken["fr"] == 3


def test_odd_rows(spark):
    docs = odd_docs(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("en", 1.0) if letters else ("und", 0.0))
    assert language_id.fit(no_docs(spark)) is None
    assert language_id.identify(no_docs(spark), model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_held_out_documents_get_their_language(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = language_id.op13_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    asked = right = 0
    for r in found:
        doc = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and doc["lang"] and any(c.isalpha() for c in doc["text"] or ""):
            asked += 1
            right += r["lang_pred"] == doc["lang"]
    assert asked > 200 and right / asked >= 0.99, (right, asked)
