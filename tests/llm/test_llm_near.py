"""The similarity join against all pairs, and the pipeline stage by stage."""

from __future__ import annotations

import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rows import SF, no_docs, odd_docs, odd_texts, plain_words  # noqa: E402

import corpus_pipeline  # noqa: E402
from perfsieve.llm import ngram_join  # noqa: E402


def gram_sets(texts):
    out = []
    for _, text in texts:
        w = plain_words(text)
        n = min(5, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def all_pairs(texts):
    """(id, class id, links) per row, by comparing every row with every other."""
    sets, parent = gram_sets(texts), list(range(len(texts)))
    links = [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    out = []
    for n, (i, _) in enumerate(texts):
        ids = [texts[m][0] for m in range(len(texts)) if root(m) == root(n) and texts[m][0] is not None]
        out.append((i, i if not sets[n] else min(ids) if ids else None, links[n]))
    return out


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(n):
        if i % 9 == 0:
            base[rng.randrange(90)] = f"c{i}"
        text = list(base)
        text[rng.randrange(90)] = f"d{i}"
        rows.append((100 + i, " ".join(text)))
    return rows


def test_bands_reach_the_recall():
    bands, rows = ngram_join.banding(0.8)
    assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    texts = [t for t in odd_texts() if t[0] != 11] + near_copies(150) + [(900 + i, "same five words in copies") for i in range(30)]
    found = ngram_join.similar_documents(odd_docs(spark, texts)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, all_pairs(texts)))


def test_odd_tables(spark):
    assert ngram_join.similar_documents(no_docs(spark)).count() == 0
    assert ngram_join.one_per_class(no_docs(spark)).count() == 0
    docs = odd_docs(spark)
    kept = ngram_join.one_per_class(docs)
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert kept.columns == docs.columns and ids == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13]


def test_components_of_chains_and_stars(spark):
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(300)] + [("x", "x")]
    found = {r["node"]: r["label"] for r in ngram_join.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"a{i:03d}"] for i in range(61)} == {"a000"} and {found[f"s{i}"] for i in range(300)} == {"hub"} and "x" not in found


def test_pipeline_stages(spark):
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == docs.columns, name
        if name == "ngram_jaccard_join":
            texts = [(r["doc_id"], r["text"]) for r in seen.collect()]
            wanted = {i for i, c, _ in all_pairs(texts) if i == c}
            assert {r["doc_id"] for r in out.collect()} == wanted and out.count() == len(wanted)
        if name == "mixing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in seen.collect()}
        seen = out
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    expected, start = [], 0
    for r in sorted(seen.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == expected
