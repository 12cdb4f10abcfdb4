"""Exact duplicates, archive and mixing against plain Python; queries with SQL against their SQL."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import connect, differences  # noqa: E402
from rows import SF, no_docs, odd_docs, odd_texts  # noqa: E402

from perfsieve.llm import exact_dedup, mixing, registry, warc_archive  # noqa: E402
from perfsieve.session import work_folder  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["strong", "weak"])
def test_copies_share_a_group(spark, digest):
    texts = odd_texts() + [(100 + i, f"copy {i % 3}") for i in range(40)]
    groups = defaultdict(list)
    norm = {n: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for n, (_, t) in enumerate(texts)}
    for n, (i, _) in enumerate(texts):
        groups[norm[n]].append(i)
    expected = []
    for n, (i, _) in enumerate(texts):
        ids = [x for x in groups[norm[n]] if x is not None]
        keep = min(ids) if ids else None
        expected.append((i, keep, len(groups[norm[n]]), i is not None and i == keep, hashlib.sha256(norm[n].encode()).hexdigest()))
    found = exact_dedup.label_copies(odd_docs(spark, texts), digest=digest)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
    assert exact_dedup.label_copies(no_docs(spark), digest=digest).count() == 0


def test_one_row_of_each_text_survives(spark):
    found = exact_dedup.survivors(odd_docs(spark)).collect()
    assert len(found) == len({r["text_sha256"] for r in found}) and {r["doc_id"] for r in found} >= {1, 4, 6, 7, 8, 9, 12}


def test_archive_gives_back_every_record(spark):
    page = "<html>" + "x" * 200
    rows = [(1, "http://a", page, 5), (2, "http://b", page, 5), (3, None, page, 5), (4, "u", "short", 5), (5, "u", "short", 5)]
    rows += [(6, "u\r\nWARC-Type: revisit", "é" * 80, 5), (7, "u", None, 5), (None, "u", page, 5), (2, "http://b", page, 5)]
    rows += [(8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n" * 9, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    path = work_folder(spark, "t")
    warc_archive.write_archive(pages, path)
    facts = {r["page_id"]: r for r in warc_archive.read_archive(spark, path).collect()}
    assert (facts[1]["record_type"], facts[2]["record_type"], facts[2]["refers_to"], facts[5]["record_type"]) == ("response", "revisit", 1, "response")
    assert facts[6]["payload_bytes"] == 160 and facts[6]["record_type"] == "response" and facts[3]["url"] is None
    assert all(facts[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() for i, _, h, _ in rows)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    whole = warc_archive.reconstruct(spark, path).collect()
    assert len(whole) == len(rows)
    for r in whole:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[size:] == b"\r\n\r\n" and (r["record_type"] == "revisit" or body[:size] == bytes(r["payload"]))
    empty = work_folder(spark, "t")
    warc_archive.write_archive(pages.limit(0), empty)
    assert warc_archive.read_archive(spark, empty).count() == 0


def _sources(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(t / total,) for t in tokens], "p double")


def test_exponent_meets_its_target(spark):
    tokens = [9000, 500, 300, 200]
    shares = [t / 10_000 for t in tokens]

    def weights(a):
        z = sum(p**a for p in shares)
        return [p**a / z for p in shares]

    sources = _sources(spark, tokens)
    a = mixing.find_exponent(sources, mixing.Target(max_repeats=3.0))
    repeats = [w / p for w, p in zip(weights(a), shares, strict=True)]
    assert max(repeats) <= 3.0 and max(w / p for w, p in zip(weights(a - 1e-6), shares, strict=True)) > 3.0
    a = mixing.find_exponent(sources, mixing.Target(min_entropy=0.8))
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a)) / math.log(4)
    assert entropy(a) >= 0.8 > entropy(a + 1e-6)
    assert mixing.find_exponent(sources, mixing.Target(min_entropy=0.0)) == 1.0
    with pytest.raises(ValueError):
        mixing.find_exponent(sources, mixing.Target(max_repeats=0.5))


def test_mix_spends_the_budget(spark):
    texts = [(i, "a b c " * (i % 7 + 1)) for i in range(3000)]
    docs = odd_docs(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("s").cast("string"))
    found = mixing.mix(docs, mixing.Target(max_repeats=1.2)).collect()
    assert len(found) == 3000
    total = sum(r["n_tokens"] for r in found)
    for source in (None, "s"):
        own = [r for r in found if r["source"] == source]
        used, asked = sum(r["copies"] * r["n_tokens"] for r in own), own[0]["weight"] * total
        # The last document may not fit; the weight is shown to six digits.
        assert asked - 50 - total * 1e-6 < used <= asked + 1 + total * 1e-6
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
    rows = mixing.repeat_rows(docs, mixing.Target(max_repeats=1.2, budget_share=None))
    assert rows.columns == docs.columns
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == set(range(3000))


def test_mix_takes_odd_rows(spark):
    found = mixing.mix(odd_docs(spark), mixing.Target(max_repeats=1.5)).collect()
    assert len(found) == len(odd_texts())
    assert mixing.mix(no_docs(spark), mixing.Target(max_repeats=1.5)).count() == 0
    assert mixing.repeat_rows(no_docs(spark), mixing.Target(max_repeats=1.5)).count() == 0
