"""Toxicity, decontamination, licences and pseudonyms."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rows import PROSE, SF, no_docs, odd_docs, odd_texts, plain_words  # noqa: E402

from perfsieve.llm import decontaminate, fm_index, licenses, pseudonyms, toxicity  # noqa: E402

BIG = "/root/testdata/sf0.1"


def test_ordinal_fit_finds_the_generating_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 3))
    latent = x @ np.array([1.5, -1.0, 0.0]) + rng.logistic(size=6000)
    grade = np.digitize(latent, [-0.5, 1.0])
    w, t = toxicity.fit_ordinal(x, grade, 3, penalty=0.1)
    assert np.abs(w - [1.5, -1.0, 0.0]).max() < 0.12 and np.abs(t - [-0.5, 1.0]).max() < 0.12


def test_held_out_toxic_documents_are_found(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    found = toxicity.grades(docs.where("doc_id % 2 = 1"), labels, sample=1)
    assert found.where("toxic").count() == 0
    model = toxicity.fit(docs, seen)
    scored = toxicity.with_severity(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id")
    rows = scored.select("toxic", (F.col("scored.any") >= 0.5).alias("said"), "scored.severity").collect()
    hit = sum(r["said"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    false = sum(r["said"] for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    # A tenth or so of the labels is wrong on purpose.
    assert hit > 0.5 and false < 0.1 and all(0 <= r["severity"] <= 2 for r in rows)


def test_toxic_documents_are_found_in_every_language(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.with_severity(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id")
    said = (F.col("scored.any") >= 0.5).cast("int")
    rows = held.groupBy("lang", "toxic").agg(F.avg(said).alias("said")).collect()
    share = {(r["lang"], r["toxic"]): r["said"] for r in rows}
    assert all(share[lang, 1] > 0.7 and share[lang, 0] < 0.05 for lang in ("en", "de", "fr", "es")), share


def test_toxic_documents_of_a_small_table_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    graded = toxicity.grades(docs, labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").select("toxic", "said").collect()
    assert sum(r["said"] for r in graded if r["toxic"]) >= 5 and not any(r["said"] for r in graded if not r["toxic"])
    # Labels that tell nothing choose no features.
    odd = docs.select("doc_id", (F.xxhash64("doc_id") % 8 == 0).cast("int").alias("toxic"))
    assert toxicity.grades(docs, odd).where("toxic").count() == 0


def test_the_sample_holds_rare_labels_and_keeps_their_share(spark):
    texts = [(i, f"{'awful' if i % 50 == 0 else 'kind'}{i % 7} word") for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i, _ in texts], "doc_id long, toxic int")
    graded = toxicity.grades(odd_docs(spark, texts), labels, sample=80)
    assert graded.where("toxic").count() == 40 and graded.where("toxic AND doc_id % 50 != 0").count() == 0


def test_toxicity_takes_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (9, 0), (9, 1)], "doc_id long, toxic int")
    docs = odd_docs(spark)
    assert toxicity.grades(docs, labels).count() == len(odd_texts())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts())
    assert toxicity.without_toxic(no_docs(spark), labels.limit(0)).count() == 0
    model = toxicity.OrdinalModel({b"idiot": 5.0}, (2.0, 4.0))
    gone = toxicity.with_severity(odd_docs(spark, [(1, "you idiot"), (2, None), (3, "kind")]), model)
    assert {r["doc_id"]: r["scored"]["any"] > 0.5 for r in gone.collect()} == {1: True, 2: False, 3: False}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_finds_what_a_scan_finds(runs, phrases):
    text = np.array([s for r in runs for s in [*r, 0]], np.int32)
    table = np.zeros((len(phrases), 5), np.int32)
    for n, p in enumerate(phrases):
        table[n, 5 - len(p) :] = p
    index = fm_index.FmIndex(text, 6, rate=3)
    found = {(int(p), int(a)) for ps, at in index.occurrences(table) for p, a in zip(ps, at, strict=True)}
    flat = text.tolist()
    assert found == {(n, i) for n, p in enumerate(phrases) for i in range(len(flat)) if flat[i : i + len(p)] == p}


def plain_hits(text, items, window=10):
    w = plain_words(text)
    hit, named = set(), set()
    for item, body in items:
        b = plain_words(body)
        for s in range(max(1, len(b) - window + 1) if b else 0):
            p = b[s : s + window]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    named |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, PROSE), (2, PROSE.upper() + " and more"), (3, "w40 w41"), (4, None), (5, "!!"), (None, "w10 w11 w12"), (20, "one")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_equals_a_scan(spark, block_bytes):
    texts = [t for t in odd_texts() if t[0] != 11] + [(30, "so. " + PROSE.replace(" ", ", ") + " one w40\nW41")]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, hits string")
    found = decontaminate.contamination(odd_docs(spark, texts), items, block_bytes=block_bytes).collect()
    expected = [(i, *plain_hits(t, ITEMS)) for i, t in texts]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert decontaminate.contamination(no_docs(spark), items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd_docs(spark), items.limit(0)).collect())


def test_no_window_is_left_after_the_cut(spark):
    items = [(1, "a b c d e f g h i j k"), (3, "p q")]
    texts = [(1, "x a b c d a, b c d e f g h i j k! e f g h i j k z"), (2, "Clean Text."), (3, None), (4, "p p q q end")]
    docs = odd_docs(spark, texts)
    cleaned = decontaminate.remove_passages(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert cleaned.columns == docs.columns and got[2] == "Clean Text." and got[3] is None
    assert all(plain_hits(t, items)[1] == 0 for t in got.values()) and got[1].startswith("x") and got[1].endswith("z")


def test_shards_of_any_size_find_the_same():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 300))).encode() for _ in range(20)]
    phrases = decontaminate.Phrases([("1", b"a b a b c"), ("2", b"c c a b c a a b c b a b")], 10)
    whole = decontaminate.find(texts, phrases)
    assert whole == decontaminate.find(texts, phrases, limit=40) and any(spans for _, spans, _ in whole)


def test_licences_are_named_and_prose_is_not(spark):
    texts = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"),
        (3, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
        (4, "He was granted a licence to fish, free of charge, under the bridge.\nThe work was published in the following year."),
    ]
    docs = odd_docs(spark, texts + [t for t in odd_texts() if t[0] not in (1, 2, 3, 4)])
    rows = licenses.license_families(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    assert [found[i]["families"] for i in (1, 2, 3, 4)] == ["apache-2.0", "mit", "cc-by-nc,gpl-3.0", ""]
    assert found[1]["n_paragraphs"] == 3 and found[5]["n_paragraphs"] == 1 and found[8]["families"] == ""
    assert licenses.license_families(no_docs(spark)).count() == 0


def test_paragraphs_without_a_telling_word_are_not_scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scanner = licenses.Scanner(docs)
    assert scanner.anchors
    inside = "\n".join(f"x{a}x" for a in scanner.anchors)
    whole = "\n".join(["", *[f"({a.upper()})" for a in scanner.anchors], "Straße"])
    rows = spark.createDataFrame([(1, inside), (2, whole), (3, None), (4, "")], "doc_id long, text string")
    kept = {r["doc_id"]: [c["paragraph"] for c in r["c"]] for r in rows.select("doc_id", scanner.candidates(F.col("text")).alias("c")).collect()}
    assert kept == {1: [], 2: list(range(1, len(scanner.anchors) + 1)), 3: [], 4: []}
    few = sorted(map(str, scanner.scan(docs).collect()))
    scanner.anchors = None  # every paragraph is scored
    assert few == sorted(map(str, scanner.scan(docs).collect())) and few


NAMES = pseudonyms.Pseudonymiser("a key")
GOOD = [
    "4111 1111 1111 1111", "4041894974608795", "+1 (017) 555-7713", "+49 30 1234567", "97.51.17.173", "123-45-6789",
    "GB82 WEST 1234 5698 7654 32", "2020-02-29", "29.02.2020", "12/31/1999", "25/03/2020", "12 March 2020", "May 1, 2001", "für.68@mail7.example.com",
]


@pytest.mark.parametrize("value", GOOD)
def test_pseudonyms_keep_format_and_come_back(value):
    text = f"So {value}, and {value}! x"
    new, found = NAMES.replace(text)
    assert len(found) == 2 and value not in new and NAMES.replace(new, back=True)[0] == text
    shown = new[3 : new.index(", and")] if "," not in value else None
    if shown:
        assert [c.isdigit() for c in shown] == [c.isdigit() for c in value] or "March" in value or value.count(".") == 3
        assert new.count(shown) == 2 and NAMES.replace(f"a {shown} b")[1]
    assert pseudonyms.Pseudonymiser("other").replace(text)[0] != new


@pytest.mark.parametrize("after", ["Please", "P", "BIC COBADEFF", "12 March 2021", "2024-01-05", "05.01.2024", "12/31/2021", "12 apples", "A12"])
@pytest.mark.parametrize("value", [*GOOD, "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "+1 555-555-7713", "+49 30 1234567"])
def test_values_end_where_the_next_text_begins(value, after):
    text = f"So {value} {after}"
    new, found = NAMES.replace(text)
    assert text[found[0][1] : found[0][2]] == value and value not in new
    # One value has one pseudonym, whatever follows it.
    assert new.startswith(NAMES.replace(f"So {value}")[0] + " ")
    assert NAMES.replace(new, back=True)[0] == text


def test_a_phone_of_many_groups_stops_before_a_date_or_card():
    for after in ("2024-01-05", "05.01.2024", "12 March 2021", "4111 1111 1111 1111"):
        text = f"+49 30 1234 5678 {after}"
        new, found = NAMES.replace(text)
        assert found[0] == ("phone", 0, 16) and len(found) == 2 and NAMES.replace(new, back=True)[0] == text


def test_what_fails_its_check_stays():
    text = "4041894974608796 300.1.1.1 000-12-3456 2021-02-29 31.04.2020 GB82 WEST 1234 5698 7654 33 v2.0. 13/13/2020 1234567890123456789012 a@b"
    assert NAMES.replace(text) == (text, [])


def test_dates_are_linked_across_formats():
    new = [NAMES.replace(d)[0] for d in ("2020-03-05", "05.03.2020", "03/05/2020", "5 March 2020")]
    days = {dt.date.fromisoformat(new[0]), dt.datetime.strptime(new[1], "%d.%m.%Y").date(), dt.datetime.strptime(new[2], "%m/%d/%Y").date(), dt.datetime.strptime(new[3], "%d %B %Y").date()}
    assert len(days) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.text(max_size=5))
def test_feistel_is_a_permutation(n, key):
    f = pseudonyms.Feistel(key)
    some = range(0, n, max(1, n // 50))
    images = [f.permute("k", n, v) for v in some]
    assert len(set(images)) == len(images) and all(0 <= i < n for i in images)
    assert [f.permute("k", n, i, back=True) for i in images] == list(some)


def test_pseudonymised_rows(spark):
    docs = odd_docs(spark, [*odd_texts(), (40, "ip 97.51.17.173 x"), (41, "also 97.51.17.173"), (42, "9" * 100_000)])
    new = pseudonyms.pseudonymise(docs, "k", kinds="found")
    got = {r["doc_id"]: r for r in new.collect()}
    assert new.columns == [*docs.columns, "found"] and got[4]["text"] is None and got[42]["text"] == "9" * 100_000
    assert got[40]["found"] == ["ip"] and got[40]["text"].split()[1] == got[41]["text"].split()[1] != "97.51.17.173"
    assert {i: r["text"] for i, r in got.items() if i not in (40, 41)} == {i: t for i, t in [*odd_texts(), (42, "9" * 100_000)]}
    back = pseudonyms.pseudonymise(new.drop("found"), "k", back=True).where("doc_id = 40").first()
    assert back["text"] == "ip 97.51.17.173 x"
    assert pseudonyms.pseudonymise(no_docs(spark), "k").count() == 0
