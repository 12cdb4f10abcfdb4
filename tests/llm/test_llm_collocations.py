"""Collocations against plain counting; the trie with tiny bounds against a Counter."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import connect, differences  # noqa: E402
from rows import no_docs, odd_docs, odd_texts  # noqa: E402

from perfsieve.llm import collocations, hat_trie  # noqa: E402


def plain_pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain_counts(texts, longest):
    counts = Counter()
    for text in texts:
        for words in plain_pieces(text):
            for size in range(1, longest + 1):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts


def plain(rows, longest, least, most):
    by = defaultdict(list)
    for text, lang in rows:
        by["und" if lang is None else lang].append(text)
    out = []
    for lang, texts in by.items():
        f = plain_counts(texts, longest)
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        covered = defaultdict(int)
        for p, c in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], c)
        rows_ = []
        for p, a in candidates.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * covered[p] < 50 * a or not covered[p]:
                rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    found = collocations.op12_collocations(spark, sf)
    assert differences(found, connect(sf), collocations.CHECKS["op12_collocations"]) is None
    assert found.count() > 1000


def hard_rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "a\x1cb", "naïve", " x", "x|y"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\r\n"]
    rows = []
    for n in range(120):
        size = rng.choice([0, 1, 2, 3, 30, 200])
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(size))
        rows.append((rng.choice([text, text.upper(), None if n % 17 == 0 else text]), rng.choice(["en", "de", None, "und"])))
    return [*rows, *[("same same words again", "en")] * 50, ("one " * 3000, "hot")]


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counting(spark, longest, small, monkeypatch):
    if small:  # every text is cut, every container bursts, everything spills
        monkeypatch.setattr(collocations, "SLICE", 40)
        monkeypatch.setattr(hat_trie, "CHUNK", 16)
        monkeypatch.setattr(hat_trie, "BURST", 4)
        monkeypatch.setattr(hat_trie, "MOST_ENTRIES", 60)
        monkeypatch.setattr(hat_trie, "VOCABULARY_BYTES", 30)
    # Values set here do not reach the workers, so the small run counts in this process.
    rows = hard_rows()
    if small:
        named = [(t, lang or "und") for t, lang in rows]
        assert local_counts(named, longest) == wanted_counts(named, longest)
        return
    if longest == 1:
        return
    docs = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, n long, phrase string").repartition(5)
    found = collocations.collocations(docs, longest, least=4, most=25)
    assert sorted(map(tuple, found.collect())) == plain(rows, longest, 4, 25)


def wanted_counts(rows, size):
    out = Counter()
    for lang in {lang for _, lang in rows}:
        for p, c in plain_counts([t for t, x in rows if x == lang], size).items():
            if len(p) == size:
                out[lang, " ".join(p)] += c
            if len(p) == 1:
                out[lang, ""] += c
    return out


def local_counts(rows, size, known=None):
    counting = hat_trie.Counting(size, known) if size > 1 else hat_trie.WordCounting()
    found, runs = Counter(), 0

    def take(batches):
        nonlocal runs
        for batch in batches:
            table = batch.to_pylist()
            runs += 1
            words = [r["phrase"].split(" ") for r in table]
            assert words == sorted(words, key=lambda w: [x.encode() for x in w]) or not table[0]["phrase"]
            for r in table:
                assert not r["phrase"] or len(r["phrase"].split(" ")) == size
                found[r["lang"], r["phrase"]] += r["n"]

    for text, lang in rows:
        tokens, context = [], 0
        for part in collocations.token_slices((text or "").encode()):
            tokens.extend(part)
            take(counting.feed(lang, tokens, context))
            context = min(len(tokens), size - 1)
            tokens = tokens[len(tokens) - context :]
    take(counting.finish())
    assert runs > (20 if known is None and size > 1 else 3)
    return Counter({k: v for k, v in found.items() if v})


def test_runs_with_a_part_that_is_not_known_stay_out(spark, monkeypatch):
    rows = [(t, lang or "und") for t, lang in hard_rows()]
    monkeypatch.setattr(hat_trie, "MOST_ENTRIES", 60)
    monkeypatch.setattr(hat_trie, "BURST", 4)
    words = spark.createDataFrame([("en", f"w{i}") for i in range(4)] + [("de", "Über".lower()), ("de", "w7")], "lang string, phrase string")
    known = collocations.known_phrases(words)
    listed = {(r["lang"], r["phrase"]) for r in words.collect()}
    wanted = Counter({k: v for k, v in wanted_counts(rows, 2).items() if not k[1] or all((k[0], w) in listed for w in k[1].split(" "))})
    found = local_counts(rows, 2, known)
    assert not wanted - found  # none is lost
    strange = {k for k in found if k not in wanted}
    assert len(strange) <= 0.2 * len(wanted_counts(rows, 2))  # chance hits only
    none = collocations.known_phrases(words.limit(0))
    assert not none.words.any()


def test_a_container_bursts_by_prefixes(monkeypatch):
    monkeypatch.setattr(hat_trie, "BURST", 8)
    trie = hat_trie.Trie(3, 21)
    codes = [(a << 42) | (b << 21) | c for a in range(1, 5) for b in range(1, 4) for c in range(0, 6)]
    trie.add(np.array(codes * 2, np.int64))
    lows = [c.low for c in trie.containers]
    assert lows == sorted(set(lows)) and len(lows) > 4 and all(low % (1 << 21) == 0 for low in lows)
    assert sum((c.counts for c in trie.containers), Counter()) == Counter(codes * 2)
    for c, after in zip(trie.containers, [*lows[1:], 1 << 63]):
        assert len(c.counts) <= 8 and all(c.low <= key < after for key in c.counts)
    trie.add(np.full(50, codes[7], np.int64))
    hot = hat_trie.Trie(3, 21)
    hot.add(np.array([(1 << 42) | (1 << 21) | c for c in range(1, 100)], np.int64))  # one prefix: cut between last words
    assert len(hot) == 99 and max(len(c.counts) for c in hot.containers) <= 8


def test_odd_rows(spark):
    found = collocations.collocations(odd_docs(spark), least=2, most=50)
    rows = [(t, "en") for _, t in odd_texts()]
    assert sorted(map(tuple, found.collect())) == plain(rows, 3, 2, 50)
    assert collocations.collocations(no_docs(spark)).count() == 0
    empty = spark.createDataFrame([(None, None), ("", "en"), (" \t.,", "en")], "text string, lang string")
    assert collocations.collocations(empty, least=1).count() == 0


def test_scores_with_products_beyond_64_bits(spark):
    big = 90_000_000_000_000
    rows = [("en", "x y", 2, big - 7), ("en", "x", 1, big), ("en", "y", 1, big - 1), ("en", "z", 1, big)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    row = collocations.scored(counted, 3).first()
    assert row["score"] == 1_000_000 * (big - 7) ** 2 // (big * (big - 1)) and (row["l"], row["r"]) == (big, big - 1)
