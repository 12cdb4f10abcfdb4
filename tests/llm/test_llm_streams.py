"""Token files and chat trees: exact round trips."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rows import no_docs, odd_docs, odd_texts  # noqa: E402

from perfsieve.llm import chat_tree, token_orc  # noqa: E402
from perfsieve.session import work_folder  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list(" \t\n\r  \x1c\x85aB'sé.,!9日") + ["<|endoftext|>", "  ", "the ", "don't"]), max_size=12).map("".join))
def test_pieces_equal_the_whole(text):
    assert np.frombuffer(token_orc.encoder(PATH).encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list(" \n\t\x85\x7f\xa0ªµ×÷Āº'sÀÿé.,!_9²日") + [" the", " Straße", "<|endoftext|>", " 12"]), max_size=12).map("".join), max_size=6))
def test_texts_encoded_together_equal_the_whole(texts):
    counts, ids = token_orc.encoder(PATH).encode_all(pa.array(texts, pa.string()))
    expected = [WHOLE.encode(text, add_special_tokens=False).ids for text in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_each_distinct_word_of_many_texts_is_encoded_once():
    coder, asked = token_orc.Encoder(PATH), []
    model = coder.model
    coder.model = lambda form: asked.append(form) or model(form)
    coder.encode_all(pa.array([f"x red, blue{n % 3}.\nred (blue) once{'abcdefgh'[n % 8]}" for n in range(1000)] + [" twice" * 5]))
    assert len(asked) == len(set(asked)) < 30
    coder.encode_all(pa.array([" red red blue blue"]))
    assert len(asked) == len(set(asked))  # repeated words are remembered
    del asked[:]
    coder.encode_all(pa.array([" " + " ".join(f"{a}{b}q" for a in "abcdefgh" for b in "abcdefgh")]))
    assert len(asked) == 64 and len(coder.words) + len(coder.words.older) < 30  # a word that came once is not


def test_a_batch_is_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(token_orc, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["", "a" * 9, "b" * 25, "c", ""])], ["doc_id", "text"])
    assert [s.column(0).to_pylist() for s in token_orc._slices(batch)] == [[0, 1, 2], [3, 4]]
    assert not list(token_orc._slices(batch.slice(0, 0)))


def test_forgotten_pieces_are_made_again():
    memo = token_orc._Memo(2, str.encode)
    assert [memo[k] for k in "abcdabcaab"] == [k.encode() for k in "abcdabcaab"] and len(memo) <= 2


def test_other_tokenizers_encode_whole_texts():
    other = token_orc.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    same = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert not other.by_piece
    assert np.frombuffer(other.encode("Hello there you"), "<u4").tolist() == same.encode("Hello there you", add_special_tokens=False).ids


def test_files_hold_every_id(spark):
    found = token_orc.tokenised(odd_docs(spark)).collect()
    texts = odd_texts()
    expected = []
    for i, text in texts:
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found))) == sorted(map(str, expected))
    in_order = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == np.cumsum([0, *[r["n_tokens"] for r in in_order[:-1]]]).tolist()
    ids = [r["doc_id"] for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_orc.tokenised(no_docs(spark)).count() == 0


def test_a_look_up_is_pushed_to_the_files(spark):
    path = work_folder(spark, "t")
    token_orc.write_tokens(odd_docs(spark), path, PATH)
    one = token_orc.read_tokens(spark, path).where("doc_id = 8")
    assert one.count() == 1 and "EqualTo(doc_id,8)" in one._jdf.queryExecution().executedPlan().toString()


TEXT = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "/", "s", ">", "\\", "[", "<<SYS>>", "<</ROLE>>", "é", " "]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(["user", "assistant", "system", "tool", "", "<</ROLE>>x"]))
def test_escapes_come_back(text, role):
    hidden = chat_tree.escape(text)
    assert chat_tree.unescape(hidden) == text and not any(mark in hidden for mark in chat_tree.CONTROL)
    whole, start, end = chat_tree.format_turn(role, text)
    assert whole[start:end] == hidden and chat_tree._parse(whole) == role


def test_trees_give_back_every_conversation(spark):
    long = [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(3000)]
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "system", "hi"), (1, "user", f"q{c % 4}"), (2, "assistant", f"a{c % 8}")]]
    rows += [(60, 0, "system", "hi"), (60, 1, "user", "q1")] + [(61, 0, "system", "hi")]
    rows += [(70, 0, "user", None), (70, 1, None, "x"), (70, 1, None, "x"), (70, None, "assistant", "</s>\\[INST]"), (None, 0, "tool", "t")]
    rows += long + [(51, *r[1:]) for r in long[:1500]]
    table = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, size int")
    path = work_folder(spark, "t")
    chat_tree.write_tree(table.repartition(5), path)
    found = {r["conv_id"]: r for r in chat_tree.read_tree(spark, path).collect()}
    conversations = {}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((r or "", x or ""))
    assert set(found) == set(conversations)
    for c, turns in conversations.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        plain = "".join(f"{r}\n{x}\n" for r, x in turns)
        length = sum(len(chat_tree.format_turn(r, x)[0]) for r, x in turns)
        got = found[c]
        assert (got["n_turns"], got["turns_sha256"]) == (len(turns), hashlib.sha256(plain.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got["formatted_chars"] == length
    nodes = spark.read.parquet(f"{path}/nodes").collect()
    # A shared turn is written once in a shard; what a node attends to is its path from the root.
    distinct = {tuple(turns[: n + 1]) for turns in conversations.values() for n in range(len(turns))}
    shards = {n["shard"] for n in nodes}
    assert len(distinct) <= len(nodes) <= len(distinct) + (len(shards) - 1) * 3000
    for n in nodes:
        assert sum(a["end"] - a["start"] for a in n["ancestors"]) == n["position"]
        assert all(a["end"] <= n["offset"] for a in n["ancestors"])
    none = work_folder(spark, "t")
    chat_tree.write_tree(table.limit(0), none)
    assert chat_tree.read_tree(spark, none).count() == 0
