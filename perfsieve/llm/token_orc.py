"""Token ids in ORC files: run-length coded id lists, row indexes and Bloom filters on document ids.

Documents are dealt by range of their id and sorted, so the files follow each other in id order;
each file holds its rows' starts relative to its own first token, and one narrow read over file
totals turns them into starts in the whole collection. Stripes can be read in parallel, and a look-up
by id skips files and stripes by their statistics and Bloom filters.

With a byte-level pre-tokenizer every space between two other characters begins a new piece, so a
text's ids are its pieces' ids one after another. A slice of texts is split at its spaces, its distinct
pieces are cut into words where the class of the characters changes, and each distinct word goes once
to the library's tokenizer, which a task (or worker, if asked) remembers; the ids are gathered back as
arrays. Pieces with characters of uncertain class are cut by the pre-tokenizer's own expression. Texts
where a space touches other white space, and tokenizers of another make, are encoded whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfsieve.llm.common import give_back, table, tidy
from perfsieve.session import work_folder

END_ID = 0
# Pieces and words a task remembers, per generation; about 220 bytes each.
MEMO = 250_000
DOCS_PER_BATCH = 256
# Texts that are split together; one text may be longer.
SLICE_BYTES = 24 << 20
STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("part_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.field("element", pa.int32(), nullable=False))),
    ]
)


# Classes of UTF-8 bytes. Beyond ASCII only the letters from U+00C0 to U+00FF have one: first byte C3, and D7 and F7 are signs.
_SPACE, _LETTER, _DIGIT, _MARK, _BREAK, _OTHER = range(6)


def _class(byte: int) -> int:
    if byte == 0xC3 or 0x80 <= byte <= 0xBF and byte not in (0x97, 0xB7):
        return _LETTER
    char = chr(byte)
    if byte >= 0x80 or byte < 0x20 and char != "\n" or char in "'\x7f":
        return _OTHER
    return _LETTER if char.isalpha() else _DIGIT if char.isdigit() else {" ": _SPACE, "\n": _BREAK}.get(char, _MARK)


_CLASSES = np.array([_class(b) for b in range(256)], np.uint8)


def _ids(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids in each, and all ids."""
    return np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<i4")


def _either(first: np.ndarray, one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sets of lists of ids as one (lengths, ids), and the place there of each item: the next of ``one`` where ``first`` holds."""
    place = np.where(first, np.cumsum(first) - 1, len(one[0]) + np.cumsum(~first) - 1)
    return np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]]), place


def _gathered(counts: np.ndarray, ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lists of ids, given by their lengths, one after another in the order asked for."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
    return lists.take(pa.array(order)).flatten().to_numpy()


class _Memo(dict):
    """A dictionary of two generations: what was not asked for during one generation is forgotten."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.older = size, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts to little-endian 32-bit ids, equal to encoding each whole text with the tokenizer."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        form = json.loads(self.tokenizer.to_str())
        before = form.get("pre_tokenizer") or {}
        self.by_piece = (
            form["model"].get("type") == "BPE"
            and not form["model"].get("dropout")
            and form.get("normalizer") is None
            and form.get("truncation") is None
            and form.get("padding") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and not before.get("add_prefix_space")
            and not any(t["rstrip"] or " " in t["content"] for t in form.get("added_tokens", []))
        )
        self.marks = [t["content"] for t in form.get("added_tokens", [])]
        # The split of byte-level pre-tokenizers (fixed value).
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # Characters on which libraries disagree whether they are white space.
        self.odd = regex.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.letters = {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}
        self.alphabet = np.array([0, *[ord(self.letters[b]) for b in range(1, 256)]], "<u4")
        self.words = _Memo(memo * 4 // 5, self._word)
        self.pieces = _Memo(memo, self._piece)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token, handed to the model in the alphabet that byte-level models use."""
        ids = [t.id for t in self.model(word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _rare_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many without a zero character, none remembered: the numbers of ids, and the ids."""
        if not words:
            return _ids([])
        forms = self.alphabet[np.frombuffer("\0".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")
        ids, ends, model = array("i"), array("q", [0]), self.model
        for form in forms:
            ids.extend([t.id for t in model(form)])
            ends.append(len(ids))
        return np.diff(np.array(ends)), np.array(ids, "<i4")

    def _parts(self, text: str) -> bytes:
        if self.odd(text) or any(m in text for m in self.marks):
            return self._plain(text)
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def _piece(self, piece: str) -> bytes | None:
        """What follows a space; None where its white space could belong to its neighbour."""
        if not piece or piece[-1].isspace():
            return None
        return self._parts(" " + piece)

    def rest(self) -> None:
        """Between tasks a worker keeps the newer words only, so that other operators find memory."""
        self.pieces.clear()
        self.pieces.older, self.words.older = {}, {}

    def _distinct(self, pieces: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces that occur ``times``, a space before each, to ids: numbers of ids, the ids, each piece's place
        among them, and which pieces' white space could belong to a neighbour. Words that come once are not remembered."""
        spaced = pc.binary_join_element_wise("", pieces, " ")
        starts = np.frombuffer(spaced.buffers()[1], np.int32)[: len(pieces) + 1]
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[: starts[-1]]
        kind = _CLASSES[data]
        before = np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8)
        unsure = (kind == _OTHER) | (kind == _BREAK) & ((before == _BREAK) | (before == _SPACE))
        last = kind[starts[1:] - 1]
        hard = np.logical_or.reduceat(unsure, starts[:-1]) | (last == _SPACE) | (last == _BREAK)
        for mark in self.marks:
            hard |= pc.match_substring(pieces, mark).to_numpy(zero_copy_only=False)
        edge = (kind != before) & (before != _SPACE)
        edge[starts[:-1]] = True
        at = np.flatnonzero(edge).astype(np.int32)
        ends = pa.py_buffer(np.append(at, starts[-1]).astype(np.int32))
        owner = np.repeat(np.arange(len(pieces)), np.add.reduceat(edge, starts[:-1], dtype=np.int64))
        easy = ~hard[owner]
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, spaced.buffers()[2]])
        words = words.filter(pa.array(easy)).cast(pa.string()).dictionary_encode()
        which = words.indices.to_numpy()
        often = np.bincount(which, times[owner[easy]], len(words.dictionary)) > 1
        counts, ids, place = _either(
            often,
            _ids(list(map(self.words.__getitem__, words.dictionary.filter(pa.array(often)).to_pylist()))),
            self._rare_words(words.dictionary.filter(pa.array(~often)).to_pylist()),
        )
        which = place[which]
        by_word = np.concatenate([[0], np.cumsum(counts[which])])
        by_piece = np.concatenate([[0], np.cumsum(np.bincount(owner[easy], minlength=len(pieces))[~hard])])
        others = list(map(self.pieces.__getitem__, pieces.filter(pa.array(hard)).to_pylist()))
        open_ended = np.zeros(len(pieces), bool)
        open_ended[hard] = [o is None for o in others]
        cut = np.diff(by_word[by_piece]), _gathered(counts, ids, which)
        return *_either(~hard, cut, _ids([o or b"" for o in others])), open_ended

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text (none is null), and the ids of all one after another."""
        if not self.by_piece or not len(texts):
            return _ids([self._plain(text) for text in texts.to_pylist()])
        split = pc.split_pattern(texts, " ")
        cuts = split.offsets.to_numpy().astype(np.int64)
        firsts = cuts[:-1]
        pieces = split.flatten().dictionary_encode()
        numbers = pieces.indices.to_numpy()
        counts, ids, place, open_ended = self._distinct(pieces.dictionary, np.bincount(numbers))
        # No space comes before a text's first piece, so it is encoded apart, and so are texts that cannot be cut.
        unsure = open_ended[numbers]
        unsure[firsts] = False
        whole = set((np.searchsorted(cuts, np.flatnonzero(unsure), "right") - 1).tolist())
        order, apart = place[numbers], []
        for row, head in enumerate(pieces.dictionary.take(pa.array(numbers[firsts])).to_pylist()):
            if row in whole or head[-1:].isspace():
                order[cuts[row] : cuts[row + 1]] = len(counts) + len(texts)
                head = texts[row].as_py()
            apart.append(self._parts(head))
        order[firsts] = len(counts) + np.arange(len(texts))
        apart_counts, apart_ids = _ids([*apart, b""])
        counts = np.concatenate([counts, apart_counts])
        return np.add.reduceat(counts[order], firsts), _gathered(counts, np.concatenate([ids, apart_ids]), order)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[1].astype("<i4").tobytes()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder per tokenizer and Python worker."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = Encoder(path, memo)
    return _ENCODERS[path, memo]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (column 1) begin within the same ``SLICE_BYTES``."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    slice_of = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(sizes)]
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        if end > at:
            yield batch.slice(at, end - at)


def _encode(path: str, end_id: int, memo: int, keep: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, coder = TaskContext.get().partitionId(), 0, encoder(path, memo)
        for batch in batches:
            for some in _slices(batch):
                counts, ids = coder.encode_all(some.column(1).cast(pa.string()))
                ids = pa.array(np.insert(ids, np.cumsum(counts), end_id))
                counts += 1
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), ids, type=_ARROW.field("ids").type
                )
                parts = pa.array(np.full(len(counts), part, np.int32))
                columns = [some.column(0), parts, pa.array(start + ends - counts), pa.array(counts), lists]
                rows = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
                start += int(ends[-1])
                for at in range(0, rows.num_rows, DOCS_PER_BATCH):
                    yield rows.slice(at, DOCS_PER_BATCH)
            give_back()
        if not keep:
            coder.rest()

    return tidy(encode)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    memo: int = MEMO,
    keep: bool = False,
) -> None:
    """Write the ids of every document below ``path``, in ascending id order (null ids first).

    With ``keep`` a Python worker's memory of pieces, bounded by ``memo``, outlives the task and serves the next.

    Null texts are empty: the end id alone. Rows that share an id are ordered by a hash of their
    text; equal rows follow each other. An empty table leaves no rows; other columns are not read.
    The number of files follows spark.sql.shuffle.partitions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The hash parts rows without an id, or with one that many texts share, into several ranges.
    keys = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (
        dealt.mapInArrow(_encode(tokenizer, end_id, memo, keep), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, as the files have them.

    A filter on doc_id reaches the files: statistics and Bloom filters skip stripes without the id.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), files["part"] == offsets["of"]).select(
        "doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


FACTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_FACTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")).cast("B")
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if (counts != batch.column(2).to_numpy()).any():
            raise ValueError("a file's token count differs from its ids")
        ends = np.cumsum(counts) * 4
        sums = [zlib.crc32(data[e - 4 * n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts), pa.array(sums, pa.int64())], schema=_FACTS
        )


def token_facts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers) per document."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(_facts), FACTS)


def tokenised(docs: DataFrame, tokenizer: str | None = None, memo: int = MEMO, keep: bool = False) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared place and give the facts read back from it."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = work_folder(docs.sparkSession, "token-orc")
    write_tokens(docs, path, str(tokenizer), memo=memo, keep=keep)
    return token_facts(docs.sparkSession, path)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Tokenising is all this job does: no other operator waits for the workers' memory.
    return tokenised(table(spark, sf_dir, "documents"), keep=True)


QUERIES = {"op1_token_orc": _query}
CHECKS: dict[str, str] = {}
