"""Small tables with the odd cases, and plain counterparts of shared helpers."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog while seven bright stars turn slowly above a quiet northern harbour"
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, copies string,"
    " bands string, key string, m_id long, g_id long, _hits string, node string, label string"
)


def odd_texts() -> list[tuple[int | None, str | None]]:
    other = " ".join(f"w{i}" for i in range(60))
    near = other.replace("w30 ", "x30 ")
    return [
        (1, PROSE),
        (2, PROSE),
        (3, PROSE.replace(" ", "\t \n", 1)),
        (4, None),
        (5, ""),
        (6, "one"),
        (7, "one two three"),
        (8, other),
        (9, near),
        (9, near),
        (10, "Überall  Straße   größer,é! 𝒳𝒴 <|endoftext|> \x1c x\r\n\ty "),
        (11, " ".join(f"long{i % 977} word" for i in range(40_000))),
        (None, "no id here at all, but some words"),
        (None, None),
        (12, "   "),
        (13, PROSE + " " + other),
    ]


def odd_docs(spark, texts=None):
    rows = [
        (i, t, "en", None if n % 3 == 0 else f"src{n % 2}", len(t or ""), "d", 7, "c", "b", "k", 1, 2, "h", "n", "l")
        for n, (i, t) in enumerate(odd_texts() if texts is None else texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def plain_words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
