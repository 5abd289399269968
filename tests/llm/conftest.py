from __future__ import annotations

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and blank texts, repeated rows, tied ids, odd separators, letters beyond ASCII, a very long text.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (4, "one"),
    (5, "Two\x0bwords"),
    (5, "tied id, other text"),
    (None, "a row without an id"),
    (6, "é ß ñ \x1c  日本 😀 x"),
    (7, "same line\nsame line\n\nsame line\n other"),
    (8, "The quick Brown fox " * 40),
    (9, "long " * 30_000 + "end"),
    (10, " ".join(f"w{i}" for i in range(80))),
    (11, "before " + " ".join(f"w{i}" for i in range(20, 70)) + " after"),
    (12, " ".join(f"w{i}" for i in range(80))),
]


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="session")
def edges(spark):
    """Edge cases, with further columns whose names the operators use inside."""
    rows = [(i, t, "en", "src0", len(t or ""), 0, "x", -1, None) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, kept string, row int, spans string").repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
