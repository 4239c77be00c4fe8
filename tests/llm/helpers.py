"""Fixtures of the training-data operators."""

from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
#: Column names that operators use inside.
CLASHES = ["_id", "_text", "_row", "id", "fp", "key", "size", "kept", "keep_id", "target", "host", "row", "unit", "payload", "_dropped", "_gone_id", "_gone_hash", "_row_hash", "_hash", "hash", "first", "_keep", "_n", "_kept", "_len", "_prefix"]
LONG = "word " * 30_000 + "end"


def awkward(spark, extra=()):
    """Documents with nulls in every column, empty, blank and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, "same text here", "en", "a"),
        (2, "same  text\there", "en", "a"),
        (3, " same text here\n", "en", None),
        (4, None, None, "b"),
        (5, "", "en", "b"),
        (6, " \t\n", "de", "b"),
        (7, LONG, "en", "a"),
        (8, LONG, "en", "a"),
        (9, "alone", None, None),
        (9, "alone", None, None),
        (None, "no id", "en", "c"),
        (10, "é x \U0001f600", "fr", "c"),
        *extra,
    ]
    rows = [(*r, len(r[1] or ""), *range(len(CLASHES))) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))


def empty(spark):
    return awkward(spark).limit(0)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
