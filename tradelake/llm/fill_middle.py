"""Fill-in-the-middle transformation: prefix, suffix and middle of a text in the order a model is to learn them.

A text is cut between its units (runs of ASCII letters, and every other code point by itself). The cut needs no positions and
no Python: the delimiter is escaped in the text, regexp_replace() appends it behind every unit, its occurrences are counted,
substring_index() takes the units up to a rank, and the escapes are undone. All of it is one projection, so a document never
leaves its row or its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.llm.common import fresh, text_of

#: What is put before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that stay plain, and of the others that put the suffix first.
PLAIN_FROM = 90
SUFFIX_FIRST = 20
SEED = 1

#: The delimiter and the escape; in an escaped text every escape is followed by "1" (a delimiter) or "2" (an escape).
DELIMITER, ESCAPE = "\x01", "\x02"
UNIT = f"[A-Za-z]+|{ESCAPE}[12]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    """text without a delimiter in it."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(marked: Column) -> Column:
    """The text of what escaped() and delimiters made of it."""
    bare = F.translate(marked, DELIMITER, "")
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def marked_units(text: Column) -> Column:
    """The escaped text with a delimiter behind each unit."""
    return F.regexp_replace(escaped(text), f"({UNIT})", f"$1{DELIMITER}")


def n_units(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.translate(marked, DELIMITER, ""))).cast("long")


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 that depend on the id and the seed only; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _ranked(marked: Column, count: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count.cast("int"))


@dataclass(frozen=True)
class Parts:
    prefix: Column
    middle: Column
    suffix: Column


def parts(marked: Column, n: Column, first: Column, second: Column) -> Parts:
    """The n marked units up to the place first, from there to second, and the rest, unescaped."""
    head = _ranked(marked, second)
    # the marked text ends with a delimiter, so one more rank from behind is an empty one
    return Parts(unescaped(_ranked(marked, first)), unescaped(_ranked(head, first - second)), unescaped(_ranked(marked, second - n - 1)))


def restored(output: Column, form: Column) -> Column:
    """The text of an output and its form. No part holds a marker, and none of the markers can overlap another, so each is found as
    it was put in."""

    def after(marker: str) -> Column:
        return F.call_function("substring_index", output, F.lit(marker), F.lit(-1))

    def between(marker: str, end: str) -> Column:
        return F.call_function("substring_index", after(marker), F.lit(end), F.lit(1))

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs with n (units), form, output, prefix_chars and middle_chars (code points, null if plain), a row for each row.

    form is plain if the text is empty, holds a marker or was drawn to be left; else psm or spm by the order of the parts. A null
    text is empty, and so plain; so is the draw's id where it is null. Rows that repeat an id get the same draws, and the same cut if
    their texts are equal too. A very long text stays in its row, which holds a few times its length. An empty table
    gives no rows; columns of docs that have the name of a new one are replaced.
    """
    names = ["n", "form", "output", "prefix_chars", "middle_chars"]
    text, marked, n, low, high, form, prefix, middle, suffix = fresh(docs, "_text", "_marked", "_units", "_low", "_high", "_form", "_prefix", "_middle", "_suffix")
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    whole = docs.withColumn(text, text_of(text_col))
    whole = whole.withColumn(marked, marked_units(F.col(text)))
    whole = whole.withColumn(n, n_units(F.col(marked)))
    places = F.col(n) + 1
    has_marker = F.greatest(*[F.contains(F.col(text), F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (F.col(text) == "") | has_marker | (h3 % 100 >= PLAIN_FROM)
    whole = whole.withColumns({
        low: F.least(h1 % places, h2 % places),
        high: F.greatest(h1 % places, h2 % places),
        form: F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm"),
    })
    cut = parts(F.col(marked), F.col(n), F.col(low), F.col(high))
    is_cut = F.col(form) != "plain"
    whole = whole.withColumns({prefix: F.when(is_cut, cut.prefix), middle: F.when(is_cut, cut.middle), suffix: F.when(is_cut, cut.suffix)})
    lit = F.lit
    output = (
        F.when(F.col(form) == "psm", F.concat(lit(PREFIX), prefix, lit(SUFFIX), suffix, lit(MIDDLE), middle))
        .when(F.col(form) == "spm", F.concat(lit(SUFFIX), suffix, lit(PREFIX), prefix, lit(MIDDLE), middle))
        .otherwise(F.col(text))
    )
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return whole.select(*own, F.col(n).alias("n"), F.col(form).alias("form"), output.alias("output"), F.char_length(prefix).cast("long").alias("prefix_chars"), F.char_length(middle).cast("long").alias("middle_chars"))
