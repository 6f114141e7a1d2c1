"""Native column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words: space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(col: str | Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    blanks = "\t\n\x0b\x0c\r"
    spaced = F.translate(text_of(col), blanks, " " * len(blanks))
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


def word_count(col: str | Column) -> Column:
    """Number of words as long; null and empty texts have 0."""
    return F.size(words_of(col)).cast("long")


def fold(col: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % of == rest


def uniform(*cols: str | Column, seed: str) -> Column:
    """A number in (0, 1) from the MD5 of the columns' texts; the same on every run and engine."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    head = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)
