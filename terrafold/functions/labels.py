"""Texts, numbers and yes/no labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean yes and no, in lower case without accents.
YES = ("si", "s", "yes", "y", "1", "true", "presencia", "presence", "positive", "positivo")
NO = ("no", "n", "0", "false", "ausencia", "absence", "negative", "negativo")
# Accented letters and what they become.
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"
# What counts as missing.
MISSING = ("", "nan", "none", "nat", "null")


def plain(v: Column) -> Column:
    """Lower case, trimmed, without accents."""
    return F.translate(F.lower(F.trim(v.cast("string"))), ACCENTED, PLAIN)


def clean_text(v: Column) -> Column:
    """Trimmed text; null where it says nothing."""
    text = F.trim(v.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def clean_number(v: Column) -> Column:
    """A finite double or null; a decimal comma is read as a point."""
    x = F.regexp_replace(F.trim(v.cast("string")), ",", ".").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def first_number(*values: Column) -> Column:
    return F.coalesce(*[clean_number(v) for v in values])


def yes_no(v: Column) -> Column:
    """``yes``, ``no``, empty for missing, ``?`` for what is not understood."""
    text, x = plain(v), v.cast("string").try_cast("double")
    return (
        F.when(text.isNull() | text.isin(*MISSING), F.lit(""))
        .when(text.isin(*YES), F.lit("yes")).when(text.isin(*NO), F.lit("no"))
        .when(x == 1, F.lit("yes")).when(x == 0, F.lit("no")).otherwise(F.lit("?")))


def truth_label(*values: Column) -> Column:
    """The first value that is understood; presence where none is."""
    known = [F.when(yes_no(v).isin("yes", "no"), yes_no(v)) for v in values]
    return F.coalesce(*known, F.lit("yes"))


def slug(v: Column) -> Column:
    """Lower-case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(plain(v), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def html_escape(v: Column) -> Column:
    out = v
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def translated(v: Column, words: dict[str, str]) -> Column:
    """The word's translation, or the word itself."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, v), v)


def year_list(spec: Column) -> Column:
    """Years of a text such as ``2017,2019-2021``, sorted and distinct."""
    parts = F.split(F.regexp_replace(spec, r"\s", ""), ",")
    each = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d{4}(-\d{4})?$")), lambda p: F.sequence(
        F.least(F.substring(p, 1, 4).cast("int"), F.substring(p, -4, 4).cast("int")), F.greatest(F.substring(p, 1, 4).cast("int"), F.substring(p, -4, 4).cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def number_text(value: Column, decimals: int = 4) -> Column:
    """A number for lists and maps, with a dash for none."""
    return F.coalesce(F.format_string(f"%.{decimals}f", F.nanvl(value.cast("double"), F.lit(None).cast("double"))), F.lit("—"))


def adaptive_text(value: Column) -> Column:
    """A number with as many decimals as its size leaves room for."""
    v, size = value.cast("double"), F.abs(value.cast("double"))
    text = lambda n: F.format_string(f"%.{n}f", v)
    return F.when(size >= 100, text(0)).when(size >= 10, text(1)).when(size >= 1, text(2)).when(size.isNotNull(), text(3))


def date_text(moment: Column) -> Column:
    """ISO text of a moment to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
