"""Text expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Unicode text processing understands it, in a form that Java and RE2 both read.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"

#: Spacing repairs, applied in this order.
SPACING = (
    (" .", "."),
    (" ,", ","),
    (" '", "'"),
    (" ?", "?"),
    (" !", "!"),
    (" :", ":"),
    (" ;", ";"),
    (" n't", "n't"),
    (" v", "v"),
    ("2 0 0 6", "2006"),
    ("5 5", "55"),
    ("4 0 0", "400"),
    ("1 7-5 0", "1750"),
    ("2 0 %", "20%"),
    ("5 0", "50"),
    ("1 2", "12"),
    ("1 0", "10"),
    ('" ballast water', '"ballast water'),
)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def ngrams(ws: Column, n: int = 7) -> Column:
    """Runs of ``n`` words of the array column ``ws`` joined by a space; none if there are fewer.

    ``ws`` should be a column of its own: an expression would be evaluated again for every run.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, runs).otherwise(F.array().cast("array<string>"))


def fix_spacing(text: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), SPACING, text)


def safe_name(name: Column, by: str = "_") -> Column:
    return F.replace(name, F.lit("/"), F.lit(by))
