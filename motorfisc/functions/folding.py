"""Letters without their marks, for every letter of the basic plane: most by a table, the rest by one vectorized step."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stripped(text: str) -> str:
    """The compatibility decomposition without combining marks; đ counts as d."""
    found = unicodedata.normalize("NFKD", text).replace("đ", "d").replace("Đ", "D")
    return "".join(ch for ch in found if not unicodedata.combining(ch))


@cache
def table() -> tuple[str, str]:
    """Latin letters that fold to one letter, and what they fold to, by the rule of ``stripped``."""
    blocks = [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]
    pairs = [(chr(i), f) for i in blocks if len(f := stripped(chr(i))) == 1 and f != chr(i) and chr(i).isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def beyond() -> str:
    """A pattern for a character of the basic plane that folds to something else and isn't in the table, or one beyond that plane."""
    known = set(table()[0])
    codes = [i for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and chr(i) not in known and stripped(chr(i)) != chr(i)]
    ranges = [[x for _, x in g] for _, g in groupby(enumerate(codes), lambda p: p[1] - p[0])]
    # most characters are ASCII and fail at the first look, before hundreds of ranges are tried
    return "(?=[^\\x00-\\x7f])[" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in ranges) + "\\x{10000}-\\x{10ffff}]"


@F.pandas_udf(StringType())
def _rest(texts: pd.Series) -> pd.Series:
    known = {t: stripped(t) for t in set(texts.dropna())}
    return pd.Series([known.get(t) for t in texts], dtype=object)


def unmarked_all(text: Column) -> Column:
    """Lower case without any mark, whatever the script.

    Texts of letters in the table stay in the engine; only those with other marked letters, ligatures or compatibility
    forms have a value in the vectorized step, the rest is null there. Null stays null.
    """
    low = F.lower(text)
    more = low.rlike(beyond())
    return F.when(more, _rest(F.when(more, low))).otherwise(F.translate(low, *table()))
