"""Words of a text: letters and digits after NFKC and lower-casing."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that NFKC leaves as they are and that are not dropped; a text of these alone needs no Python.
PLAIN = r"[^\x00-\x7F°·×÷§«»–—‘’“”„•≤≥≠±√∑∂†‡‹›À-ÖØ-öø-ÿ一-鿿、-〃〈-】]"
#: Soft hyphen, zero-width characters, word joiner, byte order mark.
DROPPED = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_DROP = dict.fromkeys(map(ord, DROPPED))
_RUN = re.compile(r"[^\W_]+")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(_DROP).lower())


def normal_text(text: Column) -> Column:
    """NFKC, lower case, invisible characters dropped, words hyphenated over a line joined; null stays null.

    Only texts with characters that NFKC may change travel to Python; for all others the result is built-in.
    """
    rare = text.rlike(PLAIN)
    changed = _nfkc(F.when(rare, text))
    return F.replace(F.coalesce(changed, F.lower(text)), F.lit("-\n"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text made by :func:`normal_text`, in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), "")


def words_of(text: str | None) -> list[str]:
    """The same words for code that runs in Python anyway."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROP)
    return _RUN.findall(text.lower().replace("-\n", ""))
