"""Words as the index and template operators see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ascii_lower

#: Runs of ASCII letters and digits and of everything past ASCII (a fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none of a null text."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


#: The same in DuckDB's SQL, of a column named text.
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
