"""String expressions: columns and SQL text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of all scripts for use within a SQL string of Spark; the same as (?U)\\s, which takes longer on whole texts.
WHITE = r"[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: The same, and its complement, in DuckDB's expressions.
SPACE = r"[\x09-\x0D\x{85}\p{Z}]"
INK = r"[^\x09-\x0D\x{85}\p{Z}]"
@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no expression for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def norm_text(column):
    """NFC, runs of white space to one space, none at the ends; case, punctuation and width stay."""
    return F.trim(F.regexp_replace(nfc(column), r"(?U)\s+", " "))


def split_columns(columns: str) -> list[str]:
    """The top-level, comma-parted items of a select list."""
    out, depth, item, quoted = [], 0, "", False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]
