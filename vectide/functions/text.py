"""Vector literals in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectide.errors import InvalidVector


def parse_vector(text: str) -> list[float]:
    """Numbers separated by commas or white space; brackets are ignored."""
    out = []
    for token in re.split(r"[,\s]+", re.sub(r"[\[\]]", " ", text)):
        if token:
            try:
                out.append(float(token))
            except ValueError:
                raise InvalidVector(f"'{token}' is not a number") from None
    return out


def parse_vector_column(text: Column) -> Column:
    """The same for a column; a bad token gives a null component, which validation rejects."""
    tokens = F.split(F.regexp_replace(text, r"[\[\]]", " "), r"[,\s]+")
    return F.transform(F.filter(tokens, lambda x: x != ""), lambda x: x.try_cast("float"))
