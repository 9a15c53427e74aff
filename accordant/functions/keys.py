"""Normal forms of codes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind at either end.
_OUTER = r"^[\s\p{Z}\x{85}\x{FEFF}]+|[\s\p{Z}\x{85}\x{FEFF}]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def code_key(c: Column) -> Column:
    """A code without regard to letter case and outer white space; blank gives null."""
    key = F.upper(stripped(c))
    return F.when(key != "", key)


def number_key(c: Column) -> Column:
    """As ``code_key``; numbers also lose a plus sign, leading zeros and a fraction of zeros."""
    key = code_key(c)
    plain = F.regexp_replace(key, r"^[+]?0*([0-9]+?)(?:[.]0*)?$", "$1")
    return F.when(key.rlike(r"^[+]?[0-9]+(?:[.]0*)?$"), plain).otherwise(key)
