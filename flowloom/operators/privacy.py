"""Pseudonyms for addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import exprs as X


def pseudonym(address: Column, key: bytes) -> Column:
    """An address of 10.0.0.0/8 from a keyed FNV-1a hash, the same for one key."""
    data = F.concat(F.lit(key), F.unhex(F.lpad(F.hex(address), 8, "0")))
    return F.lit(X.ip("10.0.0.0")).cast("long") + X.fnv1a(data).bitwiseAND(F.lit(0xFFFFFF).cast("long"))


def pseudonymize_ips(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    return df.withColumns({c: pseudonym(F.col(c), key) for c in columns})
