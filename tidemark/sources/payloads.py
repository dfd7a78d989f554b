"""Raw payloads kept for a replay, each packed by itself."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def packed(raw: pd.Series) -> pd.Series:
    """Bytes in zlib's format; null stays null. Works on Arrow batches, a payload at a time."""
    return raw.map(zlib.compress, na_action="ignore")


@F.pandas_udf(BinaryType())
def unpacked(raw: pd.Series) -> pd.Series:
    """What was packed; null for null and for bytes that are damaged, cut off or in another format."""

    def whole(data: bytes) -> bytes | None:
        try:
            return zlib.decompress(data)
        except zlib.error:
            return None

    return raw.map(whole, na_action="ignore")
