"""Compressed chunk texts as other tools store them: a mark and a zlib stream. Only for interchange; Parquet compresses by itself."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

# The mark of the format and the level of its streams.
MARK, LEVEL = b"DSZ1", 1


def pack(text: str | None) -> bytes:
    return MARK + zlib.compress((text or "").encode("utf-8"), LEVEL)


def unpack(data: bytes | None) -> str:
    """The text of a packed or plain UTF-8 value; null is empty. Anything else is an error."""
    raw = bytes(data or b"")
    try:
        return (zlib.decompress(raw[len(MARK) :]) if raw.startswith(MARK) else raw).decode("utf-8")
    except (zlib.error, UnicodeDecodeError) as e:
        raise ValueError("a damaged or unknown chunk text") from e


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    return texts.map(pack)


@F.pandas_udf(StructType().add("text", StringType()).add("error", StringType()))
def unpacked(values: pd.Series) -> pd.DataFrame:
    """text, or error for a value that cannot be read; other rows are not affected."""

    def one(x):
        try:
            return unpack(x), None
        except ValueError as e:
            return None, str(e)

    return pd.DataFrame([one(x) for x in values], columns=["text", "error"])
