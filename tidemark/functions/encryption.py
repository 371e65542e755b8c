"""Column encryption with keys from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """Replace columns by base64(AES-GCM of ``name:value``)."""
    sealed = {c: F.base64(F.aes_encrypt(F.concat(F.lit(c + ":"), F.col(c).cast("string")), key, F.lit("GCM"))) for c in columns}
    return df.withColumns(sealed)


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """Undo ``encrypt_columns``; null when the text is damaged or belongs to another column."""

    def opened(c: str) -> Column:
        plain = F.try_aes_decrypt(F.unbase64(F.col(c)), key, F.lit("GCM")).cast("string")
        return F.when(plain.startswith(c + ":"), F.substring(plain, F.lit(len(c) + 2), F.char_length(plain)))

    return df.withColumns({c: opened(c) for c in columns})
