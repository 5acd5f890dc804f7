"""Normalisation, keys and formats as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words without weight in names and addresses.
STOPWORDS = "pt cv tbk ud toko tk jl jalan gg gang no nomor"
# Latin letters and what they decompose to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

_BEYOND = re.compile("[^\\x00-\\x7Fß" + ACCENTED + "]")
_LETTERS = str.maketrans(ACCENTED, PLAIN)
_STOP = frozenset(STOPWORDS.encode().split())
_SPACED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _cleaned(low: str) -> str:
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not 0x300 <= ord(c) <= 0x36F) if _BEYOND.search(low) else low.translate(_LETTERS)
    return b" ".join(w for w in low.encode("ascii", "replace").translate(_SPACED).split() if w not in _STOP).decode()


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(_cleaned)


def normalize_text(c: Column) -> Column:
    """Lower case, compatibility decomposition without its accents, other characters and stopwords to single spaces.

    A pass over the bytes in Python: on check_s's whole documents regular expressions took 21.6 s, this 9.0. Only texts
    with characters beyond the Latin letters above are decomposed.
    """
    return _normalized(F.lower(F.coalesce(c, F.lit(""))))


def normalize_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", "")


def tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: F.length(t) >= 2))


def numeric_tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(r"[0-9]+"), F.lit(0))


def len_bucket(length: Column) -> Column:
    return F.floor(length / 5).cast("int")


def bucket_name(bucket: Column) -> Column:
    return F.format_string("%03d", bucket)


def max_len_diff(length: Column, percent: float = 30.0, chars: int = 12) -> Column:
    return F.greatest(F.lit(chars), F.floor(length * percent / 100 + 0.5)).cast("int")


def identity_shard(digits: Column) -> Column:
    return F.lpad(F.right(digits, F.lit(2)), 2, "0")


def exact_hash(norm_name: Column, norm_address: Column) -> Column:
    return F.sha2(F.concat(norm_name, F.lit("\x1f"), norm_address), 256)


def exact_shard(hash_: Column) -> Column:
    return F.substring(hash_, 1, 2)


def row_hash(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(F.coalesce(f, F.lit("")) for f in fields))), 256)


def packed_field(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "\t\r\n", "   ")


def mask(digits: Column) -> Column:
    n = F.length(digits)
    shown = F.concat(F.left(digits, F.lit(4)), F.repeat(F.lit("*"), F.greatest(n - 8, F.lit(0)).cast("int")), F.right(digits, F.lit(4)))
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(shown)


def preview(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def sanitized(score: Column, reason: Column) -> Column:
    """What a response shows of a party: no identity number, a preview of the address."""
    return F.struct("bp_id", "bp_type_id", "name_1", preview(F.col("address")).alias("address_preview"), round2(score).alias("score"), reason.alias("reason"))


def posting(*parts: Column) -> Column:
    """A posting as a compact JSON array of texts."""
    return F.to_json(F.array(*(p.cast("string") for p in parts)))


def posting_parts(c: Column, arity: int) -> Column:
    """The texts of a posting; null if it is no JSON array of that many texts."""
    parts = F.from_json(c, "array<string>")
    return F.when((F.size(parts) == arity) & ~F.exists(parts, lambda x: x.isNull()), parts)


def fingerprint(*parts: Column) -> Column:
    """One hash of a query's inputs and settings."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def first_useful_token(toks: Column, stop: tuple[str, ...] = ()) -> Column:
    return F.get(F.filter(toks, lambda t: (F.length(t) >= 3) & ~t.isin(*stop) if stop else F.length(t) >= 3), 0)
