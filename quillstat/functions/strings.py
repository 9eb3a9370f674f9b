"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def tokenize(text: Column) -> Column:
    """Runs of two or more ASCII letters, lower-cased after they are cut (lower-casing first could make letters)."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda t: F.lower(t))


def fnv1a_64(text: Column) -> Column:
    """FNV-1a of an ASCII string as DECIMAL(20): the product is formed from halves, so that nothing overflows."""
    two32 = 4294967296
    # The prime is 2^40 + 435: h * prime mod 2^64 = (h mod 2^24) * 2^40 + (h * 435 mod 2^64), in 32-bit halves.
    start = F.struct(F.lit(FNV_OFFSET // two32).alias("hi"), F.lit(FNV_OFFSET % two32).alias("lo"))

    def step(h, code):
        lo = h["lo"].bitwiseXOR(code.cast("bigint"))
        low = lo * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + (lo % 16777216) * 256
        return F.struct((high % two32).alias("hi"), (low % two32).alias("lo"))

    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    h = F.aggregate(F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<int>")), start, step)
    return h["hi"].cast("decimal(20,0)") * F.lit(two32).cast("decimal(10,0)") + h["lo"].cast("decimal(10,0)")
