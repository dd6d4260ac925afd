"""FNV-1a 64-bit hash of a string's UTF-8 bytes as a native Spark expression.

Spark has no FNV function and a bigint multiply overflows under ANSI mode, so the 64-bit state is
carried as two 32-bit limbs (hi, lo) in longs. With the prime p = 2^40 + 435, one step is

    lo' = lo xor byte
    hi  = (hi·435 + (lo'·435 >> 32) + (lo' << 8)) mod 2^32
    lo  = (lo'·435) mod 2^32

(``h·2^40`` only moves ``lo'`` into the high limb; every intermediate stays below 2^44).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a 64: offset basis 0xcbf29ce484222325 split into limbs, prime low part.
OFFSET_HI = 0xCBF29CE4
OFFSET_LO = 0x84222325
PRIME_LOW = 435  # prime = 2**40 + 435
MASK32 = 0xFFFFFFFF


def fnv1a64_limbs(s: Column) -> Column:
    """struct(hi, lo) of FNV-1a 64 over the UTF-8 bytes of ``s``."""
    hx = F.hex(F.encode(s, "UTF-8"))
    n = (F.length(hx) / 2).cast("int")
    init = F.struct(F.lit(OFFSET_HI).cast("long").alias("hi"),
                    F.lit(OFFSET_LO).cast("long").alias("lo"))

    def step(acc, i):
        byte = F.conv(F.substr(hx, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        x = acc["lo"].bitwiseXOR(byte)
        x435 = x * PRIME_LOW
        hi = (acc["hi"] * PRIME_LOW + F.shiftright(x435, 32) + F.shiftleft(x, 8)).bitwiseAND(MASK32)
        lo = x435.bitwiseAND(MASK32)
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), init, step)).otherwise(init)


def fnv1a64_hex(s: Column) -> Column:
    """The 16-digit lower-case hex digest (for tests against published values)."""
    h = fnv1a64_limbs(s)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
