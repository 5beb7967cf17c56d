"""A bitmap of hash values, small enough to broadcast whatever the input, that thins a table before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2 MB in 512 rows.
FILTER_BITS = 1 << 24


def hash_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmap of hash values modulo ``bits``: at most ``bits``/32768 rows of 4 KB, however many hashes there are."""
    bit = F.pmod(F.col(column), F.lit(bits)) + 1  # bitmap functions count from 1
    return hashes.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))


def maybe_in(df: DataFrame, column: str, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose hash may be among those of ``hash_filter``; none that is among them is lost.

    The broadcast has a size bound by construction; a full bitmap only lets more rows through.
    """
    bit = F.pmod(F.col(column), F.lit(bits)) + 1  # bitmap functions count from 1
    found = df.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "_bucket")
    position = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (position % 8).cast("int")) == 1).drop("_bucket", "_bits")
