"""Word flags and conjugation forms: bit fields in integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits in order.
FLAGS = {"primary": 0x01, "pronounce": 0x02, "common_line": 0x04, "common": 0x08, "particle": 0x10, "counter": 0x20, "top": 0x40, "is_name": 0x80}
PRIMARY, PRONOUNCE, COMMON_LINE, COMMON, PARTICLE, COUNTER, TOP, IS_NAME = FLAGS.values()
RANKED = COUNTER | PARTICLE | COMMON | COMMON_LINE | PRIMARY
FORMAL, NEGATIVE = 1, 2
#: Labels of the lookup listing, in its order.
LOOKUP_LABELS = (("primary", PRIMARY), ("reading", PRONOUNCE), ("common", COMMON), ("common-line", COMMON_LINE), ("particle", PARTICLE), ("counter", COUNTER))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def flag_if(condition: Column, bit: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), bit).otherwise(0)


def flag_names(flags: Column) -> Column:
    """Names of the set bits, in bit order; unknown bits are passed over."""
    return F.filter(F.array(*(F.when(has_flag(flags, b), n) for n, b in FLAGS.items())), lambda x: x.isNotNull())


def lookup_labels(flags: Column) -> Column:
    return F.concat_ws(",", *(F.when(has_flag(flags, b), n) for n, b in LOOKUP_LABELS))


def form_of(formal: Column, negative: Column) -> Column:
    return formal.cast("int").bitwiseOR(F.shiftleft(negative.cast("int"), 1))
