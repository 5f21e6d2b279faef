"""Message flags as bits, letters and IMAP names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEEN, ANSWERED, FLAGGED, DELETED, DRAFT, PASSED = 1, 2, 4, 8, 16, 32
SYNCED = 55  # every flag but DELETED
#: Letters in the order in which they are written.
LETTERS = (("D", DRAFT), ("F", FLAGGED), ("P", PASSED), ("R", ANSWERED), ("S", SEEN), ("T", DELETED))
#: IMAP names in the order in which they are written.
NAMES = (("\\Seen", SEEN), ("\\Answered", ANSWERED), ("\\Flagged", FLAGGED), ("\\Deleted", DELETED), ("\\Draft", DRAFT), ("$Forwarded", PASSED))


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def to_letters(flags: Column) -> Column:
    return F.concat_ws("", *[F.when(has(flags, b), c) for c, b in LETTERS])


def from_letters(text: Column) -> Column:
    """Unknown letters count for nothing; null is 0."""
    text = F.coalesce(text, F.lit(""))
    return sum((F.when(text.contains(c), b).otherwise(0) for c, b in LETTERS), F.lit(0)).cast("int")


def to_imap(flags: Column) -> Column:
    return F.concat_ws(" ", *[F.when(has(flags, b), c) for c, b in NAMES])


def from_imap(text: Column) -> Column:
    """Each flag whose name stands anywhere in the text, also as the beginning of a longer word."""
    text = F.coalesce(text, F.lit(""))
    return sum((F.when(text.contains(c), b).otherwise(0) for c, b in NAMES), F.lit(0)).cast("int")


def merge(state: Column, far: Column, near: Column) -> Column:
    """Three-way merge of the synced bits: every bit that either side changed is flipped."""
    st, ff, nf = (x.bitwiseAND(F.lit(SYNCED)) for x in (state, far, near))
    return st.bitwiseXOR(ff.bitwiseXOR(st).bitwiseOR(nf.bitwiseXOR(st)))
