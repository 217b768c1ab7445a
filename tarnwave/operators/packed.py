"""Bit streams packed 64 symbols to a long, and held against each other word by word.

A packed stream has a row for each word (keys, word = k div 64): the bits of one or more streams and `mask`, which symbols
there are. Moving a stream by up to 63 symbols takes its neighbouring words; equal and different symbols are counted by
XOR and the number of ones. So a score reads one row for 64 symbols, and offsets are columns of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def place(k: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod({k}, {WORD}) as int))")


def word_of(k: str) -> Column:
    return F.floor(F.col(k) / WORD).cast("long")


def pack(bits: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("bit",), k: str = "k", more: dict[str, Column] | None = None) -> DataFrame:
    """keys, word, mask and the columns as longs. Rows: one for each symbol; a bit is set where its column is 1.

    more: further masks, of the symbols for which a condition holds.
    """
    at = bits.withColumn("__at", place(k))
    own = [F.expr(f"bit_or(if(`{c}` = 1, __at, 0L))").alias(c) for c in columns]
    own += [F.bit_or(F.when(c, F.col("__at")).otherwise(F.lit(0).cast("long"))).alias(name) for name, c in (more or {}).items()]
    return at.groupBy(*keys, word_of(k).alias("word")).agg(F.bit_or("__at").alias("mask"), *own)


def with_sides(words: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("bit", "mask")) -> DataFrame:
    """keys, word, and of each column <c>_l, <c>_o, <c>_r: the words before, of and after this one (0 where there is none).

    Words next to an existing one get a row as well, as bits may move into them.
    """
    at = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), (F.col("word") + o).alias("word")) for side, o in (("l", 1), ("o", 0), ("r", -1))]))
    rows = words.select(*keys, *columns, at.alias("at")).select(*keys, *columns, "at.side", "at.word")
    none = F.lit(0).cast("long")
    return rows.groupBy(*keys, "word").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), none).alias(f"{c}_{s}") for c in columns for s in "lor"])


def moved(c: str, by: int) -> Column:
    """The word of a stream whose symbol k is the old symbol k + by; columns as with_sides names them."""
    own, far = F.col(f"{c}_o"), F.col(f"{c}_{'r' if by > 0 else 'l'}")
    if by > 0:
        return F.shiftrightunsigned(own, by).bitwiseOR(F.shiftleft(far, WORD - by))
    if by < 0:
        return F.shiftleft(own, -by).bitwiseOR(F.shiftrightunsigned(far, WORD + by))
    return own


def met(mask: Column, other: Column) -> Column:
    """How many symbols both masks have."""
    return F.bit_count(mask.bitwiseAND(other)).cast("long")


def apart(a: Column, b: Column, mask: Column, other: Column) -> Column:
    """In how many of these symbols two streams differ."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask).bitwiseAND(other)).cast("long")


def offset_sums(pred: DataFrame, ref: DataFrame, reach: int, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """keys, more, off, m, wrong: symbols that overlap and those that differ where pred's symbol k + off meets ref's k.

    pred: packed (keys, more, word, bit, mask); ref: packed (keys, word, bit, mask), held against all of more. Only
    offsets that overlap anywhere have a row.
    """
    if not 0 <= reach < WORD:
        raise ValueError(f"reach {reach} isn't below {WORD}")
    own = ref.select(*keys, "word", F.col("bit").alias("__r"), F.col("mask").alias("__m"))
    both = with_sides(pred, [*keys, *more]).join(own, [*keys, "word"])
    offs = range(-reach, reach + 1)
    sums = [a for i, o in enumerate(offs) for a in (F.sum(met(moved("mask", o), F.col("__m"))).alias(f"m{i}"), F.sum(apart(moved("bit", o), F.col("__r"), moved("mask", o), F.col("__m"))).alias(f"w{i}"))]
    per = both.groupBy(*keys, *more).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(o).cast("long").alias("off"), F.col(f"m{i}").alias("m"), F.col(f"w{i}").alias("wrong")) for i, o in enumerate(offs)]))
    return per.select(*keys, *more, each.alias("s")).select(*keys, *more, "s.*").filter("m > 0")


def best_rate(sums: DataFrame, keys: Sequence[str], n_ref: DataFrame) -> DataFrame:
    """keys, ber: the lowest error rate over offsets and polarities; 1 without an overlap of half the reference.

    sums: as of offset_sums. n_ref: some of the keys, n_ref.
    """
    own = [c for c in n_ref.columns if c != "n_ref"]
    rate = F.when(F.col("m") >= F.floor(F.col("n_ref") / 2), F.least("wrong", F.col("m") - F.col("wrong")) / F.col("m"))
    return sums.join(n_ref, own).groupBy(*keys).agg(F.coalesce(F.min(rate), F.lit(1.0)).alias("ber"))


def same_share(a: DataFrame, b: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """keys, more, share: of the symbols that packed streams a (keys, more) and b (keys) both have, how many are equal."""
    own = b.select(*keys, "word", F.col("bit").alias("__b"), F.col("mask").alias("__m"))
    both = a.join(own, [*keys, "word"])
    per = both.groupBy(*keys, *more).agg(F.sum(met(F.col("mask"), F.col("__m"))).alias("m"), F.sum(apart(F.col("bit"), F.col("__b"), F.col("mask"), F.col("__m"))).alias("w"))
    return per.filter("m > 0").select(*keys, *more, ((F.col("m") - F.col("w")) / F.col("m")).alias("share"))
