"""Presence conditions as truth-table masks.

Bit i of a mask says whether the condition holds in configuration i; feature k is enabled in configuration i if bit k of i is set.
With up to five features a mask is a positive BIGINT, and equal conditions are equal numbers, so that equivalence needs no solver.

More features make more blocks of 32 configurations: configuration i is bit i % 32 of block i / 32. A condition then is a row for each block in which it holds
anywhere; a block without a row is False. Configurations don't depend on each other, so that every operator works block by block, with the block as one more key; or with the blocks side by side in a row, in words of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 5
CONFIGS = 1 << FEATURES
TRUE = (1 << CONFIGS) - 1
FALSE = 0


def feature(k: int) -> int:
    """The mask of feature k."""
    return sum(1 << i for i in range(CONFIGS) if i >> k & 1)


def blocks(features: int) -> int:
    """How many blocks conditions over so many features have."""
    return 1 << max(0, features - FEATURES)


def wide_feature(k: int, block: Column) -> Column:
    """The mask of feature k in a block: those from FEATURES on hold in whole blocks or not at all."""
    return lit(feature(k)) if k < FEATURES else F.when(F.shiftright(block, k - FEATURES).bitwiseAND(F.lit(1)) == 1, lit(TRUE)).otherwise(lit(FALSE))


def in_blocks(df: DataFrame, features: int, block: str = "block") -> DataFrame:
    """Each row once for each block, from where its condition in the block follows."""
    return df.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(blocks(features) - 1))))


def words(features: int, mask: Callable[[int], Column]) -> list[Column]:
    """Conditions of all blocks in as few numbers as hold them, two blocks in each; ``mask`` gives that of a block."""
    n = blocks(features)
    return [reduce(either, (F.shiftleft(mask(b), CONFIGS * (b % 2)) for b in range(w, min(w + 2, n)))) for w in range(0, n, 2)]


def of_words(features: int, words: list[str]) -> Column:
    """block, cond of what words() made, as an array of the blocks in which the condition holds anywhere."""
    each = (F.struct(F.lit(b).alias("block"), F.shiftright(F.col(words[b // 2]), CONFIGS * (b % 2)).bitwiseAND(lit(TRUE)).alias("cond")) for b in range(blocks(features)))
    return F.filter(F.array(*each), lambda x: x["cond"] != 0)


def negated(mask: int) -> int:
    return TRUE & ~mask


def lit(mask: int) -> Column:
    return F.lit(mask).cast("bigint")


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def no(a: Column) -> Column:
    return F.bitwise_not(a).bitwiseAND(lit(TRUE))


def implies(a: Column, b: Column) -> Column:
    return either(no(a), b)


def satisfiable(a: Column, model: int = TRUE) -> Column:
    """Whether the condition holds in a configuration that the feature model allows."""
    return a.bitwiseAND(lit(model)) != 0


def contradiction(a: Column, model: int = TRUE) -> Column:
    return ~satisfiable(a, model)


def tautology(a: Column, model: int = TRUE) -> Column:
    return a.bitwiseAND(lit(model)) == lit(model)


def equivalent(a: Column, b: Column, model: int = TRUE) -> Column:
    return a.bitwiseAND(lit(model)) == b.bitwiseAND(lit(model))


def within(a: Column, model: int) -> Column:
    """The condition, or False where the model never allows it."""
    return F.when(satisfiable(a, model), a).otherwise(lit(FALSE))


def holds_in(a: Column, config: Column | int) -> Column:
    """Whether the condition holds in one configuration."""
    config = F.lit(config) if isinstance(config, int) else config
    return F.call_function("shiftright", a, config.cast("int")).bitwiseAND(F.lit(1)) == 1


def any_of(a: Column) -> Column:
    """Aggregate: the condition that holds where any row's does."""
    return F.bit_or(a)


def size(a: Column) -> Column:
    """In how many configurations it holds."""
    return F.bit_count(a)


def depends_on(a: Column, k: int) -> Column:
    """Whether the value changes with feature k."""
    on = F.shiftright(a.bitwiseAND(lit(feature(k))), 1 << k)
    off = a.bitwiseAND(lit(negated(feature(k))))
    return on != off


def features_of(a: Column) -> Column:
    """The names F0, F1 ... of features that the condition depends on, in falling order."""
    return F.filter(F.array(*(F.when(depends_on(a, k), F.lit(f"F{k}")) for k in reversed(range(FEATURES)))), lambda x: x.isNotNull())


def lowest(a: Column, model: int = TRUE) -> Column:
    """A configuration that satisfies it, the one with the least number (disabled features preferred); null if none does."""
    m = a.bitwiseAND(lit(model))
    bit = m.bitwiseAND(-m)
    return F.when(m != 0, F.bit_count(bit - 1)).cast("int")


def text(a: Column) -> Column:
    """A readable form: True, False, a feature or its negation, or the mask in hexadecimal digits."""
    known = {TRUE: "True", FALSE: "False"} | {feature(k): f"F{k}" for k in range(FEATURES)} | {negated(feature(k)): f"!F{k}" for k in range(FEATURES)}
    return reduce(lambda out, kv: F.when(a == lit(kv[0]), F.lit(kv[1])).otherwise(out), known.items(), F.concat(F.lit("0x"), F.hex(a)))


def enabled(config: Column) -> Column:
    """Names of features that a configuration enables, joined by commas."""
    return F.array_join(F.filter(F.array(*(F.when(F.shiftright(config, k).bitwiseAND(1) == 1, F.lit(f"F{k}")) for k in range(FEATURES))), lambda x: x.isNotNull()), ",")


def all_enabled(config: Column, features: list[int]) -> Column:
    bits = sum(1 << k for k in features)
    return config.bitwiseAND(bits) == bits


def any_enabled(config: Column, features: list[int]) -> Column:
    return config.bitwiseAND(sum(1 << k for k in features)) != 0


def all_disabled(config: Column, features: list[int]) -> Column:
    return ~any_enabled(config, features)


def any_disabled(config: Column, features: list[int]) -> Column:
    return ~all_enabled(config, features)


def of_config(config: Column) -> Column:
    """The condition that holds in this configuration only."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), config.cast("int"))
