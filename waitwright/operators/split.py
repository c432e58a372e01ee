"""Train, validation and test splits that never depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.functions.calendar import epoch_micros
from waitwright.operators.quantiles import quantile_values

SPAN = 1 << 32
# 70 / 15 / 15, as cumulative hundredths
BANDS = (("train", 70), ("validation", 85), ("test", 100))


def hash_share(key: Column, seed: int = 42) -> Column:
    """Pseudo-random but reproducible number in [0, 2**32) from an integer key.

    Fibonacci hashing of 31 key bits: it stays within 64 bits and any SQL engine can repeat it.
    """
    bits = F.pmod(key.cast("bigint"), F.lit(1 << 31))
    return F.pmod((bits + F.lit(seed)) * F.lit(2654435761), F.lit(SPAN))


def hash_band(key: Column, seed: int = 42) -> Column:
    """Integer 0-99 from the high bits of the hash."""
    return F.floor(hash_share(key, seed) * F.lit(100) / F.lit(SPAN)).cast("int")


def split_key(df: DataFrame, key: str) -> Column:
    """The id column, or where the table has none a fingerprint of the whole row."""
    return F.col(key) if key in df.columns else F.xxhash64(*sorted(df.columns))


def split_by_hash(df: DataFrame, key: str, bands: tuple[tuple[str, int], ...] = BANDS,
                  seed: int = 42) -> DataFrame:
    """Add ``split`` by cumulative percentage."""
    band = hash_band(split_key(df, key), seed)
    chain = F.when(band < bands[0][1], bands[0][0])
    for name, upto in bands[1:]:
        chain = chain.when(band < upto, name)
    return df.withColumn("split", chain)


def split_in_two_steps(df: DataFrame, key: str, test_size: float = 0.15, val_size: float = 0.15,
                       seed: int = 42) -> DataFrame:
    """Test rows first, then validation rows from the rest by a second, independent hash."""
    known = split_key(df, key)
    first = hash_share(known, seed)
    second = hash_share(F.pmod(known, F.lit(SPAN)) * 31 + 17, seed + 1)
    test = first < F.lit(int(test_size * SPAN))
    validation = second < F.lit(int(val_size / (1 - test_size) * SPAN))
    return df.withColumn("split", F.when(test, "test").when(validation, "validation")
                         .otherwise("train"))


def split_by_time(df: DataFrame, ts: str, train: float = 0.70, validation: float = 0.15
                  ) -> DataFrame:
    """Oldest rows train, newest test; rows sharing a cut time stay together."""
    micros = epoch_micros(df, ts)
    probs = [train, round(train + validation, 10)]
    cuts = quantile_values(df.select(micros.alias("us")), ["us"], probs, method="lower")
    early, late = (F.lit(int(cuts[("us", p)])) for p in probs)
    return df.withColumn("split", F.when(micros <= early, "train")
                         .when(micros <= late, "validation").otherwise("test"))
