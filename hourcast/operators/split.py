"""Splits in time with an embargo, one ``split`` label per sample."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import EMBARGO_DAYS

KEYS = ["zone", "target_day"]


def _held_out(no: Column, n: Column, strategy: str, frac: float, shuffled: Column) -> Column:
    k = F.floor(n * frac)
    if strategy == "head":
        return no < k
    if strategy == "tail":
        return no >= n - k
    if strategy == "random":
        return shuffled < k
    raise ValueError(f"unknown split strategy {strategy!r}; use head, tail or random")


def split_samples(samples: DataFrame, strategy: str = "tail", test_frac: float = 0.16,
                  val_strategy: str = "tail", val_frac: float = 0.0,
                  embargo: int = EMBARGO_DAYS, seed: int = 42) -> DataFrame:
    """Add ``sample_no`` and ``split`` (train, val, test, embargo), per zone.

    The test share is taken first, the validation share from what is left. The embargo drops the
    last samples of train and, in a nested split, of validation; a set no longer than the embargo
    becomes empty. Samples are one per day, so a zone's window is as small as its calendar.
    """
    zone = W.partitionBy("zone")
    noise = F.xxhash64(F.col("target_day").cast("string"), F.lit(seed))
    out = samples.withColumns({
        "sample_no": F.row_number().over(zone.orderBy("target_day")) - 1,
        "_n": F.count(F.lit(1)).over(zone),
        "_r": F.row_number().over(zone.orderBy(noise, "target_day")) - 1,
    })
    test = _held_out(F.col("sample_no"), F.col("_n"), strategy, test_frac, F.col("_r"))
    out = out.withColumn("split", F.when(test, "test").otherwise("train"))
    part = W.partitionBy("zone", "split")
    if val_frac > 0:
        noise_val = F.xxhash64(F.col("target_day").cast("string"), F.lit(seed + 1))
        out = out.withColumns({
            "_no": F.row_number().over(part.orderBy("target_day")) - 1,
            "_n": F.count(F.lit(1)).over(part),
            "_r": F.row_number().over(part.orderBy(noise_val, "target_day")) - 1,
        })
        val = _held_out(F.col("_no"), F.col("_n"), val_strategy, val_frac, F.col("_r"))
        out = out.withColumn("split", F.when((F.col("split") == "train") & val, "val")
                             .otherwise(F.col("split"))).drop("_no")
    out = out.drop("_n", "_r")
    return apply_embargo(out, embargo)


def apply_embargo(samples: DataFrame, embargo: int = EMBARGO_DAYS) -> DataFrame:
    """Relabel the last ``embargo`` samples of train and of val as 'embargo'. Counts samples, not
    calendar days."""
    if embargo <= 0:
        return samples
    from_end = F.row_number().over(W.partitionBy("zone", "split").orderBy(F.desc("target_day")))
    hit = F.col("split").isin("train", "val") & (F.col("_e") <= embargo)
    return (samples.withColumn("_e", from_end)
            .withColumn("split", F.when(hit, "embargo").otherwise(F.col("split"))).drop("_e"))


def fit_set(samples: DataFrame) -> DataFrame:
    """Train samples with a fully valid target; the filter applies to train only."""
    return samples.where((F.col("split") == "train") & (F.col("is_target_valid") == 1))


def run_tag(strategy: str, test_frac: float, val_strategy: str | None = None,
            val_frac: float | None = None) -> str:
    """Name of a split setting, used as a partition value next to the model name."""
    tag = f"{strategy}_test{test_frac}"
    return tag if val_strategy is None else f"{tag}_{val_strategy}_val{val_frac}"
