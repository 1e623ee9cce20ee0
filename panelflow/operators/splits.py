"""Chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEYS = ("train_end", "val_start", "val_end", "test_start")


def check_boundaries(boundaries: dict[str, str]) -> dict[str, str]:
    if missing := [k for k in _KEYS if not boundaries.get(k)]:
        raise ValueError(f"missing boundaries: {missing}")
    train_end, val_start, val_end, test_start = (boundaries[k] for k in _KEYS)
    if not train_end < val_start <= val_end < test_start:
        raise ValueError("boundaries must satisfy train_end < val_start <= val_end < test_start")
    return boundaries


def boundaries_by_share(df: DataFrame, train: float = 0.7, val: float = 0.15) -> dict[str, str]:
    """Boundaries at shares of the distinct dates of df: so many days, rounded down, train, then validate, and the rest test.

    Each part must get a day. The calendar is counted by year first, so only the years that hold a boundary are sorted.
    """
    if not (train > 0 and val > 0 and train + val < 1):
        raise ValueError("shares must be above 0 and leave some days to test")
    days = df.select("date").where("date IS NOT NULL").distinct()
    years = [(r["y"], r["n"]) for r in days.groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n")).orderBy("y").collect()]  # a row a year
    total = sum(n for _, n in years)
    a, b = int(total * train), int(total * (train + val))
    if not 0 < a < b < total:
        raise ValueError(f"{total} dates are too few to split")
    wanted, held, ahead = {"train_end": a - 1, "val_start": a, "val_end": b - 1, "test_start": b}, {}, 0
    for year, n in years:
        if some := {k: i - ahead for k, i in wanted.items() if ahead <= i < ahead + n}:
            inside = [str(r["date"]) for r in days.where(F.year("date") == year).orderBy("date").collect()]  # at most 366
            held |= {k: inside[i] for k, i in some.items()}
        ahead += n
    return check_boundaries(held)


def assign_split(df: DataFrame, boundaries: dict[str, str]) -> DataFrame:
    """df with split: train, val, test, or gap for every day in none of these."""
    day = {k: F.lit(check_boundaries(boundaries)[k]).cast("date") for k in _KEYS}
    d = F.col("date")
    split = F.when(d <= day["train_end"], "train").when((d >= day["val_start"]) & (d <= day["val_end"]), "val").when(d >= day["test_start"], "test").otherwise("gap")
    return df.withColumn("split", split)


def apply_split(df: DataFrame, boundaries: dict[str, str], mode: str = "fail") -> DataFrame:
    """assign_split; gap rows raise (mode fail) or go (mode drop)."""
    out = assign_split(df, boundaries)
    if mode == "fail" and (some := out.where("split = 'gap'").limit(3).collect()):
        raise ValueError(f"rows in a gap: {[(r['ticker'], str(r['date'])) for r in some]}")
    return out.where("split <> 'gap'")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def provenance(df: DataFrame) -> DataFrame:
    """Rows of each split and the date range, by ticker."""
    counts = {f"{s}_rows": F.count(F.when(F.col("split") == s, 1)) for s in ("train", "val", "test")}
    return df.groupBy("ticker").agg(*[c.alias(k) for k, c in counts.items()], F.min("date").alias("date_min"), F.max("date").alias("date_max"))
