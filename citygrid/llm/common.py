"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def min_rounds(df: DataFrame, hashed: str, n: int) -> DataFrame:
    """The ``n`` rows whose hash is least: a sample of bounded size that does not
    depend on partitioning."""
    return df.orderBy(F.xxhash64(F.col(hashed).cast("string")), hashed).limit(n)


class GenerationalCache(dict):
    """A memo of bounded size: ``cache[key]`` computes what it has not seen.

    When ``most`` keys are young, they become the old generation and the former
    old one goes; a key found in the old generation is taken over, not computed. Keys
    of more than ``longest`` characters are not kept: a few could fill the memory.
    Without ``compute`` it holds what ``hold`` is given.
    """

    def __init__(self, compute: Callable[[Hashable], object] | None, most: int = 200_000, longest: int | None = None):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def hold(self, values: dict) -> None:
        """Keep values that were computed elsewhere; they become young at once, even if they are more than ``most``."""
        if len(self) + len(values) > self.most:
            self.old = dict(self)
            self.clear()
        if self.longest is not None and values and max(map(len, values)) > self.longest:
            values = {k: v for k, v in values.items() if len(k) <= self.longest}
        self.update(values)
