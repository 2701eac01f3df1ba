"""Connected components of links, and a set of ids small enough to send to every task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

FILTER_BITS = 27  # 16 MB; ids beyond what it tells apart only cost extra rows


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b).

    Large-star and small-star steps alternate: every node's larger neighbours,
    then all its smaller ones, are tied to the smallest neighbour, until the links
    are stars. No component is ever collected; each step is an aggregation and a
    join by node, written to the shared folder.
    """
    links = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("low"))
        large = both.filter("other > node").join(least, "node").select(F.col("low").alias("a"), F.col("other").alias("b")).filter("a <> b")
        links = cut_lineage(large.distinct())
        least = links.groupBy("b").agg(F.min("a").alias("low"))
        small = links.join(least, "b").select("low", "a", "b")
        small = small.select(F.explode(F.array(F.struct("low", F.col("a").alias("x")), F.struct("low", F.col("b").alias("x")))).alias("e"))
        links = cut_lineage(small.select(F.col("e.low").alias("a"), F.col("e.x").alias("b")).filter("a <> b").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a").distinct())


def _slot(column: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)


class IdFilter:
    """A bitmap of hashed ids, of fixed size: it may admit other ids but never misses one."""

    def __init__(self, ids: DataFrame, name: str):
        slot = _slot(F.col(name))
        words = (
            ids.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(63).cast("int").alias("s"))
            .groupBy("w")
            .agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("bits"))
        )
        bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        found = words.toPandas()
        bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
        self._words = ids.sparkSession.sparkContext.broadcast(bitmap)

    @staticmethod
    def slot(name: str) -> Column:
        return _slot(F.col(name)).alias("slot")

    def admits(self, slots: np.ndarray) -> np.ndarray:
        return (self._words.value[slots >> 6] >> (slots & 63)) & 1 == 1
