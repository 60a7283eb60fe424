"""Long series in chunks: a key's ordered rows in several tasks, and what one chunk hands to the next.

Rows are dealt in ranges of (keys, order), so a range holds whole keys and at
most two parts of longer ones: the end of one and the beginning of another.  A
key's rows in one range are a chunk.  Whatever has to cross from chunk to chunk
is worked out on summaries of the chunks of such longer keys, two a range at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import keep

PART = "_part"


class Chunks:
    """``rows`` dealt in ranges and written, so that every later job and every rerun task sees the same chunks."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None):
        self.keys, self.order, self.spark = keys, order, rows.sparkSession
        dealt = rows.repartitionByRange(*([ranges] if ranges else []), *keys, *order)
        self.rows = keep(dealt.withColumn(PART, F.spark_partition_id()), "ranges")
        self.id = [*keys, PART]

    def window(self):
        return Window.partitionBy(*self.id).orderBy(*self.order)

    def linked(self, *summaries) -> dict[tuple, list[Row]]:
        """Of each key that has several chunks: their summaries, in order, with the number ``n`` of their rows."""
        chunks = self.rows.groupBy(*self.id).agg(F.count("*").alias("n"), *summaries)
        chunks = chunks.withColumn("_chunks", F.count("*").over(Window.partitionBy(*self.keys))).where("_chunks > 1")
        out: dict[tuple, list[Row]] = {}
        for row in sorted(chunks.collect(), key=lambda r: r[PART]):  # two rows a range at most
            out.setdefault(tuple(row[k] for k in self.keys), []).append(row)
        return out

    def table(self, rows: list[tuple], columns: str) -> DataFrame:
        """A small table ``keys, ...`` of facts about chunks, for a broadcast: at most some rows a range."""
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return self.spark.createDataFrame(rows, ", ".join([*(f"{k} {kinds[k]}" for k in self.keys), columns]))

    def meet(self, rows: DataFrame, facts: DataFrame, part: str = PART, how: str = "inner") -> DataFrame:
        """``rows`` beside the facts of their chunk; null keys meet too."""
        facts = facts.withColumnsRenamed({k: f"_of_{k}" for k in self.keys} | {part: "_of_part"})
        on = F.col(PART).eqNullSafe(F.col("_of_part"))
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        return rows.join(F.broadcast(facts), on, how).drop("_of_part", *[f"_of_{k}" for k in self.keys])


def chunk_of(frame: pd.DataFrame, names: list[str]) -> tuple:
    """The chunk that a pandas frame holds, as the driver names it."""
    return tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in (frame[c].iloc[0] for c in names))
