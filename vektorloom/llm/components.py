"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektorloom.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node reachable) for every node of ``links`` (``a, b`` longs), in settled rounds.

    In each round a node takes the smallest mark of its neighbours and then the mark of that mark, so marks travel
    twice as far each time. Hubs meet their links as partial minima or in joins that split skewed keys.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settled(links.where("a <> b").select(F.inline(ways)).distinct(), "edges")
    marks = settled(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "marks")
    while True:
        seen = edges.join(marks.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node"))
        least = marks.join(seen.agg(F.min("comp").alias("near")), "node").select("node", "comp", F.least("comp", "near").alias("next"))
        of_mark = marks.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        jumped = least.join(of_mark, "next", "left").select("node", "comp", F.least("next", "beyond").alias("new"))
        found = settled(jumped, "marks")
        marks = found.select("node", F.col("new").alias("comp"))
        if found.where("new <> comp").isEmpty():
            return marks
