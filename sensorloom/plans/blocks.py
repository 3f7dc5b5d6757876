"""Windows of labelled blocks, that queries of several modules share: events as a subject's samples, their types as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..sources.tables import table
from .catalog import whole

BLOCKS = """, bl AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 END AS block FROM events),
bs AS (SELECT subject, block, min(i) AS a, max(i) AS z FROM bl WHERE block IS NOT NULL GROUP BY 1, 2),
b0 AS (SELECT subject, block, unnest(range(a, z - 8 + 1, 3)) AS start, a FROM bs),
b1 AS (SELECT subject, block, start, row_number() OVER (PARTITION BY subject ORDER BY start, block) - 1 AS place, row_number() OVER (PARTITION BY subject, block ORDER BY start DESC) AS back, count(*) OVER (PARTITION BY subject, block) AS n FROM b0 WHERE block <> 1 OR start < a + 24),
b2 AS (SELECT subject, block, start, place, CASE WHEN back <= greatest(round_even(n * 0.115, 0), 1) THEN 'test' ELSE 'train' END AS split FROM b1)
"""


def blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples (subject, i, x, block), and the windows (subject, block, start, place, split) of their blocks: at most eight of block 1, merged by start."""
    e = whole(spark, d, None).select(F.col("pid").alias("subject"), "i", "x", "event_id")
    kind = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).alias("block"))
    rows = e.join(kind, "event_id").drop("event_id")
    starts = windows.block_windows(rows.filter("block is not null"), 7, 1, 3, {1: 8})
    n = F.count("*").over(Window.partitionBy("subject", "block"))
    place = (F.row_number().over(Window.partitionBy("subject").orderBy("start", "block")) - 1).cast("long")
    tail = starts.withColumns({"place": place, "k": F.greatest(F.bround(n * 0.115), F.lit(1))})
    w = Window.partitionBy("subject", "block").orderBy(F.desc("start"))
    return rows, tail.withColumn("split", F.when(F.row_number().over(w) <= F.col("k"), "test").otherwise("train")).drop("k")
