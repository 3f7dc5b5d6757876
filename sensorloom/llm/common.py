"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch, shared_dir, written  # noqa: F401  (the operators take them from here)


#: What operators remember of words in a worker, which Spark uses again for other tasks: how to forget it, by operator.
MEMORIES: dict[str, Callable[[], None]] = {}


def forget_others(name: str) -> None:
    """Called where an operator's task begins: a worker remembers the words of one operator at a time."""
    for other, forget in MEMORIES.items():
        if other != name:
            forget()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` clashes (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of the filter below: a table of 4 MB at any size of the input.
FILTER_BITS = 1 << 25


def flagged(df: DataFrame, key, listed: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column ``flag``: false where ``key`` (a text column) is surely not in ``listed`` (one text column).

    A bit for each hash, in a broadcast table of a fixed size.  It keeps rows that no join needs out of a
    shuffle; where very many keys are listed it lets more through, and the join behind it decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bucket, bit = free_name(df, "bucket_"), free_name(df, "bit_")
    bits = listed.select(place(F.col(listed.columns[0])).alias("at")).groupBy(F.floor(F.col("at") / 32768).alias(bucket)).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias(bit))
    at = place(key)
    byte = F.conv(F.hex(F.substring(F.col(bit), F.floor(at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return df.withColumn(bucket, F.floor(at / 32768)).join(F.broadcast(bits), bucket, "left").withColumn(flag, on).drop(bucket, bit)


#: A key counts as hot if it has more than one in so many of all rows, so that fewer keys than this are hot at any size.
HOT = 1_024


def looked_up(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, how: str = "inner", hot: int | None = None) -> DataFrame:
    """``rows`` joined with ``found`` (a row for each key; ``n``: how many of the ``total`` rows have it) on ``key``; ``how``: inner or left.

    The hot keys, fewer than ``hot`` (HOT unless given) narrow rows, are broadcast, so the rows of one stay where they are; the others meet
    their keys in a shuffle, where none has more than its share.
    """
    often = F.col(n) > total / (hot or HOT)
    flag = free_name(rows, "hot_")
    first = rows.join(F.broadcast(found.filter(often).withColumn(flag, F.lit(True))), key, "left")
    cold = first.filter(F.col(flag).isNull()).select(*[F.col(f"`{c}`") for c in rows.columns])
    return first.filter(flag).drop(flag).unionByName(cold.join(found.filter(~often), key, how))


def kept_rows(docs: DataFrame, groups: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``groups`` (doc_id, text_sha256, kept) keeps, with all their columns."""
    key, flag = free_name(docs, "key_"), free_name(docs, "flag_")
    name = lambda who, sha: F.concat_ws("/", sha, F.coalesce(who.cast("string"), F.lit("")))
    # rows repeated with id and text: one of them stays, so they are among the dropped and the kept
    states = groups.groupBy(name(F.col("doc_id"), F.col("text_sha256")).alias(key)).agg(F.min("kept").alias("all"), F.max("kept").alias("any")).filter("not all")
    gone = written(states.select(key, "any"), "gone")
    again = gone.filter("any").drop("any")
    sha = F.sha2(F.encode(text_or_empty(f"`{text}`"), "UTF-8"), 256)
    keyed = flagged(docs.withColumn(key, name(F.col(f"`{doc_id}`").cast("long"), sha)), F.col(key), gone.select(key), flag)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    maybe = keyed.filter(flag)
    kept = keyed.filter(~F.col(flag)).select(*columns).unionByName(maybe.join(gone.select(key).hint("merge"), key, "left_anti").select(*columns))
    if again.isEmpty():
        return kept
    one = maybe.join(again.hint("merge"), key, "left_semi").groupBy(key).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return kept.unionByName(one)
