"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only (operator 12).

Windows of an item (ten consecutive words, or the whole of a shorter item) are sets of shingles.  A document
holds a window only if it holds all of its shingles, so one of them is a necessary prefix: the rarest one in the
documents, by counts over all of them.  Documents' shingles that occur in no window are left out where they are, by a
bit for each hash in a broadcast table of a fixed size.  The others meet the prefixes; where the prefix stands in its
window says where the window would begin (positional bound), and it has to end inside the document (length bound).
At these places the document's own words are compared with the windows' words, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, text_or_empty, written

WINDOW = 10
SHINGLE = 5
#: What separates words, capital letters and their small ones.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter, in words of 64: at most 524,288 rows of two longs are broadcast at any size of the tables.
BITS = 1 << 25


def words(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z in lower case, nothing else."""
    ascii_only = lambda w: F.octet_length(w) == F.length(w)
    small = lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, CAPITALS, SMALL))
    return F.transform(F.filter(F.split(text, BETWEEN), lambda w: w != ""), small)


def shingles(h: Column, width: int) -> Column:
    """Hashes of ``width`` consecutive elements of ``h``, an array of words' hashes (a column, so that it is made once)."""
    if width == 1:
        return F.transform(h, lambda x: F.xxhash64(F.lit(1), x))
    one = lambda i: F.xxhash64(F.lit(width), *[F.get(h, i + k) for k in range(width)])
    return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), one))


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def perhaps(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``rows`` without those whose ``key`` (a long) is surely not among those of ``listed`` (a column of longs)."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    at = place(F.col(listed.columns[0]))
    bits = listed.select(F.shiftright(at, 6).alias("word_"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit")).groupBy("word_").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits_"))
    met = rows.withColumn("at_", place(F.col(key))).withColumn("word_", F.shiftright("at_", 6)).join(F.broadcast(bits), "word_")  # BITS / 64 rows at most
    return met.filter(F.expr("shiftright(bits_, cast(at_ % 64 as int)) & 1 = 1")).select(*rows.columns)


def windows(benchmark: DataFrame, text: str, item_id: str, window: int, shingle: int) -> DataFrame:
    """(words, size, width, shingles, items): each different window of the items, with the ids of those that have it.

    ``width`` is the length of its shingles, at most its own.
    """
    w = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words(text_or_empty(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - size)
    each = w.select("item", size.alias("size"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.least(F.size("w"), F.lit(window))), " "))).alias("words"))
    return each.groupBy("words", "size").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("width", F.least("size", F.lit(shingle)))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): a row for each row of ``docs``.

    n_hit counts the words inside any occurrence of a window of ``benchmark``; items are the ids, as text and in order, of
    items with occurring windows; spans are the occurrences (from, to), in words, the end exclusive.  An item of fewer
    words than ``window``, but not none, is one window.  Null texts have no words; null item ids count as empty text,
    null doc ids stay null; repeated rows each have their result, and repeated items count once.  Other columns
    are left out.  An empty table gives no rows; an empty benchmark no hits.
    """
    body = text_or_empty(f"`{text}`")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    rows = written(rows.withColumn("n_words", F.size(words(F.col("text")))), "clean-rows")
    every = written(windows(benchmark, item_text, item_id, window, shingle), "clean-windows")
    widths = [r["width"] for r in every.select("width").distinct().collect()]  # as many as a shingle has words, at most
    if not widths:
        none = F.expr("cast(array() as array<struct<from: int, to: int>>)")
        return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"), none.alias("spans"))

    held, met = None, None
    for width in widths:
        of = every.filter(F.col("width") == width).select("words", "size", hashes(F.split("words", " ")).alias("h"))
        of = of.select("words", "size", F.posexplode(shingles(F.col("h"), width)).alias("at", "shingle"))
        held = of if held is None else held.unionByName(of)
        long_enough = rows.filter(F.col("n_words") >= width).select("row_id", "n_words", hashes(words(F.col("text"))).alias("h"))
        some = long_enough.select("row_id", "n_words", F.posexplode(shingles(F.col("h"), width)).alias("at", "shingle"))
        met = some if met is None else met.unionByName(some)
    held = written(held, "clean-held")
    met = written(perhaps(met, "shingle", held.select("shingle")), "clean-met")
    counts = met.groupBy("shingle").agg(F.count("*").alias("n"))
    # the rarest shingle of each window, unless one does not occur at all
    rarest = held.join(counts, "shingle").groupBy("words", "size").agg(F.min(F.struct("n", "shingle", "at")).alias("first"), F.count("*").alias("found"))
    rarest = rarest.filter(F.col("found") == F.col("size") - F.least("size", F.lit(shingle)) + 1)
    places = rarest.groupBy("first.shingle").agg(F.max("first.n").alias("n"), F.collect_set(F.struct("first.at", "size")).alias("places"))  # a few: where in a window, and its length
    candidates = looked_up(met.select("row_id", "n_words", "at", "shingle"), places, "shingle", "n", met.count())
    candidates = candidates.select("row_id", "n_words", "at", F.explode("places").alias("place")).select("row_id", "n_words", (F.col("at") - F.col("place.at")).alias("start"), F.col("place.size").alias("size"))
    inside = candidates.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    starts = written(inside.groupBy("row_id").agg(F.collect_set(F.struct("start", "size")).alias("starts")), "clean-starts")
    texts = perhaps(rows.select("row_id", "text"), "row_id", starts.select("row_id")).join(starts, "row_id")
    read = texts.select("row_id", "starts", words(F.col("text")).alias("w"))
    # the words are named twice, so they are made once, before the places are gone through
    own = lambda s: F.struct(s["start"].alias("from"), (s["start"] + s["size"]).alias("to"), F.array_join(F.slice("w", s["start"] + 1, s["size"]), " ").alias("words"))
    own_words = read.select("row_id", F.explode(F.transform(F.filter("starts", lambda s: s["start"] + s["size"] <= F.size("w")), own)).alias("v")).select("row_id", "v.*")
    hits = own_words.join(every.select("words", "items"), "words")
    found = hits.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    add = lambda a, s: F.struct((a["hit"] + F.greatest(s["to"] - F.greatest(s["from"], a["reach"]), F.lit(0))).alias("hit"), F.greatest(a["reach"], s["to"]).alias("reach"))
    out = rows.select("row_id", "doc_id", "n_words").join(found.withColumn("n_hit", F.aggregate("spans", zero, add, lambda a: a["hit"])), "row_id", "left")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<from: int, to: int>>)")).alias("spans"),
    )
