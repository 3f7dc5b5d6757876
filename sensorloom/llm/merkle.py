"""Merkle manifest of a table by a radix-ranked trie (operator 11).

Rows are leaves; the leaves of a group ascend by id.  A leaf's exact rank comes from hierarchical histograms of the
id's digits: rows are counted by id, by the id without its last 16 bits, and so on; each level is summed up inside one
digit of the level above, at most 65,536 counts at a time, so no group and no table is sorted as a whole.  Ids that
many different rows share go on with digits of the leaf; equal rows are one entry with a count until ranks are known.
The digits of a rank to the base of the fanout key the trie: nodes are reduced by their longest prefix (the key without
its last digit) until only subroots, with no digit, are left.  Subroots make a trie of their own.  Siblings go down
from the root with the runs of a level, so a leaf meets them once, and proofs and recomputed roots are made there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
#: Rows that one entry of equal rows makes in one place.
CHUNK = 4_096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values one after another: - for null, else the number of bytes, a colon and the value."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in values]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make, level by level."""
    return F.aggregate(path, leaf, lambda h, level: F.sha2(F.concat(level["left"], h, level["right"]), 256))


def proof(path: Column) -> Column:
    """SHA-256 of the siblings on the way to the root, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def ranked(entries: DataFrame) -> DataFrame:
    """``entries`` (g, id, leaf, m, ...) with start, the rows of the group before them by (id, leaf), and total, all rows of the group."""
    tail = F.substring("leaf", 1, 4).alias("tail")
    tails = entries.groupBy("g", "id", tail).agg(F.sum("m").alias("n"))
    bins = written(tails.groupBy("g", F.shiftright("id", 16).alias("p")).agg(F.sum("n").alias("n")), "merkle-bins")

    def started(level: DataFrame, above: DataFrame | None, parent: Column | None, order: str) -> DataFrame:
        """``level`` with start: what comes before it inside its parent, behind the parent's own start."""
        rows = level if parent is None else level.withColumn("up", parent)
        w = Window.partitionBy("g") if parent is None else Window.partitionBy("g", "up")
        before = F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if above is None:
            return rows.withColumns({"start": before, "total": F.sum("n").over(w)})
        return rows.withColumn("before", before).join(above.select("g", F.col("p").alias("up"), "start", "total"), ["g", "up"]).withColumn("start", F.col("start") + F.col("before")).drop("before", "up")

    up = F.shiftright("p", 16)
    second = bins.groupBy("g", up.alias("p")).agg(F.sum("n").alias("n"))
    first = second.groupBy("g", up.alias("p")).agg(F.sum("n").alias("n"))
    first = started(first, None, None, "p")
    second = started(second, first, up, "p")
    third = started(bins, second, up, "p")
    ids = started(tails.groupBy("g", F.col("id").alias("p")).agg(F.sum("n").alias("n")), third, up, "p")
    last = started(tails, ids, F.col("id"), "tail").select("g", "id", "tail", "start", "total")
    inside = F.coalesce(F.sum("m").over(Window.partitionBy("g", "id", "tail").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("tail", tail).withColumn("inside", inside).join(last, ["g", "id", "tail"]).withColumn("start", F.col("start") + F.col("inside")).drop("tail", "inside")


def digits(total: Column, fanout: int) -> Column:
    """How many digits the ranks below ``total`` have; none for a single rank."""
    out, k = F.lit(0), 1
    while k < 2**62:
        out, k = out + (total > k).cast("int"), k * fanout
    return out


def reduced(leaves: DataFrame, fanout: int, more: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The runs of a trie, from the leaves (g, digits, i, h, more) up, and the tops (g, h) that have no digit left.

    A run (g, digits, i, members) holds the nodes below a prefix; members are structs (i, h), with ``more`` among the leaves.
    """
    runs, nodes, tops = [], leaves, leaves.filter("digits = 0").select("g", "h")
    while True:
        fields = ["i", "h", *(more if not runs else [])]
        below = nodes.filter("digits > 0").groupBy("g", (F.col("digits") - 1).alias("digits"), F.expr(f"i div {fanout}").alias("run"))
        made = written(below.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members")).withColumnRenamed("run", "i"), "merkle-runs")  # as many as the fanout
        if made.isEmpty():
            return runs, tops
        runs.append(made)
        nodes = made.select("g", "digits", "i", F.sha2(F.array_join(F.col("members.h"), ""), 256).alias("h"))
        tops = tops.unionByName(nodes.filter("digits = 0").select("g", "h"))


def siblings(members: Column, k: Column, fanout: int) -> Column:
    """The other members' hashes, before and behind the one at place ``k``."""
    h = members["h"]
    return F.struct(F.array_join(F.slice(h, F.lit(1), k), "").alias("left"), F.array_join(F.slice(h, k + 2, F.lit(fanout)), "").alias("right"))


def lowered(runs: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest runs, each with the path (siblings, level by level) from its own node to the root; tops: (g, path, subroot)."""
    start = tops.select("g", F.lit(0).alias("digits"), F.lit(0).cast("long").alias("i"), "path", "subroot")
    known = start
    for k, level in reversed(list(enumerate(runs))):
        here = level.join(known, ["g", "digits", "i"])
        if k == 0:
            return here
        child = lambda m, at: F.struct(m["i"].alias("i"), F.concat(F.array(siblings(F.col("members"), at, fanout)), F.col("path")).alias("path"))
        down = here.select("g", (F.col("digits") + 1).alias("digits"), "subroot", F.explode(F.transform("members", child)).alias("v")).select("g", "digits", "v.i", "v.path", "subroot")
        known = down.unionByName(start)
    return start.limit(0)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a column i: their place, from 0, in the order of the unique text ``key``; dealt by ranges, each numbered by itself."""
    dealt = written(rows.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    before, total = [], 0
    for r in sorted(dealt.groupBy("part").count().collect()):  # a row for each range
        before += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    first = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return dealt.withColumn("i", (first + place).cast("long")).drop("part")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", doc_id: str = "doc_id", now: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, now, subroot, root, path): a row for each row of ``docs``, with the siblings on its way to the root.

    leaf is a row's hash by ``fields``; now is that with the columns in ``now`` in place of its fields, null where it is
    the same.  ``folded(now or leaf, path)`` equals root exactly if the row is as it was.  Groups are the values of
    ``group``: null first, then in the order of their bytes.  In a group rows ascend by id (null ids count as -2^63), rows
    of one id by their leaves; equal rows take neighbouring places.  A null field counts as ``-``, empty text as ``0:``.
    Other columns are left out.  An empty table gives no rows.
    """
    col = lambda c: F.col(f"`{c}`")
    as_now = [(now or {}).get(c, col(c)) for c in fields]
    changed = F.lit(False)
    for c in now or {}:
        changed = changed | ~now[c].eqNullSafe(col(c))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), col(group).cast("string")), F.lit("")).alias("g"), F.coalesce(col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"), col(doc_id).isNull().alias("no_id"),
        leaf_hash([col(c) for c in fields]).alias("leaf"), (F.when(changed, leaf_hash(as_now)) if now else F.lit(None).cast("string")).alias("now"),
    )
    entries = written(leaves.groupBy("g", "id", "no_id", "leaf").agg(F.count("*").alias("m"), F.min("now").alias("now")), "merkle-entries")
    places = written(ranked(entries), "merkle-places").withColumn("digits", digits(F.col("total"), fanout))
    few = places.filter(F.col("m") <= CHUNK).withColumn("at", F.lit(0).cast("long"))
    many = places.filter(F.col("m") > CHUNK).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long")))).repartition("g", "id", "leaf", "at")
    last = F.least(F.col("at") + CHUNK, F.col("m")) - 1
    each = few.unionByName(many).withColumn("at", F.explode(F.sequence("at", last)))
    each = each.select("g", "digits", (F.col("start") + F.col("at")).alias("i"), F.col("leaf").alias("h"), F.when(~F.col("no_id"), F.col("id")).alias("id"), "now")
    runs, tops = reduced(each, fanout, ["id", "now"])
    subs = placed(tops.select("g", F.col("h").alias("subroot")), "g")
    n = subs.count()
    subs = written(subs.withColumn("digits", digits(F.lit(n), fanout)), "merkle-subroots")
    upper, top = reduced(subs.select(F.lit("").alias("g"), "digits", "i", F.col("subroot").alias("h"), F.col("g").alias("of")), fanout, ["of"])
    found = top.first()
    root = found["h"] if found else ""
    start = top.select("g", F.expr(f"cast(array() as {PATH})").alias("path"), F.lit("").alias("subroot"))
    if upper:
        of = lambda m, at: F.struct(m["of"].alias("g"), m["h"].alias("subroot"), F.concat(F.array(siblings(F.col("members"), at, fanout)), F.col("path")).alias("path"))
        tops = lowered(upper, start, fanout).select(F.explode(F.transform("members", of)).alias("v")).select("v.*")
    else:  # one group, or none
        tops = subs.select("g", "subroot", F.expr(f"cast(array() as {PATH})").alias("path"))
    tops = written(tops, "merkle-tops")
    out = each.filter("digits = 0").join(tops, "g").select(F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "now", "subroot", "path")
    if runs:
        one = lambda m, at: F.struct(m["id"].alias("doc_id"), m["h"].alias("leaf"), m["now"].alias("now"), F.concat(F.array(siblings(F.col("members"), at, fanout)), F.col("path")).alias("path"))
        low = lowered(runs, tops, fanout).select("subroot", F.explode(F.transform("members", one)).alias("v"))
        out = out.unionByName(low.select("v.doc_id", "v.leaf", "v.now", "subroot", "v.path"))
    return out.select("doc_id", "leaf", "now", "subroot", F.lit(root).alias("root"), "path")


def verified(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of what ``manifest`` returns."""
    made = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
