"""Headered sensor files, event lists, beats, questionnaires and result tables, and the sinks beside them.

Layout: ``<root>/Part <id>/<session>/EDA.csv | IBI.csv | tags.csv``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FS = 4.0


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(pid, sid, lines): each file of that name; participants are folders that start with Part, renamed to P."""
    raw = spark.read.text(f"{root}/Part*/*/{name}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda v: F.trim(v)), lambda v: v != "")
    return raw.select(F.replace(F.element_at(parts, -3), F.lit("Part "), F.lit("P")).alias("pid"), F.element_at(parts, -2).alias("sid"), lines.alias("lines"))


def _number(line: Column) -> Column:
    """The first comma-separated field; NaN and the like become null."""
    v = F.trim(F.split_part(line, F.lit(","), F.lit(1))).try_cast("double")
    return F.when(~F.isnan(v), v)


def read_signal(spark: SparkSession, root: str, name: str = "EDA.csv", check_rate: bool = True) -> DataFrame:
    """(pid, sid, t0, n, i, t, x): line 1 the start, line 2 the rate (4 Hz is asserted unless ``check_rate`` is off), then a value a line."""
    files = _files(spark, root, name).filter(F.size("lines") >= 2)
    head = files.select("pid", "sid", _number(F.col("lines")[0]).alias("t0"), _number(F.col("lines")[1]).alias("fs"), F.slice("lines", 3, F.greatest(F.lit(1), F.size("lines"))).alias("rest"))
    if check_rate:
        head = head.filter(F.assert_true(F.col("fs") == FS, F.lit("the sampling rate is not 4 Hz")).isNull())
    return head.select("pid", "sid", "t0", F.size("rest").cast("long").alias("n"), F.posexplode("rest").alias("i", "v")).select("pid", "sid", "t0", "n", F.col("i").cast("long").alias("i"), (F.col("t0") + F.col("i") / FS).alias("t"), _number(F.col("v")).alias("x"))


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    """(pid, sid, tag_t): an epoch a line; empty files and blank lines give none."""
    return _files(spark, root, "tags.csv").select("pid", "sid", F.explode("lines").alias("v")).select("pid", "sid", _number(F.col("v")).alias("tag_t")).filter("tag_t is not null")


def read_beats(spark: SparkSession, root: str) -> DataFrame:
    """(pid, sid, bt, rr): line 1 the start, then offset and interval; only clean beats, 0.3 < rr < 2 s."""
    files = _files(spark, root, "IBI.csv").filter(F.size("lines") >= 1)
    rows = files.select("pid", "sid", _number(F.col("lines")[0]).alias("t0"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("v"))
    rr = F.trim(F.split_part("v", F.lit(","), F.lit(2))).try_cast("double")
    return rows.select("pid", "sid", (F.col("t0") + _number(F.col("v"))).alias("bt"), rr.alias("rr")).filter("rr > 0.3 and rr < 2.0")


def sessions(signal: DataFrame) -> DataFrame:
    """(pid, sid, device, t0, t1, n, hours, start_utc)."""
    s = signal.groupBy("pid", "sid").agg(F.first("t0").alias("t0"), F.first("n").alias("n"))
    t1 = F.col("t0") + F.col("n") / FS
    return s.select("pid", "sid", F.upper(F.split_part("sid", F.lit("_"), F.lit(1))).alias("device"), "t0", t1.alias("t1"), "n", F.bround((t1 - F.col("t0")) / 3600, 2).alias("hours"), F.timestamp_seconds("t0").alias("start_utc"))


def read_questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """(subject, block, items): ``# ORDER`` names the blocks, each ``# STAI`` row their six items, divided by 4."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_quest\.csv$", 1).alias("subject"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    rows = files.select("subject", "at", F.split("line", ";").alias("f"))
    full = lambda c: F.filter(F.slice(c, 2, F.size(c)), lambda v: F.trim(v) != "")
    order = rows.filter(F.trim(F.col("f")[0]) == "# ORDER").select("subject", F.posexplode(full(F.col("f"))).alias("k", "block"))
    stai = rows.filter(F.trim(F.col("f")[0]) == "# STAI").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("a")).select("subject", F.posexplode("a").alias("k", "r"))
    items = F.transform(F.slice(full(F.col("r.f")), 1, 6), lambda v: (v.cast("double") / 4).cast("float"))
    return order.join(stai.select("subject", "k", items.alias("items")), ["subject", "k"]).select("subject", F.trim("block").alias("block"), "items")


def read_results(spark: SparkSession, paths: list[str], schema: str, key: str | None = None) -> DataFrame:
    """Result tables; paths that match nothing are skipped; ``key`` is a pattern whose groups become key1, key2 ..."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).globStatus(h):
            there.append(p)
    out = spark.read.schema(schema).csv(there, header=True) if there else spark.createDataFrame([], schema)
    if key:
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1) if there else F.lit("")
        out = out.select("*", *[F.regexp_extract(name, key, k + 1).alias(f"key{k + 1}") for k in range(key.count("("))])
    return out


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows as Parquet, a folder for each participant and split; participants that are written again replace their own folders only."""
    windows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pid", "split").option("compression", "zstd").parquet(path)


def read_windows(spark: SparkSession, path: str, pids: list | None = None) -> DataFrame:
    """Windows of ``write_windows``, of the named participants only if any are named: the folders of others are not read."""
    rows = spark.read.parquet(path)
    return rows if pids is None else rows.filter(F.col("pid").isin(pids))


def flat(report: DataFrame) -> DataFrame:
    """``report`` with the fields of its structs as columns of joined names, as a file of plain rows needs them."""
    columns = []
    for f in report.schema.fields:
        inner = f.dataType.fieldNames() if hasattr(f.dataType, "fieldNames") else []
        columns += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}_{x}") for x in inner] or [F.col(f"`{f.name}`")]
    return report.select(*columns)


def write_report(report: DataFrame, path: str, index: list[str] | None = None, mode: str = "overwrite") -> None:
    """A small report as one CSV file, index columns first; running again replaces it, or adds to it with ``mode`` append."""
    rows = flat(report)
    first = index or []
    rows.select(*first, *[c for c in rows.columns if c not in first]).repartition(1).write.mode(mode).csv(path, header=True)


def saved(spark: SparkSession, path: str, make) -> DataFrame:
    """The model's parameters at ``path``; where there are none, ``make`` is called and what it returns is kept there."""
    h = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not h.getFileSystem(spark._jsc.hadoopConfiguration()).exists(h):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in config.items()])).alias("value")).coalesce(1).write.mode("overwrite").text(path)
