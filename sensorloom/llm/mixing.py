"""Mixing sources to target weights by soft membership (operator 4).

A classifier fitted on a bounded sample of labelled rows gives each document a posterior over domains.
Document rates r >= 0 then minimise the squared distance of the expected token totals of the domains,
sum_i r_i tokens_i posterior_id, to their targets.  Each projected-gradient step is one distributed sum over
the written posteriors; the driver holds one number for each domain.  Distances of rates count by tokens,
so documents of equal posterior get equal rates, long or short.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, flagged, forget_others, free_name, text_or_empty, written

#: Most labelled rows that the classifier sees, by the order of a hash of their ids.
SAMPLE = 6_000
BUCKETS = 16_384
STEPS, TOLERANCE = 40, 1e-6
MEMORY = 250_000


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = b = crc32(word.lower().encode("utf-8", "replace")) % BUCKETS
        return b


PLACES = Buckets()
MEMORIES["mixing"] = PLACES.clear


def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the distinct tokens between white space, their counts, and the number of tokens."""
    counts = Counter(text.split())
    ids = np.fromiter(map(PLACES.__getitem__, counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    return ids, n, int(n.sum())


def fit(docs: DataFrame, labelled: DataFrame, domain: str, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float, np.ndarray]:
    """(domains, log probability of each bucket by domain, sharpness, log share of each domain).

    Multinomial naive Bayes over hashed tokens of the rows of ``docs`` that ``labelled`` names; ``domain`` is a
    column of ``docs``.  The sharpness multiplies the mean log likelihood of a token, and is fitted on rows that
    the counts leave out.  Null ids and domains are left out; of rows with one id that whose text has the smallest
    digest counts.
    """
    spark = docs.sparkSession
    ids = labelled.select(F.col(doc_id).cast("long").alias("who")).filter("who is not null").distinct().orderBy(F.xxhash64("who"), "who").limit(sample)
    rows = spark.createDataFrame(ids.toArrow())  # at most ``sample`` ids
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("who"), F.col(f"`{domain}`").cast("string").alias("domain"), text_or_empty(f"`{text}`").alias("text")).filter("domain is not null")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.bincount(i, n, minlength=BUCKETS).astype(np.float32) for i, n, _ in (bag(t.as_py()) for t in batch.column(2))]
            kept = [np.flatnonzero(b).astype(np.int32) for b in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.list_(pa.int32())), pa.array([b[k] for b, k in zip(out, kept, strict=True)], pa.list_(pa.float32()))], names=["who", "domain", "at", "n"])

    one = F.min_by(F.struct("domain", "text"), F.struct(F.sha2(F.encode("text", "UTF-8"), 256), "domain")).alias("row")
    found = whole.join(F.broadcast(rows), "who").groupBy("who").agg(one).select("who", "row.*")
    got = found.mapInArrow(bags, "who long, domain string, at array<int>, n array<float>").toArrow().to_pylist()
    got.sort(key=lambda r: (crc32(str(r["who"]).encode()), r["domain"]))
    names = sorted({r["domain"] for r in got})
    if not names:
        return [], np.zeros((0, BUCKETS)), 1.0, np.zeros(0)
    counts, share = np.ones((len(names), BUCKETS)) * 0.1, np.ones(len(names))
    held = [r for i, r in enumerate(got) if i % 5 == 0] if len(got) >= 20 else got
    for i, r in enumerate(got):
        if i % 5 or len(got) < 20:
            d = names.index(r["domain"])
            np.add.at(counts[d], r["at"], r["n"])
            share[d] += 1
    log_p, log_share = np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(share / share.sum())
    means = np.array([(log_p[:, r["at"]] @ np.array(r["n"]) / max(1, sum(r["n"]))) for r in held])
    truth = np.array([names.index(r["domain"]) for r in held])

    def loss(sharp: float) -> float:
        z = sharp * means + log_share
        return float(np.mean(np.logaddexp.reduce(z, axis=1) - z[np.arange(len(z)), truth]))

    return names, log_p, min(np.geomspace(0.5, 64, 57), key=loss), log_share


def memberships(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """``docs`` with a column membership: struct (n_tokens, posterior by domain); its text is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    @F.pandas_udf("n_tokens long, posterior array<double>")
    def member(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget_others("mixing")
        names, log_p, sharp, log_share = shared.value
        for part in texts:
            tokens, posterior = [], []
            for t in part:
                ids, n, total = bag(t)
                z = sharp * (log_p[:, ids] @ n) / max(1, total) + log_share
                p = np.exp(z - z.max()) if len(z) else z
                tokens.append(total)
                posterior.append(p / p.sum() if len(p) else p)
            yield pd.DataFrame({"n_tokens": tokens, "posterior": posterior})

    return docs.withColumn("membership", member(text_or_empty(f"`{text}`")))


def stepped(r: Column, steps: list[np.ndarray]) -> Column:
    """Rates after more steps, each clipped at 0."""
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(float(x)) * F.col("posterior")[d] for d, x in enumerate(g)), F.lit(0.0)))
    return r


def with_rates(members: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``members`` (n_tokens, posterior and more) with a column rate, fitted by projected gradient to the domains' targets; and the error left.

    Rows are scaled by the domains' own weights, so that one step length suits all of them.  Steps end when no domain is off
    by more than ``tolerance`` of all targets, when a step no longer changes the totals by a thousandth of that (a target
    that no rates reach, as of a domain without documents), or after ``steps``; the error, the largest distance of a domain
    from its target in shares of all targets, says which.
    """
    D = len(targets)
    w, p = F.col("n_tokens").cast("double"), F.col("posterior")
    gram = members.agg(*[F.sum(w * p[a] * p[b]).alias(f"g{a}_{b}") for a in range(D) for b in range(a, D)]).first()
    G = np.zeros((D, D))
    for a in range(D):
        for b in range(a, D):
            G[a, b] = G[b, a] = gram[f"g{a}_{b}"] or 0.0
    scale = 1 / np.sqrt(np.maximum(np.diag(G), 1e-12))
    length = 1 / max(float(np.linalg.eigvalsh(scale[:, None] * G * scale).max()), 1e-12)
    made: list[np.ndarray] = []
    state, done, before, error = members.withColumn("rate", F.lit(1.0)), 0, np.inf, 0.0
    for k in range(steps + 1):
        r = stepped(F.col("rate"), made[done:])
        totals = state.agg(*[F.sum(w * r * p[d]).alias(f"t{d}") for d in range(D)]).first()
        off = np.array([totals[f"t{d}"] or 0.0 for d in range(D)]) - targets
        most = tolerance * max(1.0, targets.sum())
        error = float(np.abs(off).max() / max(1.0, targets.sum()))
        if np.abs(off).max() <= most or np.abs(off - before).max() <= most / 1000 or k == steps:
            break
        before = off
        made.append(length * scale * scale * off)
        if len(made) - done == 10:  # rates so far become a table, so that expressions stay short
            state, done = written(state.withColumn("rate", stepped(F.col("rate"), made[done:])), "rates"), len(made)
    return state.withColumn("rate", stepped(F.col("rate"), made[done:])), error


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain: str = "lang", text: str = "text", doc_id: str = "doc_id", budget: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_sha256, n_tokens, posterior, domain, rate, copies, target_error): a row for each row of ``docs``.

    targets: wanted share of tokens of each domain (scaled to sum to 1); domains without one aim at 0, names that
    no labelled row has are left out.  budget: tokens in all, as many as ``docs`` has unless given.  posterior is
    in the order of the domains' names; domain is the likeliest.  copies is the rate rounded up or down by a hash of
    the row, so that its expectation is the rate; repeated rows are rounded alike.  Rows without tokens keep rate
    and copies of 1, null texts count as empty, null ids are kept.  Without labelled rows all rates are 1 and the error is null.
    target_error, alike in all rows, is the largest distance of a domain's expected tokens from its target, in shares of all.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{domain}`").alias("domain"), text_or_empty(f"`{text}`").alias("text"))
    model = fit(rows, labelled, "domain", sample=sample)
    names = model[0]
    sha = F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    members = written(memberships(rows, model).select("doc_id", sha, "membership.n_tokens", "membership.posterior"), "members")
    wanted = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
    error = None
    if len(names) and wanted.sum() > 0:
        total = budget if budget is not None else float(members.agg(F.sum("n_tokens")).first()[0] or 0)
        members, error = with_rates(members, wanted / wanted.sum() * total)
    else:
        members = members.withColumn("rate", F.lit(1.0))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    likeliest = F.element_at(F.array(*[F.lit(x) for x in names]), best) if names else F.lit(None).cast("string")
    members = members.withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("rate")).otherwise(1.0))
    uniform = F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(1 << 20)) / float(1 << 20)
    return members.withColumns({"domain": likeliest, "copies": F.floor(F.col("rate") + uniform)}).select("doc_id", "text_sha256", "n_tokens", "posterior", "domain", "rate", "copies", F.lit(error).cast("double").alias("target_error"))


def mixed(docs: DataFrame, rates: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as ``rates`` (of mix) says."""
    key, n, flag = (free_name(docs, x) for x in ("key_", "copies_", "flag_"))
    name = lambda who, sha: F.concat_ws("/", sha, F.coalesce(who.cast("string"), F.lit("")))
    # equal rows have equal rates; only rows whose number may change are joined, the others stay where they are
    changed = written(rates.filter("copies != 1").groupBy(name(F.col("doc_id"), F.col("text_sha256")).alias(key)).agg(F.max("copies").alias(n)), "changed")
    sha = F.sha2(F.encode(text_or_empty(f"`{text}`"), "UTF-8"), 256)
    keyed = flagged(docs.withColumn(key, name(F.col(f"`{doc_id}`").cast("long"), sha)), F.col(key), changed.select(key), flag)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    times = F.coalesce(F.col(n), F.lit(1)).cast("int")
    maybe = keyed.filter(flag).drop(flag).join(changed, key, "left").filter(times > 0).withColumn(n, F.explode(F.array_repeat(F.lit(1), times)))
    return keyed.filter(~F.col(flag)).select(*columns).unionByName(maybe.select(*columns))
