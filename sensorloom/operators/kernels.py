"""Recursive filters and peaks as Arrow kernels over arrays of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..shared import written

#: Samples of a part of a recording: somewhat more than an hour at 4 Hz.
PART = 16_384
PHASIC = ("tonic_mean", "tonic_std", "tonic_slope", "phasic_mean", "phasic_std", "phasic_max", "phasic_auc", "scr_count", "scr_amp_mean", "scr_amp_max")


def lowpass(samples: DataFrame, cutoff: float = 1.25, rate: float = 4.0, part: int = PART) -> DataFrame:
    """(pid, sid, i, x, smooth): each recording (a session of one device) through a zero-phase low-pass filter of order 2.

    A recording is cut into parts of ``part`` sample numbers, so one that holds most of the rows is many tasks' work; the
    filter's state is handed on between parts (``signal.Carried``), of which only summaries of some 30 numbers meet by
    recording.  Recordings of up to 9 samples come back as they are; a missing sample makes those in the filter's reach NaN.
    """
    carried = signal.Carried(*signal.butter(2, cutoff, rate))
    keys = ["pid", "sid", "part"]

    @F.pandas_udf("n long, forth array<double>, back array<double>, head array<double>, tail array<double>")
    def summary(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in parts:
            yield pd.DataFrame([carried.summary(np.asarray(x, float)) for x in some], columns=["n", "forth", "back", "head", "tail"])

    @F.pandas_udf("array<struct<before: array<double>, behind: array<double>>>")
    def scan(recordings: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for n, *arrays in recordings:
            made = []
            for r in range(len(n)):
                own = [list(map(np.asarray, c.iloc[r])) for c in arrays]
                made.append([{"before": z, "behind": w} for z, w in carried.scan(list(zip(n.iloc[r], *own, strict=True))) or []])
            yield pd.Series(made, dtype=object)

    @F.pandas_udf("array<double>")
    def smooth(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, before, behind in parts:
            yield pd.Series([np.asarray(v, float) if z is None else carried.part(np.asarray(v, float), z, w) for v, z, w in zip(x, before, behind, strict=True)], dtype=object)

    cut = samples.groupBy("pid", "sid", F.floor(F.col("i") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("rows"))
    parts = written(cut, "parts")
    of = parts.select(*keys, summary(F.col("rows.x")).alias("m")).groupBy("pid", "sid").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("all"))
    found = of.select("pid", "sid", F.col("all.part").alias("part"), scan(*[F.col(f"all.m.{c}") for c in ("n", "forth", "back", "head", "tail")]).alias("state"))
    # written, so that Spark knows the states' size when it chooses how to join
    states = written(found.select("pid", "sid", F.explode(F.arrays_zip("part", "state")).alias("v")).select("pid", "sid", "v.part", "v.state.before", "v.state.behind"), "states")
    a, b = parts.alias("a"), states.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.pid", "a.sid", "rows", smooth(F.col("rows.x"), "before", "behind").alias("smooth"))
    return both.select("pid", "sid", F.explode(F.arrays_zip("rows", "smooth")).alias("v")).select("pid", "sid", "v.rows.i", "v.rows.x", "v.smooth")


def phasic(windows: DataFrame) -> DataFrame:
    """(pid, sid, s, ...) of ``windows`` (pid, sid, s, x): phasic, tonic and response features, windows of one length side by side."""

    @F.pandas_udf(", ".join(f"{n} double" for n in PHASIC))
    def features(windows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in windows:
            yield pd.DataFrame(signal.phasic_features([np.asarray(v, float) for v in some]), columns=list(PHASIC))

    return windows.select("pid", "sid", "s", features("x").alias("f")).select("pid", "sid", "s", "f.*")
