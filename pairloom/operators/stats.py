"""Paired statistics of many systems against a baseline (STA01-STA06, JON06)."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.prefix_sums import positions
from pairloom.plans.shared import kept

_BLOCK, _DRAWN = 1 << 16, 1 << 14
COMPENSATED = sum([1.0, 1e100, 1.0, -1e100]) == 2.0


def normal_p(z: Column) -> Column:
    """Two-tailed p of a standard normal by a fifth-degree polynomial (Abramowitz and Stegun 26.2.17); 1 at or below 0."""
    t = 1 / (1 + z * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))  # fixed values
    return F.when(z <= 0, F.lit(1.0)).otherwise(2 * (F.exp(-0.5 * z * z) * poly / math.sqrt(2 * math.pi)))


def student_p(t: float, df: int) -> float:
    """Two-tailed p of Student's t by the continued fraction of the incomplete beta function."""
    if df < 1 or math.isnan(t):
        return 1.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(p: float, q: float, y: float) -> float:
        c, d = 1.0, 1 / (1 - (p + q) * y / (p + 1) or 1e-300)
        h = d
        for m in range(1, 400):
            for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / ((1 + term * d) or 1e-300)
                c = (1 + term / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def student(t: pd.Series, df: pd.Series) -> pd.Series:
    """``student_p`` of the few rows of a comparison."""
    return pd.Series([student_p(float(a), int(b)) for a, b in zip(t, df)], dtype="float64")


def compare_all(runs: DataFrame, baseline: str, alpha: float = 0.05, exact: bool = False) -> DataFrame:
    """One row per system: paired t, p by the normal approximation (``exact``: by Student's t), effect size, Bonferroni's verdict; only samples that every system has count.

    ``p_corrected`` is p times the number of systems, not capped."""
    runs = kept(runs, "runs")  # read twice
    base = runs.where(F.col("run") == baseline).select("sample_id", F.col("cer").alias("a"))
    pairs = runs.where(F.col("run") != baseline).join(base, "sample_id").withColumn("d", F.col("a") - F.col("cer"))
    sums = pairs.groupBy("run").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("std_diff"))
    t = F.when((F.col("n") < 2) | (F.col("std_diff") == 0), 0.0).otherwise(F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n")))
    out = sums.withColumn("t_stat", t).withColumn("cohens_d", F.when((F.col("n") < 2) | (F.col("std_diff") == 0), 0.0).otherwise(F.col("mean_diff") / F.col("std_diff")))
    systems = F.count("*").over(Window.partitionBy())
    out = out.withColumn("p_value", student("t_stat", F.col("n") - 1) if exact else normal_p(F.abs("t_stat"))).withColumn("_k", systems)
    return out.withColumn("p_corrected", F.col("p_value") * F.col("_k")).withColumn("significant", F.col("p_value") < alpha / F.col("_k")).drop("_k")


def poisson_table() -> np.ndarray:
    """The Poisson(1) weight of each 16-bit number."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.float64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits stirred by the finaliser of a public generator (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_interval(runs: DataFrame, baseline: str, repeats: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``run, low, high``: Poisson bootstrap of the mean difference: each row gets a weight for each repeat from a hash of its id, a partition sums them
    in arrays of ``repeats`` numbers for each run, so neither is a row repeated nor are rows gathered. Weights follow the distribution to 1 in 65,536."""
    runs = kept(runs, "runs")  # read twice
    base = runs.where(F.col("run") == baseline).select("sample_id", F.col("cer").alias("a"))
    pairs = runs.where(F.col("run") != baseline).join(base, "sample_id").select("run", "sample_id", (F.col("a") - F.col("cer")).alias("d"))
    table = poisson_table()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, hashes, values = np.array(batch["run"].to_pylist(), dtype=object), batch["h"].to_numpy().view(np.uint64), batch["d"].to_numpy()
            for name in set(names.tolist()):
                here = np.flatnonzero(names == name)
                total = sums.setdefault(name, np.zeros((2, repeats)))
                for first in range(0, len(here), 512):
                    rows = here[first : first + 512]
                    w = table[(mixed(hashes[rows][:, None] + steps[None, :]) >> np.uint64(48)).astype(np.int64)]
                    total += (values[rows] @ w, w.sum(axis=0))
        for name, (s, n) in sums.items():
            yield pa.RecordBatch.from_pydict({"run": [name] * repeats, "b": np.arange(repeats, dtype=np.int32), "s": s, "n": n})

    parts = pairs.where("run IS NOT NULL AND d IS NOT NULL").select("run", F.xxhash64(F.lit(seed), "sample_id").alias("h"), "d").mapInArrow(partial, "run string, b int, s double, n double")
    means = parts.groupBy("run", "b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    ranked = means.where("m IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("m")))
    low, high = int(alpha / 2 * repeats) + 1, min(repeats, int((1 - alpha / 2) * repeats) + 1)
    return ranked.groupBy("run").agg(F.max(F.when(F.col("k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("m"))).alias("high"))


def repeat_states(n: int, repeats: int, tasks: int, seed: int) -> list[tuple[int, int, bytes, int]]:
    """For each task its first repeat, its number of repeats, and the state of Python's seeded generator there, if a repeat draws ``n`` numbers."""
    generator, out = np.random.RandomState(), []
    words = random.Random(seed).getstate()[1]
    generator.set_state(("MT19937", np.array(words[:-1], np.uint32), words[-1]))
    per = -(-repeats // tasks)
    for first in range(0, repeats, per):
        _, state, at, *_ = generator.get_state()
        out.append((first, min(per, repeats - first), state.astype("<u4").tobytes(), int(at)))
        left = n * per if first + per < repeats else 0
        while left:
            left -= len(generator.random_sample(min(left, 1 << 20)))
    return out


class ExactSum:
    """What ``sum`` makes of the same floats in the same order, chunk by chunk: running sums, and what each addition rounds off, added up too (Neumaier's sum, as Python has it from 3.12 on)."""

    def __init__(self):
        self.total, self.lost = 0.0, 0.0

    def add(self, x: np.ndarray) -> None:
        upto = np.cumsum(np.concatenate(([self.total], x)))
        before, after = upto[:-1], upto[1:]
        lost = np.where(np.abs(before) >= np.abs(x), (before - after) + x, (x - after) + before)
        self.total, self.lost = float(upto[-1]), float(np.cumsum(np.concatenate(([self.lost], lost)))[-1])

    @property
    def value(self) -> float:
        return self.total + self.lost if COMPENSATED and self.lost and math.isfinite(self.lost) else self.total


def exact_bootstrap(runs: DataFrame, baseline: str, repeats: int = 1000, alpha: float = 0.05, seed: int = 42, tasks: int = 32) -> DataFrame:
    """The same with Python's seeded generator, value for value: the differences of a system, in order, are blocks of an array, and its repeats are spread over ``tasks``, each of which
    starts with the generator's state there. A task holds eight bytes for each sample of its system; a system of one sample has the interval (0, 0)."""
    runs = kept(runs, "runs")  # read twice
    base = runs.where(F.col("run") == baseline).select("sample_id", F.col("cer").alias("a"))
    pairs = runs.where(F.col("run") != baseline).join(base, "sample_id").select("run", "ord", (F.col("a") - F.col("cer")).alias("d")).where("d IS NOT NULL")
    placed = positions(pairs, ["run"], ["ord", "d"])
    block = F.floor(F.col("position") / _BLOCK).cast("long").alias("block")
    blocks = kept(placed.groupBy("run", block).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "d"))), lambda x: x["d"]).alias("ds")), "bootstrap-blocks")
    sizes = {r.run: r.n for r in blocks.groupBy("run").agg(F.sum(F.size("ds")).alias("n")).collect()}
    states = {n: repeat_states(n, repeats, tasks, seed) for n in set(sizes.values()) if n > 1}
    starts = [(run, *s) for run, n in sizes.items() for s in states.get(n, [(0, repeats, b"", 0)])]

    def means(rows: pd.DataFrame) -> pd.DataFrame:
        d = np.concatenate(rows.sort_values("block")["ds"].tolist())
        first, times, state, at = rows[["first", "times", "state", "at"]].iloc[0]
        if not state:
            return pd.DataFrame({"run": [rows["run"].iloc[0]] * times, "m": [0.0] * times})
        generator, n, out = np.random.RandomState(), len(d), []
        generator.set_state(("MT19937", np.frombuffer(state, "<u4"), int(at)))
        for _ in range(times):
            total = ExactSum()
            for k in range(0, n, _DRAWN):
                total.add(d[(generator.random_sample(min(_DRAWN, n - k)) * n).astype(np.int64)])
            out.append(total.value / n)
        return pd.DataFrame({"run": [rows["run"].iloc[0]] * times, "m": out})

    kind = runs.schema["run"].dataType.simpleString()
    dealt = runs.sparkSession.createDataFrame(starts, f"run {kind}, first int, times int, state binary, at int")
    found = blocks.join(F.broadcast(dealt), "run").groupBy("run", "first").applyInPandas(means, f"run {kind}, m double")
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("m")) - 1)
    at = lambda q: F.max(F.when(F.col("k") == max(0, min(int(q * repeats), repeats - 1)), F.col("m")))
    return ranked.groupBy("run").agg(at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))
