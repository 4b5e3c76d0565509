"""Significance tests on columns; sums run in Spark, p-values on the few numbers that come out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as P
from ..helpers import settle
from .ranks import numbered


def numeric(c: Column) -> Column:
    """A cell as a double, null where it is none or not a number."""
    v = c.try_cast("double") if c is not None else c
    return F.when(~F.isnan(v), v)


def cleaned(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value): the numbers of each column, cells that are none dropped column by column."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), numeric(F.col(c).cast("string")).alias("value")) for c in columns])
    return df.select(F.explode(parts).alias("p")).select("p.*").where("value IS NOT NULL")


def _moments(values: DataFrame) -> dict[str, tuple[int, float, float]]:
    rows = values.groupBy("column").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()  # a row for each column tested
    return {r["column"]: (r["n"], r["m"], r["v"] if r["v"] is not None else math.nan) for r in rows}


def t_test(values: DataFrame, a: str, b: str, welch: bool = False) -> dict[str, float]:
    """Student's or Welch's test of two columns of (column, value); df is that of the test used for p."""
    m = _moments(values)
    (n1, m1, v1), (n2, m2, v2) = m[a], m[b]
    if welch:
        s1, s2 = v1 / n1, v2 / n2
        se, df = math.sqrt(s1 + s2), (s1 + s2) ** 2 / (s1**2 / (n1 - 1) + s2**2 / (n2 - 1))
    else:
        df = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df * (1 / n1 + 1 / n2))
    t = (m1 - m2) / se
    return {"t": t, "df": df, "p": P.t_p(t, df), "mean_a": m1, "mean_b": m2, "sd_a": math.sqrt(v1), "sd_b": math.sqrt(v2)}


def paired_t_test(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Paired test over the rows in which both columns are numbers; it is the same for Student and Welch."""
    r = df.select((numeric(F.col(a).cast("string")) - numeric(F.col(b).cast("string"))).alias("d")).where("d IS NOT NULL").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    t = r.m / (r.s / math.sqrt(r.n))
    return {"t": t, "df": r.n - 1, "p": P.t_p(t, r.n - 1)}


def anova(values: DataFrame) -> dict[str, float]:
    """One-way analysis of variance over the columns of (column, value)."""
    m = list(_moments(values).values())
    n, k = sum(x[0] for x in m), len(m)
    grand = sum(x[0] * x[1] for x in m) / n
    between, within = sum(x[0] * (x[1] - grand) ** 2 for x in m), sum((x[0] - 1) * x[2] for x in m if x[0] > 1)
    f = between / (k - 1) / (within / (n - k))
    return {"f": f, "df_between": k - 1, "df_within": n - k, "p": P.f_p(f, k - 1, n - k)}


def ranked(values: DataFrame) -> DataFrame:
    """(column, value, rank): mean ranks over all values. Values are counted first, so that ties are one row and the running sum is over
    distinct values, range by range."""
    from .ranks import numbered

    per = values.groupBy("value").agg(F.count("*").alias("c"))
    parts = numbered(per, "value", name="at")
    size = parts.withColumn("part", F.floor(F.col("at") / 65536))
    before = size.groupBy("part").agg(F.sum("c").alias("s"))
    before = before.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    upto = Window.partitionBy("part").orderBy("at")
    rows = size.join(F.broadcast(before), "part").select("value", "c", (F.col("base") + F.sum("c").over(upto) - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))
    return values.join(rows, "value").select("column", "value", "rank", "c")


def mann_whitney(values: DataFrame, a: str, b: str, exact_below: int = 9) -> dict[str, float]:
    """Two-sided U test of a against b: exact for small samples without ties, else the normal approximation with corrections for ties and
    continuity."""
    rows = ranked(values.where(F.col("column").isin(a, b)))
    per = {r["column"]: r for r in rows.groupBy("column").agg(F.count("*").alias("n"), F.sum("rank").alias("s"), F.avg("rank").alias("m")).collect()}
    ties = rows.groupBy("value").agg(F.first("c").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c")).alias("t")).first().t or 0.0
    n1, n2 = per[a]["n"], per[b]["n"]
    u1 = per[a]["s"] - n1 * (n1 + 1) / 2
    n, big = n1 + n2, max(u1, n1 * n2 - u1)
    if not ties and min(n1, n2) < exact_below:
        ways = {0: 1}  # subsets of the ranks by size and sum, as a table of sums for each size
        table = [dict() for _ in range(n1 + 1)]
        table[0] = ways
        for r in range(1, n + 1):
            for k in range(min(n1, r), 0, -1):
                for s, w in table[k - 1].items():
                    table[k][s + r] = table[k].get(s + r, 0) + w
        low = n1 * (n1 + 1) // 2
        p = min(1.0, 2 * sum(w for s, w in table[n1].items() if s - low >= big) / math.comb(n, n1))
    else:
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        p = min(1.0, 2 * P.normal_sf((big - n1 * n2 / 2 - 0.5) / sd)) if sd else 1.0
    return {"u": u1, "p": p, "mean_rank_a": per[a]["m"], "mean_rank_b": per[b]["m"]}


def pearson(df: DataFrame, a: str, b: str) -> dict:
    """Correlation over the rows in which both are numbers, its square, p, and a word for its strength."""
    rows = df.select(numeric(F.col(a).cast("string")).alias("a"), numeric(F.col(b).cast("string")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    r = rows.agg(F.corr("a", "b").alias("r"), F.count("*").alias("n")).first()
    if r.r is None or r.n < 3:
        return {"r": r.r, "r2": None, "n": r.n, "p": None, "strength": None}
    p = P.t_p(r.r * math.sqrt((r.n - 2) / max(1e-300, 1 - r.r * r.r)), r.n - 2)
    size = abs(r.r)
    word = next((w for bound, w in ((0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")) if size < bound), "very strong")
    return {"r": r.r, "r2": r.r * r.r, "n": r.n, "p": p, "strength": word}


def shapiro_wilk(values: DataFrame, column: str) -> dict[str, float]:
    """The test of at least 3 values. Up to 5000 are fetched; more are numbered in their order, and tasks sum their products with normal scores. p
    follows an approximation that was fitted up to 5000 values, so it is rough beyond, and n tells."""
    rows = values.where(F.col("column") == column).select(numeric(F.col("value")).alias("value")).where("value IS NOT NULL")
    facts = rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).first()
    n, mean = facts.n, facts.mean
    if n < 3:
        raise ValueError("the test is for 3 values and more")
    if n <= 5000:
        w, p = P.shapiro([r.value for r in rows.collect()])
        return {"w": w, "p": p, "n": n}
    if facts.low == facts.high:
        return {"w": 1.0, "p": 1.0, "n": n}
    score = lambda i: P.normal_ppf((i - 0.375) / (n + 0.25))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, x = batch.column(0).to_numpy(), batch.column(1).to_numpy() - mean
            m, inner = np.array([score(k) for k in i.tolist()]), (i > 2) & (i < n - 1)
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (m @ m, (m * x)[inner].sum(), x @ x)], ["mm", "mx", "xx"])

    ranked = settle(numbered(rows, "value", start=1).select("number", "value"), "ranked")
    r = ranked.mapInArrow(sums, "mm double, mx double, xx double").agg(F.sum("mm").alias("mm"), F.sum("mx").alias("mx"), F.sum("xx").alias("xx")).first()
    ends = {e.number: e.value for e in ranked.where(F.col("number").isin(1, 2, n - 1, n)).collect()}
    last, second, phi = P.shapiro_ends(n, r.mm, score(n), score(n - 1))
    w = min((r.mx / math.sqrt(phi) + last * (ends[n] - ends[1]) + second * (ends[n - 1] - ends[2])) ** 2 / r.xx, 1.0)
    return {"w": w, "p": P.shapiro_p(w, n), "n": n}


def chi_square(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Independence of two categorical columns, with the continuity correction if there is one degree of freedom, and Cramer's V."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o")).first()[0]
    k1, k2 = rows.count(), columns.count()
    dof = (k1 - 1) * (k2 - 1)
    grid = rows.crossJoin(F.broadcast(columns)).join(cells, ["a", "b"], "left").withColumn("e", F.col("ra") * F.col("cb") / total).withColumn("gap", F.abs(F.coalesce("o", F.lit(0)) - F.col("e")))
    gap = F.col("gap") - F.least(F.lit(0.5), F.col("gap")) if dof == 1 else F.col("gap")
    r = grid.agg(F.sum(gap * gap / F.col("e")).alias("x"), F.sum(F.col("gap") * F.col("gap") / F.col("e")).alias("plain"), F.min("e").alias("least")).first()
    return {"chi2": r.x, "dof": dof, "p": P.chi2_p(r.x, dof), "v": math.sqrt(r.x / (total * min(k1 - 1, k2 - 1))) if dof else 0.0, "least_expected": r.least}


def pairwise(values: DataFrame, names: list[str], test=t_test) -> list[tuple[str, str, dict]]:
    return [(a, b, test(values, a, b)) for a, b in combinations(names, 2)]


def spread(values: DataFrame) -> DataFrame:
    """(column, n, q1, median, q3, iqr) for drawing violins."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return values.groupBy("column").agg(F.count("*").alias("n"), q.alias("q")).select("column", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def normalised_labels(intensity: DataFrame, valid: DataFrame) -> DataFrame:
    """(id, score): distance of a node's intensity from the least of the valid nodes, or the median of all if none is valid, in standard
    deviations of all."""
    low = intensity.join(valid.select("id"), "id", "left_semi").agg(F.min("value").alias("low"))
    facts = F.broadcast(intensity.agg(F.median("value").alias("mid"), F.stddev_pop("value").alias("sd")).crossJoin(low))
    return intensity.crossJoin(facts).select("id", F.try_divide(F.col("value") - F.coalesce("low", "mid"), "sd").alias("score"))


def histogram_slopes(values: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, slope): counts of equal bins and the step to the next."""
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / ((high - low) / bins))).cast("int")
    per = values.where((F.col("value") >= low) & (F.col("value") <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return grid.withColumn("slope", F.lead("n").over(Window.orderBy("bin")) - F.col("n"))
