"""Kendall's tau-b with its p-value: exact without ties for small tables, else by the normal limit.

kendall() compares topics, of which there are few, inside one array.
kendall_long() takes tables of any length: discordant pairs are inversions, and
those are counted over blocks of rows with neighbouring x and ranges of
neighbouring y.  Pairs that differ in both block and range follow from a
histogram of (block, range); pairs within a block, and pairs within a range, are
counted there by merging.  No task holds more than a block or a range.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..lineage import cut

#: Largest table for which the exact distribution is used.
EXACT_ROWS = 33

#: The pairs of metrics that are compared.
METRIC_PAIRS = tuple((p, d) for p in ("avg_views", "avg_comments", "avg_score") for d in ("avg_no_accepted_answer", "avg_hours")) + (("fused_popularity", "fused_difficulty"),)


def exact_p(n: int, discordant: int) -> float:
    """Two-sided p without ties: share of permutations with as many or fewer inversions, twice."""
    pairs = n * (n - 1) // 2
    least = min(discordant, pairs - discordant)
    if n <= 2 or 2 * least == pairs:
        return 1.0
    counts = [1]
    for k in range(2, n + 1):  # inversions of permutations of k: k ways to insert the largest
        sums, out = 0, []
        for j in range(min(least, k * (k - 1) // 2) + 1):
            sums += (counts[j] if j < len(counts) else 0) - (counts[j - k] if j >= k and j - k < len(counts) else 0)
            out.append(sums)
        counts = out
    return min(1.0, 2 * sum(counts[: least + 1]) / math.factorial(n))


def tie_sums(values: Iterable) -> tuple[int, int, int]:
    sizes = pd.Series(list(values)).value_counts()
    sizes = [int(s) for s in sizes if s > 1]
    return sum(s * (s - 1) // 2 for s in sizes), sum(s * (s - 1) * (s - 2) for s in sizes), sum(s * (s - 1) * (2 * s + 5) for s in sizes)


def p_value(n: int, difference: int, x: Iterable, y: Iterable) -> float:
    """p of tau from concordant less discordant pairs and the two columns (for their ties)."""
    return p_of_ties(n, difference, tie_sums(x), tie_sums(y))


def p_of_ties(n: int, difference: int, x_ties: tuple[int, int, int], y_ties: tuple[int, int, int]) -> float:
    (xt, x0, x1), (yt, y0, y1) = x_ties, y_ties
    pairs = n * (n - 1) // 2
    if n < 2 or xt == pairs or yt == pairs:
        return math.nan
    discordant = (pairs - difference) // 2
    if not xt and not yt and (n <= EXACT_ROWS or min(discordant, pairs - discordant) <= 1):
        return exact_p(n, discordant)
    m = n * (n - 1)
    variance = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(difference) / math.sqrt(variance) / math.sqrt(2))


def kendall(table: DataFrame, pairs=METRIC_PAIRS) -> DataFrame:
    """x, y, n, tau, p for each pair of columns; rows with a null in either are left out.

    ``table`` has one row a topic.  Pairs of topics are compared inside one
    array of that few values, so no join multiplies rows.
    """
    per_pair = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("u"), F.col(y).cast("double").alias("v")) for x, y in pairs])
    rows = table.select(F.inline(per_pair)).where("u IS NOT NULL AND v IS NOT NULL")
    grouped = rows.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("w"))
    add = lambda f: lambda acc, i: acc + F.aggregate(F.slice("w", F.lit(1), i - 1), F.lit(0).cast("bigint"), lambda inner, e: inner + f(F.get("w", i - 1), e))
    total = lambda f: F.aggregate(F.sequence(F.lit(1), F.size("w")), F.lit(0).cast("bigint"), add(f))
    sign = lambda a, b, k: F.signum(a[k] - b[k]).cast("bigint")
    out = grouped.select(
        "x", "y", F.size("w").cast("bigint").alias("n"), "w",
        total(lambda a, b: sign(a, b, "u") * sign(a, b, "v")).alias("s"),
        total(lambda a, b: F.abs(sign(a, b, "u"))).alias("du"),
        total(lambda a, b: F.abs(sign(a, b, "v"))).alias("dv"),
    )

    @F.pandas_udf(DoubleType())
    def p_of(n: pd.Series, s: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([p_value(int(a), int(b), c, d) for a, b, c, d in zip(n, s, u, v)])

    tau = F.try_divide(F.col("s"), F.sqrt(F.col("du").cast("double") * F.col("dv")))
    return out.select("x", "y", "n", tau.alias("tau"), p_of("n", "s", F.col("w.u"), F.col("w.v")).alias("p"))


# --- long tables ---------------------------------------------------------------------------------------------------

#: Rows in a block and in a range, about; blocks and ranges, at most.
BLOCK_ROWS, MOST_BLOCKS = 50_000, 512


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of weight products of pairs that stand in falling order, by merging ever longer sorted runs."""
    n, total, width = len(values), 0, 1
    if n < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    weights = weights.astype(object) if float(weights.sum()) ** 2 >= 2**62 else weights.astype(np.int64)
    at = np.arange(n)
    while width < n:
        run = at // width
        pair = run // 2
        # Runs are sorted: one search over (pair, rank) finds for every right element how much of its left run is larger.
        left = run % 2 == 0
        keys = pair * (n + 1) + rank
        sums = np.concatenate([[0], np.cumsum(weights[left])])
        ends = np.searchsorted(pair[left], pair[~left], side="right")
        larger = sums[ends] - sums[np.searchsorted(keys[left], keys[~left], side="right")]
        total += int((larger * weights[~left]).sum())
        order = np.argsort(keys, kind="stable")
        rank, weights = rank[order], weights[order]
        width *= 2
    return total


def histogram_inversions(block: np.ndarray, range_: np.ndarray, n: np.ndarray) -> int:
    """Pairs of rows with a smaller block and a larger range, from the counts of (block, range)."""
    cells = np.zeros((block.max(initial=0) + 1, range_.max(initial=0) + 1), float if n.sum() >= 2**31 else np.int64)
    cells[block, range_] = n
    above = np.zeros(cells.shape[1], cells.dtype)
    total = 0
    for row in cells:  # blocks in order; above: rows of earlier blocks by range
        larger = np.concatenate([np.cumsum(above[::-1])[::-1][1:], [0]])
        total += int(sum(int(a) * int(b) for a, b in zip(larger, row) if a and b))
        above = above + row
    return total


def _bounds(rows: DataFrame, column: str, parts: int) -> list[float]:
    return sorted(set(rows.approxQuantile(column, [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []


def _part(bounds: list[float], column: str) -> Column:
    """2k below the k-th bound, 2k + 1 at it: a value that fills a part has it for itself."""

    @F.pandas_udf("int")
    def number(values: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, values)
        return pd.Series((2 * at + [k < len(bounds) and bounds[k] == v for k, v in zip(at, values)]).astype(np.int32))

    return number(F.col(column)) if bounds else F.lit(0)


def _ties(rows: DataFrame, column: str) -> tuple[int, int, int]:
    s = F.col("s").cast("decimal(38,0)")
    sums = rows.groupBy(column).agg(F.sum("w").alias("s")).where("s > 1")
    found = sums.agg(F.sum(s * (s - 1)), F.sum(s * (s - 1) * (s - 2)), F.sum(s * (s - 1) * (2 * s + 5))).first()
    pairs, cubes, fives = (int(x or 0) for x in found)
    return pairs // 2, cubes, fives


def kendall_long(table: DataFrame, pairs: Iterable[tuple[str, str]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """x, y, n, tau, p for each pair of columns of a table of any length; rows with a null or NaN in either are left out.

    tau and p are null where a column has fewer than two different values.
    """
    spark, out = table.sparkSession, []
    for x, y in pairs:
        rows = table.select(F.col(x).cast("double").alias("u"), F.col(y).cast("double").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)")
        rows = cut(rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w")))  # equal rows are weighed
        n = int(rows.agg(F.sum("w")).first()[0] or 0)
        parts = min(MOST_BLOCKS, math.ceil(n / block_rows))
        marked = cut(rows.withColumns({"block": _part(_bounds(rows, "u", parts), "u"), "range": _part(_bounds(rows, "v", parts), "v")}))

        def count(order: list[str], by: str):
            def run(part: pd.DataFrame) -> pd.DataFrame:
                part = part.sort_values(order, kind="stable")
                return pd.DataFrame({"n": [str(inversions(part[by].to_numpy(), part["w"].to_numpy()))]})

            return run

        # Within a block pairs of unlike ranges; within a range all pairs.  A part of one value (odd) has no inversions.
        within = marked.where("block % 2 = 0").groupBy("block").applyInPandas(count(["u", "range"], "range"), "n string")
        within = within.unionByName(marked.where("range % 2 = 0").groupBy("range").applyInPandas(count(["u", "v"], "v"), "n string"))
        falling = sum(int(r["n"]) for r in within.collect())  # a row a part
        cells = marked.groupBy("block", "range").agg(F.sum("w").alias("w")).toArrow().to_pandas()  # at most the square of the parts
        falling += histogram_inversions(cells["block"].to_numpy(np.int64), cells["range"].to_numpy(np.int64), cells["w"].to_numpy(np.int64))
        both = rows.agg(F.sum(F.col("w").cast("decimal(38,0)") * (F.col("w") - 1))).first()[0]
        ties, total = (_ties(rows, "u"), _ties(rows, "v")), n * (n - 1) // 2
        unlike = [total - t[0] for t in ties]
        s = total - ties[0][0] - ties[1][0] + int(both or 0) // 2 - 2 * falling
        known = min(unlike) > 0
        out.append((x, y, n, s / math.sqrt(unlike[0]) / math.sqrt(unlike[1]) if known else None, p_of_ties(n, s, *ties) if known else None))
    return spark.createDataFrame(out, "x string, y string, n bigint, tau double, p double")


def correlation_table(result: DataFrame) -> DataFrame:
    """metric and a column a difficulty metric with cells ``tau [p]``, three decimals; the fused row last."""
    cell = F.format_string("%.3f [%.3f]", "tau", "p")
    is_fused = F.col("x") == "fused_popularity"
    metric = F.when(is_fused, F.lit("Fused Popularity vs Fused Difficulty")).otherwise(F.concat(F.initcap(F.replace("x", F.lit("avg_"))), F.lit(" (avg)")))
    column = F.when(is_fused | (F.col("y") == "avg_no_accepted_answer"), F.lit("no accepted answer")).otherwise(F.lit("hours"))
    table = result.select(metric.alias("metric"), column.alias("column"), cell.alias("cell")).groupBy("metric").pivot("column", ["no accepted answer", "hours"]).agg(F.first("cell"))
    return table.na.fill("", ["no accepted answer", "hours"])
