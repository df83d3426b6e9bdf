"""Order statistics of many columns from one table of counted values.

The rows are melted once into `(column, value)` and counted; the counts, one row per
distinct value, are dealt to ranges of `(column, value)` and written. Rows and distinct
values per range and column are a table of at most ranges + columns rows, whose running
sums tell which range holds a wanted rank. Distinct counts are then sums, any quantile is
found inside one range, and modes and top values are ranked per range first. No task holds
a column, and the source is read once whatever is asked.

Numbers are ordered as doubles. Whole numbers and decimals that a double does not hold
exactly also carry their text, so distinct values stay distinct.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import is_fractional, is_numeric
from ..session import written_table
from ..sources.tables import fill_cores

VALUE = ["num", "text"]
EXACT_BELOW = float(2**53)


def _entry(number: int, name: str, dtype: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    num, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if not is_numeric(dtype):
        text = c.cast("string")
    else:
        num = c.cast("double")
        if is_fractional(dtype):
            num = F.when(~F.isnan(num), num)
        if isinstance(dtype, T.DecimalType):
            text = c.cast("string")
        elif isinstance(dtype, T.LongType):
            text = F.when(F.abs(num) >= EXACT_BELOW, c.cast("string"))
    return F.struct(F.lit(number).alias("col"), num.alias("num"), text.alias("text"))


class OrderStatistics:
    """Counted values of the given columns; nulls and NaN are left out.

    Without `in_order` only the known and distinct values are counted, and nothing is written.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], in_order: bool = True):
        self.columns = list(dict.fromkeys(columns))
        self.types = {n: df.schema[n].dataType for n in self.columns}
        self.known: dict[str, int] = {n: 0 for n in self.columns}
        self.distinct: dict[str, int] = {n: 0 for n in self.columns}
        self.table: DataFrame | None = None
        self._parts: dict[str, list[tuple[int, int]]] = defaultdict(list)
        if not self.columns:
            return
        source = fill_cores(df.select(*[F.col(f"`{n}`") for n in self.columns]))
        melted = F.explode(F.array(*[_entry(i, n, self.types[n]) for i, n in enumerate(self.columns)])).alias("p")
        values = source.select(melted).select("p.*").filter("num IS NOT NULL OR text IS NOT NULL")
        # Columns of numbers that doubles hold need no text in the key.
        key = ["num"] if all(is_numeric(t) and not isinstance(t, (T.LongType, T.DecimalType)) for t in self.types.values()) else VALUE
        counts = values.groupBy("col", *key).agg(F.count(F.lit(1)).alias("n"))
        if not in_order:
            sizes = counts.groupBy("col", F.lit(0).alias("part"))
        else:
            counts = counts.select("col", "num", ("text" if "text" in key else F.lit(None).cast("string").alias("text")), "n")
            ranged = counts.repartitionByRange("col", *VALUE).sortWithinPartitions("col", *VALUE)
            self.table = written_table(ranged.withColumn("part", F.spark_partition_id()), "values")
            sizes = self.table.groupBy("col", "part")
        for r in sorted(sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()):
            name = self.columns[r["col"]]
            self.known[name] += r["n"]
            self.distinct[name] += r["d"]
            self._parts[name].append((r["part"], r["n"]))

    def ranks(self, wanted: dict[str, Sequence[int]]) -> dict[tuple[str, int], float]:
        """The numbers at the given ranks (from 0) of each column, all in one job."""
        inside: dict[tuple[int, int], list[int]] = defaultdict(list)
        starts = {}
        for name, ranks in wanted.items():
            col, start = self.columns.index(name), 0
            for part, n in self._parts[name]:
                starts[col, part] = start
                inside[part, col] += [r - start for r in set(ranks) if start <= r < start + n]
                start += n
        rows = [(p, c, sorted(rs)) for (p, c), rs in inside.items() if rs]
        if not rows:
            return {}
        # At most one row per wanted rank.
        asked = F.broadcast(self.table.sparkSession.createDataFrame(rows, "part int, col int, ranks array<long>"))
        upto = F.sum("n").over(Window.partitionBy("part", "col").orderBy(*VALUE).rowsBetween(Window.unboundedPreceding, 0))
        found = self.table.join(asked, ["part", "col"]).withColumn("_upto", upto).withColumn(
            "rank", F.explode(F.filter("ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("n")))))
        return {(self.columns[r["col"]], starts[r["col"], r["part"]] + r["rank"]): r["num"] for r in found.select("col", "part", "rank", "num").collect()}

    def quantiles(self, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
        """Linearly interpolated quantiles per numeric column; None for columns without numbers."""
        last = {n: self.known[n] - 1 for n in wanted}
        found = self.ranks({n: [r for q in qs for r in (math.floor(last[n] * q), math.ceil(last[n] * q))]
                            for n, qs in wanted.items() if last[n] >= 0})
        out: dict[str, list[float | None]] = {}
        for n, qs in wanted.items():
            out[n] = []
            for q in qs:
                at = last[n] * q
                if last[n] < 0:
                    out[n].append(None)
                    continue
                low, high = found[n, math.floor(at)], found[n, math.ceil(at)]
                out[n].append(low + (high - low) * (at - math.floor(at)))
        return out

    def top(self, k: int, columns: Sequence[str] | None = None) -> dict[str, list[tuple[int, str]]]:
        """The `k` most frequent values per column as (count, value as text), the smaller value first on a tie."""
        names = [n for n in (columns if columns is not None else self.columns) if self.known[n]]
        if not names:
            return {}
        order = [F.col("n").desc(), F.col("num").asc(), F.col("text").asc()]
        rows = self.table.filter(F.col("col").isin([self.columns.index(n) for n in names]))
        rank = F.row_number().over(Window.partitionBy("part", "col").orderBy(*order))
        best = rows.withColumn("_r", rank).filter(F.col("_r") <= k).withColumn("_r", F.row_number().over(Window.partitionBy("col").orderBy(*order)))
        out: dict[str, list[tuple[int, str]]] = {n: [] for n in names}
        for r in best.filter(F.col("_r") <= k).orderBy("col", "_r").collect():
            name = self.columns[r["col"]]
            out[name].append((r["n"], r["text"] if r["text"] is not None else _number_text(r["num"], self.types[name])))
        return out


def _number_text(x: float, dtype: T.DataType) -> str:
    return str(x) if is_fractional(dtype) else str(int(x))


def order_statistics(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """One row per numeric column: known and distinct values, the wanted quantiles, the mode and its count."""
    stats = OrderStatistics(df, columns)
    found, tops = stats.quantiles({n: quantiles for n in columns}), stats.top(1)
    rows = [(n, stats.known[n], stats.distinct[n], found[n], *((float(tops[n][0][1]), tops[n][0][0]) if tops.get(n) else (None, 0))) for n in columns]
    return df.sparkSession.createDataFrame(rows, "name string, known long, distinct long, quantiles array<double>, mode double, mode_count long")
