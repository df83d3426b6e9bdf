"""Order-dependent work on tables too large, or too skewed, for one window task.

A window without a partition key, or with a key that holds a large share of all
rows, runs in a single task. Here such rows are first cut into ranges of
`(keys, order)` of at most about `max_task_rows` rows, whatever the key distribution
is. Each range is processed by an ordinary window; what has to cross a range border
is one small row per range.

`arrange` does the preparation once for a chain of steps: one count of the groups and,
only if a group is too large for a task, the numbered rows and the border table, both
written below the shared folder, so that every pass and every re-run of a lost task
sees the same ranges. Rows that agree on `(keys, order)` follow a hash of the row, then
their number in the written table; a date that holds most rows, or a row that is
repeated very often, is therefore cut into ranges like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table

CHUNK = "_chunk"
POSITION = "_position"
TIE, ROW = "_tie", "_row"
SAMPLES_PER_CHUNK = 24
# Largest group that one window task may take whole, and the aim for the rows of a range.
MAX_TASK_ROWS = 1_000_000
# Borders that are handed to every task in one array; more are joined on in groups of this size.
MAX_ARRAY = 10_000
# Carried rows up to this number are broadcast.
MAX_BROADCAST_ROWS = 10_000


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def sort_keys(names: Sequence[str]) -> list[Column]:
    """Ascending, nulls last."""
    return [_col(n).asc_nulls_last() for n in names]


def _sortable(names: Sequence[str]) -> Column:
    """One comparable value per row that sorts like `sort_keys`."""
    fields = []
    for i, n in enumerate(names):
        fields += [_col(n).isNull().alias(f"n{i}"), _col(n).alias(f"v{i}")]
    return F.struct(*fields)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the table and of its biggest group (the table itself when there is no key)."""
    if not keys:
        rows = df.count()
        return rows, rows
    sizes = df.groupBy(*[_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    return found["rows"] or 0, found["largest"] or 0


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(F.lit(0), *[_col(f.name) for f in df.schema.fields if _hashable(f.dataType)])


def border_table(df: DataFrame, names: Sequence[str], chunks: int, rows: int | None = None) -> tuple[DataFrame, int]:
    """Written table `(number, border)`, the first row of each range but the first, by sample; and its rows.

    The sample has some `SAMPLES_PER_CHUNK` rows per range; it is sorted by Spark and the
    borders are picked by position, so it never meets in the driver.
    """
    slim = df.select(*[_col(n) for n in names])
    rows = slim.count() if rows is None else rows
    share = min(1.0, chunks * SAMPLES_PER_CHUNK / max(rows, 1))
    sample = slim if share == 1.0 else slim.sample(fraction=share, seed=17)
    ordered = written_table(sample.orderBy(*sort_keys(names)).withColumn("_id", F.monotonically_increasing_id()), "sample")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    sizes = {r["part"]: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    position = F.get(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), part.cast("int")) + place
    number = F.floor(position * chunks / max(total, 1)).cast("long")
    before = F.floor((position - 1) * chunks / max(total, 1)).cast("long")
    picked = ordered.filter((position > 0) & (number > before))
    borders = written_table(picked.select(number.alias("number"), _sortable(names).alias("border")), "borders")
    return borders, max(0, min(chunks, total) - 1)


def _with_place(df: DataFrame, borders: str, size: Column, most: int, name: str) -> DataFrame:
    """Add how many of the row's sorted `borders` (`size` of them, `most` at most) are smaller than `_value`.

    Binary search by halving steps, a projection each, so that it stays in generated code. A place
    names the one before it three times, so whatever the optimizer follows down through the steps
    triples in each. A term that is always 0 but counts as not deterministic keeps filters on the
    place from being pushed through, and `explode` ends the search for the source of a join key.
    """
    df = df.withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        ahead = F.col(name) + step
        below = (ahead <= size) & (F.get(F.col(borders), ahead - 1) < F.col("_value"))
        df = df.withColumn(name, F.col(name) + F.when(below, step).otherwise(0))
    fixed = (F.col(name) + F.least(F.monotonically_increasing_id(), F.lit(0))).cast("long")
    return df.withColumn(name, fixed).withColumn(name, F.explode(F.array(name)))


def _in_order(table: DataFrame, number: str) -> DataFrame:
    """One row `b`: the borders in the order of `number`."""
    listed = F.array_sort(F.collect_list(F.struct(_col(number), _col("border"))))
    return table.agg(F.transform(listed, lambda x: x["border"]).alias("b"))


def range_chunks(df: DataFrame, names: Sequence[str], chunks: int, max_array: int = MAX_ARRAY, rows: int | None = None) -> DataFrame:
    """Add `_chunk`, a number that grows with the row's range in the order of `names`.

    Up to `max_array` borders are searched as one array. Beyond that only the heads of
    groups of `max_array` borders are, and the rows meet the other borders of their group
    by a join on the group.
    """
    borders, n = border_table(df, names, chunks, rows) if chunks > 1 else (None, 0)
    if n == 0:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    valued = df.withColumn("_value", _sortable(names))
    if n <= max_array:
        held = valued.withColumn("_borders", _in_order(borders, "number").scalar())
        held = _with_place(held, "_borders", F.lit(n), n, CHUNK)
        return held.drop("_borders", "_value")
    grouped = borders.withColumn("_g", F.floor(F.col("number") / max_array).cast("long"))
    heads = grouped.groupBy("_g").agg(F.min("border").alias("border"))
    count = heads.count()
    numbered = heads.withColumn("_head", F.row_number().over(Window.orderBy("_g"))).select("_g", "_head")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "border"))), lambda x: x["border"])
    fine = grouped.groupBy("_g").agg(listed.alias("_fine")).join(numbered, "_g").select("_head", "_fine")
    held = _with_place(valued.withColumn("_borders", _in_order(heads, "_g").scalar()), "_borders", F.lit(count), count, "_head")
    held = _with_place(held.drop("_borders").join(fine, "_head", "left"), "_fine", F.size("_fine"), max_array, "_inside")
    chunk = F.when(F.col("_head") == 0, 0).otherwise((F.col("_head") - 1) * (max_array + 1) + F.col("_inside"))
    return held.withColumn(CHUNK, chunk.cast("long")).drop("_head", "_fine", "_inside", "_value")


@dataclass(frozen=True)
class Arranged:
    """Rows with what a chain of order-dependent steps shares: total order, and ranges where a group is too large."""

    df: DataFrame
    order: tuple[str, ...]
    keys: tuple[str, ...]
    ranges: int
    max_task_rows: int

    def over(self, df: DataFrame) -> Arranged:
        """The same order and ranges for a table derived row by row from this one."""
        return replace(self, df=df)

    def plain(self) -> DataFrame:
        return self.df.drop(CHUNK, TIE, ROW)

    @property
    def whole(self) -> bool:
        """Whether every group fits one task."""
        return self.ranges == 0


def arrange(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), max_task_rows: int = MAX_TASK_ROWS) -> Arranged:
    """Count the groups once; cut the rows into ceil(rows / max_task_rows) ranges if one of them is too large."""
    rows, largest = group_sizes(df, keys)
    tied = df.withColumn(TIE, _row_hash(df))
    if largest <= max_task_rows:
        return Arranged(tied, (*order, TIE), tuple(keys), 0, max_task_rows)
    numbered = written_table(tied.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    total = (*order, TIE, ROW)
    ranges = -(-rows // max_task_rows)
    return Arranged(range_chunks(numbered, [*keys, *total], ranges, rows=rows), total, tuple(keys), ranges, max_task_rows)


def _attach(chunked: DataFrame, carried: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """Left join of the carried rows.

    Ranges are contiguous in `(keys, order)`, so at most one key per range continues
    from an earlier range: `carried` has no more rows than there are ranges. It is
    broadcast up to `MAX_BROADCAST_ROWS` ranges, and joined by range beyond.
    """
    renamed = carried.select(
        _col(CHUNK).alias("_c"),
        *[_col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[_col(c) for c in carried.columns if c != CHUNK and c not in keys],
    )
    on = F.col(CHUNK) == F.col("_c")
    for i, k in enumerate(keys):
        on = on & _col(k).eqNullSafe(F.col(f"_k{i}"))
    renamed = F.broadcast(renamed) if ranges <= MAX_BROADCAST_ROWS else renamed
    return chunked.join(renamed, on, "left").drop("_c", *[f"_k{i}" for i in range(len(keys))])


def _earlier_sums(rows: Arranged, sums: dict[str, Column]) -> DataFrame:
    work = rows.df.withColumns({f"_in_{n}": e for n, e in sums.items()})
    by_key = [_col(k) for k in rows.keys]
    inner = [f"_in_{n}" for n in sums]
    if rows.whole:
        w = Window.partitionBy(*by_key).orderBy(*sort_keys(rows.order)).rowsBetween(Window.unboundedPreceding, -1)
        work = work.withColumns({n: F.coalesce(F.sum(f"_in_{n}").over(w), F.col(f"_in_{n}") * 0) for n in sums})
        return work.drop(*inner)

    totals = work.groupBy(CHUNK, *by_key).agg(*[F.sum(c).alias(f"_t{c}") for c in inner])
    earlier = Window.partitionBy(*by_key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(CHUNK, *by_key, *[F.sum(f"_t{c}").over(earlier).alias(f"_b{c}") for c in inner])
    carried = carried.filter(F.col(f"_b{inner[0]}").isNotNull())
    joined = _attach(work, carried, rows.keys, rows.ranges)
    w = Window.partitionBy(CHUNK, *by_key).orderBy(*sort_keys(rows.order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumns({
        n: F.coalesce(F.sum(f"_in_{n}").over(w), F.col(f"_in_{n}") * 0)
        + F.coalesce(F.col(f"_b_in_{n}"), F.col(f"_in_{n}") * 0)
        for n in sums
    })
    return joined.drop(*inner, *[f"_b{c}" for c in inner])


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """For each new name the sum of its expression over all earlier rows of the key (0 at first)."""
    rows = arrange(df, order, keys, max_task_rows)
    return rows.over(_earlier_sums(rows, sums)).plain()


def row_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    max_task_rows: int = MAX_TASK_ROWS,
    name: str = POSITION,
) -> DataFrame:
    """Add the exact 0-based position of each row within its key."""
    return running_sums(df, {name: F.lit(1).cast("long")}, order, keys, max_task_rows)


def fill_arranged(rows: Arranged, columns: Sequence[str], direction: str = "forward") -> DataFrame:
    """As `fill_ordered`, on rows that are already arranged; the helper columns stay."""
    if not columns:
        return rows.df
    forward = direction == "forward"
    nearest = F.last if forward else F.first
    span = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    by_key = [_col(k) for k in rows.keys]
    if rows.whole:
        w = Window.partitionBy(*by_key).orderBy(*sort_keys(rows.order)).rowsBetween(*span)
        return rows.df.withColumns({c: nearest(_col(c), ignorenulls=True).over(w) for c in columns})

    edge = F.max_by if forward else F.min_by
    at = _sortable(rows.order)
    known = rows.df.groupBy(CHUNK, *by_key).agg(
        *[edge(_col(c), F.when(_col(c).isNotNull(), at)).alias(f"_e{i}") for i, c in enumerate(columns)]
    )
    beyond = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    over = Window.partitionBy(*by_key).orderBy(CHUNK).rowsBetween(*beyond)
    carried = known.select(
        CHUNK, *by_key, *[nearest(f"_e{i}", ignorenulls=True).over(over).alias(f"_f{i}") for i in range(len(columns))]
    ).filter(_any_known(len(columns)))
    joined = _attach(rows.df, carried, rows.keys, rows.ranges)
    w = Window.partitionBy(CHUNK, *by_key).orderBy(*sort_keys(rows.order)).rowsBetween(*span)
    joined = joined.withColumns({
        c: F.coalesce(nearest(_col(c), ignorenulls=True).over(w), F.col(f"_f{i}")) for i, c in enumerate(columns)
    })
    return joined.drop(*[f"_f{i}" for i in range(len(columns))])


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = (),
    direction: str = "forward",
    max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """Replace nulls by the nearest earlier (`forward`) or later (`backward`) known value."""
    if not columns:
        return df
    rows = arrange(df, order, keys, max_task_rows)
    return rows.over(fill_arranged(rows, columns, direction)).plain()


def _any_known(n: int) -> Column:
    out = F.lit(False)
    for i in range(n):
        out = out | F.col(f"_f{i}").isNotNull()
    return out


def window_arranged(rows: Arranged, build: Callable[[Window], dict[str, Column]], reach: int) -> DataFrame:
    """As `bounded_window`, on rows that are already arranged; the helper columns stay."""
    by_key = [_col(k) for k in rows.keys]
    if rows.whole:
        return rows.df.withColumns(build(Window.partitionBy(*by_key).orderBy(*sort_keys(rows.order))))

    block_rows = max(rows.max_task_rows, reach)
    placed = _earlier_sums(rows, {POSITION: F.lit(1).cast("long")})
    home = F.floor(F.col(POSITION) / block_rows)
    near_end = F.col(POSITION) % block_rows >= block_rows - reach
    blocks = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*by_key, F.col("_block")).orderBy(POSITION)
    done = spread.withColumns(build(w)).filter(F.col("_block") == F.col("_home"))
    return done.drop("_home", "_block", POSITION)


def bounded_window(
    df: DataFrame,
    build: Callable[[Window], dict[str, Column]],
    reach: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
    max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """Add window columns that look back at most `reach` rows within the key.

    `build` gets the ordered window and returns the new columns. A key larger than
    `max_task_rows` is cut into blocks of that many rows by exact position; the last
    `reach` rows of a block are also given to the next one, as context only.
    """
    rows = arrange(df, order, keys, max_task_rows)
    return rows.over(window_arranged(rows, build, reach)).plain()
