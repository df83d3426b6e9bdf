"""Categorical encoders.

Fitting counts the levels of all columns together. Columns with up to a few
thousand levels keep their levels as plain values; a column beyond that keeps its
map as a written table, numbered or averaged in a distributed way, and is encoded
by a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import ENCODER_TARGET_NAMES, last_numeric, names_of, requested
from ..session import shared_folder
from .ordered import row_position
from .quantiles import exact_quantiles

METHODS = ("one_hot", "label", "ordinal", "frequency", "target", "binary", "woe")
ONE_HOT_LEVELS = 50          # fixed value: above this a column gets label codes
LITERAL_LEVELS = 64          # up to here a map is part of the expression
DRIVER_LEVELS = 5_000        # up to here levels are kept as plain values
BROADCAST_LEVELS = 200_000   # up to here a written map is broadcast
NULL_LEVEL = "nan"           # fixed value: the text a missing label counts as


def _text(name: str, null_as_level: bool) -> Column:
    c = F.col(f"`{name}`").cast("string")
    return F.coalesce(c, F.lit(NULL_LEVEL)) if null_as_level else c


def target_values(df: DataFrame, target: str) -> Column:
    """The target as a number; what is not a number counts as 0."""
    c = F.col(f"`{target}`").try_cast("double")
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def _level_stats(df: DataFrame, columns: Sequence[str], y: Column | None, null_as_level: bool) -> DataFrame:
    """Long table `(column, value, n, total)`: rows and summed `y` per level, partial sums before the shuffle."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _text(c, null_as_level).alias("value")) for c in columns
    ]))
    long = df.select((y if y is not None else F.lit(0.0)).alias("y"), pairs.alias("p"))
    return (
        long.select("p.column", "p.value", "y").filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    )


def _split_by_size(df: DataFrame, columns: Sequence[str], limit: int) -> tuple[list[str], list[str]]:
    sizes = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    small = [c for i, c in enumerate(columns) if sizes[f"d{i}"] <= limit]
    return small, [c for c in columns if c not in small]


def _written(df: DataFrame, purpose: str) -> dict:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return {"table": path, "rows": df.sparkSession.read.parquet(path).count()}


def _code_table(df: DataFrame, column: str, null_as_level: bool) -> dict:
    levels = df.select(_text(column, null_as_level).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return _written(row_position(levels, ["value"], name="mapped"), "codes")


def _codes(df: DataFrame, columns: Sequence[str], null_as_level: bool, driver_levels: int) -> dict[str, dict]:
    if not columns:
        return {}
    small, large = _split_by_size(df, columns, driver_levels)
    out: dict[str, dict] = {c: {"levels": []} for c in small}
    if small:
        for r in _level_stats(df, small, None, null_as_level).collect():
            out[r["column"]]["levels"].append(r["value"])
    for c in small:
        out[c]["levels"].sort()
        out[c]["rows"] = len(out[c]["levels"])
    for c in large:
        out[c] = _code_table(df, c, null_as_level)
    return out


def _maps(df: DataFrame, columns: Sequence[str], y: Column | None, mapped, driver_levels: int,
          rows: dict[str, int] | None = None) -> dict[str, dict]:
    """`{column: {"map": {level: number}}}`; `mapped(n, total)` gives the number from the level's row.

    With `rows` the number is divided by the column's rows. All small columns share one count of levels.
    """
    small, large = _split_by_size(df, columns, driver_levels)
    out: dict[str, dict] = {c: {"map": {}} for c in small}
    number = mapped(F.col("n"), F.col("total")).cast("double")
    if rows:
        number = number / F.create_map(*[F.lit(x) for c in columns for x in (c, float(rows[c]))])[F.col("column")]
    number = number.alias("mapped")
    if small:
        for r in _level_stats(df, small, y, False).select("column", "value", number).collect():
            out[r["column"]]["map"][r["value"]] = r["mapped"]
    for c in large:
        out[c] = _written(_level_stats(df, [c], y, False).select("value", number), "levels")
    return out


def _choose(df: DataFrame, columns, target_column: str | None) -> tuple[list[str], list[str]]:
    """Columns to encode, and string targets that only get label codes in place."""
    chosen = requested(df, columns)
    if chosen:
        return chosen, []
    auto = names_of(df, "non_numeric")
    protected = [c for c in auto if c == target_column or c.lower() in ENCODER_TARGET_NAMES]
    return [c for c in auto if c not in protected], protected


def fit_encoder(
    df: DataFrame,
    method: str = "one_hot",
    columns=None,
    drop_first: bool = False,
    target_column: str | None = None,
    null_as_level: bool = True,
    driver_levels: int = DRIVER_LEVELS,
) -> dict:
    """The learned encoding as a JSON-ready dict (large maps as paths of written tables)."""
    if method not in METHODS:
        raise ValueError(f"unknown encoding method: {method}")
    chosen, protected = _choose(df, columns, target_column)
    steps: dict[str, dict] = {c: {"kind": "codes", **m}
                              for c, m in _codes(df, protected, null_as_level, driver_levels).items()}
    # Without a configured target, the last numeric column that is not encoded stands in.
    target = last_numeric(df, target_column, exclude=chosen)
    if not chosen:
        return {"method": method, "steps": steps}
    if method in ("target", "woe") and target is None:
        method = "frequency"

    if method == "one_hot":
        small, _ = _split_by_size(df, chosen, 10 * ONE_HOT_LEVELS)
        levels: dict[str, list[str]] = {c: [] for c in small}
        if small:
            for r in _level_stats(df, small, None, False).collect():
                levels[r["column"]].append(r["value"])
        hot = [c for c in chosen if c in levels and len(levels[c]) <= ONE_HOT_LEVELS]
        for c in hot:
            steps[c] = {"kind": "one_hot", "levels": sorted(levels[c])[1 if drop_first else 0:]}
        rest = [c for c in chosen if c not in hot]
        steps.update({c: {"kind": "codes", **m} for c, m in _codes(df, rest, null_as_level, driver_levels).items()})
    elif method in ("label", "ordinal", "binary"):
        kind = "bits" if method == "binary" else "codes"
        for c, m in _codes(df, chosen, null_as_level, driver_levels).items():
            steps[c] = {"kind": kind, **m}
    elif method == "frequency":
        known = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(chosen)]).first()
        rows = {c: known[f"n{i}"] for i, c in enumerate(chosen)}
        for c, m in _maps(df, chosen, None, lambda n, _: n, driver_levels, rows).items():
            steps[c] = {"kind": "values", "default": 0.0, **m}
    elif method == "target":
        y = target_values(df, target)
        mean = df.agg(F.avg(y)).first()[0]
        for c, m in _maps(df, chosen, y, lambda n, total: total / n, driver_levels).items():
            steps[c] = {"kind": "values", "default": 0.0 if mean is None else mean, **m}
    else:
        steps.update(_fit_woe(df, chosen, target, driver_levels))
    return {"method": method, "steps": steps}


def _fit_woe(df: DataFrame, chosen: list[str], target: str, driver_levels: int) -> dict[str, dict]:
    numbered = df.withColumn("_y", target_values(df, target))
    middle = exact_quantiles(numbered, {"_y": [0.5]})["_y"][0]
    positive = (F.col("_y") > F.lit(middle if middle is not None else 0.0)).cast("double")
    sums = numbered.agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("n")).first()
    all_pos, all_neg = (sums["p"] or 1.0), (sums["n"] or 1.0)

    def evidence(n: Column, pos: Column) -> Column:
        return F.ln(((pos + 0.5) / F.lit(all_pos)) / ((n - pos + 0.5) / F.lit(all_neg)))

    return {
        c: {"kind": "values", "default": 0.0, **m}
        for c, m in _maps(numbered, chosen, positive, evidence, driver_levels).items()
    }


def _lookup(df: DataFrame, column: str, step: dict, key: Column, default: Column, dtype: str, out: str) -> DataFrame:
    """`out` = the number mapped to `key`, else `default`."""
    spark = df.sparkSession
    if "table" in step:
        table = spark.read.parquet(step["table"])
        if step["rows"] <= BROADCAST_LEVELS:
            table = F.broadcast(table)
    else:
        numbers = step["map"] if "map" in step else {v: i for i, v in enumerate(step["levels"])}
        if not numbers:
            return df.withColumn(out, default.cast(dtype))
        if len(numbers) <= LITERAL_LEVELS:
            literal = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
            return df.withColumn(out, F.coalesce(literal[key].cast(dtype), default.cast(dtype)))
        kind = T.DoubleType() if "map" in step else T.LongType()
        schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("mapped", kind)])
        # At most DRIVER_LEVELS rows.
        table = F.broadcast(spark.createDataFrame(list(numbers.items()), schema))
    joined = df.withColumn("_key", key).join(
        table.select(F.col("value").alias("_value"), F.col("mapped").alias("_mapped")),
        F.col("_key") == F.col("_value"), "left",
    )
    return joined.withColumn(out, F.coalesce(F.col("_mapped").cast(dtype), default.cast(dtype))).drop(
        "_key", "_value", "_mapped"
    )


def apply_encoder(df: DataFrame, fitted: dict, null_as_level: bool = True) -> DataFrame:
    """Codes and numbers replace the column in place; one-hot and bit columns are added at the end."""
    out, order, added = df, list(df.columns), []
    for c, step in fitted["steps"].items():
        if c not in df.columns:
            continue
        kind = step["kind"]
        if kind == "one_hot":
            flags = {f"{c}_{v}": F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0))
                     for v in step["levels"]}
            out = out.withColumns(flags)
            order.remove(c)
            added += list(flags)
        elif kind == "values":
            out = _lookup(out, c, step, F.col(f"`{c}`").cast("string"), F.lit(step["default"]), "double", c)
        else:
            dtype = "int" if step["rows"] < 2**31 else "long"
            code = c if kind == "codes" else f"_code_{c}"
            out = _lookup(out, c, step, _text(c, null_as_level), F.lit(-1), dtype, code)
            if kind == "bits":
                bits = {f"{c}_bin_{b}": F.shiftright(F.col(f"`{code}`"), b).bitwiseAND(F.lit(1)).cast("int")
                        for b in range(math.ceil(math.log2(max(step["rows"], 2))))}
                out = out.withColumns(bits).drop(code)
                order.remove(c)
                added += list(bits)
    return out.select(*[F.col(f"`{n}`") for n in order + added])


def encode(df: DataFrame, method: str = "one_hot", columns=None, drop_first: bool = False,
           target_column: str | None = None, null_as_level: bool = True) -> DataFrame:
    fitted = fit_encoder(df, method, columns, drop_first, target_column, null_as_level)
    return apply_encoder(df, fitted, null_as_level)

