"""Exact, repeatable train/test split by the order of a hash of the row key.

The border hash is found by counting hash prefixes: each pass counts at most 4096
prefixes per class and narrows down to one of them, so the table is never sorted
or shuffled. The split itself is then a comparison per row. Classes, their sizes and
borders are tables, so their number is not bounded by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import is_fractional, is_numeric
from ..session import written_table
from .encode import BROADCAST_LEVELS, LITERAL_LEVELS, apply_encoder, fit_encoder
from .ordered import MAX_TASK_ROWS, row_position, running_sums

SPLIT = "_split"
HASH_DIGITS = 32
DIGITS_PER_PASS = 3


def split_hash(keys: Sequence[str], seed: int) -> Column:
    """Hex digest of the key values and the seed; a null has a mark of its own, so it keeps its place among the keys."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys], F.lit(str(seed))))


def test_sizes(counts: dict[str, int], test_size: float) -> dict[str, int]:
    """Test rows per class: proportional, whole, adding up to ceil(n * test_size).

    Left-over rows go to the largest fractions, the smaller class name first.
    """
    total = sum(counts.values())
    wanted = math.ceil(total * test_size)
    share = {s: n * wanted / total for s, n in counts.items()}
    sizes = {s: math.floor(x) for s, x in share.items()}
    order = sorted(counts, key=lambda s: (-(share[s] - sizes[s]), s))
    for s in order[: wanted - sum(sizes.values())]:
        sizes[s] += 1
    return sizes


def _few_borders(hashed: DataFrame, wanted: dict[str, int]) -> list[tuple[str, str, int, int]]:
    """As `_borders`, for up to `LITERAL_LEVELS` classes: at most 4096 counts of each reach the driver."""
    found = []
    open_ = {s: ("", k) for s, k in wanted.items() if k > 0}
    digits = 0
    while open_:
        digits = min(HASH_DIGITS, digits + DIGITS_PER_PASS)
        within = F.lit(False)
        for s, (prefix, _) in open_.items():
            within = within | ((F.col("_s") == s) & F.col("_h").startswith(prefix))
        counts = (
            hashed.filter(within).groupBy("_s", F.substring("_h", 1, digits).alias("p"))
            .agg(F.count(F.lit(1)).alias("n")).collect()
        )
        by_class: dict[str, list] = {}
        for r in counts:
            by_class.setdefault(r["_s"], []).append((r["p"], r["n"]))
        for s, (_, k) in list(open_.items()):
            for prefix, n in sorted(by_class[s]):
                if n < k:
                    k -= n
                    continue
                if n == k:  # "g" sorts behind every hash with this prefix
                    found.append((s, prefix + "g", 0, 0))
                elif digits == HASH_DIGITS:
                    found.append((s, prefix, k, n))
                if n == k or digits == HASH_DIGITS:
                    del open_[s]
                else:
                    open_[s] = (prefix, k)
                break
    return found


def _test_size_table(counts: DataFrame, test_size: float) -> DataFrame:
    """(`_s`, n, k) as `test_sizes`, for any number of classes."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    wanted = math.ceil(total * test_size)
    share = F.col("n") * F.lit(wanted) / F.lit(float(total))
    parts_ = counts.withColumn("_base", F.floor(share).cast("long")).withColumn("_rest", -(share - F.floor(share)))
    ranked = row_position(parts_, ["_rest", "_s"], name="_rank")
    left = wanted - (counts.agg(F.sum(F.floor(share)).alias("b")).first()["b"] or 0)
    return ranked.select("_s", "n", (F.col("_base") + (F.col("_rank") < left).cast("long")).alias("k"))


def _borders(hashed: DataFrame, sizes: DataFrame, max_task_rows: int) -> DataFrame:
    """Written table (`_s`, border, take, equal): a class's test rows are those whose hash is below the border, and
    `take` of the `equal` rows whose hash is the border.

    Hash prefixes are counted per class, and the prefix in which the wanted number is
    reached is followed, until few enough rows are left to count their whole hashes.
    """
    open_ = written_table(sizes.filter("k > 0").select("_s", F.lit("").alias("_p"), "k"), "prefixes")
    digits = 0
    while True:
        inside = hashed.join(open_.select(F.col("_s").alias("_c"), "_p", "k"), (F.col("_s") == F.col("_c")) & F.col("_h").startswith(F.col("_p")))
        last = digits == HASH_DIGITS or (digits and open_.agg(F.sum("inside").alias("n")).first()["n"] <= max_task_rows)
        digits = HASH_DIGITS if last else min(HASH_DIGITS, digits + DIGITS_PER_PASS)
        counts = inside.groupBy("_s", F.substring("_h", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("inside"), F.first("k").alias("k"))
        before = running_sums(counts, {"_before": F.col("inside")}, ["_p"], ["_s"], max_task_rows)
        reached = before.filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("inside")))
        open_ = written_table(reached.select("_s", "_p", (F.col("k") - F.col("_before")).alias("k"), "inside"), "prefixes")
        if last:
            return open_.select("_s", F.col("_p").alias("border"), F.col("k").alias("take"), F.col("inside").alias("equal"))


def _with_border(marked: DataFrame, borders: list | DataFrame) -> DataFrame:
    """The border of the row's class, from a literal map or, with many classes, by a join."""
    fields = ["border", "take", "equal"]
    if isinstance(borders, list):
        pairs = [x for s, *rest in borders for x in (F.lit(s), F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, rest)]))]
        none = F.lit(None).cast("map<string,struct<border:string,take:int,equal:int>>")
        found = (F.create_map(*pairs) if pairs else none)[F.col("_s")]
        return marked.withColumns({f"_{f}": found[f] for f in fields})
    table = borders.select(F.col("_s").alias("_c"), *[F.col(f).alias(f"_{f}") for f in fields])
    table = F.broadcast(table) if borders.count() <= BROADCAST_LEVELS else table
    return marked.join(table, F.col("_s") == F.col("_c"), "left").drop("_c")


def train_test_split(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.2,
    random_state: int = 42,
    stratify_by: str | None = None,
    max_task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """Add `_split` (`train` or `test`), exact in size. `keys` identify a row.

    Rows that share their keys at the border are dealt by a hash of the whole row, so a
    row that is repeated very often falls on both sides in proportion. Stratified only if
    there are at least two classes and the smallest has at least two rows.
    """
    stratum = F.coalesce(F.col(f"`{stratify_by}`").cast("string"), F.lit("nan")) if stratify_by else F.lit("")
    hashed = df.select(stratum.alias("_s"), split_hash(keys, random_state).alias("_h"))
    counts = hashed.groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    first = counts.limit(LITERAL_LEVELS + 1).collect()
    if not first:
        return df.withColumn(SPLIT, F.lit("train"))
    few = len(first) <= LITERAL_LEVELS
    if few:
        sizes = {r["_s"]: r["n"] for r in first}
        least, rows = min(sizes.values()), sum(sizes.values())
    else:
        counts = written_table(counts, "classes")
        least, rows = counts.agg(F.min("n"), F.sum("n")).first()
    if len(first) > 1 and least < 2:
        stratum, few, sizes = F.lit(""), True, {"": rows}
        hashed = hashed.withColumn("_s", stratum)
    if few:
        borders = _few_borders(hashed, test_sizes(sizes, test_size))
        partial = any(take < equal for _, _, take, equal in borders)
    else:
        borders = _borders(hashed, _test_size_table(counts, test_size), max_task_rows)
        partial = not borders.filter("take < equal").isEmpty()
    marked = _with_border(df.withColumn("_s", stratum).withColumn("_h", split_hash(keys, random_state)), borders)
    whole = F.coalesce((F.col("_h") < F.col("_border")) | ((F.col("_h") == F.col("_border")) & (F.col("_take") == F.col("_equal"))), F.lit(False))
    split_up = F.coalesce((F.col("_h") == F.col("_border")) & (F.col("_take") < F.col("_equal")), F.lit(False))
    out = marked.withColumn(SPLIT, F.when(whole, "test").otherwise("train"))
    if partial:
        dealt = row_position(marked.filter(split_up), [], ["_s"], max_task_rows, name="_place")
        dealt = dealt.withColumn(SPLIT, F.when(F.col("_place") < F.col("_take"), "test").otherwise("train")).drop("_place")
        out = out.filter(~split_up).unionByName(dealt)
    return out.drop("_s", "_h", "_border", "_take", "_equal")


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) as lazily filtered tables."""
    return df.filter(F.col(SPLIT) == "train").drop(SPLIT), df.filter(F.col(SPLIT) == "test").drop(SPLIT)


def fit_target(df: DataFrame, target_column: str | None = None) -> dict:
    """How the target becomes a number: label codes for text, whole numbers for a float
    column with at most ten distinct, whole values."""
    target = target_column if target_column in df.columns else df.columns[-1]
    dtype = df.schema[target].dataType
    if not is_numeric(dtype):
        fitted = fit_encoder(df, "label", [target])
        # The names of very many classes stay in the encoder's table.
        return {"target": target, "encoder": fitted, "classes": fitted["steps"][target].get("levels"), "to_int": False}
    to_int = False
    if is_fractional(dtype):
        c = F.col(f"`{target}`")
        seen = df.agg(
            F.approx_count_distinct(c).alias("d"), F.coalesce(F.bool_and(c == F.floor(c)), F.lit(False)).alias("whole")
        ).first()
        to_int = bool(seen["whole"]) and seen["d"] <= 20 and df.select(c).distinct().count() <= 10
    return {"target": target, "encoder": None, "classes": None, "to_int": to_int}


def apply_target(df: DataFrame, fitted: dict) -> DataFrame:
    if fitted["encoder"]:
        return apply_encoder(df, fitted["encoder"])
    if fitted["to_int"]:
        return df.withColumn(fitted["target"], F.col(f"`{fitted['target']}`").cast("int"))
    return df


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """`(label, n, weight)` with the balanced weight rows / (classes * rows of the class)."""
    counts = df.groupBy(F.col(f"`{label}`").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    # One row: attached as two scalar values.
    row = totals.first()
    return counts.withColumn("weight", F.lit(float(row["rows"] or 0)) / (F.lit(row["classes"]) * F.col("n")))


def with_class_weight(df: DataFrame, label: str, name: str = "_weight") -> DataFrame:
    """Add the balanced weight, joined on by class; a missing class weighs 1."""
    weights = written_table(class_weights(df.dropna(subset=[label]), label), "weights").select(F.col(label).alias("_class"), F.col("weight").alias("_w"))
    weights = F.broadcast(weights) if weights.count() <= BROADCAST_LEVELS else weights
    joined = df.join(weights, F.col(f"`{label}`") == F.col("_class"), "left")
    return joined.withColumn(name, F.coalesce("_w", F.lit(1.0))).drop("_class", "_w")


def class_name(df: DataFrame, code: Column, fitted: dict, name: str) -> DataFrame:
    """Add the name of the class with the given code, from the encoder's table where there are very many."""
    step = fitted["encoder"]["steps"][fitted["target"]] if fitted.get("encoder") else {}
    if "table" not in step:
        known = fitted.get("classes")
        return df.withColumn(name, F.get(F.array(*[F.lit(c) for c in known]), code.cast("int")) if known else code.cast("int").cast("string"))
    table = df.sparkSession.read.parquet(step["table"]).select(F.col("value").alias(name), F.col("mapped").alias("_code"))
    table = F.broadcast(table) if step["rows"] <= BROADCAST_LEVELS else table
    return df.withColumn("_at", code.cast("long")).join(table, F.col("_at") == F.col("_code"), "left").drop("_at", "_code")
