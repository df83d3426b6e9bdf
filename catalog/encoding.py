"""Scaling, encoding, splitting."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.operators import encode, features, scale, split, stages, target_stats
from tabloom.session import shared_folder

from .base import EVENTS_NULLS, events_nulls, query, table


def _scaled(column, shift, factor, tbl, key):
    return f"SELECT {key}, round(({column} - ({shift})) / ({factor}), 6) AS {column} FROM {tbl}, "


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_CUST = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer)"
_CUST0 = f"(SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal FROM {_CUST})"


def _cust(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"))


@query("scale_standard", _scaled("c_acctbal", "m", "s", _CUST0, "c_custkey")
       + f"(SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM {_CUST0})")
def scale_standard(spark, sf):
    return _round(scale.scale(_cust(spark, sf), "standard", ["c_acctbal"]), "c_acctbal")


@query("scale_minmax", _scaled("c_acctbal", "m", "s - m", _CUST0, "c_custkey")
       + f"(SELECT min(c_acctbal) AS m, max(c_acctbal) AS s FROM {_CUST0})")
def scale_minmax(spark, sf):
    return _round(scale.scale(_cust(spark, sf), "minmax", "c_acctbal"), "c_acctbal")


@query("scale_robust", _scaled("c_acctbal", "q[2]", "q[3] - q[1]", _CUST0, "c_custkey")
       + f"(SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM {_CUST0})")
def scale_robust(spark, sf):
    return _round(scale.scale(_cust(spark, sf), "robust", ["c_acctbal"]), "c_acctbal")


@query("scale_autoselect", """
    WITH s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp,
        stddev_pop(p_retailprice) AS sp, avg(p_partkey) AS mk, stddev_pop(p_partkey) AS sk FROM part)
    SELECT round((p_partkey - mk) / sk, 6) AS p_partkey, p_brand, round((p_size - ms) / ss, 6) AS p_size,
        CAST(p_partkey % 2 AS INTEGER) AS parity, round((p_retailprice - mp) / sp, 6) AS p_retailprice,
        p_size AS label FROM part, s""")
def scale_autoselect(spark, sf):
    p = table(spark, sf, "part")
    p = p.select("p_partkey", "p_brand", "p_size", (F.col("p_partkey") % 2).cast("int").alias("parity"),
                 "p_retailprice", F.col("p_size").alias("label"))
    return _round(scale.scale(p), "p_partkey", "p_size", "p_retailprice")


@query("scale_replay", """
    SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders,
      (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')""")
def scale_replay(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    fitted = scale.fit_scaler(o.filter("o_orderdate < timestamp_ntz'1998-01-01'"), "standard", ["o_totalprice"])
    return _round(scale.apply_scaler(o, fitted), "o_totalprice").drop("o_orderdate")


def _hot(column, levels):
    return ", ".join(f"""CAST({column} = '{v}' AS INTEGER) AS "{column}_{v}" """ for v in levels)


@query("enc_one_hot", f"""SELECT l_orderkey, l_linenumber, {_hot('l_returnflag', 'ANR')},
    {_hot('l_linestatus', 'FO')} FROM lineitem""")
def enc_one_hot(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return encode.encode(lines, "one_hot")


@query("enc_one_hot_drop_first", f"""SELECT l_orderkey, l_linenumber, {_hot('l_returnflag', 'NR')},
    {_hot('l_linestatus', 'O')} FROM lineitem""")
def enc_one_hot_drop_first(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return encode.encode(lines, "one_hot", ["l_returnflag", "l_linestatus"], drop_first=True)


def _code(column):
    return f"CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS INTEGER)"


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("enc_high_card", f"SELECT p_partkey, {_code('p_name')} AS p_name, {_hot('p_type', _TYPES)} FROM part")
def enc_high_card(spark, sf):
    return encode.encode(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "one_hot")


@query("enc_label", f"SELECT p_partkey, {_code('p_brand')} AS p_brand, {_code('p_name')} AS p_name FROM part")
def enc_label(spark, sf):
    return encode.encode(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), "label")


@query("enc_label_written", f"SELECT c_custkey, {_code('c_name')} AS c_name FROM customer")
def enc_label_written(spark, sf):
    # Every level is treated as one too many for the driver: numbered in Spark, joined back.
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return encode.apply_encoder(c, encode.fit_encoder(c, "ordinal", ["c_name"], driver_levels=0))


@query("enc_frequency", f"""SELECT event_id, round(coalesce(f, 0.0), 6) AS event_type FROM {EVENTS_NULLS} e LEFT JOIN
    (SELECT event_type AS t, count(*) / (SELECT count(event_type) FROM {EVENTS_NULLS})::DOUBLE AS f FROM {EVENTS_NULLS}
     WHERE event_type IS NOT NULL GROUP BY 1) ON event_type = t""")
def enc_frequency(spark, sf):
    e = events_nulls(spark, sf).select("event_id", "event_type")
    return _round(encode.encode(e, "frequency", ["event_type"]), "event_type")


@query("enc_target", f"""SELECT event_id, round(coalesce(f, (SELECT avg(coalesce(value, 0)) FROM {EVENTS_NULLS})), 6)
    AS event_type, value FROM {EVENTS_NULLS} e LEFT JOIN
    (SELECT event_type AS t, avg(coalesce(value, 0)) AS f FROM {EVENTS_NULLS} WHERE event_type IS NOT NULL GROUP BY 1)
    ON event_type = t""")
def enc_target(spark, sf):
    e = events_nulls(spark, sf).select("event_id", "event_type", "value")
    return _round(encode.encode(e, "target", ["event_type"], target_column="value"), "event_type")


@query("enc_binary", f"""WITH c AS (SELECT p_partkey, {_code('p_brand')} AS k FROM part)
    SELECT p_partkey, """ + ", ".join(f"CAST((k >> {b}) & 1 AS INTEGER) AS p_brand_bin_{b}" for b in range(5)) + " FROM c")
def enc_binary(spark, sf):
    return encode.encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "binary", ["p_brand"])


@query("enc_woe", """
    WITH b AS (SELECT p_partkey, p_brand, p_retailprice,
        CAST(p_retailprice > (SELECT quantile_cont(p_retailprice, 0.5) FROM part) AS INTEGER) AS y FROM part),
      t AS (SELECT sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b),
      w AS (SELECT p_brand AS k, ln(((sum(y) + 0.5::DOUBLE) / any_value(pos)) / ((sum(1 - y) + 0.5::DOUBLE) / any_value(neg))) AS v
            FROM b, t GROUP BY p_brand)
    SELECT p_partkey, round(v, 6) AS p_brand, p_retailprice FROM b JOIN w ON p_brand = k""")
def enc_woe(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return _round(encode.encode(p, "woe", ["p_brand"], target_column="p_retailprice"), "p_brand")


@query("enc_target_protect", f"SELECT p_partkey, {_code('p_brand')} AS label, {_hot('p_type', _TYPES)} FROM part")
def enc_target_protect(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("label"), "p_type")
    return encode.encode(p, "one_hot")


@query("split_random", """
    SELECT event_id, user_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'))
        <= ceil((SELECT count(*) FROM events) * 0.2) THEN 'test' ELSE 'train' END AS _split FROM events""")
def split_random(spark, sf):
    return split.train_test_split(table(spark, sf, "events").select("event_id", "user_id"), ["event_id"])


@query("split_stratified", """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
      t AS (SELECT sum(n) AS total, ceil(sum(n) * 0.25) AS k FROM c),
      f AS (SELECT quality, floor(n * k / total::DOUBLE) AS base, n * k / total::DOUBLE - floor(n * k / total::DOUBLE) AS rest, k FROM c, t),
      z AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality)
              <= k - sum(base) OVER () THEN 1 ELSE 0 END AS size FROM f)
    SELECT doc_id, l.quality, CASE WHEN row_number() OVER (PARTITION BY l.quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'))
        <= size THEN 'test' ELSE 'train' END AS _split FROM labels l JOIN z ON l.quality = z.quality""")
def split_stratified(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return split.train_test_split(lab, ["doc_id"], 0.25, 7, stratify_by="quality")


# Rows without a key: equal rows at the border fall on both sides.
@query("split_repeated_rows", """
    SELECT l_discount, l_linenumber, CASE WHEN row_number() OVER (ORDER BY md5(CAST(l_discount AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|42'))
        <= ceil((SELECT count(*) FROM lineitem) * 0.2) THEN 'test' ELSE 'train' END AS _split FROM lineitem""")
def split_repeated_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_discount", "l_linenumber")
    return split.train_test_split(rows, rows.columns)


# Thousands of classes: sizes and borders are tables.
@query("split_many_classes", """
    WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 5500 AS VARCHAR) AS class FROM orders),
      c AS (SELECT class, count(*) AS n FROM r GROUP BY 1),
      t AS (SELECT sum(n) AS total, ceil(sum(n) * 0.25) AS k FROM c),
      f AS (SELECT class, floor(n * k / total::DOUBLE) AS base, n * k / total::DOUBLE - floor(n * k / total::DOUBLE) AS rest, k FROM c, t),
      z AS (SELECT class, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, class) <= k - sum(base) OVER () THEN 1 ELSE 0 END AS size FROM f)
    SELECT o_orderkey, r.class, CASE WHEN row_number() OVER (PARTITION BY r.class
        ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7')) <= size THEN 'test' ELSE 'train' END AS _split
    FROM r JOIN z ON r.class = z.class""")
def split_many_classes(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5500).cast("string").alias("class"))
    return split.train_test_split(rows, ["o_orderkey"], 0.25, 7, stratify_by="class")


_ORDER_NAMES = "(SELECT l_orderkey, l_linenumber, 'o' || l_orderkey AS name FROM lineitem)"
_NAMED_CODES = f"""SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS code FROM {_ORDER_NAMES}"""


def _order_names(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("o"), "l_orderkey").alias("code"))


@query("target_many_classes", _NAMED_CODES)
def target_many_classes(spark, sf):
    rows = _order_names(spark, sf)
    return split.apply_target(rows, split.fit_target(rows, "code"))


# Saved, loaded, then applied: the map of all levels comes from the model's own folder.
@query("saved_encoder", _NAMED_CODES)
def saved_encoder(spark, sf):
    rows, path = _order_names(spark, sf), shared_folder(spark, "model")
    PipelineModel([stages.Encoder(config={"method": "label", "columns": ["code"]}).fit(rows)]).write().save(path)
    return PipelineModel.load(path).transform(rows)


# Each part's share of returned items: as many levels as there are parts.
@query("target_stats", """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
      p AS (SELECT avg(y) AS prior FROM r), s AS (SELECT l_partkey, (sum(y) + any_value(prior)) / (count(*) + 1.0::DOUBLE) AS stat FROM r, p GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(stat, 9) AS stat FROM r JOIN s USING (l_partkey)""")
def target_stats_query(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"),
                                               (F.col("l_returnflag") == "R").cast("int").alias("y"))
    state = target_stats.fit_target_stats(rows, "y", ["part"], 2)
    found = target_stats.apply_target_stats(rows, state)
    return found.select("l_orderkey", "l_linenumber", F.round(F.col(target_stats.stat_names("part", state)[0]), 9).alias("stat"))


@query("class_weights", """SELECT toxic, count(*) AS n,
    round((SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)), 6) AS weight FROM labels GROUP BY toxic""")
def class_weights(spark, sf):
    return _round(split.class_weights(table(spark, sf, "labels"), "toxic"), "weight")


@query("target_prepare", f"SELECT c_custkey, {_code('c_mktsegment')} AS c_mktsegment, CAST(c_custkey % 2 AS INTEGER) AS flag FROM customer")
def target_prepare(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", (F.col("c_custkey") % 2).cast("double").alias("flag"))
    c = split.apply_target(c, split.fit_target(c, "c_mktsegment"))
    return split.apply_target(c, split.fit_target(c, "flag"))


@query("feature_prep", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS day_year, month(o_orderdate)::INTEGER AS day_month,
    day(o_orderdate)::INTEGER AS day_day, """ + _hot("o_orderstatus", "FOP") + f", {_code('c_name')} AS c_name" + """
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def feature_prep(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", "c_name")
    prepared = features.apply_features(o, features.fit_features(o, ["o_orderkey"]))
    return prepared.select("o_orderkey", "day_year", "day_month", "day_day", "o_orderstatus_F", "o_orderstatus_O",
                           "o_orderstatus_P", "c_name")


@query("native_category_prep", f"""SELECT event_id, coalesce(event_type, 'missing') AS event_type,
    round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS_NULLS})), 6) AS value FROM {EVENTS_NULLS}""")
def native_category_prep(spark, sf):
    e = events_nulls(spark, sf).select("event_id", "event_type", "value")
    return _round(features.apply_native_categories(e, features.fit_native_categories(e, ["event_id"])), "value")
