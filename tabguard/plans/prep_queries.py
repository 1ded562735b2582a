"""Queries over cleaning, profiling and splitting (B) and over sources (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import prep
from tabguard.plans.base import FEATURES, LI, ORDER, SPLIT, lineitem, query, table

_KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey"
_S4 = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES)
#: A dirty table from lineitem: text in a number column, infinities, nulls, a constant column.
_DIRTY_SQL = f"""{LI}, dirty AS (SELECT {_KEY}, label,
  CASE WHEN l_orderkey % 97 = 0 THEN 'bad' ELSE CAST(l_linenumber AS VARCHAR) END AS raw,
  CASE WHEN l_partkey % 89 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_discount END AS b,
  CASE WHEN l_partkey % 26 = 0 THEN NULL ELSE l_tax END AS c, 1.0::DOUBLE AS k FROM li)"""


def dirty(spark, sf_dir):
    li = lineitem(spark, sf_dir)
    off = lambda n: F.col("l_partkey") % n == 0
    return li.select(
        *ORDER, "label",
        F.when(F.col("l_orderkey") % 97 == 0, "bad").otherwise(F.col("l_linenumber").cast("string")).alias("raw"),
        F.when(off(89), float("inf")).when(off(13), None).otherwise(F.col("l_quantity")).alias("a"),
        F.when(off(13), None).otherwise(F.col("l_discount")).alias("b"),
        F.when(off(26), None).otherwise(F.col("l_tax")).alias("c"),
        F.lit(1.0).alias("k"),
    )


_NAMES = ", ".join(f"'{c}'" for c in prep.LABEL_NAMES)


@query(f"SELECT column_name AS label_column, 'name' AS rule FROM (DESCRIBE WITH {LI} SELECT * FROM li) WHERE lower(column_name) IN ({_NAMES}) LIMIT 1")
def b01_detect_label(spark, sf_dir):
    return prep.detect_label(lineitem(spark, sf_dir).drop("l_suppkey"))


@query("""WITH v AS (SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, CAST(o_custkey % 3 AS DOUBLE) AS third, CAST(o_orderstatus = 'O' AS DOUBLE) AS still_open FROM orders),
l AS (SELECT c, value FROM v UNPIVOT (value FOR c IN (o_orderkey, o_totalprice, third, still_open)))
SELECT c AS label_column, 'binary' AS rule FROM l GROUP BY c HAVING bool_and(value IN (0, 1, -1)) AND count(DISTINCT value) = 2""")
def b01_detect_binary_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return prep.detect_label(o.select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 3).alias("third"), (F.col("o_orderstatus") == "O").cast("int").alias("still_open"), "o_orderpriority"))


#: The features of a table in SQL: its numbers but those with a name ``like`` an identifier's and more than 90 % distinct values.
_FEATURES_SQL = """WITH l AS (SELECT feature, value FROM (SELECT {casts} FROM {table}) UNPIVOT (value FOR feature IN ({names})))
SELECT feature FROM l GROUP BY feature HAVING NOT (regexp_matches(feature, '{like}') AND count(DISTINCT value) > 0.9 * count(*))"""


def _features_sql(name, columns, like):
    return _FEATURES_SQL.format(casts=", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns), table=name, names=", ".join(columns), like=like)


@query(_features_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], "|".join(prep.ID_WORDS)))
def b02_detect_features(spark, sf_dir):
    return prep.detect_features(table(spark, sf_dir, "orders"), None, "substring")


@query(_features_sql("events", ["event_id", "user_id", "value"], f"(^|[^a-z])({'|'.join(prep.ID_WORDS)})([^a-z]|$)"))
def b02_detect_features_by_token(spark, sf_dir):
    return prep.detect_features(table(spark, sf_dir, "events"))


_VAR = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM lineitem" for c in FEATURES)


@query(f"SELECT feature, round(variance, 4) AS variance FROM ({_VAR}) ORDER BY variance DESC, feature LIMIT 3")
def b03_top_variance(spark, sf_dir):
    return prep.top_variance(lineitem(spark, sf_dir), FEATURES, 3).select("feature", F.round("variance", 4).alias("variance"))


@query("""WITH v AS (SELECT DISTINCT coalesce(l_linestatus, 'unknown') AS s FROM lineitem), c AS (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS code FROM v)
SELECT code AS label_code, count(*) AS n FROM lineitem JOIN c ON coalesce(l_linestatus, 'unknown') = s GROUP BY 1""")
def b04_encode_label(spark, sf_dir):
    return prep.encode_label(table(spark, sf_dir, "lineitem"), "l_linestatus").groupBy("label_code").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_quantity > (SELECT avg(l_quantity) FROM lineitem) AS INT) AS label_code, count(*) AS n FROM lineitem GROUP BY 1")
def b04_encode_numeric_label(spark, sf_dir):
    return prep.encode_label(table(spark, sf_dir, "lineitem"), "l_quantity").groupBy("label_code").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_returnflag) AS n_classes, CASE WHEN count(DISTINCT l_returnflag) <= 20 THEN 'supervised' ELSE 'unsupervised' END AS mode FROM lineitem")
def b05_label_mode(spark, sf_dir):
    return prep.label_mode(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query(f"WITH {_DIRTY_SQL} SELECT 'raw' AS \"column\", count(*) FILTER (WHERE raw IS NOT NULL AND TRY_CAST(raw AS DOUBLE) IS NULL) AS n FROM dirty")
def b06_coercion_losses(spark, sf_dir):
    return prep.coercion_losses(dirty(spark, sf_dir), ["raw"])


@query(f"WITH {_DIRTY_SQL} SELECT count(a) AS a, count(b) AS b, round(max(a), 6) AS top FROM (SELECT CASE WHEN isinf(a) THEN NULL ELSE a END AS a, b FROM dirty)")
def b07_drop_infinities(spark, sf_dir):
    return prep.drop_infinities(dirty(spark, sf_dir), ["a", "b"]).agg(F.count("a").alias("a"), F.count("b").alias("b"), F.round(F.max("a"), 6).alias("top"))


@query(f"WITH {_DIRTY_SQL} SELECT count(*) AS n FROM dirty WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT <= 1.5")
def b08_drop_sparse_rows(spark, sf_dir):
    return prep.drop_sparse_rows(dirty(spark, sf_dir), ["a", "b", "c"]).agg(F.count("*").alias("n"))


@query(f"""WITH {LI} SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, label FROM
(SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, label ORDER BY {_KEY}) AS nth FROM li) WHERE nth = 1""")
def b09_drop_duplicates(spark, sf_dir):
    out = prep.drop_duplicates(lineitem(spark, sf_dir), ["l_quantity", "l_discount", "label"], ORDER)
    return out.select(*ORDER, "l_quantity", "l_discount", "label")


@query(f"WITH {_DIRTY_SQL} SELECT feature FROM (SELECT 'a' AS feature, stddev_samp(l_tax) AS s FROM lineitem UNION ALL SELECT 'k', stddev_samp(k) FROM dirty) WHERE s = 0 OR s IS NULL")
def b10_constant_features(spark, sf_dir):
    return prep.constant_features(prep.drop_infinities(dirty(spark, sf_dir), ["a"]), ["a", "k"])


@query(f"""WITH {_DIRTY_SQL}, m AS (SELECT quantile_cont(b, 0.5) AS mb, quantile_cont(c, 0.5) AS mc FROM dirty)
SELECT round(avg(coalesce(b, mb)), 8) AS b, round(avg(coalesce(c, mc)), 8) AS c, count(*) AS n FROM dirty, m""")
def b11_impute_median(spark, sf_dir):
    out = prep.impute_median(dirty(spark, sf_dir), ["b", "c"])
    return out.agg(F.round(F.avg("b"), 8).alias("b"), F.round(F.avg("c"), 8).alias("c"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(a - 0.2 * (b - a), least(b + 0.2 * (b - a), l_extendedprice)), 4) AS l_extendedprice FROM lineitem, q""")
def b12_clip_outliers(spark, sf_dir):
    out = prep.clip_outliers(lineitem(spark, sf_dir), ["l_extendedprice"], 0.2)
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query(f"""WITH {_DIRTY_SQL}, f AS (SELECT CASE WHEN isinf(a) THEN NULL ELSE a END AS a, b, c, label FROM dirty),
d AS (SELECT * FROM f WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT <= 1.5), g AS (SELECT a, b, c, label, count(*) AS m FROM d GROUP BY ALL)
SELECT 'infinities' AS step, (SELECT count(*) FROM dirty WHERE isinf(a)) AS n UNION ALL SELECT 'sparse_rows', (SELECT count(*) FROM f) - (SELECT count(*) FROM d)
UNION ALL SELECT 'duplicates', (SELECT coalesce(sum(m - 1), 0)::BIGINT FROM g) UNION ALL SELECT 'imputed', (SELECT sum((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT)::BIGINT FROM g)""")
def b13_cleaning_report(spark, sf_dir):
    return prep.cleaning_report(dirty(spark, sf_dir), ["a", "b", "c"], "label")


def scaled_split(spark, sf_dir):
    return prep.split_by_order(prep.minmax_scale(lineitem(spark, sf_dir), FEATURES), ORDER)


@query(f"WITH {SPLIT} SELECT {_KEY}, {_S4} FROM split")
def b14_minmax_scale(spark, sf_dir):
    return prep.minmax_scale(lineitem(spark, sf_dir), FEATURES).select(*ORDER, *[F.round(c, 6).alias(c) for c in FEATURES])


@query(f"WITH {SPLIT} SELECT {_KEY}, row_rank, split FROM split")
def b15_split(spark, sf_dir):
    return prep.split_by_order(lineitem(spark, sf_dir), ORDER).select(*ORDER, "row_rank", "split")


@query()
def b16_random_split(spark, sf_dir):
    return prep.split_by_hash(table(spark, sf_dir, "orders"), ["o_orderkey"]).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {SPLIT} SELECT 'batch_' || CAST(row_rank // 100 AS VARCHAR) AS batch_id, count(*) AS n, min(row_rank) AS first_rank FROM split GROUP BY 1")
def b17_batches(spark, sf_dir):
    return prep.with_batch(prep.split_by_order(lineitem(spark, sf_dir), ORDER)).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("row_rank").alias("first_rank"))


@query(f"""WITH {LI}, l AS (SELECT feature, value FROM li UNPIVOT (value FOR feature IN ({", ".join(FEATURES)})))
SELECT feature, count(*) AS n, 0.0 AS missing_pct, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sigma, min(value) AS min, max(value) AS max FROM l GROUP BY feature""")
def b18_profile(spark, sf_dir):
    out = prep.profile(lineitem(spark, sf_dir), FEATURES)
    return out.withColumns({"mean": F.round("mean", 6), "sigma": F.round("sigma", 6)})


@query("""WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(n / sum(n) OVER (), 8) AS share, round(min(n) OVER () / max(n) OVER (), 8) AS balance FROM c""")
def b19_class_balance(spark, sf_dir):
    out = prep.class_balance(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return out.withColumns({"share": F.round("share", 8), "balance": F.round("balance", 8)})


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 1/3.0::DOUBLE) AS a, quantile_cont(o_totalprice, 2/3.0::DOUBLE) AS b FROM orders)
SELECT CAST(o_totalprice > a AS INT) + CAST(o_totalprice > b AS INT) AS bin, count(*) AS n FROM orders, q GROUP BY 1""")
def b20_quantile_bins(spark, sf_dir):
    return prep.quantile_bins(table(spark, sf_dir, "orders"), "o_totalprice").groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, value FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 200")
def b21_clean_baseline(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("poison_status", F.when(F.col("event_type") == "error", "confirmed").otherwise("clean"))
    return prep.clean_baseline(ev, ["ts", "event_id"], 200).select("event_id", "ts", "value")


_COUNT = "(SELECT CAST(count(*) AS INT) FROM (DESCRIBE SELECT * FROM {}) WHERE regexp_matches(column_type, 'INT|DOUBLE|FLOAT|DECIMAL'))"


@query(f"""WITH n AS (SELECT {_COUNT.format("lineitem")} AS a, {_COUNT.format("orders")} AS b)
SELECT a AS n_reference, b AS n_incoming, a = b AS matches, CASE WHEN a <> b THEN 'feature_mismatch: incoming ' || b || ' cols vs baseline ' || a || ' cols' END AS skip_reason FROM n""")
def b22_feature_mismatch(spark, sf_dir):
    return prep.feature_mismatch(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


# ---- sources and sinks -------------------------------------------------------------------------------------------------


@query("SELECT 'min_rows' AS rule, count(*) >= 20 AS ok FROM lineitem UNION ALL SELECT 'numeric_feature', true")
def a03_guard_rails(spark, sf_dir):
    return prep.guard_rails(lineitem(spark, sf_dir), FEATURES)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey LIMIT 1000")
def a02_row_cap(spark, sf_dir):
    from tabguard.sources import tables

    return tables.row_cap(table(spark, sf_dir, "lineitem"), ORDER, 1000).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def a01_csv_inferred(spark, sf_dir):
    """A CSV file whose types Spark infers."""
    from tabguard.sources import tables

    path = tables.scratch(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return tables.read_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM orders")
def a07_csv_round_trip(spark, sf_dir):
    from tabguard.sources import tables

    o = table(spark, sf_dir, "orders")
    return tables.csv_round_trip(o.select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("label")))


@query("SELECT vec_id % 5 AS model_id, vec_id AS unit_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def a08_parameter_table(spark, sf_dir):
    from tabguard.sources import tables

    v = table(spark, sf_dir, "embeddings")
    return tables.parameter_table(v.select((F.col("vec_id") % 5).alias("model_id"), F.col("vec_id").alias("unit_id"), F.col("embedding").alias("params"))).select("model_id", "unit_id", F.posexplode("params").alias("i", "value")).withColumn("value", F.round("value", 6))


@query("SELECT vec_id % 20 AS client_id, vec_id // 20 AS round, 1 AS n_samples, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def a09_client_gradients(spark, sf_dir):
    from tabguard.sources import tables

    return tables.client_gradients(clients(spark, sf_dir)).select("client_id", "round", "n_samples", F.posexplode("gradient").alias("i", "value")).withColumn("value", F.round("value", 6))


def clients(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select((F.col("vec_id") % 20).alias("client_id"), F.floor(F.col("vec_id") / 20).alias("round"), F.col("embedding").cast("array<double>").alias("gradient"), F.lit(1).alias("n_samples"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_custkey % 2 = 0 THEN 'upload' ELSE 'demo' END AS source, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS verdict
FROM orders GROUP BY o_custkey""")
def a04_result_store(spark, sf_dir):
    from tabguard.sources import tables

    o = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_custkey") % 2 == 0, "upload").otherwise("demo")
    rows = o.select(F.col("o_custkey").cast("string").alias("id"), source.alias("source"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("verdict"), F.timestamp_seconds("o_orderkey").alias("created_at"))
    return tables.store_and_read_latest(rows).select(F.col("id").cast("string").alias("id"), "source", "version", "verdict")


@query("SELECT 'scan-' || vec_id % 50 AS id, max(vec_id) AS n_units, arg_max(CASE WHEN vec_id % 3 = 0 THEN 'SUSPICIOUS' ELSE 'CLEAN' END, vec_id) AS verdict FROM embeddings GROUP BY 1")
def a05_scan_store(spark, sf_dir):
    """Results of model scans in a table of their own; the newest of each scan."""
    from tabguard.sources import tables

    v = table(spark, sf_dir, "embeddings")
    verdict = F.when(F.col("vec_id") % 3 == 0, "SUSPICIOUS").otherwise("CLEAN")
    rows = v.select(F.concat(F.lit("scan-"), F.col("vec_id") % 50).alias("id"), F.lit("model").alias("source"), F.col("vec_id").alias("n_units"), verdict.alias("verdict"), F.timestamp_seconds("vec_id").alias("created_at"))
    return tables.store_and_read_latest(rows).select("id", "n_units", "verdict")


@query("SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS full_json FROM customer")
def a06_evidence_json(spark, sf_dir):
    from tabguard.sources import tables

    return tables.as_document(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "full_json").select("c_custkey", "full_json")

