"""Column detection, cleaning, profiling and splitting of a feature table.

Nulls: NaN and infinities become null first; statistics skip nulls. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabguard.functions.numeric import unpivot
from tabguard.operators import quantiles
from tabguard.operators.ranks import hashed_order, with_count, with_rank

# Names that mark a label, and words that mark identifiers.
LABEL_NAMES = ["label", "labels", "target", "targets", "class", "classes", "y", "output", "result", "category", "poisoned", "is_poisoned", "attack", "anomaly", "fraud", "diagnosis", "prediction", "ground_truth"]
ID_WORDS = ["id", "uuid", "index", "timestamp", "date", "time", "name"]
_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.typeName()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in _NUMBERS]


# ---- detection (B1, B2, B3, B5, B22) -----------------------------------------------------------------------------------


def detect_label(df: DataFrame) -> DataFrame:
    """One row: label_column and the rule that found it (name, binary, last_column), or nulls."""
    spark = df.sparkSession
    schema = "label_column string, rule string"
    named = [c for c in df.columns if c.lower().strip() in LABEL_NAMES]
    if named:
        return spark.createDataFrame([(named[0], "name")], schema)
    numbers, last = numeric_columns(df), df.columns[-1]
    checks = []
    for i, c in enumerate(numbers):
        v = F.col(c).cast("double")
        checks += [F.coalesce(F.bool_or(v == x), F.lit(False)).cast("int").alias(f"c{i}_{j}") for j, x in enumerate((0.0, 1.0, -1.0))]
        checks.append(F.coalesce(F.bool_or(v.isNotNull() & ~v.isin(0.0, 1.0, -1.0)), F.lit(False)).alias(f"c{i}_x"))
    checks.append(F.approx_count_distinct(last).alias("last"))
    got = df.agg(*checks).first()
    for i, c in enumerate(numbers):
        if not got[f"c{i}_x"] and sum(got[f"c{i}_{j}"] for j in range(3)) == 2:
            return spark.createDataFrame([(c, "binary")], schema)
    if _kind(df, last) in ("integer", "long", "string") and got["last"] <= 20 and df.agg(F.count_distinct(last)).first()[0] <= 10:
        return spark.createDataFrame([(last, "last_column")], schema)
    return spark.createDataFrame([(None, None)], schema)


def detect_features(df: DataFrame, label: str | None = None, id_rule: str = "token") -> DataFrame:
    """feature: numeric columns but the label and near-unique (> 90 % distinct) columns named like identifiers."""
    import re

    def named(c: str) -> bool:
        words = re.split(r"[^a-z]+", c.lower())
        return any(w in words for w in ID_WORDS) if id_rule == "token" else any(w in c.lower() for w in ID_WORDS)

    numbers = [c for c in numeric_columns(df) if c != label]
    doubtful = [c for c in numbers if named(c)]
    got = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(doubtful)]).first()
    drop = {c for i, c in enumerate(doubtful) if got[f"d{i}"] > 0.9 * got["n"]}
    return df.sparkSession.createDataFrame([(c,) for c in numbers if c not in drop], "feature string")


def top_variance(df: DataFrame, features: list[str], k: int = 100) -> DataFrame:
    """feature, variance of the k features with the largest sample variance."""
    one = df.agg(*[F.var_samp(c).alias(c) for c in features])
    return unpivot(one, features, []).withColumnRenamed("value", "variance").orderBy(F.desc("variance"), "feature").limit(k)


def label_mode(df: DataFrame, label: str, most: int = 20) -> DataFrame:
    """n_classes and mode: supervised up to ``most`` classes, else unsupervised."""
    n = F.count_distinct(label)
    return df.agg(n.alias("n_classes"), F.when(n <= most, "supervised").otherwise("unsupervised").alias("mode"))


def feature_mismatch(reference: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: whether both tables have equally many numeric columns, and the skip reason if not."""
    a, b = len(numeric_columns(reference)), len(numeric_columns(incoming))
    reason = None if a == b else f"feature_mismatch: incoming {b} cols vs baseline {a} cols"
    return reference.sparkSession.createDataFrame([(a, b, a == b, reason)], "n_reference int, n_incoming int, matches boolean, skip_reason string")


# ---- labels (B4, B19, B20) -----------------------------------------------------------------------------------------------


def encode_label(df: DataFrame, label: str, out: str = "label_code", mode: str = "auto") -> DataFrame:
    """Numbers of two values: is the larger; other numbers: above the mean; strings: place among the sorted values."""
    if _kind(df, label) in _NUMBERS:
        s = df.agg(F.count_distinct(label).alias("_n"), F.max(label).alias("_hi"), F.avg(label).alias("_mean"))
        c = F.when(F.col("_n") == 2, F.col(label) == F.col("_hi")).otherwise(F.col(label) > F.col("_mean"))
        return df.crossJoin(F.broadcast(s)).withColumn(out, F.coalesce(c, F.lit(False)).cast("int")).drop("_n", "_hi", "_mean")
    value = F.coalesce(F.col(label).cast("string"), F.lit("unknown"))
    codes = df.select(value.alias("_v")).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy("_v")) - 1).cast("int"))  # a row per class
    return df.withColumn("_v", value).join(codes, "_v").drop("_v")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, share, and balance: smallest over largest class."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("_t"), (F.min("n") / F.max("n")).alias("balance"))
    return c.crossJoin(F.broadcast(t)).select(label, "n", (F.col("n") / F.col("_t")).alias("share"), "balance")


def quantile_bins(df: DataFrame, column: str, bins: int = 3, out: str = "bin") -> DataFrame:
    """0-based bin of each value between the quantiles; a value on an edge belongs to the lower bin."""
    edges = quantiles.of_columns(df, [column], [i / bins for i in range(1, bins)])[column]
    return df.withColumn(out, sum(((F.col(column) > F.lit(e).cast("double")).cast("int") for e in edges), F.lit(0)))


# ---- cleaning (B6-B13) ---------------------------------------------------------------------------------------------------


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def coercion_losses(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: values that coerce_numeric turns into null."""
    lost = lambda c: F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull())
    return unpivot(df.agg(*[lost(c).alias(c) for c in columns]), columns, []).select(F.col("feature").alias("column"), F.col("value").cast("long").alias("n"))


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def drop_infinities(df: DataFrame, features: list[str]) -> DataFrame:
    """NaN and infinities as null."""
    return df.withColumns({c: _finite(c) for c in features})


def drop_sparse_rows(df: DataFrame, features: list[str], most: float = 0.5) -> DataFrame:
    """Rows with at most this share of null features."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in features])
    return df.where(nulls <= most * len(features))


def drop_duplicates(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """The first row, in the given order, of each set of equal rows; nulls are equal."""
    w = Window.partitionBy(*columns).orderBy(*order_by)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def constant_features(df: DataFrame, features: list[str]) -> DataFrame:
    """feature: those with no spread (deviation 0 or undefined)."""
    return unpivot(df.agg(*[F.stddev_samp(c).alias(c) for c in features]), features, []).where("value IS NULL OR value = 0").select("feature")


def drop_constant(df: DataFrame, features: list[str]) -> DataFrame:
    return df.drop(*[r["feature"] for r in constant_features(df, features).collect()])  # at most a row per column


def _quantiles(df: DataFrame, features: list[str], at: list[float], accuracy: int | None, segments: list[str]) -> DataFrame:
    if accuracy is not None:
        return df.groupBy(*segments).agg(*[F.approx_percentile(c, at, accuracy).alias(f"_{c}") for c in features])
    long = quantiles.percentiles(unpivot(df, features, segments), [*segments, "feature"], "value", at)
    own = lambda c: F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_{c}")
    if segments:  # a segment without any value has a row too
        return df.select(*segments).distinct().join(long.groupBy(*segments).agg(*[own(c) for c in features]), segments, "left")
    return long.agg(*[own(c) for c in features])


def _with(df: DataFrame, stats: DataFrame, segments: list[str]) -> DataFrame:
    """Statistics next to each row: one row of them is broadcast, rows per segment are joined as Spark sees fit."""
    return df.join(stats, segments) if segments else df.crossJoin(F.broadcast(stats))


def impute_median(df: DataFrame, features: list[str], accuracy: int | None = None, segments: list[str] = []) -> DataFrame:  # noqa: B006
    """Nulls as the median; as 0 where a column has no value. ``accuracy`` switches to approximate medians."""
    out = _with(df, _quantiles(df, features, [0.5], accuracy, segments), segments)
    return out.withColumns({c: F.coalesce(F.col(c), F.get(f"_{c}", F.lit(0)), F.lit(0.0)) for c in features}).drop(*[f"_{c}" for c in features])


def clip_outliers(df: DataFrame, features: list[str], reach: float = 5.0, accuracy: int | None = None, segments: list[str] = []) -> DataFrame:  # noqa: B006
    """Values held to [q1 - reach IQR, q3 + reach IQR] where the IQR is positive."""
    out = _with(df, _quantiles(df, features, [0.25, 0.75], accuracy, segments), segments)

    def held(c: str) -> Column:
        q1, q3 = F.get(f"_{c}", F.lit(0)), F.get(f"_{c}", F.lit(1))
        return F.when((q3 > q1) & F.col(c).isNotNull(), F.greatest(q1 - reach * (q3 - q1), F.least(q3 + reach * (q3 - q1), F.col(c)))).otherwise(F.col(c))

    return out.withColumns({c: held(c) for c in features}).drop(*[f"_{c}" for c in features])


def cleaning_report(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """step, n: cells or rows that each cleaning step changes or drops, the steps taken in order.

    The counts are observed in one job, while its rows pass from step to step.
    """
    steps = ["infinities", "sparse_rows", "duplicates", "imputed"]
    if df.isEmpty():  # Spark leaves observations of empty plans out
        return df.sparkSession.createDataFrame([(s, 0) for s in steps], "step string, n long")
    raw, dense, distinct = Observation(), Observation(), Observation()
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in features])
    each = [F.coalesce((F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("int"), F.lit(0)) for c in features]
    odd = reduce(lambda a, b: a + b, each)
    rows = df.observe(raw, F.count(F.lit(1)).alias("n"), F.sum(odd).alias("odd"))
    rows = drop_sparse_rows(drop_infinities(rows, features), features).observe(dense, F.count(F.lit(1)).alias("n"))
    once = rows.groupBy(*features, *([label] if label else [])).agg(F.count("*").alias("_m"))
    once.observe(distinct, F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls")).write.format("noop").mode("overwrite").save()
    a, b, c = raw.get, dense.get, distinct.get
    counts = [a["odd"] or 0, a["n"] - b["n"], b["n"] - c["n"], c["nulls"] or 0]
    return df.sparkSession.createDataFrame(list(zip(steps, counts, strict=True)), "step string, n long")


# ---- scaling, splitting, profiling (B14-B18, B21) ------------------------------------------------------------------------


def minmax_scale(df: DataFrame, features: list[str], segments: list[str] = []) -> DataFrame:  # noqa: B006
    """Features in [0, 1]; a constant one becomes 0."""
    s = df.groupBy(*segments).agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"_{c}") for c in features])
    scaled = lambda c: (F.col(c) - F.col(f"_{c}.lo")) / F.when(F.col(f"_{c}.hi") == F.col(f"_{c}.lo"), 1.0).otherwise(F.col(f"_{c}.hi") - F.col(f"_{c}.lo"))
    return _with(df, s, segments).withColumns({c: scaled(c) for c in features}).drop(*[f"_{c}" for c in features])


def split_by_order(df: DataFrame, order_by: list[str], reference: float = 0.7) -> DataFrame:
    """row_rank, and split: reference for the first part of the rows, else incoming."""
    out = with_count(with_rank(df, order_by))
    return out.withColumn("split", F.when(F.col("row_rank") < F.floor(F.lit(reference) * F.col("n_rows")), "reference").otherwise("incoming"))


def split_by_hash(df: DataFrame, keys: list[str], reference: float = 0.7, seed: int = 42) -> DataFrame:
    """split by a hash of the row's key: about this share is reference, for any partitioning."""
    return df.withColumn("split", F.when(F.pmod(hashed_order(keys, seed), F.lit(1_000_000)) < int(reference * 1_000_000), "reference").otherwise("incoming"))


def with_batch(df: DataFrame, size: int = 100) -> DataFrame:
    """batch_id from row_rank."""
    return df.withColumn("batch_id", F.concat(F.lit("batch_"), F.floor(F.col("row_rank") / size).cast("string")))


def profile(df: DataFrame, features: list[str], segments: list[str] = []) -> DataFrame:  # noqa: B006
    """feature, n, missing_pct, mean, sigma, min, max."""
    long = unpivot(df, features, segments)
    return long.groupBy(*segments, "feature").agg(F.count("*").alias("n"), (100 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_pct"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"), F.min("value").alias("min"), F.max("value").alias("max"))


def clean_baseline(df: DataFrame, order_by: list[str], n: int = 200, status: str = "poison_status") -> DataFrame:
    """The first n rows whose status is clean."""
    return df.where(F.col(status) == "clean").orderBy(*order_by).limit(n)


def guard_rails(df: DataFrame, features: list[str], least: int = 20, strict: bool = False) -> DataFrame:
    """rule, ok: enough rows, and at least one numeric feature. ``strict`` raises on a broken rule."""
    numbers = len([c for c in features if _kind(df, c) in _NUMBERS])
    out = df.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit("min_rows").alias("rule"), (F.col("n") >= least).alias("ok")), F.struct(F.lit("numeric_feature").alias("rule"), F.lit(numbers > 0).alias("ok")))).alias("x")).select("x.*")
    if strict:
        broken = [r["rule"] for r in out.where("NOT ok").collect()]  # two rules
        if broken:
            raise ValueError(f"the table breaks {', '.join(broken)}")
    return out
