"""Views that map the given tables to the domain's inputs.

The tables are commercial; these projections give them the shape of catalog
rows, survey rows, waveforms, dynamic spectra and scored signals. Every view
has a SQL twin (CTE) with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepared

SURVEY = tuple(f"f{i}" for i in range(1, 9))
#: Grid of the dynamic spectra: time bins (days), channels, MHz, seconds.
N_TIME, N_CHAN, F_TOP, F_STEP, T_SAMP = 31, 16, 1500.0, 20.0, 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("snr"), F.max("l_tax").alias("w"), F.min("l_discount").alias("p")
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(
        lines, orders["o_orderkey"] == lines["l_orderkey"], "left"
    )
    return rows.select(
        F.col("o_orderkey").alias("object_id"),
        F.col("o_orderstatus").alias("class_name"),
        (F.col("o_totalprice") / 100).alias("dm"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.greatest("c_acctbal", F.lit(0.0))).alias("dm_gal_max"),
        F.col("snr"),
        (F.col("w") * 100).alias("width_ms"),
        F.nullif("p", F.lit(0.0)).alias("period_s"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 181 - 90).cast("double")).alias("glat"),
    )


CATALOG = """
catalog AS (
  SELECT o_orderkey AS object_id, o_orderstatus AS class_name, o_totalprice / 100 AS dm,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN greatest(c_acctbal, 0.0) END AS dm_gal_max,
         l.snr, l.w * 100 AS width_ms, nullif(l.p, 0.0) AS period_s,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 181 - 90 AS DOUBLE) END AS glat
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS snr, max(l_tax) AS w, min(l_discount) AS p FROM lineitem GROUP BY l_orderkey) l
    ON o_orderkey = l.l_orderkey
)"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(SURVEY)],
        F.col("label").alias("class_code"), (F.col("label") < 1).cast("int").alias("y"),
    )


SURVEY_SQL = (
    "survey AS (SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(SURVEY))
    + ", label AS class_code, CASE WHEN label < 1 THEN 1 ELSE 0 END AS y FROM embeddings)"
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("class_name"), F.round("value", 6).alias("score"),
        (F.col("event_id") % 10 < 3).cast("int").alias("is_cal"),
    )


SCORES = "scores AS (SELECT event_id AS id, event_type AS class_name, round(value, 6) AS score, CASE WHEN event_id % 10 < 3 THEN 1 ELSE 0 END AS is_cal FROM events)"

PROPS = T.StructType([T.StructField("k", T.LongType())])


def frac(key: Column, mult: int) -> Column:
    """A fraction in [0, 1) that follows from a whole number."""
    return (key * mult % 1009) / F.lit(1009.0)


def frac_sql(key: str, mult: int) -> str:
    return f"(({key} * {mult} % 1009) / 1009.0)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored signals with class probabilities and evidence for the arbitrator."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", PROPS)["k"]
    i = F.col("event_id")
    p0 = frac(i, 7919)
    p1 = (1 - p0) * frac(i, 104729)
    return e.select(
        i.alias("signal_id"), F.col("event_type").alias("sig_type"), F.round("value", 6).alias("snr"), (k * 10.0).alias("dm"),
        F.round(p0, 6).alias("p0"), F.round(p1, 6).alias("p1"), F.round(1 - p0 - p1, 6).alias("p2"),
        F.round(frac(i, 1299709) * frac(i, 31), 6).alias("p_h"),
        F.when(i % 4 != 0, F.round(frac(i, 15485863), 6)).alias("p_d"),
        F.when(i % 5 != 0, F.round(frac(i, 32452843), 6)).alias("chaos"),
        F.when(i % 3 != 0, F.round(frac(i, 49979687), 6)).alias("concentration"),
        F.when(i % 3 != 0, F.round(frac(i, 67867967), 6)).alias("spectral_flatness"),
        F.when(i % 6 != 0, k * 8.0).alias("dm_gal_max"),
        F.when(i % 7 != 0, F.round("value", 6)).alias("width_ms"),
        F.when(i % 8 != 0, F.round(frac(i, 86028121) + 0.01, 6)).alias("period_s"),
        (i % 2 == 0).alias("is_extragalactic"), (i % 211 == 0).alias("ood_mask"),
        F.when(i % 10 == 0, "Unlabeled").when(F.col("event_type") == "error", "Anomaly")
        .when(F.col("event_type") == "click", "Interference").otherwise("Natural").alias("true_role"),
    )


_I = "event_id"
_P0 = frac_sql(_I, 7919)
_P1 = f"((1 - {_P0}) * {frac_sql(_I, 104729)})"
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
SIGNALS = f"""
signals AS (
  SELECT event_id AS signal_id, event_type AS sig_type, round(value, 6) AS snr, {_K} * 10.0::DOUBLE AS dm,
    round({_P0}, 6) AS p0, round({_P1}, 6) AS p1, round(1 - {_P0} - {_P1}, 6) AS p2,
    round({frac_sql(_I, 1299709)} * {frac_sql(_I, 31)}, 6) AS p_h,
    CASE WHEN event_id % 4 <> 0 THEN round({frac_sql(_I, 15485863)}, 6) END AS p_d,
    CASE WHEN event_id % 5 <> 0 THEN round({frac_sql(_I, 32452843)}, 6) END AS chaos,
    CASE WHEN event_id % 3 <> 0 THEN round({frac_sql(_I, 49979687)}, 6) END AS concentration,
    CASE WHEN event_id % 3 <> 0 THEN round({frac_sql(_I, 67867967)}, 6) END AS spectral_flatness,
    CASE WHEN event_id % 6 <> 0 THEN {_K} * 8.0::DOUBLE END AS dm_gal_max,
    CASE WHEN event_id % 7 <> 0 THEN round(value, 6) END AS width_ms,
    CASE WHEN event_id % 8 <> 0 THEN round({frac_sql(_I, 86028121)} + 0.01, 6) END AS period_s,
    event_id % 2 = 0 AS is_extragalactic, event_id % 211 = 0 AS ood_mask,
    CASE WHEN event_id % 10 = 0 THEN 'Unlabeled' WHEN event_type = 'error' THEN 'Anomaly'
         WHEN event_type = 'click' THEN 'Interference' ELSE 'Natural' END AS true_role
  FROM events
)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, pos, x): one waveform per user, in time order."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("signal_id"), pos.alias("pos"), F.col("value").alias("x"))


WAVES = "waves AS (SELECT user_id AS signal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, value AS x FROM events)"


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, t, ch, freq_mhz, power): a dense grid per event type; cells
    without events hold 0."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("obs_id"), (F.dayofmonth("ts") - 1).alias("t"), (F.col("user_id") % N_CHAN).cast("int").alias("ch"), "value"
    )
    cells = e.groupBy("obs_id", "t", "ch").agg(F.sum("value").alias("power"))
    obs = cells.select("obs_id").distinct()
    grid = obs.select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(N_TIME - 1))).alias("t")).select(
        "obs_id", "t", F.explode(F.sequence(F.lit(0), F.lit(N_CHAN - 1))).alias("ch")
    )
    return grid.join(cells, ["obs_id", "t", "ch"], "left").select(
        "obs_id", "t", "ch", (F.lit(F_TOP) - F.col("ch") * F_STEP).alias("freq_mhz"), F.round(F.coalesce("power", F.lit(0.0)), 6).alias("power")
    )


WATERFALL = f"""
cells AS (
  SELECT event_type AS obs_id, CAST(day(ts) - 1 AS INTEGER) AS t, CAST(user_id % {N_CHAN} AS INTEGER) AS ch, sum(value) AS power
  FROM events GROUP BY ALL
), waterfall AS (
  SELECT o.obs_id, CAST(t.t AS INTEGER) AS t, CAST(c.ch AS INTEGER) AS ch, {F_TOP}::DOUBLE - c.ch * {F_STEP}::DOUBLE AS freq_mhz, round(coalesce(power, 0.0), 6) AS power
  FROM (SELECT DISTINCT obs_id FROM cells) o, (SELECT unnest(range({N_TIME})) AS t) t, (SELECT unnest(range({N_CHAN})) AS ch) c
  LEFT JOIN cells x ON x.obs_id = o.obs_id AND x.t = t.t AND x.ch = c.ch
)"""


#: Hours of a bin and bins of a wave; hours of a channel of a user's spectrum.
BIN_HOURS, WAVE, CHANNEL_HOURS = 6, 32, 2


def audit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, measured from its events: peak over spread as snr,
    dispersion from its props, widths from its values, the kind of its largest
    event as its type, and a role from the kind of event that it has most of (of
    equals the first by name), which no other column is made from. Only partial
    aggregates are shuffled."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", PROPS)["k"])
    own = e.groupBy(F.col("user_id").alias("signal_id")).agg(
        ((F.max("value") - F.avg("value")) / F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias("snr"), (F.avg("k") * 10).alias("dm"), (F.max("k") * 8.0).alias("dm_gal_max"),
        F.stddev_pop("value").alias("width_ms"), F.avg("value").alias("period_s"), (F.avg(F.hour("ts")) > 11.5).alias("is_extragalactic"),
        F.max(F.struct("value", "event_type"))["event_type"].alias("sig_type"),
    )
    kinds = e.groupBy(F.col("user_id").alias("signal_id"), "event_type").agg(F.count("*").alias("n"))
    most = kinds.groupBy("signal_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"].alias("most"))
    role = F.when(F.col("signal_id") % 10 == 0, "Unlabeled").when(F.col("most") == "error", "Anomaly").when(F.col("most") == "click", "Interference").otherwise("Natural")
    return own.join(most, "signal_id").withColumn("true_role", role).drop("most")


def audit_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, window, wave): sums of a user's values in bins of six hours,
    eight days a window. Windows with one filled bin carry no wave: an array of
    one 0. Bins are summed before anything is gathered, so a window is a row of
    WAVE numbers however many events a user has."""
    e = table(spark, sf_dir, "events")
    bin_ = (F.dayofmonth("ts") - 1) * (24 // BIN_HOURS) + F.floor(F.hour("ts") / BIN_HOURS)
    cells = e.groupBy(F.col("user_id").alias("signal_id"), bin_.alias("bin")).agg(F.sum("value").alias("x"))
    cells = cells.withColumn("window", F.floor(F.col("bin") / WAVE).cast("int")).withColumn("at", (F.col("bin") % WAVE).cast("int"))
    whole = cells.groupBy("signal_id", "window").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    wave = F.transform(F.sequence(F.lit(0), F.lit(WAVE - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return whole.select("signal_id", "window", F.when(F.size("m") > 1, wave).otherwise(F.array(F.lit(0.0))).alias("wave"))


def audit_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, t, ch, power): a user's values by day and by hours of the day, as
    a dense grid; cells without events hold 0."""
    e = table(spark, sf_dir, "events")
    n_ch = 24 // CHANNEL_HOURS
    cells = e.groupBy(F.col("user_id").alias("obs_id"), (F.dayofmonth("ts") - 1).alias("t"), F.floor(F.hour("ts") / CHANNEL_HOURS).cast("int").alias("ch")).agg(F.sum("value").alias("power"))
    line = cells.groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("t") * n_ch + F.col("ch")).alias("i"), "power"))).alias("m"))
    grid = line.select("obs_id", "m", F.explode(F.sequence(F.lit(0), F.lit(N_TIME * n_ch - 1))).alias("i"))
    return grid.select("obs_id", F.floor(F.col("i") / n_ch).cast("int").alias("t"), (F.col("i") % n_ch).cast("int").alias("ch"), F.coalesce(F.col("m")[F.col("i")], F.lit(0.0)).alias("power"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, pred_a, pred_b, prob): two predictors of documents' labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(d, "doc_id")
    return j.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), (F.col("n_chars") > 600).cast("int").alias("pred_a"),
        (F.col("doc_id") % 7 != 0).cast("int").alias("pred_b"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 6).alias("prob"),
    )


PREDICTIONS = """
predictions AS (
  SELECT doc_id AS id, quality AS y, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS pred_a,
         CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END AS pred_b, round(n_chars / (n_chars + 1500.0::DOUBLE), 6) AS prob
  FROM labels JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE quality IS NOT NULL
)"""


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, p): true and predicted class codes."""
    e = table(spark, sf_dir, "embeddings")
    off = F.when(F.col("embedding")[0] > F.lit(0.1).cast("float"), 1).otherwise(0)
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("t"), ((F.col("label") + off) % 10).alias("p"))


MULTICLASS = "multiclass AS (SELECT vec_id AS id, label AS t, (label + CASE WHEN embedding[1] > 0.1::FLOAT THEN 1 ELSE 0 END) % 10 AS p FROM embeddings)"
