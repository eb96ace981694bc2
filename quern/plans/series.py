"""Queries of the time series operators over events: key user_id, time ts, value value, code event_type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import timeseries as T
from quern.plans.registry import query, table

DAY = "((epoch_us(ts) // 1000000) // 86400 * 86400)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long"))


def _daily(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("user_id"), (F.floor(F.col("t") / 86400) * 86400).alias("ts")).agg(F.round(F.sum("value"), 2).alias("value"))


_DAILY = f"d AS (SELECT user_id, {DAY} AS ts, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH {_DAILY}, s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM d GROUP BY 1),
g AS (SELECT user_id, unnest(range(a, b + 1, 86400)) AS t FROM s)
SELECT g.user_id, g.t, coalesce(d.value, 0.0) AS value FROM g ASOF LEFT JOIN d ON g.user_id = d.user_id AND g.t >= d.ts""")
def resample_locf(spark, sf_dir):
    return T.resample(_daily(spark, sf_dir), "user_id")


@query(f"""WITH {_DAILY}, s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM d GROUP BY 1),
g AS (SELECT user_id, unnest(range(a, b + 1, 86400)) AS t FROM s),
f AS (SELECT g.user_id, g.t, coalesce(d.value, 0.0) AS value FROM g ASOF LEFT JOIN d ON g.user_id = d.user_id AND g.t >= d.ts)
SELECT user_id, string_agg(printf('%.2f', value), ',' ORDER BY t) AS "values" FROM f GROUP BY 1""")
def resample_reference(spark, sf_dir):
    """At one event a step at most, the fold that uses up an event a step gives the last value of each."""
    out = T.resample_reference(_daily(spark, sf_dir), "user_id")
    return out.select("user_id", F.array_join(F.transform("values", lambda x: F.format_string("%.2f", x)), ",").alias("values"))


@query("""WITH c AS (SELECT user_id, median((epoch_us(ts) // 1000000)) AS c FROM events GROUP BY 1 HAVING count(*) % 3 <> 0)
SELECT event_id, e.user_id FROM events e JOIN c USING (user_id) WHERE (epoch_us(ts) // 1000000) <= c""")
def asof_cutoff_prune(spark, sf_dir):
    e = _events(spark, sf_dir)
    # Every user's events are read; users with a multiple of three events go without a cutoff.
    cutoffs = e.groupBy("user_id").agg(F.median("t").alias("c"), F.count("*").alias("n")).where("n % 3 <> 0")
    return T.prune_after(e, "user_id", F.col("t"), cutoffs, "c").select("event_id", "user_id")


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def id_intersection(spark, sf_dir):
    e = _events(spark, sf_dir)
    return T.common_keys([e.where(F.col("event_type") == x) for x in ("purchase", "error")], "user_id")


@query("SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def id_union(spark, sf_dir):
    e = _events(spark, sf_dir)
    return T.common_keys([e.where(F.col("event_type") == x) for x in ("purchase", "error")], "user_id", every=False)


@query("""SELECT user_id, event_type, max(p) AS last FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events) GROUP BY 1, 2""")
def enumerate_codes(spark, sf_dir):
    out = T.enumerate_codes(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")
    return out.withColumn("last", F.col("last").cast("long"))


@query("""WITH f AS (SELECT user_id, max((event_type = 'purchase')::INTEGER) AS has_purchase, max((event_type = 'error')::INTEGER) AS has_error FROM events GROUP BY 1) SELECT *, has_purchase + has_error AS n FROM f""")
def binary_indicators(spark, sf_dir):
    return T.code_indicators(_events(spark, sf_dir), "user_id", "event_type", ["purchase", "error"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_codes(spark, sf_dir):
    return T.top_codes(_events(spark, sf_dir), "event_type", 3)


@query("""WITH d AS (SELECT user_id, (epoch_us(ts) // 1000000) - lag((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000000)) AS d FROM events)
SELECT user_id, count(d) AS n, round(avg(d), 6) AS mean_delta, round(stddev_pop(d), 6) AS sd_delta FROM d GROUP BY 1""")
def delta_stats(spark, sf_dir):
    return T.delta_stats(_events(spark, sf_dir), "user_id", F.col("t"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (ORDER BY event_id) AS i FROM events), d AS (SELECT a.user_id, abs(a.t - b.t) AS d FROM e a JOIN e b ON a.user_id = b.user_id AND a.i < b.i)
SELECT user_id, count(*) AS n, round(avg(d), 4) AS mean_delta, round(stddev_pop(d), 4) AS sd_delta FROM d GROUP BY 1""")
def pair_delta_stats(spark, sf_dir):
    return T.pair_delta_stats(_events(spark, sf_dir), "user_id", F.col("t"))


@query("""WITH c AS (SELECT unnest(['purchase', 'error']) AS code) SELECT user_id, code, string_agg((event_type = code)::INTEGER::VARCHAR, '' ORDER BY epoch_us(ts) // 1000000, event_id) || '+' || count_if(event_type = code) AS flags FROM events, c GROUP BY 1, 2""")
def indicator_sequences(spark, sf_dir):
    s = T.indicator_sequences(_events(spark, sf_dir), "user_id", ["t", "event_id"], "event_type", ["purchase", "error"])
    n = F.size("flags")
    return s.select("user_id", "code", F.concat(F.array_join(F.slice("flags", F.lit(1), n - 1), ""), F.lit("+"), F.element_at("flags", -1).cast("string")).alias("flags"))


@query(f"""WITH {_DAILY} SELECT user_id, string_agg(ts || '@' || printf('%.2f', value), ',' ORDER BY ts) AS series FROM d GROUP BY 1""")
def packed_sequences(spark, sf_dir):
    s = T.sequences(_daily(spark, sf_dir), "user_id", "ts", "value")
    return s.select("user_id", F.array_join(F.transform("series", lambda x: F.concat(x["ts"].cast("string"), F.lit("@"), F.format_string("%.2f", x["value"]))), ",").alias("series"))


@query(f"""SELECT event_id, round(value, 2) AS value, {DAY} AS ts FROM events""")
def stamped_values(spark, sf_dir):
    text = F.concat(F.round("value", 2).cast("string"), F.lit("@"), F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy"))
    return _events(spark, sf_dir).select("event_id", T.split_stamped(text).alias("x")).select("event_id", "x.value", "x.ts")




@query(f"""WITH {_DAILY}, v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM d),
s AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM v GROUP BY 1),
c AS (SELECT a.user_id, a.i - b.i AS lag, sum((a.value - m) * (b.value - m)) AS c, any_value(n) AS n, any_value(sd) AS sd FROM v a JOIN v b ON a.user_id = b.user_id JOIN s ON s.user_id = a.user_id GROUP BY 1, 2)
SELECT user_id, round(sum(CASE WHEN sd > 0 THEN c / (sd * sd * n) ELSE c END) / any_value(least(2 * n - 1, 201)), 6) + 0 AS ccf FROM c WHERE abs(lag) <= 100 GROUP BY 1""")
def cross_correlation(spark, sf_dir):
    """Of each user's daily values with themselves."""
    s = T.sequences(_daily(spark, sf_dir), "user_id", "ts", "value").select("user_id", F.transform("series", lambda x: x["value"]).alias("v"))
    return T.correlation_features(s.withColumn("u", F.col("v")), ["user_id"], "v", "u")


_BOTH = f"""d AS (SELECT user_id, event_type AS label, {DAY} AS ts, round(sum(value), 2) AS value FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3),
s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM d GROUP BY 1), l AS (SELECT DISTINCT user_id, label FROM d),
g AS (SELECT user_id, label, unnest(range(a, b + 1, 86400)) AS t FROM s JOIN l USING (user_id)),
f AS (SELECT g.user_id, g.label, g.t, coalesce(d.value, 0.0) AS value FROM g ASOF LEFT JOIN d ON g.user_id = d.user_id AND g.label = d.label AND g.t >= d.ts)"""


@query(f"""WITH {_BOTH} SELECT user_id, coalesce(string_agg(printf('%.2f', value), ',' ORDER BY t) FILTER (label = 'click'), '') AS a, coalesce(string_agg(printf('%.2f', value), ',' ORDER BY t) FILTER (label = 'purchase'), '') AS b FROM f GROUP BY 1""")
def aligned_series(spark, sf_dir):
    """Daily clicks and purchases of each user from the first day of either to the last."""
    e = _events(spark, sf_dir)
    daily = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id", (F.floor(F.col("t") / 86400) * 86400).alias("ts")).agg(F.round(F.sum("value"), 2).alias("value"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.2f", x)), ",").alias(c)
    return T.align(daily("click"), daily("purchase"), "user_id", shared=True).select("user_id", shown("a"), shown("b"))


_CORR = f"""WITH d AS (SELECT user_id, event_type AS label, {DAY} AS ts, round(sum(value), 2) AS value FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY 1, 2, 3),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY ts) - 1 AS i FROM d),
s AS (SELECT user_id, label, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM v GROUP BY ALL),
u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS c FROM (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 2)),
x AS (SELECT a.user_id, a.label, u.c, a.i + (sb.n - 1) - b.i AS place, (a.value - sa.m) * (b.value - sb.m) AS p, sa.n AS na, sb.n AS nb, sa.sd AS da, sb.sd AS db FROM v AS a JOIN u ON true JOIN v AS b ON b.user_id = u.user_id AND b.label = a.label
JOIN s AS sa ON sa.user_id = a.user_id AND sa.label = a.label JOIN s AS sb ON sb.user_id = b.user_id AND sb.label = b.label),
y AS (SELECT user_id, label, c, sum(CASE WHEN da * db * nb > 0 THEN p / (da * db * nb) ELSE p END) FILTER (place BETWEEN (na + nb - 2) // 2 - 3 AND (na + nb - 2) // 2 + 3) AS total, any_value(na + nb - 1) AS width, any_value((na + nb - 2) // 2) AS centre FROM x GROUP BY ALL),
z AS (SELECT user_id, CASE label WHEN 'click' THEN 'D' WHEN 'purchase' THEN 'P' ELSE 'C' END AS k, c, round(total / (least(centre + 4, width) - greatest(0, centre - 3)), 6) + 0 AS ccf FROM y)
SELECT user_id, """ + ", ".join(f"max(ccf) FILTER (k = '{k}' AND c = {c}) AS {k}v{k}{c}c" for k in "DPC" for c in (1, 2)) + " FROM z GROUP BY 1"


@query(_CORR)
def three_sequence_features(spark, sf_dir):
    """Daily values of three kinds of event against those of the two users of smallest id."""
    kind = F.when(F.col("event_type") == "click", "D").when(F.col("event_type") == "purchase", "P").otherwise("C")
    e = _events(spark, sf_dir).where("event_type in ('click', 'purchase', 'error')")
    daily = e.groupBy("user_id", kind.alias("label"), (F.floor(F.col("t") / 86400) * 86400).alias("ts")).agg(F.round(F.sum("value"), 2).alias("value"))
    seq = daily.groupBy("user_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("values"))
    chosen = _events(spark, sf_dir).select("user_id").distinct().orderBy("user_id").limit(2).withColumn("centroid", F.row_number().over(Window.orderBy("user_id")))  # two rows
    return T.three_sequence_table(seq, seq.join(chosen, "user_id").select("label", "centroid", "values"), "user_id", lag=3)


@query(_CORR.replace("'click', 'purchase', 'error'", "'click', 'purchase'").replace("LIMIT 2", "LIMIT 3").replace("// 2 - 3 AND", "// 2 - 100 AND").replace("// 2 + 3)", "// 2 + 100)").replace("centre + 4", "centre + 101").replace("centre - 3", "centre - 100").split("\nSELECT user_id, ")[0]
    + """, b AS (SELECT user_id, max((event_type = 'signup')::INTEGER) AS class, count(*) AS n_events FROM events GROUP BY 1)
SELECT user_id, any_value(class) AS class, any_value(n_events) AS n_events, """
    + ", ".join(f"max(ccf) FILTER (k = '{k}' AND c = {c}) AS {name}_c{c}" for k, name in (("D", "click"), ("P", "purchase")) for c in (1, 2, 3))
    + " FROM z JOIN b USING (user_id) GROUP BY 1")
def temporal_features(spark, sf_dir):
    """Daily values of clicks and of purchases against those of the three users of smallest id, beside whether the user
    signed up (class) and how many events there are."""
    every = _events(spark, sf_dir)
    e = every.where("event_type in ('click', 'purchase')")
    daily = e.groupBy("user_id", F.col("event_type").alias("label"), (F.floor(F.col("t") / 86400) * 86400).alias("ts")).agg(F.round(F.sum("value"), 2).alias("value"))
    seq = daily.groupBy("user_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("values"))
    chosen = every.select("user_id").distinct().orderBy("user_id").limit(3).withColumn("centroid", F.concat(F.lit("c"), F.row_number().over(Window.orderBy("user_id")).cast("string")))  # three rows
    centroids = seq.join(chosen, "user_id").select("label", "centroid", "values")
    beside = every.groupBy("user_id").agg(F.max((F.col("event_type") == "signup").cast("int")).alias("class"), F.count("*").alias("n_events"))
    return T.feature_table(seq, centroids, "user_id", "label", "values", [f"{k}_c{c}" for k in ("click", "purchase") for c in (1, 2, 3)], beside=beside)
