"""Queries of the relational, set and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import graph, reports, setops
from quern.operators import tabular as T
from quern.plans.registry import query, table

_CUST = "array_value(c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)"


@query("SELECT c_custkey, coalesce(c_mktsegment, '') || chr(9) || coalesce(c_name, '') || chr(9) || coalesce(c_mktsegment, '') || chr(9) || '' AS line FROM customer")
def cut_fields(spark, sf_dir):
    """Fields 4, 2, 4 and 9 of four: order and repeats kept, the missing one empty."""
    c = table(spark, sf_dir, "customer")
    row = F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")
    return c.select("c_custkey", T.cut_fields(row, T.field_numbers("4,2 4 9")).alias("line"))


@query("SELECT r_regionkey, replace(r_regionkey::VARCHAR || ',' || r_name, ',', chr(9)) AS line FROM region")
def delim_convert(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", T.convert_delimiter(F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name"), ",").alias("line"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/[a-z]*[0-9]*[02468]$')")
def regex_line_filter(spark, sf_dir):
    return T.matching_lines(table(spark, sf_dir, "pages"), "url", "/[a-z]*[0-9]*[02468]$").select("page_id", "url")


@query("SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1) AS m1, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS m2 FROM customer WHERE regexp_matches(c_name, '([A-Za-z]+)#0*([0-9]+)')")
def regex_extract_groups(spark, sf_dir):
    return T.extract_matches(table(spark, sf_dir, "customer"), "c_name", "([A-Za-z]+)#0*([0-9]+)", 2).select("c_custkey", "m1", "m2")


_BUILDING = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


def _building(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN {_BUILDING}")
def filter_include(spark, sf_dir):
    return T.filter_rows(table(spark, sf_dir, "orders"), F.col("o_custkey"), _building(spark, sf_dir), "c_custkey").select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN {_BUILDING}")
def filter_exclude(spark, sf_dir):
    return T.filter_rows(table(spark, sf_dir, "orders"), F.col("o_custkey"), _building(spark, sf_dir), "c_custkey", exclude=True).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_extract(o_orderpriority, '^([0-9])-', 1) IN ('1', '5')")
def filter_regex_key(spark, sf_dir):
    cases = spark.createDataFrame([("1",), ("5",)], "case string")
    key = F.nullif(F.regexp_extract("o_orderpriority", "^([0-9])-", 1), F.lit(""))
    return T.filter_rows(table(spark, sf_dir, "orders"), key, cases, "case").select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, '') AS part_name, l_quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def insert_field(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return T.insert_field(rows, "l_partkey", table(spark, sf_dir, "part"), "p_partkey", "p_name", "part_name", 3).drop("l_partkey")


_LISTS = """a AS (SELECT o_custkey AS k, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT user_id AS k, list(event_id::VARCHAR ORDER BY event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


def _lists(spark, sf_dir):
    sorted_ = lambda df, k, i: df.groupBy(F.col(k).alias("k")).agg(F.transform(F.array_sort(F.collect_list(i)), lambda x: x.cast("string")).alias("v"))
    a = sorted_(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey")
    return a, sorted_(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id", "event_id")


@query(f"WITH {_LISTS} SELECT coalesce(a.k, b.k) AS k, array_to_string(list_concat(coalesce(a.v, []), coalesce(b.v, [])), ',') AS v FROM a FULL JOIN b ON a.k = b.k")
def merge_tables_full(spark, sf_dir):
    return T.merge_lists(*_lists(spark, sf_dir), "k", "v").withColumn("v", F.array_join("v", ","))


@query(f"WITH {_LISTS} SELECT a.k AS k, array_to_string(list_concat(a.v, coalesce(b.v, [])), ',') AS v FROM a LEFT JOIN b ON a.k = b.k")
def merge_tables_left(spark, sf_dir):
    return T.merge_lists(*_lists(spark, sf_dir), "k", "v", "left").withColumn("v", F.array_join("v", ","))


@query("SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n_orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_fill_features(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return T.with_features(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), f, "c_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def first_row_lookup(spark, sf_dir):
    return T.first_row_for(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH t AS (SELECT l_returnflag || '|' || l_linestatus AS label, l_returnflag AS cat, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2),
j AS (SELECT t.label, t.cat, t.v, r.v AS ref FROM t LEFT JOIN t AS r ON replace(t.label, t.cat, 'N') = r.label)
SELECT label, v, ref AS reference, CASE WHEN ref <> 0 THEN round((v - ref) / ref, 3) END AS diff FROM j""")
def relative_table(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("label"), F.col("l_returnflag").alias("cat")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    return T.relative_table(sums, "label", "cat", "v", "N").select("label", "v", "reference", "diff")


@query("""SELECT 0 AS position, 'n_name' AS name, string_agg(n_name, chr(9) ORDER BY n_nationkey) AS values FROM nation
UNION ALL SELECT 1, 'n_regionkey', string_agg(n_regionkey::VARCHAR, chr(9) ORDER BY n_nationkey) FROM nation""")
def transpose_table(spark, sf_dir):
    return T.transpose(table(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT n_nationkey, 'n_name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def unpivot_table(spark, sf_dir):
    return T.unpivot(table(spark, sf_dir, "nation"), ["n_nationkey"], ["n_name", "n_regionkey"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) THEN '.' ELSE l_returnflag END AS l_returnflag FROM lineitem")
def elide_repeats(spark, sf_dir):
    return T.elide_repeats(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT event_id FROM events WHERE ('0x' || substr(md5('s' || event_id), 1, 8))::BIGINT % 100 < 10")
def bernoulli_hash_sample(spark, sf_dir):
    return T.hash_sample(table(spark, sf_dir, "events"), "event_id", 10).select("event_id")


@query()
def bernoulli_sample(spark, sf_dir):
    return T.bernoulli_sample(table(spark, sf_dir, "events"), 0.1, 42).select("event_id")


@query("SELECT event_id, user_id FROM events")
def shuffle_rows(spark, sf_dir):
    """The order is random; as a set the rows are the table."""
    return T.shuffle_rows(table(spark, sf_dir, "events"), 42).select("event_id", "user_id")


@query("SELECT event_id, event_id % 3 AS split FROM events")
def split_round_robin(spark, sf_dir):
    return T.split_round_robin(table(spark, sf_dir, "events"), "event_id", 3).select("event_id", "split")


@query("SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM documents")
def kfold_split(spark, sf_dir):
    return T.fold_of(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def row_range(spark, sf_dir):
    return T.row_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 50)


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def top_weighted(spark, sf_dir):
    return T.top_weighted(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 20)


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def normalize_freq(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return T.normalize(counts, "n", []).withColumn("share", F.round("share", 6))


@query("SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER () = min(s_acctbal) OVER () THEN 1.0 ELSE (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) END, 6) AS scaled FROM supplier")
def minmax_normalize(spark, sf_dir):
    from quern.functions.scalars import min_max

    s = table(spark, sf_dir, "supplier")
    ends = s.agg(F.min("s_acctbal").alias("a"), F.max("s_acctbal").alias("b"))
    return s.crossJoin(F.broadcast(ends)).select("s_suppkey", F.round(min_max(F.col("s_acctbal"), F.col("a"), F.col("b")), 6).alias("scaled"))  # one row


@query("SELECT user_id, count_if(x) = 0 AS sorted FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts AS x FROM events) GROUP BY user_id")
def sortedness_check(spark, sf_dir):
    return T.is_sorted(table(spark, sf_dir, "events"), "ts", ["user_id"], ["event_id"])


@query("SELECT event_type, row_number() OVER (ORDER BY first) - 1 AS code FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)")
def feature_codes(spark, sf_dir):
    return T.feature_codes(table(spark, sf_dir, "events"), "event_type", "event_id").withColumn("code", F.col("code").cast("long"))


@query("""SELECT 'o_orderstatus' AS "column", count_if(o_orderstatus IS NULL)::BIGINT AS nulls, count(DISTINCT o_orderstatus) AS "distinct", min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders
UNION ALL SELECT 'o_custkey', count_if(o_custkey IS NULL)::BIGINT, count(DISTINCT o_custkey), min(o_custkey::VARCHAR), max(o_custkey::VARCHAR) FROM orders""")
def profile_table(spark, sf_dir):
    return T.profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"])


@query("SELECT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, count(*) AS n FROM pages GROUP BY 1")
def size_by_site(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.concat(F.split_part("url", F.lit("/"), F.lit(1)), F.lit("//"), F.split_part("url", F.lit("/"), F.lit(3))).alias("site")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT string_split(url, '/') AS p, length(html) AS s FROM pages)
SELECT array_to_string(p[1:i], '/') AS folder, sum(s)::BIGINT AS size, count(*) AS n FROM f, range(1, 20) t(i) WHERE i < len(p) GROUP BY 1""")
def size_rollup(spark, sf_dir):
    return reports.size_rollup(table(spark, sf_dir, "pages").withColumn("s", F.length("html").cast("long")), F.col("url"), "s")


# --- sets -----------------------------------------------------------------------------------------


def _keys(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return a, table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))


_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000"


@query(f"{_A} UNION {_B}")
def set_union(spark, sf_dir):
    return setops.union(*_keys(spark, sf_dir))


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf_dir):
    return setops.intersection(*_keys(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def set_difference(spark, sf_dir):
    return setops.difference(*_keys(spark, sf_dir))


@query(f"SELECT k FROM ({_A}) WHERE k NOT IN ({_B})")
def bag_difference(spark, sf_dir):
    return setops.difference(*_keys(spark, sf_dir), bag=True)


@query(f"{_A} EXCEPT ALL {_B}")
def bag_remove_all(spark, sf_dir):
    return setops.remove_all(*_keys(spark, sf_dir))


@query("""WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events), b AS (SELECT upper(event_type) AS x, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY 1)
SELECT event_id, event_type FROM a LEFT JOIN b ON upper(event_type) = x WHERE r > coalesce(n, 0)""")
def bag_remove_folded(spark, sf_dir):
    """Events without the first of each type for every event whose id four divides, the types of these in capitals."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return setops.remove_all_folded(e, e.where("event_id % 4 = 0").select(F.upper("event_type").alias("event_type")), "event_type", "event_id")


@query("""SELECT c_custkey, strpos(c_name, d) - 1 AS start, strpos(c_name, d) - 1 + length(d) AS "end" FROM (SELECT c_custkey, c_name, regexp_extract(c_name, '[1-9][0-9]*') AS d FROM customer) WHERE d <> ''""")
def regex_match_places(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", T.match_place(F.col("c_name"), "[1-9][0-9]*").alias("m")).where("m is not null")
    return c.select("c_custkey", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"))


@query("SELECT event_type, min(event_id) AS first FROM events WHERE event_type IS NOT NULL AND trim(event_type) <> '' GROUP BY 1")
def unique_ordered(spark, sf_dir):
    return setops.unique_ordered(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(f"SELECT NOT EXISTS ({_A} EXCEPT {_B}) AS subset, NOT EXISTS ({_A} EXCEPT {_B}) AND NOT EXISTS ({_B} EXCEPT {_A}) AS equivalent")
def set_equivalence(spark, sf_dir):
    return setops.equivalent(*_keys(spark, sf_dir))


# --- graphs ---------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey > 1)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("x"), F.expr("p_partkey div 2").alias("y"))


@query(f"WITH RECURSIVE {_EDGES}, c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x) SELECT x, y FROM c")
def transitive_closure(spark, sf_dir):
    return graph.transitive_closure(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, c AS (SELECT x, y, 1 AS d FROM e UNION SELECT c.x, e.y, d + 1 FROM c JOIN e ON c.y = e.x WHERE d < 3)
SELECT x AS node, y AS ancestor, min(d)::INTEGER AS distance FROM c GROUP BY 1, 2""")
def bounded_hypernyms(spark, sf_dir):
    return graph.ancestors(_edges(spark, sf_dir), "x", "y", 3)


# --- reports --------------------------------------------------------------------------------------


def _note_lines(spark, sf_dir):
    """A log of events as note files: a line with the date, then the events of that day."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    day = e.select(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("file"), F.date_format("ts", "d MMM yyyy").alias("raw"), F.to_date("ts").alias("d"), "event_id", "event_type")
    heads = day.select("file", "d", F.col("raw").alias("text"), F.lit(-1).cast("long").alias("event_id")).distinct()
    lines = heads.unionByName(day.select("file", "d", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), "event_id"))
    return lines.withColumn("line_num", F.row_number().over(Window.partitionBy("file").orderBy("d", "event_id"))).select("file", "line_num", "text")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%-d %b %Y') AS raw, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY 'f' || (user_id % 5), event_id) AS notes
FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2""")
def merge_notes(spark, sf_dir):
    return reports.merge_notes(_note_lines(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


def _sheet(spark, sf_dir, week: str = "x"):
    """Time sheets out of all order lines: a sheet a customer segment (o_custkey % 50), a day an order, a slot a line, a
    stated sum after it, a weekly line after orders that 7 divides."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).cast("string").alias("file"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("n")).join(o, "k")
    names = F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri")))
    line = lambda i, text: F.struct(i.cast("long").alias("i"), text.alias("text"))
    slot = lambda n: line(n, F.concat((n + 7).cast("string"), F.lit(":00 "), (n + 7).cast("string"), F.lit(":30 task")))
    day = F.array(line(F.lit(0), F.get(names, (F.col("k") % 5).cast("int"))))
    stated = F.array(line(F.lit(100), F.concat(F.lit("hours: "), (F.array_max("slots") / 2).cast("string"))))
    weekly = F.when(F.col("k") % 7 == 0, F.array(line(F.lit(101), F.lit(f"weekly: {week}")))).otherwise(F.array().cast("array<struct<i:bigint,text:string>>"))
    sheets = li.groupBy("file", "k").agg(F.collect_list("n").alias("slots"))  # an order's lines
    rows = sheets.select("file", "k", F.inline_outer(F.concat(day, F.transform("slots", slot), stated, weekly)))
    return rows.select("file", (F.col("k") * 128 + F.col("i")).alias("line_num"), "text")  # numbers in the order of the lines


_SHEET = """WITH s AS (SELECT (o_custkey % 50)::VARCHAR AS file, l_orderkey AS k, round(count(*) * 0.5, 2) AS hours, round(max(l_linenumber) / 2, 6) AS stated FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
d AS (SELECT file, coalesce(sum((k % 7 = 0)::INTEGER) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS week, row_number() OVER (PARTITION BY file ORDER BY k) AS day_num,
['mon', 'tue', 'wed', 'thu', 'fri'][k % 5 + 1] AS day, hours, stated, abs(hours - stated) < 0.005 AS matches FROM s)"""


@query(f"{_SHEET} SELECT file, week, day_num, day, hours, stated, matches FROM d")
def timesheet_rollup(spark, sf_dir):
    return reports.timesheet(_sheet(spark, sf_dir)).select("file", F.col("week").cast("long").alias("week"), "day_num", "day", "hours", "stated", "matches")


@query(f"""{_SHEET} SELECT file, week, sum(hours) FILTER (day = 'mon') AS mon, sum(hours) FILTER (day = 'tue') AS tue, sum(hours) FILTER (day = 'fri') AS fri, sum(hours) AS total FROM d GROUP BY 1, 2""")
def timesheet_weeks(spark, sf_dir):
    return reports.weekly_pivot(reports.timesheet(_sheet(spark, sf_dir))).select("file", F.col("week").cast("long").alias("week"), "mon", "tue", "fri", "total")


@query(f"""{_SHEET}, w AS (SELECT file, week, round(sum(hours), 2) AS hours FROM d GROUP BY 1, 2), last AS (SELECT file, max(week) AS last FROM (SELECT file, week + (k7)::INTEGER AS week FROM (SELECT file, coalesce(sum((k % 7 = 0)::INTEGER) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS week, k % 7 = 0 AS k7 FROM s)) GROUP BY 1),
m AS (SELECT file, 'day' AS level, day_num AS part, hours, stated FROM d UNION ALL SELECT file, 'week', week, hours, 20.0 FROM w JOIN last USING (file) WHERE week < last)
SELECT file, level, part::BIGINT AS part, hours::DOUBLE AS hours, stated::DOUBLE AS stated, level || ' ' || part || ' has ' || hours::DOUBLE || ' hours, ' || stated::DOUBLE || ' stated' AS message FROM m WHERE abs(hours - stated) >= 0.005""")
def timesheet_messages(spark, sf_dir):
    """Days and weeks whose stated sums differ from their slots; every week states twenty hours."""
    return reports.sheet_messages(_sheet(spark, sf_dir, "20"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, 'f' || (user_id % 5) AS file, event_type || ' ' || event_id AS text FROM events WHERE event_type IN ('error', 'signup')""")
def dated_note_lines(spark, sf_dir):
    return reports.dated_lines(_note_lines(spark, sf_dir)).select(F.col("date").cast("string").alias("date"), "file", "text")


@query("""SELECT k AS row, name, coalesce(value, 'n/a') AS value FROM (SELECT n_nationkey::BIGINT AS k, n_name::VARCHAR AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation) UNPIVOT (value FOR name IN (n_name, n_regionkey))""")
def transposed_cells(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name", "n_regionkey")
    return T.transposed_cells(t, "k", ["n_name", "n_regionkey"]).select("row", "name", "value")


_TRIPLES = "t AS (SELECT DISTINCT 'c' || o_custkey AS subj, o_orderpriority AS rel, 'o' || o_orderkey AS obj FROM orders)"


@query(f"WITH {_TRIPLES} SELECT subj, rel, obj FROM (SELECT *, row_number() OVER (PARTITION BY subj ORDER BY rel, obj) AS r FROM t WHERE rel IN ('1-URGENT', '2-HIGH')) WHERE r <= 3")
def triples_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    triples = o.select(F.concat(F.lit("c"), "o_custkey").alias("subj"), F.col("o_orderpriority").alias("rel"), F.concat(F.lit("o"), "o_orderkey").alias("obj"))
    return reports.filter_triples(triples, None, spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "relation string"), 3)


@query("""SELECT event_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN false WHEN event_type = 'signup' THEN true END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) WHERE s AND event_type <> 'signup'""")
def section_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file"), F.col("event_id").alias("line_num"), F.col("event_type").alias("text"))
    return reports.section(e, "^signup$", "^error$").select("event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def column_subset(spark, sf_dir):
    return T.select_existing(table(spark, sf_dir, "orders"), ["o_orderkey", "no_such", "o_orderstatus"])


@query("SELECT n_nationkey, coalesce(r_name, n_regionkey::VARCHAR) AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def id_remapping(spark, sf_dir):
    m = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("old"), F.col("r_name").alias("new"))
    return T.remap_ids(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("region")), "region", m)


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def numeric_summary(spark, sf_dir):
    return T.summary(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('42' || user_id::VARCHAR), user_id LIMIT 5")
def random_centroids(spark, sf_dir):
    return T.random_keys(table(spark, sf_dir, "events"), "user_id", 5, 42)


@query("SELECT l_shipdate::DATE::VARCHAR || chr(9) || count(*) AS line FROM lineitem GROUP BY l_shipdate::DATE ORDER BY count(*) DESC, l_shipdate::DATE LIMIT 20")
def frequency_listing(spark, sf_dir):
    return T.frequency_listing(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("d")), "d", 20)


@query("""WITH t AS (SELECT event_id, event_type AS a, (event_id % 3)::VARCHAR AS b FROM events), f AS (SELECT a, row_number() OVER (ORDER BY min(event_id)) - 1 AS c FROM t GROUP BY a)
SELECT event_id, f.c::DOUBLE AS a, CASE WHEN b = '0' THEN 0.0 ELSE b::DOUBLE END AS b FROM t JOIN f USING (a)""")
def coded_features(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("a"), (F.col("event_id") % 3).cast("string").alias("b"))
    return T.coded_features(e, "event_id", ["a", "b"])
