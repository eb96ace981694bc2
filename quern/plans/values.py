"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars as C
from quern.plans.registry import query, table

_SCRIPT = "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


def _sql_replace(expr: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return expr


_UNESCAPE = [(b, a) for a, b in reversed(C.ENTITIES)]
_TEXT = _sql_replace(f"regexp_replace(regexp_replace(html, '(?is){_SCRIPT[4:]}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')", _UNESCAPE)


@query(f"SELECT page_id, trim(regexp_replace({_TEXT}, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.html_to_text(F.col("html")).alias("text"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']', 1)) AS link FROM pages""")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(C.html_links(F.col("html"))).alias("link"))


@query("""WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<img\\s[^>]*>')) AS t FROM pages),
s AS (SELECT page_id, url, regexp_extract(t, '(?is)\\ssrc=["'']([^"'']*)["'']', 1) AS s FROM t WHERE NOT regexp_matches(t, '(?i)display:\\s*none|\\shidden[\\s>]'))
SELECT page_id, CASE WHEN regexp_matches(s, '^[a-zA-Z]+:') THEN s WHEN starts_with(s, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || s
ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '([^/])/[^/]*$', '\\1/') || s END AS image FROM s WHERE s <> ''""")
def html_images(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(C.html_images(F.col("html"), F.col("url"))).alias("image"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS script FROM pages")
def script_bodies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.script_bodies(F.col("html")).alias("script"))


@query("""SELECT page_id, regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) || 'function f(a) {}',
'(function\\s+([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\([^)]*\\)\\s*\\{)', '\\1 console.debug("in \\2");', 'g') AS script FROM pages""")
def trace_functions(spark, sf_dir):
    body = F.concat(C.script_bodies(F.col("html")), F.lit("function f(a) {}"))
    return table(spark, sf_dir, "pages").select("page_id", C.trace_functions(body).alias("script"))


@query("""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html || '<table><tr><td>cat 1</td><td>10</td></tr></table>', '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS r FROM pages)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(""" + _sql_replace("regexp_replace(c, '(?s)<[^>]*>', ' ', 'g')", _UNESCAPE) + """, '[ \\t\\r\\n]+', ' ', 'g'))), chr(9)) AS line FROM r""")
def html_table_rows(spark, sf_dir):
    """Rows of tables, of one appended to each page at least."""
    html = F.concat("html", F.lit("<table><tr><td>cat 1</td><td>10</td></tr></table>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(C.html_rows(html)).alias("line"))


@query("""SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host,
regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, coalesce(nullif(regexp_extract(url || '?q=on&n=3', '[?&]n=([^&#]*)', 1), ''), '0') AS n, 'True' AS q FROM pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    with_query = F.concat(url, F.lit("?q=on&n=3"))
    return table(spark, sf_dir, "pages").select("page_id", *[C.url_part(url, p).alias(p) for p in ("scheme", "host", "path")], C.url_param(with_query, "n", "0").alias("n"), C.url_param(with_query, "q").alias("q"))


@query(f"SELECT item_id, {_sql_replace('text', list(C.ENTITIES))} AS escaped, text AS back FROM benchmark")
def escape_html(spark, sf_dir):
    e = C.escape_html(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", e.alias("escaped"), C.unescape_html(e).alias("back"))


@query("SELECT n_name, replace(url_encode(n_name || ' & co'), '%20', '+') AS quoted, n_name || ' & co' AS back FROM nation")
def quote_url(spark, sf_dir):
    q = C.quote_url(F.concat("n_name", F.lit(" & co")))
    return table(spark, sf_dir, "nation").select("n_name", q.alias("quoted"), C.unquote_url(q).alias("back"))


@query("""SELECT p_partkey, p_size, (p_size > 1 AND len(list_filter(range(2, p_size), lambda d: p_size % d = 0)) = 0) AS prime FROM part""")
def prime_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", C.is_prime(F.col("p_size")).alias("prime"))


@query("WITH RECURSIVE f AS (SELECT 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT b, a + b FROM f WHERE b < 10000) SELECT a AS fib FROM f WHERE a < 10000")
def fibonacci(spark, sf_dir):
    return spark.sql("WITH RECURSIVE f(a, b) AS (SELECT 0L, 1L UNION ALL SELECT b, a + b FROM f WHERE b < 10000) SELECT a AS fib FROM f WHERE a < 10000")


@query("""SELECT p_partkey, (p_size::VARCHAR || '.' || lpad((p_partkey % 37)::VARCHAR, 4, '0') || lpad((p_partkey % 11)::VARCHAR, 4, '0'))::DOUBLE AS version FROM part""")
def version_number(spark, sf_dir):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 37).cast("string"), (F.col("p_partkey") % 11).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", C.version_number(v).alias("version"))


@query("""SELECT p_partkey, unnest([p_brand, p_type, p_size::VARCHAR]) AS item FROM part""")
def string_list(spark, sf_dir):
    text = F.concat(F.col("p_brand"), F.lit(", '"), F.col("p_type"), F.lit("' "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(C.string_list(text)).alias("item"))


@query("SELECT event_id, coalesce(try_cast(regexp_extract(props, ':\\s*(-?[0-9]+)', 1) AS BIGINT), 0) AS number, event_type NOT IN ('error') AS flag, -1.0 AS bad, true AS symbolic FROM events")
def safe_cast(spark, sf_dir):
    number = F.regexp_extract("props", r":\s*(-?[0-9]+)", 1)
    flag = C.to_bool(F.when(F.col("event_type") == "error", F.lit("FALSE")).otherwise(F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", C.to_int(number).alias("number"), flag.alias("flag"), C.to_double(F.concat("event_type", F.lit("12d")), -1.0).alias("bad"), C.is_symbolic(F.col("event_type")).alias("symbolic"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS even, printf('%.3f', l_discount) AS fixed, regexp_replace(printf('%.3f', l_tax), '\\.?0+$', '') AS trimmed FROM lineitem""")
def rounding(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.round_places(F.col("l_extendedprice"), 0).alias("even"), C.fixed_places(F.col("l_discount")).alias("fixed"), C.fixed_places(F.col("l_tax"), 3, True).alias("trimmed"))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS short, NOT regexp_matches(text, '\\s') AS solid, regexp_matches(lang, '(?i)^[a-z]+$') AS simple FROM documents")
def elide_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.elide(F.col("text"), 20).alias("short"), C.has_no_spaces(F.col("text")).alias("solid"), C.is_simple_name(F.col("lang")).alias("simple"))


@query("""SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, CASE WHEN contains(list_extract(string_split(url, '/'), -1), '.') THEN list_extract(string_split(list_extract(string_split(url, '/'), -1), '.'), -1) ELSE '' END AS ext,
CASE WHEN ends_with(url, '0') THEN substr(url, 1, length(url) - 1) ELSE url END AS chomped FROM pages""")
def file_names(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", C.basename(u).alias("base"), C.extension(u).alias("ext"), C.chomp(u, "0").alias("chomped"))


@query("SELECT r_regionkey, 'region ' || r_regionkey || ' is ' || r_name AS filled, '    ' || r_name || chr(10) || '    x' AS indented, rtrim(regexp_replace(lower(hex(encode(r_name))), '(..)', '\\1 ', 'g')) AS dump FROM region")
def fill_template(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    filled = C.fill_template("region {key} is {name}", key=F.col("r_regionkey"), name=F.col("r_name"))
    return r.select("r_regionkey", filled.alias("filled"), C.indent(F.concat("r_name", F.lit("\nx"))).alias("indented"), C.hex_dump(F.col("r_name")).alias("dump"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(char, '^\\p{{{c}}}$') THEN '{c}'" for c in C.CATEGORIES if c != "Cs") + " ELSE 'Cn' END"


@query("""WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS char FROM benchmark WHERE text <> '')
SELECT item_id, """ + _CATEGORY + """ AS category, (pos - 1)::INTEGER AS pos, char, lower(hex(encode(char))) AS utf8, 'U+' || lpad(lower(to_hex(unicode(char))), 4, '0') AS code_point, (sum(strlen(char)) OVER (PARTITION BY item_id ORDER BY pos) - strlen(char))::BIGINT AS byte_at FROM c""")
def unicode_char_info(spark, sf_dir):
    from pyspark.sql import Window

    info = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(C.code_point_info(F.col("text"))).alias("pos", "x")).select("item_id", "pos", "x.*")
    w = Window.partitionBy("item_id").orderBy("pos")
    return info.withColumn("byte_at", F.sum(F.octet_length("char")).over(w) - F.octet_length("char")).withColumn("category", C.category(F.col("char")))


@query("""SELECT o_orderkey, epoch(o_orderdate::DATE)::BIGINT AS a, epoch(o_orderdate::DATE)::BIGINT AS b, 0::BIGINT AS c, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders""")
def parse_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = lambda p: F.date_format("o_orderdate", p)
    return o.select("o_orderkey", C.parse_timestamp(stamp("yyyy-MM-dd")).alias("a"), C.parse_timestamp(stamp("M/d/yyyy")).alias("b"), C.parse_timestamp(stamp("yyyy MM")).alias("c"), C.resolve_date(stamp("EEE d MMM yyyy")).cast("string").alias("d"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 12 AS a, 1 + l_suppkey % 12 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s > 0 THEN s END AS hours FROM (SELECT *, round(CASE WHEN b < a + 0.25 THEN b + 12 - a - 0.25 ELSE b - a - 0.25 END, 6) AS s FROM h)""")
def interval_hours(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = (1 + F.col("l_partkey") % 12).cast("string"), (1 + F.col("l_suppkey") % 12).cast("string")
    return li.select("l_orderkey", "l_linenumber", F.round(C.clock_hours(F.concat(a, F.lit(":15")), b), 6).alias("hours"))


@query("""WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT o_custkey, len(p) AS n, array_to_string(list_sort(list_filter(p, lambda x: x <> '1-URGENT')), ',') AS rest, list_contains(p, '1-URGENT') AS urgent, (list_contains(s, 'F')::INTEGER + list_contains(s, 'O')::INTEGER) = 1 AS one, len(p) + (NOT list_contains(p, 'new'))::BIGINT AS appended FROM a""")
def array_sets(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    urgent = F.array(F.lit("1-URGENT"))
    has = lambda x: F.array_contains("s", x)
    return a.select(
        "o_custkey",
        F.size("p").cast("long").alias("n"),
        F.array_join(F.array_sort(C.difference_bag(F.col("p"), urgent)), ",").alias("rest"),
        C.is_subset(urgent, F.col("p")).alias("urgent"),
        C.just_one([has("F"), has("O")]).alias("one"),
        F.size(C.append_new(F.col("p"), F.lit("new"))).cast("long").alias("appended"),
    )
