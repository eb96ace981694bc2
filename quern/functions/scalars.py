"""Column functions on strings, numbers and arrays. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: sign, digits with an optional point, optional exponent.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"


# --- numbers --------------------------------------------------------------------------------------


def is_numeric(text: Column) -> Column:
    """True if the text reads as a number; false for null."""
    return F.coalesce(text.rlike(NUMBER), F.lit(False))


def is_symbolic(text: Column) -> Column:
    return ~is_numeric(text)


def to_double(text: Column, default: float = 0.0) -> Column:
    """The text as a double, or the default where it is no number."""
    return F.coalesce(F.when(is_numeric(text), F.trim(text).try_cast("double")), F.lit(default))


def to_int(text: Column, default: int = 0, base: int = 10) -> Column:
    """The text as a long in the given base, or the default."""
    if base != 10:
        digits = "0-9a-zA-Z"
        return F.coalesce(F.when(text.rlike(rf"^[{digits}]+$"), F.conv(text, base, 10).try_cast("long")), F.lit(default))
    return F.coalesce(F.when(text.rlike(INTEGER), F.trim(text).try_cast("long")), F.lit(default))


def to_bool(text: Column) -> Column:
    """False only for `false` in any case and `0`."""
    return ~F.lower(text).isin("false", "0")


def round_places(x: Column, places: int = 6) -> Column:
    """Rounded half to even, as exact ties ask for."""
    return F.bround(x, places)


def fixed_places(x: Column, places: int = 3, trim: bool = False) -> Column:
    """The number as text with fixed places, trailing zeros cut on request."""
    out = F.format_string(f"%.{places}f", x)
    return F.regexp_replace(out, r"\.?0+$", "") if trim else out


def is_prime(n: Column) -> Column:
    """True for primes; trial division by the odd numbers up to the root."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("int")
    odd = F.when(root >= 3, F.sequence(F.lit(3), root, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return (n == 2) | ((n > 2) & (n % 2 != 0) & F.forall(odd, lambda d: n % d != 0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x in [0, 1] between low and high; 1 where they are equal."""
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low))


# --- strings --------------------------------------------------------------------------------------


def chomp(text: Column, tail: str = "\n") -> Column:
    """Without one trailing separator."""
    return F.when(F.endswith(text, F.lit(tail)), F.left(text, F.length(text) - len(tail))).otherwise(text)


def tabs_for_spaces(text: Column) -> Column:
    """Runs of blanks become one tab."""
    return F.regexp_replace(text, " +", "\t")


def elide(text: Column, most: int) -> Column:
    """Cut to `most` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def indent(text: Column, by: str = "    ") -> Column:
    """Every line indented."""
    return F.regexp_replace(text, "(?m)^", by)


def basename(path: Column, suffix: str = "") -> Column:
    """What follows the last slash, less the suffix."""
    name = F.substring_index(path, "/", -1)
    return chomp(name, suffix) if suffix else name


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one."""
    return F.regexp_extract(basename(path), r"\.([^.]*)$", 1)


def has_no_spaces(text: Column) -> Column:
    return ~text.rlike(r"\s")


def is_simple_name(text: Column) -> Column:
    return text.rlike("(?i)^[a-z]+$")


def hex_dump(text: Column) -> Column:
    """Lower-case hex of the UTF-8 bytes, blank between bytes."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(F.encode(text, "UTF-8"))), "(..)", "$1 "))


def fill_template(template: str, **values: Column) -> Column:
    """The template with {name} replaced by the text of the named columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def version_number(version: Column, places: int = 3) -> Column:
    """1.11.1 -> 1.00010001: the parts after the first padded to four digits each, `places` parts in all."""
    parts = F.split(F.regexp_extract(version, r"^([0-9]+(\.[0-9]+)*)", 1), r"\.")
    tail = F.concat(*[F.lpad(F.coalesce(F.get(parts, F.lit(i)), F.lit("0")), 4, "0") for i in range(1, places)])
    return F.concat(F.get(parts, F.lit(0)), F.lit("."), tail).try_cast("double")


def string_list(text: Column) -> Column:
    """Parts between blanks or commas; quoted parts may hold either."""
    found = F.regexp_extract_all(text, F.lit(r"'[^']*'|\"[^\"]*\"|[^\s,'\"]+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^['\"]|['\"]$", ""))


def int_list(text: Column, default: int = 0) -> Column:
    return F.transform(string_list(text), lambda x: to_int(x, default))


def code_point_info(text: Column) -> Column:
    """array<struct<char, utf8, code_point>> of the characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    digits = lambda c: F.lower(F.conv(code(c).cast("string"), 10, 16))
    return F.transform(
        chars,
        lambda c: F.struct(c.alias("char"), F.lower(F.hex(F.encode(c, "UTF-8"))).alias("utf8"), F.concat(F.lit("U+"), F.when(F.length(digits(c)) < 4, F.lpad(digits(c), 4, "0")).otherwise(digits(c))).alias("code_point")),
    )


# --- URLs and HTML --------------------------------------------------------------------------------


def quote_url(text: Column) -> Column:
    return F.url_encode(text)


def unquote_url(text: Column) -> Column:
    return F.try_url_decode(text)


#: Characters that HTML escapes, and their entities; the ampersand comes first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column) -> Column:
    for char, entity in ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescape_html(text: Column) -> Column:
    for char, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def url_param(url: Column, name: str, default: str = "") -> Column:
    """A query parameter's value; `on` reads as True."""
    value = F.coalesce(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return F.when(value == "on", F.lit("True")).when(value == "", F.lit(default)).otherwise(value)


def url_part(url: Column, part: str) -> Column:
    """scheme, host or path of a URL."""
    pattern = {"scheme": r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", "host": r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", "path": r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"}[part]
    return F.regexp_extract(url, pattern, 1)


def html_to_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; entities resolved, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape_html(text), r"[ \t\r\n]+", " "))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))


def html_images(html: Column, base: Column) -> Column:
    """Sources of visible images, made absolute against the page's address."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))
    shown = F.filter(tags, lambda t: ~t.rlike(r"(?i)display:\s*none|\shidden[\s>]"))
    source = F.filter(F.transform(shown, lambda t: F.regexp_extract(t, r"(?is)\ssrc=[\"']([^\"']*)[\"']", 1)), lambda s: s != "")
    site = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"([^/])/[^/]*$", "$1/")
    return F.transform(source, lambda s: F.when(s.rlike("^[a-zA-Z]+:"), s).when(F.startswith(s, F.lit("/")), F.concat(site, s)).otherwise(F.concat(folder, s)))


def script_bodies(html: Column) -> Column:
    """The bodies of script elements, joined by newlines."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")


def trace_functions(script: Column) -> Column:
    """A trace statement after the head of every named function of a script."""
    return F.regexp_replace(script, r"(function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*\{)", r'$1 console.debug("in $2");')


def html_rows(html: Column) -> Column:
    """Rows of tables: array of the cells' texts, joined by tabs."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), html_to_text)
    return F.transform(rows, lambda r: F.array_join(cells(r), "\t"))


# --- dates ----------------------------------------------------------------------------------------


def parse_timestamp(text: Column) -> Column:
    """Seconds since the epoch of yyyy-m-d or m/d/yyyy; 0 for anything else."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-M-d"))), F.unix_timestamp(F.try_to_timestamp(text, F.lit("M/d/yyyy"))), F.lit(0)).cast("long")


def resolve_date(text: Column, default: str = "1900-01-01") -> Column:
    """The date of `[weekday] day month year` with a year of two or four digits, or the default."""
    plain = F.regexp_replace(F.trim(text), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+", "")
    short = F.when(plain.rlike(r"\s[0-9]{2}$"), F.try_to_date(plain, "d MMM yy"))
    long = F.when(plain.rlike(r"\s[0-9]{4}$"), F.try_to_date(plain, "d MMM yyyy"))
    return F.coalesce(short, long, F.lit(default).cast("date"))


def clock_hours(begin: Column, end: Column) -> Column:
    """Hours between h[:mm] times; an end before the begin is half a day later; null outside (0, 24]."""

    once = lambda x, f: F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))  # noqa: E731  an expression used again is worked out again

    def hours(t: Column) -> Column:
        return F.regexp_extract(t, r"^([0-9]{1,2})", 1).cast("double") + F.coalesce(F.nullif(F.regexp_extract(t, r":([0-9]{2})$", 1), F.lit("")).cast("double"), F.lit(0.0)) / 60

    both = F.struct(once(begin, hours).alias("a"), once(end, hours).alias("b"))
    span = once(both, lambda x: F.when(x["b"] < x["a"], x["b"] + 12 - x["a"]).otherwise(x["b"] - x["a"]))
    return once(span, lambda x: F.when((x > 0) & (x <= 24), x))


# --- arrays ---------------------------------------------------------------------------------------


def nth(items: Column, n: int) -> Column:
    return F.get(items, F.lit(n))


def difference_bag(a: Column, b: Column) -> Column:
    """Items of a that aren't in b, order and repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def append_new(items: Column, item: Column) -> Column:
    """The item at the end unless it is there."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def just_one(flags: list[Column], strict: bool = True) -> Column:
    """Exactly one flag is true; at most one if not strict."""
    total = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    return total == 1 if strict else total <= 1


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of low to high words as texts."""
    one = lambda n: F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(low, high + 1)])


def overlap(a: Column, b: Column) -> Column:
    """The longest run of words that ends a and begins b, as text; empty if there is none."""
    most = F.least(F.size(a), F.size(b))
    runs = F.filter(F.sequence(F.lit(0), most), lambda k: (k > 0) & (F.slice(a, F.size(a) - k + 1, F.greatest(k, F.lit(0))) == F.slice(b, F.lit(1), k)))
    return F.coalesce(F.array_join(F.slice(b, F.lit(1), F.array_max(runs)), " "), F.lit(""))


def unzip(pairs: Column, names: list[str]) -> list[Column]:
    """The arrays that an array of structs was zipped from."""

    def field(n: str) -> Column:
        return F.transform(pairs, lambda x: x[n]).alias(n)

    return [field(n) for n in names]


def parse_weights(line: Column) -> Column:
    """struct<doc, weights map<term, weight>> of a report line `docid=... tfidf=[term:weight term:weight]`; null for
    other lines. The last colon of an entry ends its term."""
    pattern = r"docid=(.*?)\s+tfidf=\[(.*)\]"
    entries = F.filter(F.split(F.regexp_extract(line, pattern, 2), r"\s+"), lambda e: F.contains(e, F.lit(":")))
    pairs = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r"^(.*):[^:]*$", 1).alias("key"), F.substring_index(e, ":", -1).try_cast("double").alias("value")))
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("doc"), F.map_from_entries(pairs).alias("weights")))


#: Names of Unicode's general categories by the class that a pattern knows them by.
CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co", "Cs")


def category(char: Column) -> Column:
    """The general category of a character, `Cn` for an unassigned one."""
    out = F.lit("Cn")
    for c in reversed(CATEGORIES):
        out = F.when(char.rlike("^\\p{" + c + "}$"), F.lit(c)).otherwise(out)
    return out
