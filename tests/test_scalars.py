from pyspark.sql import functions as F

from quern.functions import scalars as C
from quern.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(x):
    return F.lit(x)


def test_numbers(spark):
    one = lambda c: value(spark, c)
    assert one(C.is_numeric(lit("1e3"))) and one(C.is_numeric(lit("-.5"))) and not one(C.is_numeric(lit("12d"))) and not one(C.is_numeric(lit("1_0")))
    assert not one(C.is_numeric(lit(None).cast("string")))
    assert one(C.to_double(lit("x"), 7.0)) == 7.0 and one(C.to_int(lit("ff"), 0, 16)) == 255 and one(C.to_int(lit("1.5"))) == 0
    assert one(C.to_bool(lit("FALSE"))) is False and one(C.to_bool(lit("no"))) is True
    assert [n for n in range(30) if one(C.is_prime(lit(n)))] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert one(C.round_places(lit(2.5), 0)) == 2.0 and one(C.fixed_places(lit(1.5), 3, True)) == "1.5"
    assert abs(one(C.version_number(lit("1.11.1"))) - 1.00110001) < 1e-12


def test_strings(spark):
    one = lambda c: value(spark, c)
    assert one(C.chomp(lit("a/\n"))) == "a/" and one(C.elide(lit("abcdef"), 3)) == "abc..." and one(C.elide(lit("abc"), 3)) == "abc"
    assert one(C.string_list(lit("a, 'b c' d"))) == ["a", "b c", "d"] and one(C.int_list(lit("1, x 3"))) == [1, 0, 3]
    assert one(C.basename(lit("/x/y.tar"), ".tar")) == "y" and one(C.extension(lit("/x.d/y"))) == ""
    assert one(C.hex_dump(lit("é"))) == "c3 a9" and one(C.indent(lit("a\nb"), "  ")) == "  a\n  b"
    assert one(C.tabs_for_spaces(lit("a   b c"))) == "a\tb\tc"
    info = one(C.code_point_info(lit("a¡😀")))
    assert [x["code_point"] for x in info] == ["U+0061", "U+00a1", "U+1f600"] and info[1]["utf8"] == "c2a1"
    assert one(C.fill_template("{a}-{b}", a=lit(1), b=lit(None).cast("string"))) == "1-"


def test_html_and_urls(spark):
    one = lambda c: value(spark, c)
    assert one(C.unescape_html(C.escape_html(lit("a<b & \"c\" 'd' &lt;")))) == "a<b & \"c\" 'd' &lt;"
    page = lit("<html><script>x<y</script><style>p{}</style><p>A &amp; <b>b</b></p><!-- no --></html>")
    assert one(C.html_to_text(page)) == "A & b" and one(C.script_bodies(page)) == "x<y"
    images = one(C.html_images(lit("<img src='a.png'><img src='/b.png' style='display:none'><img src=\"/c.png\"><img src='http://h/d.png'>"), lit("http://site/x/y.html")))
    assert images == ["http://site/x/a.png", "http://site/c.png", "http://h/d.png"]
    assert one(C.html_rows(lit("<table><tr><td>cat 1</td><td>10</td></tr><tr><td>cat 2</td><td>20</td></tr></table>"))) == ["cat 1\t10", "cat 2\t20"]
    assert one(C.quote_url(lit("Joe's hat"))) == "Joe%27s+hat" and one(C.unquote_url(lit("Joe%27s+hat"))) == "Joe's hat"
    assert one(C.url_param(lit("http://h/p?a=on&b=2"), "a")) == "True" and one(C.url_param(lit("http://h/p"), "a", "d")) == "d"
    assert "console.debug" in one(C.trace_functions(lit("function f(a) { return a; }")))


def test_dates(spark):
    one = lambda c: value(spark, c)
    assert one(C.parse_timestamp(lit("1/1/2001"))) == 978307200 == one(C.parse_timestamp(lit("2001-01-01"))) and one(C.parse_timestamp(lit("x"))) == 0
    assert str(one(C.resolve_date(lit("Thu 13 Nov 14")))) == "2014-11-13" and str(one(C.resolve_date(lit("13 Nov 2014")))) == "2014-11-13"
    assert str(one(C.resolve_date(lit("?")))) == "1900-01-01"
    assert one(C.clock_hours(lit("9:30"), lit("11:30"))) == 2.0 and one(C.clock_hours(lit("11"), lit("1:15"))) == 2.25


def test_arrays(spark):
    one = lambda c: value(spark, c)
    a, b = F.array(*map(lit, "ACME Rocket Research".split())), F.array(*map(lit, "Rocket Research Labs".split()))
    assert one(C.overlap(a, b)) == "Rocket Research" and one(C.overlap(b, a)) == ""
    assert one(C.ngrams(a, 1, 2)) == ["ACME", "Rocket", "Research", "ACME Rocket", "Rocket Research"]
    assert one(C.is_subset(F.array(lit(1)), F.array(lit(1), lit(2)))) and one(C.difference_bag(F.array(lit(1), lit(2), lit(1)), F.array(lit(2)))) == [1, 1]
    assert one(C.just_one([lit(True), lit(False)])) and not one(C.just_one([lit(True), lit(True)])) and one(C.just_one([lit(False)], strict=False))
    assert one(C.append_new(F.array(lit(1)), lit(2))) == [1, 2] and one(C.nth(a, 5)) is None


def test_text(spark):
    one = lambda c: value(spark, c)
    assert one(X.words(lit("My dog, ¡hola!"))) == ["my", "dog", "hola"]
    assert one(X.tokens(lit("It's fine."))) == ["It", "'", "s", "fine", "."]
    assert one(X.sentences(lit("Dr. Watson is here. Elementary! Yes?"))) == ["Dr. Watson is here.", "Elementary!", "Yes?"]
    assert one(X.tag_class(lit("VBG"), lit("DT"))) == "noun" and one(X.tag_class(lit("VBG"))) == "verb" and one(X.tag_class(lit(","))) == "punctuation"
    assert one(X.pieces_for(X.words(lit("a b c d")), 5)) == ["[CLS]", "a", "b", "c", "[SEP]"]
