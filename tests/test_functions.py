import random
import re
from difflib import SequenceMatcher

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from graphloom.functions.grams import phrase_join, substring_join
from graphloom.functions.match import highlight, match_text, valid_pattern
from graphloom.functions.ordered import dense_index, last_known, top_per
from graphloom.functions.text import file_stem, has_component, strip, suffix
from graphloom.functions.urls import parse_repo_url
from helpers import bag

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_strip_and_paths(spark):
    assert one(spark, strip(F.col("t")), t="　 a b\t\n") == "a b"
    assert one(spark, suffix(F.col("t")), t="a.b/c.tar.gz") == ".gz"
    assert one(spark, suffix(F.col("t")), t=".env") == ""
    assert one(spark, file_stem(F.col("t")), t="x/main.test.py") == "main.test"
    assert one(spark, has_component(F.col("t"), ["env"]), t="env/a.md")
    assert not one(spark, has_component(F.col("t"), ["env"]), t="environment.md")


def test_repo_urls(spark):
    cases = {
        "https://github.com/o/r": ("o", "r"), "https://github.com/o/r.git": ("o", "r"),
        "git@github.com:o/r.git": ("o", "r"), "o/r": ("o", "r"), " https://github.com/o/r/ ": ("o", "r"),
        "nothing": None, "http://example.org/a/b": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    for row in df.select("url", parse_repo_url(F.col("url")).alias("r")).collect():
        want = cases[row.url]
        assert (row.r is None) if want is None else (row.r.owner, row.r.name) == want
        assert want is None or row.r.url == "https://github.com/o/r"


def test_match_precedence(spark):
    df = spark.createDataFrame([("UserService",), ("user",), ("A user here",), ("usr",), (None,), ("",)], "t string")
    got = {r.t: r.m for r in df.select("t", match_text(F.col("t"), "User", fuzzy=True).alias("m")).collect()}
    assert (got["user"].score, got["user"].match_type) == (1.0, "exact")
    assert (got["A user here"].match_type, got["A user here"].start, got["A user here"].end) == ("contains", 2, 6)
    ratio = SequenceMatcher(None, "user", "usr").ratio()
    assert got["usr"].match_type == "fuzzy" and abs(got["usr"].score - ratio * 0.7) < 1e-12
    assert got[None] is None and got[""] is None


def test_fuzzy_equals_difflib(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r.t: r.m for r in df.select("t", match_text(F.col("t"), "abcde", fuzzy=True).alias("m")).collect()}
    for word in words:
        if word == "abcde" or "abcde" in word:
            continue
        ratio = SequenceMatcher(None, "abcde", word).ratio()
        assert (got[word] is not None) == (ratio >= 0.6)
        if got[word]:
            assert abs(got[word].score - ratio * 0.7) < 1e-12


def test_bad_pattern_falls_through(spark):
    assert not valid_pattern(spark, "[a")
    df = spark.createDataFrame([("x[ab",)], "t string")
    assert df.select(match_text(F.col("t"), "[a", use_regex=True).alias("m")).first().m.match_type == "contains"


def test_highlight(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2), (4, 5)])], "t string, r array<struct<start:int,end:int>>")
    assert df.select(highlight(F.col("t"), F.col("r")).alias("h")).first().h == "a[b]cd[e]f"


@SLOW
@given(st.lists(st.text("ab ", min_size=0, max_size=14), min_size=1, max_size=8),
       st.lists(st.text("ab ", min_size=1, max_size=10), min_size=1, max_size=8, unique=True))
def test_substring_join_equals_brute_force(spark, texts, needles):
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = bag(substring_join(t, "text", n, "needle", ["id"]), "id", "needle")
    assert got == sorted(((i, x) for i, s in enumerate(texts) for x in needles if x in s), key=repr)


@SLOW
@given(st.lists(st.text("ab_数据 .-", min_size=0, max_size=12), min_size=1, max_size=8),
       st.lists(st.text("ab_数据 .-", min_size=2, max_size=7), min_size=1, max_size=8, unique=True))
def test_phrase_join_equals_brute_force(spark, texts, names):
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")

    def stands(name, text):
        return re.search(r"(?<![a-zA-Z0-9_])" + re.escape(name) + r"(?![a-zA-Z0-9_])", text)

    got = bag(phrase_join(t, "text", n, "name", ["id"]), "id", "name")
    assert got == sorted(((i, x) for i, s in enumerate(texts) for x in names if stands(x, s)), key=repr)


def test_phrase_join_takes_names_literally(spark):
    t = spark.createDataFrame([(1, r"see a\e+b now"), (2, "see axeb now")], "id int, text string")
    n = spark.createDataFrame([(r"a\e+b",), (r"a\E+b".lower(),)], "name string").distinct()
    assert [r.id for r in phrase_join(t, "text", n, "name", ["id"]).collect()] == [1]


def test_last_known_equals_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumns({
        "b0": F.floor(F.col("i") / 7), "b1": F.floor(F.col("i") / 70),
    })
    for inclusive in (True, False):
        frame = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumn("x", F.last("v", ignorenulls=True).over(frame))
        got = last_known(df, ["k"], "i", "v", "x", ["b0", "b1"], inclusive)
        assert bag(got, "k", "i", "x") == bag(want, "k", "i", "x")


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v"), "id")
    got = dense_index(df, ["g", "v", "id"], "n", within="g")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    assert bag(got, "id", "n") == bag(want, "id", "n")


def test_top_per_limits_before_the_shuffle(spark):
    plan = top_per(spark.range(100).withColumn("g", F.col("id") % 2), ["g"], ["id"], 3)
    assert plan.count() == 6
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_regex_ranges(spark):
    cases = [("concat cat", r"\bcat", 7, 10), ("abab", "b$", 3, 4), ("xay", "(?<=x)a", 1, 2), ("aXbXX", r"(X)\1", 3, 5), ("abc", "x*", 0, 0), ("ab", "$", 2, 2)]
    for text, pattern, start, end in cases:
        row = spark.createDataFrame([(text,)], "t string").select(match_text(F.col("t"), pattern, use_regex=True).alias("m")).first()
        assert (row.m.match_type, row.m.start, row.m.end) == ("regex", start, end), (text, pattern)


def test_strip_takes_unicode_white_space_from_the_ends(spark):
    """The same as the pattern it stands for, for every character of the first plane, without searching the text for it."""
    ch = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    texts = spark.range(1 << 16).where("id not between 55296 and 57343").select(
        F.explode(F.array(ch, F.concat(ch, F.lit("a  b"), ch), F.concat(F.lit(" \n"), ch, F.lit("x"), ch, F.lit("y\t\r\n")))).alias("t"))
    both = texts.select(strip(F.col("t")).alias("now"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("pattern"))
    assert both.where(~F.col("now").eqNullSafe(F.col("pattern"))).count() == 0
    assert "regexp" not in texts.select(strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
