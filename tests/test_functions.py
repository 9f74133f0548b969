import hashlib
import random
from html import entities, unescape

import pytest
from pyspark.sql import functions as F

from qaforge.functions import html, paging, text, urls, variants
from qaforge.schema import checked_page, normalise_threshold, offered_threshold

SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first()["x"]


def many(spark, expression, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expression.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def plain_chunks(t, size, overlap):
    out, start = [], 0
    while start < len(t):
        out.append(t[start : start + size])
        start += size - overlap
    return out


@pytest.mark.parametrize(
    ("n", "size", "overlap", "lengths"),
    [(1500, 1000, 200, [1000, 700]), (2000, 500, 0, [500] * 4), (1000, 300, 50, [300, 300, 300, 250]), (11, 1000, 200, [11]), (1000, 1000, 200, [1000, 200]), (0, 1000, 200, []), (10000, 5000, 1000, [5000, 5000, 2000])],
)
def test_chunk_sizes(spark, n, size, overlap, lengths):
    assert [len(c) for c in one(spark, text.chunks(F.col("t"), size, overlap), t="x" * n)] == lengths


def test_chunks_of_code_points(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("aé𝔘🎉\n ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    assert many(spark, text.chunks(F.col("t"), 7, 3), values) == [plain_chunks(v, 7, 3) for v in values]
    with pytest.raises(ValueError):
        text.chunks(F.col("t"), 5, 5)


def test_white_space_is_pythons(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice([*SPACES, "a", "​", "b"]) for _ in range(12)) for _ in range(200)] + [None, ""]
    assert many(spark, text.collapse(F.col("t")), values) == [None if v is None else " ".join(v.split()) for v in values]
    assert many(spark, text.strip(F.col("t")), values) == [None if v is None else v.strip() for v in values]


def test_content_id(spark):
    got = one(spark, text.content_id(F.col("q"), F.col("c"), F.col("u")), q="What is Python?", c="Python is a high-level programming language.", u="https://example.com")
    assert got == "dd79e7cacbcd90095f7c72a94b2634e73b2b7ed0eeea12adedf8ac4357e4df80"
    spaced = one(spark, text.content_id(F.col("q"), F.col("c"), F.col("u")), q="  What is\n Python? ", c=" Python is a  high-level programming language.", u="https://example.com")
    assert spaced == got
    assert one(spark, text.content_id(F.lit(None).cast("string"), F.col("c"), F.lit(None).cast("string")), c="x") == hashlib.sha256(b"|x|").hexdigest()


def test_names_and_truncation(spark):
    names = ["my_dataset.json", "test dataset.json", "/path/to/my_file.json", "dataset_name", "v1.2_x", ".hidden"]
    assert many(spark, text.dataset_name(F.col("t")), names) == ["my-dataset", "test-dataset", "my-file", "dataset-name", "v1", ".hidden"]
    assert many(spark, text.truncated(F.col("t"), 3), ["abc", "abcd", None]) == ["abc", "abc...", None]
    assert one(spark, text.parsed_list(F.col("t"), ["d"]), t=" a, b ,c") == ["a", "b", "c"]
    assert one(spark, text.parsed_list(F.lit(None).cast("string"), ["d"]), t="") == ["d"]
    assert many(spark, text.default(F.col("t"), "d"), ["", None, "x"]) == ["d", "d", "x"]
    assert one(spark, text.enum_name(F.col("t")), t="a-b-c") == "a_b_c"


def test_urls(spark):
    base = ["https://e.org", "https://e.org/", "https://e.org/a", "", None]
    assert many(spark, urls.base_url(F.col("t")), base) == ["https://e.org/", "https://e.org/", "https://e.org/a/", "", ""]
    assert one(spark, urls.joined(F.col("b"), F.col("e")), b="https://e.org/a", e="/x/y") == "https://e.org/a/x/y"
    for bad in ("e.org/x", "https://"):
        with pytest.raises(Exception, match="Invalid URL"):
            one(spark, urls.base_url(F.col("t")), t=bad)
    assert one(spark, urls.picked_agent(F.col("t"), []), t="u").startswith("Mozilla")
    assert one(spark, urls.picked_agent(F.col("t"), ["a", "b"]), t="u") in "ab"


PAGE = "<html><head><title>T</title><STYLE>p{}</STYLE><script>var a = '<p>no</p>';</script></head><body class='x'><!-- gone\n --><h1>Head</h1><p>foo<b>bar</b> &amp;lt; &quot;q&quot;</p>\n<br><p>a  b</p></body></html>"


def test_html(spark):
    want = 'Head foo bar &lt; "q" a b'
    assert one(spark, html.page_text(F.col("t")), t=PAGE) == want
    assert one(spark, html.page_text_exact(F.col("t")), t=PAGE) == want
    assert one(spark, html.page_text(F.col("t")), t="<body></body>") == ""
    assert one(spark, html.page_text_exact(F.col("t")), t="no body &#233; <i>x") == "no body é x"


#: Pages on which the HTML standard and Python's parser agree.
ODD_PAGES = [
    PAGE, '<html><body class="a>b">x<p title=\'q > r\'>y</p>z', "no body &#233; <i>x", "a < b and c<3d", "", "<body></body>", None,
    "<body>a&amp;b &lt;i&gt; &copy &copyx; &notit; &nbsp;| &#x41;&#66 &#0; &#128; &#xD800; &#99999999; &#13;&#xFEFF;z &unknown; & &;",
    "<body>a<!-- x > y -->b", 'x<script>if (a<b) "</p>"</script >b<style>p{}', "<body>one</body>two", "<head><title>t</title></head>text<br/>more", "x</head>y",
    '<BODY>U<ScRiPt src="a>b">no</SCRIPT>V', "<body>a<!doctype x>b<?php echo 1 ?>c</3>d", '<body><a href="x=y&amp;z">l</a><img alt="<b>">i', "<body><a b='1' c=\"2>3\" d=4 e>t</a>",
    "<body>&lt;script&gt;no&lt;/script&gt;", "<p>x<body>y<body>z</body>w<p>v", "&AMP;&ampx&LT;", "<body>a\x00b", "<body>é🎉 &#127881; &bull;&hellip; &#x1F389", "<scripty>shown</scripty><styles>too</styles>",
    '<body>a</scriptx>b</p ">">c', "<body>\n a\t\tb\xa0\u3000c \n</body>", "<body>x<a title='it=\"s' b>y</a>", "<body><p>" + "word &amp; <b>x</b> " * 3000, "<body><a " + "k='v>' " * 2000 + ">t</a>",
]


def test_text_of_any_page(spark):
    """The native form equals the parser on odd pages, and no Python is in its plan."""
    df = spark.createDataFrame(list(enumerate(ODD_PAGES)), "i int, t string")
    got = df.select("i", html.any_page_text(F.col("t")).alias("native"), html.page_text_exact(F.col("t")).alias("exact")).orderBy("i").collect()
    assert [r["native"] for r in got] == [r["exact"] for r in got]
    assert "Python" not in df.select(html.any_page_text(F.col("t")))._jdf.queryExecution().toString()
    # What a page ends in is no text, as the standard has it.
    for page, want in (("<body>a <b", "a"), ("<body>a<!-- x", "a"), ("<body>a<!-->b<!--->c-->d", "a b c-->d"), ("&lt;<body", "<")):
        assert one(spark, html.any_page_text(F.col("t")), t=page) == want


def test_closed_references(spark):
    """Only references with a semicolon are decoded, as the queries' SQL has it."""
    cases = [("<title>x</title><body>and&amp</b> &amp;&am &copy; &copy 2", "and&amp &&am © &copy 2"), ("a&#65 &#65;&#x42;&#x42 &#0;&notit; &;&", "a&#65 AB&#x42 \ufffd&notit; &;&"), ("<body><a href='?a=1&amp=2'>&lt;b&gt</a>", "<b&gt"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = df.select("i", html.any_page_text(F.col("t"), closed=True).alias("native"), html.page_text_closed(F.col("t")).alias("exact")).orderBy("i").collect()
    assert [r["native"] for r in got] == [r["exact"] for r in got] == [want for _, want in cases]
    odd = spark.createDataFrame(list(enumerate(ODD_PAGES)), "i int, t string").select(html.any_page_text(F.col("t"), closed=True).alias("native"), html.page_text_closed(F.col("t")).alias("exact"))
    assert all(r["native"] == r["exact"] for r in odd.collect())


def test_references(spark):
    rng = random.Random(2)
    names = [*rng.sample(sorted(entities.html5), 200), "bogus;", "ampersand", "#", "#x", "#x;", "#0", "#00065;", "#x000041", "#xFFFE;", "#127;", "#150;", "#1114112;", "#9", "#12;", "#11;"]
    texts = ["".join(f"&{rng.choice(names)}{rng.choice(['', ' ', 'x', ';', '1', 'z'])}" for _ in range(6)) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", html.unescaped(F.col("t")).alias("u")).collect()
    assert {r["i"]: r["u"] for r in got} == {i: unescape(t) for i, t in enumerate(texts)}


def test_variants(spark):
    cases = [
        ('{"a":null,"c":[1,"x",null]}', "null", None, ["1", "x", None]), ('{"b":1,"c":0}', "missing", "default", []), ("not json", "missing", "default", []), (None, "missing", "default", []),
        ('{"a":"s","c":"one"}', "string", "s", ["one"]), ('{"a":1.5,"c":""}', "number", "1.5", []), ('{"a":true,"c":false}', "boolean", "true", []), ('{"a":[1],"c":{"q":1}}', "array", None, ['{"q":1}']),
        ('{"a":{},"c":[]}', "object", None, []), ("[1]", "missing", "default", []), ('{"a":"","c":true}', "string", "", ["true"]), ('{"a":' + '"x' + "y" * 50_000 + '"}', "string", "x" + "y" * 50_000, []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("v", variants.parsed(F.col("t")))
    v = F.col("v")
    rows = df.select("i", variants.kind(variants.value(v, "$.a")).alias("k"), variants.field(v, "$.a", "string", F.lit("default")).alias("f"), variants.items(variants.value(v, "$.c")).cast("array<string>").alias("c"), variants.field(v, "$.a", "double", F.lit(7.0)).alias("d")).orderBy("i").collect()
    assert [(r["k"], r["f"], r["c"]) for r in rows] == [c[1:] for c in cases]
    assert [r["d"] for r in rows][:6] == [None, 7.0, 7.0, 7.0, None, 1.5]


def test_offered_thresholds():
    assert [offered_threshold(x) for x in (0, 0.1, 0.12, 0.13, 0.9, 0.97, 0.98, 1, 7, "0.5", "x", float("nan"))] == [0.1, 0.1, 0.1, 0.15, 0.9, 0.95, 1.0, 1.0, 1.0, 0.5, 0.9, 1.0]


def test_threshold_and_page():
    assert [normalise_threshold(x) for x in ("invalid", None, 1.5, -0.5, "0.7", float("nan"))] == [0.9, 0.9, 1.0, 0.0, 0.7, 1.0]
    assert checked_page(1000, 0) == (1000, 0)
    for bad in ((2000, 0), (0, 0), (10, -1)):
        with pytest.raises(ValueError):
            checked_page(*bad)


@pytest.mark.parametrize(("current", "pages", "want"), [(1, 1, "1"), (3, 7, "1 2 3 4 5 6 7"), (1, 10, "1 2 ... 10"), (5, 10, "1 ... 4 5 6 ... 10"), (9, 10, "1 ... 8 9 10"), (10, 10, "1 ... 9 10"), (3, 8, "1 2 3 4 ... 8")])
def test_visible_pages(spark, current, pages, want):
    assert one(spark, F.array_join(paging.visible_pages(F.col("c"), F.col("p")), " "), c=current, p=pages) == want


def test_page_numbers(spark):
    assert one(spark, paging.current_page(F.col("o"), F.col("l")), o=20, l=10) == 3
    assert one(spark, paging.total_pages(F.col("o"), F.col("l")), o=21, l=10) == 3
    assert one(spark, paging.offset_of(F.col("o"), F.col("l")), o=3, l=10) == 20
