"""Text, vector and page functions against worked examples."""

from pyspark.sql import functions as F

from lectern.functions import html
from lectern.functions import text as T
from lectern.functions.vectors import cosine, normalized


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert [one(spark, x, T.normalize_token) for x in ("Íñigo", "T.V.E.", "Perú")] == ["inigo", "tve", "peru"]
    assert one(spark, "T.V.E. Norte", T.name_words) == ["T.V.E.", "Norte"]
    assert one(spark, "Museo del Canal y Puerto Viejo", T.name_words) == "Museo del Canal y Puerto Viejo".split()


def test_initials(spark):
    assert one(spark, "FF.AA.", T.initials_variants) == ["ffaa", "fa"]
    assert one(spark, "FF. AA.", T.is_plural_initials) and not one(spark, "Banco", T.is_plural_initials)
    assert one(spark, "a", T.shingles) == [] and set(one(spark, "Abc", T.shingles)) == {"ab", "bc"}


def test_categories_and_text(spark):
    assert tuple(one(spark, "Economía > Finanzas", T.split_category)) == ("Economía", "Finanzas")
    assert tuple(one(spark, "Mundo", T.split_category)) == ("Mundo", None)
    assert one(spark, "## A\n\n**b** [c](d)\n> e", T.plain_text) == "A\n\nb c\ne"
    assert one(spark, "a `b` c\n\n\n\n>\u00a0d  e \n", T.plain_text) == "a b c\n\nd e" and one(spark, None, T.plain_text) == ""
    assert one(spark, "# No\nOne two three four five. Six seven.", T.simple_sentences) == ["One two three four five."]
    assert [one(spark, x, T.ensure_period) for x in ("a", "a.", "a»")] == ["a.", "a.", "a»"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(cosine(F.col("a"), F.col("b")).alias("c"), normalized(F.col("z")).alias("z"), cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert abs(r.c - 0.96) < 1e-12 and r.z == [0.0, 0.0] and r.n is None


def test_pages(spark):
    page = "<html><body><nav>x</nav><article><h1 style='a'>T</h1><p class='k'><strong>lluvia </strong>fina<!-- c --></p><p></p><div class='component'>no</div><ul><li>uno</li></ul></article></body></html>"
    assert html.markdown(page) == "# T\n\n**lluvia** fina\n\n- uno."
    assert "nav" not in html.clean_html(page) and "style" not in html.clean_html(page) and "<p></p>" not in html.clean_html(page)
    assert html.site_date("mar. 3, 2021 | 9:40 p. m.") == "2021-03-03T21:40:00-04:00" and html.site_date("x") == "" and html.site_date("xyz 1, 2024") == "2024-01-01T00:00:00-04:00"
    full = "<body><h1>T</h1><div class='subtitle'><p>S</p></div><time id='detail-datetime'><a>Lima</a> mar. 3, 2021</time><div class='detail-body'><p>B</p></div><ul class='breadcrumb'><li>0</li><li>A</li><li>B</li></ul></body>"
    got = html.fields(full)
    assert (got["title"], got["subtitle"], got["location"], got["content"], got["category"], got["author"]) == ("T", "S", "Lima", "B", "A/B", None)
    df = spark.createDataFrame([(page,), (None,), ("",), ("<p>open",)], "p string")
    out = [r.m for r in df.select(html.markdown_column(F.col("p")).alias("m")).collect()]
    assert out[1] is None and out[2] == "" and df.select(html.fields_column(F.col("p")).alias("f")).first().f.title == "T"


def test_annotated_sentences(spark):
    s = ["One (a) two.", "Three.", "Four five.", "Six."]
    text = "\n".join(["# H", *s])
    rows = [(text, s, ["core", None, "secondary"]), (None, s, ["core"]), ("", s, ["core"]), (text, [], ["core"]), (text, ["not there", "Three."], ["filler", "filler"])]
    df = spark.createDataFrame(rows, "c string, s array<string>, k array<string>")
    got = [r.a for r in df.select(T.annotated(F.col("c"), F.col("s"), F.col("k")).alias("a")).collect()]
    assert got[0].text == "# H\n<strong>One (a) two.</strong>\n[^2]\nFour five.\n[^1]" and [tuple(n) for n in got[0].notes] == [(2, "Three."), (1, "Six.")]
    assert got[1:4] == [None] * 3
    assert got[4].text == text.replace("Three.", "[^1]") and [tuple(n) for n in got[4].notes] == [(2, "not there"), (1, "Three.")]
