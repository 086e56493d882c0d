import hashlib

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.functions.fold import clean_tag, fold_accents
from folioscan.sources.readers import chapter_keys


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()[0]


c = F.col


@pytest.mark.parametrize(
    ("value", "want"),
    [("Étale Foo_bar 000B", ["tale", "foo_bar", "000b"]), ("", []), (None, []), ("概形", [])],
)
def test_tokenize(spark, value, want):
    assert one(spark, X.tokenize(c("a")), a=value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [(r"$f : X \to \Spec(A)$", "f : X to Spec (A)"), (r"\mathcal{F}_x^2", "F x 2"), (r"\top", "to p"), (None, ""), (r"\alpha\beta", "alpha beta")],
)
def test_normalize_math(spark, value, want):
    assert one(spark, X.normalize_math(c("a")), a=value) == want


def test_tag_refs(spark):
    assert one(spark, X.tag_refs(c("a")), a="/tag/01AB /tag/0002 /tag/01AB") == ["01AB", "0002"]


@pytest.mark.parametrize(
    ("s", "f", "want"),
    [("A", "A B", "B"), ("A", "C", "C"), ("A", "A", ""), ("A", "", ""), ("", "B", "B"), (None, None, "")],
)
def test_split_proof(spark, s, f, want):
    assert one(spark, X.split_proof(c("s"), c("f")), s=s, f=f) == want


def test_html_to_text():
    assert X.plain_text("<p>a &amp; b</p><!-- c --><div>d<br>e</div>") == "a & b\n\nd\ne"
    assert X.plain_text("<script>x</script>y") == "xy"
    assert X.plain_text("<script>x</script>y", keep_scripts=False) == "y"
    assert X.plain_text(None) == ""


def test_env_and_label(spark):
    assert one(spark, X.env_hint(c("l"), c("k")), l="spaces-limits-lemma-x", k="spaces-limits") == "lemma"
    assert one(spark, X.env_hint(c("l"), c("k")), l="lemma", k="other") == "lemma"
    assert one(spark, X.env_type(c("h"), c("e")), h='<a class="env-Lemma">', e="x") == "lemma"
    assert one(spark, X.env_type(c("h"), c("e")), h="", e="") == "unknown"


def test_structure(spark):
    assert one(spark, X.structure_fields(c("a"))["reference"], a=' {"reference": "1.2"} ') == "1.2"
    assert one(spark, X.structure_fields(c("a"))["reference"], a="This tag does not have a structure.") is None


def test_hash_and_lines(spark):
    want = hashlib.sha256(b"a\n\nb").hexdigest()
    assert one(spark, X.content_hash(c("a"), c("n"), c("b")), a="a", n=None, b="b") == want
    assert one(spark, X.lines(c("a"), c("n"), c("b")), a="a", n="", b="b") == "a\nb"


@pytest.mark.parametrize(
    ("value", "want"), [("概形 的 定义", "概形 的 定义 scheme definition"), ("x", "x")]
)
def test_expand_query(spark, value, want):
    assert one(spark, X.expand_query(c("a")), a=value) == want


def test_lists_and_slugs(spark):
    assert one(spark, X.slug(c("a")), a="__A b/c.") == "a_b_c"
    assert one(spark, X.slug(c("a")), a="??") == "unnamed"
    assert one(spark, X.k_values(c("a")), a="10, 1,3,1") == [1, 3, 10]
    assert one(spark, X.csv_values(c("a"), lower=True, default=("z",)), a=" B,a,b ") == ["b", "a"]
    assert one(spark, X.csv_values(c("a"), default=("z",)), a=" , ") == ["z"]
    assert one(spark, X.metric(F.create_map(F.lit("m"), c("a")), "m"), a="x") == 0.0
    assert one(spark, X.metric(F.create_map(F.lit("m"), c("a")), "m"), a="0.5") == 0.5


def test_cuts(spark):
    long = "word " * 100
    short = one(spark, X.short_text(c("a"), 20), a=long)
    assert short == "word word word wo..."
    assert one(spark, X.snippet(c("a"), 10), a="ab\ncdefghijkl") == "ab cdef..."
    assert one(spark, X.clean_snippet(c("a")), a="<b>x</b>&nbsp;y") == "x y"
    names = F.split(c("a"), ";")
    assert one(spark, X.format_authors(names, 2), a="A; B ;;C") == "A, B, et al."
    assert one(spark, X.format_authors(names, 3), a="A; B") == "A, B"


@pytest.mark.parametrize(
    ("value", "want"),
    [(" /tag/ab12 ", "AB12"), ("#AB12 ", "AB12"), ("  ", None), (None, None), ("YOP", "YOP"), ("/tag/#x1y2", "X1Y2"), ("\u3000a b\u00a0", "A B")],
)
def test_clean_tag(spark, value, want):
    assert one(spark, clean_tag(c("a")), a=value) == want


def test_fold(spark):
    assert one(spark, fold_accents(c("a")), a="Étàle é İß") == "etale e iß"


def test_makefile():
    text = "X = 1\nLIJST = a b \\\n c # no\n d\n"
    assert chapter_keys(text) == ["a", "b", "c"]
    assert chapter_keys("x") == []
    assert chapter_keys("LIJST = a \\\n\n b") == ["a"]


def test_html_by_the_engine_is_as_by_python(spark):
    """Whole tags and text are read by the engine, the rest by Python; both give the same."""
    sources = ["<p>a</p><div>b<br/>c</div> d", "x<h2 class='a>b'>t</h2>\n \n<li>y", "<b>i</b>  <a href=\"/x\">z</a>\t", "a &amp; b", "1 < 2", "<!-- c -->e", "<SCRIPT>if (a<b)</SCRIPT>f", "<p", "", "<table><tr><td>1</td></tr></table>", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string")
    got = dict(df.select("i", X.html_to_text("s")).collect())
    assert got == {i: X.plain_text(s) for i, s in enumerate(sources)}
