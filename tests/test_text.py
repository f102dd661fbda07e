"""Column functions against cases of known result."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markup, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


def test_fold_plural(spark):
    cases = {"transformers": "transformer", "gas": "gas", "class": "class", "bus": "bus", "laws": "law"}
    assert {w: one(spark, text.fold_plural("w"), w=w) for w in cases} == cases


def test_anchor_terms(spark):
    assert set(one(spark, text.anchors("q"), q="latest research on transmission matrix engineering")) == {"transmission", "matrix", "engineering"}
    assert one(spark, text.anchors("q"), q="what is the") == []
    assert one(spark, text.anchors("q"), q="gpt4 models") == ["gpt", "model"]


@pytest.mark.parametrize(
    ("query", "kept"),
    [("real-time transmission matrix characterization", True), ("adaptive optics for imaging 2023", False), ("inverse scattering theory", False), ("transmission matrices and engineering of matrix", True)],
)
def test_on_topic(spark, query, kept):
    assert one(spark, text.on_topic("a", "b"), a=query, b="transmission matrix engineering") is kept


def test_on_topic_without_anchors(spark):
    assert one(spark, text.on_topic("a", "b"), a="anything", b="what is it") is True


@pytest.mark.parametrize(
    ("question", "recent"),
    [("latest work on lasers", True), ("state of the art in imaging", True), ("Newton second law", False), ("research since 2025", True), ("the 1998 proof", False), ("тренды в оптике", True), ("what is entropy", False), (None, False)],
)
def test_recency(spark, question, recent):
    assert one(spark, text.wants_recent("q", 2026), q=question) is recent


@pytest.mark.parametrize(
    ("raw", "label"),
    [
        ("Title: A study of light in fibres | Authors: many", "A study of light in fibres"),
        ("[Share](http://x) | [Email](mailto:y)", ""),
        ("**Deep** learning of everything\nsecond line", "Deep learning of everything"),
        ("Share", ""),
        (None, ""),
        ("![logo](http://a/b.png) A readable heading here", "A readable heading here"),
    ],
)
def test_label(spark, raw, label):
    assert one(spark, text.label("t"), t=raw) == label


def test_label_is_cut_on_a_word(spark):
    out = one(spark, text.label("t"), t="word " * 60)
    assert out.endswith("…") and len(out) <= 111 and not out[:-1].endswith(" ")


@pytest.mark.parametrize(
    ("theme", "heading"),
    [("error rates and sources", "Error rates and sources"), ("### 1. error rates", "Error rates"), ("- error rates.", "Error rates"), ("2) Error rates:", "Error rates"), ("qLDPC codes", "qLDPC codes"), ("mRNA vaccines", "mRNA vaccines"), ("", ""), ("  ", "")],
)
def test_tidy_theme(spark, theme, heading):
    assert one(spark, text.tidy_theme("t"), t=theme) == heading


def test_canonical_url(spark):
    key = lambda u: one(spark, text.canonical_url("u"), u=u)
    assert key("https://arxiv.org/abs/2410.08315v2") == key("http://www.arxiv.org/pdf/2410.08315") == "arxiv:2410.08315"
    assert key("https://a.org/p/?utm_source=x&id=3") == key("http://a.org/p?id=3#top") == "a.org/p?id=3"
    assert key("https://a.org/p?id=3") != key("https://a.org/p?id=4")
    assert key("https://x.org/doi/10.1103/PhysRevX.1.2") == key("https://y.com/10.1103/physrevx.1.2/pdf") == "doi:10.1103/physrevx.1.2"


def test_host(spark):
    assert one(spark, text.host_of("u"), u="https://WWW.Example.org:8080/a?b") == "example.org"
    assert one(spark, text.host_of("u"), u="no url") == ""


def test_title_key(spark):
    keys = [set(one(spark, text.title_key("t"), t=t)) for t in ("Light in fibres of glass - arXiv", "[PDF] Light in fibres of glass", "(PDF) Light in fibres of glass")]
    assert keys[0] == keys[1] == keys[2] == {"light", "in", "fibres", "of", "glass"}
    assert one(spark, text.title_key("t"), t="Adaptive Optics") == []


def test_stem(spark):
    cases = {"tuning": "tun", "tuned": "tun", "tunes": "tun", "tune": "tun", "red": "red", "was": "was"}
    assert {w: one(spark, text.stem("w"), w=w) for w in cases} == cases


@pytest.mark.parametrize(
    ("message", "kind"),
    [
        ("Error code: 402 - this request requires more credits", "billing"),
        ("Error code: 402 - in-flight requests reserve credit", "transient"),
        ("429 RESOURCE_EXHAUSTED", "rate_limit"),
        ("the model is overloaded", "transient"),
        ("no structured output", "transient"),
        ("bad schema", "other"),
    ],
)
def test_error_kind(spark, message, kind):
    assert one(spark, text.error_kind("m"), m=message) == kind


def test_ids_without_fences(spark):
    raw = "Adam converges [evidence_id: 72cacfe-cb0a-4d2e-9f1b-0a1b2c3d4e5f]. On 2024-01-02 v1.2.3 came."
    assert one(spark, markup.strip_ids("t"), t=raw) == "Adam converges. On 2024-01-02 v1.2.3 came."
    assert one(spark, text.id_leak("t"), t=raw) == "evidence_id"
    assert one(spark, text.id_leak("t"), t="clean") is None


def test_shortfall_and_counts(spark):
    assert one(spark, text.shortfall("p", "m", "r"), p="too_thin", m=" more ", r="") == "The answer was on topic but too thin. It needed: more"
    assert one(spark, text.shortfall("p", "m", "r"), p="else", m="", r="why") == "The answer was judged insufficient. It needed: why"
    assert one(spark, text.counted(F.col("n").cast("int"), "search"), n="2") == "2 searches"
    assert one(spark, text.counted(F.col("n").cast("int"), "page"), n="1") == "1 page"
    assert one(spark, text.short_host("u"), u="https://www.a.org/x") == "a.org"


def test_readable_quote(spark):
    assert one(spark, text.readable_quote("t"), t="a<br>b<BR/>c\nd\ne\nf") == "a\nb\nc\nd\ne"
