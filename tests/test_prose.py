"""Prose and its markup against cases of known result."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markup, prose, text
from lodestone.operators import passages
from lodestone.operators.passages import passages_of


def ask(spark, function, *cases):
    """What a column function makes of texts, or of tuples of texts; null gives null."""
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    names = [f"c{k}" for k in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    found = {r.i: r.x for r in df.select("i", function(*names).alias("x")).collect()}
    return [found[i] for i in range(len(cases))]


def test_fences_stay(spark):
    diagram = "```\nA\n   |\n   v\n```"
    out = ask(spark, markup.strip_ids, f"one  two\n{diagram}\nthree  four")[0]
    assert diagram in out and "one two" in out and "three four" in out
    loud = ask(spark, lambda c: markup.outside_fences(c, F.upper), "x\n```\ny", "x", "", None, "a\n```\nb\n``` c\nd\n  ```\ne", "```\nb\r\n```\r\nc")
    assert loud == ["X\n```\ny", "X", "", None, "A\n```\nb\n``` c\nD\n  ```\ne", "```\nb\r\n```\r\nC"]


def test_ids(spark):
    cases = {
        "Adam 72cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f converges": "Adam converges",
        "It holds (evidence_ids: aaaa-bb-cc-dd-ee, x).": "It holds.",
        "It holds [evidence_id: 72cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f].": "It holds.",
        "So (evidence id 72cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f and 82cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f) it is": "So it is",
        "See evidence_ids: 72cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f, 82cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f , and more": "See, and more",
        "On 2024-01-02 v1.2.3 came": "On 2024-01-02 v1.2.3 came",
        "both 72cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f and , then ( ) none": "both, then none",
        "": "",
    }
    assert dict(zip(cases, ask(spark, markup.strip_ids, *cases))) == cases


def test_restore_latex(spark):
    cases = {
        "$k_B \text{ln}$": r"$k_B \text{ln}$", "$\x0crac{a}{b}$": r"$\frac{a}{b}$", "$\x08eta$": r"$\beta$", "$\rho$": r"$\rho$", "$a \neq b$": r"$a \neq b$", "$@Omega$": r"$\Omega$", "$\x08aOmega$": r"$\Omega$",
        "a\tb @x $c$ d\x1ae": "ab @x $c$ de", "$$x\nnu y$$ and $a\nb$": "$$x\\nu y$$ and $a\nb$", "$q \tquux$": r"$q \tquux$", "$\x1aDelta$": r"$\Delta$", "```\n$\text$\n```": "```\n$\text$\n```", "no formula": "no formula",
    }
    cases = {k: v for k, v in cases.items()}
    assert dict(zip(cases, ask(spark, markup.restore_latex, *cases))) == cases
    assert ask(spark, markup.to_channel, r"\\alpha and \b", "```\n\\c\n```") == ["@alpha and @b", "```\n\\c\n```"]


def test_damage(spark):
    assert ask(spark, markup.damaged_maths, "$S = \x1a$", "$S = \x1aDelta$", "plain \x1a", "plain", None) == [True, False, False, False, None]


def test_skeletons_agree(spark):
    forms = ["S=k_{\\text{B}}\\ln \\Omega", "S = k_B ln Ω", "S = k_{B} \\ln\\Omega", "S=k_B@ln@Omega"]
    assert set(ask(spark, markup.skeleton, *forms)) == {"S=kBlnΩ"}
    assert ask(spark, markup.skeleton, "x² + \\alphabet") == ["x2+alphabet"]


def test_equations(spark):
    t = "Energy is $$E = mc^2$$ and $x$; F = ma holds, n = 120 does not.\n```\ny = z\n```\n\\[ a \\leq b \\]"
    assert ask(spark, markup.display_equations, t, "", None) == [["E = mc^2", "a \\leq b"], [], None]
    assert ask(spark, markup.math_spans, t) == [["E = mc^2", "x", " a \\leq b "]]
    assert ask(spark, markup.states_equation, t, "$x$") == [True, False]
    assert ask(spark, markup.typesets, (t, "E = mc²"), (t, "F = ma")) == [True, False]
    assert ask(spark, markup.mentions, (t, "F = ma"), (t, "E = mc^2")) == [True, False]
    assert ask(spark, markup.plain_equations, t, "see https://a.org/?x=y for S = k ln W") == [["F = ma"], ["S = k"]]


def test_wiki_maths():
    image = "![{\\displaystyle S=k\\ln \\Omega }](https://wikimedia.org/api/rest_v1/media/math/render/svg/abc123)"
    copies = "S=kln⁡Ω{\\\\displaystyle S=k\\\\ln \\\\Omega }" + image
    assert prose.collapse_wiki_maths(f"Thus {copies} holds") == "Thus $S=k\\ln \\Omega$ holds"
    assert prose.collapse_wiki_maths(f"Thus\n{copies}\nholds") == "Thus\n$$S=k\\ln \\Omega$$\nholds"
    assert prose.collapse_wiki_maths("nothing here") == "nothing here"


def test_parse_math():
    assert prose.parse_math("a $x$ b") == [("text", "a ", None), ("math", "x", False), ("text", " b", None)]
    assert prose.parse_math("$5 and $10") == [("text", "$5 and $10", None)]
    assert prose.parse_math("$$\nx\n$$") == [("math", "x", True)]


def test_wiki_copies_of_one_line():
    image = "![{\\displaystyle x }](https://wikimedia.org/api/rest_v1/media/math/render/svg/a1)"
    two = "where a{\\\\displaystyle a}" + image + " and [link](http://b/c)y{\\\\displaystyle y}" + image
    assert prose.collapse_wiki_maths(two) == "where $x$ and [link](http://b/c) $x$"
    assert prose.collapse_wiki_maths("near" + image + image) == "near $x$$x$"


def test_attribution(spark):
    cases = {
        ("Adaptive correction — Jiang et al. (2026)", "It works."): ("Adaptive correction", "It works (Jiang et al., 2026)."),
        ("Jiang et al. (2026): codes", "Jiang showed it."): ("codes", "Jiang showed it."),
        ("QLoRA 2023 variants", "x"): ("QLoRA 2023 variants", "x"),
        ("Codes, Hu and Li (2019) and Vaswani (2017)", "First!\n\nSecond."): ("Codes and", "First (Hu and Li, 2019) (Vaswani, 2017)!\n\nSecond."),
        (None, None): ("", ""),
    }
    found = [tuple(r) for r in ask(spark, markup.move_attribution, *cases)]
    assert dict(zip(cases, found))[("Codes, Hu and Li (2019) and Vaswani (2017)", "First!\n\nSecond.")][1] == "First (Hu and Li, 2019) (Vaswani, 2017)!\n\nSecond."
    assert [f for c, f in zip(cases, found) if c[0] is None or "Hu and" not in c[0]] == [v for k, v in cases.items() if k[0] is None or "Hu and" not in k[0]]


SENTENCES = [
    ("One. Two! Three?", 3), ("Cheng, A. Smith et al. Found it. Good.", 2), ("See Fig. 3 and Eq. (2). Then stop.", 2), ("Let $x = 1. Y$ be. Then go.", 2), ('He said "Go." Then left.', 2),
    ("no boundary here", 1), ("", 0), ("Is it I? It is. E.g. This one! A. B. C. Done.", 4), ("Costs $5. Not $6. End.", 2), ("  x.  Y  ", 1), ("First one.  Second one.\nThird.", 3),
]


def test_sentences(spark):
    found = ask(spark, markup.sentences, *[t for t, _ in SENTENCES])
    assert [(t, len(f)) for (t, _), f in zip(SENTENCES, found)] == SENTENCES, found
    assert [prose.sentences(t) for t, _ in SENTENCES] == found
    assert ask(spark, markup.sentences, None) == [None]


def test_relevance(spark):
    q = "how to fine-tune a large language model with LoRA"
    cases = [(q, "Finetuning large language models: fine tuning with LoRA", ""), (q, "Practical Tips for Finetuning LLMs Using LoRA", ""), (q, "Cooking", "A model of a kitchen"), ("", "x", "y"), (q, None, None)]
    assert ask(spark, text.relevance, *cases) == pytest.approx([1.0, 1.0, 0.4 / 6, 1.0, 0.0])
    assert ask(spark, text.covered, ("large language model", "an llm"), ("llm", "large language model"), ("one word", "")) == [[True] * 3, [True], [False] * 2]


def sentence(i, n=100):
    return (f"Sentence {i} " + "word " * 60)[: n - 1].rstrip() + "."


def test_passages_of_paragraphs():
    text = "\n\n".join("x" * 499 + "." for _ in range(5))
    found = passages_of(text)
    assert 2 <= len(found) <= 4 and all(len(p) <= 1400 for p, _, _ in found)


def test_passages_stay_within_budget():
    long_line = " ".join(sentence(i) for i in range(600))
    assert all(len(p) <= 1400 for p, _, _ in passages_of(long_line))
    assert all(len(p) <= 1400 for p, _, _ in passages_of("z" * 9000))


def test_headings_keep_their_paragraph():
    text = "\n\n".join(f"## Heading {i}\n\nBody {i} " + "word " * 80 for i in range(10))
    found = passages_of(text)
    assert found and not any(p.rsplit("\n", 1)[-1].startswith("#") for p, _, _ in found)


def test_overlap_is_whole_sentences():
    text = " ".join(sentence(i) for i in range(60))
    found = [p for p, _, _ in passages_of(text)]
    assert len(found) > 2 and all(p.endswith(".") and p.startswith("Sentence") for p in found)
    for a, b in zip(found, found[1:]):
        first = b.split(". ")[0]
        assert first in a


def test_no_lines_no_passages():
    assert passages_of("") == [] and passages_of("\n \n") == []


def test_chunks_travel_in_small_batches(spark):
    """A batch of texts for the passages has a bounded number of rows."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    passages.chunk(spark.createDataFrame([(1, "A text.")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
