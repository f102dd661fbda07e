import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copy string, held_out int"


def words(rng, n, syllables):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, ...) with copies, near copies, nulls, empties, a long text and columns of clashing names."""
    rng = random.Random(7)
    kinds = {"en": "the of and ing er tion st on an re".split(), "de": "der die und ung ich ein sch ge ver en".split(), "fr": "le la et ou que ment eau oi an é".split()}
    rows, n = [], 0
    for i in range(150):
        lang = ("en", "en", "de", "fr")[i % 4]
        text = words(rng, rng.randint(60, 160), kinds[lang])
        rows.append((n, text, lang, "big" if i % 3 else f"s{i % 7}", len(text), "x", "y", 1))
        n += 1
        if i % 10 == 0:  # exact copies, one in capitals, and near copies
            near = text.split()
            near[len(near) // 2] = "changed"
            for t in (text, text.upper(), " ".join(near), " ".join(near + ["more"])):
                rows.append((n, t, lang, "big", len(t), "x", "y", 1))
                n += 1
    long = words(rng, 30_000, kinds["en"])
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "s1", 0, "", "", 0), (n + 2, "!!! 123 --", "en", "s1", 10, "", "", 0), (n + 3, "one two", None, "s2", 7, "", "", 0), (n + 4, long, "en", "big", len(long), "", "", 0), (n + 5, long, "en", "big", len(long), "", "", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """The corpus with repeated rows and null ids."""
    some = corpus[:3]
    return spark.createDataFrame(corpus + some + [(None, *r[1:]) for r in some] + [(None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(r[0], int(r[0] % 5 != 0), int(r[0] % 9 == 0)) for r in corpus if r[0] % 3 != 1]
    return spark.createDataFrame(rows + [(10**9, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
