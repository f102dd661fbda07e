import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import language_id as L


def test_predictions(docs):
    rows = {r.doc_id: r for r in L.identify(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == truth.keys()
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in rows if rows[i].held_out} == set(held)
    judged = [i for i in held if truth[i].lang and len(truth[i].text or "") > 100]
    assert sum(rows[i].lang_pred == truth[i].lang for i in judged) >= 0.97 * len(judged)
    for i, r in rows.items():
        if not any(c.isalpha() for c in truth[i].text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1


def test_scores_do_not_depend_on_the_batch(docs):
    model = L.train(docs)
    texts = [r.text or "" for r in docs.collect()]
    whole = model.score(texts)
    assert np.allclose(whole, np.concatenate([model.score([t]) for t in texts]))
    long = max(texts, key=len)
    plain = sum(model.log_prob[L.ngram_buckets(L._codes(long), k)].sum(axis=0) for k in L.ORDERS) + model.log_prior
    assert np.allclose(model.score([long], piece=1000)[0], plain)


def test_training_against_plain_counts(docs):
    """Counting, smoothing and prior by dictionaries, n-gram by n-gram, and what they predict."""
    rows = docs.select("doc_id", "text", "lang").collect()
    counts, sizes = defaultdict(Counter), Counter()

    def grams(text):
        codes = L._codes(text)
        return [int(L.ngram_buckets(codes[i : i + k], k)[0]) for k in L.ORDERS for i in range(len(codes) - k + 1)]

    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts[r.lang].update(grams(r.text))
            sizes[r.lang] += 1
    total = {lang: sum(c.values()) + 0.5 * 2**L.BUCKET_BITS for lang, c in counts.items()}
    predicted = {r.doc_id: r for r in L.identify(docs).collect()}
    for r in rows[:60]:
        if len(r.text or "") < 2000 and any(map(str.isalpha, r.text or "")):
            found = grams(r.text)
            log = {lang: math.log(sizes[lang] / sum(sizes.values())) + sum(math.log((counts[lang][g] + 0.5) / total[lang]) for g in found) for lang in counts}
            best = max(sorted(log), key=log.get)
            score = 1 / sum(math.exp((v - log[best]) / math.sqrt(len(r.text))) for v in log.values())
            assert predicted[r.doc_id].lang_pred == best and abs(predicted[r.doc_id].score - score) < 1e-9


def test_odd_tables(odd, empty, spark):
    assert L.identify(odd).count() == odd.count()
    assert L.identify(empty).count() == 0
    alone = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.identify(alone).first().lang_pred == "und"


def test_keep_identified(docs, odd, empty):
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert all(not any(c.isalpha() for c in r.text or "") or len(r.text) < 20 for r in docs.collect() if r.doc_id in gone) and len(gone) >= 3
    assert L.keep_identified(empty).count() == 0 and L.keep_identified(odd).count() > 0


def test_short_clean_texts_stay(spark):
    rows = [(i, ["le chat dort", "der hund bellt", "the dog barks"][i % 3], ["fr", "de", "en"][i % 3]) for i in range(60)]
    rows += [(100, "a", None), (101, "ta", None), (102, "Ok", "en"), (103, "12", "en"), (104, "", None), (105, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    und = {r.doc_id for r in L.identify(docs).collect() if r.lang_pred == "und"}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in L.keep_identified(docs).collect()} == und == {103, 104, 105}


def test_rows_without_a_language_get_the_predicted_one(spark):
    """The stage judges rows by the model whatever ``min_score`` is."""
    rows = [(i, ["le chat dort", "der hund bellt", "the dog barks"][i % 3], ["fr", "de", "en"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, "der hund", None), (101, "the dog", None), (102, "le chat", "de")], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in L.keep_identified(docs).collect()}
    assert [kept[i] for i in (100, 101, 102)] == ["de", "en", "de"] and all(kept[i] == lang for i, _, lang in rows)


def test_blocks_of_languages_agree(docs):
    whole, blocks = L.identify(docs), L.identify(docs, block=2)
    a, b = ({r.doc_id: r for r in df.collect()} for df in (whole, blocks))
    assert {i: r.lang_pred for i, r in a.items()} == {i: r.lang_pred for i, r in b.items()}
    assert all(abs(a[i].score - b[i].score) < 1e-9 for i in a)


def test_more_languages_than_a_block(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300) * 6} text", f"l{i % 300:03d}") for i in range(1200)]
    out = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == 1200 and sum(r.lang_pred == f"l{r.doc_id % 300:03d}" for r in out) >= 1150
