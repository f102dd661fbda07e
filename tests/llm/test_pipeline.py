import zlib
from collections import Counter

import pytest

import corpus_pipeline as P
from lodestone.llm import exact_dedup, language_id, mixing, ngram_join
from lodestone.llm.base import materialize
from tests.llm.conftest import SCHEMA
from tests.llm.test_mixing_warc import poisson_count, uniform
from tests.llm.test_ngram_join import LOWER, WORD


def test_stages_in_order(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, kept[-1], str(tmp_path)), f"test-{name}")
        assert out.columns == docs.columns
        kept.append(out)
    ids = [Counter(r.doc_id for r in k.collect()) for k in kept]
    assert set(ids[1]) < set(ids[0]) and len(ids[0]) - len(ids[1]) <= 6  # only texts without a clear language go
    unique = {r.doc_id for r in exact_dedup.exact_duplicates(kept[1]).collect() if r.kept}
    assert set(ids[2]) == unique
    assert set(ids[3]) == {r.component_id for r in ngram_join.near_duplicate_groups(kept[2]).collect()}
    assert ids[4] == Counter(r.doc_id for r in mixing.mix_sources(kept[3]).collect())
    packed = P.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == ids[4]


def test_empty_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_document_has_the_language_of_op8(spark):
    """Wrong languages too; one that only a held-out document has can't be learned and stays."""
    rows = [(i, ["le chat dort", "der hund bellt", "the dog barks"][i % 3], ["fr", "de", "en"][i % 3]) for i in range(60)]
    rows += [(102, "le chat", "de"), (103, "the dog", "fr"), (104, "der hund", None), (105, "12", "en")]
    held = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 3 == 1)
    docs = spark.createDataFrame([*rows, (held, "o gato dorme", "pt")], "doc_id long, text string, lang string")
    told = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    out = {r.doc_id: r.lang for r in P.identify_language(spark, docs, "").collect()}
    assert out == {i: lang for i, lang in told.items() if i not in (105, held)} | {held: "pt"}
    assert [out[i] for i in (102, 103, 104)] == ["fr", "en", "de"]


def test_near_copies_of_the_stage(spark):
    words = [f"w{i}" for i in range(200)]
    near = [w if i not in (20, 60, 100, 140) else f"x{i}" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(near), "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()] == [1]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_stages(rows):
    """The stages but the last over rows (doc_id, text, ...) by loops: lists of kept rows, and numbers of copies."""
    out = [[r for r in rows if any(c.isalpha() for c in r.text or "")]]
    best = {}
    for r in out[-1]:
        key = (r.text or "").translate(LOWER)
        if key not in best or (r.doc_id is not None and (best[key].doc_id is None or r.doc_id > best[key].doc_id)):
            best[key] = r
    out.append(list(best.values()))
    sets, group = [shingles(r.text) for r in out[-1]], list(range(len(out[-1])))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for r, g in zip(out[-1], group):
        if r.doc_id is not None:
            ids[g] = min(ids.get(g, r.doc_id), r.doc_id)
    out.append([r for r, g in zip(out[-1], group) if r.doc_id == ids.get(g) or g not in ids])
    size = Counter(r.source for r in out[-1])
    weight = {s: n**0.5 for s, n in size.items()}
    rate = {s: len(out[-1]) * weight[s] / sum(weight.values()) / size[s] for s in size}
    copies = Counter()
    for r in out[-1]:
        copies[r.doc_id, r.text] += poisson_count(rate[r.source], uniform(5, "null" if r.doc_id is None else r.doc_id, 0))
    return out, +copies


def test_stages_against_brute_force_on_an_odd_table(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, null ids, columns named like those the operators add."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, copies = brute_stages(docs.collect())
    now = docs
    for (name, stage), want in zip(P.STAGES, stages):
        now = materialize(stage(spark, now, str(tmp_path)), f"odd-{name}")
        assert now.schema == docs.schema
        # of rows that agree in id and text any one may stay
        assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter((r.doc_id, r.text) for r in want), name
    mixed = materialize(P.STAGES[3][1](spark, now, str(tmp_path)), "odd-mixing")
    assert mixed.schema == docs.schema and Counter((r.doc_id, r.text) for r in mixed.collect()) == copies
    assert {r.copy for r in mixed.collect()} <= {r.copy for r in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter()
    for (doc, text), n in copies.items():
        lengths[doc, len(library.encode(text or "", add_special_tokens=False).ids) + 1] += n
    packed = P.STAGES[4][1](spark, mixed, str(tmp_path)).collect()
    ends = Counter()
    for r in packed:
        ends[r.doc_id, r.start + r.length] += 1
    assert all(ends[k] >= n for k, n in lengths.items()) and sum(r.piece == 0 for r in packed) == sum(copies.values())
    assert sum(r.length for r in packed) == sum(length * n for (_, length), n in lengths.items())
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
