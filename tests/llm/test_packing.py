import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing as K

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'stllredm 12\n\t\r\x0b\x0c\x1c\x85\xa0é²½Ü_!?-— 　日<|>")), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_the_library(library, texts):
    texts = [*texts, "<|endoftext|> x", "we'll  go "]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    own = K.tokenizer(K.TOKENIZER)
    assert own.encode_all(texts) == want
    small = K.WordCachedTokenizer(public_tokenizers.path(K.TOKENIZER), 2)
    assert small.encode_all(texts) == want and small.encode_all(texts) == want


def fill(plan, histogram):
    bins = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            at = plan.first[length] + rank
            i = np.searchsorted(plan.begin, at, side="right") - 1
            assert at - plan.begin[i] < plan.bins[i]
            bins[int(plan.base[i] + at - plan.begin[i])].append((int(plan.offset[i]), length))
    return bins


@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
@settings(max_examples=200, deadline=None)
def test_plans_fill_bins_without_gaps(case):
    capacity, lengths = case
    histogram = dict(Counter(lengths))
    plan = K.plan_bins(histogram, capacity)
    bins = fill(plan, histogram)
    assert len(bins) == plan.n_bins
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_the_fullest_combination():
    rng = np.random.default_rng(0)
    for _ in range(200):
        capacity = int(rng.integers(5, 30))
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for x in rng.integers(1, capacity + 1, rng.integers(1, 9)):
            counts[x] += 1
        items = [int(i) for i in np.flatnonzero(counts) for _ in range(counts[i])]
        seed = items.pop()
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(K.fullest(counts, capacity)) == seed + max(s for s in sums if s <= capacity - seed)


def test_documents(docs, odd, empty, library):
    for df in (docs, odd, empty):
        rows = K.pack_documents(df).collect()
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        ids = {t: library.encode(t, add_special_tokens=False).ids + [K.END_OF_DOCUMENT] for _, t in texts}
        want = Counter()
        for (doc, t), n in texts.items():
            whole, first = ids[t], len(ids[t]) % K.CAPACITY or K.CAPACITY
            starts = [0, *range(first, len(whole), K.CAPACITY)]
            for k, a in enumerate(starts):
                part = np.array(whole[a : (first if k == 0 else a + K.CAPACITY)], dtype="<u4").tobytes()
                want[(doc, k, a, len(part) // 4, zlib.crc32(part), part)] += n
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
        places = defaultdict(list)
        for r in rows:
            places[r.sequence_id].append((r.offset, r.length))
        for p in places.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= K.CAPACITY
        total = sum(r.length for r in rows)
        assert len(places) <= total / K.CAPACITY * 1.25 + 2


def test_sequences_are_few():
    """On lengths as texts have them the number of sequences is within a hundredth of the least that tokens allow."""
    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 1024, 20_000), np.minimum(1023, rng.lognormal(5, 1.2, 20_000).astype(int) + 1)):
        histogram = dict(Counter(lengths.tolist()))
        large = sum(n for length, n in histogram.items() if length > K.CAPACITY // 2)
        least = max(large, -(-int(lengths.sum()) // K.CAPACITY))
        assert K.plan_bins(histogram).n_bins <= 1.01 * least + 1
