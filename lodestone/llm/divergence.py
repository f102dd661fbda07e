"""How the sources of a language differ from each other and from the language, term by term.

A divergence of smoothed term shares in parts of 10**9, in whole numbers throughout: p of a group and q of another
give floor((p - q)**2 / q) for a term. Part ``pair`` sums this over all kept terms of the language for each two
sources; part ``term`` lists what a source uses more than its language does.

1. Scan tasks count occurrences and documents by (lang, source, term) before anything is shuffled; a
   shuffle by all three adds the counts up, so no frequent term and no large source gathers.
2. The counts are dealt to ranges of (lang, term), in order of UTF-8 bytes. Each range keeps the terms
   of at least LEAST_DOCS documents in sorted arrays, chunk by chunk; ids are places found by
   ``searchsorted``, so they preserve the order of terms. No vocabulary is broadcast or held whole.
3. Sums over chunks give each group's and each language's number of occurrences.
4. Each chunk then meets its language's groups: ``bincount`` makes dense count vectors, these shares, and
   all pairs of sources are summed over the chunk in slices of bounded size. A chunk gives the sums and
   each source's first TOP terms, ties by id; sums are added up and terms ranked by windows that Spark cuts in each task.

The result has a row for each two sources of a language, so the number of sources bounds what is asked for;
their names and totals travel with each chunk.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, join_counted, materialize, record_batch, texts_of

#: Runs of letters: all but ASCII that is no letter; A-Z are lowered before.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 3
TOP = 200
#: Shares are in parts of this.
UNIT = 1_000_000_000
#: Counters that a scan task holds before it hands them on.
COUNTERS = 200_000
#: Terms and counts of a chunk, at most (a single term may have more).
CHUNK_TERMS, CHUNK_COUNTS = 4096, 200_000
#: Numbers of a dense slice, and of the sums of pairs that a task holds.
SLICE, HELD_SUMS = 1 << 21, 1 << 22

_COUNTED = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term tells that the group occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}

        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in occurrences.items():
                terms, d = list(n), documents[lang, source]
                yield record_batch(_COUNTED, lang=[lang] * (len(n) + 1), source=[source] * (len(n) + 1), term=[None, *terms], n=[0, *n.values()], docs=[0, *(d[t] for t in terms)])
            occurrences.clear()
            documents.clear()

        for batch in batches:
            for lang, source, text in zip(texts_of(batch, "lang"), texts_of(batch, "source"), texts_of(batch)):
                n, d = occurrences.setdefault((lang, source), Counter()), documents.setdefault((lang, source), Counter())
                own = Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower()))
                n.update(own)
                d.update(own.keys())
                held += len(own) + 1  # at least as many as there are counters
                if held > 8 * COUNTERS or held > COUNTERS and sum(map(len, occurrences.values())) > COUNTERS:
                    yield from flush()
                    held = 0
        yield from flush()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")


_CHUNK = [
    ("lang", pa.string()), ("terms", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())),
    ("at_source", pa.list_(pa.int32())), ("at_term", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
]
_CHUNK_TYPE = "lang string, terms array<string>, totals array<long>, sources array<string>, sums array<long>, at_source array<int>, at_term array<int>, counts array<long>"


def _codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[str]]:
    """Numbers by first occurrence, and what they stand for."""
    encoded = pa.array(column.to_pylist(), pa.string()).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def _chunks(lang: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Chunks of whole terms of one language; rows are sorted by term, so codes of terms ascend."""
    code, terms = _codes(rows.column("term"))
    source, names = _codes(rows.column("source"))
    n, docs = rows.column("n").to_numpy(), rows.column("docs").to_numpy()
    starts = np.searchsorted(code, np.arange(len(terms)))
    kept = np.flatnonzero(np.add.reduceat(docs, starts) >= LEAST_DOCS)  # the sorted array of kept terms, as codes
    place = np.searchsorted(kept, code)
    known = np.flatnonzero((place < len(kept)) & (kept[np.minimum(place, len(kept) - 1)] == code)) if len(kept) else kept
    place, source, n = place[known], source[known], n[known]
    lo = 0
    while lo < len(kept):
        first = np.searchsorted(place, lo)
        hi = min(len(kept), lo + CHUNK_TERMS)
        if first + CHUNK_COUNTS < len(place):
            hi = min(hi, max(lo + 1, int(place[first + CHUNK_COUNTS])))
        part = slice(first, np.searchsorted(place, hi))
        ids = place[part] - lo
        own, at = np.unique(source[part], return_inverse=True)
        totals = np.bincount(ids, weights=n[part], minlength=hi - lo).astype(np.int64)
        sums = np.bincount(at, weights=n[part]).astype(np.int64)
        columns = {"terms": [terms[k] for k in kept[lo:hi].tolist()], "totals": totals, "sources": [names[s] for s in own.tolist()], "sums": sums, "at_source": at, "at_term": ids, "counts": n[part]}
        yield record_batch(_CHUNK, lang=[lang], **{name: [c] for name, c in columns.items()})
        lo = hi


def encode(counted: DataFrame) -> DataFrame:
    """The table of chunks of kept terms: sorted terms, their totals, sources with sums, and the counts by source and term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """Chunks of what is held but, unless it is the end, the last term's rows, which may go on."""
            rows = pa.Table.from_batches(held)
            held.clear()
            lang, names = _codes(rows.column("lang"))
            edges = [*np.searchsorted(lang, np.arange(len(names))).tolist(), len(lang)]
            for k, name in enumerate(names):
                own = rows.slice(edges[k], edges[k + 1] - edges[k])
                if k == len(names) - 1 and not last:
                    term, _ = _codes(own.column("term"))
                    done = int(np.searchsorted(term, term[-1]))
                    held.extend(own.slice(done).to_batches())
                    own = own.slice(0, done)
                if own.num_rows:
                    yield from _chunks(name, own)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) > CHUNK_COUNTS:
                yield from whole(False)
        if held:
            yield from whole(True)

    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.where("term is not null").repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return materialize(dealt.select("lang", "source", "term", "n", "docs").mapInArrow(read, _CHUNK_TYPE), "chunks")


def shares(counts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / size) by long division in three steps, exact while size is below 9 * 10**15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        whole, rest = np.divmod(rest, size)
        out = (out + whole) * 1000
        rest = rest * 1000
    return 1 + out + rest // size


_FOUND = [("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]


def compare(chunks: DataFrame, top: int = TOP) -> DataFrame:
    """(part, lang, source, item, value) of chunks with their language's groups: sums of pairs by task, terms by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (names, sums) in held.items():
                for a, name in enumerate(names):
                    items, values = names[:a] + names[a + 1 :], np.delete(sums[a], a)
                    yield record_batch(_FOUND, part=["pair"] * len(items), lang=[lang] * len(items), source=[name] * len(items), item=items, value=values)
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                x = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
                lang, names, terms = x["lang"].as_py(), x["group_names"].as_py(), x["terms"].as_py()
                if lang not in held and sum(s.size for _, s in held.values()) + len(names) ** 2 > HELD_SUMS:
                    yield from flush()
                sums = held.setdefault(lang, (names, np.zeros((len(names), len(names)), np.int64)))[1]
                place = {name: k for k, name in enumerate(names)}
                own = np.array([place[s] for s in x["sources"].as_py()], np.int64)
                at_source, at_term, counts = (x[c].values.to_numpy() for c in ("at_source", "at_term", "counts"))
                size = (x["group_sums"].values.to_numpy() + x["kept"].as_py())[:, None]
                totals = x["totals"].values.to_numpy()
                best: list[list[tuple[int, int]]] = [[] for _ in names]
                width = max(1, SLICE // len(names))
                for lo in range(0, len(terms), width):
                    hi = min(len(terms), lo + width)
                    first, last = np.searchsorted(at_term, [lo, hi])
                    flat = own[at_source[first:last]] * (hi - lo) + at_term[first:last] - lo
                    dense = np.bincount(flat, weights=counts[first:last], minlength=len(names) * (hi - lo)).astype(np.int64).reshape(len(names), hi - lo)
                    p = shares(dense, size)
                    q = shares(totals[lo:hi], x["lang_sum"].as_py() + x["kept"].as_py())
                    for a in range(len(names)):
                        sums[a] += ((p[a] - p) ** 2 // p).sum(axis=1)
                        over = np.flatnonzero((dense[a] > 0) & (p[a] > q))
                        f = (p[a, over] - q[over]) ** 2 // q[over]
                        order = np.lexsort((over, -f))[:top]
                        best[a] += [(-v, i + lo) for v, i in zip(f[order].tolist(), over[order].tolist())]
                for a, found in enumerate(best):
                    found = sorted(found)[:top]  # by value, then by id, which is the order of terms
                    if found:
                        yield record_batch(_FOUND, part=["term"] * len(found), lang=[lang] * len(found), source=[names[a]] * len(found), item=[terms[i] for _, i in found], value=[-v for v, _ in found])
        yield from flush()

    return chunks.mapInArrow(run, "part string, lang string, source string, item string, value long")


def audit_sources(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: see the module. Null text, lang and source count as ''.

    Every (lang, source) that occurs has its pairs, with texts or without; a language without kept terms
    gives 0 for each; a source alone in its language has none. Repeated rows count as often as they come. Long texts are read
    whole. An empty table gives an empty one; columns but text, lang and source are not looked at.
    """
    bound_batches(docs.sparkSession)
    counted = count_terms(docs)
    chunks = encode(counted)
    by_group = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("group_sum"))
    groups = counted.where("term is null").select("lang", "source").join(by_group, ["lang", "source"], "left").withColumn("group_sum", F.coalesce("group_sum", F.lit(0)))
    by_lang = chunks.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("terms")).alias("kept"))
    sorted_groups = F.array_sort(F.collect_list(F.struct("source", "group_sum"))).alias("g")
    langs = groups.groupBy("lang").agg(sorted_groups, F.sum("group_sum").alias("lang_sum")).join(by_lang, "lang", "left")
    # each language has an empty chunk more, so its pairs come whether terms are kept or not
    known = materialize(langs.select("lang", F.col("g.source").alias("group_names"), F.col("g.group_sum").alias("group_sums"), "lang_sum", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), (F.coalesce("chunks", F.lit(0)) + 1).alias("chunks")), "langs")
    none = [F.array().cast(t).alias(c) for c, t in (x.split(" ") for x in _CHUNK_TYPE.split(", ")[1:])]
    total = max(1, known.agg(F.sum("chunks").alias("n")).first()["n"] or 0)
    met = join_counted(chunks.unionByName(known.select("lang", *none)), known, "lang", "chunks", total).drop("chunks")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(compare(met.repartition(tasks), top), "compared")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
