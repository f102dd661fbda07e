"""Text functions as column expressions: they stay in the JVM and within whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(text: Column, signs: list[str]) -> Column:
    found = F.lit(False)
    for sign in signs:
        found = found | text.contains(sign)
    return found


def strip(text: Column | str) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def fold_plural(word: Column | str) -> Column:
    """A final s goes from words longer than three letters that don't end in ss."""
    w = _col(word)
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(K.WORD), 0)


def letter_runs(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(K.LETTERS), 0)


def anchor_sequence(text: Column | str) -> Column:
    """subject words in order: longer than two letters, not generic (asked before folding), plural folded."""
    generic = F.array(*[F.lit(w) for w in K.GENERIC_WORDS])
    kept = F.filter(letter_runs(text), lambda w: (F.length(w) > 2) & ~F.array_contains(generic, w))
    return F.transform(kept, fold_plural)


def anchors(text: Column | str) -> Column:
    return F.array_distinct(anchor_sequence(text))


def on_topic(query: Column | str, question: Column | str, overlap: float = K.ANCHOR_OVERLAP) -> Column:
    """the query keeps at least half (half-even, one at least) of the question's anchors; without anchors, any does."""
    wanted = anchors(question)
    needed = F.greatest(F.lit(1), F.bround(F.size(wanted) * F.lit(overlap), 0).cast("int"))
    return F.when(F.size(wanted) == 0, True).otherwise(F.size(F.array_intersect(anchors(query), wanted)) >= needed)


def wants_recent(text: Column | str, year: int) -> Column:
    """a word or phrase that asks for the present, or a year from three before to one after ``year``."""
    lower = F.lower(_col(text))
    runs = letter_runs(text)
    terms = F.array(*[F.lit(w) for w in K.RECENCY_WORDS + K.RECENCY_BEGINNINGS])
    begins = F.exists(runs, lambda w: F.exists(F.array(*[F.lit(s) for s in K.RECENCY_BEGINNINGS]), lambda s: F.startswith(w, s)))
    years = F.transform(F.regexp_extract_all(_col(text), F.lit(K.YEAR), 0), lambda y: y.cast("int"))
    by_year = F.exists(years, lambda y: (y >= year - K.RECENT_YEARS) & (y <= year + 1))
    return F.coalesce(F.arrays_overlap(runs, terms) | _any(lower, K.RECENCY_PHRASES) | begins | by_year, F.lit(False))


def label(text: Column | str, limit: int = K.LABEL_CHARS, letters: int = K.LABEL_LETTERS) -> Column:
    """The first readable segment of scraped text, cut to ``limit`` on a word; empty if there is none."""
    flat = F.regexp_replace(F.coalesce(_col(text), F.lit("")), K.LABEL_IMAGE, " ")
    flat = F.regexp_replace(flat, K.LABEL_LINK, "$1")
    for pattern in (K.LABEL_TAG, K.LABEL_URL):
        flat = F.regexp_replace(flat, pattern, " ")
    flat = F.regexp_replace(flat, K.LABEL_EMPHASIS, "")
    edge = "[" + K.LABEL_DEBRIS.replace("-", "\\-").replace("|", "\\|") + "]+"

    def clean(segment: Column) -> Column:
        s = F.regexp_replace(segment, "(?U)" + K.LABEL_BULLET, "")
        s = strip(F.regexp_replace(s, r"(?U)\s+", " "))
        return F.regexp_replace(F.regexp_replace(s, K.LABEL_FIELD, ""), f"^{edge}|{edge}$", "")

    readable = F.filter(F.transform(F.split(flat, K.LABEL_BOUNDARY), clean), lambda s: F.length(F.regexp_replace(s, r"[^\p{L}\p{Nl}\p{No}]", "")) >= letters)
    first = F.coalesce(F.get(readable, F.lit(0)), F.lit(""))
    head = F.substring(first, 1, limit + 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # the last blank, from 0
    cut = F.when((F.instr(head, " ") > 0) & (space > limit // 2), space).otherwise(F.lit(limit))
    tail = "[" + K.LABEL_DEBRIS.replace("-", "\\-").replace("|", "\\|") + ".]+$"
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.regexp_replace(F.substring(first, F.lit(1), cut), tail, ""), F.lit("…")))


def tidy_theme(theme: Column | str) -> Column:
    """A heading without marks, numbers and closing punctuation; only an all lower-case first word gets a capital."""
    bare = F.regexp_replace(F.regexp_replace(strip(theme), K.THEME_PREFIX, ""), K.THEME_TAIL, "")
    first = F.regexp_extract(bare, r"^(\S+)", 1)
    lower_first = (F.lower(first) == first) & (F.upper(first) != first)
    return F.when(lower_first, F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)


def id_leak(text: Column | str) -> Column:
    """The first label or id that is left in a text, or null."""
    found = F.regexp_extract(_col(text), rf"(?iU)({K.ID_LABEL}|{K.ID_SHAPE})", 1)
    return F.nullif(found, F.lit(""))


def readable_quote(text: Column | str, lines: int = 5) -> Column:
    """Line-break tags as line breaks, the first ``lines`` lines."""
    return F.array_join(F.slice(F.split(F.regexp_replace(_col(text), r"(?i)<br\s*/?>", "\n"), "\n"), 1, lines), "\n")


def short_host(url: Column | str) -> Column:
    """A URL's host without www., or the URL where it has none."""
    host = F.regexp_replace(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")
    return F.when(host == "", _col(url)).otherwise(host)


def counted(n: Column | str, noun: str, plural: str | None = None) -> Column:
    """A number with its noun; -es after a sibilant."""
    many = plural or noun + ("es" if noun.endswith(("s", "x", "z", "ch", "sh")) else "s")
    return F.concat(_col(n).cast("string"), F.lit(" "), F.when(_col(n) == 1, noun).otherwise(many))


def shortfall(problem: Column | str, missing: Column | str, reasoning: Column | str) -> Column:
    """A verdict as one sentence, with what was needed if that is known."""
    verdict = F.lit(K.SHORTFALL_OTHERWISE)
    for code, said in K.SHORTFALLS.items():
        verdict = F.when(_col(problem) == code, said).otherwise(verdict)
    needed = F.coalesce(F.nullif(strip(F.coalesce(_col(missing), F.lit(""))), F.lit("")), strip(F.coalesce(_col(reasoning), F.lit(""))))
    return F.concat(F.lit("The answer was "), verdict, F.lit("."), F.when(needed != "", F.concat(F.lit(" It needed: "), needed)).otherwise(""))


def cache_key(kind: str, text: Column | str) -> Column:
    """The key that a vector is kept under."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(_col(text), 256))


def error_kind(message: Column | str) -> Column:
    """billing, rate_limit, transient or other; a refusal over requests in flight is never billing."""
    m = F.lower(_col(message))
    billing = _any(m, K.BILLING_SIGNS) & ~m.contains(K.IN_FLIGHT)
    return F.when(billing, "billing").when(_any(m, K.RATE_SIGNS), "rate_limit").when(_any(m, K.TRANSIENT_SIGNS), "transient").otherwise("other")


def key_text(text: Column | str) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(strip(F.regexp_replace(_col(text), r"(?U)\s+", " ")))


# URLs and titles of search results.


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_of(url: Column | str) -> Column:
    """Lower-case host, without port and leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(netloc(url)), r"^([^:]*)", 1), r"^www\.", "")


def canonical_url(url: Column | str) -> Column:
    """One key for a document: its arXiv id, its DOI, or host, path and sorted query without tracking."""
    host, path = host_of(url), url_path(url)
    arxiv, doi = F.regexp_extract(path, K.ARXIV_ID, 1), F.regexp_extract(path, K.DOI, 1)
    query = F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(K.TRACKING))
    kept = F.array_join(F.array_sort(pairs), "&")
    plain = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host.endswith("arxiv.org") & (arxiv != ""), F.concat(F.lit("arxiv:"), arxiv)).when(doi != "", F.concat(F.lit("doi:"), F.lower(doi))).otherwise(plain)


def title_words(title: Column | str) -> Column:
    """Distinct words of a title, none where they are too few to identify it."""
    found = F.array_distinct(words(title))
    return F.when(F.size(found) >= K.LEAST_TITLE_WORDS, found).otherwise(F.array().cast("array<string>"))


def title_key(title: Column | str) -> Column:
    """The words of a title without what mirrors put before and after it."""
    t = F.coalesce(F.nullif(label(title), F.lit("")), _col(title))
    bare = F.regexp_replace(F.regexp_replace(t, K.TITLE_PREFIX, ""), "(?U)" + K.TITLE_SUFFIX, "")
    return title_words(F.regexp_replace(bare, "[ .…]+$", ""))


def paper_signals(url: Column | str, title: Column | str, snippet: Column | str) -> Column:
    """How many signs of a paper path, title and snippet have."""
    text = F.concat_ws("\n", _col(title), _col(snippet))
    return url_path(url).rlike(K.PAPER_PATH).cast("int") + F.regexp_count(text, F.lit(K.PAPER_TEXT))


def stem(word: Column | str) -> Column:
    """Without the first of ing, ed, es, e and s that leaves three letters or more."""
    w = _col(word)
    out = w
    for suffix in reversed(("ing", "ed", "es", "e", "s")):
        out = F.when(w.endswith(suffix) & (F.length(w) - len(suffix) >= 3), F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
    return out


# How a question's subject is covered by a text.


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; Spark computes what a lambda names anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _initials(words: Column, size: int) -> Column:
    """The initials of each run of ``size`` words, in order; those of two words are too short to count."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(*[F.substring(F.get(words, i - 1 + k), 1, 1) for k in range(size)]))


def covered(question: Column | str, text: Column | str) -> Column:
    """For each of the question's anchors whether a text names it: by its stem, joined with its neighbour in
    one word, or by an acronym either way (of equal acronyms of the question the first one counts)."""
    words_of_both = F.struct(anchors(question).alias("wanted"), anchor_sequence(text).alias("present"))

    def prepared(x: Column) -> Column:
        wanted, present = x["wanted"], x["present"]
        runs = [_initials(wanted, n).alias(f"runs{n}") for n in (3, 4)]
        letters = F.concat(_initials(present, 3), _initials(present, 4))
        return F.struct(wanted.alias("wanted"), present.alias("present"), F.transform(wanted, stem).alias("wanted_stems"), F.transform(present, stem).alias("stems"), letters.alias("letters"), *runs)

    def named(x: Column) -> Column:
        def joined(i: Column) -> Column:
            pair = F.concat(F.get(x["wanted"], i), F.get(x["wanted_stems"], i + 1))
            return F.coalesce(F.exists(x["stems"], lambda s: F.startswith(s, pair)), F.lit(False))

        def spelled(i: Column, size: int) -> Column:
            runs = x[f"runs{size}"]
            place = lambda k: F.get(runs, i - k)  # noqa: E731  the run that begins k words before
            return F.array_contains(F.array(*[F.coalesce(F.array_contains(x["present"], place(k)) & (F.array_position(runs, place(k)) == i - k + 1), F.lit(False)) for k in range(size)]), True)

        return F.transform(x["wanted"], lambda w, i: F.array_contains(x["stems"], F.get(x["wanted_stems"], i)) | F.array_contains(x["letters"], w) | joined(i) | joined(i - 1) | spelled(i, 3) | spelled(i, 4))

    return _let(_let(words_of_both, prepared), named)


def relevance(question: Column | str, title: Column | str, snippet: Column | str) -> Column:
    """The share of the question's anchors that the title names, and that title or snippet name."""
    t, s = (F.coalesce(_col(c), F.lit("")) for c in (title, snippet))
    q = F.coalesce(_col(question), F.lit(""))
    both = F.struct(covered(q, t).alias("title"), covered(q, s).alias("snippet"))

    def share(x: Column) -> Column:
        n = F.size(x["title"])
        either = F.zip_with(x["title"], x["snippet"], lambda a, b: a | b)
        count = lambda named: F.size(F.filter(named, lambda y: y))
        return F.when(n == 0, 1.0).otherwise(0.6 * count(x["title"]) / n + 0.4 * count(either) / n)

    return _let(both, share)
