"""Fences, formulas and evidence ids in a text, as column expressions that stay in the JVM.

A text is cut into parts by its fence lines, a part into formulas and what stands between them. What
the functions below change or ask of a text they change or ask of these pieces; nothing within a fence
is ever looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions.text import strip

Change = Callable[[Column], Column]

_FENCE = "(?md)" + K.FENCE
_FORMULA = "(?s)" + K.MATH_SPAN
#: What a model may have meant as a formula, however broken; at most so long without a closing sign.
_LOOSE = r"(?s)\$\$.+?\$\$|\$[^$]{1,400}?\$"
#: Control characters, but for the line break.
_CONTROL = r"[\x00-\x09\x0b-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _woven(text: Column, pattern: str, between: Callable[[Column, Column], Column], found: Change) -> Column:
    """A text whose matches and whose pieces between them (with their number) are changed, each on its own."""
    both = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0), lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.array_join(F.transform(both, lambda x, i: F.concat(between(x["piece"], i), F.coalesce(found(x["match"]), F.lit("")))), "")


def outside_fences(text: Column | str, change: Change) -> Column:
    """``change`` applied to what is not fenced; fence lines stay, and what follows an unclosed one is fenced."""
    t = _col(text)
    woven = _woven(t, _FENCE, lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(p), lambda line: line)
    return F.when(t.contains("```"), woven).otherwise(change(t))


def prose_of(text: Column | str) -> Column:
    """The parts that are not fenced."""
    return F.filter(F.split(_col(text), _FENCE), lambda p, i: i % 2 == 0)


# Evidence ids.

_IDS = rf"{K.ID_SHAPE}(?:\s*(?:,|and)\s*(?:{K.ID_LABEL}\s*:?\s*)?{K.ID_SHAPE})*"
_MENTION = "|".join([
    rf"[(\[]\s*{K.ID_LABEL}\s*(?::[^()\[\]\n]*|{_IDS}\s*)[)\]]",  # in brackets, whatever the label announces
    rf"{K.ID_LABEL}\s*:?\s*{_IDS}",  # a label and its list
    rf"[(\[]?\s*{K.ID_SHAPE}\s*[)\]]?",  # a bare id, with the brackets that touch it
])


def strip_ids(text: Column | str) -> Column:
    """Evidence ids go from prose, and with them what they leave: empty brackets, blanks, lone signs."""

    def without(p: Column) -> Column:
        gone = F.regexp_replace(p, rf"(?iU)\s*(?:{_MENTION})", " ")
        bare = F.regexp_replace(gone, r"(?U)\(\s*\)|\[\s*\]", "")
        closed = F.regexp_replace(bare, r"(?U)\s+(?:(?:and|,)\s*(?=,)|(?=[,.;:]))", "")
        return strip(F.regexp_replace(closed, r"[ \t]{2,}", " "))

    return outside_fences(text, without)


# Formulas that passed through a decoder.


def to_channel(text: Column | str) -> Column:
    """Commands begin with @ instead of backslashes, outside fences."""
    return outside_fences(text, lambda p: F.regexp_replace(p, r"\\+(?=[a-zA-Z])", "@"))


def _escapes() -> list[tuple[str, str]]:
    """Rules (pattern, replacement), in order of their force, that turn what an escape sequence left back into a command."""

    def any_of(names: list[str]) -> str:
        return "(" + "|".join(sorted(names, key=len, reverse=True)) + ")(?![a-zA-Z])"

    rules = []
    for control, letter in K.ESCAPE_LETTERS.items():  # the letter is gone: \t of \text became a tab
        rests = [name[1:] for name in K.COMMANDS if name.startswith(letter) and len(name) > 1]
        rules.append((rf"\x{ord(control):02x}{any_of(rests)}", rf"\\{letter}$1"))
    rules.append((rf"[\x00-\x1f]{any_of(K.COMMANDS)}", r"\\$1"))  # only the backslash is gone
    rules.append((rf"[\x00-\x1f][a-zA-Z]{any_of(K.COMMANDS)}", r"\\$1"))  # and a letter came in
    # no formula has a tab or the like, so it was a command even if no known one; it may have a line break
    rules += [(rf"\x{ord(c):02x}([a-zA-Z]+)", rf"\\{letter}$1") for c, letter in K.ESCAPE_LETTERS.items() if c != "\n"]
    return rules


def _mended(formula: Column) -> Column:
    for pattern, by in _escapes():
        formula = F.regexp_replace(formula, pattern, by)
    return formula


def restore_latex(text: Column | str) -> Column:
    """Commands that a decoder ate come back within formulas, stray control characters go, @ becomes a backslash."""

    def clean(p: Column) -> Column:
        return F.regexp_replace(p, _CONTROL, "")

    def formula(m: Column) -> Column:
        return F.translate(clean(F.when(m.rlike(r"[\x00-\x1f]"), _mended(m)).otherwise(m)), "@", "\\")

    return outside_fences(text, lambda p: F.when(p.contains("$"), _woven(p, _LOOSE, lambda q, i: clean(q), formula)).otherwise(clean(p)))


def damaged_maths(text: Column | str) -> Column:
    """Some formula holds a control character that no command explains."""
    broken = F.exists(prose_of(text), lambda p: F.exists(F.regexp_extract_all(p, F.lit(_LOOSE), 0), lambda m: _mended(m).rlike(_CONTROL)))
    return F.when(_col(text).rlike(_CONTROL), broken).otherwise(_col(text).isNull() & F.lit(None).cast("boolean"))


def presentable(text: Column | str) -> Column:
    """Formulas restored, then ids stripped."""
    return strip_ids(restore_latex(text))


# Equations.


def skeleton(expression: Column | str) -> Column:
    """X11: an expression without its typesetting: no styles, Greek letters for their names, flat scripts, no blanks."""
    plain = F.regexp_replace(_col(expression), K.STYLING, "")
    for name, letter in K.GREEK.items():
        plain = F.regexp_replace(plain, rf"[\\@]{name}(?![a-zA-Z])", letter)
    plain = F.regexp_replace(plain, r"[\\@](?=[a-zA-Z])", "")
    return F.regexp_replace(F.translate(plain, *K.SCRIPTS), "(?U)" + K.FORMULA_NOISE, "")


def formulas(text: Column | str) -> Column:
    """(body, display) of all that stands between maths delimiters outside fences."""

    def of(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(_FORMULA), 0), opened)

    def opened(m: Column) -> Column:
        wide = m.startswith("$$") | m.startswith("\\[")
        edge = F.when(wide, 2).otherwise(1)
        return F.struct(F.substring(m, edge + 1, F.length(m) - 2 * edge).alias("body"), wide.alias("display"))

    return F.flatten(F.transform(prose_of(text), of))


def math_spans(text: Column | str) -> Column:
    """The bodies of all formulas."""
    return F.transform(formulas(text), lambda f: f["body"])


def display_equations(text: Column | str) -> Column:
    """The bodies of formulas set on their own that have a relation."""
    return F.transform(F.filter(formulas(text), lambda f: f["display"] & f["body"].rlike(K.RELATION)), lambda f: strip(f["body"]))


def states_equation(text: Column | str) -> Column:
    """Some formula has a relation."""
    return F.exists(formulas(text), lambda f: f["body"].rlike(K.RELATION))


def typesets(text: Column | str, equation: Column | str) -> Column:
    """The equation stands in the text as a formula, in whatever notation."""
    wanted = skeleton(equation)
    return F.exists(formulas(text), lambda f: skeleton(f["body"]).contains(wanted))


def mentions(text: Column | str, equation: Column | str) -> Column:
    """The equation stands in the text as plain characters."""
    return skeleton(F.regexp_replace(_col(text), _FORMULA, " ")).contains(skeleton(equation))


def plain_equations(text: Column | str) -> Column:
    """Equations that are written as plain characters, outside formulas, addresses and fences."""

    def of(p: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(p, _FORMULA, " "), K.ADDRESS, " ")
        return F.transform(F.regexp_extract_all(bare, F.lit(rf"(?U)(?<![{K.BEFORE_EQUATION}]){K.PLAIN_EQUATION}"), 0), strip)

    return F.flatten(F.transform(prose_of(text), of))


# Attributions.


def move_attribution(theme: Column | str, text: Column | str) -> Column:
    """(theme, text): a source that a heading names goes to the end of the claim's first paragraph, unless it is named there."""
    heading, claim = (F.coalesce(_col(c), F.lit("")) for c in (theme, text))
    named = F.regexp_extract_all(heading, F.lit("(?U)" + K.ATTRIBUTION), 0)

    def part(m: Column, many: int, one: int) -> Column:
        found = F.regexp_extract(m, "(?U)" + K.ATTRIBUTION, many)
        return F.when(found != "", found).otherwise(F.regexp_extract(m, "(?U)" + K.ATTRIBUTION, one))

    sources = F.transform(named, lambda m: F.struct(part(m, 1, 3).alias("who"), part(m, 2, 4).alias("year")))
    new = F.filter(sources, lambda s: ~F.lower(claim).contains(F.lower(F.regexp_extract(s["who"], r"^(\S+)", 1))))
    first = F.split(claim, "\n\n", 2)[0]
    rest = F.substring(claim, F.length(first) + 1, F.length(claim))

    def cited(paragraph: Column, s: Column) -> Column:
        trimmed = F.regexp_replace(paragraph, r"(?U)\s+$", "")
        stop = F.regexp_extract(trimmed, r"([.!?])$", 1)
        return F.concat(F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(stop)), F.lit(" ("), s["who"], F.lit(", "), s["year"], F.lit(")"), stop)

    bare = F.regexp_replace(F.regexp_replace(heading, "(?U)" + K.ATTRIBUTION, " "), r"^[ —–:|,\-]+|[ —–:|,\-]+$", "")
    some = F.size(named) > 0
    return F.struct(F.when(some, bare).otherwise(heading).alias("theme"), F.when(some, F.concat(F.aggregate(new, first, cited), rest)).otherwise(claim).alias("text"))


# Sentences.

#: A noncharacter, which no text has, where a sentence may end.
CUT = "\ufdd0"


def sentences(text: Column | str) -> Column:
    """Sentences in order, without outer white space; not cut after abbreviations, initials or within formulas.

    Every place that looks like an end is marked, and marks go again where it is none. Sentences have even
    numbers of dollars, so those up to a mark tell whether a formula is open; most texts have none to count.
    """
    short = "^(?:" + "|".join(w.replace(".", r"\.") for w in K.ABBREVIATIONS) + r"|\p{L})$"

    def abbreviated(piece: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_extract(piece, K.LAST_WORD, 1)), "^[(\"'“‘]+", "").rlike(short)

    def marked(piece: Column, goes_on: Column) -> Column:
        return F.concat(piece, F.when(goes_on, "").otherwise(CUT))

    def count(state: Column, piece: Column) -> Column:
        now = state["n"] + F.length(piece) - F.length(F.replace(piece, F.lit("$"), F.lit("")))
        return F.struct(F.array_append(state["open"], now % 2 == 1).alias("open"), now.alias("n"))

    pieces = F.split(F.regexp_replace(_col(text), "(?U)" + K.SENTENCE_CUT, f"$1$2{CUT}$3"), CUT)
    start = F.struct(F.array().cast("array<boolean>").alias("open"), F.lit(0).alias("n"))
    with_formulas = F.zip_with(pieces, F.aggregate(pieces, start, count, lambda state: state["open"]), lambda p, on: marked(p, on | abbreviated(p)))
    each = F.when(_col(text).contains("$"), with_formulas).otherwise(F.transform(pieces, lambda p: marked(p, abbreviated(p))))
    return F.filter(F.transform(F.split(F.array_join(each, ""), CUT), strip), lambda s: s != "")
