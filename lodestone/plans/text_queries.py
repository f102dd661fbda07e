"""Queries of the text functions that work on markup: sentences, ids, formulas, attributions.

The driver's texts have no formulas, ids or headings, so these are put to their ends; signs that could
be mistaken for one are taken out before, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import markup, prose
from lodestone.operators import evidence, passages
from lodestone.plans.registry import choice, query, quoted, sql_list, strip_sql
from lodestone.session import read_table


@query(rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, {quoted(K.SENTENCE_CUT)}, '\1\2' || chr(64976) || '\3', 'g'), chr(64976)) AS l FROM documents),
  p AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS k FROM c),
  w AS (SELECT *, regexp_replace(lower(regexp_extract(piece, {quoted(K.LAST_WORD)}, 1)), {quoted('^[("' + "'" + '“‘]+')}, '') AS word,
               sum(length(piece) - length(replace(piece, '$', ''))) OVER (PARTITION BY doc_id ORDER BY k) AS dollars FROM p),
  e AS (SELECT *, (dollars % 2 = 1 OR list_contains({sql_list(K.ABBREVIATIONS)}, word) OR regexp_matches(word, '^\p{{L}}$'))::INT AS goes_on FROM w),
  n AS (SELECT *, coalesce(sum(1 - goes_on) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM e),
  j AS (SELECT doc_id, sentence, {strip_sql("string_agg(piece, '' ORDER BY k)")} AS t FROM n GROUP BY ALL)
  SELECT doc_id, count(*) FILTER (t <> '') AS n_sentences, coalesce(string_agg(t, chr(10) ORDER BY sentence) FILTER (t <> ''), '') AS sentences FROM j GROUP BY doc_id""")
def c8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = read_table(spark, sf_dir, "documents").select("doc_id", markup.sentences("text").alias("s"))
    return cut.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "\n").alias("sentences"))


# Passages.


def _passages_sql(source: str, budget: int = K.PASSAGE_CHARS, overlap: int = K.OVERLAP_CHARS) -> str:
    """CTEs that end in ``passages`` (doc_id, ordinal, text, start_line, end_line) of ``source`` (doc_id, text).

    lines, paragraphs (a heading alone goes with the next), sentences, units of at most ``budget``
    characters; then a machine for each document that appends its next unit, closes a passage or drops
    a carried unit, one step at a time.
    """
    lens = "list_transform({}, lambda x: length(x))"
    size = f"(coalesce(list_sum({lens.format('t')}), 0) + coalesce(list_sum({lens.format('j[2:]')}), 0))"
    waiting = "len(list_filter(range(1, n - carried), lambda k: len(list_filter(h[n - k + 1:n], lambda x: x)) = k))"  # headings at the end that the passage can spare
    fits = f"len(list_filter(range(1, m), lambda k: list_sum({lens.format('t[m - k + 1:m]')}) + coalesce(list_sum({lens.format('j[m - k + 2:m]')}), 0) <= {overlap}))"
    joined = "t[1] || coalesce(array_to_string(list_transform(range(2, m + 1), lambda k: j[k] || t[k]), ''), '')"
    return rf"""
  ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS number FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM {source})),
  solid AS (SELECT *, regexp_matches(line, '{K.HEADING}') AS heading, number - row_number() OVER (PARTITION BY doc_id ORDER BY number) AS run FROM ln WHERE regexp_matches(line, '[^\s\p{{Z}}]')),
  runs AS (SELECT doc_id, run, count(*) = 1 AND bool_or(heading) AS alone FROM solid GROUP BY ALL),
  numbered AS (SELECT doc_id, run, sum((NOT (coalesce(lag_alone, false) AND NOT alone))::INT) OVER (PARTITION BY doc_id ORDER BY run) AS paragraph FROM (SELECT *, lag(alone) OVER (PARTITION BY doc_id ORDER BY run) AS lag_alone FROM runs)),
  placed AS (SELECT s.*, paragraph, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY number) AS in_paragraph FROM solid s JOIN numbered USING (doc_id, run)),
  cut AS (SELECT *, CASE WHEN heading THEN [line] ELSE string_split(regexp_replace(line, {quoted(K.SENTENCE_CUT)}, '\1\2' || chr(64976) || '\3', 'g'), chr(64976)) END AS l FROM placed),
  piece AS (SELECT doc_id, number, heading, paragraph, in_paragraph, unnest(l) AS piece, generate_subscripts(l, 1) AS k FROM cut),
  word AS (SELECT *, regexp_replace(lower(regexp_extract(piece, {quoted(K.LAST_WORD)}, 1)), {quoted('^[("' + "'" + '“‘]+')}, '') AS word, sum(length(piece) - length(replace(piece, '$', ''))) OVER (PARTITION BY doc_id, number ORDER BY k) AS dollars FROM piece),
  ends AS (SELECT *, (dollars % 2 = 1 OR list_contains({sql_list(K.ABBREVIATIONS)}, word) OR regexp_matches(word, '^\p{{L}}$'))::INT AS goes_on FROM word),
  sent AS (SELECT *, coalesce(sum(1 - goes_on) OVER (PARTITION BY doc_id, number ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM ends),
  whole AS (SELECT doc_id, number, heading, paragraph, in_paragraph, sentence, CASE WHEN heading THEN string_agg(piece, '' ORDER BY k) ELSE {strip_sql("string_agg(piece, '' ORDER BY k)")} END AS t FROM sent GROUP BY doc_id, number, heading, paragraph, in_paragraph, sentence),
  cutting(doc_id, number, heading, paragraph, in_paragraph, sentence, part, now, rest) AS (
    SELECT doc_id, number, heading, paragraph, in_paragraph, sentence, 0, NULL::VARCHAR, t FROM whole WHERE t <> ''
    UNION ALL
    SELECT doc_id, number, heading, paragraph, in_paragraph, sentence, part + 1, CASE WHEN length(rest) <= {budget} THEN rest ELSE {strip_sql("substr(rest, 1, edge)")} END, CASE WHEN length(rest) <= {budget} THEN '' ELSE regexp_replace(substr(rest, edge + 1), '^[\s\p{{Z}}]+', '') END
    FROM (SELECT *, CASE WHEN contains(substr(rest, 1, {budget + 1}), ' ') AND instr(reverse(substr(rest, 1, {budget + 1})), ' ') <= {budget} THEN {budget + 1} - instr(reverse(substr(rest, 1, {budget + 1})), ' ') ELSE {budget} END AS edge FROM cutting WHERE rest <> '')
  ),
  parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY sentence, part) AS in_line FROM cutting WHERE now <> ''),
  unit AS (SELECT *, CASE WHEN in_line > 1 THEN ' ' WHEN in_paragraph > 1 THEN chr(10) ELSE chr(10) || chr(10) END AS joiner, row_number() OVER (PARTITION BY doc_id ORDER BY number, in_line) AS i FROM parts),
  units AS (SELECT *, sum(length(joiner) + length(now)) OVER (PARTITION BY doc_id, paragraph) AS paragraph_size FROM unit),
  machine(doc_id, step, i, t, j, ln, h, carried, weighed, emitted, first_line, last_line) AS (
    SELECT DISTINCT doc_id, 0, 1::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[], []::BOOLEAN[], 0::BIGINT, false, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM units
    UNION ALL
    SELECT doc_id, step + 1,
      CASE WHEN act = 'append' THEN i + 1 WHEN act = 'end' THEN NULL ELSE i END,
      CASE act WHEN 'append' THEN t || [u] WHEN 'drop' THEN t[2:] WHEN 'close' THEN (CASE WHEN tailed THEN [tail] ELSE t[m - fit + 1:m] END) || t[m + 1:n] END,
      CASE act WHEN 'append' THEN j || [uj] WHEN 'drop' THEN j[2:] WHEN 'close' THEN (CASE WHEN tailed THEN [j[m]] ELSE j[m - fit + 1:m] END) || j[m + 1:n] END,
      CASE act WHEN 'append' THEN ln || [ul] WHEN 'drop' THEN ln[2:] WHEN 'close' THEN (CASE WHEN tailed THEN [ln[m]] ELSE ln[m - fit + 1:m] END) || ln[m + 1:n] END,
      CASE act WHEN 'append' THEN h || [uh] WHEN 'drop' THEN h[2:] WHEN 'close' THEN (CASE WHEN tailed THEN [false] ELSE h[m - fit + 1:m] END) || h[m + 1:n] END,
      CASE act WHEN 'append' THEN carried WHEN 'drop' THEN carried - 1 WHEN 'close' THEN CASE WHEN tailed THEN 1 ELSE fit END END,
      act <> 'append', CASE WHEN act IN ('close', 'end') THEN shown END, CASE WHEN act IN ('close', 'end') THEN ln[1] END, CASE WHEN act IN ('close', 'end') THEN ln[m] END
    FROM (
      SELECT *, CASE WHEN length(t[m]) > {overlap} THEN (CASE WHEN instr(substr(t[m], length(t[m]) - {overlap} + 1), ' ') BETWEEN 1 AND {overlap - 1} THEN substr(t[m], length(t[m]) - {overlap} + instr(substr(t[m], length(t[m]) - {overlap} + 1), ' ') + 1) ELSE substr(t[m], length(t[m]) - {overlap} + 1) END) ELSE t[m] END AS tail,
             fit = 0 AND kept_size > {overlap} AS tailed
      FROM (
        SELECT *, {joined} AS shown, {fits} AS fit, list_sum({lens.format('t[1:m]')}) + coalesce(list_sum({lens.format('j[2:m]')}), 0) AS kept_size
        FROM (
          SELECT *, n - CASE WHEN act = 'close' THEN {waiting} ELSE 0 END AS m
          FROM (
            SELECT *, CASE WHEN u IS NULL THEN 'end'
              WHEN NOT weighed AND n > carried AND uj = chr(10) || chr(10) AND up > {budget} - size AND size >= {budget // 2} THEN 'close'
              WHEN n > 0 AND size + length(uj) + length(u) > {budget} THEN CASE WHEN n > carried THEN 'close' ELSE 'drop' END
              ELSE 'append' END AS act
            FROM (SELECT mc.*, len(t) AS n, {size} AS size, x.now AS u, x.joiner AS uj, x.number AS ul, x.heading AS uh, x.paragraph_size AS up FROM machine mc LEFT JOIN units x ON x.doc_id = mc.doc_id AND x.i = mc.i WHERE mc.i IS NOT NULL)
          ) WHERE act <> 'end' OR n > carried
        )
      )
    )
  ),
  passages AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS ordinal, emitted AS text, first_line::INT AS start_line, last_line::INT AS end_line FROM machine WHERE emitted IS NOT NULL)"""


_CHUNKS = "SELECT doc_id, ordinal, text, start_line, end_line, sha256(doc_id || chr(0) || ordinal || chr(0) || text) AS chunk_id FROM passages"


@query(f"WITH RECURSIVE {_passages_sql('documents')} {_CHUNKS}")
def c1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C8."""
    return passages.chunk(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""WITH RECURSIVE headed AS (SELECT doc_id, '# About' || chr(10) || chr(10) || '## First' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10) || '### Next part' || chr(10) || chr(10)) || chr(10) || '# End' AS text FROM documents),
  {_passages_sql('headed')} {_CHUNKS}""")
def c3_headed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C8 of texts whose lines are paragraphs under headings."""
    parts = F.replace("text", F.lit("\n"), F.lit("\n\n### Next part\n\n"))
    headed = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# About\n\n## First\n\n"), parts, F.lit("\n# End")).alias("text"))
    return passages.chunk(headed)


# Attributions.

_HEADINGS = ["Adaptive correction — Jiang et al. (2026)", "A plain heading", "Hu (2019): codes of light", "Waves, Hu and Li (2019)"]
_SHOWN = ["Adaptive correction", "A plain heading", "codes of light", "Waves"]
_WHO = ["Jiang", "", "Hu", "Hu"]
_CITED = ["Jiang et al., 2026", "", "Hu, 2019", "Hu and Li, 2019"]


@query(rf"""WITH b AS (SELECT item_id, text, split_part(text, chr(10) || chr(10), 1) AS first, {sql_list(_SHOWN)}[1 + item_id % 4] AS theme, {sql_list(_WHO)}[1 + item_id % 4] AS who, {sql_list(_CITED)}[1 + item_id % 4] AS cited FROM benchmark),
  t AS (SELECT *, regexp_replace(first, '[\s\p{{Z}}]+$', '') AS f FROM b), e AS (SELECT *, regexp_extract(f, '([.!?])$', 1) AS stop FROM t)
  SELECT item_id, theme, CASE WHEN who = '' OR contains(lower(text), lower(who)) THEN text ELSE substr(f, 1, length(f) - length(stop)) || ' (' || cited || ')' || stop || substr(text, length(first) + 1) END AS text FROM e""")
def x4_move_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    return b.select("item_id", markup.move_attribution(choice(F.col("item_id"), _HEADINGS), "text").alias("m")).select("item_id", "m.theme", "m.text")


# Evidence ids.

_ID = "72cacfe1-cb0a-4d2e-9f1b-0a1b2c3d4e5f"
#: How a model writes ids into its prose, and what is there once they are gone.
_LEAKS = [f" [evidence_id: {_ID}].", f" ({_ID}) so", f" evidence ids {_ID} and {_ID} , then"]
_GONE = [" .", " so", " , then"]


def _tidy_sql(t: str) -> str:
    """What X6 leaves of a text whose ids are gone."""
    closed = rf"regexp_replace(regexp_replace({t}, '\(\s*\)|\[\s*\]', '', 'g'), '\s+(?:(?:and|,)\s*(,)|([,.;:]))', '\1\2', 'g')"
    return strip_sql(rf"regexp_replace({closed}, '[ \t]{{2,}}', ' ', 'g')")


@query(f"WITH c AS (SELECT conv_id, turn, text || {sql_list(_GONE)}[1 + turn % 3] AS t FROM conversations) SELECT conv_id, turn, {_tidy_sql('t')} AS clean FROM c")
def x6_strip_evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that were put into conversations go again."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", markup.strip_ids(F.concat("text", choice(F.col("turn"), _LEAKS))).alias("clean"))


# Formulas that a decoder ate.

_EATEN = [" $S = k_B \text{ln} @Omega$", " $S = \x1a$", r" and \\alpha \beta x"]
_WHOLE = [r" $S = k_B \text{ln} \Omega$", " $S = $", r" and \\alpha \beta x"]


@query(rf"""WITH c AS (SELECT conv_id, turn, replace(text, '$', '') AS t FROM conversations),
  r AS (SELECT conv_id, turn, regexp_replace(t, '[\x00-\x09\x0b-\x1f]', '', 'g') || {sql_list(_WHOLE)}[1 + turn % 3] AS restored, t || [' $S = k_B ' || chr(9) || 'ext{{ln}} @Omega$', ' $S = ' || chr(26) || '$', {quoted(_EATEN[2])}][1 + turn % 3] AS eaten FROM c)
  SELECT conv_id, turn, restored, turn % 3 = 1 AS damaged, regexp_replace(eaten, '\\+([a-zA-Z])', '@\1', 'g') AS channel, {_tidy_sql('restored')} AS shown FROM r""")
def x9_restore_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 to X10, X20."""
    c = read_table(spark, sf_dir, "conversations")
    eaten = F.concat(F.replace("text", F.lit("$"), F.lit("")), choice(F.col("turn"), _EATEN))
    return c.select("conv_id", "turn", markup.restore_latex(eaten).alias("restored"), markup.damaged_maths(eaten).alias("damaged"), markup.to_channel(eaten).alias("channel"), markup.presentable(eaten).alias("shown"))


# Equations.


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?s){K.MATH_SPAN}') AS m FROM documents) SELECT doc_id, len(m) AS n_spans FROM t""")
def x12_math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(markup.math_spans("text")).cast("long").alias("n_spans"))


_SIGNS = "$=\\`@≥≤≈∝"
#: Ends that set equations on their own and in the line, write them in plain characters, and fence them.
_EQUATIONS = ["\n\nEnergy is $$E = mc^2$$ and $x$; F = ma holds, n = 120 too.", "\n\\[ a \\leq b \\] and $S = k_B \\ln \\Omega$ of https://a.org/?x=y", "\n```\n$y = z$ and q = r\n```\nno more", ""]


def _with_equations(text: Column, number: Column) -> Column:
    return F.concat(F.translate(text, _SIGNS, ""), choice(number, _EQUATIONS))


def _equations_sql(table: str, keys: str, number: str) -> str:
    """CTEs that end in ``eq``: keys, bodies of formulas outside fences, those set on their own, and the text p without formulas and addresses."""
    wide = r"(starts_with(x, '$$') OR starts_with(x, '\['))"
    return rf"""
  eq0 AS (SELECT {keys}, {number} AS number, translate(text, {quoted(_SIGNS)}, '') || {sql_list(_EQUATIONS)}[1 + {number} % 4] AS t FROM {table}),
  eq1 AS (SELECT * EXCLUDE (t), regexp_replace(t, '(?s)\n```\n.*\n```\n', chr(10)) AS t FROM eq0),
  eq2 AS (SELECT *, regexp_extract_all(t, '(?s){K.MATH_SPAN}', 0) AS m, regexp_replace(regexp_replace(t, '(?s){K.MATH_SPAN}', ' ', 'g'), '{K.ADDRESS}', ' ', 'g') AS p FROM eq1),
  eq AS (SELECT *, list_transform(m, lambda x: CASE WHEN {wide} THEN substr(x, 3, length(x) - 4) ELSE substr(x, 2, length(x) - 2) END) AS bodies,
         list_transform(list_filter(m, lambda x: {wide} AND regexp_matches(x, '{K.RELATION}')), lambda x: trim(substr(x, 3, length(x) - 4))) AS display FROM eq2)"""


@query(rf"""WITH {_equations_sql('documents', 'doc_id', 'doc_id')}
  SELECT doc_id, array_to_string(bodies, ' | ') AS bodies, array_to_string(display, ' | ') AS display, array_to_string(regexp_extract_all(p, '(?:^|[^{K.BEFORE_EQUATION}])({K.PLAIN_EQUATION})', 1), ' | ') AS plain,
         len(list_filter(bodies, lambda x: regexp_matches(x, '{K.RELATION}'))) > 0 AS states, number % 4 = 0 AS typesets, number % 4 = 0 AS mentions FROM eq""")
def x13_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formulas a document sets, and how."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", _with_equations(F.col("text"), F.col("doc_id")).alias("text"))
    lists = {"bodies": markup.math_spans("text"), "display": markup.display_equations("text"), "plain": markup.plain_equations("text")}
    flags = {"states": markup.states_equation("text"), "typesets": markup.typesets("text", F.lit("E = mc²")), "mentions": markup.mentions("text", F.lit("F = ma"))}
    return d.select("doc_id", *[F.array_join(c, " | ").alias(n) for n, c in lists.items()], *[c.alias(n) for n, c in flags.items()])


def _stating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the passages that were chosen for it."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("question_id"), _with_equations(F.col("text"), F.col("conv_id") + F.col("turn")).alias("text"))


@query(f"WITH {_equations_sql('conversations', 'conv_id, turn', '(conv_id + turn)')} SELECT conv_id AS question_id, sum(len(display))::BIGINT AS stated FROM eq GROUP BY conv_id")
def a10_stated_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.stated_equations(_stating(spark, sf_dir))


#: Ends of answers: none, an id that leaked, a broken formula, an equation in plain characters, one that is set.
_ANSWERS = ["", " evidence_id", " $S = \x1a$", " F = ma.", " $$E = mc^2$$."]


@query(f"""WITH {_equations_sql('conversations', 'conv_id, turn', '(conv_id + turn)')}, stated AS (SELECT conv_id, sum(len(display)) AS stated FROM eq GROUP BY conv_id),
  a AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS v, stated FROM conversations JOIN stated USING (conv_id)),
  f AS (SELECT conv_id AS question_id, turn AS attempt, 100 * (v = 1)::INT + 10 * (v = 2)::INT + 5 * (stated > 0 AND v NOT IN (2, 4))::INT + (v = 3)::INT AS flaws FROM a)
  SELECT question_id, attempt, flaws FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY flaws, attempt) AS r FROM f) WHERE r = 1""")
def a11_examined_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11, X7, X10, X13, X14 from what stands in the texts: turns as attempts at an answer."""
    c = read_table(spark, sf_dir, "conversations")
    ended = F.concat(F.translate("text", _SIGNS, ""), choice(F.col("conv_id") + F.col("turn"), _ANSWERS))
    answers = c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("attempt"), ended.alias("text"))
    return evidence.best_attempt(evidence.examine(answers, evidence.stated_equations(_stating(spark, sf_dir))))


@query(f"""WITH {_equations_sql('conversations', 'conv_id, turn', '(conv_id + turn)')}, stated AS (SELECT conv_id, sum(len(display)) AS stated FROM eq GROUP BY conv_id),
  c AS (SELECT conv_id AS question_id, turn % 2 AS attempt, turn AS claim_idx, (conv_id + turn // 2) % 5 AS v FROM conversations),
  a AS (SELECT question_id, attempt, max((v = 1)::INT) AS leak, max((v = 2)::INT) AS damaged, max((v IN (2, 4))::INT) AS states, sum((v = 3)::INT) AS n_plain FROM c GROUP BY ALL),
  f AS (SELECT question_id, attempt, leak, (100 * leak + 10 * damaged + 5 * (stated > 0 AND states = 0)::INT + n_plain)::BIGINT AS flaws FROM a JOIN stated ON conv_id = question_id),
  b AS (SELECT question_id, attempt, leak, flaws FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY flaws, attempt) = 1)
  SELECT question_id, attempt, claim_idx, flaws FROM c JOIN b USING (question_id, attempt) WHERE leak = 0""")
def a11_least_flawed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, X4, X7, X10, X13, X14, X20 as the plan joins them: even and odd turns as two answers of a claim each turn."""
    c = read_table(spark, sf_dir, "conversations")
    ended = F.concat(F.translate("text", _SIGNS, ""), choice(F.col("conv_id") + F.floor(F.col("turn") / 2), _ANSWERS))
    claims = c.select(F.col("conv_id").alias("question_id"), (F.col("turn") % 2).alias("attempt"), F.col("turn").alias("claim_idx"), ended.alias("text"), F.lit("").alias("theme"))
    shown = evidence.presented(claims)
    examined = evidence.examine_claims(shown, claims.select("question_id", "attempt").distinct(), evidence.stated_equations(_stating(spark, sf_dir)))
    return evidence.least_flawed(shown, examined).select("question_id", "attempt", "claim_idx", F.col("flaws").cast("long").alias("flaws"))


# Formulas of a wiki.


def _image(style: str) -> str:
    return rf"![{{\{style} S=k\ln \Omega }}](https://wikimedia.org/api/rest_v1/media/math/render/svg/abc123)"


def _copies(style: str) -> str:
    return rf"S=kln⁡Ω{{\\{style} S=k\\ln \\Omega }}" + _image(style)


_RENDERED = [f"\nThus {_copies('textstyle')} holds", f"\n{_copies('displaystyle')}\nholds", f" glued{_image('displaystyle')}", ""]
_COLLAPSED = ["\nThus $S=k\\ln \\Omega$ holds", "\n$$S=k\\ln \\Omega$$\nholds", " glued $S=k\\ln \\Omega$", ""]


@query(f"SELECT doc_id, text || {sql_list(_COLLAPSED)}[1 + doc_id % 4] AS text FROM documents")
def x15_wiki_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas in the copies that a wiki renders, put after each text."""
    rendered = F.concat("text", choice(F.col("doc_id"), _RENDERED))
    return read_table(spark, sf_dir, "documents").select("doc_id", prose.collapse_wiki_maths_udf(rendered).alias("text"))


_DELIMITED = ["a $x$ b", "$5 and $10", "$$\nx\n$$ end", "\\(y\\) and \\[z\\]"]
_SEGMENTS = ["text:a |math:x:false|text: b", "text:$5 and $10", "math:x:true|text: end", "math:y:false|text: and |math:z:true"]


@query(f"SELECT item_id, CASE WHEN item_id % 4 IN (0, 1) THEN 'text:' || t || substr(s, 6) WHEN t = '' THEN s ELSE 'text:' || t || '|' || s END AS segments FROM (SELECT item_id, translate(text, '$\\', '') AS t, {sql_list(_SEGMENTS)}[1 + item_id % 4] AS s FROM benchmark)")
def x16_parse_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and formula segments; what is no formula stays plain."""
    text = F.concat(F.translate("text", "$\\", ""), choice(F.col("item_id"), _DELIMITED))
    shown = F.transform("s", lambda x: F.concat_ws(":", x["type"], x["value"], x["display"].cast("string")))
    return read_table(spark, sf_dir, "benchmark").select("item_id", prose.parse_math_udf(text).alias("s")).select("item_id", F.array_join(shown, "|").alias("segments"))
