"""Judging, verifying and assembling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions.markup import damaged_maths, display_equations, move_attribution, plain_equations, presentable, states_equation
from lodestone.functions.text import id_leak, on_topic, strip, tidy_theme


def clean_plan(planned: DataFrame, questions: DataFrame, limit: int = K.MAX_QUERIES) -> DataFrame:
    """(question_id, query, place, drifted) of planned queries (question_id, idx, query).

    Blank ones go; those off the subject are marked drifted and have no place; the question itself
    leads where it isn't among the kept; no more than ``limit`` are kept.
    """
    joined = planned.select("question_id", "idx", strip("query").alias("query")).where("query <> ''").join(questions.select("question_id", "question"), "question_id")
    marked = joined.withColumn("drifted", ~on_topic("query", "question"))
    present = marked.where("not drifted").groupBy("question_id").agg(F.max(F.col("query") == F.col("question")).alias("asked"))
    missing = questions.join(present, "question_id", "left").where(~F.coalesce("asked", F.lit(False)))
    leading = missing.select("question_id", F.lit(-1).alias("idx"), F.col("question").alias("query"), F.lit(False).alias("drifted"))
    w = Window.partitionBy("question_id").orderBy("idx")
    kept = marked.where("not drifted").select("question_id", "idx", "query", "drifted").unionByName(leading).withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < limit)
    gone = marked.where("drifted").select("question_id", "idx", "query", "drifted", F.lit(None).cast("int").alias("place"))
    return kept.unionByName(gone).select("question_id", "query", "place", "drifted")


def judge_batches(passages: DataFrame, size: int = K.JUDGE_BATCH, order: str = "rank") -> DataFrame:
    """Adds batch_id, ``size`` passages of a question each in order."""
    w = Window.partitionBy("question_id").orderBy(order)
    return passages.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def keep_relevant(batched: DataFrame, grades: DataFrame) -> DataFrame:
    """Passages that a verdict of their question names, and all of a batch whose call failed.

    grades: question_id, batch_id, relevant_ids; a null list or a missing row is a failed call.
    """
    named = grades.select("question_id", F.explode("relevant_ids").alias("chunk_id")).distinct().withColumn("__named", F.lit(True))
    worked = grades.where("relevant_ids is not null").select("question_id", "batch_id").distinct().withColumn("__worked", F.lit(True))
    joined = batched.join(named, ["question_id", "chunk_id"], "left").join(worked, ["question_id", "batch_id"], "left")
    return joined.where("__named or __worked is null").select(*batched.columns)


def verify_claims(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims with the evidence ids that exist, in their order and as often as given; without any, the claim goes."""
    each = claims.select("question_id", "claim_idx", F.posexplode("evidence_ids").alias("__pos", "chunk_id"))
    valid = each.join(passages.select("question_id", "chunk_id").distinct(), ["question_id", "chunk_id"], "left_semi")
    again = valid.groupBy("question_id", "claim_idx").agg(F.array_sort(F.collect_list(F.struct("__pos", "chunk_id"))).alias("__ids"))
    kept = claims.drop("evidence_ids").join(again, ["question_id", "claim_idx"])
    return kept.withColumn("evidence_ids", F.transform("__ids", lambda s: s["chunk_id"])).drop("__ids")


def verification_counts(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """how many claims of each question were kept, trimmed and dropped, and whether evidence suffices."""
    before = claims.select("question_id", "claim_idx", F.size("evidence_ids").alias("n0"))
    after = verified.select("question_id", "claim_idx", F.size("evidence_ids").alias("n1"))
    both = before.join(after, ["question_id", "claim_idx"], "left")
    return both.groupBy("question_id").agg(
        F.count("n1").alias("kept"), F.count_if((F.col("n1") < F.col("n0"))).alias("trimmed"), F.count_if(F.col("n1").isNull()).alias("dropped"), (F.count("n1") > 0).alias("sufficient")
    )


def page_status(pages: DataFrame, text: str = "markdown", error: Column | None = None) -> DataFrame:
    """F8: adds status: ok, unreadable (nothing to read) or limited (refused for quota)."""
    limited = F.lit(False) if error is None else F.coalesce(error == "rate_limit", F.lit(False))
    empty = F.col(text).isNull() | ~F.col(text).rlike(r"[^\s\p{Z}]")
    return pages.withColumn("status", F.when(limited, "limited").when(empty, "unreadable").otherwise("ok"))


def next_step(graded: DataFrame, most: int = K.MAX_RETRIES) -> DataFrame:
    """adds next: end or refine, from sufficient, retry_count and problem."""
    over = F.col("sufficient") | (F.col("retry_count") >= most) | F.coalesce(F.col("problem") == "not_a_research_question", F.lit(False))
    return graded.withColumn("next", F.when(over, "end").otherwise("refine"))


def cited_passages(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """A row for each citation of a claim, with its passage, in the claim's order."""
    each = claims.select("question_id", "claim_idx", F.posexplode("evidence_ids").alias("cite_idx", "chunk_id"))
    return each.join(passages, ["question_id", "chunk_id"])


def evidence_map(cited: DataFrame) -> DataFrame:
    """question_id and the map from chunk_id to its passage, each once."""
    once = cited.groupBy("question_id", "chunk_id").agg(F.first(F.struct("source_url", "text"), ignorenulls=True).alias("evidence"))
    return once.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "evidence")))).alias("evidence"))


def passages_by_page(cited: DataFrame) -> DataFrame:
    """For each claim its pages in the order first cited, with their passages."""
    w = Window.partitionBy("question_id", "claim_idx").orderBy("first")
    grouped = cited.groupBy("question_id", "claim_idx", "source_url").agg(F.min("cite_idx").alias("first"), F.array_sort(F.collect_list(F.struct("cite_idx", "chunk_id"))).alias("__p"))
    return grouped.withColumn("page_idx", F.row_number().over(w) - 1).select("question_id", "claim_idx", "source_url", "page_idx", F.transform("__p", lambda s: s["chunk_id"]).alias("chunk_ids"))


def number_themes(claims: DataFrame) -> DataFrame:
    """Adds theme_no (first-seen order; null without a theme) and new_section (the theme changes)."""
    seen = claims.where("coalesce(theme, '') <> ''").groupBy("question_id", "theme").agg(F.min("claim_idx").alias("__first"))
    numbered = seen.withColumn("theme_no", F.row_number().over(Window.partitionBy("question_id").orderBy("__first"))).drop("__first")
    before = F.lag("theme").over(Window.partitionBy("question_id").orderBy("claim_idx"))
    joined = claims.join(numbered, ["question_id", "theme"], "left")
    return joined.withColumn("new_section", F.col("theme_no").isNotNull() & ~F.col("theme").eqNullSafe(before))


def flaw_score() -> Column:
    """How flawed an attempt is, from leak, damaged, omitted and n_plain."""
    return K.FLAW_LEAK * F.col("leak").cast("int") + K.FLAW_DAMAGED * F.col("damaged").cast("int") + K.FLAW_OMITTED * F.col("omitted").cast("int") + F.col("n_plain")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt of each question with fewest flaws, the earlier of equals; leak, damaged, omitted, n_plain."""
    return attempts.withColumn("flaws", flaw_score()).groupBy("question_id").agg(F.min(F.struct("flaws", "attempt")).alias("b")).select("question_id", "b.attempt", "b.flaws")


def evidence_block(passages: DataFrame, order: str = "rank") -> DataFrame:
    """What a model reads: every passage under its id, a blank line between."""
    one = F.concat(F.lit("[evidence_id: "), F.col("chunk_id").cast("string"), F.lit("]\n"), F.col("text"))
    return passages.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), one.alias("t")))), lambda s: s["t"]), "\n\n").alias("block"))


def stated_equations(passages: DataFrame) -> DataFrame:
    """A10: (question_id, stated): how many equations the chosen passages of a question set on their own."""
    return passages.groupBy("question_id").agg(F.coalesce(F.sum(F.size(display_equations("text")).cast("long")), F.lit(0).cast("long")).alias("stated"))


def examine(attempts: DataFrame, stated: DataFrame) -> DataFrame:
    """A11's flaws of each attempt (question_id, attempt, text): adds leak, damaged, omitted and n_plain.

    An equation is omitted where passages state some (``stated``, see ``stated_equations``) and the answer none.
    """
    joined = attempts.join(stated, "question_id", "left")
    omitted = (F.coalesce("stated", F.lit(0)) > 0) & ~states_equation("text")
    return joined.withColumns({"leak": id_leak("text").isNotNull(), "damaged": damaged_maths("text"), "omitted": omitted, "n_plain": F.size(plain_equations(presentable("text")))}).drop("stated")


def presented(claims: DataFrame) -> DataFrame:
    """Claims (text, theme) as a reader sees them; what the model wrote is kept in raw_text and raw_theme."""
    moved = claims.withColumns({"raw_text": F.col("text"), "raw_theme": F.col("theme"), "__moved": move_attribution("theme", "text")})
    return moved.withColumns({"text": presentable(F.col("__moved.text")), "theme": tidy_theme(F.col("__moved.theme"))}).drop("__moved")


def examine_claims(shown: DataFrame, asked: DataFrame, stated: DataFrame) -> DataFrame:
    """A11's flaws of each attempt in ``asked`` (question_id, attempt): leak, damaged, omitted, n_plain and flaws.

    ``shown``: claims from ``presented`` with their attempt. Leaks and equations are looked for in what a
    reader sees, damage in what the model wrote. An attempt without claims omits what passages state.
    """

    def some(test, text: str, theme: str) -> Column:
        return F.bool_or(F.coalesce(test(text), F.lit(False)) | F.coalesce(test(theme), F.lit(False)))

    plain = F.coalesce(F.size(plain_equations("text")), F.lit(0)) + F.coalesce(F.size(plain_equations("theme")), F.lit(0))
    found = shown.groupBy("question_id", "attempt").agg(
        some(lambda t: id_leak(t).isNotNull(), "text", "theme").alias("leak"), some(damaged_maths, "raw_text", "raw_theme").alias("damaged"), some(states_equation, "text", "theme").alias("__states"), F.sum(F.greatest(plain, F.lit(0))).cast("int").alias("n_plain")
    )
    joined = asked.join(found, ["question_id", "attempt"], "left").join(stated, "question_id", "left").fillna(False, ["leak", "damaged", "__states"]).fillna(0, ["n_plain", "stated"])
    return joined.withColumn("omitted", (F.col("stated") > 0) & ~F.col("__states")).withColumn("flaws", flaw_score()).select("question_id", "attempt", "leak", "damaged", "omitted", "n_plain", "flaws")


def least_flawed(shown: DataFrame, examined: DataFrame) -> DataFrame:
    """The claims of each question's least flawed attempt, with its flaws; none where even that shows an id."""
    best = best_attempt(examined).join(examined.where("not leak").select("question_id", "attempt"), ["question_id", "attempt"], "left_semi")
    return shown.join(best, ["question_id", "attempt"]).drop("raw_text", "raw_theme")


def trail_counts(trail: DataFrame) -> DataFrame:
    """For each question the sources found, pages read and passes of its trail."""
    kind = F.col("kind")
    return trail.groupBy("question_id").agg(
        F.count_distinct(F.when(kind == "source_found", F.col("url"))).alias("sources"), F.count_if(kind == "scrape_ok").alias("read"), F.count_distinct("attempt").alias("passes")
    )
