"""The trail of a pass: what was planned, found, read, judged and written, as rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import counted, label, short_host

#: Kinds of step, in the order of the stages.
KINDS = "plan search rank source_found scrape_ok scrape_failed mirror_dropped collect select grade_relevance generate verify grade_answer refine".split()
TRAIL_DDL = "question_id long, attempt int, stage int, place long, kind string, label string, url string, title string, detail string"


def _rows(df: DataFrame, kind: str, said: Column, attempt: int, place: Column, url: Column | None = None, title: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.col("question_id").cast("long").alias("question_id"), F.lit(attempt).alias("attempt"), F.lit(KINDS.index(kind)).alias("stage"), place.cast("long").alias("place"), F.lit(kind).alias("kind"),
        said.alias("label"), (none if url is None else url).alias("url"), (none if title is None else title).alias("title"), (none if detail is None else detail).alias("detail"),
    )


def trail_of(planned: DataFrame, chosen: DataFrame, passages: DataFrame, relevant: DataFrame, claims: DataFrame, graded: DataFrame, attempt: int) -> DataFrame:
    """One table of the steps of a pass; ``stage`` and ``place`` order a question's steps."""
    zero = F.lit(0)
    plan = planned.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_idx", "query"))), lambda s: s["query"]), " · ").alias("d"))
    named = F.coalesce(F.nullif(label("title"), F.lit("")), short_host("url"))
    pages = passages.groupBy("question_id", F.col("source_url").alias("url"), "page_place").agg(F.count(F.lit(1)).alias("n"))
    unread = chosen.join(pages.select("question_id", "url"), ["question_id", "url"], "left_anti")
    per = lambda df: df.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        _rows(plan, "plan", F.concat(F.lit("Planned "), counted("n", "search")), attempt, zero, detail=F.col("d")),
        _rows(chosen, "source_found", named, attempt, F.col("place"), F.col("url"), named),
        _rows(pages, "scrape_ok", F.concat(F.lit("Read "), short_host("url")), attempt, F.col("page_place"), F.col("url"), detail=counted("n", "passage")),
        _rows(unread, "scrape_failed", F.concat(F.lit("Set aside "), short_host("url")), attempt, F.col("place"), F.col("url"), named),
        _rows(per(passages), "collect", F.concat(F.lit("Collected "), counted("n", "passage")), attempt, zero),
        _rows(per(relevant), "grade_relevance", F.concat(F.lit("Kept "), counted("n", "passage")), attempt, zero),
        _rows(per(claims), "generate", F.concat(F.lit("Wrote "), counted("n", "claim")), attempt, zero),
        _rows(graded, "grade_answer", F.when(F.col("sufficient"), "The answer will do").otherwise("The answer falls short"), attempt, zero, detail=F.when(~F.col("sufficient"), F.col("shortfall"))),
        _rows(graded.where("next = 'refine'"), "refine", F.lit("Searching again"), attempt, zero),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(trail: DataFrame) -> DataFrame:
    """Adds seq, from 0 for each question, over all its passes."""
    w = Window.partitionBy("question_id").orderBy("attempt", "stage", "place", "url")
    return trail.withColumn("seq", F.row_number().over(w) - 1)
