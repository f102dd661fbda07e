"""From a table of questions to a table of answers: plan, search, read, rank, judge, write, verify, grade, one retry.

Each stage is a DataFrame-to-DataFrame function over all questions at once; the retry is unrolled, and
questions are split, not looped over. Tables are written at the fan-in points only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions.prose import collapse_wiki_maths_udf
from lodestone.functions.text import shortfall, wants_recent
from lodestone.operators import evidence, mirrors, passages, ranking, selection
from lodestone.plans.stage import staged
from lodestone.plans.trail import trail_of
from lodestone.sources.providers import EmbeddingsProvider, LanguageModel, RuleModel, SearchProvider


@dataclass
class Research:
    """The pipeline with its services; without ``embeddings``, or where these fail, passages are ranked by their terms.

    ``year`` is the present one, by which a question is told to ask for what is recent.
    """

    search: SearchProvider
    model: LanguageModel = field(default_factory=RuleModel)
    limit: int = K.MAX_SOURCES
    embeddings: EmbeddingsProvider | None = None
    year: int = field(default_factory=lambda: date.today().year)
    passes: list[DataFrame] = field(default_factory=list, init=False, repr=False)

    def trail(self) -> DataFrame:
        """The steps of the last run, of both its passes."""
        if not self.passes:
            raise ValueError("nothing has been run")
        out = self.passes[0]
        for part in self.passes[1:]:
            out = out.unionByName(part)
        return out

    def plan(self, questions: DataFrame) -> DataFrame:
        """Stage 2: (question_id, query_idx, query) of the searches that stay on the subject, the question first."""
        asked = questions.select("question_id", F.col("search_query").alias("question"), wants_recent("question", self.year).alias("recent"))
        kept = evidence.clean_plan(self.model.plan_searches(asked), questions)
        return kept.where("not drifted").select("question_id", F.col("place").alias("query_idx"), "query")

    def choose(self, questions: DataFrame, planned: DataFrame) -> DataFrame:
        """Stage 3: the pages to read."""
        return selection.select_sources(self.search.search(planned), questions, limit=self.limit, asked=planned)

    def read(self, chosen: DataFrame) -> DataFrame:
        """Stage 4: passages of the pages that could be read, without mirrors and equal passages."""
        scraped = self.search.scrape(chosen).withColumn("markdown", collapse_wiki_maths_udf("markdown"))
        pages = evidence.page_status(chosen.join(scraped.select("url", "markdown"), "url", "left")).where("status = 'ok'")
        mirrored = mirrors.find_mirrors(pages.select("question_id", F.col("place").alias("doc_id"), F.col("place").alias("ordinal"), F.col("markdown").alias("text"), "title"))
        kept = pages.join(mirrored.where("mirror_of is not null").select("question_id", F.col("doc_id").alias("place")), ["question_id", "place"], "left_anti")
        cut = passages.chunk(kept.select("question_id", "place", F.col("url").alias("source_url"), "title", F.col("markdown").alias("text")), key="source_url")
        return passages.first_of_equal(cut.withColumnRenamed("place", "page_place"), ["page_place", "ordinal"], within=["question_id"])

    def rank(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        """Stage 5: the passages of each question by their distance, else by its terms (those without any after them), then
        in page order, spread over pages."""

        def ranked(scored: DataFrame, first: Column) -> DataFrame:
            by = [first, F.col("page_place"), F.col("ordinal")]
            # no more passages of a page than are wanted in all can be among them
            own = ranking.top_k(scored, K.TOP_PASSAGES, by, ["question_id", "source_url"])
            return ranking.top_k(own, K.TOP_PASSAGES * self.limit, by)

        terms = chunks.join(ranking.bm25_within(questions, chunks), ["question_id", "chunk_id"], "left")
        order = ranked(terms, F.desc(F.coalesce("score", F.lit(0.0)))).select("question_id", "chunk_id", "rank")
        if self.embeddings is not None:
            passage = self.embeddings.embed(chunks.select("question_id", "chunk_id", "text"), "d")
            asked = self.embeddings.embed(questions.select("question_id", F.col("question").alias("text")), "q")
            near = chunks.join(ranking.distance_within(asked, passage), ["question_id", "chunk_id"])
            order = ranking.with_fallback(staged(ranked(near, F.col("distance")).select("question_id", "chunk_id", "rank"), "nearest"), order, questions).drop("method")
        return ranking.spread(chunks.join(order, ["question_id", "chunk_id"]), K.TOP_PASSAGES)

    def judge(self, questions: DataFrame, spread: DataFrame) -> DataFrame:
        """Stage 6: the passages that bear on their question."""
        batched = evidence.judge_batches(spread, order="place")
        return evidence.keep_relevant(batched, self.model.grade_relevance(questions, batched))

    def answer(self, questions: DataFrame, relevant: DataFrame) -> DataFrame:
        """Stages 7 and 8: claims, presentable and grounded in passages that were read.

        Questions whose answer has flaws that no filter mends are answered again, and the least flawed of
        their answers is kept.
        """
        stated = staged(evidence.stated_equations(relevant), "stated")
        waiting, passages, shown, examined = questions.join(stated.select("question_id"), "question_id", "left_semi"), relevant, [], []
        for number in range(K.MAX_GENERATIONS):
            claims = self.model.generate_answer(waiting, passages)
            shown.append(staged(evidence.presented(claims).withColumn("attempt", F.lit(number)), "generated"))
            examined.append(staged(evidence.examine_claims(shown[-1], waiting.select("question_id", F.lit(number).alias("attempt")), stated), "examined"))
            flawed = examined[-1].where("flaws > 0").select("question_id")
            if flawed.isEmpty():
                break
            waiting, passages = (df.join(flawed, "question_id", "left_semi") for df in (waiting, relevant))
        best = evidence.least_flawed(reduce(DataFrame.unionByName, shown), reduce(DataFrame.unionByName, examined))
        return evidence.verify_claims(best.drop("attempt", "flaws"), relevant)

    def attempt(self, questions: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """One pass over ``questions`` (question_id, question, search_query): grounded claims, and a grade for each question."""
        planned = staged(self.plan(questions), "planned")
        chosen = staged(self.choose(questions, planned), "chosen")
        chunks = staged(self.read(chosen), "passages")
        spread = staged(self.rank(questions, chunks), "spread")
        relevant = staged(self.judge(questions, spread), "relevant")
        claims = staged(self.answer(questions, relevant), "claims")
        grades = self.model.grade_answer(questions, claims)
        graded = grades.select("question_id", F.col("is_satisfactory").alias("sufficient"), F.lit(number).alias("retry_count"), "problem", shortfall("problem", "missing", "reasoning").alias("shortfall"))
        verdicts = staged(evidence.next_step(graded), "graded")
        self.passes.append(trail_of(planned, chosen, chunks, relevant, claims, verdicts, number))
        return claims.withColumn("attempt", F.lit(number)), verdicts

    def run(self, questions: DataFrame) -> DataFrame:
        """(question_id, question, claims, attempt, evidence_sufficient, shortfall) for (question_id, question).

        A question whose second pass has a grounded claim is answered by it, else by its first, which
        then counts as insufficient.
        """
        self.passes.clear()
        first = questions.select("question_id", "question", F.col("question").alias("search_query"))
        claims0, graded0 = self.attempt(first, 0)
        again = first.join(graded0.where("next = 'refine'").select("question_id"), "question_id", "left_semi")
        refined = staged(again.drop("search_query").join(self.model.refine_query(again), "question_id"), "refined")
        claims1, graded1 = self.attempt(refined, 1)
        answered = claims1.select("question_id").distinct().withColumn("better", F.lit(True))
        last = claims0.join(answered, "question_id", "left_anti").unionByName(claims1)
        folded = last.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", "text", "evidence_ids", "confidence", "theme"))).alias("claims"), F.max("attempt").alias("attempt"))
        verdict = graded0.select("question_id", "sufficient", "shortfall", "next").join(graded1.select("question_id", F.col("sufficient").alias("sufficient1"), F.col("shortfall").alias("shortfall1")), "question_id", "left")
        joined = first.join(folded, "question_id", "left").join(verdict, "question_id")
        sufficient = F.when(F.col("attempt") == 1, F.col("sufficient1")).otherwise(F.col("sufficient") & F.col("attempt").isNotNull())
        return joined.select("question_id", "question", F.coalesce("claims", F.array().cast(folded.schema["claims"].dataType)).alias("claims"), "attempt", F.coalesce(sufficient, F.lit(False)).alias("evidence_sufficient"), F.coalesce("shortfall1", "shortfall").alias("shortfall"))
