"""Tables as sources and sinks: search results from raw pages, requests, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import constants as K

RESULT_DDL = "question_id long, query_idx int, rank int, title string, url string, snippet string"


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, the usual entities back."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    broken = F.regexp_replace(bare, r"(?i)<(?:br|p|/p|div|/div|li|h[1-6]|/h[1-6])\b[^>]*>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def scraped_pages(pages: DataFrame) -> DataFrame:
    """S3: (page_id, url, title, markdown) of raw pages (page_id, url, html)."""
    return pages.select("page_id", "url", page_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("markdown"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Adds valid and reason: a question of 3 to 500 characters, a limit of 1 to 20 (5 where none is given)."""
    low, high = K.QUESTION_CHARS
    limit = F.coalesce("limit", F.lit(5))
    reason = F.when(F.col("question").isNull(), "no question").when(F.length("question") < low, "too short").when(F.length("question") > high, "too long").when(~limit.between(1, 20), "limit")
    return requests.withColumn("limit", limit).withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def since(rows: DataFrame, year: int, column: str = "published_year") -> DataFrame:
    """A plain predicate, so it reaches the scan."""
    return rows.where(F.col(column) >= year)


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines, null fields included."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def split_records(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): the rows of JSON lines, and as (line) those that are no object or don't fit ``ddl``; blank lines are neither."""
    fields = StructType.fromDDL(ddl)
    whole = StructType([*fields.fields, StructField("__damaged", StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", whole, {"columnNameOfCorruptRecord": "__damaged"}).alias("record"))
    # other text than an object gives no record at all
    damaged = F.col("record").isNull() | F.col("record").getField("__damaged").isNotNull()
    records = parsed.where(~damaged).select(*[F.col("record").getField(f.name).alias(f.name) for f in fields])
    return records, parsed.where(damaged).select(F.col("value").alias("line"))
