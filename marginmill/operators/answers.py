"""Answers to questions: the fixed reports by topic, ad-hoc SQL, and tagging of question texts."""

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CODE_FENCES, GLOSSARY, INTENT_WORDS, SQL_WORDS
from ..functions.columns import contains_all, contains_any, replace_all
from .categories import category_sums
from .relational import top_k, value_counts


def answer_discount(performance: DataFrame) -> DataFrame:
    return performance.select("discount_pct", "revenue", "profit", "units_sold", "margin_pct")


def answer_campaigns(roi: DataFrame) -> DataFrame:
    return roi.select("campaign_name", "channel", "discount_pct", "budget", "revenue", "gross_profit", "roi_pct")


def answer_segments(summary: DataFrame) -> DataFrame:
    return summary.select("segment", "revenue", F.col("profit").alias("gross_profit"), "total_orders", "aov")


def answer_categories(totals: DataFrame, k: int = 5) -> DataFrame:
    return top_k(category_sums(totals), "gross_profit", k, "category")


def answer_kpis(summary: DataFrame) -> DataFrame:
    return summary.select("total_revenue", "total_profit", "avg_margin_pct")


def plain_sql(text: str) -> str:
    """The text without code fences around it; what stands inside of it stays."""
    text = text.strip()
    for fence in CODE_FENCES:
        text = text.removeprefix(fence)
    return text.removesuffix(CODE_FENCES[-1]).strip().rstrip(";")


#: Functions that run methods of the engine's own process.
REFLECTIVE = {"reflect", "java_method", "try_reflect"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _foreign_tables(plan, known: frozenset) -> Iterator[str]:
    """Tables that a parsed plan names and that are neither `known` nor common table expressions where they stand. The names
    come from the plan's nodes, never from text, which may hold anything in its literals."""
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        for relation in _items(plan.cteRelations()):
            name = relation._1().lower()
            yield from _foreign_tables(relation._2(), known | {name} if plan.allowRecursion() else known)
            known |= {name}
    elif kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in known:
            yield ".".join(parts)
    elif "UnresolvedIdentifier" in kind:
        yield "a computed name"
    for below in (*_items(plan.children()), *_items(plan.subqueries())):
        yield from _foreign_tables(below, known)


def adhoc_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, limit: int = 20) -> DataFrame:
    """First rows of one query over the given tables, and nothing else.

    Spark's parser must take the text alone for a query, so it can neither be another statement nor step out of the place it
    is put in. It may name the given tables and its own common table expressions, and call no reflective function. The
    tables are views of this session under names of their own, only while the query is analysed.
    """
    tables = tables or {}
    query = plain_sql(text)
    plan = spark._jsparkSession.sessionState().sqlParser().parseQuery(query)
    if unknown := set(_foreign_tables(plan, frozenset(t.lower() for t in tables))):
        raise ValueError(f"not one of the tables: {', '.join(sorted(unknown))}")
    if called := REFLECTIVE & {f.lower() for f in re.findall(r"'(?:\w+\.)*(\w+)\(", plan.treeString())}:
        raise ValueError(f"not allowed: {', '.join(sorted(called))}")
    views = {name: f"adhoc_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        given = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"{'WITH ' + given if given else ''} SELECT * FROM (\n{query}\n) AS answer LIMIT {int(limit)}")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def tag_intents(questions: DataFrame, col: str = "text") -> DataFrame:
    """The topic of each question: the first list with a word in it; SQL needs both of its words."""
    (topic, words), *rest = INTENT_WORDS
    intent = F.when(contains_any(F.col(col), words), topic)
    for topic, words in rest:
        intent = intent.when(contains_any(F.col(col), words), topic)
    intent = intent.when(contains_all(F.col(col), SQL_WORDS), "sql").otherwise("default")
    return questions.withColumn("intent", intent)


def intent_counts(tagged: DataFrame) -> DataFrame:
    return value_counts(tagged, "intent", "questions")


def apply_glossary(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, replace_all(F.col(col), GLOSSARY))
