"""Search plans for facts: repairing a judge's JSON, defaults, and title constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_words
from .facts import strict_json

#: Length of the query that stands in where no plan is given.
DEFAULT_QUERY = 80


#: The name after a preposition: capitalised words.
NAME_IN_TEXT = r"\b(?:of|at|in|near|for|from) ((?:[A-Z]\w+ )?[A-Z]\w+)"

# The patterns that repair a judge's JSON, in their order.
FENCE = r"```(?:json)?\s*"
TRAILING = ((r",\s*\}", "}"), (r",\s*\]", "]"))
WHOLE, NESTED = r"(?s)\{.*\}", r"(?s)\{[^{}]*\{.*\}[^{}]*\}"
BARE_KEY, QUOTED_KEY = r"([{,]\s*)([a-zA-Z_]\w*)\s*:", '$1"$2":'


def cleaned(answer: Column) -> Column:
    """The answer without fences and trailing commas."""
    clean = F.regexp_replace(answer, FENCE, "")
    for pattern, by in TRAILING:
        clean = F.regexp_replace(clean, pattern, by)
    return clean


def repaired(clean: Column) -> Column:
    """The variant in a cleaned answer: the widest and then a nested pair of braces is tried, and bare keys are quoted as a
    last resort."""

    def inner(x: Column, pattern: str) -> Column:
        return F.try_variant_get(strict_json(F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))), "$[0]", "variant")

    return F.coalesce(inner(clean, WHOLE), inner(clean, NESTED), inner(F.regexp_replace(clean, BARE_KEY, QUOTED_KEY), WHOLE))


def with_plan(df: DataFrame, answer: str, fact_id: str, text: str) -> DataFrame:
    """The rows with ``query`` and ``entities`` from a judge's answer; without an entry whose query is a string the first
    characters of the text are the query. Entities that are no strings are left out.

    Each step is a column of its own, so that no step is computed again for each use of its result.
    """

    def is_text(x: Column) -> Column:
        return F.schema_of_variant(x) == "STRING"

    kept = df.columns
    df = df.withColumn("_clean", cleaned(F.col(answer))).withColumn("_value", repaired(F.col("_clean")))
    df = df.withColumn("_plans", F.from_json(F.to_json("_value"), "map<string,variant>")).withColumn("_entry", F.try_element_at("_plans", F.col(fact_id)))
    df = df.withColumn("_query", F.try_variant_get("_entry", "$.query", "variant")).withColumn("_listed", F.try_variant_get("_entry", "$.entities", "array<variant>"))
    given = F.col("_query").isNotNull() & is_text(F.col("_query"))
    none = F.array().cast("array<string>")
    texts = F.filter("_listed", lambda e: e.isNotNull() & is_text(e))
    entities = F.transform(F.slice(texts, 1, 2), lambda e: F.try_variant_get(e, "$", "string"))
    query = F.when(given, F.try_variant_get("_query", "$", "string")).otherwise(F.substring(text, 1, DEFAULT_QUERY))
    return df.select(*kept, query.alias("query"), F.when(given & F.col("_listed").isNotNull(), entities).otherwise(none).alias("entities"))


def prompt(facts_json: Column, language: Column) -> Column:
    """A judge's prompt for the plans of facts, given as a JSON array of id and text."""
    host = F.when(language == "zh", "Chinese").otherwise("English")
    head = F.concat(F.lit("For each fact give a search query of three to five keywords for the "), host, F.lit(" encyclopedia and one or two exact article titles.\n"))
    return F.concat(head, F.lit('Answer with one JSON object {"id": {"query", "entities"}} and nothing else.\n\nFacts:\n'), facts_json)


def facts_json(facts: DataFrame, batch: int = 50) -> DataFrame:
    """``job_id, slot, batch_no, n_facts, facts``: the facts of an answer as JSON arrays, at most about ``batch`` numbers of
    facts in each, so that an answer with very many facts gives many prompts."""
    number = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"), F.lit(0))
    entry = F.struct(F.struct(number.alias("n"), "fact_key").alias("o"), F.struct("id", "text").alias("f"))
    grouped = facts.groupBy("job_id", "slot", F.floor(number / batch).alias("batch_no")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select("job_id", "slot", "batch_no", F.size("e").alias("n_facts"), F.to_json(F.transform("e", lambda x: x["f"])).alias("facts"))


def local_planner(facts: DataFrame, article: DataFrame) -> DataFrame:
    """A deterministic planner: ``fact_key, answer``. The query is the beginning of the fact, the entities are the title of the
    article that it is linked to and the name that stands in the text after a preposition."""
    titles = article.select("article_id", "lang", "title")
    linked = facts.join(titles, ["article_id", "lang"])
    name = F.nullif(F.regexp_extract("text", NAME_IN_TEXT, 1), F.lit(""))
    entry = F.struct(F.substring("text", 1, DEFAULT_QUERY).alias("query"), F.array_compact(F.array("title", name)).alias("entities"))
    return linked.select("fact_key", F.to_json(F.create_map(F.col("id"), entry)).alias("answer"))


def constraint_words(query: Column, entity: Column, language: Column) -> Column:
    """The words a title must hold one of: those of the entity, else of the query."""
    own, other = entity_words(F.coalesce(entity, F.lit(""))), entity_words(query)
    fallback = F.when(language == "zh", F.filter(other, lambda w: F.length(w) <= 12)).otherwise(F.slice(other, 1, 3))
    return F.when(F.size(own) > 0, own).otherwise(fallback)


def constraint(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.concat(F.lit("intitle:"), F.array_join(words, "|"))).otherwise("")


def primary_word(query: Column, entity: Column) -> Column:
    """The first word that a title should hold, or ''."""
    return F.coalesce(F.get(entity_words(F.coalesce(F.nullif(entity, F.lit("")), query)), 0), F.lit(""))


# A title constraint within a query, and the mark between its words.
CONSTRAINT, ALTERNATIVE = r"(?:^|[^A-Za-z0-9_])intitle:(\S+)", r"\|"
ANY_CONSTRAINT = r"(^|[^A-Za-z0-9_])intitle:\S+"


def split_constraint(query: Column) -> Column:
    """``struct<words, query>``: the words of the first title constraint, and the query without any constraint."""
    found = F.regexp_extract(query, CONSTRAINT, 1)
    rest = F.trim(F.regexp_replace(query, ANY_CONSTRAINT, "$1"))
    words = F.when(found != "", F.split(found, ALTERNATIVE)).otherwise(F.array().cast("array<string>"))
    return F.struct(words.alias("words"), F.when((found == "") | (rest == ""), query).otherwise(rest).alias("query"))


def title_holds(title: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(title), w))
