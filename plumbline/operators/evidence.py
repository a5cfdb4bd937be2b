"""Evidence: candidate articles, paragraphs, relevance, and the best paragraphs of each fact."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rank import first_n
from ..functions.text import article_url, cjk_bigrams, entity_words, has_cjk, trim_white, words
from ..runtime import materialise
from .planning import constraint_words, local_planner, primary_word, title_holds, with_plan

#: Hits of a search, longest extract, paragraphs of a fact and of an article, and boosts.
TOP_K, EXTRACT, BEST, BEST_OF_ARTICLE = 8, 12_000, 3, 2
SNIPPET = 250
ENTITY_BOOST, TITLE_BOOST = 1.5, 1.3


def paragraphs(article: DataFrame) -> DataFrame:
    """``article_id, lang, title, pos, text`` of the paragraphs of more than 30 characters, with what scores need."""
    cut = F.substring("text", 1, EXTRACT)
    parts = article.where(F.col("text").isNotNull()).select("article_id", "lang", "title", F.posexplode(F.split(cut, r"\n\n+")).alias("pos", "raw"))
    kept = parts.select("article_id", "lang", "title", "pos", trim_white(F.col("raw")).alias("text")).where(F.length("text") > 30)
    return kept.select("*", has_cjk(F.col("text")).alias("p_cjk"), words(F.col("text")).alias("p_words"), cjk_bigrams(F.col("text")).alias("p_pairs"))


#: Rows of the sample on which the lists of the index are fitted, rows a list should hold, and most lists.
INDEX_SAMPLE, LIST_ROWS, MOST_LISTS = 4096, 1000, 256
#: Lists that are searched before distances rule out others.
PROBES = 2
#: Cosines are rounded to six places before they are compared.
PLACES, SLACK = 6, 2e-6
#: Articles up to which their tokens are broadcast (some 100 MB at most); beyond, they are joined.
BROADCAST_ARTICLES = 5000


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def fit_lists(vectors: DataFrame, key: str) -> np.ndarray:
    """Unit centres of the index lists, fitted on a bounded sample (``INDEX_SAMPLE`` rows by a hash of their key)."""
    lists = min(MOST_LISTS, vectors.count() // LIST_ROWS)
    if lists < 2:
        return np.zeros((0, 0))
    rows = vectors.where(_norm("embedding") > 0).orderBy(F.xxhash64(key), key).limit(INDEX_SAMPLE).select("embedding").collect()
    points = np.array([r[0] for r in rows], dtype=float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[np.linspace(0, len(points) - 1, lists).astype(int)]
    for _ in range(10):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.array([points[nearest == i].sum(axis=0) if (nearest == i).any() else centres[i] for i in range(lists)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _distances(embedding: Column, centres: np.ndarray) -> Column:
    """The distances of a vector, brought to length 1, to all centres."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        x = np.array(batch.tolist(), dtype=float).reshape(len(batch), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + 1 - 2 * x @ centres.T))))

    return run(embedding)


def neighbours(vectors: DataFrame, queries: DataFrame, key: str, within: list[str], k: int = TOP_K, exact: bool = True) -> DataFrame:
    """The ``k`` nearest rows of each query row by cosine: ``query_key, key, cosine, rank``.

    ``queries`` is a stated set (a fixed table, or the keys divisible by 100). The rows lie in lists around centres fitted on
    a bounded sample. Each query searches its ``PROBES`` nearest lists; the distance of the k-th row found, the distances to
    the other centres and the radii of their lists tell which other lists may hold a nearer row, and these are
    searched too, so the result is exact. With ``exact=False`` they are not. Below two lists all rows are one.
    A vector without length has no cosine and is no neighbour.
    """
    centres = fit_lists(vectors, key)
    left = queries.select(F.col(key).alias("query_key"), *within, F.col("embedding").alias("q"), _norm("embedding").alias("qn")).where("qn > 0")
    right = vectors.select(key, *within, F.col("embedding").alias("v"), _norm("embedding").alias("vn")).where("vn > 0")
    order = Window.partitionBy("query_key", *within).orderBy(F.col("cosine").desc(), key)

    def best(asked: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
        pairs = (asked.join(rows, on) if on else asked.crossJoin(rows)).where(F.col("query_key") != F.col(key))
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
        scored = pairs.select("query_key", *within, key, F.round(dot / (F.col("qn") * F.col("vn")), PLACES).alias("cosine"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if not len(centres):
        return best(left, right, within)
    far = F.transform(_distances(F.col("v"), centres), lambda d, i: F.struct(d.alias("d"), i.alias("list")))
    listed = materialise(right.withColumn("near", F.array_min(far)).select("*", "near.list", "near.d").drop("near"))
    radii = listed.groupBy("list").agg(F.max("d").alias("radius"))  # a row a list
    ways = F.array_sort(F.transform(_distances(F.col("q"), centres), lambda d, i: F.struct(d.alias("d"), i.alias("list"))))
    asked = materialise(left.withColumn("ways", ways))
    rows, on = listed.drop("d"), [*within, "list"]
    probed = asked.select("query_key", *within, "q", "qn", F.explode(F.slice("ways", 1, PROBES)).alias("way")).select("*", "way.list").drop("way")
    first = best(probed, rows, on)
    if not exact:
        return first
    first = materialise(first)
    reach = first.groupBy("query_key", *within).agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"))
    rest = asked.select("query_key", *within, "q", "qn", F.explode(F.slice("ways", PROBES + 1, len(centres))).alias("way")).select("*", "way.list", "way.d").drop("way")
    bound = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("least") - SLACK)))
    open_ = rest.join(reach, ["query_key", *within], "left").join(F.broadcast(radii), "list")
    more = open_.where(F.col("n").isNull() | (F.col("n") < k) | (F.col("d") - F.col("radius") <= bound)).select("query_key", *within, "q", "qn", "list")
    both = first.drop("rank").unionByName(best(more, rows, on).drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def planned_facts(facts: DataFrame, article: DataFrame, planner: Callable[[DataFrame, DataFrame], DataFrame] = local_planner) -> DataFrame:
    """The facts with ``query``, ``entities`` and ``other_id``, the article that the second entity names (-1: none).

    The planner's answer is read as a judge's; a fact without a usable plan has the default one.
    """
    asked = with_plan(facts.join(planner(facts, article), "fact_key", "left"), "answer", "id", "text").drop("answer")
    titles = article.groupBy(F.lower("title").alias("_title"), F.col("lang").alias("_lang")).agg(F.min("article_id").alias("_id"))
    second = F.lower(F.get("entities", 1))
    found = asked.withColumn("_second", second).join(titles, (F.col("_second") == F.col("_title")) & (F.col("lang") == F.col("_lang")), "left")
    other = F.when(F.col("_id") == F.col("article_id"), F.lit(-1)).otherwise(F.coalesce("_id", F.lit(-1)))
    return found.withColumn("other_id", other).drop("_second", "_title", "_lang", "_id")


def search_keys(facts: DataFrame) -> DataFrame:
    """The distinct searches of planned facts: ``article_id, other_id, lang``. Facts that would search alike do so once."""
    return facts.where(F.col("article_id").isNotNull()).select("article_id", "other_id", "lang").distinct()


def candidates(article: DataFrame, keys: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """The candidate articles of each search, in order: ``article_id, other_id, lang, cand_id, title, snippet, cand_rank,
    is_constrained, is_entity``. Without ``keys`` each article is searched for by itself.

    The first entity is the article that the facts are about, whose vector stands for the query. Text hits are its
    nearest articles: those whose title meets the constraint come first (all, if none does), others supplement them if
    their title holds the primary word; the hits of the title search for both entities are last. The first of equal
    titles stays. Of more than five candidates only those whose title or snippet has the primary word stay, if there are
    three.
    """
    if keys is None:
        keys = article.select("article_id", F.lit(-1).cast("bigint").alias("other_id"), "lang")
    named = article.select("article_id", "lang", "title", "embedding").where(F.col("embedding").isNotNull())
    hits = neighbours(named, named, "article_id", ["lang"], k).withColumnRenamed("article_id", "cand_id").withColumnRenamed("query_key", "article_id")
    shown = article.select(F.col("article_id").alias("cand_id"), "lang", F.col("title").alias("cand_title"), F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET).alias("snippet"))
    own = article.select("article_id", "lang", F.col("title").alias("entity"))
    other = article.select(F.col("article_id").alias("other_id"), "lang", F.col("title").alias("other_entity"))
    searches = keys.join(own, ["article_id", "lang"]).join(other, ["other_id", "lang"], "left")
    words = constraint_words(F.col("entity"), F.col("entity"), F.col("lang"))
    base = searches.withColumn("wanted", words).join(hits, ["article_id", "lang"]).join(shown, ["cand_id", "lang"])
    met = base.withColumn("meets", (F.size("wanted") == 0) | title_holds(F.col("cand_title"), F.col("wanted")))
    search = ["article_id", "other_id", "lang"]
    of_search = Window.partitionBy(*search)
    lenient = met.withColumn("is_constrained", F.col("meets") | (F.count_if("meets").over(of_search) == 0))
    primary = primary_word(F.col("entity"), F.col("entity"))
    columns = [*search, "entity", "other_entity", "cand_id", "cand_title", "snippet"]
    text_hits = lenient.where(F.col("is_constrained") | (primary == "") | F.contains(F.lower("cand_title"), primary))
    text_hits = text_hits.select(*columns, "is_constrained", F.when(F.col("is_constrained"), 0).otherwise(1).alias("source_rank"), "rank")
    entities = F.array(F.col("article_id"), F.col("other_id"))
    entity_hits = searches.select("*", F.posexplode(entities).alias("rank", "cand_id")).where("cand_id >= 0").join(shown, ["cand_id", "lang"])
    entity_hits = entity_hits.select(*columns, F.lit(False).alias("is_constrained"), F.lit(2).alias("source_rank"), "rank")
    merged = first_n(text_hits.unionByName(entity_hits), [*search, "cand_title"], [F.col("source_rank"), F.col("rank")], 1)
    holds = (primary != "") & (F.contains(F.lower("cand_title"), primary) | F.contains(F.lower("snippet"), primary))
    gated = merged.withColumn("holds", holds).withColumn("n", F.count(F.lit(1)).over(of_search)).withColumn("m", F.count_if("holds").over(of_search))
    kept = gated.where(F.when((primary != "") & (F.col("n") > 5) & (F.col("m") >= 3), F.col("holds")).otherwise(True))
    ranked = kept.withColumn("cand_rank", F.row_number().over(of_search.orderBy("source_rank", "rank")))
    is_entity = F.coalesce(F.lower("cand_title").isin(F.lower("entity"), F.lower("other_entity")), F.lit(False))
    return ranked.select(*search, "cand_id", F.col("cand_title").alias("title"), "snippet", "cand_rank", "is_constrained", is_entity.alias("is_entity"))


def candidate_paragraphs(article: DataFrame, found: DataFrame) -> DataFrame:
    """The paragraphs of all candidates, keyed by ``article_id, other_id, lang, cand_rank, pos``."""
    texts = paragraphs(article).withColumnRenamed("article_id", "cand_id").drop("title")
    boost = F.when(F.col("is_entity"), ENTITY_BOOST).otherwise(1.0) * F.when(F.col("is_constrained"), TITLE_BOOST).otherwise(1.0)
    return found.join(texts, ["cand_id", "lang"]).withColumn("boost", boost)


def keyword_hits(queries: DataFrame, article: DataFrame, n: int = 5) -> DataFrame:
    """The second source, for queries that the first can't answer: the ``n`` articles whose titles share most words with a
    query: ``fact_key, article_id, title, n_shared, rank``. A join on words, each query's counts combined before the rank."""
    asked = queries.select("fact_key", "lang", F.explode(F.array_distinct(entity_words(F.col("query")))).alias("word"))
    titled = article.select("article_id", "lang", "title", F.explode(F.array_distinct(entity_words(F.col("title")))).alias("word"))
    shared = asked.join(titled, ["lang", "word"]).groupBy("fact_key", "article_id", "title").agg(F.count(F.lit(1)).alias("n_shared"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("fact_key").orderBy(F.col("n_shared").desc(), "article_id")))
    return ranked.where(F.col("rank") <= n)


def _tokens(words_: Column, pairs: Column) -> Column:
    """Words and pairs of ideographs as one array with their kinds."""

    def tagged(kind: str, array: Column) -> Column:
        return F.transform(array, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    return F.concat(tagged("w", words_), tagged("b", pairs))


def scored(facts: DataFrame, article: DataFrame, found: DataFrame) -> DataFrame:
    """``fact_key, article_id, other_id, lang, cand_rank, pos, score`` of every relevant paragraph of each planned fact's
    candidates.

    The share of a fact's words that a paragraph repeats, as a join on tokens: the tokens of the facts meet the tokens of their candidates'
    paragraphs, and the matches are summed by pair, combined before the shuffle. Repeated words of the paragraph count
    again, so the share may exceed 1; pairs of ideographs count once, where both texts have some. The tokens of few
    articles (``BROADCAST_ARTICLES``, which is counted) are broadcast, so that the facts aren't shuffled by article, however
    skewed; those of more are joined, and adaptive execution splits hot articles.
    """
    none = F.array().cast("array<string>")
    search = ["article_id", "other_id", "lang"]
    at = [*search, "cand_rank", "pos"]
    held = candidate_paragraphs(article, found)
    usable = held.select(*at, "boost", "p_cjk", F.size("p_words").alias("n_words"), F.size("p_pairs").alias("n_pairs"), F.explode(_tokens(F.col("p_words"), F.when(F.col("p_cjk"), F.col("p_pairs")).otherwise(none))).alias("t"))
    enough = F.when(F.col("t.kind") == "w", F.col("n_words") >= 3).otherwise(F.col("n_pairs") >= 2)
    held = usable.where(enough).groupBy(*at, "boost", "p_cjk", "t").agg(F.count(F.lit(1)).alias("times"))
    if article.count() <= BROADCAST_ARTICLES:
        held = F.broadcast(held)
    seen = facts.select("fact_key", *search, has_cjk(F.col("text")).alias("f_cjk"), F.array_distinct(words(F.col("text"))).alias("f_words"), cjk_bigrams(F.col("text")).alias("f_pairs"))
    asked = seen.select("fact_key", *search, "f_cjk", F.size("f_words").alias("n_w"), F.size("f_pairs").alias("n_b"), F.explode(_tokens(F.col("f_words"), F.when(F.col("f_cjk"), F.col("f_pairs")).otherwise(none))).alias("t"))
    asked = asked.select("*", F.when(F.col("t.kind") == "w", F.col("n_w")).otherwise(F.col("n_b")).alias("n_tokens"))
    met = asked.join(held, [*search, "t"]).where((F.col("t.kind") == "b") == (F.col("f_cjk") & F.col("p_cjk")))
    sums = met.groupBy("fact_key", *at, "boost", "n_tokens", F.col("t.kind").alias("kind")).agg(F.sum("times").alias("hits"))
    share = sums.withColumn("share", F.col("hits") / F.col("n_tokens")).where((F.col("kind") == "w") | (F.col("share") * F.col("n_tokens") >= 1))
    return share.select("fact_key", *at, (F.col("share") * F.col("boost")).alias("score"))


def best(scored_: DataFrame, n: int = BEST, per_article: int = BEST_OF_ARTICLE) -> DataFrame:
    """The ``n`` best paragraphs of each fact, at most ``per_article`` of one article; ties by article and position."""
    order = [F.col("score").desc(), F.col("cand_rank"), F.col("pos")]
    few = first_n(scored_, ["fact_key", "cand_rank"], order, per_article)
    window = Window.partitionBy("fact_key").orderBy(*order)
    return few.withColumn("evidence_no", F.row_number().over(window)).where(F.col("evidence_no") <= n)


def with_texts(best_: DataFrame, article: DataFrame, found: DataFrame) -> DataFrame:
    """The best paragraphs with the title and text of each."""
    texts = candidate_paragraphs(article, found).select("article_id", "other_id", "lang", "cand_rank", "pos", "title", "text")
    return best_.join(texts, ["article_id", "other_id", "lang", "cand_rank", "pos"])


def first_hits(facts: DataFrame, best_: DataFrame, found: DataFrame, n: int = BEST) -> DataFrame:
    """For facts without a relevant paragraph the first ``n`` candidates, each with its snippet as text and no score."""
    bare = facts.where(F.col("article_id").isNotNull()).select("fact_key", "article_id", "other_id", "lang").join(best_.select("fact_key"), "fact_key", "left_anti")
    hits = bare.join(found.where(F.col("cand_rank") <= n), ["article_id", "other_id", "lang"])
    return hits.select("fact_key", "article_id", "other_id", "lang", "cand_rank", F.lit(-1).alias("pos"), F.lit(None).cast("double").alias("score"), F.col("cand_rank").alias("evidence_no"), "title", F.col("snippet").alias("text"))


def items(best_: DataFrame) -> DataFrame:
    """Evidence items of ``with_texts``: snippet, address and whole paragraph."""
    return best_.select("fact_key", "evidence_no", "title", F.substring("text", 1, SNIPPET).alias("snippet"), article_url(F.col("title"), F.col("lang")).alias("url"), F.col("text").alias("extract"), "score")


def prompts(items_: DataFrame, facts: DataFrame) -> DataFrame:
    """A judge's prompt for each fact with its numbered evidence."""
    block = F.concat(F.lit("["), F.col("evidence_no").cast("string"), F.lit("] "), "title", F.lit('\n    "'), F.coalesce(F.nullif("extract", F.lit("")), "snippet"), F.lit('"\n    Source: '), "url")
    listed = items_.groupBy("fact_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("evidence_no", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("evidence"))  # at most 3 a fact
    body = F.coalesce("evidence", F.lit("(no evidence found)"))
    head = F.lit('Answer with one JSON object {"accurate", "confidence", "explanation"} and nothing else.\nJudge by the evidence only.\n\nClaim: "')
    return facts.select("fact_key", "text").join(listed, "fact_key", "left").select("fact_key", F.concat(head, "text", F.lit('"\n\nEvidence:\n'), body).alias("prompt"))

