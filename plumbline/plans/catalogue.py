"""The query catalogue of the reference's operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rank import latest, numbered
from ..operators import evidence, jobs, planning, scoring, verify
from ..operators import facts as fact_reader
from ..runtime import materialise, shared_folder, table
from ..sources import job_store, models
from ..streaming import progress
from . import oracle, pipeline

#: The time at which ages are told (milliseconds).
NOW = 1_740_300_000_000

# Judge answers and plans that cover every case of the readers.
JUDGE_ANSWERS = [
    '{"accurate": true, "confidence": 0.95, "explanation": "e"}',
    '{"accurate": "false", "confidence": 0.4}',
    '{"accurate": false, "confidence": 0}',
    '{"accurate": 1, "confidence": 7}',
    '{"accurate": null, "confidence": -3}',
    'text {"accurate": true} more',
    "not json",
    "{bad}",
]
PLAN_ANSWERS = [
    '{"fact-1": {"query": "river trade", "entities": ["Lifola Bay", "Harbour", "Third"]}}',
    '```json\n{"fact-1": {"query": "guild system", "entities": ["Zemare Accord"],},}\n```',
    '{"fact-2": {"query": "other"}}',
    "no plan at all",
    '{fact-1: broken',
]


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: table(spark, base, name)


scenario, response, fact, fact_line, article, slot_dim, documents, events, embeddings = map(
    _t, ("scenario", "response", "fact", "fact_line", "article", "slot_dim", "documents", "events", "embeddings")
)


def _scenarios(spark: SparkSession, base: str) -> DataFrame:
    return latest(scenario(spark, base), "scenario_id", "received_at")


def _event_log(log: DataFrame) -> DataFrame:
    """The events as a progress log: user as job; slot, step, status and message by a number of ``props``."""
    k = F.get_json_object("props", "$.k").cast("int")
    slots = F.array(*[F.lit(s) for s in ("us-model-en", "us-model-zh", "cn-model-en", "cn-model-zh")])
    steps = F.array(*[F.lit(p) for p in (*jobs.PHASES, jobs.DONE, "pipeline")])
    status = F.when(F.col("event_type") == "error", "error").when(k % 3 == 0, "running").otherwise("done")
    return log.select(
        F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
        F.get(slots, k % 4).alias("slot"),
        F.get(steps, k % 8).alias("phase"),
        status.alias("status"),
        F.when(k % 5 == 0, "Refusal detected (85% confidence)").otherwise("Working").alias("message"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "value",
    )


def _job_table(spark: SparkSession, base: str) -> DataFrame:
    """A job for each user of the events: its last status and, if it finished, when. Of the unfinished ones those of even
    users run."""
    log = _event_log(events(spark, base))
    last = log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("s"), F.max(F.unix_millis("ts")).alias("last"), F.min(F.unix_millis("ts")).alias("created_at"))
    runs = F.substring("job_id", 2, 20).cast("bigint") % 2 == 0
    status = F.when(F.col("s") == "done", "completed").when(F.col("s") == "error", "error").when(runs, "running").otherwise("queued")
    return last.select("job_id", status.alias("status"), "created_at", F.when(status == "running", F.col("last")).alias("started_at"), F.when(F.col("s") != "running", F.col("last")).alias("completed_at"))


def slot_fanout(spark, base):
    rows = models.fan_out(_scenarios(spark, base), slot_dim(spark, base))
    return rows.select("scenario_id", "slot", "language", "origin", "prompt", F.length("prompt").alias("prompt_chars"))


def mock_responses(spark, base):
    rows = models.fan_out(_scenarios(spark, base), slot_dim(spark, base))
    return rows.select("scenario_id", "slot", models.mock_answer(F.col("slot")).alias("answer"))


def translation_routes(spark, base):
    return slot_dim(spark, base).select("slot", models.translation_route(F.col("language")).alias("translator"))


def prompt_truncate(spark, base):
    return documents(spark, base).select("doc_id", F.length(F.substring("text", 1, models.PROMPT_LIMIT)).alias("kept_chars"), F.md5(F.substring("text", 1, models.PROMPT_LIMIT)).alias("kept_md5"))


def refusal_detect(spark, base):
    return pipeline.answers(response(spark, base)).select("response_id", "r.is_refusal", "r.confidence", "r.reason")


def refusal_rate_by_slot(spark, base):
    rows = pipeline.answers(response(spark, base)).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("r.is_refusal").alias("n_refused"))
    return rows.withColumn("refusal_rate", F.round(F.col("n_refused") / F.col("n"), 6))


def parse_facts(spark, base):
    return fact_reader.exploded(fact_line(spark, base), "line", ["fact_key"]).select("fact_key", "id", "text", "category")


def fact_counts(spark, base):
    return pipeline.facts(fact(spark, base)).groupBy("job_id", "slot").agg(F.count(F.lit(1)).alias("n_facts"), F.count("category").alias("n_labelled"), F.max(F.length("text")).alias("longest"))


def strip_html_documents(spark, base):
    plain = X.strip_html(F.col("text"))
    return documents(spark, base).select("doc_id", F.length(plain).alias("plain_chars"), F.md5(plain).alias("plain_md5"))


def article_urls(spark, base):
    return article(spark, base).select("article_id", "lang", X.article_url(F.col("title"), F.col("lang")).alias("url"))


def token_frequencies(spark, base):
    return pipeline.facts(fact(spark, base)).select(F.explode(X.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def article_bigrams(spark, base):
    pairs = article(spark, base).where("lang = 'zh'").select("article_id", F.explode(X.cjk_bigrams(F.col("text"))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n_articles"))


def paragraph_split(spark, base):
    return evidence.paragraphs(article(spark, base)).select("article_id", "lang", "pos", "text")


def title_constraints(spark, base):
    rows = article(spark, base).select("article_id", "lang", "title", planning.constraint_words(F.col("title"), F.col("title"), F.col("lang")).alias("w"), planning.primary_word(F.col("title"), F.col("title")).alias("primary_word"))
    return rows.select("article_id", "lang", planning.constraint(F.col("w")).alias("title_constraint"), "primary_word")


def split_constraints(spark, base):
    query = F.concat(F.lit("intitle:"), F.regexp_replace(F.col("title"), " ", "|"), F.when(F.col("article_id") % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise(""))
    part = article(spark, base).select("article_id", "lang", planning.split_constraint(query).alias("s"))
    return part.select("article_id", "lang", F.array_join("s.words", "/").alias("title_words"), "s.query")


def query_plans(spark, base):
    rows = spark.createDataFrame([(i, a, "fact-1", "The harbour was enlarged in 1872.") for i, a in enumerate(PLAN_ANSWERS)], "answer_no int, answer string, id string, text string")
    return planning.with_plan(rows, "answer", "id", "text").select("answer_no", "query", F.array_join("entities", "/").alias("entities"))


def judge_parse(spark, base):
    rows = spark.createDataFrame(list(enumerate(JUDGE_ANSWERS)), "answer_no int, answer string")
    return rows.select("answer_no", verify.parse_answer(F.col("answer")).alias("v")).select("answer_no", "v.accurate", "v.confidence", "v.explanation")


def semantic_topk(spark, base):
    rows = embeddings(spark, base)
    found = evidence.neighbours(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", [])
    return found.select("query_key", "vec_id", F.round("cosine", 4).alias("cosine"), "rank")


def article_candidates(spark, base):
    return evidence.candidates(article(spark, base)).select("article_id", "lang", "title", "cand_rank", "is_constrained", "is_entity")


def fact_plans(spark, base):
    """The plan of each fact: the judge's, where one is usable."""
    rows = evidence.planned_facts(pipeline.facts(fact(spark, base)), article(spark, base))
    return rows.select("fact_key", "query", F.array_join("entities", "/").alias("entities"), "other_id")


def fact_candidates(spark, base):
    """How many articles the search of each fact finds, and what kinds."""
    known, found = pipeline.searched(fact(spark, base), article(spark, base))
    per = found.groupBy("article_id", "other_id", "lang").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("is_constrained").alias("n_constrained"), F.count_if("is_entity").alias("n_entities"))
    return known.join(per, ["article_id", "other_id", "lang"]).select("fact_key", "n_candidates", "n_constrained", "n_entities")


def fallback_hits(spark, base):
    """Keyword hits of the facts that have no vector to search by."""
    known = pipeline.facts(fact(spark, base)).where("article_id IS NULL").select("fact_key", "lang", F.substring("text", 1, planning.DEFAULT_QUERY).alias("query"))
    return evidence.keyword_hits(known, article(spark, base))


def plan_prompts(spark, base):
    """The prompts for plans, in batches of facts."""
    rows = planning.facts_json(pipeline.facts(fact(spark, base)))
    made = planning.prompt(F.col("facts"), models.slot_language(F.col("slot")))
    return rows.select("job_id", "slot", "batch_no", "n_facts", F.length(made).alias("prompt_chars"))


def extraction_prompts(spark, base):
    rows = latest(response(spark, base), "response_id", "received_at").where("response IS NOT NULL")
    made = fact_reader.prompt(F.col("response"), models.slot_language(F.col("slot")))
    return rows.select("response_id", F.length(made).alias("prompt_chars"), F.md5(made).alias("prompt_md5"))


def _scored(spark, base):
    known, found = pipeline.searched(fact(spark, base), article(spark, base))
    return known, found, evidence.scored(known, article(spark, base), found)


def relevance_scores(spark, base):
    return _scored(spark, base)[2].groupBy("fact_key").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.round(F.max("score"), 6).alias("best_score"), F.round(F.sum("score"), 4).alias("total_score"))


def _evidence(spark, base):
    """The planned facts, and up to three evidence items of each: relevant paragraphs, else the first hits."""
    known, found, ranked = _scored(spark, base)
    best = materialise(evidence.best(ranked))
    told = evidence.with_texts(best, article(spark, base), found)
    hits = evidence.first_hits(known, best, found)
    return known, told.select(hits.columns).unionByName(hits)


def evidence_top3(spark, base):
    return _evidence(spark, base)[1].select("fact_key", "evidence_no", "title", "pos", F.round("score", 6).alias("score"))


def evidence_prompts(spark, base):
    known, told = _evidence(spark, base)
    made = evidence.prompts(evidence.items(told), known)
    return made.select("fact_key", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


def accuracy_by_slot(spark, base):
    verdicts = pipeline.verified(fact(spark, base), article(spark, base))
    rows = verdicts.groupBy("slot").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("accurate").alias("n_accurate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return rows.withColumn("percent_accurate", X.percent(F.col("n_accurate") / F.col("n_facts")))


def _scores(spark, base):
    return pipeline.scores(response(spark, base), pipeline.verified(fact(spark, base), article(spark, base)))


def bias_score(spark, base):
    """The flagship: the bias score of every answer."""
    return _scores(spark, base).select("response_id", "job_id", "slot", F.size("indicators").alias("n_indicators"), F.round("score", 6).alias("score"), scoring.bias_class(F.col("score")).alias("bias_class"))


def bias_indicators(spark, base):
    rows = _scores(spark, base).select("response_id", F.posexplode("indicators").alias("indicator_no", "i"))
    shown = scoring.shown_severity(F.col("i.dimension"), F.col("i.severity"))
    return rows.select("response_id", "indicator_no", "i.dimension", "i.description", "i.severity", "i.direction", shown.alias("shown_severity"))


def slot_comparison(spark, base):
    """The slots by falling mean score."""
    rows = _scores(spark, base).groupBy("slot").agg(F.count(F.lit(1)).alias("n_answers"), F.avg("score").alias("mean_score"))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(F.round("mean_score", 6).desc(), "slot")))  # four slots
    return placed.select("place", "slot", jobs.slot_label(F.col("slot")).alias("label"), "n_answers", F.round("mean_score", 6).alias("mean_score"), X.percent(F.col("mean_score")).alias("percent"), F.round(F.greatest(F.col("mean_score") * 100, F.lit(4.0)), 4).alias("bar_width"))


def search_memo(spark, base):
    """Equal queries are looked up once and joined back."""
    known = pipeline.facts(fact(spark, base)).select("fact_key", "lang", F.substring("text", 1, planning.DEFAULT_QUERY).alias("query"))
    keyed = known.withColumn("cache_key", F.concat_ws(":", "lang", F.lit("text"), "query"))
    once = keyed.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_uses"))
    computed = once.select("cache_key", "n_uses", F.size(X.entity_words(F.col("cache_key"))).alias("n_words"))
    return keyed.join(computed, "cache_key").select("fact_key", F.md5("cache_key").alias("cache_md5"), "n_uses", "n_words")


def job_summaries(spark, base):
    return _scenarios(spark, base).select("job_id", X.shortened(F.col("english")).alias("summary"), "created_at", X.time_ago((F.lit(NOW) - F.col("created_at")) / 1000).alias("age"))


def next_job_id(spark, base):
    return scenario(spark, base).agg(jobs.next_id(F.col("job_id")).alias("next_id"))


def job_table(spark, base):
    return _job_table(spark, base)


def recent_jobs(spark, base):
    made = _job_table(spark, base).where("status IN ('completed', 'error')")
    memory = made.where(F.col("status") == "error")
    return jobs.recent(memory, made).select("job_id", "status", "completed_at")


def running_jobs(spark, base):
    return jobs.running(_job_table(spark, base)).select("job_id", "place")


def admission(spark, base):
    return jobs.admitted(_job_table(spark, base), 1000)


def job_overview(spark, base):
    return jobs.overview(_job_table(spark, base))


def recent_three(spark, base):
    """What the page shows of the jobs that ended last."""
    made = _job_table(spark, base).where("status IN ('completed', 'error')")
    return jobs.recent(made.limit(0), made, 3).select("job_id")


def stored_jobs(spark, base):
    """The job store written, read again and cleaned after a restart."""
    table_ = _job_table(spark, base).select(F.col("job_id").alias("id"), "status", F.col("created_at").alias("createdAt"), F.col("completed_at").alias("completedAt"))
    documents_ = _scenarios(spark, base).select(F.col("job_id").alias("id"), F.struct("english", "chinese").alias("scenario")).join(table_, "id", "left")
    folder = shared_folder(spark, "jobs")
    job_store.write_jobs(documents_, folder)
    kept = job_store.without_incomplete(job_store.read_jobs(spark, folder))
    changed = kept.where("status = 'error'").withColumn("status", F.lit("completed"))
    return job_store.summaries(job_store.upsert(kept.drop("file"), changed.drop("file"))).select("id", "status", "english", "completedAt", "slot_count")


def event_log(spark, base):
    rows = jobs.event_log(_event_log(events(spark, base)))
    return rows.select("event_id", "job_id", "slot", "place", "elapsed_ms", X.duration(F.col("elapsed_ms")).alias("elapsed"))


def event_snapshot(spark, base):
    """The first message to a subscriber who comes at a fixed time."""
    return jobs.snapshot(_event_log(events(spark, base)), F.lit("2024-01-10").cast("timestamp"))


def retention(spark, base):
    return jobs.retained(_job_table(spark, base), 20).select("job_id", "status")


def queue_positions(spark, base):
    waiting = _job_table(spark, base).where("status = 'queued'").select("job_id", "created_at")
    return numbered(waiting, [F.col("created_at"), F.col("job_id")]).select("job_id", "position")


def restart_cleanup(spark, base):
    return _job_table(spark, base).groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status").isin("queued", "running")).alias("n_removed"))


def events_by_slot(spark, base):
    rows = jobs.events_by_slot(_event_log(events(spark, base)))
    return rows.select("job_id", "slot", "n_events", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "last_status", (F.unix_millis("last_ts") - F.unix_millis("first_ts")).alias("wall_ms"))


def phase_first_ts(spark, base):
    rows = jobs.first_transitions(_event_log(events(spark, base)))
    return rows.select("job_id", "slot", "phase", F.unix_millis("first_ts").alias("first_ms"), "elapsed_ms")


def phase_state(spark, base):
    return jobs.phase_states(_event_log(events(spark, base)))


def progress_messages(spark, base):
    """The phase states as subscribers get them."""
    return progress.messages(jobs.phase_states(_event_log(events(spark, base))))


def model_replies(spark, base):
    """The text of a model's reply: the first text block that isn't empty, else nothing."""
    block = "struct<type:string,text:string>"
    said = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("x").alias("text")).cast(block), F.struct(F.lit("text").alias("type"), F.lit("").alias("text")).cast(block), F.struct(F.lit("text").alias("type"), F.col("response").alias("text")).cast(block))
    rows = latest(response(spark, base), "response_id", "received_at")
    return rows.select("response_id", F.md5(models.first_text_block(said)).alias("reply_md5"))


def debounce_last(spark, base):
    return jobs.settled(_event_log(events(spark, base)), "job_id", 60_000).select("job_id", "event_id")


def response_upsert(spark, base):
    """The last delivered answer of each job and slot."""
    rows = latest(response(spark, base), "response_id", "received_at")
    return rows.groupBy("job_id", "slot").agg(F.max_by("response_id", F.struct("received_at", "response_id")).alias("response_id"))


def slot_responses(spark, base):
    """The answers of each job in the order of the slots, errors as values."""
    rows = latest(response(spark, base), "response_id", "received_at").join(F.broadcast(slot_dim(spark, base).select("slot", "slot_ord")), "slot")
    listed = rows.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("slot_ord", F.coalesce("error", F.lit("ok")).alias("state")))).alias("a"))  # one entry a slot
    return listed.select("job_id", F.array_join(F.transform("a", lambda x: x["state"]), "|").alias("states"), F.size("a").alias("n_slots"))


def model_labels(spark, base):
    raw = F.concat("model_name", F.lit("-MLX-4bit-oQ4e"))
    return response(spark, base).select("model_name").distinct().select("model_name", X.model_label(raw).alias("label"))


def quiz_streaks(spark, base):
    log = _event_log(events(spark, base)).withColumn("right", F.col("status") == "done")
    return jobs.streaks(log, "job_id", ["ts", "event_id"], "right")


def quiz_breakdown(spark, base):
    log = _event_log(events(spark, base)).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("n_right"))
    return log.withColumn("tier", jobs.quiz_tier(F.col("n_right") / F.col("n")))


def quiz_scores(spark, base):
    """The score line of each category, how far its ring is open, and the best score kept."""
    share = F.col("n_right") / F.col("n")
    line = F.concat(F.lit("I scored "), F.col("n_right").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" in "), "phase")
    return quiz_breakdown(spark, base).select("phase", line.alias("score_line"), F.round(326.7 - share * 326.7, 4).alias("ring_offset"), F.col("tier"))


def quiz_best(spark, base):
    """The best score of each player, taking an event for a game."""
    games = _event_log(events(spark, base)).select("job_id", "ts", "event_id", F.length("phase").alias("score"), F.length("slot").alias("total"), F.length("message").alias("streak"))
    return jobs.best_scores(games, "job_id", "score", "total", "streak", ["ts", "event_id"])


def quiz_category(spark, base):
    """The answers of one category with its tag."""
    rows = _event_log(events(spark, base)).withColumn("category", F.when(F.col("phase") == "querying", "Omission").when(F.col("phase") == "translating", "Redaction").otherwise("Other"))
    return jobs.in_category(rows, "Omission").groupBy("slot", jobs.tag(F.col("category")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("n_right"))


def quiz_sample(spark, base):
    """Five prompts in a seeded random order (a sample is the feature)."""
    return _scenarios(spark, base).select("scenario_id", F.md5(F.concat(F.lit("seed"), F.col("scenario_id").cast("string"))).alias("draw")).orderBy("draw").limit(5)


def configured_models(spark, base):
    """Each slot with its backend's model, as it is shown."""
    rows = models.configuration(spark).join(F.broadcast(slot_dim(spark, base).select("slot", "language")), "slot", "left")
    return rows.select("slot", "backend", "model", X.model_label(F.col("model")).alias("label"), jobs.slot_label(F.col("slot")).alias("shown"), F.coalesce("language", F.lit("—")).alias("language"))


def translations(spark, base):
    """The translation of each answer: who is asked for it, and with what prompt."""
    rows = latest(response(spark, base), "response_id", "received_at")
    asked = rows.select("response_id", models.translation_request(F.col("response"), models.slot_language(F.col("slot"))).alias("r"))
    return asked.where("r IS NOT NULL").select("response_id", "r.translator", "r.target", F.length("r.prompt").alias("prompt_chars"), models.mock_answer(F.col("r.translator")).alias("translation"))


def scenario_translation(spark, base):
    """The scenarios with their missing language filled in by the mock model."""
    rows = models.completed(_scenarios(spark, base), lambda r: models.mock_answer(r["translator"]))
    return rows.select("scenario_id", F.md5("english").alias("english_md5"), F.md5("chinese").alias("chinese_md5"), F.coalesce("chinese", F.lit("")).rlike("[\\u4e00-\\u9fff]").alias("is_cjk"))


def translate_requests(spark, base):
    """Requests to translate, some with a direction and some blank."""
    direction = F.when(F.col("scenario_id") % 2 == 0, "zh->en").when(F.col("scenario_id") % 3 == 0, "en->zh")
    text = F.when(F.col("scenario_id") % 5 == 0, " \n").otherwise(F.concat(F.lit(" "), "english"))
    rows = _scenarios(spark, base).select("scenario_id", models.requested(text, direction).alias("r"))
    return rows.where("r IS NOT NULL").select("scenario_id", "r.target", "r.translator", F.length("r.prompt").alias("prompt_chars"))


def judge_answers(spark, base):
    """A judge's answers on facts, read over the whole table."""
    k = F.col("fact_key") % 6
    said = (
        F.when(k == 0, F.concat(F.lit('{"accurate": true, "confidence": 0.'), (F.col("fact_key") % 97).cast("string"), F.lit(', "explanation": "by the record"}')))
        .when(k == 1, F.lit('I think {"accurate": false, "confidence": -2} holds'))
        .when(k == 2, F.lit('{"accurate": 1, "confidence": 3}'))
        .when(k == 3, F.lit('{"accurate": "", "confidence": "0.25x"}'))
        .when(k == 4, F.lit('{"accurate": true} or {"accurate": false}'))
        .otherwise(F.col("text"))
    )
    rows = pipeline.facts(fact(spark, base)).select("fact_key", verify.parse_answer(said).alias("v"))
    return rows.select("fact_key", "v.accurate", F.round("v.confidence", 6).alias("confidence"), "v.explanation")


def slot_models(spark, base):
    """The models of each slot with its language, origin and translator."""
    named = latest(response(spark, base), "response_id", "received_at").groupBy("slot", "model_name").agg(F.count(F.lit(1)).alias("n"))
    listed = named.groupBy("slot").agg(F.array_join(F.array_sort(F.collect_set("model_name")), ",").alias("models"), F.sum("n").alias("n_answers"))  # a few models a slot
    rows = slot_dim(spark, base).join(listed, "slot", "left")
    return rows.select("slot", "language", models.slot_origin(F.col("slot")).alias("origin"), F.coalesce("models", F.lit("—")).alias("models"), "n_answers", models.translation_route(F.col("language")).alias("translator"))


def chart_gate(spark, base):
    """Jobs with an answer in each of the four slots."""
    rows = latest(response(spark, base), "response_id", "received_at").groupBy("job_id").agg(F.countDistinct("slot").alias("n_slots"))
    return rows.where(F.col("n_slots") >= 4)


def verdict_texts(spark, base):
    """The text that a verdict shows: the fact's, or a placeholder where the fact is not loaded."""
    keys = fact(spark, base).select("fact_key").unionByName(fact_line(spark, base).select("fact_key")).distinct()
    known = pipeline.facts(fact(spark, base)).select("fact_key", "text")
    return keys.join(known, "fact_key", "left").select("fact_key", X.escaped(F.coalesce("text", F.lit("(fact not found)"))).alias("shown"))


def job_routes(spark, base):
    return _scenarios(spark, base).select("job_id", X.routed_job(F.concat(F.lit("/job/"), "job_id")).alias("routed"), X.routed_job(F.concat(F.lit("/jobs/"), "job_id")).alias("other"))


def progress_stream(spark, base):
    """The phase states by a streaming query over the event file, run to its end: changed states only, upserted by key."""
    raw = progress.read_events(spark, base, events(spark, base).schema, "events.parquet")
    folder = shared_folder(spark, "stream")
    states = progress.stateful_states(_event_log(raw))
    progress.snapshots(states, progress.append_to(f"{folder}/changes"), f"{folder}/checkpoint").awaitTermination()
    return progress.current(spark.read.parquet(f"{folder}/changes"))


_QUERIES = [
    bias_score, slot_fanout, mock_responses, translation_routes, prompt_truncate, refusal_detect, refusal_rate_by_slot, parse_facts, fact_counts,
    strip_html_documents, article_urls, token_frequencies, article_bigrams, paragraph_split, title_constraints, split_constraints, query_plans,
    judge_parse, semantic_topk, article_candidates, relevance_scores, evidence_top3, evidence_prompts, accuracy_by_slot, bias_indicators,
    slot_comparison, search_memo, job_summaries, next_job_id, job_table, recent_jobs, retention, queue_positions, restart_cleanup, events_by_slot,
    phase_first_ts, phase_state, progress_messages, model_replies, debounce_last, response_upsert, slot_responses, model_labels, quiz_streaks, quiz_breakdown, quiz_scores,
    quiz_sample, quiz_best, quiz_category, fact_plans, fact_candidates, fallback_hits, plan_prompts, extraction_prompts, running_jobs, admission,
    job_overview, recent_three, stored_jobs, event_log, event_snapshot, configured_models, translations, scenario_translation, translate_requests,
    judge_answers, slot_models, chart_gate, verdict_texts, job_routes, progress_stream,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.statements(JUDGE_ANSWERS, PLAN_ANSWERS, NOW)
