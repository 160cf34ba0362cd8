"""Context budget, relevance, strategy and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NO_CONTEXT_ANSWER = "No relevant information was found."


def within_budget(passages: DataFrame, budget: int = 6000, most: int = 3) -> DataFrame:
    """Of the first passages by rank, those before the running token estimate leaves the budget."""
    running = F.sum(T.token_estimate(F.col("text"))).over(Window.partitionBy("query_id").orderBy("rank"))
    return passages.withColumn("tokens", running).where((F.col("tokens") <= budget) & (F.col("rank") <= most))


def document_relevance(scores: DataFrame, least: float = 0.7) -> DataFrame:
    """A row a query: relevant passages, all, best and mean of the squashed scores, and whether any is relevant."""
    s = T.sigmoid(F.col("score"))
    hit = F.count_if(s >= least)
    return scores.groupBy("query_id").agg(hit.alias("relevant_count"), F.count(F.lit(1)).alias("total_count"), F.round(F.max(s), 9).alias("max_score"), F.round(F.avg(s), 9).alias("avg_score"), (hit > 0).alias("is_relevant"))


def fallback_relevance(passages: DataFrame) -> DataFrame:
    """Without scores a query (query_id, text) is served if any passage has over 20 characters."""
    return passages.groupBy("query_id").agg(F.coalesce(F.bool_or(F.length(F.trim("text")) > 20), F.lit(False)).alias("is_relevant"))


def strategy(docs_relevant: Column, graph_relevant: Column) -> Column:
    return F.when(docs_relevant & graph_relevant, "HYBRID").when(docs_relevant, "DOC_ONLY").when(graph_relevant, "KG_ONLY").otherwise("NO_CONTEXT")


def graph_context(triplets: DataFrame, style: str = "compact") -> DataFrame:
    """One text of a query's triplets (query_id, rank, symptom, cause, remedy): compact, detailed or json."""
    one = {
        "compact": F.concat_ws(" → ", "symptom", "cause", "remedy"),
        "detailed": F.concat(F.lit("Triplet "), F.col("rank").cast("string"), F.lit("\nSymptom: "), F.col("symptom"), F.lit("\nCause: "), F.col("cause"), F.lit("\nRemedy: "), F.col("remedy")),
        "json": F.to_json(F.struct("symptom", "cause", "remedy")),
    }[style]
    rows = triplets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("line")))).alias("lines"))
    joined = F.array_join(F.col("lines.line"), {"compact": "\n", "detailed": "\n\n", "json": ","}[style])
    return rows.select("query_id", (F.concat(F.lit("["), joined, F.lit("]")) if style == "json" else joined).alias("context"))


def graph_relevance(context: Column) -> Column:
    """Lines with an arrow in a context that does not say there is none."""
    lines = F.size(F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: F.contains(x, F.lit("→"))))
    return F.when(F.startswith(F.coalesce(context, F.lit("")), F.lit("No relevant")), 0).otherwise(lines)


def prompt(template: str, **values: Column) -> Column:
    return T.filled(template, **values)


def extractive_answer(context: Column, passage: Column, chosen: Column) -> Column:
    """The default generator: the best triplet, the first sentence, or a fixed sentence without context."""
    first_line = F.split_part(context, F.lit("\n"), F.lit(1))
    first_sentence = F.get(T.sentences(passage), F.lit(0))
    return F.when(chosen == "NO_CONTEXT", NO_CONTEXT_ANSWER).when(chosen == "DOC_ONLY", first_sentence).otherwise(first_line)


# The fields of a processed query.
TERM_FIELDS = ("error_codes", "components", "equipment_models", "technical_keywords")
EQUIPMENT_FIELDS = ("primary_equipment", "equipment_type", "manufacturer", "series")
UNKNOWN = "unknown"


def processed_query(raw: DataFrame) -> DataFrame:
    """Structured queries from a model's prose (query_id, raw_query, reply), with defaults for what is missing.

    Lists default to empty ones, equipment to ``unknown`` (``equipment`` is null then), the confidence to 0.5, or 0
    where there is no JSON at all.
    """
    terms = ",".join(f"{n}:array<string>" for n in TERM_FIELDS)
    equipment = ",".join(f"{n}:string" for n in EQUIPMENT_FIELDS)
    schema = f"filtered_query string, query_variants array<string>, confidence_score double, technical_terms struct<{terms}>, equipment_info struct<{equipment}>"
    rows = raw.withColumn("p", F.from_json(T.json_in_prose(F.col("reply")), schema))
    none = F.array().cast("array<string>")
    filtered = F.coalesce(F.nullif(F.trim("p.filtered_query"), F.lit("")), F.col("raw_query"))
    variants = F.coalesce("p.query_variants", none)
    primary = F.coalesce("p.equipment_info.primary_equipment", F.lit(UNKNOWN))
    return rows.select(
        "query_id",
        "raw_query",
        filtered.alias("primary_query"),
        variants.alias("query_variants"),
        F.array_distinct(F.concat(F.array(filtered), variants)).alias("all_queries"),
        F.coalesce("p.confidence_score", F.when(F.col("p").isNull(), 0.0).otherwise(0.5)).alias("confidence_score"),
        F.struct(*(F.coalesce(f"p.technical_terms.{n}", none).alias(n) for n in TERM_FIELDS)).alias("technical_terms"),
        F.struct(*(F.coalesce(f"p.equipment_info.{n}", F.lit(UNKNOWN)).alias(n) for n in EQUIPMENT_FIELDS)).alias("equipment_info"),
        F.nullif(primary, F.lit(UNKNOWN)).alias("equipment"),
    )


def prompt_sections(text: Column, least: int = 3) -> Column:
    """A prompt file's sections by name: ``# === PROMPT NAME ===`` and what follows, trimmed; null with fewer than ``least``."""
    sections = F.slice(F.split(text, r"# === PROMPT "), 2, 1_000)
    header = lambda s: F.split_part(s, F.lit("\n"), F.lit(1))
    entries = F.transform(sections, lambda s: F.struct(F.trim(F.split_part(header(s), F.lit(" ==="), F.lit(1))), F.trim(F.substring(s, F.length(header(s)) + 1, F.length(s)), F.lit(" \n\t\r"))))
    return F.when(F.size(entries) >= least, F.map_from_entries(entries))


def answers_in_prompt(prompt_text: Column, most: int = 4) -> Column:
    """The answers that a judge's prompt holds: lines below a ``RESPONSE`` line that names a system, joined by blanks.

    A line with EVALUATION CRITERIA, or another RESPONSE line, ends an answer; a line with Provide JSON ends the search.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(False).alias("over"))

    def step(acc, raw):
        line = F.trim(raw)
        has = lambda word: F.contains(raw, F.lit(word))
        names = has("RAG") | has("CLASSIQUE") | has("DENSE") | has("SPARSE")
        head = has("RESPONSE") & names
        stop = ~head & acc["held"].isNotNull() & (F.startswith(raw, F.lit("RESPONSE")) | has("Provide JSON") | has("EVALUATION CRITERIA"))
        closed = F.when(F.coalesce(acc["held"], F.lit("")) != "", F.concat(acc["done"], F.array(F.trim(acc["held"])))).otherwise(acc["done"])
        held = F.when(head | stop, F.lit("")).when(acc["held"].isNotNull() & (line != ""), F.concat(acc["held"], line, F.lit(" "))).otherwise(acc["held"])
        over = acc["over"] | (stop & has("Provide JSON"))
        new = F.struct(F.when(head | stop, closed).otherwise(acc["done"]).alias("done"), F.when(stop & has("Provide JSON"), F.lit(None).cast("string")).otherwise(held).alias("held"), over.alias("over"))
        return F.when(acc["over"], acc).otherwise(new)

    finish = lambda acc: F.slice(F.when(F.coalesce(acc["held"], F.lit("")) != "", F.concat(acc["done"], F.array(F.trim(acc["held"])))).otherwise(acc["done"]), 1, most)
    return F.aggregate(F.split(F.coalesce(prompt_text, F.lit("")), "\n"), state, step, finish)


def judge_prompt(answers: dict[str, Column], question: Column) -> Column:
    """A judge's prompt for two or four answers, by system name; the template has as many places as there are answers."""
    if len(answers) not in (2, 4):
        raise ValueError("a judge compares two or four answers")
    parts = [F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\n")]
    for k, (name, answer) in enumerate(answers.items(), 1):
        parts += [F.lit(f"RESPONSE {k} (RAG {name.upper()}):\n"), F.coalesce(answer, F.lit("")), F.lit("\n")]
    wanted = ", ".join(f'"score_{n}": 0-5' for n in answers)
    return F.concat(*parts, F.lit("EVALUATION CRITERIA: relevance, completeness, correctness\nProvide JSON: {" + wanted + "}"))


def score_comparison(scores: DataFrame, names: tuple[str, ...] = ("classic", "dense", "sparse", "dense_sc")) -> DataFrame:
    """answer_set, system, score, rank of a judge's scores, best first."""
    pairs = ", ".join(f"'{n}', score_{n}" for n in names)
    rows = scores.selectExpr("answer_set", f"stack({len(names)}, {pairs}) as (system, score)")
    order = Window.partitionBy("answer_set").orderBy(F.col("score").desc(), "system")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def display_strategy(scores: DataFrame, contexts: DataFrame, least: float = 0.7) -> DataFrame:
    """query_id, strategy, max_score, triplets as shown beside an answer: decided by the same scores as the answer.

    scores: query_id, score (raw); contexts: query_id, context.
    """
    docs = document_relevance(scores, least).select("query_id", "is_relevant", "max_score")
    known = contexts.select("query_id", graph_relevance(F.col("context")).cast("long").alias("triplets"))
    both = docs.join(known, "query_id", "full_outer")
    return both.select("query_id", strategy(F.coalesce("is_relevant", F.lit(False)), F.coalesce("triplets", F.lit(0)) > 0).alias("strategy"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.coalesce("triplets", F.lit(0).cast("long")).alias("triplets"))


#: What a generator, a reranker and a client work with, unless settings say otherwise.
DEFAULTS = {
    "generator": {"context_token_limit": 6000, "max_context_chunks": 3, "max_triplets": 3, "relevance_threshold": 0.7, "importance_context_rerank": 50, "importance_context_graph": 50},
    "reranker": {"most_chars": 502, "top_k": 5},
    "client": {"model": "none", "max_tokens": 1000, "temperature": 0.1},
}


def settings(part: str, given: dict | None = None) -> dict:
    """The settings of a part: given ones before defaults."""
    return DEFAULTS[part] | {k: v for k, v in (given or {}).items() if v is not None}


def configuration(spark, given: dict[str, dict] | None = None) -> DataFrame:
    """part, name, value of all settings in force."""
    rows = [(part, name, str(value)) for part in DEFAULTS for name, value in settings(part, (given or {}).get(part)).items()]
    return spark.createDataFrame(rows, "part string, name string, value string")


class Client:
    """A model behind a function (prompts, settings) to replies, both DataFrames; without one, asking is an error."""

    def __init__(self, call=None, given: dict | None = None):
        self.call, self.settings = call, settings("client", given)

    def ask(self, prompts: DataFrame) -> DataFrame:
        """prompts: query_id, prompt; the replies are kept in the checkpoint folder, so each is asked for once."""
        if self.call is None:
            raise RuntimeError("no model is connected")
        return checkpointed(self.call(prompts, self.settings))


def rewrite_query(queries: DataFrame) -> DataFrame:
    """The default rewriter: codes first, then terms; two variants (terms only, codes only)."""
    codes, terms = T.strict_codes(F.col("text")), T.analyzed(F.col("text"))
    code_text, term_text = F.array_join(codes, " "), F.array_join(terms, " ")
    return queries.select("query_id", F.trim(F.concat_ws(" ", code_text, term_text)).alias("filtered_query"), F.filter(F.array(term_text, code_text), lambda v: v != "").alias("variants"))


def verdict(replies: DataFrame, names: tuple[str, ...] = ("classic", "dense", "sparse", "dense_sc")) -> DataFrame:
    """A judge's scores from prose (answer_set, reply), of two or four answers; 2.5 each where it cannot be read."""
    p = F.from_json(T.json_in_prose(F.col("reply")), ", ".join(f"score_{n} double" for n in names))
    return replies.withColumn("p", p).select("answer_set", *(F.coalesce(f"p.score_{n}", F.lit(2.5)).alias(f"score_{n}") for n in names))


def inconsistent_pairs(answers: DataFrame, alike: float = 0.9, apart: float = 0.3) -> DataFrame:
    """Pairs of nearly equal answers (answer_set, name, answer, score) whose scores differ too much; four answers a set."""
    a = answers.select("answer_set", F.col("name").alias("a"), F.col("answer").alias("ta"), F.col("score").alias("sa"))
    b = answers.select("answer_set", F.col("name").alias("b"), F.col("answer").alias("tb"), F.col("score").alias("sb"))
    pairs = a.join(b, "answer_set").where("a < b")
    return pairs.where((T.sequence_ratio("ta", "tb") >= alike) & (F.abs(F.col("sa") - F.col("sb")) > apart)).select("answer_set", "a", "b", "sa", "sb")


def judged(answers: DataFrame, judge, retries: int = 2) -> DataFrame:
    """Scores of a judge (a function from answers to answers with ``score``), asked again for inconsistent sets.

    answers: answer_set, name, answer. The last attempt is accepted as it is. ``judge`` also gets the attempt's number.
    """
    done, todo = None, answers
    for attempt in range(retries + 1):
        scored = checkpointed(judge(todo, attempt))
        again = inconsistent_pairs(scored).select("answer_set").distinct() if attempt < retries else None
        fine = scored if again is None else scored.join(again, "answer_set", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        if again is None or again.isEmpty():
            break
        todo = todo.join(again, "answer_set", "left_semi")
    return done


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows of a model, kept in the shared checkpoint folder, so that they are asked for once; an error where none is named."""
    context = rows.sparkSession.sparkContext
    folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            raise ValueError("set spark.checkpoint.dir: a model's replies must not be asked for again")
        context.setCheckpointDir(folder)
    return rows.checkpoint()


def report(figures: DataFrame) -> DataFrame:
    """One row of figures as a text, a line a column: ``Name: value``."""
    lines = [F.concat(F.lit(f"{c.replace('_', ' ').capitalize()}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in figures.columns]
    return figures.select(F.concat_ws("\n", *lines).alias("report"))
