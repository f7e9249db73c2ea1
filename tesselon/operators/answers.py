"""Context budgets, prompts, template answers, confidence, the feedback loop and output validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pii
from ..functions import rules
from ..functions.text import pii_types, token_estimate
from ..session import shared_folder


def within_budget(ranked: DataFrame, key: str, budget: int) -> DataFrame:
    """The first chunks of each list whose running token count stays in the budget."""
    used = F.sum(token_estimate(F.col("text")).cast("long")).over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running_tokens", used).where(F.col("running_tokens") <= budget)


def context(chunks: DataFrame, key: str) -> DataFrame:
    part = F.concat(F.lit("--- Context "), (F.col("rank") + 1).cast("string"), F.lit(" ---\n"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"])
    return chunks.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("context"))


def confidence(avg_score: Column, n_results: Column, answer: Column) -> Column:
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    base = 0.4 * F.least(F.lit(1.0), avg_score) + 0.3 * F.least(F.lit(1.0), n_results / 3) + 0.3 * F.least(F.lit(1.0), words / 20)
    low = F.lower(answer).rlike(rules.FALLBACK)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(low, 0.3).otherwise(base))), 3)


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def feedback(score: Column, attempt: Column) -> Column:
    return F.when((attempt >= 2) | (score >= 0.7), "stop").when((score >= 0.5) & (attempt == 0), "expand_query").when(score < 0.5, "increase_k").otherwise("stop")


def validated(answer: Column) -> Column:
    types = pii_types(answer)
    return F.when(F.size(types) > 0, F.struct(F.lit(True).alias("blocked"), types.alias("types"))).otherwise(F.struct(F.lit(False).alias("blocked"), types.alias("types")))


NO_CONTEXT, NOT_AVAILABLE = rules.NO_CONTEXT, rules.NOT_AVAILABLE


def source_label(kind: Column, section: Column, score: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(kind, F.lit("document")), F.lit(" | "), F.coalesce(section, F.lit("general")), F.lit(" | score: "), F.format_string("%.2f", score.cast("double")), F.lit("]"))


def ordered_text(parts: Column, between: str) -> Column:
    """An aggregate: ``parts`` of a group in rank order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", parts.alias("p")))), lambda x: x["p"]), between)


def prompts(questions: DataFrame, chunks: DataFrame, budget: int = 6000) -> DataFrame:
    """query_id, user_message, n_context, tokens.

    questions: query_id, question, patient_id (or null).  chunks: query_id, rank, text, kind, section, score.  Chunks
    are taken in rank order as long as their tokens stay in the budget.
    """
    fit = within_budget(chunks.where("text is not null"), "query_id", budget)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("string")
    part = F.concat(F.lit("--- Context "), F.col("place"), F.lit(" "), source_label(F.col("kind"), F.col("section"), F.col("score")), F.lit(" ---\n"), F.col("text"))
    made = fit.withColumn("place", place).groupBy("query_id").agg(ordered_text(part, "\n\n").alias("context"), F.count("*").cast("int").alias("n_context"), F.max("running_tokens").alias("used"))
    question = F.coalesce("question", F.lit(""))
    body = F.concat(F.lit("PATIENT CONTEXT:\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit("\n\nQUESTION: "), question, F.lit(f"\n\n{rules.ONLY_CONTEXT}"))
    head = F.when(F.col("patient_id").isNotNull(), F.concat(F.lit("Patient ID: "), "patient_id", F.lit("\n\n"))).otherwise("")
    return questions.join(made, "query_id", "left").select("query_id", F.concat(head, body).alias("user_message"), F.coalesce("n_context", F.lit(0)).alias("n_context"), (F.coalesce("used", F.lit(0)) + F.floor(F.length(question) / 4)).cast("int").alias("tokens"))


def template_answer(message: Column) -> Column:
    """struct(answer, input_tokens, output_tokens): what stands in for a language model, a pure function of the prompt."""
    context, question = F.instr(message, "--- Context"), F.instr(message, "QUESTION:")
    until = F.when(question > 1, F.greatest(question - context, F.lit(0))).otherwise(F.length(message))
    snippet = F.regexp_replace(F.substring(F.substr(message, context, until), 1, 300), r"^\s+|\s+$", "")
    answer = F.when(context == 0, NOT_AVAILABLE).otherwise(F.concat(F.lit(rules.FROM_RECORDS), F.substring(snippet, 1, 200), F.lit("...\n\n[Mock response]")))
    quarter = lambda c: F.floor(F.length(c) / 4).cast("int")
    return F.struct(answer.alias("answer"), quarter(message).alias("input_tokens"), quarter(answer).alias("output_tokens"))


def broader(query: Column) -> Column:
    """A wider query: short ones ask for related information, others lose the words exact and only."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return F.when(words < 10, F.concat(query, F.lit(" related information"))).otherwise(F.replace(F.replace(query, F.lit(" exact "), F.lit(" ")), F.lit(" only "), F.lit(" ")))


def with_warning(answer: Column, score: Column) -> Column:
    share = F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))
    low = F.concat(answer, F.lit("\n\n[Note: Low confidence ("), share, F.lit(f"). {rules.LOW_CONFIDENCE}]"))
    fair = F.concat(answer, F.lit("\n\n[Note: Moderate confidence ("), share, F.lit(f"). {rules.FAIR_CONFIDENCE}]"))
    return F.when(score < 0.5, low).when(score < 0.7, fair).otherwise(answer)


def feedback_loop(questions: DataFrame, attempt_at, k: int, more: int = 20, passes: int = 3) -> DataFrame:
    """query_id, answer, score, attempts, action: answered again with a broader query or more chunks as long as that may help.

    ``attempt_at(open)`` takes (query_id, question, k) and adds answer and score.  Each pass runs over the questions
    still open, all at once; there are at most ``passes``.  Each is written to the shared folder, else one task would hold
    the sorts and joins of all passes, and the first ones would run again for each later one.
    """
    spark = questions.sparkSession
    open_, done = questions.withColumn("k", F.lit(k)), None
    for attempt in range(passes):
        tried = attempt_at(open_).withColumns({"attempts": F.lit(attempt), "action": feedback(F.col("score"), F.lit(attempt))})
        path = shared_folder(spark)
        tried.write.parquet(path)
        tried = spark.read.parquet(path)
        ended = tried.where("action = 'stop'").select("query_id", "answer", "score", "attempts", "action")
        done = ended if done is None else done.unionByName(ended)
        again = F.col("action") == "expand_query"
        open_ = tried.where("action != 'stop'").select("query_id", F.when(again, broader(F.col("question"))).otherwise(F.col("question")).alias("question"), F.when(again, F.col("k")).otherwise(more).alias("k"))
    return done


def evaluation_prompts(questions: DataFrame, chunks: DataFrame, budget: int = 7424) -> DataFrame:
    """query_id, user_message, n_context, context_tokens, utilisation: the evaluation variant, texts cleaned first."""
    cleaned = chunks.where("text is not null").withColumn("text", pii.clean(F.col("text")))
    tokens = F.floor(F.length("text") / 4)
    used = F.sum(tokens).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    label = F.concat(F.lit("[Source: "), F.coalesce("kind", F.lit("record")), F.lit(" | Section: "), F.coalesce("section", F.lit("None")), F.lit(" | RRF score: "), F.format_string("%.4f", F.col("score").cast("double")), F.lit("]\n"), "text")
    made = cleaned.withColumn("used", used).where(F.col("used") <= budget).groupBy("query_id").agg(ordered_text(label, "\n\n---\n\n").alias("context"), F.count("*").cast("int").alias("n_context"), F.max("used").alias("context_tokens"))
    body = F.concat(F.lit("CLINICAL RECORDS CONTEXT:\n\n"), F.coalesce("context", F.lit(rules.NO_CONTEXT_EVALUATION)), F.lit("\n\n---\n\nQUESTION: "), F.coalesce("question", F.lit("")), F.lit(f"\n\n{rules.ONLY_CONTEXT_EVALUATION}"))
    n = F.coalesce("context_tokens", F.lit(0)).cast("int")
    return questions.join(made, "query_id", "left").select("query_id", body.alias("user_message"), F.coalesce("n_context", F.lit(0)).alias("n_context"), n.alias("context_tokens"), F.round(n / budget, 6).alias("utilisation"))


def keyword_answer(message: Column, section: Column, keywords: Column) -> Column:
    """The first line that holds each of the first five keywords found in the prompt."""
    low = F.lower(message)
    found = F.filter(keywords, lambda k: low.contains(F.lower(k)))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def made(lines):
        line = lambda k: F.get(F.filter(lines, lambda x: F.lower(x).contains(F.lower(k)) & (F.length(strip(x)) > 5)), 0)
        hits = F.array_compact(F.transform(F.slice(found, 1, 5), lambda k: F.concat(F.lit("  - "), F.substring(strip(line(k)), 1, 100))))
        full = F.array_join(F.concat(F.array(F.concat(F.lit("Based on ["), section, F.lit("]:"))), hits), "\n")
        return F.when(F.size(hits) > 0, full).otherwise(F.concat(F.lit("Found: "), F.array_join(found, ", ")))

    return F.when(F.size(found) == 0, rules.NOT_FOUND).otherwise(F.transform(F.array(F.split(message, "\n")), made)[0])


def coverage(text: Column, keywords: Column) -> Column:
    """Share of the keywords that occur in a text, 1 if there are none."""
    low = F.lower(text)
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda k: low.contains(F.lower(k)))) / F.size(keywords))


def keyword_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, recall, precision: keywords found in any chunk, and chunks that hold any keyword.  questions: query_id, keywords."""
    low = F.lower(F.coalesce("text", F.lit("")))
    both = questions.join(chunks, "query_id", "left")
    held = F.transform("keywords", lambda k: F.coalesce(low.contains(F.lower(k)), F.lit(False)))
    per = both.select("query_id", "keywords", F.col("rank").isNotNull().alias("chunk"), held.alias("held")).select("query_id", "keywords", "chunk", F.exists("held", lambda x: x).alias("relevant"), F.posexplode_outer("held").alias("k", "hit"))
    words = per.groupBy("query_id", "k").agg(F.max("hit").alias("hit")).groupBy("query_id").agg(F.count("k").alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"))
    chunks_ = per.where("chunk and coalesce(k, 0) = 0").groupBy("query_id").agg(F.count("*").alias("m"), F.sum(F.coalesce(F.col("relevant"), F.lit(False)).cast("int")).alias("relevant"))
    recall = F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("hits") / F.col("n"), 6))
    precision = F.when((F.col("n") == 0) | F.col("m").isNull(), 0.0).otherwise(F.round(F.col("relevant") / F.col("m"), 6))
    return words.join(chunks_, "query_id", "left").select("query_id", recall.alias("recall"), precision.alias("precision"))


def context_by_document(chunks: DataFrame, overlap: int, budget: int) -> DataFrame:
    """query_id, context, chunks, documents, tokens from (query_id, rank, doc_id, chunk_index, text), a rank a document.

    Grouped by document in the order of rank, chunks in their own order, without the ``overlap`` words that a chunk repeats
    of the one before; those that no longer fit into the budget are left out, as all after them.
    """
    words = F.split("text", " ")
    part = F.when(F.col("chunk_index") == 0, F.col("text")).otherwise(F.array_join(F.slice(words, overlap + 1, F.greatest(F.size(words), F.lit(1))), " "))
    own = chunks.select("query_id", "rank", "doc_id", "chunk_index", part.alias("part")).where("part <> ''")
    used = F.sum(token_estimate(F.col("part"))).over(Window.partitionBy("query_id").orderBy("rank", "chunk_index"))
    kept = own.withColumn("used", used).where(F.col("used") <= budget)
    in_order = lambda c, k, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(c).alias("c")))), lambda x: x["c"]), sep)
    told = F.concat(F.lit("=== Document "), F.col("doc_id").cast("string"), F.lit(" ===\n"), in_order("part", "chunk_index", "\n"))
    of = kept.groupBy("query_id", "rank", "doc_id").agg(told.alias("told"), F.count("*").alias("n"), F.max("used").alias("used"))
    return of.groupBy("query_id").agg(in_order("told", "rank", "\n\n").alias("context"), F.sum("n").alias("chunks"), F.count("*").alias("documents"), F.max("used").alias("tokens"))
