"""The chat entry: questions are checked, counted, put beside their history, searched for, given a context, and stored as turns.

A call answers a batch of questions at once: quotas, histories and turn numbers are windows over keys, and all questions are searched in one pass of the vectors. What a model would
say is a column of the prepared rows; without one the rows are stored as PENDING and answers come by completed().

Defined results: a blank question and one that is too long have an error and nothing else: they are not counted, searched or stored; a question of nobody (no user, no
conversation) is counted for all only; a question without a vector has no context; a question without a conversation begins one under its request's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog, progress, retrieval

#: Questions of one call, whose vectors come to the driver; chunks of a context.
MOST_QUESTIONS, CHUNKS, TURNS = 1000, 5, 5
#: Calls a day for all and for each user.
GLOBAL_DAILY, USER_DAILY = 10_000, 100
PRIMARY, FALLBACK = "primary", "fallback"
TURN = "conversation_id string, turn long, request_id long, user_id string, question string, context string, n_chunks long, model string, answer string, status string"


def question_error(query: Column) -> Column:
    """Why a question is refused, or null."""
    return F.when(F.coalesce(query, F.lit("")) == "", "No query provided").when(F.length(query) > retrieval.MAX_QUERY, f"Query exceeds maximum length of {retrieval.MAX_QUERY} characters")


def counted(questions: DataFrame, used: DataFrame | None = None, user_limit: int = USER_DAILY, global_limit: int = GLOBAL_DAILY) -> DataFrame:
    """questions (request_id, conversation_id, user_id, day) with model: the primary one within both limits of the day, else the fallback.

    used (conversation_id, user_id, day, request_id) are calls of the same days that were admitted before.
    """
    who = F.coalesce("user_id", F.concat(F.lit("anon:"), "conversation_id"), F.concat(F.lit("nobody:"), F.col("request_id").cast("string")))
    rows = questions.withColumn("_who", who).withColumn("_old", F.lit(1))
    if used is not None:
        rows = rows.unionByName(used.select("conversation_id", "user_id", "day", "request_id").withColumn("_who", who).withColumn("_old", F.lit(0)), allowMissingColumns=True)
    out = progress.coupled_quota(rows, "_who", "day", ["_old", "request_id"], user_limit, global_limit)
    return out.where("_old = 1").withColumn("model", F.when(F.col("admitted"), PRIMARY).otherwise(FALLBACK)).drop("_who", "_old", "admitted")


def histories(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """questions with history: the newest turns of their conversation that are done, oldest first."""
    mine = turns.join(questions.select("conversation_id").distinct(), "conversation_id", "left_semi")
    last = catalog.history(mine, "conversation_id", "turn", TURNS, F.col("status") == "COMPLETED")
    lists = last.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("history"))
    empty = F.array().cast("array<struct<turn:bigint,question:string,answer:string>>")
    return questions.join(lists, "conversation_id", "left").withColumn("history", F.coalesce("history", empty))


def contexts(questions: DataFrame, chunks: DataFrame, k: int = CHUNKS) -> DataFrame:
    """(request_id, context, n_chunks, sources) of questions (request_id, embedding) from chunks (vec_id, embedding, text, source): all searched in one pass."""
    asked = questions.where(F.col("embedding").isNotNull()).select("request_id", "embedding").orderBy("request_id").limit(MOST_QUESTIONS + 1).collect()
    if len(asked) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions in one call")
    spark = questions.sparkSession
    if not asked:
        return spark.createDataFrame([], "request_id long, context string, n_chunks long, sources array<string>")
    widths: dict[int, list] = {}
    for r in asked:
        widths.setdefault(len(r.embedding), []).append(r)
    found = None
    for rows in widths.values():
        ids = spark.createDataFrame([(i, r.request_id) for i, r in enumerate(rows)], "query int, request_id long")
        part = retrieval.search_many(chunks, "embedding", [list(r.embedding) for r in rows], k).join(ids, "query")
        found = part if found is None else found.unionByName(part)
    texts = found.join(chunks.select("vec_id", "text", "source"), "vec_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("source", F.lit("unknown")).alias("s")))), lambda x: x["s"])
    named = texts.groupBy("request_id").agg(F.array_distinct(names).alias("sources"))
    return retrieval.context(texts, "text", "source", "rank", k, group="request_id").join(named, "request_id")


def answered(questions: DataFrame, turns: DataFrame, chunks: DataFrame, used: DataFrame | None = None, answer: Column | None = None, user_limit: int = USER_DAILY, global_limit: int = GLOBAL_DAILY) -> DataFrame:
    """(request_id, error, history, sources and the columns of TURN) of questions (request_id, conversation_id, user_id, day, query, embedding).

    turns (TURN) are what is stored; answer is a column over query, history and context.
    """
    rows = questions.withColumn("error", question_error(F.col("query")))
    good = rows.where("error is null").withColumn("conversation_id", F.coalesce("conversation_id", F.concat(F.lit("request-"), F.col("request_id").cast("string"))))
    known = questions.where("conversation_id is not null").select("request_id", F.lit(True).alias("_known"))
    good = good.join(known, "request_id", "left")
    # a conversation that the call begins does not make its asker somebody
    models = counted(good.select("request_id", F.when(F.col("_known"), F.col("conversation_id")).alias("conversation_id"), "user_id", "day"), used, user_limit, global_limit).select("request_id", "model")
    full = histories(good.drop("_known"), turns).join(models, "request_id").join(contexts(good, chunks), "request_id", "left")
    last = turns.groupBy("conversation_id").agg(F.max("turn").alias("_last"))
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy("request_id"))
    full = full.join(last, "conversation_id", "left").withColumn("turn", (F.coalesce("_last", F.lit(0)) + n).cast("long"))
    full = full.withColumns({"context": F.coalesce("context", F.lit("")), "n_chunks": F.coalesce("n_chunks", F.lit(0)).cast("long"), "sources": F.coalesce("sources", F.array().cast("array<string>"))})
    full = full.withColumn("answer", F.lit(None).cast("string") if answer is None else answer).withColumn("status", F.when(F.col("answer").isNull(), "PENDING").otherwise("COMPLETED"))
    columns = ["request_id", "error", "history", "sources", "conversation_id", "turn", "user_id", F.col("query").alias("question"), "context", "n_chunks", "model", "answer", "status"]
    return full.select(*columns).unionByName(rows.where("error is not null").select("request_id", "error"), allowMissingColumns=True)


def stored(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The turns after a call; a request that is there already is not stored again."""
    names = [x.split()[0] for x in TURN.split(", ")]
    new = answers.where("error is null").select(*names).join(turns.select("request_id"), "request_id", "left_anti")
    return turns.select(*names).unionByName(new.select(*names))


def completed(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """Turns with the answers (request_id, answer, error) of those that are pending: COMPLETED or ERROR."""
    new = answers.select("request_id", F.col("answer").alias("_answer"), F.col("error").alias("_error"))
    out = turns.join(new, "request_id", "left")
    open_ = (F.col("status") == "PENDING") & (F.col("_answer").isNotNull() | F.col("_error").isNotNull())
    return out.withColumn("answer", F.when(open_, F.coalesce("_answer", "_error")).otherwise(F.col("answer"))).withColumn("status", F.when(open_, F.when(F.col("_error").isNotNull(), "ERROR").otherwise("COMPLETED")).otherwise(F.col("status"))).select(*turns.columns)
