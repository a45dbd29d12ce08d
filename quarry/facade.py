"""The engine's operations by name, over a set of tables: what a caller of an API asks for, as DataFrames.

Tables: documents (document_id, filename, status, type, total_pages, created_at, updated_at, output_uri), chunks (document_id, uri, content_type),
vectors (vec_id, document_id, embedding, text, and what filters name), jobs (job_id, base_url, status), pages (job_id, url, status), turns
(conversation_id, turn, status, message, answer), library (the key library). Reads return one frame. Changes return the changed tables by name, to be
written by the caller; nothing is collected but single rows that decide whether a call is allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import catalog, chat, flows, keylib, progress, rebuild, retrieval
from .operators.filters import compiled

Tables = dict[str, DataFrame]
FIELDS: dict[str, Callable] = {}
#: Which features of a demonstration a field needs.
FEATURES = {"startReindex": "reindex_all", "reprocessDocument": "reprocess", "reindexDocument": "reprocess", "deleteDocuments": "delete_documents", "deleteImage": "delete_documents"}


def field(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        FIELDS[name] = f
        return f

    return add


def call(name: str, tables: Tables, demo: bool = False, **arguments) -> DataFrame | Tables:
    """The operation of that name. ValueError for unknown ones and for those that a demonstration lacks."""
    if name not in FIELDS:
        raise ValueError(f"Unknown field: {name}")
    if demo and FEATURES.get(name) in flows.DISABLED:
        raise ValueError(f"{name} is disabled in Demo Mode")
    return FIELDS[name](tables, **arguments)


def _of(kind: str) -> Column:
    return F.coalesce("type", F.lit("document")) == kind


def _one(tables: Tables, document_id: int) -> dict:
    row = tables["documents"].where(F.col("document_id") == document_id).select("status", "type").first()
    if row is None:
        raise ValueError("Document not found")
    return row.asDict()


@field("getDocument")
def document(tables: Tables, document_id: int) -> DataFrame:
    return flows.view(tables["documents"].where(F.col("document_id") == document_id))


@field("listDocuments")
def documents(tables: Tables, limit: int = 50, after: int | None = None) -> DataFrame:
    return flows.view(catalog.keyset_page(tables["documents"].where(~_of("image")), "document_id", after, limit))


@field("getImage")
def image(tables: Tables, document_id: int) -> DataFrame:
    return flows.view(tables["documents"].where(_of("image") & (F.col("document_id") == document_id)))


@field("listImages")
def images(tables: Tables, limit: int = 50, after: int | None = None) -> DataFrame:
    return flows.view(flows.native_page(tables["documents"], "document_id", after, limit, _of("image")))


@field("deleteDocuments")
def without_documents(tables: Tables, document_ids: list[int]) -> Tables:
    """The rows of the documents go from all tables that name them."""
    gone = tables["documents"].where(F.col("document_id").isin(document_ids)).select("document_id")
    return catalog.cascade({n: t for n, t in tables.items() if "document_id" in t.columns}, gone, "document_id")


@field("deleteImage")
def without_image(tables: Tables, document_id: int) -> Tables:
    return without_documents(tables, [document_id])


def _again(tables: Tables, document_id: int, reindex: bool) -> Tables:
    state = tables["documents"].where(F.col("document_id") == document_id).select(flows.may_reprocess(F.col("status"), F.col("type"), reindex).alias("why"))
    _one(tables, document_id)
    if why := state.first().why:
        raise ValueError(f"Document cannot be processed again: {why}")
    mine = F.col("document_id") == document_id
    drop = mine & (F.coalesce("content_type", F.lit("text")) != "visual") if reindex else mine
    return {"documents": tables["documents"].withColumn("status", F.when(mine, "pending").otherwise(F.col("status"))), "chunks": tables["chunks"].where(~F.coalesce(drop, F.lit(False)))}


@field("reprocessDocument")
def reprocessed(tables: Tables, document_id: int) -> Tables:
    return _again(tables, document_id, False)


@field("reindexDocument")
def reindexed(tables: Tables, document_id: int) -> Tables:
    """The document's text goes from the index, what is visual stays."""
    return _again(tables, document_id, True)


@field("startReindex")
def rebuilt(tables: Tables, texts: DataFrame, locked: bool = False, folder: str | None = None, run: str = "reindex") -> Tables:
    """A new index of all documents and the tallies of its batches; refused while another one runs. Counts of keys begin anew.

    With a folder the run holds a lock there, and one that was broken off goes on under its name where it stood.
    """
    if locked:
        raise ValueError("A reindex is running")
    if folder is not None:
        tallies = rebuild.run(folder, run, tables["documents"].select("document_id", "filename", "type"), texts)
        return {"index": rebuild.current(texts.sparkSession, folder), "tallies": tallies, "library": keylib.reset(tables["library"])}
    chunks, tallies = flows.rebuilt(tables["documents"], texts)
    return {"index": chunks, "tallies": tallies, "library": keylib.reset(tables["library"])}


@field("getScrapeJob")
def job(tables: Tables, job_id: int) -> DataFrame:
    """A job with the progress of its pages."""
    return progress.crawl(tables["pages"].where(F.col("job_id") == job_id), "job_id", "status")


@field("listScrapeJobs")
def jobs(tables: Tables, limit: int = 50, after: int | None = None) -> DataFrame:
    return catalog.keyset_page(tables["jobs"], "job_id", after, limit)


@field("checkScrapeUrl")
def known_job(tables: Tables, url: str) -> DataFrame:
    """The latest job that began at the address."""
    return catalog.latest(tables["jobs"].where(F.col("base_url") == url), "base_url", ["job_id"], ["job_id", "status"])


@field("cancelScrape")
def cancelled(tables: Tables, job_id: int) -> Tables:
    mine = F.col("job_id") == job_id
    return {"jobs": catalog.transition(tables["jobs"], "status", catalog.ACTIVE_JOBS, "CANCELLED", mine), "pages": catalog.transition(tables["pages"], "status", ["PENDING"], "CANCELLED", mine)}


@field("getConversation")
def conversation(tables: Tables, conversation_id: str) -> DataFrame:
    return tables["turns"].where(F.col("conversation_id") == conversation_id).orderBy("turn")


@field("queryKnowledgeBase")
def searched(tables: Tables, query: str, vector: list[float], k: int = 5, condition: dict | None = None) -> DataFrame:
    """The best chunks with their documents' names; the vector stands for the embedded query."""
    if error := retrieval.query_error(query):
        raise ValueError(error)
    predicate = None if condition is None else compiled(condition, tables["vectors"].schema)
    found = retrieval.multislice(tables["vectors"], "embedding", vector, retrieval.results_wanted(k), predicate)
    return found.join(tables["documents"].select("document_id", "filename"), "document_id", "left")


@field("chat")
def asked(tables: Tables, questions: DataFrame, answer: Column | None = None) -> Tables:
    """A batch of questions as turns of their conversations, and what was found for each of them; turns have the columns of chat.TURN."""
    names = tables["documents"].select("document_id", F.col("filename").alias("source"))
    chunks = tables["vectors"].select("vec_id", "document_id", "embedding", "text").join(names, "document_id", "left")
    out = chat.answered(questions, tables["turns"], chunks, answer=answer)
    return {"turns": chat.stored(tables["turns"], out), "answers": out}


@field("getKeyLibrary")
def library(tables: Tables) -> DataFrame:
    return keylib.active(tables["library"])


@field("getMetadataStats")
def stats(tables: Tables) -> DataFrame:
    return keylib.stats(tables["library"])


@field("checkKeySimilarity")
def similar_keys(tables: Tables, key: str, threshold: float = 0.8) -> DataFrame:
    return keylib.similar(tables["library"], key, threshold)


@field("deleteMetadataKey")
def without_key(tables: Tables, key: str) -> Tables:
    return {"library": keylib.without(tables["library"], key)}


@field("analyzeMetadata")
def analysed(tables: Tables, maps: DataFrame, metadata: str, order: str) -> Tables:
    """The key library with what the sampled maps show."""
    return {"library": keylib.analysed(tables["library"], keylib.profile(maps, metadata, order))}


@field("getFilterExamples")
def examples(tables: Tables, n: int = 6) -> list[dict]:
    return keylib.filter_examples(tables["library"], n)
