"""Queries of the filter language and of row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import compiled, validated
from .registry import query

#: A metadata array made of a document's language and source.
TAGS = "list_value(lower(lang), lower(source))"


def _documents(documents):
    return documents.select("doc_id", "lang", "source", "n_chars", F.array(F.lower("lang"), F.lower("source")).alias("tags"))


def _ids(rows, expr, **how):
    return rows.where(compiled(validated(expr), rows.schema, **how)).select(rows.columns[0])


@query("documents", sql="SELECT doc_id FROM documents WHERE lang = 'en'")
def filter_eq(documents):
    return _ids(_documents(documents), {"lang": "EN"})


@query("documents", sql="SELECT doc_id FROM documents WHERE lang IS NULL OR lang <> 'en'")
def filter_ne(documents):
    return _ids(_documents(documents), {"lang": {"$ne": "en"}})


@query("documents", sql="SELECT doc_id FROM documents WHERE n_chars >= 500 AND n_chars < 2000")
def filter_range(documents):
    return _ids(_documents(documents), {"n_chars": {"$gte": 500, "$lt": 2000}})


@query("documents", sql="SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def filter_in(documents):
    return _ids(_documents(documents), {"lang": {"$in": ["fr", "de"]}})


@query("documents", sql="SELECT doc_id FROM documents WHERE lang IS NULL OR lang NOT IN ('fr', 'de')")
def filter_nin(documents):
    return _ids(_documents(documents), {"lang": {"$nin": ["fr", "de"]}})


@query("documents", sql=f"SELECT doc_id FROM documents WHERE list_contains({TAGS}, 'es')")
def filter_list_contains(documents):
    return _ids(_documents(documents), {"tags": {"$listContains": "es"}})


@query("documents", sql=f"SELECT doc_id FROM documents WHERE NOT coalesce(list_contains({TAGS}, 'fr'), false)")
def filter_array_ne(documents):
    return _ids(_documents(documents), {"tags": {"$ne": "fr"}})


@query("documents", sql="SELECT doc_id FROM documents WHERE (lang = 'en' AND n_chars > 1000) OR (lang = 'fr' AND n_chars <= 300)")
def filter_and_or(documents):
    return _ids(_documents(documents), {"$or": [{"$and": [{"lang": "en"}, {"n_chars": {"$gt": 1000}}]}, {"lang": "fr", "n_chars": {"$lte": 300}}]})


@query("documents", sql="SELECT doc_id FROM documents WHERE n_chars >= 500")
def filter_first_condition_compat(documents):
    return _ids(_documents(documents), {"n_chars": {"$gte": 500, "$lt": 2000}, "lang": "en"}, first_only=True)


@query("embeddings", sql="SELECT vec_id FROM embeddings WHERE label >= 2 AND label <= 5")
def filter_embedding_labels(embeddings):
    return _ids(embeddings.select("vec_id", "label"), {"label": {"$gte": 2, "$lte": 5}})


@query("documents", "labels", sql="""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def filter_metadata_map(documents, labels):
    """Labels as a sparse map of text values: numbers in it are compared as numbers."""
    one = labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("quality"))
    rows = documents.select("doc_id").join(one, "doc_id", "left")
    rows = rows.select("doc_id", F.when(F.col("quality").isNotNull(), F.create_map(F.lit("quality"), F.array("quality"))).alias("metadata"))
    return _ids(rows, {"quality": {"$gte": 1}}, metadata="metadata")


@query("documents", sql="SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN (SELECT min(source) FROM documents)")
def filter_type_absent_or_other(documents):
    """Rows without a type, or with another one than those named."""
    least = documents.agg(F.min("source")).first()[0]
    return _ids(_documents(documents).withColumn("source", F.lower("source")), {"source": {"$nin": [least]}})
