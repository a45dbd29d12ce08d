import pytest
from pyspark.sql import functions as F

from quarry import facade
from quarry.operators import chat, flows, keylib, rebuild


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    documents = make([(1, "a.txt", "indexed", None, 2, "2024-01-01", "2024-01-02", "out/1"), (2, None, "processing", "document", None, None, "2024-01-03", None), (3, "p.md", "indexed", "scraped", 1, None, None, "out/3"), (4, "i.png", "indexed", "image", 1, None, None, "out/4")], "document_id long, filename string, status string, type string, total_pages int, created_at string, updated_at string, output_uri string")
    chunks = make([(1, "c/1/t", "text"), (1, "c/1/v", "visual"), (3, "c/3/t", None)], "document_id long, uri string, content_type string")
    vectors = make([(10, 1, [1.0, 0.0], "one", "x"), (11, 3, [0.0, 1.0], "two", "y"), (12, 4, [0.7, 0.7], "three", "x")], "vec_id long, document_id long, embedding array<double>, text string, topic string")
    jobs = make([(7, "http://a", "COMPLETED"), (8, "http://a", "PROCESSING")], "job_id long, base_url string, status string")
    pages = make([(8, "http://a/1", "COMPLETED"), (8, "http://a/2", "PENDING"), (7, "http://a/1", "COMPLETED")], "job_id long, url string, status string")
    turns = make([("c", 2, "COMPLETED", "q2", "a2"), ("c", 1, "COMPLETED", "q1", "a1")], "conversation_id string, turn int, status string, message string, answer string")
    library = make([("topic", "string", ["x", "y"], 3, None, None, "active"), ("old", "string", ["z"], 1, None, None, "deprecated")], keylib.LIBRARY)
    return {"documents": documents, "chunks": chunks, "vectors": vectors, "jobs": jobs, "pages": pages, "turns": turns, "library": library}


def ids(df, key="document_id"):
    return sorted(r[key] for r in df.collect())


def test_reads(spark, tables):
    call = lambda name, **a: facade.call(name, tables, **a)
    assert [tuple(r) for r in call("getDocument", document_id=2).collect()] == [(2, "", "PROCESSING", 0, "2024-01-03", None)]
    assert ids(call("listDocuments", limit=2)) == [1, 2] and ids(call("listDocuments", limit=2, after=2)) == [3]
    assert ids(call("listImages", limit=2)) == [] and ids(call("listImages", limit=2, after=2)) == [4] and ids(call("getImage", document_id=1)) == []
    assert call("checkScrapeUrl", url="http://a").first().job_id == 8 and ids(call("listScrapeJobs"), "job_id") == [7, 8]
    assert call("getScrapeJob", job_id=8).count() == 1
    assert [r.turn for r in call("getConversation", conversation_id="c").collect()] == [1, 2]
    found = call("queryKnowledgeBase", query="which?", vector=[1.0, 0.1], condition={"topic": {"$eq": "x"}}).collect()
    assert {r.filename for r in found} == {"a.txt", "p.md", "i.png"} and min(found, key=lambda r: r["rank"]).vec_id == 10
    assert ids(call("getKeyLibrary"), "key_name") == ["topic"] and call("getMetadataStats").first().active_keys == 1
    assert isinstance(call("getFilterExamples"), list)
    with pytest.raises(ValueError):
        call("nothing")
    with pytest.raises(ValueError):
        call("queryKnowledgeBase", query="", vector=[1.0, 0.0])


def test_changes(spark, tables):
    call = lambda name, **a: facade.call(name, tables, **a)
    left = call("deleteDocuments", document_ids=[1])
    assert ids(left["documents"]) == [2, 3, 4] and ids(left["chunks"]) == [3] and ids(left["vectors"]) == [3, 4]
    again = call("reindexDocument", document_id=1)
    assert ids(again["chunks"], "uri") == ["c/1/v", "c/3/t"] and again["documents"].where("document_id = 1").first().status == "pending"
    assert ids(call("reprocessDocument", document_id=1)["chunks"], "uri") == ["c/3/t"]
    for name, document in (("reprocessDocument", 2), ("reindexDocument", 2), ("reprocessDocument", 3), ("reprocessDocument", 99)):
        with pytest.raises(ValueError):
            call(name, document_id=document)
    assert ids(call("reindexDocument", document_id=3)["chunks"], "uri") == ["c/1/t", "c/1/v"]
    done = call("cancelScrape", job_id=8)
    assert {(r.job_id, r.status) for r in done["jobs"].collect()} == {(7, "COMPLETED"), (8, "CANCELLED")} and done["pages"].where("status = 'CANCELLED'").count() == 1
    assert ids(call("deleteMetadataKey", key="topic")["library"], "key_name") == ["old"]
    texts = spark.createDataFrame([(1, "some words here"), (3, "more")], "document_id long, text string")
    new = call("startReindex", texts=texts)
    assert ids(new["index"]) == [1, 3] and new["tallies"].agg(F.sum("error_count")).first()[0] == 2 and new["library"].agg(F.sum("occurrence_count")).first()[0] == 0
    with pytest.raises(ValueError):
        call("startReindex", texts=texts, locked=True)
    for name in facade.FEATURES:
        with pytest.raises(ValueError):
            facade.call(name, tables, demo=True)
    assert set(facade.FEATURES.values()) == set(flows.DISABLED)


def test_rebuild_under_a_lock(spark, tables, tmp_path):
    folder, texts = f"file://{tmp_path}/index", spark.createDataFrame([(1, "one two"), (3, "three")], "document_id long, text string")
    plain = facade.call("startReindex", tables, texts=texts)
    new = facade.call("startReindex", tables, texts=texts, folder=folder)
    columns = ["document_id", "chunk", "text"]
    assert sorted(map(tuple, new["index"].select(*columns).collect())) == sorted(map(tuple, plain["index"].select(*columns).collect()))
    rebuild.acquired(spark, folder, "other")
    with pytest.raises(rebuild.Busy):
        facade.call("startReindex", tables, texts=texts, folder=folder, run="mine")


def test_chat_stores_turns(spark, tables):
    turns = spark.createDataFrame([], chat.TURN)
    questions = spark.createDataFrame([(5, "c", "u", "2024-01-01", "why?", [1.0, 0.0])], "request_id long, conversation_id string, user_id string, day string, query string, embedding array<double>")
    out = facade.call("chat", tables | {"turns": turns}, questions=questions, answer=F.lit("because"))
    row = out["turns"].first()
    assert (row.conversation_id, row.turn, row.answer, row.status) == ("c", 1, "because", "COMPLETED")
    assert row.context.startswith("[Source: a.txt]\none")
