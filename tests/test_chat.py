from pyspark.sql import functions as F

from quarry.operators import chat


def test_entry_from_questions_to_stored_turns(spark):
    turns = spark.createDataFrame([("c", i, -i, "u", f"q{i}", "", 0, "primary", f"a{i}", "PENDING" if i == 6 else "COMPLETED") for i in range(1, 8)], chat.TURN)
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "one", "s1"), (2, [0.9, 0.1], "two", None), (3, [0.0, 1.0], "three", "s3"), (4, None, "four", "s4")], "vec_id long, embedding array<double>, text string, source string")
    day = "2024-01-01"
    questions = spark.createDataFrame(
        [(1, "c", "u", day, "first?", [1.0, 0.0]), (2, "c", "u", day, "second?", [0.0, 2.0]), (3, None, None, day, "nobody?", None), (4, "c", "u", day, "", [1.0, 0.0]), (5, "c", "u", day, "x" * 10_001, None), (6, "d", "u", day, "third?", [1.0, 0.0, 0.0]), (7, "e", None, day, "anon?", [1.0, 0.0]), (8, "e", None, "2024-01-02", "anon?", None)],
        "request_id long, conversation_id string, user_id string, day string, query string, embedding array<double>",
    )
    used = spark.createDataFrame([("z", "u", day, -100)], "conversation_id string, user_id string, day string, request_id long")
    answer = F.concat(F.lit("saw "), F.size("history").cast("string"), F.lit(" turns and "), F.col("n_chunks").cast("string"))
    out = {r.request_id: r for r in chat.answered(questions, turns, chunks, used, F.when(F.col("request_id") != 7, answer), user_limit=2, global_limit=4).collect()}
    assert {k: r.error for k, r in out.items() if r.error} == {4: "No query provided", 5: "Query exceeds maximum length of 10000 characters"}
    assert {k: r.model for k, r in out.items() if not r.error} == {1: "primary", 2: "fallback", 3: "primary", 6: "fallback", 7: "primary", 8: "primary"}
    assert {k: (r.conversation_id, r.turn) for k, r in out.items() if not r.error} == {1: ("c", 8), 2: ("c", 9), 3: ("request-3", 1), 6: ("d", 1), 7: ("e", 1), 8: ("e", 2)}
    assert [h.turn for h in out[1].history] == [2, 3, 4, 5, 7] and out[3].history == []
    assert out[1].context == "[Source: s1]\none\n\n---\n\n[Source: unknown]\ntwo\n\n---\n\n[Source: s3]\nthree" and out[1].sources == ["s1", "unknown", "s3"]
    assert out[2].context.startswith("[Source: s3]") and out[3].context == "" and out[6].n_chunks == 0
    assert out[1].answer == "saw 5 turns and 3" and out[7].status == "PENDING"
    kept = chat.stored(turns, chat.answered(questions, turns, chunks, used, answer)).cache()
    assert kept.count() == 7 + 6 and chat.stored(kept, chat.answered(questions, kept, chunks, used, answer)).count() == 13
    open_ = chat.stored(turns, chat.answered(questions, turns, chunks))
    done = chat.completed(open_, spark.createDataFrame([(1, "yes", None), (2, None, "broken"), (-1, "late", None)], "request_id long, answer string, error string"))
    assert {r.request_id: (r.answer, r.status) for r in done.where("request_id in (1, 2, 3, -1)").collect()} == {1: ("yes", "COMPLETED"), 2: ("broken", "ERROR"), 3: (None, "PENDING"), -1: ("a1", "COMPLETED")}
    assert chat.answered(questions.limit(0), turns, chunks).count() == 0
