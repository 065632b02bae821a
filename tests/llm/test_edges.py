"""Null, empty, long, tied and repeated rows, empty tables and clashing columns, for every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, decontam, line_dedup, media, pii, sentence_dedup, sentencepiece, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, keys string, score double, blobs string, z string, id long, toxic string, quality string, pos long, cols string, votes string"
LONG = "some words that go on and on in a very long text\n" * 3000
PASSAGE = "a passage of many words that is copied from one text to another and says the same thing in each of them, again and again"
TEXTS = [(1, None), (2, ""), (3, LONG), (4, PASSAGE), (5, PASSAGE), (5, PASSAGE), (6, "x"), (None, PASSAGE), (7, "\n\n \t\n"), (8, "a\n" + PASSAGE + "\nb"), (9, "日本語 😀 ▁ \u0000 é")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "r", 1, "k", 0.5, "b", "z", 3, "t", "q", 1, "c", "v") for i, t in rows], SCHEMA)


BENCH = "item_id long, text string, doc_id long"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE, 0), (2, None, 0), (None, PASSAGE, 0), (3, "", 0), (4, PASSAGE, 0)], BENCH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 1), (6, 1, 0), (8, None, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "line": lambda s, d, b, n: line_dedup.dedup_lines(d),
    "simhash": lambda s, d, b, n: simhash.near_duplicates(d),
    "toxicity": lambda s, d, b, n: toxicity.score(d, toxicity.fit(d, n)),
    "decontam": lambda s, d, b, n: decontam.contamination(d, b),
    "sentencepiece": lambda s, d, b, n: sentencepiece.encode(d),
    "sentence": lambda s, d, b, n: sentence_dedup.remove_repeats(d),
    "suffix": lambda s, d, b, n: suffix_dedup.remove_repeats(d),
    "media": lambda s, d, b, n: media.read_media(media.store_bytes(d)),
    "pii": lambda s, d, b, n: pii.find_personal_data(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_edge_rows(name, spark, bench, labels):
    out = RUNS[name](spark, docs(spark), bench, labels).toArrow()
    assert out.num_rows == len(TEXTS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(name, spark, bench, labels):
    assert RUNS[name](spark, docs(spark, []), bench, labels.limit(0)).toArrow().num_rows == 0


STAGES = {
    "toxicity": lambda d, b, n: toxicity.reject_toxic(d, n),
    "line": lambda d, b, n: line_dedup.dedup_documents(d),
    "simhash": lambda d, b, n: simhash.keep_representatives(d),
    "decontam": lambda d, b, n: decontam.remove_contaminated(d, b),
}


def test_token_stage_of_clashing_names_and_no_rows(spark):
    import corpus_pipeline

    odd = docs(spark).withColumns({"ids": F.lit("i"), "n_tokens": F.lit("n"), "round_trip": F.lit(None).cast("string")})
    out = corpus_pipeline.token_stage(spark, odd, "").collect()
    assert len(out) == len(TEXTS) and all(r.round_trip for r in out if r.ids is not None)
    assert corpus_pipeline.token_stage(spark, odd.limit(0), "").count() == 0



@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(name, spark, bench, labels):
    out = STAGES[name](docs(spark), bench, labels)
    assert out.columns == docs(spark).columns
    assert out.count() > 0
    assert STAGES[name](docs(spark, []), bench, labels).count() == 0


def test_trained_toxicity_of_odd_rows(spark):
    """Both classes, so that the classifier is trained: null texts, ids and labels, repeated labels of both kinds, repeated rows, extra columns."""
    good, bad = "what a fine day it is to read a book in the garden", "you are a stupid worthless idiot and everybody knows it"
    rows = [(i, (bad if i % 3 == 0 else good) + f" number {i}") for i in range(60)] + [(6, bad), (61, None), (62, ""), (None, bad), (63, LONG)]
    d = docs(spark, rows)
    marks = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(9, 1, 0), (9, 1, 1), (61, 0, 0), (62, None, 0), (None, 1, 1), (40, 1, None), (900, 1, 1)]
    model = toxicity.fit(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("label's own")).withColumn("score", F.lit(1)))
    assert len(model.accuracies) > 0 and model.agreement > 0.9
    out = toxicity.score(d, model).select("row.doc_id", "row.text", "row.score", F.col("score").alias("p")).collect()
    assert len(out) == len(rows) and all(0 <= r.p <= 1 and r.score == 0.5 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.text, set()).add(r.p)
    assert all(len(v) == 1 for v in by.values()) and len(by[None] | by[""]) == 1
    assert all((r.p >= 0.5) == ("stupid" in r.text) for r in out if r.text and r.text != LONG)
    kept = toxicity.reject_toxic(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert kept.columns == d.columns and kept.count() == len(rows) - 22


def test_chat_of_very_long_texts(spark):
    long = 'a "quoted" \\ line\n' * 20000
    m = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "system", long)], "conv_id long, turn long, role string, text string")
    got = {(r.turn, r.kind): r for r in chat.format_chats(*chat.turns_as_calls(m), chat.REPLY_SCHEMA).collect()}
    import json

    assert got[0, "call"].errors == "maxLength:text" and got[0, "call"].status == "linked"
    assert json.loads(got[0, "call"].json)["arguments"]["text"] == json.loads(got[1, "result"].json)["content"] == json.loads(got[2, "message"].json)["content"] == long


def test_defined_results(spark, bench, labels):
    d = docs(spark)
    hit = {(r.row.doc_id, r.row.text): r for r in decontam.contamination(d, bench).collect()}
    assert hit[1, None].n_words == 0 and not hit[1, None].contaminated
    assert hit[5, PASSAGE].items == ["1", "4"] and hit[5, PASSAGE].n_hit == hit[5, PASSAGE].n_words and hit[None, PASSAGE].contaminated
    lines = {(r.row.doc_id): r for r in line_dedup.dedup_lines(d).collect()}
    assert (lines[4].n_dropped, lines[5].n_dropped, lines[8].n_dropped, lines[None].n_dropped, lines[3].n_dropped, lines[1].n_lines) == (0, 1, 1, 0, 0, 1)
    sims = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    assert sims[5].component_id == 4 and sims[None].component_id == 4 and sims[2].component_id == 1 and sims[1].fp == 0
    cut = {r.row.doc_id: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert cut[4].n_removed == 0 and cut[5].n_removed == len(PASSAGE) and cut[None].n_removed == 0 and cut[8].n_removed == len(PASSAGE) and cut[3].n_removed == 0
    assert cut[1].n_bytes == 0
    spans = {r.row.doc_id: r for r in sentence_dedup.remove_repeats(d).collect()}
    assert spans[3].n_removed == spans[3].n_sentences - 2 or spans[3].n_removed > 0
    ids = {r.row.doc_id: r for r in sentencepiece.encode(d).collect()}
    assert ids[1].ids is None and all(r.round_trip for k, r in ids.items() if k != 1)
    wav = {r.row.row.doc_id: r for r in media.read_media(media.store_bytes(d)).collect()}
    assert wav[1].payload_bytes == wav[2].payload_bytes == 192 and wav[1].feature == wav[2].feature


def test_rows_of_one_id_with_different_texts(spark):
    d = docs(spark, [(1, PASSAGE), (2, PASSAGE + " first"), (2, "second " + PASSAGE), (2, "third, without it at all but with as many words as others have")])
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(d).collect())
    assert got == sorted([(len(PASSAGE), 0), (len(PASSAGE) + 6, len(PASSAGE)), (len(PASSAGE) + 7, len(PASSAGE)), (62, 0)])


def test_chat_edges(spark):
    m = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"), (None, 0, "user", None, "x"), (2, None, None, None, "x"), (3, 5, "assistant", "lost", "x"), (1, 2, "user", "", "x")], "conv_id long, turn long, role string, text string, rank string")
    got = {(r.conv_id, r.turn, r.kind): r for r in chat.format_chats(*chat.turns_as_calls(m), chat.REPLY_SCHEMA).collect()}
    assert got[1, 0, "call"].status == "linked" and got[1, 1, "result"].copies == 2 and got[3, 5, "result"].status == "orphan"
    assert got[None, 0, "call"].status == "no_identifier" and got[1, 2, "call"].errors == "minLength:text" and got[2, None, "message"].status == "plain"
    assert got[1, 0, "call"].json == '{"arguments":{"conversation":1,"text":"q","turn":0},"id":"1:0","name":"reply","type":"call"}'
    assert chat.format_chats(*chat.turns_as_calls(m.limit(0)), chat.REPLY_SCHEMA).count() == 0


def test_chat_order_and_cycles(spark):
    t = '{"tool_calls": [%s]}'
    call = '{"id": "%s", "name": "f", "arguments": {"b": 1.50, "a": [1, {"z": 1, "y": 2}]}, "depends_on": %s}'
    rows = [(1, 0, "assistant", t % ", ".join([call % ("late", '["early"]'), call % ("early", "[]")]), ""), (1, 1, "tool", '{"tool_call_id": "early", "content": "ok"}', ""), (2, 0, "assistant", t % ", ".join([call % ("p", '["q"]'), call % ("q", '["p"]')]), ""), (1, 2, "user", "hi", "")]
    parts = chat.messages_as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string"))
    schema = {"f": {"properties": {"a": {"type": "array"}, "b": {"type": "number", "maximum": 1}, "c": {"type": "string"}}, "required": ["a", "c"], "additionalProperties": False}}
    got = {(r.conv_id, r.call_id, r.kind): r for r in chat.format_chats(*parts, schema).collect()}
    assert (got[1, "early", "call"].rank, got[1, "late", "call"].rank, got[1, "early", "result"].rank) == (0, 1, 0)
    assert got[2, "p", "call"].status == "cycle" and got[1, "late", "call"].status == "unanswered"
    assert got[1, "early", "call"].errors == "maximum:b,missing:c" and '{"a":[1,{"y":2,"z":1}],"b":1.5}' in got[1, "early", "call"].json
    assert (1, None, "message") in got
