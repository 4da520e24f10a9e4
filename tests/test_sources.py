import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import extraction as X
from tessella.sources import records as R
from tessella.streaming import ledger

RECORDS = [
    {"_id": "a", "question": "q1", "answer": "x", "type": "bridge", "level": "hard", "supporting_facts": [["T", 1], ["U", 0], ["T", 0]], "context": [["T", [" One  two.", "", "Three."]], ["U", ["U one."]]]},
    {"_id": "b", "question": "q2", "answer": "y", "type": "comparison", "level": "hard", "supporting_facts": [["T", 0]], "context": [["T", ["Another."]]]},
]


@pytest.fixture
def records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RECORDS))
    return R.read_records(spark, str(tmp_path / "r.json"))


def test_documents_first_title_wins_and_spans_fit(records):
    docs = {r.title: r for r in R.documents_of(records, "src").collect()}
    assert docs["T"].text == "One two. Three."
    spans = [(s.start_offset, s.end_offset) for s in docs["T"].sentences]
    assert [docs["T"].text[a:b] for a, b in spans] == ["One two.", "", "Three."] and len(docs["T"].doc_ref) == 16
    gold = {r.id: r for r in R.gold_of(records).collect()}
    assert gold["hp_a"].supporting_titles == ["T", "U"] and gold["hp_a"].type == "multi_hop" and gold["hp_b"].type == "comparison"


def test_corpus_round_trip_and_count_check(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "é\n"), ("d2", None)], "id string, text string")
    path = str(tmp_path / "c")
    R.write_corpus({"document": docs, "vector": spark.createDataFrame([("d1", [0.5, -1.25])], "id string, v array<float>").withColumn("v", R.encoded_vector("v"))}, path)
    back = R.read_corpus(spark, path, {"document": "id string, text string", "vector": "id string, v string"})
    assert sorted(map(tuple, back["document"].collect())) == [("d1", "é\n"), ("d2", None)]
    assert back["vector"].select(R.decoded_vector("v").alias("v")).first().v == [0.5, -1.25]
    spark.createDataFrame([("document", "{}")], "kind string, row string").write.mode("append").json(path)
    with pytest.raises(ValueError):
        R.read_corpus(spark, path, {})


def test_content_hash_does_not_depend_on_order(spark):
    rows = [(i, f"t{i % 7}") for i in range(100)]
    a = R.content_hash(spark.createDataFrame(rows, "a int, b string")).first()
    b = R.content_hash(spark.createDataFrame(rows[::-1], "a int, b string").repartition(5).select("b", "a")).first()
    c = R.content_hash(spark.createDataFrame(rows[1:] + rows[1:2], "a int, b string")).first()
    assert a == b and a["print"] != c["print"]


def test_keyed_appends(spark):
    stored = spark.createDataFrame([(1, "x")], "id int, t string")
    new = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z"), (3, None)], "id int, t string")
    assert sorted(r.id for r in R.absent(new, stored, ["id"]).collect()) == [2, 3]
    vectors = spark.createDataFrame([(2, "new")], "id int, t string")
    assert {r.id: r.t for r in R.filled(new.distinct(), vectors, "id", "t").collect()} == {1: "y", 2: "new", 3: None}
    cells = R.table_cells(spark.createDataFrame([("| 1 | a | b |",), ("|-|-|-|",), ("| x | a | b |",), ("",)], "value string"), 3)
    assert [r.cells for r in cells.collect()] == [["1", "a", "b"]]


def test_extraction_reasons_in_their_order(spark):
    passage = "Marguerite Halvorsen sang in Tin Harbour, an opera of Osric Penhallow for Zoë."
    base = {"chunk": 1, "subject": "Osric Penhallow", "subject_type": "PERSON", "predicate": "wrote", "object": "Tin Harbour", "object_type": "WORK", "evidence": "x", "confidence": 0.8}
    cases = [
        ({}, None), ({"subject": "osric PENHALLOW"}, None), ({"object": "Zoe", "object_type": "PERSON"}, None), ({"subject": "Margerite Halvorsen"}, None), ({"subject": "Osrik Panhollaw"}, "subject_not_in_source"),
        ({"object": "Copper Harbour at Night"}, "object_not_in_source"), ({"subject": "\t"}, "empty"), ({"object": "--"}, "empty"), ({"predicate": " "}, "empty"), ({"object": "osric penhallow!"}, "self_loop"),
        ({"confidence": 0.3}, "low_confidence"), ({"subject_type": "RIVER"}, "bad_schema"), ({"confidence": None}, "bad_schema"),
    ]
    rows = [(i, passage, "```json\n" + json.dumps({"triples": [base | change]}) + "\n```") for i, (change, _) in enumerate(cases)] + [(99, passage, "not json"), (98, passage, '<thought>{"a"</thought>{"triples": []}')]
    checked = X.screened(X.parsed(spark.createDataFrame(rows, "id int, text string, reply string")))
    got = {r.id: r.reason for r in checked.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(cases)} | {99: "bad_json"}
    s = X.summary(checked).first()
    assert (s.kept, s.rejected, s.bad_replies) == (4, 9, 1)


def test_evidence_span(spark):
    df = spark.createDataFrame([("HARBOUR", "a harbour wall"), ("none", "abc"), ("", "abc")], "e string, t string").select(X.evidence_span("e", "t").alias("s"))
    assert [(r.s.start, r.s.end) for r in df.collect()] == [(2, 9), (0, 3), (0, 3)]


def test_stream_of_the_ledger_equals_the_batch(spark, tmp_path):
    rows = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.concat(F.lit("e"), F.col("id") % 3).alias("event_type"), (F.col("id") * 1.5).alias("value")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    streamed = ledger.hourly(spark, str(tmp_path / "in" / "events.parquet"))
    batch = ledger.windowed(rows)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
