from pyspark.sql import functions as F

from tessella.operators import retrieval as R
from tessella.operators import stores as S
from tessella.operators import telemetry as T


def test_hits_block_and_facts(spark):
    found = spark.createDataFrame([(1, "d:sentence:0", 1), (1, "gone", 2), (1, "d:sentence:3", 3)], "qid long, chunk_id string, rank int")
    chunks = spark.createDataFrame([("d:sentence:0", 1), ("d:sentence:3", 2), ("d:sentence:3", 2)], "chunk_id string, rank int")
    hits = R.present_hits(found, chunks)
    assert {(r.chunk_id, r.rank) for r in hits.collect()} == {("d:sentence:0", 1), ("d:sentence:3", 2)}
    paths = spark.createDataFrame([(1, ["r", "s"]), (1, ["r"])], "qid long, rels array<string>")
    rels = spark.createDataFrame([("r", "a", "works_at", "b", "d:sentence:0"), ("s", "b", "in", "c", "x")], "rel_id string, subject_id string, predicate string, object_id string, chunk_id string")
    edges = R.block_edges(paths, rels)
    seeds = spark.createDataFrame([(1, "a"), (1, "alone")], "qid long, node string")
    assert {(r.node, r.seed) for r in R.block_nodes(edges, seeds).collect()} == {("a", True), ("b", False), ("c", False), ("alone", True)}
    named = edges.join(hits, ["qid", "chunk_id"]).withColumn("subject", F.lit(" Ann ")).withColumn("object", F.lit("Velm"))
    assert [(r.block, r.fact) for r in R.facts(named).collect()] == [(1, "[1] Ann works at Velm")]


def test_routes_with_one_fallback(spark):
    rows = [(0, 0.9, None), (3, 0.1, True), (1, 0.9, True), (2, 0.9, None), (6, None, None)]
    got = R.routed(spark.createDataFrame(rows, "qid long, top double, path boolean"), F.col("qid") % 3 == 0, 0.5).collect()
    assert {r.qid: r.final_route for r in got} == {0: "vector", 3: "hybrid", 1: "graph", 2: "hybrid", 6: "hybrid"}


def test_numbers_run_on_over_ranges_and_none_is_left_for_the_last(spark):
    rows = spark.createDataFrame([(f"{i:04d}", "a" if i % 3 else "b") for i in range(500)], "id string, type string")
    got = S.numbered(rows, "type", "id").orderBy("type", "id").collect()
    for kind in "ab":
        assert [r.number for r in got if r.type == kind] == list(range(1, 1 + sum(r.type == kind for r in got)))
    few = rows.filter("type = 'b'").limit(2).selectExpr("concat('n', id) as id", "type")
    assert S.replaced(rows.filter("id < '0010' and type = 'b'"), few).filter("replacement is not null").count() == 2
    assert S.numbered(rows.limit(0), "type", "id").count() == 0


def test_keys_merges_and_words_in_common(spark):
    df = spark.createDataFrame([('{"a": 1, "n": 2}', "Is the Ölberg of Ann near?", "Ann Lee"), ("no json", None, None)], "j string, q string, t string")
    rows = df.select(S.merged(F.col("j"), {"n": "0"}).alias("m"), S.names_subject(F.col("q"), F.col("t")).alias("named"), S.request_key({"b": F.lit("é"), "a": F.lit(1)}).alias("k")).collect()
    assert rows[0].m == {"a": "1", "n": "0"} and [r.named for r in rows] == [True, False]
    assert rows[0].k == __import__("hashlib").sha256('{"a":1,"b":"é"}'.encode()).hexdigest()


def test_verdicts_and_sets(spark):
    diffs = spark.createDataFrame([("up", 0.5), ("up", 0.6), ("up", 0.55), ("one", 0.1), ("flat", -1.0), ("flat", 1.0)], "run_id string, diff double")
    assert {r.run_id: r.verdict for r in S.verdicts(diffs).collect()} == {"up": "better", "one": "too few", "flat": "no clear difference"}
    rows = [("r", t, 0.1 if i == 0 else None) for t in "xyz" for i in range(4)] + [("s", None, 0.0)]
    got = {r.run_id: r.problems for r in S.set_problems(spark.createDataFrame(rows, "run_id string, gold_type string, f1 float")).collect()}
    assert got == {"r": "", "s": "size, types, too few wrong"}


def test_rate_counts_across_spans_and_rows_without_time(spark):
    rows = [("u", 0), ("u", 59), ("u", 60), ("u", 61), ("u", 200), ("v", None), ("v", None)]
    events = spark.createDataFrame(rows, "user string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    got = T.rate(events, "user", "ts", 60).orderBy("user", "sec").collect()
    assert [r.recent for r in got] == [1, 2, 2, 3, 1, 2, 2]


def test_differences_and_mismatches(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "id string")
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "id string")
    assert {(r.side, r.id) for r in S.differences(a, b).collect()} == {("lost", "x"), ("new", "z")}
    v = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0])], "vec_id long, v array<double>, w array<double>")
    assert [r.vec_id for r in S.mismatches(v, 0.99).collect()] == [2]
