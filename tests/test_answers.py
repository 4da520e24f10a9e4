from pyspark.sql import functions as F

from tessella.operators import answers as A
from tessella.operators import vector_search as S


def test_citations_are_bound_to_blocks(spark):
    rows = [
        (1, "Answer: Ankara\nIt is the capital [2][7], see also [1, 9].", 2), (2, "**Answer:** Ankara.", 2), (3, "Answer: Ankara\nSee【2】.", 2),
        (4, "Not enough context.", 2), (5, "Answer: x\ny [1]", 0), (6, None, 2),
    ]
    got = {r.id: r for r in A.bound(spark.createDataFrame(rows, "id int, raw string, n_blocks int")).collect()}
    assert got[1].short == "Ankara" and got[1].citations == [2, 1] and got[1].invalid == 2 and "[7]" not in got[1].text and "[1]" in got[1].text
    assert got[2].short == "Ankara" and got[2].text == "Ankara" and got[3].citations == [2]
    assert all(got[i].text == A.NOT_ENOUGH and got[i].citations == [] for i in (4, 5, 6))


def test_coverage(spark):
    rows = [("Ankara. One [1]. Two [2].", [1, 2], 1.0), ("Ankara. One [1]. Two.", [1], 0.5), ("Ankara. One. [1] Two. [1]", [1], 1.0), ("Ankara", [], 0.0)]
    got = spark.createDataFrame([r[:2] for r in rows], "t string, c array<long>").select(A.coverage(F.col("t"), F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [r[2] for r in rows]


def test_judge_replies(spark):
    ok = '{"faithfulness": 5, "relevance": 1, "completeness": 3, "rationale": "x"}'
    rows = [(ok,), ("```json\n" + ok + "\n```",), (ok.replace("5", "true"),), (ok.replace("5", "4.0"),), (ok.replace("5", "6"),), ('{"faithfulness": 5}',), ("no",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "r string").select(A.judge_scores("r").alias("s")).collect()]
    assert [tuple(s) if s else None for s in got] == [(1.0, 0.0, 0.5)] * 2 + [None] * 6


def test_rerank_and_context(spark):
    df = spark.createDataFrame([("order: [3, 1, 9, 3]",), ("none",), ("[7]",)], "r string")
    assert [r.o for r in df.select(A.rerank_order(F.col("r"), F.lit(4)).alias("o")).collect()] == [[3, 1], None, None]
    hits = spark.createDataFrame([(1, 2, "B", "b"), (1, 1, "A", "a")], "question_id int, rank int, title string, text string")
    assert A.context_blocks(hits).first().context == "[1] A\na\n\n[2] B\nb"


def test_search_plans_have_no_cross_join(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    plan = S.exact_topk(vectors, vectors.filter("vec_id % 100 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
