from tessella.llm import sampling as S

SCHEMA = "id string, split string, load_no int, bucket int"


def _sample(spark, rows, **options):
    return {r.id: r for r in S.growing_sample(spark.createDataFrame(rows, SCHEMA), rate=0.05, least=20, **options).collect()}


def test_earlier_choices_stay_and_partitioning_does_not_matter(spark):
    rows = [(f"q{i}", ("train", " DEV", "test", "")[i % 4], 1 + i * 6 // 3000, 0) for i in range(3000)]
    rows += [(f"q{i}", "Train ", 6, 1) for i in range(3, 3000, 40)]
    before = set()
    for load in range(1, 7):
        now = set(_sample(spark, [r for r in rows if r[2] <= load]))
        assert before <= now
        before = now
    again = S.growing_sample(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), rate=0.05, least=20)
    assert {r.id for r in again.collect()} == before
    assert all(r.split in ("train", "dev", "test", "") for r in again.collect())


def test_a_small_split_gets_its_least(spark):
    rows = [(f"a{i}", "train", 1, 0) for i in range(4000)] + [(f"b{i}", "test", 1, 0) for i in range(200)]
    got = _sample(spark, rows)
    assert sum(r.split == "test" for r in got.values()) >= 20


def test_nulls_repeats_and_no_rows(spark):
    got = _sample(spark, [(None, None, None, None), ("x", None, None, 3), ("x", "dev", 2, 3), ("x", "dev", 2, 3)])
    assert set(got) <= {"x"}
    assert S.growing_sample(spark.createDataFrame([], SCHEMA)).count() == 0
