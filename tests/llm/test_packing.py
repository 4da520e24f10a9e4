import numpy as np

from tessella.llm import packing as P


def test_no_container_overflows_and_little_is_unused():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(4, 1, 8000).astype(int), 512)
    where = P.pack(sizes, 512)
    filled = np.bincount(where, sizes)
    assert filled.max() <= 512
    assert len(filled) <= 1.01 * np.ceil(sizes.sum() / 512) + 2


def test_brute_choice_of_the_smallest_sum():
    rng = np.random.default_rng(4)
    sizes, capacity = rng.integers(1, 10, 60), 9
    where = P.pack(sizes, capacity)
    level: dict[int, int] = {}
    for size, c in zip(sizes, where):
        def total(state):
            gaps = [capacity - v for v in state.values() if v < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [total({**level, k: v + size}) for k, v in level.items() if v + size <= capacity] + [total({**level, "new": size})]
        level[int(c)] = level.get(int(c), 0) + int(size)
        assert total(level) == min(options)


def test_every_document_once_unless_it_exceeds(spark):
    rows = [(i, i % 130) for i in range(3000)] + [(9000, 1000), (9001, None), (9002, 0), (9002, 0), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = P.pack_documents(df, capacity=128, shard_containers=64).collect()
    per: dict = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_tokens for r in per[9000]) == 1000 and len(per[9000]) == 8
    assert len(per[9001]) == 1 and len(per[9002]) == 2 and len(per[None]) == 1
    assert all(len(per[i]) == (1 if i % 130 <= 128 else 2) for i in range(3000))
    fill = P.containers(P.pack_documents(df, capacity=128)).collect()
    assert max(r.n_tokens for r in fill) <= 128
    assert P.pack_documents(df.limit(0)).count() == 0


def test_rows_without_an_id_and_copies_are_spread_over_shards(spark):
    rows = [(None, 7)] * 300 + [(1, 5)] * 200 + [(2, None)]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens int"), capacity=20, shard_containers=10)
    assert got.count() == 501 and got.filter("doc_id is null").count() == 300
    shards = [r["count"] for r in got.filter("doc_id is null").selectExpr("shiftright(container, 32) as s").groupBy("s").count().collect()]
    assert len(shards) > 5
    assert P.containers(got).filter("n_tokens > 20").count() == 0
