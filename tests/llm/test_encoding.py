import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import encoding as E


def test_chunks_give_the_ids_of_the_whole(spark):
    rng = random.Random(2)
    parts = ["word", " the", "\n\n", "  ", "日本", "é", "'ll", "1234", "!!", "<|endoftext|>", "😀", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["a" * 5000, " " * 3000 + "b", "", None, "x"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in E.encode_documents(df, chunk_chars=200, overlap=40).collect()}
    counts = {r.doc_id: r.n_tokens for r in E.encode_documents(df, chunk_chars=200, overlap=40, counts_only=True).collect()}
    enc = E.encoder(E.TOKENIZER_PATH)
    for i, t, _ in rows:
        want = enc.encode_ordinary(t) if t else []
        assert got[i] == want and counts[i] == len(want)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "long " * 100), (2, "long " * 100)], "doc_id long, text string")
    got = E.encode_documents(df, chunk_chars=100, overlap=20).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    assert E.encode_documents(df.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    assert E.decode(E.encoder(E.TOKENIZER_PATH).encode_ordinary(text)) == text
