import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking as C


#: Similarities as the database's own function gives them.
SIMILARITIES = [("word", "two words", 0.800000011920929), ("ab", "b a b a", 0.3333333432674408), ("Ⅻ", "Ⅻ x", 1.0)]


@pytest.mark.parametrize("needle, haystack, want", SIMILARITIES + [("Ödra Vik", "is Ödra Vik old?", 1.0), ("x1 ¾", "x1 ¾", 1.0), ("Ilvane Korr", "", 0.0), ("", "", 0.0)])
def test_word_similarity(needle, haystack, want):
    assert T.word_similarity_of(needle, haystack) == want


def test_word_similarity_is_the_best_of_all_runs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(n)) for n in (6, 16))
        wanted, line = set(T.trigram_list(a)), T.trigram_list(b)
        runs = [set(line[i:j]) for i in range(len(line)) for j in range(i + 1, len(line) + 1)]
        best = max((len(r & wanted) / len(r | wanted) for r in runs), default=0.0)
        assert abs(T.word_similarity_of(a, b) - best) < 1e-6


def test_trigrams_of_texts(spark):
    assert T.trigram_list("Vo, k!") == ("  v", " vo", "vo ", "  k", " k ")
    texts = ["Vo, k! vo", "Élan n°5 m³", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.trigram_set(F.col("t")).alias("g")).collect()
    assert all(r.g is None if r.t is None else set(r.g) == set(T.trigram_list(r.t)) for r in rows)


NAMES = [
    ("Quillmar Ltd.", "quillmar"), ("The Quillmar Foundry Co., Inc.", "quillmar foundry"), ("the", "the"), ("Zoë Ångmar", "zoe angmar"), ("Ada Velm's", "ada velm"),
    ("D’Orsk", "dorsk"), ("Pike & Sorrel", "pike and sorrel"), ("Limited", "limited"), ("Inc Corp", "inc"), ("Ivo Tarn Sr.", "ivo tarn sr"), ("", ""),
    ("Q. X. Z. Marl", "qxz marl"), ("Q.X.Z. Marl", "qxz marl"), ("QXZ Marl", "qxz marl"), ("A b C", "abc"), (None, ""),
]


def test_normalized_name(spark):
    df = spark.createDataFrame(NAMES, "name string, want string").withColumn("got", T.normalized_name(F.col("name")))
    assert [(r.name, r.got) for r in df.collect()] == NAMES


@pytest.mark.parametrize(
    "text, n",
    [
        ("Dr. Velm met Mrs. Tarn on Mt. Orsk. It rained.", 2), ("The U.N. Council heard Q. X. Marl, i.e. the poet. Nobody spoke.", 2), ("It rose by 4.75 points in 2003. Then 1.5 more.", 2),
        ("She wrote \"Stay here.\" Then she slept. (“Where?” he said.)", 3), ("Orsk Foundry Inc. The mill grew.", 2), ("ores, tin etc. and lead", 1), ("one!", 1), (" \n ", 0), ("", 0), (None, 0),
    ],
)
def test_sentences(text, n):
    spans = T.sentence_spans_of(text)
    assert len(spans) == n
    assert "".join(text[a:b] for a, b in spans).split() == (text or "").split() or "".join("".join(text[a:b].split()) for a, b in spans) == "".join((text or "").split())


def test_match_form_and_occurs(spark):
    assert T.match_form_of("Zoë, Ltd.") == "zoe ltd" and T.match_form_of("tin_ore") == "tin ore" and T.match_form_of("?!") == ""
    text = "Marguerite Halvorsen sang with Zoë in a play of Osric Penhallow."
    cases = {"OSRIC PENHALLOW": True, "Zoe": True, "Margerite Halvorsen": True, "Marguerite Halversen": True, "Osrik Panhollaw": False, "Ivo Tarn": False, "": False, "!": False, None: False}
    df = spark.createDataFrame([(n, text) for n in cases], "n string, t string").select("n", T.occurs(F.col("n"), F.col("t"), 0.9).alias("in"))
    assert {r.n: r["in"] for r in df.collect()} == cases


def test_columns(spark):
    df = spark.createDataFrame([("A  b c",), ("see [2][7], also [1, 9]【3】",), ("Answer: Ankara\n\nIt is [1].",), (None,)], "t string")
    rows = df.select(
        T.squeeze(F.col("t")).alias("s"), T.marker_numbers(F.col("t")).alias("m"), T.split_answer(F.col("t")).alias("a"), T.snake_case(F.lit(" Took Part-in!")).alias("k")
    ).collect()
    assert rows[0].s == "A b c" and rows[1].m == [2, 7, 1, 9, 3] and rows[2].a.short == "Ankara" and rows[2].a.explanation == "It is [1]."
    assert rows[3].s is None and rows[0].k == "took_part_in"
    grams = spark.createDataFrame([("cat", "cat")], "a string, b string").select(T.trigrams(F.col("a")).alias("g"), T.jaccard(T.trigrams(F.col("a")), T.trigrams(F.col("b"))).alias("j")).first()
    assert set(grams.g) == {"  c", " ca", "cat", "at "} and grams.j == 1.0


def test_windows_and_packing(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text(11)), (2, text(7)), (3, ""), (4, None)], "id long, t string")
    sizes = {}
    for r in C.fixed_windows(df, "id", "t", 4, 1).orderBy("id", "ord").collect():
        sizes.setdefault(r.id, []).append(len(r.words))
    assert sizes == {1: [4, 4, 4, 2], 2: [4, 4]}
    assert C.fixed_windows(spark.createDataFrame([(1, text(64))], "id long, t string"), "id", "t").count() == 1
    with pytest.raises(ValueError):
        C.fixed_windows(df, "id", "t", 4, 4)
    lines = " ".join("One two three four five." for _ in range(40))
    assert [c[2] for c in C.packed_spans(lines, 12)] == [10] * 20
    assert [c[2] for c in C.packed_spans("A b c d e f g ham. I j.", 7)] == [8, 2]


def test_breaks_by_distance(spark):
    rows = [(1, i, d) for i, d in enumerate([0.1, 0.1, 0.9, 0.1, 0.1, None])] + [(2, 0, None)]
    got = C.meaning_breaks(spark.createDataFrame(rows, "k long, o int, d double"), "k", "o", "d").orderBy("k", "o").collect()
    assert [r.segment for r in got] == [0, 0, 0, 1, 1, 1, 0]
