import itertools
import random

from tessella.llm import names as N

SCHEMA = "triple_id long, subject string, subject_type string, object string, object_type string, name string"


def _found(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], SCHEMA)
    return {(r.name_a, r.name_b) for r in N.found(df).collect()}


def test_spellings_of_persons_and_organisations(spark):
    one = ["Johannes K. Ulvpagimbo", "Johannes \"Hans\" Ulvpagimbo", "ULVPAGIMBO, Johannes", "J. Ulvpagimbo", "Hans Ulvpagimbo", " Johannes  Ulvpagímbo", "Johannes Ulvpaigmbo", "Dr. Johannes Ulvpagimbo, PhD"]
    two = ["Marta Ulvpagimbo", "Ulvpagimbo Marta", "Mar. Ulvpagimbo"]
    org = ["The Drustol University of Medicine", "University of Medicine (Drustol)", "Drustol Uni of Med.", "D.U.M.", "Drustol Univerisity of Medicine"]
    org2 = ["Drustol Railway Ltd.", "DRUSTOL RAILWAY", "Drustol-Railway"]
    rows = [(n, "PERSON", n2, "person") for n, n2 in zip(one, one[1:])] + [(n, "PERSON", org[0], "ORG") for n in two]
    rows += [(n, "ORG", "Drustol", "PLACE") for n in org + org2] + [("Drustol Institute", "ORG", "she", "PERSON")]
    want = {p for group in (one, two, org, org2) for p in itertools.combinations(sorted(group), 2)}
    assert _found(spark, rows) == want


def test_initials_of_two_persons_are_left_alone(spark):
    rows = [(n, "PERSON", "X of 1990", "EVENT") for n in ("Edward Kelvostin", "Emil Kelvostin", "E. Kelvostin", "Emil F. Kelvostin")]
    assert _found(spark, rows) == {("Emil F. Kelvostin", "Emil Kelvostin")}


def test_names_of_short_words_and_of_one_word(spark):
    rows = [(n, "PERSON", "X of 1990", "EVENT") for n in ("Bo Xu", "Xu, Bo", "bo xu ", "Li Bo")] + [(n, "ORG", "X of 1990", "EVENT") for n in ("Quillmar", "QUILLMAR ", "Ardabrook")]
    assert _found(spark, rows) == {*itertools.combinations(sorted(["Bo Xu", "Xu, Bo", "bo xu "]), 2), ("QUILLMAR ", "Quillmar")}


def test_nulls_blanks_other_kinds_and_no_rows(spark):
    rows = [(None, None, "", "PERSON"), ("unknown", "PERSON", "Unknown", "PERSON"), ("they", "ORG", "  ", None), ("Velm Fair", "EVENT", "VELM FAIR", "EVENT"), ("Solo Name", "PERSON", "Solo Name", "PERSON")]
    assert _found(spark, rows) == set()
    assert N.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segment_join_finds_all_words_within_two_edits(spark):
    rng = random.Random(9)

    def edited(w):
        for _ in range(2):
            i, k = rng.randrange(len(w)), rng.random()
            w = w[:i] + (rng.choice("xyz") if k < 0.6 else "") + w[i + (k > 0.3) :]
        return w

    base = ["".join(rng.choice("abcdeklmnorst") for _ in range(rng.randint(5, 12))) for _ in range(120)]
    words = sorted({*base, *(edited(w) for w in base)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    names = [f"Zed {w}" for w in words if len(w) >= 3]
    got = {(r.a, r.b) for r in N.candidate_names(spark.createDataFrame([(n, "PERSON") for n in names], "name string, kind string")).collect()}
    for a, b in itertools.combinations(names, 2):
        if distance(a[4:], b[4:]) <= 2:
            assert (a, b) in got or (b, a) in got
