import random

from tessella.llm import overlap as O

SCHEMA = "id string, question string, split string, source string, key long"
NAMES = ["Zorvath Melkin", "Tilda Brennagh", "Oskar Vintreval", "Pavla Kestrin", "Rurik Dalmoor", "Hesper Quillan"]
PLACES = ["Dunmarrow", "Velsporth", "Quistenholm", "Ardabrook"]


def _rows(n=160):
    rng, rows = random.Random(5), []
    forms = [
        "In which town near {p} was the physician {a} born in {y}?",
        "Which award did {a} receive in {y} for the novel The Silver Door of {p}?",
        "At which theatre in {p} did {a} perform before {y}?",
    ]
    for i in range(n):
        q = rng.choice(forms).format(a=rng.choice(NAMES), p=rng.choice(PLACES), y=rng.randint(1900, 1906))
        rows.append((f"t{i:03}", q, "train", "one", 1))
        if i % 4 == 0:
            q = rng.choice([q, q.upper(), q.replace("born", "bron"), "hi, " + q, q.replace("physician", "sculptor"), q.replace("before", "after"), "<p>" + q + "</p>"])
            rows.append((f"v{i:03}", q, rng.choice(["dev", " TEST"]), "two", 1))
    return rows


def test_found_is_what_comparing_all_pairs_finds(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id_a, r.id_b) for r in O.found(df).collect()}
    classes = O.question_classes(O.question_words(df)).collect()
    known = O.known_words(O.question_classes(O.question_words(df)))
    words = {r.id: r.words for r in O.question_words(df).collect()}
    split = {r[0]: r[2].strip().lower() for r in rows}
    train = [k for k in words if split[k] == "train"]
    want = set()
    for e in (k for k in words if split[k] != "train"):
        for t in train:
            if sorted(words[e]) == sorted(words[t]) or O.same_question(words[e], words[t], known):
                want.add(tuple(sorted((e, t))))
    assert got == want and len(classes) > 50


def test_same_and_other_questions():
    known = frozenset("award receive novel town born buried first last school older led".split())

    def same(a, b):
        content = lambda q: [O.SYNONYMS.get(w, w) for w in O.words_of(q) if w not in O.STOP]
        return O.same_question(content(a), content(b), known)

    base = "Which award did Tilda Brennagh receive in 1913 for the novel The Silver Door?"
    assert same(base, "For the novel The Silver Door, what award did Tilda Brennagh get in 1913?")
    assert same(base, "12) which AWARD did Tilda Brennahg recieve in 1913 for the novel The Silver Door ? (short answer)")
    assert same(base, "Whiсh awаrd did Tilda Brénnagh receive in 1913 for the nov​el The Silver Door")
    assert not same(base, base.replace("1913", "1914"))
    assert not same(base, base.replace("Tilda", "Pavla"))
    assert not same("Who was born first, A. Melkin or B. Kestrin?", "Who was born last, A. Melkin or B. Kestrin?")
    assert not same("Which northern school did Rurik Dalmoor lead?", "Which southern school did Rurik Dalmoor lead?")


def test_nulls_placeholders_copies_and_no_rows(spark):
    q = "At which theatre in Dunmarrow did Pavla Kestrin perform before 1911?"
    rows = [("a", q, "train", None, 1), ("a", q, "", None, 1), ("b", q, "dev", None, 2), ("c", "?", "test", None, 1), ("d", None, "train", None, None)]
    rows += [(None, q, "train", "s", 1), ("e", "n/a", "train", "s", 1), ("f", "", "dev", "s", 1), ("a", q, "Train ", "s", 1)] + [(f"z{i}", q, "train", "s", 1) for i in range(40)]
    got = {(r.id_a, r.id_b) for r in O.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "b")} | {("b", f"z{i}") for i in range(40)}
    report = O.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.split, r.n_pairs, r.n_held) for r in report] == [("dev", 41, 1)]
    assert O.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_instruction_of_one_source_is_found(spark):
    lead = "Using only the given passages reply with one short phrase please "
    rows = [(f"i{k}", lead + f"Which river crosses town number{k} near place{k}?", "train", "x", 1) for k in range(60)]
    rows += [(f"j{k}", f"Which river crosses town number{k} near place{k}?", "dev", "y", 1) for k in range(60)]
    words = {tuple(r.words) for r in O.question_words(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(words) == 60


def test_short_questions_and_their_copies(spark):
    rows = [("a", "Who was Lincoln?", "train"), ("b", "who was lincoln", "dev"), ("c", "What is it?", "train"), ("d", "What is it ?", "test"), ("e", "N/A", "train"), ("f", "n/a", "dev")]
    rows += [("g", "Who composed Velmora?", "train"), ("h", "Who composed Velmora??", "test"), ("i", "Who composed Tarnquist?", "dev")]
    got = {(r.id_a, r.id_b) for r in O.found(spark.createDataFrame([(i, q, s, "x", 1) for i, q, s in rows], SCHEMA)).collect()}
    assert got == {("a", "b"), ("c", "d"), ("g", "h")}


def test_containment_is_that_of_all_pairs_whatever_the_blocks(spark):
    import math

    classes = O.question_classes(O.question_words(spark.createDataFrame(_rows(), SCHEMA)))
    rows = classes.withColumn("grams", O.grams_of(classes["words"])).collect()
    counts, trained = {}, {g for r in rows if r.train for g in r.grams}
    for r in rows:
        for g in r.grams:
            counts[g] = counts.get(g, 0) + 1
    weight = {g: (math.log((len(rows) + 1) / n) + 0.01) ** 4 for g, n in counts.items()}
    digits = {r.key: sorted(w for w in r.words if w.isdigit()) for r in rows}
    want = {}
    for e in (r for r in rows if r.held):
        own = [g for g in e.grams if g in trained]
        for t in (r for r in rows if r.train and r.key != e.key and digits[r.key] == digits[e.key]):
            share = sum(weight[g] for g in own if g in t.grams) / sum(weight[g] for g in own) if own else 0
            if share >= O.CONTAINMENT:
                want[e.key, t.key] = round(share, 9)
    for hot in (3, O.HOT):
        got = O.candidate_pairs(classes, hot=hot).collect()
        assert len(got) == len(want) and {(r.e, r.t): round(r.weight, 9) for r in got} == want
