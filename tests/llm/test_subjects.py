import random

import numpy as np

from tessella.llm import subjects as S

LETTERS = "abcdefghij"
TERMS = {area: [area + x + y for x in LETTERS[:4] for y in LETTERS[:6]] for area in ("law", "sport")}
SCHEMA = "doc_id long, text string, lang string, subject string"


def _corpus(n=240):
    rng, docs, labels = random.Random(3), [], []
    for i in range(n):
        about = [["law"], ["sport"], ["law", "sport"], []][i % 4]
        town = lambda: "".join(rng.choice(LETTERS) for _ in range(5))
        parts = [f"The {' and '.join(rng.sample(TERMS[area], 2))} were noted in {town()}." for _ in range(6) for area in about * (3 - len(about))]
        parts += [f"Nothing of note was found in {town()}."] * 2 + ["It was a lawaa of good news."]
        docs.append((i, " ".join(parts), rng.choice(["en", "EN", "en-XX"]), "clash"))
        labels += [(i, rng.choice([a.upper() + " ", a]), "x") for a in about if i % 3 == 0]
    return docs, labels


def test_areas_of_held_out_documents(spark):
    docs, labels = _corpus()
    docs += [(1000, None, "en", ""), (1001, "  ", None, ""), (1002, docs[0][1], None, ""), (1002, docs[0][1], None, "")]
    got = S.document_subjects(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"),
        spark.createDataFrame([("law", ""), ("sport", ""), (None, "")], "subject string, description string"), frequent=0.6,
    ).collect()
    found: dict = {}
    for r in got:
        assert r.subject not in found.setdefault(r.doc_id, set())
        found[r.doc_id].add(r.subject)
    right = sum(found.get(i, set()) == set([["law"], ["sport"], ["law", "sport"], []][i % 4]) for i in range(240) if i % 3)
    assert right >= 0.9 * 160
    assert found[1002] == found[0] and not {1000, 1001} & set(found)


def test_no_labels_no_documents(spark):
    docs, labels = _corpus(40)
    areas = spark.createDataFrame([("law", "")], "subject string, description string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert S.document_subjects(spark.createDataFrame(docs, SCHEMA), none, areas).count() == 0
    assert S.document_subjects(spark.createDataFrame([], SCHEMA), none, areas).count() == 0


def test_expected_counts_keep_every_word():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, n) for n in (3, 1, 40)]
    phi = rng.random((50, 5)).astype(np.float32)
    counts = S.expected_counts(docs, phi, np.full(5, 0.1, np.float32))
    assert np.allclose(counts.sum(1), np.bincount(np.concatenate(docs), minlength=50), atol=1e-3)


def test_speaking_sentences_against_a_loop():
    rng = np.random.default_rng(1)
    area, weight = rng.integers(0, 3, 20).astype(np.int32), np.where(rng.random(20) < 0.5, rng.random(20), 0)
    rows = [[int(x) for _ in range(rng.integers(0, 5)) for x in [*rng.integers(0, 20, rng.integers(1, 4)), -1]] for _ in range(30)]
    want = np.zeros((30, 3), int)
    for i, codes in enumerate(rows):
        sums = np.zeros(3)
        for c in codes:
            if c >= 0:
                sums[area[c]] += weight[c]
            else:
                want[i, sums.argmax()] += sums.max() > 0
                sums = np.zeros(3)
    flat = np.array([c for r in rows for c in r], np.int32)
    got = S.spoken(flat, np.repeat(np.arange(30), [len(r) for r in rows]), 30, area, weight, 3)
    assert (got == want).all()


def test_frequent_sentences_of_one_area_and_of_many_near_copies_count(spark):
    docs, labels = _corpus()
    fixed = "The lawaa and lawbb stand in every book."
    docs = [(i, text + (" " + fixed if i % 4 == 0 else ""), *rest) for i, text, *rest in docs]
    docs += [(2000, f"{fixed} Nothing was seen.", "en", ""), (2001, "It was a lawaa of good news. Nothing was seen.", "en", "")]
    sport = next(t for i, t, *_ in docs if i % 4 == 1).split(". ")
    rng = random.Random(5)
    for i in range(150):
        copied = list(sport)
        copied[rng.randrange(len(copied))] = f"Note {''.join(rng.choice(LETTERS) for _ in range(6))} was added"
        docs.append((3000 + i, ". ".join(copied), "en", ""))
    found: dict = {}
    for r in S.document_subjects(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"),
        spark.createDataFrame([("law",), ("sport",)], "subject string"), frequent=0.8,
    ).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert found.get(2000) == {"law"} and 2001 not in found
    assert all(found.get(3000 + i) == {"sport"} for i in range(150))


def test_terms_of_a_large_area_and_stop_words_of_another_language(spark):
    docs, labels = _corpus()
    # French texts of law and of nothing, whose common word is a term of sport in English.
    rng = random.Random(7)
    town = lambda: "".join(rng.choice(LETTERS) for _ in range(5))
    docs = [(i, text.replace("sportaa", "sportbb") + (f" The puck went to {town()}." if i % 4 == 1 else ""), *rest) for i, text, *rest in docs]
    docs += [(5000 + i, f"Puck une chose {town()}. {f'Lawaa et lawbb {town()}.' if i % 2 else ''}", "fr", "") for i in range(80)]
    labels += [(5000 + i, "law" if i % 2 else "none", "x") for i in range(0, 80, 3)]
    docs += [(6000, "The puck came along.", "en", "")]
    got = S.document_subjects(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"),
        spark.createDataFrame([("law",), ("sport",)], "subject string"),
    ).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert found.get(6000) == {"sport"}
    assert all(found.get(5000 + i, set()) == ({"law"} if i % 2 else set()) for i in range(80))


def test_tokens_are_read_once(monkeypatch):
    read, plain = [], S._WORD

    class Counting:
        def findall(self, text):
            read.append(text)
            return plain.findall(text)

    monkeypatch.setattr(S, "_WORD", Counting())
    tokens, ids = S.Tokens(), S.Tokens({"known": 3, "well": 5})
    for _ in range(3):
        assert tokens.of("Well-known l'été, a1b2cde x²³¹ 日本語 " + "long" * 20) == {"Well", "known", "été", "cde", "日本語", "long" * 20, "x²³¹"}
        assert ids.of("well-known, (known) other") == {3, 5}
    assert len(read) - read.count("long" * 20) == 5 + 3


def test_sentences_end_as_their_rule_says():
    rng = random.Random(2)
    rule = S.re.compile(r"(?<=[.!?。;])\s+|\n+")
    for _ in range(5000):
        text = "".join(rng.choice("ab.!;。? \n\t\r-") for _ in range(rng.randrange(14)))
        assert S.sentences(text) == [s.strip(" \t-*=#>") for s in rule.split(text)]


def test_codes_of_texts_are_sorted_once_and_ended():
    texts = [[([4, 2, 4], -1), ([], 7), ([9], 0)], [], [([], -1)], [([1], 2), ([1], -1)]]
    sentences = [s for t in texts for s in t]
    arrays = [[i for ids, _ in sentences for i in ids], np.cumsum([len(ids) for ids, _ in sentences]), [m for _, m in sentences], [len(t) for t in texts]]
    got = S.code_lists(*(np.array(x, np.int64) for x in arrays), 10)
    assert got.to_pylist() == [[2, 4, -1, 9, -2], [], [], [1, -4, 1, -1]]
    none = np.zeros(0, np.int64)
    assert S.code_lists(none, np.zeros(2, np.int64), np.array([-1, 3]), np.array([2, 0]), 0).to_pylist() == [[], []]


def test_proportions_in_blocks_are_those_of_each_document(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50, n) for n in (3, 30, 1, 8, 40, 2, 2, 9)]
    phi, alpha = rng.random((50, 5)).astype(np.float32), np.full(5, 0.1, np.float32)
    monkeypatch.setattr(S, "BLOCK_WORDS", 10)
    theta, share = S.proportions(np.concatenate(docs), np.repeat(np.arange(8), [len(d) for d in docs]), phi, alpha)
    for i, d in enumerate(docs):
        want = np.full(5, 0.2)
        for _ in range(S.INNER):
            mine = phi[d] * want / (phi[d] * want).sum(1, keepdims=True)
            want = (mine.sum(0) + alpha) / (mine.sum(0) + alpha).sum()
        at = sum(map(len, docs[:i]))
        assert np.allclose(theta[i], want, atol=1e-5) and np.allclose(share[at : at + len(d)], mine, atol=1e-5)


def test_counts_passed_on_in_parts_are_the_whole(monkeypatch):
    docs, _ = _corpus(40)
    batch = S.pa.table({"text": [d[1] for d in docs], "lang": [d[2] for d in docs]}).to_batches()
    want: dict = {}
    for _, text, lang, _ in docs:
        parts = S.sentences(text)
        for item in {*S._WORD.findall(text.lower()), *("s:" + S.mark(s) for s in parts if " " in s), "n:"}:
            want[lang[:2].lower(), item] = want.get((lang[:2].lower(), item), 0) + 1
    for limit in (S.COUNTED, 50):
        monkeypatch.setattr(S, "COUNTED", limit)
        got: dict = {}
        parts = list(S._counted(iter(batch)))
        for row in (r for p in parts for r in p.to_pylist()):
            got[row["lang"], row["item"]] = got.get((row["lang"], row["item"]), 0) + row["n"]
        assert got == want and (len(parts) > 1) == (limit == 50)
