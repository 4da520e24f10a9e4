import random

from tessella.llm import splitting as S

SCHEMA = "doc_id long, text string, sentences array<struct<start_offset:int,end_offset:int>>, piece string"


def _pieces(spark, rows, limit=100, overlap=10):
    out = {}
    for r in S.split_documents(spark.createDataFrame(rows, SCHEMA), limit=limit, overlap=overlap).collect():
        out.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def _sentences(text):
    spans, at = [], 0
    for part in text.split(". "):
        spans.append((at, min(len(text), at + len(part) + 1)))
        at += len(part) + 2
    return spans


def test_pieces_cover_the_text_and_share_the_overlap(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        text = ". ".join("x" * rng.randint(1, 60) + "é" for _ in range(rng.randint(1, 30)))
        rows.append((i, text, _sentences(text), "clash"))
    rows += [(100, "字" * 1000, None, None), (101, "word " * 300, [], None), (102, "a" * 99 + "́" * 3 + "b" * 300, [(-5, 0), (7, 99999)], None)]
    got = _pieces(spark, rows)
    for key, text, _, _ in rows:
        pieces = got[key]
        assert all(len(p.piece) <= 100 for p in pieces)
        assert pieces[0].start_offset == 0 and pieces[-1].end_offset == len(text)
        for a, b in zip(pieces, pieces[1:]):
            assert b.start_offset == a.end_offset - 10
        for p in pieces:
            assert p.piece == text[p.start_offset : p.end_offset] and p.n_pieces == len(pieces)


def test_cuts_are_sentence_ends_where_there_are_any():
    text = ("Aa bb cc dd. " * 40).strip()
    ends = [i + 1 for i, c in enumerate(text) if c == "."]
    starts = S.piece_starts(text, ends, 100, 10)
    assert len(starts) > 5 and all(text[s - 2] == "." for s in starts[1:])


def test_null_empty_and_short_texts_are_one_piece(spark):
    got = _pieces(spark, [(1, None, None, "x"), (2, "", [], "x"), (3, "short", [(0, 0)], None), (3, "short", [(0, 0)], None)])
    assert got[1][0].piece is None and got[1][0].start_offset is None
    assert got[2][0].piece == "" and got[2][0].end_offset == 0
    assert len(got[3]) == 2
    assert S.split_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_end_out_of_place_gives_way_to_punctuation():
    text = "Aa bb cc. Dd ee ff gg. Hh (\"ii.\") Jj"
    assert S.sentence_cuts(text, [9, 12, 33, None, 99, 4]) == ([10, 34], [13])
    text = "word " * 11 + "end. " + "more " * 12
    wrong = text.index("more more") + 4
    assert S.piece_starts(text, [wrong], 100, 10)[1] == text.index("more")
