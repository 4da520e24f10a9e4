"""Problem 1: cutting oversized texts at natural boundaries, with overlap.

Method: recursive bisection. A stretch longer than limit - overlap is cut at the strongest
boundary near its midpoint, the halves are cut in the same way, and at the end each piece but
the first is extended to the left by the overlap.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_CHARS = 2_000
OVERLAP_CHARS = 200

#: Places to cut where no given sentence end will do, strongest first.
_WEAKER = [
    re.compile(r"\n\s*\n\s*"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡]+[」』”]*\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[;:,،、，；：]\s*|\s[–—-]\s"),
    re.compile(r"\s+"),
]


#: What ends a sentence or a line, and what may close after it.
_STOPS = tuple(".!?…。！？｡।॥؟۔՞։።\n")
_CLOSERS = "\"'”’»)]」』"
#: Of `_WEAKER`, how many are stronger than a given end that may be out of place.
_OVER_UNSURE = 2


def _joins_left(ch: str) -> bool:
    """Whether `ch` belongs to the character before it (marks, joiners, selectors)."""
    return unicodedata.combining(ch) != 0 or ch == "‍" or "︀" <= ch <= "️" or unicodedata.category(ch) in ("Mn", "Me")


def sentence_cuts(text: str, ends: list[int]) -> tuple[list[int], list[int]]:
    """Cut places after the given sentence ends: (sure, unsure), without those that can't be right.

    An end counts if it lies inside the text, follows no letter or digit that is continued
    after it, and is not inside a white-space run that a later place already ends. It is sure
    where the text before it ends a sentence or a line, unsure where it may be out of place.
    """
    sure, unsure = set(), set()
    for end in ends:
        if end is None or not 0 < end < len(text):
            continue
        if text[end - 1].isalnum() and text[end].isalnum():
            continue
        stop = end
        while end < len(text) and text[end].isspace():
            end += 1
        if end < len(text):
            before = text[max(0, stop - 16) : stop].rstrip(" \t").rstrip(_CLOSERS)
            (sure if before[-1:] in _STOPS or "\n" in text[stop:end] else unsure).add(end)
    return sorted(sure), sorted(unsure - sure)


def _nearest(places: list[int], low: int, high: int, middle: int) -> int | None:
    """Of the sorted places in low..high, the one nearest to the middle, the left of two."""
    i = bisect.bisect_left(places, middle)
    best = [p for p in places[max(0, i - 1) : i + 1] if low <= p <= high]
    return min(best, key=lambda p: (abs(p - middle), p), default=None)


def piece_starts(text: str, ends: list[int], limit: int, overlap: int) -> list[int]:
    """Starts of the pieces of `text` before the overlap is attached; the first is 0."""
    most, least = limit - overlap, max(1, min(overlap, (limit - overlap) // 4))
    sure, unsure = sentence_cuts(text, ends)
    ranks, last = [sure], len(_WEAKER) + 1
    starts, todo = [0], [(0, len(text))]

    def weaker(rank: int) -> list[int]:
        while len(ranks) <= rank:
            at = len(ranks) - 1
            rule = _WEAKER[at - (at > _OVER_UNSURE)]
            ranks.append(unsure if at == _OVER_UNSURE else [m.end() for m in rule.finditer(text)])
        return ranks[rank]

    while todo:
        start, end = todo.pop()
        if end - start <= most:
            continue
        middle, low, high = (start + end) // 2, start + least, end - least
        near = (end - start) // 4
        cut = _nearest(weaker(0), middle - near, middle + near, middle) or _nearest(weaker(0), low, high, middle)
        rank = 0
        while cut is None and rank < last:
            rank += 1
            cut = _nearest(weaker(rank), max(low, middle - near), min(high, middle + near), middle)
        if cut is None:
            cut = middle
            while cut < high and _joins_left(text[cut]):
                cut += 1
        starts.append(cut)
        todo += [(start, cut), (cut, end)]
    return sorted(starts)


def _split(limit: int, overlap: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ends = batch.column(batch.schema.get_field_index("ends")).to_pylist()
            row, no, start, end, total, piece = [], [], [], [], [], []
            for i, text in enumerate(texts):
                begins = piece_starts(text, ends[i] or [], limit, overlap)
                for k, begin in enumerate(begins):
                    row.append(i)
                    no.append(k)
                    start.append(max(0, begin - overlap) if k else 0)
                    end.append(begins[k + 1] if k + 1 < len(begins) else len(text))
                    total.append(len(begins))
                    piece.append(text[start[-1] : end[-1]])
            taken = pa.array(np.array(row, np.int64))
            cols = [batch.column(batch.schema.get_field_index(c)).take(taken) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, *(pa.array(x, pa.int32()) for x in (no, total, start, end)), pa.array(piece, pa.string())],
                names=[*keep, "piece_no", "n_pieces", "start_offset", "end_offset", "piece"],
            )

    return run


def split_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences_col: str | None = "sentences",
    limit: int = LIMIT_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id_col, piece_no, n_pieces, start_offset, end_offset, piece): the ordered pieces.

    Every piece has at most `limit` characters (code points). Each but the first begins
    exactly `overlap` characters before the end of the one before it; without the overlaps the pieces
    are the text. A text within the limit is one piece, an empty one a piece of no characters,
    a null one a piece of null with null offsets. Sentence ends that are null, out of range or
    inside a word are passed over; where a stretch has no usable one, paragraph ends, sentence
    punctuation, given ends without punctuation before them, line ends, clause marks, blanks and at last any character are taken. Repeated
    rows come out as often as they stand. Further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and smaller than the limit")
    ends = F.transform(sentences_col, lambda s: s["end_offset"]) if sentences_col else F.lit(None).cast("array<int>")
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), ends.alias("ends"))
    size = F.length("text")
    whole = slim.filter(F.col("text").isNull() | (size <= limit)).select(
        "key",
        F.lit(0).alias("piece_no"),
        F.lit(1).alias("n_pieces"),
        F.when(F.col("text").isNotNull(), F.lit(0)).alias("start_offset"),
        size.alias("end_offset"),
        F.col("text").alias("piece"),
    )
    key_type = slim.schema["key"].dataType.simpleString()
    pieces = slim.filter(size > limit).mapInArrow(
        _split(limit, overlap, ["key"]),
        f"key {key_type}, piece_no int, n_pieces int, start_offset int, end_offset int, piece string",
    )
    return whole.unionByName(pieces).withColumnRenamed("key", id_col)


def split_check(pieces: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id_col, n_pieces, covered, over_limit) per document: what `pieces` keep."""
    per = pieces.groupBy(id_col).agg(
        F.count("*").alias("n_pieces"),
        F.sum(F.col("end_offset") - F.col("start_offset")).alias("chars"),
        F.max((F.col("end_offset") - F.col("start_offset") > limit).cast("int")).alias("over_limit"),
    )
    sizes = docs.select(id_col, F.length(text_col).alias("size"))
    return sizes.join(per, id_col, "left").select(
        id_col,
        "n_pieces",
        F.expr(f"(chars - {overlap} * (n_pieces - 1)) <=> size").alias("covered"),
        F.coalesce("over_limit", F.lit(0)).alias("over_limit"),
    )
