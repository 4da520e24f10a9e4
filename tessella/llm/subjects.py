"""Problem 8: the subject areas of each document.

Method: latent Dirichlet topics, fitted over all distinct texts with Spark. Each larger language
has a model of one topic for each area and a few for the rest; the area topics begin at the
words of documents labelled with the area, the others at the words of all. A pass computes the
documents' topic proportions and the expected counts of words by topic inside tasks and sums
the counts by word; the driver holds only the tables of words by topic, whose size is bounded by the
vocabulary's shares. Topics get their area from their top terms: from the labels of the texts
these stand in. A word that is nearly all of one area's topics is a term of the area. A sentence speaks of the area its terms weigh
most for. A document's areas come from its topic proportions: the areas whose topics hold a share of all its
areas' topics. Those of them that a quarter of its speaking sentences speak of are kept.
Sentences that stand literally in many texts, near copies apart, don't count in the topics. Such a
sentence speaks of an area only if the texts it stands in are about that area by their other
sentences; one that stands in texts of many areas is a set phrase or figure of speech.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut

#: A language has its own model if so many distinct texts are in it; texts in others are read with the model whose
#: frequent words they have.
LANGUAGE_TEXTS = 20
#: Words of more than FREQUENT of a language's texts are no terms unless their texts are an area's (OWN); nor
#: are words of fewer than RARE (and 4).
FREQUENT, RARE = 0.13, 0.0006
#: A sentence of this share of all texts (and 5) may be a set phrase.
STOCK = 0.005
#: What stands in texts of which a share of an area this far from the overall one to 1 is the area's; texts needed.
OWN, OWN_TEXTS = 0.5, 3
OTHER_TOPICS = 2
#: Terms looked at to find a topic's area, and the share of their labels that it must have.
TOP_TERMS, TOPIC_SHARE = 25, 0.4
PASSES = 6
INNER = 6
ALPHA, BETA = 0.1, 0.05
#: A term's share in its area among all areas, and the texts it has there at least.
TERM_SHARE, TERM_TEXTS = 0.85, 2.0
#: Share of an area's topics among all areas' topics in a document's topic proportions.
LIKELY = 0.05
#: Share of a document's speaking sentences.
ABOUT = 0.24

#: Blanks after an end, or line ends; a blank comes first in the pattern, as this is looked for fastest.
_SENTENCE = re.compile(r"\s(?:(?<=[.!?。;]\s)\s*|(?<=\n)\n*)")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Tokens that a task remembers, and their longest; others are read anew.
TOKENS, TOKEN_LENGTH = 65536, 40
#: Words and sentences of a language that a task counts before it passes the counts on.
COUNTED = 100_000
#: Words of the documents whose topic proportions are worked out together: what a core's cache holds.
BLOCK_WORDS = 8000


class Tokens(dict):
    """The words of each token (what stands between blanks), or the `ids` of those that have one. Each is read once."""

    def __init__(self, ids: dict[str, int] | None = None):
        super().__init__()
        self.ids = ids

    def __missing__(self, token: str) -> tuple:
        words = _WORD.findall(token)
        found = tuple(words) if self.ids is None else tuple(self.ids[w] for w in words if w in self.ids)
        if len(token) <= TOKEN_LENGTH:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = found
        return found

    def of(self, text: str) -> set:
        return set(chain.from_iterable(map(self.__getitem__, text.split())))


def sentences(text: str) -> list[str]:
    """The sentences of `text` in lower case, markup of lists and headings removed."""
    return [s.strip(" \t-*=#>") for s in _SENTENCE.split(text.lower())]


def language(code: str | None) -> str:
    """Two lower-case letters, '' if unknown: 'EN', 'en-XX' and 'en' are one."""
    return (code or "").strip().lower()[:2]


def mark(sentence: str) -> str:
    """Sixteen hexadecimal digits that stand for a sentence."""
    return xxhash.xxh64_hexdigest(sentence)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, n): of a task's texts how many have each word, sentence (s:) and n:, an item more than once if it has many."""
    tokens, counts = Tokens(), defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            columns = [pa.repeat(lang, len(n)), pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "item", "n"])
        counts.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            parts, n = sentences(text), counts[language(lang)]
            n.update(tokens.of(" ".join(parts)))
            n.update({"s:" + mark(s) for s in parts if " " in s and len(s) < 200})
            n["n:"] += 1
            if len(n) >= COUNTED:
                yield from rows()
    yield from rows()


@dataclass
class Vocabulary:
    """Bounded by the shares above, whatever the number of texts."""

    langs: list[str] = field(default_factory=list)
    frequent: dict[str, set[str]] = field(default_factory=dict)
    stock: dict[str, int] = field(default_factory=dict)
    stock_least: float = 5.0
    ids: dict[str, dict[str, int]] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lang_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def model_of(self, lang: str, words: list[str]) -> str | None:
        """The model of a text: its language's, or the one whose frequent words it has most of."""
        if lang in self.ids:
            return lang
        hits = {x: sum(w in f for w in words) for x, f in self.frequent.items()}
        best = max(hits, key=lambda x: (hits[x], x), default=None)
        return best if best and hits[best] else None


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.filter(F.length(F.trim("text")) > 0).withColumn("print", F.xxhash64("text"))


def _clean(labels: DataFrame) -> DataFrame:
    """(key, subject): labels in lower case without blanks around."""
    return labels.select(F.col("doc_id").alias("key"), F.lower(F.trim("subject")).alias("subject"))


def _told(shared):
    """mapInArrow over labelled texts: (lang, item, subject, n), the frequent words of each with its labels.

    The item 'n:' stands for all texts, the subject null for all labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "lang", "subjects"))
            for text, lang, subjects in zip(*columns):
                lang = language(lang)
                if lang in shared.value:
                    items = ["n:", *shared.value[lang].intersection(_WORD.findall(" ".join(sentences(text))))]
                    counts.update((lang, item, x) for item in items for x in [None, *subjects])
        yield pa.RecordBatch.from_pylist(
            [{"lang": la, "item": item, "subject": x, "n": n} for (la, item, x), n in counts.items()],
            pa.schema([("lang", pa.string()), ("item", pa.string()), ("subject", pa.string()), ("n", pa.int64())]),
        )

    return run


def telling_words(slim: DataFrame, labels: DataFrame, names: list[str], frequent: dict[str, set[str]]) -> dict[str, set[str]]:
    """Of the frequent words of each language those that stand in the texts of an area, by the labels."""
    subjects = _clean(labels).filter("subject is not null").groupBy("key").agg(F.collect_set(F.when(F.col("subject").isin(names), F.col("subject"))).alias("subjects"))
    texts = slim.join(subjects, "key").groupBy("print").agg(
        F.max("text").alias("text"), F.max("lang").alias("lang"), F.array_distinct(F.flatten(F.collect_set("subjects"))).alias("subjects")
    )
    shared = slim.sparkSession.sparkContext.broadcast(frequent)  # words of a fixed share of the texts
    rows = texts.select("text", "lang", "subjects").mapInArrow(_told(shared), "lang string, item string, subject string, n long")
    counts = {(r.lang, r.item, r.subject): r.n for r in rows.groupBy("lang", "item", "subject").agg(F.sum("n").alias("n")).collect()}
    out: dict[str, set[str]] = {}
    for lang, words in frequent.items():
        some = sorted(words)
        get = lambda item: np.array([counts.get((lang, item, x), 0) for x in names], float)  # noqa: B023, E731
        base = get("n:") / max(counts.get((lang, "n:", None), 0), 1)
        n = np.array([counts.get((lang, w, None), 0) for w in some], float)
        telling = owned(np.array([get(w) for w in some]).reshape(-1, len(names)), n, base).any(1)
        out[lang] = {w for w, t in zip(some, telling) if t}
    return out


def vocabulary(slim: DataFrame, frequent: float, labels: DataFrame, names: list[str]) -> Vocabulary:
    """Words, frequent words and set phrases by language, counted once for each distinct text."""
    texts = slim.select("print", "text", "lang").dropDuplicates(["print"]).select("text", "lang")
    counts = texts.mapInArrow(_counted, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    counts = counts.filter("n >= 4 or item = 'n:'")
    counts = cut(counts)
    sizes = {r.lang: r.n for r in counts.filter("item = 'n:'").collect()}  # one row for each language
    total = sum(sizes.values())
    v = Vocabulary(stock_least=max(5, STOCK * total))
    v.langs = sorted(x for x, n in sizes.items() if x and n >= LANGUAGE_TEXTS)
    phrases = counts.filter("item like 's:%'").groupBy("item").agg(F.sum("n").alias("n")).filter(F.col("n") >= v.stock_least)
    v.stock = {x: i for i, x in enumerate(sorted(r.item[2:] for r in phrases.select("item").collect()))}
    least = F.create_map(*(F.lit(x) for la in v.langs for x in (la, float(max(4, RARE * sizes[la]))))) if v.langs else None
    words = []
    if v.langs:
        rows = counts.filter(F.col("lang").isin(v.langs) & ~F.col("item").like("_:%")).filter(F.col("n") >= least[F.col("lang")])
        words = sorted((r.lang, r.item, r.n) for r in rows.collect())
    v.frequent = {x: set() for x in v.langs}
    for lang, word, n in words:
        if n > frequent * sizes[lang]:
            v.frequent[lang].add(word)
    telling = telling_words(slim, labels, names, v.frequent) if names and v.langs else v.frequent
    v.ids, kept = {x: {} for x in v.langs}, []
    for lang, word, n in words:
        if word not in v.frequent[lang] or word in telling[lang]:
            v.ids[lang][word] = len(kept)
            kept.append((n, v.langs.index(lang)))
    v.counts = np.array([n for n, _ in kept], np.float64)
    v.lang_of = np.array([la for _, la in kept], np.int32)
    return v


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different ones of numbers from 0, in order, by sorting: `np.unique` may hash and then takes 30 times as long."""
    some = np.sort(numbers)
    return some[np.diff(some, prepend=-1) != 0]


def code_lists(ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, sizes: np.ndarray, words: int) -> pa.ListArray:
    """The codes of each text: of each sentence with ids these once, in order, then -1, or -2 - mark where it has one.

    `ids` (under `words`) are those of all texts' sentences, `ends` where each sentence's stop, `marks` -1 for none, and
    `sizes` the sentences of each text.
    """
    sentence = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    sentence, ids = np.divmod(distinct(sentence * np.int64(words) + ids), max(words, 1))
    last = np.flatnonzero(np.diff(sentence, append=-1))
    ended = sentence[last]
    codes = np.insert(ids, last + 1, np.where(marks[ended] >= 0, -2 - marks[ended], -1))
    of = np.repeat(np.arange(len(sizes)), sizes)
    n = np.bincount(of[sentence], minlength=len(sizes)) + np.bincount(of[ended], minlength=len(sizes))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(codes, pa.int32()))


def _coded(shared):
    """mapInArrow: (key, print, lang, codes, stock, mostly), lang that of the model.

    codes are the word ids of each sentence, sentences ended by -1, or by -2 - i if it is the i-th of the
    frequent ones; stock are the latter, in order; mostly: they are half of the text's sentences or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        tokens = {model: Tokens(ids) for model, ids in {"": {}, **v.ids}.items()}
        for batch in batches:
            found, ends, all_marks, sizes, models, stocks, mostly = [], [], [], [], [], [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                lang, whole = language(lang), sentences(text)
                marks = [v.stock.get(mark(s), -1) for s in whole]
                model = v.model_of(lang, [w for s, m in zip(whole, marks) if m < 0 for w in _WORD.findall(s)] if lang not in v.ids else []) or ""
                ids = tokens[model].__getitem__
                for s in whole:
                    found.extend(chain.from_iterable(map(ids, s.split())))
                    ends.append(len(found))
                all_marks += marks
                sizes.append(len(whole))
                models.append(v.langs.index(model) if model else -1)
                stocks.append(sorted({m for m in marks if m >= 0}))
                mostly.append(2 * sum(m >= 0 for m in marks) >= sum(" " in s for s in whole))
            codes = code_lists(*(np.array(x, np.int64) for x in (found, ends, all_marks, sizes)), len(v.counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("print"), pa.array(models, pa.int32()), codes,
                    pa.array(stocks, pa.list_(pa.int32())), pa.array(mostly, pa.bool_()),
                ],
                names=["key", "print", "lang", "codes", "stock", "mostly"],
            )

    return run


def stock_classes(texts: DataFrame) -> DataFrame:
    """(print, i, next): the frequent sentences of each of `texts`, with what tells near copies.

    In a text of mostly frequent sentences each is followed by the next of them in a fixed order: near copies
    have few different followers, whatever their number. next is null where the text stands for itself.
    """
    n = F.size("stock")
    at = F.posexplode("stock").alias("at", "i")
    rows = texts.filter(n > 0).select("*", at).withColumn("next", F.when(F.col("mostly") & (n > 1), F.get("stock", (F.col("at") + 1) % n)))
    return rows.drop("stock", "mostly", "at")


def set_phrases(coded: DataFrame, v: Vocabulary) -> np.ndarray:
    """Of each frequent sentence whether it is frequent over near-copy classes too."""
    marked = coded.filter(F.size("stock") > 0).select("print", "stock", "mostly").dropDuplicates(["print"])
    counts = stock_classes(marked).groupBy("i").agg((F.count_distinct("next") + F.count_if(F.col("next").isNull())).alias("n"))
    out = np.zeros(len(v.stock), bool)
    for row in counts.filter(F.col("n") >= v.stock_least).collect():  # at most the frequent sentences
        out[row.i] = True
    return out


def _without(shared):
    """mapInArrow: the codes of sentences that aren't set phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock = np.append(shared.value, [False])
        for batch in batches:
            column = batch.column("codes")
            flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            ends = flat < 0
            keep = ~stock[np.where(flat[ends] < -1, -2 - flat[ends], -1)][np.cumsum(ends) - ends] if len(flat) else np.zeros(0, bool)
            at = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]].astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(at), pa.array(flat[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("print"), codes], names=["key", "print", "codes"])

    return run


def owned(counts: np.ndarray, texts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Whether each row's share of an area (counts / texts) lies far enough above the overall share `base`."""
    share = counts / np.maximum(texts, 1e-9)[:, None]
    return (share >= base + OWN * (1 - base)) & (texts >= OWN_TEXTS)[:, None]


def stock_areas(coded: DataFrame, told, stock: np.ndarray, langs: int, areas: int) -> np.ndarray:
    """The areas that each frequent sentence may speak of: those of the texts it stands in by their other
    sentences; near copies count as one. Frequent in near copies only: all."""
    allowed = np.repeat(~stock[:, None], areas, axis=1)
    if not stock.any():
        return allowed
    schema = "print long, lang int, areas array<int>, stock array<int>, mostly boolean"
    texts = cut(coded.mapInArrow(_about(told, areas), schema).dropDuplicates(["print"]).filter(F.size("areas") > 0))
    base = np.zeros((langs + 1, areas + 1))
    ks = F.explode(F.concat("areas", F.array(F.lit(areas)))).alias("k")
    for row in texts.select("lang", ks).groupBy("lang", "k").count().collect():  # languages x areas
        base[row.lang, row.k] = row["count"]
    base = base[:, :-1] / np.maximum(base[:, -1:], 1)
    rows = stock_classes(texts).select("i", "next", "lang", ks).groupBy("i", "next", "lang", "k").count()
    of_class = F.max(F.when(F.col("k") == areas, F.col("count"))).over(Window.partitionBy("i", "next", "lang"))
    weighted = rows.withColumn("n", F.when(F.col("next").isNull(), F.col("count")).otherwise(F.col("count") / of_class))
    sums = np.zeros((langs + 1, len(stock), areas + 1))
    for row in weighted.groupBy("i", "lang", "k").agg(F.sum("n").alias("n")).collect():  # frequent sentences x areas
        sums[row.lang, row.i, row.k] = row.n
    lang = sums[:, :, -1].argmax(0)
    sums = sums[lang, np.arange(len(stock))]
    return allowed | owned(sums[:, :-1], sums[:, -1], base[lang])


def proportions(words: np.ndarray, doc: np.ndarray, phi: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(theta, share): the topic proportions of each document, and the topics' shares in each of its words.

    `words` are word ids, `doc` the document of each: 0, 1, ... in order, each with a word at least.
    """
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    lengths = np.diff(starts, append=len(doc))
    theta, shares = np.empty((len(starts), phi.shape[1]), phi.dtype), np.empty((phi.shape[1], len(words)), phi.dtype)
    blocks = np.flatnonzero(np.diff(starts // BLOCK_WORDS, prepend=-1))
    for first, after in zip(blocks, [*blocks[1:], len(starts)]):
        low, n = starts[first], lengths[first:after]
        at = starts[first:after] - low
        p = phi[words[low : low + n.sum()]].T.copy()  # a row for each topic
        own = np.full((len(p), len(n)), 1.0 / len(p), phi.dtype)
        share = p
        for _ in range(INNER):
            share = p * np.repeat(own, n, axis=1)
            share /= share.sum(0)
            own = np.add.reduceat(share, at, axis=1) + alpha[:, None]
            own /= own.sum(0)
        theta[first:after], shares[:, low : low + n.sum()] = own.T, share
    return theta, shares.T


def expected_counts(docs: list[np.ndarray], phi: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Expected counts of words (rows) by topic over `docs`, each an array of its word ids."""
    words, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    share = proportions(words, doc, phi, alpha)[1]
    return np.stack([np.bincount(words, share[:, k], len(phi)) for k in range(phi.shape[1])], axis=1)


def likely_areas(codes: np.ndarray, rows: np.ndarray, lang: np.ndarray, phi: np.ndarray, areas_of: np.ndarray) -> np.ndarray:
    """Whether each row's topic proportions hold each area: LIKELY of all that areas' topics hold.

    `codes` as in `spoken`; `lang` is each row's model, `areas_of` (model, topic, area) is 1 where the topic is the area's.
    """
    out = np.zeros((len(lang), areas_of.shape[2]), bool)
    alpha = np.full(phi.shape[1], ALPHA, phi.dtype)
    for at in range(0, len(lang), 1000):
        low, high = np.searchsorted(rows, [at, at + 1000])
        some = codes[low:high] >= 0
        doc, words = np.divmod(distinct(rows[low:high][some] * np.int64(len(phi)) + codes[low:high][some]), len(phi))
        new = np.diff(doc, prepend=-1) != 0
        row = doc[new]
        if len(row):
            theta = proportions(words, np.cumsum(new) - 1, phi, alpha)[0]
            held = np.einsum("rk,rka->ra", theta, areas_of[lang[row]])
            out[row] = held >= LIKELY * np.maximum(held.sum(1, keepdims=True), 1e-9)
            out[row] &= held > 0
    return out


def _pass(shared, topics: int):
    """mapInArrow over texts: the expected counts of one task, a row for each word it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi, alpha = shared.value
        total = np.zeros(phi.shape)
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            flat_at = ends - ends[0]
            docs = [flat[a:b] for a, b in zip(flat_at, flat_at[1:]) if b > a]
            for at in range(0, len(docs), 1000):
                total += expected_counts(docs[at : at + 1000], phi, alpha)
        used = np.flatnonzero(total.sum(1) > 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(total[used, k].astype(np.float32)) for k in range(topics))], names=["id", *(f"t{k}" for k in range(topics))]
        )

    return run


def word_shares(counts: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The share of each word in each topic of its language."""
    phi = counts + BETA
    for lang in range(len(v.langs)):
        mine = v.lang_of == lang
        phi[mine] /= phi[mine].sum(0)
    return phi.astype(np.float32)


def fit_topics(texts: DataFrame, v: Vocabulary, seeds: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Expected counts of words by topic after `passes` over the distinct texts (ids)."""
    spark = texts.sparkSession
    areas = seeds.shape[1]
    rng = np.random.default_rng(0)
    rest = v.counts[:, None] * rng.uniform(0.5, 1.5, (len(v.counts), OTHER_TOPICS))
    counts = np.concatenate([seeds, rest], axis=1)
    topics = areas + OTHER_TOPICS
    alpha = np.full(topics, ALPHA, np.float32)
    schema = ", ".join(["id int", *(f"t{k} float" for k in range(topics))])
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((word_shares(counts, v), alpha))
        sums = texts.mapInArrow(_pass(shared, topics), schema).groupBy("id").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(topics)))
        counts = np.zeros_like(counts)
        for row in sums.collect():  # at most one row for each word of the vocabulary
            counts[row[0]] = row[1:]
        shared.unpersist()
    return counts


def topic_areas(counts: np.ndarray, seeds: np.ndarray, mine: np.ndarray, top: int = TOP_TERMS) -> np.ndarray:
    """The area of each topic of one language (`mine`: its words), -1 for none.

    A topic's `top` terms are those that are most its own. If the labels of the documents they
    stand in name one area for most of their weight, it is that area's; labels of frequent areas count less.
    """
    own, labels = counts[mine], seeds[mine] / np.maximum(seeds[mine].sum(0), 1e-9)
    base = own.sum(1) / max(own.sum(), 1e-9)
    phi = own / np.maximum(own.sum(0), 1e-9)
    telling = own * np.log(np.maximum(phi, 1e-12) / np.maximum(base, 1e-12)[:, None])
    areas = np.full(counts.shape[1], -1)
    for k in range(counts.shape[1]):
        best = np.argsort(-telling[:, k], kind="stable")[:top]
        best = best[(telling[best, k] > 0) & (labels[best].sum(1) > 0)]
        share = labels[best] / labels[best].sum(1, keepdims=True)
        weight = own[best, k] @ share / max(own[best, k].sum(), 1e-9) if len(best) else np.zeros(seeds.shape[1])
        if len(weight) and weight.max() >= TOPIC_SHARE:
            areas[k] = weight.argmax()
    return areas


def areas_of_topics(counts: np.ndarray, seeds: np.ndarray, v: Vocabulary) -> np.ndarray:
    """(model, topic, area): 1 where the topic of the language is the area's, else 0."""
    out = np.zeros((len(v.langs) + 1, counts.shape[1], seeds.shape[1]), np.float32)  # the last: no model
    for lang in range(len(v.langs)):
        for k, area in enumerate(topic_areas(counts, seeds, v.lang_of == lang)):
            if area >= 0:
                out[lang, k, area] = 1
    return out


def area_counts(counts: np.ndarray, areas_of: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Counts of words by area: those of the topics that are an area's, together."""
    return np.einsum("wk,wka->wa", counts, areas_of[v.lang_of])


def terms(counts: np.ndarray, areas: int) -> tuple[np.ndarray, np.ndarray]:
    """(area, weight) of each word: its area and share there, weight 0 if it is no term."""
    own = counts[:, :areas]
    share = own / (own.sum(1, keepdims=True) + 1.0)
    area = share.argmax(1)
    weight = np.where((share.max(1) >= TERM_SHARE) & (own.sum(1) >= TERM_TEXTS), share.max(1), 0.0)
    return area.astype(np.int32), weight


def spoken(
    codes: np.ndarray, rows: np.ndarray, n_rows: int, area: np.ndarray, weight: np.ndarray, areas: int, allowed: np.ndarray | None = None,
) -> np.ndarray:
    """How many sentences of each row (of `n_rows`) speak of each area.

    `codes` are the word ids of all rows' sentences, each sentence ended by a negative number; `rows` says
    whose. A sentence ended by -2 - i speaks only of the areas of the i-th row of `allowed`.
    """
    ends = codes < 0
    sentence = np.cumsum(ends) - ends
    words = ~ends
    at = sentence[words] * areas + area[codes[words]]
    sums = np.bincount(at, weight[codes[words]], int(ends.sum()) * areas).reshape(-1, areas)
    told = sums.max(1, initial=0) > 0
    if allowed is not None and len(allowed):
        stock = -2 - codes[ends]
        told &= (stock < 0) | allowed[np.maximum(stock, 0), sums.argmax(1)]
    at = rows[ends][told] * areas + sums[told].argmax(1)
    return np.bincount(at, minlength=n_rows * areas).reshape(n_rows, areas)


def _shares(column: pa.ListArray, told: tuple, areas: int) -> np.ndarray:
    """The share of each area in the speaking sentences of each row, 0 if it isn't about it."""
    area, weight, allowed = told
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    counts = spoken(column.flatten().to_numpy(), rows, len(column), area, weight, areas, allowed)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.where((counts > 0) & (share >= ABOUT), share, 0.0)


def _about(shared, areas: int):
    """mapInArrow: the areas of each text, with its print, lang and frequent sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = _shares(batch.column("codes"), shared.value, areas) > 0
            found = pa.array([np.flatnonzero(x).tolist() for x in share], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("print"), batch.column("lang"), found, batch.column("stock"), batch.column("mostly")],
                names=["print", "lang", "areas", "stock", "mostly"],
            )

    return run


def _assigned(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *told, phi, areas_of = shared.value
            codes = batch.column("codes")
            share = _shares(codes, tuple(told), len(names))
            rows = np.repeat(np.arange(len(codes)), np.diff(codes.offsets.to_numpy()))
            likely = likely_areas(codes.flatten().to_numpy(), rows, batch.column("lang").to_numpy(), phi, areas_of)
            row, k = np.nonzero(likely & (share > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), pa.array([names[i] for i in k], pa.string()), pa.array(share[row, k], pa.float64())],
                names=["key", "subject", "share"],
            )

    return run


def label_seeds(coded: DataFrame, labels: DataFrame, names: list[str], words: int) -> np.ndarray:
    """Labels of each area by word: how often the documents of a word were given the area.

    Labels are read in lower case without blanks around; others than the areas are left out.
    """
    clean = _clean(labels).filter(F.col("subject").isin(names)).groupBy("key", "subject").count()
    joined = coded.join(clean, "key").select("subject", "count", F.explode(F.array_distinct("codes")).alias("id")).filter("id >= 0")
    seeds = np.zeros((words, len(names)))
    for row in joined.groupBy("subject", "id").agg(F.sum("count").alias("n")).collect():  # words x areas at most
        seeds[row.id, names.index(row.subject)] = row.n
    return seeds


def document_subjects(
    docs: DataFrame, labels: DataFrame, areas: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    frequent: float = FREQUENT,
) -> DataFrame:
    """(id_col, subject, share): the areas of each document, none, one or two as a rule.

    All distinct texts count once in the topics, however often they stand; every row gets the
    areas of its text. Null, empty and blank texts have no area. Documents whose language is
    unknown or rare use the model whose frequent words they have, or have no area. Repeated
    rows and labels change nothing; with no labels or areas no document has an area.
    """
    spark = docs.sparkSession
    names = sorted(r.subject for r in areas.select("subject").distinct().collect() if r.subject)  # the fixed table
    slim = _slim(docs, id_col, text_col, lang_col)
    key_type = slim.schema["key"].dataType.simpleString()
    v = vocabulary(slim, frequent, labels, names)
    shared = spark.sparkContext.broadcast(v)
    schema = f"key {key_type}, print long, lang int, codes array<int>, stock array<int>, mostly boolean"
    coded = cut(slim.mapInArrow(_coded(shared), schema))
    stock = set_phrases(coded, v)
    plain = coded.select("key", "print", "codes").mapInArrow(_without(spark.sparkContext.broadcast(stock)), f"key {key_type}, print long, codes array<int>")
    seeds = label_seeds(plain, labels, names, len(v.counts)) if names and len(v.counts) else np.zeros((0, len(names)))
    if seeds.sum() == 0:
        return slim.select(F.col("key").alias(id_col), F.lit("").alias("subject"), F.lit(0.0).alias("share")).limit(0)
    ids = F.filter(F.array_distinct("codes"), lambda c: c >= 0)
    texts = cut(plain.select("print", ids.alias("ids")).dropDuplicates(["print"]).filter(F.size("ids") > 0).select("ids"))
    counts = fit_topics(texts, v, seeds)
    areas_of = areas_of_topics(counts, seeds, v)
    area, weight = terms(area_counts(counts, areas_of, v), len(names))
    first = spark.sparkContext.broadcast((area, weight, np.repeat(~stock[:, None], len(names), axis=1)))
    allowed = stock_areas(coded, first, stock, len(v.langs), len(names))
    told = spark.sparkContext.broadcast((area, weight, allowed, word_shares(counts, v), areas_of))
    found = coded.select("key", "lang", "codes").mapInArrow(_assigned(told, names), f"key {key_type}, subject string, share double")
    return found.dropDuplicates(["key", "subject"]).withColumnRenamed("key", id_col)


def composition(subjects: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(subject, lang, source, n_docs): documents by area, language and source; null: no area."""
    lang = F.substring(F.lower(F.trim("lang")), 1, 2).alias("lang")
    rows = docs.select(id_col, lang, "source").join(subjects.select(id_col, "subject"), id_col, "left")
    return rows.groupBy("subject", "lang", "source").agg(F.count("*").alias("n_docs"))
