"""Problem 3: evaluation questions that also stand in the training split.

Method: word n-gram hashes. Questions are brought to their bare words (markup, accents,
look-alike letters, fixed instructions and set phrases around the question removed; common
synonyms written alike), equal ones form a class. Each class has the hashes of its pairs of
neighbouring words, weighted by the fourth power of their rarity (log of the inverse frequency). The rarest hashes of each
evaluation class, those that any training class with enough of its weight must share one of,
are partitioned with the hashes of all training classes; the pairs that meet get their
containment and an exact look at the words that differ.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut

#: Weighted share of an evaluation question's word pairs that a training question has at least.
#: One misspelt word takes two pairs with it; the words are compared after it.
CONTAINMENT = 0.3
#: Lists of up to this many words are also hashed word by word, so that one misspelt word leaves something.
SHORT = 5
#: A hash of more classes meets in blocks of about this many.
HOT = 4_096
#: What stands where a question should, as folded words.
PLACEHOLDERS = frozenset("n a|na|null|none|nan|tbd|todo|tba|test|unknown|question|xxx|x".split("|"))
#: A word is known if at least this share of the classes has it; at most 1/share x the words
#: of a question are.
KNOWN_SHARE = 0.002

#: Words without weight, synonyms, words of set phrases around questions.
STOP = frozenset(
    "a an the of in on at to for by with and or is are was were be do does did that this it its "
    "which what who whom whose where when how from as both there".split()
)
SYNONYMS = {
    "yr": "year", "1st": "first", "2nd": "second", "3rd": "third", "established": "founded", "set": "founded",
    "situated": "located", "pupils": "students", "learners": "students", "movie": "film", "picture": "film",
    "get": "receive", "got": "receive", "won": "receive", "win": "receive", "took": "receive", "received": "receive", "constructed": "built",
    "authored": "wrote", "penned": "wrote", "recording": "record", "album": "record", "printed": "published",
    "train": "study", "studied": "study", "organised": "held", "organized": "held", "hosted": "held",
    "started": "began", "launched": "began", "town": "city", "writer": "author", "inhabitants": "population",
    "appear": "perform", "close": "near", "firm": "company", "theater": "theatre", "initial": "first", "earliest": "first", "biggest": "largest", "prize": "award", "novels": "novel", "book": "novel",
}
FILLER = frozenset(
    "hi hello hey so please quick one trivia question q quiz answer short thanks thank can could would you tell me "
    "cite passage passages dev test train points word words using only supplied phrase give no explanation context below "
    "if not sufficient say well ok okay now then also exactly know want i need briefly small little".split()
)
QUESTION_WORDS = "which what who whom whose when where how why".split()
#: Words that change the question when they are added.
DECISIVE = frozenset("first last largest smallest before after northern southern eastern western never older younger oldest youngest".split())
_TAG = re.compile(r"<[^<>]{0,200}>")
_LEAD = re.compile(r"^\W*(?:q\w*\W{0,3})?\d{1,3}\s*[).:\]]\s*", re.I)
_NUMBERED = re.compile(r"(?<![\w(.,])\d{1,3}\)\s")
_TAIL = re.compile(r"[(\[]\s*\d{1,3}\s*\w+\s*[)\]]\W*$")
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсхуіјѕһԁкмтвнοαερτυικνхАЕОРСХУІЈЅКМТВН", "aeopcxyijshdkmtbhoaeptuiknxAEOPCXYIJSKMTBH")


def fold(text: str) -> str:
    """`text` without markup, accents and invisible characters, look-alikes made Latin, lower case."""
    text = unicodedata.normalize("NFKD", _TAG.sub(" ", html.unescape(html.unescape(text))))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c in "\t\n\r")
    if not text.isascii():
        words = re.split(r"(\W+)", text)
        text = "".join(w.translate(LOOKALIKES) if re.search("[A-Za-z]", w) or len(w) < 3 else w for w in words)
    return text.casefold()


def words_of(question: str | None) -> list[str]:
    """All words of a question, folded, in order."""
    if not question:
        return []
    text = _NUMBERED.sub(" ", _TAIL.sub("", _LEAD.sub("", fold(question))))
    return re.findall(r"[^\W_]+", text)


def near(a: str, b: str, most: int) -> bool:
    """Whether a becomes b by at most `most` (1 or 2) insertions, deletions, changes or swaps."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


@lru_cache(maxsize=200_000)
def _meant(word: str) -> str:
    """What an unknown word misspells: '' for a word without weight, a synonym, else itself."""
    if len(word) >= 3 and any(near(word, s, 1) for s in STOP if len(s) >= 3):
        return ""
    if any(len(s) > 3 and near(word, s, 1) for s in FILLER):
        return ""
    return next((c for s, c in SYNONYMS.items() if len(s) > 3 and near(word, s, 1)), word)


def same_question(a: list[str], b: list[str], known: frozenset[str]) -> bool:
    """Whether two lists of bare words ask the same.

    Words are paired off if equal, then if one is a misspelling of the other: they differ by
    one change, or by two in words of six letters or more, and are not both known words. What
    is left over may be set phrases, or one known word on one side; a number, an unknown word
    or different words on both sides make another question.
    """
    left, right = Counter(a), Counter(b)
    common = left & right
    if sum(common.values()) < 2:
        return False
    one, other = list((left - common).elements()), list((right - common).elements())
    if any(w.isdigit() for w in one) or any(w.isdigit() for w in other):
        return False
    for x in list(one):
        letters = set(x)
        for y in other:
            if abs(len(x) - len(y)) > 2 or len(letters ^ set(y)) > 4:
                continue  # two changes replace two letters by two others at most
            if (x in known and y in known) or (x in DECISIVE and y in DECISIVE):
                continue
            longest = max(len(x), len(y))
            if longest >= 4 and near(x, y, 2 if longest >= 6 else 1):
                one.remove(x)
                other.remove(y)
                break

    def content(words: list[str]) -> list[str]:
        kept = []
        for w in words:
            if w in FILLER or (w not in known and len(w) <= 2):
                continue
            meant = w if w in known else _meant(w)
            if meant:
                kept.append(meant)
        return kept

    one, other = content(one), content(other)
    for x in list(one):
        if x in other:
            one.remove(x)
            other.remove(x)
    if one and other:
        return False
    rest = one or other
    return not rest or (len(rest) == 1 and rest[0] in known and not rest[0].isdigit() and len(rest[0]) > 2 and rest[0] not in DECISIVE)


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["id", "split", "source"]].assign(words=batch["question"].map(words_of))


def instructions(questions: DataFrame, share: float = 0.05, own: float = 0.9) -> DataFrame:
    """(source, start, cut): instructions that one source puts before its questions.

    A run of 6..24 first words without a question word is one if `share` of a source's different
    questions (and 20) begin with it and `own` of all that do are of this source; of the runs
    with the same first six words the longest that keeps 4/5 of the questions counts.
    """
    questions = questions.select("source", "words").distinct()  # copies make no instruction
    begun = questions.withColumn("n", F.explode(F.sequence(F.lit(6), F.lit(24)))).filter(F.size("words") >= F.col("n") + 4)
    asks = F.array(*map(F.lit, QUESTION_WORDS))
    begun = begun.filter(~F.arrays_overlap(F.expr("slice(words, 1, n)"), asks))
    runs = begun.select("source", "n", F.array_join(F.slice("words", 1, 6), " ").alias("start"), F.xxhash64(F.expr("slice(words, 1, n)")).alias("run"))
    counts = runs.groupBy("source", "n", "start", "run").agg(F.count("*").alias("m"))
    everywhere = Window.partitionBy("n", "run")
    sizes = questions.groupBy("source").agg(F.count("*").alias("size"))
    frequent = (
        counts.withColumn("anywhere", F.sum("m").over(everywhere))
        .filter(F.col("m") >= F.greatest(F.lit(20), own * F.col("anywhere")))
        .join(sizes.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .filter(F.col("m") >= share * F.col("size"))
    )
    of_start = Window.partitionBy("source", "start")
    return (
        frequent.withColumn("six", F.max(F.when(F.col("n") == 6, F.col("m"))).over(of_start))
        .filter(F.col("m") >= 0.8 * F.col("six"))
        .groupBy("source", "start").agg(F.max("n").alias("cut"))
    )


def question_words(items: DataFrame, id_col: str = "id", question_col: str = "question", split_col: str = "split", source_col: str = "source") -> DataFrame:
    """(id, split, source, words): train, dev and test questions as content words, in order.

    An id sent twice comes out once for each different question. Questions that are null, blank, without a word or a
    placeholder are left out, as are rows with a null id or another split. One of stop words only keeps them all.
    """
    rows = items.select(
        F.col(id_col).cast("string").alias("id"), F.lower(F.trim(F.col(split_col))).alias("split"),
        F.col(source_col).alias("source"), F.col(question_col).alias("question"),
    )
    rows = rows.filter(F.col("split").isin("train", "dev", "test") & F.col("id").isNotNull() & F.col("question").isNotNull()).distinct()
    bare = cut(rows.mapInPandas(_bare, "id string, split string, source string, words array<string>"))
    cuts = instructions(bare).withColumnsRenamed({"source": "of"})
    stripped = bare.withColumn("begin", F.array_join(F.slice("words", 1, 6), " ")).join(
        cuts, F.col("source").eqNullSafe(F.col("of")) & (F.col("begin") == F.col("start")), "left"
    )
    alike = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    rest = F.expr("slice(words, coalesce(cut, 0) + 1, greatest(size(words), 1))")
    plain = F.transform(rest, lambda w: F.coalesce(F.try_element_at(alike, w), w))
    content = F.filter(plain, lambda w: ~w.isin(*sorted(STOP)))
    content = F.when(F.size(content) > 0, content).otherwise(plain)
    real = (F.size("words") > 0) & ~F.array_join("words", " ").isin(*sorted(PLACEHOLDERS))
    return stripped.filter(real).select("id", "split", "source", content.alias("words"))


def question_classes(questions: DataFrame) -> DataFrame:
    """(key, words, train, held): each different list of words once, and where it stands."""
    key = F.xxhash64("words")
    return questions.groupBy(key.alias("key"), "words").agg(
        F.max((F.col("split") == "train").cast("int")).alias("train"),
        F.max((F.col("split") != "train").cast("int")).alias("held"),
    )


def known_words(classes: DataFrame, share: float = KNOWN_SHARE) -> frozenset[str]:
    """Words that `share` of all classes have (and five): at most words-per-question / share."""
    total = classes.count()
    words = classes.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
    return frozenset(r.w for r in words.filter(F.col("count") >= max(5, share * total)).select("w").collect())


def grams_of(words: Column) -> Column:
    """The hashes of neighbouring words; lists of up to SHORT words also have those of single words."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, 2), " "))))
    single = F.when(F.size(words) <= SHORT, F.transform(words, lambda w: F.xxhash64(w)))
    none = F.expr("cast(array() as array<long>)")
    return F.array_distinct(F.concat(F.coalesce(pairs, none), F.coalesce(single, none)))


def candidate_pairs(classes: DataFrame, containment: float = CONTAINMENT, hot: int = HOT) -> DataFrame:
    """(e, t, weight): evaluation and training classes and the weighted containment of e in t.

    All pairs of different classes whose containment is at least `containment`, and no others. Containment is
    that of the hashes that any training class has: one that none has (a misspelling, mostly) can't be shared
    and doesn't count. With the hashes of an evaluation class in the order of falling weight, a training class
    that has `containment` of its weight shares one of those before which at least 1 - containment of it is
    still to come; only these are looked up. The containment is worked out where the two meet, at the
    first hash they share, so nothing is shuffled again. Hashes of more than `hot` classes meet in blocks
    of both sides. Questions with different numbers are different, so only those with the same numbers meet.
    """
    numbers = F.array_join(F.array_sort(F.filter("words", lambda w: w.rlike(r"^\p{Nd}+$"))), " ").alias("numbers")
    rows = classes.select("key", "train", "held", numbers, grams_of(F.col("words")).alias("grams"))
    flat = rows.select("key", "train", "held", "numbers", F.explode("grams").alias("gram"))
    weights = flat.groupBy("gram").agg(F.count("*").alias("df"), F.max("held").alias("held"), F.max("train").alias("trained"))
    weights = weights.filter("held = 1 and trained = 1").select("gram", "df")
    total = F.lit(classes.count() + 1.0)
    blocks = F.ceil(F.col("df") / hot).cast("int")
    weighed = flat.filter("held = 1").join(weights, "gram").withColumn("weight", F.pow(F.log(total / F.col("df")) + 0.01, F.lit(4.0)))
    # A question's hashes are few: its words.
    lists = weighed.groupBy(F.col("key").alias("e"), "numbers").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "weight"))).alias("own"))
    lists = lists.withColumn("all", F.aggregate("own", F.lit(0.0), lambda s, x: s + x["weight"]))
    placed = lists.select("*", F.posexplode("own").alias("pos", "x")).select("*", "x.gram", "x.df")
    before = F.aggregate(F.slice("own", 1, F.col("pos")), F.lit(0.0), lambda s, x: s + x["weight"])
    first = placed.filter(before < (1 - containment + 1e-9) * F.col("all"))
    first = first.withColumn("i", F.pmod(F.xxhash64("e"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first = first.select("e", "numbers", "own", "all", "pos", "gram", "i", "j")
    trained = flat.filter("train = 1").join(weights, "gram").join(rows.filter("train = 1").select("key", "grams"), "key")
    trained = trained.withColumn("j", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    trained = trained.select(F.col("key").alias("t"), "numbers", "grams", "gram", "i", "j")
    met = first.join(trained, ["gram", "numbers", "i", "j"]).filter("e <> t")
    earlier = F.exists(F.slice("own", 1, F.col("pos")), lambda x: F.array_contains("grams", x["gram"]))
    shared = F.aggregate("own", F.lit(0.0), lambda s, x: s + F.when(F.array_contains("grams", x["gram"]), x["weight"]).otherwise(0.0))
    return met.filter(~earlier).withColumn("weight", shared / F.col("all")).filter(F.col("weight") >= containment).select("e", "t", "weight")


def overlapping_classes(classes: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(e, t, contained): evaluation classes and the training classes that ask the same."""
    known = known_words(classes)
    words = classes.select("key", "words")
    pairs = (
        candidate_pairs(classes, containment)
        .join(words.withColumnsRenamed({"key": "e", "words": "ew"}), "e")
        .join(words.withColumnsRenamed({"key": "t", "words": "tw"}), "t")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [same_question(list(a), list(b), known) for a, b in zip(batch["ew"], batch["tw"])]
            yield batch.loc[same, ["e", "t", "contained"]]

    near = pairs.select("e", "t", F.col("weight").alias("contained"), "ew", "tw").mapInPandas(run, "e long, t long, contained double")
    equal = classes.filter("held = 1 and train = 1").select(F.col("key").alias("e"), F.col("key").alias("t"), F.lit(1.0).alias("contained"))
    return near.unionByName(equal)


def cross_split_pairs(items: DataFrame, **columns: str) -> DataFrame:
    """(held_id, held_split, source, train_id, contained): all overlaps, each pair of ids once.

    Equal questions count as overlaps. `source` is the evaluation question's. The number of
    rows is that of the overlaps themselves; no class, pair or id is left out.
    """
    questions = cut(question_words(items, **columns).withColumn("key", F.xxhash64("words")))
    pairs = overlapping_classes(cut(question_classes(questions)))
    held = questions.filter("split <> 'train'").select(F.col("id").alias("held_id"), F.col("split").alias("held_split"), "source", F.col("key").alias("e"))
    train = questions.filter("split = 'train'").select(F.col("id").alias("train_id"), F.col("key").alias("t")).distinct()
    joined = pairs.join(held, "e").join(train, "t").filter("held_id <> train_id")
    return joined.groupBy("held_id", "train_id").agg(
        F.min("held_split").alias("held_split"), F.min("source").alias("source"), F.max("contained").alias("contained")
    )


def found(items: DataFrame, **columns: str) -> DataFrame:
    """(id_a, id_b): the overlapping ids, id_a < id_b by code points, each pair once."""
    pairs = cross_split_pairs(items, **columns)
    return pairs.select(F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b")).distinct()


def report(items: DataFrame, **columns: str) -> DataFrame:
    """(split, source, n_pairs, n_held): overlaps per evaluation split and its source."""
    pairs = cross_split_pairs(items, **columns)
    return pairs.groupBy(F.col("held_split").alias("split"), "source").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("held_id").alias("n_held")
    )
