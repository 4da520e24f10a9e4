"""Problem 5: spellings of one person or organisation, linked.

Method: pigeonhole segment join. Each name has keys: one of its long words, beside the initials
of its other words. A key's word of length n is cut into k + 1 segments; a word within k edits
of it has one of them unchanged, moved by at most k. The segments form an inverted index, in
which the other words look up their substrings at the positions in reach. Words that meet are
compared by banded edit distance, then the whole names by rules for order, initials, titles,
nicknames, abbreviations and company endings. Linked names form components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.overlap import near
from tessella.operators.graph import components
from tessella.session import cut

EDITS = 2

#: Titles, additions to names, company endings, words between the words of a name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame lord lady rev fr st capt gen col lt hon herr frau mme mlle don dona".split())
AFTER = frozenset("phd md jr sr ii iii iv esq mba msc ma ba bsc dds rn obe cbe mbe kbe".split())
ENDINGS = frozenset(
    "inc incorporated corp corporation co company ltd limited plc llc llp lp gmbh ag sa nv bv pty spa srl ab oy holdings".split()
)
LINKS = frozenset("the of and for a an de la et und y".split())
#: What stands for no name.
NO_NAMES = frozenset(
    "unknown none null nan na n/a tbd tba anonymous anon various others other someone somebody nobody he she it they him her them his hers its their "
    "we us i me you who this that these those one author subject person company organisation organization founder director "
    "former latter same ditto see unnamed unspecified misc test".split()
)
#: Everyday forms of given names.
FORMAL = {
    "abigail": "abby abbie gail", "adebayo": "ade bayo", "alexander": "alex sasha sandy xander alec", "andrew": "andy drew", "anthony": "tony",
    "barbara": "barb babs", "beatriz": "bea bia", "benjamin": "ben benny benji", "catherine": "cathy cath", "charles": "charlie chuck chas charley",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "delphine": "del", "dmitri": "dima mitya mitia", "dolores": "lola dolly lolita",
    "dorothy": "dot dottie dolly dodie", "edward": "ed eddie ted teddy ned", "ekaterina": "katya katia", "elizabeth": "liz beth betty lizzie eliza bess libby lisa",
    "francisco": "pancho paco cisco", "frederick": "fred freddie", "friedrich": "fritz fred", "gabriel": "gabe", "george": "georgie", "giuseppe": "beppe peppe pino", "guadalupe": "lupe lupita",
    "gwendolyn": "gwen", "henry": "harry hank hal", "ingrid": "inga", "isabella": "bella izzy isa", "james": "jim jimmy jamie", "jasper": "jas", "johannes": "hans jan hannes", "john": "jack johnny", "jose": "pepe",
    "joseph": "joe joey", "katherine": "kate kathy katie kat kitty kay", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny leo", "margaret": "peggy maggie meg greta marge margie daisy",
    "mary": "molly polly", "mateus": "teus", "matthew": "matt", "michael": "mike mick mickey", "nadezhda": "nadia", "nicholas": "nick nicky nico klaus", "nikolai": "kolya nick", "oksana": "ksana ksenia", "oliver": "ollie", "patricia": "pat patty trish tricia patsy",
    "philip": "phil pip", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron", "samuel": "sam sammy",
    "stephen": "steve", "susan": "sue susie suzy", "teodor": "teo fedya", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli ueli", "umberto": "berto", "ursula": "ulla uschi",
    "valentina": "valya tina val", "victoria": "vicky tori vika", "vladimir": "vlad vova volodya", "walter": "walt wally", "william": "bill will billy willy liam", "wojciech": "wojtek", "yevgeny": "zhenya", "zachary": "zach zack zac", "zofia": "zosia",
}
NICKNAMES: dict[str, set[str]] = {}
for _full, _shorts in FORMAL.items():
    for _short in _shorts.split():
        NICKNAMES.setdefault(_short, set()).add(_full)


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.translate({0x2019: "'", 0x2018: "'", 0x131: "i", 0x142: "l", 0x141: "L", 0xF8: "o", 0xD8: "O", 0xDF: "ss", 0x111: "d"}))
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c in "\t\n").casefold()


def is_name(text: str | None) -> bool:
    """Whether `text` could be a name: not blank, no placeholder, no pronoun."""
    words = re.findall(r"[^\W_]+", _plain(text or ""))
    words = [w for w in words if w not in LINKS] or words
    if words and all(w in NO_NAMES for w in words):
        return False
    return any(len(w) >= 2 for w in words) or bool(re.fullmatch(r"(?:[A-Z]\W?){3,}", (text or "").strip()))


def person(text: str) -> dict:
    """Long words, initials in their order, abbreviations, nickname in quotes or brackets."""
    plain = re.sub(r"['`]s\b", "", _plain(text))
    nick = re.findall(r"[\"“”(«']\s*([^\W\d_]{2,})\s*[\"“”)»']", plain)
    plain = re.sub(r"[\"“”(«']\s*[^\W\d_]{2,}\s*[\"“”)»']", " ", plain)
    plain = re.sub(r"\bph\.?\s?d\b|\bm\.d\b", " ", plain)
    words, initials, short, found = [], [], [], re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?\.?", plain)
    for token in found:
        word = token.rstrip(".").replace("'", "")
        if word in TITLES and (token is found[0] or token.endswith(".")) or word in AFTER:
            continue
        if len(word) == 1:
            initials.append(word)
        else:
            words.append(word)
            if token.endswith(".") and len(word) <= 5:
                short.append(word)
    return {"words": words, "initials": initials, "short": short, "nick": nick}


def organisation(text: str) -> dict:
    """Words without articles, links and company endings; the letters of an acronym."""
    text = re.sub(r"(\w.*)\((?:[A-Z]\.?){3,8}\)\s*$", r"\1", text.strip())  # its own acronym after it
    plain = re.sub(r"['`]s\b", "", _plain(text))
    letters = re.sub(r"[^\w]", "", text.strip())
    acronym = letters.casefold() if re.fullmatch(r"[A-Z]{3,8}", letters) and re.fullmatch(r"(?:[A-Z]\.? ?){3,8}|[A-Z]{3,8}", text.strip()) else ""
    plain = re.sub(r"\b([^\W\d_])\.(?=[^\W\d_]\b)", r"\1", plain)
    found = re.findall(r"[^\W_]+\.?", plain)
    words = [t.rstrip(".") for t in found]
    kept = [w for w in words if w not in LINKS]
    while len(kept) > 2 and kept[-1] in ENDINGS:
        kept.pop()
    kept = [w for i, w in enumerate(kept) if i < 2 or w not in ENDINGS]
    return {"words": kept, "initials": [], "short": [t.rstrip(".") for t in found if t.endswith(".")], "nick": [acronym] if acronym else []}


def _given(word: str) -> set[str]:
    return {word} | NICKNAMES.get(word, set())


def _word(a: str, b: str, short: list[str]) -> int | None:
    """0: the same word, one of them shortened or an everyday form; 1: misspelt; None: another."""
    if a == b or a in NICKNAMES.get(b, ()) or b in NICKNAMES.get(a, ()):
        return 0
    small, large = sorted((a, b), key=len)
    if small in short and len(small) >= 2 and len(small) < len(large) and large.startswith(small):
        return 0
    if len(small) >= 3 and len(large) >= 4 and near(a, b, 1) or len(small) >= 8 and near(a, b, 2):
        return 1
    return None


def same_person(a: dict, b: dict) -> bool:
    """Whether two person names can be one person's.

    Long words pair off in any order, one misspelt pair at most; an initial stands for the
    given name where only the family name is written out, and for a middle name elsewhere.
    Middle initials must agree where both names have them.
    """
    if len(a["words"]) < len(b["words"]):
        a, b = b, a
    short = a["short"] + b["short"]
    left, typos, pairs = list(b["words"]), 0, 0
    rest = []
    for w in a["words"]:
        scored = [(s, x) for x in left if (s := _word(w, x, short)) is not None]
        if scored:
            s, x = min(scored)
            typos += s
            pairs += 1
            left.remove(x)
        else:
            rest.append(w)
    if typos > 1 or left or not pairs:
        return False
    ai, bi = list(a["initials"]), list(b["initials"])
    if len(a["words"]) < 2:
        return bool(ai and bi and ai[0] == bi[0] and (not ai[1:] or not bi[1:] or ai[1:] == bi[1:]))
    if len(b["words"]) < 2:
        if not bi or len(rest) != 1:
            return False
        firsts = {g[0] for g in _given(rest[0])}
        return bi[0] in firsts and (not ai or not bi[1:] or ai == bi[1:])
    # A further word of one may be the middle name the other shortens to its initial.
    for w in rest:
        if w[0] in bi:
            bi.remove(w[0])
        elif len(a["words"]) - len(rest) < 2:
            return False
    if rest and not typos:
        return True
    return not rest and (not ai or not bi or ai == bi)


def _shortened(a: str, b: str, dotted: list[str]) -> bool:
    """Whether the shorter word abbreviates the longer: same first letter, letters in order."""
    small, large = sorted((a, b), key=len)
    if len(small) < 2 and small not in dotted or len(small) > 5 and small not in dotted or len(large) - len(small) < 2 or small[0] != large[0]:
        return False
    rest = iter(large)
    return all(c in rest for c in small)


def same_organisation(a: dict, b: dict) -> bool:
    """Whether two organisation names can be one's: the same words, one misspelt, or shortened."""
    if len(a["words"]) < 2 or len(b["words"]) < 2:
        return bool(a["words"]) and a["words"] == b["words"]
    if len(a["words"]) != len(b["words"]):
        return False
    left, rest, changed = list(b["words"]), [], 0
    for w in a["words"]:
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    if len(rest) == len(a["words"]):
        return False
    for w in rest:
        for x in left:
            if len(w) > 3 and len(x) > 3 and near(w, x, 2 if min(len(w), len(x)) >= 8 else 1):
                changed += 1
                break
            if _shortened(w, x, a["short"] + b["short"]):
                break
        else:
            return False
        left.remove(x)
    return changed <= 1


def _keys(kind: str, parsed: dict) -> set[tuple[str, str]]:
    """(block, word): each long word beside the initials of the others; all words as one where none is long."""
    words, keys = parsed["words"], set()
    for i, word in enumerate(words):
        if len(word) < EDITS + 1:
            continue
        others = words[:i] + words[i + 1 :]
        if kind == "ORG":
            keys.add(("o" + "".join(sorted(w[0] for w in others)), word))
        else:
            firsts = {g[0] for w in others for g in _given(w)} or set(parsed["initials"][:1])
            keys |= {("p" + f, word) for f in firsts}
    whole = "".join(sorted(words))
    if words and max(map(len, words)) < EDITS + 1 and len(whole) >= EDITS + 1:
        keys.add(("w" + str(len(words)), whole))
    return keys


_PARSE = {"PERSON": person, "ORG": organisation}
_PARSED = (
    "name string, given string, kind string, form string, written boolean, keys array<struct<block: string, word: string>>, "
    "words array<string>, letters string, acronym boolean"
)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of each name and kind it may be of: all that later steps need, so that no name is parsed again but to compare."""
    for batch in batches:
        rows = []
        for name, given in zip(batch["name"], batch["kind"]):
            for kind in ("PERSON", "ORG") if given == "ANY" else (given,):
                p = _PARSE[kind](name)
                form = "|".join([" ".join(p["words"]), " ".join(p["initials"]), " ".join(p["short"])])
                letters = p["nick"][0] if p["nick"] else "".join(w[0] for w in p["words"]) if len(p["words"]) >= 3 else None
                keys = [{"block": block, "word": word} for block, word in sorted(_keys(kind, p))]
                single = kind == "ORG" or len(p["words"]) != 1 or not p["initials"]
                rows.append((
                    name, given, kind, form, kind == "ORG" or len(p["words"]) >= 2, keys, sorted(set(p["words"])) if single else [],
                    letters if kind == "ORG" else None, bool(p["nick"]),
                ))
        yield pd.DataFrame(rows, columns=["name", "given", "kind", "form", "written", "keys", "words", "letters", "acronym"])


def names_of(triples: DataFrame) -> DataFrame:
    """(name, kind): the different names of persons and organisations, as stored.

    PERSON or ORG by what most rows of the name say, whatever the case; ANY where none says
    more than null or OTHER. Names of other kinds, blanks, placeholders and pronouns are left out.
    Rows are counted before they are shuffled, however frequent a name is.
    """
    ends = triples.select(F.col("subject").alias("name"), F.col("subject_type").alias("t")).unionByName(
        triples.select(F.col("object").alias("name"), F.col("object_type").alias("t"))
    )
    kind = F.upper(F.trim(F.coalesce("t", F.lit(""))))
    is_kind = lambda k: F.sum((kind == k).cast("long")).alias(k)
    counts = ends.filter("name is not null").groupBy("name").agg(
        is_kind("PERSON"), is_kind("ORG"), F.sum((~kind.isin("PERSON", "ORG", "OTHER", "")).cast("long")).alias("rest")
    )
    most = (
        F.when((F.col("PERSON") >= F.col("ORG")) & (F.col("PERSON") > F.col("rest")), "PERSON")
        .when((F.col("ORG") > F.col("PERSON")) & (F.col("ORG") > F.col("rest")), "ORG")
        .when(F.col("rest") == 0, "ANY")
    )

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[is_name(n) for n in batch["name"]]]

    return counts.select("name", most.alias("kind")).filter("kind is not null").mapInPandas(kept, "name string, kind string")


def _forms(parsed: DataFrame) -> DataFrame:
    """(kind, form, rep, keys): each way a name parses, once, with its smallest spelling."""
    keyed = parsed.filter(F.size("keys") > 0)
    return keyed.groupBy("kind", "form").agg(F.min("name").alias("rep"), F.any_value("keys").alias("keys"))


def near_words(words: DataFrame, edits: int = EDITS) -> DataFrame:
    """(kind, block, aw, bw): words of one block within `edits` of each other, aw no longer than bw.

    aw is cut into edits + 1 segments of nearly equal length. If i segments before one have an edit
    each at most, that one has moved by i at most, and likewise counted from the end; so bw
    looks each segment up at few positions, and still no word within reach is missed.
    """
    n = F.char_length("word")
    parts = F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("part")
    base, longer = F.expr(f"length div {edits + 1}"), F.lit(edits + 1) - F.col("length") % (edits + 1)
    size = base + (F.col("part") >= longer).cast("int")
    at = F.col("part") * base + F.greatest(F.lit(0), F.col("part") - longer)
    index = words.select("kind", "block", "word", n.alias("length"), parts)
    index = index.select("kind", "block", "length", "part", F.substring("word", at + 1, size).alias("piece"), F.col("word").alias("aw"))
    asked = words.select("kind", "block", "word", n.alias("n"), F.explode(F.sequence(F.greatest(n - edits, F.lit(edits + 1)), n)).alias("length"))
    asked = asked.select("*", parts).select("*", at.alias("at"), size.alias("size"), (F.col("n") - F.col("length")).alias("more"))
    before, after = F.col("part"), F.lit(edits) - F.col("part")
    low = F.greatest(F.lit(0), F.col("at") - before, F.col("at") + F.col("more") - after)
    high = F.least(F.col("n") - F.col("size"), F.col("at") + before, F.col("at") + F.col("more") + after)
    asked = asked.select("*", low.alias("low"), high.alias("high")).filter("low <= high").select("*", F.explode(F.sequence("low", "high")).alias("start"))
    asked = asked.select("kind", "block", "length", "part", F.substring("word", F.col("start") + 1, F.col("size")).alias("piece"), F.col("word").alias("bw"))
    met = index.join(asked, ["kind", "block", "length", "part", "piece"]).filter(F.levenshtein("aw", "bw", edits) >= 0)
    return met.select("kind", "block", "aw", "bw").distinct()


def _met(forms: DataFrame) -> DataFrame:
    """(a, b, kind): spellings of two forms with a key word within EDITS edits and the same other initials."""
    keyed = forms.select("kind", "rep", F.inline("keys"))
    near_by = near_words(keyed.select("kind", "block", "word").distinct())
    one = keyed.select("kind", "block", F.col("word").alias("aw"), F.col("rep").alias("x"))
    two = keyed.select("kind", "block", F.col("word").alias("bw"), F.col("rep").alias("y"))
    met = near_by.join(one, ["kind", "block", "aw"]).join(two, ["kind", "block", "bw"]).filter("x <> y and (aw <> bw or x < y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind").distinct()


def candidate_names(names: DataFrame) -> DataFrame:
    """(a, b, kind): `names` (name, kind) that may be one's; names that parse alike are met by the smallest of them."""
    return _met(_forms(names.mapInPandas(_parsed, _PARSED)))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs that can be one's; a_full, b_full: that name is written out."""
    for batch in batches:
        keep, a_full, b_full = [], [], []
        for a, b, kind in zip(batch["a"], batch["b"], batch["kind"]):
            x, y = _PARSE[kind](a), _PARSE[kind](b)
            keep.append(same_person(x, y) if kind == "PERSON" else same_organisation(x, y))
            a_full.append(kind == "ORG" or len(x["words"]) >= 2)
            b_full.append(kind == "ORG" or len(y["words"]) >= 2)
        yield batch.assign(a_full=a_full, b_full=b_full)[keep]


def linked_names(triples: DataFrame) -> DataFrame:
    """(name, entity): the names of which another spelling stands in `triples`, and their entity.

    The entity is the smallest of its spellings. Forms with initials or one
    word only, and acronyms, join an entity if it is the only one they can stand for; initials-only forms that can
    stand for none are linked among themselves. Names without another spelling are left out.
    """
    parsed = cut(names_of(triples).mapInPandas(_parsed, _PARSED))
    forms = _forms(parsed)
    members = cut(parsed.join(forms.select("kind", "form", "rep"), ["kind", "form"]).select("rep", "name", "written"))
    pairs = cut(_met(forms).mapInPandas(_compare, "a string, b string, kind string, a_full boolean, b_full boolean"))
    alike = members.filter("rep <> name").select(F.col("rep").alias("a"), F.col("name").alias("b"), "written")
    entities = cut(components(pairs.filter("a_full and b_full").select("a", "b").unionByName(alike.filter("written").select("a", "b"))))

    def ends(standing: DataFrame, by: str) -> DataFrame:
        """The least and the greatest entity that each value of `by` can stand for; a name of no entity is its own."""
        entity = F.coalesce("root", "b")
        return standing.join(entities, standing["b"] == entities["node"], "left").groupBy(by).agg(F.min(entity).alias("low"), F.max(entity).alias("high"))

    bare = pairs.filter("a_full and not b_full").select(F.col("b").alias("rep"), F.col("a").alias("b")).unionByName(
        pairs.filter("b_full and not a_full").select(F.col("a").alias("rep"), "b")
    )
    letters = parsed.filter("given <> 'PERSON' and letters is not null").select("name", "letters", "acronym")
    shorts = letters.filter("acronym").select(F.col("name").alias("a"), "letters")
    longs = letters.filter("not acronym").select(F.col("name").alias("b"), "letters")
    persons = parsed.filter("given = 'PERSON'").select("name", "words", "written")
    only = persons.filter("not written and size(words) = 1").select(F.col("name").alias("a"), F.col("words")[0].alias("word"))
    among = persons.filter("written").select(F.col("name").alias("b"), F.explode("words").alias("word"))
    stands = cut(
        ends(bare, "rep").join(members.filter("not written"), "rep").select(F.col("name").alias("a"), "low", "high")
        .unionByName(shorts.join(ends(longs, "letters"), "letters").select("a", "low", "high"))
        .unionByName(only.join(ends(among, "word"), "word").select("a", "low", "high"))
        .groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    one = stands.filter("low = high").select("a", F.col("low").alias("b"))
    open_ends = pairs.filter("not a_full and not b_full").select("a", "b").unionByName(alike.filter("not written").select("a", "b"))
    rest = open_ends.join(stands.select("a"), "a", "left_anti").join(stands.select(F.col("a").alias("b")), "b", "left_anti")
    same_letters = shorts.groupBy("letters").agg(F.min("a").alias("b")).join(shorts, "letters").filter("a <> b").select("a", "b")
    known = entities.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    all_edges = known.unionByName(one).unionByName(rest.select("a", "b")).unionByName(same_letters)
    return components(all_edges).select(F.col("node").alias("name"), F.col("root").alias("entity"))


def found(triples: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different spellings of one entity, name_a < name_b.

    The pairs are those of one entity's spellings, as asked for; an entity has few, however
    many rows it has.
    """
    linked = cut(linked_names(triples))
    other = linked.select(F.col("name").alias("name_b"), "entity")
    return linked.select(F.col("name").alias("name_a"), "entity").join(other, "entity").filter("name_a < name_b").select("name_a", "name_b")
