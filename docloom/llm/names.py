"""Linking of the spellings under which people type one author's name.

Spellings are first brought to parts: family name, given name, initials; for organisations head and field words. Spellings
with equal parts are one node, so no pairs arise within a group of copies, and a family name is one row however many
spellings hold it. Typing errors are found among the distinct family and given names by MinHash banding over padded
q-grams, the number of bands taken from the collision curve for the wanted recall; the spellings that they lead to are
verified by the Monge-Elkan similarity of all their parts, and star clustering joins each to the most used one near it. Initials and
nicknames join the one author that they fit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.tables import materialize, written

# Bylines that name nobody, titles and suffixes, particles of family names, legal forms.
NOBODY = "staff|editorial desk|editor|editors|editorial|editorial team|editorial staff|admin|administrator|newsroom|news desk|team|the team|redaktion|redacción|rédaction|unknown|anonymous|n/a|none|guest|guest author|webmaster|author|various|press office|research desk|markets desk|contributor|staff writer".split("|")
TITLES = set("dr prof professor phd cfa frm msc mba bsc dphil jr sr ii iii iv esq cpa caia fca dipl ing".split())
ADDRESS = set("mr mrs ms sir dame herr frau mme".split())
PARTICLES = set("van von der den de la di da del della du le ten ter zu zur dos das el al bin".split())
LEGAL = set("gmbh ltd llc inc ag sa plc bv nv kg corp co limited spa srl pty llp".split())
ORG_TYPES = set("institute inst laboratory laboratories lab labs department dept association assoc foundation fdn group grp partners ptnrs partnership university univ college centre center school society council committee bank fund company corporation consortium agency office bureau academy".split())
ORG_WORDS = ORG_TYPES | set("research res analytics anal economics econ strategy strat strategies trading trad investment investments inv market markets mkt mkts macro derivatives deriv quantitative quant financial fin finance commodity commodities comm portfolio portf systematic syst capital management asset of the and for".split())
# Given names and their everyday short forms.
NICKNAMES = """
abigail abby abbie gail|alexander alex al sandy xander sasha|alexandra alex sandra sandy sasha lexi|amanda mandy|andrew andy drew|anthony tony|
barbara barb babs|benjamin ben benny benji|catherine cathy kate katie cat|charles charlie chuck chas|christina chris tina|
christopher chris kit|cynthia cindy|daniel dan danny|david dave davy|deborah deb debbie|donald don|dorothy dot|edward ed eddie ned ted teddy|
elizabeth liz beth betty lizzie eliza betsy bess|eugene gene|frances fran|francis frank|frederick fred freddie|gabriel gabe|gerald gerry jerry|
gregory greg|harold hal harry|henry hank harry|jacob jake|james jim jimmy jamie|janet jan|jeffrey jeff|jennifer jen jenny|jessica jess jessie|
john jack johnny|jonathan jon jonny|joseph joe joey|joshua josh|judith judy|katherine kate kathy katie kat kay|kenneth ken kenny|
lawrence larry laurie|leonard len leo|margaret maggie meg peggy|martha marty|matthew matt|michael mike mick mickey|nathaniel nat|
nicholas nick nicky|pamela pam|patricia pat patty trish tricia|patrick pat paddy rick|peter pete|philip phil|raymond ray|
rebecca becky becca|richard rich rick dick richie|robert rob bob bobby robbie|ronald ron|samuel sam sammy|stephen steve stevie|
steven steve|susan sue susie suzy|theodore ted teddy theo|thomas tom tommy|timothy tim timmy|victoria vicky vicki tori|vincent vince vinny|
walter walt|william bill billy will willy liam|zachary zach|nadia nadi|dmitri dima mitya|sofia sofi|giulia giuli|agnieszka aga|
matteo teo|marie mimi|oscar ossie|olga olya|irina ira|pavel pasha|jose pepe|pedro perico|lucia lucy|hans hansi|jurgen jurg|ingrid inga
"""
Q, ROWS = 2, 3
SAME_SPELLING = 0.9  # from this Monge-Elkan similarity of all parts on two spellings are one name's
NAME_SCHEMA = "text string, n long, kind string, fixed boolean, given array<string>, family array<string>, initials array<string>, hyphen boolean, tokens array<string>"
PART_SCHEMA = "text string, n long, kind string, s string, g string, i string, hy string, m string"
PAIR_SCHEMA = "a string, b string"


def nickname_table() -> dict[str, list[str]]:
    """Full given names of each short form."""
    table: dict[str, list[str]] = {}
    for entry in NICKNAMES.replace("\n", "").split("|"):
        full, *short = map(fold, entry.split())
        for nick in short:
            table.setdefault(nick, []).append(full)
    return table


def fold(text: str) -> str:
    """Lower-case letters without marks."""
    if text.isascii():
        return "".join(filter(str.isalnum, text.lower()))
    text = text.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d").replace("ı", "i")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^\w]|_", "", text)


GLUED = re.compile(r"\b((?:van|von|der|den|de|la|di|da|del)+)(?=[A-ZÀ-Þ])")
LETTER, SPACES, SIGNS = re.compile(r"[^\W\d_]"), re.compile(r"[\s,]+"), re.compile(r"[^\w]")
INITIALS, APOSTROPHE = re.compile(r"(?:[^\W\d_]\.?-?){1,3}"), re.compile(r"^[oOdD]['’]\w")


def _bare(word: str) -> str:
    return word.lower() if word.isalnum() else SIGNS.sub("", word).lower()


def parse_name(text: str) -> dict | None:
    """The parts of one spelling, or None where it names nobody. ``fixed`` is False where the order of names is open."""
    s = " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())
    if s[:3].lower() == "by ":
        s = s[3:]
    s = GLUED.sub(lambda m: "van " if m[1].islower() else m[0], s)
    if "@" in s:
        if m := re.match(r"^\S+@\S+ ?[(<\[](.+)[)>\]]$", s):
            s = m[1]
        s = re.sub(r"<?\S+@\S+>?", "", s)
    if "(" in s or "[" in s:
        s = re.sub(r"\s*[(\[].*?[)\]]\s*", " ", s)
    s = s.strip(" ,;")
    if not s or s.lower() in NOBODY or not LETTER.search(s):
        return None
    words = [w for w in SPACES.split(s) if w]
    bare = [_bare(w) for w in words]
    if sum(b in ORG_TYPES or (b in LEGAL and len(b) > 2) for b in bare) or sum(b in ORG_WORDS for b in bare) >= 2:
        kept = [w for w, b in zip(words, bare, strict=True) if b and b not in LEGAL and b not in ("the", "of", "and", "for")]
        low = [re.sub(r"[^\w]", "", w).lower() for w in kept]
        if not kept:
            return None
        inverted = re.match(r"^(?:the )?\w+ of .+,\s*\S", s, re.I)
        at = len(kept) - 1 if inverted else next((k for k, w in enumerate(low) if w not in ORG_WORDS and len(w) > 2 and not kept[k].endswith(".")), 0)
        fields = [w for k, w in enumerate(low) if k != at and w not in ORG_TYPES]
        return {"kind": "org", "fixed": True, "given": [], "family": [fold(kept[at])], "initials": [w[0] for w in fields[:2]], "hyphen": False, "tokens": [fold(w) for w in kept]}
    out = {"kind": "person", "fixed": True, "given": [], "family": [], "initials": [], "hyphen": False, "tokens": []}
    clean = lambda t: [w for k, w in enumerate(t.split()) if (low := _bare(w)) not in TITLES and not (k == 0 and low in ADDRESS and t.count(" ") > 1)]
    pieces = [p for p in (clean(x) for x in s.split(",")) if p]
    if not pieces:
        return None

    def is_initials(w: str) -> bool:
        return bool(INITIALS.fullmatch(w)) and ("." in w or len(w) == 1 or (w.isupper() and len(w) <= 3 and not s.isupper()))

    def take(words: list[str], to: dict) -> list[str]:
        """The full words of a given-name part; its initials go to ``to``."""
        full = []
        for w in words:
            if is_initials(w):
                to["hyphen"] |= "-" in w
                to["initials"] += [fold(c) for c in LETTER.findall(w)]
            else:
                full.append(w)
        return full

    if len(pieces) > 1:
        out["family"] = [fold(w) for w in pieces[0] if w.lower() not in PARTICLES]
        out["given"] = [fold(w) for w in take([w for p in pieces[1:] for w in p if w.lower() not in PARTICLES], out)]
    else:
        words = pieces[0]
        kinds = ["i" if is_initials(w) else "p" if w.lower() in PARTICLES or APOSTROPHE.match(w) else "w" for w in words]
        if "i" in kinds and "w" in kinds + ["w"] * kinds.count("p"):
            first, last = kinds.index("i"), len(kinds) - 1 - kinds[::-1].index("i")
            if last == len(words) - 1:  # Family F. M.
                out["family"] = [fold(w) for w in words[:first] if w.lower() not in PARTICLES]
                take(words[first:], out)
            else:
                given = words[: last + 1]
                out["given"] = [fold(w) for w in take(given, out)]
                out["family"] = [fold(w) for w in words[last + 1 :] if w.lower() not in PARTICLES]
        elif "p" in kinds and len(words) > 1:
            k = kinds.index("p")
            if k:
                out["given"], out["family"] = [fold(w) for w in words[:k]], [fold(w) for w in words[k:] if w.lower() not in PARTICLES]
            else:
                end = next((j + 1 for j, x in enumerate(kinds) if x == "w" or re.match(r"^[oOdD]['’]", words[j])), len(words))
                out["family"], out["given"] = [fold(w) for w in words[:end] if w.lower() not in PARTICLES], [fold(w) for w in words[end:]]
        else:
            out["fixed"] = len(words) == 1
            out["family"] = [fold(w) for w in words]
    out["given"], out["family"] = [w for w in out["given"] if w], [w for w in out["family"] if w]
    out["tokens"] = out["family"] if not out["fixed"] else out["given"] + out["family"]
    return out if out["family"] else None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, n in zip(pdf["text"], pdf["n"], strict=True):
            if p := parse_name(text):
                rows.append((text, n, p["kind"], p["fixed"], p["given"], p["family"], p["initials"], p["hyphen"], p["tokens"]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in NAME_SCHEMA.split(", ")])


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide which words are the family name where the order is open, by how often each word is either."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            given, family = list(r.given), list(r.family)
            if not r.fixed and len(family) > 1:
                # as_given counts a word's family names, as_family its given names: the more, the surer.
                lean = {x["pos"]: math.log((x["as_given"] + 0.5) / (x["as_family"] + 0.5)) for x in r.roles} if r.roles is not None else {}
                lean = [lean.get(k, 0.0) for k in range(len(family))]
                total, best, words = sum(lean), -math.inf, family
                for cut in range(1, len(words)):
                    front = sum(lean[:cut])
                    for score, g, f in ((2 * front - total + 0.7, words[:cut], words[cut:]), (total - 2 * front, words[cut:], words[:cut])):
                        if score > best:
                            best, given, family = score, g, f
            g, s, init = "".join(given), "".join(family), list(r.initials)
            hy = "".join(init[:2]) if r.hyphen and not g else ""
            middle = init[2:3] if hy else init[:1] if g else init[1:2]
            if r.kind == "org":
                g, init, middle = "".join(init) or "-", [], []
            rows.append((r.text, r.n, r.kind, s, g, g[:1] if g else (init[0] if init else ""), hy, middle[0] if middle else ""))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PART_SCHEMA.split(", ")])


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands that the collision curve 1 - (1 - s^rows)^bands needs for ``recall`` at ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def qgrams(word: str, q: int = Q) -> set[str]:
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    return {padded[k : k + q] for k in range(len(padded) - q + 1)}


def _minhash(batches: Iterator[pd.DataFrame], bands: int, rows: int) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(17)
    mul = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)
    mix = rng.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = np.arange(bands, dtype=np.int64)
    for pdf in batches:
        if not len(pdf):
            continue
        keys = np.empty((len(pdf), bands), np.int64)
        for k, word in enumerate(pdf["word"]):
            h = np.array([xxhash.xxh3_64_intdigest(g) for g in qgrams(word)], np.uint64)
            x = h[:, None] * mul + add
            low = (x ^ (x >> np.uint64(31))).min(axis=0).reshape(bands, rows)
            keys[k] = ((low * mix).sum(axis=1) ^ ((low * mix).sum(axis=1) >> np.uint64(33))).view(np.int64)
        yield pd.DataFrame({"kind": np.repeat(pdf["kind"].to_numpy(), bands), "word": np.repeat(pdf["word"].to_numpy(), bands), "weight": np.repeat(pdf["weight"].to_numpy(), bands), "band": np.tile(band, len(pdf)), "key": keys.ravel()})


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance with neighbouring letters exchanged as one edit; above ``most`` it is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            nxt.append(d)
        before, row = row, nxt
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    right = [y for y, u in zip(b, used, strict=True) if u]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter name of their best Jaro-Winkler similarity; an initial fits its word."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    fit = lambda x, y: 1.0 if min(len(x), len(y)) == 1 and x[0] == y[0] else jaro_winkler(x, y)
    return sum(max(fit(x, y) for y in b) for x in a) / len(a)


def _verified(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs of whole spellings (their parts, given name first) that Monge-Elkan similarity holds for one name. An
    organisation's field letters stand in the given name's place."""
    for pdf in batches:
        parts = zip(pdf["a_g"], pdf["a_s"], pdf["b_g"], pdf["b_s"], strict=True)
        keep = [monge_elkan([g, s], [h, t]) >= similarity for g, s, h, t in parts]
        yield pdf[keep]


def deletions(word: Column) -> Column:
    """The word and what remains of it without each of its letters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def error_similarity(length: int, q: int = Q) -> float:
    """Jaccard similarity of the padded q-grams of a word of ``length`` letters and itself with two letters exchanged, the
    typing error that costs most q-grams."""
    grams = length + q - 1
    return max(grams - q - 1, 0) / (grams + q + 1)


def similar_words(words: DataFrame, recall: float = 0.99, shortest: int = 6, largest: int = 200) -> DataFrame:
    """Pairs (kind, a, b) of distinct words one typing error apart, a the one of less weight.

    ``words``: kind, word, weight. Words of ``shortest`` letters or more are banded, each length with as many bands as the
    collision curve asks for ``recall`` at its error_similarity. Words up to that length, whose q-grams an error changes
    nearly all, and the words of buckets above ``largest`` are compared by what remains when one letter is left out, which
    finds every pair one edit apart and costs each word its length. Words of one or two letters have no errors: one letter
    more or less makes another word of them.
    """
    bands_of = {length: bands_for(error_similarity(length), recall) for length in range(shortest, 25)}
    most = max(bands_of.values())
    schema = "kind string, word string, weight long, band long, key long"
    words = words.select("kind", "word", "weight")
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in bands_of.items() for x in kv]), F.least(F.length("word"), F.lit(24)))
    signed = words.where(F.length("word") >= shortest).mapInPandas(lambda b: _minhash(b, most, ROWS), schema).where(F.col("band") < wanted)
    # The size of each bucket stands beside its words, so that the table is read once for small and large ones.
    signed = written(signed.withColumn("size", F.count("*").over(Window.partitionBy("kind", "band", "key"))).where("size > 1"))
    small = signed.where(F.col("size") <= largest)
    side = lambda df, p: df.select("kind", *[c for c in ("band", "key", "rest") if c in df.columns], F.col("word").alias(p), F.col("weight").alias(f"w{p}"))
    lighter = (F.col("wa") < F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") > F.col("b")))
    # One letter changed, added or left out, or two neighbours exchanged.
    at = F.length(F.regexp_extract(F.concat("a", F.lit("\x01"), "b"), r"^(.*).*\x01\1", 1)) + 1
    swapped = (F.length("a") == F.length("b")) & (F.concat(F.substring("a", F.lit(1), at - 1), F.substring("a", at + 1, F.lit(1)), F.substring("a", at, F.lit(1)), F.substring("a", at + 2, F.length("a"))) == F.col("b"))
    one_error = (F.levenshtein("a", "b", 1) >= 0) | swapped
    pairs = side(small, "a").join(side(small, "b"), ["kind", "band", "key"]).where(lighter & one_error).select("kind", "a", "b")
    rest = words.where(F.length("word").between(3, shortest)).unionByName(signed.where(F.col("size") > largest).select("kind", "word", "weight")).distinct().withColumn("rest", F.explode(deletions(F.col("word"))))
    more = side(rest, "a").join(side(rest, "b"), ["kind", "rest"]).where(lighter & one_error).select("kind", "a", "b")
    return pairs.unionByName(more).distinct()


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, center): each node's star. ``nodes``: node, rank (higher first, no ties); ``edges``: a, b, ra, rb with the
    ranks of both ends, given both ways.

    A node without an unassigned neighbour of higher rank becomes a center and takes its unassigned neighbours, until no
    edge has two unassigned ends; every round assigns the node of highest rank at least, so it ends.
    """
    live, done = materialize(edges.distinct()), None
    while live.take(1):
        centers = live.groupBy("a").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb")).where("ra > rb").select(F.col("a").alias("center"))
        reached = live.join(centers, live.a == centers.center).groupBy("b").agg(F.max_by("a", "ra").alias("center"))
        found = materialize(reached.withColumnRenamed("b", "node").unionByName(centers.select(F.col("center").alias("node"), "center")))
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("node").alias("gone"))
        live = materialize(live.join(gone, live.a == gone.gone, "left_anti").join(gone, live.b == gone.gone, "left_anti"))
    if done is None:
        return nodes.select("node", F.col("node").alias("center"))
    return nodes.select("node").join(done, "node", "left").select("node", F.coalesce("center", "node").alias("center"))


def name_parts(authors: DataFrame) -> DataFrame:
    """The parts of every distinct spelling in column ``text`` (one row a mention); see PART_SCHEMA."""
    spelled = authors.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n"))
    parsed = materialize(spelled.mapInPandas(_parse, NAME_SCHEMA))
    person = parsed.where("kind = 'person'")
    half = lambda c: F.explode(F.transform(c, lambda t: F.struct(t.alias("token"))))
    sure = person.where("fixed")
    given = sure.select(half(F.col("given")).alias("x"), F.array_join("family", "").alias("other")).select("x.token", "other", F.lit(1.0).alias("g"), F.lit(0.0).alias("s"))
    family = sure.select(half(F.col("family")).alias("x"), F.array_join("given", "").alias("other")).select("x.token", "other", F.lit(0.0).alias("g"), F.lit(1.0).alias("s"))
    open_ = person.where("NOT fixed AND size(family) > 1")
    first = open_.select(F.element_at("family", 1).alias("token"), F.element_at("family", -1).alias("other"), F.lit(0.5).alias("g"), F.lit(0.0).alias("s"))
    last = open_.select(F.element_at("family", -1).alias("token"), F.element_at("family", 1).alias("other"), F.lit(0.0).alias("g"), F.lit(0.5).alias("s"))
    evidence = given.unionByName(family).unionByName(first).unionByName(last).groupBy("token", "other").agg(F.max("g").alias("g"), F.max("s").alias("s"))
    roles = evidence.groupBy("token").agg(F.sum("g").alias("as_given"), F.sum("s").alias("as_family"))
    words = open_.select("text", F.posexplode("family").alias("pos", "token")).join(roles, "token").groupBy("text").agg(F.collect_list(F.struct("pos", "as_given", "as_family")).alias("roles"))
    return parsed.join(words, "text", "left").mapInPandas(_place, PART_SCHEMA)


def author_clusters(authors: DataFrame) -> DataFrame:
    """(text, author): the author id of each distinct spelling in column ``text`` of ``authors``, one row a mention.

    Spellings that differ only in spacing or case are different texts of one author. Nulls, empty texts and bylines that
    name nobody give no row; repeated mentions only add weight; an empty table gives no rows; other columns are ignored.
    Initials that fit several authors of a family name stay alone.
    """
    parts = materialize(name_parts(authors))
    node = F.xxhash64("kind", "s", "g")
    nodes = parts.where("g <> ''").groupBy("kind", "s", "g").agg(F.sum("n").alias("n"))
    nodes = materialize(nodes.select("kind", "s", "g", node.alias("node"), F.struct("n", F.length("g").alias("len"), node.alias("node")).alias("rank")))

    # Family names (and heads of organisations) and given names one error apart, in one pass over their words.
    s_words = parts.groupBy(F.concat(F.lit("s-"), "kind").alias("kind"), F.col("s").alias("word")).agg(F.sum("n").alias("weight"))
    g_words = nodes.where("kind = 'person'").groupBy(F.lit("g-person").alias("kind"), F.col("g").alias("word")).agg(F.count("*").alias("weight"))
    near = materialize(similar_words(s_words.unionByName(g_words)).groupBy("kind", "a").agg(F.collect_list("b").alias("near")))

    # What each node may be a spelling of, looked up among the nodes.
    s_near = near.select(F.substring("kind", 3, 6).alias("kind"), F.col("a").alias("s"), F.col("near").alias("s_near")).where("kind <> 'g-person'")
    g_near = near.where("kind = 'g-person'").select(F.lit("person").alias("kind"), F.col("a").alias("g"), F.col("near").alias("g_near"))
    short = F.create_map(*[x for k, v in nickname_table().items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    none = F.array().cast("array<string>")
    plain = lambda c: F.regexp_replace(c, "([aou])e", "$1")
    wide = nodes.join(s_near, ["kind", "s"], "left").join(g_near, ["kind", "g"], "left")
    fulls = F.when(F.col("kind") == "person", F.coalesce(F.element_at(short, F.col("g")), none)).otherwise(none)
    made = lambda how, arr, f: F.transform(F.coalesce(arr, none), lambda x: F.struct(F.lit(how).alias("how"), *f(x)))
    targets = F.concat(
        made("family", F.col("s_near"), lambda x: (x.alias("s"), F.col("g").alias("g"))),
        made("given", F.col("g_near"), lambda x: (F.col("s").alias("s"), x.alias("g"))),
        made("short", fulls, lambda x: (F.col("s").alias("s"), x.alias("g"))),
        F.array(F.struct(F.lit("vowel").alias("how"), plain("s").alias("s"), plain("g").alias("g"))),
    )
    wanted = wide.select("kind", F.col("node").alias("a"), F.col("rank").alias("ra"), F.col("s").alias("a_s"), F.col("g").alias("a_g"), F.explode(targets).alias("t")).select("kind", "a", "ra", "a_s", "a_g", "t.*")
    known = nodes.select("kind", "s", "g", F.col("node").alias("b"), F.col("rank").alias("rb"))
    edges = wanted.join(known, ["kind", "s", "g"]).where("a <> b").select("a", "ra", "how", "b", "rb", "a_s", "a_g", F.col("s").alias("b_s"), F.col("g").alias("b_g"))
    edges = written(edges.distinct())  # small, and read four times
    # A given name in wide use by itself is no error of a near one: an error stands where the right spelling does, with most of
    # its family names. Short forms count where they fit one name only. What is left is verified as whole spellings.
    spread = nodes.where("kind = 'person'").groupBy(F.col("g").alias("a_g")).agg(F.count("*").alias("families"))
    beside = edges.where("how = 'given'").groupBy("a_g", "b_g").agg(F.count_distinct("a").alias("both")).join(spread, "a_g").where(F.col("both") * 2 >= F.col("families")).select("a_g", "b_g")
    given = edges.where("how = 'given'").join(beside, ["a_g", "b_g"]).select(*edges.columns)
    single = edges.where("how = 'short'").withColumn("n", F.size(F.collect_set("b").over(Window.partitionBy("a")))).where("n = 1").drop("n")
    errors = edges.where("how IN ('family', 'vowel')").unionByName(given).mapInPandas(lambda b: _verified(b, SAME_SPELLING), edges.schema)
    edges = errors.unionByName(single).select("a", "ra", "b", "rb")
    edges = edges.select(F.explode(F.array(F.struct("a", "b", "ra", "rb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rb").alias("ra"), F.col("ra").alias("rb")))).alias("e")).select("e.*")
    stars = star_clusters(nodes, edges)
    compound = F.regexp_extract(F.lower("text"), r"(\p{L})\p{L}+[-‐‑]\p{L}\p{L}+", 1)
    second = F.regexp_extract(F.lower("text"), r"\p{L}\p{L}+[-‐‑](\p{L})\p{L}+", 1)
    full = materialize(parts.where("g <> ''").withColumn("node", node).join(stars, "node").select("text", "kind", "s", "g", "i", "m", F.concat(compound, second).alias("hy"), F.col("center").alias("author")))

    # Initials join the one author whom they fit: compound or middle initial first, then any, then the family name corrected.
    key = lambda *c: F.concat_ws("|", *[F.lit(x) if x in ("org", "h", "m", "") else F.col(x) for x in c])
    person = F.col("kind") == "person"
    keys = F.array_compact(F.array(F.when(~person, key("s", "org", "g")), F.when(person, key("s", "i", "")), F.when(person & (F.col("m") != ""), key("s", "i", "m", "m")), F.when(person & (F.col("hy") != ""), key("s", "i", "h", "hy"))))
    fits = full.select(F.explode(keys).alias("key"), "author").groupBy("key").agg(F.min("author").alias("author"), F.max("author").alias("other"))
    fits = fits.select("key", F.when(F.col("author") == F.col("other"), F.col("author")).alias("fit"))
    rest = parts.where("g = ''").select("text", "kind", "s", "i", "hy", "m").join(s_near, ["kind", "s"], "left")
    acronym = F.col("text").rlike(r"\s\p{Lu}{3}\s*$")  # three capitals: an organisation's fields and type
    at = lambda order, k: F.struct(F.lit(order).alias("order"), k.alias("key"))
    asked = F.concat(
        F.array(
            at(0, F.when(acronym, F.concat_ws("|", "s", F.lit("org"), F.concat("i", "m")))), at(1, F.when(F.col("hy") != "", key("s", "i", "h", "hy"))),
            at(2, F.when(F.col("m") != "", key("s", "i", "m", "m"))), at(3, key("s", "i", "")),
        ),
        F.transform(F.coalesce("s_near", none), lambda x: at(4, F.concat_ws("|", x, F.col("i"), F.lit("")))),
    )
    alone = F.xxhash64("kind", "s", "i", "hy", "m")
    asked = rest.select("text", alone.alias("alone"), F.explode(asked).alias("q")).select("text", "alone", "q.*").join(fits, "key", "left")
    chosen = asked.groupBy("text", "alone").agg(
        F.min_by("fit", F.when(F.col("fit").isNotNull() & (F.col("order") < 4), F.col("order"))).alias("own"),
        F.count_if((F.col("order") == 3) & F.col("fit").isNotNull()).alias("any"),
        F.min(F.when(F.col("order") == 4, F.col("fit"))).alias("low"),
        F.max(F.when(F.col("order") == 4, F.col("fit"))).alias("high"),
    )
    corrected = F.when((F.col("any") == 0) & (F.col("low") == F.col("high")), F.col("low"))
    return full.select("text", "author").unionByName(chosen.select("text", F.coalesce("own", corrected, "alone").alias("author")))


def spelling_pairs(clusters: DataFrame) -> DataFrame:
    """Every pair name_a < name_b of one author's spellings, by code point."""
    a, b = clusters.select("author", F.col("text").alias("name_a")), clusters.select("author", F.col("text").alias("name_b"))
    return a.join(b, "author").where("name_a < name_b").select("name_a", "name_b").distinct()
