"""Text expressions. All map null to null; patterns spell out their boundaries, so that they mean the same in any engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning of their own.
STOP_WORDS = "the a an of and or with on in to for by is are when if its their than that each at be".split()
# What sentences say about their own work, by signal; words by which they speak of it, and by which they deny it;
# the heading of a reference list. They must equal those whose results are matched.
SIGNALS = {
    "out_of_sample": r"out(-\s?| )of(-\s?| )sample|walk(-\s?| )forward|hold[- ]?out (period|sample|set)|held[- ]out (period|sample|data|set)|test (period|sample|set)",
    "costs_considered": r"transaction costs?|trading costs?|slippage|bid[- ]ask|commissions?",
    "code_available": r"github\.com|source code|code is (publicly )?available|replication (code|package)",
    "sample_period": r"\b(19|20)\d\d\s?(-|–|to|through|until)\s?(19|20)\d\d\b",
    "cross_market": r"\binternational ((stock|equity|bond) )?(markets|samples?|evidence|data)\b|across (\w+ )?(countries|markets|asset classes|exchanges)|\b\d+ (countries|markets|asset classes|exchanges)\b",
}
OWN_WORK = r"\b(we|our|this (paper|study|article|work|note|analysis))\b"
NOT_DONE = r"\b(no|not|never|avoid\w*|ignor\w*|neglect\w*|exclud\w*|future (research|work|studies)|beyond the scope|left for)\b"
REFERENCE_LIST = r"(?im)^\s*(?:references|bibliography|literature cited)\s*$"
# Phrases that address a model's instructions.
INJECTIONS = (
    r"ignore (all |any )?(the )?(previous|prior|above) (instructions|prompts|messages)",
    r"disregard (all |any )?(the )?(previous|prior|above|system)",
    r"forget (all |your )?(previous |prior )?instructions",
    r"you are now (a|an|the) ",
    r"new (system )?instructions?:",
    r"(reveal|print|show|output) (your|the) (system prompt|instructions|api key|credentials|secrets?)",
    r"(run|execute) (the following|this) (command|code|script)",
    r"<\s*/?\s*(system|assistant)\s*>",
    r"\bBEGIN (SYSTEM|ADMIN) PROMPT\b",
    r"(disable|turn off|bypass) (the )?(safety|guardrails|rate limits?|restrictions)",
    r"\b(you (must|should|need to|will|have to)|please|now|immediately) (place|submit|execute) (a |the |some )?(live )?(trade|order)s?\b",
)


def bounded(pattern: str) -> str:
    r"""``pattern`` with its word boundaries spelt out, so that they part ASCII letters, digits and _ from all else in any
    version of the engine, whatever it takes \b to mean."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, also where ``use`` refers to it several times or inside a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def without_references(text: Column) -> Column:
    """``text`` up to its list of references, which is other people's work."""
    return F.get(F.split(text, REFERENCE_LIST, 2), F.lit(0))


def sentences(text: Column) -> Column:
    """Array of sentences: cut behind an end mark and blanks, before a capital, bracket or parenthesis."""
    marked = F.regexp_replace(collapse(text), r"([.!?]) +([A-Z(\[])", "$1\x01$2")
    return F.split(marked, "\x01")


def signals_of(sentence: Column, lexicon: dict[str, str]) -> Column:
    """Sorted names of the lexicon entries that ``sentence`` matches, case ignored."""
    low = F.lower(sentence)
    return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(bounded(rx)), F.lit(name)) for name, rx in lexicon.items()])))


def word_set(text: Column) -> Column:
    """Distinct ASCII words without stop words, sorted, joined by a blank: equal for texts of the same words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)
    keep = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.array_join(F.array_sort(F.array_distinct(keep)), " ")


def glued_share(text: Column, longest: int = 24) -> Column:
    """Share of letters that stand in words longer than ``longest``: high where blanks were lost."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z]+)"), 1)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    glued = F.aggregate(F.filter(words, lambda w: F.length(w) > longest), F.lit(0), lambda a, w: a + F.length(w))
    return F.when(total > 0, glued / total).otherwise(F.lit(0.0))


def location_label(page: Column, slide: Column, section: Column, sheet: Column, item: Column) -> Column:
    """'p.3, § Results, ...' of the parts that are set; 'document' where none is."""
    parts = F.concat_ws(", ", F.concat(F.lit("p."), page), F.concat(F.lit("slide "), slide), F.concat(F.lit("§ "), F.nullif(section, F.lit(""))), F.concat(F.lit("sheet "), F.nullif(sheet, F.lit(""))), F.nullif(item, F.lit("")))
    return F.when(parts == "", "document").otherwise(parts)


def injection_phrases(text: Column) -> Column:
    """Sorted distinct phrases that address the reader's instructions, in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)(" + "|".join(INJECTIONS) + ")"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.lower(F.trim(p)))))
