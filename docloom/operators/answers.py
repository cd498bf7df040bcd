"""Values that a model took from a text: read tolerantly from its answer, and kept only where the text bears them out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.grounding import Page, figures, plain

UNKNOWN = "UNKNOWN"
VALUE = "struct<field:string,value:string,quote:string,confidence:double>"
KEPT_SCHEMA = "text_id long, field string, value string, quote string, reason string"


def clamped(number: Column) -> Column:
    """A share as a number between 0 and 1; what is none is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(number.try_cast("double"), F.lit(0.0)), F.lit(0.0))))


def one_of(value: Column, allowed: list[str]) -> Column:
    """The allowed name that ``value`` is, case ignored, else UNKNOWN."""
    name = F.upper(F.trim(value.cast("string")))
    return F.when(name.isin(*allowed), name).otherwise(UNKNOWN)


def all_of(values: Column, allowed: list[str]) -> Column:
    """The different allowed names of a list in their order; others are left out, and null gives none."""
    names = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.upper(F.trim(v)))
    return F.array_distinct(F.filter(names, lambda v: F.coalesce(v.isin(*allowed), F.lit(False))))


def read_values(answer: Column) -> Column:
    """array<VALUE> of an answer, a JSON object of field to {value, evidence_quote, confidence}; null where it is no JSON.

    Values that are null, blank or no text are UNKNOWN; numbers and lists are read as their JSON text.
    """
    fields = F.from_json(answer, "map<string,struct<value:string,evidence_quote:string,confidence:string>>")
    value = lambda v: F.coalesce(F.nullif(F.trim(v["value"]), F.lit("")), F.lit(UNKNOWN))
    return F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.struct(e["key"].alias("field"), value(e["value"]).alias("value"), e["value"]["evidence_quote"].alias("quote"), clamped(e["value"]["confidence"]).alias("confidence")))


def bears_out(page: Page, numbers: frozenset[str], field: str, value: str | None, quote: str | None, claims: frozenset[str] = frozenset()) -> tuple[str, str | None, str | None]:
    """(value, quote, reason): the value where the page bears it out, else UNKNOWN and why.

    The quote must be in the page, and so must all numbers of the value. A quote that is found only nearly, and the quote of
    a field of ``claims`` always, must hold those numbers itself.
    """
    if not value or value == UNKNOWN:
        return UNKNOWN, None, None
    how, found, _ = page.look_up(quote, value)
    asked = figures(plain(value))
    if found is None:
        reason = "QUOTE_NOT_FOUND"
    elif not asked <= numbers:
        reason = "NUMBER_NOT_IN_SOURCE"
    elif how == "fuzzy" and not asked <= figures(found):
        reason = "NUMBER_NOT_IN_MATCHED_QUOTE"
    elif field in claims and not asked <= figures(plain(found)):
        reason = "CLAIM_NUMBER_NOT_IN_QUOTE"
    else:
        return value, found, None
    return UNKNOWN, None, reason


def ground_values(answers: DataFrame, claims: frozenset[str] = frozenset()) -> DataFrame:
    """One row a field of each answer: KEPT_SCHEMA, value UNKNOWN where the text does not bear it out, and the reason.

    ``answers``: text_id, text, values (array<VALUE>); other columns are ignored. Null or UNKNOWN values stay UNKNOWN without a
    reason; null texts bear out nothing; null or empty arrays give no rows; repeated rows are judged each; an empty table
    gives no rows. No row is moved, and each text is prepared once for all its values.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                values = r.values_ if r.values_ is not None else ()
                page, numbers = (Page(r.text), figures(plain(r.text))) if len(values) else (None, frozenset())
                rows += [(r.text_id, v["field"], *bears_out(page, numbers, v["field"], v["value"], v["quote"], claims)) for v in values]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in KEPT_SCHEMA.split(", ")])

    return answers.select("text_id", "text", F.col("values").alias("values_")).mapInPandas(judge, KEPT_SCHEMA)


def merge_answers(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """A second reading against the first, both (text_id, field, value): values of ``fresh`` fill what was UNKNOWN or missing, and
    ``state`` tells kept, filled, confirmed or changed; changed ones keep the first value. A text without any fresh value
    keeps all it has."""
    k, f = known.select("text_id", "field", F.col("value").alias("old")), fresh.select("text_id", "field", F.col("value").alias("new"))
    blank = lambda c: c.isNull() | (c == UNKNOWN)
    state = F.when(blank(F.col("new")), "kept").when(blank(F.col("old")), "filled").when(F.col("old") == F.col("new"), "confirmed").otherwise("changed")
    value = F.when(blank(F.col("old")), F.coalesce("new", "old")).otherwise(F.col("old"))
    return k.join(f, ["text_id", "field"], "full").select("text_id", "field", value.alias("value"), state.alias("state"))
