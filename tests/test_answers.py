import json

from pyspark.sql import functions as F

from docloom.operators.answers import all_of, clamped, ground_values, merge_answers, one_of, read_values

TEXT = "We hold the thirty stocks with the highest signal and rebalance monthly on the first day. Costs of 12 bps are deducted from the yearly return of 8.5 percent."
ANSWER = {
    "a": {"value": "monthly", "evidence_quote": "rebalance monthly on the first day", "confidence": "0.9"}, "b": {"value": "weekly", "evidence_quote": "rebalanced each week", "confidence": 7}, "c": {"value": "15 bps", "evidence_quote": "Costs of 12 bps are deducted", "confidence": None},
    "d": {"value": None, "evidence_quote": None, "confidence": "x"}, "e": {"value": "8.5 %", "evidence_quote": "Costs of 12 bps are deducted", "confidence": -1}, "f": {"value": " ", "evidence_quote": "x", "confidence": 0.5},
}


def test_reading_and_grounding(spark):
    rows = [(1, TEXT, json.dumps(ANSWER), "e"), (2, None, json.dumps({"a": ANSWER["a"]}), "e"), (3, TEXT, "no json", "e"), (4, TEXT, None, "e"), (1, TEXT, json.dumps({"a": ANSWER["a"]}), "e")]
    df = spark.createDataFrame(rows, "text_id long, text string, answer string, value string").withColumn("values", read_values(F.col("answer")))
    read = {v.field: (v.value, v.confidence) for v in df.where("text_id = 1").orderBy(F.length("answer").desc()).first()["values"]}
    assert read == {"a": ("monthly", 0.9), "b": ("weekly", 1.0), "c": ("15 bps", 0.0), "d": ("UNKNOWN", 0.0), "e": ("8.5 %", 0.0), "f": ("UNKNOWN", 0.5)}
    got = sorted((r.text_id, r.field, r.value, r.reason or "") for r in ground_values(df, frozenset({"e"})).collect())
    assert got == [(1, "a", "monthly", ""), (1, "a", "monthly", ""), (1, "b", "UNKNOWN", "QUOTE_NOT_FOUND"), (1, "c", "UNKNOWN", "NUMBER_NOT_IN_SOURCE"), (1, "d", "UNKNOWN", ""), (1, "e", "UNKNOWN", "CLAIM_NUMBER_NOT_IN_QUOTE"), (1, "f", "UNKNOWN", ""), (2, "a", "UNKNOWN", "QUOTE_NOT_FOUND")]
    assert {r.field: r.value for r in ground_values(df.where("text_id = 1")).collect()}["e"] == "8.5 %" and ground_values(df.limit(0)).count() == 0
    near = [(9, TEXT, [("g", "8.5 percent", "We hold the thirty stocks with the highest signal and rebalance monthly on a first day", 1.0)])]
    nearly = spark.createDataFrame(near, "text_id long, text string, values array<struct<field:string,value:string,quote:string,confidence:double>>")
    assert [r.reason for r in ground_values(nearly).collect()] == ["NUMBER_NOT_IN_MATCHED_QUOTE"]


def test_names_and_shares(spark):
    df = spark.createDataFrame([("fx", ["Fx", "none", "RATES", "fx", None], "2"), (None, None, "abc"), ("zz", [], "NaN")], "a string, b array<string>, c string")
    got = [(r.a, list(r.b), r.c) for r in df.select(one_of(F.col("a"), ["FX", "RATES"]).alias("a"), all_of(F.col("b"), ["FX", "RATES"]).alias("b"), clamped(F.col("c")).alias("c")).collect()]
    assert got == [("FX", ["FX", "RATES"], 1.0), ("UNKNOWN", [], 0.0), ("UNKNOWN", [], 0.0)]


def test_second_readings_only_fill(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "text_id long, field string, value string")
    got = {(r.field): (r.value, r.state) for r in merge_answers(rows((1, "a", "x"), (1, "b", "UNKNOWN"), (1, "c", "y"), (1, "d", "z")), rows((1, "a", "x"), (1, "b", "v"), (1, "c", "w"), (1, "e", "n"))).collect()}
    assert got == {"a": ("x", "confirmed"), "b": ("v", "filled"), "c": ("y", "changed"), "d": ("z", "kept"), "e": ("n", "filled")}
