"""Hand-derived cases of the operators' rules."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Settings, api_keys
from ledgerloom.functions import amounts, coerce, dates, json_salvage, metadata, text
from ledgerloom.operators import blocks, chunking, dedup, ledger, lines, tables, usage
from ledgerloom.streaming import rates

TXN = "doc_id string, seq bigint, tran_date string, value_date string, narration string, withdrawal double, deposit double, balance double"


def one(spark, expr, x):
    return spark.createDataFrame([(x,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    assert one(spark, text.clean_text, "a\t  b   c ") == "a b c"
    assert one(spark, text.clean_text, None) is None


def test_row_join(spark):
    df = spark.createDataFrame([(["a", None, " b"],)], "cells array<string>")
    r = tables.row_texts(df).first()
    assert (r["piped"], r["piped_filled"]) == ("a |  | b", "a | b")


def test_noise(spark):
    given = ["Page 1 of 4", "Transactions", "--", "UPI 12", "page 3 extra", "7", "", None]
    df = spark.createDataFrame([(x,) for x in given], "text string")
    assert [r["text"] for r in lines.clean_lines(df).collect()] == ["UPI 12", "7"]


@pytest.mark.parametrize("given,want", [("01-05-2020", "2020-05-01"), ("1-5-2020", "2020-05-01"), ("01/05/20", None), ("01-05-99", "1999-05-01"), ("31-02-2020", None), ("x 2020-05-01 y", "2020-05-01"), (None, None), ("", None)])
def test_normalizer_date(spark, given, want):
    assert one(spark, dates.normalizer_date, given) == want


@pytest.mark.parametrize("given,want", [("1st May 2020", "2020-05-01"), ("1st August 2020", None), ("01/05/20", "2020-05-01"), ("2nd jan 2021", "2021-01-02")])
def test_metadata_date(spark, given, want):
    assert one(spark, dates.metadata_date, given) == want


@pytest.mark.parametrize("given,want", [("1,50,000.00", ["1,50", "000.00"]), ("31003.24", ["003.24"]), ("31,003.24", ["31,003.24"]), ("500", [])])
def test_find_amounts(spark, given, want):
    assert one(spark, amounts.find_amounts, given) == want


def test_numbers(spark):
    assert one(spark, amounts.table_number, "1,234.50") == 1234.5
    assert one(spark, amounts.table_number, "₹5") is None
    assert one(spark, amounts.model_number, "₹5") == 5.0
    assert one(spark, amounts.table_number, "x") is None
    assert one(spark, amounts.first_amount, "at -1,234.50 x") == -1234.5


def test_coercion(spark):
    recs = [
        {"date": "2020-05-01", "particulars": "X", "dr": "1,000"},
        {"amount": "5"},
        {"amount": "5", "type": "Debit"},
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(recs)], "seq int, rec map<string,string>")
    got = {r["seq"]: r for r in coerce.coerce_rows(df).collect()}
    assert (got[0]["tran_date"], got[0]["value_date"], got[0]["narration"], got[0]["withdrawal"]) == ("2020-05-01", "2020-05-01", "X", 1000.0)
    assert got[1]["deposit"] == 5.0 and got[1]["withdrawal"] is None
    assert got[2]["withdrawal"] == 5.0 and got[2]["deposit"] is None


def txns(spark, *rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], TXN)


def test_running_balance(spark):
    df = txns(spark, ("2020-01-01", None, "a", None, 10.0, 110.0), ("2020-01-02", None, "b", 5.0, None, None), ("2020-01-03", None, "c", 5.0, None, 100.0), (None, None, "e", None, 2.0, 102.0))
    got = ledger.balance_issues(df, F.lit(100)).collect()
    assert [(r["seq"], float(r["expected_balance"]), float(r["actual_balance"])) for r in got] == [(2, 105.0, 100.0)]
    r = ledger.balance_reports(df, F.lit(100)).first()
    assert r["status"] == "invalid" and len(r["issues"]) == 1


def test_tolerance(spark):
    assert ledger.balance_issues(txns(spark, ("2020-01-01", None, "a", None, 10.0, 11.0)), F.lit(0)).count() == 0
    assert ledger.balance_issues(txns(spark, ("2020-01-01", None, "a", None, 10.0, 11.5)), F.lit(0)).count() == 1


def parsed(*texts):
    return [(b.date, b.narration, b.withdrawal, b.deposit, b.balance) for b in blocks.parse_lines(texts)]


def test_block_layout():
    got = parsed("01-05-2020", "UPI CREDIT", "500.00", "1,500.00", "02-05-2020", "ATM CASH", "200.00", "1,300.00")
    assert got == [("01-05-2020", "UPI CREDIT", None, 500.0, 1500.0), ("02-05-2020", "ATM CASH", 200.0, None, 1300.0)]


def test_block_rows_run_together():
    assert parsed("01-05-2020 UPI 500.00 1,500.00", "02-05-2020 ATM 200.00 1,300.00") == [("01-05-2020", None, None, 200.0, 1300.0)]


@pytest.mark.parametrize("narration,side", [("NEFT DR", 2), ("UPI-X", 2), ("SALARY", 3)])
def test_single_amount(narration, side):
    assert parsed("01-05-2020", narration, "500.00")[0][side] == 500.0


def test_parse_blocks_native_dates(spark):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(["01-05-2020", "UPI", "500.00"])], "doc_id string, pos bigint, text string")
    r = blocks.parse_blocks(df).first()
    assert (r["tran_date"], r["value_date"], r["deposit"]) == ("2020-05-01", "2020-05-01", 500.0)


def test_dedup_rules(spark):
    date = "2020-01-01"
    same = txns(spark, (date, None, "coffee at the corner", 5.0, None, 1300.0), (date, None, "coffee at the corner", 5.0, None, 1100.0))
    assert dedup.drop_exact(same).count() == 2 and dedup.drop_fuzzy(same).count() == 1
    zero = txns(spark, (date, None, "note", None, 0.0, 1.0), (date, None, "note", None, 0.0, 2.0))
    assert dedup.drop_fuzzy(zero).count() == 2
    undated = txns(spark, (None, None, "x", 5.0, None, 1.0), (None, None, "x", 5.0, None, 1.0))
    assert dedup.drop_fuzzy(undated).count() == 2 and dedup.drop_exact(undated).count() == 2
    tie = txns(spark, (date, None, "x", 5.0, None, 1.0), (date, date, "x", 5.0, None, 1.0))
    assert [r["seq"] for r in dedup.drop_exact(tie).collect()] == [0]


def test_dedup_is_idempotent(spark):
    date = "2020-01-01"
    df = txns(spark, *[(date, None, f"payment number {i % 3} to shop", 5.0, None, float(i)) for i in range(8)])
    once = dedup.drop_fuzzy(df).drop("slot")
    assert sorted(map(str, dedup.drop_fuzzy(once).drop("slot").collect())) == sorted(map(str, once.collect()))


def test_containment(spark):
    layouts = spark.createDataFrame([("d", "alpha one\nbeta two\ngamma x\ndelta y"), ("e", "")], "doc_id string, layout string")
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(["alpha one", "beta two", "gamma x", "delta y", "none at all"])], "doc_id string, pos int, text string")
    assert {r["doc_id"]: r["duplicate"] for r in lines.table_repeats_layout(rows, layouts).collect()} == {"d": True, "e": False}
    assert not {r["doc_id"]: r["duplicate"] for r in lines.table_repeats_layout(rows.where("pos in (0, 1, 2, 4)"), layouts).collect()}["d"]
    assert {r["doc_id"]: r["duplicate"] for r in lines.ocr_repeats_layout(rows, layouts).collect()}["e"] is True


def table(spark, rows):
    return spark.createDataFrame([("d", i, r) for i, r in enumerate(rows)], "doc_id string, row_no bigint, cells array<string>")


def test_table_usable(spark):
    ok = lambda rows: tables.table_usability(table(spark, rows)).first()["usable"]
    assert not ok([["a", "1"], ["b", "2"]])
    assert ok([["a", "1"], ["b", "2"], ["c", "3"]])
    assert not ok([["", "1"], ["", "", "2"], ["", "", "", "3"], ["", "", "", "", "4"]])


@pytest.mark.parametrize(
    "given,want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ("<think>hm {</think> [1, 2]", "[1, 2]"),
        ('so: [{"a":1},{"b":2}] ok', '[{"a":1},{"b":2}]'),
        ('so: [{"a":1}] ok', '{"a":1}'),
        ("nope", None),
        (None, None),
        ("", None),
    ],
)
def test_json_salvage(spark, given, want):
    assert one(spark, json_salvage.salvage_json, given) == want


def test_retry_hint(spark):
    body = '{{"error": {{"message": "Please try again in {}"}}}}'
    assert one(spark, json_salvage.retry_after_seconds, body.format("664ms.")) == 0.664
    assert one(spark, json_salvage.retry_after_seconds, body.format("1.88s.")) == 1.88
    assert one(spark, json_salvage.retry_after_seconds, "try again in 3s") == 0.0


def test_token_estimate(spark):
    df = spark.createDataFrame([(0,), (3,), (9,), (None,)], "n int")
    assert [r[0] for r in df.select(text.estimate_tokens(F.col("n"))).collect()] == [0, 1, 2, 0]


def test_rate_limit(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("c", at(s)) for s in (0, 1, 2, 3, 4, 5, 60)], "client string, ts timestamp")
    got = [r["admitted"] for r in rates.admitted(df, *rates.parse_limit("4/minute")).orderBy("ts").collect()]
    assert got == [True] * 4 + [False, False, True]


def test_sliding_sum(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("k", at(0), 5), ("k", at(59), 1), ("k", at(60), 7)], "api_key_id string, ts timestamp, tokens bigint")
    assert [r["window_tokens"] for r in usage.sliding_tokens(df).orderBy("ts").collect()] == [5, 6, 8]


def test_warnings(spark):
    df = spark.range(1).select(usage.warnings(F.lit(70), F.lit(100), F.lit(95), F.lit(100)).alias("w"))
    assert df.first()["w"] == ["hour: approaching limit", "month: quota nearly exhausted"]


def test_bank_names(spark):
    assert one(spark, metadata.bank_name, "State Bank of India") == "BANK OF INDIA"
    assert one(spark, metadata.bank_name, "none") is None


def test_upload_checks(spark):
    rows = [("a.txt", 5000, False, 1), ("a.pdf", 500, False, 1), ("a.pdf", 5000, True, 1), ("a.pdf", 5000, False, 11), ("a.docx", 5000, None, None)]
    df = spark.createDataFrame(rows, "n string, s bigint, e boolean, p int")
    got = [r[0] for r in df.select(tables.upload_error(F.col("n"), F.col("s"), F.col("e"), F.col("p"), settings=Settings(max_pages=10))).collect()]
    assert got == [400, 400, 400, 413, None]


def test_chunks_cover_all_lines():
    sizes = {"table": [10] * 30, "ocr": [7] * 11, "layout": [3] * 50}
    placed = chunking.fill_chunks(sizes, 300 + 77 + 150, 4, 2)
    own = [(s, p) for _, s, p, overlap in placed if not overlap]
    assert sorted(own) == sorted((s, p) for s, v in sizes.items() for p in range(len(v)))
    assert {c for c, *_ in placed} == {0, 1, 2, 3}


def test_api_keys():
    assert api_keys(" a, ,b ", "c") == ["a", "b"]
    assert api_keys("", " c ") == ["c"]
    assert api_keys(None, None) == []


def test_three_passes(spark):
    schema = TXN + ", page_no int"
    rows = [("d", 0, "2020-01-01", None, "ACME STORE 12", 5.0, None, 1.0, 1), ("d", 1, "2020-01-01", None, "acme store, 12", 5.0, None, 1.0, 1), ("d", 2, "2020-01-01", None, "ACNE STORE 12", 5.0, None, 1.0, 1), ("d", 3, "2020-01-02", None, "ACME STORE 12", 5.0, None, 1.0, 1)]
    assert dedup.three_passes(spark.createDataFrame(rows, schema)).count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TXN)
    assert ledger.balance_reports(empty, F.lit(0)).count() == 0
    assert dedup.drop_fuzzy(empty).count() == 0
    assert ledger.normalize(empty).count() == 0


def plain_fuzzy(rows, ratio):
    """The rule row by row: rows of (seq, date, narration, amount, balance, score); (slot, seq) of what stays."""
    from difflib import SequenceMatcher

    kept = []  # [date, narration, amount, balance, slot, row]
    for row in rows:
        seq, date, narration, amount, balance, score = row
        target = next((k for k in kept if k[:4] == [date, narration, amount, balance]), None)
        if target is None and amount != 0:
            target = next((k for k in kept if k[0] == date and k[2] == amount and SequenceMatcher(None, k[1], narration).ratio() >= ratio), None)
        if target is None:
            kept.append([date, narration, amount, balance, seq, row])
        elif score > target[5][5]:
            target[5] = row
    return sorted((k[4], k[5][0]) for k in kept)


def test_fuzzy_duplicates_equal_the_rule_row_by_row(spark):
    import random

    rng = random.Random(3)
    texts = ["salary may acme limited", "salary may acme limite", "salary june acme limited", "salary mai acme limted", "atm cash 12", "atm cash 13", "x"]
    rows = []
    for seq in range(400):
        amount, balance = rng.choice([0.0, 5.0, 5.0, 7.5]), rng.choice([None, 10.0, 11.0, 12.0])
        rows.append((f"d{seq % 3}", seq, rng.choice(["2020-01-01", "2020-01-02"]), rng.choice(texts), amount if rng.random() < 0.5 else None, amount, balance))
    df = spark.createDataFrame(rows, "doc_id string, seq bigint, tran_date string, narration string, withdrawal double, deposit double, balance double").repartition(5)
    got = {}
    for r in dedup.drop_fuzzy(df).collect():
        got.setdefault(r["doc_id"], []).append((r["slot"], r["seq"]))
    for doc in ("d0", "d1", "d2"):
        own = [(s, d, n, dep or w or 0.0, b, 3 * (b is not None) + 2 * (w is not None) + 2 + (len(n) > 10)) for i, s, d, n, w, dep, b in rows if i == doc]
        assert sorted(got[doc]) == plain_fuzzy(own, 0.9)


def test_earliest_starts(spark):
    import datetime as dt


    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("k", at(0), 40), ("k", at(10), 40), ("k", at(20), 40), ("k", at(30), 90), ("k", at(200), 101), ("k", at(300), 100), ("j", at(5), 0)]
    df = spark.createDataFrame(rows, "api_key_id string, ts timestamp, tokens bigint")
    got = {(r["api_key_id"], r["ts"]): r["earliest_start"] for r in usage.earliest_start(df, 100).collect()}
    late = dt.timedelta(milliseconds=50)
    assert got["k", at(0)] == at(0) and got["k", at(10)] == at(10) and got["k", at(20)] == at(60) + late
    assert got["k", at(30)] == at(80) + late and got["k", at(200)] is None and got["k", at(300)] == at(300) and got["j", at(5)] == at(5)
    assert all(r["earliest_start"] == r["ts"] for r in usage.earliest_start(df, 0).collect())


def test_amounts_in_text_become_numbers(spark):

    df = spark.createDataFrame([("d", 0, "01-05-2020", None, "1,234.50", "", "(x) 7")], "doc_id string, seq bigint, tran_date string, value_date string, withdrawal string, deposit string, balance string")
    r = ledger.normalize(df).first()
    assert (r["tran_date"], r["value_date"], r["withdrawal"]) == ("2020-05-01", "2020-05-01", 1234.5)
