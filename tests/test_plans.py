"""Plans: native operators stay native, filters and columns reach the scan, no cross joins; the core stands without the subpackage."""

import itertools
import re
import subprocess
import sys
from pathlib import Path

import pytest

from ledgerloom.plans import catalogue, statements

ROOT = Path(__file__).resolve().parents[1]
PYTHON = {"q_block_parse", "q_fallback_chain", "q_block_parse_totals", "q_chunks", "q_chunk_coverage", "q_dedup_fuzzy", "q_dedup_three_passes", "q_payloads", "q_rate_limit", "q_responses"}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - PYTHON - {"q_stream_hourly"}))
def test_native(name, spark, sf_dir):
    text = plan(catalogue.queries()[name](spark, sf_dir))
    assert not re.search(r"Python|Pandas|Arrow(Eval)?", text), name
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_few_columns(spark, sf_dir):
    text = plan(catalogue.queries()["q_balance_status"](spark, sf_dir))
    assert "o_comment" not in text
    schema = re.search(r"ReadSchema: (.*)", text)[1]
    assert set(re.findall(r"(\w+):", schema)) <= {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"}


def test_core_does_not_import_the_subpackage():
    code = "import ledgerloom.plans.catalogue, sys; assert not any(m.startswith('ledgerloom.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_salvaged_once(spark):
    answers = spark.createDataFrame([("a", 'Here: {"items": [{"date": "2020-01-01", "debit": "1.00"}]} done')], "doc_id string, raw string")
    model = statements.model_transactions(answers)
    assert optimized(model).count("<think>") == 1
    assert [(r["tran_date"], r["withdrawal"]) for r in model.collect()] == [("2020-01-01", 1.0)]


def test_the_parser_reads_lines_of_unanswered_documents_only(spark, sf_dir):
    text = optimized(catalogue.queries()["q_fallback_chain"](spark, sf_dir)).splitlines()
    depth = lambda line: len(re.match(r"[ :+-]*", line)[0])
    parser = next(i for i, line in enumerate(text) if "MapInArrow" in line and "raw_date" in line)
    below = list(itertools.takewhile(lambda line: depth(line) > depth(text[parser]), text[parser + 1 :]))
    assert any("LeftAnti" in line for line in below)
