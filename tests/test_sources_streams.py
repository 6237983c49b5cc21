"""Sources, sinks, streams and the statement pipeline on files."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerloom.functions.text import bytes_as_json_text
from ledgerloom.plans import statements
from ledgerloom.sources import files, sinks
from ledgerloom.streaming import jobs, rates

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, rows=()):
    text = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    body = "".join(f"<w:p>{text(p)}</w:p>" for p in paragraphs)
    if rows:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{text(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_word_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["SBI", " ", "01-05-2020", "SALARY", "500.00"], [["Date", " Balance "], ["x", "7.00"]]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"ignored")
    up = files.uploads(spark, str(tmp_path))
    assert up.count() == 2
    lines = files.docx_lines(up)
    assert [r["text"] for r in lines.orderBy("pos").collect()] == ["SBI", "01-05-2020", "SALARY", "500.00"]
    assert [r["cells"] for r in files.docx_tables(up).orderBy("row_no").collect()] == [["Date", "Balance"], ["x", "7.00"]]
    found = files.extracted(up, lambda b: [(0, b[:2].decode())] if b[:2] == b"PK" else 1 / 0, "layout")
    assert [r["text"] for r in found.collect()] == ["PK"]


def test_parse_to_responses(spark):
    texts = ["HDFC BANK", "Between 01/05/2020 to 31-05-2020", "Opening Balance: 1,000.00", "01-05-2020", "UPI CREDIT", "500.00", "1,500.00", "02-05-2020", "ATM CASH", "200.00", "1,200.00"]
    layout = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("e", 0, "nothing")], "doc_id string, pos bigint, text string")
    table = spark.createDataFrame([], "doc_id string, row_no bigint, cells array<string>")
    got = {r["doc_id"]: json.loads(r["response"]) for r in statements.parse(layout, table).collect()}
    d = got["d"]
    assert d["metadata"]["bank_name"] == "HDFC" and d["metadata"]["opening_balance"] == 1000.0
    assert (d["metadata"]["period_start"], d["metadata"]["period_end"]) == ("2020-05-01", "2020-05-31")
    assert [(t["tran_date"], t["narration"], t["deposit"], t["withdrawal"], t["balance"]) for t in d["transactions"]] == [
        ("2020-05-01", "UPI CREDIT", 500.0, None, 1500.0),
        ("2020-05-02", "ATM CASH", None, 200.0, 1200.0),
    ]
    # the first row's own balance is the opening one, so both rows are off
    assert d["validation"]["status"] == "invalid" and [i["seq"] for i in d["validation"]["issues"]] == [0, 1]
    assert got["e"]["transactions"] == [] and got["e"]["validation"] == {"status": "empty", "issues": []}


def test_model_hook_and_fallback(spark):
    layout = spark.createDataFrame([("d", 0, "01-05-2020 x"), ("e", 0, "02-05-2020"), ("e", 1, "5.00")], "doc_id string, pos bigint, text string")
    table = spark.createDataFrame([], "doc_id string, row_no bigint, cells array<string>")
    answer = '```json\n{"transactions": [{"date": "01-05-2020", "description": "shop", "amount": "5", "type": "debit"}]}\n```'
    model = lambda payloads: payloads.select("doc_id", F.when(F.col("doc_id") == "d", answer).otherwise("I can't").alias("raw"))
    got = {r["doc_id"]: json.loads(r["response"])["transactions"] for r in statements.parse(layout, table, model).collect()}
    assert [(t["tran_date"], t["narration"], t["withdrawal"]) for t in got["d"]] == [("2020-05-01", "shop", 5.0)]
    assert [(t["tran_date"], t["deposit"]) for t in got["e"]] == [("2020-05-02", 5.0)]


def test_ledger_files_and_notes(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"daily": {"2024-01-01": 5}, "monthly": {"2024-01": 5}, "hourly": {}}))
    (tmp_path / "bad.json").write_text("{nope")
    got = {(r["period"], r["key"], r["tokens"]) for r in files.token_ledger(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("day", "2024-01-01", 5), ("month", "2024-01", 5)}
    notes = spark.createDataFrame([("do", "why"), (None, "x")], "suggestion string, reason string")
    sinks.append_notes(notes, str(tmp_path / "notes"))
    sinks.append_notes(notes, str(tmp_path / "notes"))
    assert spark.read.json(str(tmp_path / "notes")).count() == 4
    (tmp_path / "n.json").write_text('[{"suggestion": "a", "reason": "b"}]')
    assert files.prompt_notes(spark, str(tmp_path / "n.json")).count() == 1


def test_usage_sink(spark, tmp_path):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), "k", 5)], "ts timestamp, api_key_id string, tokens bigint")
    path = str(tmp_path / "usage")
    sinks.append_usage(events, path)
    sinks.append_usage(events, path)
    assert spark.read.parquet(path).count() == 2
    sinks.reset_usage(events, path)
    assert spark.read.parquet(path).count() == 0


def pdf_files(spark, tmp_path):
    """Files called .pdf whose content says: pages, a letter for encrypted, and so on."""
    for name, content in {"ok.pdf": b"2 pages", "many.pdf": b"99 pages", "locked.pdf": b"3 locked", "broken.pdf": b"?", "tiny.pdf": b"1"}.items():
        (tmp_path / name).write_bytes(content + b" " * (2000 if name != "tiny.pdf" else 0))
    (tmp_path / "w.docx").write_bytes(docx(["x" * 5000]) + b" " * 2000)
    return files.uploads(spark, str(tmp_path))


def test_pages_are_counted_and_checked(spark, tmp_path):
    count = lambda b: (int(b.split()[0]), b"locked" in b)
    up = pdf_files(spark, tmp_path)
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert {name(r): (r["pages"], r["encrypted"]) for r in files.page_counts(up, count).collect()} == {
        "ok.pdf": (2, False), "many.pdf": (99, False), "locked.pdf": (3, True), "broken.pdf": (None, None), "tiny.pdf": (1, False), "w.docx": (None, None),
    }
    good, bad = files.checked_uploads(up, count)
    assert {name(r) for r in good.collect()} == {"ok.pdf", "broken.pdf", "w.docx"}
    assert {name(r): r["error_code"] for r in bad.collect()} == {"many.pdf": 413, "locked.pdf": 400, "tiny.pdf": 400}


def test_injected_tables_and_page_limit(spark, tmp_path):
    up = pdf_files(spark, tmp_path).where(F.col("path").rlike("(ok|broken).pdf$"))
    table = lambda b: [[["Date", None], None, [b.split()[0].decode(), 7]], None, [["z"]]] if b[:1] != b"?" else 1 / 0
    assert [r["cells"] for r in files.extracted_tables(up, table).orderBy("row_no").collect()] == [["Date", None], ["2", "7"], ["z"]]

    def pages(content):
        for n in range(10):
            if n > 2:
                raise AssertionError("asked beyond the limit")
            yield n, f"line {n}"

    found = files.extracted(up.where(F.col("path").rlike("ok.pdf$")), pages, "ocr", max_pages=2).orderBy("page_no").collect()
    assert [(r["page_no"], r["text"]) for r in found] == [(0, "line 0"), (1, "line 1")]


def test_images_become_black_and_white():
    import numpy as np

    page = np.full((60, 80, 3), 200, np.uint8)
    page[:, 40:] = 120  # a shadow
    page[20:24, 10:20] = 90
    page[20:24, 60:70] = 40
    clean = files.cleaned_image(page)
    assert set(np.unique(clean)) == {0, 255} and clean.shape == (60, 80)
    assert (clean[21:23, 12:18] == 0).all() and (clean[21:23, 62:68] == 0).all() and (clean[50:, 5:20] == 255).all()


def test_missing_ledgers_are_empty(spark, tmp_path):
    assert files.token_ledger(spark, str(tmp_path / "none.json")).count() == 0
    assert files.prompt_notes(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "empty.json").write_text("")
    assert files.token_ledger(spark, str(tmp_path / "empty.json")).count() == 0


def test_optional_readers_say_what_is_missing():
    import pytest

    for reader in (files.pdf_counter, files.pdf_table_extractor, files.text_recogniser, files.pdf_extractor):
        with pytest.raises(RuntimeError, match="needs the optional package"):
            reader()


def test_bytes(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9",), (b"\xfe\xff",)], "x binary")
    assert [r[0] for r in df.select(bytes_as_json_text(F.col("x"))).collect()] == ["café", '{"__bytes_base64":"/v8="}']


def test_rate_limit_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("c", at(s)) for s in (0, 1, 2, 3, 60)], "client string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.run_once(rates.admitted_stream(stream, 2, 60), "admitted", str(tmp_path / "check"), mode="append")
    got = [r["admitted"] for r in spark.table("admitted").orderBy("ts").collect()]
    assert got == [True, True, False, False, True]


def test_parse_stream(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "01-05-2020"), ("d", 1, "5.00")], "doc_id string, pos bigint, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([], "doc_id string, row_no bigint, cells array<string>")
    jobs.parse_in_batches(stream, lambda b: statements.parse(b, table), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 1 and got[0]["transactions"][0]["deposit"] == 5.0


def test_batches_run_again_replace_their_output(spark, tmp_path):
    """A stream whose state is lost runs its first batch again: the responses are there once."""
    rows = spark.createDataFrame([("d", 0, "01-05-2020"), ("d", 1, "5.00")], "doc_id string, pos bigint, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([], "doc_id string, row_no bigint, cells array<string>")
    for check in ("first", "second"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.parse_in_batches(stream, lambda b: statements.parse(b, table), str(tmp_path / "out"), str(tmp_path / check)).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_totals_in_batches(spark, tmp_path):
    """Hours that later batches change have their last total; a stream without rows has an empty table."""
    schema = "ts timestamp, tokens bigint"
    seen, totals = tmp_path / "in", str(tmp_path / "totals")
    spark.createDataFrame([], schema).write.parquet(str(seen))

    def run(path):
        stream = spark.readStream.schema(schema).parquet(str(seen))
        jobs.totals_in_batches(jobs.hourly_totals(stream), path, path + "-state").awaitTermination()
        return {r["hour"].hour: r["tokens"] for r in jobs.latest(spark.read.parquet(path), "hour").collect()}

    assert run(totals) == {}
    for more in ([(dt.datetime(2024, 1, 1, 5, 10), 3), (dt.datetime(2024, 1, 1, 6, 0), 4)], [(dt.datetime(2024, 1, 1, 5, 59), 10)]):
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(seen))
        got = run(totals)
    assert got == {5: 13, 6: 4}
