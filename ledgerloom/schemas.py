"""Canonical schemas."""

TRANSACTION = "doc_id string, seq bigint, tran_date string, value_date string, narration string, withdrawal double, deposit double, balance double"
METADATA = (
    "doc_id string, account_number string, account_name string, bank_name string, ifsc string, micr string, "
    "period_start string, period_end string, opening_balance double, closing_balance double"
)
LINE = "doc_id string, source string, page_no int, pos bigint, text string"
TABLE_ROW = "doc_id string, row_no bigint, cells array<string>"
TOKEN_USAGE = "ts timestamp, api_key_id string, tokens bigint"
PARSED = "tran_date string, value_date string, narration string, withdrawal double, deposit double, balance double"
LAYOUT = "doc_id string, pages array<array<struct<lines:array<struct<spans:array<struct<text:string>>>>>>>"
