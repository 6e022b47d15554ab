"""Readers of single documents, and sinks read back."""

import glob
import gzip
from datetime import date

from pyspark.sql import functions as F

from quarterbook.sources import exports, readers

COVER = """<n:edgarSubmission xmlns:n="urn:x"><n:schemaVersion>X0202</n:schemaVersion><n:headerData><n:submissionType>13F-HR/A</n:submissionType><n:filerInfo>
<n:filer><n:credentials><n:cik>0000012345</n:cik></n:credentials></n:filer><n:periodOfReport>03-31-2024</n:periodOfReport></n:filerInfo></n:headerData>
<n:formData><n:coverPage><n:reportCalendarOrQuarter>03-31-2024</n:reportCalendarOrQuarter><n:isAmendment>true</n:isAmendment><n:amendmentNo>1</n:amendmentNo>
<n:amendmentInfo><n:amendmentType>New Holdings</n:amendmentType></n:amendmentInfo><n:filingManager><n:name>Some Fund</n:name></n:filingManager><n:reportType>13F HOLDINGS REPORT</n:reportType></n:coverPage>
<n:summaryPage><n:tableEntryTotal>1,024</n:tableEntryTotal><n:tableValueTotal>987654</n:tableValueTotal><n:isConfidentialOmitted>false</n:isConfidentialOmitted></n:summaryPage></n:formData></n:edgarSubmission>"""


def test_cover_page(spark):
    [row] = readers.cover_page(spark.createDataFrame([(7, COVER)], "id int, xml string")).collect()
    assert (row.id, row.schema_version, row.form, row.cik, row.period_end) == (7, "X0202", "13F-HR/A", "0000012345", date(2024, 3, 31))
    assert (row.is_amendment, row.amendment_no, row.amendment_type, row.is_notice) == (True, 1, "NEW HOLDINGS", False)
    assert (row.table_entry_total, row.table_value_total, row.confidential_omitted, row.manager) == (1024, 987654, False, "Some Fund")


def test_listing_tickers_and_codes(spark):
    listing = '{"directory": {"item": [{"name": "form.20240102.idx"}, {"name": "form.20240103.idx.gz"}, {"name": "master.20240102.idx"}]}}'
    days = readers.daily_index_dates(spark.createDataFrame([(listing,)], "json string"))
    assert sorted(r.day for r in days.collect()) == [date(2024, 1, 2), date(2024, 1, 3)]
    tickers = readers.ticker_directory(spark.createDataFrame([('{"0": {"cik_str": 42, "ticker": "abc", "title": "Abc Co"}}',)], "json string"))
    assert [tuple(r) for r in tickers.collect()] == [("0000000042", "ABC", "Abc Co")]
    codes = readers.industry_codes(spark.createDataFrame([("42", "1311", "2023q1"), ("42", "7372", "2024q1"), ("42", None, "2024q2")], "cik string, sic string, quarter string"))
    assert [tuple(r) for r in codes.collect()] == [("0000000042", "7372")]


def test_csv_records_and_periods(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', date(2024, 3, 31)), (2, None, date(2024, 6, 30))], "n int, s string, period_end date")
    exports.write_csv(rows.coalesce(1), f"{tmp_path}/csv")
    [part] = glob.glob(f"{tmp_path}/csv/*.csv")
    assert open(part, newline="").read() == 'n,s,period_end\r\n1,"a ""b"", c",2024-03-31\r\n2,,2024-06-30\r\n'
    exports.write_csv(rows.coalesce(1), f"{tmp_path}/marked", mark=True)
    [part] = glob.glob(f"{tmp_path}/marked/*.csv")
    assert open(part, "rb").read().startswith(b"\xef\xbb\xbfn,s,period_end\r\n1,")
    exports.write_records(rows.coalesce(1), f"{tmp_path}/json")
    [part] = glob.glob(f"{tmp_path}/json/*.json.gz")
    assert '"s":null' in gzip.open(part, "rt").read()
    exports.write_periods(rows, f"{tmp_path}/p")
    exports.write_periods(rows.where("n = 2").withColumn("s", F.lit("new")), f"{tmp_path}/p")
    assert sorted((r.n, r.s) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, 'a "b", c'), (2, "new")]
