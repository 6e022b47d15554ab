"""Readers over odd input: headers with labels, prefixed XML, index lines, parallel arrays, bulk tables in archives, archived records."""

import datetime as dt
import gzip
import io
import json
import zipfile

from quarterbook.sources import readers as rd

HEADER = """<!-- <SEC-HEADER> ACCESSION NUMBER: 0001111111-26-000007 </SEC-HEADER> -->
<PRE>&lt;SEC-DOCUMENT&gt;0001111111-26-000007.txt : 20260515
&lt;ACCEPTANCE-DATETIME&gt;20260515160656
ACCESSION NUMBER:		0001111111-26-000007
CONFORMED SUBMISSION TYPE:	13F-HR
CONFORMED PERIOD OF REPORT:	20260331
FILED AS OF DATE:		20260515

FILER:
	COMPANY DATA:
		COMPANY CONFORMED NAME:			SOME FUND &amp;amp; CO
		CENTRAL INDEX KEY:			0000012345
	FORMER COMPANY:
		FORMER CONFORMED NAME:	OLD FUND
FILER:
		central index key:			678
&lt;DOCUMENT&gt;
&lt;TYPE&gt;13F-HR
&lt;SEQUENCE&gt;1
&lt;FILENAME&gt;primary_doc.xml
&lt;TEXT&gt;<a href="x">&lt;TYPE&gt;</a>
&lt;/DOCUMENT&gt;
&lt;document&gt;
&lt;type&gt;Information Table
&lt;FILENAME&gt;table.xml
&lt;DESCRIPTION&gt;
</PRE>"""


def test_index_headers(spark):
    [row] = rd.index_headers(spark.createDataFrame([(HEADER,)], "html string")).collect()
    assert (row.accession, row.form, row.cik, row.period_end, row.filed) == ("0001111111-26-000007", "13F-HR", "0000012345", dt.date(2026, 3, 31), dt.date(2026, 5, 15))
    assert row.accepted == dt.datetime(2026, 5, 15, 20, 6, 56)
    assert row.ciks == ["0000012345", "0000000678"] and row.former_names == ["OLD FUND"]
    assert [(d.type, d.sequence, d.filename, d.description) for d in row.documents] == [("13F-HR", "1", "primary_doc.xml", None), ("Information Table", None, "table.xml", None)]
    assert row.info_table_file == "table.xml"


def test_headers_that_lack_everything(spark):
    rows = rd.index_headers(spark.createDataFrame([("",), (None,), ("<DOCUMENT><TYPE>INFORMATION TABLES",)], "html string")).collect()
    assert all((r.accession, r.form, r.cik, r.period_end, r.accepted, r.info_table_file) == (None,) * 6 for r in rows)


def test_information_table(spark):
    item = lambda name, extra="": f"<n:infoTable><n:nameOfIssuer>{name}</n:nameOfIssuer><n:titleOfClass>COM</n:titleOfClass><n:cusip> 00012a103 </n:cusip><n:value>1,234</n:value><n:shrsOrPrnAmt><n:sshPrnamt>50</n:sshPrnamt><n:sshPrnamtType>SH</n:sshPrnamtType></n:shrsOrPrnAmt>{extra}<n:votingAuthority><n:Sole>1</n:Sole><n:Shared>2</n:Shared><n:None>3</n:None></n:votingAuthority></n:infoTable>"
    one = f'<n:informationTable xmlns:n="urn:t">{item("A &amp; B")}</n:informationTable>'
    two = f"<informationTable>{item('C').replace('n:', '')}{item('D', '<n:putCall>Put</n:putCall>').replace('n:', '')}</informationTable>"
    rows = rd.info_table(spark.createDataFrame([(1, one), (2, two)], "id int, xml string")).orderBy("id", "row_seq").collect()
    assert [(r.id, r.name, r.cusip, r.value_raw, r.shares, r.unit, r.put_call, r.voting_none) for r in rows] == [(1, "A & B", "00012A103", 1234, 50, "SH", None, 3), (2, "C", "00012A103", 1234, 50, "SH", None, 3), (2, "D", "00012A103", 1234, 50, "SH", "Put", 3)]


INDEX = [
    "Form Type   Company Name                CIK         Date Filed  File Name",
    "---------------------------------------------------------------------------",
    "13F-HR      FUND ONE 2 LP               12345       2024-02-14  edgar/data/12345/0000012345-24-000001.txt",
    "13F-HR/A    FUND ONE 2 LP               12345       20240220    edgar/data/12345/0000012345-24-000002.txt",
    "13F-NT      OTHER                       77          2024-02-14  edgar/data/77/0000012345-24-000003.txt   ",
    "13F-HR      FUND ONE AGAIN              12345       2024-02-15  edgar/data/12345/0000012345-24-000001.txt",
    "10-K        A COMPANY                   9           2024-02-14  edgar/data/9/0000000009-24-000001.txt",
    "",
]


def test_indexes(spark):
    lines = spark.createDataFrame(list(enumerate(INDEX)), "n int, value string").repartition(3)
    rows = rd.form_index(lines, order="n")
    assert sorted((r.form, r.company, r.cik, str(r.filed), r.accession[-6:]) for r in rows.collect()) == [
        ("13F-HR", "FUND ONE 2 LP", "0000012345", "2024-02-14", "000001"), ("13F-HR/A", "FUND ONE 2 LP", "0000012345", "2024-02-20", "000002"), ("13F-NT", "OTHER", "0000000077", "2024-02-14", "000003"),
    ]
    assert sorted(r.cik for r in rd.filers_on(rows, dt.date(2024, 2, 14)).collect()) == ["0000000077", "0000012345"]
    assert [tuple(r) for r in rd.latest_report(rows).collect()] == [("0000012345", "0000012345-24-000001")]
    pipes = ["CIK|Company Name|Form Type|Date Filed|Filename", "5|X Co|13F-HR|2024-05-01|edgar/data/5/0000000005-24-000001.txt", "5|X Co|13F-HR|2024-05-02|edgar/data/5/0000000005-24-000001.txt", "bad|line"]
    [row] = rd.master_index(spark.createDataFrame(list(enumerate(pipes)), "n int, value string"), order="n").collect()
    assert (row.company, row.cik, row.filed) == ("X Co", "0000000005", dt.date(2024, 5, 1))
    assert rd.form_index(lines.limit(0)).count() == 0


def test_submissions(spark):
    doc = json.dumps({"cik": "42", "filings": {"recent": {"accessionNumber": ["a", "b", "c"], "form": ["13F-HR", "10-K", "13F-NT"], "filingDate": ["2024-05-01", "2024-05-02", ""], "reportDate": ["2024-03-31", "", "2024-03-31"]}}})
    rows = rd.submissions(spark.createDataFrame([(doc,), ("not json",)], "json string")).collect()
    assert sorted((r.cik, r.accession, r.form, r.filed, r.period_end) for r in rows) == [("0000000042", "a", "13F-HR", dt.date(2024, 5, 1), dt.date(2024, 3, 31)), ("0000000042", "c", "13F-NT", None, dt.date(2024, 3, 31))]


TABLES = {
    "X/SUBMISSION.tsv": "SUBMISSIONTYPE\tACCESSION_NUMBER\tCIK\tPERIODOFREPORT\tFILING_DATE\r\n13F-HR\ta1\t5\t31-MAR-2024\t14-MAY-2024\r\n13F-NT\ta2\t6\t31-MAR-2024\t14-MAY-2024\r\n10-K\ta3\t7\t31-MAR-2024\t14-MAY-2024\r\n\r\n",
    "X/COVERPAGE.tsv": "ACCESSION_NUMBER\tREPORTTYPE\tFILINGMANAGER_NAME\tISAMENDMENT\tAMENDMENTTYPE\na1\t13F COMBINATION REPORT\tCaf\xe9 \"Fund\"\tY\tNew Holdings\na2\t13F NOTICE\t\tN\t",
    "X/SummaryPage.TSV": "ACCESSION_NUMBER\tTABLEENTRYTOTAL\tTABLEVALUETOTAL\tISCONFIDENTIALOMITTED\na1\t2\t1,500\tY\n",
    "X/INFOTABLE.tsv": "ACCESSION_NUMBER\tINFOTABLE_SK\tNAMEOFISSUER\tCUSIP\tVALUE\tSSHPRNAMT\tSSHPRNAMTTYPE\tPUTCALL\na1\t1\tAn issuer\t00012a103\t1000\t10\t\t\na1\t2\tAn issuer\t00012a103\t500\t5\tSH\tCall\nzz\t3\tOrphan\t1\t1\t1\tSH\t\n",
}


def test_bulk_archive(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in TABLES.items():
            archive.writestr(name, text.encode("latin1"))
    (tmp_path / "w.zip").write_bytes(held.getvalue())
    archives = spark.read.format("binaryFile").load(str(tmp_path))
    for chunk in (4 << 20, 7):
        of = lambda entry, schema, chunk=chunk: rd.table_of_lines(rd.zip_lines(archives, entry, chunk=chunk), schema)
        filings = rd.bulk_filings(of("SUBMISSION.TSV", rd.SUBMISSION), of("COVERPAGE.TSV", rd.COVERPAGE), of("SUMMARYPAGE.TSV", rd.SUMMARYPAGE))
        a1, a2 = sorted(filings.collect(), key=lambda r: r.accession)
        assert (a1.cik, a1.name, a1.period_end, a1.filed, a1.is_amendment, a1.amendment_type) == ("0000000005", 'Café "Fund"', dt.date(2024, 3, 31), dt.date(2024, 5, 14), True, "NEW HOLDINGS")
        assert (a1.is_notice, a1.is_combination, a1.table_entry_total, a1.table_value_total, a1.confidential_omitted) == (False, True, 2, 1500, True)
        assert (a2.name, a2.is_notice, a2.table_value_total, a2.confidential_omitted) == ("UNKNOWN", True, None, False)
        rows = rd.bulk_rows(of("INFOTABLE.TSV", rd.INFOTABLE), filings).orderBy("row_seq").collect()
        assert [(r.accession, r.cusip, r.value_raw, r.shares, r.unit, r.put_call, r.figi) for r in rows] == [("a1", "00012A103", 1000, 10, "SH", None, None), ("a1", "00012A103", 500, 5, "SH", "Call", None)]


def test_fails_to_deliver(spark):
    lines = ["SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE", "20240102|00012a103|abc|5|A|1.0", "20240103|00012A103|XYZ|5|A|1.0", "20240103|000000001||5|B|1.0", "Trailer record count 3"]
    rows = rd.fails_lines(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))
    assert [tuple(r)[:2] for r in rd.fails_to_deliver(rows, rows["n"]).collect()] == [("00012A103", "ABC")]


def test_archived_filings(spark, tmp_path):
    good = {"accession": "a", "cik": "7", "form": "13F-HR", "period_end": "2024-03-31", "accepted": "2024-05-01T10:00:00Z", "rows": [{"row_seq": 1, "cusip": "000000001", "value_raw": 5}, {"row_seq": 2, "cusip": "000000002", "value_raw": 6}]}
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, (good, {"accession": "b", "rows": []}, good | {"accession": "c", "period_end": "soon"}))))
    filings, rows = rd.archived_filings(spark, str(tmp_path))
    [filing] = filings.collect()
    assert (filing.accession, filing.cik, filing.period_end, filing.accepted) == ("a", "0000000007", dt.date(2024, 3, 31), dt.datetime(2024, 5, 1, 10))
    assert sorted((r.accession, r.cusip, r.value_raw) for r in rows.collect()) == [("a", "000000001", 5), ("a", "000000002", 6)]
