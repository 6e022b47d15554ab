"""Readers of filing documents and bulk tables; every schema is declared."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ACCESSION, accession_from_path, as_int, eastern_stamp_to_utc, normalize_date, pad_cik, unescape_html

FORMS = ("13F-HR", "13F-HR/A", "13F-NT", "13F-NT/A")
INFO_TABLE = """array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,figi:string,value:string,
shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string,investmentDiscretion:string,otherManager:string,
votingAuthority:struct<Sole:string,Shared:string,None:string>>>"""


def info_table(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per infoTable element of each document, whatever its namespace prefix; other columns stay."""
    rows = F.from_xml(F.col(xml), F.lit(f"infoTable {INFO_TABLE}"), {"ignoreNamespace": "true"})["infoTable"]
    flat = docs.select(*[c for c in docs.columns if c != xml], F.posexplode(rows).alias("row_seq", "r"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return flat.select(
        *[c for c in docs.columns if c != xml], "row_seq", F.col("r.nameOfIssuer").alias("name"), F.col("r.titleOfClass").alias("title_of_class"), F.upper(F.trim("r.cusip")).alias("cusip"), blank(F.col("r.figi")).alias("figi"),
        as_int(F.col("r.value")).alias("value_raw"), as_int(F.col("r.shrsOrPrnAmt.sshPrnamt")).alias("shares"), F.col("r.shrsOrPrnAmt.sshPrnamtType").alias("unit"), blank(F.col("r.putCall")).alias("put_call"),
        as_int(F.col("r.votingAuthority.Sole")).alias("voting_sole"), as_int(F.col("r.votingAuthority.Shared")).alias("voting_shared"), as_int(F.col("r.votingAuthority.None")).alias("voting_none"),
    )


def _first(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """The first row of each key by `order`; without one the least by all columns, so that partitioning never matters."""
    last = [order] if order else []
    window = Window.partitionBy(*keys).orderBy(*last, *[c for c in rows.columns if c not in (*keys, *last)])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", *last)


def form_index(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """form, company, cik, filed, accession of a quarterly form index's lines that end in an archive path (a preamble's don't).

    The filer's id comes from the path. Lines that repeat accession and filer count once: the first by `order` (a line number).
    """
    text, shape = F.col(line), r"^(\S+)\s+(.*?)\s+\d+\s+(\d{4}-?\d{2}-?\d{2})\s+(edgar/data/(\d+)/\S+)\s*$"
    part = lambda k: F.regexp_extract(text, shape, k)
    rows = lines.select(
        part(1).alias("form"), F.nullif(part(2), F.lit("")).alias("company"), pad_cik(part(5)).alias("cik"), normalize_date(part(3)).alias("filed"), accession_from_path(part(4)).alias("accession"), *[F.col(c) for c in [order] if c]
    )
    return _first(rows.where(F.col("form").isin(*FORMS) & F.col("accession").isNotNull()), ["accession", "cik"], order)


def master_index(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """form, company, cik, filed, accession of pipe-delimited lines; the first by `order` for each accession."""
    parts = F.split(F.col(line), r"\|")
    rows = lines.where(F.size(parts) == 5).select(parts[2].alias("form"), parts[1].alias("company"), pad_cik(parts[0]).alias("cik"), normalize_date(parts[3]).alias("filed"), accession_from_path(parts[4]).alias("accession"), *[F.col(c) for c in [order] if c])
    return _first(rows.where(F.col("form").isin(*FORMS) & F.col("accession").isNotNull()), ["accession"], order)


def filers_on(index: DataFrame, day: Column) -> DataFrame:
    """cik: the distinct managers of a form index that filed on a day."""
    return index.where(F.col("filed") == day).select("cik").distinct()


def latest_report(filings: DataFrame) -> DataFrame:
    """cik and accession of each manager's newest holdings report (filed, then accession)."""
    return filings.where("form = '13F-HR'").groupBy("cik").agg(F.max_by("accession", F.struct("filed", "accession")).alias("accession"))


def index_headers(docs: DataFrame, html: str = "html") -> DataFrame:
    """accession, form, cik (of the first filer), ciks, former_names, period_end, filed, accepted (UTC), documents and info_table_file of filings' index headers.

    Fields are read from a tag or from a label, whatever their case. Documents may lack their closing tag; only one of the type
    INFORMATION TABLE, whole and in any case, is the table.
    """
    text = unescape_html(F.col(html))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    tagged = lambda name: blank(F.regexp_extract(text, rf"(?i)<{name}>[ \t]*([^<\r\n]+)", 1))
    field = lambda name: F.coalesce(tagged(name), blank(F.regexp_extract(text, rf"(?im)^\s*{name}:\s*([^\r\n<]+)", 1)))
    every = lambda label: F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){label}:[ \t]*([^\r\n<]+)"), F.lit(1)), F.trim)
    parts = F.split(text, "(?i)<DOCUMENT>")
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    own = lambda block, name: blank(F.regexp_extract(F.split(block, "(?i)</DOCUMENT>|</SEC-DOCUMENT>")[0], rf"(?im)^<{name}>[ \t]*([^<\r\n]*)", 1)).alias(name.lower())
    documents = F.transform(blocks, lambda d: F.struct(*[own(d, n) for n in ("TYPE", "SEQUENCE", "FILENAME", "DESCRIPTION")]))
    table = F.get(F.filter("documents", lambda d: F.upper(d["type"]) == "INFORMATION TABLE"), F.lit(0))
    ciks = F.transform(every("CENTRAL INDEX KEY"), pad_cik)
    return docs.select(
        F.nullif(F.regexp_extract(text, ACCESSION, 0), F.lit("")).alias("accession"), field("CONFORMED SUBMISSION TYPE").alias("form"), F.get(ciks, F.lit(0)).alias("cik"), ciks.alias("ciks"), every("FORMER CONFORMED NAME").alias("former_names"),
        normalize_date(field("CONFORMED PERIOD OF REPORT")).alias("period_end"), normalize_date(field("FILED AS OF DATE")).alias("filed"), eastern_stamp_to_utc(field("ACCEPTANCE-DATETIME")).alias("accepted"), documents.alias("documents"),
    ).withColumn("info_table_file", table["filename"])


FILED = ("accessionNumber", "form", "filingDate", "reportDate")
LISTS = ",".join(f"{c}:array<string>" for c in FILED)


def submissions(docs: DataFrame, json: str = "json", pages: DataFrame | None = None) -> DataFrame:
    """cik, accession, form, filed, period_end: parallel arrays turned into rows, forms that start with 13F only.

    A document holds a manager's newest filings. Older ones stand in pages of the same arrays, which it names (older_pages()); `pages` (cik, and json) are those
    that were read. An accession that both have comes once.
    """
    parsed = docs.select(F.from_json(F.col(json), f"cik string, filings struct<recent:struct<{LISTS}>>").alias("j"))
    lists = parsed.select(F.col("j.cik").alias("cik"), *[F.col(f"j.filings.recent.{c}").alias(c) for c in FILED])
    if pages is not None:
        older = pages.select("cik", F.from_json(F.col(json), LISTS.replace(":", " ")).alias("j"))
        lists = lists.unionByName(older.select("cik", *[F.col(f"j.{c}").alias(c) for c in FILED]))
    rows = lists.select(pad_cik(F.col("cik")).alias("cik"), F.inline(F.arrays_zip(*[F.col(c) for c in FILED]))).toDF("cik", "accession", "form", "filed", "period_end")
    rows = rows.where(F.startswith("form", F.lit("13F"))).withColumn("filed", normalize_date(F.col("filed"))).withColumn("period_end", normalize_date(F.col("period_end")))
    return rows if pages is None else rows.dropDuplicates(["cik", "accession"])


def older_pages(docs: DataFrame, json: str = "json") -> DataFrame:
    """cik and name of the pages of older filings that a manager's document names."""
    parsed = docs.select(F.from_json(F.col(json), "cik string, filings struct<files:array<struct<name:string>>>").alias("j"))
    return parsed.select(pad_cik(F.col("j.cik")).alias("cik"), F.explode("j.filings.files.name").alias("name"))


def bulk_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated bulk table; columns go by the header's names, whatever their order."""
    raw = spark.read.option("sep", "\t").option("header", True).option("encoding", "ISO-8859-1").option("quote", "").option("inferSchema", False).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


SUBMISSION = "ACCESSION_NUMBER string, CIK string, SUBMISSIONTYPE string, PERIODOFREPORT string, FILING_DATE string"
COVERPAGE = "ACCESSION_NUMBER string, REPORTTYPE string, FILINGMANAGER_NAME string, FILINGMANAGER_STATEORCOUNTRY string, ISAMENDMENT string, AMENDMENTTYPE string, AMENDMENTNO string"
SUMMARYPAGE = "ACCESSION_NUMBER string, TABLEENTRYTOTAL string, TABLEVALUETOTAL string, ISCONFIDENTIALOMITTED string, OTHERINCLUDEDMANAGERSCOUNT string"
INFOTABLE = "ACCESSION_NUMBER string, INFOTABLE_SK string, NAMEOFISSUER string, TITLEOFCLASS string, CUSIP string, FIGI string, VALUE string, SSHPRNAMT string, SSHPRNAMTTYPE string, PUTCALL string, VOTING_AUTH_SOLE string, VOTING_AUTH_SHARED string, VOTING_AUTH_NONE string"


def bulk_filings(submission: DataFrame, cover: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each submission of a 13F form, with its cover and summary page where there are any.

    A notice is declared by its form or report type, never inferred. Of repeated rows of one accession the least counts.
    """
    yes = lambda c: F.coalesce(F.upper(F.trim(c)) == "Y", F.lit(False))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    one = lambda d: _first(d.where("ACCESSION_NUMBER is not null"), ["ACCESSION_NUMBER"], None)
    rows = one(submission).join(one(cover), "ACCESSION_NUMBER", "left").join(one(summary), "ACCESSION_NUMBER", "left")
    form = F.upper(F.trim("SUBMISSIONTYPE"))
    kind = F.upper(F.coalesce("REPORTTYPE", F.lit("")))
    return rows.where(F.startswith(form, F.lit("13F"))).select(
        F.col("ACCESSION_NUMBER").alias("accession"), pad_cik(F.col("CIK")).alias("cik"), F.coalesce(blank("FILINGMANAGER_NAME"), F.lit("UNKNOWN")).alias("name"), blank("FILINGMANAGER_STATEORCOUNTRY").alias("state"), form.alias("form"),
        normalize_date(F.col("PERIODOFREPORT")).alias("period_end"), normalize_date(F.col("FILING_DATE")).alias("filed"), (F.contains(form, F.lit("/A")) | yes("ISAMENDMENT")).alias("is_amendment"), blank(F.upper("AMENDMENTTYPE")).alias("amendment_type"), as_int(F.col("AMENDMENTNO")).alias("amendment_no"),
        blank("REPORTTYPE").alias("report_type"), (F.startswith(form, F.lit("13F-NT")) | F.contains(kind, F.lit("NOTICE"))).alias("is_notice"), F.contains(kind, F.lit("COMBINATION")).alias("is_combination"),
        as_int(F.col("TABLEENTRYTOTAL")).alias("table_entry_total"), as_int(F.col("TABLEVALUETOTAL")).alias("table_value_total"), yes("ISCONFIDENTIALOMITTED").alias("confidential_omitted"),
    )


def bulk_rows(info: DataFrame, filings: DataFrame) -> DataFrame:
    """The rows of a bulk information table that belong to one of the filings; others are dropped."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    whole = lambda c: F.coalesce(as_int(F.col(c)), F.lit(0))
    return info.withColumnRenamed("ACCESSION_NUMBER", "accession").join(filings.select("accession", "cik", "period_end"), "accession").select(
        "accession", "cik", "period_end", as_int(F.col("INFOTABLE_SK")).alias("row_seq"), F.coalesce(blank("NAMEOFISSUER"), F.lit("")).alias("name"), blank("TITLEOFCLASS").alias("title_of_class"), F.upper(F.trim("CUSIP")).alias("cusip"), blank("FIGI").alias("figi"),
        whole("VALUE").alias("value_raw"), whole("SSHPRNAMT").alias("shares"), F.upper(F.coalesce(blank("SSHPRNAMTTYPE"), F.lit("SH"))).alias("unit"), blank("PUTCALL").alias("put_call"), *[whole(f"VOTING_AUTH_{v.upper()}").alias(f"voting_{v}") for v in ("sole", "shared", "none")],
    )


def zip_lines(archives: DataFrame, entry: str, encoding: str = "ISO-8859-1", chunk: int = 4 << 20) -> DataFrame:
    """path, n (from 1) and line of the entry of that base name, in any folder and case, of zip archives (path, content: as the binaryFile format reads them).

    An archive is unpacked by one task, a chunk at a time; its lines come out in pieces of about `chunk` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in (i.filename for i in archive.infolist() if i.filename.rsplit("/", 1)[-1].upper() == entry.upper()):
                        n, rest = 0, b""
                        with archive.open(name) as f:
                            while True:
                                piece = f.read(chunk)
                                lines = (rest + piece).split(b"\n")
                                rest = lines.pop() if piece else b""
                                if not piece and lines == [b""]:
                                    lines = []
                                told = [x.removesuffix(b"\r").decode(encoding) for x in lines]
                                yield pa.RecordBatch.from_pydict({"path": [path] * len(told), "n": list(range(n + 1, n + len(told) + 1)), "line": told}, schema=pa.schema([("path", pa.string()), ("n", pa.int64()), ("line", pa.string())]))
                                n += len(told)
                                if not piece:
                                    break

    return archives.select("path", "content").mapInArrow(run, "path string, n long, line string")


def table_of_lines(lines: DataFrame, schema: str, sep: str = "\t") -> DataFrame:
    """Columns of `schema` (strings) by the names in each archive's first line (path, n, line); missing columns are null, blank lines are left out."""
    heads = lines.where("n = 1").select("path", F.transform(F.split("line", F.lit(_quoted(sep))), lambda c: F.upper(F.trim(c))).alias("_head"))
    cells = lines.where("n > 1 and trim(line) <> ''").join(F.broadcast(heads), "path")  # a row for each archive
    values = F.split("line", F.lit(_quoted(sep)), -1)
    names = [f.strip().split()[0] for f in schema.split(",")]
    cell = lambda name: F.when(F.array_position("_head", name) > 0, F.get(values, (F.array_position("_head", name) - 1).cast("int"))).alias(name)
    return cells.select(*map(cell, names))


def _quoted(sep: str) -> str:
    return "".join("\\" + c if c in "|.^$*+?" else c for c in sep)


def fails_to_deliver(lines: DataFrame, order: Column) -> DataFrame:
    """cusip, ticker: the first row by `order` for each cusip."""
    first = Window.partitionBy("cusip").orderBy(order)
    return lines.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fails_lines(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """cusip, ticker and `order` of pipe-delimited lines (date, cusip, symbol, ...); headings and lines without a symbol are left out."""
    parts = F.split(F.col(line), r"\|")
    cusip, ticker = F.upper(F.trim(F.get(parts, F.lit(1)))), F.upper(F.trim(F.get(parts, F.lit(2))))
    return lines.select(cusip.alias("cusip"), ticker.alias("ticker"), order).where(F.col("cusip").rlike("^[0-9A-Z]{9}$") & (F.col("ticker") != ""))


ARCHIVED = """accession string, cik string, form string, period_end string, filed string, accepted string, schema_version string, amendment_type string, table_value_total bigint,
rows array<struct<row_seq:bigint,name:string,title_of_class:string,cusip:string,figi:string,value_raw:bigint,shares:bigint,unit:string,put_call:string>>"""


def archived_filings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Filings and their as-filed rows, of gzipped JSON records with a filing each; records without accession, filer or quarter are left out."""
    read = spark.read.schema(ARCHIVED).json(path).withColumn("period_end", normalize_date(F.col("period_end"))).withColumn("cik", pad_cik(F.col("cik")))
    read = read.where("accession is not null and cik is not null and period_end is not null").withColumn("filed", normalize_date(F.col("filed"))).withColumn("accepted", F.try_to_timestamp("accepted"))
    return read.drop("rows"), read.select("accession", "cik", "period_end", F.inline("rows"))


COVER = """schemaVersion string, headerData struct<submissionType:string,filerInfo:struct<filer:struct<credentials:struct<cik:string>>,periodOfReport:string>>,
formData struct<coverPage:struct<reportCalendarOrQuarter:string,isAmendment:string,amendmentNo:string,amendmentInfo:struct<amendmentType:string>,filingManager:struct<name:string>,reportType:string>,
summaryPage:struct<otherIncludedManagersCount:string,tableEntryTotal:string,tableValueTotal:string,isConfidentialOmitted:string>>"""


def cover_page(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """A cover page's facts in columns of their own, whatever its namespace prefix; other columns stay."""
    c = F.from_xml(F.col(xml), F.lit(COVER), {"ignoreNamespace": "true"})
    cover, summary = c["formData"]["coverPage"], c["formData"]["summaryPage"]
    true = lambda x: F.coalesce(F.lower(F.trim(x)).isin("true", "y", "1"), F.lit(False))
    form = c["headerData"]["submissionType"]
    notice = F.startswith(form, F.lit("13F-NT")) | F.coalesce(F.contains(F.upper(cover["reportType"]), F.lit("NOTICE")), F.lit(False))
    return docs.select(
        *[x for x in docs.columns if x != xml], F.trim(c["schemaVersion"]).alias("schema_version"), form.alias("form"), pad_cik(c["headerData"]["filerInfo"]["filer"]["credentials"]["cik"]).alias("cik"),
        F.coalesce(normalize_date(cover["reportCalendarOrQuarter"]), normalize_date(c["headerData"]["filerInfo"]["periodOfReport"])).alias("period_end"), F.trim(cover["filingManager"]["name"]).alias("manager"),
        true(cover["isAmendment"]).alias("is_amendment"), as_int(cover["amendmentNo"]).alias("amendment_no"), F.upper(F.trim(cover["amendmentInfo"]["amendmentType"])).alias("amendment_type"), cover["reportType"].alias("report_type"), notice.alias("is_notice"),
        as_int(summary["tableEntryTotal"]).alias("table_entry_total"), as_int(summary["tableValueTotal"]).alias("table_value_total"), true(summary["isConfidentialOmitted"]).alias("confidential_omitted"),
    )


def daily_index_dates(docs: DataFrame, json: str = "json") -> DataFrame:
    """day: the dates of the form indexes that a directory listing names."""
    items = docs.select(F.explode(F.from_json(F.col(json), "directory struct<item:array<struct<name:string>>>")["directory"]["item"]["name"]).alias("name"))
    return items.select(F.to_date(F.nullif(F.regexp_extract("name", r"^form\.(\d{8})\.idx", 1), F.lit("")), "yyyyMMdd").alias("day")).where("day is not null").distinct()


def ticker_directory(docs: DataFrame, json: str = "json") -> DataFrame:
    """cik, ticker, title of an object of objects."""
    entries = F.map_values(F.from_json(F.col(json), "map<string,struct<cik_str:bigint,ticker:string,title:string>>"))
    return docs.select(F.explode(entries).alias("e")).select(pad_cik(F.col("e.cik_str")).alias("cik"), F.upper("e.ticker").alias("ticker"), F.col("e.title").alias("title"))


def statement_codes(lines: DataFrame) -> DataFrame:
    """cik, sic and quarter of the sub.txt entries, in any folder and case, of archives of financial statements (archive, entry, n, line: as archives.entries() reads them).

    The quarter is in an archive's name. Columns go by the names in the first line; an archive without cik and sic there has no rows, nor have lines
    without both. Of a manager's lines in a quarter the first counts.
    """
    own = lines.where(F.upper(F.substring_index("entry", "/", -1)) == "SUB.TXT").withColumn("_cells", F.split("line", "\t", -1))
    heads = own.where("n = 1").select("archive", "entry", F.transform("_cells", lambda c: F.lower(F.trim(c))).alias("_head"))
    at = lambda name: F.when(F.array_position("_head", name) > 0, F.get("_cells", (F.array_position("_head", name) - 1).cast("int"))).try_cast("bigint")
    rows = own.where("n > 1").join(F.broadcast(heads), ["archive", "entry"])  # a row for each archive
    told = rows.select(at("cik").alias("cik"), at("sic").alias("sic"), F.regexp_extract(F.lower("archive"), r"(\d{4}q[1-4])", 1).alias("quarter"), "n").where("cik > 0 and sic > 0 and quarter <> ''")
    return told.groupBy("cik", "quarter").agg(F.min_by("sic", "n").cast("string").alias("sic")).select(F.col("cik").cast("string").alias("cik"), "sic", "quarter")


def industry_codes(rows: DataFrame) -> DataFrame:
    """cik, sic: of statements (cik, sic, quarter) the code of the newest quarter that has one."""
    return rows.where("sic is not null").groupBy(pad_cik(F.col("cik")).alias("cik")).agg(F.max_by("sic", "quarter").alias("sic"))
