"""Filings: company facts as nested maps, and quarterly archives of holdings with their amendments."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALUE = "decimal(38,10)"
#: An entry of a unit's list. `val` is read as a decimal straight from its digits; text that is no number, or one too large, becomes null.
_ENTRY = f"start: string, end: string, val: {VALUE}, accn: string, fy: string, fp: string, form: string, filed: string, accepted: string, frame: string"
FACTS_SCHEMA = f"cik string, entityName string, facts map<string, map<string, struct<label: string, description: string, units: map<string, array<struct<{_ENTRY}>>>>>>"


def company_facts(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """A row for each fact of company documents: (cik, entity, taxonomy, tag, unit, value, start, end, fy, fp, form, filed, accepted, accession, frame, fault).

    The maps taxonomy, tag and unit are keyed by data; they are exploded one after the other. `fault` says why a fact is
    no good, and is null for good ones: json (the document does not parse; its one row holds nothing else), value (none, or none that VALUE
    holds), end or accession (missing). `accepted` falls back on the filing date. Numbers don't pass through floating point.
    """
    # from_json keeps what it has read of a document that breaks off; the keys are null unless all of it is an object
    x = documents.select(F.when(F.json_object_keys(json_col).isNotNull(), F.from_json(json_col, FACTS_SCHEMA, {"mode": "PERMISSIVE"})).alias("d"))
    none = F.col("d.cik").isNull() & F.col("d.facts").isNull()
    x = x.select(F.col("d.cik").cast("long").alias("cik"), F.col("d.entityName").alias("entity"), none.alias("_bad"), F.explode_outer("d.facts").alias("taxonomy", "_tags"))
    x = x.select("cik", "entity", "_bad", "taxonomy", F.explode_outer("_tags").alias("tag", "_tag"))
    x = x.select("cik", "entity", "_bad", "taxonomy", "tag", F.explode_outer("_tag.units").alias("unit", "_rows"))
    x = x.select("cik", "entity", "_bad", "taxonomy", "tag", "unit", F.explode_outer("_rows").alias("e"))
    x = x.where(F.col("_bad") | F.col("e").isNotNull())
    value = F.col("e.val")
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    fault = F.when(F.col("_bad"), "json").when(value.isNull(), "value").when(given(F.col("e.end")).isNull(), "end").when(given(F.col("e.accn")).isNull(), "accession")
    day = lambda c: F.expr(f"try_cast(e.{c} AS date)")
    return x.select("cik", "entity", "taxonomy", "tag", "unit", value.alias("value"), day("start").alias("start"), day("end").alias("end"), F.expr("try_cast(e.fy AS int)").alias("fy"), F.col("e.fp").alias("fp"), F.col("e.form").alias("form"), day("filed").alias("filed"), F.coalesce(F.col("e.accepted"), F.col("e.filed")).alias("accepted"), F.col("e.accn").alias("accession"), F.col("e.frame").alias("frame"), fault.alias("fault"))


def with_acceptance(facts: DataFrame, submissions: DataFrame) -> DataFrame:
    """Facts whose acceptance is missing or only the filing date take that, and a missing form and filing date, from submissions (accession, accepted, filed, form)."""
    s = submissions.groupBy("accession").agg(F.max(F.struct("accepted", "filed", "form")).alias("_s")).where("accession is not null")
    x = facts.join(s, "accession", "left")
    weak = F.col("accepted").isNull() | F.col("accepted").eqNullSafe(F.col("filed").cast("string"))
    x = x.withColumns({"accepted": F.when(weak, F.coalesce("_s.accepted", "accepted")).otherwise(F.col("accepted")), "filed": F.coalesce("filed", F.expr("try_cast(_s.filed AS date)")), "form": F.coalesce("form", "_s.form")})
    return x.select(*facts.columns)


FACT_KEY = ["cik", "taxonomy", "tag", "unit", "start", "end", "accession"]


def normal_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good facts, one for each FACT_KEY; quarantined rows with their fault). Of facts of one key the last accepted stays, then the greatest value; the others are quarantined as repeated or, with another value, as conflict."""
    w = Window.partitionBy(*FACT_KEY).orderBy(F.desc_nulls_last("accepted"), F.desc("value"), F.desc_nulls_last("frame"))
    good = facts.where("fault is null").withColumns({"_r": F.row_number().over(w), "_v": F.first("value").over(w)})
    again = good.where("_r > 1").withColumn("fault", F.when(F.col("value") == F.col("_v"), "repeated").otherwise("conflict"))
    return good.where("_r = 1").select(*facts.columns), facts.where("fault is not null").unionByName(again.select(*facts.columns))


#: Members of an archive and the columns that each must have.
MEMBERS = {
    "SUBMISSION": ("ACCESSION_NUMBER", "FILING_DATE", "SUBMISSIONTYPE", "CIK", "PERIODOFREPORT"),
    "COVERPAGE": ("ACCESSION_NUMBER",),
    "INFOTABLE": ("ACCESSION_NUMBER", "NAMEOFISSUER", "TITLEOFCLASS", "CUSIP", "VALUE", "SSHPRNAMT", "SSHPRNAMTTYPE", "PUTCALL", "INVESTMENTDISCRETION"),
}
OPTIONAL = ("ISAMENDMENT", "AMENDMENTNO", "AMENDMENTTYPE")
_ROWS = 10_000


def archive_rows(archives: DataFrame) -> DataFrame:
    """(path, member, fields map<string, string>) of all rows of archives (path, content); an archive that lacks a member or a column fails with its name.

    An archive is opened in the task that holds it, and its members are read line by line, so that a task holds the archive and 10,000 rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member, needed in MEMBERS.items():
                        names = [n for n in z.namelist() if n.rsplit("/", 1)[-1].upper() in (f"{member}.TSV", f"{member}.TXT")]
                        if len(names) != 1:
                            raise ValueError(f"{path}: one {member} table is expected, found {names}")
                        with io.TextIOWrapper(z.open(names[0]), encoding="utf-8-sig", errors="replace", newline="") as lines:
                            reader = csv.reader(lines, delimiter="\t")
                            columns = [c.strip().upper() for c in next(reader, [])]
                            if missing := sorted(set(needed) - set(columns)):
                                raise ValueError(f"{path}: {member} lacks {', '.join(missing)}")
                            held: list[dict] = []
                            for row in reader:
                                held.append({c: v for c, v in zip(columns, row, strict=False) if v != ""})
                                if len(held) == _ROWS:
                                    yield pd.DataFrame({"path": path, "member": member, "fields": held})
                                    held = []
                            if held:
                                yield pd.DataFrame({"path": path, "member": member, "fields": held})

    return archives.select("path", "content").mapInPandas(run, "path string, member string, fields map<string, string>")


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """`archive_rows` of the zip files that a path or pattern names; an archive is at most 2 GB."""
    return archive_rows(spark.read.format("binaryFile").load(pattern).select("path", "content"))


def _member(rows: DataFrame, member: str, columns: tuple[str, ...]) -> DataFrame:
    one = lambda c: F.trim(F.col("fields")[c])
    return rows.where(F.col("member") == member).select(*[one(c).alias(c) for c in columns])


def holdings(rows: DataFrame, additions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filings, holdings, exclusions) from `archive_rows`.

    filings: (accession, manager, filed, period), what holds for a manager and period: the last initial filing
    where nothing amends it; the last amendment where it is a restatement, which replaces all before it. Where the last amendment
    adds holdings or does not say what it is, the group is excluded with its reason; with `additions` amendments of
    new holdings are joined to the last initial filing or restatement before them instead. holdings: shares and value of each filing and
    security, of shares alone (no options, no principal amounts). Filings without a date, period or manager are left out; last is by date, then accession.
    """
    sub = _member(rows, "SUBMISSION", MEMBERS["SUBMISSION"])
    sub = sub.where(F.col("SUBMISSIONTYPE").isin("13F-HR", "13F-HR/A")).select(
        F.col("ACCESSION_NUMBER").alias("accession"), _day("FILING_DATE").alias("filed"), _day("PERIODOFREPORT").alias("period"),
        F.ltrim(F.regexp_replace("CIK", r"\D", ""), F.lit("0")).alias("manager"), (F.col("SUBMISSIONTYPE") == "13F-HR/A").alias("amends"),
    ).where("filed is not null and period is not null and manager != ''").dropDuplicates(["accession"])
    cover = _member(rows, "COVERPAGE", ("ACCESSION_NUMBER", *OPTIONAL)).groupBy(F.col("ACCESSION_NUMBER").alias("accession")).agg(F.max(F.upper("AMENDMENTTYPE")).alias("kind"))
    x = sub.join(cover, "accession", "left").withColumn("kind", F.coalesce("kind", F.lit("")))
    order = F.struct("filed", "accession")
    w = Window.partitionBy("manager", "period")
    restates, adds = F.col("amends") & F.col("kind").contains("RESTATEMENT"), F.col("amends") & F.col("kind").contains("NEW HOLDINGS")
    x = x.withColumns({"_first": F.max(F.when(~F.col("amends"), order)).over(w), "_last": F.max(F.when(F.col("amends"), order)).over(w), "_whole": F.max(F.when(~F.col("amends") | restates, order)).over(w)})
    x = x.withColumn("_unclear", F.max(F.when(F.col("amends") & (order > F.coalesce("_whole", F.struct(F.lit("0001-01-01").cast("date").alias("filed"), F.lit("").alias("accession")))) & ~adds, F.lit(1)).otherwise(0)).over(w))
    plain = F.when(F.col("_last").isNull(), order == F.col("_first")).otherwise((order == F.col("_last")) & restates)
    if additions:
        holds = (F.col("_unclear") == 0) & F.col("_whole").isNotNull() & ((order == F.col("_whole")) | (adds & (order > F.col("_whole"))))
        out = (order == F.col("_last")) & ((F.col("_unclear") == 1) | F.col("_whole").isNull())
    else:
        holds, out = plain, (order == F.col("_last")) & ~restates
    filings = x.where(holds).select("accession", "manager", "filed", "period")
    exclusions = x.where(out).select("manager", "period", "accession", F.lit("non_restatement_or_ambiguous_amendment").alias("reason"), F.col("kind").alias("amendment_type"))
    info = _member(rows, "INFOTABLE", MEMBERS["INFOTABLE"]).withColumnRenamed("ACCESSION_NUMBER", "accession")
    cusip, shares, value = F.regexp_replace(F.upper("CUSIP"), "[^A-Z0-9]", ""), F.expr("try_cast(SSHPRNAMT AS double)"), F.expr("try_cast(VALUE AS double)")
    info = info.select("accession", cusip.alias("cusip"), F.col("NAMEOFISSUER").alias("issuer"), F.col("TITLEOFCLASS").alias("title"), shares.alias("shares"), value.alias("value"), F.upper(F.coalesce("SSHPRNAMTTYPE", F.lit(""))).alias("_k"), F.coalesce("PUTCALL", F.lit("")).alias("_o"))
    info = info.where(F.col("cusip").rlike("^[A-Z0-9]{9}$") & (F.col("_k") == "SH") & (F.col("_o") == "") & (F.col("shares") > 0))
    g = info.join(filings, "accession").groupBy("accession", "manager", "filed", "period", "cusip", "issuer", "title").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))
    return filings, g, exclusions


def _day(c: str):
    """A date written as ISO or as day, month name, year."""
    return F.coalesce(F.expr(f"try_cast({c} AS date)"), F.expr(f"cast(try_to_timestamp(initcap({c}), 'dd-MMM-yyyy') AS date)"))


def zipped(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(path, content): an archive for each value of `key`, of tables by member name; rows of a value meet in one task, which writes them."""
    packed = [t.select(F.col(key).cast("string").alias("path"), F.lit(m).alias("member"), F.to_json(F.struct(*[c for c in t.columns if c != key])).alias("row")) for m, t in tables.items()]
    columns = {m: [c for c in t.columns if c != key] for m, t in tables.items()}

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        import json

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, names in columns.items():
                text = io.StringIO(newline="")
                writer = csv.writer(text, delimiter="\t", lineterminator="\n")
                writer.writerow(names)
                for row in map(json.loads, sorted(frame["row"][frame["member"] == m])):
                    writer.writerow([row.get(c, "") for c in names])
                z.writestr(f"{m}.tsv", text.getvalue())
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [out.getvalue()]})

    return reduce(DataFrame.unionByName, packed).groupBy("path").applyInPandas(pack, "path string, content binary")
