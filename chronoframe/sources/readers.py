"""Landed files as typed frames. Schemas are stated and checked, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_columns(found: Sequence[str], expected: Sequence[str]) -> None:
    """Refuse a table whose columns are not exactly the expected ones, naming what is missing and what is new."""
    missing, new = sorted(set(expected) - set(found)), sorted(set(found) - set(expected))
    if missing or new:
        raise ValueError(f"columns differ: missing {missing}, unexpected {new}")


def read_tab_separated(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """A tab-separated file with a header, all columns strings; fails if the header or a row is not as stated."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    check_columns(header, columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("multiLine", multi_line).csv(path)


def typed_filings(sub: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Filings with checked keys and UTC acceptance from a local wall time; rows with a bad key have ``issue``."""
    bad = F.array_compact(F.array(
        F.when(~F.rlike("adsh", F.lit(r"^\d{10}-\d{2}-\d{6}$")), F.lit("accession")),
        F.when(F.coalesce(F.col("cik").try_cast("bigint"), F.lit(0)) <= 0, F.lit("cik")),
        F.when(F.try_to_date("filed", "yyyyMMdd").isNull(), F.lit("filed")),
    ))
    accepted = F.to_utc_timestamp(F.try_to_timestamp("accepted", F.lit("yyyy-MM-dd HH:mm:ss")), zone)
    return sub.select("adsh", F.col("cik").try_cast("bigint").alias("cik"), "form", F.try_to_date("filed", "yyyyMMdd").alias("filed"), F.try_to_date("period", "yyyyMMdd").alias("period"), accepted.alias("accepted"), F.array_join(bad, ",").alias("issue"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def typed_facts(num: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with what their filing says, and orphans without a filing."""
    value = F.col("value").try_cast("decimal(28,4)")
    facts = num.select("adsh", "tag", "version", F.try_to_date("ddate", "yyyyMMdd").alias("ddate"), F.col("qtrs").try_cast("smallint").alias("qtrs"), "uom", "segments", "coreg", value.alias("value"))
    known = filings.select("adsh", "cik", "form", "accepted")
    whole = (F.col("coreg").isNull() & F.col("segments").isNull()).alias("is_consolidated")
    return facts.join(known, "adsh").select("*", whole), facts.join(known, "adsh", "left_anti")


def consolidated_as_of(facts: DataFrame, cutoff: Column, columns: Sequence[str]) -> DataFrame:
    """Consolidated facts known at a cutoff; filter and projection reach the scan."""
    return facts.where((F.col("accepted") <= cutoff) & F.col("is_consolidated")).select(*columns)


COMPANY_FACTS = "cik bigint, entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>"


def company_facts(docs: DataFrame, json_col: str, filings: DataFrame) -> DataFrame:
    """Taxonomy, tag, unit and fact, four levels down; acceptance from the filing, problems as ``issue``."""
    d = docs.select(F.from_json(json_col, COMPANY_FACTS).alias("d")).select("d.cik", F.explode("d.facts").alias("taxonomy", "tags"))
    d = d.select("cik", "taxonomy", F.explode("tags").alias("tag", "body")).select("cik", "taxonomy", "tag", F.explode("body.units").alias("unit", "rows"))
    d = d.select("cik", "taxonomy", "tag", "unit", F.inline("rows"))
    j = d.join(filings.select(F.col("adsh").alias("accn"), "accepted", F.col("form").alias("_form")), "accn", "left")
    issue = F.when(F.col("accepted").isNull(), "missing_acceptance_join").when(F.col("form") != F.col("_form"), "form_mismatch").when(F.col("val").isNull() | F.try_to_date("end").isNull(), "invalid_fact")
    return j.withColumn("issue", issue).drop("_form")


def parallel_arrays(docs: DataFrame, key: Sequence[str], struct_col: str, fields: Sequence[str]) -> DataFrame:
    """One row per place of a struct of parallel arrays; shorter arrays give nulls."""
    zipped = F.arrays_zip(*(F.col(f"{struct_col}.{f}").alias(f) for f in fields))
    return docs.select(*key, F.inline_outer(zipped))


def form_index_keys(lines: DataFrame, start: int, length: int) -> DataFrame:
    """Distinct numeric keys at a fixed place of the lines of an index."""
    key = F.trim(F.substring("value", start, length)).try_cast("bigint")
    return lines.select(key.alias("key")).where("key IS NOT NULL").distinct()


def master_index(lines: DataFrame, since: Column, until: Column) -> DataFrame:
    """``(cik, name, form, filed, path)`` of a pipe-delimited index within dates; other lines are left out."""
    p = F.split("value", r"\|")
    rows = lines.where(F.size(p) == 5).select(F.get(p, 0).try_cast("bigint").alias("cik"), F.get(p, 1).alias("name"), F.get(p, 2).alias("form"), F.try_to_date(F.get(p, 3)).alias("filed"), F.get(p, 4).alias("path"))
    return rows.where(F.col("cik").isNotNull() & F.col("filed").between(since, until))


def observations(rows: DataFrame, calendar: DataFrame, series: Column, multiplier: float = 1.0) -> DataFrame:
    """``(series, observed, available, value, issue)`` from ``(date, value)`` texts and publication instants; ``.`` is missing."""
    value = F.when(F.col("value") != ".", F.col("value")).try_cast("double") * multiplier
    typed = rows.select(series.alias("series"), F.try_to_date("date").alias("observed"), value.alias("value")).where("value IS NOT NULL")
    j = typed.join(calendar, "observed", "left")
    return j.select("series", "observed", "available", "value", F.when(F.col("available").isNull(), "missing_instant").alias("issue"))


def membership(rows: DataFrame, start: str, end: str, least_open: int) -> DataFrame:
    """Membership intervals; rows with a bad start go, and too few open ones fail the query that reads them."""
    typed = rows.withColumn(start, F.try_to_date(start)).withColumn(end, F.try_to_date(F.nullif(F.trim(end), F.lit("")))).where(F.col(start).isNotNull())
    gate = F.broadcast(typed.agg(F.count_if(F.col(end).isNull()).alias("_open")))
    return typed.crossJoin(gate).where(F.when(F.col("_open") < least_open, F.raise_error(F.lit("too few open memberships")).isNull()).otherwise(True)).drop("_open")  # one row beside each


# The columns of the vendor's lifecycle file, in order.
LIFECYCLE = ("ticker", "exchange", "assetType", "priceCurrency", "startDate", "endDate")


def read_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, exchange, asset_type, currency, start, end)`` of a CSV file whose header must be :data:`LIFECYCLE`, in this order.

    Keys are trimmed and in upper case; an exchange may be empty, an end is null if open. A row of another
    width, an empty key, a bad date or an end before its start fails the query that reads it, as does a
    file without rows.
    """
    lines = spark.read.option("header", False).option("mode", "FAILFAST").schema(", ".join(f"{c} string" for c in LIFECYCLE)).csv(path)
    found = tuple(spark.read.option("header", True).csv(path).columns)
    if found != LIFECYCLE:
        raise ValueError(f"columns are {found}, not {LIFECYCLE}")
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(lines.schema).csv(path)
    if not rows.limit(1).count():
        raise ValueError("the file has no row")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    start, end = F.try_to_date(text("startDate")), F.try_to_date(F.nullif(text("endDate"), F.lit("")))
    problem = (
        F.when((text("ticker") == "") | (text("assetType") == "") | (text("priceCurrency") == ""), "an empty key")
        .when(start.isNull() | (end.isNull() & (text("endDate") != "")), "a bad date")
        .when(end < start, "an end before its start")
    )
    ok = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("lifecycle row with "), problem)).isNull()).otherwise(True)
    return rows.where(ok).select(F.upper(text("ticker")).alias("ticker"), F.upper(text("exchange")).alias("exchange"), text("assetType").alias("asset_type"), F.upper(text("priceCurrency")).alias("currency"), start.alias("start"), end.alias("end"))


def to_raw_facts(rows: DataFrame, names: dict[str, str], schema: T.StructType) -> DataFrame:
    """``rows`` in the bulk source's schema: ``names`` tells each column's name in ``rows``, the others are null; dates may be yyyymmdd texts."""

    def typed(f: T.StructField):
        c = F.col(names[f.name]) if f.name in names else F.lit(None)
        if isinstance(f.dataType, T.DateType) and f.name in names and isinstance(rows.schema[names[f.name]].dataType, T.StringType):
            return F.try_to_date(c, "yyyyMMdd").alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return rows.select(*(typed(f) for f in schema.fields))


def union_of_sources(bulk: DataFrame, edge: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the bulk source, and those of the edge whose key it lacks, with their ``source``: an anti join on the key."""
    fresh = edge.join(bulk.select(*key).distinct(), list(key), "left_anti").select(bulk.columns)
    return bulk.withColumn("source", F.lit("bulk")).unionByName(fresh.withColumn("source", F.lit("edge")))


def two_state_listing(active: DataFrame, delisted: DataFrame) -> DataFrame:
    return active.withColumn("state", F.lit("active")).unionByName(delisted.withColumn("state", F.lit("delisted")))


def wanted_files(spark: SparkSession, path: str, wanted: DataFrame, pattern: str, key: str) -> DataFrame:
    """Whole JSON documents of a folder whose name holds a wanted key."""
    docs = spark.read.option("wholetext", True).text(path).withColumn(key, F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("bigint"))
    return docs.join(wanted.select(key).distinct(), key, "left_semi")


def bar_pages(docs: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """Bars of vendor pages (symbol -> array of bars), and those that are not sound."""
    kind = "map<string,array<struct<t:timestamp,o:double,h:double,l:double,c:double,v:bigint>>>"
    rows = docs.select(F.explode(F.from_json(json_col, kind)).alias("symbol", "bars")).select("symbol", F.inline("bars"))
    sound = F.coalesce((F.col("o") > 0) & (F.col("c") > 0) & (F.col("h") >= F.greatest("o", "c", "l")) & (F.col("l") <= F.least("o", "c")) & (F.col("v") >= 0), F.lit(False))
    return rows.where(sound), rows.where(~sound)


def header_field(body: Column, pattern: str) -> Column:
    """The only distinct match of a pattern's first group in a text, else null."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def macro_table(long: DataFrame, date: str, series: str, value: str, names: Sequence[str], start: Column) -> DataFrame:
    """Series of different calendars as one daily table, carried forward, from a start date on."""
    from pyspark.sql import Window

    wide = long.groupBy(date).pivot(series, list(names)).agg(F.last(value))
    w = Window.partitionBy(F.lit(1)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return wide.select(date, *(F.last(n, ignorenulls=True).over(w).alias(n) for n in names)).where(F.col(date) >= start)


def xml_facts(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``(id, name, context, unit, decimals, value)`` of the leaf elements of XML documents that name a context."""
    kind = docs.schema[id_col].dataType.simpleString()

    def parse(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for b in batches:
            rows = []
            for name, body in zip(b["_id"], b["_xml"], strict=True):
                try:
                    root = ET.fromstring(body)
                except (ET.ParseError, TypeError):
                    continue
                rows += [(name, e.tag.rpartition("}")[2], e.get("contextRef"), e.get("unitRef"), e.get("decimals"), (e.text or "").strip()) for e in root.iter() if e.get("contextRef")]
            yield pd.DataFrame(rows, columns=["_id", "name", "context", "unit", "decimals", "value"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(xml_col).alias("_xml")).mapInPandas(parse, f"_id {kind}, name string, context string, unit string, decimals string, value string")
    return out.withColumnRenamed("_id", id_col)


def tag_view(df: DataFrame, view: str) -> DataFrame:
    """``df`` with the name of its view in the metadata of its first column; Parquet keeps it."""
    first = df.columns[0]
    return df.withMetadata(first, {**df.schema[first].metadata, "view": view})


def read_pit_as_of(df: DataFrame, cutoff: Column, available: str, columns: Sequence[str]) -> DataFrame:
    """Facts of a view tagged ``pit`` known at a cutoff; another view or an unknown column is refused."""
    if df.schema[0].metadata.get("view") != "pit":
        raise ValueError("not a point-in-time view")
    if unknown := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"unknown columns: {unknown}")
    return df.where(F.col(available) <= cutoff).select(*columns)


def requested_symbols(rows: DataFrame, wanted: DataFrame, symbol: str, file_symbol: Column) -> DataFrame:
    """Rows of wanted symbols; a row whose symbol is not its file's fails the query that reads it."""
    same = F.when(F.col(symbol) != file_symbol, F.raise_error(F.lit("a row's symbol is not its file's")).isNull()).otherwise(True)
    return rows.where(same).join(wanted.select(symbol).distinct(), symbol, "left_semi")


def declared_actions(pages: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """``(symbol, day, action, amount)`` from one array column a kind: name -> (date field, amount field)."""
    out = None
    for kind, (day, amount) in kinds.items():
        one = pages.select(F.explode(kind).alias("x")).select(F.col("x.symbol").alias("symbol"), F.to_date(F.col(f"x.{day}")).alias("day"), F.lit(kind).alias("action"), F.col(f"x.{amount}").cast("double").alias("amount"))
        out = one if out is None else out.unionByName(one)
    return out


def associations(docs: DataFrame, json_col: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of documents of named fields and arrays of values, and the number of unusable ones (a null among them)."""
    rows = docs.select(F.explode(F.from_json(json_col, "data array<array<string>>")["data"]).alias("v"))
    named = rows.select(*(F.get("v", i).alias(f) for i, f in enumerate(fields)))
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return named.where(whole), named.agg(F.count_if(~whole).alias("unusable"))
