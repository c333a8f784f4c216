"""Reading and writing of cases, rules, expected invoices, readings and assortments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import basis_points, cents
from ..functions.reading import parse_hundredths
from ..functions.units import unit_table

#: Columns of an assortment file, and how CSV files are written.
ASSORTMENT = ("Produkt", "Bruttopreis", "USt", "Produkt-ID")
CSV = {"sep": ";", "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\r\n"}
MARK = "\ufeff"

LINE = "struct<no:bigint,name:string,sellerArticleId:string,gtin:string,quantity:bigint,unitText:string,unitCode:string,unitPrice:bigint,priceBaseQty:bigint,lineNet:bigint,vat:bigint,expectedProductId:string,expectedFactor:bigint>"
EXPECTED = f"source string, fileName string, supplierName string, supplierVatId string, number string, date string, currency string, netTotal bigint, grossTotal bigint, vatBreakdown array<struct<vat:bigint,net:bigint,tax:bigint>>, lines array<{LINE}>"
META = "struct<validFrom:string,validTo:string,changedAt:string,changedBy:string,rev:bigint>"
RULES = {
    "categories": f"struct<id:string,name:string,gewerbe:array<string>,gebinde:array<string>,sparte:string,meta:{META}>",
    "mappings": f"struct<id:string,supplierName:string,supplierArticleId:string,gtin:string,name:string,observed:string,unitCode:string,productId:string,factor:bigint,confirmed:boolean,meta:{META}>",
    "products": f"struct<id:string,name:string,unit:string,batch:bigint,categoryId:string,aliases:array<string>,piece:struct<amount:bigint,unit:string>,recipe:array<struct<partId:string,amount:bigint,unit:string>>,meta:{META}>",
    "yieldRules": f"struct<id:string,name:string,categoryId:string,productId:string,deduction:bigint,default:boolean,meta:{META}>",
    "gewerbezweige": f"struct<id:string,kennzahl:string,name:string,meta:{META}>",
    "templates": f"struct<id:string,name:string,source:string,default:boolean,meta:{META}>",
}


def read_expected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(invoices, lines) of golden invoice files; lines keep their place in the file as ord."""
    files = spark.read.schema(EXPECTED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.expected.json").json(path).withColumn("file", F.input_file_name())
    invoices = files.drop("lines").withColumn("date", F.to_date("date"))
    lines = files.select("file", F.posexplode("lines").alias("ord", "l")).select("file", (F.col("ord") + 1).cast("bigint").alias("ord"), "l.*")
    return invoices, lines


def read_ruleset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table per kind of rule out of one JSON file of maps from id to entry.

    An entry without an id gets its key, one without a change stamp the file's time. Every table has id, all fields of
    the entry, valid_from, valid_to, changed_at, changed_by and rev.
    """
    schema = ", ".join(f"`{k}` map<string,{v}>" for k, v in RULES.items())
    top = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_stamp", F.col("_metadata.file_modification_time"))
    out = {}
    for kind in RULES:
        e = top.select("_stamp", F.explode(kind).alias("key", "e")).select("_stamp", "key", "e.*")
        m = F.col("meta")
        out[kind] = e.withColumns({
            "id": F.coalesce(F.nullif("id", F.lit("")), "key"), "valid_from": F.to_date(m.validFrom), "valid_to": F.to_date(m.validTo),
            "changed_at": F.coalesce(F.to_timestamp(m.changedAt), "_stamp"), "changed_by": m.changedBy, "rev": F.coalesce(m.rev, F.lit(0)),
        }).drop("meta", "key", "_stamp")
    return out


def read_units(spark: SparkSession) -> DataFrame:
    """(code, name, base, factor, container, alias): one row per printed form, at least one per code."""
    return unit_table(spark).select("code", "name", "base", "factor", "container", F.explode_outer("aliases").alias("alias"))


def save_cases(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables of cases, each partitioned by case; only the partitions of the cases written are replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{folder}/{name}")


def load_cases(spark: SparkSession, folder: str, names: list[str], case_ids: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables written by save_cases; with case_ids, only those partitions are read."""
    read = lambda n: spark.read.parquet(f"{folder}/{n}").withColumn("case_id", F.col("case_id").cast("string"))
    return {n: read(n) if case_ids is None else read(n).filter(F.col("case_id").isin(case_ids)) for n in names}


def reading_key(content, setup: str):
    """SHA-256 of the reader's setup and the document's bytes."""
    return F.sha2(F.concat(F.lit(setup).cast("binary"), content.cast("binary")), 256)


def keep_readings(documents: DataFrame, setup: str, store: str) -> None:
    """Append documents (content, reading) to the store under their key, one per key."""
    documents.select(reading_key(F.col("content"), setup).alias("key"), "reading").dropDuplicates(["key"]).write.mode("append").parquet(store)


def find_readings(documents: DataFrame, setup: str, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown): documents with their kept reading, and those that still have to be read."""
    keyed = documents.withColumn("key", reading_key(F.col("content"), setup))
    return keyed.join(readings.dropDuplicates(["key"]), "key"), keyed.join(readings.select("key"), "key", "left_anti")


def write_assortment_csv(df: DataFrame, path: str) -> None:
    """Product, gross price (blank when 0), VAT and id, sorted by name: semicolons, CRLF, byte order mark."""
    c = F.col
    price = F.when(c("gross_price") > 0, cents(c("gross_price"))).otherwise("")
    rows = df.orderBy("name", "product_id").select(c("name").alias(MARK + ASSORTMENT[0]), price.alias(ASSORTMENT[1]), basis_points(c("vat")).alias(ASSORTMENT[2]), c("product_id").alias(ASSORTMENT[3]))
    rows.write.options(**CSV, header=True).csv(path)


def read_assortment_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, given_id, name, gross_price, vat) of a CSV file whose header names its columns in any order and case.

    The delimiter is what the header holds most of, out of semicolon, comma and tab. Text that is not UTF-8 is Latin-1. A
    product or id column is needed. Without a price it is 0, without a rate 19 %; what is no number is an error, blank rows
    are none.
    """
    text = spark.read.text(path)
    head = text.first()  # the header line
    if head is None:
        raise ValueError("an assortment needs a header line")
    first = head.value.lstrip(MARK)
    sep = max(";,\t", key=lambda c: (first.count(c), -";,\t".index(c)))
    encoding = "UTF-8" if text.filter(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    df = spark.read.options(sep=sep, header=True, multiLine=True, encoding=encoding, escape='"').csv(path)
    known = {c.lstrip(MARK).strip().lower(): c for c in df.columns}
    if not {ASSORTMENT[0].lower(), ASSORTMENT[3].lower()} & known.keys():
        raise ValueError(f"an assortment needs a column '{ASSORTMENT[0]}' or '{ASSORTMENT[3]}'")
    get = lambda k: F.trim(F.col(f"`{known[k.lower()]}`")) if k.lower() in known else F.lit(None).cast("string")
    number = lambda k, least: F.coalesce(parse_hundredths(get(k)), F.lit(least)).cast("bigint")
    filled = df.filter(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in df.columns]) != "")
    return filled.select((F.monotonically_increasing_id() + 1).alias("row"), F.nullif(get(ASSORTMENT[3]), F.lit("")).alias("given_id"), get(ASSORTMENT[0]).alias("name"), number(ASSORTMENT[1], 0).alias("gross_price"), number(ASSORTMENT[2], 1900).alias("vat"))
