"""Documents and listings as they arrive: file kinds, statute lists in XML, rule listings in JSON, CSV with a mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.sources import releases

#: First bytes of file kinds in hexadecimal digits (fixed values).
MAGIC = {"pdf": "25504446", "ole": "D0CF11E0A1B11AE1", "zip": "504B0304"}
#: Office names that share the compound file format with word-processor files (fixed values).
OFFICE = "doc xls ppt"
STATUTE = "struct<id:string,name:string,promulgated:string,effective:string,ministry:string>"


def file_kind(content: Column, name: Column) -> Column:
    """pdf, hwp or hwpx by first bytes and name; null for anything else."""
    begins = lambda k: F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(MAGIC[k]))
    ending = F.lower(F.substring_index(name, ".", -1))
    return F.when(begins("pdf"), "pdf").when(begins("ole") & ~ending.isin(*OFFICE.split()), "hwp").when(begins("zip") & (ending == "hwpx"), "hwpx")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, sha256, content) of the files below a folder; those of no known kind have a null kind, empty files are not listed."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return d.select("path", file_kind(F.col("content"), F.col("path")).alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def new_blobs(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed: one row per (source, sha256) that is not stored yet."""
    return files.dropDuplicates(["source", "sha256"]).join(stored.select("source", "sha256"), ["source", "sha256"], "left_anti")


def statute_list(pages: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """The rows of list pages; ``complete`` is false where a required field is missing, as when the structure changes."""
    schema = f"struct<totalCnt:long,law:array<{STATUTE}>>"
    rows = F.from_xml(F.col(xml), schema)
    d = pages.select(*keep, rows.alias("_x")).select(*keep, F.col("_x.totalCnt").alias("total"), F.inline("_x.law"))
    day = lambda c: F.try_to_date(F.col(c), "yyyyMMdd")
    complete = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("promulgated").isNotNull()
    return d.select(*keep, "total", "id", F.btrim("name").alias("name"), day("promulgated").alias("promulgated"), day("effective").alias("effective"), F.nullif(F.btrim("ministry"), F.lit("")).alias("ministry"), complete.alias("complete"))


def rule_listing(pages: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """Rows of rule listings with the fingerprint that tells whether a rule changed: five fields joined."""
    row = "struct<seq:string,title:string,institution:string,division:string,start:string,posted:string>"
    d = pages.select(*keep, F.inline(F.from_json(F.col(json), f"struct<rows:array<{row}>>")["rows"]))
    return d.withColumn("fingerprint", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("seq", "title", "division", "start", "posted")]))


def attachments(field: Column) -> Column:
    """``12|a, b.hwp,13|c.pdf`` as array of struct(no, name): a comma parts entries only before a number and a bar."""
    entries = F.filter(F.split(F.coalesce(field, F.lit("")), ",(?=[0-9]+\\|)"), lambda x: x.contains("|"))
    return F.transform(entries, lambda x: F.struct(F.substring_index(x, "|", 1).alias("no"), F.regexp_replace(x, "^[0-9]+\\|", "").alias("name")))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV whose header begins with the byte order mark that spreadsheets look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(folder)


def publish(spark: SparkSession, df: DataFrame, root: str, release: str) -> int:
    """Write a release beside the others and put it in force in one step: readers see one release or the other."""
    return releases.publish(df, root, note=release).number


def published(spark: SparkSession, root: str) -> DataFrame:
    """The release that came in force last."""
    return releases.read(spark, root)
