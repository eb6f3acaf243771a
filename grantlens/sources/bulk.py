"""Bulk files: yearly CSV of awards and links to typed Parquet, with downloads, and a store to open them from."""

from __future__ import annotations

import os
import shutil
import urllib.request
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs

# Columns of the yearly files and the names and types they get.
AWARD_COLUMNS = [
    ("APPLICATION_ID", "application_id", "bigint"), ("CORE_PROJECT_NUM", "core_project_num", "string"), ("FULL_PROJECT_NUM", "full_project_num", "string"),
    ("ACTIVITY", "activity_code", "string"), ("ADMINISTERING_IC", "ic", "string"), ("IC_NAME", "ic_name", "string"), ("FY", "fiscal_year", "int"),
    ("FUNDING_MECHANISM", "funding_mechanism", "string"), ("ORG_NAME", "org_name", "string"), ("ORG_STATE", "org_state", "string"), ("ORG_COUNTRY", "org_country", "string"),
    ("OPPORTUNITY NUMBER", "foa_number", "string"), ("PI_IDS", "pi_ids", "string"), ("PI_NAMEs", "pi_names", "string"), ("PROJECT_TITLE", "project_title", "string"), ("TOTAL_COST", "total_cost", "double"),
]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """One file as text columns: quoted line breaks and doubled quotes are read, short rows are filled with nulls."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False)


def read_awards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Awards of all files, matched by column name: files of different years have different columns."""
    files = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_csv(spark, p) for p in paths])
    there = {c.lower(): c for c in files.columns}
    typed = [(F.col(f"`{there[raw.lower()]}`").try_cast(kind) if raw.lower() in there else F.lit(None).cast(kind)).alias(name) for raw, name, kind in AWARD_COLUMNS]
    return files.select(*typed)


def read_publinks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct (pmid, core_project_num, pub_year); the year is in the file's name."""
    parts = [_csv(spark, p).withColumn("pub_year", F.regexp_extract(F.col("_metadata.file_name"), "_C_([0-9]{4})", 1).try_cast("int")) for p in paths]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(F.col("PMID").cast("string").alias("pmid"), F.col("PROJECT_NUMBER").alias("core_project_num"), "pub_year").where("pmid IS NOT NULL AND core_project_num IS NOT NULL").distinct()


def build(spark: SparkSession, awards: list[str], publinks: list[str], root: str) -> None:
    """Write the store: awards by fiscal year, links."""
    read_awards(spark, awards).write.mode("overwrite").partitionBy("fiscal_year").parquet(f"{root}/awards")
    read_publinks(spark, publinks).write.mode("overwrite").parquet(f"{root}/publinks")


#: Tables that a store may have besides awards and links.
OPTIONAL = ("metrics", "citers", "trials", "labels", "mortality", "prevalence", "articles", "assays", "success_rates", "terms", "abstracts")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def connect(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Open the store: awards, publinks, award_pi (with contact investigator) and the optional tables there are, also as views."""
    tables = {"awards": spark.read.parquet(f"{root}/awards"), "publinks": spark.read.parquet(f"{root}/publinks")}
    tables |= {t: spark.read.parquet(f"{root}/{t}") for t in OPTIONAL if _exists(spark, f"{root}/{t}")}
    tables["award_pi"] = tables["awards"].withColumn("contact_pi_id", exprs.contact_pi_id("pi_ids")).withColumn("contact_pi_name", exprs.contact_pi_name("pi_names"))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def data_dir() -> Path:
    """Where downloads go: GRANTLENS_DATA, or a folder in the user's cache."""
    return Path(os.environ.get("GRANTLENS_DATA") or Path.home() / ".cache" / "grantlens")


# Kinds of yearly files, the segment of their address, the name of the local file.
KINDS = {"projects": ("projects", "RePORTER_PRJ_C_FY{year}.zip"), "publinks": ("linktables", "RePORTER_PUBLNK_C_{year}.zip")}
EXPORTER_URL = "https://reporter.nih.gov/exporter/{segment}/download/{year}"


def yearly(kind: str, year: int, force: bool = False, root: Path | None = None) -> Path:
    """The CSV of a kind (projects by fiscal year, publinks by calendar year) and year, fetched and unpacked where it is not yet there."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}: {', '.join(KINDS)}")
    segment, name = KINDS[kind]
    to = (root or data_dir() / "raw" / "exporter") / name.format(year=year)
    return extract_csv(download(EXPORTER_URL.format(segment=segment, year=year), to, force))


def download(url: str, to: Path, force: bool = False, timeout: int = 600) -> Path:
    """Fetch a file by way of a .part file; one that is there and not empty is used again."""
    if to.exists() and to.stat().st_size and not force:
        return to
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_suffix(to.suffix + ".part")
    with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as sink:  # noqa: S310
        shutil.copyfileobj(source, sink, 1 << 20)
    part.rename(to)
    return to


def extract_csv(archive: Path) -> Path:
    """The first CSV of a zip file, next to it."""
    with zipfile.ZipFile(archive) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(".csv"))
        to = archive.parent / Path(name).name
        if not (to.exists() and to.stat().st_size):
            with z.open(name) as source, to.open("wb") as sink:
                shutil.copyfileobj(source, sink)
    return to
