"""EPUB archives as tables of members and package entries, and back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def members(spark: SparkSession, path: str) -> DataFrame:
    """(epub, member, content) of all members of the archives under path; an archive that cannot be read has none."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzipped(files: DataFrame) -> DataFrame:
    """The same of archives held as rows (path, content)."""

    def run(batches):
        for b in batches:
            out = []
            for epub, data in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out += [(epub, n, z.read(n)) for n in z.namelist()]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["epub", "member", "content"])

    return files.select("path", "content").mapInPandas(run, "epub string, member string, content binary")


def page_members(archive: DataFrame) -> DataFrame:
    """(epub, member, html) of the members that are pages; broken bytes become replacement characters."""
    pages = archive.where(F.col("member").rlike(r"(?i)\.(xhtml|html|htm)$"))
    return pages.select("epub", "member", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def read_member(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """(epub, member, html) of the members wanted (epub, member); one that the archive lacks is empty."""
    held = page_members(archive)
    return wanted.join(held, ["epub", "member"], "left").select("epub", "member", F.coalesce("html", F.lit("")).alias("html"))


def package(archive: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """packages (epub, opf, problem), manifest (epub, id, href) and spine (epub, idref)."""
    text = F.col("content").cast("string")
    well_formed = F.udf(_problem, "string")
    box = archive.where("member = 'META-INF/container.xml'").select("epub", F.when(well_formed("content").isNull(), text).alias("xml"))
    located = archive.select("epub").distinct().join(box, "epub", "left").select("epub", F.nullif(F.expr("xpath_string(xml, '//*[local-name()=\"rootfile\"]/@full-path')"), F.lit("")).alias("opf"))
    files = archive.select("epub", F.col("member").alias("opf"), "content")
    opened = located.join(files, ["epub", "opf"], "left").withColumn("fault", well_formed("content"))
    problem = (
        F.when(F.col("opf").isNull(), "could not locate OPF rootfile")
        .when(F.col("content").isNull(), F.concat(F.lit("OPF rootfile '"), F.col("opf"), F.lit("' missing from zip")))
        .when(F.col("fault").isNotNull(), F.concat(F.lit("OPF is not well-formed XML: "), F.col("fault")))
    )
    place = F.when(F.col("opf").isNull() | F.col("content").isNull(), "META-INF/container.xml").otherwise(F.col("opf"))
    packages = opened.select("epub", place.alias("opf"), problem.alias("problem"))
    sound = opened.where(F.col("content").isNotNull() & F.col("fault").isNull()).select("epub", F.col("content").cast("string").alias("xml"))
    pairs = lambda tag, a: F.expr(f"xpath(xml, '//*[local-name()=\"{tag}\"]/@{a}')")
    items = F.expr("""xpath(xml, '//*[local-name()="item"][@id and @href]/@id')"""), F.expr("""xpath(xml, '//*[local-name()="item"][@id and @href]/@href')""")
    manifest = sound.select("epub", F.explode(F.arrays_zip(items[0].alias("id"), items[1].alias("href"))).alias("i")).select("epub", "i.id", "i.href")
    return packages, manifest, sound.select("epub", F.explode(pairs("itemref", "idref")).alias("idref"))


def _problem(data: bytes | None) -> str | None:
    import xml.etree.ElementTree as ET

    if data is None:
        return None
    try:
        ET.fromstring(bytes(data))
    except ET.ParseError as e:
        return str(e)
    return None


def repack(archive: DataFrame) -> DataFrame:
    """(epub, content): archives from members, `mimetype` first and stored."""

    def run(key, part):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            rows = sorted(zip(part["member"], part["content"]), key=lambda r: (r[0] != "mimetype", r[0]))
            for name, data in rows:
                z.writestr(zipfile.ZipInfo(name), bytes(data), zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"epub": [key[0]], "content": [out.getvalue()]})

    return archive.groupBy("epub").applyInPandas(run, "epub string, content binary")
