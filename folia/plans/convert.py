"""Conversions of whole corpora, with a status for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia import functions as fn
from folia.operators import windows
from folia.sinks import docx, pdf
from folia.sources import external, layout, ooxml

from .assemble import blocks as assemble
from .settle import settle


def packages_to_pages(files: DataFrame) -> DataFrame:
    """DOCX to PDF: doc_id, status (ok, or what is wrong), pages, content. Files that can't be read have no content."""
    found = settle(ooxml.ordinals(ooxml.blocks(files)), "blocks")
    names = found.where("kind = 'image'").select("doc_id", F.col("image.target").alias("name")).distinct()
    media = ooxml.parts(files).join(names, ["doc_id", "name"])
    made = pdf.files(found.where("error IS NULL"), media)
    wrong = found.where("error IS NOT NULL").select("doc_id", F.col("error").alias("status"))
    out = files.select("doc_id").join(made, "doc_id", "left").join(wrong, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("content").isNotNull(), "ok").otherwise(F.coalesce("status", F.lit(external.NO_TEXT))).alias("status"), "pages", "content")


def dumps_to_packages(dumps: DataFrame, compat: bool = False) -> DataFrame:
    """Layout dumps (doc_id, xml, drawings by page, and perhaps media: pictures by name) to DOCX: doc_id, status, content. Pictures alone are no text."""
    pages = settle(layout.pages(dumps, "xml"), "pages")
    drawn = dumps.select("doc_id", F.posexplode("drawings").alias("page_no", "svg")).join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"])
    key = ["doc_id", "page_no"]
    vectors = settle(layout.vectors(drawn, "svg", "height", key), "vectors")
    fragments = settle(layout.fragments(pages), "fragments")
    # a dump names pictures by the path they were written to
    images = layout.images(pages).withColumn("src", F.regexp_replace("src", "^.*/", ""))
    blocks = assemble(pages, fragments, images, layout.rules(vectors, key), layout.shades(vectors, key), compat)
    media = None
    if "media" in dumps.columns:
        media = dumps.select("doc_id", F.explode("media").alias("m")).select("doc_id", "m.name", "m.bytes", fn.mime_for(F.col("m.name"), layout=True).alias("mime"))
    made = docx.packages(blocks, media).join(fragments.select("doc_id").distinct(), "doc_id", "left_semi")
    out = dumps.select("doc_id").join(made, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("content").isNotNull(), "ok").otherwise(external.NO_TEXT).alias("status"), "content")


def lines_to_packages(lines: DataFrame) -> DataFrame:
    """Recognised lines (doc_id, line_no, line) to DOCX: doc_id, content. A document of blank lines isn't there."""
    paras = windows.recognized_paragraphs(lines.where("line IS NOT NULL"), ["doc_id"], "line_no", "line")
    run = F.struct(F.col("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("").alias("color"), F.lit("").alias("font"))
    plain = F.struct(F.lit("None").alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("num_id"))
    fixed = {"part": "body", "kind": "paragraph", "style": "Normal", "alignment": "Default"}
    void = [F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ooxml.BLOCK) if f.name in ("widths", "cells", "image")]
    blocks = paras.select("doc_id", F.array(F.col("para_no").cast("int")).alias("path"), *[F.lit(v).alias(k) for k, v in fixed.items()], plain.alias("list"), F.array(run).alias("runs"), *void)
    return docx.packages(blocks)


def pages_to_packages(files: DataFrame) -> DataFrame:
    """PDF to DOCX where the external programs are installed: doc_id, status, content. A document without text goes to text recognition."""
    dumped = settle(external.dumps(files), "dumps")
    made = settle(dumps_to_packages(dumped.where("status = 'ok'")).select("doc_id", F.col("status").alias("made"), "content"), "made")
    first = dumped.select("doc_id", "status").join(made, "doc_id", "left").select("doc_id", F.coalesce("made", "status").alias("status"), "content")
    scanned = files.join(first.where(F.col("status") == external.NO_TEXT).select("doc_id"), "doc_id", "left_semi")
    read = lines_to_packages(settle(external.recognized(scanned), "recognized")).withColumnRenamed("content", "read")
    return first.join(read, "doc_id", "left").select("doc_id", F.when(F.col("read").isNotNull(), "ok").otherwise(F.col("status")).alias("status"), F.coalesce("content", "read").alias("content"))
