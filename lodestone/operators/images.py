"""Image records: retrieval rows, matches with evidence on a page, cross-page pairs, captions and status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def image_chunks(images: DataFrame) -> DataFrame:
    """Images as chunk rows: kind, pages, caption, recognised text and summary joined; under 24 characters they are left out."""
    parts = F.concat_ws("\n", "kind", F.concat_ws("-", "page_start", "page_end"), F.nullif("caption_text", F.lit("")), F.nullif("ocr_text", F.lit("")), F.nullif("vision_summary", F.lit("")))
    rows = images.withColumn("text", T.squeeze(parts)).where(F.length("text") >= 24)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page_start", "id")) - 1
    return rows.select(F.col("document_id").alias("doc_id"), number.alias("chunk_no"), F.format_string("%s_image_chunk_%05d", "document_id", number).alias("chunk_id"), F.col("kind").alias("chunk_type"), "page_start", "page_end", "text", F.col("id").alias("image_id"))


def related_images(evidence: DataFrame, images: DataFrame, relevance, least: float = 0.28, most: int = 2) -> DataFrame:
    """The images whose pages overlap a piece of evidence (qid, citation_id, doc_id, page_start, page_end), by `relevance`."""
    e, i = evidence.alias("e"), images.alias("i")
    on = (F.col("e.doc_id") == F.col("i.document_id")) & (F.col("i.page_end") >= F.col("e.page_start")) & (F.col("i.page_start") <= F.col("e.page_end"))
    rows = e.join(i, on).withColumn("relevance", relevance).where(F.col("relevance") >= least)
    order = Window.partitionBy("e.qid", "e.citation_id").orderBy(F.desc("relevance"), "i.id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("e.qid", "e.citation_id", F.col("i.id").alias("image_id"), "relevance")


def cross_page_pairs(images: DataFrame) -> DataFrame:
    """(document_id, upper, lower): an image at the foot of a page (86 %) and one at the head of the next (14 %) that overlap by
    .55 of the narrower; the first for each upper one. bbox: x0, y0, x1, y1 in a page of page_height."""
    u, v = images.alias("u"), images.alias("v")
    width = F.least(F.col("u.bbox.x1"), F.col("v.bbox.x1")) - F.greatest(F.col("u.bbox.x0"), F.col("v.bbox.x0"))
    narrow = F.least(F.col("u.bbox.x1") - F.col("u.bbox.x0"), F.col("v.bbox.x1") - F.col("v.bbox.x0"))
    on = (F.col("u.document_id") == F.col("v.document_id")) & (F.col("v.page_start") == F.col("u.page_end") + 1)
    at = (F.col("u.bbox.y1") >= 0.86 * F.col("u.page_height")) & (F.col("v.bbox.y0") <= 0.14 * F.col("v.page_height"))
    rows = u.join(v, on & at & (width / F.greatest(narrow, F.lit(1e-9)) >= 0.55)).select(F.col("u.document_id").alias("document_id"), F.col("u.id").alias("upper"), F.col("v.id").alias("lower"))
    return rows.groupBy("document_id", "upper").agg(F.min("lower").alias("lower"))


def captions(blocks: DataFrame, images: DataFrame, most: int = 2) -> DataFrame:
    """(image_id, caption): the nearest text blocks of an image's page that overlap it by a quarter and are within 120 points."""
    b, i = blocks.alias("b"), images.alias("i")
    width = F.least(F.col("b.bbox.x1"), F.col("i.bbox.x1")) - F.greatest(F.col("b.bbox.x0"), F.col("i.bbox.x0"))
    share = width / F.greatest(F.least(F.col("b.bbox.x1") - F.col("b.bbox.x0"), F.col("i.bbox.x1") - F.col("i.bbox.x0")), F.lit(1e-9))
    gap = F.greatest(F.lit(0.0), F.col("b.bbox.y0") - F.col("i.bbox.y1"), F.col("i.bbox.y0") - F.col("b.bbox.y1"))
    rows = i.join(b, (F.col("b.document_id") == F.col("i.document_id")) & (F.col("b.page") == F.col("i.page_start"))).withColumns({"gap": gap, "share": share}).where("share >= 0.25 and gap <= 120")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("i.id").orderBy("gap", "b.block_no"))).where(F.col("n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b.text"))), lambda s: s["text"]), " ")
    return rows.groupBy(F.col("i.id").alias("image_id")).agg(F.substring(text, 1, 600).alias("caption"))


def large_enough(images: DataFrame, side: int = 48, share: float = 0.006) -> DataFrame:
    """Images with a proper box, sides of 48 and .6 % of their page."""
    box = (F.col("bbox.x1") > F.col("bbox.x0")) & (F.col("bbox.y1") > F.col("bbox.y0"))
    return images.where(box & (F.col("width") >= side) & (F.col("height") >= side) & (F.col("width") * F.col("height") >= share * F.col("page_width") * F.col("page_height")))


def status_counts(images: DataFrame, column: str) -> DataFrame:
    """(document_id, counts): how many images are in each status."""
    return images.groupBy("document_id", column).count().groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias("counts"))


def to_enrich(images: DataFrame, most: int = 40) -> DataFrame:
    """The images that a model should see: ready ones, each content once, at most `most` of a document."""
    first = Window.partitionBy("document_id", "content_hash").orderBy("page_start", "id")
    rows = images.where("status = 'ready'").withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_start", "id"))).where(F.col("n") <= most).drop("n")
