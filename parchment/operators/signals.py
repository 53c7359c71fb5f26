"""The signals of a letter from its own stages: texts, pages, page features, lines, images and metadata, put together by letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators import forensic

# How a page that was put together is reported.
COMPOSED = "composited document — overlaid text + {n} pasted image(s) on a background letterhead, no text layer"


def composed(images: DataFrame, features: DataFrame) -> DataFrame:
    """(letter_id, composites): the findings of the pages that forensic.composite_pages() finds, in their order.

    Both sides are grouped by letter before they meet, so that they meet by letter alone, which is what a store is bucketed by.
    """
    area = F.col("px_w").cast("long") * F.col("px_h")
    by = images.groupBy("letter_id", "page_no").agg(F.count_if(area > 1_000_000).alias("large"), F.count_if(area < 80_000).alias("small"))
    by = by.groupBy("letter_id").agg(F.map_from_entries(F.collect_list(F.struct("page_no", F.struct("large", "small")))).alias("sizes"))
    pages = features.groupBy("letter_id").agg(F.sort_array(F.collect_list(F.struct("page_no", F.length(F.trim("text")).alias("n_text"), "n_drawings", "n_fonts"))).alias("pages"))
    before, after = COMPOSED.split("{n}")
    size = lambda p: F.element_at("sizes", p["page_no"])
    odd = F.filter("pages", lambda p: (p["n_text"] < 20) & (size(p)["large"] >= 1) & (size(p)["small"] >= 1) & (p["n_drawings"] > 150) & (p["n_fonts"] == 0))
    finding = F.transform(odd, lambda p: F.concat(F.lit("page "), p["page_no"].cast("string"), F.lit(f": {before}"), size(p)["small"].cast("string"), F.lit(after)))
    return pages.join(by, "letter_id").select("letter_id", finding.alias("composites"))


def listed(findings: DataFrame, name: str, *order: str) -> DataFrame:
    """(letter_id, name): a letter's findings as a list, by the columns of order, then by their own letters."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "finding")))
    return findings.groupBy("letter_id").agg(F.transform(rows, lambda r: r["finding"]).alias(name))


def signals(letters: DataFrame, pages: DataFrame, features: DataFrame, lines: DataFrame, images: DataFrame, meta: DataFrame, as_of: str) -> DataFrame:
    """One row for each letter of letters: what an assessment takes from its own stages.

    letters: (letter_id, full_text). pages: (letter_id, page_no from 0, text). features: (letter_id, page_no, text, n_drawings,
    n_fonts). lines, images, meta: as forensic takes them. A letter without rows in a table has an empty list, no place or no
    tool there. Over tables of one store (sources.store) the plan has no exchange.
    """
    text = letters.select("letter_id", forensic.red_phrases(F.col("full_text")).alias("red_phrases"), forensic.template_artifacts(F.col("full_text")).alias("artifacts"))
    made = forensic.metadata_reasons(meta, as_of).select(
        "letter_id", "created_with", "author", F.col("created").cast("date").alias("created_on"), F.col("modified").cast("date").alias("modified_on"), "suspicious",
        F.when(F.col("reasons") != "", F.col("reasons")).alias("metadata_reasons"), "online_tool",
    )
    seen = forensic.image_summary(images).select("letter_id", "logo", "signature", "has_stamp")
    shown = forensic.page_selection(pages).select("letter_id", F.size("pages").alias("n_rendered"))
    out = text
    for more in (listed(forensic.floating_dates(lines), "tampering", "page_no", "line_no"), composed(images, features), made, seen, shown):
        out = out.join(more, "letter_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("red_phrases", "artifacts", "tampering", "composites")} | {"has_stamp": F.coalesce("has_stamp", F.lit(False)), "suspicious": F.coalesce("suspicious", F.lit(False)), "n_rendered": F.coalesce("n_rendered", F.lit(0))})
