"""Signs of tampering in a letter's structure: images, metadata, placeholders, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.config import DESIGN_TOOLS, EDITING_SUITES, ONLINE_TOOLS, PLACEHOLDERS, RED_PHRASES, SALARY_PAGE, SIGNATURE_PAGE, TEMPLATE_ARTIFACTS
from parchment.functions.text import any_of, blank_to_null, every, hits, parse_date, strip
from parchment.patterns import MONTH


def red_phrases(text: Column) -> Column:
    return hits(text, RED_PHRASES)


def placeholders(text: Column, examples: int = 3) -> Column:
    """array<struct<type, examples>> of the placeholder patterns that a text holds."""
    found = [F.struct(F.lit(name).alias("type"), F.slice(every(text, p), 1, examples).alias("examples")) for name, p in PLACEHOLDERS]
    return F.filter(F.array(*found), lambda x: F.size(x["examples"]) > 0)


def template_artifacts(text: Column) -> Column:
    """Known template fields, case aside, then every bracketed run of capitals."""
    return F.array_distinct(F.concat(hits(text, TEMPLATE_ARTIFACTS), every(text, r"\[[A-Z][A-Z\s]{2,}\]")))


def image_summary(images: DataFrame) -> DataFrame:
    """One row a letter: image count, the first top image as logo, first bottom one as signature, first square of the rest as stamp."""
    rank = F.row_number().over(W.partitionBy("letter_id", "zone", "usable").orderBy("page_no", "img_no", "x0", "y0", "w", "h"))
    zone = F.when(F.col("y0") < 0.25 * F.col("page_h"), "top").when(F.col("y0") > 0.75 * F.col("page_h"), "bottom").otherwise("middle")
    side = F.when(F.col("x0") < 0.33 * F.col("page_w"), "left").when(F.col("x0") > 0.66 * F.col("page_w"), "right").otherwise("center")
    df = images.withColumn("zone", zone).withColumn("side", side).withColumn("usable", (F.col("w") >= 30) & (F.col("h") >= 30)).withColumn("rank", rank)
    taken = F.col("usable") & (F.col("rank") == 1) & F.col("zone").isin("top", "bottom")
    place = F.concat_ws("-", "zone", "side")
    stamp = F.col("usable") & ~taken & (F.abs(F.col("w") - F.col("h")) < 20)
    first_zone = lambda z: F.max(F.when(taken & (F.col("zone") == z), place))
    return df.groupBy("letter_id").agg(F.count("*").alias("n_images"), first_zone("top").alias("logo"), first_zone("bottom").alias("signature"), F.coalesce(F.bool_or(stamp), F.lit(False)).alias("has_stamp"))


def metadata_reasons(meta: DataFrame, as_of: str) -> DataFrame:
    """meta with created_with, gap_days, reasons (joined by "; "), suspicious and online_tool."""
    made = F.coalesce(blank_to_null(F.col("creator")), blank_to_null(F.col("producer")))
    gap = F.floor((F.unix_seconds(F.col("modified").cast("timestamp")) - F.unix_seconds(F.col("created").cast("timestamp"))) / 86400).cast("int")
    df = meta.withColumn("created_with", made).withColumn("gap_days", F.when(gap > 0, gap))
    low = F.lower("created_with")
    tools = [F.when(F.contains(low, F.lit(t.lower())), F.lit(f"made with {t}")) for t in DESIGN_TOOLS + EDITING_SUITES]
    online = F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in ONLINE_TOOLS])
    none = F.col("author").isNull() & F.col("created").isNull() & F.col("created_with").isNull()
    future = F.col("created").cast("timestamp") > F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp")
    reasons = F.array_compact(F.array(F.when(none, F.lit("no metadata")), F.when(future, F.lit("created in the future")), F.when(F.col("gap_days") > 1, F.concat(F.lit("modified "), F.col("gap_days").cast("string"), F.lit(" days after creation"))), *tools))
    return df.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn("suspicious", F.size(reasons) > 0).withColumn("online_tool", online)


def pdf_date(raw: Column) -> Column:
    """A timestamp from a PDF's own notation, D:20250203101500+05'30' (the zone is passed over), else from a written date."""
    digits = F.substring(strip(F.regexp_replace(raw, r"D:|[Z'].*$", "")), 1, 14)
    exact = F.when(digits.rlike("^[0-9]{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))
    return F.coalesce(exact, parse_date(raw).cast("timestamp_ntz"))


def letter_text(pages: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(letter_id, text, needs_ocr, n_pages) from (letter_id, page_no, text): the pages' texts, a line end between them.

    Pages without text are left out, or with keep_empty count as empty ones. needs_ocr: nothing but white space was found.
    """
    text = F.coalesce("text", F.lit(""))
    rows = F.sort_array(F.collect_list(F.when(F.lit(keep_empty) | (text != ""), F.struct("page_no", text.alias("text")))))
    by = pages.groupBy("letter_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"), F.count("*").alias("n_pages"))
    return by.select("letter_id", "text", (strip(F.col("text")) == "").alias("needs_ocr"), "n_pages")


def key_pages(pages: DataFrame) -> DataFrame:
    """(letter_id, salary_pages, signature_pages): the numbers of the pages that hold such words, in order."""
    holds = lambda words: any_of([F.contains(F.lower("text"), F.lit(w)) for w in words])
    listed = lambda words: F.sort_array(F.collect_list(F.when(holds(words), F.col("page_no"))))
    return pages.groupBy("letter_id").agg(listed(SALARY_PAGE).alias("salary_pages"), listed(SIGNATURE_PAGE).alias("signature_pages"))


def image_notes() -> dict[str, Column]:
    """What a report says of a letter's images, from logo, signature (places or null), has_stamp and n_rendered (pages)."""
    there = lambda c: F.when(c, "present").otherwise("absent")
    note = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name} detected at "), c)).otherwise(f"No raster {name.lower()} extracted")
    available = F.coalesce(F.col("n_rendered") > 0, F.lit(False))
    reasoning = F.when(available, F.concat(F.lit("Page renders available for visual analysis ("), F.col("n_rendered").cast("string"), F.lit(" pages)."))).otherwise("No rendered pages — conservative scores will apply.")
    logo, signature = F.col("logo"), F.col("signature")
    return {
        "logo_assessment": there(logo.isNotNull()), "logo_note": note("Logo", logo), "signature_assessment": there(signature.isNotNull()), "signature_note": note("Signature", signature),
        "stamp_assessment": there(F.coalesce("has_stamp", F.lit(False))), "images_available": available, "images_reasoning": reasoning,
    }


def composite_pages(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with hardly any text, a very large and a small image, many drawings and no font."""
    area = F.col("px_w").cast("long") * F.col("px_h")
    by = images.groupBy("letter_id", "page_no").agg(F.count_if(area > 1_000_000).alias("large"), F.count_if(area < 80_000).alias("small"))
    return pages.join(by, ["letter_id", "page_no"]).filter("length(trim(text)) < 20 AND large >= 1 AND small >= 1 AND n_drawings > 150 AND n_fonts = 0").select("letter_id", "page_no")


def floating_dates(lines: DataFrame) -> DataFrame:
    """Lines of a page's body whose whole text is a date: a sign of text laid over a page. (letter_id, page_no, line_no, finding)"""
    alone = F.trim("text").rlike(rf"(?i)^(?:[0-9]{{1,2}}(?:st|nd|rd|th)?\s+)?{MONTH}\s+[0-9]{{4}}$")
    height = F.col("y0") / F.when(F.col("page_h") != 0, F.col("page_h")).otherwise(1.0)
    finding = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": floating date '"), F.trim("text"), F.lit("'"))
    return lines.filter(alone & (height > 0.15) & (height < 0.85)).select("letter_id", "page_no", "line_no", finding.alias("finding"))


def page_selection(pages: DataFrame, most: int = 5) -> DataFrame:
    """(letter_id, pages, signature_page): the pages to look at, from (letter_id, page_no from 0, text).

    All of up to four pages; else the first two, the last salary page and the last signature page, or the last page where
    there is neither.
    """
    holds = lambda words: any_of([F.contains(F.lower("text"), F.lit(w)) for w in words])
    last = lambda words: F.max(F.when(holds(words), F.col("page_no")))
    by = pages.groupBy("letter_id").agg(F.count("*").cast("int").alias("n"), last(SALARY_PAGE).alias("salary"), last(SIGNATURE_PAGE).alias("signature"))
    end = F.when(F.coalesce("salary", "signature").isNull(), F.col("n") - 1)
    few = F.slice(F.array_distinct(F.array_compact(F.array(F.lit(0), F.lit(1), F.col("salary"), F.col("signature"), end))), 1, most)
    chosen = F.when(F.col("n") <= 4, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(few)
    return by.select("letter_id", chosen.alias("pages"), F.coalesce("signature", F.col("n") - 1).alias("signature_page"))
