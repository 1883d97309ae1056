"""Queries of the text operators, named by problem, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import forms, furniture, languages, leaks, mixture, scans, sentences, splitting
from lectern.llm.tools import table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_oversized(table(spark, d, "text_chunks"), "chunk_key", limit=splitting.chunk_limit())
    return cut.where("piece_no = 0").select(F.col("key").alias("chunk_key"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.located_pieces(table(spark, d, "text_chunks"), table(spark, d, "extracted_pages"))


#: Blanks and line ends, as a class of a regular expression.
_BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"


def _rules(*frames: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """(rule, n): a number for each rule; those of one frame are counted in one pass."""
    out = None
    for df, rules in frames:
        row = df.agg(*[F.coalesce(n, F.lit(0)).cast("bigint").alias(f"n{k}") for k, n in enumerate(rules.values())])
        one = row.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"n{k}").alias("n")) for k, rule in enumerate(rules)])).alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """(rule, n): what holds of the pieces of all oversized chunks."""
    chunks = table(spark, d, "text_chunks")
    cut = written(splitting.split_oversized(chunks, "chunk_key", limit=splitting.chunk_limit()), "pieces")
    placed = cut.join(chunks.select(F.col("chunk_key").alias("key"), F.col("text").alias("whole"), splitting.chunk_limit().alias("limit")), "key")
    differs = F.expr("substring(whole, piece_start + 1, piece_end - piece_start) <> piece")
    return _rules(
        (cut, {"chunks cut": F.count_distinct("key"), "characters, overlaps counted once": F.sum(F.length("piece")) - splitting.OVERLAP * (F.count("*") - F.count_distinct("key"))}),
        (placed, {"pieces over the limit": F.count_if(F.length("piece") > F.col("limit")), "pieces that differ from their place": F.count_if(differs)}),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(table(spark, d, "extracted_pages"), table(spark, d, "language_samples"))


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    page = languages.page_languages(table(spark, d, "extracted_pages"), table(spark, d, "language_samples"))
    return page.select(F.col("key").alias("page_id"), "lang", "declared", F.round("confidence", 6).alias("confidence"), "running")


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each paragraph of a page in several languages."""
    page = languages.page_languages(table(spark, d, "extracted_pages"), table(spark, d, "language_samples"))
    return languages.paragraph_languages(page).select(F.col("key").alias("page_id"), "para_no", "lang", F.round("confidence", 6).alias("confidence"), "running")


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    """(rule, n): what holds of the languages of all pages."""
    page = written(languages.page_languages(table(spark, d, "extracted_pages"), table(spark, d, "language_samples")), "page-languages")
    parts = page.select("key", "lang", F.explode("paras").alias("p"))
    known = F.col("lang").isin(*languages.LANGUAGES, "mixed") & F.col("confidence").between(0, 1)
    sure = F.col("p.lang").isin(*languages.LANGUAGES) & F.col("p.confidence").between(0, 1)
    return _rules(
        (page, {"pages": F.count("*"), "pages without a language or a confidence": F.count_if(~F.coalesce(known, F.lit(False)))}),
        (parts, {"paragraphs without a language or a confidence": F.count_if(~F.coalesce(sure, F.lit(False)))}),
        (parts.where("lang = 'mixed' and p.body").groupBy("key").agg(F.count_distinct("p.lang").alias("n")), {"mixed pages with one language": F.count_if(F.col("n") < 2)}),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.lookalike_pairs([("extracted_pages", table(spark, d, "extracted_pages"), "page_id"), ("text_chunks", table(spark, d, "text_chunks"), "chunk_key")])


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, key, visual_form, comparison_form) of every row of both tables; the visual form is the one that keeps apart what visibly differs."""
    return forms.both_forms([("extracted_pages", table(spark, d, "extracted_pages"), "page_id"), ("text_chunks", table(spark, d, "text_chunks"), "chunk_key")])


def p3_normalised_pages(spark: SparkSession, d: str) -> DataFrame:
    return forms.normalised(table(spark, d, "extracted_pages"), "page_id").select("page_id", "norm_text")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found as classes, a row a row of a table."""
    return forms.lookalike_classes([("extracted_pages", table(spark, d, "extracted_pages"), "page_id"), ("text_chunks", table(spark, d, "text_chunks"), "chunk_key")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, lines = furniture.furniture_lines(table(spark, d, "extracted_pages"))
    return lines.select(F.col("key").alias("page_id"), "line_no")


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    per_source, _ = furniture.furniture_lines(table(spark, d, "extracted_pages"))
    return per_source


def p4_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages")
    _, lines = furniture.furniture_lines(pages)
    return furniture.without_lines(pages, lines).select("page_id", "clean_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_lines(table(spark, d, "extracted_pages"), titles=table(spark, d, "documents").select("title"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_paragraphs(table(spark, d, "extracted_pages"), titles=table(spark, d, "documents").select("title"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark_items")).select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("size", mixture.quarter_chars())
    _, report = mixture.mixture(mixture.with_quality(docs, "doc_id", "source", "size"), table(spark, d, "mix_targets"))
    # All documents of such a source are used as often as they may be, so what it gave is what it can give.
    return report.where(F.col("below_target") & (F.col("used") == F.col("size") * F.col("max_repeats"))).select("source")


def _mixed_in_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    weighed = mixture.with_quality(docs, "doc_id", "source", "text")
    return mixture.mixture(mixture.with_tokens(weighed, "doc_id", "source", "quality"), table(spark, d, "mix_targets"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(rule, broken): how often the mix breaks each rule."""
    mix, report = _mixed_in_tokens(spark, d)
    mix = written(mix, "mix")
    limits = report.select("source", "max_repeats", "size", "budget", "used", "actual_share")
    epochs = mix.groupBy("source").agg(F.max("repeats").alias("most"), F.min("repeats").alias("least"), F.count("*").alias("n")).join(report.select("source", "n_docs"), "source")
    of = lambda rule, df: df.agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")
    total = report.agg(F.sum("actual_share").alias("s"))
    return (
        of("a document above its repeats", mix.join(limits, "source").where("repeats > max_repeats"))
        .unionByName(of("a source above its budget", limits.where("used > budget + 0.001")))
        .unionByName(of("shares that do not add up", total.where("abs(s - 1) > 1e-9")))
        .unionByName(of("a fraction before a whole epoch", epochs.where("most - least > 1 or (most > 1 and n < n_docs)")))
    )


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_in_tokens(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    _, report = _mixed_in_tokens(spark, d)
    return report.select("source", "n_docs", "size", "used", F.round("share", 9).alias("share"), F.round("actual_share", 9).alias("actual_share"), "below_target")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "start_char", "end_char")


def p8_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """(rule, n): what holds of the units of all documents."""
    docs = table(spark, d, "documents")
    units = sentences.sentence_units(docs)
    visible, broken = F.length(F.regexp_replace("unit", _BLANKS + "+", "")), F.regexp_like("unit", F.lit(r"\n[^\S\n]*\n"))
    units = written(units.select("*", visible.alias("visible"), broken.alias("broken")), "units")
    placed = units.select("doc_id", "start_char", "end_char", "unit").join(docs.select("doc_id", "text"), "doc_id")
    before = F.lag("end_char").over(W.partitionBy("doc_id").orderBy("unit_no"))
    return _rules(
        (units, {"documents with units": F.count_distinct("doc_id"), "visible characters in units": F.sum("visible"), "units over a blank line": F.count_if("broken")}),
        (placed, {"units that differ from their place": F.count_if(F.expr("substring(text, start_char + 1, end_char - start_char) <> unit"))}),
        (units.select("start_char", before.alias("before")), {"units before the end of the last": F.count_if(F.col("start_char") < F.col("before"))}),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for those whose cases SQL can state exactly, and for the rules that a mix keeps; the rest are tested by brute force on small fixtures."""
    visible = f"regexp_replace(text, '{_BLANKS}+', '', 'g')"
    none = "UNION ALL SELECT rule, 0 FROM (VALUES {}) t(rule)"
    return {
        "p1_rules": """WITH big AS (SELECT text FROM text_chunks WHERE length(text) > CASE WHEN coalesce(is_parent, false) THEN 5000 ELSE 2500 END)
            SELECT 'chunks cut' AS rule, count(*) AS n FROM big UNION ALL SELECT 'characters, overlaps counted once', coalesce(sum(length(text)), 0) FROM big """
        + none.format("('pieces over the limit'), ('pieces that differ from their place')"),
        "p2_rules": "SELECT 'pages' AS rule, count(*) AS n FROM extracted_pages "
        + none.format("('pages without a language or a confidence'), ('paragraphs without a language or a confidence'), ('mixed pages with one language')"),
        "p8_rules": f"""WITH v AS (SELECT {visible} AS text FROM documents)
            SELECT 'documents with units' AS rule, count(*) AS n FROM v WHERE text <> '' UNION ALL SELECT 'visible characters in units', coalesce(sum(length(text)), 0) FROM v """
        + none.format("('units over a blank line'), ('units that differ from their place'), ('units before the end of the last')"),
        "p7_invariants": """
            SELECT rule, CAST(0 AS BIGINT) AS broken
            FROM (VALUES ('a document above its repeats'), ('a source above its budget'), ('shares that do not add up'), ('a fraction before a whole epoch')) AS t(rule)
        """,
        "p1_found": """
            SELECT chunk_key FROM text_chunks
            WHERE length(text) > CASE WHEN coalesce(is_parent, false) THEN 5000 ELSE 2500 END
        """,
        "p7_found": """
            WITH docs AS (
                SELECT regexp_replace(lower(source), '[\\s\\x{00A0}\\x{2000}-\\x{200D}\\x{202F}\\x{2060}\\x{FEFF}\\x{2010}-\\x{2015}_./|:+-]+', '', 'g') AS name,
                       coalesce(length(text), 0) // 4 AS size
                FROM documents
            ), listed AS (
                SELECT t.source, t.weight, t.max_repeats, coalesce(sum(d.size), 0) AS size
                FROM mix_targets t LEFT JOIN docs d ON d.name = regexp_replace(lower(t.source), '[\\s_./-]+', '', 'g')
                GROUP BY ALL
            )
            SELECT source FROM listed
            WHERE size * max_repeats * (SELECT sum(weight) FROM mix_targets) < weight * (SELECT sum(size) FROM listed)
        """,
    }
