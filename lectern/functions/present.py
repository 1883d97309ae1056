"""Scalar functions of retrieval and presentation, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Badges of the confidence levels.
EMOJI = {"high": "🟢", "medium": "🟡", "low": "🔴", "insufficient": "⚫"}
COLOUR = {"high": "#28a745", "medium": "#ffc107", "low": "#dc3545", "insufficient": "#6c757d"}
# Labels of the source types that a user may choose.
SOURCE_TYPE_OF_LABEL = {"Books": "book", "Lecture Notes": "lecture_notes", "Exercises": "exercises"}
# The parts of a prompt.
NO_CONTEXT = "\n=== NO RELEVANT CONTEXT FOUND ===\n"
CONTEXT = ("\n=== CONTEXT FROM BIBLIOGRAPHY ===\n\n", "\n\n=== END OF CONTEXT ===\n")
HISTORY = ("\n=== PREVIOUS CONVERSATION ===\n", "\n=== END OF CONVERSATION ===\n")
ANSWER_IN = {
    "en": "\n\nCRITICAL: The user asked in English. You MUST respond in ENGLISH.",
    "es": "\n\nCRITICAL: The user asked in Spanish. You MUST respond in SPANISH.",
}
# Fixed value: what is shown before an answer of low confidence.
LOW_CONFIDENCE = "⚠️ **Note:** The available bibliography has limited information on this specific topic. The response below may be incomplete. Please verify with your professor or additional resources."


def similarity(distance: Column) -> Column:
    return F.least(F.greatest(1 - distance / 2, F.lit(0.0)), F.lit(1.0))


def truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def context_text(parent_content: Column, text: Column) -> Column:
    return F.coalesce(truthy(parent_content), text)


def citation(author: Column, chapter: Column, page: Column) -> Column:
    """Author, chapter and page, as far as they are known; 'Unknown source' if nothing is."""
    parts = F.concat_ws(
        ", ",
        F.when((author != "") & (F.lower(author) != "unknown"), author),
        F.when((chapter != 0) & (chapter != -1), F.concat(F.lit("Chapter "), chapter.cast("string"))),
        F.when(page != 0, F.concat(F.lit("page "), page.cast("string"))),
    )
    return F.coalesce(truthy(parts), F.lit("Unknown source"))


def ui_citation(author: Column, chapter: Column, page: Column) -> Column:
    """Always with author and page."""
    return F.concat_ws(", ", F.coalesce(truthy(author), F.lit("Unknown")), F.when((chapter != 0) & (chapter != -1), F.concat(F.lit("Chapter "), chapter.cast("string"))), F.concat(F.lit("page "), F.coalesce(page, F.lit(0)).cast("string")))


def snippet(text: Column, n: int) -> Column:
    """At most n characters, cut after the last blank, with an ellipsis if cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r" [^ ]*\z", ""), F.lit("...")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def badge(level: Column) -> tuple[Column, Column]:
    one = lambda m, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), level), F.lit(other))
    return one(EMOJI, "⚪"), one(COLOUR, "#6c757d")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def source_record(author: Column, page: Column, chapter: Column, source_type: Column, text: Column) -> Column:
    return F.struct(author.alias("author"), page.alias("page"), chapter.alias("chapter"), source_type.alias("source_type"), snippet(text, 200).alias("snippet"))


def generation_query(query: Column, optimised: Column) -> Column:
    return F.when(optimised != query, F.concat(query, F.lit("\n\n[Context: Search performed for '"), optimised, F.lit("']"))).otherwise(query)


def sanitised_rewrite(query: Column, rewrite: Column) -> Column:
    """The rewrite without its quotes; the query itself if the rewrite is empty or far too long."""
    t = F.regexp_replace(F.trim(rewrite), r'(?s)^"(.*)"$', "$1")
    t = F.trim(F.regexp_replace(t, r"(?s)^'(.*)'$", "$1"))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, query).when(F.length(t) > F.greatest(F.lit(300), 10 * F.length(query)), query).otherwise(t)


def cache_key(query: Column, context: Column) -> Column:
    return F.md5(F.concat(F.lower(F.trim(query)), F.lit(":"), F.md5(F.substring(context, 1, 1000).cast("binary"))).cast("binary"))


def defaulted(source_file: Column, page: Column, author: Column, source_type: Column, chapter: Column) -> Column:
    """A hit's fields with the values that stand for missing ones; chapter -1 is none."""
    return F.struct(
        F.coalesce(source_file, F.lit("Unknown")).alias("source_file"), F.coalesce(page, F.lit(0)).alias("page"), F.coalesce(author, F.lit("Unknown")).alias("author"),
        F.coalesce(source_type, F.lit("unknown")).alias("source_type"), F.nullif(chapter, F.lit(-1)).alias("chapter"),
    )


def source_type_of_label(label: Column) -> Column:
    """The source type behind a label; null, which filters nothing, for 'All' and any other."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TYPE_OF_LABEL.items() for x in kv]), label)


def low_confidence_notice(level: Column) -> Column:
    return F.when(level == "low", F.lit(LOW_CONFIDENCE))


def context_section(context: Column) -> Column:
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", F.lit(NO_CONTEXT)).otherwise(F.concat(F.lit(CONTEXT[0]), context, F.lit(CONTEXT[1])))


def prompt(context: Column, history: Column, question: Column, language: Column) -> Column:
    """Context, history and question, and the language to answer in if it is one of ANSWER_IN."""
    told = F.when(F.coalesce(history, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(HISTORY[0]), history, F.lit(HISTORY[1])))
    directive = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ANSWER_IN.items() for x in kv]), language), F.lit(""))
    return F.concat(F.lit("\n"), context_section(context), F.lit("\n\n"), told, F.lit("\n\nQUESTION: "), F.coalesce(question, F.lit("")), F.lit("\n\nANSWER (with citations):"), directive)


def answer_language(query: Column, detected: Column) -> Column:
    return F.when(F.coalesce(F.length(query), F.lit(0)) < 20, "en").when(detected == "es", "es").otherwise("en")


def verdict(answer: Column) -> Column:
    """IRRELEVANT is looked for before RELEVANT; what is neither counts as relevant."""
    up = F.upper(answer)
    return F.when(F.contains(up, F.lit("IRRELEVANT")), False).otherwise(True)
