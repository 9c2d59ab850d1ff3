"""Rendered messages: alerts, run summaries, prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsift import vocab


def escape_html(c: Column) -> Column:
    """Make text safe inside markup."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def percent(score: Column) -> Column:
    """Whole percent, cut and not rounded."""
    return (score * F.lit(100)).cast("int")


def tier(score: Column) -> Column:
    chain = None
    for cut, mark in vocab.SCORE_TIERS:
        hit = score >= F.lit(cut)
        chain = F.when(hit, mark) if chain is None else chain.when(hit, mark)
    return chain.otherwise(vocab.DEFAULT_TIER)


def category_tag(category: Column) -> Column:
    chain = None
    for name, tag in vocab.CATEGORY_TAGS.items():
        chain = F.when(category == name, tag) if chain is None else chain.when(category == name, tag)
    return chain.otherwise(vocab.DEFAULT_CATEGORY_TAG)


def filled(c: Column) -> Column:
    """NULL for empty text, so that fallbacks also replace empty values."""
    return F.nullif(c, F.lit(""))


def display_location(city: Column, location: Column, remote: Column) -> Column:
    place = F.coalesce(filled(city), filled(location), F.lit("India"))
    return F.when(remote, F.concat(F.lit("🏠 Remote / "), place)).otherwise(place)


def _line(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), escape_html(filled(c)))


def alert_message(row: dict[str, Column]) -> Column:
    """The alert for one scored listing; lines without a value are left out.

    Values are HTML-escaped, which plain interpolation would not do.
    """
    score = row["combined_score"]
    head = F.concat(tier(score), F.lit(" <b>"), category_tag(row["category"]), F.lit(" - "),
                    percent(score).cast("string"), F.lit("% Match</b>\n"))
    place = escape_html(display_location(row["city"], row["location"], row["is_remote"]))
    return F.concat_ws(
        "\n", head,
        F.concat(F.lit("💼 <b>"), escape_html(row["title"]), F.lit("</b>")),
        F.concat(F.lit("🏢 "), escape_html(row["company"])),
        F.concat(F.lit("📍 "), place),
        F.concat(F.lit("🌐 "), escape_html(row["source"])),
        _line("⏰ ", row["posted"]),
        _line("💰 ", row["salary"]),
        _line("📋 Exp: ", row["llm_experience_required"]),
        F.concat(F.lit("\n<a href=\""), escape_html(row["url"]), F.lit("\">🔗 Apply Now</a>")),
    )


def plain_alert(row: dict[str, Column]) -> Column:
    """The alert as plain text for a terminal."""
    rule = F.lit("=" * 60)
    remote = F.when(row["is_remote"], F.lit("(Remote)")).otherwise(F.lit(""))
    return F.concat_ws(
        "\n", F.lit(""), rule,
        F.concat(F.lit("["), percent(row["combined_score"]).cast("string"), F.lit("%] "), row["title"]),
        F.concat(F.lit("Company: "), row["company"]),
        F.concat(F.lit("Location: "), row["location"], F.lit(" "), remote),
        F.concat(F.lit("Source: "), row["source"]),
        F.concat(F.lit("Category: "), row["category"]),
        F.concat(F.lit("URL: "), row["url"]), rule,
    )


def tagged_alert(row: dict[str, Column]) -> Column:
    """The alert of the 0-100 scorer, headed by the search tag."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("🎯 <b>"), escape_html(row["tag"]), F.lit(" - "),
                 row["score"].cast("string"), F.lit("% Match</b>\n")),
        F.concat(F.lit("💼 <b>"), escape_html(row["title"]), F.lit("</b>")),
        F.concat(F.lit("🏢 "), escape_html(row["company"])),
        F.concat(F.lit("📍 "), escape_html(row["location"])),
        F.concat(F.lit("🌐 "), escape_html(row["source"]), F.lit("\n")),
        F.concat(F.lit("<a href=\""), escape_html(row["url"]), F.lit("\">🔗 Apply Now</a>")),
    )


def run_summary(row: dict[str, Column], as_of: Column) -> Column:
    return F.concat_ws(
        "\n", F.lit("🤖 <b>Job Scan Complete</b>\n"),
        F.format_string("📊 Fetched: %d jobs", row["total_fetched"]),
        F.format_string("🆕 New: %d", row["total_new"]),
        F.format_string("✅ Matched: %d", row["total_matched"]),
        F.format_string("📬 Notified: %d", row["total_notified"]),
        F.format_string("🏆 Best: %d%%\n", percent(row["best_score"])),
        F.concat(F.lit("⏰ "), F.date_format(as_of, "yyyy-MM-dd HH:mm")),
    )


# Fixed value: the question put to a classifier plug-in.
PROMPT_FORMAT = (
    "Analyze this job posting:\n\nTitle: %s\nCompany: %s\n\nDescription:\n%s\n\n"
    "Is this job suitable for a candidate with 0-3 years of experience "
    "in Data Science/Analytics?"
)


def prompt(title: Column, company: Column, description: Column) -> Column:
    return F.format_string(PROMPT_FORMAT, title, company, description)


REPLY_SCHEMA = "suitable_for_junior STRING, experience_required STRING, reason STRING"
# What counts as false in a reply; anything else is suitable.
FALSE_WORDS = ["false", "0", "0.0", "no", "off", "f", "n"]
# Reasons and confidence of verdicts.
NO_REPLY = "LLM call failed, defaulting to suitable"
BAD_REPLY = "Failed to parse LLM response"
REPLY_CONFIDENCE = 0.8


def reply_object(reply: Column) -> Column:
    """The outermost ``{...}`` of a reply, NULL when it is not a JSON object."""
    text = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(text).isNotNull(), text)


def verdict_fields(reply: Column) -> dict[str, Column]:
    """Verdict columns of a reply; missing, broken or empty replies count as suitable."""
    body = reply_object(reply)
    parsed = F.from_json(body, REPLY_SCHEMA)
    empty = body.isNull() | (F.json_object_keys(body) == F.array().cast("array<string>"))
    lost = reply.isNull() | (reply == "")
    return {
        "suitable": F.when(lost | empty, F.lit(True)).otherwise(
            ~F.coalesce(F.lower(F.trim(parsed["suitable_for_junior"])).isin(FALSE_WORDS), F.lit(False))),
        # an explicit null stays null, a missing key has a default
        "experience_required": F.when(~(lost | empty), F.when(F.array_contains(
            F.json_object_keys(body), "experience_required"), parsed["experience_required"]).otherwise(
            F.lit("Not specified"))),
        "reason": F.when(lost, F.lit(NO_REPLY)).when(empty, F.lit(BAD_REPLY)).otherwise(
            F.coalesce(parsed["reason"], F.lit(""))),
        "confidence": F.when(lost | empty, F.lit(0.0)).otherwise(F.lit(REPLY_CONFIDENCE)),
    }
