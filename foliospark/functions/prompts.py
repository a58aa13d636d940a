"""What is said to language models, and what is taken from their replies, as Column expressions.

An engine sends the messages; nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a style asks for; a style that is not here is balanced.
GUIDANCE = {
    "literal": "Stay as close to the wording of the original as the target language allows.",
    "balanced": "Be faithful to the meaning and easy to read.",
    "natural": "Prefer what a native speaker would say over the original's wording.",
    "localized": "Adapt idioms, jokes and references to readers of the target language.",
}


def _messages(system: Column, user: Column) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", system), ("user", user))])


def _said(label: str, texts: Column) -> Column:
    """label and the texts, or null without any."""
    return F.when(F.size(texts) > 0, F.concat(F.lit(label), F.array_join(texts, " / ")))


def translation_messages(source: Column, preceding: Column, following: Column, terms: Column, source_lang: str, target_lang: str, style: str = "balanced") -> Column:
    """Messages that ask for one line's translation: fixed terms (array of source, target) and neighbours first, where there are any."""
    system = f"Translate the user's line from {source_lang} to {target_lang}. {GUIDANCE.get(style, GUIDANCE['balanced'])} Answer with the translated line alone."
    pinned = F.transform(terms, lambda t: F.concat(t["source"], F.lit(" = "), t["target"]))
    fixed = F.when(F.size(terms) > 0, F.concat(F.lit("Always translate these terms so: "), F.array_join(pinned, "; "), F.lit(".")))
    user = F.concat_ws("\n\n", fixed, _said("Said before: ", preceding), _said("Said after: ", following), F.concat(F.lit("Line:\n"), source))
    return _messages(F.lit(system), user)


def correction_messages(text: Column, source_lang: str, most: int = 3) -> Column:
    """Messages that ask for corrected readings of a recognised line, as JSON."""
    system = (
        f"A recogniser read one line of {source_lang} text and was unsure. Give up to {most} corrected readings of the line itself, in its own language and script, "
        'without translating. Answer with one JSON object alone: "alternatives" (array of strings, most likely first, empty if the line is right), '
        '"confidence" (number from 0 to 1), "rationale" (string).'
    )
    return _messages(F.lit(system), F.concat(F.lit("Line:\n"), text))


def assist_messages(source: Column, draft: Column, preceding: Column, following: Column, target_lang: str) -> Column:
    """Messages that ask to improve a draft translation, as JSON that candidates.parsed_reply reads."""
    system = (
        f'Improve a draft translation into {target_lang}. Answer with one JSON object alone: "candidate" (string), "readability" (string), "literal" (string), '
        '"confidence" (number from 0 to 1), "warnings" (array of strings).'
    )
    user = F.concat_ws("\n\n", _said("Said before: ", preceding), _said("Said after: ", following), F.concat(F.lit("Line:\n"), source), F.concat(F.lit("Draft:\n"), draft))
    return _messages(F.lit(system), user)


def chat_text(response: Column) -> Column:
    """The first choice's text in a chat completion's JSON, null if there is none."""
    return F.trim(F.get_json_object(response, "$.choices[0].message.content"))


def translations_text(response: Column) -> Column:
    """The first text of a translation service's JSON, null if there is none."""
    return F.trim(F.get_json_object(response, "$.translations[0].text"))


def service_language(code: str, special: dict[str, str] | None = None) -> str:
    """A language code as a translation service takes it: upper case, but for special ones."""
    return (special or {}).get(code.lower(), code.upper())


def corrected(reply: Column, most: int = 3) -> Column:
    """struct(alternatives, confidence, rationale) of a correction's reply, fenced or not; null if it is no JSON object.

    Alternatives are cut to `most` distinct ones that are not blank; confidence lies in 0..1, to three digits.
    """
    bare = F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*|\s*```$", "")
    p = F.from_json(bare, "alternatives array<string>, confidence double, rationale string")
    some = F.transform(F.filter(F.coalesce(p["alternatives"], F.array().cast("array<string>")), lambda a: F.trim(a) != ""), lambda a: F.trim(a))
    sure = F.when(p["confidence"].isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["confidence"])), 3))
    found = F.struct(F.slice(F.array_distinct(some), 1, most).alias("alternatives"), sure.alias("confidence"), F.nullif(F.trim(p["rationale"]), F.lit("")).alias("rationale"))
    return F.when(bare.startswith("{") & bare.endswith("}") & p.isNotNull(), found)
