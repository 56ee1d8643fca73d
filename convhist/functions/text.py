"""Text expressions: folding, byte-bounded cuts, token estimates, envelopes, titles.

Everything here is a built-in column expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Names of the evidence envelopes that exported conversations may embed in text.
ENVELOPE_NAMES = (
    "HISTORICAL_TOOL_EVIDENCE",
    "HISTORICAL_RESOURCE",
    "HISTORICAL_REFERENCE",
    "HISTORICAL_CITATIONS",
    "HISTORICAL_CONTEXT",
    "HISTORICAL_WORK_STATE",
    "HISTORICAL_EVENT",
    "HISTORICAL_REASONING_SUMMARY",
    "HISTORICAL_REASONING_TRACE",
)
# Vendor tag inside the envelope markers; pass the exporter's own tag where it differs.
ENVELOPE_TAG = "CONVHIST"


def ascii_fold(value: Column) -> Column:
    """Lower-case A-Z only; accented letters keep their case."""
    return F.translate(value, _UPPER, _UPPER.lower())


def utf8_bytes(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def utf8_prefix(value: Column, limit: Column | int) -> Column:
    """Longest prefix of at most ``limit`` bytes that does not cut a character."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    limit = limit.cast("int")
    binary = value.cast("binary")
    cuts = [
        F.try_validate_utf8(F.substring(binary, F.lit(1), F.greatest(limit - back, F.lit(0))).cast("string"))
        for back in range(4)
    ]
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.coalesce(*cuts))


def exceeds(value: Column, limit: int) -> Column:
    return F.octet_length(value) > limit


def token_estimate(value: Column) -> Column:
    """ceil((ascii / 4 + other) * 1.2) + 16, counted in code points."""
    ascii_count = F.length(F.regexp_replace(value, r"[^\x00-\x7F]", "")).cast("double")
    other = F.length(value).cast("double") - ascii_count
    return F.ceil((ascii_count / 4 + other) * F.lit(1.2)).cast("bigint") + 16


def compact_title(value: Column, limit: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(value, f"{_SPACE}+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def snippet(value: Column, query: str, margin: int = 120) -> Column:
    """Text around the first match, ``...`` where it was cut; null without a match."""
    found = F.instr(ascii_fold(value), _fold(query))
    start = F.greatest(found - 1 - margin, F.lit(0))
    end = F.least(found - 1 + len(query) + margin, F.length(value))
    cut = F.concat(
        F.when(start == 0, "").otherwise("..."),
        F.substring(value, start + 1, end - start),
        F.when(end == F.length(value), "").otherwise("..."),
    )
    return F.when(found > 0, cut)


def _fold(query: str) -> str:
    return query.translate(str.maketrans(_UPPER, _UPPER.lower()))


def matches(value: Column, query: str) -> Column:
    return F.instr(ascii_fold(value), _fold(query)) > 0


def envelopes(value: Column, tag: str = ENVELOPE_TAG) -> Column:
    """Array of the valid envelopes embedded in a text, each with its markers."""
    names = "|".join(ENVELOPE_NAMES)
    # A look-ahead finds the candidate behind every header, also behind a malformed one.
    pattern = rf"(?=(<<<{tag}_({names})_V1>>>(?s:.*?)<<<END_{tag}_\2_V1>>>))"
    found = F.regexp_extract_all(value, F.lit(pattern), F.lit(1))
    return F.when(F.contains(value, F.lit(f"<<<{tag}_")), F.filter(found, _valid_envelope)).otherwise(
        F.array().cast("array<string>")
    )


def envelope_name(envelope: Column, tag: str = ENVELOPE_TAG) -> Column:
    return F.regexp_extract(envelope, rf"^<<<{tag}_([A-Z0-9_]+)_V1>>>", 1)


def envelope_payload(envelope: Column) -> Column:
    """JSON text between the markers."""
    return F.trim(F.regexp_extract(envelope, r"(?s)^<<<[A-Z0-9_]+>>>(.*)<<<[A-Z0-9_]+>>>$", 1))


def _valid_envelope(envelope: Column) -> Column:
    payload = F.try_parse_json(envelope_payload(envelope))
    notice = F.try_variant_get(payload, "$.notice", "string")
    agent = F.schema_of_variant(F.try_variant_get(payload, "$.source_agent", "variant"))
    kind = F.schema_of_variant(F.try_variant_get(payload, "$.notice", "variant"))
    return F.coalesce((kind == "STRING") & notice.startswith("Historical ") & (agent == "STRING"), F.lit(False))


def strip_envelopes(value: Column, tag: str = ENVELOPE_TAG) -> Column:
    """Text without its valid envelopes, white space trimmed at both ends."""
    plain = F.aggregate(envelopes(value, tag), value, lambda text, part: F.replace(text, part, F.lit("")))
    return trim_space(plain)


def trim_space(value: Column) -> Column:
    """Trim every kind of white space, not only blanks.

    The pattern tries every run of white space, so only texts that begin or end with some are searched; it also trims in
    front of a last line terminator, and U+0085 is one.
    """
    edge = F.substring(value, 1, 1).rlike(_SPACE) | F.substring(value, -1, 1).rlike(rf"{_SPACE}|\x{{85}}")
    return F.when(edge, F.regexp_replace(value, rf"^{_SPACE}+|{_SPACE}+$", "")).otherwise(value)


def quote_lines(value: Column) -> Column:
    """Markdown quote: ``> `` before every line."""
    return F.concat(F.lit("> "), F.replace(value, F.lit("\n"), F.lit("\n> ")))


def reminder_line(kind: Column, item_id: Column, status: Column, title: Column) -> Column:
    mark = F.when(kind == "task_reminder", "#").otherwise("")
    return F.concat(mark, item_id, F.lit(". ["), status, F.lit("] "), title)


def gap_code(prefix: str, native_type: Column) -> Column:
    """Safe lower-case code for an unknown native record type."""
    usable = native_type.rlike(r"^[A-Za-z0-9._-]{1,64}$")
    kind = F.when(usable, native_type).otherwise("unclassified")
    return F.concat(F.lit(prefix + "."), F.translate(ascii_fold(kind), "-", "_"))


def content_text(blocks: Column) -> Column:
    """Lines of a typed block list: text, thinking, tool-call and image labels."""

    def line(block: Column) -> Column:
        kind = block["type"]
        return (
            F.when(kind == "text", block["text"])
            .when(kind == "thinking", block["thinking"])
            .when(kind == "toolCall", F.concat(F.lit("[Tool call: "), block["name"], F.lit("]")))
            .when(kind == "image", F.concat(F.lit("[Image: "), block["mimeType"], F.lit("]")))
        )

    return F.array_join(F.filter(F.transform(blocks, line), lambda text: text.isNotNull()), "\n")


def content_kinds(blocks: Column) -> Column:
    """Distinct block types in order of first appearance."""
    return F.array_distinct(
        F.filter(F.transform(blocks, lambda block: block["type"]), lambda kind: kind.isNotNull())
    )


CONTENT_BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,mimeType:string>>"


@F.pandas_udf(T.StringType())
def _nfkc_lower(values: pd.Series) -> pd.Series:
    return values.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text).lower())


def normalize_phrase(value: Column) -> Column:
    """NFKC, lower case, runs of other characters to one blank. NFKC has no SQL form: Arrow UDF."""
    return F.trim(F.regexp_replace(_nfkc_lower(value), r"[^\p{L}\p{N}_.:/+-]+", " "))


# Character classes of the Unicode sentence rules (UAX 29), as members of a regular expression's set.
_SB_SEPARATOR = r"\n\r\u0085\u2028\u2029"
_SB_BLANK = r"\t\x0B\f \u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
_SB_UPPER, _SB_LOWER, _SB_LETTER, _SB_NUMBER = r"\p{Lu}\p{Lt}", r"\p{Ll}", r"\p{L}\p{Nl}", r"\p{Nd}"
_SB_FULL_STOP = r".\u2024\uFE52\uFF0E"
_SB_TERMINAL = r"!?\u0589\u061D-\u061F\u06D4\u0964\u0965\u104A\u104B\u1362\u1367\u1368\u203C\u203D\u2047-\u2049\u2E2E\u3002\uFE56\uFE57\uFF01\uFF1F\uFF61"
_SB_CLOSING = r"\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"'"
_SB_GOES_ON = r",\-:\u055D\u060C\u060D\u1802\u1808\u2013\u2014\u3001\uFE10\uFE11\uFE13\uFE50\uFE51\uFE55\uFE58\uFE63\uFF0C\uFF0D\uFF1A\uFF64"


def _sentence_pattern() -> str:
    """One sentence: up to the first place where the rules break, or to the end.

    A line break always ends one (SB4). A mark with the closing marks and blanks behind it does (SB9 to SB11) unless a
    comma or another mark follows (SB8a); a full stop also doesn't before a digit (SB6), between letters of which the second
    is upper case (SB7), or if the next letter is lower case (SB8).
    """
    line_end = rf"(?:\r\n|[{_SB_SEPARATOR}])"
    behind = rf"[{_SB_CLOSING}]*+[{_SB_BLANK}]*+"
    no_mark = rf"(?![{_SB_GOES_ON}{_SB_FULL_STOP}{_SB_TERMINAL}])"
    no_lower = rf"(?![^{_SB_LETTER}{_SB_SEPARATOR}{_SB_FULL_STOP}{_SB_TERMINAL}]*+[{_SB_LOWER}])"
    cased = _SB_UPPER + _SB_LOWER
    stop = rf"(?:(?<![{cased}])[{_SB_FULL_STOP}]|(?<=[{cased}])[{_SB_FULL_STOP}](?![{_SB_UPPER}]))(?![{_SB_NUMBER}])"
    ends = rf"{line_end}|[{_SB_TERMINAL}]{behind}(?:{line_end}|{no_mark})|{stop}{behind}(?:{line_end}|{no_mark}{no_lower})"
    return rf"(?s)(?=.).*?(?:{ends}|\z)"


def sentences(text: Column) -> Column:
    """Sentences of a text by the Unicode rules; together they are the text. Combining and format characters have no special role."""
    return F.regexp_extract_all(text, F.lit(_sentence_pattern()), F.lit(0))
