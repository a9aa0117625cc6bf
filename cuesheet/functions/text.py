"""String expressions: stripping, line splitting, tokens, labels and previews.

Everything here is a built-in Catalyst expression, so it stays inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
# The line boundaries of a Unicode-aware line split.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# A word token.
TOKEN = "[A-Za-z0-9']+"


def strip(text: Column) -> Column:
    """Remove surrounding white space, Unicode spaces included."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Array of raw lines. A trailing break adds one empty line, which every caller drops."""
    return F.split(text, LINE_BREAK)


def stripped_lines(text: Column) -> Column:
    """Array of stripped, non-blank lines."""
    return F.filter(F.transform(split_lines(text), strip), lambda line: line != "")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens. Lower-casing first is one call per text, not per token."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that no other letter can turn into a token character."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_count(text: Column) -> Column:
    return F.size(raw_tokens(text)).cast("bigint")


def collapse_spaces(text: Column) -> Column:
    """Join the white-space separated words with single spaces."""
    return strip(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def speaker_name(line: Column) -> Column:
    """Candidate speaker of a stripped line: what stands before its first colon, else null."""
    name = strip(F.substring_index(line, ":", 1))
    return F.when((F.instr(line, ":") > 1) & (name != ""), name)


def after_colon(line: Column) -> Column:
    return strip(F.substring(line, F.instr(line, ":") + 1, F.length(line)))


def speaker_key(name: Column) -> Column:
    return F.lower(strip(name))


def transcript_label(transcript: Column) -> Column:
    """First 40 characters of the first non-blank line."""
    first = F.try_element_at(stripped_lines(transcript), F.lit(1))
    return F.coalesce(F.nullif(F.left(first, F.lit(40)), F.lit("")), F.lit("empty-script"))


def request_label(script: Column) -> Column:
    """First line of a normalised script without its speaker prefix, at most 40 characters."""
    first = F.coalesce(F.try_element_at(stripped_lines(script), F.lit(1)), F.lit("empty-script"))
    body = F.when(F.instr(first, ":") > 0, after_colon(first)).otherwise(first)
    return F.coalesce(F.nullif(F.left(collapse_spaces(body), F.lit(40)), F.lit("")), F.lit("empty-script"))


def file_label(text: Column, fallback: str) -> Column:
    """A label safe in a file name."""
    safe = F.lower(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def preview(text: Column) -> Column:
    """Quoted text; past 60 characters only its first and last 30."""
    plain = collapse_spaces(text)
    whole = F.concat(F.lit("'"), plain, F.lit("'"))
    ends = F.concat(
        F.lit("'"), F.left(plain, F.lit(30)), F.lit("' ... '"), F.right(plain, F.lit(30)), F.lit("'")
    )
    return F.when(F.length(plain) <= 60, whole).otherwise(ends)


def straight_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("’"), F.lit("'"))
