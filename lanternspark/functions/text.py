"""Text expressions: report cleaning and section parsing, blank tests, templates.

All are Column -> Column and stay in the JVM.  BLANK lists the Unicode white space that
Python's str.strip and \\s know, so that results don't depend on an engine's idea of it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SYMBOLS = r"[_*#/\\<>~^`=|]+"
MARKER = r"\bimpression:" + BLANK + "*"
LABEL = "impression:"
SYSTEM_PROMPT = "You condense radiology notes into a short impression."
USER_PREFIX = "Summarise the following long note: "
USER_SUFFIX = "\n"
# ---------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of the characters at either end."""
    return F.btrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, f"{BLANK}+", " ")


def clean_report(c: Column) -> Column:
    """Lower case, runs of ruling symbols and of white space as one space, stripped first.  Null stays null."""
    return collapse(F.regexp_replace(F.lower(strip(c)), SYMBOLS, " "))


def report_sections(c: Column) -> Column:
    """struct<context, impression> of a report.

    Only a text with exactly one marker is divided; others (none, or several markers) are all
    context, with a bare label as impression.  A null report has a null context and a bare label.
    """
    parts = F.split(clean_report(c), MARKER, -1)
    one = F.size(parts) == 2
    return F.struct(
        F.when(one, strip(F.get(parts, F.lit(0)))).otherwise(strip(clean_report(c))).alias("context"),
        F.when(one, F.concat(F.lit(LABEL + " "), strip(F.get(parts, F.lit(1))))).otherwise(F.lit(LABEL)).alias("impression"),
    )


def is_blank_impression(c: Column) -> Column:
    """A bare label and nothing else; null is not blank."""
    return F.coalesce(c.rlike(f"^{BLANK}*{LABEL}{BLANK}*$"), F.lit(False))


def is_invalid_reference(c: Column, chars: str = " :;.,") -> Column:
    """Empty, or only the label, after folding case and white space and trimming `chars`; null counts as empty.

    With a space among chars "impression :" is invalid (the stricter rule), without it is valid.
    """
    text = F.coalesce(c.cast("string"), F.lit(""))
    return (strip(text) == "") | (strip_chars(strip(collapse(F.lower(text))), chars) == "impression")


def user_prompt(context: Column, prefix: str = USER_PREFIX, suffix: str = USER_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(context, F.lit("")), F.lit(suffix))


def continuation(full: Column, prompt: Column) -> Column:
    """What follows the prompt in a text that begins with it, stripped."""
    return strip(F.substring(full, F.length(prompt) + 1, F.length(full)))


def file_stem(c: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def config_map(c: Column) -> Column:
    """'k=v,k=v' as a map."""
    return F.str_to_map(c, F.lit(","), F.lit("="))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
