"""Text normalisation: an ordered chain of rules, as native expressions but for NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and its opposite as the rules mean them: U+001C to U+001F count too.
S = r"[\s\x1C-\x1F]"
N = r"[^\s\x1C-\x1F]"

# The rules' patterns, in Java's dialect (d: only \n ends a line; U: Unicode classes).
SCRIPT_OR_STYLE = r"(?isU)<(script|style)\b[^>]*>.*?</\1>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]{1,2000}>"
LINK = r"!?\[([^\]]*)\]\([^)]*\)"
REFERENCE = rf"(?iU)\[{S}*(?:\d{{1,4}}|citation needed|nb{S}*\d{{1,3}}|edit){S}*\]"
URL = rf"(?U)https?://{N}+|www\.{N}+"
HEADING = rf"(?mdU)^{S}{{0,3}}#{{1,6}}{S}+"
RULE = rf"(?mdU)^{S}{{0,3}}(?:[-*_]{S}*){{3,}}$"
EMPHASIS = rf"(?sU)(\*{{1,3}}|_{{1,3}}|`{{1,3}})({N}.{{0,400}}?{N}|{N})\1"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{2028}\x{2029}\x{FEFF}]"
SPACES = r"[ \t\r\f\x0B]+"
BLANK_LINES = r"\n{3,}"
LINE_ENDS = r"(?mdU)^[\s&&[^\n]]+|[\s&&[^\n]]+$"
TEXT_ENDS = r"(?dU)\A\s+|\s+\z"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Spark has no NFKC.  ASCII texts don't leave the JVM's answer to Python: their value is theirs already."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _guarded(text: Column, guards: tuple[str, ...], *rules: tuple[str, str]) -> Column:
    """The rules, where the text has one of the guards.  The one-element array names the text once: an optimiser
    that copies expressions can't multiply it."""

    def apply(t: Column) -> Column:
        c, has = t, F.contains(t, F.lit(guards[0]))
        for g in guards[1:]:
            has = has | F.contains(t, F.lit(g))
        for pattern, by in rules:
            c = F.regexp_replace(c, pattern, by)
        return F.when(has, c).otherwise(t)

    return F.transform(F.array(text), apply)[0]


def normalize(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the normalised text as column `out`; a null stays null."""
    c = _guarded(F.col(out), ("<",), (SCRIPT_OR_STYLE, " "), (COMMENT, " "), (TAG, " "))
    c = _guarded(c, ("[",), (LINK, "$1"), (REFERENCE, " "))
    c = _guarded(c, ("://", "www."), (URL, " "))
    c = _guarded(c, ("#",), (HEADING, ""))
    c = _guarded(c, ("*", "_", "`"), (RULE, ""), (EMPHASIS, "$2"))
    c = F.lower(c)
    for pattern, by in ((CONTROL, " "), (SPACES, " "), (BLANK_LINES, "\n\n"), (LINE_ENDS, ""), (TEXT_ENDS, "")):
        c = F.regexp_replace(c, pattern, by)
    return df.withColumn(out, nfkc(F.col(text))).withColumn(out, c)
