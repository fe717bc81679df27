"""Redaction of personal identifiers and flags for instruction-like text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters, digits and numbers of any script make words, marks do not; white space is of any kind.
WORD, SPACE = r"[\p{L}\p{N}_]", r"[\s\x1C-\x1F]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: What is redacted, in this order, and what looks like an instruction. Letters in both cases, as a range of one
#: case misses the Kelvin sign and the dotted I.
PERSONAL = [("IBAN", rf"{EDGE}[A-Za-z]{{2}}\d{{2}}(?:[ ]?[A-Za-z0-9]){{11,30}}{EDGE}"), ("EMAIL", rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{EDGE}")]
INSTRUCTIONS = [rf"ignore{SPACE}+(?:all{SPACE}+)?previous{SPACE}+instructions", rf"(?:system|developer){SPACE}+(?:message|prompt)", rf"reveal{SPACE}+(?:the{SPACE}+)?(?:prompt|instructions|secrets?)"]


def sanitize(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds sanitized, detected_categories and injection_suspected; the flag looks at the original text."""
    text, found = F.col(column), []
    for name, pattern in PERSONAL:
        found.append(F.when(text.rlike(f"(?iU){pattern}"), F.lit(name)))
        text = F.regexp_replace(text, f"(?iU){pattern}", f"[{name}_REDACTED]")
    suspected = F.lit(False)
    for pattern in INSTRUCTIONS:
        suspected = suspected | F.col(column).rlike(f"(?iU){pattern}")
    return df.withColumns({"sanitized": text, "detected_categories": F.array_compact(F.array(*found)), "injection_suspected": F.coalesce(suspected, F.lit(False))})
