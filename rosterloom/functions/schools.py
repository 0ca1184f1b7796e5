"""University names without the medical unit that stands before or behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions import vocab
from rosterloom.functions.text import col, let


def _named(x: Column) -> Column:
    return F.coalesce(x.rlike(vocab.INSTITUTION_WORD), F.lit(False))


def strip_med_suffix(x: Column | str) -> Column:
    """Keeps the university: behind a unit's name where that names one, else before it. Null stays null.

    Each phrase changes the string at most once per rule. Patterns are literals, which are compiled once and not for each
    row, and each step's string is computed once.
    """

    def behind(s: Column, p: str) -> Column:
        tail = F.regexp_extract(s, rf"(?i)^.+?\s*[,-]?\s*{p}(?:\s*,\s*|\s+(?:AT|OF)\s+(?:THE\s+)?)(.+)$", 1)
        return let(tail, lambda t: F.when(_named(t), t).otherwise(s))

    def before(s: Column, p: str) -> Column:
        head = F.regexp_replace(s, rf"(?i)^(.+?)\s*[,-]?\s*{p}\b.*$", "$1")
        head = F.regexp_replace(head, r"(?i)[ ,\-]+(AT|OF|THE|AND|SYSTEM|HSC)?[ ,\-]*\z", "")
        head = F.trim(F.regexp_replace(head, r"\s+", " "))
        return let(head, lambda h: F.when((h != s) & (h != "") & _named(h), h).otherwise(s))

    # the first step is the innermost
    steps = [(rule, p) for rule in (behind, before) for p in vocab.MEDICAL_UNIT_PATTERNS]
    return reduce(lambda s, step: let(s, lambda v: step[0](v, step[1])), steps, col(x))
