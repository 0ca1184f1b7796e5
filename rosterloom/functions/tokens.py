"""Token arrays of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import vocab
from rosterloom.functions.text import blank_na, col, name_key, nm_key, quoted, trim_white


def strings(values: list[str]) -> Column:
    """An array literal, parsed at once."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def _tokens(x: Column, separators: str, keep) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(x, F.lit("")), separators), keep))


def surname_tokens(x: Column | str, strip_alternates: bool = True) -> Column:
    """Tokens of four characters or more that aren't particles."""
    return surname_tokens_of_key(name_key(x, strip_alternates))


def surname_tokens_of_key(k: Column) -> Column:
    particles = strings(vocab.SURNAME_PARTICLES)
    return _tokens(k, "[^A-Z']+", lambda t: (F.length(t) >= vocab.MIN_SURNAME_TOKEN) & ~F.array_contains(particles, t))


def middle_tokens(x: Column | str, strip_alternates: bool = True) -> Column:
    """Tokens with a letter; hyphens don't split."""
    return middle_tokens_of_key(name_key(x, strip_alternates))


def middle_tokens_of_key(k: Column) -> Column:
    return _tokens(k, "[^A-Z'-]+", lambda t: t.rlike("[A-Z]"))


def given_tokens(given: Column | str, middle: Column | str | None = None, strip_alternates: bool = True) -> Column:
    text = blank_na(given, strip_alternates)
    if middle is not None:
        text = F.trim(F.concat(text, F.lit(" "), blank_na(middle, strip_alternates)))
    return _tokens(text, "[^A-Z'-]+", lambda t: (F.length(t) >= 2) & t.rlike("[A-Z]"))


def surname_token_table(df: DataFrame, x: str, id: str) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.explode(surname_tokens(x)).alias("token"))


def components_of_key(k: Column) -> Column:
    return _tokens(F.upper(k), "[^A-Z]+", lambda t: F.length(t) >= 2)


def name_surname_components(x: Column | str) -> Column:
    return components_of_key(nm_key(x))


def given_tokens_of_keys(first: Column, middle: Column) -> Column:
    text = trim_white(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(middle, F.lit(""))))
    return _tokens(F.upper(text), "[^A-Z-]+", lambda t: F.length(t) >= 2)


def name_given_tokens(first: Column | str, middle: Column | str | None = None) -> Column:
    return given_tokens_of_keys(nm_key(first), F.lit("") if middle is None else nm_key(middle))


def leading_of_key(k: Column) -> Column:
    return F.get(F.filter(F.split(F.upper(k), "[^A-Z-]+"), lambda t: t.rlike("[A-Z]")), F.lit(0))


def name_leading_given(first: Column | str) -> Column:
    """The first token with a letter; null without one."""
    return leading_of_key(nm_key(first))


def is_initial(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Za-z]\\z"), F.lit(False))


def deletions(x: Column) -> Column:
    """The string and its forms with one character left out, for three characters and more."""
    each = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
    return F.when(F.length(x) >= 3, F.array_distinct(F.concat(F.array(x), each))).otherwise(F.array().cast("array<string>"))


def pipe_list(x: Column | str) -> Column:
    return F.filter(F.split(col(x), "\\|"), lambda t: t != "")
