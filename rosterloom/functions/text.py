"""Name normalisation as column expressions.

The declared domain is ASCII and U+00C0..U+017F, composed or decomposed. Spark has no Unicode normalisation function, so
a letter with a combining mark is handled in this order: decomposed umlauts and letters that expand, combining marks,
then a one-to-one translation, then upper case.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import vocab


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: the optimizer doesn't put it in its place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _one_to_one() -> tuple[str, str]:
    table = dict(vocab.SINGLE_LETTERS) | vocab.PUNCTUATION
    for point in range(0xC0, 0x180):
        c = chr(point)
        base = unicodedata.normalize("NFD", c)[0]
        if c not in table and c not in vocab.EXPANSIONS and base.isascii():
            table[c] = base
    return "".join(table), "".join(table.values())


_FROM, _TO = _one_to_one()
_CAPITALS = "".join(c for c in vocab.EXPANSIONS if c.isupper())
_SMALL = {c: to for c, to in vocab.EXPANSIONS.items() if not c.isupper()}


def quoted(value: str) -> str:
    """A literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def transliterate_upper(x: Column | str) -> Column:
    """Latin letters to ASCII, German umlauts to digraphs, upper case. Null stays null."""
    out = F.replace(col(x), F.lit("\x00"), F.lit(" "))
    for vowel in "uoa":
        out = F.regexp_replace(out, f"[{vowel}{vowel.upper()}]̈(?!\\p{{Mn}})", vowel.upper() + "E")
    # capitals of the letters that expand first become small ones, so each pair takes one step
    out = F.translate(out, _CAPITALS, _CAPITALS.lower())
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _SMALL.items(), out)
    return F.upper(F.translate(F.regexp_replace(out, "\\p{Mn}", ""), _FROM, _TO))


def trim_white(x: Column) -> Column:
    return F.regexp_replace(x, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+\\z", "")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def has_name_information(x: Column | str) -> Column:
    return col(x).isNotNull() & (col(x) != "")


def strip_parenthetical(x: Column | str) -> Column:
    """Unwrap a bracket inside a word, drop others with what they hold (an unclosed one to the end), and stray brackets."""
    out = F.regexp_replace(col(x), r"([A-Za-z'])\(([^)]*)\)", "$1$2")
    out = F.regexp_replace(out, r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\([^)]*\z", " ")
    return F.regexp_replace(out, r"[\[\]()]", " ")


def name_key(x: Column | str, strip_alternates: bool = True, fold_hyphens: bool = False) -> Column:
    out = transliterate_upper(x)
    if strip_alternates:
        out = strip_parenthetical(out)
    if fold_hyphens:
        out = F.replace(out, F.lit("-"), F.lit(" "))
    return collapse(out)


def blank_na(x: Column | str, strip_alternates: bool = True, fold_hyphens: bool = False) -> Column:
    return F.coalesce(name_key(x, strip_alternates, fold_hyphens), F.lit(""))


def first_initial(x: Column | str, strip_alternates: bool = True, fold_hyphens: bool = False) -> Column:
    return F.nullif(F.substring(name_key(x, strip_alternates, fold_hyphens), 1, 1), F.lit(""))


def normalize_string(x: Column | str, remove_apostrophes: bool = False, remove_internal_spaces: bool = False) -> Column:
    """The general form: brackets and inner white space stay."""
    out = trim_white(transliterate_upper(x))
    if remove_apostrophes:
        out = F.replace(out, F.lit("'"), F.lit(""))
    if remove_internal_spaces:
        out = F.regexp_replace(out, "\\s+", "")
    return out


def extract_first_initial(x: Column | str) -> Column:
    return F.nullif(F.substring(F.regexp_replace(normalize_string(x), "[^A-Z]", ""), 1, 1), F.lit(""))


def split_given(given: Column | str, strip_alternates: bool = True, fold_hyphens: bool = False) -> Column:
    """struct(given, middle_from_given): the first token and the rest; absent: empty."""
    k = collapse(F.regexp_replace(blank_na(given, strip_alternates, fold_hyphens), "[.,]", " "))
    return F.struct(F.regexp_extract(k, "^(\\S*)", 1).alias("given"), F.trim(F.regexp_replace(k, "^[^ ]*", "")).alias("middle_from_given"))


def nm_key(x: Column | str) -> Column:
    """normalize_string with white space collapsed and apostrophes deleted."""
    return F.regexp_replace(F.regexp_replace(normalize_string(x), "\\s+", " "), "['’`]", "")


def compact_name_key(x: Column | str, strip_alternates: bool = True, strip_suffixes: bool = False) -> Column:
    """The letters of the key; null where there is none."""
    k = name_key(x, strip_alternates)
    if strip_suffixes:
        k = F.regexp_replace(k, vocab.TRAILING_CREDENTIAL, "")
    return F.nullif(F.regexp_replace(k, "[^A-Z]", ""), F.lit(""))


def surname_key_variants(x: Column | str, strip_alternates: bool = True) -> Column:
    """struct(key_full, key_final): the glued key and that of the last token; a trailing single letter doesn't count."""
    k = name_key(x, strip_alternates)
    tokens = F.filter(F.split(k, "[^A-Z']+"), lambda t: t != "")
    letters = lambda c: F.regexp_replace(c, "[^A-Z]", "")
    drop = (F.size(tokens) >= 2) & (F.length(letters(F.try_element_at(tokens, F.lit(-1)))) == 1)
    kept = F.when(drop, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    full = F.when(drop, letters(F.array_join(kept, ""))).otherwise(letters(k))
    return F.struct(F.nullif(full, F.lit("")).alias("key_full"), F.nullif(letters(F.try_element_at(kept, F.lit(-1))), F.lit("")).alias("key_final"))


def normalize_name_columns(df: DataFrame, cols: list[str], remove_apostrophes: bool = False, remove_internal_spaces: bool = False, suffix: str = "_norm") -> DataFrame:
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    return df.withColumns({c + suffix: normalize_string(c, remove_apostrophes, remove_internal_spaces) for c in cols})


def normalize_physician_names(df: DataFrame, first_col: str = "first_name", last_col: str = "last_name", middle_col: str = "middle_name", advanced_norm: bool = False) -> DataFrame:
    """Adds first_clean, last_clean, middle_clean (null without its source) and the initials of the clean columns."""
    if missing := [c for c in (first_col, last_col) if c not in df.columns]:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    clean = lambda c: normalize_string(c, advanced_norm, advanced_norm)
    middle = clean(middle_col) if middle_col in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"first_clean": clean(first_col), "last_clean": clean(last_col), "middle_clean": middle})
    return df.withColumns({"first_initial": extract_first_initial("first_clean"), "middle_initial": extract_first_initial("middle_clean")})


def needs_normalization(df: DataFrame, column: str) -> bool:
    """Whether any value isn't upper case or has white space around it."""
    c = F.col(column)
    return bool(df.agg(F.bool_or((c != F.upper(c)) | (c != trim_white(c)))).first()[0])


def surname_rarity(df: DataFrame, surname: str, frequencies: DataFrame) -> DataFrame:
    """Adds key, rank and per_100k; null beyond the table. The table of frequencies has a row for each surname."""
    if missing := [c for c in ("surname", "rank", "per_100k") if c not in frequencies.columns]:
        raise ValueError(f"frequencies needs columns {', '.join(missing)}")
    table = frequencies.select(F.col("surname").alias("__surname"), "rank", "per_100k")
    return df.withColumn("key", name_key(surname)).join(table, F.col("key") == F.col("__surname"), "left").drop("__surname")


def npi_text(df: DataFrame, column: str) -> Column:
    """An id as text: whole numbers in plain digits, others as they are."""
    c = F.col(column)
    kind = dict(df.dtypes)[column]
    if kind in ("double", "float") or kind.startswith("decimal"):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e18))
        return F.when(whole, F.expr(f"CAST(try_cast(`{column}` AS BIGINT) AS STRING)")).otherwise(c.cast("string"))
    return c.cast("string")


def npi_luhn_ok(x: Column | str) -> Column:
    """Ten digits, the first 1 or 2, with a valid check digit under the 80840 prefix; null stays null."""
    c = col(x).cast("string")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(c.rlike("^[12][0-9]{9}\\z") & F.call_function("luhn_check", F.concat(F.lit("80840"), c)))


def extract_npis(x: Column | str) -> Column:
    """Distinct valid ten-digit ids of a text."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(?<![0-9])([12][0-9]{9})(?![0-9])"), F.lit(1)))
    return F.filter(found, lambda n: F.call_function("luhn_check", F.concat(F.lit("80840"), n)))
