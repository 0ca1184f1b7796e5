"""Agreement rules: each returns one of three verdicts as a column.

``corroborates``, ``conflicts`` and ``uninformative`` are the only verdicts. What is absent is never evidence: a null or
empty side is ``uninformative``. No rule measures similarity of spelling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions import tokens as tk
from rosterloom.functions import vocab
from rosterloom.functions.nicknames import SEED, NicknameDictionary, nickname_token
from rosterloom.functions.parse import strip_name_noise
from rosterloom.functions.text import col, compact_name_key, has_name_information, let, name_key, nm_key, normalize_string, quoted

CORROBORATES, CONFLICTS, UNINFORMATIVE = "corroborates", "conflicts", "uninformative"


def lookup(table: dict[str, object], x: Column) -> Column:
    """Value of a small table, or null; the table is a literal that is parsed at once."""
    text = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return F.try_element_at(F.expr(f"map({', '.join(text(v) for kv in table.items() for v in kv)})"), x)


def verdict(known: Column, agrees: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), UNINFORMATIVE).when(agrees, CORROBORATES).otherwise(CONFLICTS)


# --- surnames -----------------------------------------------------------------------------------------------------


def surname_match_type_of(ka: Column, kb: Column, xa: Column, xb: Column) -> Column:
    """As name_surname_match_type, of keys and components that are there already."""
    particles = tk.strings(vocab.NAME_SURNAME_PARTICLES)
    inside = lambda s, b: F.size(F.array_except(s, b)) == 0
    glued = lambda s, b: (F.size(s) > 1) & F.array_contains(b, F.array_join(s, ""))
    nests = lambda s, b: inside(s, b) & (F.size(F.array_except(s, particles)) > 0)
    return (
        F.when(F.coalesce((ka != "") & (ka == kb), F.lit(False)), "exact")
        .when((F.size(xa) == 0) | (F.size(xb) == 0), "none")
        .when(inside(xa, xb) & inside(xb, xa), "separator_equivalent")
        .when(glued(xa, xb) | glued(xb, xa), "concatenated_equivalent")
        .when(nests(xb, xa) | nests(xa, xb), "component_subset")
        .otherwise("none")
    )


def name_surname_match_type(a: Column | str, b: Column | str) -> Column:
    """exact, separator_equivalent, concatenated_equivalent, component_subset or none."""
    keys = F.struct(nm_key(a).alias("a"), nm_key(b).alias("b"))
    parts = lambda k: F.struct(tk.components_of_key(k["a"]).alias("a"), tk.components_of_key(k["b"]).alias("b"))
    return let(keys, lambda k: let(parts(k), lambda x: surname_match_type_of(k["a"], k["b"], x["a"], x["b"])))


def names_have_compatible_surname(a: Column | str, b: Column | str) -> Column:
    return name_surname_match_type(a, b) != "none"


def _dequoted(x: Column) -> Column:
    return F.replace(x, F.lit("'"), F.lit(""))


def alternate_forms(alternates: Column | None) -> Column:
    """Keys and tokens of a record's array of other surnames."""
    if alternates is None:
        return F.array().cast("array<string>")
    known = F.filter(F.coalesce(alternates, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    return F.transform(F.concat(F.transform(known, lambda s: name_key(s)), F.flatten(F.transform(known, lambda s: tk.surname_tokens(s)))), _dequoted)


def surname_agreement(a, b, middle_a=None, middle_b=None, alternates_a=None, alternates_b=None) -> Column:
    """struct(verdict, reason). alternates: array columns of recorded other surnames; middles allow the maiden-name rescue."""
    once = {"kind": name_surname_match_type(a, b)}
    for s, name, mid, alternates in (("a", a, middle_a, alternates_a), ("b", b, middle_b, alternates_b)):
        once |= {f"{n}_{s}": c for n, c in surname_facts(name, mid).items()}
        once["others_" + s] = alternate_forms(None if alternates is None else col(alternates))
    return let(F.struct(*[c.alias(n) for n, c in once.items()]), surname_agreement_of)


def surname_facts(name, middle=None) -> dict[str, Column]:
    """What surname_agreement() reads of one side's surname and middle name."""
    tokens = F.array().cast("array<string>") if middle is None else F.transform(tk.middle_tokens(middle), _dequoted)
    return {"key": _dequoted(name_key(name)), "tokens": F.transform(tk.surname_tokens(name), _dequoted), "middle": tokens}


def surname_agreement_of(v) -> Column:
    """As surname_agreement; v["kind"] is the surname match type, v["key_a"], v["tokens_b"] and so on are surname_facts() and alternate_forms()."""
    meets = lambda x, y: F.size(F.array_intersect(x, y)) > 0
    reason = (
        F.when(v["kind"] != "none", v["kind"])
        .when(meets(F.concat(F.array(v["key_b"]), v["tokens_b"]), v["others_a"]) | meets(F.concat(F.array(v["key_a"]), v["tokens_a"]), v["others_b"]), "alternate_recorded")
        .when(meets(v["tokens_b"], v["middle_a"]) | meets(v["tokens_a"], v["middle_b"]), "maiden_as_middle")
    )
    known = has_name_information(v["key_a"]) & has_name_information(v["key_b"])
    return let(reason, lambda r: F.struct(verdict(known, r.isNotNull()).alias("verdict"), F.when(known, r).alias("reason")))


# --- given and middle names -----------------------------------------------------------------------------------------


def initials_string_matches(short: Column, toks: Column) -> Column:
    """One token of two to four characters is, in order, initials of distinct tokens."""
    word = F.try_element_at(short, F.lit(1))
    initials = F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), "")
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    # what is left of the initials behind each letter in turn; null once a letter isn't there
    rest = F.aggregate(letters, initials, _behind)
    return F.coalesce((F.size(short) == 1) & F.length(word).between(2, 4) & (F.size(toks) >= F.length(word)) & rest.isNotNull(), F.lit(False))


def _behind(left: Column, c: Column) -> Column:
    at = F.call_function("locate", c, left)
    return F.when(left.isNotNull() & (at > 0), left.substr(at + 1, F.length(left)))


def middle_agreement(a_tokens: Column, b_tokens: Column) -> Column:
    a, b = col(a_tokens), col(b_tokens)
    ka, kb = nm_key(F.array_join(a, " ")), nm_key(F.array_join(b, " "))
    return middle_agreement_of(a, b, surname_match_type_of(ka, kb, tk.components_of_key(ka), tk.components_of_key(kb)))


def middle_agreement_of(a: Column, b: Column, compound: Column) -> Column:
    """As middle_agreement; ``compound`` is the surname match type of the joined tokens."""
    full = lambda t: F.filter(t, lambda x: F.length(x) >= 2)
    initial = lambda t: F.exists(t, lambda x: F.length(x) == 1)
    firsts = lambda t: F.transform(t, lambda x: F.substring(x, 1, 1))
    agrees = (
        F.arrays_overlap(full(a), full(b))
        | compound.isin("exact", "separator_equivalent", "concatenated_equivalent")
        | initials_string_matches(a, b)
        | initials_string_matches(b, a)
        | ((initial(a) | initial(b)) & F.arrays_overlap(firsts(a), firsts(b)))
    )
    return verdict((F.size(a) > 0) & (F.size(b) > 0), agrees)


def nickname_verdict_of(x: Column, y: Column, roots_x: Column, roots_y: Column) -> Column:
    """As nickname_agreement, of tokens and roots that are there already."""
    first = F.substring(x, 1, 1) == F.substring(y, 1, 1)
    agrees = F.when(x == y, True).when((F.length(x) == 1) | (F.length(y) == 1), first).otherwise(F.arrays_overlap(roots_x, roots_y))
    return verdict(has_name_information(x) & has_name_information(y), agrees)


def nickname_agreement(a: Column | str, b: Column | str, edges: NicknameDictionary = SEED) -> Column:
    x, y = nickname_token(a), nickname_token(b)
    return nickname_verdict_of(x, y, edges.roots(x), edges.roots(y))


def are_nickname_equivalents(a: Column | str, b: Column | str, edges: NicknameDictionary = SEED) -> Column:
    """The relation without the rule for initials; false where a side is absent."""
    x, y = normalize_string(a), normalize_string(b)
    return F.coalesce((x == y) | F.arrays_overlap(edges.roots(x), edges.roots(y)), F.lit(False))


def given_name_agreement(a: Column | str, b: Column | str, edges: NicknameDictionary = SEED) -> Column:
    """struct(verdict, reason): exact, initial or nickname where it corroborates."""
    return given_agreement_of(compact_name_key(a), compact_name_key(b), are_nickname_equivalents(a, b, edges))


def given_agreement_of(ka: Column, kb: Column, nickname: Column) -> Column:
    """As given_name_agreement, of compact keys and whether the names are nickname equivalents."""
    one_initial = (F.length(ka) == 1) != (F.length(kb) == 1)
    reason = F.when(ka == kb, "exact").when(one_initial, F.when(F.substring(ka, 1, 1) == F.substring(kb, 1, 1), "initial")).when(nickname, "nickname")
    known = ka.isNotNull() & kb.isNotNull()
    return F.struct(verdict(known, reason.isNotNull()).alias("verdict"), F.when(known, reason).alias("reason"))


def compatible_given_of(x: Column, y: Column, nickname: Column) -> Column:
    """Position-wise compatibility of two leading names; ``nickname`` is their nickname verdict."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    ix, iy = tk.is_initial(x), tk.is_initial(y)
    return (
        F.when(blank(x) | blank(y) | (ix & iy), False)
        .when(x == y, True)
        .when(ix, F.substring(y, 1, 1) == x)
        .when(iy, F.substring(x, 1, 1) == y)
        .otherwise(nickname == CORROBORATES)
    )


def names_have_compatible_given(a_first, b_first, a_middle=None, b_middle=None, *, mode: str, edges: NicknameDictionary = SEED) -> Column:
    """mode has no default: positional_ie compares leading names, any_token asks for a shared token."""
    if mode == "any_token":
        return F.size(F.array_intersect(tk.name_given_tokens(a_first, a_middle), tk.name_given_tokens(b_first, b_middle))) > 0
    if mode != "positional_ie":
        raise ValueError("mode must be explicitly specified: positional_ie or any_token")
    x, y = tk.name_leading_given(a_first), tk.name_leading_given(b_first)
    return compatible_given_of(x, y, nickname_verdict_of(x, y, edges.roots(x), edges.roots(y)))


def given_position_of(tokens_a: Column, tokens_b: Column, lead_a: Column, lead_b: Column) -> Column:
    shared = F.array_intersect(tokens_a, tokens_b)
    leads = lambda x: F.coalesce(F.array_contains(shared, x), F.lit(False))
    return F.when(F.size(shared) > 0, F.when(leads(lead_a) & leads(lead_b), "both_leading").when(leads(lead_a) | leads(lead_b), "one_leading").otherwise("neither_leading"))


def name_given_match_position(a_first, b_first, a_middle=None, b_middle=None) -> Column:
    """both_leading, one_leading, neither_leading, or null without a shared token."""
    return given_position_of(tk.name_given_tokens(a_first, a_middle), tk.name_given_tokens(b_first, b_middle), tk.name_leading_given(a_first), tk.name_leading_given(b_first))


def person_matches(last_a, given_a, last_b, given_b) -> Column:
    """Equal informative surnames and a shared given token (token array columns)."""
    a, b = col(last_a), col(last_b)
    same = has_name_information(a) & has_name_information(b) & (a == b)
    return F.coalesce(same, F.lit(False)) & (F.size(F.array_intersect(col(given_a), col(given_b))) > 0)


# --- gender, suffix, licence --------------------------------------------------------------------------------------------


def normalize_gender(x: Column | str) -> Column:
    u = F.upper(F.trim(col(x).cast("string")))
    return F.when(u.isin("M", "MALE"), "M").when(u.isin("F", "FEMALE"), "F")


def gender_agreement(a: Column | str, b: Column | str) -> Column:
    x, y = normalize_gender(a), normalize_gender(b)
    return verdict(x.isNotNull() & y.isNotNull(), x == y)


def normalize_suffix(x: Column | str) -> Column:
    return lookup(vocab.SUFFIX_SPELLINGS, F.replace(F.upper(F.trim(col(x))), F.lit("."), F.lit("")))


def extract_suffix(x: Column | str) -> Column:
    """struct(name, suffix): suffix tokens behind the first token are taken out, the last one found counts."""
    parts = F.filter(F.split(col(x), "\\s+"), lambda t: t != "")

    def taken(parts: Column, canon: Column) -> Column:
        kept = F.filter(parts, lambda t, i: F.get(canon, i).isNull())
        found = F.filter(canon, lambda c: c.isNotNull())
        name = F.trim(F.regexp_replace(F.array_join(kept, " "), "[ ,]+\\z", ""))
        return F.struct(name.alias("name"), F.try_element_at(found, F.lit(-1)).alias("suffix"))

    canon = lambda parts: F.transform(parts, lambda t, i: F.when(i > 0, normalize_suffix(F.regexp_replace(t, "[.,]", ""))))
    return let(parts, lambda p: let(canon(p), lambda c: taken(p, c)))


def suffix_agreement(a: Column | str, b: Column | str) -> Column:
    x, y = (lookup(vocab.SUFFIX_GENERATION, normalize_suffix(c)) for c in (a, b))
    return verdict(x.isNotNull() & y.isNotNull(), x == y)


def normalize_license(x: Column | str) -> Column:
    return F.nullif(F.upper(F.regexp_replace(col(x).cast("string"), "[ .\\-]", "")), F.lit(""))


def license_agreement(a, state_a, b, state_b) -> Column:
    """Same number in the same state corroborates; nothing conflicts."""
    na, nb = normalize_license(a), normalize_license(b)
    sa, sb = (F.nullif(F.upper(F.trim(col(s).cast("string"))), F.lit("")) for s in (state_a, state_b))
    return F.when(F.coalesce((na == nb) & (sa == sb), F.lit(False)), CORROBORATES).otherwise(UNINFORMATIVE)


def license_anatomy(x: Column | str) -> Column:
    """struct(license, key, prefix, digits, suffix, shape, n_digits)."""
    key = normalize_license(x)
    digit = key.rlike("[0-9]")
    middle = F.regexp_extract(key, "([0-9](?:.*[0-9])?)", 1)
    return F.struct(
        col(x).cast("string").alias("license"),
        key.alias("key"),
        F.regexp_extract(key, "^([^0-9]*)", 1).alias("prefix"),
        F.when(digit, middle).alias("digits"),
        F.when(digit, F.regexp_extract(key, "([^0-9]*)\\z", 1)).when(key.isNotNull(), "").alias("suffix"),
        F.regexp_replace(key, "[0-9]", "#").alias("shape"),
        F.length(F.regexp_replace(key, "[^0-9]", "")).alias("n_digits"),
    )


def _status_key(x: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(x, "[\\s\\p{Punct}]+", " ")))


def normalize_license_status(x: Column | str, levels: dict[str, list[str]] = vocab.LICENSE_STATUS_LEVELS) -> Column:
    """Class of a status word; null where it isn't known."""
    import re

    clean = lambda s: re.sub(r"[\s!-/:-@\[-`{-~]+", " ", s).strip().upper()
    return lookup({clean(s): c for c, words in levels.items() for s in words}, _status_key(col(x).cast("string")))


# --- years, taxonomies, organisations, credentials --------------------------------------------------------------------------


def graduation_year_band(credentialing, graduation, bands=vocab.GRADUATION_YEAR_BANDS) -> Column:
    """Name of the first band that holds graduation less credentialing year; unknown without both."""
    d = _year(graduation) - _year(credentialing)
    cases = [(name, d.between(F.lit(-(2**31) if lo is None else lo), F.lit(2**31 - 1 if hi is None else hi))) for name, lo, hi, *_ in bands]
    out = reduce(lambda c, case: c.when(case[1], case[0]), cases[1:], F.when(cases[0][1], cases[0][0]))
    return F.coalesce(F.when(d.isNotNull(), out), F.lit("unknown"))


def _year(x) -> Column:
    return col(x).try_cast("int")


def graduation_year_agreement(credentialing, graduation, bands=vocab.GRADUATION_YEAR_BANDS) -> Column:
    return F.coalesce(lookup({b[0]: b[3] for b in bands}, graduation_year_band(credentialing, graduation, bands)), F.lit(UNINFORMATIVE))


def taxonomy_family_pattern(specialty: Column | str) -> Column:
    return lookup(vocab.TAXONOMY_FAMILY_PATTERNS, col(specialty))


def taxonomy_consistent(taxonomy: Column | str, expected: Column | str) -> Column:
    """Whether a pipe-separated code starts with a pipe-separated prefix; null without a basis."""
    codes, prefixes = tk.pipe_list(taxonomy), F.split(col(expected), "\\|")
    hit = F.exists(codes, lambda c: F.exists(prefixes, lambda p: c.startswith(p)))
    return F.when((F.size(codes) > 0) & col(expected).isNotNull(), hit)


def taxonomy_tiebreak_rank(consistent: Column | str) -> Column:
    c = col(consistent)
    return F.when(c.isNull(), 1).when(c, 0).otherwise(2)


def identity_tokens(x: Column | str) -> Column:
    """Tokens of two characters or more that aren't degrees or organisation words."""
    key = name_key(strip_name_noise(x), fold_hyphens=True)
    return F.array_except(F.filter(F.split(F.coalesce(key, F.lit("")), " "), lambda t: F.length(t) >= 2), tk.strings(vocab.ORG_NOISE))


def org_name_matches_person(org: Column | str, person: Column | str) -> Column:
    """Whether identity tokens are shared; null if a side has none."""
    a, b = identity_tokens(org), identity_tokens(person)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def normalize_credential(x: Column | str) -> Column:
    """Recognised degrees in order, joined by ", "; empty without one.

    The rule is specified here: dots go, commas, semicolons, slashes and white space separate, unknown words are left out.
    """
    words = F.split(F.upper(F.replace(F.coalesce(col(x).cast("string"), F.lit("")), F.lit("."), F.lit(""))), "[,;/\\s]+")
    return F.array_join(F.array_distinct(F.filter(F.transform(words, lambda w: lookup(vocab.CREDENTIALS, w)), lambda w: w.isNotNull())), ", ")


def attribute_verdict(name: str, a, b, state_a=None, state_b=None) -> Column:
    """Verdict of one attribute; blank on either side is uninformative."""
    x, y = col(a).cast("string"), col(b).cast("string")
    first_year = lambda c: F.substring(F.trim(c), 1, 4)
    if name == "gender":
        out = gender_agreement(x, y)
    elif name == "license":
        out = license_agreement(x, state_a, y, state_b)
    elif name == "state":
        out = verdict(F.lit(True), F.upper(F.trim(x)) == F.upper(F.trim(y)))
    elif name == "credential":
        p, q = normalize_credential(x), normalize_credential(y)
        out = verdict((p != "") & (q != ""), F.arrays_overlap(F.split(p, ", "), F.split(q, ", ")))
    elif name == "taxonomy":
        ok = taxonomy_consistent(y, x)
        out = verdict(ok.isNotNull(), ok)
    elif name == "graduation_year":
        out = graduation_year_agreement(first_year(y), first_year(x))
    else:
        raise ValueError(f"unknown attribute: {name}")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(blank(x) | blank(y), UNINFORMATIVE).otherwise(out)

