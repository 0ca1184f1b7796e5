"""Registry API responses: nested JSON to flat providers and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.agreement import normalize_gender

SCHEMA = (
    "Errors array<struct<description:string>>, result_count int, results array<struct<number:string, "
    "basic:struct<first_name:string,middle_name:string,last_name:string,name_suffix:string,name_prefix:string,credential:string,sex:string,enumeration_date:string,last_updated:string>, "
    "addresses:array<struct<address_purpose:string,postal_code:string,state:string>>, "
    "taxonomies:array<struct<code:string,desc:string,primary:boolean,state:string,license:string>>>>"
)


def _field(c: Column) -> Column:
    """Empty and "--" are absent."""
    return F.nullif(F.nullif(c, F.lit("")), F.lit("--"))


def _responses(df: DataFrame, text: str, keep: list[str], validate: bool) -> DataFrame:
    parsed = df.select(*keep, F.from_json(text, SCHEMA).alias("j"))
    if validate:
        errors = parsed.filter("j.Errors is not null").limit(1).collect()
        if errors:
            raise ValueError("registry API error: " + "; ".join((e["description"] or "unknown") for e in errors[0]["j"]["Errors"]))
    return parsed


def parse_search(df: DataFrame, text: str, retrieved: str, keep: list[str] | None = None, validate: bool = True) -> DataFrame:
    """One row for each provider in the responses of column ``text``; ``keep`` are columns to carry along.

    The practice location's address counts, else the first one. retrieved: the date of retrieval, yyyy-mm-dd.
    """
    keep = keep or []
    r = _responses(df, text, keep, validate).select(*keep, F.explode("j.results").alias("r"))
    here = F.filter("r.addresses", lambda a: a["address_purpose"] == "LOCATION")
    place = F.coalesce(F.get(here, F.lit(0)), F.get("r.addresses", F.lit(0)))
    basic = lambda n: _field(F.col(f"r.basic.{n}"))
    enumerated = basic("enumeration_date")
    day = F.to_date(F.lit(retrieved))
    full = _field(place["postal_code"])
    return r.select(
        *keep,
        _field(F.col("r.number")).alias("npi"),
        basic("first_name").alias("first"),
        basic("middle_name").alias("middle"),
        basic("last_name").alias("last"),
        basic("name_suffix").alias("suffix"),
        basic("name_prefix").alias("honorific"),
        basic("credential").alias("credential"),
        normalize_gender(basic("sex")).alias("gender"),
        basic("sex").alias("gender_code"),
        F.substring(full, 1, 5).alias("zip"),
        full.alias("zip_full"),
        _field(place["state"]).alias("state"),
        enumerated.alias("enumeration_date"),
        F.floor(F.datediff(day, F.to_date(enumerated)) / 365.25).cast("int").alias("years_enumerated"),
        basic("last_updated").alias("last_updated"),
        day.cast("string").alias("retrieved"),
    )


def parse_licenses(df: DataFrame, text: str, validate: bool = True) -> DataFrame:
    """npi, state, license, taxonomy_code, taxonomy_desc, primary: a row for each taxonomy with a licence."""
    r = _responses(df, text, [], validate).select(F.explode("j.results").alias("r")).select(F.col("r.number").alias("n"), F.explode("r.taxonomies").alias("t"))
    return r.select(
        _field(F.col("n")).alias("npi"), _field(F.col("t.state")).alias("state"), _field(F.col("t.license")).alias("license"), _field(F.col("t.code")).alias("taxonomy_code"),
        _field(F.col("t.desc")).alias("taxonomy_desc"), F.coalesce("t.primary", F.lit(False)).alias("primary"),
    ).filter("license is not null")
