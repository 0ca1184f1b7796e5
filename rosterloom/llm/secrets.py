"""Secret scan with corpus-wide ownership frequency.

Three patterns (assigned values, access keys, long hex runs) give the candidate spans of each text. The candidates' hashes
are then counted over the whole corpus by distinct owner and by distinct repository, and every candidate gets one verdict:
a value that ``wide_owners`` owners or ``wide_repos`` repositories have is a widely copied example (``copied``); of the
others, one that a single owner has is a live-looking credential (``live``), or a placeholder if it looks like one
(``dummy``), and one that few owners have is ``shared``. Verdicts are added to a document's spans with the bounds of the
value.

Only built-in functions. Texts are read once; each pattern's matches and the pieces between them are arrays that a
generator holds fast, so nothing scans a text again, and start positions are running sums over chunks of matches: the work
is in proportion to a text's length and matches. What texts hold is kept as a slim table. Frequencies are aggregated in
steps (hash, owner and repository; hash and owner; hash), each with a map-side part, so a value in a third of all rows
shrinks before each shuffle; its join back is a plain equi-join that adaptive execution can split.

Defined results: a null text counts as empty; a document without candidates has empty lists; repeated rows are reported
each and count once for a repository; a null owner or repository is one of its own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common

# The kinds in order, with pattern, the group that holds the value, and least length of that group.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = ("live", "copied", "shared", "dummy")
PLACEHOLDER = r"(?i)example|placeholder|changeme|change_me|your[_-]|dummy|sample|xxxx|0000000|1234567"
WIDE_OWNERS, WIDE_REPOS = 3, 4
#: Matches whose starts are summed in one go.
CHUNK = 256


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once: Spark moves no expression across a generator."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return rows.select("*", F.explode(made).alias("held")).select(*rows.columns, "held.*")


def _spans(rows: DataFrame) -> DataFrame:
    """``rows`` with a column for each kind instead of ``text``: array<struct<start, rank, end, value>> of the matches whose group is long enough."""
    kept = [c for c in rows.columns if c != "text"]
    names = [k for k, *_ in KINDS]
    matches = {}
    for kind, pattern, group, _ in KINDS:
        matches |= {f"whole_{kind}": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), f"between_{kind}": F.split("text", pattern, -1)}
        matches |= {f"inner_{kind}": F.regexp_extract_all("text", F.lit(pattern), F.lit(group))} if group else {}
    rows = _held(rows, **matches).drop("text")

    def steps(kind: str, group: int) -> Column:
        value = lambda m, i: F.get(f"inner_{kind}", i) if group else m
        return F.transform(f"whole_{kind}", lambda m, i: F.struct(F.length(F.get(f"between_{kind}", i)).alias("gap"), F.length(m).alias("size"), value(m, i).alias("value")))

    rows = _held(rows, **{f"step_{k}": steps(k, group) for k, _, group, _ in KINDS}).select(*kept, *[f"step_{k}" for k in names])

    def chunks(step: str) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / CHUNK).cast("int")), lambda c: F.slice(step, c * CHUNK + 1, CHUNK))
        return F.when(F.size(step) > 0, cut).otherwise(F.array().cast("array<array<struct<gap:int,size:int,value:string>>>"))

    rows = _held(rows, **{f"chunks_{k}": chunks(f"step_{k}") for k in names}).drop(*[f"step_{k}" for k in names])
    sums = lambda of: F.transform(of, lambda c: F.aggregate(c, F.lit(0), lambda at, m: at + m["gap"] + m["size"]))
    rows = _held(rows, **{f"sums_{k}": sums(f"chunks_{k}") for k in names})
    running = lambda of: F.aggregate(of, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    rows = _held(rows, **{f"starts_{k}": running(f"sums_{k}") for k in names}).drop(*[f"sums_{k}" for k in names])
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")

    def found(kind: str, rank: int, least: int) -> Column:
        def add(state: Column, m: Column) -> Column:
            start = state["at"] + m["gap"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + m["size"]).alias("end"), m["value"].alias("value"))
            return F.struct((start + m["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        of_chunk = lambda c, i: F.aggregate(c, F.struct(F.get(f"starts_{kind}", i).alias("at"), empty.alias("out")), add, lambda s: s["out"])
        return F.filter(F.flatten(F.transform(f"chunks_{kind}", of_chunk)), lambda s: F.length(s["value"]) >= least)

    return rows.select(*kept, *[found(k, i, least).alias(k) for i, (k, _, _, least) in enumerate(KINDS)])


def candidates(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """row, doc_id, repo, owner, base: the candidate spans of each row in order of start, then kind."""
    rows = docs.select("doc_id", repo.alias("repo"), owner.alias("owner"), common.text_or_empty().alias("text"))
    return _spans(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", F.array_sort(F.concat(*[k for k, *_ in KINDS])).alias("base"))


def _text_of(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, repo: Column | None = None, owner: Column | None = None, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans, and a count for each verdict.

    repo, owner: columns of ``docs``; by default source with language, and source.
    wide_owners, wide_repos: from so many distinct owners or repositories on, a value is a copied example.
    """
    base = common.keep(candidates(docs, F.concat_ws("/", "source", "lang") if repo is None else repo, F.col("source") if owner is None else owner), "secret-candidates")
    each = base.select("row", "repo", "owner", F.explode("base").alias("s")).withColumn("hash", F.unhex(F.md5("s.value")))
    spread = (
        each.groupBy("hash", "owner", "repo").agg(F.first("s.value").alias("value"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.first("value").alias("value"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.first("value").alias("value"))
    )
    varied = F.size(F.array_distinct(F.split("value", ""))) >= 8
    rank = {name: F.lit(len(KINDS) + i) for i, name in enumerate(ADDED)}
    wide = (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)
    verdict = F.when(wide, rank["copied"]).when(F.col("owners") > 1, rank["shared"]).when(varied & ~F.col("value").rlike(PLACEHOLDER), rank["live"]).otherwise(rank["dummy"])
    judged = each.join(spread.select("hash", verdict.alias("rank")), "hash")
    start = F.when(F.col("s.rank") == 0, F.col("s.end") - F.length("s.value")).otherwise(F.col("s.start"))
    span = F.struct(start.alias("start"), F.col("rank"), F.col("s.end").alias("end"), F.lit("").alias("value"))
    added = judged.groupBy("row").agg(F.collect_set(span).alias("added"))
    count = lambda r, of: F.size(F.filter(of, lambda s: s["rank"] == r)).cast("long")
    both = base.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(base.schema["base"].dataType)))
    kinds = tuple(k for k, *_ in KINDS)
    return both.select(
        "doc_id",
        *[count(i, F.col("base")).alias(f"n_{k}") for i, k in enumerate(kinds)],
        F.sha2(_text_of(F.col("base"), kinds), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "added")), kinds + ADDED).alias("spans"),
        *[count(len(KINDS) + i, F.col("added")).alias(f"n_{k}") for i, k in enumerate(ADDED)],
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))


def _sql_kind(i: int) -> str:
    name, pattern, group, least = KINDS[i]
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, r.i AS n, {i} AS rank, '{name}' AS kind,
       list_sum(list_transform(p[1:r.i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:r.i - 1], lambda x: length(x))), 0) AS start,
       list_sum(list_transform(p[1:r.i], lambda x: length(x))) + list_sum(list_transform(m[1:r.i], lambda x: length(x))) AS stop, v[r.i] AS value
FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS v FROM docs),
     LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) r
WHERE length(v[r.i]) >= {least}"""


OP1_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(map(_sql_kind, range(len(KINDS))))}),
owned AS (SELECT b.*, d.source, d.lang FROM base b JOIN documents d USING (doc_id)),
spread AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT coalesce(source, chr(1)) || chr(2) || concat_ws('/', source, lang)) AS repos FROM owned GROUP BY value),
verdicts AS (
  SELECT value, CASE WHEN owners >= {WIDE_OWNERS} OR repos >= {WIDE_REPOS} THEN 'copied' WHEN owners > 1 THEN 'shared'
         WHEN len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '{PLACEHOLDER}') THEN 'live' ELSE 'dummy' END AS verdict FROM spread
),
judged AS (
  SELECT b.doc_id, CASE WHEN rank = 0 THEN stop - length(value) ELSE start END AS start, stop, 2 + list_position({list(ADDED)}, verdict) AS rank, verdict AS kind FROM base b JOIN verdicts USING (value)
),
added AS (SELECT DISTINCT * FROM judged),
every AS (SELECT doc_id, start, rank, stop, kind FROM base UNION ALL SELECT doc_id, start, rank, stop, kind FROM added),
per AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, {", ".join(f"count(*) FILTER (rank = {3 + i}) AS n_{k}" for i, k in enumerate(ADDED))},
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ADDED)}
FROM docs d LEFT JOIN per USING (doc_id)
"""
