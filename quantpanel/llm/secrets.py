"""Secret scans: shapes of credentials, told apart by how many repositories and owners hold the same value (no Python workers).

1. Each text is searched for every kind of `KINDS` (leftmost, non-overlapping per kind). Where a kind occurs, the text is
   split at its matches: running sums of the parts' and the matches' lengths are the places, in code points. Values leave the
   scan as digests only.
2. Ownership: (digest, owner, repository) is made distinct, then counted by digest and owner, then by digest, each step with
   partial sums, so a value that a third of all documents hold sends a row a task and owner. A value of many owners is an
   example that was copied; one of a single owner that looks random is live.
3. Candidates join the verdict of their digest (a skewed join is split by Spark) and come together again by document.

Spans of the base kinds are always reported. Those of the other kinds are reported where the corpus says that they are live,
so long random-looking strings that many owners share (identifiers, samples of a manual) stay silent. Spans of different
kinds may overlap.

Defined cases: null and empty texts have no spans and the digest of the empty string; rows are judged each, repeated ones
too; a null owner or repository is one of its own; an empty table gives an empty result; very long texts are searched whole,
all patterns take time in proportion to the text; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, table, text_or_empty


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: Kind, pattern, group of the value, least length of the value, is in the base contract.
KINDS = [
    ("assign", rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    ("hex", r"[0-9a-f]{32,}", 0, 32, True),
    ("url", r"://[^\x00-\x20/:@]+:([^\x00-\x20/:@]+)@", 1, 6, False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\x09-\x0D\x20]+)-----END", 1, 64, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.([A-Za-z0-9_-]+)", 1, 16, False),
    ("vendor", r"(gh[pousr]_|glpat-|xox[abprs]-|sk_live_|npm_|AIza)([A-Za-z0-9_-]+)", 2, 16, False),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24, False),
]
#: What placeholders contain, in lower case.
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your[_-]|xxxx|00000000|12345678|abcdefgh"
BASE = [k for k, *_, base in KINDS if base]
SPAN = "struct<start:int,rank:int,kind:string,end:int,digest:string,random:boolean>"
CHUNK = 256


def scan(xs: Column, first: Column) -> Column:
    """Running sums of a short array, each with `first` added."""
    sums = F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.slice(sums, 2, F.size(xs))


def running(xs: Column) -> Column:
    """Running sums: of the chunks first, then inside them, as a long array would be copied for each of its elements."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    before = F.zip_with(scan(sums, F.lit(0)), sums, lambda s, x: s - x)
    return F.flatten(F.zip_with(chunks, before, scan))


def looks_random(value: Column, kind: str) -> Column:
    """Many different characters and no placeholder; strings without a context also need a digit and letters of both cases."""
    varied = (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~F.lower(value).rlike(PLACEHOLDERS)
    return varied & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") if kind == "opaque" else varied


def spans_of(text: Column, rank: int) -> Column:
    """The spans of one kind, in order."""
    kind, pattern, group, least, _ = KINDS[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    sizes = F.transform(found, lambda m: F.length(m))
    starts = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.concat(F.array(F.lit(0)), F.slice(sizes, F.lit(1), F.size(found) - 1)), lambda g, m: g + m))

    def span(start: Column, m: Column) -> Column:
        value = F.regexp_extract(m, pattern, group)
        fields = [start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), F.sha2(value, 256).alias("digest"), looks_random(value, kind).alias("random"), F.length(value).alias("size")]
        return F.struct(*fields)

    long_enough = F.filter(F.zip_with(starts, found, span), lambda s: s["size"] >= least)
    return F.when(text.rlike(pattern), F.transform(long_enough, lambda s: F.struct(*(s[c] for c in ("start", "rank", "kind", "end", "digest", "random"))))).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One written row per document: line (a number of its own), doc_id, owner, repo and spans, sorted by start, then kind."""
    text = text_or_empty(f"`{text_col}`")
    spans = F.sort_array(F.concat(*(spans_of(F.col("text"), i) for i in range(len(KINDS)))))
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{owner_col}`"].alias("owner"), docs[f"`{repo_col}`"].alias("repo"), text.alias("text"))
    return cut(rows.select("doc_id", "owner", "repo", spans.alias("spans")).withColumn("line", F.monotonically_increasing_id()))


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, n_repos, n_owners: how many repositories and owners hold a value. A repository is one of its owner's."""
    each = candidates.select("digest", "owner", "repo").distinct()
    by_owner = each.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(rows: DataFrame, copied_owners: int, copied_repos: int) -> DataFrame:
    """Every candidate of `rows` with n_repos, n_owners and verdict.

    example: held by `copied_owners` owners or more, or by more than one in `copied_repos` repositories or more;
    live: held by one owner and random-looking; unclear: all others.
    """
    candidates = rows.withColumn("s", F.explode("spans")).select("line", "doc_id", "owner", "repo", "s.*")
    example = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos))
    verdict = F.when(example, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return candidates.join(ownership(candidates), "digest").withColumn("verdict", verdict)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = 3, copied_repos: int = 20) -> DataFrame:
    """One row per candidate: doc_id, kind, start, end, digest of the value, n_repos, n_owners, verdict."""
    return judged(scanned(docs, id_col, text_col, owner_col, repo_col), copied_owners, copied_repos).select("doc_id", "kind", "start", "end", "digest", "n_repos", "n_owners", "verdict")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = 3, copied_repos: int = 20) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, all spans, verdicts (one a span), n_live, n_example."""
    rows = scanned(docs, id_col, text_col, owner_col, repo_col)
    of_doc = F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "verdict")))
    told = lambda s: s["kind"].isin(BASE) | (s["verdict"] == "live")
    found = judged(rows, copied_owners, copied_repos).groupBy("line").agg(F.first("doc_id").alias("doc_id"), of_doc.alias("spans")).withColumn("spans", F.filter("spans", told))
    # Documents without candidates go around the joins.
    none = rows.where(F.size("spans") == 0).select("doc_id", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,verdict:string>>").alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    return none.unionByName(found.drop("line")).select(
        "doc_id", *(count("kind", k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"), count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_example"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def spans_sql(rank: int) -> str:
    """Spans of one kind: the parts between matches and the matches are summed up."""
    kind, pattern, group, least, _ = KINDS[rank]
    quoted = pattern.replace("'", "''")
    varied = f"len(list_distinct(string_split(v, ''))) >= 8 AND NOT regexp_matches(lower(v), '{PLACEHOLDERS}')"
    if kind == "opaque":
        varied += " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"
    return f"""SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, stop - size AS start, stop, sha256(v) AS digest, {varied} AS random FROM (
    SELECT doc_id, owner, length(m) AS size, regexp_extract(m, '{quoted}', {group}) AS v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
      SELECT doc_id, source AS owner, unnest(regexp_extract_all(text, '{quoted}')) AS m, unnest(regexp_split_to_array(text, '{quoted}')) AS gap, unnest(range(len(regexp_split_to_array(text, '{quoted}')))) AS k
      FROM documents WHERE text IS NOT NULL) WHERE m IS NOT NULL) WHERE length(v) >= {least}"""


def list_sql(which: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE {which}), '')"


IN_BASE = "kind IN (" + ", ".join(f"'{k}'" for k in BASE) + ")"
SQL = f"""
WITH spans AS ({" UNION ALL ".join(spans_sql(i) for i in range(len(KINDS)))}),
freq AS (SELECT digest, count(DISTINCT (owner, doc_id)) AS n_repos, count(DISTINCT (owner,)) AS n_owners FROM spans GROUP BY digest),
judged AS (SELECT spans.*, CASE WHEN n_owners >= 3 OR n_owners > 1 AND n_repos >= 20 THEN 'example' WHEN n_owners = 1 AND random THEN 'live' ELSE 'unclear' END AS verdict
  FROM spans JOIN freq USING (digest)),
told AS (SELECT * FROM judged WHERE {IN_BASE} OR verdict = 'live')
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)}, sha256({list_sql(IN_BASE)}) AS base_sha256, {list_sql("kind IS NOT NULL")} AS spans,
  coalesce(string_agg(verdict, ',' ORDER BY start, rank), '') AS verdicts, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
FROM documents d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id
"""
