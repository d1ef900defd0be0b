"""Secret scans by corpus-wide ownership frequency, in DataFrame expressions alone.

Each text gives spans of four kinds. Three are patterns; the fourth, `live`,
comes from the corpus: every long token that mixes letters and digits is a
candidate, its hash is counted over distinct repositories and owners, and one
that few owners have is live-looking while one that many have is an example
that was copied around. A live-looking candidate is a span of its own wherever
no pattern covers it.

Positions come from splitting a text by the pattern: what lies between the
matches and the matches themselves, in turn, add up to every start and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: The patterns, in the order in which spans of one start are listed.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A maximal run that is too short fails as a whole, so the least length can stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "live"]
#: Candidates: long tokens with at least one letter and one digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
SPAN = "struct<start:int,stop:int,value:string>"


def matches(text: Column, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches, in code points, end exclusive,
    whose value has `least` characters or more."""
    found = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, whole: F.struct(gap.alias("gap"), whole.alias("whole"))),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)),
        lambda x, value: F.struct(x["gap"].alias("gap"), x["whole"].alias("whole"), value.alias("value")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        lo = state["at"] + F.length(x["gap"])
        hi = lo + F.coalesce(F.length(x["whole"]), F.lit(0))
        out = F.when(x["whole"].isNull() | (F.length(x["value"]) < least), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(lo.alias("start"), hi.alias("stop"), x["value"].alias("value")))))
        return F.struct(hi.alias("at"), out.alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(found, start, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def kind_spans(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("nth"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end of spans that are sorted by start, then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(documents: DataFrame, max_owners: int = 2, max_repositories: int = 4, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(id, base, spans, live, examples) of every document row.

    `base` holds the pattern spans and `spans` those and the live ones, both sorted by start, then kind, as
    struct(start, nth, kind, stop, value). `live` lists the distinct values, of base spans or
    candidates, that at most max_owners distinct owners have in at most max_repositories distinct repositories:
    what one owner has put into many is a template of theirs. `examples` lists the others. Owner and
    repository are columns of `documents`, by default its source, and its source with its language; a null one
    counts as one of its own. Null and empty texts have no spans. Rows that repeat an id are rows of their own.
    """
    found = judged_spans(documents, max_owners, max_repositories, id_col, text_col, repository, owner)
    return found.withColumnRenamed("id", id_col).drop("text_key")


def judged_spans(documents: DataFrame, max_owners: int, max_repositories: int, id_col: str, text_col: str, repository: Column | None, owner: Column | None) -> DataFrame:
    """scan, with the key of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("-")), F.coalesce(F.col("lang"), F.lit("-"))) if repository is None else repository
    found = documents.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.coalesce(repository.cast("string"), F.lit("-")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("-")).alias("owner"),
        kind_spans(matches(text, ASSIGN, 1, ASSIGN_LEAST), "assign").alias("assign"), kind_spans(matches(text, ACCESS), "access").alias("access"), kind_spans(matches(text, HEX), "hex").alias("hex"),
        kind_spans(matches(text, TOKEN), "live").alias("tokens"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    found = written(found.select("id", "text_key", "repository", "owner", base.alias("base"), "tokens"), "secret-candidates")
    values = F.array_distinct(F.transform(F.concat("base", "tokens"), lambda s: s["value"]))
    seen = found.select("id", "text_key", "repository", "owner", F.explode(values).alias("value")).withColumn("hash", F.sha2("value", 256))
    # Distinct owners of each hash first, within every task, so a value that is everywhere costs little.
    owners = seen.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = seen.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    of_hash = owners.join(repositories, "hash").select("hash", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("is_live"))
    judged = (
        seen.join(of_hash, "hash").groupBy("id", "text_key")
        .agg(F.array_sort(F.collect_set(F.when(F.col("is_live"), F.col("value")))).alias("live"), F.array_sort(F.collect_set(F.when(~F.col("is_live"), F.col("value")))).alias("examples"))
    )
    none = F.array().cast("array<string>")
    joined_rows = found.alias("f").join(judged.alias("j"), (F.col("f.id").eqNullSafe(F.col("j.id"))) & (F.col("f.text_key") == F.col("j.text_key")), "left")
    rows = joined_rows.select("f.id", "f.text_key", "base", "tokens", F.coalesce("live", none).alias("live"), F.coalesce("examples", none).alias("examples"))
    covered = lambda t: F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    added = F.filter("tokens", lambda t: F.array_contains("live", t["value"]) & ~covered(t))
    return rows.select("id", "text_key", "base", F.array_sort(F.concat("base", added)).alias("spans"), "live", "examples")


def redacted(documents: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every live-looking value replaced by `mark` wherever it stands in its text, longest
    first; widely copied examples stay. n_chars follows where the table has it. All rows are kept, those with a
    null id too, and judged each by its own text."""
    wanted = {"max_owners": 2, "max_repositories": 4, "id_col": "doc_id", "text_col": "text", "repository": None, "owner": None} | options
    id_col, text_col = wanted["id_col"], wanted["text_col"]
    found = judged_spans(documents, **wanted)
    longest_first = F.expr("array_sort(live, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")
    key, values, whose = unused(documents, "of"), unused(documents, "values"), unused(documents, "text_key")
    live = found.filter(F.size("live") > 0).select(F.col("id").alias(key), F.col("text_key").alias(whose), longest_first.alias(values)).groupBy(key, whose).agg(F.first(values).alias(values))
    text_key = F.xxhash64(F.coalesce(documents[text_col], F.lit("")))
    out = documents.join(live, documents[id_col].eqNullSafe(F.col(key)) & (text_key == F.col(whose)), "left")
    text = F.when(F.col(values).isNull(), F.col(text_col)).otherwise(F.aggregate(values, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mark))))
    changes = {text_col: text}
    if "n_chars" in documents.columns:
        changes["n_chars"] = F.when(F.col(values).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return out.withColumns(changes).select(*documents.columns)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_examples"),
    )


def _sql_spans(kind: str, pattern: str, group: int, least: int, more: str = "true") -> str:
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {KINDS.index(kind)} AS nth, '{kind}' AS kind, start, start + len(whole[i]) AS stop, val[i] AS value FROM (
  SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start FROM (
    SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS val FROM t)))
WHERE len(val[i]) >= {least} AND {more}"""


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '-') AS owner, coalesce(source, '-') || '/' || coalesce(lang, '-') AS repository FROM documents),
base AS ({_sql_spans("assign", ASSIGN, 1, ASSIGN_LEAST)} UNION ALL {_sql_spans("access", ACCESS, 0, 18)} UNION ALL {_sql_spans("hex", HEX, 0, 16)}),
tokens AS ({_sql_spans("live", "[A-Za-z0-9+/_=-]{20,}", 0, 20, "regexp_matches(val[i], '[0-9]') AND regexp_matches(val[i], '[A-Za-z]')")}),
seen AS (SELECT DISTINCT doc_id, value FROM (SELECT doc_id, value FROM base UNION ALL SELECT doc_id, value FROM tokens)),
judged AS (SELECT value, count(DISTINCT owner) <= 2 AND count(DISTINCT repository) <= 4 AS is_live FROM seen JOIN t USING (doc_id) GROUP BY value),
counts AS (SELECT doc_id, count(*) FILTER (is_live) AS n_live, count(*) FILTER (NOT is_live) AS n_examples FROM seen JOIN judged USING (value) GROUP BY doc_id),
added AS (
  SELECT k.* FROM tokens k JOIN judged USING (value) WHERE is_live
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = k.doc_id AND b.start < k.stop AND k.start < b.stop)
),
listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(l.spans, '')) AS base_sha256,
  coalesce(e.spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM t LEFT JOIN listed l USING (doc_id) LEFT JOIN every e USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
