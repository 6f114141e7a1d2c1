"""Secret scans with corpus-wide ownership frequency (DataFrame operations only).

Candidates are credential-like strings. The hash of each candidate's value is counted over the whole corpus by
distinct repositories and by distinct owners; a repository is a document, unless a column names it, so exact
copies count each. A value that reaches both ``example_owners`` and ``example_repositories`` is an example that was widely
copied, be it in one text or in many. All others are specific to their owners: those in a few owners, and those in any number of texts
of one owner; they look live if their shape is that of a credential too (``credential_like``). The scan keeps every base
match and adds, for each value that looks live, a span of kind ``live`` that covers the value itself.

Without limits in the call, the limit of owners follows from the table (``owner_limit``), and that of repositories is the same.

Defined results: null text is empty; a null owner or repository counts as one value of its own; texts without
candidates give no spans; repeated rows are scanned each for itself and count once for their owner; an empty
table gives an empty result. Columns other than those named in the call are carried by nobody and cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import stored
from terrafold.llm.textcols import text_of

#: Kind, pattern, group that holds the value, least length of that group. Order breaks ties between equal starts.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A text without a match of this has no base match of the kind; it is only a cheaper first look.
FIRST_LOOK = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: Runs shorter than the least length can't hold a match, and maximal runs don't overlap, so the search may skip them.
SEARCH = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}

#: A value is widely copied from a quarter of the table's owners on, at least 3 and at most 10. A credential and its forks and
#: mirrors have an owner or two, hence 3; in a large corpus ten that share one value by accident are not to be expected, hence
#: 10; the quarter is for tables of few owners, where 3 is soon reached. The numbers are set by this argument, not on given tables.
LEAST_OWNERS, MOST_OWNERS, OWNERS_PART = 3, 10, 4

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value_start:int,value:string>>"
#: Running sums and cuts go by blocks of so many spans, so that a text with very many of them takes little more than linear time.
BLOCK = 128
#: A value with one of these is a placeholder, whoever has it.
PLACEHOLDER = "(?i)example|changeme|placeholder|dummy|sample|your_|xxxx"
#: So is one of fewer bits a character than random digits of base 16 have at 16 characters, but for some in a thousand.
LEAST_BITS = 2.3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(items, at + 1, BLOCK))


def _running(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima, as ``step`` says) of an array of int: within each block, and over the blocks before."""
    total = lambda items: F.aggregate(items, F.lit(0), step)
    return _let(numbers, lambda all_: _let(_blocks(all_), lambda blocks: _let(F.transform(blocks, total), lambda totals: F.flatten(F.transform(
        blocks, lambda block, b: _let(total(F.slice(totals, 1, b)), lambda before: F.transform(
            block, lambda _, i: step(before, total(F.slice(block, 1, i + 1))))))))))


def _matches(text: Column, rank: int) -> Column:
    """Spans of one kind. The pieces between matches give the positions, in code points."""
    kind, pattern, group, least = KINDS[rank]
    pattern = SEARCH.get(kind, pattern)
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
                     F.split(text, pattern, -1).alias("gaps"))

    def spans(m: Column) -> Column:
        steps = F.zip_with(m["whole"], m["gaps"], lambda whole, gap: F.coalesce(F.length(whole) + F.length(gap), F.lit(0)))
        return _let(_running(steps, lambda x, y: x + y), lambda ends: F.filter(F.transform(m["whole"], lambda whole, i: F.struct(
            (F.get(ends, i) - F.length(whole)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"),
            (F.get(ends, i) - F.length(F.get(m["value"], i))).alias("value_start"), F.get(m["value"], i).alias("value"))), lambda s: F.length(s["value"]) >= least)).cast(SPAN)

    return F.when(text.rlike(FIRST_LOOK[kind]) & text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    return F.array_sort(F.concat(*[_matches(text, rank) for rank in range(len(KINDS))]))


def credential_like(value: Column) -> Column:
    """Whether a value may be a credential by its shape: it has the variety of random characters (``LEAST_BITS``), most of
    its characters do not repeat or follow the one before (aaaa, abcd, 4321), and it has no word of a placeholder."""
    def varied(chars: Column) -> Column:
        share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
        bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
        codes = F.transform(chars, F.ascii)
        steps = F.zip_with(codes, F.slice(codes, 2, F.length(value)), lambda a, b: F.coalesce(F.abs(a - b) <= 1, F.lit(False)))
        return (bits >= LEAST_BITS) & (2 * F.size(F.filter(steps, lambda x: x)) <= F.length(value) - 1)

    return ~value.rlike(PLACEHOLDER) & _let(F.split(value, ""), varied)


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, n_repositories, n_owners, n_uses`` of candidate values; ``found`` has value_hash, repository, owner.

    The distinct steps aggregate before each shuffle, so a value copied into a third of all rows arrives as one
    row a task.
    """
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("key")) for side in ("repository", "owner")])
    uses = found.select("value_hash", F.inline(sides)).groupBy("value_hash", "side", "key").agg(F.count(F.lit(1)).alias("n_uses"))
    return uses.groupBy("value_hash").agg(
        F.count_if(F.col("side") == "repository").alias("n_repositories"), F.count_if(F.col("side") == "owner").alias("n_owners"),
        F.sum(F.when(F.col("side") == "owner", F.col("n_uses"))).alias("n_uses"))


def owner_limit(table_owners: Column) -> Column:
    """Owners from which a value is widely copied, in a table of so many owners."""
    return F.least(F.greatest(F.ceil(table_owners / OWNERS_PART), F.lit(LEAST_OWNERS)), F.lit(MOST_OWNERS))


def specific_values(found: DataFrame, owners: DataFrame, example_owners: int | None, example_repositories: int | None) -> DataFrame:
    """``value_hash, n_owners, n_repositories`` of the values that no wide copying explains; ``owners`` has the owner of every row of the table."""
    counted = ownership(found)
    if example_owners is None:
        every = owners.agg(owner_limit(F.count_distinct("owner")).alias("limit"))  # one row
        counted = counted.crossJoin(F.broadcast(every))
    else:
        counted = counted.withColumn("limit", F.lit(example_owners))
    least = F.col("limit") if example_repositories is None else F.lit(example_repositories)
    return counted.where((F.col("n_owners") < F.col("limit")) | (F.col("n_repositories") < least)).select("value_hash", "n_owners", "n_repositories")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None,
         example_owners: int | None = None, example_repositories: int | None = None) -> DataFrame:
    """``row_id, id, base, live`` for every row: the base spans, and those of values that look live.

    Texts are read once: the narrow table of spans is written to the shared folder, and only it is joined.
    """
    def distinct(col: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))

    narrow = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), distinct(owner_col).alias("owner"),
            distinct(repository_col or id_col).alias("repository"), candidates(text_of(text_col)).alias("base"),
        ).select(
            "row_id", "id", "owner", "repository",
            F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"], s["value_start"], F.sha2(s["value"], 256).alias("value_hash"), credential_like(s["value"]).alias("shaped"))).alias("base"),
        ),
        "secret-spans",
    )
    found = narrow.where(F.size("base") > 0).select("row_id", "owner", "repository", F.explode("base").alias("span")).select(
        "row_id", "owner", "repository", "span", F.col("span.value_hash").alias("value_hash"))
    few = specific_values(found, narrow.select("owner"), example_owners, example_repositories)
    live = found.where("span.shaped").join(few, "value_hash").groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("span.value_start", "span.end", "span.kind", "n_owners", "n_repositories"))).alias("live"))
    nothing = F.array().cast("array<struct<value_start:int,end:int,kind:string,n_owners:bigint,n_repositories:bigint>>")
    return narrow.join(live, "row_id", "left").select("row_id", "id", "base", F.coalesce("live", nothing).alias("live"))


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each of the sorted spans (value_start, end) replaced by ``mark``; of overlapping ones the first counts.

    Each block of spans works on its own piece of the text, so no position is counted from the start of a long text.
    """
    def pieces(apart: Column) -> Column:
        def piece(block: Column, b: Column) -> Column:
            begin = F.when(b == 0, F.lit(0)).otherwise(F.get(apart, b * BLOCK - 1)["end"])
            end = F.element_at(block, -1)["end"]
            return _let(F.struct(begin.alias("at"), F.substring(text, begin + 1, end - begin).alias("own")), lambda part: F.array_join(F.transform(block, lambda s, i: _let(
                F.when(i == 0, part["at"]).otherwise(F.get(block, i - 1)["end"]), lambda last: F.concat(F.substring(part["own"], last - part["at"] + 1, s["value_start"] - last), F.lit(mark)))), ""))

        rest = F.substring(text, F.element_at(apart, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(_blocks(apart), piece), ""), rest)

    def first_of_overlapping(all_: Column) -> Column:
        ends = _running(F.transform(all_, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        return _let(ends, lambda e: F.filter(all_, lambda s, i: (i == 0) | (s["value_start"] >= F.get(e, i - 1))))

    return _let(first_of_overlapping(spans), pieces)


def redact(docs: DataFrame, mark: str = "<secret>", example_owners: int | None = None, example_repositories: int | None = None) -> DataFrame:
    """Documents with every live value replaced by ``mark``; n_chars follows the new text. Columns stay as they are."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # The spans are found again on the rows themselves, so that no text is joined: only narrow value hashes are.
    spans = numbered.withColumn("base", F.transform(candidates(text_of(F.col("doc.text"))), lambda s: F.struct(
        s["value_start"].alias("value_start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash"), credential_like(s["value"]).alias("shaped"))))
    spans = stored(spans.withColumn("row_id", F.monotonically_increasing_id()), "redact-spans")
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"doc.{c}").cast("string")), F.lit("null"))
    found = spans.where(F.size("base") > 0).select("row_id", told("source").alias("owner"), told("doc_id").alias("repository"), F.explode("base").alias("span"))
    found = found.select("row_id", "owner", "repository", "span", F.col("span.value_hash").alias("value_hash"))
    few = specific_values(found, spans.select(told("source").alias("owner")), example_owners, example_repositories).select("value_hash")
    live = found.where("span.shaped").join(few, "value_hash").groupBy("row_id").agg(
        F.array_sort(F.collect_set(F.struct("span.value_start", "span.end"))).alias("live"))
    text = F.col("doc.text")
    out = spans.join(live, "row_id", "left").withColumn("hidden", F.when(F.col("live").isNull(), text).otherwise(_cut(text, F.col("live"), mark)))
    return out.select(*[
        F.col("hidden").alias(c) if c == "text" else F.length("hidden").cast("long").alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c)
        for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    part = "struct<start:int,rank:int,kind:string,end:int>"
    base = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]).cast(part))
    added = F.transform("live", lambda s: F.struct(s["value_start"], F.lit(len(KINDS)), F.lit("live"), s["end"]).cast(part))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(base, added))).alias("spans"))


def _sql_spans(rank: int) -> str:
    kind, pattern, group, least = KINDS[rank]
    pattern = pattern.replace("'", "''")
    return rf"""SELECT doc_id, source, text, {rank} AS rank, '{kind}' AS kind, {least} AS least, unnest(range(len(whole))) AS i, unnest(whole) AS whole, unnest(value) AS value, unnest(gaps[:len(whole)]) AS gap
    FROM (SELECT *, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value, string_split_regex(text, '{pattern}') AS gaps FROM d)"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(_sql_spans(rank) for rank in range(len(KINDS)))}),
placed AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS "end" FROM matches),
spans AS (SELECT doc_id, source, text, rank, kind, "end" - length(whole) AS start, "end", "end" - length(value) AS value_start, value FROM placed WHERE length(value) >= least),
told_owners AS (SELECT least(greatest(ceil(count(DISTINCT coalesce('=' || source, 'null')) / {OWNERS_PART}), {LEAST_OWNERS}), {MOST_OWNERS}) AS least_owners FROM d),
uses AS (SELECT value, count(DISTINCT coalesce('=' || source, 'null')) AS n_owners, count(DISTINCT coalesce('=' || doc_id, 'null')) AS n_repositories FROM spans GROUP BY value),
shapes AS (SELECT value, string_split(value, '') AS chars FROM (SELECT DISTINCT value FROM spans)),
varied AS (SELECT value, list_sum(list_transform(list_distinct(chars), lambda c: -(length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) AS bits,
  len(list_filter(range(1, length(value)), lambda i: abs(ord(chars[i]) - ord(chars[i + 1])) <= 1)) AS steps FROM shapes),
live AS (SELECT doc_id, value_start AS start, {len(KINDS)} AS rank, 'live' AS kind, "end" FROM spans JOIN uses USING (value) JOIN varied USING (value), told_owners
  WHERE (n_owners < least_owners OR n_repositories < least_owners) AND NOT regexp_matches(value, '{PLACEHOLDER}') AND bits >= {LEAST_BITS} AND 2 * steps <= length(value) - 1),
every_span AS (SELECT doc_id, start, rank, kind, "end" FROM spans UNION ALL SELECT * FROM live),
told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank) FILTER (kind <> 'live') AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, rank, "end") AS spans FROM every_span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON d.doc_id = told.doc_id"""
