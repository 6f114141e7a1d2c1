"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences (DataFrame operations only).

Empty lines part sections, line ends part paragraphs, and a paragraph's leaves are its sentences. A node's hash is the
SHA-256 of its children's hashes, so equal roots mean equal texts. The fingerprint keeps the root in full and the first
16 hexadecimal digits of every other node:

    root/section:paragraph=leaf.leaf,paragraph=leaf;section:paragraph=leaf

Every separator of the text stays in the leaf before it, so the leaves together are the text.

Two trees are compared from the root down: equal roots end it, sections that the other tree has are settled as they
are, and only the paragraphs of the other sections, and then the leaves of the other paragraphs, are looked at.
``likeness`` counts the leaves that are settled on the way, ``differing`` tells the paths of those that are not.

Defined results: null text is empty; the empty text has one empty leaf; two equal fingerprints have likeness 1, and
unequal ones less; branches that a tree has several times count once; a null fingerprint has null likeness; repeated rows
have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.shared import stored
from terrafold.llm.textcols import text_of

SECTION = r"(?<=\n\n)(?!\n)"
PARAGRAPH = r"(?<=\n)(?!\n)"
SENTENCE = r"(?<=[.!?;,:] )"
DIGITS = 16
PATHS = "array<struct<section:int,paragraph:int,leaf:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _node(children: Column, mark: str) -> Column:
    """Hash and text form of a node from those of its children."""
    return F.struct(F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256).alias("hash"),
                    F.array_join(F.transform(children, lambda c: c["told"]), mark).alias("told"))


def _labelled(node: Column, mark: str) -> Column:
    return F.struct(node["hash"].alias("hash"), F.concat(F.substring(node["hash"], 1, DIGITS), F.lit(mark), node["told"]).alias("told"))


def fingerprint(text: Column) -> Column:
    def leaf(part: Column) -> Column:
        return _let(F.sha2(part, 256), lambda h: F.struct(h.alias("hash"), F.substring(h, 1, DIGITS).alias("told")))

    def paragraph(part: Column) -> Column:
        return _let(F.transform(F.split(part, SENTENCE, -1), leaf), lambda leaves: _let(_node(leaves, "."), lambda node: _labelled(node, "=")))

    def section(part: Column) -> Column:
        return _let(F.transform(F.split(part, PARAGRAPH, -1), paragraph), lambda paragraphs: _let(_node(paragraphs, ","), lambda node: _labelled(node, ":")))

    return _let(F.transform(F.split(text, SECTION, -1), section), lambda sections: _let(_node(sections, ";"), lambda node: F.concat(node["hash"], F.lit("/"), node["told"])))


def root(mark: Column) -> Column:
    return F.substring_index(mark, "/", 1)


def sections(mark: Column) -> Column:
    return F.split(F.substring_index(mark, "/", -1), ";")


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring_index(section, ":", -1), ",")


def _leaves(paragraph: Column) -> Column:
    return F.split(F.substring_index(paragraph, "=", -1), r"\.")


def _n_leaves(nodes: Column) -> Column:
    """Number of leaves of sections or paragraphs: their separators, and one each."""
    return F.aggregate(nodes, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.translate(x, ",.", "")) + 1)


def likeness(a: Column, b: Column) -> Column:
    """Leaves settled from the root down over all leaves looked at and the root, 1 for equal roots, 0 where nothing is shared."""
    def level(x: Column, y: Column, settled: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), settled.alias("settled"))

    def descend(at: Column, children: Callable[[Column], Column]) -> Column:
        """Count what both trees have at a level, and go down in what only one of them has."""
        return _let(F.array_intersect(at["x"], at["y"]), lambda both: level(
            F.flatten(F.transform(F.array_except(at["x"], both), children)), F.flatten(F.transform(F.array_except(at["y"], both), children)), at["settled"] + _n_leaves(both)))

    def over_leaves(at: Column) -> Column:
        return _let(F.array_intersect(at["x"], at["y"]), lambda both: _let(at["settled"] + F.size(both), lambda settled: (
            settled / (settled + F.size(F.array_except(at["x"], both)) + F.size(F.array_except(at["y"], both)) + 1))))

    found = _let(level(sections(a), sections(b), F.lit(0)), lambda top: _let(descend(top, _paragraphs), lambda middle: _let(descend(middle, _leaves), over_leaves)))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(found)


def differing(a: Column, b: Column) -> Column:
    """Paths (section, paragraph, leaf; from 0) of the leaves of ``b`` that no branch of ``a`` settles: what an edit
    from a to b put in. The other way round it tells what the edit took out."""
    empty = F.array().cast(PATHS)

    def only(nodes: Column, others: Column, branch: Callable[[Column, Column], Column]) -> Column:
        """``branch`` of the nodes (and their places) that the others lack."""
        return _let(F.array_except(nodes, others), lambda new: F.flatten(F.transform(nodes, lambda x, i: F.when(F.array_contains(new, x), branch(x, i)).otherwise(empty))))

    def of_section(section: Column, s: Column, own: Column) -> Column:
        return only(_paragraphs(section), own, lambda paragraph, p: _let(
            F.flatten(F.transform(F.array_except(own, F.array(paragraph)), _leaves)), lambda leaves: only(_leaves(paragraph), leaves, lambda _, i: F.array(
                F.struct(s.alias("section"), p.alias("paragraph"), i.alias("leaf"))).cast(PATHS))))

    found = _let(sections(a), lambda x: _let(sections(b), lambda y: _let(
        F.flatten(F.transform(F.array_except(x, y), _paragraphs)), lambda own: only(y, x, lambda section, s: of_section(section, s, own)))))
    return F.when(root(a) == root(b), empty).otherwise(found)


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 512) -> DataFrame:
    """``id, text, next_text``: the next row in ascending order of id, after the last the first.

    Ids are cut into ranges at approximate quantiles, each range is sorted for itself, and the first row of a range
    follows the last of the range before. Equal ids go by a hash of their text; null ids come first, spread over
    ranges by that hash.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    n = docs.count()
    pieces = int(max(1, min(32768, n // rows_per_range)))
    marks = [x / pieces for x in range(1, pieces)]
    cuts = (docs.where(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, marks, 10 * pieces)).first()[0] or []) if marks else []
    cuts = sorted(set(cuts))
    at = F.when(F.col("id").isNull(), F.shiftright(F.xxhash64("text"), 56).cast("int") - 200)
    if cuts:
        # Two levels of comparisons find the range: among every 64th cut, then among the 64 that follow.
        outer, inner = cuts[::64], [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
        block = F.size(F.filter(F.lit(outer), lambda c: c <= F.col("id")))
        block_cuts = F.get(F.array(*[F.lit(c) for c in inner]), block - 1)
        within = F.when(block == 0, F.lit(0)).otherwise((block - 1) * 64 + F.size(F.filter(block_cuts, lambda c: c <= F.col("id"))))
        at = F.coalesce(at, within)
    rows = rows.withColumn("range", F.coalesce(at, F.lit(0)).cast("int")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    own = Window.partitionBy("range").orderBy(*order)
    inside = rows.withColumn("follows", F.lead("text").over(own))
    # One row a range: which range follows, and the text of that range's first row.
    firsts = stored(rows.groupBy("range").agg(F.min_by("text", F.struct(F.col("id").isNotNull(), "id", "tie")).alias("head")), "range-firsts")
    every = sorted(r[0] for r in firsts.select("range").collect())
    if not every:
        return inside.select("id", "text", F.lit(None).cast("string").alias("next_text"))
    after = spark.createDataFrame([(a, b) for a, b in zip(every, every[1:] + every[:1])], "range int, next_range int")
    heads = firsts.withColumnRenamed("range", "next_range").join(F.broadcast(after), "next_range").select("range", "head")
    return inside.join(heads, "range").select("id", "text", F.coalesce("follows", "head").alias("next_text"))


def edited(text: Column, follows: Column) -> Column:
    """The last half of the code points, rounded down, replaced by the first as many of ``follows``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(follows, F.lit(1), half))


def op5_merkle(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    marked = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_mark"))
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_mark")).alias("near_next"))


LINES, EMPTY_LINES = r"(\n+)", r"(\n\n+)"


def _sql_fingerprint(text: str) -> str:
    """The fingerprint in SQL. A private character parts what the patterns part; texts with that character are not for it."""
    split = lambda x, pattern: f"string_split(regexp_replace({x}, '{pattern}', concat('\\1', chr(57345)), 'g'), chr(57345))"
    node = lambda kids, mark: f"{{'hash': sha256(array_to_string(list_transform({kids}, lambda c: c.hash), '')), 'told': array_to_string(list_transform({kids}, lambda c: c.told), '{mark}')}}"
    named = lambda mark: f"lambda nd: {{'hash': nd.hash, 'told': left(nd.hash, {DIGITS}) || '{mark}' || nd.told}}"
    leaf = f"lambda l: {{'hash': sha256(l), 'told': left(sha256(l), {DIGITS})}}"
    paragraphs = f"lambda p: list_transform(list_transform([list_transform({split('p', '([.!?;,:] )')}, {leaf})], lambda k: {node('k', '.')}), {named('=')})[1]"
    sections_ = f"lambda s: list_transform(list_transform([list_transform({split('s', LINES)}, {paragraphs})], lambda k: {node('k', ',')}), {named(':')})[1]"
    return f"list_transform(list_transform([list_transform({split(text, EMPTY_LINES)}, {sections_})], lambda k: {node('k', ';')}), lambda nd: nd.hash || '/' || nd.told)[1]"


def _sql_likeness(a: str, b: str) -> str:
    """The same descent over the fingerprints, one level of lists at a time."""
    both = lambda x, y: f"list_intersect({x}, {y})"
    rest = lambda x, y: f"list_filter(list_distinct({x}), lambda i: NOT list_contains({y}, i))"
    count = lambda x: f"coalesce(list_sum(list_transform({x}, lambda i: length(i) - length(translate(i, ',.', '')) + 1)), 0)"
    under = lambda x, head, mark: f"flatten(list_transform({x}, lambda i: string_split(split_part(i, '{head}', 2), '{mark}')))"
    x, y = (f"string_split(split_part({m}, '/', 2), ';')" for m in (a, b))
    levels = f"[{{'x': {x}, 'y': {y}, 'n': 0::HUGEINT}}]"
    for head, mark in ((":", ","), ("=", ".")):
        levels = f"list_transform({levels}, lambda l: {{'x': {under(rest('l.x', 'l.y'), head, mark)}, 'y': {under(rest('l.y', 'l.x'), head, mark)}, 'n': l.n + {count(both('l.x', 'l.y'))}}})"
    last = f"list_transform({levels}, lambda l: {{'n': l.n + len({both('l.x', 'l.y')}), 'd': len({rest('l.x', 'l.y')}) + len({rest('l.y', 'l.x')})}})"
    return f"CASE WHEN split_part({a}, '/', 1) = split_part({b}, '/', 1) THEN 1.0 ELSE list_transform({last}, lambda l: l.n::DOUBLE / (l.n + l.d + 1))[1] END"


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM p),
f AS (SELECT doc_id, n, edited, {_sql_fingerprint('text')} AS f, {_sql_fingerprint('edited')} AS g, {_sql_fingerprint('next_text')} AS h FROM e)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint, {_sql_likeness('f', 'g')} AS near_edited, {_sql_likeness('f', 'h')} AS near_next FROM f"""
