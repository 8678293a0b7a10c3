"""Line deduplication by a log-template tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import scratch, stash
from leadwave.llm.mixing import WORD
from leadwave.session import BROADCAST_MAX_BYTES, broadcast_if_small

DEPTH = 3
MIN_DOCS = 10
CONSTANT = 0.6
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    """Words of a line, which has no line feed: other white space becomes a space, and empty parts go."""
    spaced = F.when(line.rlike(r"[\t\x0B\f\r]"), F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(row, line_no, leaf, tokens, own) of all lines with words. Tokens with a digit are fields from the start; `own` is a hash
    of the tokens as they stand in the line. The leaf takes the leading tokens alone, so who asks for leaves only masks no others."""
    split = docs.select("row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    raw = split.select("row", "line_no", F.col("line").rlike("[0-9]").alias("digits"), _tokens(F.col("line")).alias("raw"))
    tokens = F.when(F.col("digits"), _masked(F.col("raw"))).otherwise(F.col("raw"))
    leaf = F.xxhash64(F.size("raw"), _masked(F.slice("raw", 1, depth)))
    return raw.select("row", "line_no", leaf.alias("leaf"), tokens.alias("tokens"), F.xxhash64("raw").alias("own"))


def _in_many(rows: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Keys that occur in at least `min_docs` rows of documents; repeats inside one count once, and partial counts are summed."""
    return rows.select(*keys, "row").distinct().groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select(*keys)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """(row, dropped): for each row of (row, text) that has any, the numbers of the lines whose template recurs in `min_docs` rows.

    The tree has a fixed depth: the number of tokens, then the leading `depth` tokens, lead a line to its leaf. In a leaf a
    token stands in the template if `min_docs` documents have it at its place; others are variable fields. A template of which less than `constant`
    would stand generalises too much, and the line keeps its own tokens, those with digits unmasked. A template lies in one leaf, so lines of leaves
    that fewer documents reach cannot recur and are left out before tokens are spread. Everything is counts by key: no
    leaf is gathered, however many lines reach it.
    """
    common = broadcast_if_small(stash(_in_many(_lines(docs, depth).select("row", "leaf"), ["leaf"], min_docs), "leaves"))
    lines = stash(_lines(docs, depth).join(common, "leaf"), "lines")
    places = lines.select("row", "line_no", "leaf", "own", F.posexplode("tokens").alias("place", "token"))
    standing = broadcast_if_small(stash(_in_many(places, ["leaf", "place", "token"], min_docs), "standing")).withColumn("stands", F.lit(True))
    marked = places.join(standing, ["leaf", "place", "token"], "left")
    tokens = F.array_sort(F.collect_set(F.struct("place", "token", F.coalesce("stands", F.lit(False)).alias("stands"))))
    built = marked.groupBy("row", "line_no", "leaf", "own").agg(tokens.alias("tokens"))
    fixed = F.size(F.filter("tokens", lambda t: t["stands"] & (t["token"] != FIELD)))
    general = F.transform("tokens", lambda t: F.when(t["stands"], t["token"]).otherwise(F.lit(FIELD)))
    # Own tokens never equal a template of another line: where a template's tokens stand, so do those of the line that has them.
    template = F.when(fixed >= constant * F.size("tokens"), F.xxhash64("leaf", general)).otherwise(F.xxhash64("leaf", "own"))
    templates = stash(built.select("row", "line_no", template.alias("template")), "templates")
    recurring = broadcast_if_small(stash(_in_many(templates, ["template"], min_docs), "recurring"))
    return templates.join(recurring, "template").groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def _kept(lines: Column, dropped: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(dropped, i), F.lit(False))), "\n")


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """`docs` with their texts less the recurring lines, and `n_lines` and `n_dropped`; columns of these names are replaced.

    Lines are what line feeds part; lines without words are kept. A missing text stays missing and has no lines, an empty one has
    one empty line. Rows are known by a hash of id and text; rows equal in both count as one document.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    with scratch(docs.sparkSession):
        found = stash(recurring_lines(keyed.where("text is not null"), depth, min_docs, constant), "dropped", keep=True)
    width = found.agg(F.coalesce(F.sum(32 + 4 * F.size("dropped")), F.lit(0))).first()[0]
    found = found.select(F.col("row").alias("__row"), F.col("dropped").alias("__dropped"))
    if width <= BROADCAST_MAX_BYTES:  # by measure; beyond it both sides are shuffled by row
        found = F.broadcast(found)
    joined = docs.join(found, F.xxhash64("doc_id", "text") == F.col("__row"), "left")
    lines = F.split("text", "\n")
    n_dropped = F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long")
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(_kept(lines, F.col("__dropped")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in names), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
