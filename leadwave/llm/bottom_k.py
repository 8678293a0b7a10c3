"""MinHash near-duplicates by bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import may_be_alike, pieces, scratch, stash, texts_of
from leadwave.llm.components import components
from leadwave.llm.words import NOT_SPACE, U, Words, mix64, parities, text_hash
from leadwave.session import broadcast_if_small

SHINGLE = 2
LIKENESS = Fraction(4, 5)
SKETCH = 48
# Chance that a sketch shares less than what is asked for although the sets are alike.
MISS = 1e-8
# Lists in which a node meets more than this many of other components get more pivots.
LIST = 64
# Bits of a whole set's signature, which is compared before sketches are.
BITS = 512


_WORDS = [f"bits{i}" for i in range(BITS // 64)]
_MEMBER = ["root", "set_key", "n", "asked", "room"]


def least_overlap(k: int, likeness: Fraction) -> int:
    """Values of a union sketch of k that two sets at the limit share all but surely: fewer have a chance of at most MISS.

    Each of the k smallest values of the union is in both sets with probability `likeness`, drawn without replacement, so the
    binomial tail bounds it.
    """
    p, tail, m = float(likeness), 0.0, 0
    while (tail := tail + comb(k, m) * p**m * (1 - p) ** (k - m)) <= MISS:
        m += 1
    return m


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of all its words together if they are fewer."""
    for i, j in pieces(texts):
        words = Words(texts[i:j], NOT_SPACE)
        grams, _ = words.grams(k)
        for first, last in zip(words.first[:-1], words.first[1:], strict=True):
            if last - first >= k:
                yield np.unique(grams[first : last - k + 1])
            else:
                yield text_hash(words.hashes[first:last]) if last > first else np.empty(0, U)


def _signed(values: np.ndarray) -> np.ndarray:
    """As Spark's signed integers, in the same order."""
    return (values ^ U(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, k: int = SHINGLE, size: int = SKETCH) -> DataFrame:
    """(doc_id, row, n, set_key, kept, bits): for each row of (doc_id, row, text) its set's size and digest, its `size` smallest values
    in rising order, and the whole set's signature (see parities). A set no larger than that is its own sketch. A text without words has n = 0
    and no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, kept, bits = [], [], [], []
            for values in _sets(texts_of(batch["text"]), k):
                n = len(values)
                sizes.append(n)
                keys.append(int(mix64(mix64(values + U(7)).sum(dtype=U, keepdims=True) + U(n)).view(np.int64)[0]) if n else None)
                kept.append(_signed(values[:size]))
                bits.append(parities(values, BITS))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (kept, bits)]
            arrays = [batch["doc_id"], batch["row"], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n", "set_key", "kept", "bits"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {id_type}, row bigint, n bigint, set_key bigint, kept array<bigint>, bits array<bigint>")


def _may_link(a: str, b: str, size: int, likeness: Fraction) -> Column:
    """What the union sketch says of two nodes: sizes fit, and enough of the smallest values of the union are in both. A union
    that the sketches hold whole is judged exactly."""
    up, down = likeness.numerator, likeness.denominator
    n_a, n_b, kept_a, kept_b = (F.col(f"{x}.{c}") for c in ("n", "kept") for x in (a, b))
    fits = (n_a * down >= n_b * up) & (n_b * down >= n_a * up)
    enough = least_overlap(size, likeness)
    both = F.array_intersect(kept_a, kept_b)
    union = F.slice(F.sort_array(F.array_union(kept_a, kept_b)), 1, size)
    shared = F.size(F.array_intersect(both, union))
    whole = (F.size(union) < size) & (shared * down >= F.size(union) * up)
    return fits & ((F.size(both) >= enough) | (F.least(n_a, n_b) < size)) & (whole | ((F.size(union) == size) & (shared >= enough)))


def inverted_lists(nodes: DataFrame, size: int, likeness: Fraction) -> DataFrame:
    """(list, set_key, n, asked, room): the members of each list, one for each retained value that others retain too.

    Two nodes that the union sketch can let pass share at least `asked` values. In the one order of all values (those in fewest
    sketches first, then by hash), the first value they share is then among the first |found| - asked + 1 of both, `found` being the
    values that others retain too; `room` of them are left from that one on, so no more can be shared.
    """
    asked = F.least(F.lit(least_overlap(size, likeness)), F.ceil(F.col("n") * float(likeness) - 1e-9).cast("int"))
    values = nodes.where("n > 1").select("set_key", F.explode("kept").alias("value"))
    held = values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    shared = values.join(held, "value").groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("found"))
    shared = shared.withColumn("found", F.col("found.value"))
    listed = nodes.join(shared, "set_key").select("set_key", "n", asked.alias("asked"), "found")
    leading = F.slice("found", F.lit(1), F.greatest(F.size("found") - F.col("asked") + 1, F.lit(0)))
    members = listed.select("set_key", "n", "asked", F.size("found").alias("all"), F.posexplode(leading).alias("at", "list"))
    return members.withColumn("room", F.col("all") - F.col("at")).drop("all", "at")


def _may_meet(a: str, b: str, likeness: Fraction) -> Column:
    """What members (column names' endings) of one list tell of a link: sizes fit, and the values left from this one on are as many as
    both ask for. True of every pair that _may_link lets pass, in the list of the first value the two share."""
    up, down = likeness.numerator, likeness.denominator
    of = lambda name: (F.col(name + a), F.col(name + b))
    n_a, n_b = of("n")
    return (n_a * down >= n_b * up) & (n_b * down >= n_a * up) & (F.least(*of("room")) >= F.greatest(*of("asked")))


def _signatures(nodes: DataFrame) -> DataFrame:
    return nodes.select("set_key", "n", *(F.col("bits")[i].alias(word) for i, word in enumerate(_WORDS)))


def _may_be_alike(a: str, b: str, likeness: Fraction) -> Column:
    """What the signatures of two whole sets (column names' endings) tell of a link: true of every pair that is one."""
    apart = sum((F.bit_count(F.col(word + a).bitwiseXOR(F.col(word + b))) for word in _WORDS), F.lit(0))
    return may_be_alike(F.col(f"n{a}") + F.col(f"n{b}"), apart, likeness)


def _alike_by_signature(pairs: DataFrame, nodes: DataFrame, likeness: Fraction) -> DataFrame:
    """The pairs (a, b), each once, that the signatures of their whole sets let pass."""
    signs = _signatures(nodes)
    of_a, of_b = (signs.select(F.col("set_key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *_WORDS))) for x in "ab")
    return pairs.distinct().join(of_a, "a").join(of_b, "b").where(_may_be_alike("_a", "_b", likeness)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, likeness: Fraction) -> DataFrame:
    """The pairs (a, b) of set keys whose whole sets are alike. Each set is made once, from one text."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    rows = stash(nodes.join(ends, "set_key").select("set_key", F.col("row").alias("of")), "ends")
    texts = docs.join(broadcast_if_small(rows), docs["row"] == F.col("of")).select("set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_signed(s) for s in _sets(texts_of(batch["text"]), k)]
            yield pa.RecordBatch.from_arrays([batch["set_key"], pa.array(sets, pa.list_(pa.int64()))], ["set_key", "held"])

    sets = stash(texts.mapInArrow(run, "set_key bigint, held array<bigint>").dropDuplicates(["set_key"]), "sets")
    left, right = (sets.select(F.col("set_key").alias(x), F.col("held").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * likeness.denominator >= union * likeness.numerator).select("a", "b")


def _close(pairs: DataFrame, nodes: DataFrame, size: int, likeness: Fraction) -> DataFrame:
    """The pairs (a, b) that their union sketches let pass, each once."""
    of_a, of_b = (nodes.select(F.col("set_key").alias(x), F.struct("n", "kept").alias(f"of_{x}")) for x in "ab")
    return pairs.distinct().join(of_a, "a").join(of_b, "b").where(_may_link("of_a", "of_b", size, likeness)).select("a", "b")


def _named(members: DataFrame, end: str, *also: str) -> DataFrame:
    return members.select("list", *(F.col(c).alias(c + end) for c in (*_MEMBER, *also)))


def _pivoted(placed: DataFrame, turn: int, likeness: Fraction) -> DataFrame:
    """Pairs of each list's pivot and its other members, as far as they may link: any node of any component, by a hash that
    differs from turn to turn."""
    order = F.struct(F.xxhash64("root", F.lit(turn)).alias("by"), F.xxhash64("set_key", F.lit(turn)).alias("then"), *_MEMBER)
    pivots = placed.groupBy("list").agg(F.min(order).alias("pivot")).select("list", "pivot.*")
    met = _named(placed, "_a").join(_named(pivots, "_b"), "list").where(F.col("root_a") != F.col("root_b"))
    return met.where(_may_meet("_a", "_b", likeness)).select(*_pair())


def _pair() -> list[Column]:
    return [F.least("set_key_a", "set_key_b").alias("a"), F.greatest("set_key_a", "set_key_b").alias("b")]


def _across(placed: DataFrame, nodes: DataFrame, likeness: Fraction) -> DataFrame:
    """Pairs of members of different components in each list, as far as they, and the signatures of their sets, may link.

    One of a pair is not of the list's largest component `top`, so a large group of near copies meets the others only.
    """
    signed = stash(placed.join(_signatures(nodes).drop("n"), "set_key"), "signed")
    a, b = _named(signed.where("root != top"), "_a", "top", *_WORDS), _named(signed, "_b", *_WORDS)
    once = (F.col("root_b") == F.col("top_a")) | (F.col("set_key_a") < F.col("set_key_b"))
    near = _may_meet("_a", "_b", likeness) & _may_be_alike("_a", "_b", likeness)
    return a.join(b, "list").where((F.col("root_a") != F.col("root_b")) & once & near).select(*_pair())


def near_duplicates(docs: DataFrame, k: int = SHINGLE, likeness: Fraction = LIKENESS, size: int = SKETCH) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, root) for each row of (doc_id, text), from links of at least `likeness`.

    Rows with equal sets are one node. Nodes meet in inverted lists of their rarest retained values (see inverted_lists):

    1. each list's nodes against one pivot; what the union sketches let pass is verified on whole sets, and linked nodes become
       components, so a group of near copies costs a multiple of its size. Lists that stay long get further pivots as long as
       that takes away a third of what their nodes have left to meet;
    2. in every list that still holds two components, pairs of nodes of different components.

    Before sketches are compared, signatures of the whole sets are, of BITS bits: sets differ in at least as many shingles as their
    signatures do in bits, so no link is lost by that, and of texts that share a list without being alike few pairs leave it (all, if
    sets have far more shingles than BITS). No list and no number of partners is capped. A link of the limit itself is missed with a
    chance of at most MISS, when fewer values of the union sketch are shared than least_overlap asks for; sets up to the sketch's size
    are never missed.

    Rows without words have component_id = doc_id and link with nothing. A missing id takes part in links, but is nobody's
    component. A repeated id is judged row by row. `root` tells components apart whatever their ids. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    with scratch(docs.sparkSession):
        points = stash(sketches(docs, k, size), "points")
        real = points.where("set_key is not null").groupBy("set_key")
        nodes = stash(real.agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("kept").alias("kept"), F.first("bits").alias("bits")), "nodes")
        roots = stash(components(_links(nodes, docs, k, likeness, size)), "roots")
        named = nodes.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "doc_id", F.coalesce("root", "set_key").alias("root"))
        names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of_set = named.join(names, "root").select("set_key", "component_id", "root")
        component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        found = points.join(of_set, "set_key", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), "root")
        return stash(found, "found", keep=True)


def _links(nodes: DataFrame, docs: DataFrame, k: int, likeness: Fraction, size: int) -> DataFrame:
    """Links that connect all nodes which any links connect."""
    members = stash(inverted_lists(nodes, size, likeness), "members")
    alone = members.groupBy("list").agg(F.count("*").alias("times")).where("times > 1").select("list")
    placed = stash(members.join(alone, "list").withColumn("root", F.col("set_key")), "placed")
    links, open_before, turn = None, None, 0
    while True:
        # Of lists that were looked at before, only long ones get another pivot; the others are short enough for all pairs.
        turn, looked = turn + 1, placed if links is None else placed.where(F.col("open") > LIST)
        close = stash(_close(_alike_by_signature(_pivoted(looked, turn, likeness), nodes, likeness), nodes, size, likeness), "close")
        found = _verified(close, nodes, docs, k, likeness)
        links = stash(found if links is None else links.union(found), "links")
        roots = stash(components(links), "parts").withColumnRenamed("node", "set_key")
        before = placed.select("list", *(c for c in _MEMBER if c != "root"))
        placed = before.join(broadcast_if_small(roots), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
        held = placed.groupBy("list", "root").agg(F.count("*").alias("n_root"))
        lists = held.groupBy("list").agg(F.sum("n_root").alias("total"), F.max("n_root").alias("most"), F.max_by("root", F.struct("n_root", "root")).alias("top"))
        # A list of two was looked at whole by its pivot.
        lists = lists.where("total > most and total > 2").select("list", "top", (F.col("total") - F.col("most")).alias("open"))
        placed = stash(placed.join(lists, "list"), "placed")
        still = placed.where(F.col("open") > LIST).agg(F.sum("open")).first()[0] or 0
        if still == 0 or (open_before is not None and still > 0.7 * open_before):
            break
        open_before = still
    return links.union(_verified(stash(_close(_across(placed, nodes, likeness), nodes, size, likeness), "pairs"), nodes, docs, k, likeness))
