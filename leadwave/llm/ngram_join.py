"""N-gram Jaccard join: group counts of shingle sets as points of a tree of bounding boxes."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwave.llm.common import may_be_alike, pieces, scratch, stash, texts_of
from leadwave.llm.components import components
from leadwave.llm.words import NOT_SPACE, U, Words, mix64, parities, text_hash
from leadwave.session import broadcast_if_small

SHINGLE = 5
LIKENESS = Fraction(4, 5)
# Points have FINE coordinates; boxes of the tree, and points while they are compared inside it, have these summed to GROUPS.
FINE, GROUPS = 128, 32
# Shingles counted as frequent only change which of a set's shingles are looked at first; links do not depend on them.
FREQUENT_MAX = 1_000_000
# How often, twice at least, a task must have met a shingle to report it, and all tasks together for it to count as frequent.
MET, FREQUENT = 2, 6
# Buckets with more nodes than this outside their largest component get further pivots before all that is left meets.
LONG = 16
# Bits of the table of shingles that may recur: 32 MB, whatever the size of the corpus. A fuller table only lets more through.
CODE_BITS = 28
# Bits of a set's signature, which stands for the set before whole sets are moved; and of the folded one that meets others in buckets.
SIGN_BITS, FOLDED_BITS = 2048, 512
_SLICE_BITS = 15  # bits of one of Spark's bitmaps
_FLUSH = 4 << 20


def _shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of all its words together if they are fewer."""
    for i, j in pieces(texts):
        words = Words(texts[i:j], NOT_SPACE)
        grams, _ = words.grams(k)
        for first, last in zip(words.first[:-1], words.first[1:], strict=True):
            if last - first >= k:
                yield np.unique(grams[first : last - k + 1])
            else:
                yield text_hash(words.hashes[first:last]) if last > first else np.empty(0, U)


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that recur within tasks, by their summed counts, the commonest first and at most FREQUENT_MAX of them.

    Each task counts everything it reads and reports what it met at least MET times. The list has a bound, so it can be
    broadcast; any list gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, size = np.empty(_FLUSH, U), 0  # a worker's largest array, used again and sorted in place
        for batch in batches:
            for shingles in _shingle_sets(texts_of(batch["text"]), k):
                for i in range(0, len(shingles), _FLUSH):
                    part = shingles[i : i + _FLUSH]
                    if size + len(part) > _FLUSH:
                        yield report(met[:size])
                        size = 0
                    met[size : size + len(part)] = part
                    size += len(part)
        yield report(met[:size])

    def report(met: np.ndarray) -> pa.RecordBatch:
        met.sort()
        again = np.concatenate(([False], met[1:] == met[:-1], [False])) if len(met) else np.zeros(1, bool)
        edges = np.flatnonzero(again[1:] != again[:-1])  # the first and the last place of each shingle met at least twice
        first, counts = edges[::2], edges[1::2] - edges[::2] + 1
        often = counts >= MET
        return pa.RecordBatch.from_arrays([pa.array(met[first[often]].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "times"])

    counts = docs.select("text").mapInArrow(run, "shingle bigint, times bigint").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counts.where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "shingle").limit(FREQUENT_MAX).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(dtype=np.int64).view(U))


def shingle_points(docs: DataFrame, k: int = SHINGLE, likeness: Fraction = LIKENESS) -> DataFrame:
    """(doc_id, row, n, set_key, counts, sign, first): for each row its set's size, digest, group counts, signature and leading shingles.

    Shingles are hashed into FINE groups; `counts` has the number in each. `first` holds the n - ceil(likeness * n) + 1 leading
    shingles in one global order (frequent ones last, then by hash); two sets that are alike share one of them.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))
    up, down = likeness.numerator, likeness.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            sizes, keys, counts, signs, leading = [], [], [], [], []
            for shingles in _shingle_sets(texts_of(batch["text"]), k):
                n = len(shingles)
                sizes.append(n)
                keys.append(int(mix64(mix64(shingles + U(7)).sum(dtype=U, keepdims=True) + U(n)).view(np.int64)[0]) if n else None)
                counts.append(np.bincount((shingles >> U(64 - FINE.bit_length() + 1)).astype(np.int64), minlength=FINE).astype(np.int32))
                signs.append(_signature(shingles))
                late = np.zeros(n, bool) if not len(often) else often[np.minimum(np.searchsorted(often, shingles), len(often) - 1)] == shingles
                leading.append(np.concatenate((shingles[~late], shingles[late]))[: n + (-up * n) // down + 1 if n else 0].view(np.int64))
            lists = [pa.array(counts, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in (signs, leading))]
            arrays = [batch["doc_id"], batch["row"], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n", "set_key", "counts", "sign", "first"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {id_type}, row bigint, n bigint, set_key bigint, counts array<int>, sign array<bigint>, first array<bigint>")


def _recurring(points: DataFrame) -> np.ndarray:
    """Bit table of the leading shingles, by the low bits of their hashes, that more than one row has.

    Only codes are shuffled to be counted; those found twice are laid into bitmaps by slices of the table.
    """
    code = F.col("shingle").bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("int").alias("code")
    counts = points.select(F.explode("first").alias("shingle")).select(code).groupBy("code").agg(F.count("*").alias("times"))
    twice = counts.where("times > 1").select(F.bitmap_bucket_number(F.col("code") + 1).alias("slice"), F.bitmap_bit_position(F.col("code") + 1).alias("bit"))
    table = np.zeros(1 << (CODE_BITS - 3), np.uint8)
    for part in twice.repartition("slice").groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        start = (part["slice"] - 1) << (_SLICE_BITS - 3)
        table[start : start + len(part["bits"])] = np.frombuffer(part["bits"], np.uint8)
    return table


def _leading(points: DataFrame) -> DataFrame:
    """(shingle, set_key, n, room) of the leading shingles that may recur. `room` is the number of a set's shingles from this one
    on, in the global order: two sets share no more if it is the first that they share."""
    table = points.sparkSession.sparkContext.broadcast(_recurring(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            shingles = batch["first"].flatten().to_numpy(zero_copy_only=False)
            held = batch["first"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(shingles)) - np.repeat(np.cumsum(held) - held, held)
            code = shingles & ((1 << CODE_BITS) - 1)
            kept = np.flatnonzero((bits[code >> 3] >> (code & 7).astype(np.uint8)) & 1)
            owner = np.repeat(np.arange(len(held)), held)[kept]
            n = batch["n"].to_numpy(zero_copy_only=False)[owner]
            columns = [shingles[kept], batch["set_key"].to_numpy(zero_copy_only=False)[owner], n.astype(np.int32), (n - place[kept]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "set_key", "n", "room"])

    return points.select("set_key", "n", "first").mapInArrow(run, "shingle bigint, set_key bigint, n int, room int")


def _may_meet(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], likeness: Fraction) -> Column:
    """Whether a shared shingle can be the first that two alike sets share: (least size, most size, most room) of both sides."""
    up, down = likeness.numerator, likeness.denominator
    fits = (a[1] * down >= b[0] * up) & (b[1] * down >= a[0] * up)
    return fits & (F.least(a[2], b[2]) * (up + down) >= (a[0] + b[0]) * up)


def _may_link(a: str, b: str, likeness: Fraction) -> Column:
    """No set in box `a` can be like one in box `b` unless this holds: sizes fit, and the summed minima of the group counts,
    which no overlap exceeds, reach likeness / (1 + likeness) of both sizes. A box has the least and largest size and the
    largest counts of its sets; a single set is its own box."""
    up, down = likeness.numerator, likeness.denominator
    fits = (F.col(f"{a}.most") * down >= F.col(f"{b}.least") * up) & (F.col(f"{b}.most") * down >= F.col(f"{a}.least") * up)
    return fits & (_minima(a, b) * (up + down) >= (F.col(f"{a}.least") + F.col(f"{b}.least")) * up)


def _minima(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(f"{a}.counts", f"{b}.counts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _bound(a: str, b: str) -> Column:
    return _minima(a, b) / (F.col(f"{a}.least") + F.col(f"{b}.least"))


def _signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of SIGN_BITS groups of shingles. Two sets differ in at least as many shingles as their signatures do in bits."""
    return parities(shingles, SIGN_BITS)


def _folded() -> list[Column]:
    """A signature of FOLDED_BITS in columns of its own, from `sign`."""
    words = FOLDED_BITS // 64
    fold = lambda j: [F.col("sign")[i] for i in range(j, SIGN_BITS // 64, words)]
    return [reduce(lambda x, y: x.bitwiseXOR(y), fold(j)).alias(f"sign{j}") for j in range(words)]


def _apart(least: str, most: str) -> Column:
    """Bits that all signatures of box a have and none of box b, or the other way round. Columns `least`0_a, ... hold the bits that all
    sets in a box have, `most`0_a, ... those that any has; a single set is its own box."""
    of = lambda name, x: [F.col(f"{name}{j}_{x}") for j in range(FOLDED_BITS // 64)]
    corners = zip(of(least, "a"), of(most, "a"), of(least, "b"), of(most, "b"), strict=True)
    return sum((F.bit_count(x.bitwiseAND(F.bitwise_not(v)).bitwiseOR(u.bitwiseAND(F.bitwise_not(y)))) for x, y, u, v in corners), F.lit(0))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, likeness: Fraction) -> DataFrame:
    """The pairs (a, b) of set keys whose sets really are alike."""
    ends = pairs.select(F.col("a").alias("set_key")).union(pairs.select(F.col("b").alias("set_key"))).distinct()
    rows = stash(nodes.join(ends, "set_key").select("set_key", F.col("row").alias("of")), "ends")
    # Texts stay where they are while the list of those wanted is small by measure; beyond that both sides are shuffled by row.
    texts = docs.join(broadcast_if_small(rows), docs["row"] == F.col("of")).select("set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _shingle_sets(texts_of(batch["text"]), k)]
            yield pa.RecordBatch.from_arrays([batch["set_key"], pa.array(sets, pa.list_(pa.int64()))], ["set_key", "shingles"])

    sets = stash(texts.mapInArrow(run, "set_key bigint, shingles array<bigint>"), "sets")
    if sets.count() > rows.count():  # rows equal in id and text: one stands for all
        sets = stash(sets.dropDuplicates(["set_key"]), "sets")
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    alike = both * likeness.denominator >= union * likeness.numerator
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(alike).select("a", "b").distinct()


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold two components, with their `root` and `open`, the number of nodes outside the bucket's largest
    component. A bucket of two was looked at whole when its nodes met its first one."""
    named = members.join(broadcast_if_small(roots), "set_key", "left").select("shingle", "set_key", F.coalesce("root", "set_key").alias("root"), "n", "room")
    held = named.groupBy("shingle", "root").agg(F.count("*").alias("held")).groupBy("shingle").agg(F.sum("held").alias("total"), F.max("held").alias("most"))
    mixed = held.where("total > most and total > 2").select("shingle", (F.col("total") - F.col("most")).alias("open"))
    return stash(named.join(mixed, "shingle"), "placed")


def _pivoted(placed: DataFrame, turn: int, likeness: Fraction) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot and its nodes of other components, as far as they may link: any node of any component, by a
    hash that differs from turn to turn."""
    order = F.struct(F.xxhash64("root", F.lit(turn)).alias("by"), F.xxhash64("set_key", F.lit(turn)).alias("then"), "root", "set_key", "n", "room")
    pivots = placed.groupBy("shingle").agg(F.min(order).alias("pivot"))
    sides = [(F.col("n"), F.col("n"), F.col("room")), (F.col("pivot.n"), F.col("pivot.n"), F.col("pivot.room"))]
    met = placed.join(pivots, "shingle").where(F.col("root") != F.col("pivot.root")).where(_may_meet(*sides, likeness))
    return met.select(F.least("set_key", "pivot.set_key").alias("a"), F.greatest("set_key", "pivot.set_key").alias("b")).distinct()


def _found_across(placed: DataFrame, nodes: DataFrame, box: DataFrame, likeness: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes of different components that meet in a bucket, as far as their boxes, and they, may link.

    A leaf is what a bucket has of one component. Its box has sizes, and signatures as corners of a cube: bits that all its nodes have,
    and bits that any has. Leaves meet by these; two leaves of one node each are a pair already. Of others the boxes of the whole
    components are compared, once for all buckets, and where these may link the nodes of the two leaves meet.
    """
    words = range(FOLDED_BITS // 64)
    placed = stash(placed.join(nodes.select("set_key", *_folded()), "set_key"), "signed")
    corners = [c for j in words for c in (F.bit_and(f"sign{j}").alias(f"all{j}"), F.bit_or(f"sign{j}").alias(f"any{j}"))]
    leaves = placed.groupBy("shingle", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"), F.count("*").alias("nodes"), F.min("set_key").alias("one"), *corners)
    a, b = (leaves.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in leaves.columns[1:])) for x in "ab")
    sides = [tuple(F.col(f"{c}_{x}") for c in ("least", "most", "room")) for x in "ab"]
    near = _may_meet(*sides, likeness) & may_be_alike(F.col("most_a") + F.col("most_b"), _apart("all", "any"), likeness)
    met = a.join(b, "shingle").where(F.col("root_a") < F.col("root_b")).where(near)
    alone = (F.col("nodes_a") == 1) & (F.col("nodes_b") == 1)
    met = stash(met.select("shingle", "root_a", "root_b", alone.alias("alone"), F.col("one_a").alias("a"), F.col("one_b").alias("b")), "met")

    several = met.where("not alone").select("root_a", "root_b").distinct()
    ends = several.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct()
    inside = placed.join(ends, "root", "left_semi")
    tops = inside.select("root", "set_key").distinct().join(box, "set_key").groupBy("root")
    largest = F.array(*(F.max(F.col("box.counts")[i]) for i in range(GROUPS)))
    boxes = tops.agg(F.min("box.least").alias("least"), F.max("box.most").alias("most"), largest.alias("counts"))
    boxes = stash(boxes.select("root", F.struct("least", "most", "counts").alias("box")), "boxes")
    of_a, of_b = (boxes.select(F.col("root").alias(f"root_{x}"), F.col("box").alias(f"box_{x}")) for x in "ab")
    opened = several.join(of_a, "root_a").join(of_b, "root_b").where(_may_link("box_a", "box_b", likeness)).select("root_a", "root_b")

    # Which leaves of a bucket are opened is told by (shingle, roots) before nodes meet, so that closed boxes never pair their nodes.
    doors = met.where("not alone").select("shingle", "root_a", "root_b").join(opened, ["root_a", "root_b"])
    a, b = (inside.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("root", "set_key", "n", "room", *(f"sign{j}" for j in words)))) for x in "ab")
    sides = [tuple(F.col(f"{c}_{x}") for c in ("n", "n", "room")) for x in "ab"]
    near = _may_meet(*sides, likeness) & may_be_alike(F.col("n_a") + F.col("n_b"), _apart("sign", "sign"), likeness)
    found = doors.join(a, ["shingle", "root_a"]).join(b, ["shingle", "root_b"]).where(near).select(F.col("set_key_a").alias("a"), F.col("set_key_b").alias("b"))
    return found.union(met.where("alone").select("a", "b")).distinct()


def jaccard_components(docs: DataFrame, k: int = SHINGLE, likeness: Fraction = LIKENESS) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, root) for each row of (doc_id, text).

    Rows with equal sets are one node. Nodes that share a leading shingle form a bucket, and buckets are searched as trees of boxes:

    1. every node of a bucket against the bucket's first node, point against point;
       Buckets that stay long get further pivots as long as that takes away a third of what their nodes have left to meet;
    2. components so far become boxes. In each bucket that still holds two components, what it has of each is a box of sizes and of
       signatures (FOLDED_BITS bits; sets differ in at least as many shingles as these in bits). Boxes that may link are opened, if
       the boxes of the whole components (sizes and largest group counts) may link too, by the summed coordinate minima; these are
       compared once, however many buckets they share. Nodes of opened boxes are compared by signatures, then by points and whole signatures.

    Shingles that only one row leads with are left out by a bit table of fixed size before anything else is moved. Nodes meet in the
    bucket of the first shingle they share: in others, what is left of both sets may be too little for a link (see _may_meet).

    What passes is verified on the whole sets; of two boxes first the likeliest pair, then the others if that does not unite them. Only nodes of different components are compared in step 2, so a group of
    near copies costs a multiple of its size, not its square; all other pairs of a bucket are compared, without a limit.

    Rows without words have component_id = doc_id. A missing id takes part in links, but is nobody's component: rows linked only with such rows
    have none. A repeated id is judged row by row. `root` tells the components apart whatever their ids; rows without words have none.
    """
    docs = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    with scratch(docs.sparkSession):
        return stash(_components_of(docs, k, likeness), "found", keep=True)


def _components_of(docs: DataFrame, k: int, likeness: Fraction) -> DataFrame:
    """The steps of jaccard_components on (doc_id, text, row)."""
    points = stash(shingle_points(docs, k, likeness), "points")
    real = points.where("set_key is not null")
    nodes = stash(
        real.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("sign").alias("sign")), "nodes"
    )
    leading = stash(_leading(real), "leading")
    head = [F.min("set_key").alias("head"), F.max("set_key").alias("last"), F.min_by("n", "set_key").alias("head_n"), F.min_by("room", "set_key").alias("head_room")]
    shared = stash(leading.groupBy("shingle").agg(*head).where("head != last").drop("last"), "shared")
    members = stash(leading.distinct().join(shared, "shingle"), "members")

    point = nodes.select("set_key", F.struct(F.col("n").alias("least"), F.col("n").alias("most"), "counts", "sign").alias("box"))
    coarse = F.array(*(sum((F.col("counts")[g] for g in range(i, i + FINE // GROUPS)), F.lit(0)) for i in range(0, FINE, FINE // GROUPS)))
    box = nodes.select("set_key", F.struct(F.col("n").alias("least"), F.col("n").alias("most"), coarse.alias("counts")).alias("box"))

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs whose points and signatures may link by all their coordinates, and `bound`, the largest likeness the points leave them."""
        of_a, of_b = (point.select(F.col("set_key").alias(x), F.col("box").alias(f"box_{x}")) for x in "ab")
        apart = F.aggregate(F.zip_with("box_a.sign", "box_b.sign", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = _may_link("box_a", "box_b", likeness) & may_be_alike(F.col("box_a.most") + F.col("box_b.most"), apart, likeness)
        return pairs.join(of_a, "a").join(of_b, "b").where(near).select("a", "b", _bound("box_a", "box_b").alias("bound"))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, nodes, docs, k, likeness)

    def rooted(links: DataFrame) -> DataFrame:
        return stash(components(links), "roots").withColumnRenamed("node", "set_key")

    n, room, head_n, head_room = (F.col(c) for c in ("n", "room", "head_n", "head_room"))
    stars = members.where("head != set_key").where(_may_meet((n, n, room), (head_n, head_n, head_room), likeness))
    stars = stars.select(F.col("head").alias("a"), F.col("set_key").alias("b")).distinct()
    links = stash(verified(stash(close(stars), "stars")), "links")
    roots = rooted(links)
    placed = _placed(members, roots)

    short, long, open_before, turn = placed.where(F.col("open") <= LONG).drop("open"), placed.where(F.col("open") > LONG), None, 0
    while (still := long.where(F.col("open") > LONG).agg(F.sum("open")).first()[0] or 0) and (open_before is None or still <= 0.7 * open_before):
        open_before, turn = still, turn + 1
        found = verified(stash(close(_pivoted(long, turn, likeness)), "close"))
        links = stash(links.union(found), "links")
        roots = rooted(links)
        long = _placed(long.select("shingle", "set_key", "n", "room"), roots)
    if turn:
        placed = _placed(short.drop("root").union(long.select("shingle", "set_key", "n", "room")), roots)

    # One link unites two components, so the likeliest pair of each two is verified first, and of the others those still apart.
    found = stash(close(_found_across(placed, nodes, box, likeness)), "across")
    for best in (True, False):
        of_a, of_b = (roots.select(F.col("set_key").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        ends = found.join(broadcast_if_small(of_a), "a", "left").join(broadcast_if_small(of_b), "b", "left")
        ends = ends.withColumns({f"root_{x}": F.coalesce(f"root_{x}", x) for x in "ab"}).where("root_a != root_b")
        if best:
            both = [F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")]
            ends = ends.groupBy(*both).agg(F.max(F.struct("bound", "a", "b")).alias("best")).select("best.*")
        links = stash(links.union(verified(stash(ends.select("a", "b"), "pairs"))), "links")
        roots = rooted(links)

    named = nodes.join(roots, "set_key", "left").select("set_key", "doc_id", F.coalesce("root", "set_key").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(names, "root").select("set_key", "component_id", "root")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return points.select("doc_id", "row", "n", "set_key").join(of_set, "set_key", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), "root")
