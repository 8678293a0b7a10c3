from collections import defaultdict

from leadwave.llm.sharding import shuffle_shards


def test_every_row_once_in_shards_of_equal_size(table):
    rows = [(i, f"text {i % 7}") for i in range(1003)] + [(None, None), (5, "text 5"), (5, "text 5"), (6, "")]
    out = shuffle_shards(table(rows, shard="mine", Slot="mine"), 24).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted((i is None, i or 0, t or "") for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_order_depends_on_rows_and_seed_alone(table):
    df = table([(i, f"text {i}") for i in range(500)])

    def places(d, seed=0, **how):
        return {r.doc_id: (r.shard, r.slot) for r in shuffle_shards(d, 8, seed, **how).collect()}

    assert places(df) == places(df.repartition(5, "text"))
    assert places(df) != places(df, seed=1)
    many = places(df, bucket_bytes=200)
    assert sorted(many.values()) == sorted(places(df).values()) and many != places(df)


def test_order_is_random(table):
    out = shuffle_shards(table([(i, "same") for i in range(2000)]), 2).collect()
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 880 < rising < 1120


def test_fewer_rows_than_shards_and_none(table):
    out = shuffle_shards(table([(1, "a"), (2, None), (3, "c" * 50_000)]), 24).collect()
    assert len({r.shard for r in out}) == 3 and {r.slot for r in out} == {0}
    assert shuffle_shards(table([]), 24).collect() == []
