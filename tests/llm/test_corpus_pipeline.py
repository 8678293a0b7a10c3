"""The pipeline against a plain version of each stage on its own input, and the queries against DuckDB and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from brute import NOT_SPACE, components, contamination, held_out, repeats
from checks.compare import difference
from leadwave.llm.fingerprints import fingerprints
from leadwave.llm.oracle import ORACLE
from leadwave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SMALL).toPandas() for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql(results, con, name):
    assert difference(results[name], con.execute(ORACLE[name]).fetchdf()) is None


def test_suffix_dedup(results, documents):
    got = results["op1_suffix_dedup"][["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]
    assert sorted(map(tuple, got.itertuples(index=False))) == repeats(sorted((i, r.text) for i, r in documents.items()), 400)


def test_sharding(results, documents):
    got = results["op3_sharding"]
    assert sorted(got.doc_id) == sorted(documents) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        text = documents[r.doc_id].text.encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    sizes = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert len(sizes) == 24 and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] == sizes["count"] - 1).all()
    assert not got.duplicated(["shard", "slot"]).any()


@pytest.mark.parametrize("name,limit", [("op4_toxicity", 0.5), ("op8_quality", 0.3)])
def test_scores(results, documents, name, limit):
    got = results[name]
    assert sorted(got.doc_id) == sorted(documents) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= limit)).all()
    assert [held_out(i) for i in got.doc_id] == got.held_out.tolist()


def test_token_counts(results, documents):
    got = results["op9_token_counts"].set_index("doc_id")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in documents.items():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert tuple(got.loc[i]) == (len(r.text.encode()), n, n > 2048)


def test_fingerprints(results, documents):
    got, order = results["op10_fingerprints"].set_index("doc_id"), sorted(documents, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = documents[i].text, documents[after].text
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
    texts = [documents[i].text.encode() for i in order]
    assert [p.astype(">u2").tobytes().hex() for p in fingerprints(texts)] == got.fingerprint[order].tolist()


def stages(spark, docs, sf_dir):
    """Input and output rows of every stage."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        rows = after.collect()
        out.append((docs.collect(), rows, after.columns))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def test_stages_of_the_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxicity, near, clean, mixed, shards = stages(spark, docs, SMALL)
    assert all(s[2] == COLUMNS for s in (toxicity, near, clean, mixed)) and shards[2] == [*COLUMNS, "shard", "slot"]

    scores = QUERIES["op4_toxicity"](spark, SMALL).collect()
    assert {r.doc_id for r in toxicity[1]} == {r.doc_id for r in scores if r.predicted == 0}

    groups = components([(r.doc_id, r.text) for r in near[0]])
    assert {r.doc_id for r in near[1]} == {i for i, (_, root) in groups.items() if i == root}

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contamination([(r.doc_id, r.text) for r in clean[0]], items) if r[5]}
    assert {r.doc_id for r in clean[1]} == {r.doc_id for r in clean[0]} - bad

    times, size, largest = Counter(r.doc_id for r in mixed[1]), defaultdict(int), defaultdict(int)
    for r in mixed[0]:
        words = len(NOT_SPACE.findall(r.text))
        size[r.source] += words
        largest[r.source] = max(largest[r.source], words)
    assert set(times.values()) <= {1, 2}
    taken = defaultdict(int)
    for r in mixed[1]:
        taken[r.source] += len(NOT_SPACE.findall(r.text))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    level, total = 0.0, 1.5 * sum(size.values())
    free = dict(weight)
    while True:  # water-filling round by round
        level = (total - sum(2 * size[s] for s in size if s not in free)) / sum(free.values())
        over = [s for s in free if free[s] * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            del free[s]
    for s in size:
        target = weight[s] * level if s in free else 2 * size[s]
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6

    assert sorted(tuple(r)[:5] for r in shards[1]) == sorted(map(tuple, mixed[1]))
    slots = defaultdict(list)
    for r in shards[1]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == [*COLUMNS, "shard", "slot"] and rows.count() > 100


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty texts, repeated rows, extra columns, no rows."""
    rng = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en", rng.choice(["a", "b", None]), 5, "x") for i in range(60)]
    rows += [(None, None, None, None, None, None), (None, "", None, None, None, None), (3, rows[3][1], "en", "a", 5, "x"), (None, rows[4][1], None, "b", 1, "y"), (100, long, "en", "a", 1, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(60)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[0][1]), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            got = after.collect()
            if name != "sharding":
                assert after.columns == docs.columns
                docs = spark.createDataFrame(got, schema)
            assert bool(got) == bool(part)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(1)
    a, b, c, d, e = (" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(900)) for _ in range(60)) for _ in range(5))
    rows = [(None, a, "x")] * 3 + [(None, a + " z", "x"), (7, a, "x"), (9, a + " y", "x")]  # missing ids beside others
    rows += [(None, b, "x")] * 4 + [(None, b + " z", "x")]  # missing ids only
    rows += [(3, c, "y"), (3, c, "x"), (3, c, "x")]  # equal rows
    rows += [(4, d, "x"), (4, d + " z", "x"), (4, d + " y", "x"), (5, d, "x"), (5, d, "x")]  # an id with several texts
    rows += [(6, e, "x"), (None, None, "x"), (None, None, "x"), (8, "", "x"), (8, "", "x"), (10, "", "x")]  # alone, without words
    docs = spark.createDataFrame([(i, text, "en", source, 1) for i, text, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    got = Counter((r.doc_id, r.text, r.source) for r in after.collect())
    of_b, of_d = (next(k for k in got if k[0] == i and k[1] and k[1].startswith(t)) for i, t in ((None, b), (4, d)))
    expected = [(7, a, "x"), of_b, (3, c, "x"), of_d, (6, e, "x"), (None, None, "x"), (8, "", "x"), (10, "", "x")]
    assert after.columns == COLUMNS and got == Counter(expected)
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), SMALL).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in again) == got


def test_modules_do_not_hide_import_errors():
    for path in ("corpus_pipeline.py", "leadwave/llm/queries.py"):
        assert not re.search(r"except (ImportError|ModuleNotFoundError)", open(path).read())
