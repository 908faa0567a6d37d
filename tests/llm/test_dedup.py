"""SimHash near-dedup and streaming exact dedup against brute force."""

import hashlib
import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from stowage.llm import exact_dedup, simhash
from stowage.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOC)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def groups(pairs):
    out = {}
    for key, group in pairs:
        out.setdefault(group, set()).add(key)
    return sorted(map(sorted, out.values()))


def brute_groups(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \t\n", "A b", "one two three", "É ÀB c\x0bd\x1ce f " * 40, "word " * 300_000])
def test_fingerprint(text):
    if text and len(text) > 1_000_000:
        short = "word " * 30
        assert simhash.fingerprint(text) == simhash.fingerprint(short) == brute_print(short)
    else:
        assert simhash.fingerprint(text) == brute_print(text)


def test_pieces_make_no_difference(monkeypatch):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choices("abcdé", k=rnd.randrange(1, 9))) for _ in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_links_of_all_shapes(spark):
    """Every way of spreading 1 to 3 differing bits over the blocks, and near misses."""
    rnd, prints = random.Random(5), {0, 7, 15}
    for spread in ((1, 0, 0), (2, 0, 0), (0, 3, 0), (1, 1, 1), (0, 2, 1), (3, 0, 0), (0, 0, 3), (1, 0, 2), (2, 1, 1), (0, 4, 0)):
        a = b = rnd.getrandbits(64)
        for n, (lo, hi) in zip(spread, simhash.BLOCKS, strict=True):
            for i in rnd.sample(range(lo, hi), n):
                b ^= 1 << i
        prints |= {a, b}
    for lo, hi in simhash.BLOCKS:  # many that differ in one block alone, at all distances
        base = rnd.getrandbits(64)
        prints |= {base ^ sum(1 << i for i in rnd.sample(range(lo, hi), rnd.randrange(8))) for _ in range(60)}
    want = brute_groups(prints)
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = [(r.fp, r.root) for r in simhash.link_fingerprints(rows).collect()]
    assert groups(got) == groups((simhash._signed(k), v) for k, v in want.items())


def test_near_duplicates(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    other = list(base)
    other[200] = "changed"
    texts = [" ".join(base), " ".join(other), " ".join(base), None, "", "a", "a", " ".join(reversed(base))]
    ids = [5, 3, 9, 1, 2, 7, 7, 0]
    got = simhash.near_duplicates(docs(spark, texts, ids).withColumn("root", F.lit(1)).withColumn("fp", F.lit("x")))
    assert got.columns == ["doc_id", "fingerprint", "component_id", "representative"]
    rows = got.collect()
    want = brute_groups({brute_print(t) for t in texts})
    least = {}
    for i, t in zip(ids, texts, strict=True):
        root = want[brute_print(t)]
        least[root] = min(least.get(root, 99), i)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{brute_print(t):016x}", least[want[brute_print(t)]]) for i, t in zip(ids, texts, strict=True))
    kept = simhash.drop_near_duplicates(docs(spark, texts, ids))
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    got = simhash.near_duplicates(docs(spark, ["x y z", "x y z"], [None, 4])).collect()
    assert {r.component_id for r in got} == {4} and sum(r.representative for r in got) == 1


def test_temporary_tables_go(spark):
    from stowage.operators import tables

    with tables.temporary(spark) as keep:
        a = tables.materialise(spark.range(3), "a")
        with tables.temporary(spark) as inner:
            b, c = tables.materialise(spark.range(4), "b"), inner(tables.materialise(spark.range(5), "c"))
        assert not tables.exists(spark, b.stored_in) and tables.exists(spark, c.stored_in)
        d = keep(tables.materialise(spark.range(6), "d"))
    assert not tables.exists(spark, a.stored_in) and not tables.exists(spark, c.stored_in) and d.count() == 6
    tables.clear(spark)
    assert not tables.exists(spark, d.stored_in)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 100: 90, 200: 90}


def brute_exact(rows):
    out = []
    keys = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), k in zip(rows, keys, strict=True):
        same = [j for (j, _), other in zip(rows, keys, strict=True) if other == k]
        out.append((i, min(same), len(same), hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out)


TEXTS = ["a  b", "a\tb", "a b ", None, "", "A b", "a b", "a b", "x" * 200_000, "x" * 200_000, "\n", " "]


@pytest.mark.parametrize("bits", [64, 1, 0])
def test_exact_duplicates(spark, bits):
    """Short digests collide; results stay the same. Small batches exercise the state."""
    ids = [5, 3, 4, 9, 8, 2, 1, 0, 11, 10, 7, 6]
    made = docs(spark, TEXTS, ids).withColumn("digest", F.lit(1)).withColumn("n", F.lit("z")).repartition(5)
    got = exact_dedup.exact_duplicates(made, digest_of=lambda sha: F.substring(sha, 1, bits), bytes_per_batch=900).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(list(zip(ids, TEXTS, strict=True)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_edges(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    repeated = exact_dedup.exact_duplicates(docs(spark, ["q", "q", "q"], [1, 1, None])).collect()
    assert [r.kept for r in repeated].count(True) == 1 and {r.keep_id for r in repeated} == {1}
    kept = exact_dedup.drop_exact_duplicates(docs(spark, ["q", "q", "r"], [1, 1, 2]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


KIND = "doc_id long, sha string, __file string, __row long, digest string"


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """A repeated load counts nothing twice; another load finds the digests of the first in the state."""
    folder = str(tmp_path / "state")
    one = spark.createDataFrame([(3, "s", "f", 0, "d"), (4, "t", "f", 1, "e")], KIND)
    two = spark.createDataFrame([(1, "s", "g", 0, "d"), (7, "s", "g", 1, "d")], KIND)

    def run(made, load):
        return {r.digest: (r.first.doc_id, r.n) for r in exact_dedup.run_stream(made, folder, 1, load).collect()}

    for _ in range(2):
        assert run(one, "a") == {"d": (3, 1), "e": (4, 1)}
    for _ in range(2):
        assert run(two, "b") == {"d": (1, 3), "e": (4, 1)}
    with pytest.raises(ValueError, match="load"):
        exact_dedup.run_stream(one, folder, 1, "../x")


def test_interrupted_load_is_taken_in_once(spark, tmp_path):
    """Stored whole but not streamed, and stored in part: both as if nothing had happened."""
    one = spark.createDataFrame([(3, "s", "f", 0, "d"), (4, "t", "f", 1, "e")], KIND)
    for name, done in (("whole", True), ("part", False)):
        folder = str(tmp_path / name)
        one.write.parquet(f"{folder}/in/load-a")
        if not done:
            os.remove(f"{folder}/in/load-a/_SUCCESS")
        assert {r.digest: r.n for r in exact_dedup.run_stream(one, folder, 1, "a").collect()} == {"d": 1, "e": 1}


def test_later_loads_meet_the_state(spark, tmp_path):
    state = str(tmp_path / "state")
    for load, texts, ids in (("a", ["x  y", "z", "x y"], [1, 2, 3]), ("b", ["z", "new", "x\ty"], [11, 12, 13])):
        docs(spark, texts, ids).write.parquet(str(tmp_path / load))
        made = spark.read.parquet(str(tmp_path / load))
        for _ in range(2):
            got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(made, state_dir=state, load=load).collect()}
            assert got == ({1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)} if load == "a" else {11: (2, 2, False), 12: (12, 1, True), 13: (1, 3, False)})
    kept = exact_dedup.drop_exact_duplicates(made, state_dir=state, load="b")
    assert [r.doc_id for r in kept.collect()] == [12]


def test_bytes_are_compared_with_earlier_loads(spark, tmp_path):
    """Digests shortened to nothing collide across loads; the text that the state points at tells rows apart."""
    state = str(tmp_path / "state")
    for load, texts, ids in (("a", ["x", "x"], [1, 2]), ("b", ["y", "x"], [3, 4])):
        docs(spark, texts, ids).write.parquet(str(tmp_path / load))
        got = exact_dedup.exact_duplicates(spark.read.parquet(str(tmp_path / load)), digest_of=lambda sha: F.lit(""), state_dir=state, load=load)
        got = {r.doc_id: (r.keep_id, r.kept) for r in got.collect()}
    assert got == {3: (3, True), 4: (1, False)}


def test_rows_that_share_a_place_are_told_apart(spark, tmp_path):
    """Rows that come out of a scan several times, and rows brought together."""
    docs(spark, ["a b c d", "e f g h"]).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    twice = stored.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = stored.join(spark.range(2).withColumnRenamed("id", "k"))
    union = stored.union(stored).withColumn("k", F.lit(0))
    for made in (twice, joined, union):
        got = exact_dedup.exact_duplicates(made).collect()
        assert sorted((r.keep_id, r.group_size) for r in got) == [(0, 2), (0, 2), (1, 2), (1, 2)] and sum(r.kept for r in got) == 2
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        left = drop(twice.withColumn("__file", F.lit(1)).withColumn("__row", F.lit(2)))
        assert left.columns[-2:] == ["__file", "__row"] and sorted(r.doc_id for r in left.collect()) == [0, 1]


@pytest.mark.parametrize("most", [8192, 2])
def test_rows_are_dropped_by_place(spark, monkeypatch, tmp_path, most):
    """By bitmaps that are broadcast at once, and for some files after the others."""
    from stowage.llm import common

    monkeypatch.setattr(common, "BITMAPS", most)
    spark.range(0, 100_000, 1, 3).withColumn("text", F.col("id").cast("string")).write.parquet(str(tmp_path / "t"))
    located = common.with_locator(spark.read.parquet(str(tmp_path / "t")))
    gone = located.where("doc.id % 7 = 0 OR doc.id IN (1, 32767, 32768, 33333)").select("__file", "__row")
    left = common.without_rows(located, gone)
    assert left.columns == ["id", "text"]
    assert sorted(r.id for r in left.select("id").collect()) == [i for i in range(100_000) if i % 7 and i not in (1, 32767, 32768, 33333)]
