"""Decontamination, packing, sharding and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stowage.llm import decontaminate, packing, sharding, simhash
from stowage.llm.queries import op8_sharding
from stowage.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, 0) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOC)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


RND = random.Random(8)
LONG = " ".join(RND.choices("alpha beta gamma delta été 42 x".split(), k=30))
ITEMS = [(1, LONG), (10, LONG.upper()), (2, "rare, word"), (3, None), (4, "..."), (5, "été"), (9, "zeta " * 13)]
TEXTS = [
    None, "", "!!", LONG, "pre " + LONG.replace(" ", "-_ ") + " post", LONG[: len(LONG) // 2], "rare word", "Rare\nWORD rare word", "a été b", "ete", "zeta " * 40, "q " * 5000 + "rare word",
    " ".join(LONG.split()[:13]) + " end", " ".join(LONG.split()[:12]) + " end", "ra re word",
]


@pytest.mark.parametrize("most", [decontaminate.SMALL_WORDS, 5])
def test_decontamination(spark, monkeypatch, most):
    """With all windows broadcast, and with a bitmap of their hashes and a join."""
    monkeypatch.setattr(decontaminate, "SMALL_WORDS", most)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    made = docs(spark, TEXTS).withColumn("items", F.lit(1)).withColumn("__file", F.lit("x")).withColumn("hits", F.lit("y"))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(made, bench).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute_hits(TEXTS, ITEMS)
    kept = decontaminate.drop_contaminated(made, bench)
    assert kept.columns == made.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, h in enumerate(brute_hits(TEXTS, ITEMS)) if not h[4]]


def test_chunks_make_no_difference(monkeypatch):
    block = decontaminate.benchmark_block([(str(i), t) for i, t in ITEMS])
    maps = decontaminate._bitmaps(block)
    whole = list(decontaminate.scan_texts(TEXTS, block, maps))
    monkeypatch.setattr(decontaminate, "CHUNK", 10)
    assert list(decontaminate.scan_texts(TEXTS, block, maps)) == whole


@pytest.mark.parametrize("most", [decontaminate.SMALL_WORDS, 0])
def test_spans_are_cut_out(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "SMALL_WORDS", most)
    bench = spark.createDataFrame([(1, "rare word"), (2, "été 42")], "item_id long, text string")
    made = docs(spark, ["a é rare word, b", "Été-42", None, "none", "rare word x été 42"])
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(made, bench).collect()}
    assert got == {0: "a é , b", 1: "Été-42", 2: None, 3: "none", 4: " x "}


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(docs(spark, ["a b"]), empty).collect()] == [0]
    assert decontaminate.decontaminate(docs(spark, []), empty).count() == 0


def check_packing(rows, texts, sources, capacity):
    used, in_bin = Counter(), {}
    pieces = {}
    for r in rows:
        used[r.bin_id] += r.n_words + 1
        in_bin.setdefault(r.bin_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append((r.piece, r.first_word, r.n_words))
    assert max(used.values()) <= capacity
    for own in in_bin.values():
        assert len({sources[r.doc_id] for r in own}) == len(own)
        assert len({re.sub(r"[\x20\x09-\x0D]+", " ", texts[r.doc_id] or "") for r in own}) == len(own)
        ends = sorted((r.bin_offset, r.bin_offset + r.n_words + 1) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    for i, t in enumerate(texts):
        n, at = len((t or "").split()), 0
        for k, (piece, first, size) in enumerate(sorted(pieces[i])):
            assert (piece, first) == (k, at)
            at += size
        assert at == n
    return used


def test_packing(spark):
    rnd = random.Random(3)
    texts = ["w " * rnd.choice([0, 1, 3, 7, 20, 55]) + str(rnd.randrange(40)) for _ in range(300)] + [None, "", " ", "same"] + ["same"] * 60
    sources = [rnd.choice("abcdefgh") if i % 3 else "hot" for i in range(len(texts))]
    sources[5] = None
    rows = packing.pack(docs(spark, texts, sources).withColumn("cluster", F.lit(1)), capacity=32, group_rows=10_000).collect()
    check_packing(rows, texts, sources, 32)
    many = packing.pack(docs(spark, texts, sources), capacity=32, group_rows=50).collect()
    check_packing(many, texts, sources, 32)
    again = packing.pack(docs(spark, texts, sources).repartition(7).where("doc_id >= 0"), capacity=32, group_rows=50).collect()
    assert sorted(map(repr, many)) == sorted(map(repr, again))
    assert packing.pack(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(docs(spark, []), capacity=1)


def test_packing_does_not_depend_on_where_rows_are(spark, tmp_path):
    rnd = random.Random(4)
    made = docs(spark, [" ".join(rnd.choices("abcdefgh", k=9)) for _ in range(60)], [rnd.choice("xyz") for _ in range(60)])
    made.union(made.where("doc_id < 9")).repartition(3).write.parquet(str(tmp_path / "one"))
    made.union(made.where("doc_id < 9")).orderBy(F.desc("doc_id")).write.parquet(str(tmp_path / "two"))
    one, two = (sorted(map(repr, packing.pack(spark.read.parquet(str(tmp_path / d)), capacity=50, group_rows=20).collect())) for d in ("one", "two"))
    assert one == two and len(one) == 69


def test_repeats_are_packed_each_for_itself(spark, monkeypatch):
    monkeypatch.setattr(packing, "REPEATS", 3)
    made = docs(spark, ["a b c"]).crossJoin(spark.range(20)).drop("id")
    rows = packing.pack(made, capacity=32).collect()
    assert len(rows) == 20 and len({r.bin_id for r in rows}) == 20  # one cluster


def test_packing_with_near_duplicate_clusters(spark):
    base = " ".join(f"w{i}" for i in range(300))
    made = docs(spark, [base, base.replace("w150", "other"), "something else entirely", "w1"], ["p", "q", "r", "s"])
    found = simhash.near_duplicates(made)
    assert found.where("component_id = 0").count() == 2
    rows = packing.pack(made, capacity=1000, clusters=found.select("doc_id", F.col("component_id").alias("cluster"))).collect()
    bins = {r.doc_id: r.bin_id for r in rows}
    assert bins[0] != bins[1] and bins[2] in (bins[0], bins[1])
    few = packing.pack(made, capacity=1000, clusters=found.where("doc_id = 0").select("doc_id", F.col("component_id").alias("cluster"))).collect()
    assert len(few) == 4


def test_search_finds_the_tightest_compatible_bin():
    rnd = random.Random(7)
    bins, plain = packing.Bins(50), []
    for _ in range(1500):
        size, need, small = rnd.randrange(1, 30), 1 << rnd.randrange(12) | 1 << rnd.randrange(12, 15), rnd.choice([0, 1 << rnd.randrange(5)])
        fits = [b for b in plain if b[0] >= size and not b[1] & need and not b[2] & small and b[0]]
        number, room = bins.place(size, need, small)
        if fits:
            assert room == min(b[0] for b in fits)
            own = next(b for b in plain if b[3] == number)
            assert own in fits
        else:
            own = [50, 0, 0, number]
            plain.append(own)
            assert room == 50
        own[0], own[1], own[2] = own[0] - size, own[1] | need, own[2] | small


def greedy(sizes, capacity):
    n, at = 1, 0
    for s in sizes:
        if at + s > capacity:
            n, at = n + 1, 0
        at += s
    return n


def least(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_least(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([8, 9, 30, 500]) if rnd.random() < 0.99 else 20_000 for _ in range(3000)]
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)

    def finer(gaps):
        out = []
        for a, b in gaps:
            inside = [e for e in ends if a < e < b]
            out.append((inside[:: max(1, len(inside) // 5)], len(inside) <= 5))
        return out

    known = sorted({0, ends[-1], *ends[::700]})
    capacity, cuts = sharding.least_capacity(known, False, 24, max(sizes), finer)
    assert capacity == least(sizes, 24)
    assert len(cuts) <= 24 and cuts[-1] == ends[-1] and all(c in ends for c in cuts)
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= capacity


def test_shards(spark):
    rnd = random.Random(9)
    texts = ["hot text"] * 80 + ["t" * rnd.randrange(300) for _ in range(150)] + [None, "", "é" * 10]
    got = sharding.shard(docs(spark, texts), 5).collect()
    assert len(got) == len(texts)
    by_text, sizes = {}, Counter()
    for r in got:
        text = texts[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 8
        by_text.setdefault(text, set()).add(r.shard)
        sizes[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = sorted(by_text, key=lambda t: hashlib.sha256(t.encode()).digest())
    assert [by_text[t] for t in order] == sorted(([by_text[t] for t in order]), key=max)  # cut contiguously
    whole = [sum(len((x or "").encode()) + 8 for x in texts if (x or "") == t) for t in order]
    assert max(sizes.values()) == least(whole, 5)
    assert sharding.shard(docs(spark, []), 5).count() == 0
    assert len({r.shard for r in sharding.shard(docs(spark, ["one", "one"]), 5).collect()}) == 1


def test_repeats_get_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 3)
    made = docs(spark, ["a", "b"]).crossJoin(spark.range(10)).drop("id")
    got = sharding.shard(made, 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in (0, 1) for i in range(10)]
    one = sharding.shard(made.where("doc_id = 0"), 3).collect()
    assert sorted(r.slot for r in one) == list(range(10))


def test_sharding_query(spark):
    """The whole query against plain Python: sizes, checksums, the least capacity over the order of digests."""
    got = op8_sharding(spark, SF).collect()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows.items()}
    shard_of, sizes = {}, Counter()
    for r in got:
        assert shard_of.setdefault(rows[r.doc_id], r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r["size"]
    order = sorted(shard_of, key=lambda t: hashlib.sha256(t.encode()).digest())
    assert [shard_of[t] for t in order] == sorted(shard_of.values())
    whole = Counter()
    for t in rows.values():
        whole[t] += len(t.encode()) + 8
    assert max(sizes.values()) == least([whole[t] for t in order], 24)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_pipeline(spark):
    """The stages against plain Python on whole tables."""
    got = corpus_pipeline.run(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    left = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    seen, unique = set(), []
    for r in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if key not in seen:
            seen.add(key)
            unique.append(r)
    prints = {r.doc_id: fingerprint(r.text) for r in unique}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    near = [r for r in unique if find(r.doc_id) == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r, h in zip(near, brute_hits([r.text for r in near], items), strict=True) if not h[4]]
    assert {r.doc_id for r in got} == {r.doc_id for r in clean}
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.n_words
    assert lengths == Counter({r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean})


def test_stages_keep_columns(spark):
    made = docs(spark, ["a b c", "a b c", None, "d"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, made, SF).columns == made.columns
        assert stage(spark, made.where("false"), SF).count() == 0


def test_stages_take_columns_of_any_name_and_exploded_rows(spark):
    names = ("__file", "__row", "__f", "__b", "__bits", "doc", "hits", "lang_pred", "share", "fp", "c")
    made = docs(spark, ["a b c", "d e f"]).withColumns({c: F.lit(c) for c in names}).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, made, SF)
        assert got.columns == made.columns
        assert [(r.doc_id, r["doc"]) for r in got.orderBy("doc_id").collect()] == [(i, "doc") for i in ((0, 1) if name in ("exact_dedup", "simhash") else (0, 0, 1, 1))]
    assert len({r.bin_id for r in corpus_pipeline.STAGES[-1][1](spark, made, SF).collect()}) == 4


def test_unlabelled_corpus_is_kept(spark):
    made = docs(spark, ["a text", None, "42", "noch einer"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, made, SF).collect()) == [0, 3]
    other = docs(spark, ["ciao bella", "bella ciao"] * 5).withColumn("lang", F.lit("it"))
    assert corpus_pipeline.language(spark, other, SF).count() == 10
