"""Language model, shards, search, near-duplicates and the pipeline, against brute force on small fixtures."""

import collections
import functools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import katz, maxscore, minhash, queries, shards, shingles
from heddle.llm.common import crc_mod, new_path, shared_dir
from heddle.llm.word_ids import pack

ODD = [None, "", "  ", "one", "A b c d", "a B c d", "a b c d e", "x " * 400, "é漢 字", "a b c d e f g", "a b c d e f g"]


def words(text):
    return (text or "").encode().lower().split()


def corpus(n=160, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=rng.randint(1, 60))) for _ in range(n)]
    return texts + ODD


# -- language model ---------------------------------------------------------------------------


def katz_by_hand(texts, held, order):
    """Counts of every level over padded texts, and p(w | h) by recursion on the length of h."""
    rows = [[*words(t), "END"] for t in texts]
    c = [collections.Counter() for _ in range(order)]  # c[k]: (k words, word)
    for row, out in zip(rows, held, strict=True):
        if not out:
            padded = ["BEGIN"] * (order - 1) + row
            for i in range(order - 1, len(padded)):
                for k in range(order):
                    c[k][tuple(padded[i - k : i + 1])] += 1
    n, v = sum(c[0].values()), len(c[0])
    spectrum = lambda x: [0] + [sum(m == r for m in x.values()) for r in range(1, katz.K + 2)]
    d = [katz.discounts(spectrum(x)) for x in c]
    cut = lambda k, m: d[k][min(m, katz.K + 1)] * m
    kept = sum(cut(0, m) for m in c[0].values())
    total = n if n and 1 - kept / n > 1e-9 else n + 1
    after = collections.defaultdict(list)
    for k in range(1, order):
        for gram, m in c[k].items():
            after[gram[:-1]].append((gram[-1], m))

    @functools.cache
    def weight(h):
        count, freed = sum(m for _, m in after[h]), sum(cut(len(h), m) for _, m in after[h])
        below = count if 1 - freed / count >= 1e-9 else count + 1
        return below, (1 - freed / below) / (1 - sum(p(h[1:], x) for x, _ in after[h]))

    def p(h, w):
        if not h:
            return cut(0, c[0][(w,)]) / total if c[0][(w,)] else 1 - kept / total
        if h not in after:
            return p(h[1:], w)
        below, alpha = weight(h)
        return cut(len(h), c[len(h)][(*h, w)]) / below if c[len(h)][(*h, w)] else alpha * p(h[1:], w)

    return rows, c[0], n, v, p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_equals_brute_force(spark, order):
    texts = corpus(120 if order > 2 else 160)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    rows, c, n, v, p = katz_by_hand(texts, held, order)
    tables = {t.name for t in spark.catalog.listTables()}
    got = {r.doc_id: r for r in katz.score(docs, crc_mod(F.col("doc_id"), 7) == 2, order=order).collect()}
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert len(got) == len(texts)
    histories = set()
    for i, row in enumerate(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(row), sum(c[w,] > 0 for w in row), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w,] + 1) / (n + v + 1)) for w in row), rel=1e-9)
        padded = ["BEGIN"] * (order - 1) + row
        own = [tuple(padded[j : j + order - 1]) for j in range(len(row))]
        histories.update(own[:2])
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(own, row, strict=True)), rel=1e-9)
    for h in [*sorted(histories, key=str)[:30], ("never",) * (order - 1)]:
        assert sum(p(h, w) for (w,) in c) + p(h, "not a word") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [1, 3])
def test_katz_from_stored_tables(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "GROUP_BYTES", 2000)
    monkeypatch.setattr(katz, "RANGE_BYTES", 1000)
    texts = corpus(100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learnt, other = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    whole = katz.score(docs, F.col("doc_id") % 3 == 0, order=order)
    model = katz.train(learnt, order=order)
    want = {r.doc_id: r for r in whole.where("held_out").collect()}
    got = {r.doc_id: r for r in model.score(other).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[i].n_tokens, want[i].n_known, want[i].train_tokens)
        assert r.score == pytest.approx(want[i].score, rel=1e-12) and r.base_score == pytest.approx(want[i].base_score)
    assert {r.doc_id for r in model.score(learnt).collect()} == {i for i in range(len(texts)) if i % 3}


def test_katz_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    rows = katz.score(docs, F.lit(True)).collect()
    assert [r.score for r in rows] == [0.0, 0.0] and {r.train_tokens for r in rows} == {0}
    assert katz.score(docs.limit(0), F.lit(False)).collect() == []


def test_discounts_never_raise_a_count():
    for spectrum in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 100, 40, 20, 12, 8, 5], [0, 1, 50, 1, 1, 1, 99]):
        d = katz.discounts(spectrum)
        assert (d > 0).all() and (d <= 1).all()


# -- shards -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    assert sorted(shards.Permutation(n, "k")(np.arange(n)).tolist()) == list(range(n))


def test_shards_round_trip_and_resume(spark):
    texts = corpus(60)
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folder = new_path(spark, "test-shards")
    manifest = shards.write(docs, folder, queries.WORD_TOKENIZER, length=16, per_shard=10)
    got = {r.slot: bytes(r.ids) for r in shards.read(spark, folder, manifest).collect()}
    assert sorted(got) == list(range(manifest["sequences"]))
    order = shards.Permutation(manifest["sequences"], manifest["key"])(np.arange(manifest["sequences"]))
    stream = np.frombuffer(b"".join(got[int(s)] for s in order), "<u2")[: manifest["tokens"]]
    assert manifest["tokens"] == sum(len(b) // 4 for b in pack(pa.array(texts), queries.WORD_TOKENIZER, 2))
    want = collections.Counter(np.frombuffer(b, "<u4").astype("<u2").tobytes() for b in pack(pa.array(texts), queries.WORD_TOKENIZER, 2))
    ends = np.flatnonzero(stream == 2) + 1  # no text of the fixture holds the end id's character
    assert collections.Counter(x.tobytes() for x in np.split(stream, ends)[:-1]) == want
    files = shards._sizes(spark, f"{folder}/shards")
    assert all(len(v) == 1 and v[0][1] == manifest["stride"] * min(10, manifest["sequences"] - 10 * k) for k, v in files.items())
    lost = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shards/shard=1")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, True)
    assert shards.write(docs, folder, queries.WORD_TOKENIZER, length=16, per_shard=10, resume=True) == manifest
    assert {r.slot: bytes(r.ids) for r in shards.read(spark, folder, manifest).collect()} == got
    assert shards.read(spark, folder, manifest, first=25).count() == manifest["sequences"] - 25
    with pytest.raises(ValueError, match="another manifest"):
        shards.write(docs, folder, queries.WORD_TOKENIZER, length=16, per_shard=12, resume=True)


def test_shards_keep_doc_id_order_in_every_part_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(shards, "PARTS", 5)
    texts = corpus(60)
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    options = {"length": 16, "per_shard": 10}

    def stream(own, **more):
        folder = new_path(spark, "test-order")
        manifest = shards.write(own, folder, queries.WORD_TOKENIZER, **options, **more)
        got = {r.slot: bytes(r.ids) for r in shards.read(spark, folder, manifest).collect()}
        order = shards.Permutation(manifest["sequences"], manifest["key"])(np.arange(manifest["sequences"]))
        return b"".join(got[int(s)] for s in order)[: 2 * manifest["tokens"]]

    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text", tie.alias("tie"), F.pmod(F.xxhash64("doc_id", tie), F.lit(5)).alias("part")).collect()
    keyed.sort(key=lambda r: (r.part, r.doc_id is not None, r.doc_id or 0, r.tie))
    want = b"".join(np.frombuffer(b, "<u4").astype("<u2").tobytes() for b in pack(pa.array([r.text for r in keyed], pa.string()), queries.WORD_TOKENIZER, 2))
    assert stream(docs.repartition(1), partitions=3) == stream(docs.repartition(7, "text"), partitions=8) == stream(docs) == want


def test_shards_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.materialise_order(empty, queries.WORD_TOKENIZER).count() == 0


# -- search ---------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)]  # ties
    rows += [(50, rows[50][1]), (400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, [0.5] * 3), (450, [-0.2] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(4)
    usable = [(i, np.floor(np.array(np.array(v, np.float32), float) * 256)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (q, x) in enumerate(usable):
        if q % 50 == 0:
            scores = sorted((-int(sum(x[j] * y[j] for j in range(min(len(x), len(y))))), i) for b, (i, y) in enumerate(usable) if b != a)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    got = maxscore.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert maxscore.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).count() == 2
    assert maxscore.top_k(df.limit(0), F.lit(True), 5).count() == 0


def by_hand(rows, k):
    want = []
    for a, (q, x) in enumerate(rows):
        scores = sorted((-sum(i * j for i, j in zip(x, y, strict=False)), v) for b, (v, y) in enumerate(rows) if b != a)
        want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return sorted(want)


@pytest.mark.parametrize("scale", [1.0, 1e7, 3e9])
def test_top_k_of_components_beyond_32_bits(spark, scale):
    """Products beyond 2^53, and sums whose bound passes 64 bits though no returned score does."""
    rng = random.Random(int(scale))
    rows = [(i, [rng.choice([-1, 1]) * (scale + rng.randint(0, 9)) * (1 if j % 2 else -1) / 256 * 0.4 for j in range(2)]) for i in range(60)]
    rows += [(60, [1.5e7, 1.0]), (61, [0.0, 0.0]), (62, [])]
    exact = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, maxscore.top_k(df, F.lit(True), 4).collect())) == by_hand(exact, 4)


def test_top_k_says_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [1e18]), (2, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="needs more than 64 bits"):
        maxscore.top_k(df, F.lit(True), 1).collect()


def test_top_k_in_many_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 250, [float(x) for x in rng.normal(0, 0.5, rng.integers(1, 9))]) for i in range(400)] + [(7, [0.25] * 8)] * 90
    for name, value in (("SHARD_ROWS", 40), ("BLOCK_ROWS", 25), ("SHARDS_A_GROUP", 2), ("SAMPLE", 30)):
        monkeypatch.setattr(maxscore, name, value)
    exact = [(i, [math.floor(x * 256) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert sorted(map(tuple, maxscore.top_k(df, F.lit(True), 3).collect())) == by_hand(exact, 3)


# -- near-duplicates ----------------------------------------------------------------------------------


def components_by_hand(texts, similarity):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(texts))]


def near_copies(seed, groups, size, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"t{rng.randint(0, 400)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, size)):
            copy = base[:]
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["the"], [f"u{rng.randint(0, 99)}"], [copy[k], copy[k]]])
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("similarity", [85, 80])
def test_components_equal_brute_force(spark, similarity):
    texts = near_copies(similarity, 12, 40, 9) + ODD
    sets, want = components_by_hand(texts, similarity)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(5)
    rows = {r.doc_id: r for r in minhash.near_duplicates(df, similarity).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}
    assert sum(r["first"] for r in rows.values()) == len(set(want))


def test_one_document_of_each_group_stays(spark):
    texts = near_copies(3, 5, 8, 2) + ["same text of five words"] * 6 + [None, "", ""]
    df = spark.createDataFrame([(7 if t and t.startswith("same") else i if i % 4 else None, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = minhash.deduplicate(df, 80)
    assert kept.columns == df.columns
    assert kept.count() == len(set(components_by_hand(texts, 80)[1]))
    assert minhash.deduplicate(df.limit(0), 80).count() == 0


def test_one_centre_of_many_members(spark, monkeypatch):
    """A centre with thousands of members is compared in shares; stray texts stay apart; no table of the run is left."""
    monkeypatch.setattr(minhash, "SHARE", 64)
    base = [f"b{i}" for i in range(45)]
    texts = [" ".join([*base, f"own{i}"]) for i in range(3000)] + [" ".join(f"{i}w{j}" for j in range(20)) for i in range(50)] + ["tail " * 700_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    listed = lambda: {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    before = listed()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 85).collect()}
    assert got == {i: 0 if i < 3000 else i for i in range(len(texts))}
    assert len(listed() - before) == 1  # the result


def test_a_set_is_named_by_all_its_members():
    sets = [np.arange(n, dtype=np.uint64) for n in (0, 1, 2, 50)] + [np.array([1], np.uint64)]
    assert len({shingles.set_key(s) for s in sets}) == 5 and shingles.set_key(sets[3]) == shingles.set_key(sets[3].copy())


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 300).astype(np.uint64)])
    x, y = shingles.circulant_signatures([np.unique(a), np.unique(b)], 1024)
    assert abs((x == y).mean() - 700 / 1300) < 0.06
    assert len(np.unique(shingles.permutation(np.arange(100_000, dtype=np.uint32), 7))) == 100_000


# -- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(80)) for _ in range(40)]
    texts = clean + [clean[0] + " end", clean[1]] + [t + " vilefool" for t in clean[2:12]] + ["short", None, "of " * 90] + [f'{clean[20]} x token = "3c4226790fc3f8022bcc4434e93601b2005f1325" y']
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(42 <= i < 52)) for i in range(52)] , "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
            seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(seen["quality_rules"]) <= set(seen["toxicity"]) and not {52, 53, 54} & set(seen["quality_rules"])
    assert len(seen["near_duplicates"]) < len(seen["quality_rules"]) and 40 not in seen["near_duplicates"] and 41 not in seen["near_duplicates"]
    assert set(seen["secret_scan"]) == set(seen["near_duplicates"])
    assert not any("3c4226790f" in t for t in seen["secret_scan"].values())
    assert set(range(12, 40)) - set(seen["near_duplicates"]) <= {20}
    assert {r.doc_id for r in now.collect()} == set(seen["secret_scan"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_on_empty_and_null_documents(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None, None, None, None, None), (None, "", None, None, 0), (1, None, "en", "s", None)]):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
            kept = out.count()
            # an untrained model rejects nothing; too few words fail the quality rules
            assert kept == (0 if name == "quality_rules" else len(rows)), name
            if name != "packing":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
