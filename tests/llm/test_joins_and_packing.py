"""Search, packing, near-duplicates and resampling against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from proplake.llm import maxscore, neardup, packing, resampling
from pyspark.sql import functions as F

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# search

def best(vectors, queries, k):
    held = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(held):
        if queries(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for k, (i, w) in enumerate(held) if k != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def vectors(seed, n, width, spread):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(draw.normal(0, spread, width), 2)]) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(1, 400, 16, 0.2), vectors(2, 60, 3, 0.01), [(i, [0.0, 0.0]) for i in range(20)], [(i, [-1.0 - i, 0.5]) for i in range(60)], [(0, [1.0])], [],
    [*vectors(3, 120, 4, 1), (None, [1.0] * 4), (200, None), (250, [1.0, None, 1.0, 1.0]), (300, [float("nan")] * 4), (350, [float("inf")] * 4), (50, [9.0] * 4), (0, [0.0]), (400, []), *vectors(3, 30, 4, 1)],
    [(i, [1.0, 1.0]) for i in range(150)] + [(200 + i, [0.01 * i, -1.0]) for i in range(100)],
    [(50, [1.0, 0.5]), (1, [0.1, 0.1]), (1, [5.0, 5.0]), (2, [1.0, 1.0]), *[(50, [1.0, 0.5])] * 9, *[(3, [2.0, 2.0])] * 20, (100, [0.0, 0.0]), (100, [0.0, -1.0])],
])
def test_search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert rows_of(maxscore.search_digest(df)) == best(rows, lambda i: i % 50 == 0, 5)
    small = maxscore.search(maxscore.scaled(df), F.col("vec_id") % 3 == 0, k=2, shard=40, query_block=7)
    assert rows_of(small) == best(rows, lambda i: i % 3 == 0, 2)


# packing

def test_best_fit_takes_the_tightest_compatible_bin():
    draw = np.random.default_rng(0)
    for capacity in (10, 50):
        sizes = sorted((int(x) for x in draw.integers(0, capacity + 1, 400)), reverse=True)
        sources, clusters = draw.integers(-1, 6, 400).tolist(), draw.integers(-1, 90, 400).tolist()
        got = packing.best_fit(sizes, sources, clusters, capacity)
        left, held = [], []
        for size, source, cluster, chosen in zip(sizes, sources, clusters, got):
            fits = [b for b in range(len(left)) if left[b] >= size and not ((0, source) in held[b] or (1, cluster) in held[b])]
            want = min(fits, key=lambda b: (left[b], b)) if fits else len(left)
            if want == len(left):
                left.append(capacity)
                held.append(set())
            assert chosen == want
            left[want] -= size
            held[want] |= {(0, source)} if source >= 0 else set()
            held[want] |= {(1, cluster)} if cluster >= 0 else set()


def test_pack_keeps_every_byte_and_every_rule(documents, edge, nothing):
    for df, capacity, group in ((documents, 2_000, 50), (edge, 1_000, 40), (edge, 1_000_000, 4_096)):
        items = packing.items(df)
        placed = packing.pack(items, capacity, group).collect()
        want = Counter()
        for r in items.collect():
            starts = range(0, max(1, r["size"]), capacity)
            want.update((r["doc_id"], n, start, min(capacity, r["size"] - start)) for n, start in enumerate(starts))
        assert Counter((p["doc_id"], p["piece"], p["start"], p["size"]) for p in placed) == want
        source = {r["doc_id"]: r["source"] for r in items.collect() if r["doc_id"] is not None}
        cluster = {r["doc_id"]: r["cluster"] for r in items.collect() if r["doc_id"] is not None}
        bins = defaultdict(list)
        for p in placed:
            bins[p["bin"]].append(p)
        for held in bins.values():
            assert sum(p["size"] for p in held) <= capacity
            for of in (source, cluster):
                values = [of[p["doc_id"]] for p in held if of.get(p["doc_id"]) is not None]
                assert len(values) == len(set(values))
    assert packing.pack(packing.items(nothing)).count() == 0


def test_near_copies_never_share_a_bin(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:k] + [f"other{k}"] + base[k + 1:]) for k in range(0, 400, 80)] + [" ".join(base), " \n", " \n"]
    rows = [(i if i % 3 else None, t, f"src{i}") for i, t in enumerate(texts)] + [(90 + i, f"stranger {i}", f"far{i}") for i in range(3)]
    items = packing.items(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    clusters = {r["source"]: r["cluster"] for r in items.collect()}
    assert len(clusters) == len(rows) and len({clusters[f"src{i}"] for i in range(6)}) == 1 and clusters["src6"] == clusters["src7"]
    assert len(set(clusters.values())) == 5
    bins = Counter(r["bin"] for r in packing.pack(items).filter("size > 1000").collect())
    assert len(bins) == 6 and set(bins.values()) == {1}


# near-duplicates

def word_sets(rows, n=5):
    out = defaultdict(list)
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        out[doc].append(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def components(rows, percent=85):
    sets = word_sets(rows)
    flat = [(d, s) for d, held in sets.items() for s in held if d is not None and s]
    parent = {d: d for d, _ in flat}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by_shingle = defaultdict(set)
    for k, (_, s) in enumerate(flat):
        for x in s:
            by_shingle[x].add(k)
    for k, (d, s) in enumerate(flat):
        common = Counter(o for x in s for o in by_shingle[x] if o < k)
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(flat[o][1]) - n):
                a, b = sorted((root(d), root(flat[o][0])))
                parent[b] = a
    return sets, {d: root(d) for d in parent}


def expected(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets, roots = components(rows)
    return sorted(((d, len(s), roots.get(d, d), d is None or roots.get(d, d) == d) for d, held in sets.items() for s in held), key=repr)


def near_copies(n, words, edits, seed=0):
    """Copies of one text with a few words changed, some of them chained."""
    draw = np.random.default_rng(seed)
    base = [f"w{x}" for x in draw.integers(0, 5_000, words)]
    texts = []
    for _ in range(n):
        own = list(base)
        for at in draw.integers(0, words, draw.integers(0, edits + 1)):
            own[at] = f"x{draw.integers(0, 40)}"
        texts.append(" ".join(own))
        if draw.random() < 0.2:
            base = own
    return texts


def test_neardup_digest(spark, documents, edge, nothing):
    chained = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(300, 120, 5))], "doc_id bigint, text string")
    for df in (documents, edge, chained):
        assert rows_of(neardup.neardup_digest(df)) == expected(df)
    assert neardup.neardup_digest(nothing).count() == 0
    kept = neardup.first_of_each(chained)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c, _ in expected(chained) if d == c) and kept.columns == chained.columns


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2_000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(200, 90, 4, seed=4))], "doc_id bigint, text string")
    assert rows_of(neardup.neardup_digest(df)) == expected(df)


def test_shingles_match_words():
    texts = ["A b\tc d e f", "a B c  d\ne", "a b", "A B", "", " \n", "é É", "a b c d e f a b c d e f", "ab" * 5_000 + " x y z w v", "a b c d"]
    owner, found = neardup.shingles([t.encode() for t in texts])
    sets = word_sets(enumerate(texts))
    names = {}
    for k in range(len(texts)):
        mine = found[owner == k].tolist()
        assert len(mine) == len(sets[k][0])
        for j in range(k):
            other = set(found[owner == j].tolist())
            assert len(other & set(mine)) == len(sets[k][0] & sets[j][0])
    assert not names


def test_a_nul_is_of_its_word():
    texts = ["a\0b c", "\0", "a\0b c d e f g", "A\0B c d e f x", "a b c d e f g", "\0\0 \0"]
    owner, found = neardup.shingles([t.encode() for t in texts])
    sets = word_sets(enumerate(texts))
    for k in range(len(texts)):
        assert (owner == k).sum() == len(sets[k][0])
        for j in range(k):
            assert len(set(found[owner == k].tolist()) & set(found[owner == j].tolist())) == len(sets[k][0] & sets[j][0])


# resampling

@pytest.fixture(scope="module")
def judged(spark):
    """Good, junk and toxic texts over one vocabulary, two thirds of them labelled."""
    draw = np.random.default_rng(8)
    words = [f"word{i}" for i in range(600)]
    rows, labels = [], []
    for i in range(3_000):
        text = [words[int(x)] for x in draw.zipf(1.4, int(draw.integers(20, 200))) % 600]
        toxic, junk = i % 10 == 3, i % 10 == 7
        if toxic:
            for at in draw.integers(0, len(text), max(3, len(text) // 12)):
                text[int(at)] = f"slur{int(draw.integers(0, 5))}"
        if junk:
            text = [w + "$$$" for w in text]
        rows.append((i, " ".join(text), None, "s", 1))
        if i % 3:
            labels.append((i, 0 if junk else 1, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string, log_weight string, n_chars bigint").repartition(6),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_held_out_accuracy(judged):
    rows = {r["doc_id"]: r for r in resampling.resampling_digest(*judged).collect()}
    assert len(rows) == 3_000
    share = lambda wanted: np.mean([rows[i]["kept"] for i in range(0, 3_000, 3) if wanted(i % 10)])  # noqa: E731  without labels
    good, toxic, junk = (share(w) for w in (lambda r: r not in (3, 7), lambda r: r == 3, lambda r: r == 7))
    assert good > 0.98 and toxic < 0.05 and junk < 0.02, (good, toxic, junk)


def test_weights_are_log_ratios_and_top_k_is_exact(judged, spark):
    documents, labels = judged
    model = resampling.fit(documents, labels)
    _, rows, cut = resampling.sample(documents, labels)
    keys = sorted((r["key"] for r in rows.collect()), reverse=True)
    k = sum(r["log_weight"] >= model.threshold for r in rows.collect())
    assert cut == keys[k - 1]
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r["log_weight"] for r in rows.collect()}
    for i in list(texts)[:50]:
        owner, bucket = resampling.buckets([texts[i].encode()])
        w = texts[i].split()
        assert len(set(w) | set(zip(w, w[1:]))) - 8 <= len(bucket) <= len(set(w) | set(zip(w, w[1:]))) + 5 and abs(got[i] - sum(model.ratio[b] for b in bucket)) < 1e-4
    kept = resampling.accepted(documents, labels)
    assert kept.columns == documents.columns and kept.count() == sum(x >= cut for x in keys)


def test_counts_cover_every_document(judged, spark):
    documents, labels = judged
    raw, target = resampling._count(documents, resampling.labelled(labels))
    texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    fitted = {r["doc_id"] for r in resampling.labelled(labels).filter("good AND NOT held").collect()}
    for counts, wanted in ((raw, texts), (target, fitted)):
        _, bucket = resampling.buckets([texts[i] for i in sorted(wanted)])
        assert (counts == np.bincount(bucket, minlength=len(counts))).all()


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(0, 1, 500)] + [1.5] * 40 + [-1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 37, 60, 300, 541, 542, 900):
        assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_gumbel_noise(spark):
    noise = [r[0] for r in spark.range(20_000).select(resampling.gumbel("id")).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.05 and abs(np.var(noise) - np.pi**2 / 6) < 0.1


def test_resampling_of_awkward_tables(edge, nothing, spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    assert resampling.resampling_digest(edge, labels).count() == edge.count()
    assert resampling.resampling_digest(nothing, labels).count() == 0
    unlabelled = resampling.resampling_digest(edge, labels.limit(0))
    assert unlabelled.filter("kept").count() == edge.count() and unlabelled.filter("log_weight <> 0").count() == 0


def test_runs_of_a_word_end_with_the_text():
    texts = [b"a x x", b"x x x b", b"", b"x", b"x x"]
    owner, bucket = resampling.buckets(texts)
    for k, text in enumerate(texts):
        assert bucket[owner == k].tolist() == resampling.buckets([text])[1].tolist()
