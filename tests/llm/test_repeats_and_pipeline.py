"""Repeated passages and the pipeline's stages against plain Python."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest

from proplake.llm import packing, repeats, resampling, secrets
from proplake.llm.suffixes import sort_suffixes


def corpus_order(df):
    """(doc_id, bytes) of the documents as they are taken: NULL ids first, equal ids by checksum, rows that repeat another once."""
    import zlib

    rows = {(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1])))


def masks(documents):
    seen, out = set(), {}
    for doc, data in documents:
        mask = bytearray(len(data))
        for p in range(len(data) - repeats.MATCH + 1):
            window = data[p:p + repeats.MATCH]
            if window in seen:
                mask[p:p + repeats.MATCH] = b"\1" * repeats.MATCH
            seen.add(window)
        out[doc, data] = mask
    return out


def expected(df):
    found, rows = masks(corpus_order(df)), []
    for r in df.collect():
        data = (r["text"] or "").encode()
        mask = found[r["doc_id"], data]
        runs = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        rows.append((r["doc_id"], len(data), sum(mask), runs, hashlib.sha256(bytes(c for c, m in zip(data, mask) if not m)).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def shared_passages(spark, n=250, seed=0):
    """Texts around a few shared passages, some nearly equal, some periodic, not in order of their ids."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 9)))
    passages = [" ".join(word() for _ in range(draw.randint(40, 80))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40)))]
        for p in draw.sample(passages, draw.randint(0, 3)):
            start = draw.randint(0, max(0, len(p) - 110))
            parts += [p[start:start + draw.randint(90, len(p))], word()]
        if draw.random() < 0.1:
            parts.append(draw.choice(["ab" * 150, "x" * 260, "abc " * 90]))
        rows.append((draw.randint(0, 3) * 1_000 + i, " ".join(parts)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def test_repeats_digest(spark, documents, edge, nothing):
    for df in (documents, edge, shared_passages(spark)):
        assert rows_of(repeats.repeats_digest(df)) == expected(df)
    assert repeats.repeats_digest(nothing).count() == 0


@pytest.mark.parametrize("piece, all_", [(2, 512), (64, 2), (3, 5)])
def test_hot_anchors_go_by_windows(spark, monkeypatch, piece, all_):
    monkeypatch.setattr(repeats, "PIECE_HOT", piece)
    monkeypatch.setattr(repeats, "HOT", all_)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 9_000)
    df = shared_passages(spark, seed=piece)
    assert rows_of(repeats.repeats_digest(df)) == expected(df)


def test_sort_suffixes():
    draw = np.random.default_rng(0)
    for trial in range(40):
        n = int(draw.integers(1, 200))
        data = draw.integers(97, 97 + 1 + trial % 3, 1_500, dtype=np.uint8)
        start, length, group = draw.integers(0, 1_400, n), draw.integers(0, 100, n), np.sort(draw.integers(0, draw.integers(1, 20), n))
        order, common = sort_suffixes(data, start, length, group)
        got = [(int(group[i]), data[start[i]:start[i] + length[i]].tobytes()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and got == sorted(got)
        for (g, x), (h, y), c in zip(got, got[1:], common[1:]):
            assert c == (-1 if g != h else next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))


def test_collisions_are_found(monkeypatch):
    from proplake.llm import suffixes

    monkeypatch.setattr(suffixes, "SYMBOLS", suffixes.SYMBOLS[np.arange(256) // 4])  # four bytes share a symbol
    draw = np.random.default_rng(1)
    data = draw.integers(96, 104, 3_000, dtype=np.uint8)
    start, length, group = np.arange(150) * 20, np.full(150, 20), np.sort(draw.integers(0, 4, 150))
    order, common = suffixes.sort_suffixes(data, start, length, group)
    got = [(int(group[i]), data[start[i]:start[i] + 20].tobytes()) for i in order]
    assert got == sorted(got)


def test_whole_characters_stay():
    text = "aé" * 3 + "z"
    assert repeats.kept_text(text, [(2, 4)]) == "aéé" + "aéz" and repeats.kept_text(text, [(1, 5)]) == "aéaéz"


def test_stages(spark, edge):
    """Each stage on its own input, on real rows and on awkward ones."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for docs in (docs, edge.unionByName(edge.limit(0))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, after = docs.collect(), stage(spark, docs, folder)
            rows = after.collect()
            assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
            if name == "quality classifier":
                _, weights, cut = resampling.sample(docs, labels)
                kept = {(r["doc_id"], r["log_weight"]) for r in weights.collect() if r["key"] >= cut}
                assert len(rows) == sum(1 for r in weights.collect() if (r["doc_id"], r["log_weight"]) in kept) > 0.5 * len(before)
            elif name == "minhash near-dedup":
                from test_joins_and_packing import components

                _, roots = components([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.NEAR_PERCENT)
                assert sorted(map(repr, rows)) == sorted(repr(r) for r in before if roots.get(r["doc_id"], r["doc_id"]) == r["doc_id"])
            elif name == "suffix-array dedup":
                found = masks(corpus_order(docs))
                want = []
                for r in before:
                    text = r["text"]
                    if text is not None:
                        mask, at, out = found[r["doc_id"], text.encode()], 0, []
                        for c in text:
                            size = len(c.encode())
                            if not all(mask[at:at + size]):
                                out.append(c)
                            at += size
                        text = "".join(out)
                    want.append((r["doc_id"], text, r["n_chars"] if text == r["text"] else len(text)))
                assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in rows), key=repr) == sorted(want, key=repr)
            else:
                want = [(r["doc_id"], secrets._masked(r["text"])) for r in before]
                assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(want, key=repr)
                assert not any(secrets.scan_text(r["text"]) for r in rows)
                assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"])
            docs = spark.createDataFrame(rows, docs.schema)
        placed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert sum(r["size"] for r in placed.collect()) == sum(r["size"] for r in packing.items(docs).collect())


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "secret scan", "best-fit packing"]
