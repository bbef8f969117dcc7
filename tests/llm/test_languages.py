"""Language profiles against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proplake.llm import languages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def grams(counted):
    out = Counter()
    for word, n in counted.items():
        padded = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                if padded[i:i + size] != " ":
                    out[padded[i:i + size]] += n
    return out


def ranked(counts, places):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:places]]


def expected(rows, places=300):
    by_lang = defaultdict(Counter)
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    for i, text, lang in rows:
        if not out_of(i) and lang is not None:
            by_lang[lang].update(words(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(grams(c), places))} for lang, c in by_lang.items() if c}
    out = []
    for i, text, _ in rows:
        own = ranked(grams(Counter(words(text))), places)
        best = min(((sum(abs(k - p[g]) if g in p else places for k, g in enumerate(own)), lang) for lang, p in profiles.items()), default=None)
        out.append((i, out_of(i), best[1], 1 - best[0] / (places * len(own))) if own and best else (i, out_of(i), "und", 0.0))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD = [(1, "½ ² 12 _", "en"), (2, "a½b a_b A", "en"), (3, "İstanbul ΣΑΣ ǅ", "tr"), (4, "日本語の文章 日本", "ja"), (5, None, "en"), (6, "", None), (7, "x" * 3000, "en"),
       (8, "été\0été", "fr"), (None, "a null id", "en"), (9, "tie", "zz"), (9, "tie", "aa"), (10, "no lang tie", None)]


def test_language_digest(spark, documents, edge, nothing):
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    for df in (documents, edge, odd):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
        assert rows_of(languages.language_digest(df)) == expected(rows)
    assert languages.language_digest(nothing).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in languages.language_digest(unlabelled).collect()} == {("und", 0.0)}


def test_slices_and_passes_change_nothing(spark, documents, monkeypatch):
    whole = rows_of(languages.language_digest(documents))
    monkeypatch.setattr(languages, "SLICE", 50)
    monkeypatch.setattr(languages, "LANGUAGES_A_PASS", 2)
    profiles = languages.learn(documents.filter(~languages.held_out(F.col("doc_id"))))
    assert rows_of(languages.identified(documents, profiles).select("doc_id", languages.held_out(F.col("doc_id")), "lang_pred", "score")) == whole
    counted = {"abcabc" * 40: 3, "x": 2, "été": 1}
    keys, n = languages.gram_counts(counted)
    assert dict(zip(map(languages.gram_text, keys.tolist()), n.tolist())) == dict(grams(counted))


def test_held_out_documents_are_told_apart(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = languages.language_digest(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * n


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, t, "en", i * 2, f"k{i}") for i, t in enumerate(["the cat", None, "la maison"])]
    df = spark.createDataFrame(rows, "place bigint, text string, lang string, gram bigint, nearest string").withColumn("a.b", F.lit(1))
    profiles = languages.learn(spark.createDataFrame([("en", "the cat sat"), ("fr", "la maison de la rue")], "lang string, text string"))
    out = languages.identified(df, profiles)
    assert out.columns == [*df.columns, "lang_pred", "score"]
    assert sorted((r["place"], r["gram"], r["nearest"], r["lang_pred"]) for r in out.collect()) == [(0, 0, "k0", "en"), (1, 2, "k1", "und"), (2, 4, "k2", "fr")]


@pytest.mark.parametrize("letters", [1, 2_000_000])
def test_one_very_long_word(letters):
    keys, n = languages.gram_counts({"a" * letters: 2})
    found = dict(zip(map(languages.gram_text, keys.tolist()), np.asarray(n).tolist()))
    assert found["a"] == 2 * letters and found[" a"] == found["a "] == 2 and found.get("aaa", 0) == 2 * max(0, letters - 2)
