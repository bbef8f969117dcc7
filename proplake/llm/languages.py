"""Language identification by rank-order profiles.

The profile of a language is the list of its most frequent character n-grams (one to three letters, words padded with a space
at both ends), learnt from all labelled texts. A document is compared by the out-of-place distance: how far each of its own most
frequent n-grams stands from its place in the profile, the length of a profile where it has none. The nearest profile wins.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 300  # n-grams of a profile, and of a document
LANGUAGES_A_PASS = 256  # profiles that one function holds
LEARN_CHARS = 8 << 20  # texts whose words a task counts before it emits
SLICE = 1 << 20  # places of a text whose n-grams are counted at once
UNDETERMINED = "und"

WORD = re.compile(r"[^\W\d_]+")  # letters, and some numerals that words_of() takes out
SPACE = 32
BITS = 21  # of a code point; a missing one is 0, so keys sort as the n-grams do


def words_of(text: str | None) -> Counter:
    """How often each lower-case run of letters stands in ``text``."""
    counts = Counter(WORD.findall(text.lower())) if text else Counter()
    for word in [w for w in counts if not w.isalpha()]:
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


def _merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(weights, firsts) if len(firsts) else weights


def gram_counts(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the n-grams of counted words, by key; a key holds three code points of 21 bits."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer((" " + " ".join(words) + " \0\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes + 1)  # of a space: those of the word behind it
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(weights), SLICE):
        w = weights[at:at + SLICE]
        first, second, third = (points[at + k:at + k + len(w)] for k in range(3))
        one, two = first << 2 * BITS, second << BITS
        letter, inner = first != SPACE, second != SPACE
        kept.append(_merged(np.concatenate((one[letter], one | two, (one | two | third)[inner])), np.concatenate((w[letter], w, w[inner]))))
    return kept[0] if len(kept) == 1 else _merged(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))


def gram_text(key: int) -> str:
    return "".join(chr(c) for c in (key >> 2 * BITS, key >> BITS & (1 << BITS) - 1, key & (1 << BITS) - 1) if c)


def most_frequent(text: str | None, places: int = PLACES) -> np.ndarray:
    """Keys of the most frequent n-grams, ties by code points; none where there is no letter."""
    keys, counts = gram_counts(words_of(text))
    return keys[np.argsort(-counts, kind="stable")[:places]]


def learn(texts: DataFrame, places: int = PLACES) -> DataFrame:
    """(lang, place, gram): the ``places`` most frequent n-grams of each language, places from 0, ties by code points.

    ``texts`` has lang and text; further columns are not read. Rows without language or letters add nothing, repeated rows count
    each time; an empty table gives an empty result. Tasks count words by language, then n-grams; only n-gram counts are exchanged.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        read = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                keys, n = gram_counts(words)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py()
                held[lang].update(words_of(text))
                read += len(text)
                if read >= LEARN_CHARS:
                    yield from counted()
                    held.clear()
                    read = 0
        yield from counted()

    known = texts.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < places)
    return ranked.select("lang", "place", "gram")


class Profiles:
    """Places of the n-grams of some languages, ascending by name."""

    def __init__(self, rows: list[tuple[str, int, int]], places: int):
        self.names = sorted({lang for lang, _, _ in rows}, key=str.encode)
        self.places = places
        self.grams = np.unique(np.array([gram for _, _, gram in rows], dtype=np.int64))
        self.table = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)  # the last column: in no profile
        number = {name: i for i, name in enumerate(self.names)}
        for lang, place, gram in rows:
            self.table[number[lang], np.searchsorted(self.grams, gram)] = place

    def nearest(self, grams: np.ndarray) -> tuple[int, str]:
        """(distance, language) of a document's n-grams in their order; ties to the smaller name."""
        column = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        found = self.table[:, np.where(self.grams[column] == grams, column, len(self.grams))]
        apart = np.where(found < 0, self.places, np.abs(found - np.arange(len(grams)))).sum(axis=1)
        least = int(np.argmin(apart))
        return int(apart[least]), self.names[least]


def _nearest(profiles: Profiles, text: Column) -> Column:
    """struct(distance, lang, grams) of each text; NULL where it has no letter."""
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            grams = most_frequent(text, profiles.places)
            out.append((*profiles.nearest(grams), len(grams)) if len(grams) else (None, None, None))
        return pd.DataFrame(out, columns=["distance", "lang", "grams"]).astype({"distance": "Int64", "grams": "Int64"})

    return F.pandas_udf(run, "distance bigint, lang string, grams bigint")(text)


def identified(documents: DataFrame, profiles: DataFrame, text: str = "text", into: str = "lang_pred", score: str = "score", places: int = PLACES) -> DataFrame:
    """``documents``, every row kept, with the nearest language of the whole text and its score from 0 to 1.

    The score is 1 minus the distance over the largest possible one. NULL texts, texts without a letter and all texts where
    there is no profile get 'und' and 0.0. Columns already named ``into`` or ``score`` are replaced, others stay whatever their
    names; repeated rows get equal results. No shuffle. The driver holds ``places`` short rows for each language; more than
    LANGUAGES_A_PASS languages are compared in several functions and their nearest taken.
    """
    rows = sorted(((r["lang"], r["place"], r["gram"]) for r in profiles.collect()), key=lambda r: (r[0].encode(), r[1]))
    names = sorted({r[0] for r in rows}, key=str.encode)
    blocks = [set(names[i:i + LANGUAGES_A_PASS]) for i in range(0, len(names), LANGUAGES_A_PASS)]
    nearest = [_nearest(Profiles([r for r in rows if r[0] in block], places), F.col(text)) for block in blocks]
    nothing = F.lit(None).cast("struct<distance:bigint,lang:string,grams:bigint>")
    free = "nearest"
    while free in documents.columns:
        free += "_"
    held = documents.select("*", (F.least(*nearest) if len(nearest) > 1 else nearest[0] if nearest else nothing).alias(free))
    found = F.col(free)
    new = {into: F.coalesce(found["lang"], F.lit(UNDETERMINED)),
           score: F.coalesce(1 - found["distance"] / (found["grams"] * F.lit(float(places))), F.lit(0.0))}
    return held.select(*[f"`{c}`" for c in documents.columns if c not in new], *[column.alias(name) for name, column in new.items()])


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from: those whose crc32 of the id leaves 2 when divided by 4; NULL ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learnt from those that are not held out."""
    apart = documents.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    profiles = learn(apart.filter("NOT held_out"))
    return identified(apart.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


# Every step of a checksum as a list to fold: a byte, then eight shifts.
LANGUAGE_SQL = r"""
WITH ids AS (SELECT *, row_number() OVER () AS n, CASE WHEN doc_id IS NULL THEN false ELSE xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 4 = 2 END AS held_out FROM documents),
words AS (SELECT n, lang, held_out, ' ' || w || ' ' AS w, count(*) AS k FROM (SELECT n, lang, held_out, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM ids) GROUP BY ALL),
placed AS (SELECT n, lang, held_out, w, k, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT n, lang, held_out, k, unnest([w[i:i], w[i:i + 1], w[i:i + 2]]) AS g, unnest([1, 2, 3]) AS size, len(w) - i + 1 AS rest, w[i + 1:i + 1] AS inner_letter FROM placed),
valid AS (SELECT n, lang, held_out, k, g FROM grams WHERE size <= rest AND g <> ' ' AND (size < 3 OR inner_letter <> ' ')),
own AS (SELECT n, g, row_number() OVER (PARTITION BY n ORDER BY sum(k) DESC, g) - 1 AS place FROM valid GROUP BY n, g QUALIFY place < 300),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(k) DESC, g) - 1 AS place FROM valid WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY place < 300),
sizes AS (SELECT n, count(*) AS size FROM own GROUP BY n),
apart AS (SELECT s.n, s.size, l.lang, 300 * s.size - coalesce(m.saved, 0) AS distance FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM profile) l
  LEFT JOIN (SELECT o.n, p.lang, sum(300 - abs(o.place - p.place)) AS saved FROM own o JOIN profile p ON o.g = p.g GROUP BY ALL) m ON m.n = s.n AND m.lang = l.lang),
best AS (SELECT * FROM apart QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, lang) = 1)
SELECT i.doc_id, i.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - CAST(b.distance AS DOUBLE) / CAST(300 * b.size AS DOUBLE), 0.0) AS score
FROM ids i LEFT JOIN best b ON b.n = i.n"""
