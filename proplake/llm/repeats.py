"""Suffix-array deduplication: bytes covered by a MATCH-byte string that also starts earlier in the corpus.

Sorting all suffixes of a corpus is out of reach, and needless. Every MATCH-byte window is stood for by its anchor, the
GRAM-byte string of least hash inside it; equal windows have equal anchors at equal offsets. So only anchors are exchanged:

1. per text, the anchors with the range of windows each stands for, dealt by the anchor's hash;
2. per anchor hash, occurrences with the same whole range: all but the first repeat it entirely. Where ranges differ,
   the first of each kind is looked at closely;
3. those fetch the bytes of their range from their document;
4. per anchor hash, the suffixes from the anchor on and the reversed prefixes before it are sorted (suffixes.py). The bytes
   that neighbours share tell, for every offset of the anchor, which windows are equal; all but the first are repeats;
5. per document, the repeated windows are put together and taken out.

An anchor in very many different surroundings (the edge of a passage that a third of all documents hold) is not gathered in
one task: its windows go by their own 128-bit hashes, and equal ones are reduced to the first before they are exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplake.llm.batches import pieces
from proplake.llm.hashing import ODD, ODD2, mix
from proplake.llm.names import safe_names
from proplake.llm.suffixes import PrefixHash, sort_suffixes

MATCH = 100
GRAM = 32
OFFSETS = MATCH - GRAM + 1
PIECE_HOT = 64  # surroundings of one anchor in a piece of text from which it goes by windows
HOT = 512  # and among all
PIECE_BYTES = 1 << 19
GROUPS_PER_PARTITION = 3

FOUND = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("back", "u1"), ("fore", "u1"), ("flag", "u1")])
NORMAL, SCATTERED, MARKER, REPEATED = 0, 1, 2, 3  # flags of FOUND
ASKED = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("low", "<u4"), ("end", "<u4"), ("flag", "u1")])
SHOWN = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("back", "u1"), ("fore", "u1"), ("size", "u1")])
WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("row", "<u4"), ("low", "<u4"), ("end", "<u4")])
ROWS = "part int, kind string, packed binary, extra binary"
NAMES = ["part", "kind", "packed", "extra"]


# Rows travel in packed blocks: one per task and target, field after field, compressed.

def _pack(rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names))


def _unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    rows, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize * len(rows)
        rows[f] = np.frombuffer(raw[at:at + size], dtype[f])
        at += size
    return rows


def _blocks(target: np.ndarray, kind: str, rows: np.ndarray, texts: list[bytes] | None = None) -> list[tuple]:
    """(part, kind, packed, extra) for every target that occurs; ``texts`` go with their rows."""
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    press = zstandard.ZstdCompressor(level=3)
    return [(int(target[take[0]]), kind, _pack(rows[take]), None if texts is None else press.compress(b"".join([texts[i] for i in take])))
            for take in np.split(order, cuts) if len(take)]


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=NAMES)


def _gather(blocks: list[tuple], kind: str, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *[_unpack(b[2], dtype) for b in blocks if b[1] == kind]])


def _of_document(rows: np.ndarray, parts: int) -> np.ndarray:
    """The part a document belongs to; the same sum as ``_document_part``."""
    return (rows["doc"] % parts + rows["row"].astype(np.int64) % parts) % parts


def _document_part(parts: int) -> Column:
    return F.pmod(F.pmod("_doc", F.lit(parts)) + F.pmod("_row", F.lit(parts)), F.lit(parts)).cast("int")


def _spans(rows: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    out["doc"], out["row"], out["low"], out["end"] = rows["doc"], rows["row"], low, end
    return out


def united(spans: np.ndarray) -> np.ndarray:
    """Spans of each document put together where they overlap or touch."""
    spans = spans[np.lexsort((spans["low"], spans["row"], spans["doc"]))]
    if not len(spans):
        return spans
    fresh = np.concatenate(([True], (spans["doc"][1:] != spans["doc"][:-1]) | (spans["row"][1:] != spans["row"][:-1])))
    shifted = (np.cumsum(fresh) - 1) << 33  # documents one after another on one line
    low, end = spans["low"] + shifted, np.maximum.accumulate(spans["end"] + shifted)
    starts = np.flatnonzero(np.concatenate(([True], low[1:] > end[:-1])))
    out = spans[starts].copy()
    last = np.append(starts[1:], len(spans)) - 1
    out["end"] = end[last] - shifted[last]
    return out


# 1: anchors

def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, at, first, last, gram, around) of every anchor: its place, the first and last start of the windows it stands
    for, the hash of its GRAM bytes, and that of all bytes of its windows. Places count from the start of the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    windows = np.maximum(sizes - MATCH + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hashes = PrefixHash(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = mix(hashes.of(place, place + GRAM))
    least = gram >> np.uint64(32) << np.uint64(32) | place.astype(np.uint64)  # of equal hashes the leftmost
    width = 1
    while width * 2 <= OFFSETS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < OFFSETS:
        least = np.minimum(least[:width - OFFSETS], least[OFFSETS - width:])
    owner = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    chosen = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    runs = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    first, last = start[runs], start[np.append(runs[1:], len(start)) - 1]
    at, owner = chosen[runs], owner[runs]
    with np.errstate(over="ignore"):
        shape = ((at - first) * 256 + (at - last)).astype(np.uint64)
        around = mix(mix(hashes.of(first, last + MATCH)) + shape * ODD2)
    base = begins[owner]
    return owner, at - base, first - base, last - base, gram[at], around


def _firsts(rows: np.ndarray, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` sorted by keys and then by place in the corpus, and a mask of the first row of each key; repeats of one place go."""
    rows = rows[np.lexsort((rows["at"], rows["row"], rows["doc"], *[rows[k] for k in reversed(keys)]))]
    if not len(rows):
        return rows, np.zeros(0, bool)
    differs = lambda names: np.concatenate(([True], np.any([rows[n][1:] != rows[n][:-1] for n in names], axis=0)))
    once = differs((*keys, "doc", "row", "at"))
    return rows[once], differs(keys)[once]


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by gram: (start of each gram's rows, their number)."""
    starts = np.flatnonzero(np.concatenate(([True], rows["gram"][1:] != rows["gram"][:-1]))) if len(rows) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(rows)))


def _find(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", PIECE_BYTES):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("_text").to_pylist()]
            owner, at, first, last, gram, around = anchors(texts)
            rows = np.zeros(len(owner), FOUND)
            rows["gram"], rows["around"], rows["at"], rows["back"], rows["fore"] = gram, around, at, at - first, at - last
            rows["doc"], rows["row"] = batch.column("_doc").to_numpy()[owner], batch.column("_row").to_numpy()[owner]
            rows, is_first = _firsts(rows, "gram", "around")
            repeated, rows = rows[~is_first], rows[is_first]
            repeated["flag"] = REPEATED
            starts, size = _classes(rows)
            scattered = np.repeat(size > PIECE_HOT, size)
            markers = rows[starts[size > PIECE_HOT]]
            rows["flag"][scattered], markers["flag"] = SCATTERED, MARKER
            apart = np.concatenate((repeated, rows[scattered]))
            by_gram = np.concatenate((rows[~scattered], markers))
            yield _batch(_blocks(_of_document(apart, parts), "found", apart) + _blocks((by_gram["gram"] % np.uint64(parts)).astype(np.int64), "found", by_gram))

    return run


# 2: occurrences of each anchor

def _compare(groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.empty(0, FOUND), *[_unpack(p, FOUND) for batch in batches for p in batch.column("packed").to_pylist()]])
        marked = np.unique(rows["gram"][rows["flag"] == MARKER])
        apart = rows[(rows["flag"] == SCATTERED) | (rows["flag"] == REPEATED)]
        rows, is_first = _firsts(rows[rows["flag"] == NORMAL], "gram", "around")
        repeated, rows = rows[~is_first], rows[is_first]
        repeated["flag"] = REPEATED
        starts, size = _classes(rows)
        hot = np.repeat((size > HOT) | np.isin(rows["gram"][starts], marked), size)
        rows["flag"][hot] = SCATTERED
        rows = np.concatenate((apart, repeated, rows[hot | np.repeat(size > 1, size)]))
        asked = np.empty(len(rows), ASKED)
        for f in ("gram", "doc", "row", "at", "flag"):
            asked[f] = rows[f]
        asked["low"], asked["end"] = rows["at"] - rows["back"], rows["at"] - rows["fore"] + MATCH
        yield _batch(_blocks(_of_document(asked, groups), "asked", asked))

    return run


# 3: bytes around them

def _blocks_of(table: pa.Table) -> list[tuple]:
    return list(zip(*[table.column(n).to_pylist() for n in NAMES]))


def _show(parts: int, groups: int) -> Callable:
    def run(documents: pa.Table, blocks: pa.Table) -> pa.Table:
        asked = _gather(_blocks_of(blocks), "asked", ASKED)
        text_of = {}
        if len(asked):
            for doc, row, text in zip(documents.column("_doc").to_pylist(), documents.column("_row").to_pylist(), documents.column("_text").to_pylist()):
                text_of[doc, row] = (text or "").encode("utf-8", "surrogatepass")
        spans = [_spans(r := asked[asked["flag"] == REPEATED], r["low"], r["end"])]
        shown_from = asked[asked["flag"] == NORMAL]
        shown = np.empty(len(shown_from), SHOWN)
        for f in ("gram", "doc", "row", "at"):
            shown[f] = shown_from[f]
        shown["back"], shown["fore"], shown["size"] = shown["at"] - shown_from["low"], shown["at"] - (shown_from["end"] - MATCH), shown_from["end"] - shown_from["low"]
        around = [text_of[d, r][a:b] for d, r, a, b in zip(shown_from["doc"].tolist(), shown_from["row"].tolist(), shown_from["low"].tolist(), shown_from["end"].tolist())]
        out = _blocks((shown["gram"] % np.uint64(parts)).astype(np.int64), "shown", shown, around)
        scattered = asked[asked["flag"] == SCATTERED]
        if len(scattered):
            windows, is_first = _firsts(_windows_of(scattered, text_of), "one", "two")
            spans.append(_spans(r := windows[~is_first], r["at"], r["at"] + MATCH))
            windows = windows[is_first]
            out += _blocks((windows["one"] % np.uint64(parts)).astype(np.int64), "window", windows)
        spans = united(np.concatenate(spans))
        out += _blocks(_of_document(spans, parts), "span", spans)
        return pa.Table.from_batches([_batch(out)])

    return run


def _windows_of(rows: np.ndarray, text_of: dict) -> np.ndarray:
    """Every window of ``rows`` with a 128-bit hash: of its bytes, and of its bytes as they stand in reverse order."""
    around = [text_of[d, r][a:b] for d, r, a, b in zip(rows["doc"].tolist(), rows["row"].tolist(), rows["low"].tolist(), rows["end"].tolist())]
    size = (rows["end"] - rows["low"]).astype(np.int64)
    data = np.frombuffer(b"".join(around), dtype=np.uint8)
    count = size - MATCH + 1
    which = np.repeat(np.arange(len(rows)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(size) - size)[which] + inside
    out = np.empty(len(which), WINDOW)
    with np.errstate(over="ignore"):
        out["one"] = mix(PrefixHash(data).of(start, start + MATCH) + ODD)
        out["two"] = mix(PrefixHash(data[::-1]).of(len(data) - start - MATCH, len(data) - start) + ODD2)
    out["doc"], out["row"], out["at"] = rows["doc"][which], rows["row"][which], rows["low"][which] + inside
    return out


# 4: suffix sort

def repeated_windows(rows: np.ndarray, data: bytes) -> np.ndarray:
    """Spans of the windows of ``rows`` (SHOWN, their bytes one after another in ``data``) that also start earlier in a row."""
    if not len(rows):
        return np.empty(0, SPAN)
    begin = np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
    order = np.argsort(rows["gram"], kind="stable")
    rows, begin, n = rows[order], begin[order], len(rows)
    group = np.cumsum(np.concatenate(([0], rows["gram"][1:] != rows["gram"][:-1])))
    data = np.frombuffer(data, dtype=np.uint8)
    back, fore, size = (rows[f].astype(np.int64) for f in ("back", "fore", "size"))
    after, after_common = sort_suffixes(data, begin + back, size - back, group)
    before, before_common = sort_suffixes(data[::-1].copy(), len(data) - begin - back, back, group)
    place = np.empty(n, dtype=np.int64)
    place[np.lexsort((rows["at"], rows["row"], rows["doc"]))] = np.arange(n)
    repeated = np.zeros((n, OFFSETS + 2), dtype=np.int8)
    after_class, before_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for offset in range(OFFSETS):  # of the anchor inside the window
        held = np.flatnonzero((fore <= offset) & (offset <= back))
        if len(held) < 2:
            continue
        after_class[after] = np.cumsum(after_common < MATCH - offset)
        before_class[before] = np.cumsum(before_common < offset)
        same = after_class[held] * (n + 1) + before_class[held]
        by = np.lexsort((place[held], same))
        later = np.concatenate(([False], same[by][1:] == same[by][:-1]))
        repeated[held[by[later]], offset + 1] = 1
    steps = np.diff(repeated, axis=1)
    row, low = np.nonzero(steps == 1)  # offsets low .. high - 1 of a row are repeats
    _, high = np.nonzero(steps == -1)
    at = rows["at"][row].astype(np.int64)
    return _spans(rows[row], at - (high - 1), at - low + MATCH)


def _sort(groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b for batch in batches for b in zip(*[batch.column(n).to_pylist() for n in NAMES])]
        press = zstandard.ZstdDecompressor()
        data = b"".join(press.decompress(b[3]) for b in blocks if b[1] == "shown")
        spans = [_gather(blocks, "span", SPAN), repeated_windows(_gather(blocks, "shown", SHOWN), data)]
        windows, is_first = _firsts(_gather(blocks, "window", WINDOW), "one", "two")
        spans.append(_spans(r := windows[~is_first], r["at"], r["at"] + MATCH))
        spans = united(np.concatenate(spans))
        yield _batch(_blocks(_of_document(spans, groups), "span", spans))

    return run


# 5: documents without their repeats

def _spans_by_document(blocks: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    spans = united(_gather(_blocks_of(blocks), "span", SPAN))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, row, low, end in spans.tolist():
        found.setdefault((doc, row), []).append((low, end))
    return found


def _keyed(documents: DataFrame, groups: int, *keep: str) -> DataFrame:
    """A document is known by its id and a checksum of its text, so that rows that share an id stay apart."""
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(*[f"`{c}`" for c in keep], F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_doc"), F.crc32(text.cast("binary")).alias("_row"), F.col("text").alias("_text"))
    return keyed.withColumn("_part", _document_part(groups))


def without_repeats(documents: DataFrame, take_out: Callable, schema: str, *keep: str) -> DataFrame:
    """``take_out(table, spans by (_doc, _row))`` over all documents: its result, of ``schema``, gets the columns ``keep`` too.

    Spans are in bytes of the UTF-8 text. Earlier means a smaller doc_id (NULL ids first), then a smaller checksum of the
    text, then an earlier start; rows that repeat id and text are one document. Texts under MATCH bytes have no windows.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = parts * GROUPS_PER_PARTITION
    texts = _keyed(documents, groups, *keep)
    found = _keyed(documents, groups).select("_doc", "_row", "_text").mapInArrow(_find(parts), ROWS)
    asked = found.repartitionById(parts, F.col("part")).mapInArrow(_compare(groups), ROWS)
    by_document = texts.groupBy("_part")
    shown = by_document.cogroup(asked.groupBy("part")).applyInArrow(_show(parts, groups), ROWS)
    spans = shown.repartitionById(parts, F.col("part")).mapInArrow(_sort(groups), ROWS)

    def finish(table: pa.Table, blocks: pa.Table) -> pa.Table:
        return take_out(table, _spans_by_document(blocks))

    return by_document.cogroup(spans.groupBy("part")).applyInArrow(finish, schema)


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, end in spans:
        out.append(data[at:low])
        at = end
    return b"".join([*out, data[at:]])


def repeats_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; NULL texts are empty, an empty table gives none."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def take_out(table: pa.Table, spans: dict) -> pa.Table:
        rows = []
        for doc_id, doc, row, text in zip(*[table.column(n).to_pylist() for n in ("doc_id", "_doc", "_row", "_text")]):
            data, own = (text or "").encode("utf-8", "surrogatepass"), spans.get((doc, row), [])
            rows.append((doc_id, len(data), sum(b - a for a, b in own), len(own), hashlib.sha256(_kept(data, own)).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.string(),))], names=names)

    return without_repeats(documents, take_out, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", "doc_id")


def kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; a character of which only some bytes are in a span stays."""
    data, whole = text.encode("utf-8", "surrogatepass"), []
    inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
    for low, end in spans:
        while inside(low):
            low += 1
        while inside(end):
            end -= 1
        if low < end:
            whole.append((low, end))
    return _kept(data, whole).decode("utf-8", "surrogatepass")


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents``, every row kept, with repeated passages cut from ``text`` and ``n_chars`` counted anew where text changed.

    Other columns stay whatever their names; NULL and empty texts stay; an empty table gives an empty result.
    """
    names, documents = documents.columns, documents.toDF(*safe_names(documents.columns, ("doc_id", "text", "n_chars")))
    columns, kept = documents.columns, [c for c in documents.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def take_out(table: pa.Table, spans: dict) -> pa.Table:
        texts, lengths = table.column("_text").to_pylist(), table.column("n_chars").to_pylist() if "n_chars" in kept else []
        for i, key in enumerate(zip(table.column("_doc").to_pylist(), table.column("_row").to_pylist())):
            if key in spans:
                texts[i] = kept_text(texts[i], spans[key])
                if lengths:
                    lengths[i] = len(texts[i])
        new = {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array(lengths, table.schema.field("n_chars").type)} if lengths else {})
        return pa.table([new[c] if c in new else table.column(c) for c in columns], names=columns)

    return without_repeats(documents, take_out, schema, *kept).toDF(*names)
