"""MinHash near-duplicates by an inverted join over signature coordinates.

A signature has WIDTH coordinates; its tokens are (coordinate, value) pairs. Two documents of similarity t agree in about
t * WIDTH tokens, so pairs that agree in fewer than MATCHES are not looked at. Tokens are put in one global order, rare ones
first: two documents that agree in MATCHES tokens share one among their first WIDTH - MATCHES + 1, so only those are posted.
Inside a posting list agreements are counted against documents not reached yet; reached ones are skipped. The classes this
gives are only candidates: links are confirmed on full shingle sets inside each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proplake.functions.graph import connected_components
from proplake.functions.skew import join_by_weight
from proplake.llm.batches import pieces
from proplake.llm.hashing import ODD2, follow, mix, word_hashes
from proplake.session import cut_lineage

WORDS = 5
PERCENT = 85
WIDTH = 48
MATCHES = 24  # a pair of similarity 0.85 agrees in fewer with probability 2e-8
POSTED = WIDTH - MATCHES + 1
SKETCH_BITS = 16
MARK_BITS = 25  # a table of 4 MB; beyond thirty million members it only spares less
BLOCK_ROWS = 2_048
BLOCK_SHINGLES = 2_000_000
FACTORS = np.random.default_rng(5).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
SHIFTS = np.random.default_rng(6).integers(1, 2**63, WIDTH, dtype=np.uint64)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, ascending by owner and hash."""
    edges, hashes = word_hashes(texts)
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not len(owner):
        return owner, hashes
    left = edges[1:][owner] - np.arange(len(owner))  # words from here to the end of the text
    found = follow(hashes, words) if len(hashes) >= words else np.zeros_like(hashes)
    long = left >= words
    short = np.flatnonzero((sizes > 0) & (sizes < words))  # the whole sequence is the one shingle
    extra = np.array([follow(hashes[edges[t]:edges[t + 1]], int(sizes[t]))[0] for t in short], dtype=np.uint64)
    with np.errstate(over="ignore"):
        extra = mix(extra + (sizes[short].astype(np.uint64) + np.uint64(1)) * ODD2)
    owner, found = np.concatenate((owner[long], short)), np.concatenate((found[long], extra))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    fresh = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
    return owner[fresh], found[fresh]


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, number of shingles of each text) of a batch."""
    owner, found = shingles([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], words)
    return owner, found, np.bincount(owner, minlength=batch.num_rows)


def signatures(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature, low) of every row: size and 128-bit hash of the set, WIDTH 32-bit minima
    and their low bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            owner, found, sizes = _sets(batch, words)
            full = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][full]
            rows = np.zeros((batch.num_rows, WIDTH), dtype=np.uint32)
            both = np.zeros((2, batch.num_rows), dtype=np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    for j in range(WIDTH):
                        rows[full, j] = np.minimum.reduceat(((found * FACTORS[j] + SHIFTS[j]) >> np.uint64(32)).astype(np.uint32), starts)
                    both[0][full], both[1][full] = np.add.reduceat(found, starts), np.add.reduceat(mix(found), starts)
            packed = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (rows, rows.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), *packed],
                                             names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "low"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, low binary")


def _tokens(packed: list[bytes]) -> np.ndarray:
    """One row per signature: coordinate and value of each token in one number."""
    values = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(-1, WIDTH)
    return values.astype(np.int64) | np.arange(WIDTH, dtype=np.int64) << 32


def _bucket(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(tokens.astype(np.uint64)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _frequencies(distinct: DataFrame) -> np.ndarray:
    """How many tokens fall in each of 2 ** SKETCH_BITS buckets. It orders tokens by rarity; any order gives the same pairs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_bucket(_tokens(batch.column("signature").to_pylist())).ravel(), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = distinct.select("signature").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in counts.collect():  # a table of fixed size
        table[row["bucket"]] = row["n"]
    return table


def postings(distinct: DataFrame) -> DataFrame:
    """(token, doc_id): the POSTED rarest tokens of every signature."""
    table = _frequencies(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(batch.column("signature").to_pylist())
            order = np.lexsort((tokens, table[_bucket(tokens)]), axis=1)[:, :POSTED]
            chosen = np.take_along_axis(tokens, order, axis=1)
            docs = np.repeat(batch.column("doc_id").to_numpy(), POSTED)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), pa.array(docs)], names=["token", "doc_id"])

    return distinct.select("doc_id", "signature").mapInArrow(run, "token bigint, doc_id bigint")


def in_blocks(rows: DataFrame, group: str, blocks: str, member: str) -> DataFrame:
    """``rows`` dealt so that any two rows of a group meet in one (group, low, high): a group of ``blocks`` = 1 stays whole,
    a larger one is cut into that many blocks, of which each pair meets once. No task holds more than two blocks."""
    own = F.pmod(F.xxhash64(F.lit(17), member), F.col(blocks)).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return dealt.withColumns({"low": F.least("_own", "_with"), "high": F.greatest("_own", "_with")}).drop("_own", "_with", blocks)


def reach(n: int, neighbours) -> list[tuple[int, int]]:
    """Spanning edges of a graph on 0 .. n - 1 given by ``neighbours(node, open nodes) -> those it is linked with``.

    A node is compared with nodes not reached yet and with no others.
    """
    open_nodes, edges = np.arange(n), []
    while len(open_nodes):
        front, open_nodes = [int(open_nodes[0])], open_nodes[1:]
        while front and len(open_nodes):
            node = front.pop()
            found = neighbours(node, open_nodes)
            if len(found):
                edges += [(node, int(other)) for other in found]
                front += found.tolist()
                open_nodes = np.setdiff1d(open_nodes, found, assume_unique=True)
    return edges


def _edges_of(docs: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"node": docs[pairs[:, 0]], "other": docs[pairs[:, 1]]})


def list_edges(docs: np.ndarray, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Candidate edges inside posting lists that begin at ``starts``: agreements of whole signatures are counted, by their low
    bytes, which can only add some. Lists of two are compared all at once, as most are."""
    size = np.diff(np.append(starts, len(docs)))
    first = starts[size == 2]
    agree = first[(low[first] == low[first + 1]).sum(axis=1) >= MATCHES]
    edges = [np.stack((docs[agree], docs[agree + 1]), axis=1)]
    for begin, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
        own, own_docs = low[begin:begin + n], docs[begin:begin + n]
        if n <= 64:  # a small table of all agreements is quicker than a search
            agrees = (own[:, None, :] == own[None, :, :]).sum(axis=2) >= MATCHES
            found = reach(n, lambda node, others: others[agrees[node, others]])
        else:
            found = reach(n, lambda node, others: others[(own[others] == own[node]).sum(axis=1) >= MATCHES])
        if found:
            edges.append(own_docs[np.array(found)])
    return np.concatenate(edges)


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sorted posting lists; the list at a batch's end waits for the next batch."""
    def edges(keys: np.ndarray, docs: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, np.int64)
        found = np.unique(list_edges(docs, low, starts), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["node", "other"])

    keys, docs, low = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty((0, WIDTH), np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate((keys, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "low", "high")], axis=1)))
        docs = np.concatenate((docs, batch.column("doc_id").to_numpy()))
        low = np.concatenate((low, np.frombuffer(b"".join(batch.column("low_bytes").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)))
        open_from = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])
        yield edges(keys[:open_from], docs[:open_from], low[:open_from])
        keys, docs, low = keys[open_from:], docs[open_from:], low[open_from:]
    yield edges(keys, docs, low)


def candidate_classes(distinct: DataFrame) -> DataFrame:
    """(doc_id, class) of documents that chain together by agreeing signatures; documents without such a partner are absent."""
    posted = postings(distinct)
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = posted.join(lists, "token").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)).drop("n")
    rows = in_blocks(shared, "token", "blocks", "doc_id").join(distinct.select("doc_id", F.col("low").alias("low_bytes")), "doc_id")
    sorted_lists = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    edges = sorted_lists.select("token", "low", "high", "doc_id", "low_bytes").mapInArrow(_count_lists, "node bigint, other bigint").distinct()
    return connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("class"))


class Overlap:
    """Sizes of intersections of one set with many, from lists of the shingles that at least two sets share."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.sets = sets
        self.index(np.arange(len(sets)))

    def index(self, held: np.ndarray) -> None:
        self.held = held
        self.row = np.repeat(np.arange(len(held)), self.size[held])
        shingle = np.concatenate([self.sets[h] for h in held]) if len(held) else np.zeros(0, np.int64)
        order = np.argsort(shingle, kind="stable")
        shingle, self.row = shingle[order], self.row[order]
        starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.zeros(0, np.int64)
        self.name, self.start, self.length = shingle[starts], starts, np.diff(np.append(starts, len(shingle)))

    def linked(self, node: int, others: np.ndarray, percent: int) -> np.ndarray:
        if len(others) * 2 < len(self.held):
            self.index(others)
        if not len(self.name):
            return others[:0]
        at = np.searchsorted(self.name, self.sets[node]).clip(0, len(self.name) - 1)
        at = at[self.name[at] == self.sets[node]]
        length = self.length[at]
        rows = self.row[np.repeat(self.start[at] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())]
        common = np.bincount(rows, minlength=len(self.held))
        found = self.held[100 * common >= percent * (self.size[node] + self.size[self.held] - common)]
        return np.intersect1d(found, others, assume_unique=True)


def _confirm(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows["doc_id"].to_numpy()
        overlap = Overlap([np.frombuffer(s, dtype=np.int64) for s in rows["shingles"]])
        return _edges_of(docs, reach(len(docs), lambda node, others: overlap.linked(node, others, percent)))

    return run


def _members_mark(members: DataFrame) -> bytes:
    """A bit for the hash of every member's id: 2 ** MARK_BITS bits however many there are, collected slice by slice."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS))
    slices = members.groupBy(F.shiftright(slot, 15).alias("slice")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << 15) - 1)).alias("bits"))
    mark = bytearray(1 << MARK_BITS - 3)
    for row in slices.collect():  # a table of fixed size
        mark[row["slice"] << 12:row["slice"] + 1 << 12] = row["bits"]
    return bytes(mark)


def confirmed_links(documents: DataFrame, members: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """(node, other): links between members of one class, confirmed on full shingle sets, enough of them to reach all that is linked.

    Texts that are in no class are dropped where they are read, by the members' bits; the few that pass by chance go at the join.
    Sets are exchanged, texts never.
    """
    mark = documents.sparkSession.sparkContext.broadcast(_members_mark(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(mark.value, dtype=np.uint8)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for piece in pieces(iter([batch.filter(pa.array(bits[slot >> 3] >> (slot & 7) & 1 == 1))]), "text"):
                owner, found, sizes = _sets(piece, words)
                ends = np.cumsum(sizes)
                sets = [found[a:b].view(np.int64) for a, b in zip(ends - sizes, ends)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([np.sort(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    named = documents.filter("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS)).alias("slot"))
    sets = named.mapInArrow(run, "doc_id bigint, shingles binary").join(members.hint("merge"), "doc_id")
    return in_blocks(sets, "class", "blocks", "doc_id").groupBy("class", "low", "high").applyInPandas(_confirm(percent), "node bigint, other bigint").distinct()


def components(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles) of every row, (doc_id, component_id) of every doc_id that is linked with another).

    Rows of one doc_id count as one node; rows without an id, and documents without words, have no links.
    """
    signed = cut_lineage(signatures(documents, words))
    usable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]
    distinct = cut_lineage(usable.groupBy(*key).agg(
        F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n")))
    firsts = distinct.filter("n > 1").select(*key, F.col("doc_id").alias("other"), "n")
    copied = join_by_weight(usable.select(F.col("doc_id").alias("node"), *key), firsts, key, "n")
    copies = cut_lineage(copied.filter("node > other").select("node", "other").distinct())
    classes = candidate_classes(distinct.select("doc_id", "signature", "low"))
    sized = classes.join(distinct.select("doc_id", "n_shingles"), "doc_id")
    weight = sized.groupBy("class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    members = cut_lineage(classes.join(weight, "class").select("doc_id", "class", "blocks"))
    links = confirmed_links(documents, members, percent, words)
    found = connected_components(links.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    return signed.select("doc_id", "n_shingles"), found


def neardup_digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; a row without an id has no component and is kept."""
    sizes, found = components(documents)
    rows = sizes.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Of each component of ``documents`` the row of its smallest doc_id; rows that repeat an id stand or fall together."""
    _, found = components(documents, percent, words)
    others = found.filter("doc_id <> component_id").select("doc_id")
    return documents.join(others, "doc_id", "left_anti")
