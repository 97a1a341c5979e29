"""Self-join of documents on the Jaccard similarity of their word 5-grams.

1. Every text is sketched in one pass: the fingerprint of its set of shingles
   and a MinHash signature. Texts with equal sets are one class, searched once.
2. The signatures form a forest of TREES prefix tries. A document's label in a
   tree is DEEPEST hash values; the labels of a tree, sorted over the cluster,
   are its trie, in which the documents under a prefix lie in a row. Runs under
   the shortest prefix that can be needed are kept where they have two rows.
3. The shortest prefix is the longest at which the chance of a pair at the
   threshold to meet reaches the target, by the collision probability and as
   measured on a bounded sample, whose similar partners are found by comparing
   signatures with all. Near copies that a document has say nothing about its
   partners at the threshold, so every document's prefixes may go down to there.
   Under each such prefix matching starts with whole labels and shortens them a
   value at a time: rows that share the longer prefix are compared by their
   sketches first and tied if they may be similar, and a shorter one only
   compares rows that the longer ones neither brought together nor tied.
4. Ties make clusters (connected components). Within a cluster every pair is
   verified on the exact sets of shingles; only each document's number of links
   and its component leave a block. Prefixes and clusters that many documents
   share are cut into a grid of blocks of a bounded number of rows, so no task
   gets them whole.

Words are runs of letters and digits in lower case. A text of fewer than five
words has one shingle, all its words; a text without words (null ones too) has
none and is similar only to others without. Very long texts have one shingle a
word, and only their own set is in memory besides a bounded number of others.
Rows are documents: a repeated row is a copy that counts as a link. Where rows
share an id, each set of shingles among them is a document of its own. A class
is named by its least id, of whatever type ids have. Rows with a null id take no
part and come back with a null class and no links. An empty table gives no rows.
Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, as_struct, cut, in_slices, join_by_key, maybe_among
from .graph import components

WORDS = 5
TREES, DEEPEST = 24, 8
THRESHOLD = 0.8
TARGET_RECALL = 0.995
#: Sketches whose estimate is so far below the threshold, four standard errors at 0.8, are not tied.
TOLERANCE = 0.15
SKETCH_HASHES = 128
SAMPLED = 48
BUCKET_ROWS = 4_096
CLUSTER_ROWS = 1_024
COLUMNS_AT_ONCE = 4_096
#: Rows that a task remembers, so that it hands on a repeated one once.
SEEN = 100_000

WORD = re.compile(r"[^\W_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20050901)
SLOPES = _random.integers(0, 1 << 31, TREES * DEEPEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words, ascending."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in WORD.findall(text.lower())] if text else [], dtype=np.uint64)
    if not len(words):
        return words
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + len(h)]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each."""
    if not len(grams):
        return np.zeros(TREES * DEEPEST, dtype=np.uint16)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEEPEST, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2_048):
        least = np.minimum(least, (low[at : at + 2_048, None] * SLOPES[None, :] + OFFSETS[None, :]).min(axis=0))
    least ^= least >> np.uint32(15)
    return (least * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)


def agreeing(sketch: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Estimated similarity of one sketch to others: values of four bits that agree, less those that would by chance."""
    return ((sketches == sketch).mean(axis=1) - 1 / 16) / (1 - 1 / 16)


def least_alike(threshold: float) -> float:
    """Below this estimate, four standard errors or more under the threshold, sketches are not tied."""
    agree = threshold + (1 - threshold) / 16
    return threshold - max(TOLERANCE, 4 * math.sqrt(agree * (1 - agree) / SKETCH_HASHES) / (1 - 1 / 16))


def sketch_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, print (fingerprint of the set of shingles), size, signature."""

    def run(batches):
        for batch in in_slices(batches):
            prints, sizes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text)
                prints.append(hashlib.md5(grams.tobytes()).digest())
                sizes.append(len(grams))
                signatures.append(signature(grams).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], names=["id", "print", "size", "signature"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, print binary, size long, signature binary")


def model_recall(depth: int, similarity: float) -> float:
    """Chance that two documents of that similarity share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shortest_prefix(classes: DataFrame, threshold: float, target: float) -> int:
    """How far prefixes may have to be shortened: the longest one that reaches the target recall by the model and on a sample."""
    depth = DEEPEST
    while depth > 1 and model_recall(depth, threshold) < target:
        depth -= 1
    sample = classes.filter("size > 0").orderBy(F.xxhash64("print"), "print").limit(SAMPLED).select("signature").collect()
    if not sample:
        return depth
    shared = classes.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(bytes(r["signature"]) for r in sample), dtype=np.uint16).reshape(len(sample), -1))

    def run(batches):
        for batch in in_slices(batches, 4_096):
            all_of = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
            deepest = np.zeros(DEEPEST + 1, dtype=np.int64)
            for own in shared.value:
                same = all_of == own
                alike = same[same.mean(axis=1) >= threshold].reshape(-1, TREES, DEEPEST)
                matched = np.cumprod(alike, axis=2).sum(axis=2).max(axis=1, initial=0)
                deepest += np.bincount(matched[~alike.all(axis=(1, 2))], minlength=DEEPEST + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DEEPEST + 1)), pa.array(deepest)], names=["depth", "pairs"])

    found = classes.select("signature").mapInArrow(run, "depth long, pairs long").groupBy("depth").agg(F.sum("pairs").alias("pairs")).collect()
    pairs = {r["depth"]: r["pairs"] for r in found}
    total = sum(pairs.values())
    while depth > 1 and total and sum(n for d, n in pairs.items() if d >= depth) < target * total:
        depth -= 1
    return depth


def grouped(keys: list[str], work):
    """For mapInArrow over partitions sorted by ``keys``: ``work`` on the rows of runs of whole groups, about a batch at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, dtype=bool)
            for k in keys:
                column = batch.column(k).to_numpy(zero_copy_only=False)
                same &= column == column[-1]
            first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if first == 0 and held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
                held.append(batch)
                continue
            held.append(batch.slice(0, first))
            whole = pa.Table.from_batches(held)
            if whole.num_rows:
                yield from work(whole)
            held = [batch.slice(first)]
        if held and (whole := pa.Table.from_batches(held)).num_rows:
            yield from work(whole)

    return run


def runs(table: pa.Table, keys: list[str]):
    """Slices of a table whose rows agree in ``keys``."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.append(np.flatnonzero(change), table.num_rows)
    return list(zip(starts[:-1].tolist(), starts[1:].tolist()))


def in_grid(rows: DataFrame, by: str, count: str, most: int) -> DataFrame:
    """Rows dealt to the blocks (low, high) of their group's grid; ``part`` is a row's own part of the group."""
    n = F.ceil(F.col(count) / most).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", count)


def _ties(shortest: int, threshold: float):
    """Ties (a, b) under the prefixes of ``shortest`` values: a spanning set of those between documents that may be similar.

    Rows of a block are in the order of ``rest``, the values of their label beyond the shortest prefix.
    """
    least = least_alike(threshold)
    beyond = DEEPEST - shortest

    def work(whole: pa.Table):
        nodes = whole.column("node").to_numpy()
        sketches = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), dtype=np.uint8).reshape(whole.num_rows, -1)
        rests = np.frombuffer(b"".join(whole.column("rest").to_pylist()), dtype=np.uint8).reshape(whole.num_rows, 2 * beyond)
        left, right = [], []
        for a, b in runs(whole, ["key", "low", "high"]):
            component = np.arange(b - a)
            changes = rests[a + 1 : b] != rests[a : b - 1]
            longer = np.arange(b - a)  # runs under the prefix that is a value longer: at first rows by themselves
            for kept in range(beyond, -1, -1):
                run = np.concatenate([[0], np.cumsum(changes[:, : 2 * kept].any(axis=1))])
                bounds = np.flatnonzero(np.diff(run, prepend=-1, append=run[-1] + 1)).tolist()
                for c, d in zip(bounds, bounds[1:]):
                    if longer[c] == longer[d - 1] or (component[c:d] == component[c]).all():
                        continue  # alone, compared under the longer prefix, or tied
                    order = c + np.argsort(nodes[a + c : a + d], kind="stable")  # so that all trees tie a group to its least node
                    own, before, of = sketches[a + order], longer[order], component[order]
                    for i in range(d - c - 1):
                        later = np.flatnonzero((of[i + 1 :] != of[i]) & (before[i + 1 :] != before[i])) + i + 1
                        if not len(later):
                            continue
                        for j in later[agreeing(own[i], own[later]) >= least].tolist():
                            if of[j] != of[i]:
                                left.append(nodes[a + order[i]])
                                right.append(nodes[a + order[j]])
                                component[component == of[j]] = of[i]
                                of = component[order]
                longer = run
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return work


LABEL_BYTES = 1 + 2 * DEEPEST


def _trie_runs(shortest: int):
    """For mapInArrow over sorted labels: rows of runs of at least two labels that share ``shortest`` values.

    A partition's first and last run may go on in its neighbours: their rows are all kept, with n = 0.
    """
    width = 1 + 2 * shortest

    def some(labels: np.ndarray, nodes: np.ndarray, edges: tuple[bool, bool]) -> pa.RecordBatch:
        starts = np.append(0, np.flatnonzero((labels[1:, :width] != labels[:-1, :width]).any(axis=1)) + 1)
        sizes = np.diff(np.append(starts, len(labels)))
        n = np.repeat(sizes, sizes)
        if edges[0]:
            n[: sizes[0]] = 0
        if edges[1]:
            n[len(n) - sizes[-1] :] = 0
        keep = np.flatnonzero(n != 1)
        keys = [xxhash.xxh3_64_intdigest(x) for x in np.ascontiguousarray(labels[keep, :width])]
        rests = [x.tobytes() for x in labels[keep, width:]]
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(nodes[keep]), pa.array(n[keep]), pa.array(rests, pa.binary())], names=["key", "node", "n", "rest"])

    def run(batches):
        labels, nodes, first = np.zeros((0, LABEL_BYTES), dtype=np.uint8), np.zeros(0, dtype=np.int64), True
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=np.uint8).reshape(-1, LABEL_BYTES)
            labels, nodes = np.concatenate([labels, more]), np.concatenate([nodes, batch.column("node").to_numpy()])
            other = np.flatnonzero((labels[:, :width] != labels[-1, :width]).any(axis=1))
            if len(other):  # the last run may go on in the next batch
                at = int(other[-1]) + 1
                yield some(labels[:at], nodes[:at], (first, False))
                labels, nodes, first = labels[at:], nodes[at:], False
        if len(labels):
            yield some(labels, nodes, (first, True))

    return run


def forest(classes: DataFrame, shortest: int) -> DataFrame:
    """key, node, n, rest: the runs of the sorted tries in which two or more of ``classes`` share ``shortest`` values; n is a run's size."""

    def label(batches):
        for batch in in_slices(batches, 4_096):
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, TREES, DEEPEST)
            labels = np.empty((batch.num_rows, TREES, LABEL_BYTES), dtype=np.uint8)
            labels[:, :, 0] = np.arange(TREES)
            labels[:, :, 1:] = np.ascontiguousarray(values.astype(">u2")).view(np.uint8).reshape(batch.num_rows, TREES, -1)
            flat = pa.Array.from_buffers(pa.binary(LABEL_BYTES), labels.shape[0] * TREES, [None, pa.py_buffer(labels.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat, pa.array(np.repeat(batch.column("node").to_numpy(), TREES))], names=["label", "node"])

    labels = classes.filter("size > 0").select("node", "signature").mapInArrow(label, "label binary, node long")
    # the node is a key too, so that equal labels, however many, lie in several partitions
    tries = labels.repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    found = cut(tries.mapInArrow(_trie_runs(shortest), "key long, node long, n long, rest binary"))
    ends = found.filter("n = 0").drop("n")
    sizes = ends.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")  # at most two keys a partition
    return found.filter("n > 0").unionByName(ends.join(F.broadcast(sizes), "key").select("key", "node", "n", "rest"))


def candidate_ties(classes: DataFrame, shortest: int, threshold: float) -> DataFrame:
    """Ties (a, b) between classes that meet in the forest and have similar sketches."""

    def sketch(batches):
        for batch in in_slices(batches, 4_096):
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
            low = (values[:, :SKETCH_HASHES] & np.uint16(15)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in low], pa.binary())], names=["node", "sketch"])

    sketches = classes.filter("size > 0").select("node", "signature").mapInArrow(sketch, "node long, sketch binary")
    met = in_grid(forest(classes, shortest), "key", "n", BUCKET_ROWS).join(sketches, "node").select("key", "low", "high", "node", "rest", "sketch")
    by = ["key", "low", "high"]
    dealt = met.repartition(*by).sortWithinPartitions(*by, "rest", "node")
    return dealt.mapInArrow(grouped(by, _ties(shortest, threshold)), "a long, b long").distinct()


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have at least the Jaccard similarity, exactly."""
    sizes = np.array([len(s) for s in sets])
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = counts > 1
    number = np.cumsum(several) - 1
    inside = several[codes]
    row, column = row[inside], number[codes[inside]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)  # exact: counts stay below 2^24
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(several.sum())
    for at in range(0, total, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        grid = np.zeros((len(sets), min(COLUMNS_AT_ONCE, total - at)), dtype=np.float32)
        grid[row[a:b], column[a:b] - at] = 1
        common += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - common.astype(np.float64)
    return common.astype(np.float64) / np.maximum(union, 1) >= threshold


def _verify(threshold: float):
    def work(whole: pa.Table):
        nodes, parts = whole.column("node").to_numpy(), whole.column("part").to_numpy()
        weights = whole.column("copies").to_numpy()
        grams = whole.column("grams").to_pylist()
        out_node, out_root, out_links = [], [], []
        for a, b in runs(whole, ["cluster", "low", "high"]):
            keep = [a] + [i for i in range(a + 1, b) if nodes[i] != nodes[i - 1] or grams[i] != grams[i - 1]]
            own, part = nodes[keep], parts[keep]
            linked = similar([np.frombuffer(grams[i], dtype=np.uint64) for i in keep], threshold)
            linked &= own[:, None] != own[None, :]
            if part.min() != part.max():
                linked &= part[:, None] != part[None, :]  # pairs within one part are verified in its own block
            links = (linked * weights[keep][None, :]).sum(axis=1)
            root = np.arange(len(own))  # rows are in ascending order of node
            linked |= np.eye(len(own), dtype=bool)
            while True:
                near = np.where(linked, root[None, :], len(own)).min(axis=1)
                near = near[near]
                if (near == root).all():
                    break
                root = near
            out_node.append(own)
            out_root.append(own[root])
            out_links.append(links)
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64))
        yield pa.RecordBatch.from_arrays([join(out_node), join(out_root), join(out_links)], names=["node", "root", "links"])

    return work


def classified(df: DataFrame, threshold: float, target: float, id_col: str, text_col: str) -> DataFrame:
    """Per row with an id: id, print, class_id, n_links and kept (whether its id and print are the first of its class)."""
    sketches = cut(sketch_table(df, id_col, text_col))
    classes = cut(sketches.groupBy("print").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")))
    classes = classes.withColumn("node", F.monotonically_increasing_id())  # of a checkpoint, so the same whenever it is read; an id may have several prints
    named = classes.select("node", "print", "first_id", "copies")
    shortest = shortest_prefix(classes, threshold, target)
    clusters = components(candidate_ties(classes, shortest, threshold))
    sizes = cut(clusters.groupBy("component").agg(F.count("*").alias("n")))
    n_members, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    members = join_by_key(clusters, sizes, "component", "n", n_members).withColumnRenamed("component", "cluster")
    members = cut(members.join(named, "node"))

    def shingled(batches):
        met: set[tuple] = set()
        for batch in in_slices(batches):
            keep, prints, sets = [], [], []
            for i, (name, text) in enumerate(zip(batch.column("first_id").to_pylist(), batch.column("text").to_pylist())):
                grams = shingles(text).tobytes()
                own = hashlib.md5(grams).digest()
                if (name, own) in met:
                    continue  # a repeated row
                met.add((name, own))
                keep.append(i)
                prints.append(own)
                sets.append(grams)
            if len(met) > SEEN:
                met.clear()
            yield pa.RecordBatch.from_arrays([batch.column("first_id").take(pa.array(keep, pa.int64())), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], names=["first_id", "print", "grams"])

    texts = df.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).filter("first_id is not null")
    texts = maybe_among(texts, "first_id", members, n_members)  # most texts are no member's and aren't moved
    texts = texts.mapInArrow(shingled, f"first_id {df.schema[id_col].dataType.simpleString()}, print binary, grams binary")
    sets = texts.join(members, ["first_id", "print"]).select("node", "cluster", "n", "copies", "grams")
    dealt = in_grid(sets, "cluster", "n", CLUSTER_ROWS).repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "node")
    verified = cut(dealt.mapInArrow(grouped(["cluster", "low", "high"], _verify(threshold)), "node long, root long, links long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if largest > CLUSTER_ROWS:
        joined = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = links.join(joined, "node", "left").select("node", "links", F.coalesce("component", "node").alias("root"))
    links = cut(links.join(named.select("node", "first_id", "print"), "node"))
    firsts = cut(links.groupBy("root").agg(F.min(F.struct("first_id", "print")).alias("first"), F.count("*").alias("n")))
    placed = join_by_key(links.select("node", "links", "root"), firsts, "root", "n", n_members).select("node", "links", "first")
    of_class = named.join(placed, "node", "left").withColumn("first", F.coalesce("first", F.struct("first_id", "print")))
    of_class = cut(of_class.select("print", "copies", F.col("first.first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("first.print") == F.col("print")).alias("kept")))
    known = join_by_key(sketches.select("id", "print"), of_class, "print", "copies")
    return known.select("id", "print", "class_id", "n_links", (F.col("kept") & (F.col("id") == F.col("class_id"))).alias("kept"))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the least id among all documents that links connect) and n_links (other rows at least so similar)."""
    kind = df.schema[id_col].dataType
    known = classified(df, threshold, target, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links")
    without = df.filter(F.col(id_col).isNull()).select(F.lit(None).cast(kind).alias(id_col), F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(without)


def keep_one(df: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` without the near copies of a kept one: one row of the least id of each class, and every row without an id."""
    found = cut(classified(df, threshold, target, id_col, text_col).select("id", "print", "kept"))
    of_id = cut(found.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"), F.max("kept").alias("__kept")))
    n_rows = found.count()
    several = F.col("__n") > 1
    # ids of one kept row stay, others go; a very frequent id is dropped by broadcast, so that its rows don't meet
    many = max(1024, n_rows // BROADCAST_ROWS)
    gone = of_id.filter(several | ~F.col("__kept")).select("__id", "__n")
    once = df
    for ids in (F.broadcast(gone.filter(F.col("__n") > many)), gone.filter(F.col("__n") <= many)):
        once = once.join(ids, once[id_col] == ids["__id"], "left_anti")
    # rows that share their id are told apart by their prints, and repeats of one are one
    shared = cut(of_id.filter(several & F.col("__kept")))
    rows = df.select(F.col(id_col).alias("__id"), as_struct(df.columns).alias("__row"), F.col(text_col).alias("__text"))
    rows = join_by_key(rows, shared, "__id", "__n").select("__id", "__row", "__text")

    def run(batches):
        for batch in in_slices(batches):
            prints = [hashlib.md5(shingles(t).tobytes()).digest() for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())], names=[*batch.schema.names, "__print"])

    rows = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__print", T.BinaryType())]))
    firsts = rows.groupBy("__id", "__print").agg(F.min_by("__row", F.coalesce("__text", F.lit(""))).alias("__row"))
    wanted = found.filter("kept").select(F.col("id").alias("__id"), F.col("print").alias("__print")).distinct()
    return once.unionByName(firsts.join(wanted, ["__id", "__print"], "left_semi").select("__row.*"))
