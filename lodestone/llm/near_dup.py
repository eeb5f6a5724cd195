"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

1. Every document gives its shingle set's size, fingerprint and band keys; documents with the same set
   become one node, so copies cost no more than their row.
2. In a bucket (nodes with a band key in common) every node is paired with the least one, not with all.
   Pairs whose sizes and odd sketches allow the similarity are verified on the full sets, and links give components.
3. Buckets that still hold more than one component are finished exactly: nodes outside the bucket's
   largest component meet all nodes of the bucket, in blocks of bounded size: first their sketches, then
   the full sets of the nodes that found another whose sketch allows it; a block gives only the links that
   join components.
4. Components of all links; a document's component is the least doc_id in it.

An odd sketch (``minhash.odd_sketch``) is a sixteenth to a thirty-second of its set and bounds the difference of
two sets from below, so that it rules out only pairs that the full sets would rule out as well.  Texts and sets are
moved only if a filter of bounded size (``common.flagged``) lets them through; what it lets through too much falls to the join after it.

Nodes that share fewer than ``SHARED`` buckets are alone.  With 64 bands of 6 coordinates a pair at
similarity 0.8 shares fewer than two with a probability of 9e-8, and at 0.85 of 4e-12.  Sets are
compared by 64-bit hashes of their shingles.

Sums by bucket are written before rows meet them: Spark splits a hot bucket only in a join of two plain
shuffles, not in one with an aggregation below it.

Edge cases: null, empty and blank texts have no shingles and link with nothing; texts of any length are
compared whole; a text shorter than a shingle is one shingle; documents with equal sets are linked;
rows that repeat an id are documents of their own, kept if their id is the component's least; null ids
never name a component unless all of it has none, and rows without an id are kept only then; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, likely, map_arrow, parts, pick, texts
from lodestone.llm.components import components
from lodestone.llm.minhash import band_keys, fingerprint, fold, odd_sketch, shingles, signature

BANDS, ROWS = 64, 6
#: Buckets that a node must share before it is looked at.
SHARED = 2
#: Nodes of one side of a block, their shingles, and rows of a group of blocks.
BLOCK, BLOCK_SHINGLES, GROUP = 256, 1 << 21, 2000


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, text_hash, n, fa, fb and bands of every document; no bands without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingles(text, width) for text in texts(batch)]
            made = [(len(s), *fingerprint(s), band_keys(signature(s, bands * rows), rows) if len(s) else None) for s in sets]
            n, fa, fb, keys = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "text_hash", "n", "fa", "fb", "bands"],
            )

    rows_of = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(rows_of, run, "row long, doc_id long, text_hash long, n long, fa long, fb long, bands array<long>")


def full_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """node, its sorted shingle hashes and their sketch, read again from a document that has the set: the id and the text's hash name it, as ids repeat.

    Texts and nodes always meet by a merge join, as the number of nodes follows the corpus.  A task gives a node once; only
    if rows repeat an id and a text in several tasks are nodes made distinct over all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts(batches):
            found = []
            for node, fa, fb, text in zip(batch.column("node").to_pylist(), batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), texts(batch)):
                if node not in seen and fingerprint(s := shingles(text, width)) == (fa, fb):
                    seen.add(node)
                    found.append((node, s.view(np.int64), odd_sketch(s).tobytes()))
            if found:
                nodes, sets, sketches = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["node", "hashes", "sketch"],
                )

    wanted = needed.select("node", "fa", "fb", F.col("read_id").alias("id"), "text_hash")
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    named = likely(named, ["doc_id", "hash"], wanted.select("id", "text_hash"))
    joined = named.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))).select("node", "fa", "fb", "text")
    sets = cut(map_arrow(joined, run, "node long, hashes array<long>, sketch binary"), "near-dup-sets")
    told = sets.agg(F.count("node").alias("rows"), F.countDistinct("node").alias("nodes")).first()
    if told.rows == told.nodes:
        return sets
    once = cut(sets.dropDuplicates(["node"]), "near-dup-sets")
    discard(sets)
    return once


def similar(n: str, m: str, both, percent: int):
    return 100 * both >= percent * (F.col(n) + F.col(m) - both)


def sizes_allow(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def sketches_allow(u: np.ndarray, v: np.ndarray, n, m, percent: int):
    """Whether sets of n and m shingles can be similar; u holds one sketch or a row for each of several, v one."""
    size = min(u.shape[-1], v.shape[-1])
    odd = np.bitwise_count(fold(u, size) ^ fold(v, size)).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * odd <= (100 - percent) * (n + m)


def close_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
            ns, ms = (batch.column(c).to_pylist() for c in ("n", "m"))
            keep = [bool(sketches_allow(*x, percent)) for x in zip(us, vs, ns, ms)]
            yield batch.select(["node", "center", "n", "m"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select("node", F.col("sketch").alias("left")), "node")
    both = left.join(sets.select(F.col("node").alias("center"), F.col("sketch").alias("right")), "center")
    return map_arrow(both.select("node", "center", "n", "m", "left", "right"), run, "node long, center long, n long, m long")


def block_near(us: list[np.ndarray], ms: list[np.ndarray], u_sizes: np.ndarray, m_sizes: np.ndarray, u_roots: np.ndarray, m_roots: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of us and of ms, given as sketches, have one of another root on the other side that the sketches allow."""
    u_near, m_near = np.zeros(len(us), bool), np.zeros(len(ms), bool)
    lengths = np.array([len(u) for u in us])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        rows, sizes, roots = np.stack([us[i] for i in at]), u_sizes[at], u_roots[at]
        for j, m in enumerate(ms):
            some = np.flatnonzero((roots != m_roots[j]) & (100 * np.minimum(sizes, m_sizes[j]) >= percent * np.maximum(sizes, m_sizes[j])))
            if len(some):
                near = some[sketches_allow(rows[some], m, sizes[some], m_sizes[j], percent)]
                u_near[at[near]] = True
                m_near[j] |= len(near) > 0
    return u_near, m_near


def block_links(us: list[np.ndarray], ms: list[np.ndarray], u_roots: np.ndarray, m_roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (u, m) of different roots that are similar, one for each join of components."""
    owner = np.repeat(np.arange(len(us)), [len(u) for u in us])
    hashes = np.concatenate(us)
    order = np.argsort(hashes, kind="stable")
    hashes, owner, n_u = hashes[order], owner[order], np.array([len(u) for u in us])
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    links = []
    for j, m in enumerate(ms):
        low, high = np.searchsorted(hashes, m, "left"), np.searchsorted(hashes, m, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(us))
        for i in np.flatnonzero(100 * both >= percent * (n_u + len(m) - both)):
            a, b = root(int(u_roots[i])), root(int(m_roots[j]))
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((int(i), j))
    return links


def sides(keys: np.ndarray, outer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of both sides of every bucket that has both."""
    order = np.argsort(keys, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        us, ms = some[outer[some]], some[~outer[some]]
        if len(us) and len(ms):
            yield us, ms


def pairs_of(found: list[tuple], *names: str) -> pa.Table:
    return pa.table([pa.array([int(x[i]) for x in found], pa.int64()) for i in range(len(names))], names=list(names))


def in_blocks(open_: DataFrame, held: DataFrame, function, schema: str, what: str) -> DataFrame | None:
    """``function`` over blocks of buckets, written; None without rows.  Nodes outside a bucket's main component meet all its nodes.

    ``open_`` has key, node, n, root and main; ``held`` has node and what the function gets for it after the
    arrays of keys, nodes, roots, sides and sizes.
    """
    outside = F.col("root") != F.col("main")
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    sizes = open_.groupBy("key").agg(
        blocks(F.count(F.when(outside, 1)), F.sum(F.when(outside, F.col("n")).otherwise(0))).alias("u_blocks"), blocks(F.count(F.lit(1)), F.sum("n")).alias("m_blocks"), F.count(F.lit(1)).alias("size"),
    )
    sizes = cut(sizes, "near-dup-sizes")
    total = sizes.agg(F.sum("size").alias("n")).first().n
    if not total:
        discard(sizes)
        return None
    dealt = open_.join(sizes.hint("merge"), "key")
    u_blocks, m_blocks = F.col("u_blocks"), F.col("m_blocks")
    place = lambda blocks, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    u_rows = dealt.filter(outside).select("key", "node", "n", "root", F.lit(True).alias("outer"), place(u_blocks, 2).alias("ub"), each(m_blocks).alias("mb"))
    m_rows = dealt.filter("u_blocks > 0").select("key", "node", "n", "root", F.lit(False).alias("outer"), each(u_blocks).alias("ub"), place(m_blocks, 3).alias("mb"))
    groups = max(1, -(-total // GROUP))
    rows = u_rows.union(m_rows).join(held, "node").withColumn("group", F.struct(F.pmod(F.xxhash64("key", "ub", "mb"), F.lit(groups)).alias("g"), F.col("ub"), F.col("mb")))
    value = next(c for c in held.columns if c != "node")

    def one(table: pa.Table) -> pa.Table:
        return function(*[table[c].to_numpy(zero_copy_only=False) for c in ("key", "node", "root", "outer", "n")], table[value])

    found = cut(rows.select("group", "key", "node", "root", "outer", "n", value).groupBy("group").applyInArrow(one, schema), what)
    discard(sizes)
    return found


def remaining_links(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components that share a bucket, found in blocks; None if every bucket is settled.

    ``members`` has key, node and n (its shingles) of the buckets with three nodes or more (with two, the one pair has
    been verified).  Buckets with the same nodes count once.
    """
    same = members.groupBy("key").agg(F.sum(F.xxhash64("node") % (1 << 40)).alias("a"), F.sum(F.xxhash64("node", F.lit(1)) % (1 << 40)).alias("b"), F.count(F.lit(1)).alias("size"))
    once = same.groupBy("a", "b", "size").agg(F.min("key").alias("key")).select("key")
    rooted = members.join(once, "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted, "near-dup-rooted")
    counts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("nodes"))
    main = counts.groupBy("key").agg(F.max(F.struct("nodes", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    main = cut(main.filter("roots > 1").select("key", F.col("most.root").alias("main")), "near-dup-main")
    open_ = cut(rooted.join(main.hint("merge"), "key"), "near-dup-open")
    discard(rooted, main)

    def near(keys, nodes, roots_, outer, sizes, sketches) -> pa.Table:
        found = []
        for us, ms in sides(keys, outer):
            held = {i: np.frombuffer(sketches[int(i)].as_py(), np.uint64) for i in (*us, *ms)}
            allowed = block_near([held[i] for i in us], [held[i] for i in ms], sizes[us], sizes[ms], roots_[us], roots_[ms], percent)
            found += [(keys[i], nodes[i]) for side, which in zip((us, ms), allowed) for i in side[which]]
        return pairs_of(sorted(set(found)), "key", "node")

    def linked(keys, nodes, roots_, outer, sizes, hashes) -> pa.Table:
        found = []
        for us, ms in sides(keys, outer):
            held = {i: np.asarray(hashes[int(i)].values) for i in (*us, *ms)}
            links = block_links([held[i] for i in us], [held[i] for i in ms], roots_[us], roots_[ms], percent)
            found += [(nodes[us[i]], nodes[ms[j]]) for i, j in links]
        return pairs_of(found, "u", "v")

    close = in_blocks(open_, sets.select("node", "sketch"), near, "key long, node long", "near-dup-close")
    if close is None:
        discard(open_)
        return None
    allowed = cut(open_.join(close.distinct(), ["key", "node"]), "near-dup-allowed")
    discard(open_, close)
    found = in_blocks(allowed, likely(sets.select("node", "hashes"), ["node"], allowed.select("node")), linked, "u long, v long", "near-dup-rest")
    discard(allowed)
    return found


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; then text_hash, and group, the same for linked documents alone, null without links."""
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut(signatures(docs, width, bands, rows), "near-dup-signatures")
    nodes = signed.filter("n > 0").groupBy("fa", "fb").agg(
        F.first("n").alias("n"), F.min("row").alias("node"), F.min_by("doc_id", "row").alias("read_id"), F.min_by("text_hash", "row").alias("text_hash"),
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),
    )
    nodes = cut(nodes, "near-dup-nodes")
    slim = cut(signed.drop("row", "bands"), "near-dup-signatures")
    discard(signed)
    signed = slim
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"), "near-dup-shared")
    all_met = cut(banded.join(shared.hint("merge"), "key"), "near-dup-met")
    busy = all_met.groupBy("node").agg(F.count(F.lit(1)).alias("buckets")).filter(F.col("buckets") >= SHARED).select("node")
    met = cut(all_met.join(busy, "node"), "near-dup-busy")
    slim = cut(nodes.drop("bands"), "near-dup-nodes")
    discard(shared, all_met, nodes)
    nodes = slim
    centers = met.groupBy("key").agg(F.min("node").alias("center"), F.min_by("n", "node").alias("m"), F.count(F.lit(1)).alias("size"))
    centers = cut(centers.filter("size > 1"), "near-dup-centers")
    members = cut(met.join(centers.hint("merge"), "key"), "near-dup-members")
    discard(met, centers)
    pairs = cut(members.filter("node <> center").filter(sizes_allow("n", "m", percent)).select("node", "center", "n", "m").distinct(), "near-dup-pairs")
    needed = cut(members.select("node").distinct().join(nodes.drop("n", "copies", "first_id"), "node"), "near-dup-needed")
    sets = full_sets(docs, needed, width)
    close = cut(close_pairs(pairs, sets, percent), "near-dup-close")
    discard(pairs, needed)
    held = likely(sets.select("node", "hashes"), ["node"], close.select("node").union(close.select("center")))
    # Both joins name the same columns of the same plan, so that Spark moves the sets once.
    left = close.alias("p").join(held.alias("l"), F.col("p.node") == F.col("l.node")).select("center", "n", "m", F.col("p.node").alias("u"), F.col("l.hashes").alias("left"))
    both = left.join(held.alias("r"), F.col("center") == F.col("r.node")).select("u", F.col("center").alias("v"), "n", "m", "left", F.col("r.hashes").alias("right"))
    links = cut(both.filter(similar("n", "m", F.size(F.array_intersect("left", "right")), percent)).select("u", "v"), "near-dup-links")
    discard(close)
    roots = components(links)
    rest = remaining_links(members.filter("size > 2").select("key", "node", "n"), roots, sets, percent)
    if rest is not None:
        roots = components(links.union(rest))
        discard(rest)
    discard(members, sets, links)
    grouped = nodes.select("fa", "fb", "node", "first_id", "copies").join(roots, "node", "left").filter("copies > 1 or root is not null")
    grouped = grouped.select("fa", "fb", "first_id", F.coalesce("root", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first_id").alias("least"))
    named = grouped.join(least, "group").select("fa", "fb", "least", "group")
    out = signed.select("doc_id", "text_hash", "n", "fa", "fb").join(named, ["fa", "fb"], "left")
    linked = F.col("group").isNotNull() & (F.col("n") > 0)
    component = F.when(linked, F.col("least")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", F.when(linked, F.col("group")).alias("group"),
    )
