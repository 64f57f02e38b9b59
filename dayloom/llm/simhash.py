"""SimHash near-duplicates: BK-trees over shards of distinct fingerprints.

Distinct fingerprints are dealt to shards such that a pair within the radius meets in at least
one of them. Each shard's BK-tree (children keyed by their Hamming distance to the parent) goes
to the shard's query blocks; a query follows only edges within the radius of its distance to the
node. The trees travel in the shuffle, since the rules let no driver see all fingerprints.

Shards come from the fingerprint's own bits (exact for small radii: a pair that differs in r bits
agrees on one of r + 1 bands) or from keys of the caller (min-hashes, for larger radii). For
removal (``keep_one``) the trees only find candidates; sets of shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, free_name, materialise, thinned, words_of

#: Fingerprints of a shard, about; and the most that one tree or query block holds.
SHARD, BLOCK = 8_192, 16_384
#: Queries that walk a tree together.
WALK = 1_024
#: Pairs that such a walk meets at most, and shingles of a block whose sets are compared, about.
WALKED, LOAD = 1 << 18, 500_000


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``n`` words, lower-cased in A-Z and joined by spaces.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-n]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    bytes_ = hashes.view(np.uint8).reshape(len(hashes), 8)  # little-endian: byte k has bits 8k to 8k + 7
    values = (np.arange(256)[:, None] >> np.arange(8)) & 1
    out = 0
    for k in range(8):
        ones = np.bincount(bytes_[:, k], minlength=256) @ values
        for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
            out |= 1 << (8 * k + bit)
    return out


def min_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` rehashings, tagged with its number."""
    odd = (np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if not len(hashes):
        return np.arange(count, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    for k in range(count):
        mixed = hashes * odd[k]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[k] = mixed.min() + np.uint64(k)
    return out


def fingerprints(docs: DataFrame, words: int = 3, keys: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and, if asked for, an array of ``keys`` min-hashes; one row per document.

    Null text has no words, like an empty one: its fingerprint is zero.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text_ in batch.text:
                h = shingle_hashes(text_, words)
                rows.append((fingerprint(h), min_hashes(h, keys).view(np.int64) if keys else None))
            out = pd.DataFrame({"doc_id": batch.doc_id.astype("Int64")})
            out["fp"] = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
            if keys:
                out["keys"] = [r[1] for r in rows]
            yield out

    bounded_batches(docs.sparkSession)
    source = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return source.mapInPandas(run, "doc_id long, fp long" + (", keys array<long>" if keys else ""))


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched a level at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values
        keys, nodes = [], []  # parent * 65 + distance to it, and the child
        rest = np.arange(len(values))
        key = np.zeros(len(values), dtype=np.int64)
        self.root = 0
        level = 0
        while len(rest):
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            heads = rest[first]  # the first of each group becomes the node
            if level:
                keys.append(key[first])
                nodes.append(heads)
            parent = heads[np.cumsum(first) - 1][~first]
            rest = rest[~first]
            key = parent * 65 + np.bitwise_count(values[rest] ^ values[parent])
            level += 1
        keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.children = nodes[order]
        self.first = np.searchsorted(keys[order], np.arange(len(values) * 65 + 1)).astype(np.int64)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, value number) within the radius, in pieces."""
        if not len(self.values):
            return
        asks = np.arange(len(queries))
        nodes = np.full(len(queries), self.root)
        while len(asks):
            d = np.bitwise_count(queries[asks] ^ self.values[nodes]).astype(np.int64)
            near = d <= radius
            yield asks[near], nodes[near]
            low = self.first[nodes * 65 + np.maximum(d - radius, 0)]
            high = self.first[nodes * 65 + np.minimum(d + radius, 64) + 1]
            count = high - low
            total = int(count.sum())
            asks = np.repeat(asks, count)
            before = np.cumsum(count) - count
            nodes = self.children[np.repeat(low - before, count) + np.arange(total)]


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of linked members; a label is the smallest number of its group."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels[:] = shorter


def _sharded(fps: DataFrame, radius: int, shard: int) -> DataFrame:
    """Rows (shard, fp) from the fingerprint's bits: all pairs within the radius meet in a shard."""
    band = 64 // (radius + 1)
    bits = min(band, max(0, math.ceil(math.log2(max(1, fps.count()) / shard))))
    bands = range(radius + 1) if bits else [0]
    keys = [
        F.shiftrightunsigned("fp", k * band).bitwiseAND((1 << bits) - 1) * (radius + 1) + k for k in bands
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("shard"))


def linked_pairs(members: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a > b) that connect what is within the radius in some shard of ``(shard, fp)`` rows.

    In a group of rows all links are found and only a spanning set is returned, so the result is
    never larger than the members. A shard beyond ``block`` is cut into blocks; each pair of blocks
    is a group of its own, so no link of a hot shard is lost and none is one task.
    """
    sizes = members.groupBy("shard").agg(F.count("*").alias("size")).filter("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / F.lit(block)).cast("int")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = members.join(sizes.drop("size"), "shard").withColumn("own", own)
    pairs = placed.select(
        "shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows.i.iloc[0], rows.j.iloc[0]
        values = rows.fp.to_numpy(dtype=np.int64).view(np.uint64)
        in_tree = rows.own.to_numpy() == i
        tree_at = np.flatnonzero(in_tree)
        query_at = tree_at if i == j else np.flatnonzero(~in_tree)
        tree = BKTree(values[tree_at])
        labels = np.arange(len(values))
        for a in range(0, len(query_at), WALK):
            asked = query_at[a : a + WALK]
            for q, v in tree.search(values[asked], radius):
                _unite(labels, asked[q], tree_at[v])
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        fp = values.view(np.int64)
        return pd.DataFrame({"a": np.maximum(fp[linked], fp[labels[linked]]), "b": np.minimum(fp[linked], fp[labels[linked]])})

    return pairs.groupBy("shard", "i", "j").applyInPandas(search, "a long, b long").distinct()


def components(links: DataFrame, what: str = "links") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of linked nodes.

    Alternates stars around each node's smallest neighbour until nothing changes (a number of
    rounds about the logarithm of the longest chain); every round is a written table.
    """

    def state(table: DataFrame):
        row = table.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    links = materialise(links, what)
    seen = state(links)
    while seen[0]:
        both = links.select("a", "b").union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), what)
        now = state(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_groups(
    docs: DataFrame, words: int = 3, radius: int = 2, keys: int = 0,
    doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every document, repeated rows included.

    Fingerprints link at ``radius`` or fewer differing bits; equal ones are one node whatever
    their number. ``component_id`` is the smallest id reachable; rows without an id are members
    but never give it (a component of such rows alone has null). With ``keys`` = 0 shards come
    from the bits and no link is missed; else a pair must also share one of ``keys`` min-hashes
    of its shingles. Null and empty texts have fingerprint zero and link like any other.
    """
    marked = materialise(fingerprints(docs, words, keys, doc_id, text), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    if keys:
        members = marked.select("fp", F.explode("keys").alias("shard")).distinct()
    else:
        members = _sharded(nodes.select("fp"), radius, shard)
    roots = components(linked_pairs(members, radius, block), "links")
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(known, "fp").select("doc_id", "fp", "component_id")


def signatures(docs: DataFrame, words: int, keys: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``node`` (a hash of its set of shingles), ``fp``, ``size`` and ``keys`` of that set."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text_ in batch.text:
                h = np.unique(shingle_hashes(text_, words))
                rows.append((xxhash.xxh64_intdigest(h.tobytes(), 42), fingerprint(h), len(h), min_hashes(h, keys).view(np.int64)))
            out = pd.DataFrame({"doc_id": batch.doc_id})
            for k, name in enumerate(("node", "fp")):
                out[name] = np.array([r[k] for r in rows], dtype=np.uint64).view(np.int64)
            yield out.assign(size=[r[2] for r in rows], keys=[r[3] for r in rows])

    bounded_batches(docs.sparkSession)
    source = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return source.mapInPandas(run, "doc_id long, node long, fp long, size long, keys array<long>")


def _block_pairs(members: DataFrame, load: Column, block: int) -> DataFrame:
    """Members of shards of two or more, once for each pair (i, j) of blocks that their own block is in."""
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"), F.sum(load).alias("load")).filter("n > 1")
    sizes = sizes.select("shard", F.ceil(F.col("load") / F.lit(block)).cast("int").alias("blocks"))
    placed = members.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def _candidates(rows: pd.DataFrame, radius: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of a pair of blocks that may have ``share`` of their shingles in common.

    Their fingerprints are within the radius and their sizes allow it. A pair that meets in several
    shards is a candidate in the first of them only.
    """
    i, j = rows.i.iloc[0], rows.j.iloc[0]
    values = rows.fp.to_numpy(dtype=np.int64).view(np.uint64)
    size = rows["size"].to_numpy(dtype=np.int64)
    keys = np.stack(rows["keys"].to_numpy())
    before = keys[:, : int(np.argmax(keys[0] == rows.shard.iloc[0]))]
    in_tree = rows.own.to_numpy() == i
    tree_at = np.flatnonzero(in_tree)
    query_at = tree_at if i == j else np.flatnonzero(~in_tree)
    if not len(tree_at) or not len(query_at):
        return
    tree_at = tree_at[np.argsort(values[tree_at], kind="stable")]
    distinct, first, count = np.unique(values[tree_at], return_index=True, return_counts=True)
    tree = BKTree(distinct)
    walk = max(1, min(WALK, WALKED // len(tree_at)))
    for a in range(0, len(query_at), walk):
        asked = query_at[a : a + walk]
        for q, v in tree.search(values[asked], radius):
            n = count[v]
            skip = np.cumsum(n) - n
            x = np.repeat(asked[q], n)
            y = tree_at[np.repeat(first[v] - skip, n) + np.arange(len(x))]
            fits = np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y])
            if i == j:
                fits &= x < y
            x, y = x[fits], y[fits]
            new = ~(before[x] == before[y]).any(1)
            if new.any():
                yield x[new], y[new]


def similar_pairs(nodes: DataFrame, sets, radius: int, share: float, block: int = BLOCK, load: int = LOAD) -> DataFrame:
    """Links (a > b) that connect the nodes with ``share`` or more of their shingles in common.

    Nodes with a candidate in a shard meet there again with their sets of shingles, which
    ``sets(nodes)`` gives, in blocks of about ``load`` shingles. The similarity of every candidate
    is counted, but for pairs already connected in their group; a spanning set of the links that
    hold is returned.
    """
    members = nodes.select("node", "fp", "size", "keys", F.explode("keys").alias("shard"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        has = np.zeros(len(rows), dtype=bool)
        for x, y in _candidates(rows, radius, share):
            has[x] = has[y] = True
        return rows.loc[has, ["node", "fp", "size", "keys", "shard"]]

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"]]
        size = np.array([len(x) for x in pieces])
        ends = np.cumsum(size)
        code = np.unique(np.concatenate(pieces), return_inverse=True)[1].reshape(-1)
        codes = [code[e - n : e] for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
        inside = np.zeros(int(code.max()) + 1, dtype=bool)
        labels = np.arange(len(rows))
        for x, y in _candidates(rows, radius, share):
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            asked, begins = np.unique(x, return_index=True)
            for q, other in zip(asked.tolist(), np.split(y, begins[1:]), strict=True):
                other = other[labels[other] != labels[q]]
                if not len(other):
                    continue
                inside[codes[q]] = True
                common = np.array([np.count_nonzero(inside[codes[v]]) for v in other.tolist()])
                inside[codes[q]] = False
                alike = other[common / (size[q] + size[other] - common) >= share]
                _unite(labels, np.full(len(alike), q), alike)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        node = rows.node.to_numpy(dtype=np.int64)
        return pd.DataFrame({"a": np.maximum(node[linked], node[labels[linked]]), "b": np.minimum(node[linked], node[labels[linked]])})

    schema = "node long, fp long, size long, keys array<long>, shard long"
    found = _block_pairs(members, F.lit(1), block).groupBy("shard", "i", "j").applyInPandas(search, schema)
    found = materialise(found.dropDuplicates(["shard", "node"]), "candidates")
    again = _block_pairs(found, F.col("size"), load).join(sets(found.select("node").distinct()), "node")
    return again.groupBy("shard", "i", "j").applyInPandas(verify, "a long, b long").distinct()


def keep_one(
    docs: DataFrame, words: int = 5, share: float = 0.8, radius: int = 26, keys: int = 8,
    doc_id: str = "doc_id", text: str = "text", **sizes: int,
) -> DataFrame:
    """The rows that stay: one of each group of near duplicates, the one with the smallest id.

    Two texts are near duplicates if their sets of runs of ``words`` words have a Jaccard
    similarity of ``share`` or more, counted on the sets; groups are what such pairs connect.
    Pairs are looked for among those that share one of ``keys`` min-hashes and whose SimHash
    fingerprints are within ``radius``. Texts without words are nobody's copies and stay. Rows
    without an id are the last of their group; of rows with equal ids the first in the scan
    stays. ``docs`` has to be a scan of files, as its rows are told apart by their place in it.
    """
    row = free_name(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    worded = placed.filter(F.size(words_of(col(text))) > 0)
    marked = materialise(signatures(worded, words, keys, row, text), "signatures")
    nodes = materialise(
        marked.groupBy("node").agg(F.min("doc_id").alias("first_row"), *[F.first(c).alias(c) for c in ("fp", "size", "keys")]),
        "nodes",
    )

    def sets(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.text]
                yield pd.DataFrame({"node": batch.node, "set": made})

        rows = materialise(nodes.join(wanted, "node").select("node", "first_row"), "wanted")
        texts = thinned(placed.select(col(row).alias("first_row"), col(text).alias("text")), rows, "first_row").join(rows, "first_row")
        return texts.select("node", "text").mapInPandas(run, "node long, set binary")

    roots = components(similar_pairs(nodes, sets, radius, share, **sizes), "links")
    groups = marked.select(F.col("doc_id").alias("row"), "node").join(roots, "node", "left").select(
        "row", F.coalesce("root", "node").alias("grp")
    )
    ids = placed.select(col(row).alias("row"), col(doc_id).cast("long").alias("id"))
    members = materialise(groups.join(ids, "row"), "members")
    stays = members.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("one"))
    kept = stays.select(F.col("one.row").alias("row"))
    dropped = materialise(members.join(kept, "row", "left_anti").select(F.col("row").alias(row)), "dropped")
    return placed.join(dropped, row, "left_anti").drop(row)
