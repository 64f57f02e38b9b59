"""N-gram Jaccard join: sets of word n-grams in a trie, joined by shared partial overlaps.

A set is the sorted array of its n-grams' 64-bit hashes: the hash value is the global order. Equal
sets are one node. The join runs in three steps.

1. *Routing.* If two sets have a Jaccard similarity of ``share`` or more, enough elements of one's
   prefix are in the other's too (``prefix_pairs``). Elements are dealt by their hash, 16 bytes each;
   nodes with too few shared ones have no partner. What is left falls into families, the
   components of shared elements without the most frequent ones of each node (``families``).
2. *Trie join.* The sets of a family (in blocks, where it is large) are stored in a trie. A set
   walks the trie from the root, down the branches of the sets that share one of its rarest elements
   in the block; all sets below a trie node share the overlap counted so far, and a subtree is left
   as soon as the overlap and what remains cannot reach the share.
3. *Components* of the links that hold.

No pair of sets is taken on trust and none is missed: routing is a proof, the walk is a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, materialise, tasks_for, thinned
from dayloom.llm.simhash import components

#: Shingles of a block, about: what one trie holds.
LOAD = 2_000_000
#: Shingles of one trie node at most, so that long unshared tails can be left half-way.
SEGMENT = 32
#: Words beyond so many bytes are hashed one at a time; nodes that a task remembers.
LONG_WORD, KNOWN_NODES = 256, 100_000
#: Elements of a bucket, about, and those that a task deals out at a time.
BUCKET, DEALT = 1_000_000, 2_000_000
#: Rows of a bucket that a task holds before it lets go of elements with over ``CROWD`` rows; their count.
HELD, CROWD, MANY = 4_000_000, 1_000, (1 << 31) - 1
#: A node with over this share of all rows is looked up by broadcast: there are 500 of them at most.
HOT = 0.002
#: The bytes between words, and masks of the first 0 to 8 bytes of eight.
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


# ---- sets -----------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of a buffer that has eight bytes to spare; takes eight bytes of all words at a time."""
    import xxhash

    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, left = np.arange(len(starts)), sizes
    while len(at):
        part = eights[starts[at] + (sizes[at] - left)] & _MASKS[np.minimum(left, 8)]
        out[at] = _mixed(out[at] ^ part)
        more = (left > 8) & (sizes[at] <= LONG_WORD)
        at, left = at[more], left[more] - 8
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]], 7)
    return out


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words whose hashes are ``h``."""
    out = np.full(max(0, len(h) - length + 1), length, dtype=np.uint64)
    for k in range(length):
        out = _mixed(out) + h[k : k + len(out)]
    return _mixed(out)


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of every text, the sorted distinct hashes of the runs of ``n`` words, lower-cased in A-Z.

    A text with fewer words has one, the whole sequence; one without words has none.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        yield from (np.zeros(0, dtype=np.uint64) for _ in range(len(texts)))
        return
    data = np.frombuffer(texts.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes().lower() + bytes(8), dtype=np.uint8)
    at = at - at[0]
    edges = np.unique(at)
    inside = ~_SPACE[data[:-8]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges[:-1]], last[edges[1:] - 1] = inside[edges[:-1]], inside[edges[1:] - 1]  # a word ends with its text
    starts = np.flatnonzero(first)
    h = word_hashes(data, starts, np.flatnonzero(last) + 1 - starts)
    runs, place = _runs(h, n), np.searchsorted(starts, at).tolist()
    for a, b in zip(place[:-1], place[1:], strict=True):
        out = runs[a : b - n + 1] if b - a >= n else _runs(h[a:b], b - a) if b > a else h[:0]
        out = np.sort(out)
        new = out[1:] != out[:-1]
        yield out if new.all() else out[np.r_[True, new]]


def prefix_pairs(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The elements that routing pairs with a set; none of a set of one, which has no partner but itself.

    Sets x and y with the share r have c >= r max(|x|, |y|) common elements. The k-th of them has
    at most |x| - c others before it in x, so it is among the first |x| - ceil(r |x|) + k of x.
    The prefix has room for k = max(1, |x| / 4): the prefixes share the k of the smaller set.
    """
    n = len(hashes)
    return hashes[: n - -(-n * percent // 100) + max(1, n // 4)] if n > 1 else hashes[:0]


def needed(n: Column, percent: int) -> Column:
    """Elements that the prefix of a set of ``n`` shares with that of any partner: a partner has ``percent`` of its size at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) / 4)).cast("int")


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id``, ``tid`` (MD5 of the text), ``n`` (size of the set), ``node`` (its 128-bit hash, null
    for none), ``short`` (64 bits of it) and, once a task and node, the packed prefix that routes it."""
    import xxhash

    schema = "doc_id long, tid string, n long, node binary, short long, prefix binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("tid", pa.string()), ("n", pa.int64()), ("node", pa.binary()), ("short", pa.int64()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, nodes, shorts, heads = [], [], [], []
            if len(seen) > KNOWN_NODES:
                seen.clear()
            for h in ngram_sets(batch.column(2), words):
                sizes.append(len(h))
                node = xxhash.xxh3_128_digest(h) if len(h) else None
                nodes.append(node)
                shorts.append(int.from_bytes(node[:8], "little", signed=True) if node else None)
                new = len(h) > 1 and node not in seen
                heads.append(prefix_pairs(h, percent).tobytes() if new else None)
                if new:
                    seen.add(node)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(shorts, pa.int64()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``node`` and ``set`` (packed hashes) of texts, once a task and node; texts without words have no row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            nodes, sets = [], []
            for h in ngram_sets(batch.column(0), words):
                node = xxhash.xxh3_128_digest(h) if len(h) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "set"])

    return docs.mapInArrow(run, "node binary, set binary")


# ---- routing --------------------------------------------------------------


def dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of rows (prefix, short), the elements with their shorts, packed by bucket; an element has one bucket."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        element, short = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (_mixed(element) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        element, short, bucket = element[order], short[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        packed = [element[a:b].tobytes() + short[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    for batch in batches:
        heads = batch.column(0).to_pylist()
        if not heads:
            continue
        element = np.frombuffer(b"".join(heads), dtype=np.uint64)
        held.append((element, np.repeat(batch.column(1).to_numpy(), [len(x) // 8 for x in heads])))
        size += len(element)
        if size > DEALT:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def shared_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows (bucket, packed) in order, (element, short, rows) of elements with two or more shorts.

    ``rows`` is the number of shorts. Holds a bucket. Where one grows beyond ``HELD`` rows, elements
    with over ``CROWD`` of them go out as they come, repeated shorts included, with ``rows`` = ``MANY``.
    """

    def found(element: np.ndarray, short: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(element.view(np.int64)), pa.array(short), pa.array(rows.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["element", "short", "rows"])

    def counted(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        element, short = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((short, element))
        element, short = element[order], short[order]
        new = np.r_[True, (element[1:] != element[:-1]) | (short[1:] != short[:-1])]
        element, short = element[new], short[new]
        starts = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        count = np.diff(np.r_[starts, len(element)])
        return element, short, np.repeat(count, count)

    held, size, now, crowded, limit = [], 0, None, np.zeros(0, dtype=np.uint64), HELD
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now:
                if size:
                    element, short, rows = counted(held)
                    yield found(element[rows > 1], short[rows > 1], rows[rows > 1])
                held, size, now, crowded, limit = [], 0, bucket, crowded[:0], HELD
            half = len(packed) // 2
            element, short = np.frombuffer(packed[:half], dtype=np.uint64), np.frombuffer(packed[half:], dtype=np.int64)
            if len(crowded):
                out = np.isin(element, crowded)
                if out.any():
                    yield found(element[out], short[out], np.full(int(out.sum()), MANY))
                element, short = element[~out], short[~out]
            held.append((element, short))
            size += len(element)
            if size > limit:
                element, short, rows = counted(held)
                out = rows > CROWD
                if out.any():
                    yield found(element[out], short[out], np.full(int(out.sum()), MANY))
                    crowded = np.union1d(crowded, element[out])
                held, size = [(element[~out], short[~out])], int((~out).sum())
                limit = max(HELD, 2 * size)
    if size:
        element, short, rows = counted(held)
        yield found(element[rows > 1], short[rows > 1], rows[rows > 1])


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (element, short) in order, links (a > b) of every short to the smallest of its element."""
    last = None
    for batch in batches:
        element, short = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if not len(element):
            continue
        starts = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        hub = short[starts]
        if last is not None and element[0] == last[0]:
            hub[0] = last[1]
        last = (element[-1], hub[-1])
        b = np.repeat(hub, np.diff(np.r_[starts, len(element)]))
        links = np.unique(np.stack([short, b], axis=1)[short != b], axis=0)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k])) for k in range(2)], names=["a", "b"])


def families(marked: DataFrame, percent: int) -> DataFrame:
    """``short`` and ``family`` of the nodes that may have a partner.

    A node whose prefix shares k elements with any partner's needs not be linked by the k - 1 of them
    that most nodes have: of what two partners share, the rarest is left in both.
    """
    heads = marked.filter(F.col("prefix").isNotNull())
    total = heads.agg(F.sum(F.length("prefix")).alias("bytes")).first()["bytes"] or 0
    buckets = max(tasks_for(marked.sparkSession), total // 8 // BUCKET)
    rows = heads.select("prefix", "short").mapInArrow(lambda batches: dealt(batches, buckets), "bucket int, packed binary")
    shared = materialise(
        rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared_elements, "element long, short long, rows int"),
        "shared-elements",
    )
    sizes = heads.groupBy("short").agg(needed(F.min("n"), percent).alias("needed"))
    place = F.row_number().over(Window.partitionBy("short").orderBy(F.desc("rows"), "element"))
    kept = shared.join(sizes, "short").withColumn("place", place).filter("place >= needed").select("element", "short")
    links = kept.repartition("element").sortWithinPartitions("element", "short").mapInArrow(stars, "a long, b long").distinct()
    roots = components(links, "family-links")
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root"))
    return both.distinct().select(F.col("node").alias("short"), F.col("root").alias("family"))


# ---- the trie join --------------------------------------------------------


class Trie:
    """Sorted sets of numbers below ``size``; equal beginnings are stored once.

    Trie node v holds the elements ``tokens[start[v] : start[v] + length[v]]``; node 0 is the root
    and holds none. ``rest`` is the most that follows it in a set below, ``least`` the size of the
    smallest set below, ``ends`` the set that ends in it (else -1); ``at`` is the node a set ends in.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.tokens = np.concatenate([sets[k] for k in order]) if order else np.zeros(0, dtype=np.int64)
        offset = np.cumsum([0, *[len(sets[k]) for k in order]])
        start, length, parent, ends, depth = [0], [0], [0], [-1], [0]
        path: list[int] = [0]  # trie nodes from the root to the end of the set before
        before = np.zeros(0, dtype=np.int64)
        for place, k in enumerate(order):
            mine = sets[k]
            m = min(len(before), len(mine))
            differ = np.flatnonzero(before[:m] != mine[:m])
            common = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > common:
                v = path.pop()
                top = depth[v] - length[v]
                if top < common:  # cut v in two: what is common stays, the rest becomes a node below
                    cut = common - top
                    start.append(start[v] + cut)
                    length.append(length[v] - cut)
                    parent.append(v)
                    ends.append(ends[v])
                    depth.append(depth[v])
                    for child in self._below.pop(v, []):
                        parent[child] = len(start) - 1
                        self._below.setdefault(len(start) - 1, []).append(child)
                    self._below[v] = [len(start) - 1]
                    length[v], depth[v], ends[v] = cut, common, -1
                    path.append(v)
                    break
            at = common
            while at < len(mine):
                step = min(SEGMENT, len(mine) - at)
                start.append(int(offset[place]) + at)
                length.append(step)
                parent.append(path[-1])
                self._below.setdefault(path[-1], []).append(len(start) - 1)
                ends.append(-1)
                at += step
                depth.append(at)
                path.append(len(start) - 1)
            ends[path[-1]] = k
            before = mine
        self.start, self.length, self.ends = np.array(start), np.array(length), np.array(ends)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        n = len(start)
        parents, depths = np.array(parent), np.array(depth)
        self.last = self.start + self.length - 1
        self.sets, self.percent, self.parent = sets, 0, parents
        self.at = np.zeros(len(sets), dtype=np.int64)
        self.at[self.ends[self.ends >= 0]] = np.flatnonzero(self.ends >= 0)
        longest = np.where(self.ends >= 0, self.sizes[self.ends], 0) if len(sets) else np.zeros(n, dtype=np.int64)
        least = np.where(self.ends >= 0, self.sizes[self.ends], np.iinfo(np.int64).max) if len(sets) else longest
        order = np.argsort(depths, kind="stable").tolist()  # children end deeper than their parent
        level = [0] * n
        for v in order[1:]:
            level[v] = level[parent[v]] + 1
        for v in order[:0:-1]:
            p = parent[v]
            longest[p], least[p] = max(longest[p], longest[v]), min(least[p], least[v])
        self.rest, self.least, self.level = longest - depths, least, np.array(level)
        self._overlap, self._alive = np.zeros(n, dtype=np.int64), np.arange(n) == 0

    @property
    def _below(self) -> dict[int, list[int]]:
        return self.__dict__.setdefault("_kids", {})

    def _rarest(self, asked: np.ndarray, percent: int) -> np.ndarray:
        """Ranks of the elements of a set that come first by rarity; it shares one of them with any partner."""
        keep = len(asked) - -(-len(asked) * percent // 100) + 1
        known = asked[asked < len(self.rank)]
        keep -= len(asked) - len(known)  # what no stored set has is the rarest
        ranks = self.rank[known]
        return ranks if keep >= len(ranks) else np.partition(ranks, keep - 1)[:keep] if keep > 0 else ranks[:0]

    def _post(self, percent: int) -> None:
        """Rank all elements by rarity and file the stored sets under the rarest of theirs."""
        counts = np.bincount(self.tokens)
        self.rank = np.empty(len(counts), dtype=np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        ranks = [self._rarest(s, percent) for s in self.sets]
        holders = np.repeat(np.arange(len(ranks)), [len(r) for r in ranks])
        ranks = np.concatenate(ranks)
        order = np.argsort(ranks, kind="stable")
        self.holders, self.posts = holders[order], np.searchsorted(ranks[order], np.arange(len(counts) + 1))
        self.percent = percent

    def _candidates(self, asked: np.ndarray, percent: int, open_: np.ndarray) -> np.ndarray:
        """The open sets of a fitting size that share a rarest element with ``asked``: all partners, and others."""
        if self.percent != percent:
            self._post(percent)
        ranks = self._rarest(asked, percent)
        count = self.posts[ranks + 1] - self.posts[ranks]
        skipped = np.cumsum(count) - count
        sets = self.holders[np.repeat(self.posts[ranks] - skipped, count) + np.arange(int(count.sum()))]
        size = self.sizes[sets]
        return np.unique(sets[open_[sets] & (100 * size >= percent * len(asked)) & (100 * len(asked) >= percent * size)])

    def partners(self, asked: np.ndarray, inside: np.ndarray, percent: int, open_: np.ndarray) -> np.ndarray:
        """The sets that share ``percent`` with the sorted set ``asked``, of those that are ``open_``.

        ``inside`` marks the elements of ``asked``. Walks the branches that lead to a candidate, a
        level at a time.
        """
        found = []
        if not len(self.sets):
            return np.zeros(0, dtype=np.int64)
        up = self.at[self._candidates(asked, percent, open_)]
        ways = [up]
        while len(up):
            up = np.unique(self.parent[up])
            ways.append(up := up[up > 0])
        ways = np.unique(np.concatenate(ways))
        ways = ways[np.argsort(self.level[ways], kind="stable")]
        overlap, alive = self._overlap, self._alive
        for nodes in np.split(ways, np.flatnonzero(np.diff(self.level[ways])) + 1):
            nodes = nodes[alive[self.parent[nodes]]]
            if not len(nodes):
                break
            length = self.length[nodes]
            begin = np.cumsum(length) - length
            at = np.repeat(self.start[nodes] - begin, length) + np.arange(int(length.sum()))
            common = overlap[self.parent[nodes]] + np.add.reduceat(inside[self.tokens[at]].astype(np.int64), begin)
            left = len(asked) - np.searchsorted(asked, self.tokens[self.last[nodes]], side="right")
            best = common + np.minimum(self.rest[nodes], left)
            useful = (100 + percent) * best >= percent * (self.least[nodes] + len(asked))
            overlap[nodes], alive[nodes] = common, useful
            nodes, common = nodes[useful], common[useful]
            done = self.ends[nodes]
            holds = (done >= 0) & ((100 + percent) * common >= percent * (self.sizes[done] + len(asked)))
            found.append(done[holds])
        alive[ways] = False
        found = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return found[open_[found]]


def trie_links(sets: list[np.ndarray], labels: np.ndarray, stored: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets that connect all groups of labels with a link; sets with one label are not compared."""
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum([len(s) for s in sets])
    coded = [code[e - len(s) : e] for e, s in zip(ends.tolist(), sets, strict=True)]
    inside = np.zeros(int(code.max()) + 1, dtype=bool)
    at = np.flatnonzero(stored)
    trie = Trie([coded[k] for k in at.tolist()])
    labels, links = labels.copy(), []
    for q in np.flatnonzero(asks).tolist():
        open_ = labels[at] != labels[q]
        if not open_.any():
            continue
        inside[coded[q]] = True
        for v in at[trie.partners(coded[q], inside, percent, open_)].tolist():
            if labels[v] != labels[q]:
                links.append((q, v))
                labels[labels == labels[v]] = labels[q]
        inside[coded[q]] = False
    return links


def join_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` (a > b) between nodes of rows (task, side, node, label, set).

    Side 0 is stored and asked, 1 stored only, 2 asked only. A task's rows are held together; the
    caller bounds them.
    """

    def solve(group: list[tuple]) -> list[tuple[bytes, bytes]]:
        group = list({(r[1], r[0]): r for r in group}.values())  # repeated rows of the documents
        nodes, side = [r[1] for r in group], np.array([r[0] for r in group])
        if len(set(nodes)) < 2:
            return []
        labels = np.unique(np.array([r[2].hex() for r in group]), return_inverse=True)[1].reshape(-1)
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in group]
        links = trie_links(sets, labels, side < 2, side != 1, percent)
        return [(max(nodes[x], nodes[y]), min(nodes[x], nodes[y])) for x, y in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            out = []
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != task:
                    out += solve(held)
                    held, task = [], key
                held.append(row)
            if out:
                yield _linked(out)
        if out := solve(held):
            yield _linked(out)

    ordered = rows.select("task", "side", "node", "label", "set").repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def _linked(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in range(2)], names=["a", "b"])


def _blocks(load: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(load / F.lit(size))).cast("int")


def first_links(members: DataFrame, percent: int, load: int) -> DataFrame:
    """Links inside every block of a family and between each block and the family's block 0.

    A family of one block is settled by this. In one that is mostly near copies, the blocks
    are connected through block 0.
    """
    numbers = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = members.withColumn("j", F.explode(numbers))
    return join_groups(rows.select(F.xxhash64("family", "j").alias("task"), F.lit(0).alias("side"), "node", F.col("node").alias("label"), "set"), percent)


def other_links(members: DataFrame, percent: int, load: int) -> DataFrame:
    """Links of families of several blocks between sets with different labels.

    What has the family's most frequent label is stored in blocks and not compared with itself; all
    other sets walk those blocks and each other's.
    """
    by_label = members.groupBy("family", "label").agg(F.sum("n").alias("load"))
    sums = by_label.groupBy("family").agg(
        F.max_by("label", F.struct("load", "label")).alias("main"), F.max("load").alias("main_load"),
        F.sum("load").alias("all_load"), F.count("*").alias("labels"),
    ).filter("labels > 1")
    sums = sums.select(
        "family", "main", _blocks(F.col("main_load"), load).alias("stored"), _blocks(F.col("all_load") - F.col("main_load"), load).alias("asked")
    )
    placed = members.join(sums, "family").withColumn("is_main", F.col("label") == F.col("main"))
    place = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("stored")).otherwise(F.col("asked"))).cast("int")
    placed = placed.withColumn("own", place).select("family", "is_main", "own", "stored", "asked", "node", "label", "set")
    to_main = F.transform(
        F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("asked")).otherwise(F.col("stored")) - 1),
        lambda k: F.struct(
            F.lit(0).alias("kind"), F.when(F.col("is_main"), k).otherwise(F.col("own")).alias("i"),
            F.when(F.col("is_main"), F.col("own")).otherwise(k).alias("j"), F.when(F.col("is_main"), 1).otherwise(2).alias("side"),
        ),
    )
    to_rest = F.transform(
        F.sequence(F.lit(0), F.col("asked") - 1),
        lambda k: F.struct(
            F.lit(1).alias("kind"), F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"),
            F.when(k == F.col("own"), 0).when(F.col("own") < k, 1).otherwise(2).alias("side"),
        ),
    )
    spots = F.when(F.col("is_main"), to_main).otherwise(F.concat(to_main, to_rest))
    rows = placed.withColumn("t", F.explode(spots))
    return join_groups(rows.select(F.xxhash64("family", "t.kind", "t.i", "t.j").alias("task"), F.col("t.side").alias("side"), "node", "label", "set"), percent)


# ---- the operator ---------------------------------------------------------


def jaccard_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", load: int = LOAD,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``, repeated rows included.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of runs of
    ``words`` words (lower-cased in A-Z; with fewer words, the whole sequence). ``percent`` is 51 or
    more. ``component_id`` is the smallest id reachable by links. Null and empty texts and those of
    white space have no set and link with nothing. Rows without an id link others but never give
    the id (a component of such rows alone has null). Other columns are not returned.
    """
    if not 51 <= percent <= 100:
        raise ValueError("percent has to be 51 to 100")
    bounded_batches(docs.sparkSession)
    plain = docs.select(col(doc_id).cast("long").alias("doc_id"), F.md5(col(text).cast("binary")).alias("tid"), col(text).alias("text"))
    marked = materialise(signatures(plain, words, percent), "ngram-signatures")
    routed = materialise(families(marked, percent), "families")

    one = marked.join(routed, "short").groupBy("node", "family", "n").agg(F.min(F.struct("tid", "doc_id")).alias("x"))
    nodes = materialise(one.select("node", "family", "n", "x.tid", "x.doc_id"), "family-nodes")
    texts, asked = thinned(plain, nodes, "tid"), nodes.select(F.col("tid").alias("asked_tid"), F.col("doc_id").alias("asked_id"))
    same = F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("tid") == F.col("asked_tid"))
    # an inner join, as a semi join would be moved in front of the bit map; a text and id are asked for once
    sets = sets_of(texts.join(asked, same).select("text"), words)
    loads = nodes.groupBy("family").agg(_blocks(F.sum("n"), load).alias("blocks"))
    members = nodes.select("node", "family", "n").join(loads, "family").join(sets, "node")
    members = materialise(members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "family-sets")

    links = materialise(first_links(members, percent, load), "first-links")
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        roots = components(links, "first-labels")
        both = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        labelled = large.join(both, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        links = links.unionByName(other_links(labelled, percent, load))
    roots = components(links, "ngram-links")
    return grouped(marked, roots)


def grouped(marked: DataFrame, roots: DataFrame) -> DataFrame:
    """Every row with the smallest id of its component; hot nodes are looked up by broadcast."""
    nodes = marked.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    rooted = nodes.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialise(
        rooted.join(smallest, "root", "left").select("node", "rows", F.coalesce("component_id", "first_id").alias("component_id")), "ngram-nodes"
    )
    total = known.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(known.filter(F.col("rows") > total * HOT).select("node", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    rows = marked.select("doc_id", F.col("n").alias("n_shingles"), "node").join(hot, "node", "left")
    cool = rows.filter("hot IS NULL AND node IS NOT NULL").join(known.select("node", "component_id"), "node")
    return (
        rows.filter("hot").select("doc_id", "n_shingles", F.col("hot_id").alias("component_id"))
        .unionByName(rows.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .unionByName(cool.select("doc_id", "n_shingles", "component_id"))
    )
