"""Exact repeated passages by merging Burrows-Wheeler transforms.

A byte goes if it lies in a 50-byte window that also starts in a document with a smaller id.

1. Every window picks an anchor, a 32-byte string inside it, by a rule that depends on the
   window's bytes alone, so equal windows pick equal anchors. Anchors of only one document are
   dropped; this is a filter, what it keeps is decided below.
2. Windows with the same anchor and document are one fragment of text. Fragments are dealt by
   their anchor's hash; equal ones are collapsed with their smallest id.
3. Where an anchor has several fragments, these are dealt to shards. Each shard's suffixes are
   sorted once and give its transform. The transforms are merged by refining their interleave
   a symbol at a time: after h rounds rows stand in the order of their first h symbols. A
   boundary that appears in round h has a common prefix of h - 1; after 50 rounds the blocks
   between boundaries are the intervals of equal windows. No suffix is sorted a second time.
   An anchor with one fragment is one interval for each window as it stands.
4. The smallest id of each interval returns to the documents, which drop covered bytes.

The passes meet by scan partition and unit of rows: what a unit has to know is written to the
shared folder under its partition, and the next scan reads it there. So ``docs`` has to be a
scan of files; its texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, new_folder
from dayloom.llm.warc import open_folder

WINDOW, ANCHOR, STEP, SMALL = 50, 32, 19, 13  # STEP = WINDOW - ANCHOR + 1; SMALL = ANCHOR modulo STEP
UNIT_ROWS, BLOCK = 2_048, 1 << 19  # documents of a unit; windows whose anchors are found at once
NO_ID = np.iinfo(np.int64).max
#: Anchors and fragment bytes of a group, about; bytes of a shard whose transform is built at once.
GROUP_ANCHORS, GROUP_BYTES, SHARD_BYTES = 1_000_000, 1 << 20, 256 << 10
MIX, MIX2, MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


class Unit:
    """A run of documents as one buffer, and the anchors of all its windows."""

    def __init__(self, texts: pa.Array, ids: np.ndarray):
        pieces = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
        self.ids, self.pieces = ids, pieces
        self.buffer = b"".join(pieces)
        self.starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))])
        self._anchors()

    def _anchors(self) -> None:
        """Runs of windows with one anchor, a block of windows at a time; a run may end with its block."""
        total = max(0, len(self.buffer) - WINDOW + 1)
        blocks = [self._block(a, min(total, a + BLOCK)) for a in range(0, total, BLOCK)]
        join = lambda k, kind: np.concatenate([b[k] for b in blocks]) if blocks else np.zeros(0, dtype=kind)
        self.first, self.last, self.row = (join(k, np.int64) for k in range(3))
        self.keys = join(3, np.uint64)

    def _block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = self.buffer[a : b + WINDOW - 1]
        n = len(data)
        words = np.ndarray((n,), dtype="<u8", buffer=data + b"\0" * 8, strides=(1,)).copy()
        m = n - SMALL + 1
        small = (words[:m] * MIX) ^ ((words[SMALL - 8 : SMALL - 8 + m] * MIX2) >> np.uint64(7))
        small ^= small >> np.uint64(29)
        small *= MIX3
        small = (small & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        width, reach = 1, WINDOW - SMALL + 1  # the least of every `reach` neighbours, with its place
        while 2 * width <= reach:
            small = np.minimum(small[:-width], small[width:])
            width *= 2
        if reach > width:
            small = np.minimum(small[: -(reach - width)], small[reach - width :])
        at = np.arange(b - a, dtype=np.uint32)
        anchor = at + (small.astype(np.uint32) - at) % np.uint32(STEP)
        # the documents of the block, and how many of its windows begin and how many end in each
        docs = np.arange(np.searchsorted(self.starts, a, side="right") - 1, np.searchsorted(self.starts, b))
        begins = np.maximum(self.starts[docs], a)
        ends = np.minimum(self.starts[docs + 1], b)
        row = np.repeat(docs.astype(np.int32), ends - begins)
        last = np.repeat((self.starts[docs + 1] - a - WINDOW).astype(np.int32), ends - begins)
        inside = at.view(np.int32) <= last
        at, anchor, row = at[inside].astype(np.int64), anchor[inside].astype(np.int64), row[inside].astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
        chosen = anchor[begin]
        keys = words[chosen] * MIX
        for k in range(8, ANCHOR, 8):
            keys = (keys ^ (keys >> np.uint64(31))) * MIX3 + words[chosen + k] * MIX2
        return at[begin] + a, at[end] + a, row[begin], keys ^ (keys >> np.uint64(32))

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct anchors, whether several documents have one, and each fragment's number."""
        order = np.argsort(self.keys)
        keys, rows = self.keys[order], self.row[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        number = np.empty(len(keys), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        if not len(begin):
            return keys, new, number
        return keys[begin], np.minimum.reduceat(rows, begin) != np.maximum.reduceat(rows, begin), number

    def fragments(self, kept: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fragments (sorted), their keys and smallest ids, and the fragment of each kept run."""
        runs = np.flatnonzero(kept)
        buffer = self.buffer
        texts = [buffer[a : b + WINDOW] for a, b in zip(self.first[runs].tolist(), self.last[runs].tolist(), strict=True)]
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(t, len(known)) for t in texts], dtype=np.int64)
        keys = np.zeros(len(known), dtype=np.uint64)
        keys[which] = self.keys[runs]
        smallest = np.full(len(known), NO_ID)
        np.minimum.at(smallest, which, self.ids[self.row[runs]])
        return list(known), keys, smallest, which


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Unit]]:
    number = 0
    for batch in batches:
        for a in range(0, batch.num_rows, UNIT_ROWS):
            piece = batch.slice(a, UNIT_ROWS)
            ids = piece.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            yield number, Unit(piece.column(1), ids)
            number += 1


def _by_group(keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """The groups that have some of the keys, and which ones, in order."""
    if not len(keys):
        return
    group = (keys % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(group[order[a]]), order[a:b]


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _told(folder: str) -> dict[int, dict[int, dict]]:
    """What earlier passes wrote for this task's partition: rows by unit and group."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, top = open_folder(folder)
    part = TaskContext.get().partitionId()
    found: dict[int, dict[int, dict]] = {}
    chosen = fs.FileSelector(f"{top}/part={part}", allow_not_found=True)
    for info in files.get_file_info(chosen):
        if info.is_file and info.base_name.endswith(".parquet"):
            with files.open_input_file(info.path) as file:
                for row in pq.ParquetFile(file).read().to_pylist():
                    found.setdefault(row["unit"], {})[row["grp"]] = row
    return found


def _tell(rows: DataFrame, folder: str) -> None:
    """Write rows where the scan's tasks look for them."""
    rows.repartition("part").write.partitionBy("part").parquet(folder)


def _kept(unit: Unit, told: dict[int, dict], groups: int) -> np.ndarray:
    """Which of a unit's runs have an anchor that another document has too."""
    keys, _, number = unit.distinct_keys()
    keep = np.zeros(len(keys), dtype=bool)
    for group, which in _by_group(keys, groups):
        bits = np.unpackbits(np.frombuffer(told[group]["bits"], dtype=np.uint8), count=len(which))
        keep[which] = bits.astype(bool)
    return keep[number]


class Transform:
    """The Burrows-Wheeler transform of a shard of strings, and where its rows come from."""

    def __init__(self, strings: list[bytes], numbers: np.ndarray):
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1
        # 0 ends a string; a zero byte becomes one that UTF-8 never has
        text = np.frombuffer(b"\0".join(s.replace(b"\0", b"\xff") for s in strings) + b"\0", dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        order = self._sorted(text)
        before = np.empty(len(text), dtype=np.uint8)
        before[1:] = text[:-1]
        before[begins] = 0
        of = np.repeat(np.arange(len(strings)), lengths)
        self.symbols = before[order]
        self.counts = np.bincount(text, minlength=256)
        self.string = numbers[of[order]]
        self.offset = order - begins[of[order]]

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling the compared length from 8 to 128 (strings are shorter)."""
        padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
        key = np.zeros(len(text), dtype=np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + len(text)]
        length = 8
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(len(text), dtype=np.uint64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64)
            if length >= 64 or rank[order[-1]] == len(text) - 1:
                return order
            later = np.zeros(len(text), dtype=np.uint64)
            later[:-length] = rank[length:] + np.uint64(1)
            key = (rank << np.uint64(32)) | later
            length *= 2


def merge(shards: list[Transform], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave shards by their first ``depth`` symbols.

    Returns, row by row in the merged order, the string, the offset in it, and the length of the
    prefix in common with the row before (``depth`` where it is at least that).
    """
    sizes = [len(t.symbols) for t in shards]
    n = sum(sizes)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) > 255 else np.uint8), sizes)
    common = np.full(n, depth, dtype=np.uint8)
    common[0] = 0
    block = np.zeros(n, dtype=np.int32)
    symbols = np.empty(n, dtype=np.uint8)
    rows = [np.flatnonzero(shard == k) for k in range(len(shards))]
    starts = np.concatenate([[0], np.cumsum(np.sum([t.counts for t in shards], axis=0))])
    first = np.zeros(n, dtype=bool)  # where rows of another first symbol begin
    first[starts[:-1][np.diff(starts) > 0]] = True
    for h in range(1, depth + 1):
        for t, at in zip(shards, rows, strict=True):
            symbols[at] = t.symbols
        order = np.argsort(symbols, kind="stable")
        shard, block = shard[order], block[order]
        new = first.copy()
        new[1:] |= block[1:] != block[:-1]
        new[: starts[1]] = False  # ends of strings are alike, whatever follows
        new[0] = True
        common[new & (common == depth)] = h - 1
        block = np.cumsum(new, dtype=np.int32)
        rows = [np.flatnonzero(shard == k) for k in range(len(shards))]
    string, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for t, at in zip(shards, rows, strict=True):
        string[at], offset[at] = t.string, t.offset
    return string, offset, common


def smallest_ids(strings: list[bytes], keys: np.ndarray, ids: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each distinct fragment, the smallest id that has each of its windows."""
    out = [np.full(len(s) - WINDOW + 1, i) for s, i in zip(strings, ids.tolist(), strict=True)]
    _, which, members = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[which] > 1)
    if not len(several):
        return out
    weight = np.cumsum([len(strings[k]) + 1 for k in several])
    shards, of = [], weight // shard_bytes
    for k in np.unique(of):
        numbers = several[of == k]
        shards.append(Transform([strings[i] for i in numbers], numbers))
    string, offset, common = merge(shards)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    interval = np.cumsum(common < WINDOW)
    window = offset + WINDOW <= lengths[string]
    string, offset, interval = string[window], offset[window], interval[window]
    begin = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    least = np.minimum.reduceat(ids[string], begin)
    for s, o, i in zip(string.tolist(), offset.tolist(), np.repeat(least, np.diff(np.append(begin, len(string)))).tolist(), strict=True):
        out[s][o] = i
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes) of every row of a scan.

    Windows never cross documents. Null text is empty; texts shorter than a window lose nothing.
    A row without an id counts as later than all others; rows with equal ids do not remove from
    each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, int(size * 0.08 / GROUP_ANCHORS))
    first, second = new_folder(spark, "anchors"), new_folder(spark, "intervals")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, unit in _units(batches):
            keys, several, _ = unit.distinct_keys()
            rows = list(_by_group(keys, groups))
            yield _batch({
                "grp": ([g for g, _ in rows], pa.int32()), "part": ([part] * len(rows), pa.int32()),
                "unit": ([number] * len(rows), pa.int32()),
                "keys": ([keys[w].tobytes() for _, w in rows], pa.binary()),
                "several": ([np.packbits(several[w]).tobytes() for _, w in rows], pa.binary()),
            })

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, dtype=np.uint64) for k in rows["keys"]]
        lengths = list(map(len, keys))
        several = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(rows.several, lengths, strict=True)])
        _, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        keep = count > 1
        keep[which[several > 0]] = True
        bits = np.split(keep[which], np.cumsum(lengths)[:-1])
        out = rows[["part", "unit", "grp"]].copy()
        out["bits"] = [np.packbits(b).tobytes() for b in bits]
        out["kept"] = [int(b.sum()) for b in bits]
        return out

    found = source.mapInArrow(anchors, "grp int, part int, unit int, keys binary, several binary")
    _tell(found.groupBy("grp").applyInPandas(shared, "part int, unit int, grp int, bits binary, kept long"), first)
    kept = spark.read.parquet(first).agg(F.sum("kept")).first()[0] or 0 if groups and size >= WINDOW else 0
    groups2 = max(1, int(kept * 62 / GROUP_BYTES))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, told = TaskContext.get().partitionId(), _told(first)
        for number, unit in _units(batches):
            texts, keys, ids, _ = unit.fragments(_kept(unit, told.get(number, {}), groups))
            rows = list(_by_group(keys, groups2))
            yield _batch({
                "grp": ([g for g, _ in rows], pa.int32()), "part": ([part] * len(rows), pa.int32()),
                "unit": ([number] * len(rows), pa.int32()),
                "keys": ([keys[w].tobytes() for _, w in rows], pa.binary()),
                "ids": ([ids[w].tobytes() for _, w in rows], pa.binary()),
                "lengths": ([np.array([len(texts[k]) for k in w], dtype=np.uint8).tobytes() for _, w in rows], pa.binary()),
                "texts": ([b"".join([texts[k] for k in w]) for _, w in rows], pa.binary()),
            })

    def intervals(rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        numbers = []
        for lengths, texts in zip(rows.lengths, rows.texts, strict=True):
            ends = np.cumsum(np.frombuffer(lengths, dtype=np.uint8).astype(np.int64))
            begins = np.concatenate([[0], ends[:-1]])
            numbers.append(np.array([known.setdefault(texts[a:b], len(known)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]))
        every = np.concatenate(numbers)
        keys, ids = np.zeros(len(known), dtype=np.uint64), np.full(len(known), NO_ID)
        keys[every] = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in rows["keys"]])
        np.minimum.at(ids, every, np.concatenate([np.frombuffer(i, dtype=np.int64) for i in rows.ids]))
        packed = []
        for least in smallest_ids(list(known), keys, ids):
            cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
            packed.append((np.diff(cuts).astype(np.uint8).tobytes(), least[cuts[:-1]].tobytes()))
        out = rows[["part", "unit", "grp"]].copy()
        out["runs"] = [bytes([len(packed[k][0]) for k in w]) for w in numbers]
        out["spans"] = [b"".join([packed[k][0] for k in w]) for w in numbers]
        out["least"] = [b"".join([packed[k][1] for k in w]) for w in numbers]
        return out

    found = source.mapInArrow(
        fragments, "grp int, part int, unit int, keys binary, ids binary, lengths binary, texts binary"
    )
    _tell(found.groupBy("grp").applyInPandas(intervals, "part int, unit int, grp int, runs binary, spans binary, least binary"), second)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, least = _told(first), _told(second)
        for number, unit in _units(batches):
            kept = _kept(unit, told.get(number, {}), groups)
            ranges = _ranges(unit, kept, least.get(number, {}), groups2)
            yield _results(unit, *ranges)

    return source.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _ranges(unit: Unit, kept: np.ndarray, told: dict[int, dict], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the unit's buffer that go, by start."""
    _, keys, _, which = unit.fragments(kept)
    runs = np.flatnonzero(kept)
    spans: list[np.ndarray | None] = [None] * len(keys)
    least: list[np.ndarray | None] = [None] * len(keys)
    for group, members in _by_group(keys, groups):
        row = told[group]
        counts = np.frombuffer(row["runs"], dtype=np.uint8).astype(np.int64)
        all_spans = np.frombuffer(row["spans"], dtype=np.uint8).astype(np.int64)
        all_least = np.frombuffer(row["least"], dtype=np.int64)
        ends = np.cumsum(counts)
        for k, a, b in zip(members.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            spans[k], least[k] = all_spans[a:b], all_least[a:b]
    if not len(runs):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    counts = np.array([len(spans[k]) for k in which])
    span = np.concatenate([spans[k] for k in which])
    value = np.concatenate([least[k] for k in which])
    of = np.repeat(np.arange(len(runs)), counts)
    end = np.cumsum(span)
    inside = end - span - np.repeat((np.cumsum(np.bincount(of, weights=span)) - np.bincount(of, weights=span)).astype(np.int64), counts)
    begin = unit.first[runs][of] + inside
    gone = value < unit.ids[unit.row[runs]][of]
    return begin[gone], (begin + span - 1 + WINDOW)[gone]


def _results(unit: Unit, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    change = np.zeros(len(unit.buffer) + 1, dtype=np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    data = np.frombuffer(unit.buffer, dtype=np.uint8)
    ids, sizes, removed, spans, kept = [], [], [], [], []
    for row in range(len(unit.pieces)):
        a, b = int(unit.starts[row]), int(unit.starts[row + 1])
        flags = gone[a:b]
        ids.append(None if unit.ids[row] == NO_ID else int(unit.ids[row]))
        sizes.append(b - a)
        removed.append(int(flags.sum()))
        spans.append(int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum()))
        kept.append(data[a:b][~flags].tobytes() if removed[-1] else unit.pieces[row])
    kind = pa.int64()
    return _batch({
        "doc_id": (ids, kind), "n_bytes": (sizes, kind), "n_removed": (removed, kind), "n_spans": (spans, kind),
        "kept": (kept, pa.binary()),
    })


