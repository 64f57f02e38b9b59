"""Alignment of two tokenizers: byte ranges on which their tokens begin and end together.

Tasks encode texts with both tokenizers and merge the two sorted lists of token ends. Merge-path
partitioning divides that merge: a binary search along each diagonal of the (A ends x B ends) grid
finds where a merge has taken so many ends, so pieces of equal work are independent. A piece emits
the ends that both lists have (its overlaps); an equal pair that a diagonal separates is found when
neighbouring pieces are stitched, and the groups follow from the cuts.

Counts of linked id pairs are corpus-wide. Documents are gathered into units; a unit says once which
pairs it holds and is told once what they count, so a frequent pair costs one row a unit, not one a
document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, materialise, worker_memo

#: Ends that a piece of the merge takes; pairs that a unit holds, about; links expanded at a time.
PIECE, UNIT, LINKS = 1 << 16, 1 << 20, 1 << 20
#: Bytes of text encoded together, about: tokens of a text take some forty times its size while they are lists.
TEXT = 1 << 19
#: Characters whose classes (letter, number, space) no version of the Unicode tables disputes.
SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")
# --- fixed value: how byte-level tokenizers cut a text before they merge bytes ---
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

UNIT_COLUMNS = {
    "unit": pa.int64(), "ids": pa.binary(), "named": pa.binary(), "n_a": pa.binary(), "n_b": pa.binary(), "n_groups": pa.binary(),
    "n_links": pa.binary(), "groups": pa.list_(pa.string()), "n_pairs": pa.binary(), "pairs": pa.binary(), "times": pa.binary(),
    "codes": pa.list_(pa.int64()), "held": pa.list_(pa.int64()),
}
UNIT_SCHEMA = (
    "unit long, ids binary, named binary, n_a binary, n_b binary, n_groups binary, n_links binary, groups array<string>, "
    "n_pairs binary, pairs binary, times binary, codes array<long>, held array<long>"
)


# ---- tokenizers -----------------------------------------------------------


def _byte_of_symbol() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as printable symbols."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteLevel:
    """A byte-level BPE read from a tokenizers file; special tokens in texts are plain text.

    Where the order of merges is that of the ids, a rank-based encoder of the same vocabulary
    gives the same ids several times faster; texts with characters outside ``SETTLED`` and other
    vocabularies are encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        symbols = _byte_of_symbol()
        vocabulary = {t: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t in model["vocab"]}
        self.bytes_of = [b""] * (max(model["vocab"].values()) + 1)
        for token, number in model["vocab"].items():
            self.bytes_of[number] = vocabulary[token]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = None
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            ranks = {vocabulary[t]: n for t, n in model["vocab"].items() if all(c in symbols for c in t) and n <= merged[-1]}
            if len(ranks) == merged[-1] + 1:
                self.fast = tiktoken.Encoding("pairs", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and SETTLED.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


NONE = np.zeros(0, dtype=np.int64)


class Pieces:
    """A sentence-piece model; it puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.sizes = [np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (self.a, self.b)]
        self.texts = [list(map(str, range(len(t.bytes_of)))) for t in (self.a, self.b)]
        self.width = len(self.b.bytes_of)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where the text is null or empty or the tokens' bytes are not its bytes."""
        if not text:
            return NONE, NONE
        whole = " " + text
        wanted = whole.encode()
        out = []
        for t, asked in ((self.a, whole), (self.b, text)):
            ids = t.encode(asked)
            if b"".join(map(t.bytes_of.__getitem__, ids)) != wanted:
                return NONE, NONE
            out.append(np.array(ids, dtype=np.int64))
        return tuple(out)


# ---- merge path -----------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` the merge has taken at every ``piece``-th step and at its end."""
    steps = np.unique(np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b)))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        take = np.zeros(len(steps), dtype=bool)
        take[open_] = a[mid[open_]] <= b[steps[open_] - mid[open_] - 1]
        low, high = np.where(open_ & take, mid + 1, low), np.where(open_ & ~take, mid, high)
    return low, steps - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values that both sorted lists have, found piece by piece."""
    i, j = diagonals(a, b, piece)
    in_a, in_b = [], []
    for k in range(len(i) - 1):
        x, y = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        if len(x) and len(y):
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = np.flatnonzero(y[at] == x)
            in_a.append(same + i[k])
            in_b.append(at[same] + j[k])
        last, after = i[k + 1] - 1, j[k + 1]  # a value of ``a`` is taken first, so its twin opens the next piece
        if last >= i[k] and after < len(b) and a[last] == b[after]:
            in_a.append(np.array([last]))
            in_b.append(np.array([after]))
    if not in_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(in_a), np.concatenate(in_b)


def pairs_of_groups(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``doc``, ``pair`` (a * width + b) and ``times`` of the distinct links of groups that end at the given places.

    ``doc`` numbers the document of each group, rising. Links are expanded ``LINKS`` at a time.
    """
    n_a, n_b = np.diff(np.r_[0, end_a + 1]), np.diff(np.r_[0, end_b + 1])
    group = np.repeat(np.arange(len(end_a)), n_a)
    first_b = np.r_[0, end_b + 1][:-1]
    links = n_b[group]
    upto = np.cumsum(links)
    docs, pairs, times = [], [], []
    begin = 0
    while begin < len(a):
        done = upto[begin] - links[begin]
        end = max(begin + 1, int(np.searchsorted(upto, done + LINKS, side="right")))
        n = links[begin:end]
        skipped = np.cumsum(n) - n
        of = np.repeat(np.arange(begin, end), n)
        at = np.repeat(first_b[group[begin:end]] - skipped, n) + np.arange(len(of))
        where = doc[group[of]]
        key = (where - where[0]) * (np.int64(1) << 40) + a[of] * np.int64(width) + b[at]
        key, count = np.unique(key, return_counts=True)
        docs.append((key >> 40) + where[0])
        pairs.append(key & ((1 << 40) - 1))
        times.append(count)
        begin = end
    if len(docs) > 1:  # a document may lie in several pieces
        d, p, t = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
        order = np.lexsort((p, d))
        d, p, t = d[order], p[order], t[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])])
        return d[first], p[first], np.add.reduceat(t, first)
    return (docs[0], pairs[0], times[0]) if docs else (np.zeros(0, dtype=np.int64),) * 3


def align_batch(aligner: Aligner, texts: list[str | None], spell: str) -> dict:
    """Counts, groups and distinct linked pairs of texts, as arrays over the texts."""
    ids = [aligner.tokens(t) for t in texts]
    n_a, n_b = (np.array([len(x[k]) for x in ids], dtype=np.int64) for k in range(2))
    a, b = (np.concatenate([x[k] for x in ids]) for k in range(2))
    # the two token lists of a document cover the same bytes, so ends of all texts rise in step
    end_a, end_b = common_ends(np.cumsum(aligner.sizes[0][a]), np.cumsum(aligner.sizes[1][b]))
    doc = np.searchsorted(np.cumsum(n_a), end_a, side="right")
    sizes_a, sizes_b = np.diff(np.r_[0, end_a + 1]), np.diff(np.r_[0, end_b + 1])
    where, pairs, times = pairs_of_groups(a, b, end_a, end_b, doc, aligner.width)
    n_groups = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    n_links = np.bincount(doc, weights=sizes_a * sizes_b, minlength=len(texts)).astype(np.int64)
    groups = []
    spelt_a, spelt_b = aligner.texts
    first_group = np.cumsum(n_groups) - n_groups
    for k, (x, y) in enumerate(ids):
        at = slice(first_group[k], first_group[k] + n_groups[k])
        groups.append(_spelt(x.tolist(), y.tolist(), sizes_a[at].tolist(), sizes_b[at].tolist(), spelt_a, spelt_b, spell))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
        "n_pairs": np.bincount(where, minlength=len(texts)).astype(np.int64), "pairs": pairs, "times": times,
    }


def _spelt(a: list[int], b: list[int], n_a: list[int], n_b: list[int], spelt_a: list[str], spelt_b: list[str], spell: str) -> str:
    if not n_a:
        return ""
    x, y = [spelt_a[k] for k in a], [spelt_b[k] for k in b]
    i = j = 0
    out = []
    for p, q in zip(n_a, n_b, strict=True):
        if p == 1 and q == 1:
            out.append(f"{x[i]}|{y[j]}")
        else:
            out.append(",".join(x[i : i + p]) + "|" + ",".join(y[j : j + q]))
        i += p
        j += q
    text = ";".join(out)
    return text if spell == "text" else hashlib.new(spell, text.encode()).hexdigest()


# ---- units ----------------------------------------------------------------


def bounded_parts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of a text column, one row at least."""
    if batch.num_rows:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        part = upto // size
        for begin, end in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(part)]))(np.flatnonzero(np.diff(part)) + 1), strict=True):
            yield batch.slice(begin, end - begin)


def units_of(docs: DataFrame, a_path: str, b_path: str, spell: str, unit: int) -> DataFrame:
    """Documents (doc_id, text) encoded, aligned and packed into units of about ``unit`` pairs."""
    schema = pa.schema(list(UNIT_COLUMNS.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = worker_memo(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        number = TaskContext.get().partitionId() << 32
        held, load = [], 0
        for batch in (part for whole in batches for part in bounded_parts(whole, 1, TEXT)):
            ids = batch.column(0)
            done = align_batch(aligner, batch.column(1).to_pylist(), spell)
            done["named"] = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            done["ids"] = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(done)
            load += len(done["pairs"]) + batch.num_rows
            if load >= unit:
                yield _packed(number, held, schema)
                held, load, number = [], 0, number + 1
        if held:
            yield _packed(number, held, schema)

    return docs.mapInArrow(run, UNIT_SCHEMA)


def _packed(number: int, held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    row = {name: np.concatenate([h[name] for h in held]) for name in ("ids", "named", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "pairs", "times")}
    codes, count = np.unique(row["pairs"], return_counts=True)
    row["pairs"] = np.searchsorted(codes, row["pairs"]).astype(np.uint32)  # places in ``codes``
    row["times"] = row["times"].astype(np.uint32)
    cells = {name: [value.tobytes()] for name, value in row.items()}
    cells |= {"unit": [number], "groups": [[g for h in held for g in h["groups"]]], "codes": [codes], "held": [count]}
    return pa.RecordBatch.from_arrays([pa.array(cells[n], t) for n, t in UNIT_COLUMNS.items()], schema=schema)


def pair_counts(units: DataFrame, width: int) -> DataFrame:
    """``code``, ``count`` (documents that hold the pair) and ``best`` (no pair of its A id counts more)."""
    said = units.select(F.explode(F.arrays_zip("codes", "held")).alias("x")).select("x.codes", "x.held")
    counts = materialise(said.groupBy(F.col("codes").alias("code")).agg(F.sum("held").alias("count")), "pair-counts")
    a_id = F.floor(F.col("code") / F.lit(width)).cast("int")
    highest = F.broadcast(counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest")))  # a row a token of A at most
    return counts.join(highest, a_id == F.col("a")).select("code", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, spell: str = "text", doc_id: str = "doc_id", text: str = "text", unit: int = UNIT,
) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups`` of every row.

    A (``a_path``, a byte-level tokenizers file) encodes a space and the text, B (``b_path``, a
    sentence-piece model) the text. Byte offsets where tokens of both end cut them into groups;
    links are all pairs of an A and a B token of a group. A pair's count is the number of rows
    that hold it; ``n_best`` counts the links whose pair no other pair of its A id exceeds,
    ``count_sum`` adds the counts over links. ``groups`` spells the groups as
    ``a1,a2|b1;a3|b2,b3``, or is its digest where ``spell`` names a hash function.

    Null and empty texts, and texts that one of the tokenizers cannot give back byte by byte, have
    no tokens: zeros and empty groups. Repeated rows, also with equal ids, count each. Other
    columns are not returned.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    units = materialise(units_of(plain, a_path, b_path, spell, unit), "aligned")
    width = len(Pieces(b_path).bytes_of)
    asked = units.select(F.col("unit").alias("asker"), F.explode("codes").alias("code")).join(pair_counts(units, width), "code")

    def look(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = mine.iloc[0]
        read = lambda name, kind=np.int64: np.frombuffer(row[name], dtype=kind)
        told = told.sort_values("code")
        count, best = told["count"].to_numpy(dtype=np.int64), told["best"].to_numpy(dtype=bool)
        pair, times = read("pairs", np.uint32), read("times", np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(read("n_pairs"))), read("n_pairs"))
        out = {"doc_id": pd.array(read("ids"), dtype="Int64")}
        out["doc_id"][read("named", np.uint8) == 0] = pd.NA
        out |= {name: read(name) for name in ("n_a", "n_b", "n_groups", "n_links")}
        n_best, count_sum = np.zeros(len(read("n_a")), dtype=np.int64), np.zeros(len(read("n_a")), dtype=np.int64)
        if len(pair):
            np.add.at(n_best, of, times * best[pair])
            np.add.at(count_sum, of, times * count[pair])
        return pd.DataFrame(out | {"n_best": n_best, "count_sum": count_sum, "groups": list(row["groups"])})

    kept = units.select("unit", "ids", "named", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs", "pairs", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return kept.groupBy("unit").cogroup(asked.groupBy("asker")).applyInPandas(look, schema)
