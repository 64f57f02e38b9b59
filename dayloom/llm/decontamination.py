"""Benchmark decontamination by spaced seeds.

A mask selects some of the tokens at its span and ignores the others, so a substituted word in
an ignored position does not spoil a hit. The selected tokens of every position are hashed, for
benchmark items and for documents alike, and equal hashes are hits. Around each hit the item and
the document are compared token by token along the hit's diagonal; every maximal stretch of which
enough is equal is an overlap.

The benchmark is the query set: its hashes go to the tasks in blocks of a fixed size, and each
block meets every document.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, free_name

#: '1' is compared, '0' ignored. Any 13 tokens with up to three substitutions keep a hit.
MASKS = ("11101", "1101011", "11000111")
OVERLAP = "array<struct<item_id:bigint,start:int,length:int,matched:int>>"


@dataclass(frozen=True)
class Settings:
    """``min_tokens``: overlaps are at least that long, or as long as a shorter item."""

    masks: tuple[str, ...] = MASKS
    min_tokens: int = 13
    min_share: float = 0.8  # of an overlap's tokens that are equal
    block_items: int = 20_000  # benchmark items that go to the tasks at once
    block_chars: int = 50_000_000


def normal(word: str) -> str:
    """Lower case, without punctuation around it."""
    return word.lower().strip(string.punctuation)


def split_words(texts):
    """The pieces of each text of an Arrow array between white space, of Unicode too."""
    import pyarrow.compute as pc

    return pc.utf8_split_whitespace(pc.fill_null(texts, ""))


def outermost(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those stretches (start, length, equal tokens) that lie in no other; of equal places the best."""
    kept, reach = [], -1
    for a, n, m in sorted(stretches, key=lambda x: (x[0], -x[1], -x[2])):
        if a + n > reach:
            kept.append((a, n, m))
            reach = a + n
    return kept


class SeedIndex:
    """Hashed seeds of a block of items: sorted hashes, with the item and position of each."""

    def __init__(self, items: Sequence[tuple[int | None, str | None]], s: Settings):
        self.s = s
        import pyarrow as pa

        pieces = split_words(pa.array([t for _, t in items], pa.string())).to_pylist()
        split = [(i, [w for w in map(normal, ws) if w]) for (i, _), ws in zip(items, pieces, strict=True)]
        split = [(i, w) for i, w in split if w]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in split for w in ws), 1)}
        self.ids = [i for i, _ in split]
        self.tokens = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in split]
        self.share = Fraction(s.min_share).limit_denominator(1000)
        masks = [(np.flatnonzero(np.array(list(m)) == "1"), len(m)) for m in s.masks]
        # short items of which some allowed substitutions spoil every seed have seeds of all that is left
        for n in sorted({len(t) for t in self.tokens if len(t) < s.min_tokens}):
            placed = [set((m + p).tolist()) for m, span in masks[: len(s.masks)] for p in range(n - span + 1)]
            for gone in combinations(range(n), int(n * (1 - self.share))):
                if all(x & set(gone) for x in placed):
                    masks.append((np.setdiff1d(np.arange(n), gone), n))
        self.masks, self.spans = [m for m, _ in masks], [span for _, span in masks]
        self.factors = [
            np.random.default_rng([11, k]).integers(1, 2**63, len(m), dtype=np.uint64) | np.uint64(1)
            for k, m in enumerate(self.masks)
        ]
        hashes, items_at, places = [], [], []
        for number, tokens in enumerate(self.tokens):
            for k in range(len(self.masks)):
                h, at = self.seeds(tokens, k)
                hashes.append(h)
                places.append(at)
                items_at.append(np.full(len(h), number))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        hashes = join(hashes, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.items = join(items_at, np.int64)[order]
        self.places = join(places, np.int64)[order]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def seeds(self, tokens: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of a mask where all tokens it selects are known (not zero)."""
        n = len(tokens) - self.spans[mask] + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        known = np.ones(n, dtype=bool)
        for offset in self.masks[mask]:
            known &= tokens[offset : offset + n] > 0
        at = np.flatnonzero(known)
        h = np.zeros(len(at), dtype=np.uint64)
        for offset, factor in zip(self.masks[mask], self.factors[mask], strict=True):
            h += tokens[at + offset].astype(np.uint64) * factor
        h ^= h >> np.uint64(32)
        return h * np.uint64(0x9E3779B97F4A7C15), at

    def stretches(self, tokens: np.ndarray, item: int, shift: int) -> list[tuple[int, int, int]]:
        """The maximal stretches on a diagonal: start in the document, length, equal tokens.

        At least ``min_share`` of a stretch is equal, and no longer one holds it. It begins and ends
        on equal tokens; only if no such stretch is long enough may one also reach to the item's own ends.
        """
        wanted = self.tokens[item]
        a, b = max(0, -shift), min(len(wanted), len(tokens) - shift)
        equal = tokens[a + shift : b + shift] == wanted[a:b]
        least = min(self.s.min_tokens, len(wanted))
        if len(equal) < least:
            return []
        share = self.share
        # a stretch has the share if the total does not fall from its begin to its end
        total = np.concatenate([[0], np.cumsum(share.denominator * equal.astype(np.int64) - share.numerator)])
        equals = np.concatenate([[0], np.cumsum(equal)])
        may_begin, may_end = equal.copy(), equal.copy()
        for _ in range(2):
            low = np.minimum.accumulate(np.where(may_begin, total[:-1], np.iinfo(np.int64).max))
            ends = np.flatnonzero(may_end) + 1
            begins = np.searchsorted(-low, -total[ends], "left")
            # a later end with the same begin or an earlier one holds the stretch
            later = np.minimum.accumulate(np.append(begins[1:], len(equal) + 1)[::-1])[::-1][: len(begins)]
            kept = (ends - begins >= least) & (begins < later)
            if kept.any():
                return [
                    (a + x + shift, y - x, int(equals[y] - equals[x]))
                    for x, y in zip(begins[kept].tolist(), ends[kept].tolist(), strict=True)
                ]
            may_begin[0] |= a == 0
            may_end[-1] |= b == len(wanted)
        return []

    def search(self, texts) -> list[list[dict]]:
        """The overlaps of each text of an Arrow array, by item and place."""
        split = split_words(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        look = self.vocabulary.get
        # -1: a piece that has nothing but punctuation is no token
        code = np.array([look(w, 0) if w else -1 for w in map(normal, words)], dtype=np.int64).reshape(-1)
        tokens = code[coded.indices.to_numpy()]
        of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        real = tokens >= 0
        tokens, of = tokens[real], of[real]
        begins = np.searchsorted(of, np.arange(len(texts) + 1))
        found: dict[tuple[int, int, int], None] = {}
        for mask in range(len(self.masks)):
            h, at = self.seeds(tokens, mask)
            at_sieve = self.sieve[(h >> np.uint64(44)).astype(np.int64)]
            h, at = h[at_sieve], at[at_sieve]
            same = of[at] == of[at + self.spans[mask] - 1]  # no seed crosses documents
            h, at = h[same], at[same]
            low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            hit = np.flatnonzero(high > low)
            for k, x, y in zip(hit.tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                row = int(of[at[k]])
                place = int(at[k] - begins[row])
                found.update(dict.fromkeys((row, int(i), place - int(q)) for i, q in zip(self.items[x:y], self.places[x:y], strict=True)))
        seen: list[dict[int, list]] = [{} for _ in range(len(texts))]
        for row, item, shift in found:
            stretches = self.stretches(tokens[begins[row] : begins[row + 1]], item, shift)
            if stretches:
                seen[row].setdefault(item, []).extend(stretches)
        return [
            [
                {"item_id": self.ids[i], "start": a, "length": n, "matched": m}
                for i, stretches in sorted(s.items()) for a, n, m in outermost(stretches)
            ]
            for s in seen
        ]


def _blocks(benchmark: DataFrame, item_id: str, text: str, s: Settings) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's items in blocks of bounded size, one after the other."""
    rows = benchmark.select(col(item_id).cast("long").alias("i"), col(text).alias("t")).toLocalIterator()
    block, chars = [], 0
    for row in rows:
        if block and (len(block) >= s.block_items or chars + len(row["t"] or "") > s.block_chars):
            yield block
            block, chars = [], 0
        block.append((row["i"], row["t"]))
        chars += len(row["t"] or "")
    if block:
        yield block


def _search(index: SeedIndex, text: Column) -> Column:
    @F.pandas_udf(OVERLAP)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pyarrow as pa

        for batch in batches:
            out: list[list[dict]] = []
            texts = pa.array(batch, pa.string())
            for a in range(0, len(texts), 1024):
                out += index.search(texts.slice(a, 1024))
            yield pd.Series(out, index=batch.index, dtype=object)

    return search(text)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    result: str = "overlaps", settings: Settings = Settings(),
) -> DataFrame:
    """Add an array of overlaps with benchmark items to every document (empty: a clean one).

    An overlap is a stretch of the document that matches an item along some diagonal and lies in no
    other stretch for that item, so an item that a text holds twice has two. ``start``, ``length`` and
    ``matched`` count tokens: words in lower case without punctuation around them. Null and empty texts overlap nothing, and nothing does with an empty benchmark;
    items of equal text are all reported. Repeated rows keep their own arrays. A clashing name
    gets underscores in front.
    """
    bounded_batches(docs.sparkSession)
    name = free_name(docs, result)
    out = docs.withColumn(name, F.array().cast(OVERLAP))
    for block in _blocks(benchmark, item_id, item_text, settings):
        out = out.withColumn(name, F.concat(col(name), _search(SeedIndex(block, settings), col(text))))
    return out
