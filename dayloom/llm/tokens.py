"""Token ids in seekable zstandard files: independent frames, checksums, a trailing seek table.

File layout (the public seekable format): frames that decompress on their own, then a skippable
frame with one entry per frame (compressed size, decompressed size, low 32 bits of the XXH64 of
the content), the number of frames, a descriptor byte and a magic number. The content is a
stream of unsigned 32-bit little-endian ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, materialise, new_folder, tasks_for, worker_memo
from dayloom.llm.warc import open_folder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = "<III", "<IBI"
ENTRY_SIZE, FOOTER_SIZE = struct.calcsize(ENTRY), struct.calcsize(FOOTER)
#: Documents encoded together: their equal words are looked up once.
BATCH_DOCS = 4096
#: Bytes of the words and ids a worker remembers, about; beyond it the older half is forgotten.
REMEMBERED = 60_000_000
#: What an entry takes beside the letters and the ids: two objects and its place in the table.
ENTRY_BYTES = 180

INDEX_SCHEMA = "doc_id long, part int, sequence int, file string, frame int, at long, n_tokens long"


#: A full stop or comma after a letter or digit, before white space or the end, is a piece of its
#: own to the tokenizer. Only letters that keep their class in lower case are listed.
STOP = "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,])([ \\t\\n\\v\\f\\r]|$)"


class WordEncoder:
    """The tokenizer applied word by word, with a bounded memory of words already encoded.

    Only for tokenizers that lower-case, drop white space and never join across it, as the word
    BPE does: there the ids of a text are those of its words in order. Words are cut at ASCII
    white space, a subset of what the tokenizer drops, and before a stop. New words of a batch
    are encoded in one call.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(definition)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.weight = 0  # of the young ones

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        ends = (4 * np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(words) + 1))).tolist()
        return {w: ids[a:b] for w, a, b in zip(words, ends, ends[1:], strict=False)}

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if self.weight > REMEMBERED // 2:
            self.old, self.young, self.weight = self.young, {}, 0
        young, old = self.young, self.old
        pieces = list(map(young.get, words))
        gaps = [k for k, piece in enumerate(pieces) if piece is None]
        young.update((words[k], old[words[k]]) for k in gaps if words[k] in old)
        unknown = [words[k] for k in gaps if words[k] not in young]
        if unknown:
            young.update(self._encoded(unknown))
        for k in gaps:
            pieces[k] = young[words[k]]
            self.weight += ENTRY_BYTES + len(words[k]) + len(pieces[k])
        return pieces

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts one after the other, and where each text begins."""
        import pyarrow.compute as pc

        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, STOP, r"\1 \2\3"))
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        pieces = self._look_up(words.dictionary.to_pylist())
        blob = np.frombuffer(b"".join(pieces), dtype="<u4")
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[which]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        at = np.repeat(starts[which] - ends[:-1], per_word) + np.arange(ends[-1])
        cuts = split.offsets.to_numpy().astype(np.int64)
        return blob[at], ends[cuts - cuts[0]]


class SeekableWriter:
    """Appends content to frames; ``close`` writes the seek table."""

    def __init__(self, out, frame_bytes: int, level: int):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.held: list[bytes] = []
        self.size, self.total = 0, 0
        self.entries: list[bytes] = []

    @property
    def frame(self) -> int:
        return len(self.entries)

    def add(self, content: bytes) -> tuple[int, int]:
        """Append one document; returns its first frame and the byte offset within that frame."""
        if self.size >= self.frame_bytes:
            self.flush()
        place = (self.frame, self.size)
        for a in range(0, len(content), self.frame_bytes):  # a long document spans frames
            if a and self.size:
                self.flush()
            piece = content[a : a + self.frame_bytes]
            self.held.append(piece)
            self.size += len(piece)
        self.total += len(content)
        return place

    def flush(self) -> None:
        import xxhash

        if not self.size:
            return
        content = b"".join(self.held)
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.entries.append(struct.pack(ENTRY, len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(self.entries) + struct.pack(FOOTER, len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class SeekableReader:
    """Reads chosen frames of a file; a wrong checksum raises."""

    def __init__(self, file, size: int):
        import zstandard

        self.file = file
        self.unpacker = zstandard.ZstdDecompressor()
        file.seek(size - FOOTER_SIZE)
        frames, descriptor, magic = struct.unpack(FOOTER, file.read(FOOTER_SIZE))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("not a seekable file with checksums")
        file.seek(size - FOOTER_SIZE - frames * ENTRY_SIZE)
        entries = np.frombuffer(file.read(frames * ENTRY_SIZE), dtype="<u4").reshape(frames, 3)
        self.packed, self.sizes, self.sums = (entries[:, k].astype(np.int64) for k in range(3))
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])

    def read(self, frame: int) -> bytes:
        import xxhash

        self.file.seek(int(self.starts[frame]))
        content = self.unpacker.decompress(
            self.file.read(int(self.packed[frame])), max_output_size=int(self.sizes[frame])
        )
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame} is damaged")
        return content


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    frame_bytes: int = 256 << 10,
    max_file_bytes: int = 1 << 30,
    level: int = 3,
    partitions: int | None = None,
) -> DataFrame:
    """Encode every text, write ids in ascending ``doc_id`` order, return the index (a written table).

    Null text is empty and gives just the end id. Rows without an id come first; rows with equal
    ids follow each other by text. Ranges of ids are dealt to tasks by id and text together, so
    copies of one row cannot gather in a task beyond equal pairs. ``tokenizer`` is the driver's
    path of a tokenizer file of the kind :class:`WordEncoder` takes; its content travels with the
    tasks. Other columns are not written.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    definition = Path(tokenizer).read_text(encoding="utf-8")
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(
        col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text")
    )
    dealt = rows.repartitionByRange(
        partitions or tasks_for(spark), "doc_id", F.xxhash64("text")
    ).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_folder(folder)
        files.create_dir(top, recursive=True)
        context = TaskContext.get()
        part, out, count, name = context.partitionId(), None, 0, ""
        encoder = worker_memo(f"words {zlib.crc32(definition.encode())}", lambda: WordEncoder(definition))
        end = struct.pack("<I", end_id)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("part", pa.int32()), ("sequence", pa.int32()), ("file", pa.string()),
             ("frame", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64())]
        )
        for batch in batches:
            index = []
            for a in range(0, batch.num_rows, BATCH_DOCS):
                piece = batch.slice(a, BATCH_DOCS)
                ids, cuts = encoder.encode(piece.column(1))
                for did, x, y in zip(piece.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if out is None or out.total >= max_file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{part:06d}-{context.taskAttemptId()}-{count:03d}.zst"
                        out = SeekableWriter(files.open_output_stream(f"{top}/{name}", compression=None), frame_bytes, level)
                        count += 1
                    frame, at = out.add(ids[x:y].tobytes() + end)
                    index.append((did, part, count - 1, name, frame, at, y - x + 1))
            columns = list(zip(*index, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    index = dealt.mapInArrow(write, INDEX_SCHEMA).withColumn("folder", F.lit(folder))
    return materialise(index, "token-index")


def read_tokens(index: DataFrame, frames_per_group: int = 64) -> DataFrame:
    """Read the documents of the given index rows: ``ids`` as bytes, and what counts them.

    Adds ``start``, the number of ids in all documents before it, from the index rows given (the
    whole index for positions in the whole output). Frames that hold none of the rows are not
    decompressed.
    """
    # one row per file: as many as tasks wrote, plus one per max_file_bytes
    files = index.groupBy("part", "sequence").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "sequence", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))

    def fetch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "at"], kind="stable")
        place, top = open_folder(rows.folder.iloc[0])
        path = f"{top}/{rows.file.iloc[0]}"
        size = place.get_file_info(path).size
        out, held, content = [], -1, b""
        with place.open_input_file(path) as file:
            reader = SeekableReader(file, size)
            before = np.concatenate([[0], np.cumsum(reader.sizes)])
            for did, frame, at, n in zip(rows.doc_id, rows.frame, rows["at"], rows.n_tokens, strict=True):
                start, wanted = int(before[frame] + at) // 4, 4 * int(n)
                ids = b""
                while len(ids) < wanted:
                    if frame != held:
                        held, content = frame, reader.read(frame)
                    ids += content[at : at + wanted - len(ids)]
                    frame, at = frame + 1, 0
                out.append((did, start, len(ids) // 4, zlib.crc32(ids), ids))
        part, sequence = int(rows.part.iloc[0]), int(rows.sequence.iloc[0])
        out = pd.DataFrame(out, columns=["doc_id", "at_file", "n_tokens", "ids_crc32", "ids"])
        return out.assign(part=part, sequence=sequence).astype({"doc_id": "Int64"})

    group = F.floor(F.col("frame") / F.lit(frames_per_group)).alias("frames")
    read = index.groupBy("folder", "file", group).applyInPandas(
        fetch, "doc_id long, at_file long, n_tokens long, ids_crc32 long, ids binary, part int, sequence int"
    )
    return read.join(bases, ["part", "sequence"]).select(
        "doc_id", (F.col("base") + F.col("at_file")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
