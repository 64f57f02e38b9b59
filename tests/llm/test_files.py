import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dayloom.llm import tokens, warc
from tests.llm.helpers import awkward, awkward_rows

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>one</p>", "<p>two é 漢</p>", None, "", "z" * 300_000]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 3 else None, html[i % 5], "own") for i in range(40)]
    rows += [(None, "u", "<p>one</p>", "own"), (7, "u", html[2], "own"), (7, "u", html[2], "own")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    index = warc.write_warc(table, folder=str(tmp_path / "w"), max_file_bytes=2_000)
    out = warc.read_warc(index, stretch_bytes=1_000, read_bytes=900).collect()
    assert len(out) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = sorted(
        (-1 if i is None else i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
         "response" if i is None or first[h or ""] >= i else "revisit",
         -1 if i is None or first[h or ""] >= i else first[h or ""])
        for i, _, h, _ in rows
    )
    none = lambda x: -1 if x is None else x
    got = sorted((none(r[0]), r["payload_bytes"], r["payload_digest"], r["record_type"], none(r["refers_to"])) for r in out)
    assert got == expected
    one = warc.read_warc(index.filter("page_id = 1")).collect()
    assert [bytes(r["payload"]).decode() for r in one] == [html[1]]
    assert warc.read_warc(warc.write_warc(table.filter("false"), folder=str(tmp_path / "e"))).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    table = spark.createDataFrame([(i, "u", h) for i, h in enumerate(["a", "a", "bb" * 9, "bb" * 9])], "page_id long, url string, html string")
    out = warc.read_warc(warc.write_warc(table, folder=str(tmp_path / "w"), min_bytes=5)).collect()
    assert {r["page_id"]: r["record_type"] for r in out} == {0: "response", 1: "response", 2: "response", 3: "revisit"}


def test_token_files_round_trip(spark, tmp_path):
    rows = awkward_rows()
    index = tokens.write_tokens(awkward(spark), TOKENIZER, folder=str(tmp_path / "t"), frame_bytes=4_000, max_file_bytes=60_000, partitions=3)
    out = tokens.read_tokens(index, frames_per_group=2).orderBy("start").collect()
    coder = Tokenizer.from_file(TOKENIZER)
    ids = lambda t: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    expected = sorted(((-1 if r[0] is None else r[0]), ids(r[1])) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in out) == expected
    position = 0
    for r in out:
        assert r["start"] == position and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        position += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert order == sorted(order)
    assert tokens.read_tokens(index.filter("doc_id = 3")).count() == 1
    assert tokens.read_tokens(tokens.write_tokens(awkward(spark).filter("false"), TOKENIZER, folder=str(tmp_path / "e"))).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(4)
    coder, own = Tokenizer.from_file(TOKENIZER), tokens.WordEncoder(open(TOKENIZER, encoding="utf-8").read())
    parts = ["a.", "Über,", "é.", "İ.", "don't", "..", "<|endoftext|>", "<|ENDOFTEXT|>", "\x0b", "\x85", "\xa0", "A,b", " ", "\n", "3.5,", "WORD."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    for a in range(0, 300, 7):
        ids, cuts = own.encode(pa.array(texts[a : a + 7]))
        for k, text in enumerate(texts[a : a + 7]):
            assert ids[cuts[k] : cuts[k + 1]].tolist() == coder.encode(text, add_special_tokens=False).ids, text


def test_frames_are_independent_and_checked():
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    sink = Sink()
    writer = tokens.SeekableWriter(sink, 100, 3)
    for k in range(20):
        writer.add(bytes([k]) * 90)
    writer.close()
    data = bytearray(sink.kept)
    reader = tokens.SeekableReader(io.BytesIO(data), len(data))
    assert len(reader.sizes) > 5 and reader.read(3)[0] > 0
    data[int(reader.starts[2]) + 8] ^= 255
    broken = tokens.SeekableReader(io.BytesIO(data), len(data))
    with pytest.raises(Exception):
        broken.read(2)
    assert broken.read(3) == reader.read(3)
