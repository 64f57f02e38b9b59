import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dayloom.llm import alignment
from dayloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, awkward_rows

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Token ids and bytes by the libraries themselves."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    symbols = alignment._byte_of_symbol()

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, bytes_a, ids_b, bytes_b

    return encode


def brute(rows, encode):
    """All documents token by token, with the counts of linked pairs over all of them."""
    docs, held = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, bytes_a, ids_b, bytes_b = encode(text)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                i = j = 0
                for cut in cuts:
                    p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
                    groups.append((ids_a[i:p], ids_b[j:q]))
                    i, j = p, q
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        docs.append((doc_id, groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for doc_id, groups, links in docs:
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            -1 if doc_id is None else doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(spelt.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def result(table):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    return sorted(tuple(-1 if n == "doc_id" and r[n] is None else r[n] for n in names) for r in table.collect())


def hard_texts():
    rng = random.Random(6)
    signs = "ab \t\n.,'é漢字🙂ﬁ́\xa0　\x00▁<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(150)]
    return texts + ["<|endoftext|> plain", "a  b   c", " lead", "trail ", "</s> <s> <unk>", "x" * 20_000, "don't we'll I'M", "▁ q", "12345 67"]


def test_alignment_agrees_with_brute_force(spark, plain):
    rows = list(enumerate(hard_texts())) + [(None, "No id."), (3, None), (4, ""), (4, "same id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(alignment.align_tokens(table, A, B, spell="sha256", unit=500)) == brute(rows, plain)


def test_awkward_rows_and_nothing(spark, plain):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert result(alignment.align_tokens(awkward(spark), A, B, spell="sha256")) == brute(rows, plain)
    assert result(alignment.align_tokens(awkward(spark).filter("false"), A, B)) == []


def test_groups_are_spelt_out(spark):
    table = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    row = alignment.align_tokens(table, A, B).first()
    assert [len(g.split("|")) for g in row["groups"].split(";")] == [2] * row["n_groups"]


def test_query_on_a_small_table(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op12_alignment"](spark, SMALL).withColumnRenamed("groups_sha256", "groups")) == brute(rows, plain)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_of_the_merge_find_all_common_ends(piece):
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 30))) for _ in range(2))
        i, j = alignment.diagonals(a, b, piece)
        assert (np.diff(i + j)[:-1] == piece).all() and (i[-1], j[-1]) == (len(a), len(b))
        at_a, at_b = alignment.common_ends(a, b, piece)
        assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()


def test_links_are_expanded_in_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 160)
    end_a, end_b = np.array([2, 90, 120, 199]), np.array([0, 100, 101, 159])
    doc = np.array([0, 0, 2, 2])
    want = Counter()
    for g in range(4):
        x, y = ((e[g - 1] + 1 if g else 0, e[g] + 1) for e in (end_a, end_b))
        want.update((int(doc[g]), int(p) * 9 + int(q)) for p in a[slice(*x)] for q in b[slice(*y)])
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(alignment, "LINKS", size)
        d, p, t = alignment.pairs_of_groups(a, b, end_a, end_b, doc, 9)
        assert dict(zip(zip(d.tolist(), p.tolist(), strict=True), t.tolist(), strict=True)) == want
