import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dayloom.llm import prefix_join
from dayloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, awkward_rows, words

SMALL = "/root/testdata/sf0.001"


def brute(rows, n=5, percent=80):
    """Sizes and components of all rows by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((-1 if d is None else d, len(s), least.get(find(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(table, **options):
    rows = prefix_join.jaccard_groups(table, **options).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in rows)


def near_copies(seed, groups, copies, length):
    """Texts with copies that differ in a few words, many of them close to the threshold."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = words(seed * 1000 + g, rng.randrange(3, length), 5000).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 30)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [f"new{rng.randrange(10_000)}"]
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("load", [prefix_join.LOAD, 300])
def test_components_agree_with_brute_force(spark, load):
    texts = near_copies(1, 25, 9, 120) + near_copies(2, 3, 40, 400) + [words(9, 60)] * 30
    passage = words(77, 50)
    texts += [f"{words(100 + k, 45)} {passage} {words(200 + k, 20)}" for k in range(30)]
    rng = random.Random(3)
    rng.shuffle(texts)
    rows = [(rng.choice([k, k, k // 2, None]), t) for k, t in enumerate(texts)] + [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One TWO")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(table, load=load) == brute(rows)


def test_awkward_rows_and_nothing(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert result(awkward(spark)) == brute(rows)
    assert result(awkward(spark).filter("false")) == []


def test_query_on_a_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op11_prefix_join"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute(rows)


def test_trie_finds_all_partners():
    rng = np.random.default_rng(4)
    for size, percent in ((30, 80), (200, 75), (90, 80)):
        base = [np.unique(rng.integers(0, 4000, size)) for _ in range(6)]
        sets = []
        for b in base:
            for _ in range(12):
                kept = b[rng.random(len(b)) > 0.08]
                sets.append(np.unique(np.r_[kept, rng.integers(0, 4000, rng.integers(0, size // 10 + 1))]))
        sets = [s for s in {tuple(s): s for s in sets if len(s)}.values()]
        trie = prefix_join.Trie(sets)
        open_ = np.ones(len(sets), dtype=bool)
        for q in sets:
            inside = np.zeros(4000, dtype=bool)
            inside[q] = True
            want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, q)) >= percent * len(np.union1d(s, q))]
            assert sorted(trie.partners(q, inside, percent, open_).tolist()) == want


def test_routing_meets_every_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(4, 60))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        y = x[rng.random(len(x)) > rng.choice([0.05, 0.1, 0.2])]
        y = np.unique(np.r_[y, rng.integers(0, 1 << 60, rng.integers(0, len(x) // 5 + 1)).astype(np.uint64)])
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)) or np.array_equal(x, y):
            continue
        shared = len(np.intersect1d(prefix_join.prefix_pairs(x, 80), prefix_join.prefix_pairs(y, 80)))
        assert shared >= max(1, -(-len(x) * 80 // 100) // 20)


class Looked(np.ndarray):
    """Counts the elements that are looked up."""

    count = 0

    def __getitem__(self, key):
        out = super().__getitem__(key)
        Looked.count += np.size(out)
        return out.view(np.ndarray) if isinstance(out, np.ndarray) else out


def test_walk_leaves_out_branches_that_share_a_common_passage_only():
    rng = np.random.default_rng(6)
    passage = np.arange(0, 20_000, 1000)
    sets = [np.unique(np.r_[passage, rng.integers(0, 20_000, 40)]) for _ in range(400)]
    sets += [np.unique(np.r_[s[:-2], 20_000 + k]) for k, s in enumerate(sets[:50])]
    trie, open_ = prefix_join.Trie(sets), np.ones(len(sets), dtype=bool)
    Looked.count = 0
    for k, q in enumerate(sets):
        inside = np.zeros(21_000, dtype=bool)
        inside[q] = True
        found = trie.partners(q, inside.view(Looked), 80, open_).tolist()
        assert sorted(found) == [k] + ([k + 400] if k < 50 else []) if k < 400 else sorted(found) == [k - 400, k]
    assert Looked.count < 60 * 10 * len(sets)  # a few sets for each that asks; all branches are 450


def test_a_common_passage_makes_no_family(spark):
    rows = [(k, str(k), f"{words(300 + k, 22, 9000)} {words(78, 18)} {words(900 + k, 20, 9000)}") for k in range(80)]
    rows += [(100 + k, str(100 + k), f"{text} more") for k, (_, _, text) in enumerate(rows[:4])]
    marked = prefix_join.signatures(spark.createDataFrame(rows, "doc_id long, tid string, text string"), 5, 80).cache()
    routed = prefix_join.families(marked, 80)
    sizes = sorted(r["count"] for r in routed.groupBy("family").count().collect())
    assert sizes == [2, 2, 2, 2]


def test_crowded_elements_go_out_early_and_whole(monkeypatch):
    rng = np.random.default_rng(7)
    rows = {(int(e) if e % 3 else 3, int(s)) for e, s in zip(rng.integers(0, 4000, 6000), rng.integers(0, 900, 6000), strict=True)}
    rows = [(e, s) for e, s in sorted(rows, key=lambda x: hash((x[1], x[0])))]

    def pieces():
        for a in range(0, len(rows), 500):
            part = np.array(rows[a : a + 500], dtype=np.int64)
            packed = part[:, 0].tobytes() + part[:, 1].tobytes()
            yield pa.RecordBatch.from_pydict({"bucket": [0], "packed": [packed]})

    def run():
        return [tuple(r.values()) for b in prefix_join.shared_elements(pieces()) for r in b.to_pylist()]

    count = Counter(e for e, _ in rows)
    want = sorted((e, s, count[e]) for e, s in rows if count[e] > 1)
    assert sorted(run()) == want
    monkeypatch.setattr(prefix_join, "HELD", 800)
    monkeypatch.setattr(prefix_join, "CROWD", 20)
    assert sorted(run()) == sorted((e, s, prefix_join.MANY if e == 3 else n) for e, s, n in want)


def test_words_end_with_their_text_and_long_words_differ():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x1c", "longerword"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [None, "", "x" * 300, "x" * 299 + "y", "x" * 16, "x" * 15 + "y", "x" * 17, "x\0", "x"]
    got = [tuple(h.tolist()) for h in prefix_join.ngram_sets(pa.array(texts).slice(1), 3)]
    known = {}
    for text, hashes in zip(texts[1:], got, strict=True):
        w = (text or "").encode().lower().split()
        runs = frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()
        assert known.setdefault(runs, hashes) == hashes and len(hashes) == len(runs) and list(hashes) == sorted(hashes)
    assert len(set(known.values())) == len(known)
