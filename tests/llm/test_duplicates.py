import hashlib
import random

import numpy as np

from dayloom.llm import decontamination, repeats, simhash
from tests.llm.helpers import awkward, awkward_rows, on_disk, words


def removed(rows):
    """Brute force: bytes in a 50-byte window that starts in a document with a smaller id."""
    last = 1 << 62
    windows = {}
    for i, t in rows:
        b, key = (t or "").encode(), last if i is None else i
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            windows[w] = min(key, windows.get(w, key))
    out = []
    for i, t in rows:
        b, key = (t or "").encode(), last if i is None else i
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if windows[b[k : k + 50]] < key:
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(table):
    rows = repeats.remove_repeats(table).collect()
    return sorted(
        (-1 if r[0] is None else r[0], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in rows
    )


def test_repeats_agree_with_brute_force(spark, tmp_path):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé \u0000\n") for _ in range(rng.choice((49, 50, 51, 64, 130, 400)))) for _ in range(12)]
    rows = []
    for i in range(160):
        text = "".join(rng.choice([rng.choice(passages), words(i * 7 + k, 9), rng.choice(passages)[: rng.randrange(60)]]) for k in range(rng.randrange(6)))
        rows.append((rng.choice([i, i // 2, i]), text))
    rows += [(None, passages[5] + "tail"), (None, passages[5]), (0, None), (3, ""), (500, "ab" * 300), (501, "ba" * 300), (502, "a" * 500)]
    rng.shuffle(rows)
    table = on_disk(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path / "d")
    assert result(table) == removed(rows)


def test_repeats_of_awkward_rows_and_nothing(spark, tmp_path):
    table = on_disk(awkward(spark), tmp_path / "a")
    assert result(table) == removed([(r[0], r[1]) for r in awkward_rows()])
    assert result(on_disk(awkward(spark).filter("false"), tmp_path / "e")) == []
    short = on_disk(spark.createDataFrame([(1, "abc"), (2, "abc")], "doc_id long, text string"), tmp_path / "s")
    assert [r[2] for r in result(short)] == [0, 0]


def test_merged_order_and_common_prefixes():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    shards = [repeats.Transform(strings[k::3], np.arange(40)[k::3]) for k in range(3)]
    string, offset, common = repeats.merge(shards, depth=20)
    rows = [strings[s][o:] for s, o in zip(string, offset, strict=True)]
    assert len(rows) == sum(len(s) + 1 for s in strings)
    assert [r[:20] for r in rows] == sorted(r[:20] for r in rows)
    for a, b, n in zip(rows, rows[1:], common[1:], strict=False):
        same = next((k for k in range(20) if a[k : k + 1] != b[k : k + 1]), 20)
        if len(a) > n or len(b) > n:  # equal short suffixes count their end as alike
            assert n == same


def fingerprint_of(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_groups_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in awkward_rows()]
    base = words(77, 700).split()
    for i in range(60):  # one word changed: few bits
        w = list(base)
        w[rng.randrange(700)] = "zz"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, words(900 + i, 3)) for i in range(40)]
    fps = [fingerprint_of(t) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    expected = sorted((-1 if d is None else d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"shard": 4, "block": 8}):  # also with many shards and cut ones
        out = simhash.simhash_groups(table, **sizes).collect()
        got = sorted((-1 if r[0] is None else r[0], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in out)
        assert got == expected
    assert simhash.simhash_groups(table.filter("false")).count() == 0


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 16, 900, dtype=np.uint64) * np.uint64(0x10001))
    tree = simhash.BKTree(values)
    found = {(int(q), int(v)) for a, b in tree.search(values, 6) for q, v in zip(a, b, strict=True)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 6
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}


def test_long_chains_have_one_root(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 800)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {roots[i] for i in range(1, 201)} == {0} and roots[900] == 800


def test_one_of_each_group_stays(spark, tmp_path):
    text = words(1, 300)
    changed = " ".join(["zz", *text.split()[1:]])
    rows = [(5, text), (3, changed), (3, changed), (None, text), (9, words(2, 300)), (10, ""), (11, None), (12, words(4, 3))]
    table = on_disk(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS fp"), tmp_path / "k")
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r[0] for r in kept.collect()) == [3, 9, 10, 11, 12]
    assert simhash.keep_one(on_disk(table.filter("false"), tmp_path / "e")).count() == 0


def test_near_copies_are_those_of_the_exact_similarity(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(60):  # from close copies to texts that share half
        text = words(3000 + i, rng.choice((9, 30, 120)), 5000).split()
        rows.append((3 * i, " ".join(text)))
        for k in (1, 2):
            w = list(text)
            cut = rng.randrange(1, max(2, len(w) // 3))
            w[:cut] = words(4000 + 3 * i + k, cut, 5000).split()
            rows.append((3 * i + k, " ".join(w)))
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) >= 0.8:
                group[max(find(i), find(j))] = min(find(i), find(j))
    expected = [i for i in range(len(rows)) if find(i) == i]
    assert 60 < len(expected) < len(rows)
    table = on_disk(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path / "n")
    for sizes in ({}, {"block": 2, "load": 100}):
        assert sorted(r[0] for r in simhash.keep_one(table, **sizes).collect()) == expected


def test_overlaps_tolerate_substitutions(spark):
    items = {1: words(50, 40, 5000), 2: words(51, 15, 5000), 3: "two words", 4: None, 5: words(52, 7, 5000)}
    inner = items[1].split()
    swapped = list(inner[5:30])
    swapped[6], swapped[12], swapped[19] = "other", "words", "here"
    docs = {
        1: f"start. {items[1].upper()}! end", 2: "pre " + " ".join(swapped) + " post", 3: " ".join(inner[:12]),
        4: "x " + items[5] + " y", 5: items[5][:20], 6: words(60, 400, 5000), 7: None, 8: "", 9: f"({items[2]})",
        10: " ".join(w for pair in zip(inner, words(61, 40, 5000).split(), strict=True) for w in pair),
    }
    table = spark.createDataFrame([(i, t, "own") for i, t in docs.items()] + [(1, docs[1], "own")], "doc_id long, text string, overlaps string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for s in (decontamination.Settings(), decontamination.Settings(block_items=2)):
        out = decontamination.find_overlaps(table, bench, settings=s)
        rows = [(r["doc_id"], [(o["item_id"], o["length"], o["matched"]) for o in r["_overlaps"]]) for r in out.collect()]
        found = dict(rows)
        assert len(rows) == 11 and found[1] == [(1, 40, 40)] and found[9] == [(2, 15, 15)] and found[4] == [(5, 7, 7)]
        assert found[2] == [(1, 25, 22)]
        assert all(found[i] == [] for i in (3, 5, 6, 7, 8, 10))
    assert decontamination.find_overlaps(table, bench.filter("false")).filter("size(_overlaps) > 0").count() == 0
    assert decontamination.find_overlaps(table.filter("false"), bench).count() == 0


def test_masks_survive_three_substitutions():
    from itertools import combinations

    spans = [[i for i, c in enumerate(m) if c == "1"] for m in decontamination.MASKS]
    for gone in combinations(range(13), 3):
        assert any(
            not set(gone) & {p + o for o in span}
            for span, m in zip(spans, decontamination.MASKS, strict=True) for p in range(13 - len(m) + 1)
        )


def test_items_are_found_under_all_allowed_substitutions():
    from itertools import combinations

    import pyarrow as pa

    for n in (*range(5, 21), 25):
        item = [f"t{k}" for k in range(n)]
        index = decontamination.SeedIndex([(1, " ".join(item))], decontamination.Settings())
        texts = []
        for gone in combinations(range(n), n // 5):
            w = ["pre", *item, "post"]
            for k in gone:
                w[1 + k] = "other"
            texts.append(" ".join(w))
        found = index.search(pa.array(texts))
        assert all(len(f) == 1 and f[0]["length"] >= min(n, 13) and 5 * f[0]["matched"] >= 4 * f[0]["length"] for f in found)


def _maximal(equal, least=13):
    """Brute force: the stretches [a, b) of enough equal tokens that no other such stretch holds."""
    n = len(equal)
    for edges in (False, True):
        all_ = [
            (a, b) for a in range(n) for b in range(a + least, n + 1)
            if (equal[a] or (edges and a == 0)) and (equal[b - 1] or (edges and b == n)) and 5 * sum(equal[a:b]) >= 4 * (b - a)
        ]
        if all_:
            return [(a, b) for a, b in all_ if not any((x, y) != (a, b) and x <= a and b <= y for x, y in all_)]
    return []


def test_all_maximal_stretches_of_a_diagonal_are_found():
    rng = random.Random(4)
    item = [f"t{k}" for k in range(60)]
    index = decontamination.SeedIndex([(1, " ".join(item))], decontamination.Settings())
    numbers = set()
    for k in range(300):
        share = (0.6, 0.75, 0.9)[k % 3]
        equal = [rng.random() < share for _ in item]
        tokens = np.array([7, *[k + 1 if e else 0 for k, e in enumerate(equal)], 9])
        expected = [(1 + a, b - a, sum(equal[a:b])) for a, b in _maximal(equal)]
        assert index.stretches(tokens, 0, 1) == expected
        numbers.add(len(expected))
    assert {0, 1, 2, 3} <= numbers


def test_every_place_of_a_repeated_passage_is_found():
    import pyarrow as pa

    rng = random.Random(8)
    item = words(70, 30, 5000).split()
    index = decontamination.SeedIndex([(1, " ".join(item)), (2, " ".join(item[:20]))], decontamination.Settings())
    text, expected = [], {1: [], 2: []}
    for k in range(5):
        text += words(80 + k, rng.randrange(1, 40), 5000).split()
        piece = list(item[: (30, 16)[k % 2]])
        piece[7] = "swapped"
        for i, n in ((1, 30), (2, 20)):
            expected[i].append((len(text), min(len(piece), n), min(len(piece), n) - 1))
        text += piece
    # two far parts of the item, the middle another text
    text += ["gap"] * 5
    far = [(len(text), 13, 13), (len(text) + 33, 13, 13)]
    text += item[:13] + ["gap"] * 20 + item[17:]
    found = index.search(pa.array([" ".join(text), None, ""]))
    assert found[1:] == [[], []]
    assert [(o["start"], o["length"], o["matched"]) for o in found[0] if o["item_id"] == 1] == expected[1] + far
    assert [(o["start"], o["length"], o["matched"]) for o in found[0] if o["item_id"] == 2] == expected[2] + far[:1]


def test_items_and_documents_are_split_alike():
    import pyarrow as pa

    item = " ".join(f"t{k}" for k in range(15))
    for one, other in ((item, item.replace(" ", "\u00a0")), (item.replace(" ", "\u3000"), item)):
        index = decontamination.SeedIndex([(1, one), (2, "two words"), (3, None), (4, "...")], decontamination.Settings())
        found = index.search(pa.array([f"pre {other} post", "Two words!", "two other words", None, ""]))
        assert [[(o["item_id"], o["length"], o["matched"]) for o in f] for f in found] == [[(1, 15, 15)], [(2, 2, 2)], [], [], []]
