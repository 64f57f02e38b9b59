import json
import math
import re
from collections import Counter

from dayloom.llm import mixing, quality, urls
from tests.llm.helpers import SCHEMA, awkward, awkward_rows, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = SPLIT.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return (
        len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_measures_agree_with_brute_force(spark):
    texts = [r[1] for r in awkward_rows()] + [
        "a b c d e a b c d e f", "a a a a a a a", "a b c d e x a b c d e y a b c d e", "l1\nl2\nl1\n\n \nl1\nl2",
        "one # two ** $ <tag> | &amp;", "a\x0bb\x0cc\x1cd\x85e", words(3, 3000, 9), "\n".join(["same line here"] * 9),
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r["quality"] for r in quality.quality_rules(table).collect()}
    for i, text in enumerate(texts):
        q = rows[i]
        got = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"])
        assert got == measured(text), text
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])


def test_quality_keeps_rows_and_columns(spark):
    table = awkward(spark)
    out = quality.quality_rules(table)
    assert out.columns == [*table.columns, "_quality"] and out.count() == table.count()
    assert quality.quality_rules(table.filter("false")).count() == 0
    kept = {r[0] for r in out.filter("_quality.kept").select("doc_id").collect()}
    assert set(range(10)) <= kept and not kept & {10, 11, 12, 15}


def fitting(rules, host, path):
    """Brute force: the longest rule that fits, of equal ones the last."""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(enumerate(fits), key=lambda x: (len(x[1].name), x[0]))[1] if fits else None


def test_host_rules_agree_with_brute_force():
    part = ["a", "b", "co", "a.b", "b.a", "a.b.co", ""]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab"]
    rules = [urls.HostRule(h, p, v) for v in ("allow", "block") for h in part for p in paths if len(h + p) % 2 or v == "block"]
    whole = urls.HostTable(0, rules)
    halves = [urls.HostTable(k, r) for k, r in ((0, rules[:20]), (20, rules[20:]))]
    for rest in (rules, rules[:9], rules[30:35]):
        table = urls.HostTable(0, rest)
        for host in [*part, "x.a", "xa", "x.a.b.co", "a.", ".a", "..", "x" * 99 + ".co"]:
            for path in [*paths, "/a/b/c", "/ab/", "x"]:
                want = fitting(rest, host, path)
                got = table.best(host, path)
                assert got[2:] == ((want.name, want.verdict) if want else (None, None)), (host, path)
                assert max(h.best(host, path)[:2] for h in halves) == whole.best(host, path)[:2]


def test_large_rule_tables(spark, tmp_path):
    hosts = [[f"h{i}.net", "/p" * (i % 3), "block" if i % 2 else "allow"] for i in range(100_000)]
    patterns = [[rf"/item{i}(x|y)?/", [f"item{i}" if i % 2 else "page"]] for i in range(1, 100_000, 2)]
    patterns += [[rf"/page/n{i}$", ["page", f"n{i}"]] for i in range(50_000)]
    (tmp_path / "rules.json").write_text(json.dumps({"hosts": hosts, "patterns": patterns}))
    read_hosts, read_patterns = urls.read_rules(spark, str(tmp_path / "rules.json"))
    assert len(read_hosts) == len(read_patterns) == 100_000
    assert [k for k, _ in urls.rule_blocks(read_hosts, lambda r: 1)] == [0, 50_000]
    rows = [
        ("http://w.h7.net/p/q", "h7.net/p", "block"), ("http://h99998.net/", None, "allow"),
        ("http://h99998.net/p/p/", "h99998.net/p/p", "allow"), ("http://h99999.net/", "h99999.net", "block"),
        ("http://x.org/item99999/", None, "block"), ("http://x.org/item99998/", None, "allow"),
        ("http://x.org/page/n49999", None, "block"), ("http://x.org/page/n50000", None, "allow"), (None, None, "allow"),
    ]
    table = spark.createDataFrame([(u,) for u, _, _ in rows], "url string")
    out = urls.filter_urls(table, host_rules=read_hosts, pattern_rules=read_patterns).collect()
    assert sorted(map(str, ((r["url"], r["rule"], r["verdict"]) for r in out))) == sorted(map(str, rows))
    none = urls.filter_urls(table, host_rules=[], pattern_rules=[]).collect()
    assert {(r["rule"], r["pattern"], r["verdict"]) for r in none} == {(None, None, "allow")}


def test_url_verdicts(spark):
    cases = {
        "https://x.example.org/en/12": ("x.example.org", "/en/12", "example.org/en/1", "block"),
        "http://EXAMPLE.org/es/?q": ("example.org", "/es/", "example.org/es/", "block"),
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://notorg/x": ("notorg", "/x", None, "allow"),
        "https://m.b.com/fr/casino/1": ("m.b.com", "/fr/casino/1", "com/fr/", "allow"),
        "https://m.b.com/de/1#x": ("m.b.com", "/de/1", "com/de/", "block"),
        "https://free-bets.example.net/en/5?x=1": ("free-bets.example.net", "/en/5", None, "block"),
        "https://my-free-betsy.example.net/": ("my-free-betsy.example.net", "/", None, "allow"),
        "no scheme/casino/": ("", "", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(cases)] + [(None, "http://a.org/x", "h")] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = urls.filter_urls(table).collect()
    assert len(out) == len(rows)
    got = {r["url"]: (r["_host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got == cases
    assert urls.filter_urls(table.filter("false")).count() == 0


def test_only_candidates_run_and_the_rarest_token_indexes(spark):
    rules = (urls.PatternRule(r"/common-rare/", ("common", "rare")), urls.PatternRule("/x/", ("x",)))
    table = spark.createDataFrame([("http://h/common/",)] * 5 + [("http://h/common-rare/",)], "url string")
    index = urls.rarest_literals(table, "url", rules)
    assert index == {"rare": [0], "x": [1]}


def test_mixture_meets_its_targets(spark):
    rows = [(i, words(i, 20 + i % 7), "en", "big" if i % 10 else f"small{i % 30}", 0) for i in range(1500)]
    table = spark.createDataFrame(rows, SCHEMA)
    mixture = mixing.Mixture(entropy=0.9, max_repeats=None, block_tokens=2000)
    out = mixing.mix_sources(table, mixture)
    used = {r["source"]: r for r in out.groupBy("source").agg({"mix_tokens": "sum", "mix_weight": "max"}).collect()}
    total = sum(len(r[1].split()) + 1 for r in rows)
    weights = [r["max(mix_weight)"] for r in used.values()]
    assert abs(sum(weights) - 1) < 1e-9
    assert abs(-sum(w * math.log(w) for w in weights) - 0.9 * math.log(len(weights))) < 1e-3
    for r in used.values():
        assert -30 <= r["sum(mix_tokens)"] - r["max(mix_weight)"] * total <= 1
    # an epoch never repeats a document
    assert out.groupBy("doc_id", "mix_epoch").count().filter("count > 1").count() == 0
    limited = mixing.mix_sources(table, mixing.Mixture(entropy=0.99, max_repeats=2.0, block_tokens=2000))
    assert limited.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    again = mixing.mix_sources(table.repartition(3), mixture)
    key = lambda t: sorted((r["doc_id"], r["mix_epoch"]) for r in t.select("doc_id", "mix_epoch").collect())
    assert key(again) == key(out)


def test_mixture_of_awkward_rows(spark):
    table = awkward(spark)
    out = mixing.mix_sources(table, mixing.Mixture(entropy=None, max_repeats=None))
    assert out.columns[: len(table.columns)] == table.columns and "_mix_epoch" in out.columns
    assert out.count() == table.count()  # natural weights and the whole budget: every row once
    assert mixing.mix_sources(table.filter("false")).count() == 0
