"""The trie, URL rules and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridjobs.llm import divergence, trie, urlfilter

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, every=5, most=8):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, own in convs.items():
        own.sort(key=lambda t: (*t[:3], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()[:16], len(t[3].encode())))
        convs[c] = [t[2:] for t in own]
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = tuple(convs.get(c - c % every, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    out = set()
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        ends = sorted(c for c in m if built[c] == s)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.add((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], sum(not kids[x] for x in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def nodes(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talk(seed, n, kinds=3):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        if rnd.random() < 0.9:
            for t in range(rnd.choice([1, 2, 3, 9, 12])):
                rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", "", "long text " * 3][:kinds])))
    return rows


@pytest.mark.parametrize("keys", [1, 2, 7, 1000])
def test_trie_equals_brute_force(spark, keys):
    rows = talk(keys, 60) + [(100 + i, 0, "user", "same") for i in range(40)]
    docs = spark.createDataFrame(rows, TURNS).repartition(5)
    assert nodes(trie.trie(trie.rebuilt(docs), slice_keys=keys)) == brute_trie(rows)


def test_trie_branches_of_every_layout(spark):
    rows = [(c, t, "user", f"{c if t == 9 else 0}") for c in range(0, 3000, 5) for t in range(10)]
    got = nodes(trie.trie(trie.rebuilt(spark.createDataFrame(rows, TURNS)), slice_keys=400))
    assert got == brute_trie(rows)
    tree = trie.RadixTree()
    for b in range(256):
        tree.insert(bytes([b]) * trie.WIDTH, b)
        assert tree.root.kids.room == (4 if b < 4 else 16 if b < 16 else 48 if b < 48 else 256)
    assert [b for b, _ in tree.root.kids.ordered()] == list(range(256))


def test_trie_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "b", "y"), (2, 1, None, "z" * 100_000), (7, 5, "user", None), (5, 0, "", ""), (10, 0, "user", "x")]
    docs = spark.createDataFrame([(*r, b"k", 1) for r in rows], TURNS + ", key binary, h int")
    got = nodes(trie.trie(trie.rebuilt(docs), slice_keys=2))
    assert got == brute_trie(rows)
    assert nodes(trie.trie(trie.rebuilt(docs.limit(0)))) == set()
    alone = spark.createDataFrame([(3, 0, "user", "x")], TURNS)  # crc32("3") % 9 is over 0: its only turn goes
    assert zlib.crc32(b"3") % 9 and nodes(trie.trie(trie.rebuilt(alone))) == brute_trie([(3, 0, "user", "x")])


def test_trie_of_a_very_long_conversation(spark):
    rows = [(0, t, "user", "t") for t in range(3000)] + [(1, t, "user", "t") for t in range(2000)]
    got = nodes(trie.trie(trie.rebuilt(spark.createDataFrame(rows, TURNS)), slice_keys=1))
    assert len(got) == 3001 and {(r[1], r[3]) for r in got} == {(d, 2 if d <= 2000 else 1) for d in range(3001)}


def brute_rule(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_urls_equal_brute_force(spark):
    rnd = random.Random(3)
    labels, parts = ["a", "b", "net", "example", "com", "", "É"], ["en", "x", "", "x.html", "a/b"]
    rules = [(".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 3))), "".join(rnd.choice(["", "/", "/en", "/en/", "/x", "/a/"]) for _ in range(rnd.randint(1, 3))), rnd.choice(["allow", "block"])) for _ in range(40)]
    urls = [rnd.choice(["http://", "https://", "", "//"]) + ".".join(rnd.choice([*labels, "NET"]) for _ in range(rnd.randint(1, 4))) + "".join("/" + rnd.choice(parts) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "?q=/en/", "#top/"]) for _ in range(400)]
    urls += [None, "", "://", "http:///en/", "http://net", "http://x.NET/a\nb?", "http://a://b.net/x", urls[0], "http://" + "a." * 30_000 + "net/" + "en/" * 30_000]
    pages = spark.createDataFrame([(i if i % 7 else None, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, short int")
    for table in (rules, urlfilter.RULES, []):
        got = urlfilter.judge(pages, urlfilter.rule_table(spark, table)).collect()
        want = Counter((i if i % 7 else None, *brute_rule(u, table)) for i, u in enumerate(urls))
        assert Counter(tuple(r) for r in got) == want
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, rules)).collect() == []


def test_urls_with_colliding_short_hashes_are_confirmed(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p{i}/") for i in range(100)], "page_id long, url string")
    rules = [(f"h{i}.net", f"/p{i}/", "block") for i in range(0, 100, 2)]
    got = {r.id: r.rule for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules), short=1).collect()}
    assert got == {i: f"h{i}.net/p{i}/" if i % 2 == 0 else None for i in range(100)}


def brute_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    seen, out = Counter(), set()
    for lang, _, words in docs:
        seen.update((lang, w) for w in set(words))
    for lang in {d[0] for d in docs}:
        kept = {w for (k, w), n in seen.items() if k == lang and n >= least}
        by = {s: Counter() for k, s, _ in docs if k == lang}
        for k, s, words in docs:
            if k == lang:
                by[s].update(w for w in words if w in kept)
        whole = sum(by.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(whole)
        for s in by:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in by if o != s]
            term = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if by[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("slice_bytes", "block"), [(1, 1), (100, 3), (1 << 20, 1 << 15)])
def test_divergence_equals_brute_force(spark, slice_bytes, block):
    rnd = random.Random(slice_bytes)
    words = ["a", "The", "the", "thé", "antidisestablishment", "antidisestablishments", "antidise", "ÜBER", "über", "x☃y", "abcdefgh", "abcdefghi"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "Zé", None]), rnd.choice([" ", "-", "1", "\x00", "_"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 40])))) for _ in range(150)]
    rows += [("fr", "s1", "only once"), ("fr", "s2", None), ("es", "s9", ""), ("en", "s1", "The the " * 20_000), ("en", "s1", "w" * 100_000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "t", 5, 1.0) for r in rows], "lang string, source string, text string, term string, count long, p double").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, top=5, slice_bytes=slice_bytes, block_counts=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, top=5)


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert divergence.audit(one).collect() == []


def test_contract_columns(spark):
    from gridjobs.llm.queries import queries

    want = {
        "op11_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
        "op12_urlfilter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op13_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    }
    for name, columns in want.items():
        assert dict(queries()[name](spark, "/root/testdata/sf0.001").dtypes) == columns
