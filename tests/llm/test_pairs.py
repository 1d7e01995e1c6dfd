"""Near-duplicates, top-k, packing, licenses, URL lists and the pipeline against brute force."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

import corpus_pipeline
from penstrata.llm import common, covertree, language, licenses, packing, quality, simhash, urllist
from tests.llm.conftest import make


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB É\n　"), max_size=30))
def test_fingerprints_like_plain_code(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == slow_fingerprint(text)


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [64, 2])
def test_links_and_components_like_brute_force(spark, hot):
    import random

    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 150:
        base = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(fps))
        fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.4 else 0))
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), hot)
    want = slow_components(fps)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    groups = lambda m: {frozenset(k for k in fps if m.get(k, k) == r) for r in {m.get(k, k) for k in fps}}
    assert groups(found) == groups(want)
    if hot == 64:
        pairs = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in edges.collect()}
        assert pairs == {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 2}


def slow_near(rows):
    fp = [slow_fingerprint(t) for _, t, _, _ in rows]
    root = slow_components(set(fp))
    least = {}
    for (i, *_), f in zip(rows, fp, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f"{f:016x}", least.get(root[f])) for (i, *_), f in zip(rows, fp, strict=True)]


def test_near_duplicates_of_odd_rows(docs, empty, rows):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_near(rows), key=str)
    one = simhash.one_of_each(docs)
    keep = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and sorted(keep, key=str) == sorted({c for _, _, c in slow_near(rows)}, key=str)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_row_of_each_component_stays(spark):
    import random

    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(4)]
    near = lambda k, n: [base[k], *(f"{base[k]} tail{i}" for i in range(n - 1))]
    rows = [(None, t, "en", "s") for t in near(0, 4)]  # no id at all
    rows += [(None, t, "en", "s") for t in near(1, 3)] + [(5, f"{base[1]} with id", "en", "s")]
    rows += [(7, base[2], "en", "s"), (7, base[3], "en", "s"), (7, base[3], "en", "s"), (9, f"{base[3]} later", "en", "s")]  # one id, two texts
    root = slow_components({slow_fingerprint(t) for _, t, _, _ in rows})
    part = lambda r: root[slow_fingerprint(r[1])]
    assert len({part(r) for r in rows}) == 4
    for docs in (make(spark, rows), make(spark, rows[::-1]).repartition(3)):
        got = simhash.one_of_each(docs)
        assert got.columns == docs.columns
        got = [(r.doc_id, r.text, r.lang, r.source) for r in got.collect()]
        assert len(got) == 4 and set(got) <= set(rows)
        assert {part(r): r[0] for r in got} == {part(rows[0]): None, part(rows[4]): 5, part((7, base[2])): 7, part((7, base[3])): 7}
        assert {t for i, t, *_ in got if i == 7} == {base[2], base[3]}


def slow_top(rows, k=5, every=50):
    """Rows (vec_id, whole numbers): every row is a query and a candidate of its own; shorter vectors end in zeros."""
    width = max(len(v) for _, v in rows)
    pad = [(i, list(v) + [0] * (width - len(v))) for i, v in rows]
    out = []
    for n, (q, v) in enumerate(pad):
        if q % every == 0:
            s = sorted((-int(np.dot(v, w)), i) for m, (i, w) in enumerate(pad) if m != n)[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def clustered(n, width, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(24, width))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    x = middle[rng.integers(0, 24, n)] + 0.03 * rng.normal(size=(n, width))
    return np.round(x / np.linalg.norm(x, axis=1)[:, None], 4)


@pytest.mark.parametrize("block,fan", [(64, 5), (2048, 32)])
def test_top_k_like_brute_force(spark, monkeypatch, block, fan):
    """Several levels of cells, of which one is a vector 120 times, or one block; repeated ids, an empty and a short vector."""
    monkeypatch.setattr(covertree, "DATA_BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 4)
    monkeypatch.setattr(covertree, "CENTRES", fan)
    monkeypatch.setattr(covertree, "DEAL", 100)
    x = clustered(700, 8)
    x[300:420] = x[300]
    rows = [(int(i), [float(y) for y in v], 0) for i, v in enumerate(x)]
    rows += [rows[50], rows[51], (50, rows[52][1], 0), (900, [], 0), (950, [0.5, -0.25], 0)]
    want = slow_top([(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows])
    odd = [(700, None, 0), (750, [1.0, None], 0), (800, [float("nan")] * 8, 0), (850, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, covertree.top_k(df).collect())) == want
    if block == 64:
        assert covertree.top_k(df.where("false")).count() == 0
        few = covertree.top_k(df.where("vec_id in (51, 52, 100)")).collect()
        assert sorted((r.query_id, r["rank"]) for r in few) == [(100, 1), (100, 2), (100, 3)]


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    """Of the pairs of leaves of all blocks fewer than a tenth are scored."""
    monkeypatch.setattr(covertree, "DATA_BLOCK", 256)
    x = clustered(4000, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    told = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = covertree.top_k(df, told=told).collect()
    assert sorted(map(tuple, got)) == slow_top([(i, np.floor(256 * v).astype(int)) for i, v in enumerate(x)])
    rows = covertree.parted(covertree.scaled(df), 256)
    leaves = lambda r: sum(covertree._unpacked(b)[3].leaves for b in r.collect())
    every = leaves(covertree.blocks(rows.where("vec_id % 50 = 0"), covertree.QUERY_BLOCK)) * leaves(covertree.blocks(rows, 256))
    assert 0 < told[0].value <= told[1].value and told[0].value < every / 10


def test_trees_cover_and_prune():
    rng = np.random.default_rng(5)
    p = np.concatenate([c + rng.integers(-3, 4, (300, 3)) for c in rng.integers(-900, 900, (12, 3))])
    t = covertree.Tree(p)
    for n in range(len(t.centre)):
        own = t.order[t.lo[n] : t.hi[n]]
        assert (np.sqrt(((p[own] - p[t.centre[n]]) ** 2).sum(axis=1)) <= t.nodes.radius[n] + 1e-9).all()
        assert t.centre[n] in own
        a, b = t.kids[n]
        if a < b:  # children part the node, and their centres are no closer than any child's radius
            assert sorted(np.concatenate([t.order[t.lo[x] : t.hi[x]] for x in range(a, b)])) == sorted(own)
            c = p[t.centre[a:b]].astype(float)
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.where(np.eye(b - a) > 0, np.inf, 0)
            assert apart.min() >= t.nodes.radius[a:b].max() - 1e-9
        else:
            assert len(own) <= covertree.LEAF or t.nodes.radius[n] == 0
    q, best = p[:40], covertree.Best(40, 5)
    qt = covertree.Tree(q, leaf=10)
    scored, every = covertree.search(q, np.arange(40) + 10**6, qt, p, np.arange(len(p)), np.arange(len(p)), t, best)
    want = np.sort(q @ p.T, axis=1)[:, ::-1][:, :5]
    assert (best.score == want).all()
    assert scored < every / 2


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([1, 50, 3000]))
def test_bounds_hold(seed, width, size):
    rng = np.random.default_rng(seed)
    p, q = (rng.integers(-size, size + 1, (n, width)) + rng.integers(-size, size + 1, width) * rng.integers(0, 4) for n in (60, 40))
    a, b = covertree.Tree(q, leaf=3, fan=3), covertree.Tree(p, leaf=3, fan=3)
    top = covertree.bound(a.nodes, b.nodes)
    s = q @ p.T
    for i in range(len(a.lo)):
        for j in range(len(b.lo)):
            assert s[np.ix_(a.order[a.lo[i] : a.hi[i]], b.order[b.lo[j] : b.hi[j]])].max() <= top[i, j]


def test_products_beyond_doubles_are_exact():
    big = np.array([[1 << 40, 3]])
    assert covertree.products(np.array([[1 << 20, 1]]), big)[0, 0] == (1 << 60) + 3


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    sizes = sorted(hist)
    cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist.items())
    got = packing.boundaries(np.array(sizes), np.array([hist[n] for n in sizes]), k)
    best = min(cost([*x, sizes[-1]]) for r in range(k) for x in itertools.combinations(sizes[:-1], r))
    assert len(got) <= k and got[-1] == sizes[-1] and cost(got) == best


def check_packing(got, budget):
    spots = {(r.bucket, r.batch, r.slot) for r in got}
    assert len(spots) == len(got)
    for b in {r.bucket for r in got}:
        own = sorted((r for r in got if r.bucket == b), key=lambda r: (r.batch, r.slot))
        assert [(r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in own] == sorted((r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in own)
        room = max(1, budget // own[0].padded)
        assert [r.batch * room + r.slot for r in own] == list(range(len(own)))
        assert all(r.n_tokens <= r.padded for r in own)


def test_packing_of_odd_rows(docs, empty, rows):
    got = packing.packed(docs, buckets=4, budget=500).collect()
    want = sorted((i is not None, i or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for i, t, _, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want
    check_packing(got, 500)
    assert packing.packed(empty).count() == 0


def test_many_lengths_are_rounded_up(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_LENGTHS", 5)
    docs = make(spark, [(i, "w " * i, "en", "s") for i in range(40)])
    got = packing.packed(docs, buckets=3, budget=100).collect()
    assert len(got) == 40
    check_packing(got, 100)


def test_many_lengths_have_optimal_boundaries(spark, monkeypatch):
    hist = {n + 1: 1 + (n * n) % 3 for n in range(40)}
    cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in hist.items())
    best = min(cost([*x, 40]) for x in itertools.combinations(range(1, 40), 2))
    monkeypatch.setattr(packing, "MOST_LENGTHS", 5)
    docs = make(spark, [(100 * n + k, "w " * (n - 1), "en", "s") for n, c in hist.items() for k in range(c)])
    got = packing.packed(docs, buckets=3, budget=100).collect()
    assert len(got) == sum(hist.values()) and max(r.padded for r in got) == 40
    assert sum(r.padded - r.n_tokens for r in got) == best
    check_packing(got, 100)


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=9))
def test_alignments_are_common_subsequences(a, b):
    got = licenses.aligned(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert len(got) <= slow_lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.permutations("abcdefg"), st.permutations("abcdefg"))
def test_alignment_of_unique_words_is_longest(a, b):
    assert len(licenses.aligned(list(a), list(b))) == slow_lcs(a, b)


def test_license_scans(spark, docs, empty, rows):
    mit = licenses.TEMPLATES["MIT"][2]
    lost = " ".join(w for i, w in enumerate(mit.split()) if i % 7)
    long = "the license of this work " * 3000
    texts = {1: "x y. Released under the MIT License.", 2: f"intro {mit} end", 3: f"intro {lost} end", 4: "licensed software under permission", 5: long + mit, 6: long, 7: "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."}
    got = {r.doc_id: r for r in licenses.scanned(make(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    assert [got[i].license for i in (1, 2, 3, 4, 5, 6)] == ["MIT", "MIT", "MIT", None, "MIT", None]
    assert got[1].first_word == 2 and got[1].last_word == 6 and got[2].coverage == 1.0 and 0.8 <= got[3].coverage < 1
    assert sorted(got[7].licenses) == ["Apache-2.0", "GPL-3.0"]
    assert licenses.scanned(docs).count() == len(rows) and licenses.scanned(empty).count() == 0


def common_words(a, b):
    """The length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6))
def test_scans_like_all_windows(seed):
    """What is planted within the allowed losses is found; what is found holds by a longest common subsequence; what no window of the text holds is not found."""
    import random

    rng = random.Random(seed)
    scanner = licenses.Scanner()
    noise = lambda n: [rng.choice(["the", "license", "software", "house", "river", "under", "permission", "lamp", "copy", "zeta"]) for _ in range(n)]
    name, template, _, _, need = rng.choice(scanner.rules)
    n = len(template)
    lost = set(rng.sample(range(1, n - 1), rng.randint(0, (n - need) // 3) if n - need >= 3 else 0))
    planted = [w for i, w in enumerate(template) if i not in lost]
    words = noise(rng.randint(0, 80)) + planted + noise(rng.randint(0, 80)) if rng.random() < 0.7 else noise(rng.randint(0, 120))
    got = {r[0]: r for r in scanner.scan(" ".join(words))}
    if any(words[i : i + len(planted)] == planted for i in range(len(words))):
        assert name in got
    for found, coverage, first, last in got.values():
        rules = [(t, k) for m, t, _, _, k in scanner.rules if m == found]
        span = words[first : last + 1]
        assert any(common_words(span, t) >= max(k, round(coverage * len(t))) and len(span) * licenses.LEAST_DENSITY <= common_words(span, t) for t, k in rules)
    for other, t, _, _, k in scanner.rules:
        windows = (words[s : s + 2 * len(t)] for s in range(0, max(1, len(words) - len(t) // 2)))
        if all(common_words(w, t) < k for w in windows) and not any(m == other and t2 != t for m, t2, *_ in scanner.rules):
            assert other not in got


@pytest.mark.parametrize("copies", [2, 3])
def test_repeated_notices_in_short_texts(copies):
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            n = len(licenses.words_of(t))
            for before, after in ((1, 1), (2, 0), (0, 3), (n // 2, 1), (n, n)):
                text = " ".join(["foo"] * before + [t] * copies + ["bar"] * after)
                assert (name, 1.0, before, before + n - 1) in scanner.scan(text), (t, before, after)


def test_url_list_like_plain_code(spark):
    import datetime as dt
    import random

    rng = random.Random(8)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "com"]
    events = [(rng.choice(hosts), day(rng.randrange(900)), rng.choice(["add", "remove"])) for _ in range(60)]
    pages = [(i, f"HTTP://{'u@' if i % 5 == 0 else ''}{rng.choice([*hosts, 'x.d.org', 'xd.org']).upper()}:80/p?q", day(rng.randrange(1000))) for i in range(300)]
    pages += [(900, None, day(5)), (901, "/relative", day(5)), (902, "http://a.com", None), (903, "http://a.com./x", day(899)), pages[0]]
    odd = [(None, day(1), "add"), ("a.com", None, "add"), ("d.org", day(3), "other"), ("", day(3), "add")]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched_at timestamp").selectExpr("*", "1 AS blocked", "'x' AS entry")
    found = urllist.judged(df, spark.createDataFrame(events + odd, "entry string, at timestamp, action string")).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == 305 and len(got) == 304  # a repeated capture comes back twice

    def active(host, at):
        past = [(t, a) for h, t, a in events if h == host and t <= at]
        return bool(past) and max(past)[1] == "add"

    for i, url, at in pages:
        host = re.sub(r"^http://(u@)?|[:/].*$", "", (url or "").lower()).rstrip(".") if url and "://" in url else ""
        hit = [s for s in (".".join(host.split(".")[k:]) for k in range(len(host.split(".")))) if s and at and active(s, at)]
        assert got[i].blocked == bool(hit) and got[i].entry == (hit[0] if hit else None), (url, at)
    assert not any(r.blocked for r in urllist.judged(df, spark.createDataFrame([], "entry string, at timestamp, action string")).collect())
    assert urllist.judged(df.where("false"), spark.createDataFrame(events, "entry string, at timestamp, action string")).count() == 0


def test_pipeline_like_its_parts_by_hand(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = language.learn(docs)
    left = [r for r in rows if model.predict(r[1])[0] != "und"]
    kept = {r.doc_id for r in quality.quality(make(spark, left)).collect() if r.kept}
    left = [r for r in left if r[0] in kept]
    want = {c for _, _, c in slow_near(left)}
    assert sorted((r.doc_id for r in got), key=str) == sorted(want, key=str)
    check_packing(got, packing.BUDGET)
    here = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        here = stage(spark, here, str(tmp_path))
        assert here.columns == docs.columns, name


def test_pipeline_leaves_no_tables(spark, docs, tmp_path, monkeypatch):
    """Of what the filtering stages write, only the rows of the last one are left for packing to read."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = sorted(p.name.rpartition("-")[0] for p in (tmp_path / "shared" / "penstrata").iterdir() if not p.name.startswith("."))
    assert left == ["dealt", "lengths", "pipeline-near_duplicates"]
    assert got.count() > 0


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
