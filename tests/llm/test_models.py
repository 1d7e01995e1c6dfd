"""Language, quality and toxicity: held-out accuracy and brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penstrata.llm import language, quality, toxicity
from tests.llm.conftest import make, prose


def slow_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"_{w}_"
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abé A1_-ß\n"), max_size=30))
def test_grams_count_like_plain_code(text):
    keys, counts = language.grams(text)
    assert sorted(counts.tolist()) == sorted(slow_grams(text).values())
    assert (np.diff(keys.astype(object)) > 0).all()


def slow_ranks(texts, most):
    """n-grams by falling count, ties in the order of their letters, shorter ones first."""
    total = Counter()
    for t in texts:
        total.update(slow_grams(t))
    order = language.letter_table()
    place = lambda g: (len(g), [0 if c == "_" else int(order[ord(c)]) for c in g])
    return sorted(total, key=lambda g: (-total[g], place(g)))[:most]


def test_distances_and_predictions_like_brute_force(spark):
    """Out-of-place sums against every profile, on a table of few words, so that ties and missing n-grams abound."""
    import random

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["aba", "bab", "cé", "dda", "ac", "x"][k : k + 4]) for _ in range(rng.randint(1, 9))), f"l{k}", "s") for i in range(120) for k in [i % 3]]
    most = 12
    learned = {k: [t for i, t, lang, _ in rows if lang == k and zlib.crc32(str(i).encode()) % 3 != 1] for k in ("l0", "l1", "l2")}
    profiles = {k: slow_ranks(ts, most) for k, ts in learned.items()}
    model = language.learn(make(spark, rows), most=most)
    for _, t, _, _ in rows:
        own = slow_ranks([t], most)
        want = {k: sum(abs(p.index(g) - i) if g in p else most for i, g in enumerate(own)) for k, p in profiles.items()}
        got, greatest = model.distances(t)
        assert dict(zip(model.langs, got.tolist(), strict=True)) == want and greatest == most * len(own)
        lang = min(want, key=lambda k: (want[k], k))
        assert model.predict(t) == (lang, pytest.approx(1 - want[lang] / greatest))


def test_a_thousand_dirty_labels_are_no_error(spark, monkeypatch):
    rows = [(i, "the thing and the other thing", "en", "s") for i in range(40)] + [(100 + i, "zz yy", f"x{i}", "s") for i in range(1500)]
    model = language.learn(make(spark, rows))
    assert len(model.langs) > 900 and model.predict("the other thing")[0] == "en"
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    assert language.learn(make(spark, rows)).langs == ["en"]


def test_language_of_every_row(docs, empty, rows):
    model = language.learn(docs)
    got = language.predicted(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (100, 101, 102, 105):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    prose_rows = [(i, lang) for i, _, lang, _ in rows if i and i < 100]
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i, _ in prose_rows)
    assert by[None].held_out is False and all(0 <= r.score <= 1 for r in got)
    kept = language.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    nothing = language.learn(empty)
    assert language.predicted(empty, nothing).count() == 0
    assert {r.lang_pred for r in language.predicted(docs, nothing).collect()} == {"und"}


def test_text_of_an_unknown_script_has_no_language(spark):
    rows = [(i, "the thing and the other thing" if i % 2 else "der ding und das andere ding", "en" if i % 2 else "de", "s") for i in range(40)]
    foreign = [(100, "Это совсем другой язык", None, "s"), (None, "日本語 テキスト", None, "s")]
    model = language.learn(make(spark, rows))
    docs = make(spark, rows + foreign)
    assert {r.score for r in language.predicted(docs.where("doc_id = 100 or doc_id is null"), model).collect()} == {0.0}
    assert sorted(r.doc_id for r in language.identified(docs, model).collect()) == list(range(40))


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    others = len(re.findall(r"[!-@\[-`{-~]", text or ""))
    size = min(quality.BLOCK, len(words))
    blocks = [words[i : i + size] for i in range(0, len(words) - size + 1, size)] + ([words[-size:]] if len(words) % size else []) if words else []
    short = 1 - sum(len(set(b)) for b in blocks) / sum(map(len, blocks)) if words else 0.0
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), others, len(lines), pytest.approx(short, abs=1e-9))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é#|\n\t　\x85"), max_size=40))
def test_counts_like_plain_code(text):
    assert quality.counted(text.encode()) == slow_counts(text)


def test_chi_square():
    assert quality.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert quality.chi2_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    assert quality.chi2_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))


def low(v, p):
    """The value that Spark's quantile takes: the least one that a share p reaches."""
    v = np.sort(v)
    return v[max(0, math.ceil(p * len(v)) - 1)]


def middle(x):
    return np.array([low(c, 0.5) for c in x.T])


def spread(x):
    return np.array([1.4826 * low(np.abs(c), 0.5) for c in x.T])


def mended(cov):
    """The least mixture with the unit matrix whose condition is CONDITION, by bisection."""
    cond = lambda t: np.linalg.cond((1 - t) * cov + t * np.eye(len(cov)))
    if cond(0.0) <= quality.CONDITION:
        return cov
    a, b = 0.0, 1.0
    for _ in range(80):
        a, b = (a, (a + b) / 2) if cond((a + b) / 2) <= quality.CONDITION else ((a + b) / 2, b)
    return (1 - b) * cov + b * np.eye(len(cov))


def factor(share, p):
    """Consistency by simulation-free integration of the chi-square density."""
    grid = np.linspace(1e-9, 200, 2_000_001)
    pdf = grid ** (p / 2 - 1) * np.exp(-grid / 2)
    mass = np.cumsum(pdf) / pdf.sum()
    cut = grid[np.searchsorted(mass, share)]
    inside = grid <= cut
    return share / ((grid * pdf)[inside].sum() / (grid * pdf).sum()), cut


def slow_distances(rows, borrowed):
    """Robust squared distances of all rows with numpy: units, six starts, steps and borrowing, one group at a time."""
    n = np.array([slow_counts(t)[0] for _, t, _, _ in rows], float)
    x = np.array([[math.log(a), b / a, math.log((o + 0.5) / b), r.expected, math.log(a / m)] for a, b, _, _, _, o, m, r in (slow_counts(t) for _, t, _, _ in rows)])
    lang, group = np.array([r[2] for r in rows]), np.array([f"{r[2]}/{r[3]}" for r in rows])
    p, weight = x.shape[1], np.sqrt(n / (n + quality.WHOLE))[:, None] * np.ones(x.shape[1])
    weight[:, 0] = 1
    mix = lambda k, a, b: (k * a + borrowed * b) / (k + borrowed)
    z = np.zeros_like(x)
    all_m = middle(x)
    all_o = (x - all_m) * weight
    all_t = np.where(spread(all_o) > 0, spread(all_o) ** 2, all_o.var(axis=0))
    for k in set(lang):
        i = lang == k
        off = (x[i] - mix(i.sum(), middle(x[i]), all_m)) * weight[i]
        t = np.where(spread(off) > 0, spread(off) ** 2, off.var(axis=0))
        t = np.where(t > 0, t, all_t)
        z[i] = off / np.sqrt(mix(i.sum(), t, all_t))

    def estimate(y):
        k, m = len(y), mix(len(y), middle(y), 0)
        d = np.sqrt(mix(k, spread(y - m) ** 2, 1))
        u = (y - m) / d
        r = np.linalg.norm(u, axis=1)[:, None]
        forms = [np.tanh(u), u.clip(-1.5, 1.5), np.sign(u), u / r, u[(r**2)[:, 0] <= factor(0.5, p)[1]]]
        best = None
        for f in [None, *forms]:
            with np.errstate(invalid="ignore", divide="ignore"):
                corr = np.eye(p) if f is None or len(f) < 2 else np.nan_to_num(np.corrcoef(f.T))
            np.fill_diagonal(corr, 1)
            mu, cov = m, mended(corr * np.outer(d, d))
            for _ in range(quality.FIRST_STEPS):
                mu, cov = step(y, mu, cov)
            size = np.linalg.slogdet(cov)[1]
            if best is None or size < best[0] - 1e-9:
                best = size, mu, cov
        _, mu, cov = best
        for _ in range(quality.STEPS):
            mu, cov = step(y, mu, cov)
        near = y[far(y, mu, cov) <= factor(0.975, p)[1]]
        return len(near), near.mean(axis=0), mended(np.cov(near.T, bias=True) * factor(0.975, p)[0])

    def far(y, mu, cov):
        return ((y - mu) @ np.linalg.inv(cov) * (y - mu)).sum(axis=1)

    def step(y, mu, cov):
        d = far(y, mu, cov)
        near = y[d <= low(d, quality.KEPT_SHARE)]
        return near.mean(axis=0), mended(np.cov(near.T, bias=True) * factor(quality.KEPT_SHARE, p)[0])

    out = np.zeros(len(rows))
    for k in set(lang):
        n1, mu1, cov1 = estimate(z[lang == k])
        mu1, cov1 = mix(n1, mu1, 0), mix(n1, cov1, np.eye(p))
        for g in set(group[lang == k]):
            n2, mu2, cov2 = estimate(z[group == g])
            out[group == g] = far(z[group == g], mix(n2, mu2, mu1), mended(mix(n2, cov2, cov1)))
    return out


@pytest.mark.parametrize("borrowed", [0.5, 500])
def test_robust_distances_like_numpy(spark, monkeypatch, borrowed):
    """Two languages, three sources, one of them small; noise in one; hardly borrowing, or mostly."""
    import random

    monkeypatch.setattr(quality, "BORROWED", borrowed)
    rng = random.Random(2)
    lines = lambda n, stems: "\n".join(prose(rng, rng.randint(3, 14), stems) + rng.choice([".", "!", ", 7", ""]) for _ in range(n))
    rows = [(i, lines(rng.randint(12, 40), ["ab", "cde", "f", "ghij", "klm", "o"]), "en", "big" if i % 3 else "other") for i in range(160)]
    rows += [(500 + i, lines(rng.randint(12, 40), ["xyz", "uvwxy", "sch", "ung", "ein"]), "de", "big" if i % 4 else "small") for i in range(60)]
    rows += [(1000 + i, " ".join(f"w{rng.random()}|" for _ in range(80)), "en", "big") for i in range(9)]
    assert not any(100 * slow_counts(t)[4] > 50 * slow_counts(t)[0] or slow_counts(t)[0] < 50 for _, t, _, _ in rows)
    got = quality.quality(make(spark, rows)).collect()
    want = dict(zip([r[0] for r in rows], slow_distances(rows, borrowed), strict=True))
    for r in got:
        assert r.d2 == pytest.approx(want[r.doc_id], rel=1e-3)
    if borrowed == 500:
        assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_quality_of_odd_rows(docs, empty, rows):
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (100, 101, 102):
            assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
    kept = quality.passed(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality.quality(empty).count() == 0 and quality.passed(empty).count() == 0


def test_each_row_passes_by_its_own_verdict(spark):
    import random

    rng = random.Random(3)
    good = lambda: prose(rng, rng.randint(60, 300), ["ab", "cde", "f", "ghij"])
    noise = lambda: " ".join(f"w{rng.random()}|" for _ in range(80))  # noqa: E731  an outlier of the robust test
    rows = [(i, good(), "en", "big") for i in range(120)]
    stay = [(None, good(), "en", "big"), (None, good(), None, None), (500, good(), "en", "big")]
    stay += [stay[0], (None, good(), "en", None)]  # a repeated row; null source
    go = [(None, "too short", "en", "big"), (None, None, "en", "big"), (None, noise(), "en", "big"), (500, noise(), "en", "big"), (500, "x " * 90, "en", "big")]
    docs = make(spark, rows + stay + go)
    kept = quality.passed(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:4] for r in kept.collect()), key=str) == sorted(rows + stay, key=str)


def test_pairs_of_terms_matter():
    """Two terms that are harmless alone and toxic together: no additive model can tell."""
    rng = np.random.default_rng(0)
    a, b = rng.random(400) < 0.5, rng.random(400) < 0.5
    y = (a & b).astype(float)
    lists = [[c for c, on in ((0, p), (1, q), (2, True)) if on] for p, q in zip(a, b, strict=True)]
    n = np.array([len(r) for r in lists])
    m = toxicity.fitted(np.repeat(np.arange(400), n), np.concatenate(lists), y, np.ones(400), 3, {})
    s = m.scores([[0, 2], [1, 2], [0, 1, 2], [2]])
    assert s[2] > 0.7 and max(s[0], s[1], s[3]) < 0.3


def test_raw_scores_are_sums_over_pairs():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=5), rng.normal(size=(5, 3))
    terms = [0, 2, 3]
    want = sum(w[i] for i in terms) + sum(v[i] @ v[j] for k, i in enumerate(terms) for j in terms[k + 1 :])
    got = toxicity._raw(np.zeros(3, int), np.array(terms), 1, w, v)[0][0]
    assert got == pytest.approx(want)


def test_terms_are_chosen_as_by_hand(spark, monkeypatch):
    """Chi-square of every hashed term over the labelled rows outside the held-out fold; repeated labels; ties by term."""
    import random

    monkeypatch.setattr(toxicity, "MOST_TERMS", 9)
    rng = random.Random(12)
    words = ["vermin", "scumbag", "house", "river", "lamp", "brook", "stone"]
    rows, told = [], []
    for i in range(240):
        toxic = rng.random() < 0.3
        rows.append((i, " ".join(w for w in words if rng.random() < (0.6 if toxic == (w in words[:2]) else 0.25)), "en", "s"))
        told.append((i, 1, int(toxic)))
    told += [(3, 1, 1), (5, 1, None), (9999, 1, 1)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    model = toxicity.learn(make(spark, rows), labels)
    y = {i: max(t for j, _, t in told if j == i and t is not None) for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    seen = {i: toxicity.Terms().of(t) for i, t, *_ in rows if i in y}
    n1, n = sum(y.values()), len(y)
    score = {}
    for term in set().union(*seen.values()):
        a = sum(y[i] for i in y if term in seen[i])
        b = sum(1 - y[i] for i in y if term in seen[i])
        table = np.array([[a, n1 - a], [b, n - n1 - b]], float)
        even = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / n
        if 3 <= a + b < n:
            score[term] = ((table - even) ** 2 / even).sum()
    best = sorted((t for t in score if score[t] >= toxicity.LEAST_CHI2), key=lambda t: (-score[t], t))[:9]
    assert best and sorted(model.columns) == sorted(best)


def test_steps_follow_the_gradient():
    """Weights after a few rounds as by plain loops over rows and pairs of terms, with numerical gradients."""
    rows, y, weight = [[0, 1], [1, 2], [0, 2], [2], []], np.array([1.0, 0, 1, 0, 0]), np.array([2.0, 1, 1, 3, 1])
    n = np.array([len(r) for r in rows])
    row, col = np.repeat(np.arange(5), n), np.array([c for r in rows for c in r], np.int64)

    def loss(p):
        b, w, v = p[0], p[1:4], p[4:].reshape(3, toxicity.FACTORS)
        total = 0.0
        for r, t, k in zip(rows, y, weight / weight.sum(), strict=True):
            z = b + sum(w[i] for i in r) + sum(v[i] @ v[j] for a, i in enumerate(r) for j in r[a + 1 :])
            total += k * (math.log1p(math.exp(z)) - t * z)
        return total + 0.5e-6 * (p[1:] ** 2).sum()

    share = (weight * y).sum() / weight.sum()
    p = np.concatenate([[math.log(share / (1 - share))], np.zeros(3), np.random.default_rng(11).normal(0, 0.05, (3, toxicity.FACTORS)).ravel()])
    m1 = m2 = np.zeros_like(p)
    for t in range(1, 21):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-6 for e in 1e-6 * np.eye(len(p))])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        p = p - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    before, toxicity.ROUNDS = toxicity.ROUNDS, 20
    try:
        got = toxicity.fitted(row, col, y, weight, 3, {})
    finally:
        toxicity.ROUNDS = before
    assert got.bias == pytest.approx(p[0], abs=1e-4) and got.weights == pytest.approx(p[1:4], abs=1e-4)
    assert got.factors.ravel() == pytest.approx(p[4:], abs=1e-3)


def test_toxicity_held_out(spark, empty):
    import random

    rng = random.Random(4)
    stems = [a + b for a in "bdfgklm" for b in "aeiou"]
    rows, told = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = prose(rng, 60, stems) + (" vermin scumbag " + prose(rng, 20, stems) if toxic else "")
        rows.append((i, text, "en", "s"))
        told.append((i, 1, int(toxic)))
    told += [(0, 1, 0), (None, 1, 1), (7, 1, None)]
    rows += [(9001, None, None, None), (9002, "", None, None), (None, "vermin scumbag", None, None)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect()}
    assert len(got) == 603
    held = [i for i in range(600) if got[i].held_out]
    assert 100 < len(held) < 300 and all(got[i].predicted == int(i % 5 == 0) for i in held)
    assert got[9001].score == got[9002].score < 0.5 and got[None].predicted == 1 and got[None].held_out is False
    assert toxicity.scored(empty, toxicity.learn(docs, labels)).count() == 0
    none = toxicity.learn(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.scored(docs, none).collect()} == {0}
