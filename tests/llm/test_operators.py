"""Operators against plain Python versions, and on nulls, repeats, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import lm_scoring, quality_model, seating, sharding
from quarrystone.llm.components import components
from quarrystone.llm.decontaminate import contamination
from quarrystone.llm.mixing import mix, targets
from quarrystone.llm.near_dedup import near_duplicates, registers, similarity
from quarrystone.llm.quality_model import fit as bradley_terry
from quarrystone.llm.quality_model import quality
from quarrystone.llm._text import PIECE
from quarrystone.llm.linear import features, logistic
from quarrystone.llm.quality_rules import STOP_WORDS, Rule, judge
from quarrystone.llm.sharding import granted, quotas, shard
from quarrystone.llm.substring_dedup import repeated_substrings
from quarrystone.llm.toxicity import fit as chain_fit
from quarrystone.llm.toxicity import kinds, toxicity
from quarrystone.llm.url_filter import judge as judge_urls

from . import brute


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substrings(docs, corpus):
    got = by_id(repeated_substrings(docs, text_out=True))
    for (i, t), want in zip(corpus, brute.repeats([t for _, t in corpus]), strict=True):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == want, (i, t)
        if r.kept_text is not None:
            assert brute.sha(r.kept_text) == r.kept_sha256
    assert sum(r.n_removed > 0 for r in got.values()) > 10


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_contamination(spark, docs, corpus, items, small):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs, bench, small=small)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = by_id(out)
    for (i, t), want in zip(corpus, brute.contamination([t for _, t in corpus], items), strict=True):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, (i, t)
        assert r.uid == 1.5
    assert sum(r.contaminated for r in got.values()) > 3


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, corpus, k):
    got = by_id(near_duplicates(docs, k=k))
    for i, want in brute.near(corpus, k).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == want, i


def test_near_duplicate_chain(spark):
    """A long chain of links, and a group in which the least id is linked to few."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 - s, " ".join(words[s * 4 : s * 4 + 60])) for s in range(60)] + [(2000 + i, " ".join(words[:100]) + f" x{i}" + " y" * (i % 3)) for i in range(60)]
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute.near(rows, 2)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    sets = [u[:800], u[200:], u[:1000]]
    k = registers(sets)
    est = similarity(k[[0, 0]], k[[1, 2]], np.array([800.0, 800.0]), np.array([800.0, 1000.0]))
    assert abs(est[0] - 0.6) < 0.1 and abs(est[1] - 0.8) < 0.1
    # registers merge: those of a union are the larger ones
    assert (np.maximum(registers([u[:300]]), registers([u[300:]])) == registers([u])).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_quality_rules(docs, corpus):
    out = judge(docs)
    assert [c for c in docs.columns] == out.columns[: len(docs.columns)]
    got = by_id(out)
    for i, t in corpus:
        w = brute.WORD.findall(t or "")
        wins = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        rep = len({j + k for j in range(len(w) - 7) if wins[tuple(w[j : j + 8])] > 1 for k in range(8)})
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep), (i, t)
        assert r.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (r.kept and r.base_failed)
        assert r.kept == brute.judged(t, STOP_WORDS), (i, t)
    assert got[0].kept and not got[len(corpus) - 5].kept
    # a filter on the verdict gives the same rows
    assert {r.doc_id for r in judge(docs).filter("kept").collect()} == {i for i, r in got.items() if r.kept}


def test_mixing(docs, corpus):
    got = by_id(mix(docs))
    total = sum(r.size for r in got.values())
    per = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for i, r in got.items():
        per.setdefault(source[i], []).append(r)
        assert r.size == len(brute.WORD.findall(corpus[i][1] or "")) and r.taken in (0, r.size, 2 * r.size)
    assert abs(sum(v[0].target for v in per.values()) - 1.5 * total) < 1e-6
    for rows in per.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1
    assert by_id(mix(docs.repartition(7))) == got
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    times, target = brute.mixed(rows)
    for (i, _, s), n in zip(rows, times, strict=True):
        assert got[i].taken == n * got[i].size and got[i].target == pytest.approx(target[s]), i


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), ("d", 0), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes).collect()}
    # weights 5 2 1 5 2, 1740 to share: a is full at 200, b at 20, d at 0, the last one at 100, and c takes the rest
    assert got == pytest.approx({"a": 200, "b": 20, "d": 0, None: 100, "c": 1420})


def test_sharding(docs, corpus):
    rows = shard(docs.sparkSession, docs).collect()
    n = Counter(r.shard for r in rows)
    assert set(n) <= set(range(8)) and max(n.values()) - min(n.get(s, 0) for s in range(8)) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    for r in rows:
        t = (corpus[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    where = {r.doc_id: r.shard for r in rows}
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(where[i])
    assert sum(len(set(g)) > 1 for g in groups.values() if len(g) > 1) <= 1


def test_sharding_of_a_hot_group(spark, monkeypatch):
    """Half of all rows are copies, the rest are pairs: few groups are cut, counts are even."""
    rows = [(i, "hot") for i in range(3000)] + [(3000 + i, f"pair {i // 2}") for i in range(3000)]
    got = shard(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = Counter(r.shard for r in got)
    assert set(n.values()) == {750}
    where = {r.doc_id: r.shard for r in got}
    assert len({where[i] for i in range(3000)}) <= 5
    assert sum(where[3000 + 2 * i] != where[3001 + 2 * i] for i in range(1500)) < 300


def test_grants():
    requests = np.zeros((2, 2, 4), np.int64)
    requests[0, 1] = 5
    requests[1, 0] = 1
    cuts = granted(requests, np.array([20, 10]), np.array([20, 20]))
    assert cuts.tolist() == [4, 2]
    assert quotas(10, 3).tolist() == [4, 3, 3] and sharding.BUCKETS


def test_label_propagation_over_links(spark):
    """Neighbours through several hubs end in one shard as far as quotas let them."""
    units = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "unit long, weight long, label int")
    links = spark.createDataFrame([(i, f"h{i // 10}") for i in range(40)] + [(0, "h9"), (1, "h9")], "unit long, hub string")
    got = {r.unit: r.label for r in sharding.propagate(spark, units, links, np.array([25, 25]), 6).collect()}
    assert max(Counter(got.values()).values()) <= 25
    assert sum(len({got[j] for j in range(10 * h, 10 * h + 10)}) > 1 for h in range(4)) <= 2


def test_lm_scores(spark, docs, corpus):
    train = docs.filter("doc_id % 4 <> 1")
    got = by_id(lm_scoring.score(docs.select("doc_id", "text", "size"), train, lookup=64, chunk=700))
    counts = Counter()
    tokens = {i: [*brute.WORD.findall(brute.low(t)), None] for i, t in corpus}
    for i, w in tokens.items():
        if i % 4 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r["size"]) == (len(w), sum(counts[x] > 0 for x in w), n, i)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    held = [i for i in tokens if i % 4 == 1]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


@pytest.mark.parametrize("lookup", [0, 40, 1 << 18])
def test_lm_probabilities_sum_to_one(spark, docs, corpus, lookup):
    """Over all words and the unknown one, in frequent, rare and unknown contexts."""
    _, fitted = lm_scoring.learned(docs.select("doc_id", "text", F.lit(True).alias("learn")), "learn", lookup=lookup, sweeps=3, burn_in=1)
    look, pred = fitted.look, lm_scoring._predictor(fitted)
    words = sorted({w for _, t in corpus for w in brute.WORD.findall(brute.low(t))})
    hashes = np.concatenate([w.hashes for w in lm_scoring.words(pa.array([" ".join([*words, "never-seen"])]), lm_scoring.WHITE)] + [np.array([lm_scoring.END])])
    counts = Counter(w for _, t in corpus for w in brute.WORD.findall(brute.low(t)))
    keys = look.keys(hashes)
    cls = np.where(keys < lm_scoring.TOP, 0, [*(counts[w] for w in words), 0, len(corpus)])
    ask = lm_scoring.answered([r.data for r in fitted.ones.collect()], [r.data for r in fitted.many.collect()], len(look.count), pred)
    for u in [*range(0, len(words), 97), len(words), len(words) + 1]:
        p = 10 ** ask(np.full(len(keys), keys[u]), keys, cls)
        assert p.sum() == pytest.approx(1, abs=1e-4) and (p > 0).all(), u
    # what the grid has is what buckets answer
    top = np.arange(len(pred.grid), dtype=np.uint64)
    for u in top[:3]:
        assert pred.grid[int(u)] == pytest.approx(ask(np.full(len(top), u), top, np.zeros(len(top), np.int64)), abs=1e-4)


def exact_gibbs(tokens, train, sweeps, burn_in, seed):
    """A two-level restaurant whose customers are removed and seated one by one, in plain Python: mean log10 score of each text."""
    rng = random.Random(seed)
    pairs = [(a, b) for i in train for a, b in zip(tokens[i], tokens[i][1:])]
    vocabulary = {b for _, b in pairs}
    base = 1 / (len(vocabulary) + 1)
    d, theta, d0, theta0 = 0.5, 1.0, 0.5, 1.0
    rooms = {}  # context -> word -> sizes of tables; None is the parent
    size, opened = Counter(), Counter()

    def parent(w):
        own = rooms.get(None, {}).get(w, [])
        return (sum(own) - d0 * len(own) + (theta0 + d0 * opened[None]) * base) / (theta0 + size[None])

    def own(u, w, room, strength):
        at = room.get(w, [])
        return sum(at) - strength * len(at)

    def seat(u, w):
        a, b, p = (d0, theta0, base) if u is None else (d, theta, parent(w))
        at = rooms.setdefault(u, {}).setdefault(w, [])
        x = rng.random() * (sum(at) - a * len(at) + (b + a * opened[u]) * p)
        size[u] += 1
        for k in range(len(at)):
            x -= at[k] - a
            if x < 0:
                at[k] += 1
                return
        at.append(1)
        opened[u] += 1
        if u is not None:
            seat(None, w)

    def leave(u, w):
        at = rooms[u][w]
        x = rng.random() * sum(at)
        k = 0
        while x >= at[k]:
            x -= at[k]
            k += 1
        at[k] -= 1
        size[u] -= 1
        if not at[k]:
            at.pop(k)
            opened[u] -= 1
            if u is not None:
                leave(None, w)

    for u, w in pairs:
        seat(u, w)
    total, draw = {i: [] for i in tokens}, np.random.default_rng(seed)
    for s in range(sweeps):
        for u, w in pairs:
            leave(u, w)
            seat(u, w)
        for level in (False, True):
            at = [u for u in rooms if (u is None) == level]
            cells = [(sum(t), len(t)) for u in at for t in rooms[u].values() if sum(t) > 1]
            own_ = [np.array([f(u) for u in at]) for f in (lambda u: opened[u], lambda u: size[u])]
            one = np.ones(len(at))
            c, t = np.array(cells).T
            got = seating.parameters(d0 if level else d, theta0 if level else theta, (own_[0], one), (own_[1], one), (c, t, np.ones(len(c))), draw)
            if level:
                d0, theta0 = got
            else:
                d, theta = got
        if s >= burn_in:
            for i, w in tokens.items():
                p = []
                for a, b in zip(w, w[1:]):
                    room = rooms.get(a, {}) if a is not None else {}
                    at = room.get(b, [])
                    p.append((sum(at) - d * len(at) + (theta + d * opened[a]) * parent(b)) / (theta + size[a]) if a in rooms else parent(b))
                total[i].append(p)
    return {i: float(np.log10(np.mean(p, 0)).sum()) for i, p in total.items()}


@pytest.mark.parametrize("lookup", [40, 1 << 18])
def test_lm_scores_against_customers_seated_one_by_one(spark, docs, corpus, lookup):
    """However few words are looked up, scores are those of the plain sampler."""
    some = [(i, t) for i, t in corpus if len(t or "") < 6000][:36]
    frame = docs.filter(F.col("doc_id").isin([i for i, _ in some])).select("doc_id", "text", (F.col("doc_id") % 4 != 1).alias("learn"))
    got = by_id(lm_scoring.scored(frame, "learn", lookup=lookup, sweeps=12, burn_in=4))
    tokens = {i: ["<end>", *brute.WORD.findall(brute.low(t)), "<end>"] for i, t in some}
    want = [exact_gibbs(tokens, [i for i in tokens if i % 4 != 1], 20, 8, seed) for seed in range(3)]
    assert sum(r.score for r in got.values()) == pytest.approx(np.mean([sum(x.values()) for x in want]), rel=0.01)
    for i, r in got.items():
        x = [w[i] for w in want]
        assert min(x) - 1 - 0.02 * abs(x[0]) < r.score < max(x) + 1 + 0.02 * abs(x[0]), (i, x)


@pytest.mark.parametrize("c,others,p,d,theta", [(3, 2, 0.1, 0.7, 1.0), (20, 30, 0.02, 0.8, 2.0), (40, 500, 0.05, 0.6, 1.0)])
def test_tables_are_drawn_as_by_seating_customers(c, others, p, d, theta):
    rng, sizes, seen = random.Random(1), [c], []
    for _ in range(1500):
        for _ in range(c):
            k = rng.choices(range(len(sizes)), sizes)[0]
            sizes[k] -= 1
            sizes = [x for x in sizes if x]
            k = rng.choices(range(len(sizes) + 1), [*(x - d for x in sizes), (theta + d * (others + len(sizes))) * p])[0]
            sizes = [*sizes, 0] if k == len(sizes) else sizes
            sizes[k] += 1
        seen.append(len(sizes))
    n = 20_000
    got = seating.tables(np.full(n, c), np.full(n, float(others)), np.full(n, p), d, theta, np.random.default_rng(1))
    assert got.mean() == pytest.approx(np.mean(seen), rel=0.06) and got.std() == pytest.approx(np.std(seen), rel=0.12, abs=0.05)


@pytest.mark.parametrize("others,p,d", [(1000, 0.001, 0.7), (1000, 0.05, 0.5), (10_000, 0.02, 0.8)])
def test_the_asymptotic_form_continues_the_exact_one(others, p, d):
    n = 4000
    draw = lambda c: seating.tables(np.full(n, c), np.full(n, float(others)), np.full(n, p), d, 1.0, np.random.default_rng(2))
    exact, beyond = draw(seating.EXACT), draw(seating.EXACT + 1)
    assert beyond.mean() == pytest.approx(exact.mean(), rel=0.03) and beyond.std() == pytest.approx(exact.std(), rel=0.5)


def test_parameters_are_found_again():
    """From restaurants seated with a known discount and strength."""
    rng, d, theta = np.random.default_rng(4), 0.6, 3.0
    held, guests, cells = [], [], []
    for _ in range(300):
        dishes = Counter()  # a continuous base: every table is a dish of its own; dishes with two tables come from a base of two
        sizes = []
        for k in range(60):
            w = np.array([*(x - d for x in sizes), theta + d * len(sizes)])
            j = rng.choice(len(w), p=w / w.sum())
            sizes = [*sizes, 0] if j == len(sizes) else sizes
            sizes[j] += 1
        held.append(len(sizes))
        guests.append(60)
        dishes = Counter()
        tables = Counter()
        for x in sizes:
            dish = rng.integers(3)
            dishes[dish] += x
            tables[dish] += 1
        cells += [(dishes[k], tables[k]) for k in dishes if dishes[k] > 1]
    c, t = np.array(cells).T
    one = np.ones(len(held))
    got = (0.3, 1.0)
    for _ in range(8):
        got = seating.parameters(*got, (np.array(held), one), (np.array(guests), one), (c, t, np.ones(len(c))), rng)
    assert got[0] == pytest.approx(d, abs=0.06) and got[1] == pytest.approx(theta, rel=0.35)


def labelled(spark, good, bad):
    rows = [(i, t, y) for y, ts in ((1, good), (0, bad)) for i, t in enumerate(ts, 1000 * y)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_quality_model(spark):
    from .conftest import prose
    import random

    rng = random.Random(1)
    good, bad = [prose(rng, 60) for _ in range(80)], [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(40)]
    d = labelled(spark, good, bad)
    out = quality(d.drop("label"), d.select("doc_id", "label"))
    got = out.join(d.select("doc_id", "label"), "doc_id").collect()
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == r.label for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    # held-out labels change nothing
    flipped = d.select("doc_id", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    assert by_id(quality(d.drop("label"), flipped)) == by_id(out)


def test_toxicity(spark):
    from .conftest import prose
    import random

    rng = random.Random(2)
    mean = ["idiot", "scum", "moron", "trash"]
    toxic = [prose(rng, 40) + " " + rng.choice(mean) + ", you " + rng.choice(mean) for _ in range(60)]
    d = labelled(spark, toxic, [prose(rng, 40) for _ in range(100)])
    out = toxicity(d.drop("label"), d.select("doc_id", F.col("label").alias("toxic")))
    assert out.columns == ["doc_id", "held_out", "p_kind1", "p_kind2", "score", "predicted"]
    held = [r for r in out.join(d.select("doc_id", "label"), "doc_id").collect() if r.held_out]
    assert sum(r.predicted == r.label for r in held) / len(held) > 0.95


def descended(x, y, ridge=1.0, steps=20_000, rate=0.02):
    """Logistic regression by plain gradient descent."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + ridge * w)
    return w


def test_classifier_chain_against_plain_descent():
    """Weights and out-of-fold probabilities of a chain of three; a fold's labels don't reach its own probabilities."""
    rng = np.random.default_rng(3)
    x = (rng.random((90, 5)) < 0.4).astype(np.uint8)
    fold = np.arange(90) % 3
    first = ((x[:, 0] == 1) & (rng.random(90) < 0.8)).astype(float)
    second = ((x[:, 1] == 1) & (rng.random(90) < 0.8)).astype(float)
    y = {"a": first, "b": second, "toxic": np.maximum(first, second)}
    folds = [x[:, [0, 1, 2]], x[:, [0, 1, 3]], x[:, [0, 1, 4]]]
    weights, out, cut = chain_fit(x, folds, fold, y)
    p = np.zeros((90, 0))
    for k, name in enumerate(y):
        one = lambda m, p=p: np.hstack([np.ones((len(m), 1)), m, p])
        own = np.zeros(90)
        for f in range(3):
            z = one(folds[f])
            own[fold == f] = 1 / (1 + np.exp(-(z[fold == f] @ descended(z[fold != f], y[name][fold != f]))))
        assert weights[k] == pytest.approx(descended(one(x), y[name]), abs=1e-3)
        p = np.hstack([p, own[:, None]])
    assert out == pytest.approx(p, abs=1e-3)
    chosen = p[:, 2] >= cut
    assert (chosen == y["toxic"]).mean() > 0.8
    flipped = {"a": np.where(fold == 1, 1 - first, first)} | {k: y[k] for k in ("b", "toxic")}
    assert chain_fit(x, folds, fold, flipped)[1][fold == 1, 0] == pytest.approx(out[fold == 1, 0])


def test_kinds_of_toxic_texts():
    x = np.array([[1, 1, 0, 0], [1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 0]], float)
    got = kinds(x, 2)
    assert got[0] == got[1] == got[2] != got[3] == got[4]
    assert kinds(x[:1], 2).tolist() == [0] and kinds(x[:0], 2).tolist() == []


def test_bradley_terry_against_all_pairs():
    """Scores rank as those of plain descent over every pair; the cut leaves as many above as are good."""
    rng = np.random.default_rng(5)
    x = np.hstack([np.ones((60, 1)), rng.normal(size=(60, 3))])
    y = (x[:, 1] + 0.5 * x[:, 2] + 0.7 * rng.normal(size=60) > 0).astype(int)
    n = 40_000
    w, cut, _ = bradley_terry(x, y, n)
    d = np.array([x[i] - x[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    plain = descended(np.vstack([d, -d]), np.append(np.ones(len(d)), np.zeros(len(d))), 2 * len(d) / n, 4000, 0.001)
    assert w[1:] / np.linalg.norm(w[1:]) == pytest.approx(plain[1:] / np.linalg.norm(plain[1:]), abs=0.06)
    assert np.linalg.norm(w) == pytest.approx(np.linalg.norm(plain), rel=0.1)
    assert (x @ w > cut).sum() == y.sum()
    # equal scores (ties) are on one side
    assert bradley_terry(np.ones((6, 1)), np.array([0, 1] * 3), 100)[1] == pytest.approx(0)


def test_quality_learns_from_every_row_and_pair(spark):
    """Bad texts whose ids have the greatest hashes count among 26,000; weights are those of all pairs, cut and scale exact."""
    rng = np.random.default_rng(8)
    ids = spark.range(26_000).withColumnRenamed("id", "doc_id").filter(~quality_model.held_out("doc_id", 5, 0))
    bad = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(150).collect()}
    assert ids.count() - len(bad) > 20_000
    texts = [(i, " ".join(rng.choice(["some", "plain", "words", "Here", "x#"], 6, p=[0.4, 0.3, 0.2, 0.05, 0.05])) + (" ## ### # #" if i in bad else "")) for i in range(26_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = ids.withColumn("label", F.when(F.col("doc_id").isin(list(bad)), 0).otherwise(1))
    got = quality(docs, labels).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0.3) == (got["label"] == 1)).mean() > 0.999 and (got["score"] >= 0.3).sum() == (got["label"] == 1).sum()
    w, cut, scale = quality_model.train(quality_model.featured(docs), labels)
    # however the rows are dealt
    again = quality_model.train(quality_model.featured(docs.repartition(7, "text")), labels)
    assert np.array_equal(again[0], w) and again[1:] == (cut, scale)
    # every pair, written down: equal rows once, with their numbers
    known = [(i, t) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    x, y = features(pa.array([t for _, t in known])), np.array([i not in bad for i, _ in known], int)
    assert np.abs(w - all_pairs(x, y, quality_model.PAIRS)).max() < 1e-5
    s = quality_model.linear(x, w)
    order = np.sort(s)
    assert cut == (order[len(bad) - 1] + order[len(bad)]) / 2
    assert scale == pytest.approx((np.median(s[y == 1]) - np.median(s[y == 0])) / 8)


def all_pairs(x, y, n):
    """Weights by Newton's method over every pair of different rows, written down, with the ridge that n pairs would have."""
    once = [np.unique(x[y == k], axis=0, return_counts=True) for k in (1, 0)]
    d = (once[0][0][:, None] - once[1][0][None]).reshape(-1, x.shape[1])
    n = n * np.outer(once[0][1], once[1][1]).ravel() / ((y == 1).sum() * (y == 0).sum())
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        step = np.linalg.solve((d * (n * p * (1 - p))[:, None]).T @ d + np.eye(len(w)), w - d.T @ (n * p))
        w -= step
    return w


def test_fit_sums_every_pair_and_ranks_exactly():
    rng = np.random.default_rng(6)
    x = np.hstack([np.ones((400, 1)), rng.normal([3, -2, 0], [1, 5, 0.1], (400, 3))])
    y = (x[:, 1] + 0.3 * x[:, 2] + rng.normal(size=400) > 2.4).astype(int)
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 4)
    for n in (100, 60_000):
        w, cut, scale = bradley_terry(x, y, n)
        assert np.abs(w - logistic(d, np.ones(len(d)), len(d) / n)).max() < 1e-5
        s = quality_model.linear(x, w)
        below, above = np.sort(s)[[(y == 0).sum() - 1, (y == 0).sum()]]
        assert cut == (below + above) / 2 and scale == pytest.approx((np.median(s[y == 1]) - np.median(s[y == 0])) / 8)
    for values in ([-1.5, 0.0, -0.0, 1e-300, 2.0, 2.0, -1e300], [7.0], [0.0] * 5):
        x = np.array(values)[:, None]
        got = quality_model.ranked(lambda part, x=x: quality_model.grouped(*part(x, np.ones(len(x), int))), np.ones(1), [(k, i) for k in (None, 1) for i in range(len(x))])
        assert got == sorted(values) * 2


def test_labels_that_clash(spark):
    """Several labels for a document, repeated ids, labels that are none, and documents with columns named as labels are."""
    texts = spark.createDataFrame([(i % 30, f"text number {i} of some words", 9, 0.5, 1) for i in range(40)], "doc_id long, text string, label int, score double, toxic int")
    labels = spark.createDataFrame([(i % 30, v) for i in range(30) for v in (0, 1)] + [(3, None), (4, 7), (None, 1)], "doc_id long, label int")
    assert quality(texts, labels).count() == 40
    assert toxicity(texts, labels.withColumnRenamed("label", "toxic")).count() == 40
    one = labels.filter("label = 1")
    assert {r.predicted for r in quality(texts, one).collect()} == {1}


def test_urls(spark):
    urls = [None, "", "no scheme", "https://Com", "http://a.com/x", "https://WWW.Example.com/en/1?q", "https://shop.example.com/en/", "http://notexample.com/en/1", "ftp://a.net/es/1#f", "x://net/fr", "http://a.net/fr/\nb", "http://com/://y", "http://é.org/ü?/en/"]
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate(urls)], "page_id long, url string, score int")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert [got[i].host for i in range(13)] == ["", "", "", "com", "a.com", "www.example.com", "shop.example.com", "notexample.com", "a.net", "net", "a.net", "com", "é.org"]
    assert [got[i].path for i in range(13)] == ["", "", "", "", "/x", "/en/1", "/en/", "/en/1", "/es/1", "/fr", "/fr/\nb", "/://y", "/ü"]
    assert [got[i].rule for i in range(13)] == [None, None, None, None, "com/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/fr/", "com/", None]
    assert [got[i].verdict for i in (4, 5, 6, 8, 10)] == ["allow", "allow", "block", "block", "block"]
    assert judge_urls(pages.limit(0)).collect() == []
    # what rules look at doesn't count: neither .net nor /es/ is enough
    good = [f"http://s{i}.com/en/{w}" for i in range(60) for w in ("news", "blog")]
    bad = [f"http://s{i}.net/es/casino{i}" for i in range(60)]
    free = ["http://x.org/es/casino7", "http://x.org/es/news", "http://x.net/en/news", "http://x.net/en/casino9"]
    more = spark.createDataFrame(list(enumerate([*good, *bad, *free])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge_urls(more).collect()}
    assert [got[i] for i in range(180, 184)] == ["block", "allow", "allow", "block"]
    # without rejected urls there is no cut
    assert {r.verdict for r in judge_urls(more.filter("page_id < 120 or page_id >= 180")).collect()} == {"allow"}
    # repeated rows and a very long url
    long = spark.createDataFrame([(1, "http://a.org/" + "x/" * 20_000), (1, "http://a.org/" + "x/" * 20_000), (2, None)], "page_id long, url string")
    assert sorted(r.verdict for r in judge_urls(long).collect()) == ["allow"] * 3


def every(spark, docs):
    bench = spark.createDataFrame([(1, "some text here"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, label int")
    return {
        "substrings": lambda: repeated_substrings(docs),
        "contamination": lambda: contamination(docs, bench),
        "contamination_join": lambda: contamination(docs, bench, small=0),
        "near": lambda: near_duplicates(docs),
        "rules": lambda: judge(docs),
        "mix": lambda: mix(docs),
        "shard": lambda: shard(spark, docs),
        "lm": lambda: lm_scoring.score(docs, docs),
        "quality": lambda: quality(docs, labels),
        "toxicity": lambda: toxicity(docs, labels.withColumnRenamed("label", "toxic")),
    }


def test_empty_tables(spark, none):
    for name, f in every(spark, none).items():
        assert f().collect() == [], name


def test_nulls_and_repeats(spark, nulls):
    for name, f in every(spark, nulls).items():
        got = f().collect()
        assert len(got) == 8, name
        if name == "shard":
            assert Counter(r.shard for r in got) == Counter(range(8))
        elif name != "mix":
            assert sum(n for n in Counter(map(str, got)).values() if n % 2 == 0) == 8, name


def test_empty_training_and_benchmark(spark, docs, none):
    got = by_id(contamination(docs, spark.createDataFrame([], "item_id long, text string")))
    assert not any(r.n_hit or r.contaminated for r in got.values())
    scored = lm_scoring.score(docs, none).collect()
    assert all(r.score == pytest.approx(0) and r.base_score == 0 and r.n_known == 0 for r in scored)


@pytest.fixture(scope="module")
def long_texts():
    """A text beyond the piece that is read at once, part of it in another, and a short one."""
    rng = random.Random(9)
    words = [f"{rng.randrange(10**9):09d}{'x' * rng.randrange(20, 45)}" for _ in range(70_000)]
    text = " ".join(words)
    assert len(text) > PIECE
    return [(0, text), (1, " ".join(words[30_000:30_100]) + " and more words"), (2, "short text")]


def test_very_long_texts(spark, long_texts):
    """Whole texts count, piece by piece or not."""
    docs = spark.createDataFrame([(i, t, "s") for i, t in long_texts], "doc_id long, text string, source string")
    texts = [t for _, t in long_texts]
    got = by_id(judge(docs))
    assert [got[i].n_words for i in range(3)] == [len(t.split()) for t in texts] and got[0].n_repeat_words == 0
    got = by_id(repeated_substrings(docs))
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(3)] == brute.repeats(texts)
    items = [(1, " ".join(texts[0].split()[69_000:69_020]))]
    got = by_id(contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in (got[i] for i in range(3))] == brute.contamination(texts, items)
    got = by_id(near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute.near(long_texts, 5)
    got = by_id(lm_scoring.score(docs, docs, sweeps=2, burn_in=0))
    assert [got[i].n_tokens for i in range(3)] == [len(t.split()) + 1 for t in texts] and all(r.n_known == r.n_tokens for r in got.values())
    assert {r.size for r in mix(docs).collect()} == {len(t.split()) for t in texts}
    assert {r.size for r in shard(spark, docs).collect()} == {len(t) + 1 for t in texts}
    whole = features(pa.array(texts))
    assert np.expm1(whole[:, 1]) == pytest.approx([len(t.split()) for t in texts])
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, label int")
    assert quality(docs, labels).count() == 3 and toxicity(docs, labels.withColumnRenamed("label", "toxic")).count() == 3


def test_ties(spark):
    """Equal keys, equal texts, equal hashes and bounds that are just met."""
    w = [f"w{i}" for i in range(40)]
    same = spark.createDataFrame([(1, " ".join(w), "a")] * 4 + [(2, " ".join(w), "a")], "doc_id long, text string, source string")
    rows = mix(same).collect()
    assert sum(r.taken for r in rows) == 60 * 5 - 60 * 5 % 40 or abs(sum(r.taken for r in rows) - rows[0].target) <= 20
    assert sorted(r.slot for r in shard(spark, same, shards=1).collect()) == [0, 1, 2, 3, 4]
    assert {(r.component_id, r.n_shingles) for r in near_duplicates(same).collect()} == {(1, 36)}
    assert {r.n_removed for r in repeated_substrings(same).collect()} == {40}
    assert len({r.score for r in lm_scoring.score(same, same, sweeps=2, burn_in=0).collect()}) == 1
    # a document of which exactly a twentieth is hit, and a similarity of exactly 0.8
    bench = spark.createDataFrame([(1, "w0 w1")], "item_id long, text string")
    assert by_id(contamination(same, bench))[1].contaminated and not by_id(contamination(spark.createDataFrame([(3, " ".join(w) + " x")], "doc_id long, text string"), bench))[3].contaminated
    near = [(1, " ".join(f"a{i}" for i in range(10))), (2, " ".join([*(f"a{i}" for i in range(9)), "b"])), (3, " ".join([*(f"a{i}" for i in range(8)), "c", "d"]))]
    got = near_duplicates(spark.createDataFrame(near, "doc_id long, text string"), k=2)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(got).items()} == brute.near(near, 2)
    # a feature that equals its bound passes
    row = " ".join(["the"] + ["ab"] * 9 + ["cdef"] * 10 + ["##"])
    assert by_id(judge(spark.createDataFrame([(1, row)], "doc_id long, text string"), (Rule("symbol_ratio", None, 2 / 21),)))[1].broken == []


@pytest.mark.parametrize("hubs", [[(0, 1, 2, 3), (4, 5, 6, 7)], [(0, 1), (2, 3), (4, 5), (6, 7)], [(0, 1, 2), (2, 3), (4, 5, 6), (6, 7), (0, 3), (4, 7)]])
def test_label_propagation_against_every_assignment(spark, hubs):
    """Edges that are cut, against the least that any assignment within the quotas cuts: reached by groups that share nothing, as copies do."""
    from itertools import combinations

    links = spark.createDataFrame([(i, f"h{j}") for j, h in enumerate(hubs) for i in h], "unit long, hub string")

    def cut_by(label):
        return sum(label[a] != label[b] for h in hubs for a, b in combinations(h, 2))

    best = min(cut_by({i: int(i in left) for i in range(8)}) for n in (3, 4, 5) for left in combinations(range(8), n))
    for left in ((1, 3, 5, 7), (0, 1, 4, 6)):
        start = {i: int(i in left) for i in range(8)}
        units = spark.createDataFrame([(i, 1, n) for i, n in start.items()], "unit long, weight long, label int")
        got = {r.unit: r.label for r in sharding.propagate(spark, units, links, np.array([5, 5]), 8).collect()}
        assert max(Counter(got.values()).values()) <= 5
        assert best <= cut_by(got) <= cut_by(start)
    if len(hubs) == 2:  # with room for either group, none is cut
        got = {r.unit: r.label for r in sharding.propagate(spark, units, links, np.array([8, 8]), 8).collect()}
        assert cut_by(got) == 0


def test_sketch_misses_no_pair(spark):
    """Families around the threshold: all links of brute force, none else, with more rounds and without."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        v = list(base)
        for _ in range(rng.randint(2, 9)):
            v[rng.randrange(80)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(v)))
    want = brute.near(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 3):
        assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(near_duplicates(docs, k=2, rounds=rounds)).items()} == want
