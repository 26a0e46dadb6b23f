"""Operators for training data against brute force, exact round trips and edge cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from sievewright.llm import components, formatting, leaks, mixing, packed, queries, samples, similar, splitting, tokenizing, toxicity
from sievewright.llm.banded import indel_distances
from sievewright.llm.words import elements, words

WORD = re.compile("[a-z0-9]+")
SAMPLE = "sample_id string, repository string, task_text string, patch_texts array<string>, source_dataset string, resolved int, lo string, kind string"


def bag(text):
    c = collections.Counter(WORD.findall((text or "").lower()))
    return {(w, k) for w, n in c.items() for k in range(n)}


def brute(rows, t):
    out = set()
    for kind in ("task", "patch"):
        flat = [(r[0], bag(x)) for r in rows for x in ([r[2]] if kind == "task" else (r[3] or [])) if r[0] is not None]
        flat = [(i, b) for i, b in flat if b]
        for k, (i, a) in enumerate(flat):
            for j, b in flat[k + 1 :]:
                if i != j and 2 * len(a & b) >= t * (len(a) + len(b)) - 1e-9:
                    out.add((kind, min(i, j), max(i, j)))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(400)]
    base = [[rng.choice(names[: rng.choice([8, 60, 400])]) for _ in range(rng.choice([1, 2, 3, 8, 30, 90]))] for _ in range(n // 4)]
    rows = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(t) // 6))):
            how = rng.random()
            if how < 0.4:
                t[rng.randrange(len(t))] = rng.choice(names)
            elif how < 0.7:
                t.insert(rng.randrange(len(t) + 1), rng.choice(names))
            else:
                rng.shuffle(t)
        p = [" ".join(rng.choice(base)) for _ in range(rng.randint(0, 2))]
        rows.append((f"s{k:03}", "a/b", ", ".join(t).upper(), [*p, None, ""], None, 1, "clash", "clash"))
    rows += [rows[0], ("e1", "a/b", None, None, None, None, None, None), ("e2", "a/b", " .,;\n", [], None, None, None, None), (None, "a/b", rows[1][2], None, None, 0, None, None)]
    rows += [(f"c{k:02}", "a/b", "exactly the same words again", None, None, 0, None, None) for k in range(40)]  # a group of copies
    rows += [("long1", "a/b", "x y z " * 3000, None, None, 0, None, None), ("long2", "a/b", "x y z " * 2900 + "q", None, None, 0, None, None)]
    return rows


def test_words_are_those_of_the_definition():
    texts = ["Ab-9_c", None, "", "Kelvin İx", "é1e", "a" * 10000 + " b", "x\x00y", "中文abc"]
    h, o = words(pa.array(texts))
    assert np.diff(o).tolist() == [len(WORD.findall((x or "").lower())) for x in texts]
    h2, _ = words(pa.array(["c 9 ab"]))
    assert h[:3].tolist() == h2[[2, 1, 0]].tolist()
    e = elements(*words(pa.array(["a a b", "a"])))
    assert len(set(e[:3].tolist())) == 3 and e[3] in e[:2]
    assert len(words(pa.array([], pa.string()))[0]) == 0


def test_embedding_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (rng.integers(0, 2**63, 300).astype(np.uint64) for _ in "ab")
        b[:200] = a[:200]
        v = packed.embed(np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
        assert packed.distance(v[:1], v[1:])[0] <= 200


@pytest.mark.parametrize("hot", [4, 30, 10**9])
def test_similar_pairs_equal_brute_force(spark, hot):
    rows = corpus(hot)
    df = spark.createDataFrame(rows, SAMPLE)
    found = similar.find(similar.sample_texts(df), 0.8, hot=hot)
    got = {(r.kind, r.a, r.b) for r in similar.record_pairs(found).collect()}
    assert got == brute(rows, 0.8)


def test_long_texts_of_frequent_words_enter_few_cells(spark):
    rng = np.random.default_rng(5)
    names = [f"w{k}" for k in range(900)]
    base = [[names[k] for k in rng.integers(0, 900, n)] for n in (1200, 900, 600, 300, 40, 12)]
    rows = []
    for k in range(90):
        t = list(base[k % len(base)])
        for _ in range(int(len(t) * rng.choice([0.02, 0.1, 0.25]))):
            t[rng.integers(len(t))] = names[rng.integers(900)]
        rows.append((f"s{k:02}", None, " ".join(t), None, None, None, None, None))
    found = similar.find(similar.sample_texts(spark.createDataFrame(rows, SAMPLE)), 0.8, hot=3)  # every word is hot
    assert {(r.kind, r.a, r.b) for r in similar.record_pairs(found).collect()} == brute(rows, 0.8)
    h, o = words(pa.array([r[2] for r in rows]))
    e = elements(h, o)
    counts = packed.segment_counts(e)
    for hot in (3, 30, 10**9):
        _, row, _ = packed.cells(e, o, counts, packed.classes(counts), 0.8, hot)
        assert (np.bincount(row, minlength=len(rows)) <= np.diff(o)).all()


def test_texts_of_the_same_frequent_words_are_refuted_by_what_rare_ones_use_up():
    rng = np.random.default_rng(8)
    base, texts = [f"w{k}" for k in range(104)], []
    for k in range(120):  # 104 frequent words and 26 of their own: as many as may differ, so alike only if all frequent ones are the same
        t = list(base)
        for at in rng.choice(104, 3 * (k % 4 > 0), replace=False):
            t[at] = f"v{rng.integers(60)}"
        texts.append(" ".join(t + [f"own{k}x{i}" for i in range(26)]))
    e, o = (lambda h, o: (elements(h, o), o))(*words(pa.array(texts)))
    counts, m = packed.segment_counts(e), np.diff(o)
    klass, rows = packed.classes(counts), np.repeat(np.arange(len(m)), m)
    alike = {(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(e[o[i] : o[i + 1]], e[o[j] : o[j + 1]])) >= 104}
    assert len(alike) >= 30 * 29 / 2
    for hot in (20, 50):
        frequent = packed.is_frequent(e, klass, packed.halves(counts, klass, hot))
        x = np.zeros(len(m), packed.TEXT)
        x["id"], x["m"], x["role"], x["v"] = np.arange(len(m)), m, 3, packed.embed(e, rows, len(m), frequent)
        x["rare"] = np.bincount(rows[~frequent], minlength=len(m))
        key, text, place = packed.cells(e, o, counts, klass, 0.8, hot)
        order = np.lexsort((text, key >> np.uint64(24)))
        got = packed.pairs(x, key[order] >> np.uint64(24), text[order], place[order], 0.8, False)
        met = {(max(i, j), min(i, j)) for a, b in got for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert alike <= met and len(met) <= 1.1 * len(alike)


@pytest.mark.parametrize("role_ids", [0, similar.ROLE_IDS])
def test_crossing_pairs_and_empty_tables(spark, role_ids):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SAMPLE)
    held = {r[0] for r in rows if r[0] and hash(r[0][-1]) % 2}
    found = similar.find(similar.sample_texts(df), 0.7, spark.createDataFrame([(x,) for x in held], "x string"), 20, role_ids)
    got = {(r.kind, r.a, r.b) for r in similar.record_pairs(found).collect()}
    assert {g for g in got if (g[1] in held) != (g[2] in held)} == {g for g in brute(rows, 0.7) if (g[1] in held) != (g[2] in held)}
    empty = similar.find(similar.sample_texts(df.limit(0)))
    assert similar.record_pairs(empty).count() == 0 and empty.links.count() == 0
    with pytest.raises(ValueError):
        similar.find(similar.sample_texts(df), 0.0)


def test_banded_distance():
    rng = np.random.default_rng(0)
    a, b = ([np.sort(rng.choice(50, rng.integers(0, 30), replace=False)).astype(np.uint64) for _ in range(300)] for _ in "ab")
    budget = rng.integers(0, 40, 300)
    true = np.array([len(x) + len(y) - 2 * len(np.intersect1d(x, y)) for x, y in zip(a, b, strict=True)])
    assert (indel_distances(a, b, budget) == np.where(true <= budget, true, budget + 1)).all()
    assert len(indel_distances([], [], np.zeros(0, int))) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"v{k}", f"v{k + 1}") for k in range(60) if k % 20] + [("hub", f"h{k}") for k in range(50)] + [("b", "a"), ("b", "a"), ("a", "b"), ("z", "z"), (None, "a"), ("q", None)]
    rng.shuffle(edges)
    got = {r.vertex: r.group for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x and y:
            p, q = sorted((find(x), find(y)))
            parent[q] = p
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies(spark):
    rng = random.Random(4)
    rows = [(f"s{k:03}", None, rng.choice(["A b", "a-B", "ab!", "AB c", "", None, "?"]), rng.choice([["x", "Y z"], ["y-Z", None, " X"], ["x"], [], None, ["."]]), None, 0, None, None) for k in range(200)]
    rows += [rows[0], (None, None, "ab", ["x"], None, 0, None, None)]
    sets = collections.defaultdict(set)
    for r in rows:
        clean = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
        p = sorted(filter(None, map(clean, r[3] or [])))
        if r[0] and clean(r[2]) and p:
            sets[(clean(r[2]), tuple(p))].add(r[0])
    df = spark.createDataFrame(rows, SAMPLE)
    sizes = {r.first_id: r.n_copies for r in formatting.sets(df).collect()}
    got = {r.sample_id: (r.first_id, sizes[r.first_id]) for r in formatting.members(df).collect()}
    assert {r.sample_id: r.first_id for r in formatting.copies(df).collect()} == {i: f for i, (f, _) in got.items() if i != f}
    assert got == {x: (min(s), len(s)) for s in sets.values() for x in s}
    assert formatting.copies(df.limit(0)).count() == 0


def test_entities_and_splits(spark):
    alias = [("b/x/y", "https://C/x/y.git"), ("c/x/y", "d/x/y"), ("d/x/y", "E/X/y/"), ("b/x/y", "c/x/y"), (None, "a"), ("k/l/m", "k/l/m"), ("", "q")]
    aliases = spark.createDataFrame(alias, "alias string, target string")
    assert {r.name: r.entity for r in samples.entities(aliases).collect()} == {k: "e/x/y" for k in ("b/x/y", "c/x/y", "d/x/y")}
    with pytest.raises(ValueError):
        samples.entities(spark.createDataFrame([("a/b/c", "d/e/f"), ("d/e/f", "a/b/c")], "alias string, target string"))
    rows = [(f"s{k}", ["b/x/y", "git@e:x/y.git", "f/g/h", None][k % 4] if k < 40 else f"h/o/r{k // 3}", None, None, None, k % 3 - 1, None, None) for k in range(300)]
    df = spark.createDataFrame([*rows, rows[0]], SAMPLE)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 1.0), ("none", 0.0)], "split string, share double")
    got = splitting.split_records(df, aliases, targets).collect()
    assert len(got) == 300 and {r.split for r in got} == {"train", "validation", "test"}
    by = collections.defaultdict(set)
    for r in got:
        by[r.entity].add(r.split)
    assert all(len(v) == 1 for k, v in by.items() if k) and {r.entity for r in got if r.name == "b/x/y"} == {"e/x/y"}
    size = collections.Counter(r.split for r in got)
    assert abs(size["train"] - 240) <= 4 and abs(size["test"] - 30) <= 4
    assert splitting.split_records(df.limit(0), aliases, targets).count() == 0


def test_annealing_improves_and_keeps_the_best():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, (200, 2)).astype(float)
    goal = np.outer([0.8, 0.2], w.sum(0))
    start = rng.integers(0, 2, 200)

    def off(a):
        g = goal.copy()
        np.subtract.at(g, a, w)
        return np.abs(g).sum()

    assert off(splitting.anneal(w, start, goal, 3, 6000, np.ones(2))) < min(20, off(start))


@pytest.mark.parametrize("sizes", [[1000], [700, 650], [400] * 4])
def test_large_components_reach_the_targets_in_blocks(spark, monkeypatch, sizes):
    """Entities that hold a good part of all rows don't keep their hashed split where several blocks are annealed."""
    monkeypatch.setattr(splitting, "BLOCK", 128)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = [(f"big{k}", n, n // 2, n // 4) for k, n in enumerate(sizes)] + [(f"c{k}", *[rng.randint(1, 5)] * 2, 0) for k in range(600)]
        df = spark.createDataFrame(rows, "component string, n int, solved int, unsolved int")
        at = {r.component: r.split for r in splitting.assign_components(df, targets, seed).collect()}
        total, got = sum(r[1] for r in rows), collections.Counter()
        for r in rows:
            got[at[r[0]]] += r[1]
        assert len(at) == len(rows) and all(abs(got[s] / total - w) < 0.02 for s, w in (("train", 0.8), ("validation", 0.1), ("test", 0.1))), (seed, got)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"t{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"i{k}", text(rng.choice([5, 15, 20, 60, 60, 60]))) for k in range(30)]
    docs = []
    for k in range(120):
        t = text(40)
        i = rng.choice(items)[1]
        n = rng.choice([12, 19, 20, 21, 35, 35])
        a = rng.randrange(max(1, len(i) - n + 1))
        piece = list(i[a : a + n])
        if k % 5 == 0 and len(piece) == 35:
            piece[17] = "changed"
        docs.append((k, t[:20] + piece + t[20:]))
    rows = [(k, " ".join(t), "extra") for k, t in docs] + [(900, None, ""), (901, "", ""), (902, "one two", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, seed string")
    q = spark.createDataFrame([(i, ",".join(t)) for i, t in items] + [("null", None), ("i0", ",".join(items[0][1]))], "item_id string, text string")

    def grams(t):
        return {tuple(t[k : k + 20]) for k in range(len(t) - 19)}

    want = {(k, i) for k, t in docs for i, u in items if grams(t) & grams(u)}
    got = leaks.leaks(d, q).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.exact_words >= 20} == want
    assert all(r.overlap_words >= 20 and r.equal_words <= r.overlap_words for r in got)
    assert any(r.exact_words < 20 for r in got), "substituted overlaps are reported too"
    assert leaks.leaks(d.limit(0), q).count() == 0 and leaks.leaks(d, q.limit(0)).count() == 0


def test_masks_cover_substitutions():
    from itertools import combinations

    def recall(n, k):
        ways = list(combinations(range(n), k))
        return sum(any(all(not 0 <= p - a < leaks.SPAN or m[p - a] == "0" for p in w) for m in leaks.MASKS for a in range(n - leaks.SPAN + 1)) for w in ways) / len(ways)

    assert [recall(20, k) for k in (0, 1)] == [1, 1] and recall(20, 2) > 0.92
    assert recall(24, 2) > 0.98 and recall(24, 3) > 0.93 and recall(30, 3) == 1


def test_tolerant_leaks_are_whole(spark):
    """Passages with substitutions are found wherever a seed fits, and lengths are not cut off at a reach."""
    rng = random.Random(9)
    fresh = iter(range(10**6))
    docs, items = [], []
    for k in range(60):
        n, wrong = [(20, [13]), (25, [12]), (36, [12, 24]), (400, [100, 300]), (20, [6, 13])][k % 5]
        piece = [f"p{next(fresh)}" for _ in range(n)]
        items.append((f"i{k}", " ".join(piece)))
        pad = [f"d{rng.randrange(10**6)}x" for _ in range(20)]
        docs.append((k, " ".join([*pad, *[f"z{next(fresh)}" if p in wrong else w for p, w in enumerate(piece)], *pad])))
    got = {(r.doc_id, r.item_id): (r.exact_words, r.overlap_words, r.equal_words) for r in leaks.all_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    want = {(k, f"i{k}"): [(13, 20, 19), (12, 25, 24), (12, 36, 34), (199, 400, 398), (6, 20, 18)][k % 5] for k in range(60)}
    assert got == want


def test_tokenizer_equals_the_public_one(spark):
    import tiktoken
    import public_tokenizers

    c = tokenizing.codec(tokenizing.default_path("byte_bpe_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab'sdmtrevl  \n\t\r1.-_\x1c\x00é中😀'", k=rng.randint(0, 20))) for _ in range(3000)] + ["<|endoftext|>", "x" * 5000, " " * 99, "don't we'll", ""]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k long, text string")
    got = {r.k: (r.ids, r.n) for r in df.select("k", tokenizing.token_ids(F.col("text")).alias("ids"), tokenizing.token_count(F.col("text")).alias("n")).collect()}
    for k, x in enumerate(texts):
        assert got[k][0] == public.encode_ordinary(x) and got[k][1] == len(got[k][0]) and c.decode(got[k][0]) == x
    assert got[len(texts)] == ([], 0)


def test_pivotal_keeps_size_and_expectation():
    size = [3, 5, 7, 11, 13, 2, 9] * 30
    total = collections.Counter()
    for seed in range(300):
        p = mixing.pivotal([0.3] * len(size), size, seed, False)
        assert sum(0 < x < 1 for x in p) <= 1 and abs(sum(a * b for a, b in zip(p, size, strict=True)) - 0.3 * sum(size)) < 1e-6
        total.update({k: x for k, x in enumerate(p)})
    assert all(abs(v / 300 - 0.3) < 0.12 for v in total.values())


@pytest.mark.parametrize("block", [1 << 16, 20])
def test_mix_reaches_shares(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(1)
    rows = [(k, "big" if k < 700 else "small" if k < 760 else None, rng.randint(1, 30)) for k in range(800)] + [(900, "big", 0), (901, "other", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    copies = {r.doc_id: (r.source, r.copies) for r in mixed.collect()}
    assert all(1 <= n <= {"big": 1, "small": 3}[s] for s, n in copies.values()) and 900 not in copies and 901 not in copies
    share = {r.source: (r.actual_share, r.wanted_share) for r in mixing.reached(mixed, sizes, targets).collect()}
    assert abs(share["big"][0] - 0.625) < 0.01 and share["absent"] == (0.0, 0.0)
    assert mixing.mix(sizes.limit(0), targets).count() == 0


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    nouns = [f"noun{k}" for k in range(60)]
    fine = ["The {} keeps its {} for a while.", "Please split the {} from the {}.", "Kill the {} process before the {} starts.", "Profiling shows {} in {}."]
    bad = ["You are a worthless idiot and your {} is trash.", "Nobody likes you, get lost with your {}.", "YOU STUPID MORON broke the {} again.", "I hope you rot in hell for this {}."]
    docs, labels = [], []
    for k in range(900):
        lines = [rng.choice(fine).format(rng.choice(nouns), rng.choice(nouns)) for _ in range(8)]
        toxic = k % 8 == 0
        if toxic:
            lines.insert(rng.randrange(8), rng.choice(bad).format(rng.choice(nouns)))
        docs.append((k, "\n".join(lines), "src" if k % 3 else None))
        if k < 500:
            wrong = rng.random() < 0.05
            labels.append((k, ("clean" if wrong else "abusive") if toxic else ("hateful" if wrong and k % 9 == 0 else "clean")))
    docs += [(1000, None, "src"), (1001, "", "src"), (1002, "Y0u are a w0rthless 1diot and your noun3 is tr@sh.", "src"), (1003, "‮中\x00", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    model = toxicity.fit(d, spark.createDataFrame([*labels, (None, "clean"), (5, None)], "doc_id long, label string"))
    flagged = {r.doc_id for r in toxicity.score(d, model).where("toxic").collect()}
    truth = {k for k in range(500, 900) if k % 8 == 0}
    held = {k for k in flagged if 500 <= k < 900}
    assert len(held & truth) >= 0.9 * len(truth) and len(held - truth) <= 4
    assert not flagged & {1000, 1001} and 1002 in flagged
    nothing = toxicity.fit(d, spark.createDataFrame([], "doc_id long, label string"))
    assert toxicity.score(d, nothing).where("toxic").count() == 0 and toxicity.score(d.limit(0), model).count() == 0


def test_toxicity_threshold_is_that_of_all_labels(spark):
    """A word of 30 toxic and 90 of 2,000 clean documents is worth flagging in a balanced sample, but not among all labels."""
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(2070):
        toxic = k < 70
        lines = [f"The noun{rng.randrange(60)} keeps its noun{rng.randrange(60)}." for _ in range(4)]
        if k < 40:
            lines.append("You worthless stupid idiot.")
        elif k < 160:
            lines.append("Zounds.")
        docs.append((k, "\n".join(lines), "src"))
        labels.append((k, "abusive" if toxic else "clean"))
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, label string"), 70)
    flagged = {r.doc_id for r in toxicity.score(d, model).where("toxic").collect()}
    assert set(range(40)) <= flagged and not {k for k in flagged if k >= 70}
    assert abs(model.held_out_f1 - 2 * 40 / (40 + 70)) < 0.02


def test_toxicity_counts_features_in_all_documents(spark):
    rng = random.Random(2)
    rows = [(" ".join(f"w{rng.randrange(50)}" for _ in range(30)) + ". w1", rng.randrange(toxicity.FOLDS), rng.choice([-1, -1, 0, 1])) for _ in range(1500)]
    without, whole = toxicity.spreads(spark.createDataFrame(rows, "text string, fold int, kind int"))
    feature, offsets, at = toxicity.features([r[0] for r in rows])
    owner = np.repeat(at, np.diff(offsets))
    for fold, got in [*enumerate(without), (None, whole)]:
        for n, sign in enumerate((True, False)):
            mine = np.array([(r[2] == 1) == sign and (r[1] != fold or r[2] < 0) for r in rows])
            want = np.zeros(1 << toxicity.BITS, int)
            for f in {(int(o), int(f)) for o, f in zip(owner, feature, strict=True) if mine[o]}:
                want[f[1]] += 1
            assert (got[n] == want).all() and got[n + 2] == mine.sum()


def test_toxicity_fits_on_the_whole_unlabelled_side(spark, monkeypatch):
    """Features are chosen by the counts of all documents and all others are the unlabelled side, however few positives a fit samples."""
    seen = []
    train = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda *a, **k: seen.append(a) or train(*a, **k))
    docs = [(k, f"word{k % 7} is here. " + ("You stupid idiot." if k % 10 == 0 else "All fine."), "s") for k in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, "abusive" if k % 10 == 0 else "clean") for k in range(300)], "doc_id long, label string")
    toxicity.fit(d, labels, 10)
    positive, rows, unlabelled, prior, spread = seen[-1]
    assert spread[2:] == (30, 570) and len(set(rows.tolist())) == 10 and len(positive.weight) == 20
    assert unlabelled[1:] == (1140, 570) and unlabelled[0].weight.sum() >= 30  # the unlabelled toxic ones are there too
    seen.clear()
    size = len(docs[0][1])
    toxicity.fit(d, labels, 10, 4 * size)
    assert len(set(seen[-1][1].tolist())) == 4 and toxicity.POSITIVES == 3000
    assert toxicity.fit(d, labels, 10, size).threshold == np.inf


def test_patterns_count_every_sentence(spark):
    rng = random.Random(3)
    rows = [(". ".join(" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))), rng.randrange(toxicity.FOLDS), rng.choice([-1, 0])) for _ in range(400)]
    feature, offsets, at = toxicity.features([r[0] for r in rows])
    telling, common = np.zeros(1 << toxicity.BITS, bool), np.zeros(1 << toxicity.BITS, bool)
    telling[feature[offsets[5] : offsets[6]]] = True
    common[feature[offsets[9] : offsets[12]]] = True
    got = toxicity.unlabelled_patterns(spark.createDataFrame(rows, "text string, fold int, kind int"), telling, common)
    group = [0 if r[2] < 0 else 1 + r[1] for r in rows]
    assert got.documents.tolist() == [group.count(g) for g in range(4)] and got.sentences.tolist() == np.bincount([group[r] for r in at], minlength=4).tolist()
    split = [np.sort(feature[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    some = [k for k, f in enumerate(split) if telling[f].any()]
    near = np.bincount(np.concatenate([split[k] for k in some]), minlength=1 << toxicity.BITS)
    keep = telling | (common & (near >= 3))
    want = collections.Counter((group[at[k]], tuple(split[k][keep[split[k]]].tolist())) for k in some)
    p = got.patterns
    assert collections.Counter({(int(g), tuple(p.feature[a:b].tolist())): int(n) for g, a, b, n in zip(got.group, p.offsets[:-1], p.offsets[1:], p.weight, strict=True)}) == want
    assert got.without(0)[2] == got.documents.sum() - got.documents[1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    folder, con = duck
    same_rows(queries.queries()[name](spark, folder).toPandas(), con.execute(queries.oracle_sql()[name]).df())
