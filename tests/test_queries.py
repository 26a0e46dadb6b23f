import pytest
from pyspark.sql import functions as F
from conftest import same_rows

from sievewright.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    folder, con = duck
    same_rows(catalog.queries()[name](spark, folder).toPandas(), con.execute(catalog.oracle_sql()[name]).df())


def test_entry_runs():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_needs_no_python_path(duck):
    """In a session of its own, started elsewhere and without a path to the package, as a driver would."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); from pyspark.sql import SparkSession as S; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate(); import __spark_entry__ as e; print('rows', len(e.entry(s).collect()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True, timeout=300)
    assert out.stdout.startswith("rows ") and int(out.stdout.split()[1]) > 0, out.stderr[-2000:]


def test_near_task_pairs_against_brute_force(spark, duck):
    from difflib import SequenceMatcher

    from sievewright.operators import contamination as c
    from sievewright.operators import edits

    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the forest"
    texts = [base, base.replace("quick", "quack"), base.upper(), base + ".", "something else entirely", "", None, "  "]
    rows = [(f"s{k}", f"r{k}", t, [t]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "sample_id string, repository string, task_text string, patch_texts array<string>")
    v = c.content(df).where("kind = 'task'")
    for t in (0.5, 0.9, 0.98):
        got = {frozenset((r.fp_l, r.fp_r)) for r in c.near_pairs(c.near_candidates(v, v, t, True), t).collect()}
        ids = v.select("kind", "text", F.xxhash64("text").alias("id"), "fingerprint")
        name = {r.id: r.fingerprint for r in ids.collect()}
        for by_length in (False, True):  # both kinds of cells
            assert got <= {frozenset((name[r.id_l], name[r.id_r])) for r in edits.candidates(ids, None, t, by_length).collect()}
        have = {r.fingerprint: r.text for r in v.collect()}
        want = {frozenset((a, b)) for a in have for b in have if a < b and max(SequenceMatcher(None, have[a], have[b], False).ratio(), SequenceMatcher(None, have[b], have[a], False).ratio()) >= t}
        assert got == want


def test_near_pairs_of_both_kinds_against_brute_force(spark, tmp_path):
    from difflib import SequenceMatcher
    from hashlib import sha256
    from itertools import combinations

    base = {"task": "the quick brown fox jumps over the lazy dog and runs from the wolf", "patch": "one line is added and another one taken away from the parser of dates"}
    texts = {k: [x, x.replace("one", "two").replace("quick", "quack"), x + "s", "something else entirely"] for k, x in base.items()}
    rows = [(f"s{k}", f"a/r{k}", texts["task"][k], [texts["patch"][k]]) for k in range(4)]
    spark.createDataFrame(rows, "sample_id string, repository string, task_text string, patch_texts array<string>").write.parquet(f"{tmp_path}/samples.parquet")
    hashed = lambda x: sha256(x.encode()).hexdigest()
    want = {
        (k, *sorted((hashed(a), hashed(b))))
        for k, found in texts.items()
        for a, b in combinations(found, 2)
        if max(SequenceMatcher(None, a, b, False).ratio(), SequenceMatcher(None, b, a, False).ratio()) >= 0.95
    }
    got = {(r.kind, r.fp_l, r.fp_r) for r in catalog.queries()["near_task_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and {k for k, _, _ in want} == {"task", "patch"}


@pytest.mark.parametrize("by_length", [False, True])
def test_candidates_hold_every_near_pair(spark, monkeypatch, by_length):
    import random
    from difflib import SequenceMatcher
    from itertools import combinations

    from sievewright.operators import edits

    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh  \n") for _ in range(n)) for n in (3, 8, 40, 41, 120, 400)]
    texts = set()
    for _ in range(70):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(x) // 12))):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
        texts.add("".join(x))
    texts = sorted(texts - {""})
    df = spark.createDataFrame([(k, "task" if k % 9 else "patch", x, "clash") for k, x in enumerate(texts)] + [(900, "task", None, ""), (901, "task", "", "")], "id long, kind string, text string, bucket string")
    near = lambda a, b: max(SequenceMatcher(None, x, y, False).ratio() for x, y in ((a, b), (b, a)))
    for t in (0.8, 0.95):
        want = {(a, b) for a, b in combinations(range(len(texts)), 2) if (a % 9 == 0) == (b % 9 == 0) and near(texts[a], texts[b]) >= t}
        got = [(r.id_l, r.id_r) for r in edits.candidates(df, None, t, by_length).collect()]
        assert want and want <= set(got) and len(got) == len(set(got)) and all(a < b for a, b in got)
        left = df.where("id % 2 = 0")
        cross = {(r.id_l, r.id_r) for r in edits.candidates(left, df.where("id % 2 = 1"), t, by_length).collect()}
        assert {tuple(sorted(p, key=lambda k: k % 2)) for p in want if (p[0] + p[1]) % 2} <= cross
    assert edits.candidates(df.limit(0), None, 0.9, by_length).count() == 0


def test_tiles_let_every_two_texts_meet_once():
    import numpy as np

    from sievewright.operators import edits

    n = np.full(300, 50)
    ids = np.arange(300).astype(np.int64)
    texts = np.zeros((edits.KINDS, edits.BANDS), np.int64)
    salt = np.full(300, 8, np.uint64)
    texts[0, edits.band(n, 0.9)[0]] = 3 * edits.TILE  # as many as three tiles hold
    key, row, at = edits.length_entries(n, ids, salt, texts, 0.9)
    met = {}
    for k in np.unique(key):
        here = np.flatnonzero(key == k)
        for a in here:
            for b in here:
                if row[a] < row[b] and (at[a] < 2 or at[a] // 2 != at[b] // 2) and not at[a] % 2:
                    met[(row[a], row[b])] = met.get((row[a], row[b]), 0) + 1
    assert len(met) == 300 * 299 // 2 and set(met.values()) == {1}


def test_matched_counts_as_sequence_matching():
    import random
    from difflib import SequenceMatcher

    from sievewright.operators import contamination as c

    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcdefghij"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(90)))
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = b[: rng.randint(0, 14)] if rng.random() < 0.3 else rng.choice(letters)
        b = "".join(b)
        for x, y in ((a, b), (b, a)):
            assert c.matched(x, y, c.common_runs(x, y)) == sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())


def test_near_pairs_of_long_texts_take_no_quadratic_time():
    """Sequence matching of these texts takes minutes where every place of every character is tried."""
    import random
    import time

    from sievewright.operators import contamination as c

    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    b = a[:9_000] + "x" + a[9_000:15_000] + a[15_001:]
    began = time.process_time()
    assert c.matched(a, b, c.common_runs(a, b)) == len(a) - 1
    assert time.process_time() - began < 5


def test_histograms_refute_no_pair_within_the_edits():
    import random

    import numpy as np

    from sievewright.operators import edits

    rng = random.Random(11)
    for _ in range(50):
        a = "".join(rng.choice("aab \n") for _ in range(rng.randint(1, 600)))
        b, changes = list(a), rng.randint(0, 30)
        for _ in range(changes):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        h, g = edits.histograms(*edits.characters([a, "".join(b)]))
        most = 2 * changes  # a replacement is two edits
        assert edits.common(h[:1], h[:1]) + edits.common(h[1:], h[1:]) - 2 * edits.common(h[:1], h[1:]) <= most
        assert edits.pairs_differ(g[:1], g[1:]) <= 3 * most
        assert edits.common(h[:1], h[1:])[0] == np.minimum(h[0].astype(int), h[1]).sum()


def test_estimates_of_two_sides_count_pairs_across():
    import numpy as np

    from sievewright.operators import edits

    texts = np.zeros((2, edits.KINDS, edits.BANDS), np.int64)
    texts[0, 0, 9], texts[1, 0, 9] = 10, 100_000
    by_grams, by_bands = edits.estimates(np.full(1000, 300), texts, 0.95, symmetric=False)
    assert by_bands == 2 * 10 * 100_000 and by_grams < edits.estimates(np.full(1000, 300), texts, 0.95)[0]
