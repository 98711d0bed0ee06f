"""HyperMinHash near-dedup, spelling variants and periodic runs, against brute force."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from fitgrain.llm import hyperminhash as hm
from fitgrain.llm import periods, spelling
from fitgrain.llm.catalog import QUERIES
from fitgrain.session import written

UPPER = {k: k + 32 for k in range(65, 91)}
SPACES = re.compile("[\x20\x09-\x0d]+")


def split(text):
    return [w for w in SPACES.split(text or "") if w]


def rows_of(spark, sf_dir, name="documents"):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select("doc_id", "text").collect()]


def shingles(text, size=4):
    words = split((text or "").translate(UPPER))
    return frozenset(tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))) if words else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    up[top(x)] = top(y)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(k)] = min(doc_id, least.get(top(k), doc_id))
    return sorted(((d, len(sets[k]), least.get(top(k))) for k, (d, _) in enumerate(rows)), key=str)


def found_components(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def test_hyperminhash_on_documents(spark, sf_dir):
    assert found_components(QUERIES["op11_hyperminhash"](spark, sf_dir)) == brute_components(rows_of(spark, sf_dir))


def near_rows():
    """Chains of near copies at and around the limit, large groups, short texts, and a passage that many share."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    passage = [draw.choice(words) for _ in range(60)]
    rows = []
    for base in range(12):
        text = [draw.choice(words) for _ in range(draw.choice([4, 6, 9, 30, 120, 600]))]
        for _ in range(draw.choice([2, 6, 40])):
            rows.append(list(text))
            for _ in range(max(1, len(text) * draw.choice([1, 2, 3, 4]) // 100)):
                text[draw.randrange(len(text))] = draw.choice(words)
    rows += [passage + [draw.choice(words) for _ in range(draw.choice([3, 10, 40, 100]))] for _ in range(60)]
    return [(k, " ".join(w).upper() if k % 3 else "\n ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("few, rounds", ((hm.FEW, hm.ROUNDS), (1, 0), (1, 2)))
def test_hyperminhash_links(documents, monkeypatch, few, rounds):
    """Whether pairs are found by pivots, in small bands or by rare shingles."""
    monkeypatch.setattr(hm, "FEW", few)
    monkeypatch.setattr(hm, "ROUNDS", rounds)
    rows = near_rows()
    want = brute_components(rows)
    assert found_components(hm.near_duplicates(documents(rows))) == want
    assert 50 < len({c for _, _, c in want}) < len(rows) - 30


def test_hyperminhash_odd_rows(documents, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(None, "only one without id here"), (None, "one of two texts alike"), (9, "One of two texts alike"), (10, "a b"), (11, "A\tb")]
    assert found_components(hm.near_duplicates(documents(rows))) == brute_components(rows)
    assert hm.near_duplicates(empty).count() == 0


def test_hyperminhash_moves_compared_sets_once(spark, documents, monkeypatch):
    """The sets and sketches that each round compares are dealt by class when they are written; a round moves only its pairs."""
    plans = []

    def kept_plan(df, label):
        if label in ("likely-pairs", "links"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(hm, "written", kept_plan)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        draw = random.Random(3)
        rows = [(k, " ".join(f"w{draw.randrange(30)}" for _ in range(60))) for k in range(20)]
        rows += [(k + 20, f"{text} more") for k, text in rows] + rows[:3]
        assert found_components(hm.near_duplicates(documents(rows))) == brute_components(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) >= 2
    assert all(len(re.findall(r"Bucketed: true", plan)) == 2 for plan in plans)


def test_registers_hold_zeros_and_mantissa():
    draw = np.random.default_rng(1)
    hashes = np.unique(draw.integers(0, (1 << 64) - 1, 5000, np.uint64))
    bucket = (hashes >> np.uint64(32)) * np.uint64(288) >> np.uint64(32)
    value = hm._mixed(hashes * hm._K1 + np.uint64(1)) >> np.uint64(12)
    for k, register in enumerate(hm.sketch(hashes)):
        bits = f"{int(value[bucket == k].min()):052b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert register == zeros << 10 | int(bits[zeros + 1 : zeros + 11].ljust(10, "0"), 2)
    assert (hm.sketch(hashes[:0]) == hm.EMPTY).all()


def test_estimate_is_corrected():
    """Disjoint sets look unlike, whatever their sizes; a known likeness is met within its error."""
    draw = np.random.default_rng(2)
    for n, m, both in ((20_000, 20_000, 0), (400_000, 300_000, 0), (5000, 5000, 4500), (1000, 900, 850)):
        pool = np.unique(draw.integers(0, (1 << 64) - 1, n + m, np.uint64))
        draw.shuffle(pool)
        a, b = (hm.sketch(np.sort(x))[None] for x in (pool[:n], pool[n - both : n - both + m]))
        found, error = hm.estimate(a, b, np.array([n]), np.array([m]))
        assert abs(found[0] - both / (n + m - both)) < 4 * error[0]


def slipped(doc_id, run):
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if doc_id is None or h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]


def brute_variants(rows, min_count=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            n[slipped(doc_id, run.translate(UPPER))] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= min_count}
    without = {}
    for w in n:
        for k in range(len(w)):
            without.setdefault(w[:k] + w[k + 1 :], set()).add((w, k))
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            near[w] |= {x for x, at in without[less] if x != w and at == k}
            if less in n:
                near[w].add(less)
                near[less].add(w)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def found_variants(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_variants_on_documents(spark, sf_dir):
    assert found_variants(QUERIES["op12_spelling_variants"](spark, sf_dir)) == brute_variants(rows_of(spark, sf_dir))


def test_variants(documents, odd, empty):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abÿé") for _ in range(draw.choice([5, 6, 7, 8, 13]))) for _ in range(40)]
    rows = []
    for k in range(150):
        words = []
        for _ in range(60):
            w = list(draw.choice(stems[: 1 + draw.randrange(40)]))
            for _ in range(draw.choice([0, 0, 0, 1, 2])):
                at = draw.randrange(len(w) + 1)
                w[at : at + draw.randrange(2)] = draw.choice(["", "a", "B", "É"])
            words.append("".join(w))
        rows.append((k if k % 5 else None, draw.choice([" ", "1", "_\n"]).join(words)))
    rows += [(900, "x" * 2000 + " "), (900, "x" * 2000)] * 3 + [(901, "x" * 1999)] * 30 + [(902, None), (903, "")]
    rows += [(None, "chained " * 130 + "chainef " * 26 + "chaimef " * 5)]
    want = brute_variants(rows)
    assert found_variants(spelling.spelling_variants(documents(rows))) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f and r != f for _, f, r, *_ in want)
    assert found_variants(spelling.spelling_variants(odd)) == []
    assert spelling.spelling_variants(empty).count() == 0


def brute_runs(words, min_length=24, min_periods=3):
    found = {}
    for p in range(1, len(words) // min_periods + 1):
        i = p
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(min_length, min_periods * p):
                found.setdefault((i - p, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    digests = (sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), sha256(" ".join(kept).encode()).hexdigest())
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *digests)


def test_runs_on_documents(spark, sf_dir):
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    want = [brute_row(*r) for r in rows_of(spark, sf_dir)]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] for r in want) > 5


def test_runs_of_odd_rows(documents, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 9000] + [(None, "a b " * 30), (30, "a b " * 30), (31, "x " * 23), (32, "x " * 24), (33, "Y\x0b" * 25 + "é é " * 25)]
    got = [tuple(r) for r in periods.periodic_runs(documents(rows), change=periods.planted).collect()]
    assert sorted(got, key=str) == sorted([brute_row(*r) for r in rows], key=str)
    long = {r["doc_id"]: r for r in periods.periodic_runs(odd).collect()}
    assert (long[6]["n_runs"], long[6]["length"], long[6]["period"], long[6]["exponent_milli"]) == (1, 60_000, 1, 60_000_000)
    assert periods.periodic_runs(empty).count() == 0


@pytest.mark.parametrize("step", (1, 7, 10_000))
def test_runs_caught_online(step):
    """Whatever is appended at once, the runs are those of the whole text."""
    for seed in range(150):
        draw = random.Random(seed)
        words = [draw.randrange(draw.choice([2, 3, 50])) for _ in range(draw.choice([30, 100, 300]))]
        for _ in range(draw.randrange(4)):
            a = draw.randrange(len(words))
            p = 1 + draw.randrange(max(1, min(len(words) - a, 40)))
            for i in range(a, a + draw.randrange(len(words) - a + 1)):
                words[i] = words[a + (i - a) % p]
        least, times = draw.choice([(24, 3), (2, 2), (7, 4), (1, 3)])
        catcher = periods.RunCatcher(least, times)
        for k in range(0, len(words), step):
            catcher.append(np.array(words[k : k + step]))
        assert catcher.runs() == brute_runs(words, least, times)
