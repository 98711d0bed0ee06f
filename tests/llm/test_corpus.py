"""Operators that compare documents, against brute force, and the pipeline."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, differences

from fitgrain.llm import bpe, decontam, langid, lines, simhash, suffix
from fitgrain.llm.catalog import ORACLES, QUERIES, RANK_FILE
from fitgrain.llm.components import components

WORDS = [f"w{k}" for k in range(400)]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prose(seed, n):
    draw = random.Random(seed)
    return [draw.choice(WORDS) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir).toArrow(), connect(sf_dir).sql(ORACLES[name]).to_arrow_table()) is None


def test_lines(documents, odd, empty, monkeypatch):
    shared = "A shared line, long enough"
    docs = documents([(3, f"{shared}\nown three\n  {shared.upper()} "), (1, f"x\n{shared}\n{shared}"), (2, f"{shared}\n\nshort"), (2, f"{shared}\n\nshort"), (None, shared), (9, shared), *((k, f"line {k} here\n" * 70 + shared) for k in range(20, 24))])
    for least in (lines.HOT_LINES, 1):
        monkeypatch.setattr(lines, "HOT_LINES", least)
        marked = lines.apply_bitmaps(docs, lines.line_bitmaps(docs))
        assert set(docs.columns) < set(marked.columns)
        got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in marked.collect())
        assert got == [
            (0, 1, 0, shared), (1, 3, 0, f"x\n{shared}\n{shared}"), (2, 3, 1, "\nshort"), (2, 3, 1, "\nshort"), (3, 3, 2, "own three"), (9, 1, 1, ""),
            *((k, 71, 1, "\n".join([f"line {k} here"] * 70)) for k in range(20, 24)),
        ]
    assert lines.apply_bitmaps(odd, lines.line_bitmaps(odd)).where("n_dropped > 0").count() == 0
    assert lines.line_bitmaps(empty).count() == 0


def test_seeds_lose_no_overlap():
    for first in range(decontam.STEP):
        for different in itertools.combinations(range(decontam.OVERLAP), decontam.DIFFERENT):
            places = range(first, decontam.OVERLAP, decontam.STEP)
            assert any(all(p + o < decontam.OVERLAP and p + o not in different for o in seed) for p in places for seed in decontam.SEEDS)


def test_contamination(spark, documents, odd, empty, monkeypatch):
    items = [(k, prose(k, n)) for k, n in enumerate((40, 13, 12, 8, 7, 20, 0))] + [(None, prose(77, 20))]
    docs = []
    for k in range(60):
        text = prose(100 + k, 200)
        item = items[k % 6][1]
        part = list(item[: 13 + k % 9] if len(item) > 12 else item)
        for place in random.Random(k).sample(range(len(part)), min(k % 4, len(part))):
            part[place] = f"changed{k}"
        text[k : k + len(part)] = part
        docs.append((k, " ".join(text).upper() if k % 2 else "\n".join(text)))
    want = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        words, width = text.lower().split(), min(len(item), 13)
        if width >= decontam.MIN_ITEM:
            for a, b in itertools.product(range(len(words) - width + 1), range(len(item) - width + 1)):
                if sum(x != y for x, y in zip(words[a : a + width], item[b : b + width])) <= (2 if width == 13 else 0):
                    want.add((d, i))
    tests = spark.createDataFrame([(i, " ".join(t), "x") for i, t in items] + [(9, None, "x"), (0, " ".join(items[0][1]), "x")], "item_id long, text string, at string")
    for bound in (decontam.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", bound)
        got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(docs), tests).collect()]
        assert sorted(got) == sorted(want) and len(want) > 20
    assert decontam.contaminated(odd, tests).count() == 0 and decontam.contaminated(empty, tests).count() == 0
    assert decontam.contaminated(documents(docs), tests.where("false")).count() == 0


def test_contamination_by_short_items(spark, documents):
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(1, 8)]
    tests = spark.createDataFrame(items + [(0, " \n")], "item_id long, text string")
    docs = [(n, f"{' '.join(prose(n, 70))} {text.upper()} end") for n, text in items]
    docs += [(10 + n, text.replace(f"x{n - 1}", "changed")) for n, text in items] + [(20, items[6][1])]
    got = sorted((r["doc_id"], r["item_id"], r["first_token"]) for r in decontam.contaminated(documents(docs), tests).collect())
    assert got == [(n, n, 70) for n, _ in items] + [(20, 7, 0)]


@pytest.mark.parametrize("doc_id", (None, 5))
def test_contamination_of_rows_with_one_id(spark, documents, doc_id):
    """A row that only shares a seed with the item stands at the same place as one that holds it."""
    item = prose(1, 13)
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    near = [(doc_id, " ".join([w if k - at in decontam.SEEDS[0] else f"x{k}" for k, w in enumerate(item)] + [f"y{n}"])) for at in range(0, 6, decontam.STEP) for n in range(9)]
    for rows in (near + [(doc_id, " ".join(item))], [(doc_id, " ".join(item))] + near):
        assert [(r["doc_id"], r["item_id"], r["n_overlaps"]) for r in decontam.contaminated(documents(rows), tests).collect()] == [(doc_id, 1, 1)]


def brute_spans(docs):
    seen = Counter(t[k : k + suffix.WIDTH] for _, t in docs for k in range(len(t) - suffix.WIDTH + 1))
    out = []
    for doc_id, t in docs:
        marks = bytearray(len(t))
        for k in range(len(t) - suffix.WIDTH + 1):
            if seen[t[k : k + suffix.WIDTH]] > 1:
                marks[k : k + suffix.WIDTH] = b"\1" * suffix.WIDTH
        kept = bytes(b for b, m in zip(t, marks) if not m)
        out.append((doc_id, len(t), len(t) - len(kept), len(bytes(marks).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", (suffix.GROUP, 1))
def test_suffixes(documents, empty, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    passage = " ".join(prose(1, 70)) + "é"
    docs = [(k, " ".join(prose(50 + k, k * 7)) + passage[k : 230 + k * 3] + " ".join(prose(90 + k, 40))) for k in range(12)]
    docs += [(20, "ab" * 300), (21, "z" * 199), (22, "y" * 200), (23, "y" * 201), (24, passage * 2), (25, None), (26, ""), (27, "q" * 3000), (28, docs[3][1]), (29, "short")]
    got = sorted(map(tuple, suffix.cut_digests(documents(docs)).collect()))
    assert got == brute_spans([(d, (t or "").encode()) for d, t in docs])
    if group == 1:
        assert suffix.cut_digests(empty).count() == 0
        spans = {r["doc_id"]: r["spans"] for r in suffix.repeated_spans(documents([(1, "k" * 250), (None, "k" * 250), (2, "v" * 9)])).collect()}
        assert spans[None] == [] == spans[2] and [tuple(s) for s in spans[1]] == [(0, 250)]


@pytest.mark.parametrize("group", (2, 5, 20))
def test_suffixes_of_many_contexts(documents, monkeypatch, group):
    """Pairs share a string around a gram that more than GROUP documents hold, and one of each pair is sampled elsewhere soon after it."""
    monkeypatch.setattr(suffix, "GROUP", group)
    draw = random.Random(group)
    pool = "".join(draw.choices("abcdefgh ", k=20_000))
    gram, at, _, _ = suffix.samples(np.frombuffer(pool.encode(), np.uint8))
    least, often = (pool[a : a + suffix.GRAM] for a in at[np.argsort(gram.view(np.uint64))][:2])
    docs = []
    for k in range(24):
        shared = "".join(draw.choices("ijklmnop ", k=120)) + often + "".join(draw.choices("ijklmnop ", k=40 + k)) + least[:28]
        for end in (least[28:], ""):
            docs.append((len(docs), "".join(draw.choices("qrstuvw ", k=90)) + shared + end + "".join(draw.choices("qrstuvw ", k=150))))
    got = sorted(map(tuple, suffix.cut_digests(documents(docs)).collect()))
    assert got == brute_spans([(d, t.encode()) for d, t in docs])


def brute_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, near):
    label = {n: n for n in nodes}
    while True:
        new = {a: min([label[b] for b in nodes if near(a, b)]) for a in nodes}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("bucket", (simhash.BUCKET, 1))
def test_simhash(documents, odd, empty, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    docs = []
    for k in range(40):
        words = prose(k // 8, 120)
        for place in range(k % 8 // 2):
            words[place * 30 + k % 5] = f"new{k}"
        docs.append((100 - k, " ".join(words).title()))
    docs += [(200, None), (201, ""), (202, "one two"), (203, "ONE\ttwo"), (203, "ONE\ttwo"), (None, "one two")]
    fps = {d: brute_fingerprint(t) for d, t in docs if d is not None}
    label = smallest_reachable(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= simhash.DISTANCE)
    least = {}
    for d, fp in fps.items():
        least[label[fp]] = min(d, least.get(label[fp], d))
    got = simhash.near_duplicates(documents(docs)).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got if r["doc_id"] is not None} == fps and len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {d: least[label[fp]] for d, fp in fps.items()}
    assert next(r["component_id"] for r in got if r["doc_id"] is None) == 202
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(odd).count() == odd.count()


def test_allocation_is_least_and_loses_nothing():
    random_ = np.random.default_rng(0)
    costs = [np.cumsum(random_.integers(0, 50, (5, 30)), axis=0).astype(float) for _ in range(4)]
    chosen = simhash.allocate(costs)
    ways = [w for w in itertools.product(range(-1, 4), repeat=4) if sum(w) == 0]
    for row in range(30):
        assert chosen[row].sum() == 0
        assert sum(costs[k][t + 1, row] for k, t in enumerate(chosen[row])) == min(sum(costs[k][t + 1, row] for k, t in enumerate(w)) for w in ways)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (7, 6), (None, 3), (200, 201), (201, 202), (202, 200)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, sf_dir)
        assert (found.columns == docs.columns) == (k < len(corpus_pipeline.STAGES) - 1)
        found = spark.createDataFrame(found.toArrow())
        assert 0.85 * docs.count() < found.count() <= docs.count()
        docs = found
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def plain_pipeline(spark, sf_dir):
    """The five stages in plain Python over ``(doc_id, text)`` pairs without null ids."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_languages(frame)
    docs = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
    docs = [(d, t) for d, t in docs if any(c.isalpha() for c in t) and model.predict(t.encode())[2]]

    key = lambda line: line.encode().translate(LOWER).strip(b" \t\n\x0b\f\r").decode()
    holders = {}
    for d, t in docs:
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    stays = lambda d, line: len(key(line)) < 10 or d == min(holders[key(line)])
    kept = [(d, [line for line in t.split("\n") if stays(d, line)]) for d, t in docs]
    docs = [(d, "\n".join(lines)) for d, lines in kept if lines]

    fps = {d: brute_fingerprint(t) for d, t in docs}
    label = smallest_reachable(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= simhash.DISTANCE)
    first = {}
    for d, fp in fps.items():
        first[label[fp]] = min(d, first.get(label[fp], d))
    docs = [(d, t) for d, t in docs if first[label[fps[d]]] == d]

    words = lambda t: (t or "").encode().translate(LOWER).split()
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    def leaks(text):
        own = words(text)
        for item in items:
            width = min(len(item), 13)
            for a, b in itertools.product(range(len(own) - width + 1), range(len(item) - width + 1)) if width else ():
                if own[a : a + width] == item[b : b + width] or width == 13 and sum(x != y for x, y in zip(own[a : a + width], item[b : b + width])) <= 2:
                    return True
        return False
    docs = [(d, t) for d, t in docs if not leaks(t)]

    with open(public_tokenizers.path(RANK_FILE), "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f), special_tokens={})
    ids = {d: coder.encode_ordinary(t) for d, t in docs}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return sorted((d, len(ids[d]), sha(np.array(ids[d], "<u4").tobytes()), sha(t.encode())) for d, t in docs)


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Planted copies, shared lines, passages of the benchmark and mixed-up texts among the given documents."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 90 AND n_chars < 3000")
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(6)
    some = [r["text"] for r in docs.orderBy("doc_id").limit(12).collect()]
    item = tests.first()["text"].split()
    planted = [some[0], some[1] + " more", some[2].upper(), "x " + " ".join(item[:14]) + " y " + some[3], "12 34", langid.mixed_up(" ".join(some[4:8]).encode(), 1).decode("latin-1").lower()]
    planted += [f"A line that two documents share\n{some[8 + k]}" for k in range(2)]
    rows = spark.createDataFrame([(1000 + k, t, "en", "planted", len(t)) for k, t in enumerate(planted)], docs.schema)
    docs.unionByName(rows).write.parquet(f"{tmp_path}/documents.parquet")
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_pipeline(spark, str(tmp_path))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    left = {d for d, *_ in want}
    assert not left & {1003, 1004} and len(left) > 40


def test_pipeline_stages_keep_odd_rows(spark, sf_dir):
    rows = [(1, "the first of the words here", "en", None, None), (None, None, None, None, None), (2, "the first of the words here", "en", "s", 3), (2, "the first of the words here", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = [stage(spark, docs, sf_dir).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [3, 2, 2, 4, 4]


@pytest.mark.parametrize("other", (None, 2))
def test_pipeline_stages_judge_row_by_row(spark, sf_dir, other):
    """Rows without an id, or with the same one, have opposite verdicts."""
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text IS NOT NULL").orderBy(F.desc(F.length("text"))).first()["text"]
    one, two = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    cases = {
        "language_id": ([(other, "the first of the words here"), (other, "12 34")], [(other, "the first of the words here")]),
        "simhash_near_dedup": ([(1, one), (other, one), (other, two)], [(1, one), (other, two)]),
        "decontamination": ([(other, passage), (other, one)], [(other, one)]),
    }
    stages = dict(corpus_pipeline.STAGES)
    for name, (rows, want) in cases.items():
        docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, docs, sf_dir).collect()), key=repr) == sorted(want, key=repr), name
