"""Which classes meet: low bits of few shingles tell unrelated sets apart, and keep linked ones."""

import numpy as np
from pyspark.sql import functions as F

from fitgrain.llm import hyperminhash as h


def banded(spark, sets):
    rows = [(1, rep, len(s), 0, rep, [int(x) for x in h.low_bits(h.sketch(np.unique(s)))]) for rep, s in enumerate(sets)]
    return spark.createDataFrame(rows, "band long, rep long, n long, weight long, root long, bits array<long>")


def test_small_sets(spark):
    draw = np.random.default_rng(5)
    fresh = lambda n: draw.integers(0, 2**63, n).astype(np.uint64)
    sets = []
    for n in (20, 50, 125, 400):
        own = fresh(n)
        few = n // 9  # as many that each has alone: 0.8 of the union is shared
        sets += [own, np.concatenate([own[few:], fresh(few)]), fresh(n)]
    rows = banded(spark, sets)
    small = rows.select("band").distinct()
    met = {(r["a"], r["b"]) for r in h._in_small_bands(rows, small).collect()}
    assert met == {(0, 1), (3, 4), (6, 7), (9, 10)}
    pivots = h._by_pivots(rows.where(F.col("rep") < 3), 0).collect()
    assert {(r["a"], r["b"]) for r in pivots} == {(0, 1)}


def test_group_in_several_parts_compares_few_of_its_pairs(documents, monkeypatch):
    """Texts that each resemble only those next to them are one group in many parts; most pairs need no comparison."""
    words = [f"w{i}" for i in np.random.default_rng(5).permutation(700)]
    rows = [(i, " ".join(words[i : i + 200])) for i in range(300)]
    compared, verified = [], h.verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(h, "verified", counted)
    found = h.near_duplicates(documents(rows)).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(compared) < 10 * len(rows), compared
