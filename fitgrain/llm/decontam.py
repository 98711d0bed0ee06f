"""Benchmark decontamination: spaced seeds of token hashes join test items and documents, overlaps around hits are verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import ascii_lower, texts, words
from fitgrain.session import written

#: Token offsets that a seed compares; the others may differ. Together they are
#: lossless: whichever 2 of 13 aligned tokens differ, one of them fits between
#: at an even offset, and at an odd one. A test goes through all cases.
SEEDS = ((0, 1, 4, 6, 7), (0, 1, 5, 6, 7))
#: Tokens of an overlap, and how many of them may differ.
OVERLAP = 13
DIFFERENT = 2
#: Document positions are probed at this step, test items at each position.
STEP = 2
#: Positions of a document that one row probes.
RUN = 64
#: Items without a token are left out; items between this and OVERLAP tokens match as a whole and exactly.
MIN_ITEM = 1
#: The seeds of the items are broadcast up to this count, else both sides are shuffled.
BROADCAST_SEEDS = 200_000


def tokens(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))))


def seed_hashes(width: int) -> Column:
    """The hashes of the window ``w``: one for each seed."""
    masks = [tuple(range(width))] if width < OVERLAP else SEEDS
    hashes = [f"struct(cast({width * 10 + k} as int) AS seed, xxhash64({width * 10 + k}, {', '.join(f'w[{i}]' for i in mask)}) AS hash)" for k, mask in enumerate(masks)]
    return F.expr(f"array({', '.join(hashes)})")


def seeds(df: DataFrame, key: str, step: int, width: int) -> DataFrame:
    """``(key, at, lead, near, seed, hash)`` of every ``step``-th token that a seed can start at.

    Tokens are first cut into short runs that overlap, so that no row holds a
    long text. ``near`` is the run, ``lead`` the place of the seed in it; the
    run reaches far enough on both sides for any overlap that holds the seed.
    """
    span = span_of(width)
    reach = max(width - span, 0)
    size = RUN + span - 1 + 2 * reach
    run = F.expr(f"CASE WHEN size(t) >= {span} THEN sequence(0, size(t) - {span}, {RUN}) END")
    runs = df.select(key, "t", F.explode_outer(run).alias("start"))
    runs = runs.select(key, "start", F.expr(f"slice(t, greatest(start - {reach}, 0) + 1, {size} - greatest({reach} - start, 0))").alias("near"), F.expr(f"least(start, {reach})").alias("back"))
    at = runs.select(key, "start", "near", "back", F.explode(F.sequence(F.lit(0), F.lit(RUN - 1), F.lit(step))).alias("k"))
    at = at.select(key, "near", (F.col("start") + F.col("k")).alias("at"), (F.col("back") + F.col("k")).alias("lead"), F.expr(f"slice(near, back + k + 1, {span})").alias("w"))
    return at.where(F.size("w") == span).select(key, "at", "lead", "near", F.explode(seed_hashes(width)).alias("s")).select(key, "at", "lead", "near", "s.seed", "s.hash")


def span_of(width: int) -> int:
    return width if width < OVERLAP else 1 + max(max(s) for s in SEEDS)


def contaminated(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, n_overlaps, first_token)`` of each document that holds a passage of an item.

    Tokens are the runs without white space, A-Z lower-cased. A passage is an
    aligned run of 13 tokens of both that differ in 2 places at most. An item of 1 to
    12 tokens must be held whole and unchanged; one without tokens matches nothing.
    ``n_overlaps`` counts the alignments, ``first_token`` is the first token of
    the first seed that led to one. Null and empty texts hold nothing. Rows without an id are
    reported under a null id. Repeated rows and equal items give the same rows
    once for each id pair. Empty tables give no rows.
    """
    docs = texts(documents, id_col, text_col).select("doc_id", tokens(F.col("text")).alias("t"))
    tests = items.select(F.col(f"`{item_id}`").alias("item_id"), tokens(F.col(f"`{item_text}`")).alias("u")).where(F.size("u") >= MIN_ITEM)
    tests = written(tests, "test-items")
    lengths = [r[0] for r in tests.select(F.least(F.size("u"), F.lit(OVERLAP))).distinct().collect()]
    found = None
    for width in sorted(lengths):
        part = _of_width(docs, tests.where(F.least(F.size("u"), F.lit(OVERLAP)) == width), width)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("at"), F.lit(0).alias("shift")).where(F.lit(False))
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("shift").alias("n_overlaps"), F.min("at").cast("long").alias("first_token"))


def _of_width(docs: DataFrame, tests: DataFrame, width: int) -> DataFrame:
    """``(doc_id, item_id, at, shift)`` of verified hits of items that are compared over ``width`` tokens."""
    short = width < OVERLAP
    probed = seeds(docs, "doc_id", 1 if short else STEP, width)
    own = seeds(tests.select("item_id", F.col("u").alias("t")), "item_id", 1, width)
    own = own.select("item_id", F.col("at").alias("item_at"), F.col("lead").alias("item_lead"), F.col("near").alias("item_near"), "seed", "hash")
    own = written(own.dropDuplicates(["item_id", "item_at", "seed", "hash"]), "test-seeds")
    bounded = own.count() <= BROADCAST_SEEDS
    sent = F.broadcast if bounded else (lambda df: df)
    hits = probed.join(sent(own.select("seed", "hash", "item_id", "item_at")), ["seed", "hash"])
    # Grouping keeps the checks below out of the join, which all tokens of the corpus pass through.
    # Rows that share an id, or have none, are told apart by their tokens.
    hits = hits.select("doc_id", "item_id", "at", "item_at", "lead", "near").distinct()
    places = own.dropDuplicates(["item_id", "item_at"]).select("item_id", "item_at", "item_lead", "item_near")
    aligned = hits.join(sent(places), ["item_id", "item_at"])
    reach, span = max(width - span_of(width), 0), span_of(width)
    same = F.expr(f"transform(sequence({-reach}, {span + reach - 1}), d -> int(coalesce(get(near, lead + d) = get(item_near, item_lead + d), false)))")
    runs = f"transform(sequence(1, {span + 2 * reach - width + 1}), o -> aggregate(slice(same, o, {width}), 0, (a, x) -> a + x))"
    allowed = 0 if short else DIFFERENT
    checked = aligned.withColumn("same", same).where(F.expr(f"exists({runs}, n -> n >= {width - allowed})"))
    return checked.select("doc_id", "item_id", "at", (F.col("at") - F.col("item_at")).alias("shift"))
