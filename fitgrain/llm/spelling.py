"""Spelling variants: words one edit apart by asymmetric chunk and gram signatures, and the form each leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import ascii_lower, texts
from fitgrain.session import written

#: A run of letters, after A-Z became a-z.
RUN = "[a-zÀ-ÿ]+"
MIN_CHARS = 6
MIN_COUNT = 5
#: A word's form is so many times as frequent as the word.
FORM_RATIO = 5
#: One run in so many loses a code point, by a checksum of its document and itself.
SLIP_EVERY = 199


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, or what is left of it after a planted slip; a row without an id has none."""
    checksum = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (checksum % F.char_length(run)).cast("int")
    return F.when(checksum % SLIP_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: all words of the texts that are long and frequent enough.

    Words are counted in each task before they are shuffled, so a frequent word costs one row a task.
    """
    runs = F.filter(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0)), lambda r: F.char_length(r) >= min_chars)
    found = texts(documents, id_col, text_col).select("doc_id", F.explode(runs).alias("run"))
    words = found.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def chunks(words: DataFrame) -> DataFrame:
    """``(word, length, part, gram)``: two disjoint halves of each word; an odd one leaves its middle out."""
    length = F.char_length("word")
    half = F.floor(length / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.substring("word", F.lit(1), half).alias("gram")),
        F.struct(F.lit(1).alias("part"), F.substring(F.col("word"), length - half + 1, half).alias("gram")),
    )
    return words.select("word", length.alias("length"), F.explode(parts).alias("c")).select("word", "length", "c.part", "c.gram")


def grams(words: DataFrame) -> DataFrame:
    """``(word, length, part, gram)``: all positional grams that can be a half of a word of ``length``.

    That word is as long or one shorter, and its half stands where the gram
    does or one place to the left, as far as the lengths differ.
    """
    own = F.char_length("word")
    shorter = F.explode(F.array(own, own - 1))
    rows = words.select("word", shorter.alias("length"))
    half = F.floor(F.col("length") / 2).cast("int")
    slack = F.sequence(F.lit(0), F.char_length("word") - F.col("length"))
    rows = rows.select("word", "length", half.alias("half"), F.explode(slack).alias("shift"))
    places = F.array(
        F.struct(F.lit(0).alias("part"), F.substring(F.col("word"), F.col("shift") + 1, F.col("half")).alias("gram")),
        F.struct(F.lit(1).alias("part"), F.substring(F.col("word"), F.col("length") - F.col("half") + F.col("shift") + 1, F.col("half")).alias("gram")),
    )
    return rows.select("word", "length", F.explode(places).alias("g")).select("word", "length", "g.part", "g.gram")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)``: each two words that differ by one inserted, deleted or replaced code point, once.

    One edit leaves one of two disjoint halves of the shorter word (of equally
    long ones, of the lesser) whole, and moves it one place at most: halves
    meet grams, and what meets is verified.
    """
    a, b = chunks(words).alias("a"), grams(words).alias("b")
    meet = (F.col("a.length") == F.col("b.length")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.gram") == F.col("b.gram"))
    once = (F.char_length("b.word") > F.col("a.length")) | (F.col("a.word") < F.col("b.word"))
    near = a.join(b, meet & once & (F.levenshtein("a.word", "b.word", 1) == 1))
    return near.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: forms followed to the last, by doubling.

    A form is ``FORM_RATIO`` times as frequent as its word, so a chain has no
    circle, and the rounds grow with the logarithm of its length.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of each word of the texts.

    Words are runs of Latin letters with A-Z lower-cased. ``form`` is the near
    word of largest ``n``, the least of equal ones, if it is ``ratio`` times as
    frequent; ``root`` the end of the chain of forms. Null and empty texts have
    no words; repeated rows count again; rows without an id count without
    slips; an empty table gives no rows. Words too long for one edit to matter
    are words like any other.
    """
    words = written(word_counts(documents, id_col, text_col, min_chars, min_count), "words")
    pairs = written(near_pairs(words.select("word")), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = known.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    formed = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "word-forms")
    ends = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
