"""Operators that judge each row by itself, against plain Python and the libraries they follow."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer


from fitgrain.llm import bpe, common, html_text, langid, licenses, quality, token_files
from fitgrain.llm.catalog import END_ID, QUERIES, RANK_FILE, TOKENIZER_FILE

SF_DIR = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path(RANK_FILE)
TOKENIZER = public_tokenizers.path(TOKENIZER_FILE)
ALPHABET = [*" \n\t.,'|#AbéÉİΣσ1²١_!́ẖK", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "\x1c", "\x85", "　", "😀"]


def scribble(n, size, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, size))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(tik):
    with open(RANKS, "rb") as f:
        coder = bpe.ByteBpe(bpe.read_ranks(f), public_tokenizers.PATTERN)
    texts = scribble(20_000, 12, 1) + scribble(20, 3000, 2) + ["", "a" * 20_000, "abcd" * 5_000, "ab " * 3_000]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = tik.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want), text[:100]
        assert coder.decode(ids) == text.encode()


def test_rank_queue_order():
    queue = bpe.RankQueue(np.array([70_000, 5, 5]), np.array([1, 9, 2]))
    queue.push(64, 3)
    queue.push(5, 1)
    assert [queue.pop() for _ in range(3)] == [(5, [1, 2, 9]), (64, [3]), (70_000, [1])] and not queue.top


def test_bpe_odd_rows(odd, empty, tik):
    got = rows(bpe.bpe_digests(odd, RANKS, public_tokenizers.PATTERN))
    want = []
    for doc_id, text in ((r.doc_id, r.text or "") for r in odd.collect()):
        ids = tik.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.bpe_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_tokens_hold_ids_and_bytes(documents):
    found = bpe.bpe_tokens(documents([(1, "Hello wörld")]), RANKS, public_tokenizers.PATTERN).first()
    assert bytes(found["decoded"]).decode() == "Hello wörld" and len(found["ids"]) == 4 * found["n_tokens"]


def test_word_tokens_like_the_library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = scribble(20_000, 14, 3)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    for limit in (token_files.CACHE_BYTES, 100_000):
        coder = token_files.WordTokens(tokenizer)
        coder.known.limit = limit
        for some in (slice(0, 9000), slice(9000, None)):
            for text, ids, own in zip(texts[some], coder.encode(pa.array(texts[some])), want[some], strict=True):
                assert ids.tolist() == own.ids, repr(text)
    assert [len(x) for x in coder.encode(pa.array([None, "", " \n"]))] == [0, 0, 0]


def test_worker_caches_are_bounded_by_bytes():
    cache = common.Recent(100_000)
    for k in range(200):
        keys = [f"{j}" for j in range(k * 50, k * 50 + 100)] + ["x" * 9000]
        values = cache.ready(keys, lambda new: [x.encode() * 2 for x in new])
        assert all(values[x] == x.encode() * 2 for x in keys)
        cache.forget_long()
        held = sum(3 * len(x) + common.ENTRY_BYTES for g in (cache.now, cache.older) for x in g)
        assert held < 200_000 and "x" * 9000 not in cache.now
    assert common.kept_in_worker("a", lambda: 1) == common.kept_in_worker("a", lambda: 2) == 1
    assert common.kept_in_worker("b", lambda: 3) == 3 and common.kept_in_worker("a", lambda: 4) == 4
    common.release_worker()


def test_token_files_order_rows_of_one_id(documents):
    """Rows without an id, or with the same one, stand by their texts whatever order they come in."""
    rows = [(d, f"text {k} of many" * (k % 3)) for d in (None, 4, 9) for k in range(40)]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        found.append(sorted(map(str, token_files.token_table(documents(rows).repartition(3 + seed), TOKENIZER, 2).collect())))
    assert found[0] == found[1]


def test_codes_give_any_id():
    ids = np.random.default_rng(0).integers(0, 70_000, 5_000).astype(np.uint32)
    ids[:60] = 2**31 + np.arange(60)
    codes = token_files.Codes(token_files.pack(ids))
    assert len(codes) == 5_000 and (codes.slice(0, 5_000) == ids).all() and (codes.slice(777, 3_001) == ids[777:3_001]).all()
    assert [codes[i] for i in range(0, 5_000, 13)] == ids[::13].tolist()
    assert len(token_files.Codes(token_files.pack(ids[:0]))) == 0


def test_token_files_odd_rows(odd, empty, monkeypatch):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    all_rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    sizes = {(d, t): [*tokenizer.encode(t, add_special_tokens=False).ids, END_ID] for d, t in all_rows}
    got = sorted(rows(token_files.token_table(odd, TOKENIZER, END_ID)), key=lambda r: r[1])
    assert [r[0] for r in got] == [d for d, _ in all_rows]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    want = sorted((len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for i in (sizes[r] for r in all_rows))
    assert sorted((r[2], r[3]) for r in got) == want
    assert token_files.token_table(empty, TOKENIZER, END_ID).count() == 0


def brute_repeats(words):
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return len(covered)


def test_quality_counts(spark, odd, empty):
    texts = [" ".join(random.Random(s).choice("ab") for _ in range(60)) for s in range(40)] + scribble(300, 60, 5) + ["a b\nc\n\n \na b\na b "]
    for text in texts:
        words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(words)]
        assert quality.statistics(text.encode())[0] == want, repr(text)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(9)], "doc_id long, quality int, toxic int")
    assert quality.quality(odd, quality.fit_quality(odd, labels)).count() == odd.count()
    assert quality.fit_quality(empty, labels) is None and quality.quality(empty, None).count() == 0


def test_forest_finds_what_is_odd():
    usual = np.random.default_rng(3).normal(size=(2_000, 4))
    forest = quality.fit(usual, np.ones(2_000, bool))
    assert (forest.scores(usual) <= forest.threshold).mean() > 0.98
    assert (forest.scores(np.full((5, 4), 9.0)) > forest.threshold).all()


def test_quality_keeps_good_rows(spark):
    found = QUERIES["op9_quality_rules"](spark, SF_DIR.replace("0.001", "0.01")).alias("q")
    labels = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/labels.parquet")
    judged = found.join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    shares = dict(map(tuple, judged))
    assert shares[1] > 0.97 and shares.get(0, 0) < 0.5


def test_quality_of_held_out_labels(spark):
    """Learned from every second label, judged by the others; better than the base rule alone."""
    sf = SF_DIR.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit_quality(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    judged = quality.quality(docs, forest).join(labels.where("crc32(cast(doc_id as string)) % 2 = 1"), "doc_id")
    shares = {r["quality"]: (r["kept"], r["base"]) for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((~F.col("base_failed")).cast("int")).alias("base")).collect()}
    assert shares[1][0] > 0.94 and shares[0][0] < 0.15 < shares[0][1]


def test_quality_is_learned_alike_from_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    forest = quality.fit_quality(docs, labels)
    more = labels.unionByName(labels.where("quality = 0").selectExpr("doc_id", "1 AS quality")).unionByName(labels)
    again = quality.fit_quality(docs.unionByName(docs).repartition(3), more.repartition(5))
    assert forest.threshold == again.threshold and (forest.split == again.split).all()


def test_quality_threshold_counts_every_labelled_row(spark):
    """However few rows the driver may hold, the threshold is a place among all good rows of a half."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 97:03d}{'#' * (j % 11 == i % 11)}" for j in range(30 + i % 17))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 != 0)) for i in range(900)], "doc_id long, quality int")
    forest = quality.fit_quality(docs, labels, rows=20)
    second = docs.join(labels.where("quality = 1 AND pmod(xxhash64('quality', doc_id), 2) = 1"), "doc_id")
    scores = sorted(r["anomaly"] for r in quality.quality(second, forest).collect())
    assert len(scores) > 400 and forest.threshold == scores[min(int(np.ceil(len(scores) * quality.KEPT_SHARE)), len(scores) - 1)]
    assert forest.size == quality.SUBSAMPLE


def plain_path(forest, tree, row):
    node = 0
    while forest.feature[tree, node] >= 0:
        node = 2 * node + (2 if row[forest.feature[tree, node]] >= forest.split[tree, node] else 1)
    return forest.path[tree, node]


def test_forest_scores_are_path_lengths():
    rows = np.random.default_rng(5).normal(size=(400, 3))
    forest = quality.fit(rows, np.ones(400, bool))
    some = rows[:20]
    mean = np.array([np.mean([plain_path(forest, t, r) for t in range(len(forest.feature))]) for r in some])
    assert np.allclose(forest.scores(some), 2.0 ** (-mean / quality.usual_path(forest.size)))


def test_language_of_held_out_rows(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = QUERIES["op1_language_id"](spark, sf).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang_pred"] == r["want"] for r in held]) > 0.97 and np.mean([r["accepted"] for r in found]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_rejection_is_calibrated(spark):
    """Texts with their letters in another order are rejected, their originals are not, and that depends on the odds."""
    docs = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.fit_languages(docs)
    whole = [(r["text"] or "").encode() for r in docs.where("crc32(cast(doc_id as string)) % 4 = 2").collect()]
    long = [t for t in whole if len(t) > 100]
    assert len(long) > 100 and np.mean([model.predict(t)[2] for t in long]) > 0.99
    assert np.mean([model.predict(langid.mixed_up(t, k))[2] for k, t in enumerate(long)]) < 0.05
    assert np.isfinite(model.threshold) and sorted(langid.mixed_up(long[0], 1)) == sorted(long[0].translate(langid._SIGNS))
    assert model.languages == ("de", "en", "es", "fr") and len(model.bias) == 5


def test_language_odd_rows(odd, empty):
    assert langid.fit_languages(empty) is None
    assert {r["lang_pred"] for r in langid.languages(odd, None).collect()} == {"und"}
    found = langid.languages(odd, langid.fit_languages(odd)).collect()
    assert len(found) == odd.count() and sum(r["lang_pred"] == "und" for r in found) == 5
    assert all(r["score"] == 0 and not r["accepted"] for r in found if r["lang_pred"] == "und")


PAGES = [
    ("<body><nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two.<p>Three, <b>four</b><br>five.</article><footer>f</footer>", "T & U\n\nOne two.\n\nThree, four five."),
    ('<header>Site</header><div class="cookie-notice">We use cookies, yes.</div><div id="content"><h1>Title</h1><p>First, a long one. Really.</p><ul><li>a, b</li><li>c d e.</ul><div class="comments"><p>I like it very much, thanks!</p></div></div><aside>rel</aside>', "Title\n\nFirst, a long one. Really.\n\na, b\n\nc d e."),
    ("<main><script>var a='<p>no</p>';</script><style>p{}</style><form><p>mail</p></form><p>Yes.</p><!-- <p>no</p> --></main>", "Yes."),
    ("<nav>only</nav>", ""),
    ("plain text", "plain text"),
    ("", ""),
    (None, ""),
    ("<article><p>cut off", "cut off"),
]


def test_html(spark):
    pages = spark.createDataFrame([(k if k else None, None, h, "x") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.page_texts(pages).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert got[k or None]["text"] == want and got[k or None]["n_chars"] == len(want)
    assert html_text.page_texts(pages.where("false")).count() == 0


PROSE = [f"Paragraph {k} tells its part of the story, at length, and with some marks. " * 5 for k in range(6)]
SHORT = [f"item number {k}, short" for k in range(10)]


def _p(texts):
    return "".join(f"<p>{t.strip()}</p>" for t in texts)


@pytest.mark.parametrize("wrap", ("<article>{}</article>", "<main><div class='body'>{}</div></main>", "<div id='content'><h1>T</h1>{}</div>"))
def test_html_keeps_short_items(wrap):
    items = {
        "list": "<ul>" + "".join(f"<li>{x}</li>" for x in SHORT) + "</ul>",
        "table": "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(SHORT[::2], SHORT[1::2])) + "</table>",
    }
    links = "<ul class='more'>" + "".join(f"<li><a href='/{k}'>another page {k}</a></li>" for k in range(10)) + "</ul>"
    title = ["T"] if "h1" in wrap else []
    for name, block in items.items():
        html = "<body><nav><a href='/'>Home</a></nav>" + wrap.format(_p(PROSE[:3]) + block + _p(PROSE[3:]) + links) + "<footer>f</footer>"
        assert html_text.main_text(html).split("\n\n") == title + [t.strip() for t in PROSE[:3]] + SHORT + [t.strip() for t in PROSE[3:]], name


SIDE = "<div class='sidebar'><p>Side matter, of no use. It has some marks, too.</p></div><div class='comments'>" + _p(["I like it, very much indeed, and say so at length. " * 8] * 4) + "</div>"


@pytest.mark.parametrize("page", (
    "<div class='page with-sidebar'><h1>T</h1>{}" + SIDE + "</div>",
    "<div class='content-sidebar-wrap'><div class='text'>{}</div><div class='sidebar'><p>Short, side.</p></div></div>",
    "<div id='page'><article class='post comments-open'><h1>T</h1>{}</article>" + SIDE + "</div>",
    "<div id='page'><article class='post comments-open'>{}</article></div>",
    "<article title='The hidden cost' data-id='nav-3' data-class='menu'>{}</article>" + SIDE,
    "<div title='class=menu'>{}</div>" + SIDE,
    "<div class='text'><h1>T</h1>{}</div>" + SIDE * 5,
))
def test_html_wrapper_words(page):
    title = ["T"] if "h1" in page else []
    assert html_text.main_text("<body>" + page.format(_p(PROSE[:3]))).split("\n\n") == title + [t.strip() for t in PROSE[:3]]


def test_html_of_boilerplate_only():
    assert html_text.main_text("<div class='cookie-notice'>We use cookies, yes.</div><div class='comments'><p></p></div>") == ""
    assert html_text.main_text("<div id='content'><p>Yes.</p></div>" + SIDE) == "Yes."


def test_html_holders_are_one_vote():
    """A teaser does not hide the article, two articles both stay, and a section's name does not remove it."""
    prose = [t.strip() for t in PROSE[:3]]
    teaser = "<div><article><h2>Teaser</h2><p>See this too, now.</p></article></div>"
    assert html_text.main_text(f"<body><div id=content><h1>T</h1>{_p(PROSE[:3])}</div>{teaser}").split("\n\n") == ["T", *prose]
    assert html_text.main_text(f"<body><article id=a>{_p(PROSE[:3])}</article><article id=b>{_p(PROSE[:3])}</article>").split("\n\n") == prose + prose
    for outside in ("", "<p>More</p>"):
        page = f"<article><h1>New copyright law</h1><section id='copyright'>{PROSE[0]}</section><p>End.</p></article>{outside}"
        assert html_text.main_text(page).split("\n\n") == ["New copyright law", prose[0], "End."]


def test_html_ratios_decide(monkeypatch):
    """Labels and dates in elements around the paragraphs go by their ratios alone: no tag or word tells them."""
    names = ["Home", "World", "Today"] * 4
    facts = "".join(f"<div><div>{w}</div></div>" for w in names)
    page = f"<body><div><section>{_p(PROSE[:4])}<div>{facts}</div></section></div>"
    want = [t.strip() for t in PROSE[:4]]
    assert html_text.main_text(page).split("\n\n") == want
    monkeypatch.setattr(html_text, "path_ratios", lambda page, own: dict.fromkeys(page.path, 1.0))
    assert html_text.main_text(page).split("\n\n") == want + names


@pytest.mark.parametrize("page", ("<div>x" * 2000, "<div class=nav>A tale, told. " * 2000, "<table><tr><td>y" * 2000, "<ul><li>z" * 2000, "".join(f"<p id=a{k}>Text {k}, here." for k in range(8000)), "</p>" * 9000, "<p>" * 9000))
def test_html_takes_linear_time(page):
    html_text.main_text(page)
    times = []
    for many in (page, page * 4):
        start = time.process_time()
        html_text.main_text(many)
        times.append(time.process_time() - start)
    assert times[0] < 0.5 and times[1] < 12 * times[0] + 0.1


def test_html_of_repeated_and_long_pages(spark):
    long = "<article>" + _p(PROSE) * 300 + "</article>"
    rows = [(1, "u", long, "x")] * 3 + [(None, None, long, "x"), (None, "u", "<div>" * 20_000 + "deep", "x")]
    found = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["n_chars"] for r in found) == sorted([len(r["text"]) for r in found]) and sorted({r["text"][:9] for r in found}) == ["Paragraph", "deep"]
    assert len({r["text"] for r in found if r["page_id"] == 1}) == 1


LICENCES = [
    ("Released under the MIT License.", ["MIT"]),
    ("Text.\nThis work is licensed under the GNU General Public License, version 3.\nMore.", ["GPL-3.0-only"]),
    ("Licensed under CC BY-NC 4.0. And more.", ["CC-BY-NC-4.0"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 2.1 of the License, or\n(at your option) any later version.\n\nfoo", ["LGPL-2.1-or-later"]),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list.\n2. Redistributions in binary form must reproduce the above copyright notice, this list.\n", ["BSD-2-Clause"]),
    ("A licence to kill under the sea.", []),
    ("This is released under the MIT\nLicense and all rights reserved.", ["MIT", "Proprietary"]),
    ("Licensed under the\nApache License, Version 2.0\nAll rights reserved", ["Apache-2.0", "Proprietary"]),
    ("Licensed under MIT", ["MIT"]),
    ("We do not use anything licensed under the MIT license.", []),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-4.0\ncode", ["MIT", "Apache-2.0", "CC-BY-4.0"]),
    ("The program is made available under the terms of the Eclipse Public License v2.0.", ["EPL-2.0"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
    ("Licensed under the EUPL, version 1.2 only. Fonts are licensed under the SIL Open Font License, Version 1.1.", ["EUPL-1.2", "OFL-1.1"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not distributed, see the site.", ["MPL-2.0"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted.", ["GPL-3.0-only"]),
    ("                                 Apache License\n                           Version 2.0, January 2004", ["Apache-2.0"]),
    ("Released under the LGPL version 2.1 or later.", ["LGPL-2.1-or-later"]),
    ("Provided 'as-is', and in no event will the authors be held liable for any damages.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following.", ["Zlib"]),
    ("He was subject to the python in the zoo. It is available by the sea.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text, words", (("This is free and unencumbered software released into the {}.", "public domain"), ("All {}.", "rights reserved"), ("Released under {} Attribution 4.0.", "creative commons")))
def test_licenses_over_line_ends(text, words):
    want = licenses.scan(text.format(words))
    assert want[0]
    for space in ("\n", "  ", " \t", "\n * "):
        assert licenses.scan(text.format(words.replace(" ", space))) == want, repr(space)


def test_licenses(documents, empty):
    got = {r["doc_id"]: r["licenses"] for r in licenses.licenses(documents(list(enumerate(t for t, _ in LICENCES)))).collect()}
    assert got == {k: want for k, (_, want) in enumerate(LICENCES)}
    assert licenses.licenses(empty).count() == 0


def test_licenses_of_odd_rows(documents, odd):
    """Null ids pass, repeated rows are equal, and a licence at the end of a very long text is found."""
    long = "some words here, and more. " * 60_000 + "Licensed under the MIT License."
    rows = [(None, LICENCES[0][0]), (None, None), (1, long), (1, long), (2, "license " * 50_000)]
    got = sorted((str(r["doc_id"]), r["licenses"]) for r in licenses.licenses(documents(rows)).collect())
    assert got == sorted([("None", ["MIT"]), ("None", []), ("1", ["MIT"]), ("1", ["MIT"]), ("2", [])])
    assert all(r["licenses"] == [] for r in licenses.licenses(odd).collect())


@pytest.mark.parametrize("name, words", licenses.NAMES)
def test_each_name_is_a_rule(name, words):
    first = words.split("|")[0].replace("(?: software)?", "").replace("(?: libpng)?", "").replace("(?:perl )?", "").replace("(?= licen[sc]e)", "")
    version = "" if name in ("MIT", "ISC") else "-2.0"
    assert licenses.scan(f"It is distributed under the terms of the {first.title()} License, version 2.0.")[1] == [name + version]
