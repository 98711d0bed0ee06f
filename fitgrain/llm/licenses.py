"""License scans: normalised sentences become identifiers, and ordered rules match sequences of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fitgrain.llm.common import texts

#: How a text says which licence holds, up to its name.
UNDER = r"(?:released|licen[sc]ed|distributed|available|provided|published|covered|redistribute it|subject|made) (?:(?:under|to|by) )?(?:either )?(?:of )?(?:the |a )?(?:terms (?:and conditions )?of )?(?:the |a )?"
VERSION = r"(?:(?: the)? licen[sc]e)?(?: (?:version|v))? ?(?P<v>\d(?:\.\d)?)?"

#: Licences by their names after such words; an acronym needs no "license". The names of public licences.
NAMES = (
    ("MIT", "mit|expat|x11"), ("Apache", "apache(?: software)?"), ("ISC", "isc"), ("Zlib", "zlib(?: libpng)?"), ("BSL", "boost(?: software)?|bsl"),
    ("MPL", "mozilla public|mpl"), ("EPL", "eclipse public|epl"), ("CDDL", "common development and distribution|cddl"), ("EUPL", "european union public|eupl"),
    ("OFL", "sil open font|open font|ofl"), ("Artistic", "(?:perl )?artistic"), ("WTFPL", "do what the fuck you want to public|wtfpl"), ("Unlicense", "unlicense"),
    ("AFL", "academic free|afl"), ("OSL", "open software|osl"), ("MS-PL", "microsoft public|ms-pl"), ("MS-RL", "microsoft reciprocal|ms-rl"), ("CPL", "common public|cpl"),
    ("IPL", "ibm public"), ("PSF", "python software foundation|psf"), ("PHP", "php(?= licen[sc]e)"), ("Ruby", "ruby(?= licen[sc]e)"), ("PostgreSQL", "postgresql"), ("OpenSSL", "openssl"),
    ("LPPL", "latex project public|lppl"), ("NCSA", "university of illinois ncsa|ncsa"), ("QPL", "q public|qpl"), ("Vim", "vim(?= licen[sc]e)"), ("W3C", "w3c(?: software)?"), ("ODbL", "open database|odbl"), ("GFDL", "gnu free documentation|gfdl"),
)

#: Sentences by what they say: an identifier and a pattern found in the normalised sentence. Groups
#: ``v`` and ``k`` give a version and a kind. The wording of public licences.
SENTENCES = (
    *((f"name:{name}", rf"{UNDER}(?:{words}){VERSION}") for name, words in NAMES),
    ("gpl-name", rf"{UNDER}(?:gnu )?(?P<k>lesser |library |affero |l|a)?(?:general public licen[sc]e|gpl)(?: (?:version|v))? ?(?P<v>\d(?:\.\d)?)?(?P<later> or (?:at your option )?(?:any )?later(?: version)?)?"),
    ("bsd-name", rf"{UNDER}(?:new |modified |simplified )?(?:(?P<v>[234])[ -]clause )?bsd(?: (?P<w>[234])[ -]clause)?(?: licen[sc]e)?"),
    ("cc-name", rf"{UNDER}(?:cc|creative commons) ?(?P<k>by(?:[ -](?:nc|nd|sa))*|zero|0|attribution(?:[ -](?:noncommercial|noderivatives|noderivs|sharealike))*)(?: (?P<v>\d\.\d))?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", r"software is provided (?:by .* )?as is"),
    ("no-liability", r"in no event (?:shall|will) .* be (?:held )?liable for any"),
    ("apache-title", r"apache license version (?P<v>2\.0) january 2004"),
    ("apache-comply", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at"),
    ("apache-limits", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-title", r"gnu (?P<k>lesser |library |affero )?general public license version (?P<v>\d(?:\.\d)?) \d+ [a-z]+ \d{4}"),
    ("gpl-grant", r"you can redistribute it and ?/? ?or modify it under the terms of the gnu (?P<k>lesser |library |affero )?general public license as published by the free software foundation (?:either )?version (?P<v>\d(?:\.\d)?)(?: of the license)?(?P<later> or at your option any later version)?"),
    ("gpl-hope", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-name-use", r"neither the name of .* may be used to endorse or promote products"),
    ("isc-grant", r"permission to use copy modify and ?/? ?or distribute this software for any purpose with or without fee is hereby granted"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("mpl-title", r"mozilla public license version (?P<v>\d\.\d)"),
    ("epl-title", r"eclipse public license v(?:ersion)? ?(?P<v>\d\.\d)"),
    ("ofl-title", r"sil open font license version (?P<v>\d\.\d)"),
    ("cc-title", r"creative commons (?P<k>attribution(?:[ -](?:noncommercial|noderivatives|sharealike))*) (?P<v>\d\.\d) international public license"),
    ("wtfpl-grant", r"you just do what the fuck you want to"),
    ("public-domain", r"this is free and unencumbered software released into the public domain"),
    ("rights-reserved", r"all rights reserved"),
)
#: Sentences that are one of these as a whole.
TITLES = (("mit-title", r"(?:the )?mit license(?: mit)?"), ("isc-title", r"(?:the )?isc license"))

#: Licences by the identifiers that say so, in order; the first rule that matches at a
#: place wins, so longer ones stand before what they begin with. ``?`` marks an identifier that may be missing.
RULES = (
    ("MIT", ("mit-title?", "mit-grant", "mit-notice?", "as-is?", "no-liability?")),
    ("Apache", ("name:Apache", "apache-comply", "apache-copy?", "apache-limits?")),
    ("GPL", ("gpl-grant", "gpl-hope?", "gpl-copy?")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-use", "as-is?", "no-liability?")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is?", "no-liability?")),
    ("ISC", ("isc-title?", "isc-grant", "as-is?", "no-liability?")),
    ("BSL-1.0", ("boost-grant", "as-is?", "no-liability?")),
    ("Zlib", ("as-is?", "no-liability?", "zlib-grant")),
    ("SPDX", ("spdx",)),
    *((name, (f"name:{name}",)) for name, _ in NAMES),
    ("MIT", ("mit-title",)),
    ("Apache", ("apache-title",)),
    ("GPL", ("gpl-title",)),
    ("GPL", ("gpl-name",)),
    ("BSD", ("bsd-name",)),
    ("MPL", ("mpl-title",)),
    ("EPL", ("epl-title",)),
    ("OFL", ("ofl-title",)),
    ("CC", ("cc-title",)),
    ("CC", ("cc-name",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("Unlicense", ("public-domain",)),
    ("Proprietary", ("rights-reserved",)),
)

#: Each known sentence holds one of these, so texts and sentences without one need no pattern.
_HOLDS = re.compile(r"licen[sc]|permission|redistribut|\bas is\b|liable|warranty|public domain|rights reserved|neither the name|creative commons|spdx|what the fuck|\bunder\b.*\b(?:mit|bsd|[al]?gpl|cc)\b")
_MAY_HOLD = re.compile(r"licen[sc]|permission|redistribut|liable|warranty|spdx|fuck|\b(?:mit|bsd|[al]?gpl|cc)\b" + "".join(f"|{a}[.-]*[^a-z0-9.+-][^a-z0-9+]*{b}" for a, b in (("as", "is"), ("public", "domain"), ("rights", "reserved"), ("creative", "commons"), (r"neither[.-]*[^a-z0-9.+-][^a-z0-9+]*the", "name"))))
_SENTENCE = re.compile(r"(?<=[.;!?])(?<!\bv\.)\s+|(?<=:)\s*\n|\n\s*\n|\n(?=\s*(?:spdx|copyright|licensed|released|this work|permission|redistribution|the mit|mit license)\b)|(?<=[.;!?:])\n", re.I)
_NOISE = re.compile(r"[^a-z0-9.+-]+")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])", re.I)
_NOT = re.compile(r"\b(?:not|never|nothing|neither|nor|no longer|instead of|rather than|incompatible)\b")
_PATTERNS = tuple((name, re.compile(rf"(?<![a-z0-9.+-])(?:{pattern})(?![a-z0-9])")) for name, pattern in SENTENCES)
_TITLES = tuple((name, re.compile(pattern)) for name, pattern in TITLES)
_GPL_KINDS = {"": "GPL", "l": "LGPL", "a": "AGPL", "lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}
_CC_PARTS = {"attribution": "BY", "noncommercial": "NC", "noderivatives": "ND", "noderivs": "ND", "sharealike": "SA"}


def normal(sentence: str) -> str:
    """Lower case, one space for all between words, no stops at the ends of words."""
    words = _NOISE.sub(" ", sentence.lower()).split()
    return " ".join(w for w in (w.strip(".-") for w in words) if w)


def sentences(text: str) -> list[str]:
    """The sentences of a text, normalised, lines joined; those that hold no known sentence are left out."""
    if not _MAY_HOLD.search(text.lower()):
        return []
    found: list[str] = []
    for part in _SENTENCE.split(text):
        if m := _SPDX.search(part):
            found.append(m[0])
            continue
        lines = [normal(line) for line in part.split("\n")]
        title = next((k for k, line in enumerate(lines) if any(p.fullmatch(line) for _, p in _TITLES)), None)
        if title is not None:
            found.append(lines[title])
            lines = lines[title + 1 :]
        whole = " ".join(line for line in lines if line)
        if _HOLDS.search(whole):
            found.append(whole)
    return found


def identified(sentence: str) -> list[tuple[str, dict[str, str]]]:
    """The known sentences in a normalised one, in order, none inside another. A licence's name after a "not" is none."""
    if m := _SPDX.match(sentence):
        return [("spdx", {"k": name}) for name in re.split(r"[() ]+", m[1]) if name and name.upper() not in ("AND", "OR", "WITH")]
    for name, pattern in _TITLES:
        if pattern.fullmatch(sentence):
            return [(name, {})]
    if not _HOLDS.search(sentence):
        return []
    hits = [(m.start(), -m.end(), name, m) for name, pattern in _PATTERNS for m in pattern.finditer(sentence)]
    known, end = [], 0
    for start, stop, name, m in sorted(hits, key=lambda h: h[:2]):
        if start >= end:
            end = -stop
            if "name" not in name.split(":")[0].split("-")[-1:] or not _NOT.search(sentence[:start]):
                known.append((name, {k: (v or "").strip() for k, v in m.groupdict().items()}))
    return known


def named(rule: str, values: list[dict[str, str]]) -> str:
    """The licence's short name with its kind and version."""
    first = next((v for v in values if v), {})
    version = first.get("v", "") or first.get("w", "")
    if rule == "SPDX":
        return first["k"]
    if rule == "GPL":
        version = f"-{version if '.' in version else version + '.0'}" if version else ""
        return _GPL_KINDS[first["k"]] + version + ("-or-later" if first.get("later") else "-only" if version else "")
    if rule == "BSD":
        return f"BSD-{version}-Clause" if version else "BSD"
    if rule == "CC":
        parts = [_CC_PARTS.get(p, p.upper()) for p in re.split("[ -]", first["k"])]
        return "-".join(["CC0" if parts[0] in ("ZERO", "0") else "CC-" + "-".join(parts), *([version] if version else [])])
    if version and rule not in ("MIT", "ISC"):
        return f"{rule}-{version if '.' in version else version + '.0'}"
    return rule


def scan(text: str) -> tuple[list[str], list[str]]:
    """The identifiers of a text's known sentences in order, and the licences that the rules read from them."""
    known = [i for sentence in sentences(text) for i in identified(sentence)]
    ids = [i[0] for i in known]
    found, at = [], 0
    while at < len(ids):
        for rule, wanted in RULES:
            k, used = at, []
            for want in wanted:
                if k < len(ids) and ids[k] == want.rstrip("?"):
                    used.append(k)
                    k += 1
                elif not want.endswith("?"):
                    break
            else:
                if used:
                    found.append(named(rule, [known[u][1] for u in used]))
                    at = k
                    break
        else:
            at += 1
    return ids, list(dict.fromkeys(found))


def licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentence_ids, licenses)`` of each row, from its whole text.

    ``sentence_ids`` are the known sentences in order, ``licenses`` the
    licences found, each once, in order of appearance. Null and empty texts
    and texts without a known sentence have empty lists. Rows are read one by
    one: repeated rows are equal, null ids pass through, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "") for t in batch.column(1)]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *lists], ["doc_id", "sentence_ids", "licenses"])

    return texts(documents, id_col, text_col).mapInArrow(run, "doc_id long, sentence_ids array<string>, licenses array<string>")
