r"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z), cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` and written anew with
every word's number behind it (``mit:0 license:1``), so that what a regular expression matches also
says where.  Texts without any gate keyword are never rewritten, and a rule is only tried where its
own keyword stands.  Detections are put in order; one that lies inside another of the same or a
better priority is suppressed.

Rules are regular expressions over words: ``( ) | ?`` mean what they do elsewhere, ``~n`` is up to n
words of any kind, ``YEAR`` a year, and ``{N}`` stands for the name of a license.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.storage import held, own

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # on text that is not lowered yet
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: label, keyword, name
NAMES = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit (0|no attribution)"),
    ("x11", "x11", "x11"),
    ("expat", "expat", "expat"),
    ("apache-1.0", "apache", "apache( software)? license (v|version)? 1 0"),
    ("apache-1.1", "apache", "apache( software)? license (v|version)? 1 1"),
    ("apache-2.0", "apache", "apache( software)? (license |licence )?(v2|2|v 2|version 2)( 0)?"),
    ("apache", "apache", "apache( software)?"),
    ("gpl-1.0", "general", "(gnu )?general public (license |licence )?(v1|1|version 1)( 0)?"),
    ("gpl-2.0", "general", "(gnu )?general public (license |licence )?(v2|2|version 2)( 0)?( only)?"),
    ("gpl-2.0-or-later", "general", "(gnu )?general public (license |licence )?(v2|2|version 2)( 0)? or ~3 later( version)?"),
    ("gpl-3.0", "general", "(gnu )?general public (license |licence )?(v3|3|version 3)( 0)?( only)?"),
    ("gpl-3.0-or-later", "general", "(gnu )?general public (license |licence )?(v3|3|version 3)( 0)? or ~3 later( version)?"),
    ("gpl", "general", "(gnu )?general public"),
    ("gpl-2.0", "gpl", "gpl (v2|2|version 2)( 0)?"),
    ("gpl-3.0", "gpl", "gpl (v3|3|version 3)( 0)?"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl", "gpl", "gnu gpl"),
    ("lgpl-2.0", "library", "(gnu )?library general public (license |licence )?(v2|2|version 2)( 0)?"),
    ("lgpl-2.1", "lesser", "(gnu )?lesser general public (license |licence )?(v2|2|version 2) 1"),
    ("lgpl-3.0", "lesser", "(gnu )?lesser general public (license |licence )?(v3|3|version 3)( 0)?"),
    ("lgpl", "lesser", "(gnu )?lesser general public"),
    ("lgpl", "lgpl", "(gnu )?lgpl ((v2|2) 1|v3|3)?"),
    ("agpl-3.0", "affero", "(gnu )?affero general public (license |licence )?(v3|3|version 3)( 0)?"),
    ("agpl", "affero", "(gnu )?affero( general public)?"),
    ("agpl", "agpl", "(gnu )?agpl (v3|3)?"),
    ("gfdl", "documentation", "(gnu )?free documentation"),
    ("bsd-2-clause", "bsd", "(2|two) clause bsd|(simplified|freebsd) bsd|bsd (2|two) clause"),
    ("bsd-3-clause", "bsd", "(3|three) clause bsd|(new|revised|modified) bsd|bsd (3|three) clause"),
    ("bsd-4-clause", "bsd", "(4|four) clause bsd|original bsd|bsd (4|four) clause"),
    ("0bsd", "bsd", "(0|zero) clause bsd|bsd (0|zero) clause"),
    ("bsd", "bsd", "bsd( style)?"),
    ("isc", "isc", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public (license |licence )?(v1|1|version 1) 1"),
    ("mpl-2.0", "mozilla", "mozilla public (license |licence )?(v2|2|version 2)( 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1.0", "eclipse", "eclipse public (license |licence )?(v1|1|version 1)( 0)?"),
    ("epl-2.0", "eclipse", "eclipse public (license |licence )?(v2|2|version 2)( 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("edl", "eclipse", "eclipse distribution"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl-1.0", "common", "common public"),
    ("eupl", "european", "european union public"),
    ("artistic-2.0", "artistic", "artistic (license |licence )?(2|version 2)( 0)?"),
    ("artistic", "artistic", "(perl )?artistic"),
    ("boost-1.0", "boost", "boost( software)?"),
    ("zlib", "zlib", "zlib( libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("openssl", "openssl", "openssl"),
    ("php", "php", "php"),
    ("python", "python", "python software foundation|psf"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "font", "(sil )?open font"),
    ("odbl", "database", "open (data commons open )?database"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("osl-3.0", "open", "open software"),
    ("afl-3.0", "academic", "academic free"),
    ("vim", "vim", "vim"),
    ("tcl", "tcl", "tcl( tk)?"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)?"),
    ("busl", "business", "business source"),
    ("sspl", "server", "server side public"),
    ("elastic", "elastic", "elastic"),
    ("proprietary", "proprietary", "proprietary"),
    ("commercial", "commercial", "commercial"),
]
_L = "(license|licence|licenses|licences)"
_UNDER = "(licensed|licenced|released|distributed|available|published|provided|offered|covered|governed|made available)"
#: priority (1 is best), keyword or None for the name's, form; each is tried with every name.
FORMS = [
    (2, None, _UNDER + " (under|by) (either |both )?(the |a |an )?(terms ~3 of )?(the )?{N}( " + _L + ")?( (v|version) ~1)?"),
    (2, None, "(subject to|under|according to) (the )?(terms|conditions|provisions)( and conditions)? of (the )?{N}( " + _L + ")?"),
    (2, None, "(see|read) (the )?{N} " + _L + " for (more )?details"),
    (2, None, "dual licensed ~3 {N}( " + _L + ")?"),
    (3, None, "(the )?{N} " + _L),
]
_CC = [(f"cc-{a}-4.0".replace("--", "-"), b) for a, b in [("by", "attribution"), ("by-sa", "attribution (share alike|sharealike)"), ("by-nd", "attribution (no (derivs|derivatives)|noderivs|noderivatives)"), ("by-nc", "attribution (non commercial|noncommercial)"), ("by-nc-sa", "attribution (non commercial|noncommercial) (share alike|sharealike)"), ("by-nc-nd", "attribution (non commercial|noncommercial) (no (derivs|derivatives)|noderivs|noderivatives)")]]
#: priority, label, keyword, rule
TEXTS = [
    (1, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (1, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    (1, "mit", "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (1, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (1, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    (1, "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    (1, "bsd-3-clause", "endorse", "neither the name of ~8 nor the names of its contributors may be used to endorse or promote products"),
    (1, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    (1, "apache-2.0", "apache", "you may not use this file except in compliance with the license ~20 apache ~12"),
    (2, "apache", "compliance", "you may not use this file except in compliance with the license"),
    (1, "apache-2.0", "license", "unless required by applicable law or agreed to in writing software distributed under the license"),
    (1, "gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (1, "lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (1, "gpl-2.0-or-later", "version", "either version 2 of the license or at your option any later version"),
    (1, "gpl-3.0-or-later", "version", "either version 3 of the license or at your option any later version"),
    (1, "gpl", "gnu", "you should have received a copy of the gnu general public license"),
    (1, "mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (1, "epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (1, "boost-1.0", "boost", "distributed under the boost software license version 1 0"),
    (1, "zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    (1, "unlicense", "domain", "this is free and unencumbered software released into the public domain"),
    (2, "public-domain", "domain", "(released |placed |dedicated |in )?(in )?(into |to )?the public domain"),
    (2, "cc0-1.0", "cc0", "(licensed under )?(creative commons )?(cc0|cc zero)( 1 0)?( universal)?"),
    (3, "cc", "commons", "creative commons( license| licence)?"),
    (4, "warranty-disclaimer", "warranty", "without (warranty|warranties) ~3 of any kind"),
    (4, "warranty-disclaimer", "merchantability", "(merchantability|fitness for a particular purpose)"),
    (4, "all-rights-reserved", "rights", "all rights reserved"),
    (4, "copyright-notice", "copyright", "copyright (c|©)? YEAR"),
    (4, "unknown-license", "license", "see (the )?license( file)?( for details)?"),
    (4, "unknown-license", "licensed", "licensed under"),
    (4, "unknown-license", "license", "license agreement"),
    (2, "proprietary", "unauthorized", "unauthorized (copying|use|distribution) ~8 (is )?(strictly )?prohibited"),
]
_SPDX = ["mit", "isc", "zlib", "apache 1 1", "apache 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0", "gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "epl 1 0", "epl 2 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "unlicense", "bsl 1 0", "0bsd"]

BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: The prefilter: rules apply to texts with one of these, in any case.  The base phrases need the first.
GATES = ["licen", "copyright", "spdx", "commons", "cc0", "domain", "reserved", "warrant", "merchantability", "fitness", "redistribut", "permission", "prohibited", "advertising", "contributors", "gpl", "conditions"]
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.3}


def compiled(rule: str) -> str:
    """The rule as a Java regular expression over numbered words, each with a space behind it."""
    out, at = [], 0
    for m in re.finditer(r" +|~(\d+)|YEAR|[a-z0-9\x80-\U0010ffff]+|[()|?]", rule):
        if m.start() != at:
            break
        at = m.end()
        token = m[0]
        if m[1]:
            out.append(rf"(?:\S+ ){{0,{m[1]}}}")
        elif token == "(":
            out.append("(?:")
        elif token in ")|?":
            out.append(token)
        elif token.strip():
            out.append(f"(?:{'(?:19|20)[0-9][0-9]' if token == 'YEAR' else token}:[0-9]++ )")
    if at != len(rule):
        raise ValueError(f"{rule!r}, at {at}")
    return f"(?<= )(?:{''.join(out)})"


def needed(rule: str) -> set[str]:
    """Words of which every match of the rule holds one at least: the fewest that a part of it offers."""
    tokens = re.findall(r"~\d+|YEAR|[a-z0-9\x80-\U0010ffff]+|[()|?]", rule)

    def alternatives(at: int) -> tuple[set[str] | None, int]:
        every: set[str] | None = set()
        while True:
            part, at = sequence(at)
            every = None if every is None or part is None else every | part
            if at >= len(tokens) or tokens[at] == ")":
                return every, at
            at += 1  # a bar

    def sequence(at: int) -> tuple[set[str] | None, int]:
        best = None
        while at < len(tokens) and tokens[at] not in "|)":
            if tokens[at] == "(":
                part, at = alternatives(at + 1)
            else:
                part = None if tokens[at][0] == "~" or tokens[at] == "YEAR" else {tokens[at]}
            at += 1
            if at < len(tokens) and tokens[at] == "?":
                part, at = None, at + 1
            if part and (best is None or (len(part), -min(map(len, part))) < (len(best), -min(map(len, best)))):
                best = part
        return best, at

    found = alternatives(0)[0]
    if not found:
        raise ValueError(f"{rule!r} matches without any word")
    return found


def rules() -> list[dict]:
    """All rules in order: p(riority), l(abel), k(eyword), ks (the words of :func:`needed`), r(egular expression)."""
    raw = [*TEXTS]
    for label, keyword, name in NAMES:
        raw += [(p, label, k or keyword, form.replace("{N}", f"({name})")) for p, k, form in FORMS]
    raw += [(2, label, "commons", f"creative commons {words} (4 0)? international? {_L}?") for label, words in _CC]
    raw += [(2, label, "cc", f"cc {label[3:-4].replace('-', ' ')} (4 0)?") for label, _ in _CC]
    for name in _SPDX:
        label = re.sub(r"(\d) (\d)", r"\1.\2", name).replace(" ", "-")
        raw.append((1, label, "spdx", f"spdx license identifier {name}"))
    return [{"p": p, "l": label, "k": keyword, "ks": sorted(needed(rule)), "r": compiled(rule)} for p, label, keyword, rule in raw]


_FOUND = "array<struct<start:int,neg_end:int,p:int,rule:int,l:string>>"


def scanned(docs: DataFrame, text: str = "text", gates: list[str] | None = GATES) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` of base phrases, and ``detections``; own columns of these names go.

    places: array of (start word, label).  detections: array of (start, neg_end, p, rule, l), what is
    left after suppression, in order of start; neg_end is minus the last word's number.  Null and
    empty texts have 0 words and empty arrays.  Works row by row: repeated rows fare alike.

    Rules apply to texts that hold one of ``gates``, a rule only where its keyword stands.  With
    ``gates`` None both are derived from the rules, so that no text that a rule matches is left out.
    """
    docs = docs.drop("n_words", "places", "detections")
    docs, columns = held(docs, text), docs.columns
    own_rules = [{**r, "i": i} for i, r in enumerate(rules())]
    empty_places = F.from_json(F.lit("[]"), "array<struct<start:int,l:string>>")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    gate = F.lit(False)
    for g in gates if gates is not None else sorted({w for r in own_rules for w in r["ks"]} | {phrase.split()[0] for phrase, _ in BASE}):
        gate = gate | F.contains(F.col("_low"), F.lit(g))
    out = docs.withColumn("_low", F.lower(body))
    out = out.withColumn("_hit", gate)
    words = F.regexp_extract_all(F.translate(body, _UPPER, _LOW), F.lit(WORD), F.lit(0))
    # every word with a number and a space behind it, and a space before them all
    tagged = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit(":"), i.cast("string"), F.lit(" "))), ""))
    out = out.withColumn("_tagged", F.when(F.col("_hit"), tagged))
    start = lambda m: F.regexp_extract(m, ":([0-9]+)", 1).cast("int")
    base = "|".join(compiled(phrase) for phrase, _ in BASE)
    label = lambda m: F.element_at(F.create_map(*[F.lit(x) for phrase, name in BASE for x in (phrase.split()[0], name)]), F.regexp_extract(m, "^([a-z]+)", 1))
    places = F.transform(F.regexp_extract_all("_tagged", F.lit(base), F.lit(0)), lambda m: F.struct(start(m).alias("start"), label(m).alias("l")))
    out = out.withColumn("places", F.coalesce(F.when(F.col("_hit"), places), empty_places))
    table = F.from_json(F.lit(json.dumps(own_rules)), f"array<struct<p:int,l:string,k:string,{'' if gates is not None else 'ks:array<string>,'}r:string,i:int>>")
    there = lambda w: F.contains(F.col("_tagged"), F.concat(F.lit(" "), w, F.lit(":")))
    tried = F.filter(table, lambda r: there(r["k"]) if gates is not None else F.exists(r["ks"], there))
    found = F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(
                F.regexp_extract_all(F.col("_tagged"), r["r"], F.lit(0)),
                lambda m: F.struct(start(m).alias("start"), (-F.regexp_extract(m, ":([0-9]+) $", 1).cast("int")).alias("neg_end"), r["p"].alias("p"), r["i"].alias("rule"), r["l"].alias("l")),
            ),
        )
    )
    out = out.withColumn("_found", F.when(F.col("_hit"), F.array_sort(found)))
    out = out.withColumn("detections", F.coalesce(F.when(F.size("_found") > 0, _unsuppressed(F.col("_found"))), F.from_json(F.lit("[]"), _FOUND)))
    out = out.withColumn("n_words", F.regexp_count(body, F.lit(WORD)).cast("long"))
    return out.select(*own(columns, text), "n_words", "places", "detections")


def _unsuppressed(found: Column) -> Column:
    """Without detections inside another of the same or a better priority.

    In order of (start, longest first, priority, rule) what contains a detection comes before it, so
    the furthest end seen for each priority tells; one pass.
    """
    none = F.lit(-1)
    begin = F.struct(*[none.alias(f"e{p}") for p in CONFIDENCE], F.from_json(F.lit("[]"), _FOUND).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.lit(False)
        for p in CONFIDENCE:
            inside = inside | ((d["p"] >= p) & (acc[f"e{p}"] >= -d["neg_end"]))
        ends = [F.when(d["p"] == p, F.greatest(acc[f"e{p}"], -d["neg_end"])).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in CONFIDENCE]
        return F.struct(*ends, F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, begin, step, lambda acc: acc["kept"])


def licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    base: phrases of BASE, all places.  labels: those of the base phrases and of all detections that
    are not suppressed.  score: the confidence of the best detection (at least 0.7 with a base
    phrase), 0 without any.  first_word and last_word are null without base phrases.
    """
    out = scanned(docs.select("doc_id", "text"))
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["l"])))
    starts = F.transform("places", lambda x: x["start"].cast("long"))
    sure = F.element_at(F.array(*[F.lit(c) for _, c in sorted(CONFIDENCE.items())]), F.array_min(F.transform("detections", lambda d: d["p"])))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(names("places"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names("places"), names("detections"))), ",").alias("labels"),
        F.greatest(F.when(F.size("detections") > 0, sure).otherwise(0.0), F.when(F.size("places") > 0, 0.7).otherwise(0.0)).alias("score"),
    )
