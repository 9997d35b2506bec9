"""Quality rules, decontamination and license scans against plain Python."""

import os
import subprocess
import sys
import hashlib
import random
import re
from collections import Counter

from quarry.llm import decontaminate, license_rules, licenses, quality_rules

WORD = r"[^\x20\x09-\x0D]+"
FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def measured(t):
    t = t or ""
    w, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    rep = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), n < 10 or 100 * len(rep) > 20 * n


def test_quality_ledger(messy, nothing):
    got = quality_rules.verdict(quality_rules.ledger(messy), "standard/1")
    want = Counter((r.doc_id, *measured(r.text)) for r in messy.collect())
    assert rows_of(got, ["doc_id", *quality_rules.MEASURES, "base_failed"]) == want
    assert not got.where("kept and base_failed").count()
    assert quality_rules.ledger(nothing).count() == 0
    kept = quality_rules.keep(messy)
    assert kept.columns == messy.columns and kept.count() == got.where("kept").count()


def test_quality_ablation(messy):
    book = quality_rules.ledger(messy).cache()
    bits = {r.name: 1 << r.bit for r in quality_rules.RULES}
    failed = [r.failed & quality_rules.mask_of("standard/1") for r in book.collect()]
    for r in quality_rules.ablation(book, "standard/1").collect():
        b = bits[r.rule]
        assert (r.n_fails, r.n_alone, r.n_kept_without) == (sum(bool(f & b) for f in failed), sum(f == b for f in failed), sum(not f & ~b for f in failed))


def items_for(docs):
    rng = random.Random(3)
    words = [re.findall(FOLDED, low(r.text)) for r in docs.collect()]
    long = [w for w in words if len(w) > 30]
    out = [(i, " ".join(rng.choice(long)[5:25])) for i in range(8)]
    return [*out, (8, "ONE"), (9, None), (10, "..."), (0, "w1, W2"), (None, "w5 w6"), (11, "no such words here at all"), (12, "la la la")]


def contaminated(t, items):
    words = re.findall(FOLDED, low(t))
    hit, found = set(), set()
    for i, x in items:
        w = re.findall(FOLDED, low(x))
        wins = [w] if 0 < len(w) < 10 else [w[k : k + 10] for k in range(len(w) - 9)]
        for win in wins:
            for k in range(len(words) - len(win) + 1):
                if words[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(i)} - {"None"}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, messy, nothing):
    items = items_for(messy)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter((r.doc_id, *contaminated(r.text, items)) for r in messy.collect())
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one, more = decontaminate.scan(messy, bench), decontaminate.scan(messy, bench, shard_bytes=200)
    assert rows_of(one, columns) == rows_of(more, columns) == want
    assert rows_of(one, ["doc_id", "spans"]) == rows_of(more, ["doc_id", "spans"])
    text = {r.doc_id: r.text for r in messy.collect()}
    for r in one.where("doc_id is not null").collect():
        cut = [text[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert sum(len(re.findall(FOLDED, low(c))) for c in cut) == r.n_hit
    clean = decontaminate.clean(messy, bench)
    assert clean.columns == messy.columns and clean.count() == one.where("not contaminated").count()
    assert decontaminate.scan(nothing, bench).count() == 0
    assert not decontaminate.scan(messy, bench.limit(0)).where("contaminated").count()


LICENSED = ["Licensed under CC BY-NC 4.0.\nmore", "the MIT License, or GNU General Public License version 3; cc by cc by", "SPDX-License-Identifier: Apache-2.0", "Apache   License, Version 2.0", "license", "mit license " * 300]


def base(t):
    w = re.findall(FOLDED, low(t))
    at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    n = [k for k, _ in at]
    return len(w), len(at), min(n, default=None), max(n, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, messy, nothing):
    assert len(licenses.rules()) >= 200
    docs = messy.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(LICENSED, 500)), "doc_id bigint, text string"))
    got = licenses.scan(docs)
    assert rows_of(got, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    by = {r.doc_id: r for r in got.collect()}
    assert by[500].labels == "cc-by,cc-by-nc" and by[502].labels == "apache-2.0" and by[503].labels == "apache,apache-2.0" and by[504].labels == ""
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in by.values())
    assert licenses.scan(nothing).count() == 0


def test_suppression():
    found = licenses.detections(b"Licensed under the Apache License, version 2.0")
    assert all(not (a[0] <= b[0] and b[1] <= a[1]) for a in found for b in found if a != b)


def ungated(text):
    """All rules without any gate over the text with white space made single, and plain suppression."""
    low = b" ".join((text or b"").lower().split())
    found = [(m.start(), m.end(), p, c, label) for p, c, some in license_rules.KINDS for label, _, regex in some for m in re.finditer(regex.encode(), low)]
    kept = []
    for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0])):
        if not any(x[0] <= d[0] and d[1] <= x[1] for x in kept):
            kept.append(d)
    return sorted(kept)


def example(items, rng):
    """A string that a parsed regex matches."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "ANY":
            out += rng.choice("abc")
        elif op == "NOT_LITERAL":
            out += "q"
        elif op == "IN":
            one = rng.choice([x for x in arg if str(x[0]) != "NEGATE"])
            out += "q" if str(arg[0][0]) == "NEGATE" else chr(one[1]) if str(one[0]) == "LITERAL" else chr(rng.randint(*one[1]))
        elif op == "SUBPATTERN":
            out += example(arg[3], rng)
        elif op == "BRANCH":
            out += example(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op in ("AT", "ASSERT_NOT"), op
    return out


def test_each_rule():
    """Every rule finds texts of its own, wrapped or not, and all that it finds has its keyword."""
    from re import _parser

    rng = random.Random(5)
    assert len({x for _, _, some in license_rules.KINDS for x in some}) == sum(len(some) for _, _, some in license_rules.KINDS) >= 200
    for p, _, some in license_rules.KINDS:
        for label, key, regex in some:
            for _ in range(6):
                t = f"so, {example(_parser.parse(regex), rng)} ."
                m = re.search(regex, t)
                assert m and key in m[0], (regex, t)
                wrapped = re.sub(" ", lambda _: rng.choice([" ", "\n", " \t", "\r\n  "]), t.title() if rng.random() < 0.3 else t)
                got = licenses.detections(wrapped.encode())
                assert sorted(got) == ungated(t.encode())
                assert any(x[4] == label and x[2] <= p for x in got) or any(x[0] <= m.start() and m.end() <= x[1] and x[2] <= p for x in got), (label, t, got)


def test_labels_by_brute_force(messy):
    """labels and score of every row by all rules without gates."""
    rng = random.Random(8)
    rules = [x for _, _, some in license_rules.KINDS for x in some]
    from re import _parser

    more = [" ".join(["some words", *(example(_parser.parse(rng.choice(rules)[2]), rng) for _ in range(rng.randint(1, 5))), "end"]).replace(" ", "\n", 3) for _ in range(60)]
    docs = messy.select("doc_id", "text").union(messy.sparkSession.createDataFrame(list(enumerate(more + LICENSED, 500)), "doc_id bigint, text string"))
    want = Counter()
    for r in docs.collect():
        own, first = ungated((r.text or "").encode()), set(base(r.text)[4].split(",")) - {""}
        score = max([d[3] for d in own] + [0.8] * bool(first), default=0.0)
        want[(r.doc_id, ",".join(sorted(first | {d[4] for d in own})), score)] += 1
    assert rows_of(licenses.scan(docs), ["doc_id", "labels", "score"]) == want


BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance",
    "gpl-3.0-or-later": "it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.".replace(" * ", " "),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-sa": "see https://creativecommons.org/licenses/by-sa/4.0/",
}


def test_bodies():
    for label, text in BODIES.items():
        assert label in {d[4] for d in licenses.detections(text.encode())}, label


PLAIN = ["released under gnu gpl v3", "Distributed under the terms of the MPL 2.0", "available under the BSD", "released under the Unlicense", "under the Creative Commons Attribution Share-Alike", "SPDX-License-Identifier: MIT", "The MIT License", "Apache License, Version 2.0", "licence: isc", "License = the zlib", "under", "no terms"]


def test_wrapped_notices():
    for phrase in PLAIN:
        want = ungated(phrase.encode())
        assert want or phrase in ("under", "no terms"), phrase
        gaps = [m.start() for m in re.finditer(" ", phrase)]
        for white in ("\n", "\t", "\r\n", "\n\n  ", "\x0b", "\x0c"):
            wrapped = [phrase.replace(" ", white)] + [phrase[:g] + white + phrase[g + 1 :] for g in gaps] + [f"{white}{phrase}{white}"]
            for t in wrapped:
                assert sorted(licenses.detections(t.encode())) == ungated(t.encode()) == want, t


def test_wrapped_notice_in_scan(spark):
    got = licenses.scan(spark.createDataFrame([(1, "Released under\nGNU GPL v3")], "doc_id bigint, text string")).first()
    assert (got.labels, got.score) == ("gpl,gpl-3.0", 0.95)


def test_memory_of_an_automaton():
    """A shard of the greatest size, of windows that share nothing: what a worker makes of it stays below 500 MB."""
    code = """
import random, resource
from quarry.llm import decontaminate
rng = random.Random(1)
vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
items, size = [], 0
while size < decontaminate.SHARD_BYTES:
    items.append((len(items), " ".join(rng.choice(vocab) for _ in range(60))))
    size += len(items[-1][1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
made = decontaminate.automaton(items)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(made.automaton))
"""
    mb, windows = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout.split())
    assert windows > 400_000 and mb < 500, mb
