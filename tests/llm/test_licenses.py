import random
import re

from pyspark.sql import types as T

from folioscope.llm import licenses as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    at, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_hundreds_of_rules():
    rules = L.build_rules()
    assert len(rules) > 500 and all(re.search(rb"^[0-9a-z\x80-\xff]+$", r.keyword) for r in rules)


def test_base_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = ["cc", "by", "CC-BY", "General", "public", "LICENSE", "all", "rights", "Reserved.", "É", "é", "x", "cc0", "by2", "K", "--", "(c)"]
    texts = [None, "", "...", "CC BY", "all rights\n\nreserved all-rights-reserved", "cc by " * 20000] + ["".join(rng.choice(vocab) + rng.choice([" ", "", "-", "\n"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "cc by", None), (3, "CC BY", None)]
    got = L.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r[1:6]) == slow(texts[r.doc_id]), texts[r.doc_id]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels_and_suppression():
    labels = lambda t: L.scan_text(t)[5].split(",")
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl", "gpl-3"]
    assert labels("This is in the public domain. All rights reserved") == ["public-domain", "reserved"]
    assert labels("a committee of apaches") == [""]
    found = [(p, a, a + n, i) for i, (p, a, n) in enumerate((random.Random(9).choice([10, 20, 30]), random.Random(k).randrange(60), random.Random(k + 99).randrange(1, 20)) for k in range(200))]
    kept = L.suppress(found)
    best = sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1]))
    slow_kept = []
    for f in best:
        if not any(k[1] <= f[1] and f[2] <= k[2] for k in slow_kept):
            slow_kept.append(f)
    assert sorted(kept) == sorted(slow_kept)


def slow_labels(text):
    """Every rule on every text, without keywords, and suppression by comparing all detections."""
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    found = [(r.priority, m.start(), m.end(), r.label) for r in L.build_rules() for m in re.finditer(r.pattern.encode("latin-1"), raw)]
    kept = []
    for f in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1])):
        if not any(k[1] <= f[1] and f[2] <= k[2] for k in kept):
            kept.append(f)
    own = slow(text)[4]
    return ",".join(sorted({f[3] for f in kept} | set(filter(None, own.split(",")))))


def test_labels_equal_brute_force():
    rng = random.Random(7)
    phrases = [
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU Lesser General Public License v2.1", "the MIT License", "BSD 3-Clause", "CC BY-NC-SA 4.0",
        "Creative Commons Attribution-ShareAlike 3.0", "All rights reserved", "Mozilla Public License, v. 2.0", "public domain", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Business Source License 1.1", "GPLv3", "accept", "apache2.0", "tous droits réservés", "at your option any later version", "under the terms of the eclipse public license", "used with permission", "(c) Copyright 2021",
    ]
    for _ in range(150):
        text = "".join(rng.choice(phrases) + rng.choice([" ", ". ", ", ", "\n", "x ", "-"]) for _ in range(rng.randrange(5)))
        assert L.scan_text(text)[5] == slow_labels(text), text


def test_signatures_by_hand():
    lines = [x.split(" ", 3) for x in L.SIGNATURES.strip().splitlines() if not x.startswith("#")]
    assert len(lines) > 300 and len({x[3] for x in lines}) == len(lines) and all(0 < int(x[1]) <= 100 for x in lines)
    labels = lambda t: set(L.scan_text(t)[5].split(","))
    assert "lgpl-2.1" in labels("GNU Lesser General Public License, version 2.1") and "cc-by-nc-sa-4.0" in labels("CC BY-NC-SA 4.0")
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == {"bsd-3-clause"} and labels("Copyright (c) 2020 by us") == {"copyright"}
    assert "reserved" in labels("Tous droits réservés") and "isc" in labels("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee")
