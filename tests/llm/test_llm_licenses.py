"""License scan: rules against plain searches without the gate, suppression against all pairs, edge cases."""

import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.llm import license_rules, license_scan, queries

from .test_llm_sql import DIR

RULES = license_rules.rules()
SCANNER = license_scan.Scanner()

#: (text, labels that it must give), by hand.
CASES = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"apache-2.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3", "gpl"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2-or-later"}),
    ("SPDX-License-Identifier: LGPL-2.1-only", {"lgpl-2.1-only"}),
    ("SPDX-License-Identifier: FooBar", {"spdx-other"}),
    ("Licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc-4.0"}),
    ("Licensed under CC BY-NC-SA", {"cc-by", "cc-by-nc-sa"}),
    ("https://creativecommons.org/licenses/by-sa/3.0/", {"cc-by-sa-3.0"}),
    ("Copyright (c) 2020 Foo. All rights reserved.", {"copyright", "reserved"}),
    ("GNU Lesser General Public License v2.1", {"lgpl-2.1", "gpl"}),
    ("under the GPLv2", {"gpl-2"}),
    ("Redistributions must retain this. Neither the name of Foo Bar Inc. nor the names of its contributors may be used to endorse or promote products derived from this software", {"bsd-3-clause"}),
    ("a 3-clause BSD license", {"bsd-3-clause"}),
    ("Mozilla Public License 2.0", {"mpl-2.0"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Tous droits réservés", {"reserved-fr"}),
    ("No license is needed to read about the Apache people.", set()),
    ("The commonest mistake", set()),
    ("", set()),
]


@pytest.mark.parametrize(("text", "labels"), CASES)
def test_labels_of_known_texts(text, labels):
    assert {RULES[k].label for k, _, _ in SCANNER.scan(text)[1]} == labels


def test_rules_are_many_and_ordered():
    assert len(RULES) > 300 and len({r.label for r in RULES}) > 150
    assert [r.priority for r in RULES] == sorted((r.priority for r in RULES), reverse=True)
    assert all(0 < r.strength < 1 and r.keywords for r in RULES)


def sample(pattern: str, r: random.Random) -> str:
    """Some text that a pattern of the rules matches: choices, options and classes are drawn."""
    parse = re._parser.parse(pattern)

    def one(items):
        out = ""
        for op, v in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(v)
            elif op == "NOT_LITERAL":
                out += r.choice("xyz")
            elif op == "IN":
                lo = v[0][1]
                out += r.choice("xyz") if str(v[0][0]) == "NEGATE" else chr(lo if isinstance(lo, int) else r.randint(*lo)) if len(v) == 1 else chr(r.choice(v)[1])
            elif op == "MAX_REPEAT":
                out += "".join(one(v[2]) for _ in range(r.randint(v[0], min(v[1], v[0] + 2))))
            elif op == "BRANCH":
                out += one(r.choice(v[1]))
            elif op == "SUBPATTERN":
                out += one(v[3])
            elif op != "ASSERT_NOT":
                raise ValueError(op)
        return out

    return one(parse)


def test_every_match_of_a_rule_holds_a_keyword():
    """The gate loses nothing: texts drawn from each pattern match it and have one of its keywords as a word."""
    r = random.Random(3)
    for rule in RULES:
        for _ in range(30):
            text = sample(rule.pattern.pattern.decode(), r)
            assert rule.pattern.search(text.encode()), (rule.label, text)
            assert rule.keywords.intersection(text.split(" ")), (rule.label, text)


def plain_scan(text):
    """All rules without gate; suppression over all pairs."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    said, starts = " ".join(words), []
    raw, at = said.encode(), 0
    for w in words:
        starts.append(at)
        at += len(w.encode()) + 1
    found = [(-r.priority, m.start() - m.end(), k, m.start(), m.end()) for k, r in enumerate(RULES) for m in r.pattern.finditer(raw)]
    kept = []
    for p, _, k, a, b in sorted(found):
        if RULES[k].base or not any(c <= a and b <= d for q, c, d in kept if not RULES[q].base):
            kept.append((k, a, b))
    word = lambda x: sum(s <= x for s in starts) - 1
    return len(words), sorted(((k, word(a), word(b - 1) + 1) for k, a, b in kept), key=lambda d: (d[1], d[2], d[0]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([t for t, _ in CASES] + ["é ü", "cc", "by", "nc", "4.0", "all rights", "reserved", "general public license", "version 2", "or later", "\n\n", "the", "apache", "2.0"]), max_size=14))
def test_scan_equals_the_plain_search(parts):
    assert SCANNER.scan(" ".join(parts)) == plain_scan(" ".join(parts)) == SCANNER.scan(" ".join(parts), gate=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8)), max_size=30))
def test_cover(spans):
    cover, seen = license_scan.Cover(), []
    for a, n in spans:
        held = any(c <= a and a + n <= d for c, d in seen)
        assert cover.holds(a, a + n) == held
        if not held:
            cover.add(a, a + n)
            seen.append((a, a + n))


def test_license_scan_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " .,-\n"), (None, "All rights reserved"), (4, "cc by"), (4, "cc by"), (5, "CC-BY " * 2000), (6, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, detections string")
    got = [(r["doc_id"], r["n_words"], len(r["detections"]), round(r["score"], 3)) for r in license_scan.license_scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (None, 3, 1, 0.6), (4, 2, 1, 0.6), (4, 2, 1, 0.6), (5, 4000, 2000, 0.6), (6, 1, 0, 0)], key=str)
    assert license_scan.license_scan(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_op11_as_registered_against_the_plain_version(spark):
    want = {}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        n, found = plain_scan(r["text"] or "")
        base = [(RULES[k].label, a) for k, a, _ in found if RULES[k].base]
        at = [a for _, a in base]
        want[r["doc_id"]] = (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted({RULES[k].label for k, _, _ in found})))
    got = queries.QUERIES["op11_license_scan"](spark, DIR).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == want and all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert any(r["n_base"] for r in got)
