import random
import re
import re._parser as syntax

from chronowarn.llm.license_scan import BASE, build_rules, gate_index, license_scan, scan
from chronowarn.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """All rules on all texts without gates, suppression by comparing every pair of detections."""
    words = words_of(text)
    line, found = " " + " ".join(words) + " ", []
    for i, r in enumerate(build_rules()):
        for m in re.finditer(r.pattern.pattern.decode(), line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r.priority, i, r))
    kept = [d for d in found if not any(
        e is not d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3])) for e in found)]
    return len(words), found, kept


def test_gated_scan_equals_ungated_rules(docs_of):
    texts = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3 or any later version.",
             "mit license MIT License; Apache license", "CC BY-NC 4.0 by Creative Commons Attribution-NonCommercial 4.0 International", "Mit der Lizenz under apache",
             "SPDX-License-Identifier: MPL-2.0 and BSD 3-Clause license. Copyright (c) 2019 2020 X. All rights reserved.", None, "", "the MIT\n\nLicense"]
    got = {r["doc_id"]: r for r in license_scan(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        n, found, kept = brute(text)
        row = got[i]
        assert row["n_words"] == n
        assert sorted((d["first_word"], d["stop_word"], d["rule"]) for d in row["detections"]) == sorted((d[0], d[1], d[4].name) for d in found)
        assert sorted((d["first_word"], d["rule"]) for d in row["detections"] if d["kept"]) == sorted((d[0], d[4].name) for d in kept)
        assert row["score"] == max([d[2] / 100 for d in kept], default=0.0)
    assert "apache-2.0" in got[0]["labels"] and "gpl-3.0-or-later" in got[1]["labels"] and "mpl-2.0" in got[5]["labels"]


def test_query_base_columns_equal_word_search(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op1_license_scan"](spark, FOLDER).collect():
        words = words_of(texts[r["doc_id"]])
        places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_awkward_rows(awkward, docs_of):
    assert license_scan(awkward).count() == awkward.count()
    assert license_scan(docs_of([])).collect() == []
    assert len(build_rules()) > 300


def made(tree, rng):
    """A text that a parsed pattern matches, with every choice drawn at random."""
    out = ""
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            first, value = rng.choice(arg)
            out += chr(value) if str(first) == "LITERAL" else rng.choice("0123456789") if "DIGIT" in str(value) and "NOT" not in str(value) else rng.choice("xyz")
        elif kind == "SUBPATTERN":
            out += made(arg[3], rng)
        elif kind == "BRANCH":
            out += made(rng.choice(arg[1]), rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(made(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
    return out


def test_every_rule_opens_its_own_gate():
    """Texts made from every rule's pattern: the gated scan finds what all rules without gates find."""
    rng, rules = random.Random(1), build_rules()
    index, always = gate_index(rules)
    open_all = list(range(len(rules)))
    for r in rules:
        tree = syntax.parse(r.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )"))
        for _ in range(4):
            text = made(tree, rng).encode()
            found = scan(text, rules, index, always)
            assert r.name in {d[0] for d in found[1]}, (r.name, text)
            assert found == scan(text, rules, {}, open_all)
    assert sum(not r.gate for r in rules) == 0


def test_common_notations(docs_of):
    want = {"gpl v3": "gpl-3.0", "GNU GPL version 3": "gpl-3.0", "LGPL 2.1": "lgpl-2.1", "released under the GPLv3": "gpl-3.0", "license: MIT": "mit", "SPDX-License-Identifier: ECL-2.0": "ecl",
            "SPDX-License-Identifier: UPL-1.0": "upl", "SPDX-License-Identifier: MS-PL": "ms-pl", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later", "SPDX-License-Identifier: MIT-0": "mit-0",
            "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc"}
    got = {r["doc_id"]: r["labels"] for r in license_scan(docs_of(list(enumerate(want)))).collect()}
    assert {text: got[i] for i, text in enumerate(want)} == {text: [label] for text, label in want.items()}
