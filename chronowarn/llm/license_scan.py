"""License detections by ordered signature rules with keyword gates and suppression of contained spans."""

from __future__ import annotations

import re
import re._parser as syntax
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Phrases of the base list with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Licenses with versions: label, name in normal form (lower-case words, one space), versions.
VERSIONED = (
    ("apache", r"apache(?: software)?", "1.0 1.1 2.0"),
    ("gpl", r"(?:gnu )?(?:gpl|general public)", "1.0 2.0 3.0"),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)", "2.0 2.1 3.0"),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public)", "1.0 3.0"),
    ("gfdl", r"(?:gnu )?(?:gfdl|fdl|free documentation)", "1.1 1.2 1.3"),
    ("mpl", r"(?:mpl|mozilla public)", "1.0 1.1 2.0"),
    ("epl", r"(?:epl|eclipse public)", "1.0 2.0"),
    ("eupl", r"(?:eupl|european union public)", "1.0 1.1 1.2"),
    ("cddl", r"(?:cddl|common development and distribution)", "1.0 1.1"),
    ("cpl", r"(?:cpl|common public)", "1.0"),
    ("osl", r"(?:osl|open software)", "1.0 2.0 2.1 3.0"),
    ("afl", r"(?:afl|academic free)", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", r"(?:perl )?artistic", "1.0 2.0"),
    ("bsl", r"(?:boost software)", "1.0"),
    ("busl", r"(?:busl|business source)", "1.1"),
    ("ofl", r"(?:ofl|(?:sil )?open font)", "1.0 1.1"),
    ("ms-pl", r"(?:ms pl|microsoft public)", "1.0"),
    ("odbl", r"(?:odbl|open (?:data commons open )?database)", "1.0"),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)", "1.0"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))", "1.0 2.0 2.5 3.0 4.0"),
)
# Licenses without versions: label, name.
PLAIN = (
    ("mit", r"(?:mit|expat)"), ("mit-0", r"mit 0"), ("isc", r"isc"), ("zlib", r"zlib(?: libpng)?"), ("x11", r"x11"),
    ("bsd-2-clause", r"(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2 clause"), ("bsd-3-clause", r"(?:3 clause|three clause|new|modified|revised) bsd|bsd 3 clause"),
    ("bsd-4-clause", r"(?:4 clause|four clause|original) bsd|bsd 4 clause"), ("bsd", r"bsd(?: style)?"), ("0bsd", r"(?:0bsd|zero clause bsd)"),
    ("unlicense", r"unlicense"), ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)"), ("postgresql", r"postgresql"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?"), ("openssl", r"openssl"), ("php", r"php"), ("psf", r"(?:python software foundation|psf|python)"),
    ("ruby", r"ruby"), ("vim", r"vim"), ("curl", r"curl"), ("json", r"json"), ("beerware", r"beer ?ware"),
    ("ecl", r"educational community"), ("upl", r"universal permissive"), ("nasa", r"nasa open source"), ("intel", r"intel(?: open source)?"),
    ("sleepycat", r"sleepycat"), ("zope", r"zope public"), ("w3c", r"w3c(?: software)?"), ("icu", r"(?:icu|unicode)"), ("imagemagick", r"imagemagick"),
)
# Statements that name no license: label, pattern, priority.
STATEMENTS = (
    ("all-rights-reserved", r"all rights reserved", 40), ("public-domain", r"(?:dedicated to|placed in|released into|in) the public domain", 50),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 30), ("proprietary", r"(?:proprietary and confidential|proprietary licen[sc]e)", 45),
    ("permission-notice", r"permission is hereby granted free of charge to any person obtaining a copy", 55),
    ("warranty-disclaimer", r"(?:provided )?as is without warrant(?:y|ies) of any kind", 35),
    ("unnamed", r"(?:licensed|released) under (?:the|a|an)? ?(?:\S+ ){1,4}licen[sc]e", 20),
)
# Sentences of license bodies and headers: label, pattern, priority.
BODIES = (
    ("apache", r"you may not use this file except in compliance with the license", 56),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 57),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 57),
    ("agpl", r"under the terms of the gnu affero general public license as published by the free software foundation", 57),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 56),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software", 57),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 57),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 56),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", 56),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 56),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", 57),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 57),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 56),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 56),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", 56),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 56),
    ("ofl", r"this font software is licensed under the sil open font license", 57),
    ("json", r"the software shall be used for good not evil", 56),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 57),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 57),
)
# Names that are words of their own: the word license before them says nothing.
WORDS_TOO = ("php", "psf", "ruby", "vim", "curl", "json", "intel", "icu", "x11", "openssl")
UNDER = r"(?:licensed|licenced|released|distributed|available|provided|published|covered|offered) under (?:the )?(?:terms (?:of|and conditions of) (?:the )?)?"
# Words that say little about which license is meant: a gate takes another word where the pattern has one.
FREQUENT = frozenset("under the terms of and conditions licensed licenced released distributed available provided published covered offered license licence version ver any later or "
                     "spdx identifier public software open common a an to in is this free permission copy use you may only option by nd sa nc non other".split())
FORMS = 32            # forms of a pattern up to which options are spelt out
MORE = "\1"           # stands for further words that may follow
LOOSE = "\0"          # stands for what a pattern leaves open; a word that touches it is no gate


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over words in lower case with one space between, only where the text has a word of ``gate``; an
    empty gate lets every text in."""
    name: str
    label: str
    priority: int
    pattern: re.Pattern
    gate: frozenset
    base: bool = False


def _forms(tree) -> list[str]:
    """Texts that a parsed pattern matches, one per choice of branches and short options, with ``LOOSE`` for parts that
    may vary further."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            parts = [chr(arg)]
        elif kind == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            parts = [chr(c) for _, c in arg]
        elif kind == "SUBPATTERN":
            parts = _forms(arg[3])
        elif kind == "BRANCH":
            parts = [f for branch in arg[1] for f in _forms(branch)]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == 0:
            parts = _forms(arg[2])
            if all(f.startswith(" ") for f in parts):
                parts = [MORE]
            else:
                parts = ["", *parts] if arg[1] == 1 and len(parts) == 1 and len(out) <= FORMS else [LOOSE]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [f + LOOSE for f in _forms(arg[2])]
        else:
            parts = [LOOSE]
        out = [a + b for a in out for b in parts]
    return out


def gate_of(pattern: str) -> frozenset:
    """Words of which every match of ``pattern`` has one, read off the pattern: per form its longest telling word."""
    words = set()
    for form in _forms(syntax.parse(pattern)):
        sure = [w for w in re.sub(MORE + "+(?= |$)", "", form).split(" ") if w and LOOSE not in w and MORE not in w]
        if not sure:
            return frozenset()
        words.add(max(sure, key=lambda w: (not re.fullmatch(r"v?\d+", w), w not in FREQUENT, len(w), w)))
    return frozenset(w.encode() for w in words)


def _rule(name, label, priority, pattern, base=False) -> Rule:
    return Rule(name, label, priority, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), gate_of(pattern), base)


def build_rules() -> tuple[Rule, ...]:
    """All rules in order: the base phrases, then for every license its identifier, statement, title, name and glued
    forms, then the sentences of license bodies and the statements that name none."""
    rules = [_rule(f"base-{label}", label, 65, phrase, base=True) for phrase, label in BASE]
    lic = r"(?: public)?(?: licen[sc]e)?"
    spdx = "spdx license identifier "
    for label, name, versions in VERSIONED:
        for version in versions.split():
            one = version.replace(".0", "(?: 0)?").replace(".", " ")
            full, tag = rf"{name}{lic}(?: version| ver| v)?(?: of)? v?{one}", f"{label}-{version}"
            words = f"{label} {version}".replace("-", " ").replace(".", " ")
            rules += [
                _rule(f"{tag}-spdx-later", f"{tag}-or-later", 96, rf"{spdx}{words} or later"),
                _rule(f"{tag}-spdx", tag, 95, rf"{spdx}{words}(?: only)?"),
                _rule(f"{tag}-or-later", f"{tag}-or-later", 92, rf"(?:{UNDER})?{full} or (?:at your option )?any later version"),
                _rule(f"{tag}-statement", tag, 90, rf"{UNDER}{full}(?: international| unported)?"),
                _rule(f"{tag}-title", tag, 80, rf"{full}(?: international| unported)?"),
            ]
            if "-" not in label:
                rules.append(_rule(f"{tag}-glued", tag, 80, rf"{label}v?{one}"))
        rules += [_rule(f"{label}-spdx", label, 94, rf"{spdx}{label.replace('-', ' ')}"), _rule(f"{label}-named", label, 60, rf"(?:{name}) licen[sc]e"),
                  _rule(f"{label}-under", label, 58, rf"{UNDER}(?:{name}){lic}")]
    for label, name in PLAIN:
        rules += [_rule(f"{label}-spdx", label, 95, rf"{spdx}{label.replace('-', ' ')}"), _rule(f"{label}-statement", label, 90, rf"{UNDER}(?:{name}) licen[sc]e"),
                  _rule(f"{label}-named", label, 60, rf"(?:{name}) licen[sc]e")]
        if label not in WORDS_TOO:
            rules.append(_rule(f"{label}-tagged", label, 70, rf"licen[sc]e (?:{name})"))
    rules += [_rule(f"body-{label}", label, priority, pattern) for label, pattern, priority in BODIES]
    rules += [_rule(f"says-{label}", label, priority, pattern) for label, pattern, priority in STATEMENTS]
    return tuple(rules)


def gate_index(rules: tuple[Rule, ...]) -> tuple[dict[bytes, list[int]], list[int]]:
    """Rules that each gate word opens, and those that are always open."""
    index: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules):
        for w in r.gate:
            index.setdefault(w, []).append(i)
    return index, [i for i, r in enumerate(rules) if not r.gate]


NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def scan(raw: bytes, rules: tuple[Rule, ...], index: dict[bytes, list[int]], always: list[int]) -> tuple[int, list[tuple]]:
    """Number of words, and detections (rule, label, priority, first word, word after the last, kept, base)."""
    words = raw.translate(NORMAL).split()
    open_rules = sorted({i for w in index.keys() & set(words) for i in index[w]}.union(always))
    if not open_rules or not words:
        return len(words), []
    text = b" " + b" ".join(words) + b" "
    spans, at, seen = [], 0, 0
    hits = sorted((m.start(), m.end(), i) for i in open_rules for m in rules[i].pattern.finditer(text))
    for start, end, i in hits:
        seen += text.count(b" ", at, start)
        at = start
        spans.append((seen - 1, seen + text.count(b" ", start, end), i))
    return len(words), resolve(spans, rules)


def resolve(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple]:
    """Mark as suppressed what lies inside a span of higher priority, or of equal priority if longer or earlier in the list."""
    furthest: dict[int, int] = {}
    out = []
    for start, stop, i in sorted(spans, key=lambda s: (s[0], -s[1], -rules[s[2]].priority, s[2])):
        r = rules[i]
        kept = not any(level >= r.priority and end >= stop for level, end in furthest.items())
        furthest[r.priority] = max(furthest.get(r.priority, 0), stop)
        out.append((r.name, r.label, r.priority, start, stop, kept, r.base))
    return out


DETECTION = "struct<rule:string,label:string,priority:int,first_word:long,stop_word:long,kept:boolean,base:boolean>"


def _run(rules):
    kind = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()),
                               ("stop_word", pa.int64()), ("kept", pa.bool_()), ("base", pa.bool_())]))
    names = [f.name for f in kind.value_type]
    index, always = gate_index(rules)

    def run(batches):
        for batch in batches:
            found = [scan(t.as_buffer().to_pybytes() if t.is_valid else b"", rules, index, always) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in found], pa.int64()),
                pa.array([[dict(zip(names, d)) for d in ds] for _, ds in found], kind)], ["doc_id", "n_words", "detections"])
    return run


def license_scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Detections in every row of ``docs`` (doc_id, text): doc_id, n_words, detections, labels, score.

    Whole texts are lower-cased (A-Z) and taken as words of digits, letters and non-ASCII characters.  A rule's regex
    runs only where its gate words occur.  Overlapping detections are all reported with their word span; ``kept`` is
    false for one that lies inside a detection of higher priority.  labels: distinct labels of kept and of base
    detections, sorted.  score: priority / 100 of the strongest kept detection, 0 without any.

    One narrow pass without shuffle.  Null or empty text: no words, no detections; null doc_id stays; repeated rows
    give equal results; empty input gives no rows; extra columns are ignored.
    """
    rules = build_rules() if rules is None else rules
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_run(rules), f"doc_id long, n_words long, detections array<{DETECTION}>")
    shown = F.filter("detections", lambda d: d["kept"] | d["base"])
    return out.select(
        "doc_id", "n_words", "detections", F.array_sort(F.array_distinct(F.transform(shown, lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.filter("detections", lambda d: d["kept"]), lambda d: d["priority"])) / 100.0, F.lit(0.0)).alias("score"))
