"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and read as words. A cheap look for stems keeps most texts
from any rule; in the rest, a rule runs only if one of its keywords is one of the words.
Every text that a rule matches holds one of its keywords. What the rules find is ordered by priority, then length, then place, and a detection inside
an accepted one is suppressed. The three base phrases are found at all their places and
are never suppressed.

A null or empty text has no words, no labels and score 0; rows that repeat give the same
result each. Texts are read whole at any length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, functions as F

from brightrow.llm.common import annotate, groups, joined

PHRASES = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

# Words of the contract: letters a-z after lower-casing, digits, and every byte beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IN_WORD = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IN_WORD[_low : _high + 1] = True

# Families: label, keywords of the name (one in every alternative), name as words (regular
# expression), short form, versions. The first word of the short form is the keyword of its rules.
FAMILIES = (
    ("apache", "apache", "apache(?: software)?(?: foundation)?", "apache", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit expat x11", "(?:mit|expat|x11)", "mit", ()),
    ("bsd", "bsd", "(?:(?:new|modified|revised|simplified) )?bsd", "bsd", ("0 clause", "1 clause", "2 clause", "3 clause", "4 clause")),
    ("isc", "isc consortium", "(?:isc|internet systems consortium)", "isc", ()),
    ("lgpl", "lesser library", "(?:gnu )?(?:lesser|library) general public", "lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "affero", "(?:gnu )?affero general public", "agpl", ("1 0", "3 0", "3")),
    ("gpl", "gpl general", "(?:gnu )?(?:gpl|general public)", "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gnu", "gnu (?:gpl|general public)", "gnu gpl", ("1", "2", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", "mozilla public", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse (?:public|distribution)", "epl", ("1 0", "2 0")),
    ("cddl", "development cddl", "(?:common development and distribution|cddl)", "cddl", ("1 0", "1 1")),
    ("cpl", "common cpl", "(?:common public|cpl)", "cpl", ("1 0",)),
    ("ipl", "ibm", "ibm public", "ipl", ("1 0",)),
    ("eupl", "european eupl", "(?:european union public|eupl)", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", "(?:clarified )?artistic", "artistic", ("1 0", "2 0")),
    ("boost", "boost", "boost(?: software)?", "bsl", ("1 0",)),
    ("zlib", "zlib", "(?:zlib|zlib libpng)", "zlib", ()),
    ("unlicense", "unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "fuck wtfpl", "(?:do what the fuck you want to public|wtfpl)", "wtfpl", ("1", "2")),
    ("python", "python", "python(?: software foundation)?", "psf", ("2", "2 0")),
    ("php", "php", "php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby", "ruby", ()),
    ("openssl", "openssl ssleay", "(?:openssl|ssleay)", "openssl", ()),
    ("ofl", "sil", "sil open font", "ofl", ("1 0", "1 1")),
    ("ecl", "educational", "educational community", "ecl", ("1 0", "2 0")),
    ("afl", "academic", "academic free", "afl", ("2 0", "2 1", "3 0")),
    ("osl", "open osl", "(?:open software|osl)", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("msl", "microsoft", "microsoft (?:public|reciprocal)", "ms pl", ()),
    ("odbl", "open odbl", "(?:open database|open data commons(?: open database)?|odbl)", "odbl", ("1 0",)),
    ("odc-by", "attribution odc", "(?:open data commons attribution|odc by)", "odc by", ("1 0",)),
    ("postgresql", "postgresql", "postgresql", "postgresql", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa", "ncsa", ()),
    ("upl", "permissive upl", "(?:universal permissive|upl)", "upl", ("1 0",)),
    ("elastic", "elastic", "elastic", "elastic", ("1 0", "2 0")),
    ("sspl", "server sspl", "(?:server side public|sspl)", "sspl", ("1 0", "1")),
    ("busl", "business", "business source", "busl", ("1 0", "1 1")),
    ("rail", "rail", "(?:open|creativeml|bigscience|bigcode)(?: open)? rail(?: m)?", "openrail", ()),
)
# Creative Commons parts: label, words of the short form, words of the long form.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Single signatures: label, keywords (one in every match), expression, score.
SINGLE = (
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.95),
    ("cc0", "zero", "creative commons zero(?: 1 0)?(?: universal)?", 0.95),
    ("public-domain", "domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.9),
    ("public-domain", "domain", "public domain", 0.6),
    ("reserved", "rights", "(?:all|some|no) rights reserved", 0.8),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 0.7),
    ("copyright", "copyrighte copyrighted", "copyrighted?(?: c)? by", 0.6),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "warranty", "the software is provided as is without warranty of any kind", 0.8),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 1.0),
    ("apache", "except", "you may not use this file except in compliance with the license", 1.0),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1.0),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("proprietary", "prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this file)?(?: \\S+){0,6} is (?:strictly )?prohibited", 0.9),
    ("noncommercial", "commercial noncommercial", "(?:for )?non ?commercial (?:use|purposes) only", 0.7),
    ("eula", "eula", "eula", 0.5),
    ("eula", "user", "end user license agreement", 0.7),
)
# Forms a family's name stands in: expression, whether it takes a version, priority, score.
FORMS = (
    (r"spdx license identifier {short} {version}(?: only| or later)?", True, 90, 1.0),
    (r"spdx license identifier {short}(?: only| or later)?", False, 88, 1.0),
    (r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?: public)? licen[cs]e (?:version |v)?{version}", True, 80, 1.0),
    (r"{name}(?: public)? licen[cs]e (?:version |v)?{version}", True, 70, 0.95),
    (r"{short} v?{version}", True, 60, 0.8),
    (r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?: public)? licen[cs]e", False, 50, 0.95),
    (r"{name} licen[cs]e", False, 40, 0.9),
)
# Each stem is part of some word of every signature; a text without any stem is skipped.
STEMS = (b"licen", b"reserved", b"copyright", b"domain", b"spdx", b"commons", b"proprietary", b"rail")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    expression: re.Pattern
    priority: int
    score: float

    @property
    def keyword(self) -> bytes:
        """The first of the keywords."""
        return self.keywords[0]


@cache
def rules() -> tuple[Rule, ...]:
    """All signatures, from the families in every form and version, the Commons and the single ones."""
    out = []

    def add(label, keywords, expression, priority, score):
        framed = re.compile(rb"(?<= )(?:" + expression.encode() + rb")(?= )")
        out.append(Rule(label, tuple(keywords.encode().split()), framed, priority, score))

    for label, of_name, name, short, versions in FAMILIES:
        for form, versioned, priority, score in FORMS:
            keywords = short.split()[0] if "{short}" in form else of_name
            for version in versions if versioned else ("",):
                add(label, keywords, form.format(name=name, short=short, version=version), priority, score)
    for label, short, long in COMMONS:
        for version in COMMONS_VERSIONS:
            add(label, "cc", f"cc {short} {version}", 85, 1.0)
            add(label, "commons", f"creative commons {long}(?: international)?(?: licen[cs]e)? {version}", 85, 1.0)
        add(label, "cc", f"cc {short}", 45, 0.85)
        add(label, "commons", f"creative commons {long}", 45, 0.9)
    for label, keywords, expression, score in SINGLE:
        add(label, keywords, expression, 65, score)
    return tuple(out)


@cache
def _by_keyword() -> dict[bytes, tuple[int, ...]]:
    found: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        for keyword in rule.keywords:
            found.setdefault(keyword, []).append(i)
    return {k: tuple(v) for k, v in found.items()}


@cache
def _stem() -> tuple[bytes, ...]:
    """The fixed stems, and keywords that may stand in a text without any of them."""
    more = {k for r in rules() if not any(s in r.expression.pattern for s in STEMS) for k in r.keywords}
    return tuple(sorted({*STEMS, *more, b"cc"}))


class _Line:
    """Words between single spaces, and which word begins at a place."""

    def __init__(self, words: list[bytes]):
        self.text = b" " + b" ".join(words) + b" "
        self.spaces = np.flatnonzero(np.frombuffer(self.text, dtype=np.uint8) == 0x20)

    def spaces_before(self, places: list[int]) -> np.ndarray:
        return np.searchsorted(self.spaces, places)


def detect(words: list[bytes]) -> list[tuple[int, int, str, float]]:
    """Accepted detections as (first word, end word, label, score), by place."""
    chosen = sorted({i for w in _by_keyword().keys() & set(words) for i in _by_keyword()[w]})
    if not chosen:
        return []
    line, raw, places = _Line(words), [], []
    for i in chosen:
        rule = rules()[i]
        for m in rule.expression.finditer(line.text):
            places.append(m.start())
            raw.append((-rule.priority, -m[0].count(b" ") - 1, rule.label, rule.score))
    firsts = (line.spaces_before(places) - 1).tolist()
    return suppress([(p, s, first, *rest) for (p, s, *rest), first in zip(raw, firsts)], len(words))


def suppress(raw: list[tuple[int, int, int, str, float]], n_words: int) -> list[tuple[int, int, str, float]]:
    """Of (minus priority, minus size, first word, label, score), in this order, those in no accepted one.

    Those of one priority and size are told at once: they can only hold equal ones of their
    own. ``reach`` has for each word the last end of what was accepted up to it.
    """
    accepted: list[tuple[int, int, str, float]] = []
    reach = np.zeros(n_words + 1, dtype=np.int64)
    for (_, size), members in groupby(sorted(raw), key=lambda r: r[:2]):
        members = list(members)
        first = np.array([m[2] for m in members], dtype=np.int64)
        ends = first - size
        fresh = reach[first] < ends
        fresh[1:] &= first[1:] != first[:-1]
        for k in np.flatnonzero(fresh).tolist():
            accepted.append((members[k][2], int(ends[k]), *members[k][3:]))
        np.maximum.at(reach, first[fresh], ends[fresh])
        np.maximum.accumulate(reach, out=reach)
    return sorted(accepted)


def _phrases(words: list[bytes]) -> list[tuple[int, str]]:
    line, places, labels = _Line(words), [], []
    for phrase, label in PHRASES.items():
        framed = b" " + phrase + b" "
        at = line.text.find(framed)
        while at >= 0:
            places.append(at)
            labels.append(label)
            at = line.text.find(framed, at + 1)
    return list(zip(line.spaces_before(places).tolist(), labels))


def count_words(texts: list[bytes]) -> list[int]:
    """Words per text."""
    out: list[int] = []
    for low, high in groups(texts):
        data, starts = joined(texts[low:high], b"\x00")
        inside = IN_WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        total = np.concatenate([[0], np.cumsum(begins)])
        out += np.diff(total[starts]).tolist()
    return out


def _work(texts: list[bytes | None]):
    whole = [t or b"" for t in texts]
    found, base = [], []
    for text in whole:
        low = text.lower()
        if not any(s in low for s in _stem()):
            found.append([])
            base.append([])
            continue
        words = WORD.findall(low)
        found.append(detect(words))
        base.append(_phrases(words))
    return count_words(whole), found, base


def _digest(texts: list[bytes | None]):
    counts, found, base = _work(texts)
    label = lambda names: ",".join(sorted(set(names)))
    return (
        counts,
        [len(b) for b in base],
        [min((w for w, _ in b), default=None) for b in base],
        [max((w for w, _ in b), default=None) for b in base],
        [label(x for _, x in b) for b in base],
        [label([*(x for _, x in b), *(x for _, _, x, _ in f)]) for f, b in zip(found, base)],
        [max([*(s for _, _, _, s in f), *(0.8 for _ in b)], default=0.0) for f, b in zip(found, base)],
    )


def find_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``detections``: array of (first_word, end_word, label, score), by place."""

    def work(texts):
        _, found, _ = _work(texts)
        return tuple([[d[i] for d in f] for f in found] for i in range(4))

    parts = "_first array<long>, _end array<long>, _label array<string>, _score array<double>"
    out = annotate(df, text, keep, parts, work)
    names = {"_first": "first_word", "_end": "end_word", "_label": "label", "_score": "score"}
    return out.withColumn("detections", F.arrays_zip(*[F.col(a).alias(b) for a, b in names.items()])).drop(*names)


def license_report(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word count, base phrases, all labels and the best score per text."""
    return annotate(
        df,
        text,
        keep,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
        _digest,
    )
