"""License scans: Aho-Corasick over whole texts, a shunting-yard parser for licence expressions.

One automaton holds every notice phrase, as words between blanks.  A text
is reduced to its words (A-Z lower-cased; a word is a run of 0-9, a-z and
characters beyond ASCII) joined by single blanks, and the automaton reports
every place of every phrase.  A second automaton finds identifier tags in
the raw text; the expression after a tag (to the line's end) is parsed by
the shunting-yard method and evaluated: ``or`` takes the most permissive
choice, ``and`` the least permissive part, ``with`` adds an exception.

Labels: the base labels of the four base phrases, and the method's own:
``spdx:<id>`` for each identifier of a tag, ``with:<exception>``, a class
``permissive``, ``weak-copyleft``, ``copyleft``, ``restricted`` or
``unknown`` of each expression, and the labels of further notice phrases.

The score is 1 - product of (1 - weight) over the places found; a tag
weighs 0.95, a notice phrase 0.6 and a base phrase 0.5.

Defined results: null text is the empty text (no words, score 0); repeated
rows give one row each; an expression that doesn't parse gives the class
``unknown`` and every identifier in it whose class is known; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The method's own notice phrases.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "creative commons": "creative-commons",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit-text",
    "redistribution and use in source and binary forms": "bsd-text",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Permissiveness by the start of an identifier; the longest start counts.
CLASSES = {
    "mit": 3, "bsd": 3, "apache": 3, "isc": 3, "zlib": 3, "unlicense": 3, "cc0": 3, "cc-by": 3, "0bsd": 3,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2, "cc-by-sa": 1, "gpl": 1, "agpl": 1,
    "cc-by-nc": 0, "cc-by-nd": 0, "busl": 0, "proprietary": 0,
}
CLASS_NAMES = {3: "permissive", 2: "weak-copyleft", 1: "copyleft", 0: "restricted", None: "unknown"}
OPERATORS = {"or": 1, "and": 2, "with": 3}
TAG_WEIGHT, NOTICE_WEIGHT, BASE_WEIGHT = 0.95, 0.6, 0.5

#: ASCII signs, blanks and controls become blanks; bytes of words stay.
_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SYMBOL = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression's symbols in postfix order; raises ValueError if it doesn't parse."""
    text = expression.lower()
    if _SYMBOL.sub("", text).strip():
        raise ValueError("a sign that no licence expression has")
    out, held, operand = [], [], False
    for s in _SYMBOL.findall(text):
        if s == "(":
            if operand:
                raise ValueError("a bracket after a licence")
            held.append(s)
        elif s == ")":
            if not operand:
                raise ValueError("nothing before a bracket")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("a bracket too many")
            held.pop()
        elif s in OPERATORS:
            if not operand:
                raise ValueError(f"nothing before {s}")
            while held and held[-1] != "(" and OPERATORS[held[-1]] >= OPERATORS[s]:
                out.append(held.pop())
            held.append(s)
            operand = False
        else:
            if operand:
                raise ValueError("two licences without an operator")
            out.append(s)
            operand = True
    if not operand:
        raise ValueError("the expression ends early")
    while held:
        if held[-1] == "(":
            raise ValueError("an open bracket")
        out.append(held.pop())
    return out


def class_of(identifier: str) -> int | None:
    starts = [s for s in CLASSES if identifier.startswith(s)]
    return CLASSES[max(starts, key=len)] if starts else None


def evaluate(expression: str) -> tuple[set[str], int | None]:
    """Labels and permissiveness (3 to 0, None unknown) of an expression."""
    labels: set[str] = set()
    stack: list[tuple[int | None, str | None]] = []
    for s in postfix(expression):
        if s not in OPERATORS:
            stack.append((class_of(s), s))
            continue
        (right, name), (left, own) = stack.pop(), stack.pop()
        if s == "with":
            if name is None or own is None:
                raise ValueError("with takes a licence and an exception")
            labels.add(f"with:{name}")
            labels.add(f"spdx:{own}")
            # an exception relaxes copyleft by one class
            stack.append((None if left is None else max(left, min(left + 1, 2)), None))
            continue
        labels.update(f"spdx:{n}" for n in (own, name) if n)
        known = [v for v in (left, right) if v is not None]
        if s == "or":
            stack.append((max(known, default=None), None))
        else:
            stack.append((min(known) if len(known) == 2 else None, None))
    value, name = stack.pop()
    if name:
        labels.add(f"spdx:{name}")
    return labels, value


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None):
        import ahocorasick
        self.phrases = ahocorasick.Automaton()
        own = NOTICES if notices is None else notices
        for phrase, label in {**own, **BASE}.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """``(n_words, n_base, first_word, last_word, base_labels, labels, score)``."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: lowers A-Z alone
        words = raw.translate(_TO_WORDS).split()
        line = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte
        n_base, starts, base, labels, rest = 0, [], set(), set(), 1.0
        for end, (size, label, is_base) in self.phrases.iter(line):
            labels.add(label)
            rest *= 1 - (BASE_WEIGHT if is_base else NOTICE_WEIGHT)
            if is_base:
                n_base += 1
                base.add(label)
                starts.append(end - size + 1)
        first = last = None
        if starts:
            first, last = line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))
        plain = raw.decode("latin-1")
        for end, _ in self.tags.iter(plain):
            rest *= 1 - TAG_WEIGHT
            stop = plain.find("\n", end)
            expression = plain[end + 1:stop if stop >= 0 else len(plain)].strip(" \t\r*/#-<>!.;,")
            try:
                found, value = evaluate(expression)
            except ValueError:
                found, value = {f"spdx:{s}" for s in _SYMBOL.findall(expression)
                                if s not in OPERATORS and s not in "()" and class_of(s) is not None}, None
            labels |= found | {CLASS_NAMES[value]}
        return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - rest)


_SCANNERS: list[Scanner] = []


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Scans ``docs(doc_id, text)`` in one pass over the scan, without an exchange."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for pdf in parts:
            out = pd.DataFrame([_SCANNERS[0].scan(t) for t in pdf["text"]], columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64",
                              "base_labels": object, "labels": object, "score": float})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                          "base_labels string, labels string, score double")


def license_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op4: every document."""
    return scan_licenses(docs)
