import re

import pytest
from helpers import awkward, documents, with_clashes

from fundflow.llm import licenses as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in L.BASE.items() for p in [phrase.split()]
              for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


TEXTS = ["Released under the MIT License. mit-license MIT\n LICENSE", "GNU General  Public,License; Apache\x00License CC-BY cc by 4.0",
         "éMIT License MITé License mit license", "CC BY CC BY", "SPDX-License-Identifier: MIT OR GPL-2.0-only WITH Classpath-exception-2.0\nrest",
         "// spdx-license-identifier: (Apache-2.0 AND (", "All rights reserved. permission is hereby granted, free of charge"]


def test_base_columns_against_a_plain_search(spark):
    texts, ids, sources = awkward()
    texts += TEXTS
    ids += range(100, 100 + len(TEXTS))
    got = L.scan_licenses(with_clashes(documents(spark, texts, ids))).collect()
    assert sorted((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.first_word is not None) == \
        sorted(b for b in map(base, texts) if b[2] is not None)
    assert sorted((r.n_words, r.n_base) for r in got) == sorted(base(t)[:2] for t in texts)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert L.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text, want", [
    ("MIT", ({"spdx:mit"}, 3)),
    ("MIT OR GPL-3.0-only", ({"spdx:mit", "spdx:gpl-3.0-only"}, 3)),
    ("MIT AND GPL-3.0-only", ({"spdx:mit", "spdx:gpl-3.0-only"}, 1)),
    ("MIT OR GPL-3.0-only AND MPL-2.0", ({"spdx:mit", "spdx:gpl-3.0-only", "spdx:mpl-2.0"}, 3)),
    ("(MIT OR GPL-3.0-only) AND LGPL-2.1", ({"spdx:mit", "spdx:gpl-3.0-only", "spdx:lgpl-2.1"}, 2)),
    ("GPL-2.0 WITH Classpath-exception-2.0", ({"spdx:gpl-2.0", "with:classpath-exception-2.0"}, 2)),
])
def test_expressions(text, want):
    assert L.evaluate(text) == want


@pytest.mark.parametrize("text", ["", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT GPL", "MIT & GPL", "()"])
def test_broken_expressions(text):
    with pytest.raises(ValueError):
        L.evaluate(text)


def test_tag_labels():
    labels = L.Scanner().scan(TEXTS[4])[5].split(",")
    assert {"spdx:mit", "spdx:gpl-2.0-only", "with:classpath-exception-2.0", "permissive"} <= set(labels)
    assert "unknown" in L.Scanner().scan(TEXTS[5])[5].split(",")


NAMES = [f"{s}-{k}.0" for s in ("mit", "bsd", "gpl", "mpl", "apache") for k in range(1, 5)]


@pytest.mark.parametrize("expression", [", ".join(NAMES), " ".join(NAMES), "((" + " OR ".join(NAMES) + ") AND (isc OR zlib",
                                        "( ( ( ( ( ( ( ( ( " + " AND ".join(NAMES)])
def test_broken_expressions_keep_every_identifier(expression):
    labels = L.Scanner().scan(f"SPDX-License-Identifier: {expression.upper()}\nMIT-9")[5].split(",")
    want = {f"spdx:{n}" for n in NAMES} | ({"spdx:isc", "spdx:zlib"} if "isc" in expression else set())
    assert set(labels) == want | {"unknown"}
