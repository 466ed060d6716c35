"""Licence scans against plain word lists and a recursive parser, and on odd rows."""

import random
import re

import pytest

from panelcast.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(text):
    words = WORD.findall(lowered(text))
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = {label for _, label in places}
    for phrase, label in (licenses.NOTICES | licenses.NAMES).items():
        if f" {phrase} " in f" {' '.join(words)} ":
            labels.add(label)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), labels


TEXTS = [
    None,
    "",
    " \t\n",
    "Released under the MIT License.",
    "mit-license MIT\n\tLICENSE, mit licenses; summit license mit license mit license",
    "the GNU Lesser General Public License, and the GNU General  Public\x00License",
    "Licensed under the Apache License, Version 2.0 (the apachelicense)",
    "Licensed under CC BY-NC 4.0.",
    "émit license, MIT licenseé mit license 中mit license",
    "general public general public license general public",
    "MIT",
    "x" * 200,
]


def test_base_equals_words_by_hand(spark, tmp_path):
    r = random.Random(2)
    bits = ["mit", "license", "License,", "general", "public", "apache", "gnu", "bsd", "é", "--", "\n", "the", "released", "under"]
    texts = TEXTS + [" ".join(r.choice(bits) for _ in range(r.choice([3, 40, 400]))) for _ in range(60)]
    texts.append("Filler words " * 200_000 + "mit license " * 20_000)
    rows = [(i % 40 if i else None, t, "x") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(4)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_licenses(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = got.collect()
    expected = [(i, *by_hand(t)) for i, t, _ in rows]
    assert sorted(str((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels)) for x in got) == sorted(str((*x[:6], ",".join(sorted(x[6])))) for x in expected)
    assert all(0 <= x.score <= 1 and (x.score > 0) == bool(x.labels) for x in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).count() == 0


def parsed(tokens):
    """Recursive descent over a whole well-formed expression: (labels, duty)."""

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            out = either()
            assert tokens.pop(0) == ")"
            return out
        label = licenses.family(tokens.pop(0))
        return {label}, licenses.FAMILIES[label]

    def excepted():
        labels, duty = atom()
        while tokens and tokens[0].lower() == "with":
            tokens.pop(0)
            atom()
            duty = min(duty, 1)
        return labels, duty

    def both():
        labels, duty = excepted()
        while tokens and tokens[0].lower() == "and":
            tokens.pop(0)
            more = excepted()
            labels, duty = labels | more[0], max(duty, more[1])
        return labels, duty

    def either():
        labels, duty = both()
        while tokens and tokens[0].lower() == "or":
            tokens.pop(0)
            more = both()
            labels, duty = labels | more[0], min(duty, more[1])
        return labels, duty

    return either()


def test_expressions_equal_recursive_parser():
    r = random.Random(1)
    names = ["MIT", "Apache-2.0", "GPL-2.0-or-later", "LGPL-3.0+", "AGPL-3.0-only", "BSD-3-Clause", "0BSD", "CC-BY-4.0", "CC0-1.0", "LicenseRef-x", "MPL-2.0"]

    def expression(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(names) + (" WITH Classpath-exception-2.0" if r.random() < 0.2 else "")
        inner = f" {r.choice(['AND', 'OR', 'and', 'or'])} ".join(expression(depth - 1) for _ in range(r.choice([2, 3])))
        return f"({inner})" if r.random() < 0.6 else inner

    for _ in range(400):
        text = expression(4)
        labels, duty = parsed(re.findall(r"[()]|[^() ]+", text))
        whole, bits, found = licenses.evaluate(text)
        assert (whole, {x for x in licenses.LABELS if bits & licenses.BIT[x]}, found) == (text, labels, duty)


@pytest.mark.parametrize(
    "line, labels, text",
    [
        ("// SPDX-License-Identifier: MIT OR GPL-2.0-only", "gpl,mit", "MIT OR GPL-2.0-only"),
        ("# spdx-license-identifier: (Apache-2.0 WITH LLVM-exception AND BSD-2-Clause) */", "apache,bsd", "(Apache-2.0 WITH LLVM-exception AND BSD-2-Clause)"),
        ("SPDX-License-Identifier: MIT and text that follows", "mit,other", "MIT and text"),
        ("SPDX-License-Identifier: MIT OR", "mit", "MIT"),
        ("SPDX-License-Identifier: (ISC AND (MIT", "isc,mit", "(ISC AND (MIT"),
        ('license-expression = "MPL-2.0"\nMIT', "mpl", "MPL-2.0"),
        ("SPDX-License-Identifier:\nMIT", "", None),
        ("SPDX-License-Identifier: OR MIT", "", None),
        ("SPDX-License-Identifier: MIT OR (", "mit", "MIT"),
    ],
)
def test_tags(line, labels, text):
    n, places, expressions, score = licenses.scan_text(f"before\n{line}", licenses.automaton())
    assert not places and [e[0] for e in expressions] == ([text] if text else [])
    assert ",".join(x for x in licenses.LABELS if expressions and expressions[0][1] & licenses.BIT[x]) == labels
    assert (score > 0.9) == bool(labels)
