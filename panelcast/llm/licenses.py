"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm.text import slices

# Phrases in lower-case words, and what each stands for.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# How much a phrase alone speaks for a licence notice: a whole notice, or a mere name.
NOTICE, NAME, TAGGED = 0.9, 0.6, 0.99
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "under the terms of the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1 0": "bsl",
    "licensed under cc by": "cc",
    "licensed under a creative commons": "cc",
    "creative commons attribution": "cc",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
}
NAMES = {
    "bsd license": "bsd",
    "new bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "creative commons zero": "cc0",
    "cc by nc": "cc",
    "cc by sa": "cc",
    "cc by nd": "cc",
    "cc by 4 0": "cc",
    "gnu gpl": "gpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgplv3": "lgpl",
    "agplv3": "agpl",
}
TAGS = ("spdx license identifier", "spdx licenseidentifier", "license expression", "spdx license expression")
# Families of licence identifiers by how they begin, and what they ask for: 0 little, 1 their own files, 2 whole works, 3 services too.
FAMILIES = {
    "agpl": 3,
    "lgpl": 1,
    "gpl": 2,
    "apache": 0,
    "mit": 0,
    "bsd": 0,
    "0bsd": 0,
    "mpl": 1,
    "isc": 0,
    "cc0": 0,
    "cc": 0,
    "epl": 1,
    "eupl": 2,
    "cddl": 1,
    "unlicense": 0,
    "bsl": 0,
    "zlib": 0,
    "artistic": 1,
    "other": 2,
}
ALIASES = {"0bsd": "bsd"}

LABELS = sorted({*FAMILIES, *BASE_PHRASES.values(), *NOTICES.values(), *NAMES.values()} - {*ALIASES})
BIT = {label: 1 << i for i, label in enumerate(LABELS)}
PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9.+:-]+))")
BINDS = {"or": 1, "and": 2, "with": 3}


def words(text: str) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


def family(identifier: str) -> str:
    """The label of a licence identifier, whatever its version: gpl for GPL-2.0-or-later; ``other`` if unknown."""
    name = identifier.lower()
    known = next((f for f in FAMILIES if re.match(rf"{f}(?![a-z0-9])", name)), "other")
    return ALIASES.get(known, known)


def evaluate(expression: str) -> tuple[str, int, int] | None:
    """The expression that ``expression`` begins with, its labels as bits and what it asks for; None without an operand.

    Two stacks hold operands and operators: ``with`` binds before ``and``, ``and`` before ``or``. Of
    ``a or b`` the milder duty counts, of ``a and b`` the stricter; an exception makes a duty on whole works
    one on files. The expression ends where a token does not fit; operators without a right side fall
    away, and parentheses left open are closed.
    """
    values: list[tuple[int, int]] = []
    operators: list[str] = []

    def apply() -> None:
        operator = operators.pop()
        if operator == "(":
            return
        (a, x), (b, y) = values[-2:]
        del values[-2:]
        if operator == "with":
            values.append((a, min(x, 1)))
        else:
            values.append((a | b, min(x, y) if operator == "or" else max(x, y)))

    at, end, operand, depth = 0, 0, True, 0
    while token := TOKEN.match(expression, at):
        bracket, name = token.groups()
        binds = BINDS.get((name or "").lower(), 0)
        if operand:
            if bracket == ")" or binds:
                break
            if bracket:
                operators.append("(")
                depth += 1
            else:
                label = family(name)
                values.append((BIT[label], FAMILIES[label]))
                operand, end = False, token.end()
        elif bracket == ")":
            if not depth:
                break
            while operators[-1] != "(":
                apply()
            operators.pop()
            depth, end = depth - 1, token.end()
        elif binds:
            while operators and operators[-1] != "(" and BINDS[operators[-1]] >= binds:
                apply()
            operators.append(name.lower())
            operand = True
        else:
            break
        at = token.end()
    if not values:
        return None
    waiting = sum(o != "(" for o in operators) - len(values) + 1
    while waiting > 0:  # operators without a right side
        waiting -= operators.pop() != "("
    while operators:
        apply()
    return expression[:end].strip(), *values[-1]


def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, each between spaces: (label, base, words, weight), label None for a tag."""
    found: dict[str, tuple] = {}
    for phrases, base, weight in ((NAMES, False, NAME), (NOTICES, False, NOTICE), (BASE_PHRASES, True, NAME)):
        found |= {p: (label, base, len(p.split()), weight) for p, label in phrases.items()}
    found |= {p: (None, False, len(p.split()), TAGGED) for p in TAGS}
    a = ahocorasick.Automaton()
    for phrase, value in found.items():
        a.add_word(f" {phrase} ", (phrase, *value))
    a.make_automaton()
    return a


def _after(text: str, wanted: list[int]) -> list[str]:
    """What stands on the line behind each of the numbered words, without a colon, equals sign or quote before it."""
    data = text.encode("utf-8", "surrogatepass")
    solid = np.frombuffer(data.translate(PLAIN), np.uint8) != 32
    ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
    out = []
    for k in wanted:
        stop = data.find(b"\n", ends[k])
        line = data[ends[k] : len(data) if stop < 0 else stop].decode("utf-8", "replace")
        out.append(re.sub(r"^[ \t]*[:=]?[ \t\"'`]*", "", line))
    return out


def scan_text(text: str, phrases: ahocorasick.Automaton) -> tuple[int, list[tuple], list[tuple], float]:
    """Words, places (label, base, first word, words), expressions (text, bits, duty) and score of one text."""
    found = words(text)
    line = f" {b' '.join(found).decode('utf-8', 'replace')} "
    places, tags, weights, at, seen = [], [], {}, 0, 0
    for last, (phrase, label, base, n, weight) in phrases.iter(line):
        seen, at = seen + line.count(" ", at, last), last
        start = seen - n
        if label is None:
            tags.append(start + n - 1)
        else:
            places.append((label, base, start, n))
            weights[phrase] = weight
    expressions = [e for e in map(evaluate, _after(text, sorted(set(tags))) if tags else []) if e]
    doubt = 1.0
    for weight in [weights[p] for p in sorted(weights)] + [TAGGED] * len(expressions):
        doubt *= 1 - weight
    return len(found), places, expressions, 1 - doubt


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every document with n_words, places, expressions, labels and score.

    ``places``: every phrase that stands in the text word for word, as (label, base, start, words), whether it is
    one of the base phrases, its first word (from 0) and number of words. ``expressions``: what follows
    identifier tags, as (text, labels, duty), see ``evaluate``. ``labels``: all of these, distinct and sorted.
    ``score``: 1 minus the product of what each distinct phrase and each expression leaves in doubt.

    One automaton over all phrases reads each whole text once, whatever their number. Nothing is
    shuffled. Null and empty texts have no words and score 0; rows that repeat a key, and null keys, are
    documents of their own; an empty table gives none. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    place = "struct<label string, base boolean, start long, words long>"
    expression = "struct<text string, labels array<string>, duty int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        place_type = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int64())])
        expression_type = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("duty", pa.int32())])
        named = lambda bits: [label for label in LABELS if bits & BIT[label]]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [scan_text(t or "", phrases) for t in part.column("text").to_pylist()]
                bits = [reduce(or_, [BIT[p[0]] for p in r[1]] + [e[1] for e in r[2]], 0) for r in rows]
                columns = {
                    "key": part.column("key"),
                    "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "places": pa.array([[dict(zip(("label", "base", "start", "words"), p, strict=True)) for p in r[1]] for r in rows], pa.list_(place_type)),
                    "expressions": pa.array([[{"text": e[0], "labels": named(e[1]), "duty": e[2]} for e in r[2]] for r in rows], pa.list_(expression_type)),
                    "labels": pa.array([named(b) for b in bits], pa.list_(pa.string())),
                    "score": pa.array([r[3] for r in rows], pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    d = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    out = d.mapInArrow(run, f"key {kind}, n_words long, places array<{place}>, expressions array<{expression}>, labels array<string>, score double")
    return out.withColumnRenamed("key", key)

