"""Licence scan: one automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions.

A text is lower-cased (A-Z) and read as words of letters, digits and bytes above
0x7F; a phrase is found where its words stand one after another, overlaps
included. After the tag ``SPDX-License-Identifier:`` the rest of the line is read
as an expression of and / or / with; its label set is the one that the
expression grants: all operands of ``and``, the first (preferred) operand of
``or`` by permissiveness, and the identifier before ``with``.

Defined results: a null text is empty: no words, no labels, score 0. Each input
row gives one row, repeated rows and null ids too. Malformed expressions give
the labels of the known identifiers in them. Known are those of the SPDX list and
``LicenseRef-`` names; one without a label in IDENTIFIERS is its own label, in
lower case, and comes after all of those in the order of permissiveness.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts
from tessera.llm.spdx import NAMES

# Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases and their labels.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "isc license": "isc",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
# Licence identifiers of expressions, most permissive first, and their labels.
IDENTIFIERS = {
    "cc0-1.0": "cc0", "unlicense": "unlicense", "mit": "mit", "isc": "isc", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
    "apache-2.0": "apache-2.0", "mpl-2.0": "mpl", "epl-2.0": "epl", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa",
    "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "gpl-2.0": "gpl", "gpl-3.0": "gpl", "agpl-3.0": "agpl", "cc-by-nc-4.0": "cc-by-nc",
}
RANK = {name: i for i, name in enumerate(IDENTIFIERS)}
OWN_NAME = r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
OPERATORS = {"or": 1, "and": 2, "with": 3}
# Weights of the evidence of one place of each kind in the score.
WEIGHT = {"tag": 0.9, "notice": 0.5, "base": 0.5}
FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "n_tags long, n_notices long, score double")
KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]

WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def automaton():
    """Phrases with a space on both sides, over the words of a text joined by spaces (one character a byte)."""
    a = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            kinds.setdefault(phrase, []).append((kind, label))
    for phrase, found in kinds.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, found))
    a.make_automaton()
    return a


def tokens(expression: str) -> list[str]:
    return expression.lower().replace("(", " ( ").replace(")", " ) ").split()


def known(name: str) -> str:
    short = name
    for suffix in ("-only", "-or-later", "+"):
        short = short.removesuffix(suffix)
    return short if short in NAMES else name


def label_of(name: str) -> str | None:
    return IDENTIFIERS.get(name) or (name if name in NAMES or re.fullmatch(OWN_NAME, name) else None)


def postfix(expression: str) -> list[str]:
    """Shunting-yard: tokens in postfix order; reading stops at the first token that cannot continue an expression."""
    out, stack, want_name = [], [], True
    for t in tokens(expression):
        if t == "(" and want_name:
            stack.append(t)
        elif t == ")" and not want_name:
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif t in OPERATORS and not want_name:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[t]:
                out.append(stack.pop())
            stack.append(t)
            want_name = True
        elif t not in OPERATORS and t not in "()" and want_name:
            out.append(t)
            want_name = False
        else:
            break
    return out + [t for t in reversed(stack) if t != "("]


def granted(expression: str) -> frozenset[str]:
    """Labels that the expression grants."""
    stack: list[frozenset[str]] = []
    for t in postfix(expression):
        if t not in OPERATORS:
            stack.append(frozenset([known(t)]))
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if t == "and":
                stack.append(left | right)
            elif t == "with":
                stack.append(left)
            else:
                worst = [max((RANK.get(n, len(RANK)) for n in side), default=len(RANK)) for side in (left, right)]
                stack.append(left if worst[0] <= worst[1] else right)
    names = frozenset().union(*stack) if stack else frozenset()
    return frozenset(filter(None, map(label_of, names)))


def expressions(text: bytes) -> Iterator[str]:
    """What follows each identifier tag, up to the end of its line."""
    low = text.lower()
    at = 0
    while (at := low.find(b"spdx-license-identifier:", at)) >= 0:
        at += 24
        end = low.find(b"\n", at)
        yield low[at: end if end >= 0 else len(low)].decode("utf-8", "replace")


def scan(text: bytes, phrases) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, n_tags, n_notices, score."""
    words = text.translate(WORD_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    n = {"base": 0, "notice": 0, "tag": 0}
    first = last = None
    base, labels = set(), set()
    seen_to, seen_words = 0, 0
    starts = []
    for end, (length, found) in phrases.iter(line):
        for kind, label in found:
            n[kind] += 1
            if kind == "base":
                starts.append(end - length + 1)
                base.add(label)
            elif label:
                labels.add(label)
    for at in sorted(starts):
        seen_words += line.count(" ", seen_to, at)
        seen_to = at
        first = seen_words if first is None else first
        last = seen_words
    if n["tag"]:
        for e in expressions(text):
            labels |= granted(e)
    miss = 1.0
    for kind, weight in WEIGHT.items():
        miss *= (1 - weight) ** min(n[kind], 50)
    return len(words), n["base"], first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), n["tag"], n["notice"], 1 - miss


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_tags, n_notices, score (0 to 1)."""
    def make():
        phrases = automaton()

        def work(texts):
            columns = list(zip(*[scan(t, phrases) for t in texts])) or [()] * len(KINDS)
            return [pa.array(c, k) for c, k in zip(columns, KINDS)]

        return work

    return map_texts(docs, ["doc_id"], FIELDS, make)
