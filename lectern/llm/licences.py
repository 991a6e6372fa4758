"""Licence notices and identifier tags, found in one pass by an Aho-Corasick automaton.

The words of a batch (runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased) are written one space apart
into one string, a line feed between documents.  The automaton runs over it once, whatever the number of phrases,
and finds notice phrases and the words of identifier tags.  After a tag the raw text is read token by token as a
licence expression: a shunting-yard parser puts ``and``, ``or``, ``with`` and brackets into postfix order, and the
postfix form is evaluated to a value between 0 (nothing allowed) and 1 (nearly everything allowed): ``and`` takes
the lesser value, ``or`` the greater one, and ``with`` an exception that loosens the licence.

A phrase that lies inside a longer phrase found at the same place isn't reported; phrases of ``BASE`` always are.
An expression ends with its line or sentence, or at the first thing that can't follow; a dangling operator and
brackets without a partner are ignored.  After ``license:`` only known identifiers count, after
``spdx-license-identifier:`` any name does.

Cases: null and empty texts have no words and no matches; every row gives one row, repeated rows and rows without
an id too; an empty table gives no rows; other columns are ignored; whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

# Phrases and labels of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# How freely a licence lets a text be used, by label.
VALUES = {
    "mit": 1.0, "apache-2": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "zlib": 1.0, "0bsd": 1.0,
    "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "boost-1": 1.0, "psf-2": 1.0, "cc-by": 0.9, "odc-by": 0.9,
    "artistic-2": 0.8, "mpl-2": 0.6, "epl-2": 0.6, "cddl-1": 0.6, "lgpl-2.1": 0.6, "lgpl-3": 0.6, "lgpl": 0.6, "eupl-1.2": 0.6,
    "cc-by-sa": 0.5, "odbl-1": 0.5, "gfdl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "gpl": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2,
    "cc-by-nc-sa": 0.2, "cc-by-nd": 0.1, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
#: Of a name that isn't known, and of a known licence with an exception (never less than its own value).
UNKNOWN = 0.05
EXCEPTION = 0.7
# Identifiers of licence expressions (lower case; "-only", "-or-later" and "+" are taken off first) and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "isc": "isc",
    "zlib": "zlib", "0bsd": "0bsd", "unlicense": "unlicense", "cc0-1.0": "cc0", "bsl-1.0": "boost-1", "psf-2.0": "psf-2",
    "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "odc-by-1.0": "odc-by", "artistic-2.0": "artistic-2", "mpl-2.0": "mpl-2",
    "epl-2.0": "epl-2", "cddl-1.0": "cddl-1", "lgpl-2.1": "lgpl-2.1", "lgpl-3.0": "lgpl-3", "eupl-1.2": "eupl-1.2",
    "cc-by-sa-3.0": "cc-by-sa", "cc-by-sa-4.0": "cc-by-sa", "odbl-1.0": "odbl-1", "gfdl-1.3": "gfdl", "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3", "agpl-3.0": "agpl-3", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}
# Phrases of notices, as words, and their labels.
PHRASES = {
    "the mit license": "mit", "mit licensed": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2", "apache license 2 0": "apache-2", "apache software license": "apache-2",
    "redistribution and use in source and binary forms": "bsd-2-clause", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause", "isc license": "isc", "zlib license": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense", "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain", "in the public domain": "public-domain", "boost software license": "boost-1",
    "python software foundation license": "psf-2", "mozilla public license version 2": "mpl-2", "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl-2", "common development and distribution license": "cddl-1",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu general public license v2": "gpl-2", "gnu general public license v3": "gpl-3", "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl-3", "gnu free documentation license": "gfdl", "open database license": "odbl-1",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd", "all rights reserved": "all-rights-reserved",
}
# Words of tags; an expression follows after a colon or an equals sign. True: any name counts.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False, "licenses": False}

MATCHES = "array<struct<kind: string, label: string, first_word: long, n_words: long, value: double>>"
KINDS = ["base", "phrase", "tag"]
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:_-]*))")
_OPENING = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_BINDS = {"or": 1, "and": 2, "with": 3}


class Operand(NamedTuple):
    labels: tuple[str, ...]
    value: float


def postfix(text: bytes, at: int = 0, any_name: bool = True) -> list[str]:
    """The licence expression at ``at`` in postfix order; names in lower case, operators as ``and``, ``or``, ``with``."""
    out: list[str] = []
    held: list[str] = []
    after_operand = False
    while found := _TOKEN.match(text, at):
        bracket, name = found.group(1), (found.group(2) or b"").decode().lower().rstrip(".:")
        if bracket == b"(" and not after_operand:
            held.append("(")
        elif bracket == b")" and after_operand and "(" in held:
            while (top := held.pop()) != "(":
                out.append(top)
        elif name in _BINDS and after_operand:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[name]:
                out.append(held.pop())
            held.append(name)
            after_operand = False
        elif name and name not in _BINDS and not after_operand and (any_name or _plain(name) in IDENTIFIERS or held[-1:] == ["with"]):
            out.append(name)
            after_operand = True
            if found.group().endswith((b".", b":")):
                break  # the end of a sentence
        else:
            break
        at = found.end()
    if not after_operand:
        while held and held[-1] == "(":
            held.pop()
        if held and out:
            held.pop()  # an operator without a second operand
    return out + [x for x in reversed(held) if x != "("]


def _plain(name: str) -> str:
    return name.removesuffix("+").removesuffix("-only").removesuffix("-or-later")


def evaluate(expression: list[str]) -> Operand | None:
    """Labels and value of an expression in postfix order."""
    stack: list[Operand] = []
    for x in expression:
        if x not in _BINDS:
            label = IDENTIFIERS.get(_plain(x), x)
            stack.append(Operand((label,), VALUES.get(label, UNKNOWN)))
            continue
        right, left = stack.pop(), stack.pop()
        if x == "with":
            known = left.value > UNKNOWN
            stack.append(Operand((*left.labels[:-1], f"{left.labels[-1]}-with-{right.labels[-1]}"), max(left.value, EXCEPTION) if known else left.value))
        else:
            stack.append(Operand(left.labels + right.labels, (min if x == "and" else max)(left.value, right.value)))
    return stack[0] if stack else None


class Scanner:
    """The automaton, and what each of its patterns stands for."""

    def __init__(self):
        import ahocorasick

        self.patterns = [("base", p, label) for p, label in BASE.items()]
        self.patterns += [("phrase", p, label) for p, label in PHRASES.items() if p not in BASE]
        self.patterns += [("tag", p, "") for p in TAGS]
        self.words = np.array([p.count(" ") + 1 for _, p, _ in self.patterns], np.int64)
        self.chars = np.array([len(p) + 2 for _, p, _ in self.patterns], np.int64)
        self.kind = np.array([KINDS.index(k) for k, _, _ in self.patterns], np.int8)
        self.automaton = ahocorasick.Automaton()
        for i, (_, phrase, _) in enumerate(self.patterns):
            self.automaton.add_word(f" {phrase} ", i)
        self.automaton.make_automaton()

    def found(self, t: common.Texts, w: common.Words) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and first word (of all words of ``t``) of every match, by place."""
        length = w.end - w.start
        # two characters before each document, one after each word
        first = np.cumsum(length + 1) - length - 1 + 2 * (w.doc() + 1)
        size = int(length.sum()) + len(length) + 2 * len(t)
        stream = np.full(size, ord(" "), np.uint8)
        stream[np.concatenate([[0], np.cumsum(common.sums(length + 1, w.first) + 2)[:-1]]) if len(t) else []] = ord("\n")
        stream[np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = common.LOWER[
            t.data[np.repeat(w.start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        ]
        hits = list(self.automaton.iter(stream.tobytes().decode("latin-1")))
        pattern = np.array([p for _, p in hits], np.int64)
        place = np.array([e for e, _ in hits], np.int64) - self.chars[pattern] + 2
        order = np.lexsort((pattern, place))
        return pattern[order], np.searchsorted(first, place[order])


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def _matches(t: common.Texts, w: common.Words) -> tuple[list, np.ndarray]:
    """``(kind, label, first word, words, value)`` of every match, and its document."""
    s = scanner()
    pattern, word = s.found(t, w)
    doc = np.searchsorted(w.first, word, "right") - 1
    out, of = [], []
    reach = -1  # last word of the phrases so far
    text_of, text = -1, b""
    longest = np.lexsort((-s.words[pattern], word))
    for i in longest.tolist():
        kind, phrase, label = s.patterns[pattern[i]]
        first, n = int(word[i]), int(s.words[pattern[i]])
        at = first - int(w.first[doc[i]])
        if kind == "tag":
            if doc[i] != text_of:
                text_of, text = doc[i], t.data[t.offsets[doc[i]] : t.offsets[doc[i] + 1]].tobytes()
            opening = _OPENING.match(text, int(w.end[first + n - 1] - t.offsets[doc[i]]))
            read = evaluate(postfix(text, opening.end(), TAGS[phrase])) if opening else None
            if read:
                out += [("tag", x, at, n, read.value) for x in dict.fromkeys(read.labels)]
                of += [doc[i]] * len(dict.fromkeys(read.labels))
            continue
        inside = first + n - 1 <= reach
        reach = max(reach, first + n - 1)
        if kind == "base" or not inside:
            out.append((kind, label, at, n, VALUES[label]))
            of.append(doc[i])
    return out, np.array(of, np.int64)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches):
        w = common.words(t, common.NOT_ALNUM)
        found, of = _matches(t, w)
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        struct = pa.StructArray.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], ["kind", "label", "first_word", "n_words", "value"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(t) + 1)), pa.int32()), struct)
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), lists], ["doc_id", "n_words", "matches"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, matches`` of every row; one pass over the texts, no shuffle.

    ``matches`` has kind (base, phrase or tag), label, place and value of everything found; an expression gives
    one entry per licence, each with the value of the whole expression.
    """
    return common.keyed_texts(docs, id_col, text_col).mapInArrow(_scanned, f"doc_id long, n_words long, matches {MATCHES}")


def labels(matches: Column) -> Column:
    """Distinct labels, sorted and joined with commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")


def freedom(matches: Column) -> Column:
    """How freely a text may be used: the least value of all that was found, 0 where nothing was."""
    return F.coalesce(F.array_min(F.transform(matches, lambda m: m.value)), F.lit(0.0))
