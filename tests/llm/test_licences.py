from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import licences, queries
from tests.llm.conftest import ODD, frame

TEXTS = [
    *ODD, "Released under the MIT License. Under\n the-mit; LICENSE", "under the mit licenses", "xunder the mit license",
    "apache license version 2apache license, version 2.0", "CC BY-NC 4.0 cc by nc cc by", "cc by", "CC BY-SA 4.0; CC-BY",
    "# SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)\nnext or line",
    "spdx-license-identifier = LicenseRef-Own AND mit", "License: MIT. Or something", "license: see below", "licence: gpl-3.0+ or",
    "GNU General Public License, version 3", "GNU Lesser General Public License version 3", "éunder the mit license",
    "under the mit license x", "ß" * 10 + " cc by nc", "license: mit\r\nSPDX License Identifier: isc",
]


def brute_words(text: str | None) -> list[str]:
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_base(text: str | None) -> tuple:
    words = brute_words(text)
    places, found = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                found.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def run(spark, df):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return {r.doc_id: r for r in _query(df).collect()}


def _query(df):
    base = F.filter("matches", lambda m: m.kind == "base")
    places = F.transform(base, lambda m: m.first_word)
    return licences.scan(df).select("doc_id", "n_words", F.size(base), F.array_min(places), F.array_max(places), licences.labels(base).alias("base"),
                                    licences.labels(F.col("matches")).alias("labels"), licences.freedom(F.col("matches")).alias("score"))


def test_base_against_brute_force(spark):
    got = run(spark, frame(spark, TEXTS))
    for i, text in enumerate(TEXTS):
        assert tuple(got[i])[1:6] == brute_base(text), text


def test_whole_table(spark, sf, documents):
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op12_licences(spark, sf).collect()}
    assert got == {r.doc_id: brute_base(r.text) for r in documents.collect()}
    assert any(r[1] for r in got.values())


def test_labels_of_the_method(spark):
    got = run(spark, frame(spark, TEXTS))
    of = {t: (got[i].labels, got[i].score) for i, t in enumerate(TEXTS) if t}
    assert of["CC BY-NC 4.0 cc by nc cc by"] == ("cc-by,cc-by-nc", 0.2)
    assert of["CC BY-SA 4.0; CC-BY"] == ("cc-by,cc-by-sa", 0.5)
    assert of[TEXTS[len(ODD) + 7]] == ("apache-2,gpl-2-with-classpath-exception-2.0,mit", 1.0)
    assert of["spdx-license-identifier = LicenseRef-Own AND mit"] == ("licenseref-own,mit", licences.UNKNOWN)
    assert of["License: MIT. Or something"] == ("mit", 1.0)
    assert of["license: see below"] == ("", 0.0)
    assert of["licence: gpl-3.0+ or"] == ("gpl-3", 0.4)
    assert of["GNU General Public License, version 3"] == ("gpl-3", 0.4)
    assert of["GNU Lesser General Public License version 3"] == ("lgpl-3", 0.6)
    assert of["license: mit\r\nSPDX License Identifier: isc"] == ("isc,mit", 1.0)


def by_descent(text: str):
    """A second parser: recursive descent over the same grammar."""
    tokens = re.findall(r"[()]|[^\s()]+", text.lower())

    def level(i, names):
        value, i = level(i, names[1:]) if len(names) > 1 else atom(i)
        while i < len(tokens) and tokens[i] == names[0]:
            right, i = level(i + 1, names[1:]) if len(names) > 1 else atom(i + 1)
            value = {"or": max, "and": min, "with": lambda a, _: max(a, licences.EXCEPTION) if a > licences.UNKNOWN else a}[names[0]](value, right)
        return value, i

    def atom(i):
        if tokens[i] == "(":
            value, i = level(i + 1, ["or", "and", "with"])
            return value, i + 1
        return licences.VALUES.get(licences.IDENTIFIERS.get(tokens[i], ""), licences.UNKNOWN), i + 1

    return level(0, ["or", "and", "with"])[0]


@pytest.mark.parametrize("seed", range(300))
def test_expressions_against_recursive_descent(seed):
    import random

    rng = random.Random(seed)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["MIT", "gpl-2.0", "mpl-2.0", "CC-BY-NC-4.0", "Own-1"])
            return f"{name} WITH some-exception" if rng.random() < 0.2 else name
        inner = f" {rng.choice(['AND', 'or'])} ".join(make(depth - 1) for _ in range(rng.randint(2, 3)))
        return f"({inner})" if rng.random() < 0.5 else inner

    text = make(3)
    assert licences.evaluate(licences.postfix(text.encode())).value == by_descent(text)


def test_broken_expressions():
    for text, want in {"": [], "(": [], ")": [], "or mit": [], "mit or": ["mit"], "mit or (": ["mit"], "(mit": ["mit"], "mit)": ["mit"],
                       "mit isc": ["mit"], "mit and (isc or": ["mit", "isc", "and"], "((mit)) or isc": ["mit", "isc", "or"]}.items():
        got = licences.postfix(text.encode())
        assert got == want, text
        licences.evaluate(got)


def test_no_rows_and_repeated_rows(spark, none):
    assert licences.scan(none).collect() == []
    df = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc")], "doc_id long, text string")
    assert [r.matches[0].label for r in licences.scan(df).collect()] == ["cc-by-nc"] * 3


def test_very_many_matches():
    import time

    import numpy as np

    from lectern.llm import common

    data = np.frombuffer(b"license: mit or isc, cc by nc " * 60_000, np.uint8)
    t = common.Texts(data, np.array([0, len(data)]))
    started = time.monotonic()
    found, _ = licences._matches(t, common.words(t, common.NOT_ALNUM))
    assert len(found) == 180_000 and time.monotonic() - started < 20
