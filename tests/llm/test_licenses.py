import re
import time

import pytest

from assay.llm import licenses
from tests.llm.cases import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(text.translate({65 + i: 97 + i for i in range(26)}))
    spots, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        spots += found
        labels |= {label} if found else set()
    return len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License. under, the\nMIT; license",
    "Apache License, Version 2.0 and CC BY-NC 4.0 und cc-by-nc-sa",
    "thunder the mit license; under the mit licenses",
    "",
    "É under the mit license ÉÀ1 2-3",
    "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)",
]


def test_places_and_base_labels_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.scanned(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in licenses.scanned(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])


@pytest.mark.parametrize(
    ("text", "names", "accepted"),
    [
        ("MIT", {"mit"}, True),
        ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, False),
        ("MIT OR GPL-3.0-only AND Proprietary", {"mit", "gpl-3.0-only", "proprietary"}, True),
        ("(MIT OR GPL-3.0-only) AND Proprietary", {"mit", "gpl-3.0-only", "proprietary"}, False),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR ISC", {"gpl-2.0+-with-classpath-exception-2.0", "isc"}, True),
        ("((Apache-2.0))", {"apache-2.0"}, True),
    ],
)
def test_expressions(text, names, accepted):
    found = licenses.evaluate(licenses.expression_of(text))
    assert found.names == names and found.accepted == accepted


@pytest.mark.parametrize("text", ["", "MIT OR", "AND MIT", "(MIT", "()", "MIT (ISC)"])
def test_broken_expressions_are_refused(text):
    with pytest.raises(ValueError):
        licenses.evaluate(re.findall(r"[A-Za-z0-9.+-]+|[()]", text))


def test_awkward_and_empty_tables(spark):
    assert licenses.scanned(awkward(spark, extra=True)).count() == awkward(spark).count()
    assert licenses.scanned(empty(spark)).count() == 0


def test_time_grows_with_the_length_of_a_text():
    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES, licenses.ACCEPTED)
    text = "under the mit license " * 100_000
    begun = time.process_time()
    got = scanner.scan(text)
    assert got[:4] == (400_000, 100_000, 0, 399_996)
    assert time.process_time() - begun < 20  # counting from the start at every place takes hours
