"""The postings of several rare words, and what is looked up by them."""

from pyspark.sql import functions as F

from folia.llm import licenses


def test_two_rare_words_are_chosen():
    n = licenses.notice("x", "here all rights all reserved", "all rights all reserved")
    counts = {"all": 90, "rights": 4, "reserved": 9}
    assert licenses.rare_words([n], 100, counts) == [[("rights", 1), ("reserved", 3)]]
    assert licenses.rare_words([licenses.notice("x", "a a a")], 100, {}) == [[("a", 0)]]


def test_postings_fall_together(spark):
    words = "all rights reserved rights rights reserved reserved all rights x".split()
    hits = [(w, i) for i, w in enumerate(words) if w in ("rights", "reserved")]
    df = spark.createDataFrame([(hits,)], "hits array<struct<w:string,i:int>>")
    rare = [[("rights", 1), ("reserved", 2)], [("reserved", 0)]]
    assert [tuple(x) for x in df.select(licenses._meeting("hits", rare).alias("s")).first().s] == [(0, 0), (0, 3), (1, 2), (1, 5), (1, 6)]  # "rights" alone would give 0, 2, 3, 7


def test_tag_lines_and_other_names(spark):
    """Tag lines, notices by name, and kept columns that are named like what is made on the way."""
    texts = {1: "# SPDX-License-Identifier: Apache-2.0", 2: "BSD 3-Clause license", 3: "Licensed under CC-BY-SA 4.0", 4: "MITLICENSE mit licence"}
    names = ["words", "hits", "n_words", "places", "w", "at", "lower text"]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    out = {r.doc_id: r for r in licenses.scan_licenses(df, keep=("doc_id", *names)).collect()}
    labels = {k: {p.label for p in r.places} for k, r in out.items()}
    assert labels == {1: {"spdx:Apache-2.0"}, 2: {"bsd-3-clause"}, 3: {"cc-by-sa"}, 4: set()}
    assert out[1].words == 7 and out[1].n_words == 6


def test_places_are_those_of_plain_search(spark):
    texts = ["all rights reserved all rights reserved", "rights reserved", "all all rights reserved rights", "mit mit license license mit license", "all rights x reserved"]
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        w = tuple(texts[r.doc_id].split())
        want = [(n.label, n.base, i) for n in [*licenses.BASE, *licenses.TEMPLATES] for i in range(len(w)) if w[i : i + n.length] == n.key]
        assert [(p.label, p.base, p.start) for p in r.places] == want
