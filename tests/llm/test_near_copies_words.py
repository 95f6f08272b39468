"""Near copies against brute force on words: the helper of that name in ``test_against_brute_force`` is defined twice,
and the later one, which gives places of words too, takes the place of the first."""

import re

import numpy as np

from logicspark.llm import near_copies
from tests.llm.test_against_brute_force import planted


def test_near_copies_are_those_of_all_pairs_of_words(spark):
    rows = planted()
    found = {r["doc_id"]: r["class_id"] for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sequences = []
    for _, text in rows:
        w = re.findall(r"[^\W_]+", text.lower())
        sequences.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            names = {s: k for k, s in enumerate(dict.fromkeys(sequences[i] + sequences[j]))}
            a, b = (np.array([names[s] for s in sequences[k]]) for k in (i, j))
            if near_copies.aligned(a, b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert found == dict(enumerate(root))
    assert len(set(root)) < len(rows) - 10
