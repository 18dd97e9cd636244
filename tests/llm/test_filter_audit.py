"""The audit of filters against every order applied by hand, on awkward rows."""

import itertools
import re
from collections import Counter

import pytest

from parcelgraph.llm import filter_audit

DOCS = "doc_id long, text string, source string, _id long, _part string, state int, left long, A boolean, quality int"


def brute(rows, labels):
    """Rows of the audit: documents one by one through all orders."""
    lowest = {}
    for i, t, _ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > lowest[t],
        }
        mark = [any(j == i and i is not None and y[k] == 1 for j, *y in labels) for k in (0, 1)]
        docs.append((s or "", fails, *mark))
    found, shapley = {}, Counter()
    parts = {d[0] for d in docs}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in parts:
            left = [d for d in docs if d[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                out = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[part, f] += len(out)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in everyone)
                found[part, order, step] = (len(left), len(out), sum(d[1][f] for d in everyone) - len(out), alone, sum(d[2] for d in out), sum(d[3] for d in out))
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items())


@pytest.mark.parametrize("empty", [False, True])
def test_audit(spark, empty):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [
        (1, long, "a"), (2, long, "b"), (2, long, "b"), (3, long, None), (None, long, "a"), (None, long, "a"),
        (4, None, "a"), (5, "", None), (6, "", ""), (7, "ABC def", "b"), (8, "w " * 250, "a"), (9, long + " #", "a"), (10, long.upper(), "b"),
        (11, "x" * 400_000, "a"), (12, " ".join(f"q{k}" for k in range(60_000)), "b"), (13, "tab\x0bsep\x1c \x85end\u3000a", "b"), (14, long + "\n", "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, None, 1), (8, 1, 1), (9, 1, 0), (None, 1, 1), (999, 1, 1), (11, 0, 1)]
    docs = spark.createDataFrame([(i, t, s, 5, "x", 1, 2, True, 0) for i, t, s in rows], DOCS).repartition(3)
    docs = docs.where("false") if empty else docs
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(tuple(r) for r in found.collect()) == brute([] if empty else rows, labels)
