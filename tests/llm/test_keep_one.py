"""The near-duplicate stage on repeated and null ids, against brute force."""

from collections import Counter

import corpus_pipeline
from test_corpus import SCHEMA, WORD, corpus

from strandline.llm import jaccard


def own_words(name, n=40, **changes):
    return " ".join(changes.get(f"w{i}", f"{name}{i}") for i in range(n))


def test_rows_that_share_an_id(spark):
    a, e, d = own_words("a"), own_words("e"), own_words("d")
    rows = [(1, a), (2, a + " more"), (2, own_words("c")), (3, e), (3, e + " more"), (None, d), (None, d + " more"), (4, own_words("g")), (None, own_words("g") + " more"), (5, own_words("h")), (5, own_words("h")), (6, ""), (7, None)]
    kept = Counter(tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(kept.values()) == 1
    for row in ((1, a), (2, own_words("c")), (4, own_words("g")), (5, own_words("h")), (6, ""), (7, None)):
        assert kept[row] == 1
    assert sum(kept.values()) == 8 and sum(i == 3 for i, _ in kept) == 1 and sum(i is None for i, _ in kept) == 1


def linked(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


def test_exact_and_near_stage_by_brute_force(spark):
    rows = corpus(5)
    rows += [(i, rows[40 - i][1] if i % 2 else f"{rows[i][1]} tail", *rows[i][2:]) for i in range(20)] + [(None, f"{r[1]} end", *r[2:]) for r in rows[:20]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = corpus_pipeline.exact_stage(spark, df, "").collect()
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(left, SCHEMA), "").collect())
    sets = []
    for r in left:
        w = WORD.findall((r["text"] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(left)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and linked(x, sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    for g in set(group):
        own = [left[i] for i in range(len(left)) if group[i] == g]
        stays = [(r["doc_id"], r["text"]) for r in own if (r["doc_id"], r["text"]) in got]
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert len(stays) == 1 and stays[0][0] == (min(ids) if ids else None)
    assert sum(got.values()) == len(set(group)) < len(left)
