"""A block of more sets than a tile holds, whose sets share passages and hardly ever link: pivots connect nothing."""

import itertools
import random
from collections import Counter

from lodestrata.llm import ngram_join


def test_large_block(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passages = [" ".join(word() for _ in range(30)) for _ in range(26)]
    texts = [f"{passages[a]} {passages[b]}" for a, b in itertools.combinations(range(26), 2)]
    assert len(texts) > ngram_join.TILE
    copies = rng.sample(range(len(texts)), 40)
    texts += [texts[i] + " " + word() for i in copies]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.component_id) for r in found.collect()) == Counter((i, find(i)) for i in sets)
    assert sum(find(i) != i for i in sets) == 40
