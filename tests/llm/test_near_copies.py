"""Near copies at a stated Jaccard similarity against brute force over all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import near_copies
from tests.llm.test_llm_operators import SCHEMA, awkward, union

TABLES = "/root/testdata/sf0.01"


def plain_set(text, shingle=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) <= shingle:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1))


def plain_links(texts, similarity=0.8):
    """All pairs of ids of ``texts`` whose shingle sets reach the similarity, with it."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    common, holders = Counter(), defaultdict(list)
    for i, shingles in sets.items():
        for s in shingles:
            holders[s].append(i)
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    empty = [i for i, s in sets.items() if not s]
    out = {(a, b): 1.0 for a, b in zip(empty, empty[1:], strict=False)}
    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            out[a, b] = n / (len(sets[a]) + len(sets[b]) - n)
    return out


def groups(spark, texts, **options):
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")).cast("binary")).repartition(3)
    return {r.node: r.component for r in near_copies.near_groups(rows, **options).collect()}


def edited(rnd, words, changes):
    words = list(words)
    for at in rnd.sample(range(len(words)), changes):
        words[at] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_planted_copies(spark):
    """Copies at all similarities around the threshold: nothing below it, almost all above it."""
    rnd, texts = random.Random(5), {}
    for _ in range(250):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(12, 300))]
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = edited(rnd, words, rnd.randint(0, 1 + len(words) // 25))
    links = plain_links(texts)
    got = groups(spark, texts)
    want = union(links, texts)
    assert len(links) > 100
    assert all(want[i] == want[c] for i, c in got.items())  # no link below the threshold
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)


@pytest.mark.parametrize("cell", [8, near_copies.CELL])
def test_large_group_and_shared_passages(spark, cell):
    """One group of very many copies beside texts that share half their words, in small cells too."""
    rnd, texts = random.Random(8), {}
    words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    for _ in range(150):
        texts[len(texts)] = edited(rnd, words, 1)
    for _ in range(60):
        tail = [f"t{rnd.randrange(5000)}" for _ in range(60)]
        texts[len(texts)] = " ".join(words[:60] + tail)
        texts[len(texts)] = " ".join(words[:60] + tail[:-1])
    assert groups(spark, texts, cell=cell) == union(plain_links(texts), texts)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    links = plain_links(texts)
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == set(union(links, texts).values())


def test_awkward_rows(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = {k: rows[i][1] for k, i in enumerate(order)}
    least = set(union(plain_links(texts), texts).values())
    assert Counter(r.doc_id for r in got.collect()) == Counter(rows[order[k]][0] for k in least)
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    words = [f"w{i * 7919 % 100003}" for i in range(200_000)]
    got = groups(spark, {0: " ".join(words), 1: " ".join(words[:180_000]), 2: " ".join(words[:150_000])})
    assert got == {0: 0, 1: 0, 2: 0}  # 0 and 2 are linked by 1 only


def test_many_pairs_are_never_listed(spark, monkeypatch):
    """Texts that share a band and little else, or are linked only through others: pairs stay fewer than rows."""
    rnd, texts, rows = random.Random(11), {}, []
    words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    for _ in range(120):
        texts[len(texts)] = edited(rnd, words, 7)  # a few links among very many candidates
    listed = near_copies.verified

    def counted(pairs, *rest):
        rows.append(pairs.count())
        return listed(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    got = groups(spark, texts)
    assert max(rows) <= 20 * len(texts)
    assert rows[1] <= len(texts)  # the walks; before, every candidate pair
    want = union(plain_links(texts), texts)
    assert all(want[i] == want[c] for i, c in got.items())
    assert len(set(want.values())) <= len(set(got.values())) <= len(set(want.values())) + 2


def test_forest_links_are_those_of_all_pairs():
    rnd = random.Random(3)
    pool = np.arange(1, 60, dtype="i8")
    sets = [np.array(sorted(rnd.sample(pool.tolist(), rnd.randint(20, 55))), dtype="i8") for _ in range(80)]
    pairs = np.array([(a, b) for a in range(80) for b in range(a + 1, 80)])
    comp = np.arange(80) % 70
    links = near_copies.forest_links(pairs, comp, sets, 0.8)

    def linked(a, b):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    same = [(a, b) for a, b in pairs.tolist() if comp[a] == comp[b]]
    every = [(a, b) for a, b in pairs.tolist() if linked(a, b)]
    ids = range(80)
    assert links and all(linked(a, b) for a, b in links) and len(links) < 70
    assert union(same + links, ids) == union(same + every, ids)
