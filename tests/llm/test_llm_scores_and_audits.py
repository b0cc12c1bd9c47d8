"""Operators 11 to 13 against plain versions on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import bloom_lm, merkle, turn_repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, leaf string, levels string, idx int"
TALKS = "conv_id long, turn long, role string, text string, conv string, code int, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- scores -----------------------------------------------------------------

def document_rows():
    rnd = random.Random(5)
    vocabulary = ["The", "the", "of", "Été", "river", "stone", "42", "x!", "日本"]
    texts = [rnd.choice([" ", "\n", " \t"]).join(rnd.choices(vocabulary, k=rnd.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, rnd.choice(["en", "de", None, "é"]), f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1"), (5, "another", "en", None), (None, texts[3], "en", "s0"), (None, None, None, None)]
    rows += [(70, None, "fr", "s0"), (71, "", "de", "s0"), (72, " \n", "de", "s1"), (73, "z" * 9000, "en", "s1")]
    rows += [(74, "the river " * 4000, "en", "s1"), (75, "a\x0bb\x0cc\rd\x1fe f", "en", "s1")]
    rows += [(80, texts[1], "de", "s0")] * 5
    return [(*r, None if i % 9 == 0 else len(r[1] or ""), *"abc", 1) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS).repartition(4).cache()


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def in_fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_scores(rows, order, prior):
    learned = [tokens(r[1]) for r in rows if not in_fold(r[0])]
    grams = Counter()
    for words in learned:
        padded = [None] * (order - 1) + words
        for k in range(1, order + 1):
            grams.update(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)))
    words = Counter(w for t in learned for w in t)
    total, distinct = sum(words.values()), len(words)

    def count(gram):
        if set(gram) == {None}:
            return float(len(learned))
        c = grams[gram]
        level = int(math.log2(c)) + 1 if c else 0
        return (2 ** (level - 1) + 2**level - 1) / 2 if c else 0.0

    out = []
    for r in rows:
        held = tokens(r[1])
        padded, score = [None] * (order - 1) + held, 0.0
        for i in range(order - 1, len(padded)):
            p = (count((padded[i],)) + 1) / (total + distinct + 1)
            for k in range(2, order + 1):
                gram = tuple(padded[i - k + 1 : i + 1])
                context = count(gram[:-1])
                p = (min(count(gram), context) + prior * p) / (context + prior)
            score += math.log10(p)
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in held)
        out.append((r[0], in_fold(r[0]), len(held), sum(words[w] > 0 for w in held), total, base, score))
    return out


def near(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for place in (5, 6):
        assert np.allclose([g[place] for g in got], [w[place] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_exact_model(docs, order):
    # With 64 bits an entry no false hit is to be expected among these few n-grams.
    got = bloom_lm.language_model_scores(docs, order=order, bits=64, prior=4.0)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    near(got.collect(), plain_scores(document_rows(), order, 4.0))


def test_rounds_and_shards_change_nothing(docs, monkeypatch):
    settings = {"order": 2, "unit_tokens": 2000}
    whole = bloom_lm.language_model_scores(docs, **settings).collect()
    for shard, round_ in ((600, 1200), (600, 600), (1, 5)):
        parts = bloom_lm.language_model_scores(docs, **settings, shard_bytes=shard, round_bytes=round_)
        assert sorted(parts.collect(), key=repr) == sorted(whole, key=repr)


def test_long_texts_go_in_pieces():
    raw = b" ".join(b"w%d" % (i % 50) for i in range(5000)) + b"\n"
    parts = list(bloom_lm.pieces(raw, 100))
    assert b"".join(p for p, _ in parts) == raw and len(parts) > 100
    assert [last for _, last in parts] == [False] * (len(parts) - 1) + [True]
    assert sum(len(p.split()) for p, _ in parts) == 5000
    assert list(bloom_lm.pieces(b"x" * 500, 100)) == [(b"x" * 500, True)]


def test_scores_without_rows_or_training(spark, docs):
    assert bloom_lm.language_model_scores(docs.limit(0)).collect() == []
    alone = docs.filter("doc_id is not null").filter(bloom_lm.held_out("doc_id"))
    assert alone.count() > 0
    for row in bloom_lm.language_model_scores(alone).collect():
        assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def test_counts_are_never_too_small():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    counts = rng.integers(1, 200, 4000)
    import pyarrow as pa

    often = counts > 1
    table = pa.table({
        "unit": pa.array([0], pa.int32()), "ones": [keys[~often].tobytes()], "keys": [keys[often].tobytes()],
        "counts": [counts[often].astype(np.uint32).tobytes()],
    })

    class Grams:
        def groupBy(self, _):
            return self

        def applyInArrow(self, build, _):
            return build(table).to_pylist()[0]

    row = bloom_lm.build_units(Grams(), 2.0, 10)
    shard = bloom_lm.Shard(0, 0, [type("Row", (), row)()])
    asked = np.concatenate([keys, rng.integers(0, 1 << 63, 20000, dtype=np.uint64)])
    levels = np.zeros(len(asked), np.uint8)
    shard.probe(asked, bloom_lm.unit_of(asked, 1), bloom_lm.PROBES, levels)
    exact = np.floor(np.log2(counts)).astype(int) + 1
    assert (levels[:4000] >= exact).all() and (levels[:4000] == exact).mean() > 0.95
    assert (levels[4000:] > 0).mean() < 0.03


# --- conversations ----------------------------------------------------------

def best_edits(codes):
    """Least (cost, audit) over all edit sequences, by trying every edit at every place."""

    @cache
    def go(i, state, inserts):
        out = [(0, "")] if i == len(codes) and state in (0, 3) else []

        def add(cost, letter, rest):
            if rest is not None:
                out.append((cost + rest[0], letter + rest[1]))

        if i < len(codes):
            kind, fault = divmod(codes[i], 4)
            add(4, "D", go(i + 1, state, 3))
            if fault < 2:
                if kind == 4:
                    add(3 * fault, "K", go(i + 1, state, 3))
                for role, after in enumerate(turn_repair.NEXT[state]):
                    if after is not None and role == kind:
                        add(3 * fault, "K", go(i + 1, after, 3))
                    if after is not None and role in (1, 2):
                        add(3 + 3 * fault, "R", go(i + 1, after, 3))
        if inserts:
            for role in (1, 2):
                if turn_repair.NEXT[state][role] is not None:
                    add(3, "I", go(i, turn_repair.NEXT[state][role], inserts - 1))
        return min(out) if out else None

    return go(0, 0, 3)


def test_block_tables_give_the_least_audit():
    rnd = random.Random(3)
    for _ in range(1500):
        codes = bytes(rnd.choice([0, 4, 4, 8, 8, 12, 16, 1, 5, 9, 13, 2, 7, 11, 17]) for _ in range(rnd.randint(0, 13)))
        want = best_edits(codes)
        for block in (1, 3, 4):
            assert turn_repair.cheapest(codes, block) == want


def test_audits_give_legal_conversations():
    rnd = random.Random(4)
    letters = "suax"
    for n in (0, 1, 50, 4001):
        codes = bytes(rnd.choice([0, 4, 4, 8, 8, 12, 5, 9, 2, 7]) for _ in range(n))
        cost, audit = turn_repair.cheapest(codes)
        place, state, paid, said = 0, 0, 0, ""
        for letter in audit:
            kind, fault = divmod(codes[place], 4) if letter != "I" else (None, 0)
            place += letter != "I"
            paid += {"D": 4, "I": 3, "K": 0, "R": 3}[letter] + (3 if letter != "D" and fault == 1 else 0)
            assert letter == "D" or fault < 2
            if letter == "K":
                said += letters[kind]
            elif letter != "D":
                said += "u" if said[-1:] in ("", "s", "a") else "a"
        assert paid == cost and place == n and re.fullmatch("(s?(ua)+)?", said)


def talk_rows():
    rnd = random.Random(9)
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", ""]
    texts = [None, "", "Hi.", "Hi", "What? ", "ok!\n", " \t", "日本.", "same.", "a\x0b"]
    rows = [(rnd.choice([*range(1, 40), None]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts))
            for _ in range(400)]
    rows += [(90, 0, "user", "x.")] * 7 + [(91, 0, "system", "a."), (92, None, None, None)]
    rows += [(93, i, "user" if i % 2 else "assistant", "long " * 3000 + ("." if i % 3 else "")) for i in range(40)]
    return [(*r, "?", 7, "?") for r in rows]


def plain_repair(rows):
    shown = lambda v: " " if v is None else str(v)
    talks = {}
    for conv, turn, role, text, *_ in rows:
        talks.setdefault(conv, [])
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, held in talks.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1].encode())}:{r[1]}{r[2]}")))
        turns = [r[0] for r in held if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, codes = set(), []
        for _, role, text in held:
            body = text.strip(" \t\n\v\f\r")
            fault = 2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            codes.append(("suaxx".index(role[0]) if role[:1] in set("sua") else 3 if role else 4) * 4 + fault)
        cost, audit = best_edits(bytes(codes))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        lines, rest, last = [], iter(held), ""
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            if letter in "IR":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[:1] or last
        faults = [c % 4 for c in codes]
        out.append((conv, gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, sha("\n".join(lines))))
    return out


def test_repair_equals_plain(spark):
    rows = talk_rows()
    got = turn_repair.repair(spark.createDataFrame(rows, TALKS).repartition(5))
    assert got.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_repair(rows), key=repr)


def test_repair_of_nothing(spark):
    assert turn_repair.repair(spark.createDataFrame([], TALKS)).collect() == []
    # A conversation that loses its only row, and one that stays undamaged.
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hi.", "?", 1, "?")], TALKS)
    assert tuple(turn_repair.repair(rows).first()) == (gone, 0, 0, 0, 0, 0, 0, "", sha(""))
    assert turn_repair.repair(rows, damage=False).first().audit == "KI"


# --- audits -----------------------------------------------------------------

def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((other < place, level[other]) if other < len(level) else None)
        place //= 2
    return out


def plain_manifest(rows):
    spelled = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(spelled, (
        r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups}
    trees = {g: tree([leaf(r) for r in held[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for at, g in enumerate(groups):
        for i, r in enumerate(held[g]):
            way = path(trees[g], i) + path(top, at)
            now = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for step in way:
                now = sha(now if step is None else step[1] + now if step[0] else now + step[1])
            proof = sha("".join(s[1] for s in way if s))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("stride", [1, 2, 8])
def test_manifest_equals_plain(docs, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    got = merkle.manifest(docs, tampered=merkle.one_more_char())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_manifest(document_rows()), key=repr)


def test_manifest_of_few_rows(spark, docs):
    assert merkle.manifest(docs.limit(0)).collect() == []
    for rows in ([document_rows()[1]], [document_rows()[1]] * 3):
        got = merkle.manifest(spark.createDataFrame(rows, DOCS))
        want = [(*w[:5], w[3], True) for w in plain_manifest(rows)]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_manifest_leaves_the_session_alone(spark, docs):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(docs.limit(5)).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert not any(t.name.startswith("merkle") for t in spark.catalog.listTables())
