"""Every dealt operator against a plain version on small tables with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import (
    components,
    curriculum,
    exact_dedup,
    id_store,
    license_scan,
    packing,
    quality,
    simhash,
    spotsigs,
    suffix_dedup,
    token_counts,
)
from rosterline.llm.queries import op10_suffix_dedup, vocabulary
from rosterline.session import shared_dir

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use inside.
    "uid string, size string, row string, at string, fp string, words string, kept string"
)


def sentence(rnd, n):
    return " ".join(rnd.choice(["the", "of", "Été", "is", "river", "stone", "Licence,", "42", "x!"]) for _ in range(n))


def awkward():
    rnd = random.Random(11)
    texts = [sentence(rnd, rnd.randint(1, 60)) for _ in range(25)]
    passage = sentence(rnd, 120)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(30, texts[3], "en", "s1"), (31, texts[3], None, None), (32, "", "en", "s1"), (33, None, None, "s2")]
    rows += [(40, passage + " tail one", "en", "s0"), (41, "head two " + passage, "en", None)]
    rows += [(42, " \t\n", "en", "s0"), (43, "word " * 6000, "en", "s0"), (44, "y" * 5000, "de", "s2")]
    rows += [(7, texts[7], "en", "s1"), (7, "other text of seven", "en", "s1"), (None, texts[1], "en", "s0")]
    rows += [(None, None, None, None), (50, "All rights reserved. CC BY cc-by", "en", "s1"), (51, "日本語 <|endoftext|> don't", "", "")]
    return [(*r, len(r[1] or ""), *["?"] * 7) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_license_scan(docs, rows):
    got = listed(license_scan.license_report(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    phrases = [(t.label, t.words) for t in license_scan.TEMPLATES if t.phrase]
    import re

    for r in rows:
        words = re.findall(license_scan.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        at = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        places = [i for i, _ in at]
        want.append((r[0], len(words), len(at), min(places, default=None), max(places, default=None),
                     ",".join(sorted({label for _, label in at}))))
    assert got == sorted(want, key=repr)



def test_license_blocks_need_no_single_word(spark):
    texts = [
        "Licensed under the Apche License, Version 2.0",
        "Permission is hereby given, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
        "released under the license", "Released under the MIT license.",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in license_scan.license_report(rows).collect()}
    assert got[0] == ("apache", 0.875) and got[1][0] == "mit" and got[1][1] > 0.9
    assert got[2] == ("", 0.0) and got[3] == ("mit", 1.0)


def test_license_join_equals_all_pairs(spark):
    rnd = random.Random(2)
    words = sorted({w for t in license_scan.TEMPLATES for w in t.words})
    rows = []
    for i in range(60):
        t = rnd.choice(license_scan.TEMPLATES).words
        t = [w for w in t if rnd.random() > 0.12]
        rows.append((i, " ".join([rnd.choice(words) for _ in range(rnd.randint(0, 90))] + t + ["z"] * rnd.randint(0, 70))))
    _, matches = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(r.template for r in matches.filter("not phrase").collect())
    want = Counter()
    for _, text in rows:
        w = text.split()
        for k in range(0, max(1, len(w)), 32):
            block = set(w[k : k + 64])
            for number, t in enumerate(license_scan.TEMPLATES):
                if not t.phrase and len(block & set(t.words)) >= t.needed(0.8):
                    want[number] += 1
    assert got == want and want


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary(spark, "byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in rows:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    pieces = packing.pack(docs, path).collect()
    assert sum(p.length for p in pieces) == sum(n * k for (_, n, _), k in want.items())
    whole = Counter((p.doc_id, p.length, p.ids_crc32) for p in pieces if p.length == p.doc_tokens)
    assert whole - want == Counter()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0 and set(sequences) == set(range(len(sequences)))


def test_least_squares_reaches_a_known_solution():
    combos = packing.combinations(12)
    assert (combos.sum(axis=1) == 12).all() and len(np.unique(combos, axis=0)) == len(combos)
    true = np.zeros(len(combos))
    true[[1, 4, 7]] = [5, 3, 9]
    histogram = np.bincount(combos.ravel(), weights=np.repeat(true, 3), minlength=13)
    histogram[0] = 0
    x = packing.nnls_counts(histogram, combos, 3000)
    fitted = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=13)
    fitted[0] = 0
    assert (x >= 0).all() and np.abs(fitted - histogram).max() < 0.05


def test_exact_dedup(docs, rows):
    got = listed(exact_dedup.exact_duplicates(docs, every_digest=True, filter_bits=64))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert Counter(g[:3] + g[4:] for g in got) == Counter(
        (r[0], top[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest())
        for r in rows
    )
    assert sum(g[3] for g in got) == len(groups) and all(g[0] == g[1] for g in got if g[3])
    assert sorted(r.text or "" for r in exact_dedup.drop_copies(docs).collect()) == sorted(groups)


def test_token_counts_and_prefixes(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary(spark, "word_bpe_49k.json")
    library = Tokenizer.from_file(path)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    got = listed(token_counts.token_counts(docs, path, limit=50))
    assert got == sorted(((r[0], len((r[1] or "").encode()), count(r[1] or ""), count(r[1] or "") > 50) for r in rows), key=repr)
    table = token_counts.PrefixCounter(path)
    rnd = random.Random(4)
    for text in ["I'll we're 'sa ''re", *("".join(rnd.choice("abl's \né🙂12-.Σ") for _ in range(25)) for _ in range(60))]:
        normal = library.normalizer.normalize_str(text)
        assert table.prefixes(text).tolist() == [count(normal[:k]) for k in range(len(normal) + 1)]
    assert table.prefixes("a<|endoftext|>b")[-1] == count("a<|endoftext|>b")
    asked = token_counts.token_counts(docs.filter("doc_id = 3"), path, every_prefix=True).select(
        token_counts.tokens_at(F.col("counts"), F.lit(10)).alias("n"),
        token_counts.fitting_prefix(F.col("counts"), F.lit(3)).alias("k"),
    ).first()
    text = library.normalizer.normalize_str(next(r[1] for r in rows if r[0] == 3))
    assert asked.n == count(text[:10])
    assert asked.k == max(k for k in range(len(text) + 1) if count(text[:k]) <= 3)


def test_token_counts_of_very_long_words(spark):
    from tokenizers import Tokenizer

    path = vocabulary(spark, "word_bpe_49k.json")
    library, table = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    rnd = random.Random(6)
    for word in ["a" * 500_000, "".join(rnd.choice("acgt") for _ in range(500_000))]:
        assert table.total(word) == len(library.encode(word, add_special_tokens=False).ids)
        assert max(map(len, table.open)) <= table.longest
    for text in ["ab" * 90 + " c", "'" * 90, "é🙂" * 40 + "x'll" + "y" * 80]:
        normal = library.normalizer.normalize_str(text)
        assert table.prefixes(text).tolist() == [
            len(library.encode(normal[:k], add_special_tokens=False).ids) for k in range(len(normal) + 1)
        ]
    assert len(table.prefixes("a" * 500_000)) == 500_001


def test_mixing(docs, rows):
    import re

    mixed = curriculum.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(curriculum.WORD, r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        left = 0.0
        for s, more in share.items():
            goal[s] += more
            if goal[s] >= 2 * sizes[s]:
                left += goal[s] - 2 * sizes[s]
                goal[s] = 2.0 * sizes[s]
                free.discard(s)
    taken = Counter()
    for m in mixed:
        assert m.source_size == sizes[m.source] and m.target == pytest.approx(goal[m.source])
        assert 0 <= m.taken <= 2 * m.size
        taken[m.source] += m.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order) and len(mixed) == len(rows)
    places = [m.position for m in mixed if m.position is not None]
    assert all(0 <= p <= 1 for p in places)
    again = curriculum.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))
    ordered = curriculum.training_order(docs, length_col="n_chars")
    assert ordered.columns == docs.columns
    assert sum(len(re.findall(curriculum.WORD, r.text or "")) for r in ordered.collect()) == sum(taken.values())


@pytest.mark.parametrize("schedule", curriculum.SCHEDULES)
def test_due_time_inverts_the_integral(spark, schedule):
    shares = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", curriculum.due_time(F.col("s"), schedule).alias("t"))
    for s, t in df.collect():
        grid = np.linspace(0, t, 2001)
        knots, weights = zip(*schedule, strict=True)
        assert np.trapezoid(np.interp(grid, knots, weights), grid) == pytest.approx(s, abs=1e-6)


def test_spot_comparison(docs, rows):
    got = spotsigs.compare_edits(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for i, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[(r[0], len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    spotter = spotsigs.Spotter()
    for g in got:
        a, b = set(spotsigs.decode(g.fingerprint)), set(spotsigs.decode(g.edited_fingerprint))
        assert g.near_edited == pytest.approx(len(a & b) / len(a | b))
    assert spotsigs.encode(spotter.spots("")) == spotsigs.encode(spotter.spots(""))


def test_spots_follow_anchors():
    spotter = spotsigs.Spotter(["the", "is"], chain=2)
    # the-quick-fox, is-far-away; the last "the" has no two content words after it.
    assert len(spotter.spots("The quick fox is far away the end")) == 2
    assert (spotter.spots("the quick is fox") == spotter.spots("The quick, fox? Is it THE"[:15])).all()


def test_spot_near_duplicates(spark):
    rnd = random.Random(9)
    base = [sentence(rnd, 80).split() + [f"w{i}{j}" for j in range(60)] for i in range(4)]
    rows = []
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"new{rnd.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spotsigs.fingerprints(docs)).collect()}
    spotter = spotsigs.Spotter()
    sets = {i: set(spotter.spots(t)) for i, t in rows}
    assert got == union([(a, b) for a in sets for b in sets
                         if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)


def union(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_id_store(spark, docs, rows):
    from tokenizers import Tokenizer

    path, folder = vocabulary(spark, "word_bpe_49k.json"), f"{shared_dir(spark)}/ids-test-{random.random()}"
    library = Tokenizer.from_file(path)
    id_store.write_ids(docs, folder, path)
    id_store.write_index(spark, folder)
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    back = id_store.read_back(spark, folder)
    assert listed(back, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    keys = spark.createDataFrame([(7, 2), (None, 1), (7, 3), (999, 0)], "doc_id long, copy long")
    found = id_store.fetch(spark, folder, keys).collect()
    assert sorted(((f.doc_id, f.copy) for f in found), key=repr) == [(7, 2), (None, 1)]
    seven = next(f for f in found if f.doc_id == 7)
    texts = sorted((r[1] for r in rows if r[0] == 7), key=str.encode)
    assert np.frombuffer(seven.raw, "<u2").tolist() == library.encode(texts[2], add_special_tokens=False).ids + [2]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    copies = np.zeros_like(keys)
    levels, bits, slots = id_store.build_hash(keys, copies)
    assert sorted(slots) == list(range(len(keys)))
    assert (id_store.find_slots(levels, bits, keys, copies) == slots).all()


def test_quality_is_learnt_and_calibrated(spark):
    rnd = random.Random(6)
    good = [sentence(rnd, rnd.randint(20, 80)) for _ in range(150)]
    bad = [" ".join(["SPAM!!"] * rnd.randint(20, 80)) for _ in range(150)]
    texts = good + bad
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    described = quality.describe(docs).cache()
    scores = dict(listed(quality.score(described, quality.fit(described, labels))))
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((scores[i] >= 0.3) == (i < 150) for i in held)
    assert all(0 <= s <= 1 for s in scores.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(150))


def test_isotonic():
    at, level = quality.isotonic(np.arange(5.0), np.array([0.0, 0.6, 0.2, 0.9, 0.8]), np.ones(5))
    assert np.allclose(level, [0.0, 0.4, 0.85]) and np.allclose(at, [0, 1.5, 3.5])


def bits_of(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, rows):
    got = Counter((r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((r[0], bits_of(r[1])) for r in rows)


@pytest.mark.parametrize("node_rows", [512, 16])
def test_trie_join(spark, node_rows, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 9, dtype="u8")
    fps = []
    for _ in range(1500):
        v = base[0] if rng.random() < 0.6 else rng.choice(base)
        for _ in range(rng.integers(0, 9)):
            v ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        fps.append(v)
    fps = np.array(fps + [0], dtype="u8")
    monkeypatch.setitem(simhash.fingerprint_links.__kwdefaults__, "node_rows", node_rows)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(fps.view("i8"))], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert got == union(near.tolist(), range(len(fps)))


def test_near_copies_leave_one(docs, rows):
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert len({bits_of(r.text) for r in left.collect()}) == left.count() == len({bits_of(r[1]) for r in rows})


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)]
    links += [(5, 5), (None, 3), (-7, 40)]
    got = dict(listed(components.components(spark.createDataFrame(links, "a long, b long"))))
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union(real, {n for link in real for n in link})


def plain_removal(rows, length):
    count = Counter()
    for _, b in rows:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc, b in rows:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, docs, rows):
    plain = [(r[0], (r[1] or "").encode()) for r in rows]
    assert listed(suffix_dedup.remove_repeats(docs)) == plain_removal(plain, 400)
    rnd = random.Random(5)

    def text(n):
        return "".join(rnd.choice("abcdé ") for _ in range(n))

    shared, made = [text(450), text(900), text(400)], []
    for i in range(30):
        parts = [text(rnd.randint(0, 500))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            parts += [s[rnd.randint(0, 60) : len(s) - rnd.randint(0, 60)], text(rnd.randint(0, 300))]
        made.append((i, "".join(parts)))
    made += [(90, "ab" * 700), (91, "xyz " * 300), (92, shared[2])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"), filter_bits=64)
    assert listed(got) == plain_removal([(i, t.encode()) for i, t in made], 400)


@pytest.mark.parametrize("filter_bits", [64, 1 << 24])
def test_suffix_dedup_of_repeated_rows(spark, monkeypatch, filter_bits):
    rnd = random.Random(8)

    def text(n):
        return "".join(rnd.choice("abcdé ") for _ in range(n))

    hot, tables = text(3000), {}
    made = [(1, hot)] * 40 + [(2, hot[500:1500] + text(300)), (2, text(200) + hot[900:1310]), (3, text(700))]
    made += [(4, text(50))] * 3 + [(None, text(600))] * 2 + [(5, "ab" * 500)] * 2 + [(6, "ab" * 250)]

    def spy(df, name, plain=suffix_dedup.store):
        tables[name] = plain(df, name)
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "store", spy)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(docs, filter_bits=filter_bits)
    assert listed(got) == plain_removal([(i, t.encode()) for i, t in made], 400)
    # A document's ranges do not grow with the number of its rows.
    assert all(len(r.ranges) == len(set(r.ranges)) for r in tables["repeat-spans"].collect())


def test_suffix_dedup_of_planted_passages(spark, tmp_path):
    """Passages of over 50 words go if they have 400 bytes, and stay if they have fewer."""
    rnd = random.Random(12)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    short, long = words(55), words(60)
    assert len(short) < 400 < len(long)
    made = [(i, f"{words(rnd.randint(1, 90))} {(short, long, '')[i % 3]} {words(rnd.randint(1, 90))}") for i in range(30)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = listed(op10_suffix_dedup(spark, str(tmp_path)))
    want = plain_removal([(i, t.encode()) for i, t in made], 400)
    assert got == sorted(((*r, r[1] - r[2]) for r in want), key=repr)
    removed = {r[0]: r[2] for r in got}
    assert all(len(long) <= removed[i] < len(long) + 20 for i in range(1, 30, 3))
    assert not any(removed[i] for i in range(30) if i % 3 != 1)


def test_sampled_positions_own_every_string_once(monkeypatch):
    data = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    data = np.concatenate([data, data[:2000], np.full(1500, 97, np.uint8)])

    def owned():
        return [(int(p - h), int(p - low)) for at, _, _, lo, hi in suffix_dedup.anchors(data) for p, low, h in zip(at, lo, hi)]

    whole = owned()
    starts = [s for a, b in whole for s in range(a, b + 1)]
    assert sorted(starts) == list(range(len(data) - 399))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    assert owned() == whole


OPERATORS = {
    "license_scan": lambda spark, d: license_scan.license_report(d),
    "packing": lambda spark, d: packing.pack(d, vocabulary(spark, "byte_bpe_50k.json")),
    "exact_dedup": lambda spark, d: exact_dedup.exact_duplicates(d),
    "drop_copies": lambda spark, d: exact_dedup.drop_copies(d),
    "token_counts": lambda spark, d: token_counts.token_counts(d, vocabulary(spark, "word_bpe_49k.json")),
    "mixing": lambda spark, d: curriculum.mix(d),
    "training_order": lambda spark, d: curriculum.training_order(d),
    "spotsigs": lambda spark, d: spotsigs.compare_edits(d),
    "quality": lambda spark, d: quality.keep_good(d, d.selectExpr("doc_id", "1 AS quality")),
    "simhash": lambda spark, d: simhash.near_duplicates(simhash.fingerprints(d)),
    "near_copies": lambda spark, d: simhash.drop_near_copies(d),
    "suffix_dedup": lambda spark, d: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def test_empty_id_store(spark, empty):
    folder = f"{shared_dir(spark)}/ids-empty-{random.random()}"
    id_store.write_ids(empty, folder, vocabulary(spark, "word_bpe_49k.json"))
    id_store.write_index(spark, folder)
    assert id_store.read_back(spark, folder).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_library(name, monkeypatch):
    """Mixed scripts, signs, spaces and special strings, with generations that turn often."""
    import random
    from array import array

    from tokenizers import Tokenizer

    from rosterline.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    codec, library = tokens.Encoder(f"/opt/tokenizers/{name}", 7), Tokenizer.from_file(f"/opt/tokenizers/{name}")
    rng = random.Random(11)
    bits = ["a", "B", "é", "ß", "ÿ", "don", "'t", "'S", " ", "  ", "\n", "\t", "1", "23", ".", ",", "(", "_",
            "́", "漢", "😀", "　", "İ", "ſ", "ª", "×", "\x00", "x" * 70, "<|endoftext|>"]
    texts = ["", " ", *("".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000))]
    want = [array("I", [*library.encode(t, add_special_tokens=False).ids, 7]).tobytes() for t in texts]
    assert codec.encode(texts) == want
    assert len(codec.pieces) <= 50 and len(codec.pieces.old) <= 50
