"""Substring dedup, SimHash and decontamination against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from calstack.llm import decontaminate, jaccard, simhash, substrings
from calstack.llm.common import stored

SCHEMA = "doc_id long, text string, n_words string, row string, id string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def some_texts(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.choice((0, 3, 34, 35, 36, 80, 200)))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), passage)
        if i % 7 == 0 and texts:
            own = [texts[rng.randrange(len(texts))] or ""]
        texts.append(rng.choice((" ", "\n", "\t ", "\x0b")).join(own))
    return [*texts, None, "", "  \n", " ".join(["same"] * 90), "a b   c", texts[0], "z " * 5000]


def brute_passages(texts, window):
    seen, out = Counter(), []
    split = [(t or "").encode().split() for t in texts]
    for words in split:
        seen.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    for words in split:
        drop = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                drop.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in drop]
        out.append((len(words), len(drop), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "window", "anchor"), [(1, 35, 8), (2, 12, 5), (3, 5, 5)])
def test_duplicate_passages(spark, seed, window, anchor):
    texts = some_texts(seed)
    rows = substrings.duplicate_passages(frame(spark, texts), window, anchor).orderBy("id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == brute_passages(texts, window)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in rows)


def test_duplicate_passages_of_an_empty_table(spark):
    assert substrings.duplicate_passages(frame(spark, [])).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, distance):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[find(i)].append(ids[i])
    return [min(least[find(i)]) for i in range(len(fps))]


def test_near_duplicates(spark):
    texts = some_texts(4, 40)
    base = [f"v{i % 97}" for i in range(900)]
    for i in range(60):
        copy = list(base)
        copy[i * 13] = f"x{i}"
        texts.append(" ".join(copy).upper() if i % 2 else " ".join(copy))
    rows = {r.id: r for r in simhash.near_duplicates(frame(spark, texts, start=5)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    ids = list(range(5, 5 + len(texts)))
    assert [rows[i].fp % (1 << 64) for i in ids] == fps
    assert [rows[i].component_id for i in ids] == brute_components(fps, ids, 4)


def test_near_duplicates_without_ids(spark):
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, None), (7, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 7), (7, 7), (7, 7)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cuts", [0, 1, 4])
def test_shards_hold_every_link(cuts):
    rng = np.random.default_rng(cuts)
    centres = rng.integers(0, 1 << 63, 60, np.int64).view(np.uint64)
    fps = [centres]
    for _ in range(12):
        flips = np.zeros(60, np.uint64)
        for _ in range(3):
            flips |= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        fps.append(centres ^ flips)
    fps = np.unique(np.concatenate(fps))
    row, shard = simhash.shards_of(fps, cuts, 1)
    pairs = set()
    for s in np.unique(shard).tolist():
        own = row[shard == s]
        pairs |= {(int(own[a]), int(own[b])) for a, b in simhash.shard_links(fps[own], simhash.masks()[s >> 40], 4)}
    up = simhash.Forest(len(fps))
    for a, b in pairs:
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 4
        up.join(a, b)
    want = brute_components([int(f) for f in fps], list(range(len(fps))), 4)
    assert [up.find(i) for i in range(len(fps))] == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (98, 99)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 99: 98, 100: 98}


def brute_contamination(texts, items, window):
    out = []
    for text in texts:
        words = decontaminate.words_of(text)
        hit, found = set(), set()
        for item, t in items:
            own = decontaminate.words_of(t)
            m = min(window, len(own))
            for p in {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else ():
                for i in range(len(words) - m + 1):
                    if tuple(words[i : i + m]) == p:
                        hit.update(range(i, i + m))
                        found.add(item)
        out.append((len(words), sorted(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("block_bytes", [8_000_000, 200])
def test_contamination(spark, block_bytes):
    rng = random.Random(9)
    words = ["the", "of", "Éa", "b2", "c", "日本", "d"]
    texts = [rng.choice((" ", ", ")).join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 40)))) for _ in range(50)] + [None, "THE of"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 6, 9))))) for i in range(14)] + [(20, None), (21, ""), (22, "?!"), (23, "the OF!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(frame(spark, texts), benchmark, window=4, block_bytes=block_bytes).orderBy("id").collect()
    assert [(r.n_words, r.hits, r.items) for r in rows] == brute_contamination(texts, items, 4)
    assert decontaminate.contamination(frame(spark, []), benchmark).count() == 0
    assert decontaminate.contamination(frame(spark, ["a b"]), benchmark.limit(0)).first().hits == []


def brute_jaccard(texts):
    """The groups of J >= 0.8 by lower-cased five-word shingles, over all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared, n = len(sets[i] & sets[j]), len(sets[i]) + len(sets[j])
            if 9 * shared >= 4 * n:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], sets


def near_copies(seed, n=40):
    """Texts and copies of them with so many words changed that J is 0.7 to 1; many
    of one text, a chain, and a line that all texts end with."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 8, 60, 200, 400)))]
        texts.append(" ".join([*words, *"the same line is in all of them".split()]))
        for _ in range(30 if i == 0 else 2):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join([*copy, *"THE same line is in all of them".split()]))
    return [*texts, None, "", " \n", "É a b c d e", "é a b c d e", texts[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_stage_links_all_of_similarity(spark, seed):
    import corpus_pipeline

    texts = near_copies(seed)
    roots, sets = brute_jaccard(texts)
    similar = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a | b]
    assert sum(0.8 <= x < 0.95 for x in similar) > 20
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, texts), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots))


@pytest.mark.parametrize(("chunk", "n_edges"), [(1, 60), (7, 200), (65_536, 200), (65_536, 0)])
def test_components_of_random_edges(spark, monkeypatch, chunk, n_edges):
    rng = random.Random(n_edges + chunk)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(n_edges)] + [(200 + i, 201 + i) for i in range(50 if n_edges else 0)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    monkeypatch.setattr(simhash, "CHUNK_EDGES", chunk)
    rows = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in rows) == sorted((x, find(x)) for x in up if find(x) != x)


@pytest.mark.parametrize(("last", "tables"), [(1 << 19, 2), (40, None), (8, None)])
def test_few_edges_end_without_rounds(spark, monkeypatch, last, tables):
    rng = random.Random(last)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(400 + i, 401 + i) for i in range(80)]
    up = simhash.Forest(500)
    for a, b in edges:
        if up.find(a) != up.find(b):
            up.join(a, b)
    written = []

    def counted(df, name, instead_of=None):
        written.append(name)
        return stored(df, name, instead_of)

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(simhash, "CHUNK_EDGES", 16)
    monkeypatch.setattr(simhash, "LAST_EDGES", last)
    rows = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    least = {}
    for x in range(500):
        least.setdefault(up.find(x), x)
    assert sorted((r.node, r.root) for r in rows) == [(x, least[up.find(x)]) for x in range(500) if least[up.find(x)] != x]
    assert tables is None or len(written) == tables


def test_neighbours_connect_a_large_group_by_few_pairs(spark):
    rng = random.Random(4)
    first, n = [f"w{i}" for i in range(150)], 600
    texts = []
    for _ in range(n):
        copy = list(first)
        for at in rng.sample(range(150), 2):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = frame(spark, texts).selectExpr("doc_id AS row", "text")
    lists = stored(jaccard.postings(jaccard.shingled(docs)), "postings")
    rows = lists.count()
    near = jaccard.neighbours(lists)
    assert near.count() <= jaccard.NEIGHBOURS * rows
    found = [jaccard.shingles(t) for t in texts]
    node = {jaccard.node_of(s): s for s in found}
    links = [(r.a, r.b) for r in near.collect() if 9 * len(np.intersect1d(node[r.a], node[r.b])) >= 4 * (len(node[r.a]) + len(node[r.b]))]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    left = jaccard.others(lists, spark.createDataFrame(list(roots.items()), "node long, root long")).count()
    assert left < n * n / 40


@pytest.mark.parametrize("n", [1, 64, 65, 900])
def test_tree_search_finds_all_within_the_radius(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, (9, jaccard.FP_WORDS), np.int64).view(np.uint64)
    bits = np.unpackbits(centres.view(np.uint8), axis=1)[rng.integers(0, 9, n)] ^ (rng.random((n, 64 * jaccard.FP_WORDS)) < rng.choice((0, 0.1, 0.2, 0.5), (n, 1)))
    fps = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)
    queries = np.arange(0, n, 3)
    found = [(q, p) for i, j in jaccard.tree_search(fps, queries) for q, p in zip(i.tolist(), j.tolist(), strict=True)]
    ints = [int.from_bytes(f.tobytes(), "little") for f in fps]
    assert len(found) == len(set(found))
    assert set(found) == {(q, p) for q in queries.tolist() for p in range(n) if (ints[q] ^ ints[p]).bit_count() <= jaccard.RADIUS}


def test_fingerprints_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(5)
    for n in (4, 8, 40, 400):
        apart = []
        for _ in range(500):
            a = rng.integers(-(1 << 63), 1 << 63, n + n // 4, np.int64)
            apart.append(int(jaccard.apart(jaccard.fingerprint(np.unique(a)), jaccard.fingerprint(np.unique(a[:n])))))
        assert np.mean(apart) + 5 * np.std(apart) < jaccard.RADIUS
    assert jaccard.apart(jaccard.fingerprint(a), jaccard.fingerprint(np.unique(~a))) > jaccard.RADIUS


def test_a_large_group_of_near_copies_makes_few_rows(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(8)
    first, n = [f"w{i}" for i in range(150)], 400
    texts = []
    for i in range(n):
        copy = list(first)
        for at in rng.sample(range(150), 2 if i % 10 else 5):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = defaultdict(int)

    def counted(df, name, instead_of=None):
        made = stored(df, name, instead_of)
        rows[name] += made.count()
        return made

    monkeypatch.setattr(jaccard, "stored", counted)
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, texts), "").collect()
    roots, _ = brute_jaccard(texts)
    assert 1 < len(set(roots)) < n / 2
    assert sorted(r.doc_id for r in kept) == sorted(set(roots))
    assert rows["wanted"] == rows["sets"] <= n
    assert rows["forest"] + rows["links"] < 12 * n


def test_pairs_of_whole_sets_and_guests():
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 40), 1 << 40, 60)
    sets = [np.unique(rng.choice(base, k)) for k in (0, 0, 5, 200, 220, 240, 260, 300)]
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))}
    i, j = jaccard.linked(sets)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(i, j) for i, j in near if i < j}
    i, j = jaccard.linked(sets[:5], sets[5:])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(i - 5, j) for i, j in near if i >= 5 and j < 5}


def test_long_words_are_told_apart(spark):
    def word(i, j):
        letters = ["a"] * 5000
        letters[i], letters[j] = "b", "c"
        return "".join(letters)

    tail = " ".join(f"t{i}" for i in range(34))
    texts = [f"{word(7, 7 + 4096)} {tail}", f"{word(7 + 4096, 7)} {tail}", f"{'x' * 9000} {tail}"]
    rows = substrings.duplicate_passages(frame(spark, texts)).collect()
    assert [r.n_removed for r in rows] == [0, 0, 0]
    rows = substrings.duplicate_passages(frame(spark, [*texts, texts[0]])).orderBy("id").collect()
    assert [r.n_removed for r in rows] == [35, 0, 0, 35]


@pytest.mark.parametrize("seed", range(30))
def test_greedy_factors_cover_all_that_repeats(seed):
    rng = random.Random(seed)
    block = [b" ".join(rng.choice((b"a", b"b")) for _ in range(rng.randrange(4, 40))) for _ in range(8)]
    parsed = [rng.random() < 0.7 for _ in block]
    split = [t.split() for t in block]
    seen = Counter(tuple(w[i : i + 4]) for w in split for i in range(len(w) - 3))
    want = {(p, i) for p, w in enumerate(split) for i in range(len(w) - 3) if parsed[p] and seen[tuple(w[i : i + 4])] > 1}
    factors = list(substrings.greedy(block, 4, parsed))
    got = [(p, i) for p, first, n in factors for i in range(first, first + n)]
    assert len(got) == len(set(got))
    assert set(got) == want
    for p, first, n in factors:  # none can be longer
        words = split[p][first : first + n + 3]
        longer = [*words, *split[p][first + n + 3 : first + n + 4]]
        places = [(q, j) for q, w in enumerate(split) for j in range(len(w) - len(words) + 1) if w[j : j + len(words)] == words and (q, j) != (p, first)]
        assert places
        assert len(longer) == len(words) or not any(split[q][j : j + len(longer)] == longer for q, j in places)


def test_hot_anchors_are_counted(spark, monkeypatch):
    texts = some_texts(1)
    monkeypatch.setattr(substrings, "BLOCK_PHRASES", 2)
    rows = substrings.duplicate_passages(frame(spark, texts)).orderBy("id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == brute_passages(texts, 35)


@pytest.mark.parametrize(("window", "anchor", "length"), [(35, 8, 12), (35, 8, 40), (12, 5, 8), (5, 5, 5)])
def test_a_passage_in_many_texts_lists_few_windows(spark, monkeypatch, window, anchor, length):
    rng = random.Random(length)
    common = [f"c{i}" for i in range(length)]
    texts = []
    for i in range(120):
        own = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(2)]
        if i % 5 == 0:  # shares a part of the surroundings with another text
            own[0][20:] = [f"s{i // 10}_{k}" for k in range(20)]
        texts.append(" ".join([*own[0], *common, *own[1]]))
    texts += ["p q r " * 60, *texts[:6]]
    listed = {}

    def counted(df, name, instead_of=None):
        made = stored(df, name, instead_of)
        if name == "windows":
            listed[name] = made.count()
        if name == "parsed":
            listed["pieces"] = made.select(F.sum(F.size("pieces"))).first()[0]
        return made

    monkeypatch.setattr(substrings, "stored", counted)
    monkeypatch.setattr(substrings, "BLOCK_PHRASES", 1)
    rows = substrings.duplicate_passages(frame(spark, texts), window, anchor).orderBy("id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == brute_passages(texts, window)
    if length == 12:
        assert 120 < listed["pieces"] < 120 * 28 / 3 and listed["windows"] < 120 * 28 / 3


def test_rows_that_move_are_stored_first(spark):
    texts = some_texts(2)
    mixed = frame(spark, texts).repartition(3).orderBy("text").repartition(5, "text")
    rows = substrings.duplicate_passages(mixed).orderBy("id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == brute_passages(texts, 35)


def test_search_tables_are_small():
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    items = [(str(i), " ".join(words[i * 100 : i * 100 + 100]).encode()) for i in range(3000)]
    made = decontaminate.tables(items, 10)
    size = sum(len(t) for _, t in items)
    assert sum(x.nbytes for x in made.values()) < 9 * size
    docs = [b"x y " + items[7][1][:200], b"nothing here at all that is in any of them"]
    found = list(decontaminate.Searcher(made).occurrences(decontaminate.Words(docs)))
    assert {(t, n) for t, _, _, names in found for n in names} == {(0, "7")}


@pytest.mark.parametrize("seed", range(40))
def test_occurrences_are_all_found(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c"][: rng.randrange(1, 4)] + ["Ü"] * (seed % 2)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(6)]
    items = [(i, ". ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(5)]
    made = decontaminate.tables([(str(i), t.encode()) for i, t in items], 4)
    hits, names = [set() for _ in texts], [set() for _ in texts]
    for text, first, m, found in decontaminate.Searcher(made).occurrences(decontaminate.Words([t.encode() for t in texts])):
        hits[text].update(range(first, first + m))
        names[text].update(found)
    assert [(sorted(a), sorted(b)) for a, b in zip(hits, names, strict=True)] == [(h, i) for _, h, i in brute_contamination(texts, items, 4)]


def test_contamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "y", "z"), (1, "a b c d", "x", "y", "z"), (None, "q", "x", "y", "z")], "doc_id long, text string, hits string, items string, n_words string")
    benchmark = spark.createDataFrame([(5, "b c"), (None, "c d")], "item_id long, text string").withColumn("item", F.lit(1))
    made = decontaminate.marked(docs, benchmark)
    assert made.columns == [*docs.columns, "n_words_", "hits_", "items_"]
    assert sorted((r.doc_id or 0, r.n_words_, r.hits_, r.items_) for r in made.collect()) == [(0, 1, [], []), (1, 4, [1, 2, 3], ["5"]), (1, 4, [1, 2, 3], ["5"])]
