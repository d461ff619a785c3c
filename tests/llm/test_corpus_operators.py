"""Near duplicates, class model, decontamination, sharding, the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from quillon.llm import class_lm, common, decontam, neardup, sharding

from .helpers import SCHEMA, empty, frame, odd_rows, prose


def near_copies(n_groups=12, size=14, seed=3):
    rnd = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = prose(1000 + g, rnd.choice([5, 60, 200]))
        for _ in range(size):
            words = base.split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice("xx yy zz".split())
            rows.append(" ".join(words))
    shared = prose(5000, 60)
    rows += [shared + " " + prose(6000 + k, 150) for k in range(60)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def brute_components(rows, size, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and den * both >= num * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("size, num, den", [(4, 85, 100), (5, 8, 10), (2, 1, 2)])
def test_join_equals_brute_force(spark, size, num, den):
    rows = near_copies() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one")]
    got = neardup.jaccard_components(frame(spark, rows), size, num, den).collect()
    expected = brute_components(rows, size, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert len(got) == len(rows)


@pytest.mark.parametrize("hot_rank, most", [(6, 4), (1, 4), (3, 1)])
def test_join_with_frequent_shingles_in_a_grid(spark, monkeypatch, hot_rank, most):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "GRID", 3)
    monkeypatch.setattr(neardup, "HOT_RANK", hot_rank)
    monkeypatch.setattr(neardup, "MOST_MATCHES", most)
    rows = near_copies(4, 10)
    texts = frame(spark, rows).selectExpr("doc_id as t", "text")
    rnd = np.random.default_rng(1)
    hot = np.arange(1 << neardup.CELL_BITS)
    counts = rnd.integers(1, 40, len(hot)) if hot_rank == 3 else np.full(len(hot), 8)
    like = neardup.Similarity(8, 10)
    prefixes = [*neardup._prefixes(5, like, hot, counts)(texts.toArrow().to_batches())]
    whole = pa.Table.from_batches(prefixes).to_pandas()
    whole["component"] = whole["t"]
    whole = whole[["t", "n", "l", "cool", "prefix", "component"]]
    batch = pa.RecordBatch.from_pandas(whole, preserve_index=False)
    posts = pa.Table.from_batches([*neardup._postings(like)(iter([batch]))]).sort_by("key")
    hits, wanted = collections.Counter(), {}
    for out in neardup._meet(like)(iter(posts.to_batches(max_chunksize=97))):
        for r in out.to_pylist():
            hits[r["x"], r["y"]] += r["hits"]
            wanted[r["x"], r["y"]] = r["l"] - r["later"]
    found = {frozenset(p) for p, n in hits.items() if n >= wanted[p]}
    shingles = neardup.Shingler(5)
    sets = {i: shingles(t.encode()) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and like.holds(sets[i], sets[j]):
                assert frozenset((i, j)) in found


def test_passages_in_many_documents_hand_on_few_pairs(spark):
    """Documents that share a frequent passage, and are else different."""
    passage = prose(5000, 12)
    rows = [(k, passage + " " + prose(6000 + k, 20)) for k in range(300)] + near_copies(3, 5)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = neardup.jaccard_components(frame(spark, rows), 4, 85, 100).collect()
    expected = brute_components(rows, 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_rows_that_repeat_an_id_keep_the_links_of_their_texts(spark):
    rnd = random.Random(8)
    rows, groups = [], []
    for g in range(20):
        a, b = prose(100 + g, 80), prose(500 + g, 80)
        near = [" ".join(w if k != 3 else "zz" for k, w in enumerate(t.split())) for t in (a, b)]
        i = 10 * g
        # the id 10g + 5 has two texts: one near 10g + 6, one near 10g + 7
        rows += [(i + 5, a), (i + 5, b), (i + 6, near[0]), (i + 7, near[1]), (None, b), (i + 1, near[1] + " end")]
        groups.append((i, a, b, near))
    rnd.shuffle(rows)
    got = collections.defaultdict(set)
    docs = frame(spark, rows)
    out = neardup.jaccard_components(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r["doc_id"]].add(r["component_id"])
    for i, *_ in groups:
        assert got[i + 6] == {i + 5}
        assert got[i + 7] == got[i + 1] == {i + 1}
        assert got[i + 5] == {i + 1, i + 5}
    assert got[None] == {i + 1 for i, *_ in groups}


def test_shingles_of_any_bytes(monkeypatch):
    """Equal sets of words give equal hashes, however the texts are cut."""
    import pyarrow as pa

    rnd = random.Random(4)
    words = ["a", "B", "b", "\u00e9", "xyz", "Z" * 40, "zz", "\u65e5\u672c", "0"]
    texts = [None, "", "  ", "one", " One\n"] + [
        "".join(rnd.choice(words) + rnd.choice([" ", "\t", "\r\n", "\x0b  "]) for _ in range(rnd.randint(0, 60)))
        for _ in range(300)
    ]
    texts.append("x" * 500 + " " + "Y" * 100 + " y")
    expected = [
        len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if (w := (t or "").encode().lower().split()) else 0
        for t in texts
    ]
    whole = pa.array(texts, pa.string())
    plain = [list(s) for s in neardup.Shingler(3).sets(whole)]
    assert [len(s) for s in plain] == expected and plain[3] == plain[4]
    assert [list(s) for s in neardup.Shingler(3).sets(whole.slice(7, 50))] == plain[7:57]
    assert [list(neardup.Shingler(3)((t or "").encode())) for t in texts] == plain
    shifted = [list(s) for s in neardup.Shingler(3).sets(pa.array(["q w " + (t or "") for t in texts[5:305]]))]
    assert all(set(a) <= set(b) for a, b in zip(plain[5:305], shifted) if len(a) > 1)
    for size in (64, 130):  # texts, and words, longer than what is hashed at a time
        monkeypatch.setattr(neardup, "AT_ONCE", size)
        short = [list(s) for s in neardup.Shingler(3).sets(whole)]
        assert short[:-1] == plain[:-1] and [len(s) for s in short] == expected


def test_join_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = neardup.jaccard_components(docs).collect()
    assert len(got) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["component_id"] == 0 and by_id[0]["n_shingles"] == 0
    assert by_id[5]["component_id"] == 4 and by_id[None]["component_id"] is None and by_id[None]["n_shingles"] > 0
    assert neardup.jaccard_components(empty(spark)).count() == 0


def test_profiles_bound_what_is_shared():
    rnd = np.random.default_rng(0)
    for _ in range(100):
        pool = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
        a = np.unique(rnd.choice(pool, rnd.integers(1, 300)))
        b = np.unique(rnd.choice(pool, rnd.integers(1, 50)))
        n, m, most = neardup._most_shared(neardup._profile(a), neardup._profile(b))
        assert (n, m) == (len(a), len(b)) and most >= len(np.intersect1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)}
    assert {r["node"]: r["component"] for r in got} == expected
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_class_scores_base(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(k, prose(k, 50)) for k in range(100, 200)]
    got = class_lm.score_texts(frame(spark, rows), n_frequent=20, n_classes=4).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = collections.Counter(
        (i, held(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n,
         round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4))
        for i, t in rows
    )
    assert expected == collections.Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got
    )
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert class_lm.score_texts(empty(spark)).count() == 0


def test_class_model_learns_the_order_of_classes(spark):
    rnd = random.Random(1)
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    rows = [(i, " ".join(rnd.choice((a, b)[k % 2]) for k in range(40))) for i in range(300)]
    got = class_lm.score_texts(frame(spark, rows), n_frequent=40, n_classes=4).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 5 * len(got)


def test_class_transitions_count_every_training_pair(spark):
    # with one class besides the end's, the whole model is known
    rows = [(k, prose(k, 30 + k % 9)) for k in range(120)] + [(500, None), (501, "")]
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    table = np.zeros((2, 2))  # words, ends
    for i, t in tokens.items():
        for x, y in zip([b" ", *t], t):
            table[int(x == b" "), int(y == b" ")] += not held[i]
    total = np.array([sum(counts.values()) - counts[b" "], counts[b" "]])
    share = total / total.sum()
    step = (table + class_lm.PULL * share) / (table.sum(axis=1, keepdims=True) + class_lm.PULL)
    once = (sum(n == 1 for n in counts.values()) + 0.1) / (total.sum() + 0.2)

    def score(t):
        sum_, before = 0.0, 1
        for w in t:
            of = int(w == b" ") if counts[w] else None
            if of is None:
                sum_ += math.log10(once)
            else:
                p = share[of] if before is None else step[before, of]
                sum_ += math.log10(p * (1 - once) * counts[w] / total[of])
            before = of
        return sum_

    got = class_lm.score_texts(frame(spark, rows), n_frequent=5, n_classes=1).collect()
    assert len(got) == len(rows) and any(r["held_out"] for r in got)
    for r in got:
        assert r["score"] == pytest.approx(score(tokens[r["doc_id"]]), abs=1e-4)


def brute_class_scores(rows, n_frequent, n_classes):
    """The whole model by dictionaries: counts, classes in two steps, transitions."""
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    train = [t for i, t in tokens if zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip([b" ", *t], t))
    words = sorted((w for w in counts if w != b" "), key=lambda w: (-counts[w], class_lm.word_hash(w)))
    frequent = [b" ", *words[: n_frequent - 1]]
    place, k, c = {w: p for p, w in enumerate(frequent)}, len(frequent), n_classes + 1
    bigrams = np.zeros((k, k))
    for (x, y), n in pairs.items():
        if x in place and y in place:
            bigrams[place[x], place[y]] += n
    of = class_lm.exchange_clusters(bigrams, np.array([counts[w] for w in frequent]), n_classes)
    class_of = {w: int(of[p]) for w, p in place.items()}

    def sums():
        table, size = np.zeros((c, c)), np.zeros(c)
        for (x, y), n in pairs.items():
            if x in class_of and y in class_of:
                table[class_of[x], class_of[y]] += n
        for w, n in counts.items():
            if w in class_of:
                size[class_of[w]] += n
        return table, size

    for _ in range(2):
        table, size = sums()
        share = (size + 1) / (size.sum() + c)
        next_ = np.log((table + class_lm.PULL * share) / (table.sum(axis=1, keepdims=True) + class_lm.PULL))
        placed = {}
        for w in words:
            if w in place:
                continue
            gain = np.log(share)
            for (x, y), n in pairs.items():
                if y == w and x in class_of:
                    gain = gain + n * next_[class_of[x]]
                if x == w and y in class_of:
                    gain = gain + n * next_[:, class_of[y]]
            placed[w] = int(np.argmax(gain[: c - 1]))
        class_of |= placed
    table, size = sums()
    total = sum(counts.values())
    once = (sum(n == 1 for n in counts.values()) + 0.1) / (total + 0.2)
    share = (size + 1e-9) / (size.sum() + 1e-9 * c)
    step = (table + class_lm.PULL * share) / (table.sum(axis=1, keepdims=True) + class_lm.PULL)
    out = {}
    for i, t in tokens:
        before, sum_ = n_classes, 0.0
        for w in t:
            if not counts[w]:
                sum_, before = sum_ + math.log10(once), None
                continue
            of_w = class_of[w]
            p = share[of_w] if before is None else step[before, of_w]
            sum_ += math.log10(p * (1 - once) * counts[w] / size[of_w])
            before = of_w
        out[i] = sum_
    return out


def test_scores_equal_the_model_by_brute_force(spark):
    rnd = random.Random(21)
    groups = [[f"{g}{k}" for k in range(25)] for g in "pqr"]
    rows = [
        (i, " ".join(rnd.choice(groups[(k + rnd.randint(0, 1)) % 3]) for k in range(rnd.randint(5, 30))))
        for i in range(150)
    ] + [(500, "never seen words"), (501, None)]
    got = class_lm.score_texts(frame(spark, rows), n_frequent=30, n_classes=4).collect()
    expected = brute_class_scores(rows, 30, 4)
    for r in got:
        assert r["score"] == pytest.approx(expected[r["doc_id"]], abs=1e-6)


def test_words_with_rare_neighbours_alone_are_placed(spark):
    # p and a go before q and b; x stands between rare b's alone, y between rare a's
    rnd = random.Random(2)
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0]
    ids = (i for i in range(1000) if i not in held)
    rows = [(held[0], "p0 b0 x0 b0 p0"), (held[1], "p0 b0 y0 b0 p0")]
    for n in range(200):
        k, p, q = n % 20, f"p{rnd.randrange(3)}", f"q{rnd.randrange(3)}"
        rows.append((next(ids), " ".join([p, q] * 5 + [f"a{k}", q, p, f"b{k}", p, q])))
        rows.append((next(ids), f"{p} b{k} x{k} b{k} {p} {q} a{k} y{k} a{k} {q}"))
    got = class_lm.score_texts(frame(spark, rows), n_frequent=7, n_classes=2).where("held_out").collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[held[0]] > score[held[1]] + 0.5


def test_exchange_never_lowers_the_likelihood():
    rnd = np.random.default_rng(3)
    bigrams = rnd.poisson(1.0, (30, 30)).astype(float)
    bigrams[1:15, 15:] += 6
    counts = bigrams.sum(axis=0) + bigrams.sum(axis=1)

    def likelihood(of):
        m = np.eye(4)[of]
        t = m.T @ bigrams @ m
        f = lambda x: x * np.log(np.maximum(x, 1e-12))
        return f(t).sum() - f(t.sum(axis=0)).sum() - f(t.sum(axis=1)).sum()

    values = [likelihood(class_lm.exchange_clusters(bigrams, counts, 3, k)) for k in range(6)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:])) and values[-1] > values[0]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_passages_with_edits_are_found(spark):
    items = [(k, prose(9000 + k, 30)) for k in range(10)]
    rnd = random.Random(6)
    rows, planted = [], set()
    for i in range(80):
        text = prose(i, 80)
        if i % 4 == 0:
            item, body = rnd.choice(items)
            body = list(body)
            for _ in range(rnd.randint(0, int(0.05 * len(body)))):
                body[rnd.randrange(len(body))] = rnd.choice("xyz")
            text = text[:150] + " " + "".join(body).upper() + "\n " + text[150:]
            planted.add((i, item))
        rows.append((i, text))
    benchmark = spark.createDataFrame(items + [(50, None), (51, ""), (52, "tiny")], "item_id long, text string")
    docs = frame(spark, rows + [(900, None), (901, "")])
    got = decontam.find_benchmark_passages(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    texts, wanted = dict(rows), {k: decontam.normal(t) for k, t in items}
    for r in got:
        piece = decontam.normal(texts[r["doc_id"]])[r["start_char"] : r["end_char"]]
        assert edit_distance(wanted[r["item_id"]], piece) == r["n_edits"] <= 0.05 * len(wanted[r["item_id"]])


def test_decontamination_odd_rows(spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, prose(1)), (2, prose(77))], "item_id long, text string")
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)  # the benchmark in several blocks
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_benchmark_passages(docs, benchmark).collect()}
    assert got == {(4, 1), (5, 1)}
    assert decontam.find_benchmark_passages(empty(spark), benchmark).count() == 0
    assert decontam.find_benchmark_passages(docs, benchmark.limit(0)).count() == 0


def test_short_items_are_found(spark):
    words = "zq", "qzx-qzx", "Qzqzqzqzqzq", "xzqzqxzzqxqzxzqzq", "abcdefghijklmnopqrst", "bcdefghijklmnopqrstuvwx"
    items = [(k, w) for k, w in enumerate(words)]
    rows = [(k, f"{prose(k, 20)} {w} {prose(50 + k, 20)}") for k, w in enumerate(words)]
    # one edit in the middle of an item of 20 and of 23 characters
    rows += [(10, prose(10, 20) + " abcdefghij0lmnopqrst"), (11, prose(11, 20) + " bcdefghijkl0nopqrstuvwx")]
    rows += [(12, prose(12, 20)), (13, "a\0b"), (14, None)]
    benchmark = spark.createDataFrame(items + [(90, None), (91, " \n")], "item_id long, text string")
    got = decontam.find_benchmark_passages(frame(spark, rows), benchmark).collect()
    wanted = {k: decontam.normal(w) for k, w in items}
    expected = {
        (i, k, a, a + len(w), 0)
        for i, t in rows
        for k, w in wanted.items()
        for a in range(len(t or ""))
        if decontam.normal(t).startswith(w, a)
    }
    assert {tuple(r) for r in got if r["n_edits"] == 0} == expected
    assert {k for _, k, *_ in expected} == set(wanted)
    edited = {(r["doc_id"], r["item_id"]) for r in got if r["n_edits"] == 1}
    assert {(10, 4), (11, 5)} <= edited
    texts = dict(rows)
    for r in got:
        piece = decontam.normal(texts[r["doc_id"]])[r["start_char"] : r["end_char"]]
        assert edit_distance(wanted[r["item_id"]], piece) == r["n_edits"] <= 0.05 * len(wanted[r["item_id"]])


def least_edits(item, text):
    """Edits to the nearest stretch of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_search_equals_all_pairs_brute_force(spark):
    rnd = random.Random(12)
    letters = "abcd efgh "
    items = [(k, "".join(rnd.choices(letters, k=rnd.randint(5, 60)))) for k in range(40)]
    items += [(100, "a" * 30), (101, "ab" * 21), (102, "abc")]
    rows = [(900, "a" * 200), (901, "ab" * 60 + "c" + "ab" * 40), (902, "a" * 29)]
    for i in range(60):
        parts = []
        for _ in range(3):
            body = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(body))
                body[at : at + rnd.randint(0, 1)] = rnd.choices(letters, k=rnd.randint(0, 2))
                body = body or ["a"]
            parts += ["".join(rnd.choices(letters, k=rnd.randint(0, 20))), "".join(body)]
        rows.append((i, "".join(parts)))
    docs, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_benchmark_passages(docs, benchmark).collect()
    normal = {k: decontam.normal(t) for k, t in items}
    texts = {i: decontam.normal(t) for i, t in rows}
    expected = {
        (i, k): n
        for i, t in texts.items()
        for k, x in normal.items()
        if x and (n := least_edits(x, t)) <= int(decontam.EDIT_SHARE * len(x))
    }
    best = {}
    for r in got:
        pair = r["doc_id"], r["item_id"]
        best[pair] = min(best.get(pair, 99), r["n_edits"])
        piece = texts[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert edit_distance(normal[r["item_id"]], piece) == r["n_edits"]
    assert best == expected
    clean = decontam.without_passages(docs, benchmark).collect()
    assert {r["doc_id"] for r in clean} == set(texts) - {i for i, _ in expected}


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    [index] = decontam.item_indexes([1], ["a" * 2000])
    tracemalloc.start()
    [spans] = index.search(["a" * 20_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans and all(e == 0 for *_, e in spans) and peak < 500e6


def test_rows_without_passages_keep_their_columns(spark):
    benchmark = spark.createDataFrame([(1, prose(1))], "item_id long, text string")
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = decontam.without_passages(docs, benchmark)
    assert got.schema == docs.schema
    assert sorted(got.collect(), key=str) == sorted(docs.where("text is null or text <> %r" % prose(1)).collect(), key=str)
    assert decontam.without_passages(docs, benchmark.limit(0)).count() == docs.count()
    assert decontam.without_passages(empty(spark), benchmark).count() == 0


def check_shards(rows, got, tolerance):
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    slots = collections.defaultdict(list)
    sizes = collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(sizes.values()) / 16
    assert max(abs(sizes[k] - share) for k in range(16)) <= tolerance


def test_shards_are_even(spark):
    rows = [(k, prose(k % 500, 20 + k % 60)) for k in range(2000)]
    got = sharding.histogram_sort_shards(frame(spark, rows)).collect()
    check_shards(rows, got, 2 * max(len(t) for _, t in rows))
    text = dict(rows)
    for r in got:
        t = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))


def test_a_large_group_of_copies_is_split(spark):
    rows = [(k, "the same text, many times over") for k in range(1500)] + [(2000 + k, prose(k, 5)) for k in range(1500)]
    got = sharding.histogram_sort_shards(frame(spark, rows)).collect()
    check_shards(rows, got, 200)


def test_sharding_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = sharding.histogram_sort_shards(docs).collect()
    assert sorted(r["size"] for r in got)[0] == 1 and len(got) == len(odd_rows())
    assert sharding.histogram_sort_shards(empty(spark)).count() == 0


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(1)), (2, prose(3)), (None, prose(4)), (None, None)]
    rows += [(k, prose(k % 90, 40)) for k in range(10, 400)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, shard int, h string")
    name = sharding.write_shards(docs, str(tmp_path / "a"), 8)
    got = spark.read.parquet(str(tmp_path / "a"))
    assert name == "shard_" and got.columns == [*docs.columns, name]
    assert collections.Counter(map(tuple, got.select(docs.columns).collect())) == collections.Counter(map(tuple, docs.collect()))
    sizes = [r["n"] for r in got.groupBy(name).agg({"text": "count"}).toDF(name, "n").collect()]
    assert len(sizes) == 8 and min(sizes) > 30
    places = sharding.histogram_sort_shards(docs, 8).select("doc_id", "text_crc32", "shard").distinct()
    there = got.selectExpr("doc_id", "crc32(cast(coalesce(text, '') as binary)) as text_crc32", f"{name} as shard")
    assert set(map(tuple, there.collect())) == set(map(tuple, places.collect()))
    sharding.write_shards(empty(spark), str(tmp_path / "b"))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, sf_dir), "test-stage")
        assert after.columns == docs.columns
        assert 0 < after.count() <= n
        assert after.join(docs, "doc_id", "left_anti").isEmpty()
        docs, n = after, after.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids.count() == n and ids.where("octet_length(ids) <> 4 * n_tokens").isEmpty()


def brute_line_fails(line):
    """The line rules of the quality stage, in plain Python."""
    import re

    import regex

    from quillon.llm import quality

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
    n = len(words)
    marks = sum(c in quality.SYMBOLS + "{}=~^\\»›•" for c in line)
    shouted = len(regex.findall(r"\p{Lu}{2}", line))
    return (
        not re.search("[.!?…。！？:;\"'”’»)\\]]([\x20\x09-\x0D]*$|[\x20\x09-\x0D].{20,}$)", line)
        or marks > 0.3 * n
        or line.count("!") > 0.6 * n + 2
        or (n >= 4 and shouted > 0.6 * n)
        or (n >= 10 and len(set(words)) < 0.35 * n)
        or (n <= 20 and re.search("(?i)" + "|".join(quality.BOILERPLATE), line) is not None)
    )


def brute_quality(text):
    """The cleaned text, or None where the document is rejected."""
    import re

    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    words = split(text)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    stay = [x for x in dict.fromkeys(x for x in text.split("\n") if split(x)) if not brute_line_fails(x)]
    kept = sum(len(split(x)) for x in stay)
    if 100 * kept < 50 * len(words):
        return None
    return text if kept == len(words) else "\n".join(stay)


def holds_item(item, text):
    """Whether a stretch of ``text`` is within the edits of ``item``, by the whole table."""
    k = int(decontam.EDIT_SHARE * len(item))
    a, b = decontam._codes(item), decontam._codes(text)
    row, steps = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for code in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (b != code), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > k:
            return False
    return True


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    from quillon.llm import toxicity
    from quillon.llm.bpe import read_ranks

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    texts, own = dict(rows), [x for x in labels if fold(x[0]) != 2 and x[1] is not None]
    model = toxicity.train_nnpu(
        [texts[i] for i, t in sorted(own) if t == 1 and i in texts],
        [t for i, t in sorted(rows) if fold(i) != 2],
        min(max(sum(t for _, t in own) / len(own), 1e-3), 0.9),
    )
    scores = model.scores([t for _, t in rows], {})
    rows = [r for r, s in zip(rows, scores) if s < 0.3]
    rows = [(i, c) for i, t in rows if (c := brute_quality(t)) is not None]
    component = brute_components(rows, 5, 8, 10)
    first = {}
    for i, (n, root) in sorted(component.items()):
        first.setdefault((root if n else ("alone", i)), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(holds_item(x, decontam.normal(t)) for x in items if x)]
    encoder = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    expected = {i: np.array(encoder.encode_ordinary(t), "<u4").tobytes() for i, t in rows}
    got = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected and 20 < len(got) < docs.count()


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """Null, empty, very long, repeated; no rows at all: by every stage alone."""
    import corpus_pipeline

    docs = spark.createDataFrame(odd_rows(), SCHEMA).select(corpus_pipeline.COLUMNS)
    plain = {"toxicity": 12, "quality rules": 5, "n-gram jaccard join": 10, "benchmark decontamination": 12, "byte-level bpe": 12}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir).collect()
        assert len(got) == plain[name], name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_a_long_text_that_repeats_a_line_takes_linear_time(spark):
    import time

    from quillon.llm import quality

    text = "\n".join([f"Some line number {k} is here and ends well." for k in range(60_000)] * 2)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    [r] = quality.line_first_cleaning(docs).collect()
    assert r["n_dup_lines"] == 60_000 and time.time() - began < 60


def test_pipeline_rows_without_own_ids(spark, sf_dir):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null").orderBy("item_id").head()["text"]
    rows = [(None, prose(1)), (None, prose(1) + " end"), (7, prose(2)), (7, prose(2)), (None, prose(2)), (5, prose(2))]
    rows += [(9, prose(3)), (9, prose(4)), (None, prose(5))]
    docs = frame(spark, rows).select(corpus_pipeline.COLUMNS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    alone = [(5, prose(2)), (9, prose(3)), (9, prose(4)), (None, prose(5))]
    assert len(got) == 5 and collections.Counter(alone) <= collections.Counter(got)
    assert sum(t.startswith(prose(1)) for _, t in got) == 1

    rows = [(None, prose(1) + " " + item), (None, prose(2)), (3, prose(3) + " " + item), (3, prose(4)), (4, prose(5))]
    docs = frame(spark, rows).select(corpus_pipeline.COLUMNS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()]
    assert collections.Counter(got) == collections.Counter([(None, prose(2)), (3, prose(4)), (4, prose(5))])


def test_workers_keep_caches_of_their_own_module_only(monkeypatch):
    from functools import lru_cache

    from quillon.llm import common

    @lru_cache
    def own(x):
        return [x]

    @lru_cache
    def other(x):
        return [x]

    own.__module__, other.__module__ = "own", "other"
    released = []
    monkeypatch.setattr(common, "CACHES", [own, other])
    monkeypatch.setattr(common, "release_memory", lambda: released.append(1))
    first, second = own(1), other(1)
    run = common.lean(lambda batches: (b + 1 for b in batches), "own")(iter([1, 2]))
    assert next(run) == 2 and own(1) is first and other(1) is not second and not released
    assert list(run) == [3] and released == [1]


def test_class_model_reads_small_batches(spark):
    from quillon.llm.class_lm import score_texts

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
        assert score_texts(docs).count() == 2
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.set(name, before)
