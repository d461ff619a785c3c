"""Quality rules, token counts, BPE, id files, toxicity, extraction."""

import collections
import random
import re
import zlib
from array import array
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import bpe, html_text, idcodec, quality, tokens, toxicity, units

from .helpers import SCHEMA, empty, frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_base_columns(spark):
    rnd = random.Random(5)
    rows = [(i, t) for i, t, *_ in odd_rows()]
    for i in range(100, 160):
        lines = [" ".join(rnd.choices(["a", "b#", "c|", "dé", "e"], k=rnd.randint(0, 30))) for _ in range(6)]
        rows.append((i, "\n".join(lines)))
    got = quality.line_first_cleaning(frame(spark, rows), keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        w = WORD.findall(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_lines(spark):
    good = "\n".join(prose(k, 60) for k in range(3))
    menu = " | ".join(prose(9, 40).split())
    rows = [
        (1, good), (2, good + "\n" + menu), (3, menu + "\n" + menu.upper()), (4, good + "\nAll rights reserved."),
        (5, "\n".join(" ".join(w + "!!" for w in prose(k, 60).upper().split()) for k in range(3))),
    ]
    got = {r["doc_id"]: r for r in quality.line_first_cleaning(frame(spark, rows)).collect()}
    assert [got[i]["kept"] for i in range(1, 6)] == [True, True, False, True, False]
    assert got[2]["clean_text"] == good and got[4]["clean_text"] == good
    assert quality.line_first_cleaning(empty(spark)).count() == 0


def test_token_counts_equal_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "'s", "<|endoftext|>", "\x85", "\x1c", "　", "12", "!!", "\r\n"]
    rows = [(i, t) for i, t, *_ in odd_rows()]
    rows += [(k, "".join(rnd.choices(parts, k=rnd.randint(1, 60)))) for k in range(100, 500)]
    got = tokens.token_counts(frame(spark, rows), path).collect()
    expected = collections.Counter(
        (i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024)
        for i, t in rows
    )
    assert collections.Counter(map(tuple, got)) == expected
    assert tokens.token_counts(empty(spark), path).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_tiktoken(encoder):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.bpe.ranks, special_tokens={})
    rnd = random.Random(4)
    parts = ["a", "e", "th", "in", " ", "  ", "0", "é", "ß", "\n", "aaaa", "!!", "日", "'s", "\x1c", "　", "\x85"]
    texts = ["".join(rnd.choices(parts, k=rnd.choice([1, 5, 40, 200]))) for _ in range(1500)]
    texts += ["ab" * 20_000 + "a" * 20_001, "", prose(1)]
    for text in texts:
        ids = encoder.encode(text)
        assert array("I", ids).tolist() == library.encode_ordinary(text)
        assert encoder.bpe.decode(array("I", ids)) == text.encode()


def test_bpe_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    got = bpe.encode_texts(frame(spark, rows), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert collections.Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == collections.Counter(
        (i, t or "") for i, t in rows
    )


def test_bpe_of_short_pieces_runs_in_lanes(encoder, monkeypatch):
    """Every piece that fits a lane is merged with the others, none by itself."""
    rnd = random.Random(14)
    some = {"".join(rnd.choices("abcdeéanthi日", k=rnd.randint(1, 20))).encode() for _ in range(5000)}
    some |= {b"a" * k for k in range(1, bpe.LANE_BYTES + 1)} | {b"ab" * 20, b"&" * 40, bytes(range(40))}
    expected = {x: array("I", encoder.bpe.encode_piece(x)).tobytes() for x in some}
    monkeypatch.setattr(bpe.ByteBPE, "encode_piece", None)
    got = encoder.bpe.encode_pieces(list(some))
    assert dict(zip(some, got)) == expected
    assert not encoder.bpe.lanes.root.any() and not encoder.bpe.lanes.leaf.any()  # ready for the next
    texts = pa.array(["", None, " one", "thé anthi!", "x" * 30]).slice(1)
    got = [encoder.decode_column(encoder.encode_column(x)).to_pylist() for x in units.chunks(texts)]
    assert got == [[b"", b" one", "thé anthi!".encode(), b"x" * 30]]


@pytest.mark.parametrize("words", [False, True])
def test_units_in_bytes_equal_those_of_the_pattern(words, monkeypatch):
    monkeypatch.setattr(units, "CHUNK_BYTES", 500)
    rnd = random.Random(15)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "'s", "\x85", "\x1c", "　", "12", "!!", "\r\n", "ü.", "×,", "̈́", "<|x|>"]
    texts = [None, "", *("".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(2000)), " ", "　"]
    got = []
    for some in units.chunks(pa.array(texts).slice(1)):
        cut = units.Cut(some, words, (b"<|x|>",))
        got += [[cut.distinct[k].decode() for k in cut.number[a:b]] for a, b in zip(cut.first, cut.first[1:])]
    runs = re.compile(f"[^{tokens.SPACE}]+") if words else tokens.UNIT
    for text, own in zip(texts[1:], got, strict=True):
        assert "".join(own) == "".join(runs.findall(text))
        ends = {m.end() for m in runs.finditer("".join(own))} if not words else set()
        at = 0
        for unit in own:
            assert unit not in ("x|>", "|x|>", "|>")  # a whole string is not cut
            at += len(unit)
            if words:
                assert not re.search(f"[{tokens.SPACE}]", unit)
            else:
                assert at in ends or re.match(r"[A-Za-z0-9À-ÖØ-öø-ÿ][!-/:-@\[-`{-~]", "".join(own)[at - 1 :])


@pytest.mark.parametrize("ids", [
    np.random.default_rng(1).integers(0, 1 << 32, 150_000).astype(np.uint32),  # too many ids for a block
    np.zeros(5000, np.uint32),
    np.arange(70_000, dtype=np.uint32) * 61_000,
])
def test_ids_of_any_size(ids):
    assert (idcodec.decode_ids(idcodec.encode_ids(ids)) == ids).all()


def test_several_blocks(monkeypatch):
    monkeypatch.setattr(idcodec, "BLOCK", 3000)
    ids = np.random.default_rng(5).integers(0, 300, 10_000).astype(np.uint16)
    blocks = idcodec.encode_ids(ids)
    assert [n for n, *_ in blocks] == [3000, 3000, 3000, 1000]
    assert (idcodec.decode_ids(blocks[1:2]) == ids[3000:6000]).all()  # each on its own


def test_all_orders_are_mixed():
    """Each order's shares make a stream shorter that only this order can tell."""
    rnd = np.random.default_rng(6)
    n = 60_000
    flat = rnd.integers(0, 64, n)
    skewed = np.minimum(rnd.geometric(0.2, n), 63)
    after = rnd.integers(0, 64, (64, 3))
    one, two = [0], [0, 0]
    for k in rnd.integers(0, 3, n):
        one.append(after[one[-1], k])
        two.append((after[two[-1], k % 2] + 7 * two[-2]) % 64)
    bits = [
        8 * sum(len(p) for *_, p in idcodec.encode_ids(np.array(x, np.uint16))) / len(x) for x in (flat, skewed, one, two)
    ]
    assert bits[0] < 6.5 and bits[1] < 4.5 and bits[2] < 2.5 and bits[3] < 3.6, bits


@pytest.mark.parametrize("n", [0, 1, 2, 500, 4096, 4097, 9000])
def test_id_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.3, n), 49_407).astype(np.uint16)
    blocks = idcodec.encode_ids(ids)
    assert (idcodec.decode_ids(blocks) == ids).all()
    if n > 1000:
        assert sum(len(p) for *_, p in blocks) < 2 * n


def test_damaged_block_is_refused():
    ids = np.arange(300, dtype=np.uint16)
    (n, crc, payload), *rest = idcodec.encode_ids(ids)
    with pytest.raises(ValueError, match="checksum"):
        idcodec.decode_ids([(n, crc, payload[:10] + b"\x55\xaa" + payload[12:]), *rest])


@pytest.mark.parametrize("last", [0, 2])
def test_carries_run_through_many_words(last):
    """Intervals around a middle leave open what their words are, until the last."""
    ends = np.array([32767, 32769, 60000, 60000])
    symbols = [[1] * 40 + [last], [1] * 41, [last, *[1] * 39, 2]]
    coder = idcodec._Encoder(len(symbols))
    for now in np.array(symbols).T:
        start = np.append(0, ends)[now]
        choice = (start | (ends[now] - start) << 16).astype(np.uint64)
        coder.choose(len(now), choice, np.full(len(now), 1 << 18, np.uint64))
    words, counts = coder.finish()
    assert words.dtype == np.uint32 and counts.sum() == len(words)
    coder = idcodec._Decoder(words, counts.astype(np.int64))
    packed = [np.full(len(symbols), sum(int(x) << 16 * k for k, x in enumerate(some)), np.uint64) for some in (ends, range(4))]
    model = SimpleNamespace(symbols=np.zeros(1, np.uint16), packed0=np.zeros(1, np.uint64), known=9)
    got = [coder.choose(len(symbols), *packed, model)[0].tolist() for _ in symbols[0]]
    assert got == np.array(symbols).T.tolist()


def test_ids_of_a_task_are_one_block(monkeypatch):
    """Models are built a few times for millions of ids, as each costs as much as its ids."""
    rnd = np.random.default_rng(18)
    ids = np.minimum(rnd.zipf(1.5, 5_000_000), 3000).astype(np.uint16)
    built = []
    monkeypatch.setattr(idcodec, "_Model", lambda *a, own=idcodec._Model: built.append(len(a[0])) or own(*a))
    blocks = idcodec.encode_ids(ids)
    assert len(blocks) == 1 and sum(built) < len(ids) // 2
    assert (idcodec.decode_ids(blocks) == ids).all()


def test_repeats_are_coded_in_little_space():
    ids = np.tile(np.arange(50, dtype=np.uint16) * 900, 80)
    assert sum(len(p) for *_, p in idcodec.encode_ids(ids)) < len(ids) // 4


def test_id_files(spark, monkeypatch):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(7, prose(50 + k)) for k in range(300)]
    monkeypatch.setattr(idcodec, "SEGMENT_IDS", 2000)  # a repeated id spans segments and partitions
    files = idcodec.write_id_files(frame(spark, rows), path)
    got = sorted(idcodec.read_id_files(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    expected, start = collections.Counter(), 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        expected[r["doc_id"], r["n_tokens"], r["ids_crc32"]] -= 1
    assert not any(expected.values()) and len(got) == len(rows)
    again = idcodec.read_id_files(idcodec.write_id_files(frame(spark, rows[::-1]), path)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert idcodec.read_id_files(idcodec.write_id_files(empty(spark), path)).count() == 0


def test_word_ids_equal_the_library():
    """Plain words go to the library's model at once, the others through all of it."""
    path = P.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), idcodec.WordIds(path)

    class Whole:
        met: list[str] = []

        def encode_batch_fast(self, run, **options):
            self.met += run
            return library.encode_batch_fast(run, **options)

    words.tokenizer = Whole()
    rnd = random.Random(16)
    parts = ["a", "The", " ", "\n", "é", "ÀSß", "日", "'s", "'", "'LL", "\x85", "　", "12", "!!", "ü.", "×", "́", "İ.", "Σ", "<", "̸"]
    parts += ["<|endoftext|>", "<|startoftext|>", "ŉ", "K"]
    texts = [None, "", " ", "x" * 99, *("".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3000))]
    for text, got in zip(texts, words.encode(pa.array(texts), 2), strict=True):
        assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids + [2], text
    Whole.met.clear()
    words.encode(pa.array(["Plain wörds, and signs) &&& go ... straight", "12 日"]), 2)
    assert set(Whole.met) <= {"12", "日"}


def test_new_words_go_to_the_model_in_lines(monkeypatch):
    """The model gets new words alone, many at a time, also where words are forgotten."""
    path = P.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), idcodec.WordIds(path)

    class Lines:
        met: list[str] = []

        def encode_batch_fast(self, run, lines=words.lines, **options):
            self.met += run
            return lines.encode_batch_fast(run, **options)

    words.lines = Lines()
    monkeypatch.setattr(idcodec, "LINES", 50)
    rnd = random.Random(17)
    some = sorted({"".join(rnd.choices("abcdeÀéßÿ", k=rnd.randint(1, 9))) for _ in range(600)})
    texts = [" ".join(rnd.choices(some, k=40)) + " " + x for x in (*some, "&&&", "x" * 90, "日本")]
    expected = [library.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    column = pa.array(["?", *texts]).slice(1)
    assert [x.tolist() for x in words.encode(column, 2)] == expected
    assert len(Lines.met) == -(-(len(some) + 2) // 50)
    Lines.met.clear()
    assert [x.tolist() for x in words.encode(column, 2)] == expected
    assert Lines.met == ["x" * 90]  # too long to be kept
    monkeypatch.setattr(idcodec, "KEPT_WORDS", 40)
    monkeypatch.setattr(idcodec, "CUT_BYTES", 900)
    assert [x.tolist() for x in words.encode(column, 2)] == expected
    assert len(words.words) == len(words.ids) < 700


def test_id_files_without_ids(spark):
    files = idcodec.write_id_files(frame(spark, [(i, t) for i, t, *_ in odd_rows()]), P.path("word_bpe_49k.json"))
    whole = sorted(map(tuple, idcodec.read_id_files(files).drop("ids").collect()), key=str)
    got = idcodec.read_id_files(files, with_ids=False).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == whole and not any(r["ids"] for r in got)


def toxic_corpus():
    rnd = random.Random(8)
    bad = ["zorkel", "zorkelish", "zorkels", "vexhead", "vexheads"]
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score_toxicity(docs, model).where("held_out").collect()
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got)
    assert len(got) > 100 and right >= 0.97 * len(got)


def test_toxicity_never_reads_held_labels(spark):
    rows, labels = toxic_corpus()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    turned = [(i, q, 1 - t if fold(i) == 2 else t) for i, q, t in labels]
    docs = frame(spark, rows)
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.fit_toxicity(docs, spark.createDataFrame(x, schema)) for x in (labels, turned))
    assert a == b


def test_fitting_on_the_executors_equals_training_on_texts(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit_toxicity(
        frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    texts, own = dict(rows), [r for r in labels if fold(r[0]) != 2]
    plain = toxicity.train_nnpu(
        [texts[i] for i, _, t in sorted(own) if t],
        [t for i, t in sorted(rows) if fold(i) != 2],
        sum(t for *_, t in own) / len(own),
    )
    assert set(model.weights) == set(plain.weights) and model.weights
    assert all(model.weights[f] == pytest.approx(w, abs=1e-6) for f, w in plain.weights.items())


def test_kept_columns_with_names_of_results(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", 7)], "doc_id long, text string, score int, text_ string, row int")
    got = toxicity.score_toxicity(docs, toxicity.ToxicityModel({}, -1.0), keep=["doc_id", "score", "text_", "row", "text"])
    assert got.columns == ["doc_id", "text_", "row", "text", "held_out", "score", "predicted"]
    assert [r["text_"] for r in got.collect()] == ["x"]


def test_toxicity_odd_rows(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    got = toxicity.score_toxicity(odd, model, keep=["doc_id", "text", "n"]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    none = toxicity.fit_toxicity(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.weights == {}


def test_nnpu_risk_stays_bounded():
    texts = [prose(k, 40) for k in range(60)]
    model = toxicity.train_nnpu([t + " zorkel" for t in texts[:20]], texts, 0.3, rounds=100)
    low, high = model.scores(["plain words only", "zorkel again"], {})
    assert low < 0.3 <= high


def test_crf_on_pages_it_has_not_seen():
    model = html_text.page_model()
    wrong = total = 0
    for html, labels in html_text.labelled_pages(150, seed=1234):
        got = model.decode(html_text.block_features(html_text.leaf_blocks(html)))
        assert len(got) == len(labels)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(got, labels))
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_sequence():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        n = int(rnd.integers(1, 7))
        weights = {f"f{i}": rnd.normal(size=2) for i in range(n)}
        crf = html_text.ChainCRF(weights, rnd.normal(size=(2, 2)))
        features = [[f"f{i}"] for i in range(n)]
        e = crf.emissions(features)

        def value(seq):
            return sum(e[i, x] for i, x in enumerate(seq)) + sum(crf.transition[a, b] for a, b in zip(seq, seq[1:]))

        best = max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert value(crf.decode(features)) == pytest.approx(best)


def test_extraction(spark):
    html = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li>"
        "<li><a href=y>News</a></li></ul></nav><div class='ad'>Buy now. Really.</div><article><h1>A &amp; B</h1>"
        "<p><b>First  words of the<br>article are here, and they go on for a while.<p>Second &lt;part&gt; is here "
        "too, with some more words in it.</article><footer>&copy; 2020 us. All of it.</footer>"
    )
    expected = "A & B First words of the article are here, and they go on for a while. Second <part> is here too, with some more words in it."
    pages = spark.createDataFrame(
        [(1, "u", html, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", html, "x"), (None, "u", "<p", "x")],
        "page_id long, url string, html string, text string",
    )
    got = html_text.extract_pages(pages).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [
        (1, expected, len(expected)), (2, "", 0), (3, "", 0), (1, expected, len(expected)), (None, "", 0)
    ]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("head", [
    "<html><head><title>T</title></head><body>", "<html><head><title>T</title><body>", "<title>T</title><body>",
    "<!DOCTYPE html><head><meta charset=utf-8><title>T</title><style>p{}</style>", "<head><title>T</title>", "",
])
def test_optional_tags_may_be_left_out(head):
    article = "<article><h1>A title of it</h1><p>First words of the article are here, and they go on.<p>Second and last part of the article, which ends."
    nav = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>"
    expected = "A title of it First words of the article are here, and they go on. Second and last part of the article, which ends."
    assert html_text.main_text(head + nav + article + "</article><footer>&copy; 2020 us.", html_text.page_model()) == expected
    blocks = [t for t, *_ in html_text.leaf_blocks(head + "plain text<p>more")]
    assert blocks == ["plain text", "more"]


def test_deep_pages_take_linear_memory():
    import time
    import tracemalloc

    def peak(depth):
        html = "".join(f"<div class=c{k % 7}>words of level {k}" for k in range(depth))
        tracemalloc.start()
        blocks = html_text.leaf_blocks(html)
        features = html_text.block_features(blocks, html_text.page_model().weights)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(features) == depth
        return most

    html_text.page_model()
    began = time.time()
    assert peak(8000) < 3 * peak(4000) and peak(4000) < 30e6
    assert time.time() - began < 20
    assert html_text.main_text("</div>" * 5000 + "<p>" * 5000, html_text.page_model()) == ""


def test_blocks_of_the_real_pages(spark, sf_dir):
    """All rows of ``pages``, labelled by what was seen in them: every page is a
    menu, one advert, an article (a title and paragraphs) and a footer."""
    model = html_text.page_model()
    right = found = wanted = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        blocks = html_text.leaf_blocks(r["html"])
        labels = model.decode(html_text.block_features(blocks, model.weights))
        article = {t for t, *_ in html_text.leaf_blocks(re.search(r"(?s)<article>.*?(?=</article>|$)", r["html"])[0])}
        outside = {t for t, *_ in html_text.leaf_blocks(re.sub(r"(?s)<article>.*?(</article>|$)", "", r["html"]))}
        for (text, _, _), label in zip(blocks, labels):
            assert (text in article) or (text in outside)
            own = text in article and text not in outside
            right, found, wanted = right + (own and label), found + label, wanted + own
    assert wanted > 300 and right / found > 0.99 and right / wanted > 0.99
