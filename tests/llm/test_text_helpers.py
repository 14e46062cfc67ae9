import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import bpe, language, packing, textbatch
from loomline.llm.crf import Graph, Model
from loomline.llm.formatting import sort_json_fields
from loomline.llm.mixture import bounded_knapsack, plan_bucket

ODD = ["don't we'll 's 'll x's ''s 've're'm  'd", "  a  b \n\n c\t\td   ", " \n x", "é é", "0123 ١٢ ½", "x\x1cy\x85q\xa0r", "aaaaaaaaaaa", "🙂🙂 👩‍👩‍👧", "<|endoftext|> hi", "", "İıŞğ"]


def odd_texts(n=400):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("a bs'tlver \n\t1.é​I漢") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_batches_of_texts():
    b = textbatch.TextBatch(pa.array(["Straße ÇIĞ", None, "", "STRASSE çığ", "dar ge​çit", "Geçit"]))
    w = b.words()
    assert w.doc.tolist() == [0, 0, 3, 3, 4, 4, 5] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[5] == w.hash[6]
    assert w.length.tolist() == [6, 3, 7, 3, 3, 5, 5]
    empty = textbatch.TextBatch(pa.array([], pa.string()))
    assert empty.n == 0 and len(empty.words().hash) == 0
    sliced = pa.array(["x", "yy", "zz z"]).slice(1)
    assert textbatch.TextBatch(sliced).words().length.tolist() == [2, 2, 1]


def test_slices_keep_rows_and_long_texts():
    rows = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a", "b" * 3_000_000, None, "c", "d" * 10])], ["i", "t"])
    parts = list(textbatch.slices(iter([rows]), "t"))
    assert [i for p, _ in parts for i in p.column(0).to_pylist()] == [0, 1, 2, 3, 4]
    assert sum(len(b.cp) for _, b in parts) == 3_000_012


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_equals_the_public_library(name):
    texts, vocab = odd_texts(), bpe.vocabulary(bpe.default_path(name))
    got = vocab.encode(textbatch.TextBatch(pa.array(texts))).to_pylist()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(bpe.default_path(name))
        t.encode_special_tokens = True
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    else:
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_path(name), "rb"))}
        e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        want = [e.encode_ordinary(x) for x in texts]
    assert got == want
    assert [vocab.decode(x) for x in got] == texts
    assert vocab.count(textbatch.TextBatch(pa.array(texts))).tolist() == list(map(len, want))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_long_pieces_merge_as_short_ones(name):
    rng, vocab = random.Random(2), bpe.vocabulary(bpe.default_path(name))
    for _ in range(30):
        pieces = [bytes(rng.choice(rng.choice([b"etaoinshrdlu", b"aaab", bytes(range(256)), b"a"])) for _ in range(rng.choice([1, 5, 300, 2000]))) for _ in range(4)]
        symbols, sizes = vocab.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], np.array([len(p) for p in pieces])
        for a, b in zip(vocab.merge(symbols, sizes), vocab.merge_long(symbols, sizes)):
            assert a.tolist() == b.tolist()
    assert vocab.decode(vocab.encode(textbatch.TextBatch(pa.array(["etaoin" * 100_000]))).to_pylist()[0]) == "etaoin" * 100_000


def test_transition_scan_equals_a_loop():
    rng = np.random.default_rng(2)
    symbols, first = rng.integers(0, 7, 3000).astype(np.uint8), rng.random(3000) < 0.05
    first[0] = True
    state, want = 0, []
    for s, f in zip(symbols, first):
        state = 0 if f else state
        want.append(state)
        state = bpe._NEXT[s, state]
    for block in (8, 64, 4096):
        assert bpe.scan(symbols, first, block).tolist() == want


def test_products_are_those_of_bundled_vectors():
    p = language.Profiles.fit([("en", "the cat sat on the mat"), ("tr", "kedi paspasın üstüne oturdu")])
    text = textbatch.TextBatch(pa.array(["the old cat sat"]))
    g = language.Grams(text)
    vectors = language._gram_vectors(g.gram[g.valid])
    assert vectors.shape[1] == language.DIMENSION and set(np.unique(vectors)) == {-1.0, 1.0}
    s = p.score(text)
    assert np.allclose(s.scores.sum(0), p.products[g.gram[g.valid]].sum(0)[: len(p.languages)], atol=1e-4)
    assert p.languages[int(s.scores.sum(0).argmax())] == "en"


def test_json_fields_are_sorted_wherever_they_stand():
    a = 'x {"b": 1, "a": {"d": 2.50, "c": [1, "é"]}} y { not json'
    b = 'x {"a":{"c":[1,"é"],"d":2.50},"b":1} y { not json'
    letters = lambda s: "".join(c for c in unicodedata.normalize("NFC", sort_json_fields(s)) if c.isalnum())
    assert letters(a) == letters(b) and letters(a) != letters(b.replace("2.50", "2.51"))


def test_knapsack_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(rng.sample(range(1, 30), 4))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, 120)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = bounded_knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_bucket_plans_keep_to_repeats_and_budget():
    n, c = np.array([1, 3, 7]), np.array([10, 10, 10])
    assert plan_bucket(n, c, 1000, 2) == (2, pytest.approx(np.zeros(3)))
    base, extra = plan_bucket(n, c, 150, 5)
    assert base == 1 and int((extra * n).sum()) == 40
    assert plan_bucket(n, c, 0, 5)[0] == 0 and plan_bucket(np.array([0]), np.array([4]), 5, 2)[0] == 0
    big = plan_bucket(np.array([10, 11]), np.array([10**7, 10**7]), 10**8 + 3, 1)
    assert int((big[1] * np.array([10, 11])).sum()) == 10**8 + 3


def test_hilbert_curve_visits_every_cell_by_steps():
    grid = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    place = packing.hilbert_index(grid, 2)
    assert sorted(place.tolist()) == list(range(64))
    path = grid[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_best_fit_fills_and_never_overfills():
    sizes = np.array([random.Random(3).randint(0, 100) for _ in range(1)] + [int(x) for x in np.random.default_rng(3).integers(0, 101, 2000)])
    number = packing.best_fit(sizes, 100)
    used = np.bincount(number, sizes)
    assert used.max() <= 100 and used.sum() == sizes.sum() and len(used) <= -(-sizes.sum() // 100) * 1.05


def test_messages_give_exact_marginals_on_a_chain():
    rng = np.random.default_rng(0)
    m = Model(3, 16)
    m.unary[:], m.pair[:] = rng.normal(size=(16, 3)), rng.normal(size=(2, 3, 3))
    f = np.array([[1, 2], [3, 4], [5, 6], [7, 8]])
    g = Graph(np.zeros(4, int), np.zeros(4, int), np.zeros(4, int))
    got = m.marginals(f, g, rounds=8)
    u, want = m.scores(f), np.zeros((4, 3))
    for ys in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(u[i, y] for i, y in enumerate(ys)) + sum(m.pair[0, a, b] for a, b in zip(ys, ys[1:])))
        for i, y in enumerate(ys):
            want[i, y] += w
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-5)


def test_skip_edges_join_recurring_tokens():
    g = Graph(np.array([0, 0, 0, 1, 1]), np.zeros(5, int), np.array([7, 0, 0, 0, 7]))
    assert list(zip(g.left, g.right, g.kind)) == [(0, 1, 0), (1, 2, 0), (3, 4, 0), (0, 4, 1)]
