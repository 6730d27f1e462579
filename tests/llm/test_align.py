"""Packing along the curve, cross-tokenizer alignment and whitening against brute force and odd inputs."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import SF  # noqa: E402
from test_ops import odd_docs  # noqa: E402

from quarryline.llm import crosstoken, packing, queries, sstable, whitening  # noqa: E402

PARTS = ["'s", "'ll", "a", "B", "É", "ß", "ı", "ª", "½", "1", "23", "!", "...", "—", "日本", "ж", " ", "  ", " ", " ", "\n", "\n", "\n\n", " \n", "\n ", "\t", "\r", "\r\n", "\x0b", ";\r"]
PARTS += ["\x1c", "\x85", "\xa0", " ", "é", "\xad", "\x00", "\x7f", "▁", "�", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "x" * 30, "the", "tion", " the", "re", "ll", "s", "🙂", "​"]


def random_texts(rng, n, most=60):
    plain = [p for p in PARTS if p != "▁"]
    return ["".join(rng.choices(PARTS if i % 9 == 0 else plain, k=rng.randint(0, most))) for i in range(n)]


# --- packing


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_cuts_cover_every_token_once():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 3, 10, 33]) for _ in range(rng.randint(1, 9))]
        total, length = sum(sizes), 16
        filled, before = {}, 0
        for n in sizes:
            got = packing.cuts(before, n, total, length)
            assert [s for s, *_ in got] == [sum(x[1] for x in got[:i]) for i in range(len(got))] and sum(x[1] for x in got) == n
            for _, m, seq, offset in got:
                filled.setdefault(seq, []).extend(range(offset, offset + m))
            before += n
        assert sorted(filled) == list(range(len(filled)))
        for x in filled.values():
            assert sorted(x) == list(range(len(x))) and len(x) <= length and len(x) & (len(x) - 1) == 0
        assert sum(map(len, filled.values())) == total


def token_rows(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(sstable.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes()] += 1
    return want


def check_packing(docs):
    pieces = packing.pack(docs).collect()
    want = token_rows(docs)
    if max(want.values(), default=1) == 1 and len({k[0] for k in want}) == len(want):
        by = {}
        for r in pieces:
            by.setdefault(r.doc_id, []).append(r)
        assert len(by) == len(want)
        for doc, n, ids in want:
            own = sorted(by[doc], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) == ids and all(r.doc_tokens == n and len(r.ids) == 4 * r.length for r in own)
            assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    assert sum(r.length for r in pieces) == sum(k[1] * v for k, v in want.items())
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and (n & (n - 1)) == 0 and n <= 2048
    return pieces


def test_packing_equals_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = check_packing(docs)
    digest = queries.queries()["op11_packing"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens, r.sequence_id, r.offset) for r in pieces) == sorted(map(tuple, digest))


def test_packing_of_odd_rows(spark):
    d = odd_docs(spark)
    pieces = check_packing(d)
    assert sum(r.doc_tokens == 1 for r in pieces) == 3 and len({r.sequence_id for r in pieces if r.doc_tokens > 2048}) > 20
    assert packing.pack(d.where("false")).count() == 0
    whole = packing.sequences(packing.pack(d)).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in pieces) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert sum(len(r.pieces) for r in whole) == len(pieces)


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(3)
    topics = [[f"{a}{b}" for a in rng.sample("bcdfghklmnprst", 6) for b in ("an", "el", "or", "ix")] for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(topics[i % 6], k=80))) for i in range(600)], "doc_id long, text string")
    rows = packing.encoded(docs, lambda: sstable._encoder(sstable.default_tokenizer()))
    order = [r.doc_id % 6 for r in rows.join(packing.along_curve(rows), "rid").orderBy("before").collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.6 * len(order)  # one in six by chance


# --- alignment


def brute_alignment(pair, text):
    """(groups, links) of a text by walking over its bytes."""
    ((a, b),) = pair.tokens([text])
    want = (" " + text).encode()
    if not text or pair.joined(a, b) != (want, want):
        return None
    own = [[(k, i) for k, i in enumerate(ids) for _ in data[i]] for ids, data in ((a, pair.a_bytes), (b, pair.b_bytes))]
    links = list(dict.fromkeys(zip(*own, strict=True)))  # occurrence pairs, in order
    groups, part = [], ([], [])
    for i in range(len(want)):
        for side in (0, 1):
            if i + 1 == len(want) or own[side][i + 1] != own[side][i]:
                part[side].append(own[side][i][1])
        if all(i + 1 == len(want) or own[s][i + 1] != own[s][i] for s in (0, 1)):
            groups.append(f"{','.join(map(str, part[0]))}|{','.join(map(str, part[1]))}")
            part = ([], [])
    return len(a), len(b), groups, [(x[1], y[1]) for x, y in links]


def brute_rows(pair, texts):
    known = [brute_alignment(pair, t or "") for t in texts]
    count = Counter(x for k in known if k for x in k[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for k in known:
        if k is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield k[0], k[1], len(k[2]), len(k[3]), sum(count[x] == most[x[1]] for x in k[3]), sum(count[x] for x in k[3]), hashlib.sha256(";".join(k[2]).encode()).hexdigest()


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    return crosstoken.Pair(*map(public_tokenizers.path, (crosstoken.TOKENIZER_A, crosstoken.TOKENIZER_B)))


def test_intervals_of_a_small_case():
    a_at, b_at, a_last, b_last = crosstoken.group_ends(np.array([2, 5, 6]), np.array([1, 2, 6]))
    assert list(zip(a_at.tolist(), b_at.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2)]
    assert crosstoken.groups_text([7, 8, 9], [1, 2, 3], a_last.tolist(), b_last.tolist()) == "7|1,2;8,9|3"


def test_pieces_have_the_tokens_of_the_whole(pair):
    assert pair.cuts
    rng = random.Random(5)
    for t in random_texts(rng, 3000):
        if t and "▁" not in t:
            keys = crosstoken.pieces_of(t)
            pieces = list(map(crosstoken.piece_of, keys))
            assert "".join(pieces) == " " + t
            ((a, b),) = pair.tokens([t])
            own = list(pair.piece_tokens(pieces))
            assert [i for x, _ in own for i in x] == a and [i for _, y in own for i in y] == b, repr(t)


def columns(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("block", [200, crosstoken.BLOCK])
def test_alignment_equals_brute_force(spark, pair, block):
    import public_tokenizers

    rng = random.Random(6)
    texts = [None, "", " ", "\n", "a ", "▁x", *random_texts(rng, 250), "word " * 3000, "longpiece" * 60, *["the same text"] * 3]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = crosstoken.aligned_blocks(docs, *map(public_tokenizers.path, (crosstoken.TOKENIZER_A, crosstoken.TOKENIZER_B)), block=block)
    got = {r.doc_id: columns(r) for r in crosstoken._with_counts(blocks, crosstoken.pair_counts(blocks)).collect()}
    want = dict(enumerate(brute_rows(pair, texts)))
    assert got == want


def test_alignment_query_equals_brute_force(spark, pair):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: x for r, x in zip(docs, brute_rows(pair, [r.text for r in docs]), strict=True)}
    assert {r.doc_id: columns(r) for r in queries.queries()["op12_cross_tokens"](spark, SF).collect()} == want


def test_alignment_of_odd_rows(spark):
    d = odd_docs(spark)
    got, counts = crosstoken.align(d)
    rows = got.collect()
    assert len(rows) == 9 and sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in d.collect())
    assert all(columns(r) == (0, 0, 0, 0, 0, 0, "") for r in rows if r.doc_id in (0, 1))
    total = counts.agg({"count": "sum"}).first()[0]
    assert total == sum(r.n_links for r in rows) and counts.where("best").select("b").distinct().count() == counts.select("b").distinct().count()
    assert crosstoken.align(d.where("false"))[0].count() == 0


# --- whitening


def brute_whitening(vectors, k=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array([[float(Fraction(int(a) * n - int(b), n)) for a, b in zip(r, s)] for r in fit])
    v = centred.T @ centred / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    own = np.array([[float(Fraction(int(a) * n - int(b), n)) for a, b in zip(r, s)] for r in x])
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x], own @ vecs / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, white, explained = brute_whitening([r.embedding for r in rows])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = queries.queries()["op13_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    out = np.empty(white.shape)
    for r in got:
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        out[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((out * white).sum(axis=0))
    assert np.abs(out * sign - white).max() < 1e-7


def test_subspace_iteration_of_a_wide_operator_needs_no_matrix():
    rng = np.random.default_rng(2)
    d, k = 400, 16
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.gamma(2.0, 1.0, d))[::-1]  # no gap behind the sixteenth
    calls = []

    def product(x):
        calls.append(x.shape[1])
        return q @ (values[:, None] * (q.T @ x))

    vectors, got, passes = whitening.subspace_iteration(product, d, k)
    assert np.abs(got - values[:k]).max() < 1e-9 and passes == len(calls) < 60 and max(calls) == k + whitening.OVERSAMPLE
    assert np.abs(np.abs((vectors * q[:, :k]).sum(axis=0)) - 1).max() < 1e-9
    with pytest.raises(RuntimeError):
        whitening.subspace_iteration(product, d, k, passes=2)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = rng.standard_normal((30, 5)).round(3)
    good[:, 4] = good[:, 0]  # rank four
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [nan] * 5, [inf, 0.0, 0.0, 0.0, 0.0], [1e30] * 5, [1.0] * 4, [1.0] * 6]
    vectors = [*good.tolist(), *good[:10].tolist(), *bad]
    data = [(None if i == 3 else i if i != 5 else 4, v, 7, "m") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n long, x string")
    got = whitening.whitened_rows(df).collect()
    n, deviation, white, explained = brute_whitening(vectors[:40], 4)
    assert n == 30 and len(got) == 40 * 4 and {r.component for r in got} == {1, 2, 3, 4} and sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 4 for r in got) == 8
    assert sorted(r.deviation for r in got) == sorted(deviation * 4) and max(r.identity_error for r in got) < 1e-9
    white = np.sort(np.abs(white), axis=0)
    assert all(np.abs(np.sort([abs(r.whitened) for r in got if r.component == c]) - white[:, c - 1]).max() < 1e-8 for c in (1, 2, 3, 4))
    assert whitening.whitened_rows(df.where("false")).count() == 0 and whitening.whitened_rows(df.where("vec_id = 1")).count() == 0
    assert whitening.whitened_rows(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_deviation_is_exact_at_any_size():
    n = 3_000_000_000
    model = whitening.Whitening(n, [1_000_007 * n + 1, 999_990 * n - 5], np.empty((2, 0)), np.empty(0), 0.0)
    x = np.array([[1_000_100, 999_000], [1_000_007, 999_990]], np.int64)
    assert model.deviation(x) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, model.sums)) for r in x]
