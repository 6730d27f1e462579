"""The ten operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import io
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import SF, expected, rows  # noqa: E402

from quarryline.llm import decontam, encoder, exactdedup, htmlmain, langid, mixing, nearset, queries, sharding, simhash, sstable, toxicity, warc  # noqa: E402

LONG = "word salad " * 30000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, hits string, score string, u double, cell int"


def odd_docs(spark, empty=False):
    texts = [None, "", " \n\t", "Hello World again", "hello world again", "hello world again", LONG, "日本語 ünïcode", "x"]
    data = [(None if i == 7 else i if i != 5 else 4, x, None if i == 1 else "en", None if i == 2 else "s", 1, 5, "h", "s", 0.5, 3) for i, x in enumerate(texts)]
    return spark.createDataFrame([] if empty else data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    cols, got = rows(queries.queries()[name](spark, SF))
    assert got == expected(queries.oracle_sql()[name], cols)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_inputs(spark, empty):
    d = odd_docs(spark, empty)
    n = 0 if empty else d.count()
    bench = spark.createDataFrame([(1, "hello world again"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (1, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    assert exactdedup.exact_dedup(d).count() == n
    assert sharding.shard_rows(d).count() == n
    assert mixing.mix(d).count() == n
    assert simhash.near_duplicates(d).count() == n
    assert decontam.decontaminate(d, bench).count() == n
    assert langid.language_id(d).count() == n
    assert toxicity.toxicity(d, labels).count() == n
    assert sstable.token_shards(d).count() == n
    for out in (nearset.without_near_duplicates(d), decontam.without_contaminated(d, bench), toxicity.without_toxic(d, labels), mixing.mixed(d)):
        assert out.columns == d.columns and out.count() <= n
    pages = spark.createDataFrame([] if empty else [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>a" * 200, "x"), (3, "u", "<p>a" * 200, "x")], "page_id long, url string, html string, text string")
    assert warc.archive_pages(pages).count() == htmlmain.main_text(pages).count() == pages.count()


def test_exact_dedup_keeps_one_row(spark):
    got = exactdedup.exact_dedup(odd_docs(spark)).collect()
    same = [r for r in got if r.group_size == 3 and r.keep_id == 4]
    assert len(same) == 3 and sum(r.kept for r in same) == 1
    index = exactdedup.DigestIndex(spark, buckets=4)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "X"), (6, "z")], "doc_id long, text string")
    exactdedup.exact_dedup(a, index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in exactdedup.exact_dedup(b, index).collect()} == {(5, 1, False), (6, 6, True)}
    assert index.rows().count() == 3
    index.drop()


def test_sharding_law_and_movement(spark, docs):
    got = sharding.shard_rows(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(docs.select("doc_id", "text").collect())
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    counts = {c: 3 for c in range(0, 1 << 16, 7)}
    where = [{(c, i): s for c, lo, hi, s, _ in sharding.place(counts, k) for i in range(lo, hi)} for k in (16, 17)]
    assert len(where[0]) == sum(counts.values())
    assert sum(where[0][k] != where[1][k] for k in where[0]) < len(where[0]) / 2  # plain hashing would move 16 of 17


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, docs):
    texts = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i].fingerprint == f"{brute_fingerprint(t):016x}" for i, t in texts)


def test_links_in_dense_buckets_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    label = simhash.unit_roots(fps)
    want = {frozenset(np.flatnonzero(label == r).tolist()) for r in set(label.tolist())}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    groups = {}
    for r in simhash.components(simhash.links(df, chunk=8)).collect():
        groups.setdefault(r.root, set()).add(at[r.node])
    got = {frozenset(g) for g in groups.values()}
    assert got == {g for g in want if len(g) > 1}


def test_decontamination_small(spark):
    item = " ".join(f"w{i}" for i in range(14))
    rows_ = [(1, "a " + item.upper() + " z"), (2, " ".join(f"w{i}" for i in range(2, 11))), (3, "x w0-w1 w2"), (4, "short item"), (5, " ".join(f"w{i}" for i in range(4, 14)))]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (10, "short, item!"), (11, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.decontaminate(d, b).collect()}
    assert got == {1: (16, 14, 1), 2: (9, 0, 0), 3: (4, 0, 0), 4: (2, 2, 1), 5: (10, 10, 1)}
    blocks = {r.doc_id: r.n_hit for r in decontam.with_matches(d, b, ["doc_id"], block_bytes=8).selectExpr("doc_id", "aggregate(hits, 0, (a, h) -> a + h.n_words) n_hit").collect()}
    assert blocks == {k: v[1] for k, v in got.items()}


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 3, 300).astype(np.int32)
    order = decontam.suffix_array(tokens, np.arange(300), 64)
    keys = [tokens[p : p + 64].tolist() for p in order]
    assert keys == sorted(keys)


def test_language_held_out(spark, docs):
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].lang_pred == true[i] for i in held) / len(held) > 0.95


def test_language_mixture():
    log_p = np.log(np.array([[0.9, 0.1, 1e-4]] * 30 + [[0.1, 0.9, 1e-4]] * 10))
    pi = langid.mixtures(log_p, np.ones(40), np.array([40]))
    assert pi.shape == (1, 3) and pi[0].argmax() == 0 and pi[0, 2] == 0 and abs(pi[0].sum() - 1) < 1e-5


def test_toxicity_learns_from_positive_and_unlabelled():
    rng = np.random.default_rng(0)
    bad = [np.unique(rng.integers(10, 500, 30)).astype(np.int32) for _ in range(300)]
    bad = [np.union1d(b, [1]).astype(np.int32) for b in bad]
    clean = [np.unique(rng.integers(10, 500, 30)).astype(np.int32) for _ in range(900)]
    m = toxicity.fit(bad, [*clean, *bad[:100]], 0.1)
    z = lambda d: m.bias + sum(m.weights.get(int(f), 0) for f in d)
    assert np.mean([z(d) > 0 for d in bad]) > 0.97 and np.mean([z(d) > 0 for d in clean]) < 0.03


def test_risk_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    for shift in (2.0, -6.0):  # the clean class's estimate above and below zero
        z_p, z_u, prior, step = rng.normal(2, 1, 6), rng.normal(shift, 1, 9), 0.4, 1e-6
        clean = lambda a, b: np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean()
        whole = lambda a, b: prior * np.logaddexp(0, -a).mean() + clean(a, b)
        g_p, g_u, risk = toxicity.risk_gradient(z_p, z_u, prior)
        assert (clean(z_p, z_u) >= 0) == (shift > 0) and risk == pytest.approx(prior * np.logaddexp(0, -z_p).mean() + max(0.0, clean(z_p, z_u)))
        follow = whole if shift > 0 else lambda a, b: -clean(a, b)
        for g, z, at in ((g_p, z_p, 0), (g_u, z_u, 1)):
            for i in range(len(z)):
                up, down = z.copy(), z.copy()
                up[i] += step
                down[i] -= step
                args = ((up, z_u), (down, z_u)) if at == 0 else ((z_p, up), (z_p, down))
                assert g[i] == pytest.approx((follow(*args[0]) - follow(*args[1])) / (2 * step), abs=1e-6)


def test_settings_are_chosen_on_folds():
    rng = np.random.default_rng(5)
    bad = [np.union1d(rng.integers(10, 400, 25), [1, 2]).astype(np.int32) for _ in range(120)]
    rest = [np.unique(rng.integers(10, 400, 25)).astype(np.int32) for _ in range(600)]
    best, errors = toxicity.cross_validated(bad, [*rest, *bad[:60]], 0.1, [{"rounds": 0}, {"rounds": 200}], folds=3)
    assert best == {"rounds": 200} and errors[1] < errors[0]


def test_training_sample_is_bounded(spark):
    d = spark.createDataFrame([(1, f"bad words {i % 7}") for i in range(500)] + [(2, "clean words")] * 500, "doc_id long, text string")
    drawn = toxicity.drawn(d, 50)
    assert drawn.count() <= 100 and toxicity.drawn(d, 50, text_bytes=60).count() <= 100
    spread = spark.range(4000).selectExpr("id as doc_id", "repeat('word ', 20) as text")
    assert 300 < toxicity.drawn(spread, 400).count() < 500 and 100 < toxicity.drawn(spread, 400, text_bytes=20_000).count() < 300


def test_training_sample_does_not_depend_on_the_layout(spark):
    d = spark.range(3000).selectExpr("id % 900 as doc_id", "concat('text ', id % 900) as text")
    one, two = ({tuple(r) for r in toxicity.drawn(d.repartition(n), 200).collect()} for n in (1, 7))
    assert one == two and 20 < len(one) < 200 and toxicity.drawn(d, 200).count() == len(one)


def test_driver_gets_chosen_features_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = lambda i, own: " ".join([own, f"common{i % 3}", *(f"w{x}" for x in rng.integers(0, 10**9, 80))])
    rows = [(i, text(i, "vile" if i % 5 == 1 else "kind")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, None), (601, "12")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    got, frame = [], type(docs)
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: got.append(f(self)) or got[-1])
    model = toxicity.train(docs, labels)
    assert sum(len(v) for rows in got for r in rows for v in r if isinstance(v, (bytes, bytearray))) < 20_000  # of 600 * 80 words' numbers
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    numbers = lambda ids: [np.array([f for w in toxicity.words_of(rows[i][1]) for f in toxicity.features(w)], np.int32) for i in ids]
    known = [i for i in range(0, 600, 2) if not out(i)]
    bad = [i for i in known if i % 5 == 1]
    want = toxicity.fit(numbers(bad), numbers([i for i in range(600) if not out(i)]), len(bad) / len(known))
    assert want.weights and model.weights == pytest.approx(want.weights, abs=1e-9) and model.bias == pytest.approx(want.bias, abs=1e-9)


def test_model_agrees_with_an_independent_learner():
    """Gradient descent on the same estimate over a dense matrix, without slices, feature choice or Adam."""
    rng = np.random.default_rng(9)
    bad = [np.union1d(rng.integers(10, 60, 12), [1, 2]).astype(np.int32) for _ in range(80)]
    rest = [np.unique(rng.integers(10, 60, 12)).astype(np.int32) for _ in range(240)] + [np.union1d(rng.integers(10, 60, 12), [1, 2]).astype(np.int32) for _ in range(40)]
    x = np.zeros((len(bad) + len(rest), 60))
    for i, d in enumerate([*bad, *rest]):
        x[i, d] = 1
    w, b, prior = np.zeros(60), 0.0, 40 / 280
    for _ in range(4000):
        z = x @ w + b
        g_p, g_u, _ = toxicity.risk_gradient(z[:80], z[80:], prior)
        g = np.concatenate([g_p, g_u])
        w, b = w - 0.5 * (x.T @ g), b - 0.5 * g.sum()
    own = toxicity.fit(bad, rest, prior)
    z = np.array([own.bias + sum(own.weights.get(int(f), 0.0) for f in d) for d in [*bad, *rest]])
    assert np.mean((z >= 0) == (x @ w + b >= 0)) > 0.97


def test_risk_follows_only_the_overfitted_part():
    z_p, z_u = np.full(10, 5.0), np.full(10, -9.0)
    _, g_u, risk = toxicity.risk_gradient(z_p, z_u, 0.5)
    assert risk >= 0 and (g_u < 0).all()


def test_token_shards_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(sstable.default_tokenizer())
    path = f"{spark.conf.get('spark.checkpoint.dir')}/sst-test"
    manifest = sstable.write_shards(docs, path, lambda: sstable.Encoder(sstable.default_tokenizer()), shards=3)
    got = {r.doc_id: r for r in sstable.read_shards(manifest, path).collect()}
    at = 0
    for r in sorted(docs.collect()):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (at, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    some = [0, 17, 99, 10**9]
    found = sstable.lookup(manifest, path, some)
    assert found[10**9] == [] and all(len(found[i]) == 1 and found[i][0][-1] == 2 for i in some[:3])


def test_encoder_equals_the_library_on_random_texts(monkeypatch):
    rng = random.Random(3)
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'D", "'", "''", "a", "B", "É", "ß", "\u0130", "\u0131", "\u017f", "\u212a", "ª", "²", "½", "1", "23", "!", "...", "—", "日本", "ж", "Σ", "ς", " ", "  ", "\n", "\t", "\x0b"]
    parts += ["\x1c", "\x85", "\xa0", "\u2003", "\u0301", "e\u0301", "\xad", "\x00", "\x7f", "\u023a", "\u024f", "\u0250", "<|endoftext|>", "<|endof", "x" * 30, "the", "tion", "re", "ll", "s", "t"]
    for entries, size in ((2000, 1 << 18), (50, 60)):  # a memory that is dropped often, texts that are cut
        monkeypatch.setattr(encoder, "SLICE", size)
        e = encoder.Encoder(sstable.default_tokenizer(), entries)
        assert e.known
        for _ in range(6):
            texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(200)]
            assert e.encode(texts) == e.direct(texts)


def test_encoder_leaves_other_tokenizers_to_the_library():
    import public_tokenizers

    e = encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Don't  do\nthat", "", "日本 ½", "x" * 1000]
    assert not e.known and [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [r.ids for r in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_rows_that_share_an_id_go_to_many_files(spark):
    d = spark.createDataFrame([(i % 2 * 7 or None, f"text {i}") for i in range(4000)], "doc_id long, text string")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/sst-shared-ids"
    manifest = sstable.write_shards(d, path, lambda: encoder.Encoder(sstable.default_tokenizer()), shards=8)
    assert manifest.count() == 8 and max(r.entries for r in manifest.collect()) < 1500
    got = sorted((r.start, r.n_tokens) for r in sstable.read_shards(manifest, path).collect())
    assert len(got) == 4000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    assert len(sstable.lookup(manifest, path, [7])[7]) == 2000


def test_encoder_equals_the_library():
    e = sstable.Encoder(sstable.default_tokenizer())
    odd = ["don't 'S it''s <|endoftext|> x", "a\x1cb\xa0c ÀÉ ΑΣ İx é ª² ½x", "日本語 テスト　x", "", " \n", "<|ENDOFTEXT|> A", "\x00\x01 a\x7fb", "naïve—dash…ok 'tis !'s", "é ́x"]
    assert e.encode(odd) == e.direct(odd)


def test_sstable_blocks_bloom_and_damage():
    out = io.BytesIO()
    w = sstable.Writer(out, 2, block_bytes=64)
    for i in range(-50, 50):
        w.add(sstable.key_of(i), np.full(5, i & 7, "<u2").tobytes())
    w.close()
    data = out.getvalue()
    r = sstable.Reader(io.BytesIO(data), len(data))
    assert [sstable.id_of(k) for k, _ in r] == list(range(-50, 50)) and len(r.blocks) > 3
    assert r.get(sstable.key_of(7)) == [np.full(5, 7, "<u2").tobytes()] and r.get(sstable.key_of(1000)) == []
    with pytest.raises(ValueError):
        w.add(sstable.key_of(-99), b"")
    broken = bytearray(data)
    broken[5] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(bytes(broken)), len(data)))


def test_warc_reader():
    payloads = [b"", b"x" * 200_000, "é\r\n\r\nWARC/1.1".encode()]
    data = b"".join(warc.record_bytes("response", f"urn:page:{i}", "http://a b\n", p, hashlib.sha256(p).hexdigest()) for i, p in enumerate(payloads))
    data += warc.record_bytes("revisit", "urn:page:9", None, payloads[1], hashlib.sha256(payloads[1]).hexdigest(), "urn:page:1")
    got = list(warc.read_records(io.BytesIO(data)))
    assert [r.http()[1] for r in got[:3]] == payloads and got[3].kind == "revisit" and got[3].http()[0]["content-length"] == "200000"
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-30])))
    one = warc.record_bytes("response", "urn:page:1", "u", b"some payload", hashlib.sha256(b"some payload").hexdigest())
    for i in range(len(one)):
        try:  # a byte of the gzip header may not matter; all other damage is a ValueError
            assert [r.http()[1] for r in warc.read_records(io.BytesIO(one[:i] + bytes([one[i] ^ 1]) + one[i + 1 :]))] == [b"some payload"] and i < 10
        except ValueError:
            pass
    bad = warc.record_bytes("response", "urn:page:1", "u", b"abc", hashlib.sha256(b"abd").hexdigest())
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad)))


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu one</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site</div><article><h1>Head &amp; line</h1><p><b>First   para<br>two.<p>Second <a href=y>linked</a> para.</p>
    <aside>Side words here</aside><form>Sign up now</form><div class="comments"><p>Reader says hi</p></div></article><footer>&copy; foot</footer></body>"""
    assert htmlmain.extract(page) == "Head & line\n\nFirst para two.\n\nSecond linked para."
    assert htmlmain.extract(None) == htmlmain.extract("<nav>only menu</nav>") == ""
    assert htmlmain.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)


def test_main_text_is_the_region_where_no_element_claims_it():
    menu = "<div><ul>" + "".join(f"<li><a href=x>Menu {i}</a></li>" for i in range(8)) + "</ul></div>"
    foot = "<div><ul><li><a href=x>Terms</a></li><li><a href=y>Imprint</a></li></ul><p>&copy; 2024 Foo</p></div>"
    text = "<h1>A title of five words</h1><p>One two three four five six seven <a href=z>eight nine</a>.</p><p>Ten eleven twelve thirteen fourteen.</p>"
    want = "A title of five words\n\nOne two three four five six seven eight nine.\n\nTen eleven twelve thirteen fourteen."
    for page in (f"<body>{menu}<div>{text}</div>{foot}</body>", f"<body><div>{menu}{text}{foot}</div></body>", menu + text + foot):
        assert htmlmain.extract(page) == want
    claimed = f"<body><div>{menu}<main>{text}<aside>{'side ' * 90}</aside><p>End.</p></main><div><p>Ten plain words that stand beside it, not in it.</p></div>{foot}</div></body>"
    assert htmlmain.extract(claimed) == want + "\n\nEnd."
    teaser = f"<body><article><p>See this too</p></article>{menu}<div>{text}</div>{foot}</body>"
    assert htmlmain.extract(teaser) == want


def test_main_text_is_not_dropped_with_a_wrapper_or_a_loose_name():
    body = "<h2>Title words here</h2><p>One two three four five six.</p><p>Seven eight nine ten eleven.</p>"
    want = "Title words here\n\nOne two three four five six.\n\nSeven eight nine ten eleven."
    for a, b in (
        ('<div class="content has-sidebar">', "</div>"), ('<div class="wrapper no-sidebar"><article>', "</article></div>"), ('<section class="story social">', "</section>"),
        ('<form id="aspnetForm"><div>', "</div></form>"), ('<div class="sidebar"><main>', "</main></div>"), ('<div class="page a hidden-xs b"><article>', "</article></div>"),
        ('<article class="x hidden y">', "</article>"), ('<div data-id="comments"><div>', "</div></div>"), ('<div class="nav-open"><div>', "</div></div>"),
    ):
        assert htmlmain.extract(f"<body>{a}{body}{b}<div class='sidebar'><p>Some side words</p></div></body>") == want, a
    for h in ('<h2 id="discussion">Title words here</h2>', '<h2 id="related-work">Title words here</h2>', '<div class="post-header"><h2>Title words here</h2></div>', "<header><h2>Title words here</h2></header>"):
        assert htmlmain.extract(f"<body><article>{h}{body[body.index('<p>'):]}</article></body>") == want, h
    rest = f"<body><article>{body}</article>"
    for out in ('<div class="related-posts"><article><p>Teaser words one two</p></article></div>', '<div id="comments"><article class="comment-body"><p>Reader words one two</p></article></div>', "<div hidden><p>Not seen</p></div>", '<div style="color:red; display: none"><p>Not seen</p></div>', '<div class="site-header"><p>Some site words</p></div>', "<form><p>Sign up now for more</p></form>"):
        assert htmlmain.extract(rest.replace("<article>", out + "<article>", 1)) == htmlmain.extract(rest + out) == want, out


def test_main_text_goes_on_after_a_block_left_open():
    text, want = "<p>Para one is here.<p>Para two is here.", "Para one is here.\n\nPara two is here."
    for out in (
        '<p class="promo">Ad', '<p class="notice">Ad <b>words</b>', '<ul><li class="ad">Ad</ul>', '<ul><li class="ad">Ad<ul><li>inner</ul></ul>', '<table><tr><td class="ad">Ad</table>', '<table><tr class="ad"><td>Ad<td>b</table>',
        '<dl><dt class="promo">Ad</dl>', '<hr class="ad">', '<h3 class="ad">Ad', '<div><select><option>a</div>', "<div><svg><path d=x></div>", "<svg><path d=x>", "<div><object>fallback</div>", "<div><canvas></div>", "<div><math><mi>x</div>",
        '<svg><title>T</title><a href="</p>"><g></svg>', "<select><option>a</select>", "<noscript><p>Off</p></noscript>", '<p class="ad">Ad<script>"<p>"</script> more</p>', "<object><object>in</object>out</object>", "<p class='ad'>Ad <svg><g></svg> more</p>",
    ):
        assert htmlmain.extract(f"<body><article>{out}{text}</article></body>") == want, out
    assert htmlmain.extract(f'<body><article><ul><li class="ad">Ad<li>Kept words in a list</ul>{text}</article>') == "Kept words in a list\n\n" + want
    assert htmlmain.extract(f'<body><article><figcaption class="ad"><p>Ad</p>more</figcaption>{text}</article>') == want
    assert htmlmain.extract("<article><p>Text is here.<script>never closed <p>x") == "Text is here."


def test_main_text_weights_count_every_tag(spark):
    odd = [f"<body><x-menu{i}><x-item{i}>Go</x-item{i}></x-menu{i}><article><p>One two three.</p></article></body>" for i in range(800)]
    rare = ["<body><blockquote>Q</blockquote><article><p>One two three.</p></article></body>"]
    weights = htmlmain.train(spark.createDataFrame(list(enumerate(odd + rare)), "page_id long, html string"), bound=10**6)
    counts = sum(map(htmlmain.count_tokens, odd + rare), htmlmain.Counter())
    assert weights == htmlmain.learn(counts) and {"tag:blockquote", "tag:other"} <= set(weights) and len(counts) < 20


def test_best_region_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 25))]
        first, end = htmlmain.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[first:end]) == max([0, *sums])


def test_maximal_regions_equal_repeated_search():
    def search(scores, at=0):
        if not scores or max(scores) <= 0:
            return []
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        most = max(sums.values())
        i, j = min((k for k, v in sums.items() if v == most), key=lambda k: (k[1] - k[0], k))
        return [*search(scores[:i], at), (at + i, at + j), *search(scores[j:], at + j)]

    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in htmlmain.maximal_regions(scores)] == search(scores)
    began = time.process_time()
    assert len(htmlmain.maximal_regions([1, -2] * 200_000)) == 200_000 and len(htmlmain.maximal_regions([2, -1] * 200_000)) == 1
    assert time.process_time() - began < 5


def test_main_text_goes_on_behind_what_is_not_text():
    words = lambda x: f"{x} one two three four five six seven eight nine ten eleven"
    a, b, links = words("A"), words("B"), "".join(f"<a href=x>Link {i}</a>" for i in range(9))
    cells = "".join(f"<tr><td>{i}</td><td>{i * 3}</td><td>{i * 7}</td></tr>" for i in range(15))
    rows = [str(x) for i in range(15) for x in (i, i * 3, i * 7)]
    both = f"{a}\n\n{b}"
    for page, want in (
        (f"<div>{a}</div>{''.join(f'<div><a href=x>Link {i}</a></div>' for i in range(6))}<div>{b}</div>", both),
        (f"<div><p>{a}</p><table>{cells}</table><p>{b}</p></div>", "\n\n".join([a, *rows, b])),
        (f"<article><p>{a}</p></article><div>{links}</div><article><p>{b}</p></article>", both),
        ("<body><article><p><a href=x>Only a link</a></p></article></body>", "Only a link"),
        (f"<div><p>{a}</p><p><a href=x>A whole paragraph that is a link</a></p><p>{b}</p></div>", f"{a}\n\nA whole paragraph that is a link\n\n{b}"),
        (f"<article><h1 class='banner'>Title of it</h1><p>{a}</p><div class='share price'>Prices went up again</div><div id='menu'>Soup and bread</div></article>", f"Title of it\n\n{a}\n\nPrices went up again\n\nSoup and bread"),
        (f"<article><p>{a}</p><div class='share'><a href=x>One</a> <a href=y>Two</a></div><div class='related-posts'><p>Read on here</p></div><p>{b}</p></article>", both),
        (f"<article><p>{a} <button>Copy</button> more <select><option>x</select> words</p></article>", f"{a} more words"),
    ):
        assert htmlmain.extract(page) == want, page


def test_region_and_weights_decide_without_an_article(monkeypatch):
    menu, text = "<ul>" + "<li>Go here</li>" * 30 + "</ul>", "<p>One two three four five six seven eight nine ten eleven twelve.</p>" * 3
    page = f"<body><div>{menu}</div><div>{text}</div><div>{menu}</div></body>"
    got = htmlmain.extract(page)
    assert got == "\n\n".join(["One two three four five six seven eight nine ten eleven twelve."] * 3)
    assert htmlmain.extract(page, htmlmain.default_weights() | {"tag": 1.0}) != got
    monkeypatch.setattr(htmlmain, "best_region", lambda scores: (0, len(scores)))
    assert htmlmain.extract(page).count("Go here") == 60


def test_main_text_of_pages_without_telling_names(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = htmlmain.train(pages)
    full = close = 0
    for r in pages.collect():
        bare = re.sub(r"(</?)(?:article|main)\b[^>]*>", r"\1div>", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|\S+?(?=[\s>]))", "", r.html))
        want, got = htmlmain.extract(r.html, weights).split("\n\n"), htmlmain.extract(bare, weights).split("\n\n")
        full += set(want) <= set(got)
        close += len("".join(got)) <= 1.5 * len("".join(want)) + 100
    n = pages.count()
    assert full >= 0.95 * n and close >= 0.9 * n


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a "', "<a \"x>\"", "<!", "<!--", "<svg>", "<select>", "<p class=ad>", "<p class=ad", "<h3 class=ad><pre class=ad>", "< ", "</", "<p title=it's>", "<a b='\"", "<title>", "<div>", "<div style=\"", "\"'", "<a a a=a "])
def test_main_text_takes_linear_time(unit):
    took = []
    for n in (1 << 16, 1 << 19):
        page = "<article><p>One two three.</p></article>" + unit * (n // len(unit)) + "<p>tail</p>"
        began = time.process_time()
        assert htmlmain.extract(page).startswith("One two three.")
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1, took  # eight times the length


def test_tags_left_open():
    assert htmlmain.extract("<article><p>Text is here.</p></article><a href='" + "\"'" * 100) == "Text is here."
    assert htmlmain.extract("<article><p>Text is here.</p><p>a < b and c</p><a href=\"x") == "Text is here.\n\na < b and c"
    assert htmlmain.extract("<article><p title='a > b'>Text is here.</p><p title=\"x>More words.</p></article>") == "Text is here.\n\nMore words."


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmlmain.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert "".join(got[r.page_id].text.split()) == "".join("".join(blocks).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)


def mix_cells(rows_):
    return rows_.where("n_tokens > 0").groupBy(*mixing.DIMENSIONS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n")


def test_mixing_meets_targets(spark, docs):
    rng = random.Random(6)
    dense = spark.createDataFrame([(f"s{i}", lang, t, rng.randint(1, 10**6)) for i in range(5) for lang in ("en", "de") for t in ("general", "legal", "data")], "source string, lang string, topic string, n long")
    given = spark.createDataFrame([("general", 0.3), ("legal", 0.6), ("data", 0.1)], "topic string, share double")
    for cells, topics in ((mix_cells(mixing.marks(docs)), {}), (dense, {"topic": given})):
        targets = mixing.target_table(cells, topics)
        fitted, settled = mixing.rake(cells, targets)
        want = {(r.dim, r.value): r.share for r in targets.collect()}
        got = {(d, r[d]): r.w for d in mixing.DIMENSIONS for r in fitted.groupBy(d).agg({"w": "sum"}).withColumnRenamed("sum(w)", "w").collect()}
        assert settled and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.001 * want[k] for k in want)
        assert mixing.margin_gap(fitted, targets) < 0.001


def test_mixing_calibrates_probabilities(spark):
    rng = random.Random(4)
    for keep in (0.1, 0.7, 0.99):
        rows_ = [("s", "l", str(i), rng.randint(1, 1000), rng.choice([0.1, 0.9, 1.0, 3.0, 80.0])) for i in range(40)]
        c = mixing.calibrated(spark.createDataFrame(rows_, "source string, lang string, topic string, n long, weight double"), keep)
        total = sum(r[3] for r in rows_)
        assert abs(sum(r[3] * min(1, c * r[4]) for r in rows_) - keep * total) < 1e-6 * total


def test_words_and_topics(spark):
    texts = [None, "", " \n", "a  b", " a\t\tb\x0bc\r\n", "A licen\u017fe", "LICENSE and warranty, price", "x | y;; price", "mail me@x", "plain words"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(mixing.n_tokens(d.t), mixing.topic_of(d.t)).collect()
    assert [r[0] for r in got] == [0, 0, 0, 2, 3, 2, 4, 4, 2, 2]
    assert [r[1] for r in got] == ["general"] * 4 + ["data", "general", "legal", "data", "contact", "general"]


def test_mixing_is_not_set_by_one_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionAll(spark.createDataFrame([(10**9, "one two three four five", "en", "a source of its own"), (10**9 + 1, None, None, "s")], docs.schema))
    n = lambda df: df.select(mixing.n_tokens(df.text).alias("n")).agg({"n": "sum"}).first()[0]
    total = n(docs)
    kept = mixing.mixed(docs)
    assert abs(n(kept) / total - mixing.KEEP) < 0.05 and kept.where("doc_id >= 1000000000").count() == 2
    out = mixing.mixed(docs, tokens=int(2.5 * total))
    assert abs(n(out) / total - 2.5) < 0.12 and out.columns == docs.columns
    assert out.where("doc_id = 1000000001").count() == 1 < out.where("doc_id = 1000000000").count()


def test_mixing_to_a_topic_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    given = spark.createDataFrame([("general", 0.8), ("legal", 0.2)], "topic string, share double")
    out = mixing.mix(docs, {"topic": given}, keep=0.2).collect()
    assert not [r for r in out if r.kept and r.topic not in ("general", "legal") and r.n_tokens]
    flat = spark.createDataFrame([(s, 1.0) for s in ["x"]], "source string, share double")
    one = mixing.mix(docs.selectExpr("doc_id", "text", "'en' as lang", "'x' as source"), {"topic": given, "source": flat}, keep=0.1).collect()
    kept = [r for r in one if r.n_tokens]
    mass = {t: sum(r.n_tokens * r.prob for r in kept if r.topic == t) for t in ("general", "legal")}
    assert abs(mass["legal"] / sum(mass.values()) - 0.2) < 0.01


def test_mixing_warns_of_margins_that_are_not_met(spark):
    rows_ = [(i, "a b c d " * 9, "en", "s") for i in range(40)] + [(90, "a b", "xx", "t")]  # t and xx stand for one cell, in unlike shares
    docs = spark.createDataFrame([*rows_, *[(i, "a b c d " * 9, "de", "s") for i in range(50, 80)]], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="off its target"):
        mixing.rates(mixing.marks(docs), rounds=3)


def test_pipeline_stages_compose(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in out}
    assert len(ids) == len(out) > 0 and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
