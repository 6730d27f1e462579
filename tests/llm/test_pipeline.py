"""The stages of the pipeline against plain Python over the same rows, and defined results for odd rows."""

import hashlib
import math
import re
import sys
import zlib

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import pytest  # noqa: E402
from oracle import SF  # noqa: E402
from test_ops import brute_fingerprint, odd_docs  # noqa: E402

from quarryline.llm import decontam, exactdedup, langid, mixing, sharding, simhash, sstable, toxicity, warc  # noqa: E402


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(docs):
    """doc_id to the smallest id that its fingerprint reaches."""
    ids = sorted(docs)
    fp = {i: brute_fingerprint(docs[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def similar(docs):
    """doc_id to the smallest id reached over pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    ids = sorted(docs)
    sets = {}
    for i in ids:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]", lower(docs[i])) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and len(x & y) * 5 >= len(x | y) * 4:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def dirty(docs, items):
    """The documents in which a window of an item occurs."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[s : s + 10]) for w in map(words, items) if w for s in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return {i for i, t in docs.items() for w in [words(t)] if any(tuple(w[s : s + m]) in windows for m in sizes for s in range(len(w) - m + 1))}


def topic(text):
    """The topic with the most terms in the text; the first of those that tie."""
    low = (text or "").lower()
    hits = [(sum(t in low for t in terms), -i, name) for i, (name, terms) in enumerate(mixing.TOPICS.items())]
    return max(hits)[2] if max(hits)[0] else "general"


def draw(rows):
    """The ids that the raked and calibrated probabilities keep; rows: (doc_id, text, lang, source)."""
    cell = {i: (s or "(null)", la or "(null)", topic(t)) for i, t, la, s in rows}
    size = {i: len([w for w in re.split("[ \t\n\x0b\x0c\r]", t or "") if w]) for i, t, _, _ in rows}
    n = {}
    for i, c in cell.items():
        if size[i]:
            n[c] = n.get(c, 0) + size[i]
    total = sum(n.values())

    def margin(x, k):
        out = {}
        for c, v in x.items():
            out[c[k]] = out.get(c[k], 0) + v
        return out

    share = []
    for k, d in enumerate(mixing.DIMENSIONS):
        power = {v: x ** mixing.TEMPER[d] for v, x in margin(n, k).items()}
        share.append({v: x / sum(power.values()) for v, x in power.items()})
    w = {c: x / total for c, x in n.items()}
    for _ in range(mixing.ROUNDS):
        moved = 0
        for k in range(3):
            f = {v: share[k][v] / m for v, m in margin(w, k).items()}
            moved = max([moved, *(abs(x - 1) for x in f.values())])
            w = {c: x * f[c[k]] for c, x in w.items()}
        if moved <= mixing.SETTLED:
            break
    weight = {c: w[c] / (n[c] / total) for c in n}
    low, high = 0.0, 1e9  # the factor by bisection: the expected sample grows with it
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(x * min(1, c * weight[k]) for k, x in n.items()) < mixing.KEEP * total else (low, c)
    u = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 for i in cell}
    return {i for i in cell if not size[i] or u[i] < min(1, high * weight[cell[i]])}


def test_each_stage_equals_plain_python(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(cp.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()

    model = toxicity.train(docs, labels)
    score = {i: 1 / (1 + math.exp(-(model.bias + sum(map(model.word, toxicity.words_of(r.text)))))) for i, r in rows.items()}
    want = {i for i, x in score.items() if x < 0.5}
    kept = stage["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == want
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert not [i for i in set(rows) - want if known.get(i) == 0]

    def step(name, want):
        got = stage[name](spark, docs.where(docs.doc_id.isin(sorted(was))), SF)
        assert sorted(r.doc_id for r in got.collect()) == sorted(want)
        return want

    was = want
    near = similar({i: rows[i].text for i in was})
    was = step("near_duplicates", {i for i in was if near[i] == i})
    was = step("decontamination", was - dirty({i: rows[i].text for i in was}, items))
    was = step("mixing", draw([(i, rows[i].text, rows[i].lang, rows[i].source) for i in was]))
    out = cp.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(was)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert (r.size, r.text_crc32) == (len((rows[r.doc_id].text or "").encode()) + 1, zlib.crc32((rows[r.doc_id].text or "").encode()))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    loads = [len(by.get(s, [])) for s in range(16)]
    assert max(loads) - min(loads) <= 1


def test_components_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = components(dict(docs.select("doc_id", "text").collect()))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


def by_text(spark, df):
    """Rows of an operator over odd_docs, by (doc_id, position among equal ids)."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_odd_rows_have_defined_results(spark):
    d = odd_docs(spark)  # ids 0-4, 4 again, 6, null, 8; texts: null, empty, blank, four alike, long, other scripts, x
    near = by_text(spark, simhash.near_duplicates(d))
    assert near[0][0].fingerprint == near[1][0].fingerprint == near[2][0].fingerprint == "0" * 16
    assert {near[i][0].component_id for i in (0, 1, 2)} == {0} and {r.component_id for r in near[3] + near[4]} == {3}
    assert near[None][0].component_id is None
    same = by_text(spark, exactdedup.exact_dedup(d))
    assert (same[0][0].keep_id, same[0][0].group_size, same[0][0].kept) == (1, 2, False) and same[1][0].kept
    assert same[0][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert (same[None][0].keep_id, same[None][0].kept) == (None, True)
    lang = by_text(spark, langid.language_id(d))
    assert all(lang[i][0].lang_pred == "und" for i in (0, 1, 2)) and all(0 <= r.score <= 1 for rs in lang.values() for r in rs)
    assert lang[3][0].held_out == (zlib.crc32(b"3") % 4 == 2)
    tokens = by_text(spark, sstable.token_shards(d))
    assert all(tokens[i][0].n_tokens == 1 and tokens[i][0].ids_crc32 == zlib.crc32((2).to_bytes(4, "little")) for i in (0, 1))
    flat = sorted((r.start, r.n_tokens) for rs in tokens.values() for r in rs)
    assert all(a + n == b for (a, n), (b, _) in zip(flat, flat[1:])) and flat[0][0] == 0
    shard = by_text(spark, sharding.shard_rows(d))
    assert (shard[0][0].size, shard[0][0].text_crc32, shard[1][0].size) == (1, 0, 1)
    assert sorted((r.shard, r.slot) for rs in shard.values() for r in rs) == [(s, 0) for s in range(9)]
    bench = spark.createDataFrame([(1, "hello world again"), (2, None), (None, ""), (1, "WORLD again")], "item_id long, text string")
    hit = by_text(spark, decontam.decontaminate(d, bench))
    assert (hit[3][0].n_words, hit[3][0].n_hit, hit[3][0].n_items, hit[3][0].contaminated) == (3, 3, 1, True)
    assert (hit[0][0].n_words, hit[0][0].n_hit, hit[0][0].n_items, hit[0][0].items_sha256) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert hit[6][0].n_words == 60000 and not hit[6][0].contaminated
    mix = by_text(spark, mixing.mix(d))
    assert all(mix[i][0].n_tokens == 0 and mix[i][0].weight is None and mix[i][0].prob == 1 and mix[i][0].kept for i in (0, 1, 2))
    assert mix[1][0].lang == "(null)" and mix[2][0].source == "(null)"


def test_labels_without_toxic_rows_call_nothing_toxic(spark):
    d = odd_docs(spark)
    for rows in ([], [(3, 0)], [(3, None), (None, 1)]):
        got = toxicity.toxicity(d, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == 9 and not any(r.predicted for r in got) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    bad, clean = [p for p, t in held if t == 1], [p for p, t in held if t == 0]
    assert sum(bad) > 0.85 * len(bad) and sum(clean) < 0.02 * len(clean)


@pytest.mark.parametrize("html", ["", "short", "é" * 49, "é" * 50])
def test_payloads_of_a_hundred_bytes_are_revisited(spark, html):
    pages = spark.createDataFrame([(9, "u", html, 1), (4, None, html, 2), (None, "v", html, 3), (4, "w", html, 4)], "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=repr)
    long = len(html.encode()) >= 100
    assert got == sorted([(0, "revisit", 4), (4, "response", None), (4, "response", None), (9, "revisit", 4)] if long else [(0, "response", None), (4, "response", None), (4, "response", None), (9, "response", None)], key=repr)
