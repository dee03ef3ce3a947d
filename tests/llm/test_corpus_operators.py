"""The corpus operators against plain versions, with nulls, empty and repeated rows, ties, extra columns and empty tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrow.llm import ann, bitpack, components, epsilon, language, mixing, pieces, pii, secrets, simhash, suffixes

tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, row_key string, fp string"


def table(spark, texts, lang=lambda i: "en"):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang(i), f"s{i % 3}", "x", "y") for i, t in enumerate(texts)], DOC)


def words(r, n, stock):
    return " ".join(r.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    stock = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    out = [words(r, r.randrange(1, 120), stock) for _ in range(40)]
    out[5] = words(r, 150, stock)
    near = out[5].split()
    near[3:4] = ["changed"]
    return out + [out[0], out[0], " ".join(near), None, "", "   ", "one", "two words", "One", words(r, 9000, stock), out[7].upper()]


def groups(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups(real, {x for e in real for x in e})
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, texts):
    own = table(spark, texts)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(own.select("doc_id", "text")).collect()}
    fps = {i: simhash.fingerprint(t, 4)[0] for i, t in enumerate(texts)}
    assert {i: v[0] for i, v in got.items()} == fps
    links = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    assert {i: v[1] for i, v in got.items()} == groups(links, fps)
    assert fps[43] == fps[44] == fps[45] == 0
    kept = [r.doc_id for r in simhash.deduplicated(own.unionByName(own)).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and {0, 5} <= set(kept) and not {40, 41, 42} & set(kept)
    assert simhash.near_duplicates(own.limit(0).select("doc_id", "text")).count() == 0


def test_deduplicated_exactly(spark, monkeypatch):
    """The rows kept are those of the components of all pairs with an exact Jaccard of 0.8 or more."""
    r = random.Random(12)
    stock = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(40):
        base = [r.choice(stock) for _ in range(r.randrange(60, 400))]
        texts.append(" ".join(base))
        for edits in (len(base) // 55, len(base) // 46, len(base) // 42, len(base) // 36, len(base) // 28):
            near = list(base)
            for k in r.sample(range(len(near)), edits):
                near[k] = r.choice(stock)
            texts.append(" ".join(near))
    # One shingle often repeated makes equal fingerprints of unlike sets.
    texts += ["same " * 400 + " ".join(r.choice(stock) for _ in range(30)) for _ in range(2)]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j]]
    links = [(i, j) for i, j, s in pairs if s >= 0.8]
    assert len([s for *_, s in pairs if 0.8 <= s < 0.85]) > 20 and len([s for *_, s in pairs if 0.7 <= s < 0.8]) > 20
    want = {i for i, c in groups(links, range(len(texts))).items() if i == c}
    for few in (64, 2):
        monkeypatch.setattr(simhash, "FEW", few)
        assert {x.doc_id for x in simhash.deduplicated(table(spark, texts)).select("doc_id").collect()} == want


def test_simhash_blocks(spark, monkeypatch):
    """Groups longer than a block keep all their links; every number of segments finds the same ones."""
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(4)]
    fps = sorted({b ^ sum(1 << r.randrange(63) for _ in range(r.randrange(4))) for b in base for _ in range(60)})
    nodes = spark.createDataFrame([(f, 0, i) for i, f in enumerate(fps)], "fp long, more long, rep long").repartition(3)
    want = groups([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], range(len(fps)))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    for s in (5, 7):
        got = {x.node: x.component for x in components.components(simhash.links(nodes, 4, segments=s, agree=s - 4)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_suffixes(spark, texts):
    r = random.Random(9)
    raw = "".join(r.choice("abcdefgh ") for _ in range(6000))
    cases = [raw[:900], "x" + raw[:900], raw[200:1500], "ab" * 300, "a" * 450, "a" * 30, raw[4000:4401] + "é" + raw[4000:4400], None, "", raw[:900], raw[5000:]]
    own = table(spark, cases)
    got = {x.doc_id: x for x in suffixes.removed(own, 40, 24).collect()}
    for i, want in enumerate(suffixes.brute_force(cases, 40)):
        x = got[i]
        kept = bytes(x.kept)
        assert (len(x.data), sum(s.end - s.start for s in x.spans), len(x.spans)) == want[:3], i
        assert suffixes.hashlib.sha256(kept).hexdigest() == want[3]
    assert suffixes.removed(own.limit(0), 40, 24).count() == 0


def test_suffix_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 256)
    r = random.Random(2)
    raw = "".join(r.choice("abcd") for _ in range(3000))
    cases = [raw, raw[500:1700] + "zz", raw[1000:1100] + "q" + raw[1050:1500]]
    got = sorted((x.doc_id, sum(s.end - s.start for s in x.spans)) for x in suffixes.removed(table(spark, cases), 60, 40).collect())
    assert got == [(i, w[1]) for i, w in enumerate(suffixes.brute_force(cases, 60))]


def test_multikey_sort():
    r = np.random.default_rng(1)
    keys = r.integers(0, 5, (200_000, 3)).astype(np.uint64)
    o = suffixes.multikey_sort(keys)
    assert sorted(o.tolist()) == list(range(len(keys)))
    s = keys[o].tolist()
    assert s == sorted(s)


def test_bitpack_round_trip():
    r = np.random.default_rng(4)
    for bits in (1, 7, 16, 17, 31):
        ids = r.integers(0, 1 << bits, 1000).astype(np.uint32)
        assert (bitpack.unpack(bitpack.pack(ids, bits), len(ids), bits) == ids).all()
    docs = [r.integers(0, 300, n).astype(np.uint32) for n in (0, 5, 40_000, 1)]
    f = bitpack.Reader(memoryview(bitpack.build([3, None, 5, 6], docs, 9)))
    assert all((f.document(i) == d).all() for i, d in enumerate(docs)) and f.doc_ids[1] == bitpack.NO_ID
    whole = np.concatenate(docs)
    assert (f.ids(16_000, 33_000) == whole[16_000:33_000]).all() and f.bits == 9


def test_bitpack_files(spark, texts):
    path = tokenizers.path("word_bpe_49k.json")
    odd = [*texts, "it's <|endoftext|> ok", "İx ﬁ y", "a\tb\r\nc", "don't 3²½ µ ß"]
    rows = {r.doc_id: r for r in bitpack.write_and_read(table(spark, odd).orderBy(F.rand(1)), path).collect()}
    tok, at = bitpack.encoder(path).tokenizer, 0
    for i, t in enumerate(odd):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_secrets(spark):
    key = "Zx9Kq2LmP0aRt7VbN4cYw8SdF6gHj1Ue"
    shared = "0123456789abcdef01234567"
    cases = [f'token = "{shared}" and {key}', f"token: {shared}", f"PASSWORD={shared}", "password=abc secret:abcdef api_key = 'A+/=._-'", "AKIA" + "B" * 16 + " AKIAshort", None, "", f"x {shared}"]
    rows = {r.doc_id: r for r in secrets.scan(table(spark, cases)).collect()}
    assert len(rows) == len(cases)
    kinds = lambda i: [(s.kind, s.start, s.end) for s in rows[i].spans]
    assert ("opaque", cases[0].index(key), cases[0].index(key) + 32) in kinds(0)
    assert [s.standing for s in rows[1].spans] == ["copied", "copied"] and rows[1].n_hex == 1
    assert (rows[3].n_assign, rows[4].n_access, rows[5].n_assign) == (2, 1, 0)
    assert kinds(3) == [("assign", 13, 26), ("assign", 27, 45)]
    assert rows[5].base_sha256 == rows[6].base_sha256 == secrets.spans.digest("") and not rows[6].spans
    assert secrets.scan(table(spark, cases).limit(0)).count() == 0


def test_language(spark):
    r = random.Random(8)
    stock = {"en": ["the", "and", "with", "house", "water"], "fr": ["être", "avec", "maison", "eau", "où"], "de": ["und", "über", "haus", "wasser", "nicht"]}
    names = sorted(stock)
    texts = [words(r, 12, stock[names[i % 3]]) for i in range(240)]
    own = table(spark, [*texts, None, "", "123 !?"], lang=lambda i: names[i % 3] if i < 240 else None)
    rows = {x.doc_id: x for x in language.identify(own, 60).collect()}
    held = [i for i in range(240) if rows[i].held_out]
    assert held == [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([rows[i].lang_pred == names[i % 3] for i in held]) == 1.0
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (240, 241, 242))
    assert all(0 <= x.score <= 1 for x in rows.values())
    assert language.accepted(own).count() == 240
    none = language.identify(own.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in none} == {"und"}
    assert language.identify(own.limit(0)).count() == 0


def test_mixing(spark):
    r = random.Random(6)
    good, bad = ["calm", "clear", "kind", "plain"], ["spam", "junk", "noise", "click"]
    texts = [words(r, 30, good if i % 3 else bad) for i in range(150)]
    own = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 150, 2)] + [(999, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mix(own.select("doc_id", "text"), mixing.quality_domains(labels), {"high": 0.5, "low": 0.5}).collect()
    tokens = sum(x.n_tokens for x in out)
    for d in (0, 1):
        assert sum(x.n_tokens * x.rate * x.posterior[d] for x in out) == pytest.approx(tokens / 2, rel=1e-3)
    assert all(x.rate >= 0 and abs(x.n_copies - x.rate) < 1.0 for x in out)
    assert [x.rate for x in out if x.n_tokens == 0] == [1.0, 1.0]
    kept = mixing.mixed(own, mixing.quality_domains(labels), {"high": 1.0, "low": 0.0})
    assert kept.columns == own.columns and 80 <= kept.count() <= 125


def test_ann(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] + [1.0] * 7, 1), (1004, [1.0, 2.0], 1)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for q in ann.search(own, own.where("vec_id % 20 = 0"), k=5, codes=16).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, near in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:5]
        hits += len({v for v, _ in near} & set(want.tolist()))
        assert all(sc == pytest.approx(s[v], abs=1e-9) for v, sc in near)
        assert near == sorted(near, key=lambda z: (-z[1], z[0]))
    assert hits / (5 * len(got)) >= 0.9
    few = spark.createDataFrame(rows[:3], own.schema)
    assert ann.search(few, few, k=20).count() == 6
    assert ann.search(own.limit(0), own.limit(0)).count() == 0


def test_probes_order():
    r = np.random.default_rng(0)
    a, b, n = r.random(9), r.random(7), r.integers(0, 3, (9, 7))
    got = ann.probes(a, b, n, int(n.sum()))
    d = (a[:, None] + b[None, :]).reshape(-1)
    want = [i for i in np.argsort(d, kind="stable") if n.reshape(-1)[i]]
    assert got.tolist() == want


def test_epsilon(spark, monkeypatch):
    monkeypatch.setattr(epsilon, "BLOCK", 32)
    monkeypatch.setattr(epsilon, "LEAF", 8)
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 6))
    x = np.concatenate([base + r.normal(scale=s, size=base.shape) for s in (0.0, 0.1, 0.3, 0.6)]).astype(np.float32)
    x[1] = x[0] * 2
    x[2] = x[3]
    label = [None if i % 31 == 0 else i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), label[i], "extra") for i, v in enumerate(x)] + [(900, None, 1, ""), (901, [0.0] * 6, 1, ""), (902, [1.0, 2.0], 1, "")]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and label[i] is not None and label[i] == label[j] and u[i] @ u[j] >= 0.93]
    want = groups(link, range(len(x)))
    got = {z.vec_id: z for z in epsilon.near_duplicates(own).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in link), want[i], want[i] == i), i
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902))
    assert epsilon.near_duplicates(own.limit(0)).count() == 0


@pytest.fixture(scope="module")
def network():
    return pii.default_network()


def test_pii_network(network):
    ex = pii.examples(seed=77, count=120)
    got = pii.network_spans([t for t, _ in ex], network)
    tp = sum(len(set(g) & set(y)) for g, (_, y) in zip(got, ex, strict=True))
    assert tp / max(1, sum(map(len, got))) > 0.75 and tp / sum(len(y) for _, y in ex) > 0.5


def test_pii_gradient():
    """The gradient of the emissions' sum against differences."""
    net, x = pii.Network.new(1), np.array([[1, 2], [3, 4], [5, 1]])
    emit, saved = net.emissions(x, keep=True)
    grad = net.backward(x, saved, np.ones_like(emit))
    for k in ("uf", "wb", "embed", "out"):
        at = tuple(n // 2 for n in net.p[k].shape) if k != "embed" else (3, 2)
        net.p[k][at] += 1e-6
        up = net.emissions(x)[0].sum()
        net.p[k][at] -= 2e-6
        down = net.emissions(x)[0].sum()
        net.p[k][at] += 1e-6
        assert grad[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_pii(spark, network):
    mail = "a.b+c@x-y.example.org"
    cases = [f"{mail} é +1 (743) 555-3824, 10.0.0.255 999.1.1.1", "4785380592391139, 4111 1111 1111 1111; 12-34", "@@a@b.c_d@e.f", None, "", "no data here", ("word " * 30_000) + mail]
    rows = {r.doc_id: r for r in pii.detect(table(spark, cases), network).collect()}
    assert [(rows[0].n_email, rows[0].n_phone, rows[0].n_ip), rows[1].n_card] == [(1, 1, 1), 1 + pii.luhn("4785380592391139")]
    assert rows[2].n_email == 2 and pii.base_spans(cases[2]) == [("email", 2, 7), ("email", 7, 13)]
    assert rows[6].n_email == 1 and rows[6].spans[0].start == 150_000
    assert rows[3].base_sha256 == rows[5].base_sha256 == pii.spans.digest("") and not rows[5].spans
    clean = {r.doc_id: r.text for r in pii.redacted(table(spark, cases), network).collect()}
    assert clean[0].startswith("[EMAIL] é [PHONE], [IP] 999") and clean[3] is None and clean[5] == cases[5]
    assert pii.detect(table(spark, cases).limit(0), network).count() == 0


def test_long_digits():
    text = "9" * 6000 + ".1.1.1 00010.0.0.1"
    assert pii.base_spans(text) == [("ip", 6007, 6018)]


def test_pii_windows():
    text = "x" * 300 + "5" + "y" * 300 + "a@b.c"
    starts = pii.windows_of(text)
    for at in (300, 601 + 1):
        assert any(s + 8 <= at < s + pii.WINDOW - 8 for s in starts)
    assert pii.windows_of("plain words") == []


class Marked(pii.Network):
    """Calls every stretch of the letter q and @ an address."""

    def emissions(self, x, keep=False):
        on = (x == pii.classes("q")[0]) | (x == pii.classes("@")[0])
        before = np.concatenate([np.zeros_like(on[:1]), on[:-1]])
        tag = np.where(on, np.where(before, pii.TAGS.index("I-email"), pii.TAGS.index("B-email")), 0)
        return 20.0 * np.eye(len(pii.TAGS))[tag], ()


def test_pii_long_spans():
    """A span of any length is found at each place of the windows' grid, and only once."""
    net = Marked({"move": np.zeros((len(pii.TAGS), len(pii.TAGS)))})
    for size in (31, 33, 36, 63, 65, 90, 140, 700):
        for offset in range(32):
            texts = ["x" * (at + offset) + "q" * (size - 3) + "@qq" + "x" * after for at, after in ((0, 0), (32, 200), (96, 1), (640, 700))]
            want = [[("email", t.index("q"), t.index("q") + size)] for t in texts]
            assert pii.network_spans(texts, net) == want, (size, offset)
    assert pii.network_spans(["q" * 40 + "@" + "q" * 5000], net) == [[("email", 0, 5041)]]


def test_reconciled():
    spans = [("ip", 0, 10, 0.9), ("ip", 0, 10, 0.9), ("phone", 5, 20, 0.9), ("card", 20, 30, 0.9)]
    assert [s[:3] for s in pii.reconciled(spans)] == [("ip", 0, 10), ("card", 20, 30)]


def test_pieces(spark, texts):
    path = tokenizers.path("piece_bpe_32k.model")
    cases = [*texts, "tail ", "two  gaps", "日本 😀", "a▁b\nc"]
    own = table(spark, cases)
    rows = {r.doc_id: r for r in pieces.encode(own, path, k=3).collect()}
    model = pieces.vocabulary(path, 1.0).model
    for i, t in enumerate(cases):
        assert rows[i].ids == model.encode(t or "") and rows[i].decodes, i
        found = rows[i].samples
        assert len({tuple(s.ids) for s in found}) == len(found) >= 1
        assert [s.perturbed for s in found] == sorted((s.perturbed for s in found), reverse=True)
        assert all(0 < s.inclusion <= 1 or s.logp < -30 for s in found)
    again = {r.doc_id: r for r in pieces.encode(own.where("doc_id % 2 = 1").repartition(3), path, k=3).collect()}
    assert all([s.ids for s in again[i].samples] == [s.ids for s in rows[i].samples] for i in again)
    assert pieces.decode(spark.createDataFrame([(rows[0].ids,), (None,)], "ids array<int>"), path).collect()[0].text == cases[0]
    assert pieces.encode(own.limit(0), path).count() == 0


def test_pieces_decode_every_sample(spark, monkeypatch):
    """Without ids, too, each sample of a text of any length has to decode."""
    path = tokenizers.path("piece_bpe_32k.model")
    real = pieces.segmentations

    def one_wrong(texts, keys, v, k, seed):
        for key, (ids, found) in zip(keys, real(texts, keys, v, k, seed), strict=True):
            if key is not None and key % 2:
                x, *rest = found[-1]
                found[-1] = (x[:-1], *rest)
            yield ids, found

    cases = [t for n in (3, 200, 4000) for t in [" ".join(f"word{i} of the river" for i in range(n))] * 2]
    own = table(spark, cases)
    rows = {r.doc_id: r for r in pieces.encode(own, path, with_ids=False).collect()}
    assert all(rows[i].decodes and len(rows[i].samples) == 2 for i in range(6)) and min(rows[i].samples[0].n_pieces for i in (2, 4)) > 64
    monkeypatch.setattr(pieces, "segmentations", one_wrong)
    assert {r.doc_id: r.decodes for r in pieces.encode(own, path, with_ids=False).collect()} == {i: i % 2 == 0 for i in range(6)}


def test_pieces_distribution():
    """First samples follow the lattice's distribution, and inclusion scores weigh without bias."""
    v = pieces.vocabulary(tokenizers.path("piece_bpe_32k.model"), 0.5)
    n, text = 1500, "the cat"
    words_ = pieces._WORD.findall(v.model.normalize(text))
    lat = pieces.Lattices(words_, v)

    def paths(node):
        if node < 0:
            return [((), 0.0)]
        return [((int(lat.piece[e]), *p), lat.cond[e] + q) for e in range(lat.off[node], lat.off[node] + lat.count[node]) for p, q in paths(int(lat.to[e]))]

    all_ = {a + b: np.exp(p + q) for a, p in paths(int(lat.first[0])) for b, q in paths(int(lat.first[1]))}
    assert sum(all_.values()) == pytest.approx(1.0)
    first, total = defaultdict(int), 0.0
    for _, found in pieces.segmentations([text] * n, list(range(n)), v, 3, 1):
        first[tuple(found[0][0].tolist())] += 1
        total += sum(np.exp(lp) / q for _, lp, _, q in found)
    for p, chance in all_.items():
        assert abs(first[p] / n - chance) < 4 * np.sqrt(chance / n) + 2 / n
    assert total / n == pytest.approx(1.0, abs=0.1)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    good = ["the", "calm", "river", "stone", "house", "garden", "light"]
    docs = [words(r, 40, good) + f" {i} mail{i}@example.com" for i in range(60)]
    docs += [docs[0], "123 456", None]
    own = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path)).cache()
        assert step.columns == own.columns, name
        seen.append({r.doc_id for r in step.select("doc_id").collect()})
    assert seen[0] == set(range(61)) and 60 not in seen[1] and len(seen[1]) == 60 and seen[2] == seen[1]
    assert not [r for r in step.collect() if "@example" in r.text] and all(r.n_chars == len(r.text) for r in step.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path))
    assert last.count() == step.count()


def test_a_worker_holds_the_words_of_one_operator():
    """A mapper empties what another operator remembered, keeps its own, and yields what it did before."""
    from quillrow.llm import common, mixing

    batches = [pa.RecordBatch.from_pydict({"x": [1, 2]}), pa.RecordBatch.from_pydict({"x": []}, schema=pa.schema([("x", pa.int64())]))]
    same = lambda given: iter(given)
    common.serve("mixing")
    mixing.buckets("word")
    assert list(common.served(same, "mixing")(iter(batches))) == batches
    assert "word" in mixing._buckets
    assert list(common.served(same, "pieces")(iter(batches))) == batches
    assert not mixing._buckets
    assert mixing.buckets("word") == mixing.buckets("word")
