"""Every operator against a plain version of its definition, on small inputs."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from quarry.llm import base, decontaminate, language, lm, quality, rules, secrets, sentencepiece, simhash, suffix, toxicity
from quarry.llm.queries import QUERIES

SPACE = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark, sf_smoke):
    return spark.read.parquet(f"{sf_smoke}/documents.parquet").collect()


@pytest.fixture(scope="module")
def labelled(spark, sf_smoke):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_smoke}/labels.parquet").collect()}


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


# ------------------------------------------------------------------ helpers

def test_words_and_hashes_of_a_blob():
    texts = ["a bb\x0bccc", "", None, "é x\x1cy z", "bb"]
    data, off = base.blob(pa.array(texts, pa.string()).slice(0))
    s, e, row = base.word_ranges(data, off)
    got = [(int(r), bytes(data[a:b])) for a, b, r in zip(s, e, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    h = base.range_hash(base.running_sum(data), s, e)
    assert h[1] == h[-1] and len(set(h.tolist())) == len(h) - 1


def test_pieces_keep_all_rows_and_bound_their_bytes():
    rb = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 500, 3, 3, 3)])], ["text"])
    parts = list(base.pieces([rb], "text", 60))
    assert [t for p in parts for t in p.column("text").to_pylist()] == rb.column("text").to_pylist()
    assert all(sum(map(len, p.column("text").to_pylist()[1:])) < 60 for p in parts)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + \
        [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {x: x for x in itertools.chain(*edges)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = base.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# ------------------------------------------------------------------ 1 language

def test_language_finds_the_declared_one(spark, sf_smoke, rows):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, sf_smoke).collect()}
    right = sum(got[r.doc_id].language == r.lang for r in rows)
    assert right >= 0.97 * len(rows) and sum(not g.accepted for g in got.values()) <= 0.01 * len(rows)


def test_evidence_moves_an_undecided_text(spark):
    train = [("en", "the house and the garden with the old tree"), ("de", "das haus und der garten mit dem alten baum")] * 10
    labelled = [(i, t, lang, None, None) for i, (lang, t) in enumerate(train)]
    shape = "key long, text string, label string, markup string, host string"
    model = language.fit_text(spark.createDataFrame(labelled, shape))
    base_rows = [(100 + i, "das haus und der garten mit dem alten baum", None, "de", "x.alt.de") for i in range(30)]
    for markup, host, want in (("de", None, "de"), (None, "x.alt.de", "de")):
        recs = spark.createDataFrame([*base_rows, (1, "qx", None, markup, host)], shape)
        recs = language.records(recs, recs.key, recs.text, recs.label, recs.markup, recs.host)
        found = {r.key: r for r in language.identify(recs, model=model).collect()}
        assert found[1].language == want

def test_pages_use_address_and_markup(spark, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    pages = spark.read.parquet(f"{sf_smoke}/pages.parquet")
    recs = language.from_pages(pages)
    assert recs.where("host IS NULL OR suffix IS NULL OR markup IS NULL").count() == 0
    out = language.identify(recs, model=language.fit_text(language.from_documents(docs)))
    assert out.count() == pages.count() and out.where("NOT accepted").count() == 0


# ------------------------------------------------------------------ 2 simhash

def test_simhash_fingerprints_and_components(spark, rows, sf_smoke):
    fps = {}
    for r in rows:
        words = (r.text or "").encode().lower().split()
        grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    ids = sorted(fps)
    root = {d: d for d in ids}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, sf_smoke).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in ids}


def test_bit_sliced_links_and_tiles(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = centre[rng.integers(0, 4, 300)]
    for _ in range(5):
        fp = fp ^ np.where(rng.random(300) < 0.5, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
    fp = np.unique(fp)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 4}
    a, b = simhash.bucket_links(fp, np.zeros(len(fp), int), np.array([0]), 4, step=64)
    assert set(zip(a.tolist(), b.tolist())) == want
    df = spark.createDataFrame([(x,) for x in fp.view(np.int64).tolist()], "fp long")
    for tile in (7, 4096):  # a small tile deals every bucket over pairs of tiles
        got = base.connected_components(simhash.links(df, tile=tile))
        number = {x: k for k, x in enumerate(fp.view(np.int64).tolist())}
        groups = {}
        for r in got.collect():
            groups.setdefault(r.root, set()).add(number[r.node])
        root = list(range(len(fp)))
        for _ in fp:
            for i, j in want:
                root[i] = root[j] = min(root[i], root[j])
        expect = {}
        for k, r in enumerate(root):
            expect.setdefault(r, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expect.values() if len(g) > 1)


# ------------------------------------------------------------------ 3 suffixes

def removed(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_removal_on_documents(spark, rows, sf_smoke, hot):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(docs, hot=hot).collect()}
    want = dict(zip([r.doc_id for r in rows], removed([(r.text or "").encode() for r in rows], 200)))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_suffix_removal_on_few_letters(spark, seed):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    texts = ["".join(rng.choice(blocks) for _ in range(rng.randrange(1, 6))) for _ in range(40)] + ["a" * 90, "é" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(docs, length=24, gram=8, hot=3 + 5 * (seed % 2)).collect()}
    assert got == dict(enumerate(removed([t.encode() for t in texts], 24)))


def test_two_stage_order():
    rng = np.random.default_rng(0)
    for _ in range(60):
        depth = int(rng.integers(8, 20))
        parts = [rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(depth, 60))).astype(np.uint8) for _ in range(3)]
        text = np.concatenate([np.append(p, 0) for p in parts] + [np.zeros(depth + 16)]).astype(np.uint8)
        first = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        count = np.array([len(p) - depth + 1 for p in parts])
        wanted = {int(f + i) for f, c in zip(first, count) for i in range(c)}
        order = [x for x in suffix.suffix_order(text, first, count, depth).tolist() if x in wanted]
        strings = [bytes(text[x:x + depth]) for x in order]
        assert set(order) == wanted and strings == sorted(strings)


# ------------------------------------------------------------------ 4 and 5 classifiers

def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    row = np.array([0, 0, 0, 0, 1, 2, 2])
    good, move = rng.normal(size=7), rng.normal(size=(2, 2))
    p, moves = quality.forward_backward(good, row, move)
    expect, pairs = np.zeros(7), np.zeros((2, 2))
    for r in range(3):
        at = np.flatnonzero(row == r)
        total, acc, acc_pair = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(good[a] * v for a, v in zip(at, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += w
            acc += w * np.array(y)
            for a, b in zip(y, y[1:]):
                acc_pair[a, b] += w
        expect[at] = acc / total
        pairs += acc_pair / total
    assert np.allclose(p, expect) and np.allclose(moves, pairs)


@pytest.mark.parametrize("name, field, mod, rest, least", [("op4_quality", "quality", 4, 2, 0.95), ("op5_toxicity", "toxic", 5, 0, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, field, mod, rest, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[field] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = QUERIES[name](spark, sf).collect()
    assert all(r.held_out == held(r.doc_id, mod, rest) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out and r.doc_id in labels]
    assert len(test) > 50
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) >= least


def test_held_out_labels_are_never_read(spark, rows, labelled, sf_smoke):
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    labels = spark.read.parquet(f"{sf_smoke}/labels.parquet")
    for module, mod, rest in ((quality, 4, 2), (toxicity, 5, 0)):
        flipped = labels.selectExpr("doc_id", f"IF(crc32(string(doc_id)) % {mod} = {rest}, 1 - quality, quality) AS quality",
                                    f"IF(crc32(string(doc_id)) % {mod} = {rest}, 1 - toxic, toxic) AS toxic")
        one, two = (sorted((r.doc_id, r.score) for r in module.score_documents(docs, x).collect()) for x in (labels, flipped))
        assert one == two


def test_nnpu_finds_the_telling_feature():
    rng = np.random.default_rng(0)
    p = [np.unique(np.append(rng.integers(10, 500, 30), 7)) for _ in range(80)]
    u = [np.unique(np.append(rng.integers(10, 500, 30), 7)) if k < 10 else np.unique(rng.integers(10, 500, 30)) for k in range(200)]
    model = toxicity.fit(p, u, prior=0.05)
    view, names, weight, bias = model.tables[0]
    margin = [bias + weight[np.isin(names, x)].sum() for x in u]
    assert min(margin[:10]) > 0 > max(margin[10:])


def test_long_chains_are_cut_without_a_difference(monkeypatch):
    rng = np.random.default_rng(5)
    row = np.repeat(np.arange(9), [1, 40, 2, 7, 8, 9, 1, 100, 16])
    good, move = rng.normal(size=len(row)) * 8, rng.normal(size=(2, 2)) * 3
    want, moves = quality.forward_backward(good, row, move)
    for span in (1, 2, 7, 8, 64):
        monkeypatch.setattr(quality, "SPAN", span)
        p, m = quality.forward_backward(good, row, move)
        assert np.allclose(p, want) and np.allclose(m, moves)


def test_evidence_in_blocks_is_that_of_all_features(monkeypatch):
    texts = ["", "One line. Another one!\n\n| a | b |\n#### 12", None, "\n" * 7, "é x\n" * 40, "last"]
    data, off = base.blob(pa.array(texts))
    emit = np.random.default_rng(3).normal(size=3 * quality.N_SHAPE)
    shape, size, row = quality.shapes(data, off)
    want = quality.with_neighbours(shape, row) @ emit
    for block in (1, 3, 1000):
        monkeypatch.setattr(quality, "BLOCK", block)
        good, size2, row2 = quality.evidence(data, off, emit)
        assert np.allclose(good, want) and (size2 == size).all() and (row2 == row).all()


def test_document_score_is_the_weighted_mean_over_all_labellings(spark, monkeypatch):
    """The query's score of small documents, from the trained weights and every labelling of their lines."""
    texts = {1: "A good line of text, it seems.\nshort\n\n%% $$ ##", 2: "", 3: None, 4: "x\ny", 5: "plain words here and there\n" * 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (4, 0), (5, 1), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    for doc, text in texts.items():
        shape, size, row = quality.shapes(*base.blob(pa.array([text], pa.string())))
        good = np.clip(quality.with_neighbours(shape, row) @ model.emit, -30, 30)
        total, on = 0.0, np.zeros(len(good))
        for states in itertools.product((0, 1), repeat=len(good)):
            w = math.exp(sum(g for g, y in zip(good, states) if y) + sum(model.move[a, b] for a, b in zip(states, states[1:])))
            total += w
            on += w * np.array(states)
        weight = size if size.sum() else np.ones(len(size))
        assert got[doc] == pytest.approx((on / total * weight).sum() / weight.sum(), abs=1e-6)


def test_training_takes_whole_texts_within_its_bound(spark, monkeypatch):
    """Lines far down a text are learned from; a text over the bound is passed over whole."""
    ids = [i for i in range(60) if not held(i, 4, 2)]
    head, bad = "the same words at the top\n" * 300, "@@ ## $$ %% ^^\n" * 300
    docs = spark.createDataFrame([(i, head + (bad if i % 2 else head)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in ids], "doc_id long, quality int")
    model = quality.train(docs, labels)
    good, _, row = quality.evidence(*base.blob(pa.array([bad, head])), model.emit)
    p = model.marginals(good, row)
    assert p[row == 0].mean() < 0.1 and p[row == 1].mean() > 0.5
    assert not quality.train(docs, labels, max_lines=600).emit.any()


def test_many_short_lines_stay_in_bounds():
    import resource
    text = "\n" * 4_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    good, _, row = quality.evidence(*base.blob(pa.array([text])), np.ones(3 * quality.N_SHAPE))
    p = quality.Crf(np.ones(3 * quality.N_SHAPE), np.zeros((2, 2))).marginals(good, row)
    assert len(p) == 4_000_001 and (p > 0).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB


# ------------------------------------------------------------------ 6 secrets

WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans(spark, rows, sf_smoke):
    odd = ["Token = 'abcdefgh", "passwd:short AKIA1234 AKIA" + "X" * 16, "a" * 31 + "g" + "0" * 40, "ſecret=abcdefghi", "api_key: x=abcdefgh",
           "secret=tok token=abcdefgh1", "päss password\t= abcdefgh password = \"zzzzzzzz.zz\""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(100 + r.doc_id, r.text) for r in rows], "doc_id long, text string")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.find_secrets(docs).collect():
        want = plain(text[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


SECRET = 'password = "correct-horse-9"'
WRAPS = {
    "url": lambda s: urllib.parse.quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "hex": lambda s: "".join(f"\\x{b:02x}" for b in s.encode()),
    "entity": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", WRAPS)
def test_nested_layers_map_to_the_text(outer, inner):
    wrapped = WRAPS[outer](WRAPS[inner](SECRET))
    text = f"é see {wrapped} end"
    base_spans, spans, layers, _ = secrets.scan(text)
    assert not base_spans and layers >= 1
    s, e, k = next(x for x in spans if x[2] == 0)
    assert 6 <= s < e <= 6 + len(wrapped) and secrets.KINDS[k] == "assign"
    assert e - s > len(wrapped) // 2


FILL = " ".join(f"w{i * i % 997}" for i in range(300))
ENC = lambda raw: base64.b64encode(raw).decode()
LINES = lambda t: "\r\n".join(t[i:i + 76] for i in range(0, len(t), 76))
LAYERS = {
    "second gzip member": ENC(gzip.compress(b"hello") + gzip.compress(SECRET.encode())),
    "member boundary within the find": ENC(gzip.compress(SECRET[:14].encode()) + gzip.compress(SECRET[14:].encode())),
    "wrapped gzip": LINES(ENC(gzip.compress((FILL + SECRET).encode()))),
    "wrapped, find across lines": LINES(ENC((FILL[:45] + SECRET + FILL).encode())),
    "path before": "/v1/" + ENC(SECRET.encode()),
    "misaligned path before": "/v12/" + ENC(SECRET.encode()),
    "path before gzip": "/v1/" + ENC(gzip.compress(SECRET.encode())),
    "control byte": ENC(b"abc\x01" + SECRET.encode()),
    "bytes that are no text": ENC(b"\xff\xfe\x00" + SECRET.encode() + b"\x80"),
    "gzip in percent escapes": urllib.parse.quote(gzip.compress(SECRET.encode())),
    "gzip in form escapes": urllib.parse.quote_plus(gzip.compress((FILL + SECRET).encode())),
    "zlib in byte escapes": "".join(f"\\x{c:02x}" for c in zlib.compress(SECRET.encode())),
    "stream twice": ENC(bz2.compress(lzma.compress((FILL + SECRET).encode()))),
    "zstandard frames": ENC(zstandard.compress(FILL.encode()) + zstandard.compress(SECRET.encode())),
}


@pytest.mark.parametrize("kind", LAYERS)
def test_layers_in_bytes(kind):
    text = f"é see {LAYERS[kind]} end of it"
    base_spans, spans, _, _ = secrets.scan(text)
    assert not base_spans and all(6 <= s < e <= len(text) - len(" end of it") for s, e, _ in spans)
    assert {k for *_, k in spans} == {0}
    clean = secrets.redact(text, spans)
    assert secrets.scan(clean)[1] == [] and clean.startswith("é see ") and clean.endswith(" end of it")
    # the same layer without a secret is left alone
    assert secrets.scan(text.replace(LAYERS[kind], ENC(gzip.compress(FILL.encode()))))[1] == []


def test_streams_are_read_to_their_end():
    """A find behind 60 MB, and one across the ends of two windows."""
    for before in (60 << 20, secrets.WINDOW - 10):
        text = "see " + ENC(zlib.compress(b"x " * (before // 2) + SECRET.encode()))
        spans, long = secrets.scan(text)[1::2]
        assert [(s, k) for s, _, k in spans] == [(4, 0)] and long >= 1


def test_cycles_end_and_redaction_removes_the_find():
    text = "%25%32%35 " + urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe="")
    _, spans, layers, _ = secrets.scan(text)
    assert spans and layers < 10
    assert secrets.scan(secrets.redact(text, spans))[1] == []
    assert secrets.scan("%%% 100% \\u12 &#x; " + "A" * 40)[1] == []


# ------------------------------------------------------------------ 7 rules

def test_base_counts_and_ratio(spark, rows, labelled, sf_smoke):
    odd = {9001: "a b c a b c a b c", 9002: "x\n\nx\n \nx", 9003: "#*$%&|<> é", 9004: " ".join(f"w{i}" for i in range(60))}
    docs = spark.createDataFrame([*odd.items(), *((r.doc_id, r.text) for r in rows)], "doc_id long, text string")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rules.base_counts(docs.selectExpr("*", f"{rules.words_of()} AS words")).collect():
        t = text[r.doc_id]
        w = SPACE.findall(t)
        windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))

    good = [d for d, x in labelled.items() if x.quality == 1]
    judged = rules.judge(docs, spark.createDataFrame([(d,) for d in good], "doc_id long")).collect()

    def buckets(df):
        return {r.doc_id: r.b for r in df.selectExpr("doc_id", f"{rules.words_of()} AS words").selectExpr("doc_id", f"{rules.GRAMS} AS b").collect()}

    grams = buckets(docs)
    raw, target = Counter(), Counter()
    for d, b in grams.items():
        raw.update(b)
        if d in set(good):
            target.update(b)
    n, m, mass = sum(raw.values()), sum(target.values()), rules.SMOOTHING * rules.BUCKETS
    weight = {b: math.log((target[b] + mass * c / n) / (m + mass)) - math.log(c / n) for b, c in raw.items()}
    for r in judged:
        b = grams[r.doc_id]
        want = sum(weight[x] for x in b) / len(b) if b else 0.0
        assert r.ratio == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.ratio >= rules.THRESHOLD)


def test_rules_plan_is_native(spark, sf_smoke):
    plan = QUERIES["op7_quality_rules"](spark, sf_smoke)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ 8 language model

def test_lm_scores(spark, rows, sf_smoke):
    got = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, sf_smoke).collect()}
    text = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    one, two = Counter(), Counter()
    for d, w in text.items():
        if not held(d, 7, 2):
            one.update(w)
            two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    gap = []
    for d, w in text.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d, 7, 2), len(w), sum(one[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[t] + 1) / (n + v + 1)) for t in w), rel=1e-9)
        p = [(one[t] + 1) / (n + v + 1) for t in w]
        for i in range(1, len(w)):
            p[i] = lm.LAMBDA * two[(w[i - 1], w[i])] / max(1, one[w[i - 1]]) + (1 - lm.LAMBDA) * p[i]
        gap.append(abs(sum(map(math.log10, p)) - r.score) / len(w))
    assert sum(gap) / len(gap) < 0.2  # quantisation, and false positives on a corpus of mostly single n-grams


def test_filter_never_loses_a_level():
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 2**64, 4000, dtype=np.uint64), rng.integers(1, 3000, 4000)
    size = lm.filter_words(400000, 1 << 20)
    words = np.zeros(size, dtype=np.uint64)
    q = lm.levels(counts)
    for level in range(1, q.max() + 1):
        word, bits = lm.Filter.probe(keys[q >= level], level, size >> lm.REGIONS)
        np.bitwise_or.at(words, word, bits)
    filt = lm.Filter(words)
    assert (filt.level(keys) >= q).all() and (filt.level(keys) == q).mean() > 0.8
    assert (filt.level(rng.integers(0, 2**64, 4000, dtype=np.uint64)) == 0).mean() > 0.7


# ------------------------------------------------------------------ 9 tiling

def tiling(p, t, least):
    up, ut, total = [False] * len(p), [False] * len(t), 0
    while True:
        best, top = [], least
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not up[i + k] and not ut[j + k]:
                    k += 1
                if k > top:
                    best, top = [(i, j, k)], k
                elif k == top:
                    best.append((i, j, k))
        if not best:
            return total
        for i, j, k in best:
            if not any(up[i:i + k]) and not any(ut[j:j + k]):
                up[i:i + k], ut[j:j + k] = [True] * k, [True] * k
                total += k


def test_tiles_are_greedy():
    rng = random.Random(1)
    for _ in range(150):
        p = [rng.randrange(3) for _ in range(rng.randrange(3, 25))]
        t = [rng.randrange(3) for _ in range(rng.randrange(3, 60))]
        assert sum(x[2] for x in decontaminate.tiles(p, t, 3)) == tiling(p, t, 3)


@pytest.mark.parametrize("block_words", [1_000_000, 400])
def test_leaks_on_documents(spark, rows, sf_smoke, block_words):
    bench = spark.read.parquet(f"{sf_smoke}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_smoke}/documents.parquet")
    items = {r.item_id: decontaminate.words(r.text) for r in bench.collect()}
    want = set()
    for r in rows:
        w = decontaminate.words(r.text)
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for item, p in items.items():
            if len(p) >= 5 and any(tuple(p[i:i + 5]) in grams for i in range(len(p) - 4)) and tiling(p, w, 5) >= 0.8 * len(p):
                want.add((r.doc_id, item))
    got = decontaminate.contaminated_pairs(docs, bench, block_words=block_words).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, bench, block_words=block_words).collect()}
    assert kept == {r.doc_id for r in rows} - {d for d, _ in want}


def test_reordered_and_split_passages_are_caught():
    w = [f"w{i}" for i in range(60)]
    block = decontaminate.Block([(7, " ".join(w))], 5, 0.8)
    moved = " ".join([*w[40:], "x", *w[20:40], "y", "z", *w[:20]]).upper()
    assert [x[2:4] for x in block.leaks([moved, " ".join(w[:40]), " ".join(w[::-1])])] == [(60, 3)]


# ------------------------------------------------------------------ 10 pieces

def test_pieces_are_drawn_from_their_distribution():
    v = sentencepiece.Vocabulary.load()
    piece = {v.blob[a:a + n].tobytes(): k for k, (a, n) in enumerate(zip(v.at.tolist(), v.size.tolist())) if k >= 259}

    def every(b):
        if not b:
            yield ()
        for n in range(1, len(b) + 1):
            if b[:n] in piece:
                for rest in every(b[n:]):
                    yield (piece[b[:n]], *rest)

    word, n = " there", 40000
    ways = list(every(word.encode()))
    weight = np.array([np.prod(v.weight[list(w)]) for w in ways])
    weight /= weight.sum()
    data, off = base.blob(pa.array([word] * n))
    ids, cut = sentencepiece.sample(v, data, off, np.arange(n), 5)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cut, cut[1:]))
    assert set(seen) <= set(ways)
    for w, p in zip(ways, weight):
        assert abs(seen[w] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_pieces_are_lossless_and_reproducible(spark, rows, sf_smoke):
    odd = ["", " ", "  a  b ", "\x00\t\n\r", "▁▁ ▁a", "é日本\U0001F600" * 3, "x" * 3000, "  ", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(100 + r.doc_id, r.text) for r in rows], "doc_id long, text string")
    one = sentencepiece.encode(docs).cache()
    two = {r.doc_id: r.pieces for r in sentencepiece.encode(docs.repartition(5)).collect()}
    assert {r.doc_id: r.pieces for r in one.collect()} == two and one.where("NOT lossless").count() == 0
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.text for r in sentencepiece.decode(one).collect()} == text
    other = {r.doc_id: r.pieces for r in sentencepiece.encode(docs, seed=7).collect()}
    assert sum(other[d] != two[d] for d in two) > len(rows) * 0.9
