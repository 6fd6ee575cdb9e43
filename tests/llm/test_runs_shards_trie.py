"""Periodic runs, shards and the prefix trie: plain versions, SQL twins, edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from oracle_compare import compare, duck
from quarry.llm import oracle, periodic, shards, trie
from quarry.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    r = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLE[name])
    assert r["status"] == "match", r


# ------------------------------------------------------------------ 11 periodic runs

def plain_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > start and i - start + p >= max(6, 4 * p):
                out.setdefault((start, i - start + p), p)
            i += i == start
    return sorted((s, length, p) for (s, length), p in out.items())


def test_maximal_pairs_are_exactly_the_runs():
    rng = random.Random(11)
    for _ in range(4000):
        n, k = rng.randrange(0, 70), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if rng.random() < 0.3:
            w = w + w[:rng.randrange(n + 1)] + w
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w), w


def test_sorted_suffixes_and_their_common_prefixes():
    rng = random.Random(3)
    for _ in range(500):
        w = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(40))]
        pos, lcp = periodic.sorted_suffixes(np.array(w, np.int64))
        want = [i for i in range(len(w)) if len(w[i:i + 5]) == 5 and sum(w[j:j + 5] == w[i:i + 5] for j in range(len(w))) > 1]
        assert sorted(pos.tolist()) == want
        assert pos.tolist() == sorted(pos.tolist(), key=lambda i: w[i:])
        for a, b, c in zip(pos.tolist(), pos[1:].tolist(), lcp.tolist()):
            assert w[a:a + c] == w[b:b + c] and w[a:a + c + 1] != w[b:b + c + 1]


def test_runs_of_texts(spark):
    many = "a b " * 30000 + "c"
    rows = [(1, "x x x x x x"), (2, "x x x x x"), (3, None), (4, ""), (5, " \n\t "), (6, "é é\né é é é 日本"), (7, many), (7, many),
            (None, "p q p q p q p q r"), (8, "p q p q p q p r")]
    docs = spark.createDataFrame([(*r, 1, "k", 3) for r in rows], "doc_id long, text string, runs int, collapsed string, start int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    assert got == [(1, 6, [(0, 6, 1)], "x"), (2, 5, [], "x x x x x"), (3, 0, [], ""), (4, 0, [], ""), (5, 0, [], ""),
                   (6, 7, [(0, 6, 1)], "é 日本"), (7, 60001, [(0, 60000, 2)], "a b c"), (7, 60001, [(0, 60000, 2)], "a b c"),
                   (None, 9, [(0, 8, 2)], "p q r"), (8, 8, [], "p q p q p q p r")]
    out = periodic.digest(periodic.periodic_runs(docs)).collect()
    assert (out[0].n_runs, out[0].start, out[0].length, out[0].period, out[0].exponent_milli) == (1, 0, 6, 1, 6000)
    assert out[0].runs_sha256 == hashlib.sha256(b"0,6,1\n").hexdigest()
    assert (out[2].n_runs, out[2].start, out[2].exponent_milli) == (0, None, None)
    assert out[2].runs_sha256 == out[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(docs.limit(0)))).count() == 0
    assert [r.doc_id for r in periodic.with_planted_runs(docs).collect()] == [r[0] for r in rows]


def test_strongest_run_breaks_ties(spark):
    text = "a a a a a a z b b b b b b z c d c d c d c d c d c d"
    r = periodic.digest(periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_runs, r.start, r.length, r.period) == (3, 0, 6, 1)


# ------------------------------------------------------------------ 12 shards

def plain_shards(rows, n):
    """rows: (doc_id, text); the rows of each shard in order."""
    rows = sorted(((-1 if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows))
    total, at, out = sum(r[2] for r in rows), 0, [[] for _ in range(n)]
    for r in rows:
        out[min(n - 1, (2 * at + r[2]) * n // (2 * total))].append(r)
        at += r[2]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_are_contiguous_and_balanced(spark, spread, parts):
    rng = random.Random(12)
    rows = [(rng.choice([None, 5, 5, 5, i]), rng.choice([None, "", "é" * rng.randrange(90), "x" * rng.randrange(300)])) for i in range(600)]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, size int, shard string").repartition(parts)
    got = shards.assign(docs, 8).collect()
    want = plain_shards(rows, 8)
    for k in range(8):
        mine = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"]) for r in mine] == want[k]
    sizes = [sum(r[2] for r in w) for w in want]
    assert max(sizes) - min(sizes) <= 2 * max(r[2] for w in want for r in w)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_of_few_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot, r["size"], r.text_crc32) for r in shards.assign(docs, 8).collect()}
    assert got[1][:3] == (3, 0, 1001) and got[2] == (7, 0, 1, 0) and got[3] == (7, 1, 1, 0)
    assert shards.assign(docs.limit(0), 8).count() == 0


def test_sharding_plan_is_native_and_moves_no_text(spark):
    plan = shards.assign(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan


# ------------------------------------------------------------------ 13 trie

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows, shared):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append(((turn is not None, turn or 0), tuple(_signed(sha(f"{len(role.encode())}:{role}{text}"))), role, text))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in said.items()}
    paths = dict(own)
    if shared:
        for c in own:
            base, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
            paths[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(len(x) == len(node) + 1 for x in below), sum(not any(y[:-1] == x for y in members if y) for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x),
                    sha(",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node)))))))
    return sorted(out, key=str)


def _signed(h):
    return [int.from_bytes(bytes.fromhex(h[16 * k:16 * k + 16]), "big", signed=True) for k in range(2)]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.fixture
def spread(spark):
    """Small tables stay on many partitions, so that conversations and lists go over their borders."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_one_conversation_is_numbered_over_many_tasks(spark, spread):
    df = spark.range(5000).selectExpr("9L AS conv_id", "id % 4000 AS turn", "'r' AS role", "string(id) AS text")
    turns = trie.save(trie.turns_of(df), "t")
    assert sorted(r.k for r in trie.numbered(turns).collect()) == list(range(5000))
    rows = trie.prefixes(trie.as_they_are(trie.numbered(turns))).collect()
    assert sorted(r.depth for r in rows) == list(range(5001)) and all(r.depth + r.below == 5000 for r in rows)
    node = {r.depth: (r.n1, r.n2) for r in rows}
    assert len(set(node.values())) == 5001 and all((r.p1, r.p2) == node[max(0, r.depth - 1)] for r in rows)


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["user", None, "é"]), rng.choice(["a b", "a b c", None, ""])) for c in range(-25, 60, 1 + rng.randrange(2))
            for t in range(rng.randrange(7))]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(3)]                    # many copies
    rows += [(200, t, "user", f"turn {t % 5}") for t in range(700)] + [(201, t, "user", f"turn {t % 5}") for t in range(650)]  # very long
    rows += [(300, None, "a", "x"), (300, 0, "b", "y"), (300, 0, "b", "y"), (300, 0, "a", "z"), (300, None, None, None)]       # nulls and ties
    rows += [(None, 0, "user", "lost"), (25, 0, "user", "one turn"), (2 ** 40 + 1, 0, None, None)]
    return rows, spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, n1 string")


@pytest.mark.parametrize("shared,light,send", [(False, 1 << 17, 1 << 20), (True, 1 << 17, 1 << 20), (True, 40, 1 << 20), (False, 3, 0), (True, 1, 0)])
def test_trie_equals_plain_one(spark, spread, talks, monkeypatch, shared, light, send):
    rows, df = talks
    monkeypatch.setattr(trie, "SEND_ROWS", send)
    got = trie_rows(trie.prefix_trie(df, shared_starts=shared, light=light))
    want = plain_trie([r for r in rows if r[0] not in (200, 201)], shared)
    long_ones = [r for r in got if r[0] in (200, 201) and r[1] > 0]
    root = next(r for r in got if r[1] == 0)
    assert [r for r in got if r not in long_ones and r[1] > 0] == [r for r in want if r[1] > 0]
    assert root[3] == len({r[0] for r in rows} - {None})
    # the two long ones: 201 takes its first turns from 200, or has the same ones
    assert {r[1]: r[3] for r in long_ones if r[0] == 200} == {d: 1 + (d <= 650) for d in range(1, 701)}
    assert sum(r[4] == 0 for r in long_ones) == 1
    assert next(r for r in long_ones if r[1] == 650)[7] == sha("201") and next(r for r in long_ones if r[1] == 700)[7] == sha("200")
    assert root[6] == next(r for r in want if r[1] == 0)[6] + 650 * 2


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 0)
    got = trie_rows(trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "hi there")], "conv_id long, turn long, role string, text string"), True))
    assert got == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trie_of_nothing(spark, talks):
    assert trie.prefix_trie(talks[1].limit(0)).count() == 0
    assert trie.prefix_trie(talks[1].where("conv_id IS NULL")).count() == 0


def test_slots_are_a_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    hi, lo = rng.integers(-2**63, 2**63 - 1, 5000), rng.integers(-2**63, 2**63 - 1, 5000)
    hi[:100] = 7  # digests that share a half
    t = trie.SlotTable(hi, lo)
    assert sorted(t.find(hi, lo).tolist()) == list(range(5000))
    assert (t.find(hi, lo + 1) == -1).all()
    assert trie.SlotTable(hi[:0], lo[:0]).find(hi, lo).tolist() == [-1] * 5000
    with pytest.raises(ValueError):
        trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_long_member_lists_are_digested_in_order(spark, spread):
    ids = list(range(-300, 900000, 3))
    rows = spark.createDataFrame([(1, 1)], "n1 long, n2 long").join(spark.range(-300, 900000, 3).withColumnRenamed("id", "conv_id")) \
        .union(spark.createDataFrame([(1, 2, 5), (1, 2, 4), (0, 9, 8), (3, 3, 3)], "n1 long, n2 long, conv_id long"))
    got = {(r.n1, r.n2): r.ends_sha256 for r in trie.ends_digests(rows).collect()}
    assert got == {(1, 1): sha(",".join(map(str, ids))), (1, 2): sha("4,5"), (0, 9): sha("8"), (3, 3): sha("3")}


def test_sql_checksum():
    con = duck(SF)
    for text in ("", "a", "123456789", "é日本\x00"):
        assert con.execute(f"WITH {oracle._CRC_TABLE} SELECT {oracle.crc32('$1')} FROM crc_table", [text]).fetchone()[0] == zlib.crc32(text.encode())
