"""Filter audit, Merkle manifest and SimHash: against SQL on given tables, brute force on awkward rows, and their parts by properties."""

import hashlib
import os
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textledger.llm import filters, manifest, registry, simhash
from textledger.llm.common import likely, lookup

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    rows = registry.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and rows


@tables
@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest"])
def test_equals_sql(spark, name):
    equals_sql(spark, name)


# --- op11 -------------------------------------------------------------------------

ascending = st.lists(st.integers(0, 60), max_size=30).map(lambda x: sorted(set(x)))


@given(st.lists(ascending, max_size=5), ascending)
def test_galloping_merges(lists, xs):
    both = filters.union(lists)
    assert both == sorted(set().union(*lists)) and filters.difference(xs, both) == sorted(set(xs) - set(both))
    for limit in range(-1, 62, 7):
        for at in range(len(xs) + 1):
            want = next((i for i in range(at, len(xs)) if xs[i] >= limit), len(xs))
            assert filters.gallop(xs, at, limit) == want


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least, parts = {}, {}
    for i, text, _, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, _, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        parts.setdefault(source or "", []).append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        found = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in rows if f in r[0] and not r[0] & set(order[:k])]
                own = [r for r in rows if f in r[0]]
                kept = sum(not r[0] & set(order[: k + 1]) for r in rows)
                found.append((part, "".join(order), k + 1, kept, len(here), len(own) - len(here), sum(r[0] == {f} for r in own), sum(r[1] for r in here), sum(r[2] for r in here)))
        whole = {f: sum(r[4] for r in found if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, whole[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def test_audit_of_awkward_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None), (2, "", "a"), (3, "", None), (3, "", "a"), (None, words, "a"), (None, words, "a"), (7, words, "b"), (7, words, "b"), (9, words, "a")]
    rows += [(20 + i, "RED red " * i, "abc"[i % 3]) for i in range(40)] + [(90 + i, words + " 5% & more", "b") for i in range(30)] + [(5, "x" * 200_000 + " É É　é", "")]
    labels = [(3, 1, 0), (3, 0, 1), (7, 1, None), (20, 1, 1), (95, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, None, s, 0, "x") for i, t, s in rows], DOCS + ", bits string")
    given_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filters.audit(docs, given_)
    assert sorted(map(tuple, found.collect())) == plain_audit([(i, t, None, s) for i, t, s in rows], labels)
    lists = filters.postings(docs, given_)
    assert {r["doc_id"] for r in filters.failing_ids(lists, "D").collect()} == set(range(90, 120))
    assert filters.audit(docs.limit(0), given_).count() == 0


def test_lookup_of_hot_and_rare_keys(spark):
    """A key of most rows, rare keys, keys that are not there, and null keys."""
    rows = [(i, "hot") for i in range(3000)] + [(i, f"k{i % 7}") for i in range(50)] + [(1, "absent"), (2, None)]
    known = [("hot", 3000, "h")] + [(f"k{i}", 8 - (i > 0), str(i)) for i in range(7)]
    got = lookup(spark.createDataFrame(rows, "i long, k string"), spark.createDataFrame(known, "k string, n long, v string"), "k").select("i", "k", "v").collect()
    values = {k: v for k, _, v in known}
    assert sorted(map(tuple, got), key=repr) == sorted(((i, k, values.get(k)) for i, k in rows), key=repr)


def test_key_filter_loses_none(spark):
    wanted = spark.range(2000).selectExpr("cast(id * 3 as string) k")
    rows = spark.range(6000).selectExpr("cast(id as string) k", "id")
    kept = {r["id"] for r in likely(rows, wanted, "k").collect()}
    assert {3 * i for i in range(2000)} <= kept and len(kept) < 2200


# --- op12 -------------------------------------------------------------------------


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, 9000), max_size=80), st.booleans())
def test_ranks(ids, dense):
    ids = ids + list(range(0, manifest.SPAN, 9)) * dense
    lows = [i % manifest.SPAN for i in ids]
    import pyarrow as pa

    half = len(lows) // 2
    pieces = [pa.RecordBatch.from_arrays([pa.array(["p"] * len(x)), pa.array(x, pa.int64())], names=["part", "doc_id"]) for x in (lows[:half], lows[half:]) if x]
    if pieces:
        merged = manifest._merge(pa.Table.from_batches([b for p in pieces for b in manifest._pieces([p])])).to_pylist()[0]
        ranks = manifest.Ranks(merged["data"], merged["again"], merged["directory"])
        asked = np.array(sorted(set(lows)))
        assert merged["n"] == len(lows) and ranks.rank(asked).tolist() == [sum(x < a for x in lows) for a in asked.tolist()]
        assert sorted(ranks.places(np.array(lows)).tolist()) == list(range(len(lows)))


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain_manifest(rows):
    def leaf(row):
        fields = (None if v is None else str(v) for v in row)
        return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = nodes[i - i % 8 : i - i % 8 + 8]
            out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            i //= 8
        return out

    langs = {}
    for i, text, lang, source, n in rows:
        low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        own = leaf((i, source, lang, n, text))
        changed = leaf((i, source, lang, n, low)) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else own
        langs.setdefault(lang, []).append((i is not None, i or 0, own, changed, i))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [grow([r[2] for r in sorted(langs[x])]) for x in names]
    top = grow([t[-1][0] for t in trees])
    out = []
    for k, name in enumerate(names):
        for at, (_, _, own, changed, i) in enumerate(sorted(langs[name])):
            sides = path(trees[k], at) + path(top, k)
            node = changed
            for left, right in sides:
                node = sha(left + node + right)
            out.append((i, own, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_of_awkward_rows(spark):
    rows = [(None, "A", "en", "s", 1), (None, None, "en", None, None), (None, "A", "en", "s", 1), (5, "B b", None, "s", 3), (5, "B b", None, "s", 3), (5, "C", None, "t", 1), (-70000, "É", "", "s", 1)]
    rows += [(2**40 + i * 5000, f"T{i} x", "en", "s", i) for i in range(20)] + [(7, "x" * 300_000, f"l{i}", None, None) for i in range(10)] + [(9, "", "ü", "", 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", leaf long")
    assert ordered(manifest.manifest(docs).collect()) == ordered(plain_manifest(rows))
    assert manifest.manifest(docs.limit(0)).count() == 0
    one = docs.limit(0).union(spark.createDataFrame([(4, "x", "en", "s", 1, 1)], docs.schema))
    assert ordered(manifest.manifest(one).collect()) == ordered(plain_manifest([(4, "x", "en", "s", 1)]))


def test_manifest_over_several_tables(spark):
    rows = [(i * 3, f"Text {i}", "en" if i % 6 else "de", "s", i) for i in range(manifest.BLOCK + 1500)]
    docs = spark.createDataFrame(rows, DOCS)
    assert ordered(manifest.manifest(docs).collect()) == ordered(plain_manifest(rows))


# --- op13 -------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = np.array(fps, np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]) <= 3):
            x, y = find(a), find(int(b))
            if x != y:
                label[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aBÉ  \n\x1c\x85x", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@tables
def test_simhash_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))]
    assert sorted(map(tuple, registry.op13_simhash(spark, SF).collect())) == want


def test_simhash_of_awkward_rows(spark):
    long = "one two three four " * 20_000
    rows = [(None, None), (4, ""), (4, " \n"), (3, "a"), (3, "A"), (None, "a"), (None, "lone text"), (8, long), (7, long + "five"), (8, long)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, n int")
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps))]
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(want)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def flipped(rng, base, most):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        base ^= 1 << int(b)
    return base


def test_large_buckets_lose_no_link(spark):
    """Thousands of fingerprints around few centres share the parts' values, so leaders leave components that tiles must join."""
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**63, 3)]
    centres += [flipped(rng, c, 12) for c in centres]
    fps = sorted({flipped(rng, centres[i % 6], 7) for i in range(2600)} | {int(x) for x in rng.integers(0, 2**63, 300)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(x, 1) for x in signed], "fp long, docs long")
    groups = simhash.bit_groups(nodes)
    assert sorted(b for g in groups for b in g) == list(range(64))
    want = plain_components(list(range(len(fps))), fps)
    for parts in (simhash.plan(groups, simhash.histograms(nodes, groups)), [(groups[0] + groups[1] + groups[2], -1), (groups[3], 3)], [(sum(groups[:2], []), 1), (sum(groups[2:], []), 1)]):
        labels = dict(map(tuple, simhash.links(nodes, [p for p in parts if p[1] >= 0]).collect()))
        found = [labels.get(x, x) for x in signed]
        assert len(set(zip(want, found))) == len(set(want)) == len(set(found))


def test_distances_and_thresholds():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << simhash.GROUP, 300) & 0xF0F0
    chance = simhash.distances(np.bincount(values, minlength=1 << simhash.GROUP))
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    assert np.allclose(chance, [(apart == d).mean() for d in range(4)])
    even = [np.array([1e-4, 1e-3, 1e-2, 1e-1])] * 4
    assert simhash.thresholds(even, [16] * 4, 10**5)[1] == [0, 0, 0, 0]
    skewed = [np.array([0.9, 0.05, 0.02, 0.01]), *even[1:]]
    assert simhash.thresholds(skewed, [16] * 4, 10**6)[1][0] == -1  # a part that nearly all share is not looked at
    for limits in (simhash.thresholds(skewed, [16] * 4, 10**6)[1], simhash.thresholds(even[:2], [32, 32], 10**9)[1]):
        assert sum(t + 1 for t in limits) == simhash.RADIUS + 1
