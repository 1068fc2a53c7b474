import numpy as np
import pytest
import xxhash

from latentspark.llm import simhash as sh
from tests.llm.cases import no_documents, odd_documents, prose


def _naive(text, width=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _components(ids, fps, radius):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {}
    for a in range(len(ids)):
        out.setdefault(find(a), []).append(ids[a])
    return [min((i for i in out[find(a)] if i is not None), default=None) for a in range(len(ids))]


def test_fingerprint():
    for t in ("", "one", "a b c", "A b C d e f", "Ünï çödé\x0bwörds here\ttoo and on", prose(3, 200)):
        assert sh.fingerprint(t.encode()) == _naive(t)
    assert sh.fingerprint(None) == 0


@pytest.mark.parametrize("radius", [1, 4, 7, 20])
def test_distances(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 1 << 63, 300, dtype=np.int64).view(np.uint64)
    f[1::3] = f[::3] ^ np.uint64(0b1011)
    planes = np.ascontiguousarray(np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1).T)
    i, j = (x.ravel() for x in np.triu_indices(300, 1))
    d = np.bitwise_count(f[i] ^ f[j]).astype(int)
    assert (sh.distances(planes, i, j, radius) == np.where(d <= radius, d, radius + 1)).all()


@pytest.mark.parametrize("chunk", [3, 2048])
def test_links_connect_what_all_pairs_connect(spark, chunk):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = sh.connected_components(sh.links_within(df, 4, chunk)).toPandas()
    root = dict(zip(got["node"], got["root"], strict=True))
    assert [root.get(f, f) for f in fps] == _components(fps, fps, 4)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = sh.near_duplicates(docs).toPandas()
    assert len(got) == docs.count() and got["fingerprint"].str.fullmatch("[0-9a-f]{16}").all()
    rows = docs.select("doc_id", "text").collect()
    want = {(r["doc_id"], f"{_naive(r['text']):016x}"): c for r, c in zip(rows, _components([r["doc_id"] for r in rows], [_naive(r["text"]) for r in rows], 4), strict=True)}
    for i, f, c in got.itertuples(index=False):
        i, c = None if i != i else int(i), None if c != c else int(c)
        assert want[i, f] == c
    assert sh.near_duplicates(no_documents(spark)).count() == 0


def test_near_copies_are_found_and_others_kept(spark):
    rows = []
    for k in range(30):
        words = prose(100 + k, 200).split()
        rows.append((10 * k, " ".join(words)))
        for c in range(3):  # two words of 200 changed: similarity about .9
            w = list(words)
            w[30 + c], w[150 - c] = "changed", "words"
            rows.append((10 * k + 1 + c, " ".join(w)))
    rows += [(1000 + k, prose(900 + k, 150)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in sh.keep_one_of_each(docs).collect()}
    assert kept == {10 * k for k in range(30)} | {1000 + k for k in range(50)}


def test_near_copies_that_differ_in_repetition(spark):
    rows = []
    for k in range(20):  # a line of ten words, once or eight times over: the same set of shingles but for the seams
        head, line = prose(300 + k, 100), prose(400 + k, 10)
        rows += [(2 * k, f"{head} {line} {line}"), (2 * k + 1, " ".join([head] + [line] * 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in sh.keep_one_of_each(docs).collect()} == {2 * k for k in range(20)}


def _alike_components(texts, width=5, similarity=0.8):
    """Least index of each text's group, from all pairs."""
    sets = [set(sh.shingle_hashes(t.encode(), width).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_every_pair_at_the_threshold_is_found(spark):
    rows = []
    for k in range(300):  # four words of 204 changed: 180 shingles of 220 are shared, similarity .818
        words = prose(2000 + k, 204).split()
        rows.append((2 * k, " ".join(words)))
        for at in (20, 70, 120, 170):
            words[at] = f"new{at}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in sh.keep_one_of_each(docs).collect()} == {2 * k for k in range(300)}


@pytest.mark.parametrize("chunk", [4, 2048])
def test_versions_of_versions_are_one_group(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(sh.spread, "__defaults__", (chunk,))
    texts = []
    for k in range(12):
        r, group = random.Random(k), [prose(5000 + k, 120).split()]
        while len(group) < 25:
            words = list(r.choice(group))
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            group.append(words)
        r.shuffle(group)
        texts += [" ".join(w) for w in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(sh.near_copies(docs).collect())
    assert [got[k] for k in range(len(texts))] == _alike_components(texts)


def test_keep_one_of_each_on_odd_documents(spark):
    docs = odd_documents(spark)
    kept = sh.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2 and 3 in ids and 4 not in ids and 5 not in ids and 6 in ids
    assert sh.keep_one_of_each(no_documents(spark)).count() == 0


def test_prefixes_of_alike_sets_share_enough():
    """In any common order two sets of the similarity share as many of their prefixes as promised."""
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(1, 200))
        a = r.choice(10**6, n, replace=False)
        extra = r.choice(np.arange(10**6, 2 * 10**6), int(r.integers(0, n // 4 + 1)), replace=False)
        b = np.concatenate([a[int(r.integers(0, n // 8 + 1)) :], extra])
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        rank = r.permutation(2 * 10**6)
        first = lambda x: set(x[np.argsort(rank[x])][: sh.prefix_length(len(x), 0.8)].tolist())
        assert len(first(a) & first(b)) >= max(sh.least_shared(len(a), 0.8), sh.least_shared(len(b), 0.8))


@pytest.mark.parametrize("hub", [2, 512])
def test_components_with_hubs(spark, monkeypatch, hub):
    from latentspark.llm import common

    monkeypatch.setattr(common, "HUB", hub)
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(30)] + [(39, 500), (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}
    for x in range(1000):
        root[x] = 0 if x < 40 or x == 500 else 100 if 100 <= x <= 130 else 200 if x == 201 else x
    assert all(root[x] == r for x, r in got.items()) and {x for x, r in got.items() if x != r} == {*range(1, 40), 500, *range(101, 131), 201}


def test_links_found_among_documents_that_share_passages(spark):
    """Recall per link against all pairs, where passages are shared by texts that aren't copies; copies with and without an id."""
    import random

    r = random.Random(11)
    passages, texts = [prose(7000 + k, 60) for k in range(5)], []
    for k in range(60):
        words = (prose(8000 + k, 80) + " " + r.choice(passages) + " " + r.choice(passages)).split()
        texts.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            copy = list(words)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in sh.near_copies(docs).collect()]
    want = _alike_components(texts)
    assert dict(x for x in got if x[0] is not None) == dict(enumerate(want)) and (None, want[0]) in got


def test_parity_maps_never_rule_out_what_is_alike():
    """Maps differ in no more bits than sets in shingles; most pairs that are alike in part only are ruled out."""
    r = np.random.default_rng(8)
    ruled_out = tried = 0
    for n in (1, 2, 5, 40, 300, 1500, 6000):
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            keep = r.random(len(a)) < r.choice([1.0, 0.95, 0.9, 0.85, 0.7])
            b = np.unique(np.concatenate([a[keep], r.integers(0, 1 << 63, int(r.integers(0, n // 6 + 1))).astype(np.uint64)]))
            maps = np.stack([sh.parity_map(x) for x in (a, b)])
            differ = len(np.setxor1d(a, b))
            assert np.bitwise_count((maps[0] ^ maps[1]).view(np.uint64)).sum() <= differ
            both = np.array([0]), np.array([1])
            may = bool(sh._may_be_alike(np.array([len(a), len(b)]), maps, *both, 0.8)[0])
            alike = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            assert may or not alike
            if n == 300 and len(np.intersect1d(a, b)) < 0.75 * len(np.union1d(a, b)):
                tried, ruled_out = tried + 1, ruled_out + (not may)
    assert tried > 5 and ruled_out >= 0.9 * tried


def test_groups_that_are_alike_in_part_write_few_pairs(spark, monkeypatch):
    """Sixty versions of a text with a similarity of about .7 to each other: no pair is alike, and hardly one reaches the comparison of whole sets."""
    import random

    compared, verified = [], sh._verified

    def count(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(sh, "_verified", count)
    words, texts = prose(77, 300).split(), []
    for k in range(60):
        w, r = list(words), random.Random(k)
        for at in r.sample(range(300), 6):
            w[at] = f"v{k}x{at}"
        texts.append(" ".join(w))
    got = dict(sh.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [got[k] for k in range(60)] == _alike_components(texts)
    assert compared[-1] <= 60 * 59 // 2 // 4


def test_pair_of_two_large_buckets_is_compared_in_the_first():
    import pyarrow as pa

    n, words = 40, 32
    rows = {"bucket": [5] * n + [9] * n + [11] * n, "node": [*range(n)] * 3, "root": [*range(n)] * 3, "size": [100] * 3 * n, "place": [50 << 32] * 3 * n}
    rows |= {"large": [0b11 if k % 4 else 0b10 for k in range(n)] * 3, "before": [0b1] * n + [0b0] * n + [-1] * n}  # bucket 9 is bit 0, 5 is bit 1, 11 isn't large
    rows |= {f"w{k}": [0] * 3 * n for k in range(words)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})
    in9 = [k for k in range(n) if k % 4]
    batch = batch.filter(pa.array([b != 9 or k % 4 != 0 for b, k in zip(rows["bucket"], rows["node"], strict=True)]))
    got = [x for b in sh._rest_batches(iter([batch]), 0.8) for x in zip(*(b.column(c).to_pylist() for c in ("a", "b", "cell")), strict=True)]
    want = {(a, b): 9 if a in in9 and b in in9 else 5 for a in range(n) for b in range(a + 1, n)}
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want


@pytest.mark.parametrize("bits", [1, 3, 63])
def test_large_groups_of_near_copies_link_as_all_pairs_do(spark, monkeypatch, bits):
    import random

    monkeypatch.setattr(sh, "LARGE", 2)
    monkeypatch.setattr(sh, "LARGE_BUCKETS", bits)
    r, base = random.Random(bits), [prose(7000 + k, 150).split() for k in range(2)]
    texts = []
    for k in range(240):  # 0 to 5 words of 150 changed, a third of the texts from another version
        words = list(r.choice(texts).split() if texts and k % 3 == 0 else base[k % 2])
        for _ in range(r.randint(0, 5)):
            words[r.randrange(150)] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(sh.near_copies(docs).collect())
    assert [got[k] for k in range(len(texts))] == _alike_components(texts)
