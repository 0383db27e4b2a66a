import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import golay, simhash
from ledgerloom.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {f: f for f in fps}
    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    return {f: top(f) for f in fps}


def test_code_is_perfect():
    words = np.arange(1 << 23)
    index = golay.decode(words)
    assert np.bincount(index).tolist() == [2048] * 4096


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_a_key(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    rows, keys = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == [plain_fingerprint(text)]
    assert simhash.fingerprint(text.encode(), 3, 3)[0] == plain_fingerprint(text)


@pytest.mark.parametrize("cell", [4096, 16])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    words = [f"W{i}é" for i in range(300)]
    texts = []
    for g in range(12):
        base = rng.choice(words, 40 + 40 * g).tolist()
        for _ in range(12):
            changed = list(base)
            changed[rng.integers(len(base))] = rng.choice(words)
            texts += [" ".join(changed), "\n".join(changed)]
    texts += ["", None, "  ", "one", "ONE", "one two", "x" * 50_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, texts[5], None), (None, "alone in the world", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string").repartition(3)
    out = simhash.near_duplicates(docs).collect()
    fps = {t: plain_fingerprint(t or "") for _, t, _ in rows}
    root = plain_components(set(fps.values()))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted((str(i), f"{fps[t]:016x}", str(least.get(root[fps[t]]))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = plain_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_similar_documents(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    rows, base = [], {}
    for g in range(40):
        text = rng.choice(words, 200).tolist()
        for c in range(3):
            changed = list(text)
            if c:
                changed[rng.integers(200)] = "edited"
            base[len(rows)] = 3 * g
            rows.append((len(rows), " ".join(changed)))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (None, rows[3][1])]
    out = simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert len(out) == len(rows) and got[1000] == got[1001] == 1000 and got[1002] == got[0] and got[None] == got[3]
    assert sum(got[i] == b for i, b in base.items()) >= 0.95 * len(base)
    assert all(got[i] // 3 == i // 3 for i in base)


def test_keys_lengthen_with_the_rows():
    share = np.arccos(2 * 0.8 / 1.8) / np.pi
    assert simhash.key_length(0, 2048, 10, share) == simhash.key_length(1 << 23, 2048, 10, share) == (0, 10)
    assert simhash.key_length((1 << 23) + 1, 2048, 10, share) == (1, 12)
    work, rng = [], np.random.default_rng(1)
    for n in (4000, 16000, 64000):
        extra, families = simhash.key_length(n, 0.25, 10, share)
        pairs = 0
        for _ in range(families):
            rows, keys = simhash.code_keys(rng.integers(-(2**63), 2**63, n), extra)
            assert len(rows) == 3 * n and keys.max() < 1 << 26
            pairs += int((np.unique(keys, return_counts=True)[1].astype(np.int64) ** 2).sum()) - 3 * n
        work.append((3 * families * n, pairs))
    for few, many in zip(work[0], work[2], strict=True):  # families are whole numbers, so single steps vary
        assert np.log(many / few) / np.log(16) <= 1.25


@pytest.mark.parametrize("fill", [simhash.CELL // 2, 0.003])
def test_similar_documents_against_brute_force(spark, fill):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(20000)]
    rows = []
    for g in range(400):  # pairs with stretches replaced, on both sides of the limit
        text = rng.choice(words, 300).tolist()
        other = list(text)
        n = int(rng.integers(10, 60))
        other[100 : 100 + n] = rng.choice(words, n).tolist()
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]

    def plain(text):
        own = text.split()
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}

    sets = [plain(t) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), fill=fill).collect()}
    linked = [got[2 * g + 1] == 2 * g for g in range(400)]
    assert not any(on for on, j in zip(linked, alike, strict=True) if j < 0.8)
    due = [on for on, j in zip(linked, alike, strict=True) if j >= 0.8]
    near = [on for on, j in zip(linked, alike, strict=True) if 0.8 <= j < 0.85]
    print("recall", np.mean(due), "at 0.80 to 0.85", np.mean(near), len(near))
    assert np.mean(due) >= 0.98 and np.mean(near) >= 0.95


@pytest.mark.parametrize("partners", [4, 0])
def test_a_crowd_around_the_limit(spark, monkeypatch, partners):
    """Edits of one text, few and many: all links there are, and no others, however a cell is verified."""
    monkeypatch.setattr(simhash, "PARTNERS", partners)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(20000)]
    text, rows = rng.choice(words, 150).tolist(), []
    for i in range(300):
        other = list(text)
        for at in rng.choice(150, int(rng.integers(1, 14)), replace=False):
            other[at] = words[rng.integers(20000)]
        rows.append((i, " ".join(other)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(300))
    for a in range(300):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 10 < len(set(root)) < 290
    assert all(root[c] == root[i] for i, c in got.items())
    assert np.mean([got[i] == root[i] for i in got]) >= 0.98


def test_joined():
    a, b, c = np.arange(10), np.arange(9), np.arange(50, 60)
    empty = np.zeros(0, np.int64)
    assert simhash.joined(np.array([7, 8, 9, 5]), [a, b, c, empty], 0.8) == ([0], [1])
    assert simhash.joined(np.array([7, 7, 9]), [a, b, c], 0.8) == ([], [])
    assert simhash.joined(np.array([7, 8]), [empty, empty], 0.8) == ([], [])
