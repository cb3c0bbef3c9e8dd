"""MinHash near-duplicates against all pairs, and the promise of the multi-index join."""

import random

import numpy as np
import pytest

from lodestone.llm import minhash
from tests.llm.test_operators import LOWER, WORD, clashing, real, rows, table  # noqa: F401


def shingles(text, k=5):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain(rows, percent=85):  # noqa: F811
    sets = [shingles(t) for _, t in rows]
    place = {d: d for d, _ in rows if d is not None}

    def root(x):
        while place[x] != x:
            x = place[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for g in s for j in at[g] if j < i}:
            if None in (rows[i][0], rows[j][0]) or (i, j) in seen:
                continue
            seen.add((i, j))
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                place[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else root(d), d is None or d == root(d)) for (d, _), s in zip(rows, sets)), key=str)


def edited(rng, words, share):
    return " ".join(rng.choice("uvwxyz") + str(rng.random()) if rng.random() < share else w for w in words)


def near_copies(seed=3):
    rng = random.Random(seed)
    rows = []  # noqa: F811
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 9, 60, 300]))]
        for _ in range(25):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))))
    rng.shuffle(rows)
    return rows


def test_components_are_those_of_all_pairs(spark, real, rows):  # noqa: F811
    more = [(10_000 + d, t) for d, t in near_copies()]
    df = clashing(real.unionByName(table(spark, more)), "n", "c", "sign", "key", "a.b", "kept")
    got = minhash.minhash_near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows + more)


def test_crowded_keys_lose_no_pair(spark):
    """Documents that share one passage crowd its keys; near copies among them are still found when every key counts as crowded."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []  # noqa: F811
    for i in range(70):
        own = [f"d{i}x{j}" for j in range(30)]
        rows.append((i, " ".join(passage + own)))
        if i % 7 == 0:
            rows.append((1000 + i, " ".join(passage + own[:28] + ["z"])))
    rows += [(2000 + d, t) for d, t in near_copies(rng.random())]
    want = plain(rows)
    for crowd in (1, 5, 64):
        got = minhash.minhash_near_duplicates(table(spark, rows).repartition(3), crowd=crowd).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == want, crowd


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(4)
    pairs, size = [], minhash.CHUNKS * minhash.WIDTH
    for i in range(400):
        x = rng.integers(0, 65536, size).astype("<u2")
        y = x.copy()
        if i % 2:  # as evenly as the chunks allow: the worst case
            where = [5 * int(c) + int(j) for c in rng.permutation(minhash.CHUNKS) for j in rng.permutation(5)[:2]][: minhash.DISTANCE]
        else:
            where = rng.permutation(size)[: minhash.DISTANCE].tolist()
        y[where] ^= rng.integers(1, 65536, len(where)).astype("<u2")
        pairs.append((x.tobytes(), y.tobytes()))
    df = spark.createDataFrame([(bytearray(x), bytearray(y)) for x, y in pairs], "x binary, y binary")
    for r in df.select(*(minhash.F.array(*minhash.chunk_keys(c)).alias(c) for c in "xy")).collect():
        assert set(r.x) & set(r.y)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    apart = []
    for _ in range(60):
        both, a, b = rng.integers(0, 1 << 63, 850), rng.integers(0, 1 << 63, 75), rng.integers(0, 1 << 63, 75)
        x, y = (np.frombuffer(minhash.signature(np.concatenate([both, z]).astype(np.uint64)), "<u2") for z in (a, b))
        apart.append((x != y).sum())
    assert 6.5 < np.mean(apart) < 8.5 and max(apart) <= minhash.DISTANCE
    big = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert minhash.signature(big) == minhash.signature(np.concatenate([big[9000:], big[:9000]]))


def test_empty_tables_short_texts_and_repeats(spark):
    cols = ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.minhash_near_duplicates(table(spark, [])).count() == 0
    blank = [(1, None), (2, ""), (3, " \n"), (None, None)]
    got = minhash.minhash_near_duplicates(table(spark, blank)).select(cols).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)], key=str)
    some = [(5, "One two"), (4, "one TWO"), (4, "one two"), (None, "one two"), (9, "one two three"), (8, "w " * 90_000), (7, "w " * 60_000)]
    got = minhash.minhash_near_duplicates(table(spark, some)).select(cols).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(some)
    with pytest.raises(ValueError):
        minhash.minhash_near_duplicates(table(spark, some), distance=20)


def test_folded_parities_bound_what_two_sets_do_not_share():
    rng = np.random.default_rng(5)
    for n in (1, 30, 300, 3000):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        for more in (0, 1, 5, 40):
            y = np.concatenate([x[more // 2 :], rng.integers(0, 2**64, more, dtype=np.uint64)])
            apart = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(minhash.folded(x), minhash.folded(y)))
            assert apart <= len(np.setxor1d(x, y))


def test_pairs_that_cannot_link_are_not_made(spark, monkeypatch):
    texts = [" ".join(f"x{i}y{at}" if at in (50, 54, 59) else f"w{at}" for at in range(60)) for i in range(40)]  # 70 % alike, all under common keys
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, keep = [], minhash.table

    def every(*_):
        return lambda batches: (b.select(["a", "b", "c1", "c2"]) for b in batches)

    def noted(df):
        out = keep(df)
        made.append(out) if out.columns == ["a", "b", "c1", "c2"] else None
        return out

    monkeypatch.setattr(minhash, "_within", every)
    monkeypatch.setattr(minhash, "table", noted)
    assert minhash.minhash_near_duplicates(docs).where("not kept").count() == 0
    assert made and sum(df.count() for df in made) < 20  # of 780
