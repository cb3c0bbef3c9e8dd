"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import periodic
from tests.llm.test_operators import clashing, real, rows, table  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=6, times=4):
    """By the definition: every stretch whose words are the same q apart, that can't be longer, and has no smaller period."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(min_length, times * q) and not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found)


def plain_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + k for s, k, p in runs))


def coded(words):
    ids = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 7), st.integers(0, 8), st.integers(0, 40))
def test_runs_are_those_of_the_definition(noise, period, times, at):
    words = noise[:at] + (noise[:period] or [9]) * times + noise[at:]
    assert periodic.runs_of(coded(words)) == plain_runs(words)


def test_every_bound_between_rare_and_frequent_words_counts_alike(monkeypatch):
    rng = random.Random(5)
    for n in (7, 100, 900):
        codes = coded([rng.choice("aaaaabbbccdefghijklm") for _ in range(n)])
        most = n // 4
        want = [int((codes[q:] == codes[: n - q]).sum()) for q in range(1, most + 1)]
        for heavy in (0, 1, 3, 20, 10_000, None):
            assert periodic.lag_matches(codes, most, heavy)[1:].tolist() == want
        monkeypatch.setattr(periodic, "PAIR_BLOCK", 50)
        monkeypatch.setattr(periodic, "FFT_CELLS", 10)
        assert periodic.lag_matches(codes, most, 20)[1:].tolist() == want
        monkeypatch.undo()


def test_long_patterns_in_long_texts():
    rng = random.Random(1)
    words = [rng.choice(["the", "of", *map(str, range(3000))]) for _ in range(30_000)]
    words[5000:17000] = (words[5000:7500] * 5)[:12000]  # period 2500, 4.8 times
    words[20000:20900] = words[20000:20100] * 9
    words[25000:25007] = ["x"] * 7
    got = periodic.runs_of(coded(words))
    assert [(a, k, q) for a, k, q in got if q > 1] == [(a, k, q) for a, k, q in got if q in (2500, 100)] and {q for _, _, q in got} == {2500, 100, 1}
    for a, k, q in got:
        assert words[a : a + k - q] == words[a + q : a + k] and (a == 0 or words[a - 1] != words[a - 1 + q]) and (a + k == len(words) or words[a + k] != words[a + k - q])


def test_documents_are_those_of_a_plain_loop(spark, real, rows):  # noqa: F811
    texts = ["a b " * 20, "x x x x x x", "x x x x x", "a b c a b c a b c a b c a", "A a A a A a A a", "\x0bq\x0bq q\tq q\nq ", "é é é é é é", "  " * 8, "p q p q p q p q p p p p p p"]
    extra = [(1000 + i, t) for i, t in enumerate(texts)]
    df = clashing(real.unionByName(table(spark, extra)), "runs", "n_words", "a.b", "w", "g")
    short = [r for r in rows + extra if len(r[1] or "") < 3000]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df.where("length(coalesce(text, '')) < 3000")).collect())
    want = []
    for doc_id, text in short:
        words = WORD.findall(text or "")
        runs = plain_runs(words)
        want.append((doc_id or 0, len(words), runs, plain_collapse(words, runs)))
    assert got == sorted(want)
    assert sum(1 for r in got if r[2]) >= 7


def test_planted_runs_and_digests(spark, real, rows):  # noqa: F811
    got = {(r.doc_id, r.collapsed_sha256): r for r in periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(clashing(real, "a", "p", "b")))).collect()}
    planted = 0
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        if len(words) > 700:
            continue
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs), plain_collapse(words, runs))]
        r = got[doc_id, sha[1]]
        assert tuple(r) == (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)
    assert planted > 5


def test_empty_table_and_parameters(spark):
    assert periodic.digests(periodic.periodic_runs(table(spark, []))).count() == 0
    r = periodic.digests(periodic.periodic_runs(table(spark, [(7, None)]))).first()
    assert tuple(r)[:6] == (7, 0, None, None, None, None) and r.runs_sha256 == r.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    r = periodic.periodic_runs(table(spark, [(1, "a b c " * 3)]), min_times=3).first()
    assert [tuple(x) for x in r.runs] == [(0, 9, 3)] and r.collapsed == "a b c"
    with pytest.raises(ValueError):
        periodic.periodic_runs(table(spark, []), min_times=2)
