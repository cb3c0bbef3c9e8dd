"""Fill-in-the-middle against a plain loop, and the round trip."""

import hashlib
import re

from pyspark.sql import functions as F

from lodestone.llm import fim
from tests.llm.test_operators import clashing, real, rows, table  # noqa: F401


def plain(doc_id, text, percent=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, m, z = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", a, m, z, f"<S>{z}<P>{a}<M>{m}"
    return doc_id, len(units), "psm", a, m, z, f"<P>{a}<S>{z}<M>{m}"


def test_arrangements_are_those_of_a_plain_loop(spark, real, rows):  # noqa: F811
    got = [tuple(r) for r in fim.arrange(clashing(real, "units", "form", "h1", "lo", "a.b", "n")).collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_marks_and_their_halves(spark):
    texts = ["a <P> b", "x<S>", "<M>", "<P", "S>", "<", ">", "<<P", "P><M", "<S<M<P", "\n\n", "\U0001f600<\U0001f600>", "é<P\n>", "long " * 60_000, "<S" * 500]
    many = [(i, t) for i, t in enumerate(texts * 40)]
    df = table(spark, many)
    got = fim.arrange(df, percent=100).select("*", fim.restored().alias("back")).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(plain(i, t, 100) for i, t in many)
    assert all(r.back == dict(many)[r.doc_id] for r in got)
    digest = {r.doc_id: r for r in fim.digests(fim.arrange(df, percent=100)).collect()}
    for i, t in many:
        _, n, form, a, m, _, out = plain(i, t, 100)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, t)]
        assert tuple(digest[i]) == (i, n, form, None if a is None else len(a), None if m is None else len(m), *sha)


def test_empty_table_and_other_shares(spark):
    assert fim.arrange(table(spark, [])).count() == 0
    df = table(spark, [(i, "some words") for i in range(300)] + [(None, None), (None, "x y")])
    share = dict(fim.arrange(df, percent=50, spm_percent=50).groupBy("form").agg(F.count("*")).collect())
    assert 100 < share["plain"] < 200 and share["psm"] > 40 and share["spm"] > 40


def test_no_python_in_the_plan(spark, real):  # noqa: F811
    plan = fim.digests(fim.arrange(real))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
