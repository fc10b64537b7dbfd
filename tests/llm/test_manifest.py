"""Operator 11 against a straightforward recomputation, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import pytest

from twinframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Levels of a list of digests, from the leaves to one root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[k : k + 3]) for k in range(0, len(now), 3)])
    return levels


def path(levels, i):
    out = []
    for now in levels[:-1]:
        lo = i - i % 3
        out.append(("".join(now[lo:i]), "".join(now[i + 1 : lo + 3])))
        i //= 3
    return out


def brute(rows):
    """{row: (leaf, subroot, root, proof, folded root, verified)} of rows with distinct ids."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([low[s][-1][0] for s in order])
    out = {}
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            siblings = path(low[s], i) + path(top, k)
            bad = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                bad = (*r[:4], r[4].replace("\n", ""))
            d = leaf(bad)
            for a, b in siblings:
                d = h(a, d, b)
            out[r] = (leaf(r), low[s][-1][0], top[-1][0], h(*[a + b for a, b in siblings]), d, d == top[-1][0])
    return out


def op(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11_manifest(spark, str(tmp_path))


def check(spark, tmp_path, rows):
    got = op(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, *r[1:]) for r in got) == sorted((k[0] is not None, k[0] or 0, *v) for k, v in want.items())


def test_hot_group_over_several_rounds(spark, tmp_path):
    """One group of more than CHUNK rows, groups of 1 to 4, of one run and of one run more, and a null group."""
    rng = random.Random(7)
    sizes = {"hot": merkle.CHUNK + 31, "a": 1, "b": 2, "é": 3, "c": 4, None: 9, "d": 10, "": 28}
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    rows = [(next(ids), s, rng.choice(["en", None]), rng.choice([1, None]), rng.choice([None, "", "x\ny", "ü\n\n", "plain"])) for s, n in sizes.items() for _ in range(n)]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 3, 4, 82])
def test_small_tables(spark, tmp_path, n):
    check(spark, tmp_path, [(i, f"s{i}" if n == 82 else None, None, i, "a\nb" * i) for i in range(n)])


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, "s", "en", 1, "a"), (None, None, None, None, None), (5, "s", "en", 3, "x" * 200_000 + "\n")]
    again = [(7, "s", "en", 1, "same")] * 5
    df = spark.createDataFrame([(*r, "q", "q", 0) for r in rows + again], SCHEMA + ", leaf string, path string, i int")
    got = op(spark, tmp_path, df).collect()
    assert len(got) == 8 and len({r.root for r in got}) == 1
    assert {r.leaf for r in got} == {leaf(r) for r in rows + again}
    assert all(r.verified for r in got if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2)
    assert len({r.proof_sha256 for r in got if r.doc_id == 7}) > 1  # repeated rows are leaves of their own


def test_empty(spark, tmp_path):
    assert op(spark, tmp_path, spark.createDataFrame([], SCHEMA)).count() == 0


def test_changed_rows_between_manifests(spark):
    old = [(i, f"s{i % 5}", "en", i, f"text {i}") for i in range(60)]
    new = [r for r in old if r[0] != 7] + [(99, "s1", "en", 1, "new")]
    new[20] = (*new[20][:4], "other")
    a, b = (merkle.manifest(spark.createDataFrame(x, SCHEMA), "source", "doc_id", merkle.FIELDS) for x in (old, new))
    assert sorted(map(tuple, merkle.changed(a, b, "source", "doc_id").collect())) == sorted([("s2", 7, "removed"), ("s1", 99, "added"), (new[20][1], new[20][0], "changed")])
    assert merkle.changed(a, a, "source", "doc_id").count() == 0
