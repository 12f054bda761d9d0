"""Line dedup, periodic runs and phrases against plain versions: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from vecweave.llm import lines, periodic, phrases

SCHEMA = "doc_id long, text string, lang string, n_lines int, row string, runs string, words int"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "Dd", "é", "the", "The", "of"])
    line = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    common = ["This line stands in many documents", "  this LINE stands in many documents\t", "é" * 19, "é" * 20, "x" * 19, "x" * 20, "12345678901234567890\r"]
    texts = [None, "", " \n ", "One", "a b", "\n\n", "a " * 3000, "a b c " * 50 + "d", "x" * 30_000, ("a b. c, " * 9 + "the of the of\t") * 300]
    texts += ["\n".join([*(line() for _ in range(rng.randint(0, 9))), *rng.sample(common, rng.randint(0, 4)), line()]) for _ in range(40)]
    out = [(k, t, rng.choice(["en", "de", None]), 7, "r", "s", 1) for k, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, common[0] + "\n" + common[3], "en", 1, "r", "s", 1), (None, common[5], None, None, None, None, None), (12, common[0] + " and more", "en", 1, "r", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_lines(rows, min_docs, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= least:
                holds[k].append(r[0])
    best = {k: max((x for x in ids if x is not None), default=None) for k, ids in holds.items() if len(ids) >= min_docs}
    out = []
    for r in rows:
        have = (r[1] or "").split("\n")
        kept = [x for x in have if key(x) not in best or best[key(x)] == r[0]]
        out.append((r[0], len(have), len(have) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [True, False])
def test_line_dedup(docs, rows, small):
    """Shards held by every task, and documents' hashes dealt to shards, give the same."""
    got = lines.without_repeated_lines(docs, arrays_bytes=1 << 20 if small else 0, shard_keys=4)
    want = plain_lines(rows, 3, 20)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == want
    assert sum(x[2] for x in want) > 20 and set(got.columns) == {*docs.columns, "n_dropped"}
    assert lines.without_repeated_lines(docs.limit(0), arrays_bytes=1 << 20 if small else 0).count() == 0


def test_lines_of_documents_without_ids(spark):
    same = "the same line of text in all of them"
    d = spark.createDataFrame([(None, same)] * 3 + [(None, "other")], "doc_id long, text string")
    assert [r.n_dropped for r in lines.without_repeated_lines(d).collect()] == [0] * 4
    d = spark.createDataFrame([(None, same), (None, same), (-5, same)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in lines.without_repeated_lines(d).collect()), key=repr) == [(-5, same), (None, ""), (None, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(-(2**63), 2**63 - 1, 2 * n) for _ in range(2))
    h1[: n // 2] = 7  # only the second half tells these apart
    counts, keepers = rng.integers(3, 2**40, n), rng.integers(0, 99, n)
    made = lines.Shard.build(h1[:n], h2[:n], counts, keepers)
    assert sorted(made.index(h1[:n], h2[:n]).tolist()) == list(range(n))
    back = lines.Shard.of_row(made.row())
    c, k = back.probe(h1, h2)
    assert c[:n].tolist() == np.minimum(counts, 2**32 - 1).tolist() and k[:n].tolist() == keepers.tolist()
    assert not c[n:].any() and (k[n:] == lines.NOBODY).all()


def plain_runs(s, periods=4, least=6):
    n, found = len(s), {}
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((b, e - b, p) for (b, e), p in found.items())


def test_runs_of_random_words():
    rng = random.Random(1)
    total = 0
    for _ in range(600):
        s = [rng.randint(0, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, unit = rng.randint(0, len(s)), [rng.randint(0, 3) for _ in range(rng.randint(1, 6))]
            s[at:at] = (unit * 9)[: rng.randint(4, 40)]
        for periods, least in ((4, 6), (2, 2), (3, 10)):
            want = plain_runs(s, periods, least)
            assert periodic.periodic_runs(np.array(s, np.int64), periods, least) == want, s
            total += len(want)
    assert total > 2000


def test_runs_of_long_words_lists():
    for s in ([0] * 50_000, [0, 1] * 20_000 + [0], [*range(300)] * 40, list(range(30_000))):
        got = periodic.periodic_runs(np.array(s, np.int64))
        p = len(set(s))
        assert got == ([(0, len(s), p)] if len(s) >= 4 * p else [])
    a, b = [0], [0, 1]  # Fibonacci words hold very many runs of small exponents
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic.periodic_runs(np.array(b), 2, 2) == plain_runs(b, 2, 2)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        x = rng.integers(0, 3, n)
        sa, rank, lcp = periodic.suffix_array(x)
        s = x.tolist()
        want = sorted(range(n), key=lambda i: s[i:])
        assert sa.tolist() == want and rank[sa].tolist() == list(range(n))
        common = lambda a, b: next((k for k in range(n) if a + k >= n or b + k >= n or s[a + k] != s[b + k]), n)
        assert lcp.tolist() == [0, *(common(a, b) for a, b in zip(want, want[1:], strict=False))]


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_runs_of_documents(docs, rows):
    want = []
    for r in rows:
        w = plain_words(r[1])
        if r[0] is not None:
            h = zlib.crc32(str(r[0]).encode())
            g, n = h // 10, len(w)
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w) if len(w) < 20_000 else None
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want.append((r[0], len(found), *(best or (None,) * 3), "".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(x for k, x in enumerate(w) if k not in gone)))
    have = periodic.with_runs(periodic.planted(docs)).withColumn("best", periodic.strongest())
    got = [(r.doc_id, len(r.runs), *(r.best or (None,) * 3), "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs), r.collapsed) for r in have.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[1] for x in want) > 5
    assert set(have.columns) == {*docs.columns, "n_words", "collapsed", "best"} and periodic.with_runs(docs.limit(0)).count() == 0
    short = periodic.collapsed(docs)
    assert short.columns == docs.columns and {r.text for r in short.where("doc_id < 6").collect()} == {r[1] for r in rows if r[0] is not None and r[0] < 6}


def test_runs_query(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    r = out[6]  # 3,000 times one word, whether planted or not
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 3000, 1, 3_000_000)
    assert r.runs_sha256 == hashlib.sha256(b"0,3000,1\n").hexdigest() and r.collapsed_sha256 == hashlib.sha256(b"a").hexdigest()
    assert (out[0].n_runs, out[0].start, out[0].collapsed_sha256) == (0, None, hashlib.sha256(b"").hexdigest())


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def plain_collocations(rows, least, most, top, percent):
    counts, n = defaultdict(Counter), Counter()
    for r in rows:
        for w in pieces(r[1]):
            n[r[2] or "und"] += len(w)
            for k in range(1, most + 1):
                counts[r[2] or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in many.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        best = []
        for p, a in many.items():
            if not (p in inside and 100 * inside[p] >= percent * a):
                cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                best.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "top", "shard"), [(10, 3, 2000, 4 << 20), (3, 3, 7, 200), (2, 4, 50, 1000), (1, 2, 5, 64)])
def test_collocations(docs, rows, least, most, top, shard):
    got = phrases.collocations(docs, least, most, top, 50, shard)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, most, top, 50)


def test_collocations_of_nothing(docs):
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_states_of_an_automaton():
    rng = random.Random(8)
    for depth in (1, 2, 3, 4):
        text = ". ".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(30))
        made = phrases.Automaton(np.frombuffer(text.encode(), np.uint8), depth)
        ends = defaultdict(set)
        for j, w in enumerate(pieces(text)):
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    ends[tuple(w[i : i + k])].add((j, i + k))
        assert made.total == sum(map(len, pieces(text)))
        for k in range(1, depth + 1):
            columns, count = made.phrases(k)
            got = dict(zip(made.text(columns).to_pylist(), count.tolist(), strict=True))
            assert got == {" ".join(p): len(e) for p, e in ends.items() if len(p) == k}
        # A state is a class of equal ends, and its link leads to the longest suffix of more.
        name = made.words.to_pylist()
        longest = [tuple(name[b[s]] for b in made.back[: made.length[s]][::-1]) for s in range(len(made.count))]
        assert len({frozenset(ends[p]) for p in ends}) == len(longest)
        for s, p in enumerate(longest):
            low = made.shortest[s]
            assert all(ends[p[-k:]] == ends[p] for k in range(low, len(p) + 1))
            assert (made.link[s] == -1) == (low == 1) and (low == 1 or longest[made.link[s]][-(low - 1) :] == p[-(low - 1) :])
            assert low == 1 or made.length[made.link[s]] == low - 1


def test_blocks_are_cut_between_pieces():
    text = b"aa bb. cc, " * 50 + b"x" * 300 + b"!yy zz"
    for size in (5, 17, 64, 10_000):
        parts = list(phrases.blocks(text, size))
        assert b"".join(parts) == text and all(p[-1:] in b".,;:!?\n" for p in parts[:-1])
