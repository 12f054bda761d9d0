"""The pipeline on small tables against plain versions of its stages."""

import random
import re

import corpus_pipeline
from vecweave.llm import tokens, toxicity
from vecweave.llm.common import table

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, copy long, mix_key string, key string, row int"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_near_copies(rows):
    """One row of each group: smallest doc_id (null last)."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return [sorted((r[0] is None, r[0] or 0) for r in g)[0] for g in groups.values()]


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    have = words(text)
    for t in items:
        w = words(t)
        n = min(10, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        if any(tuple(have[k : k + n]) in wins for k in range(len(have) - n + 1)):
            return True
    return False


def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(8)]
    edited = [" ".join([*t.split()[:59], word()]) for t in base[:4]]
    out = [(k, t) for k, t in enumerate(base + edited + base[:2])]
    # One doc_id with different texts: a copy of document 1 and a text of its own; rows without an id; repeats.
    out += [(2, base[1]), (2, text(50)), (4, text(40)), (4, text(40)), (None, base[3]), (None, text(30)), (70, None), (71, ""), (72, " \n"), (73, text(5000)), out[5], out[5]]
    return [(i, t, rng.choice(["a", None]), 1000 + k, f"keep{k}", "k", k) for k, (i, t) in enumerate(out)]


def test_stages_on_awkward_rows(spark, tmp_path):
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    # Near copies: each group leaves one row, whose values are its own.
    near = corpus_pipeline.near_copies_out(spark, docs, DATA)
    got = near.collect()
    assert near.schema == docs.schema and {tuple(r) for r in got} <= set(given)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(plain_near_copies(given))
    # Decontamination: rows follow their own text.
    items = [(1, given[3][1]), (2, given[-5][1] or "x"), (3, "zz")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.benchmark_out(spark, docs, str(tmp_path))
    want = [r for r in given if not contaminated(r[1], [t for _, t in items])]
    assert clean.schema == docs.schema and sorted(map(tuple, clean.collect()), key=repr) == sorted(want, key=repr) and len(want) < len(given)
    # Toxicity: rows follow their own text, other columns keep their values.
    labels = [(k, int(k // 8 % 4 == 0)) for k in range(500, 900)]
    rude = [(k, f"{given[k % 8][1][:80]} {'grobix snarvel grobix' if y else 'kind words here'} {k}", "a", k, "m", "k", k) for k, y in labels]
    bad = [(2, f"{given[6][1][:80]} grobix snarvel grobix 2", "a", 1, "m", "k", 1), (None, f"{given[7][1][:80]} grobix snarvel grobix 7", None, 2, "m", "k", 2)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    mixed = spark.createDataFrame(given + rude + bad, SCHEMA)
    left = [tuple(r) for r in corpus_pipeline.toxic_out(spark, mixed, str(tmp_path)).collect()]
    scores = {(r.doc_id, r.key): r.predicted for r in toxicity.toxicity(mixed, table(spark, str(tmp_path), "labels")).collect()}
    assert set(given) <= set(left) and not set(bad) & set(left)
    assert len(left) == len(given) + sum(not y for _, y in labels) and sum(scores.values()) > 90
    # Mixing: whole rows with their own values, repeated by source.
    copies = corpus_pipeline.sources_mixed(spark, docs, DATA)
    assert copies.schema == docs.schema and {tuple(r) for r in copies.collect()} <= set(given)
    # Token files: every row, in the order of doc_id.
    out = sorted(corpus_pipeline.token_files(spark, docs, DATA).collect(), key=lambda r: r.start)
    encode = tokens.Encoder(tokens.default_tokenizer())
    n = sorted((r[0] is not None, r[0] or 0, len(encode(r[1] or "")) // encode.dtype.itemsize + 1) for r in given)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out) == n
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))  # noqa: B905
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "token output" or empty.columns == docs.columns), name


def test_run_is_the_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token output"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect())) and docs.count() > 0


def test_whole_run_without_ids(spark, tmp_path):
    """A third of the documents have no id: they are judged, kept and mixed like the others."""
    for name in ("documents", "labels", "benchmark"):
        d = table(spark, DATA, name)
        if name == "documents":
            d = d.selectExpr("if(xxhash64(text) % 3 = 0, null, doc_id) as doc_id", *(c for c in d.columns if c != "doc_id"))
        d.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    kept = corpus_pipeline.benchmark_out(spark, corpus_pipeline.near_copies_out(spark, corpus_pipeline.toxic_out(spark, docs, str(tmp_path)), str(tmp_path)), str(tmp_path))
    n, none = kept.count(), kept.where("doc_id is null").count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    got = sum(r.doc_id is None for r in rows)
    assert none > 30 and abs(len(rows) - n) < 4 * n**0.5 and abs(got - none) < 5 * none**0.5
    by_start = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + k == b for (a, k), (b, _) in zip(by_start, by_start[1:], strict=False))
