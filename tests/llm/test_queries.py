import glob
import re

import duckdb
import numpy as np
import pytest
from test_ops import brute_mix, lower, words_of

from tidemark.llm import packing, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= ids
        ids = {r.doc_id for r in kept.collect()}
    copies = sorted((r.doc_id for r in kept.collect()))
    rows = packing.pack(kept).collect()
    assert sorted(d for r in rows for d, o in zip(r.doc_ids, r.doc_offsets, strict=True) if o == 0) == copies
    assert {d for r in corpus_pipeline.run(spark, SF).collect() for d in r.doc_ids} == ids


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def near_copies(rows):
    """Rows that stay when of each group of texts whose five-word shingle sets are 4/5 alike the least doc_id stays."""
    sets = []
    for r in rows:
        w = words_of(lower(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in least.values()]


def clean(rows, items):
    windows = {}
    for t in items:
        w = alnum(t)
        for a in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(min(13, len(w)), set()).add(tuple(w[a : a + 13]))
    out = []
    for r in rows:
        w, hit = alnum(r["text"]), set()
        for n, known in windows.items():
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in known:
                    hit |= set(range(a, a + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_pipeline_equals_brute_force(spark):
    """The whole run by plain loops; of the first stage the network is taken as it was learned."""
    import corpus_pipeline

    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    net = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = lambda t: net.probability(net.highest(toxicity.inputs_of(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))))[0]
    rows = [r.asDict() for r in docs.collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    rows = clean(near_copies([r for r in rows if score(r["text"]) < 0.5]), [r.text for r in items.collect()])
    want = sorted(r["doc_id"] for r, n in brute_mix(rows) for _ in range(n))
    made = corpus_pipeline.run(spark, SF).collect()
    assert sorted(d for r in made for d, o in zip(r.doc_ids, r.doc_offsets, strict=True) if o == 0) == want and 0 < len(rows) < docs.count()
