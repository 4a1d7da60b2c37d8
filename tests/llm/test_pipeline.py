import duckdb

import corpus_pipeline
from lumenfield.llm import queries

from .test_near_dup import brute as near_brute
from .test_packing import check as packing_check
from .test_suffix_dedup import brute as suffix_brute
from .test_suffix_dedup import brute_passages

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def line_brute(docs):
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = lower(line.strip(SPACE))
            first[k] = min(d, first.get(k, d))
    return {d: "\n".join(x for x in (t or "").split("\n") if len(k := lower(x.strip(SPACE))) < 10 or first[k] == d) for d, t in docs}


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    def run(name):
        out = stages[name](spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({queries.oracle_sql()['op1_quality_rules']}) t where kept").fetchall()}
    docs = run("quality_rules")
    assert docs.columns == columns
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert after == {d: before[d] for d in kept}
    want = line_brute(sorted(after.items()))
    docs = run("line_dedup")
    assert docs.columns == columns
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert after == want
    items = sorted(after.items())
    stay = {d for (d, _), c in zip(items, near_brute(items)) if c == d}
    docs = run("minhash_near_dedup")
    assert docs.columns == columns
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert after == {d: t for d, t in items if d in stay}
    items = sorted(after.items())
    removed, passages = suffix_brute([t for _, t in items]), brute_passages([t for _, t in items])
    docs = run("suffix_array_dedup")
    assert docs.columns == columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert {d: r["n_chars"] for d, r in rows.items()} == {d: len(r["text"]) for d, r in rows.items()}
    for (d, t), (n, gone, spans, _), found in zip(items, removed, passages):
        size, by_words = len(rows[d]["text"].encode()), sum(b - a for a, b in found)
        assert n - gone - by_words - 6 * spans <= size <= n - max(gone, by_words) and (gone or by_words or rows[d]["text"] == t)
    packing_check(stages["best_fit_packing"](spark, docs, sf).collect(), {d: r["text"] for d, r in rows.items()})


def test_nulls_repeats_extra_columns_and_an_empty_table(spark, tmp_path):
    import random

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    texts = [prose(rng.randrange(80, 200)) for _ in range(12)]
    passage = prose(55)
    rows = [(i, t, "en", "s1", len(t), f"n{i}", True, i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]  # repeated rows
    rows += [(20 + i, f"{prose(70)} {passage} {prose(70)}", None, None, None, None, None, None) for i in range(3)]  # a passage that three share
    rows += [(30, None, "en", "s1", 0, None, None, None), (31, "", "en", None, 0, None, None, None), (None, prose(90), None, "s2", 1, None, None, None), (40, texts[2] + " " + prose(3), "en", "s2", 1, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, class_id string, kept boolean, n_bytes int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {n: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rs) for n, rs in seen.items()}
    want = [(False, i) for i in [*range(12), 20, 21, 22]]
    assert ids["quality_rules"] == sorted([*want, (False, 4), (False, 4), (False, 40), (True, 0)])
    assert ids["minhash_near_dedup"] == ids["suffix_array_dedup"] == [*want, (True, 0)]
    after = {r["doc_id"]: r for r in seen["suffix_array_dedup"]}
    assert all(passage not in after[20 + i]["text"] and len(after[20 + i]["text"]) > 300 for i in range(3))
    assert all(after[i]["text"] == texts[i] and after[i]["class_id"] == f"n{i}" for i in range(12))
    assert {r["doc_id"] for r in seen["best_fit_packing"]} == {*range(12), 20, 21, 22, None}
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
