import re

import duckdb

from lumenfield.llm import quality_rules, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORDS.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, x in enumerate(tri) if tri.count(x) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op1_quality_rules"])
    df = queries.op1_quality_rules(spark, sf)
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_odd_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n\x0b\x0c\r", "a b c a b c", "x x x x x", "a\n\na\nb\n a", "é#*$%&|<> ü\U0001f600", good, good, "na " * 3000, " a  b c d "]
    hosts = [None, "h", "h", "h", "h", "h", "h", None, "h", "g", "g"]
    rows = [(i if i != 3 else None, t, h, 1, "clash", -1) for i, (t, h) in enumerate(zip(texts, hosts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, kept string, host_docs int")
    got = quality_rules.judge(df).collect()
    by_text = sorted((r["text"] is None, r["text"] or "", r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert by_text == sorted((t is None, t or "", *counts(t)) for t in texts)
    for r in got:
        n, *_, repeated = counts(r["text"])
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert r["kept"] == (not r["base_failed"] and (r["source"] is None or r["host_rate"] <= 0.5))
    assert [r["kept"] for r in got if r["text"] == good and r["source"] is None] == [True]
    assert [r["kept"] for r in got if r["text"] == good and r["source"] == "h"] == [False]  # six of its seven documents fail
    assert quality_rules.judge(df.limit(0)).collect() == []


def test_small_hosts_shrink_towards_the_mean(spark):
    rows = [(1000 * h + i, f"h{h}", i < bad) for h, (n, bad) in enumerate([(200, 20), (200, 30), (200, 10), (200, 60), (2, 2)]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, base_failed boolean")
    rate = {r["source"]: r["host_rate"] for r in quality_rules.host_rates(df).collect()}
    assert abs(rate["h0"] - 0.1) < 0.02 and 0.1 < rate["h4"] < 1.0
    one = quality_rules.host_rates(df.where("source = 'h0'")).first()
    assert one["host_rate"] == 0.1
