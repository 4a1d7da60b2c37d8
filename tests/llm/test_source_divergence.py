import random
import re
from collections import Counter

import duckdb

from lumenfield.llm import queries, source_divergence


def brute(docs, min_docs, top):
    """Sorted rows of (lang, source, text) documents."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in docs]
    held, group, whole = Counter(), {}, {}
    for lang, source, words in docs:
        held.update((lang, w) for w in set(words))
        group.setdefault((lang, source), Counter()).update(words)
        whole.setdefault(lang, Counter()).update(words)
    out = []
    for lang, counts in whole.items():
        keep = [w for w in counts if held[lang, w] >= min_docs]

        def shares(c):
            n = sum(c[w] for w in keep)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(keep)) for w in keep}

        q, p = shares(counts), {s: shares(c) for (x, s), c in group.items() if x == lang}
        for s in p:
            rows = [("pair", o, sum(abs(p[s][w] - p[o][w]) for w in keep)) for o in p if o != s]
            out += [(lang, s, *x, i + 1) for i, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[1].encode())))]
            rows = [("term", w, p[s][w] - q[w]) for w in keep if group[lang, s][w] and p[s][w] > q[w]]
            out += [(lang, s, *x, i + 1) for i, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[1].encode()))) if i < top]
    return sorted(out)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op11_source_divergence"])
    df = queries.op11_source_divergence(spark, sf)
    got = sorted(map(tuple, df.collect()))
    assert rel.columns == df.columns and got == sorted(rel.fetchall()) and {r[2] for r in got} == {"pair", "term"}


def test_odd_rows_collisions_flushes_and_many_sources(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghé" for b in "xyzÉßж"] + ["UPPER", "upper", "don't", "日本", "x9y"]
    docs = [(rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(60)] + [None, "", "é", "z" * 300]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(400)]
    docs += [("fr", "only", "a b"), ("xx", "a", None), ("xx", "b", "12 34"), ("en", "s1", "hot " * 60_000)] + [("en", "s2", "copy of this")] * 120 + [("en", "s\x00", "\x00a\x00b")]
    df = spark.createDataFrame([(i % 7 or None, t, lang, s, 0, 0, 0) for i, (lang, s, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n long, h long, term int").repartition(6)
    want = brute(docs, 5, 7)
    assert sorted(map(tuple, source_divergence.audit(df, 5, 7).collect())) == want
    # few bits of digest: nearly all terms share theirs with another; tasks give up their counts at every few terms
    assert sorted(map(tuple, source_divergence.audit(df, 5, 7, flush=40, bits=3).collect())) == want
    assert sorted(map(tuple, source_divergence.audit(df, 10_000, 7).collect())) == brute(docs, 10_000, 7)
    assert source_divergence.audit(df.limit(0)).collect() == []


def test_counts_over_the_range_of_a_product_of_longs(spark):
    row = spark.createDataFrame([(10**17, 3 * 10**17, 7)], "n long, total long, v long").select(source_divergence._part("n", "total", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**17 + 5) // (3 * 10**17 + 35)
