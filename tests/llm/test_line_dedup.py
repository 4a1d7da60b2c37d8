import duckdb

from lumenfield.llm import line_dedup, queries

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs):
    place = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            first[key(line)] = min(place(d), first.get(key(line), place(d)))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == place(d)]
        out.append((d is None, d or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op10_line_dedup"])
    df = queries.op10_line_dedup(spark, sf)
    assert rel.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_odd_rows_and_any_batching(spark):
    docs = [(5, "The same line\nonly here, once"), (3, "  THE SAME LINE\t\nshort\nshort"), (9, "the same line\n\nthe same line\nÉcole de là-bas"), (7, "école de là-bas\nÉcole de là-bas"), (None, "the same line\nnew line of null"), (1, None), (2, ""), (3, "the same line\nagain three"), (9, "the same line"), (4, "\n\n"), (8, "x the same line"), (6, "long " * 20000 + "\nthe same line")]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, ord int, pos int")
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(df, batches=batches, fanout=fanout).collect())
        assert got == brute(docs)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
