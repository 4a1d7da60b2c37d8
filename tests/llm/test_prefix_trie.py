import hashlib
import math
import zlib

import duckdb

from lumenfield.llm import prefix_trie, queries


def rebuilt(rows):
    """Sequences of (role, text) by conversation, from (conv_id, turn, role, text) without equal turns; the remainder is SQL's, with the sign of the id."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return own, {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = con.sql(queries.oracle_sql()["op12_prefix_trie"])
    df = queries.op12_prefix_trie(spark, sf)
    got = rows(df)
    assert rel.columns == df.columns and got == sorted(rel.fetchall(), key=str)
    assert got == brute(rebuilt(con.sql("select conv_id, turn, role, text from conversations").fetchall())[1])


def made():
    out = []
    for c in [*range(0, 40), *range(95, 130), 205, 206, 207, 300, 301, -3, -100, -103]:
        n = 75 if c in (7, 100, 103) else (1 if c == 300 else c % 9 + 1)
        out += [(c, t if t else None, None if t % 5 == 1 else f"r{t % 2}", None if t == 3 else f"turn {t} {c % 3 if t > 1 else ''}") for t in range(n)]
    return out + [(7, 75 + t, "r", "same again") for t in range(40)] + [(400 + c, t, "u", "x" * (50_000 if t == 1 else 3)) for c in range(60) for t in range(3)]


def test_odd_rows_of_any_band_and_piece(spark):
    data = made()
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in data] + [(None, 1, "r", "no conversation", 0, 0, 0)], "conv_id long, turn long, role string, text string, m long, k1 int, n int").repartition(6)
    own, shared = rebuilt([(c, t, r, x) for c, t, r, x in data])
    turns, convs = prefix_trie.numbered_turns(df)
    want = brute(shared)
    assert any(not t for t in shared.values()) and any(t == own[c][: len(t)] for c, t in shared.items())
    again = prefix_trie.shared_openings(turns, convs)
    for band, chunk in ((8, 1024), (2, 4), (3, 16)):  # 2 and 4: seven levels, conversations in up to 29 pieces
        assert rows(prefix_trie.trie(*again, band, chunk)) == want
    assert rows(prefix_trie.trie(turns, convs)) == brute(own)


def test_ties_and_repeated_rows_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(1, 5, "a", "x"), (1, 5, "a", "x"), (1, 5, "a", "y"), (2, 5, "a", "y"), (2, 5, "a", "x"), (2, 5, "a", "x")], "conv_id long, turn long, role string, text string")
    got = rows(prefix_trie.trie(*prefix_trie.numbered_turns(df)))
    assert [(r[0], r[1], r[3], r[5], r[6]) for r in got] == [(1, d, 2, 1, 3 - max(0, d - 1)) for d in range(4)]
    none = prefix_trie.numbered_turns(df.limit(0))
    assert prefix_trie.trie(*none).collect() == []


def test_ends_of_a_node_over_many_batches_are_one_hash(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(500).selectExpr("cast(id % 5 = 0 as bigint) as m", "0L as k1", "0L as k2", "id - 100 as conv_id")
        got = {r["m"]: r["ends_sha256"] for r in prefix_trie.ends_hashes(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {m: hashlib.sha256(",".join(str(i - 100) for i in range(500) if (i % 5 == 0) == m).encode()).hexdigest() for m in (0, 1)}
