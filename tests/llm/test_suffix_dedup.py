import hashlib
import random
import re

import numpy as np

from lumenfield.llm import queries, suffix_dedup


def brute(texts, length=400):
    seen, out = {}, []
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - length + 1):
            h = hashlib.blake2b(t[i : i + length], digest_size=16).digest()
            seen[h] = seen.get(h, 0) + 1
    for t in data:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] > 1:
                mark[i : i + length] = True
        edges = np.diff(mark.astype(int), prepend=0)
        out.append((len(t), int(mark.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~mark].tobytes()).hexdigest()))
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_suffix_array_dedup(spark, sf).collect()}
    assert [got[d] for d, _ in docs] == brute([t for _, t in docs])


def odd_texts():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    common, long = word(1500), word(700)
    texts = [None, "", "x" * 399, "y" * 400, "z" * 401, "q" * 3000, "ab" * 900, word(5000)]
    texts += [word(rng.randrange(600)) + common[rng.randrange(300) : 1500 - rng.randrange(900)] + word(rng.randrange(600)) for _ in range(60)]
    texts += [long, long, long + "!", "?" + long[1:], word(300) + long + word(10) + long + word(50)]
    texts.append(word(200000) + common + word(100000) + common[:450])
    return texts


def test_odd_texts_and_crowded_anchors(spark, tmp_path):
    texts = odd_texts()
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, rid int").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    want = brute(texts)
    for crowd in (20_000, 3):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(df, crowd=crowd).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def brute_passages(texts, words=51):
    """Byte ranges of strings of ``words`` words that occur twice."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen, out = {}, []
    keys = [[b" ".join((t or "").encode()[a:b] for a, b in s[i : i + words]) for i in range(len(s) - words + 1)] for t, s in zip(texts, spans)]
    for ks in keys:
        for k in ks:
            seen[k] = seen.get(k, 0) + 1
    for s, ks in zip(spans, keys):
        found = []
        for i, k in enumerate(ks):
            if seen[k] > 1:
                a, b = s[i][0], s[i + words - 1][1]
                if found and a <= found[-1][1]:
                    found[-1] = (found[-1][0], max(b, found[-1][1]))
                else:
                    found.append((a, b))
        out.append(found)
    return out


def test_planted_passages_over_and_under_the_length_on_many_files(spark, tmp_path):
    """Passages of 45 to 120 words in documents of different files: bytes by 400-byte strings, passages by 51 words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: rng.choice([" ", "\n", "  "]).join(word() for _ in range(n))
    texts = [None, "", prose(20), *(prose(rng.randrange(60, 300)) for _ in range(40))]
    for n in range(45, 121, 3):
        passage = prose(n)
        texts += [f"{prose(rng.randrange(80))} {passage} {prose(rng.randrange(80))}" for _ in range(rng.choice((2, 2, 3)))]
    rows = [(i, t, "x", i % 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, _rid int").repartition(23).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    want, passages = brute(texts), brute_passages(texts)
    assert sum(bool(p) and not w[1] for p, w in zip(passages, want)) > 3  # some passages are under 400 bytes
    for crowd in (20_000, 1):
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, crowd=crowd, passage_words=51).collect()}
        assert [(g["n_bytes"], g["n_removed"], len(g["spans"]), hashlib.sha256(g["kept"]).hexdigest()) for g in (got[i] for i in range(len(texts)))] == want
        assert [[(p["start"], p["stop"]) for p in got[i]["passages"]] for i in range(len(texts))] == passages
        assert all(got[i]["_rid"] == i % 7 for i in range(len(texts)))
    cut = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(df, passage_words=51, as_text=True).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for a, z in passages[i]:
            covered[a:z] = True
        for p in got[i]["spans"]:
            covered[p["start"] : p["stop"]] = True
        assert cut[i] == np.frombuffer(b, np.uint8)[~covered].tobytes().decode("utf-8", "ignore")
