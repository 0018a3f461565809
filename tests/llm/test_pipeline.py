import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from sparkobs.llm import jaccard


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"wort{i}" for i in range(900)]
    docs, labels = [], []
    for i in range(300):
        own = [rng.choice(vocab) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            own[7], own[30] = "zankify", "grumblor"
        docs.append((i, " ".join(own), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    base = docs[1][1].split()
    near = [(1000 + k, " ".join(base[:39] + [f"end{k}"]), "en", "s0", 0) for k in range(4)]
    copies = [(2000, docs[2][1].upper(), "en", "s1", 0), docs[3], docs[3]]
    private = [(3000, " ".join(rng.choice(vocab) for _ in range(20)) + " mail joe@x.example.com", "en", "s2", 0), (3001, None, "en", None, None), (None, "nobody has this text " * 3, "de", "s1", 0)]
    rows = docs + near + copies + private
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == kept.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in kept.collect()})
    toxic = {i for i, *_ in docs if i % 5 == 0}
    assert set(seen[0]) == {r[0] for r in rows} - toxic
    assert set(seen[1]) == set(seen[0]) - {1000, 1001, 1002, 1003, 2000}
    assert spark.read.parquet(f"{tmp_path}/jaccard_join").count() == len(seen[1])
    assert seen[2][3000].text.endswith("mail [EMAIL]") and seen[2][3000].n_chars == len(seen[2][3000].text)
    assert all(seen[2][i].text == seen[1][i].text for i in seen[1] if i != 3000)
    assert 0 < len(seen[3]) <= len(seen[2]) and 3001 not in seen[3]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in seen[4].items():
        ids = own.encode_ordinary(seen[3][i].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(seen[3][i].text.encode()).hexdigest())
    whole = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == Counter(map(tuple, spark.read.parquet(f"{tmp_path}/byte_bpe").collect()))


def test_stages_over_odd_tables(spark, tmp_path):
    """An empty table, labels without rows, very long texts, and columns whose names the operators use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, mark string, row string, own string, size string, pat string, k0 string, spans string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = ("m", "r", "o", "s", "p", "k", "sp")
    long = "lang " + " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000)) + " joe@x.example.com"
    rows = [(1, long, "en", "a", len(long), *extra), (2, None, None, None, None, *extra), (2, None, None, None, None, *extra), (3, "", "de", "a", 0, *extra), (4, "some words of another kind", "en", "b", 26, *extra)]
    for name, given in (("none", []), ("odd", rows)):
        docs = spark.createDataFrame(given, kinds)
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, str(tmp_path))
            if stage != "byte_bpe":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage in ("toxicity", "jaccard_join", "pii"):
                assert docs.count() == len(set(given)) + (stage == "toxicity") * (len(given) - len(set(given)))
        if given:
            assert {r.doc_id for r in docs.collect()} == {1, 4}
            kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/odd-pii").collect()}
            assert kept[1].text == long.replace("joe@x.example.com", "[EMAIL]") and kept[1].n_chars == len(kept[1].text) and kept[1].mark == "m"
        else:
            assert docs.count() == 0


def test_the_join_keeps_strangers_apart_in_a_crowded_sketch(spark, tmp_path, monkeypatch):
    """Long texts of few common passages: nothing but near copies meets in many blocks, and all else is kept."""
    monkeypatch.setattr(jaccard, "BITS", (14, 14))
    monkeypatch.setattr(jaccard, "PROFILE_DOCS", 40)
    rng = random.Random(11)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(16)) for _ in range(1000)]
    rows = []
    for i in range(2600):
        own = [f"w{rng.randrange(10**6)}" for _ in range(180)]
        for p in rng.sample(passages, 3):
            own.insert(rng.randrange(len(own)), p)
        rows.append((2 * i, " ".join(own), "en", "a", 0))
        if i % 20 == 0:
            rows.append((2 * i + 1, rows[-1][1] + " end", "en", "a", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    met, meet = [], jaccard.meet
    monkeypatch.setattr(jaccard, "meet", lambda placed, *how: met.append(placed.count()) or meet(placed, *how))
    kept = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, str(tmp_path)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [d for d, *_ in rows if d % 2 == 0]
    assert sum(met) <= 3 * len(rows)
