"""The pipeline on the smallest tables, stage by stage against brute force."""

import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_odd_rows(spark, tmp_path):
    near = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " ".join(near)), (4, " ".join(near)), (5, " ".join([*near[:59], "x"])), (6, "mail a@b.de now"), (6, "mail a@b.de now"), (None, " ".join(near)), (None, "call 10.0.0.1"), (7, "y" * 200_000), (8, "é😀 " * 50)]
    schema = "doc_id long, text string, score double, key string, digest string, component_id long"
    docs = spark.createDataFrame([(i, t, 0.5, "k", "d", 1) for i, t in rows], schema).repartition(3)
    columns, sf = docs.columns, str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for empty in (False, True):
        own = docs.where("doc_id < 0") if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, own, sf).write.parquet(str(tmp_path / f"{empty}{k}"))
            own = spark.read.parquet(str(tmp_path / f"{empty}{k}"))
            got = own.collect()
            if empty:
                assert not got
                continue
            texts = {r["doc_id"]: r["text"] for r in got} if name != "packing" else {}
            if name != "packing":
                assert own.columns == columns
                assert sum(r["doc_id"] is None for r in got) == 2
            if name == "toxicity":
                assert len(got) == len(rows)
            elif name == "exact_dedup":
                assert sorted(i for i in texts if i is not None) == [1, 3, 5, 6, 7, 8] and sum(r["doc_id"] == 6 for r in got) == 2
            elif name == "ngram_jaccard":
                assert sorted(i for i in texts if i is not None) == [1, 3, 6, 7, 8]
            elif name == "pii":
                assert texts[6] == "mail <email> now" and texts[1] is None and texts[7] == "y" * 200_000
                assert "call <ip>" in {r["text"] for r in got}
            else:
                assert {r["doc_id"] for r in got} == {None, 1, 3, 6, 7, 8}
                assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        if name != "packing":
            assert docs.columns == columns and len(ids) == len(after)
        if name == "toxicity":
            clean = {r["doc_id"] for r in before} - toxic
            assert len(toxic & ids) <= 0.2 * len(toxic) and len(clean & ids) >= 0.97 * len(clean)
        elif name == "exact_dedup":
            first: dict = {}
            for r in before:
                t = re.sub("[\x20\x09-\x0d]+", " ", r["text"])
                first[t] = min(r["doc_id"], first.get(t, r["doc_id"]))
            assert ids == set(first.values())
        elif name == "ngram_jaccard":
            sets = {}
            for r in before:
                w = r["text"].encode().lower().split()
                sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            assert not any(a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in ids for b in ids)
            assert all(any(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for b in sets if b != a) for a in set(sets) - ids)
        elif name == "pii":
            assert ids == {r["doc_id"] for r in before}
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        else:
            own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            own.encode_special_tokens = True
            want = {r["doc_id"]: len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
            got: dict = {}
            for r in after:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
            assert got == want
        before = after
