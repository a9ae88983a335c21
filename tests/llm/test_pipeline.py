"""The pipeline's stages against what was planted, and against each operator by itself."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from folioscan.llm.bpe import default_bpe  # noqa: E402
from folioscan.llm.mixing import mix  # noqa: E402
from tests.llm.test_models import brute_components  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(folder, spark, seed=2, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 120))) for _ in range(n)]
    toxic = set(range(0, n, 4))
    for i in toxic:
        w = texts[i].split()
        for bad in ("wretchling", "snotgobbler"):
            w.insert(rng.randrange(len(w)), bad)
        texts[i] = " ".join(w)
    exact, near = {}, {}
    for i in range(1, 80, 4):
        exact[len(texts)] = i
        texts.append(texts[i].upper())
    for i in range(2, 80, 4):
        w = texts[i].split()
        if len(w) > 60:
            near[len(texts)] = i
            texts.append(" ".join([*w[:-1], "changed"]))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, "", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(n)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts, toxic, exact, near


def test_stages(spark, tmp_path):
    texts, toxic, exact, near = make(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == COLUMNS
        last = before
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    everything = set(range(len(texts) + 2))
    assert everything - ids("toxicity") == toxic
    gone = ids("toxicity") - ids("exact_dedup")
    assert gone == set(exact.values()) | {len(texts)}  # the larger id of equal texts stays, null counts as empty
    rows = sorted(kept["exact_dedup"])
    want = brute_components([r["text"] for r in rows], 5, 80, 100)
    assert ids("ngram_join") == {rows[i]["doc_id"] for i, (_, c) in want.items() if c == i}
    assert ids("exact_dedup") - ids("ngram_join") == set(near)
    plan = mix(spark.read.parquet(f"{tmp_path}/ngram_join")).collect()
    taken = Counter()
    for r in kept["mixing"]:
        taken[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert sum(taken.values()) == sum(r["taken"] for r in plan)
    bpe = default_bpe()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in kept["bpe"]) == Counter((r["doc_id"], tuple(bpe.encode(r["text"]))) for r in last.collect())


def test_run(spark, tmp_path):
    make(str(tmp_path), spark, n=60)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "token_ids"] and out.count() > 40
