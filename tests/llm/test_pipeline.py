import base64
import hashlib
import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402

from thalweg.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, folder, out = spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append((name, before, docs.collect()))
    return {name: (before, after) for name, before, after in out}


def test_the_stages_keep_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name, (before, after) in list(stages.items())[:-1]:
        assert list(after[0].asDict()) == columns and {tuple(r) for r in after} <= {tuple(r) for r in before}, name


def test_quality(spark, stages):
    before, after = stages["quality"]
    weights, bias = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    cache = quality._Tokens()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if quality.score(r["text"], weights, bias, cache) >= 0.7}


def test_exact_copies(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    assert {r["doc_id"] for r in after} == {i for _, i in best.values()}


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components(ids, near):
    group = {i: i for i in ids}
    for i in ids:
        for j in near.get(i, ()):
            a, b = sorted((group[i], group[j]))
            if a != b:
                group = {k: a if g == b else g for k, g in group.items()}
    return group


def test_near_copies(spark, stages):
    """By the similarity of their sets of five-word shingles: clear copies go, and what is far from all others stays.

    The small table has no edited copies left at this stage, so some are planted.
    """
    before, stage_kept = stages["simhash"]
    planted = []
    for r in before:
        words = r["text"].split()
        if len(words) >= 80 and len(planted) < 40:
            words[len(words) // 2] = "otherwise"
            planted.append((10**6 + r["doc_id"], " ".join(words), *r[2:]))
    rows = [tuple(r) for r in before] + planted
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()}
    sets = {i: shingles(text) for i, text, *_ in rows}
    near, far = {}, {}
    for i in sets:
        for j in sets:
            if i < j:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.85:
                    near.setdefault(i, []).append(j)
                if s >= 0.65:
                    far.setdefault(i, []).append(j)
    group, loose = components(sorted(sets), near), components(sorted(sets), far)
    copies = {i for i, g in group.items() if i != g}
    assert len(planted) >= 20 and {i for i, *_ in planted} <= copies and len(copies & kept) <= 0.02 * len(copies)
    apart = {g for g in loose.values()}
    assert apart <= kept and apart & {r["doc_id"] for r in before} <= {r["doc_id"] for r in stage_kept}


def test_benchmark_passages(spark, stages):
    before, after = stages["decontaminate"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in before if any(t in r["text"] for t in items)}
    kept = {r["doc_id"] for r in after}
    words = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    shared = {r["doc_id"] for r in before if any(len(words(t) & words(r["text"])) >= 0.5 * len(words(t)) for t in items)}
    assert held and not held & kept and {r["doc_id"] for r in before} - kept <= shared


def test_tokens(stages):
    before, after = stages["bpe"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"] for r in after} == set(texts)
    for r in after:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages["bpe"][1]))
