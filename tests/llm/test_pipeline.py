"""The corpus pipeline: each stage and the whole against brute force on a planted corpus."""

import ctypes
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from sieveline.llm import common, language_id, mixing, substring_dedup, token_store
from tests.llm.test_operators import SCHEMA, words

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rows():
    """Two languages, copies, near copies, a shared passage, texts that must go, and odd rows."""
    draw, out = random.Random(1), []
    kinds = {"en": "aeithonrs", "de": "uzkßövwgm"}
    for i in range(240):
        lang = ("en", "de")[i % 2]
        out.append((i, " ".join(words(draw.randint(60, 120), i, kinds[lang])), lang, f"s{i % 4}"))
    passage = words(70, 5000, kinds["en"])
    for k, i in enumerate((10, 50, 90)):
        out[i] = (i, " ".join(words(20, 6000 + i, kinds["en"]) + passage + words(20, 7000 + i, kinds["en"])), "en", f"s{k}")
    base = out[20][1].split()
    out.append((300, " ".join(base), "en", "s1"))
    out.append((301, " ".join([*base[:30], "new", *base[31:]]), "en", "s2"))
    out += [(302, None, "en", "s0"), (303, "12 34 ..", "en", "s0"), (304, "", None, None), (305, out[7][1] + " end", "de", None), (306, out[7][1] + " fin", None, None)]
    return [(i, t, lang, src, len(t or "")) for i, t, lang, src in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]


def test_language_stage(spark, docs, rows):
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert kept == {i for i, t, *_ in rows if t and any(map(str.isalpha, t))}


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))


def test_near_duplicate_stage(spark, docs, rows):
    some = docs.where("text is not null and text <> ''")
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, some, "").collect()}
    sets = {i: shingles(t) for i, t, *_ in rows if t}
    gone = {i for i, s in sets.items() if any(j < i and 10 * len(s & o) >= 8 * len(s | o) for j, o in sets.items())}
    assert set(kept) == set(sets) - gone and {300, 301, 305, 306} <= gone
    assert all(kept[i] == t for i, t, *_ in rows if i in kept)


def test_substring_stage(spark, docs, rows):
    out = {r.doc_id: r for r in corpus_pipeline.substrings(spark, docs, "").collect()}
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").split()
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        if any(gone):
            left = " ".join(x for x, g in zip(w, gone) if not g)
            assert (i not in out) if not left else (out[i].text, out[i].n_chars) == (left, len(left))
        else:
            assert out[i].text == t
    assert len(out[50].text.split()) == 40 and 300 not in out


def test_mixing_stage(spark, docs, rows):
    copies = {r.doc_id: r.copies for r in mixing.copies(docs).collect()}
    kept = Counter(r.doc_id for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert kept == Counter({i: c for i, c in copies.items() if c}) and max(copies.values()) <= 3


def test_packing_stage(spark, docs, rows):
    tool = token_store.Encoder(P.path("byte_bpe_50k.json"))
    out = corpus_pipeline.pack(spark, docs, "").collect()
    spans = Counter()
    for r in out:
        spans[r.doc_id] += r.n_tokens
    assert spans == Counter({i: len(tool.whole(t)) + 1 for i, t, *_ in rows if t})


def test_whole(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = common.stored(stage(spark, step, str(tmp_path)), "step")
        assert step.columns == docs.columns
    plain = lambda df: Counter(tuple(r) for r in df.select("doc_id", "part", "start", "n_tokens", "bucket_length", "padding").collect())
    found = plain(corpus_pipeline.run(spark, str(tmp_path)))
    assert found == plain(corpus_pipeline.pack(spark, step, str(tmp_path)))
    tokens, tool = Counter(), token_store.Encoder(P.path("byte_bpe_50k.json"))
    for r in step.collect():
        tokens[r.doc_id] += len(tool.whole(r.text)) + 1
    assert tokens == sum((Counter({k[0]: k[3] * n}) for k, n in found.items()), Counter())
    assert {302, 303, 304, 300, 301, 305, 306}.isdisjoint(tokens)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text here", None, "s", 14)], SCHEMA)
    assert corpus_pipeline.identify(spark, docs, "").count() == 0 and language_id.predictions(docs).first().lang_pred == "und"


def _kept(batches):
    """MB of freed memory that the worker of a task hasn't given back."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024

    for _ in batches:
        pass
    before = held()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    yield pa.RecordBatch.from_arrays([pa.array([before - held()])], names=["mb"])


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="memory can't be read here")
@pytest.mark.parametrize("stage", [substring_dedup.remove_substrings, lambda docs: token_store.token_counts(docs, P.path("byte_bpe_50k.json"))])
def test_workers_give_memory_back(spark, stage):
    """Stages share their workers: memory that a stage has freed must not stay with them."""
    texts = "transform(sequence(1, 700), i -> concat('w', pmod(xxhash64(id, i), 5000)))"
    docs = spark.range(0, 48_000, 1, 8).selectExpr("id as doc_id", f"array_join({texts}, ' ') as text", "'en' as lang", "'s' as source", "0L as n_chars")
    stage(docs).write.format("noop").mode("overwrite").save()
    kept = [r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(_kept, "mb double").collect()]
    assert max(kept) < 40, kept
