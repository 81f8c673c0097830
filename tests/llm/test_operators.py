"""Each operator against brute force on a fixture with nulls, empty, long and repeated texts, ties, and an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, components, fingerprints, jaccard_join, language_id, mixing, ogg, packing, substring_dedup, token_store, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, kind="abcdefgh"):
    draw = random.Random(seed)
    return ["".join(draw.choices(kind, k=draw.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base, passage = words(120, 1), words(60, 2)
    near = base[:40] + ["changed"] + base[41:]
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", "\t \n", "one two", "one two", "é ß x"]
    texts += [" ".join(words(30, s) + passage + words(10, s + 50)) for s in (3, 4, 5)]
    texts += [" ".join(words(9000, 6)), " ".join(["same"] * 130), "a  b\n\nc\td ", "Don't $top!! it's 50% off.\nNew line, here."]
    return [(i * 7 % 101, t, None if i == 3 else ("en", "de")[i % 2], None if i % 5 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, empty, rows):
    found = {r[0]: tuple(r)[1:] for r in substring_dedup.substring_digest(docs).collect()}
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert found[i] == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert substring_dedup.substring_digest(empty).count() == 0
    assert substring_dedup.remove_substrings(docs).columns == docs.columns


def test_jaccard_join(docs, empty, rows):
    found = {r.doc_id: r for r in jaccard_join.similarity_classes(docs).collect()}
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := split(t)) else frozenset() for i, t, *_ in rows}
    distinct = set(sets.values())
    like = lambda a, b: bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)
    for i, s in sets.items():
        assert found[i].n_links == sum(like(s, o) for o in distinct if o != s)
        assert found[i].n_copies == sum(o == s for o in sets.values())
        group, todo = {s}, [s]
        while todo:
            a = todo.pop()
            new = {o for o in distinct if like(a, o)} - group
            group |= new
            todo += new
        assert found[i].class_id == min(k for k, o in sets.items() if o in group)
    assert jaccard_join.similarity_classes(empty).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.class_id for r in found.values()}


def test_jaccard_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 50)  # some clusters have blocks without members
    texts = []
    for k in range(16):
        base = words(100, 300 + k)
        texts += [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(0, 10 * (2 + k % 3), 10)]
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0])]
    found = {r.doc_id: r.n_links for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    assert found == {i: sum(10 * len(a & b) >= 8 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}


def test_one_of_each_keeps_documents_without_id(spark):
    base, own = words(120, 1), words(100, 2)
    near = [*base[:40], "changed", *base[41:]]
    other = [*own[:40], "changed", *own[41:]]
    rows = [(5, base), (None, near), (None, own), (None, other), (None, own), (None, words(80, 3)), (7, words(80, 4)), (None, words(80, 5))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = [(r.doc_id, r.text.split()) for r in jaccard_join.one_of_each(docs).collect()]
    assert len(kept) == 5 and sum(x in kept for x in [rows[2], rows[3]]) == 1
    assert all(x in kept for x in [rows[0], *rows[5:]])


def test_forest_depth_meets_recall():
    d = jaccard_join.forest_depth()
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES


def test_fill():
    assert mixing.fill([10, 10, 10], [5, 2, 1], 30) == [18.75, 7.5, 3.75]
    shares = mixing.fill([1, 100], [5, 1], 101)
    assert shares == [3, 98]


def test_pivot_keeps_mass_and_expectation():
    size, part = np.array([5.0, 3.0, 2.0, 1.0, 4.0]), np.array([0.2, 0.7, 0.5, 0.9, 0.4])
    outs = []
    for seed in range(4000):
        x, held = mixing.pivot(size, part, np.random.default_rng(seed).random(5))
        assert abs((x * size).sum() - (part * size).sum()) < 1e-6
        assert all(v in (0, 1) for k, v in enumerate(x) if k != held)
        outs.append(x)
    assert np.abs(np.mean(outs, axis=0) - part).max() < 0.04


def test_mixture(docs, empty, rows):
    a, b = (sorted(map(tuple, mixing.mixture(d).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == len(rows)
    sizes = {i: len(split(t)) for i, t, *_ in rows}
    for doc_id, size, _, _, taken, copies, _ in a:
        assert size == sizes[doc_id] and taken == size * copies and 0 <= copies <= 3
    assert mixing.mixture(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_token_store(spark, docs, empty, rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tool, start = Tokenizer.from_file(path), 0
    found = {r.doc_id: tuple(r)[1:] for r in token_store.token_digest(docs, path).collect()}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        assert found[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_digest(empty, path).count() == 0


def test_encoder_cuts_as_the_library_does():
    P = pytest.importorskip("public_tokenizers")
    tool, draw = token_store.Encoder(P.path("byte_bpe_50k.json")), random.Random(9)
    kinds = ["a", "B", "ß", "é", "Ñ", "ª", "ǆ", "ɏ", "ɐ", "ж", "中", "́", "7", "²", "'s", "'", ".", "!", "-", " ", " ", "\n", "\t", "\xa0", "\xad", "<|endoftext|>"]
    for n in range(6000):
        text = "".join(draw.choices(kinds[: draw.choice((6, 14, 22, 26))], k=draw.randint(0, 12)))
        assert tool.encode_all([text])[0].tolist() == [*tool.whole(text), 2], text


def test_packing(docs, empty):
    lengths, counts = [1, 2, 5, 9], [4, 1, 3, 2]

    def padding(edges):
        return sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts))

    best = min(padding({a, b, 9}) for a in lengths for b in lengths)
    assert padding(packing.bounds(lengths, counts, 3)) == best
    out = packing.pack(docs, context=64, buckets=3, budget=256).collect()
    assert len({(r.bucket, r.batch, r.slot) for r in out}) == len(out)
    for (_, _), g in {(r.bucket, r.batch): [x for x in out if (x.bucket, x.batch) == (r.bucket, r.batch)] for r in out}.items():
        assert len(g) * g[0].bucket_length <= 256 and all(r.padding == r.bucket_length - r.n_tokens >= 0 for r in g)
    assert packing.pack(empty).count() == 0


def test_packing_of_tokens(spark, docs, empty, rows, tmp_path):
    """Every token of every document stands in one place; only a bucket's last batch is short; padding is the least there is."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    tool = token_store.Encoder(path)
    packed = packing.pack(docs, path, context=32, buckets=3, budget=128)
    token_store.write_tokens(docs, str(tmp_path / "t"), path, 2)
    out = packing.batch_tokens(packed, token_store.read_tokens(spark, str(tmp_path / "t"))).collect()
    for i, t, *_ in rows:
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ([*tool.whole(t).tolist(), 2] if t else []) and [r.start for r in own] == [32 * k for k in range(len(own))]
    edges = sorted({r.bucket_length for r in out})
    lengths = Counter(r.n_tokens for r in out)
    import itertools

    pad = lambda e: sum(n * (min(x for x in e if x >= k) - k) for k, n in lengths.items())
    assert sum(r.padding for r in out) == pad(edges) == min(pad([*e, max(lengths)]) for e in itertools.combinations(sorted(lengths), 2))
    for b in {r.bucket for r in out}:
        sizes = Counter(r.batch for r in out if r.bucket == b)
        per = max(1, 128 // next(r.bucket_length for r in out if r.bucket == b))
        assert [sizes[k] for k in sorted(sizes)][:-1] == [per] * (len(sizes) - 1) and sorted(sizes) == list(range(len(sizes))) and sizes[max(sizes)] <= per
    assert packing.pack(empty, path).count() == 0


def test_ogg(docs, empty, rows):
    found = {r.doc_id: r for r in ogg.media_digest(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert ogg.media_digest(empty).count() == 0

    def slow(data):
        x = 0
        for b in data:
            x ^= b << 24
            for _ in range(8):
                x = ((x << 1) ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        return x

    data = ogg.encode(ogg.payload_of("x" * 200_000)[1])
    assert ogg.crc(data[:500]) == slow(data[:500])
    assert ogg.decode(data)[0] == ogg.payload_of("x" * 200_000)[1]
    with pytest.raises(ValueError):
        ogg.decode(data[:900] + b"?" + data[901:])


def test_language_id(spark):
    pairs = [(i, " ".join(words(40, i, "aeioth" if i % 2 else "uzkßöv")), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    docs = spark.createDataFrame([*pairs, (900, None, "en", "s", 0), (901, "12 .,", "de", "s", 0)], SCHEMA)
    found = {r.doc_id: r for r in language_id.predictions(docs).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in pairs)
    assert found[900].lang_pred == found[901].lang_pred == "und"
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    assert language_id.predictions(docs.where("doc_id < 0")).count() == 0


def test_backpropagation_matches_differences():
    model = language_id.Network(["a", "b"])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    codes, mask = language_id._padded([b"abc", b"zz"])
    label = np.array([0, 1])

    def loss():
        p, _ = model.forward(codes)
        return -(np.log(p[:, np.arange(2), label]) * mask / mask.sum()).sum()

    grads = model.gradients(codes, mask, label)
    for k in model.w:
        at = np.unravel_index(int(np.abs(grads[k]).argmax()), model.w[k].shape)
        model.w[k][at] += 1e-4
        up = loss()
        model.w[k][at] -= 2e-4
        down = loss()
        model.w[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-3


def test_fingerprints(docs, empty, rows):
    found = {r.doc_id: r for r in fingerprints.fingerprint_digest(docs).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edit = fingerprints.edited(t, after)
        a, b, c = (Counter(split(x)) for x in (t, edit, after))
        true = lambda x, y: sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert abs(r.near_edited - true(a, b)) < 0.25 and abs(r.near_next - true(a, c)) < 0.25
    assert len({found[i].fingerprint for i, t, *_ in rows if t == rows[0][1]}) == 1
    assert fingerprints.fingerprint_digest(empty).count() == 0


def test_toxicity(spark):
    texts = [(i, " ".join(words(20, i, "lmnoprst")) + (" nasty vile" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame([*texts, (500, None), (501, "so n4sty and v1le"), (502, "n a s t y vvvvile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert all(found[i].predicted == int(i % 3 == 0) for i in range(120))
    assert found[500].predicted == 0 and found[501].predicted == found[502].predicted == 1
    assert toxicity.scores(docs.where("doc_id < 0"), labels).count() == 0
    assert toxicity.scores(docs, labels.where("doc_id < 0")).where("score > 0").count() == 0


def test_toxicity_by_tokens_as_by_words():
    cost = np.random.default_rng(3).random((toxicity.SIGNS,) * 3)
    parts = ["nasty", "n4sty", "na$ty!", "n", "a", "s", "t", "y", "5", "!", "vile", "VILEST", "vvvvile", "x", "ß", "plain", "pl--ain", "12"]
    scorer, slow, fast = toxicity.Scorer({"nasty": 1.5, "vile": 0.7, "vile*": 0.2, "x": -0.4}, -2.0), toxicity.Restorer(cost), toxicity.Restorer(cost)
    draw = random.Random(4)
    for text in [None, "", " ", *(" ".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(400))]:
        assert scorer.told_by(fast, text) == scorer.told(slow.words(text))


def test_toxicity_of_words_set_apart():
    tool = toxicity.Restorer(np.ones((toxicity.SIGNS,) * 3))  # splitting a row costs more than not splitting it
    for text in ("you i d i o t. Other", 'an "i d i o t" here', "some (i d i o t) here", "other i . d . i . o . t here", "other i. d. i. o. t. here", "other i - d - i - o - t here", "id iot", "so i di ot, they", "a id i0t here", "I D I O T!"):
        assert "idiot" in tool.words(text), text
    assert "kill" in tool.words("they k i ll them") and "ofthe" not in tool.words("of these the")
    plain = tool.words("other words here, and there")
    assert plain == Counter(["other", "words", "here", "and", "there"])


def test_toxicity_of_signs_at_the_end():
    cost = np.full((toxicity.SIGNS,) * 3, 9.0)
    for word in ("a", "ass", "idiot", "stupid", "piss", "great"):
        at = [0, 0, *map(toxicity.sign_of, word), 0]
        for a, b, c in zip(at, at[1:], at[2:], strict=False):
            cost[a, b, c] = 1.0
    tool = toxicity.Restorer(cost)
    for text, word in {"a$$": "ass", "idio+": "idiot", "idio+.": "idiot", "pi$$,": "piss", "455": "ass", "4$$": "ass", "id io+": "idiot"}.items():
        assert word in tool.words(text), text
    assert tool.words("a$$")["a"] == 1
    assert tool.words("stupid$$$") == tool.words("stupid!!") == tool.words("stupid") and tool.words("great!") == Counter(["great"])
    assert not tool.words("$$$ !! 3. 2024 | 108.51")


def test_url_rules(spark):
    urls = [None, "no scheme", "http://COM/en/", "https://a.example.com/en/7x?q=1", "http://example.com/EN/7", "http://x.net?de", "http://b.example.net/de/8#f", "http://notcom/en/", "http://s.es.org/es/1", "http://com"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, labels).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(t, v) for v, t in url_filter.RULES if (host == (h := t.split("/")[0]) or host.endswith("." + h)) and path.startswith(t[len(h) :])]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert out[i] == (host, path, rule, verdict)


def test_url_rules_say_what_the_contract_says(spark):
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://w.example.net/de/80": ("example.net/de/8", "block"), "http://a.org/es/2": ("org/es/", "block"), "http://a.org/de/2": (None, "allow")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = url_filter.judged(pages, spark.createDataFrame([], "page_id long, bad boolean")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in out] == list(urls.values())


def test_url_mining(spark):
    rows = [(i, f"http://h{i % 7}.test/{'spam' if i % 4 == 0 else 'page'}/{i}", "") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(300)], "page_id long, bad boolean")
    out = url_filter.judged(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in out)


def test_least_hashed(spark):
    rows = spark.range(0, 5000, 1, 7).toDF("doc_id")
    every = [r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for n in (1, 40, 3000, 6000):
        assert [r[0] for r in common.least_hashed(rows, "doc_id", n).collect()] == every[:n]
    assert common.least_hashed(rows.where("doc_id < 0"), "doc_id", 5).count() == 0


def test_jaccard_join_with_repeated_ids(spark):
    """Rows of one doc_id with different texts are sets of their own; a null id counts but names no class."""
    a, b, c = words(100, 1), words(100, 2), words(100, 3)
    near = lambda w: [*w[:50], "changed", *w[51:]]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (1, a), (None, c), (None, near(c)), (None, words(90, 9))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = sorted(((r.doc_id or 0), r.class_id, r.n_links, r.n_copies) for r in jaccard_join.similarity_classes(docs).collect())
    assert found == [(0, None, 0, 1), (0, None, 1, 1), (0, None, 1, 1), (1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 1), (3, 1, 1, 1)]


def test_forest_reads_on_while_links_are_missed(spark):
    """Links near the threshold need shorter prefixes; the found ones tell so. Pairs built at 0.8 are all found."""
    rows = []
    for k in range(60):
        base = words(94, 700 + k)  # 90 shingles; a changed last word and each further one cost one of them
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-10], *words(10, 900 + k)]))]
    found = {r.doc_id: r for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    true = {i: sum(10 * len(s & o) >= 8 * len(s | o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    assert {i: r.n_links for i, r in found.items()} == true and sum(true.values()) == 120


def test_components_raise_when_unfinished(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert components.components(chain).where("root <> 0").count() == 0
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(words(60, 1))
    names = {"_keep": 1, "_key": 2, "key": 3, "keep": 4, "_id": 5, "_copy": 6, "_copies": 7, "cuts": 8, "_cut_id": 9, "_lang_pred": "x", "_lang_score": 0.5, "id": 10, "h1": 11, "th": 12, "n": 13}
    rows = [(i, text if i < 2 else " ".join(words(70, i)), "en", "s", len(text), *names.values()) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for stage in (language_id.accepted, jaccard_join.one_of_each, substring_dedup.remove_substrings, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert {n: r[n] for n in names} == names


def test_ogg_cut_short():
    data = ogg.encode(ogg.payload_of("y" * 400_000)[1])
    places = [i for i in range(len(data) - 3) if data[i : i + 4] == b"OggS"]
    assert len(places) > 6
    for cut in places[-4:]:
        with pytest.raises(ValueError):
            ogg.decode(data[:cut])
    with pytest.raises(ValueError):
        ogg.decode(data + data[places[-1] :])


def test_mixture_of_many_sources_and_totals(spark):
    """Each source's words come within a document of its target, whose shares are those of the plain loop."""
    draw = random.Random(5)
    rows = [(i, " ".join(["w"] * draw.randint(0, 40)), f"s{draw.choice([0, 0, 0, *range(1, 30)]):02d}" if i % 50 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mixture(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.fill([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], sum(sizes.values())), strict=True))
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in order) and abs(sum(taken.values()) - sum(sizes.values())) <= 40 * len(order)


def test_mixed_rows_of_one_id(spark):
    rows = [(1, "a b", "s"), (1, "c d e", "s"), (None, "f g", "s"), (None, "h", "s"), (2, "a b", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter((r.doc_id, r.size, r.copies) for r in mixing.mixture(docs).collect())
    kept = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    for i, t, _ in rows:
        n = len(t.split())
        assert kept[i, t] in {c for j, size, c in taken if (j, size) == (i, n)}


def test_token_store_of_repeated_ids(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = [(7, "c c"), (7, "b b b b"), (7, "a"), (None, "x"), (None, "y y"), (3, "z"), (7, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = token_store.token_digest(docs, path).orderBy("start").collect()
    tool = token_store.Encoder(path)
    crc = lambda t: zlib.crc32(np.append(tool.whole(t), 2).astype("<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in out) == Counter((i, crc(t)) for i, t in rows)
    upto = 0
    for r in out:  # starts follow each other, ids ascend, null first
        assert r.start == upto
        upto += r.n_tokens
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_can_be_read_in_part(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import glob

    import pyarrow.parquet as pq

    path, folder = P.path("byte_bpe_50k.json"), str(tmp_path / "t")
    rows = [(i, " ".join(words(400, i, "abcdefghijklmnop"))) for i in range(400)]
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, path, files=2, row_group=1 << 16, page=1 << 12)
    files = sorted(glob.glob(f"{folder}/*.parquet"))
    kinds, groups = set(), 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.row_group(g).num_columns):
                column = meta.row_group(g).column(c)
                kinds |= set(column.encodings)
                assert column.has_offset_index and column.has_column_index and column.compression == "ZSTD"
    assert len(files) == 2 and groups > 4 and "DELTA_BINARY_PACKED" in kinds and kinds & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}
    tool = token_store.Encoder(path)
    some = {r.doc_id: r.ids for r in token_store.read_some(spark, folder, [3, 250]).collect()}
    assert some == {i: [*tool.whole(rows[i][1]).tolist(), 2] for i in (3, 250)}
    plan = token_store.read_some(spark, folder, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan
    lengths = token_store.read_lengths(spark, folder)
    assert "ids" not in lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert lengths.agg(F.sum("n_tokens")).first()[0] == sum(len(tool.whole(t)) + 1 for _, t in rows)


def test_long_texts_of_tokens():
    P = pytest.importorskip("public_tokenizers")
    tool = token_store.Encoder(P.path("byte_bpe_50k.json"))
    word = words(300, 1, "abcdefghé")
    text = " ".join(word * 2500)
    flat, count = tool.encode_all([text, "", f"  {text[:5000]}", "a"])
    assert len(text) > 2 * token_store.BLOCK / 2 and count[1] == 1
    first, again = tool.whole(" ".join(word)), tool.whole(" " + " ".join(word))
    assert flat[: count[0] - 1].tolist() == first.tolist() + again.tolist() * 2499
    assert flat[count[0] + 1 :][: count[2] - 1].tolist() == tool.whole(f"  {text[:5000]}").tolist()


def test_languages_of_few_documents(spark):
    """Every language with a label is learned, however rare; words longer than a segment are cut between letters."""
    kinds = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu", "dd": "жзийклм"}
    rows = [(i, " ".join(words(25, i, kinds[k])), k) for i, k in enumerate(["aa"] * 900 + ["bb"] * 900 + ["cc"] * 12 + ["dd"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs)
    assert {k for _, k in sample} == set(kinds) and len(sample) <= language_id.SAMPLE
    assert language_id.labelled_sample(docs.repartition(5)) == sample
    found = language_id.predictions(docs).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in found) > 0.97 * len(rows)
    long = "ж" * 500 + "x" * 100
    parts = language_id.segments(f"a {long} 12 b")
    assert b"".join(parts).decode() == f"a{long}b" and all(p.decode() and len(p) <= language_id.SEGMENT for p in parts)


def test_network_reads_both_ways_and_pools_all_positions():
    """A segment's sum against a plain loop over gates, positions and both directions."""
    model = language_id.Network(["a", "b", "c"])
    w = {k: v.astype(float) for k, v in model.w.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    for word in (b"x", b"hello", "жa".encode()):
        seq = [0, *word, 0]
        states = []
        for side, order in (("f", seq), ("b", seq[::-1])):
            h, out = np.zeros(language_id.HIDDEN), []
            for c in order:
                g = w["emb"][c] @ w[f"{side}x"] + w[f"{side}b"]
                n = language_id.HIDDEN
                z, r = sig(g[:n] + h @ w[f"{side}h"][:, :n]), sig(g[n : 2 * n] + h @ w[f"{side}h"][:, n : 2 * n])
                h = (1 - z) * h + z * np.tanh(g[2 * n :] + (r * h) @ w[f"{side}h"][:, 2 * n :])
                out.append(h)
            states.append(out if side == "f" else out[::-1])
        total = np.zeros(3)
        for t in range(1, len(seq)):
            e = np.exp(np.concatenate([states[0][t], states[1][t]]) @ w["out"] + w["out_b"])
            total += e / e.sum()
        assert np.allclose(model.sums([word])[0], total, atol=1e-4)


def brute_decode(symbols, model, spaced=False, tail=0):
    """Every choice for every sign, and its cost."""
    import itertools

    T = toxicity
    runs = [len(list(g)) for _, g in itertools.groupby(symbols)]
    long = [n > 2 for n in runs for _ in range(n)]
    options = []
    for i, s in enumerate(symbols):
        own = [(s, 0.0)] if s.isalpha() else [(c, T._SIGN_COST) for c in T.MIMICS.get(s, "")] + [("", T._DROP_SIGN if s in T.MIMICS else 0.5)]
        if i >= len(symbols) - tail and (long[i] or s in "!|(<"):
            own.append(("", T._DROP_JUNK if long[i] else T._DROP_MARK))
        if i and symbols[i - 1] == s:
            own.append(("", T._DROP_REPEAT if long[i] else T._DROP_DOUBLE))
        options.append(own)
    best = None
    for choice in itertools.product(*options):
        text, price = [c for c, _ in choice if c], sum(p for _, p in choice)
        for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)) if spaced else [(0,) * max(0, len(text) - 1)]:
            cost, a, b, said = price, 0, 0, ""
            for k, c in enumerate(text):
                if k and cuts[k - 1]:
                    cost += T._SPLIT + model[a][b][0]
                    a, b, said = 0, 0, said + " "
                q = T.sign_of(c)
                cost, a, b, said = cost + model[a][b][q], b, q, said + c
            cost += model[a][b][0] if b else 0.0
            if best is None or cost < best[0] - 1e-12:
                best = (cost, said)
    return best


def test_viterbi_against_all_paths():
    draw = random.Random(8)
    for n in range(150):
        model = np.random.default_rng(n).random((toxicity.SIGNS,) * 3) * 4
        symbols = "".join(draw.choices("abs$51!|-aa", k=draw.randint(1, 6)))
        spaced, tail = draw.random() < 0.5, draw.randint(0, 2)
        cost, _ = brute_decode(symbols, model, spaced, tail)
        said = toxicity.decode(symbols, model.tolist(), spaced, tail)
        # the decoder's words cost what the best path costs: rebuild the least cost among paths that say them
        again = brute_decode_of(symbols, model, spaced, tail, " ".join(said))
        assert abs(again - cost) < 1e-9, (symbols, spaced, tail, said)


def brute_decode_of(symbols, model, spaced, tail, said):
    import itertools

    T = toxicity
    runs = [len(list(g)) for _, g in itertools.groupby(symbols)]
    long = [n > 2 for n in runs for _ in range(n)]
    letters, words_ = said.replace(" ", ""), said.split()
    least = {0: 0.0}  # letters said so far
    for i, s in enumerate(symbols):
        own = {s: 0.0} if s.isalpha() else dict.fromkeys(T.MIMICS.get(s, ""), T._SIGN_COST)
        drop = [] if s.isalpha() else [T._DROP_SIGN if s in T.MIMICS else 0.5]
        if i >= len(symbols) - tail and (long[i] or s in "!|(<"):
            drop.append(T._DROP_JUNK if long[i] else T._DROP_MARK)
        if i and symbols[i - 1] == s:
            drop.append(T._DROP_REPEAT if long[i] else T._DROP_DOUBLE)
        new = {}
        for k, c in least.items():
            if k < len(letters) and letters[k] in own:
                new[k + 1] = min(new.get(k + 1, 9e9), c + own[letters[k]])
            for p in drop:
                new[k] = min(new.get(k, 9e9), c + p)
        least = new
    cost = least[len(letters)]
    for j, word in enumerate(words_):
        a = b = 0
        for c in word:
            cost, a, b = cost + model[a][b][T.sign_of(c)], b, T.sign_of(c)
        cost += model[a][b][0] + (T._SPLIT if j < len(words_) - 1 else 0)
    return cost


def test_long_texts_of_other_operators(spark):
    """Texts of a megabyte, and one token of fifty thousand signs."""
    text = " ".join(words(500, 3) * 400)
    rows = [(1, text, "en", "s", 0), (2, "4$" * 25_000, "en", "s", 0), (3, text + " x", "de", "s", 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert language_id.predictions(docs).count() == toxicity.scores(docs, labels).count() == mixing.mixture(docs).count() == 4
    found = {r.doc_id: r for r in fingerprints.fingerprint_digest(docs).collect()}
    assert found[1].n_chars == len(text) and found[2].near_next < 0.1
    out = packing.pack(docs, context=2048).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert sorted(map(tuple, out)) == [(1, 200_000), (2, 1), (3, 200_001)]


def test_fingerprints_estimate_closely(spark):
    """Over many pairs the mean error is near 0 and the spread that of 128 samples; rows of one doc_id follow each other in any dealing."""
    draw, errors, spread = random.Random(4), [], []
    for n in range(120):
        bag = words(draw.choice([5, 40, 300]), 5000 + n)
        bag += [w for w in bag if draw.random() < 0.3] * draw.randint(0, 3)
        other = [w for w in bag if draw.random() < 0.7] + words(len(bag) // 4, 9000 + n)
        a, b = Counter(bag), Counter(other)
        true = sum((a & b).values()) / sum((a | b).values())
        x, y = fingerprints.fingerprint([" ".join(bag), " ".join(other)])
        errors.append(fingerprints.likeness(x, y) - true)
        spread.append(true * (1 - true) / fingerprints.SAMPLES)
    assert abs(np.mean(errors)) < 0.012 and np.mean(np.square(errors)) < 1.5 * np.mean(spread)
    rows = [(None if i % 3 else i, f"text {i} of {i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (Counter((r.doc_id, r.n_chars, r.fingerprint, r.edited_sha256) for r in fingerprints.fingerprint_digest(d).collect()) for d in (docs, docs.repartition(6)))
    assert one == two and sum(one.values()) == 200


def brute_rules(rows, length):
    """Rules by counting every set of tokens: Apriori without its shortcuts."""
    import itertools

    n, bad = len(rows), sum(b for _, b in rows)
    least = max(-(-url_filter.SUPPORT * bad // 1), url_filter.LEAST_ROWS)
    counts = Counter()
    for items, b in rows:
        for k in range(1, length + 1):
            for c in itertools.combinations(sorted(set(items)), k):
                counts[c, 0] += 1
                counts[c, 1] += b
    rules = {}
    for (c, kind), hits in counts.items():
        if kind and hits >= least:
            shown = counts[c, 0]
            p, z = hits / shown, 1.96
            lower = (p + z * z / (2 * shown) - z * (p * (1 - p) / shown + z * z / (4 * shown * shown)) ** 0.5) / (1 + z * z / shown)
            if lower >= url_filter.CONFIDENCE and p >= (1 + url_filter.LIFT) * bad / n:
                rules[c] = p
    return {c: p for c, p in rules.items() if not any(q in rules and rules[q] >= p for k in range(1, len(c)) for q in itertools.combinations(c, k))}


@pytest.mark.parametrize("wide", [0, 30])
def test_mined_rules_against_counting(spark, wide):
    draw = random.Random(3)
    rows = []
    for _ in range(1500):
        items = draw.sample([f"t{k}" for k in range(9)], draw.randint(1, 5))
        risk = 0.9 if {"t1", "t2"} <= set(items) else 0.8 if "t3" in items and "t4" not in items else 0.95 if {"t4", "t5", "t6"} <= set(items) else 0.1
        rows.append((items, draw.random() < risk))
    found = url_filter.mine(spark.createDataFrame(rows, "items array<string>, bad boolean"), wide=wide).collect()
    want = brute_rules(rows, url_filter.LENGTH)
    assert len(want) >= 3 and max(map(len, want)) > 1
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in found} == {c: round(p, 9) for c, p in want.items()}
    freq = Counter(t for items, _ in rows for t in set(items))
    assert all(r.key == min(r.antecedent, key=lambda t: (freq[t], t)) for r in found)


def test_mined_rules_decide_pages(spark):
    """Documents' labels reach pages through the number in the path; pages that no fixed rule covers are judged by what was mined."""
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(3000):
        spam = i % 3 == 0
        kind = "win" if spam else draw.choice(["news", "blog"])
        rows.append((i, f"http://{'promo' if spam and i % 2 else 'www'}.site{i % 40}.test/{kind}/{100_000 + i}.html?ref=x", ""))
        labels.append((100_000 + i, spam if draw.random() < 0.95 else not spam))
    pages = spark.createDataFrame([*rows, (9000, "http://x.com/en/100000", ""), (9001, "http://a.test/win/no", ""), (9002, None, "")], "page_id long, url string, html string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, bad boolean")
    shown = url_filter.shown_labels(pages, marks)
    assert shown.where("page_id < 9000").count() == len([x for x in labels if x[0] % 5])
    out = {r.page_id: r for r in url_filter.judged(pages, shown).collect()}
    assert all((out[i].verdict == "block") == (i % 3 == 0) and out[i].rule is None for i in range(3000))
    assert "path0=win" in out[0].matched and out[9000].rule == "com/en/" and out[9001].verdict == "block" and out[9002].verdict == "allow"


def test_forty_shared_tokens(spark):
    names = "&".join(f"q{k}=1" for k in range(40))
    rows = [(i, f"http://h.test/a/{i}?{names}" if i % 2 else f"http://h.test/b/{i}", "") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(60)], "page_id long, bad boolean")
    out = url_filter.judged(pages, labels).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in out)


def test_plain_words_cost_few_calls():
    """Words in plain letters whose beginnings no feature has are neither decoded nor looked up piece by piece; what a text tells stays the same."""
    import sys

    cost = np.random.default_rng(5).random((toxicity.SIGNS,) * 3)
    scorer, slow, fast = toxicity.Scorer({"nasty": 1.5, "vile*": 0.2, "nas": 0.4, "idio*": 0.7}, -2.0), toxicity.Restorer(cost), toxicity.Restorer(cost)
    odd = ["nasty!", "NASTY,", "n4sty", "nas", "naaasty", "vilest", "vil3st", "id", "iots.", "i", "d", "i", "o", "t", "$$$", "plain*", "(vile", "idio+", "idiom"]
    plain = [f"{w}ost" + (".", "", ",")[i % 3] for i, w in enumerate(dict.fromkeys(words(6000, 11, "bcdefgh"))) if not re.search(r"(.)\1\1", w)]
    for text in (None, "", *(" ".join(odd[k:] + plain[:50] + odd[:k]) for k in range(len(odd)))):
        assert scorer.told_by(fast, text) == scorer.told(slow.words(text))
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        scorer.told_by(toxicity.Restorer(cost), " ".join(plain))
    finally:
        sys.setprofile(None)
    assert len(plain) > 3000
    assert calls["call"] + calls["c_call"] < 25 * len(plain)


def test_equal_pieces_are_met_without_arrays_by_character(monkeypatch):
    """Texts are encoded like the library's, whatever generation holds their pieces; finding equal ones takes no arrays of many bytes for each character."""
    P = pytest.importorskip("public_tokenizers")
    import tracemalloc

    path = P.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_store, "CACHE", 60)
    tool = token_store.Encoder(path)
    texts = [" ".join(w + ("", ".", "é", "7")[i % 4] for i, w in enumerate(words(50, s % 7))) for s in range(12)]
    texts += ["", " x", "a\nb\nc", "w" * 100 + " " + "w" * 100, "no  shortcut", "ß, 12 345!", texts[0]]
    for some in (texts, texts[::-1], texts[3:5], [""]):
        ids, count = tool.encode_all(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [[*tool.whole(t).tolist(), token_store.END] for t in some]
    monkeypatch.setattr(token_store, "CACHE", 500_000)
    text, tool = " ".join(words(300, 2) * 1000), token_store.Encoder(path)
    tool.joined([text])
    tracemalloc.start()
    tool.joined([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)
