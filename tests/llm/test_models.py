"""PPM scoring, toxicity, byte-level BPE and packed files."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pairgauge.llm import bpe, packing, ppm, toxicity

PATH = P.path("byte_bpe_50k.tiktoken")


def test_ppm_is_exact(docs, nothing, rows):
    learn = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d, *_ in rows}
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    words, trie, k = collections.Counter(), collections.defaultdict(collections.Counter), ppm.ORDER
    for d, x in texts:
        if d is None or learn[d]:
            words.update([*x.lower().split(), b""])
            p = b"\xff" * k + x + b"\xff"
            for i in range(k, len(p)):
                trie[p[i - k : i]][p[i]] += 1
    for order in range(k - 1, -1, -1):
        for c in [c for c in trie if len(c) == order + 1]:
            for a in list(trie[c]):
                trie[c[1:]][a] += 1

    def code(x):
        p, out = b"\xff" * k + x + b"\xff", 0.0
        for i in range(k, len(p)):
            seen = set()
            for order in range(k, -1, -1):
                live = {a: n for a, n in trie.get(p[i - order : i], {}).items() if a not in seen}
                if p[i] in live:
                    out += math.log10((live[p[i]] - 0.5) / sum(live.values()))
                    break
                if live:
                    out += math.log10(0.5 * len(live) / sum(live.values()))
                    seen |= set(live)
            else:
                out -= math.log10(256 - len(seen))
        return out

    n, v = sum(words.values()), sum(c > 0 for c in words.values())
    got = sorted(ppm.score(docs, ~ppm.held_out(), block_bytes=5000).collect(), key=repr)
    want = []
    for d, x in texts:
        tokens = [*x.lower().split(), b""]
        want.append((d, not (d is None or learn[d]), len(tokens), sum(words[t] > 0 for t in tokens), n, sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens), code(x)))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, (w[:5] for w in want)))
    for i, near in ((5, 1e-9), (6, 1e-6)):
        assert np.allclose(sorted(r[i] for r in got), sorted(w[i] for w in want), rtol=near)
    assert ppm.score(nothing, ~ppm.held_out()).count() == 0
    blank = {(r.doc_id, len(x)): r.score for r, (_, x) in zip(ppm.score(docs.filter("doc_id < 3"), F.lit(False)).sort("doc_id").collect(), texts, strict=False)}
    assert np.allclose(list(blank.values()), [-(n + 1) * math.log10(256) for _, n in blank])


def test_ppm_pairs_of_a_block(monkeypatch):
    """Every byte and end with its context; pairs of training texts count, others are kept with 0."""
    monkeypatch.setattr(ppm, "MERGE_PAIRS", 50)
    texts = [b"", b"abcabcabc", "é é é".encode(), b"", b"ab" * 40, b"xabc"]
    want, pairs = collections.Counter(), ppm._Pairs()
    for learn in ([True, False, True, True, True, False], [False, True, False, False, False, False]):
        key, at = ppm._keys(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert at.tolist() == np.cumsum([0, *(len(t) + 1 for t in texts)]).tolist()
        each = []
        for t, train in zip(texts, learn, strict=True):
            padded = bytes([ppm.END] * ppm.ORDER) + t + bytes([ppm.END])
            each += [int.from_bytes(padded[i - 1 : i - 1 - ppm.ORDER : -1] if i > ppm.ORDER else padded[ppm.ORDER - 1 :: -1], "big") << 8 | padded[i] for i in range(ppm.ORDER, len(padded))]
            want.update(dict.fromkeys(each[-len(t) - 1 :], 0))
            for k in each[-len(t) - 1 :]:
                want[k] += train
        assert key.tolist() == each
        pairs.add(key, np.repeat(learn, np.diff(at)))
    key, n = pairs.merge()
    assert list(zip(key.tolist(), n.tolist(), strict=True)) == sorted(want.items())


def test_ppm_is_a_distribution():
    key = np.array([(65 << 40) + (66 << 32) + (67 << 24) + (68 << 16) + (69 << 8) + a for a in range(256)], np.int64)
    n = np.zeros(256, np.int64)
    n[[3, 7, 200]] = (5, 1, 2)
    two = np.array([(65 << 16) + (66 << 8) + a for a in (3, 7, 13, 200)], np.int64)
    two_n = np.array([1, 2, 3, 1], np.int64)
    one = np.zeros((256, 256), np.int64)
    one[65, [3, 7, 200, 9, 13]] = (2, 1, 1, 4, 1)
    one[1, 11] = 1
    zero = (one > 0).sum(axis=0)
    assert abs((10 ** ppm.code_lengths(key, n, two, two_n, one, zero)).sum() - 1) < 1e-9
    none = np.zeros(0, np.int64)
    assert np.allclose(10 ** ppm.code_lengths(key, 0 * n, none, none, 0 * one, 0 * zero), 1 / 256)
    assert ppm.code_length(b"abcabcabcabc") > ppm.code_length(b"abcxkqzujwpv")


def test_toxicity_learns_stems(spark, nothing):
    rnd = random.Random(2)
    plain = lambda n: [f"w{rnd.randrange(300)}{'abcde'[rnd.randrange(5)]}" for _ in range(n)]
    rows = []
    for i in range(500):
        ws = plain(rnd.randrange(20, 200))
        if i % 4 == 0:
            for _ in range(2):
                ws[rnd.randrange(len(ws))] = "bogwart" + rnd.choice(["", "y", "ing", "s", "ed"])
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("lang", "lang")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(500)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    of = model.scorer()
    assert of("you bogwartes") > 0.5 > of("w1a w2b") and 0 <= of("") < 0.5 and of(None) == of("")
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert none.scorer()("x") < 0.01


def test_toxicity_against_plain_python(spark, nothing):
    """Scores of whole texts are a logistic of the best window, worked out word by word; what else is in the table does not count."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(2, 7)))
    texts = [" ".join(("grumph" + rnd.choice(["", "el", "ing"]) if i % 3 == 0 and rnd.random() < 0.2 else word()) for _ in range(rnd.randrange(1, 60))) for i in range(120)]
    texts += [None, "", " \n ", "!!! ...", "Grumph!", " ".join(word() for _ in range(30_000)), texts[0], texts[0]]
    rows = [(i if i != 7 else None, t, 0.5, 9, "de") for i, t in enumerate(texts)] + [(5, texts[5], 0.1, 1, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic int, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(4, 1), (9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)

    def logit(text):
        ws = [w for w in (x.strip(toxicity._STRIP) for x in (text or "").lower().encode().split()) if w]
        if not ws:
            return model.bias
        k, best = min(model.window, len(ws)), -math.inf
        for i in range(len(ws) - k + 1):
            buckets = []
            for w in ws[i : i + k]:
                w = f"<{w.decode()}>"
                buckets += [zlib.crc32(g.encode()) % len(model.weight) for g in {w, *(w[a:b] for a in range(len(w)) for b in range(a + 3, min(a + 6, len(w)) + 1))}]
            best = max(best, sum(model.weight[b] for b in buckets) / len(buckets))
        return best + model.bias

    want = []
    for d, t, *_ in rows:
        s = 1 / (1 + math.exp(-min(40, max(-40, model.slope * logit(t) + model.shift))))
        want.append((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0, s, int(s >= 0.5)))
    got = sorted(map(tuple, toxicity.score(docs, model).collect()), key=repr)
    want.sort(key=repr)
    assert [(a, b) for a, b, *_ in got] == [(a, b) for a, b, *_ in want]
    assert np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want), atol=1e-9) and sum(g[3] for g in got) == sum(w[3] for w in want)
    assert toxicity.fit(docs, labels.filter("false")).scorer()("any text") < 1e-5
    assert toxicity.fit(nothing, labels).scorer()("any text") < 1e-5
    few = toxicity.fit(docs, labels, max_bytes=200)  # a bounded sample is still a model
    assert 0 <= few.scorer()(texts[0]) <= 1


def test_toxicity_on_held_out_documents(spark):
    """On the test tables: labels of a fold that the model has not seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    rows = [(r.toxic, r.predicted) for r in scored.collect()]
    clean, toxic = [p for t, p in rows if t == 0], [p for t, p in rows if t == 1]
    assert len(rows) > 50 and sum(clean) / len(clean) < 0.1 and sum(toxic) >= 0.7 * len(toxic)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, nothing, rows, library):
    got = sorted(map(tuple, bpe.encode_documents(docs, PATH, P.PATTERN).collect()), key=repr)
    want = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(nothing, PATH, P.PATTERN).count() == 0
    more = bpe.add_token_ids(docs, PATH, P.PATTERN)
    assert more.columns == [*docs.columns, "token_ids"] and more.count() == len(rows)
    e, rnd = bpe.encoder(PATH, P.PATTERN), random.Random(1)
    for _ in range(2000):
        x = "".join(rnd.choice("ab é\n\t'sre 12日\x1c.!, \r　\xa0\x85 ") for _ in range(rnd.randrange(40)))
        assert e.encode(x) == library.encode_ordinary(x), repr(x)


def test_prefix_table_edits():
    v, rnd = bpe.encoder(PATH, P.PATTERN).v, random.Random(4)
    for _ in range(200):
        x = bytes(rnd.choice(b"abcdeinorst \xc3\xa9") for _ in range(rnd.randrange(90)))
        t = bpe.PrefixTable(v, x[:30])
        t.append(x[30:])
        assert t.ids() == v.merged(x) and all(t.ids(k) == v.merged(x[:k]) for k in range(0, len(x), 17))
        a = rnd.randrange(len(x) + 1)
        b, new = min(len(x), a + rnd.randrange(6)), bytes(rnd.choice(b"tion e") for _ in range(rnd.randrange(5)))
        t.splice(a, b, new)
        assert t.last == bpe.PrefixTable(v, x[:a] + new + x[b:]).last
    t = bpe.PrefixTable(v, b"the nation and the station " * 60)
    assert t.splice(5, 6, b"N") < 400


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip(bits):
    rnd = np.random.default_rng(bits)
    ids = rnd.integers(0, 2**bits, 200_000).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    for start, n in ((0, 0), (0, 5), (777, 1000), (199_999, 1), (0, 200_000)):
        assert (packing.unpack(data, bits, start, n) == ids[start : start + n]).all()
    lengths = [70_000, 0, 130_000]
    f = packing.TokenFile(packing.build([4, 5, 6], ids, lengths, bits))
    assert (f.document(0) == ids[:70_000]).all() and len(f.document(1)) == 0 and (f.document(2) == ids[70_000:]).all()
    assert packing.bits_for(49408) == 16 and packing.bits_for(2) == 1 and packing.bits_for(50257) == 16


def test_token_files(docs, nothing, rows, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    files = packing.write(docs, path, end_id=2, partitions=3)
    got = sorted(map(tuple, packing.read(files).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert packing.read(packing.write(nothing, path)).count() == 0
    packing.export(files, f"file://{tmp_path}")
    assert sum(packing.TokenFile(p.read_bytes()).n_docs for p in tmp_path.glob("*.tok")) == len(rows)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_encoder_equals_the_library(name):
    """Case mappings that join marks to punctuation, white space beyond ASCII, added tokens; a cased file that keeps white space."""
    from tokenizers import Tokenizer

    path, rnd = P.path(name), random.Random(3)
    lib, (_, encode) = Tokenizer.from_file(path), packing.encoder(path)
    signs = "aAbBzéÉßİıŁłŒœŸǅſKΣςº²½Ⅷ日🙂̸́̇<=>|'s't're'll.,!?;: \t\n\x0b\x1c\x85\xa0　​09_-"
    cases = ["aİ!", "a<|endoftext|>b <|endoftext|>", "", "I'LL go,'s", "x" * 300 + " y"]
    cases += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    cases += ["".join(chr(rnd.randrange(1, 0x180 if i % 2 else 0xD800)) for _ in range(rnd.randrange(30))) for i in range(4000)]
    for x in cases:
        assert np.frombuffer(encode(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, repr(x)


def test_long_texts_are_encoded_in_runs(monkeypatch):
    path = P.path("word_bpe_49k.json")
    _, encode = packing.encoder(path)
    x = "It's a long text, of 12 words or so; été " * 50
    whole = encode(x)
    monkeypatch.setattr(packing, "RUN_CHARS", 17)
    assert encode(x) == whole
    monkeypatch.setattr(packing, "STORE", 3)
    assert packing._Kept(lambda p: [len(p)])["abc"] == b"\3\0\0\0" and encode(x) == whole


def test_token_files_of_another_tokenizer(docs, rows):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in packing.read(packing.write(docs, path, end_id=None, partitions=2)).collect()), key=repr)
    ids = [(d, np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4")) for d, t, *_ in rows]
    assert got == sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids), key=repr)
