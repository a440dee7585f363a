"""The corpus pipeline against plain Python, and its edge cases."""

import base64
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_groups import _components
from test_native import SPACE, _near

from pairgauge.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LAST = 2**63


def _kept(text):
    """The quality rules, read off their table."""
    t = text or ""
    ws = [w for w in SPACE.split(t) if w]
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = {}
    for w in wins:
        seen[w] = seen.get(w, 0) + 1
    ls = [x for x in t.split("\n") if SPACE.sub("", x)]
    m = {
        "n_words": len(ws),
        "word_chars": len(SPACE.sub("", t)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_repeat_words": len({i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(3)}),
        "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in ws),
        "n_lines": len(ls),
        "n_dup_lines": len(ls) - len(set(ls)),
    }
    for r in (*quality.BASE, *quality.RULES):
        value, unit = m[r.measure] * (100 if r.per else 1), m[r.per] if r.per else 1
        if (r.low is not None and value < unit * r.low) or (r.high is not None and value > unit * r.high):
            return False
    return True


def _expected(rows, items):
    rows = [r for r in rows if _kept(r[1])]
    # lines: an equal one earlier, or (from 20 characters) one within an edit
    key = lambda d: LAST if d is None else d
    first = {}
    for d, t in sorted({(key(r[0]), r[1]) for r in rows}):
        for n, x in enumerate(t.split("\n")):
            if x not in first or (d, n) < first[x]:
                first[x] = d, n
    by_size = {}
    for x in first:
        by_size.setdefault(len(x), []).append(x)

    def stays(x, at):
        if not SPACE.sub("", x):
            return True
        if at != first[x]:
            return False
        return len(x) < 20 or not any(y != x and first[y] < at and _near(x, y) for n in (-1, 0, 1) for y in by_size.get(len(x) + n, ()) if len(y) >= 20)

    clean = []
    for d, t, *rest in rows:
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if stays(x, (key(d), n)))
        clean.append((d, kept, *rest[:2], len(kept)))
    # one row of each group, the one with the smallest id
    groups = {}
    for r, (d, n, c) in zip(clean, _components([(i, r[1]) for i, r in enumerate(clean)], 5, 80), strict=True):
        if n:
            groups.setdefault(c, []).append(r)
    left = [r for r in clean if not SPACE.sub("", r[1])] + [min(g, key=lambda r: key(r[0])) for g in groups.values()]
    # benchmark items of which 80 % of the shingles are in a text
    norm = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def leaks(t):
        for item in items:
            w = norm(item or "")
            k = min(5, len(w))
            if k and 100 * len(cut(w, k) & cut(norm(t), k)) >= 80 * len(cut(w, k)):
                return True
        return False

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [(*r, library.encode_ordinary(r[1])) for r in left if not leaks(r[1])]


def _corpus():
    rnd = random.Random(12)
    small = "the of and to in is that it for as with was be on by".split()
    word = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5)))
    line = lambda n: " ".join(rnd.choice(small) if rnd.random() < 0.3 else word() for _ in range(n))
    items = [line(9), line(30), "two words", None, ""]
    shared = [line(12) for _ in range(4)]
    texts = []
    for _ in range(40):
        ls = [line(rnd.randrange(6, 20)) for _ in range(rnd.randrange(5, 12))]
        if rnd.random() < 0.5:
            ls.insert(rnd.randrange(len(ls)), rnd.choice(shared))
        if rnd.random() < 0.3:
            x = rnd.choice(shared)
            ls.insert(0, x[:5] + "q" + x[6:])
        if rnd.random() < 0.3:
            ls.insert(1, "Les.")
        texts.append("\n".join(ls))
    texts += [t.replace("a", "e", 2) for t in texts[:6]] + [texts[7], texts[7]]  # near copies and copies
    texts += [t + "\n" + rnd.choice(items[:2]) for t in [" ".join(line(40) for _ in range(3)) for _ in range(5)]]
    texts += [None, "", " \n ", "too short", "### " * 80, line(4) * 60]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, " ".join(line(30) for _ in range(3)), "en", "s", 1), rows[3]]
    return rows, items


def _write(spark, folder, rows, items, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, items = _corpus()
    out = corpus_pipeline.run(spark, _write(spark, tmp_path, rows, items))
    assert out.columns == [*COLUMNS, "token_ids"]
    got = sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.token_ids) for r in out.collect()), key=repr)
    want = _expected(rows, items)
    assert 20 < len(want) < len(rows) - 5 and got == sorted(want, key=repr)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_pipeline_edges(spark, tmp_path):
    """Clashing columns are carried along, shared and null ids are told apart, an empty table stays one."""
    good = "the cat and the dog went to a house in the town of the hill and it is on the way for all of us "
    rnd = random.Random(9)
    prose = lambda: " ".join(f"{w}{rnd.randrange(1000)}" if rnd.random() < 0.6 else w for w in (good * 5).split())
    a, b, c = prose(), prose(), prose()
    rows = [(1, a, "x", 1, "old"), (1, b, "y", 2, "old"), (None, c, "z", 3, "old"), (None, c + " end", "z", 4, "old"), (2, a, "w", 5, "old"), (1, a, "v", 6, "old")]
    folder = _write(spark, tmp_path, rows, ["no such item is in any of the texts"], "doc_id long, text string, _id string, gone int, token_ids string")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "_id", "gone", "token_ids"]
    got = out.collect()
    # the line of document 2 is one of document 1, which has two rows of one text
    texts = sorted((r.doc_id or 0, r.text) for r in got)
    assert texts in [sorted([(1, a), (1, b), (0, t), (2, "")]) for t in (c, c + " end")]
    assert all(len(r.token_ids) > 50 for r in got if r.text)
    for name, stage in corpus_pipeline.STAGES:
        none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        left = stage(spark, none, folder)
        assert left.count() == 0 and left.columns[:5] == COLUMNS, name
    assert spark.read.parquet(f"{folder}/documents.parquet").filter(F.col("text") == a).count() == 3
