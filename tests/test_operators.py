"""Operators that no SQL covers, and the queries against DuckDB on the smallest tables."""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairgauge import plans
from pairgauge.functions import numbers, trees, xml
from pairgauge.functions import text as X
from pairgauge.operators import compare, corpus, summaries, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _rows(df):
    return sorted((tuple(x.tolist() if hasattr(x, "tolist") else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b) and all(_same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def _against_sql(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over made-up tables."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return _rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()), _rows(c.execute(plans.ORACLE_SQL[name]).df())


_DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_xml_heads_first_lines(spark, tmp_path):
    texts = ["A.\nAll rights reserved.", "\nabc", "ab", "abc", "<a&bc\nd", "é😀x y\n\n", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], _DOCUMENT)
    got, want = _against_sql(spark, tmp_path, "xml_heads", documents=docs)
    assert got == want and {r[4] for r in got} == {3, 4, 5}


def test_decoded_places(spark):
    """As character by character, with few places at a time on their way to Spark."""

    def slow(raw):
        out, spans, at = [], [], 0
        while at < len(raw):
            m = trees._REFERENCE.match(raw, at)
            c = m and trees._referred(m)
            out.append(c or raw[at])
            spans.append((at, m.end() if c else at + 1))
            at = spans[-1][1]
        return "".join(out), spans

    rnd = random.Random(2)
    bits = ["a", "é", "😀", "&", "&lt;", "&amp;", "&#233;", "&#xA;", "&#0;", "&#xD800;", "&#x1F600;", "&nbsp;", "&quot", ";", "\n"]
    texts = ["", None, *("".join(rnd.choices(bits, k=rnd.randrange(40))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", xml.decode_mapped(F.col("t")).alias("d")).collect()
    got = {r.i: r.d and (r.d.text, [tuple(x) for x in r.d.spans]) for r in rows}
    assert got == {i: None if t is None else slow(t) for i, t in enumerate(texts)}
    sizes = [len(a) for a in xml._decoded(iter([pa.array(["x" * (xml.PLACES // 2)] * 5 + [None])]))]
    assert sizes == [2, 2, 2]


def test_places(spark):
    rnd = random.Random(3)
    ids = [rnd.choice([None, "b", "é", f"k{i}"]) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(ids)), "i int, id string").repartition(5)
    for parts, per in ((256, 16), (8, 4), (100, 1)):
        got = sorted((r.place, r.id, r.i) for r in windows.places(df, "id", "i", parts=parts, per=per).collect())
        assert [g[0] for g in got] == list(range(500))
        assert [g[1:] for g in got] == sorted(((x, i) for i, x in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert df.select(windows.ranges(df, "id", 8, 4).alias("b")).distinct().count() > 1


def test_blind_tally_of_many(spark, tmp_path):
    """More pairs than one task numbered, and documents and labels that occur twice."""
    ids = spark.range(100_100).union(spark.range(5))
    docs = ids.select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got, want = _against_sql(spark, tmp_path, "blind_tally", documents=docs, labels=labels)
    assert got == want and got[0][0] == 100_095 + 5 * 4


def test_py_round(spark):
    rnd = random.Random(1)
    values = [2.675, 0.125, -0.125, 1.005, 0.0, -1.0, 0.5, 1.5, 2.5, *[rnd.uniform(-100, 100) for _ in range(300)], *[round(rnd.uniform(0, 1), 3) + 0.0005 for _ in range(100)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 4):
        for r in df.select("v", numbers.py_round(F.col("v"), digits).alias("r")).collect():
            assert r.r == round(r.v, digits), (r.v, digits)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.split_label(F.lit("/a/b/test_run_2.jsonl"))) == "test"
    assert one(X.prolog(F.lit('<?xml version="1.0"?>\n<!DOCTYPE t>\n<t/>'))) == '<?xml version="1.0"?>\n<!DOCTYPE t>\n'
    assert one(X.strip_doctype(F.lit('<!DOCTYPE t [<!ENTITY a "b">]><t/>'))) == "<t/>"
    assert one(X.excerpt(F.lit("0123456789abcdefghij" * 2), F.lit(20))) == "89abcdefghij0123456789abc"
    assert one(X.titlecase(F.lit("The Tool"), F.lit("La Belle Vue du Tool XML iPhone Boîte de dialogue Historique"))) == 3
    assert one(X.romanian_fluency(F.lit("acesta este un test pentru tine și pe"))) == 5
    assert one(F.size(X.messages("s", F.lit("u"), F.lit("repair")))) == 2
    assert one(X.completion_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7), F.lit(8)), 3)) == [-100, -100, 7]
    assert one(X.completion_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7)), 2)) is None
    assert one(X.family(F.lit("author-tags-2"), ["author"])) == "author" and one(X.family(F.lit("x_y"), ["author"])) == "x"
    assert one(F.rlike(F.lit("model.layers.3.q_proj"), X.alternation(F.array(F.lit("q_proj"), F.lit("v_proj")))))
    assert one(xml.closed(F.lit("<a><b/></a>"))) and not one(xml.closed(F.lit("<a><b/>")))
    assert one(xml.visible_text(F.lit("<t><title>A</title><p>B c</p></t>"))) == "AB c\nA\nB c"


def test_high_marks_match_python(spark):
    import re

    n, m = X.NBSP, X.NNBSP
    high = re.compile(rf"(?P<pre>.?)(?P<sp>[ {n}{m}]?)(?P<mark>[:;!?])(?=\s|$|[)\]»§])")
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(f"aé1 :;!?»)«\n{n}{m}") for _ in range(rnd.randrange(25))) for _ in range(400)]

    def want(t):
        bad = 0
        for x in high.finditer(t):
            pre, sp, mark = x["pre"], x["sp"], x["mark"]
            bad += not ((sp and sp in n + m) or (mark in "!?" and pre and pre in "!?") or (not pre and not sp) or (pre.isdigit() and mark == ":"))
        return bad

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.typography(F.col("t"))["nbsp_missing"].alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: want(t) for t in texts}


def test_windows(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 3, 9, 1, 4, 20])], "g string, k int, n int")
    assert [(r.n, r.batch) for r in windows.pack(df, "g", "k", "n", 3, 12).orderBy("batch", "n").collect()] == [(1, 0), (3, 0), (4, 0), (5, 1), (9, 2), (20, 3)]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    span = lambda *p: F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in p])
    assert [tuple(x) for x in one(windows.merge_spans(span((4, 6), (0, 2), (2, 3), (5, 9))))] == [(0, 3), (4, 9)]
    assert [tuple(x) for x in one(windows.free_spans(span((0, 2), (0, 5), (4, 6), (5, 7))))] == [(0, 5), (5, 7)]
    assert one(windows.covered(span((0, 2)), F.lit(1))) and not one(windows.covered(span((0, 2)), F.lit(2)))
    assert one(windows.drop_repeats_in(F.array(*map(F.lit, "aabba")))) == ["a", "b", "a"]
    assert trees.lcs_ratio(list("abcd"), list("acd")) == 0.75 and trees.common_pairs(list("abc"), list("bc")) == [(1, 0), (2, 1)]


def test_compare(spark):
    rows = [(f"t{i:02d}", float(i % 7), float(i % 5)) for i in range(40)]
    a = spark.createDataFrame([(i, x) for i, x, _ in rows], "id string, m double")
    b = spark.createDataFrame([(i, y) for i, _, y in rows], "id string, m double")
    d = compare.deltas(a, b, ("m",))
    r = compare.paired_bootstrap(d, 2000).first()
    x = [y - z for _, z, y in sorted(rows)]
    rng = random.Random(0)
    means = sorted(sum(x[rng.randrange(40)] for _ in range(40)) / 40 for _ in range(2000))
    assert (r.n, r.up, r.down, r.equal) == (40, sum(v > 0 for v in x), sum(v < 0 for v in x), sum(v == 0 for v in x))
    assert math.isclose(r.low, means[50]) and math.isclose(r.high, means[1950])
    s = compare.bootstrap_at_scale(d, 400).first()
    assert abs(s.low - r.low) < 0.25 and abs(s.high - r.high) < 0.25 and math.isclose(s.mean, r.mean)
    assert round(compare.sign_test(22, 17), 2) == 0.52 and compare.sign_test(0, 0) == 1.0


def test_python_draws():
    """Python's randrange by arrays, also from where a part of the resamples begins."""
    for n in (1, 2, 3, 40, 64, 65, 100_003):
        _, state, _ = random.Random(7).getstate()
        key, pos, size = np.array(state[:624], np.uint32), state[624], 3 * n
        rng = random.Random(7)
        want = [rng.randrange(n) for _ in range(5 * size)]
        for k, (at, p, skip) in enumerate(compare._Draws(n, key, pos).stands(size, 5)):
            draws, got = compare._Draws(n, np.frombuffer(at, np.uint32), p, skip), []
            while len(got) < size:
                got += draws.next().tolist()
            assert got[:size] == want[k * size : (k + 1) * size]


def test_bootstrap_of_many(spark, monkeypatch):
    """More topics than were taken before, in several parts, and two measures."""
    monkeypatch.setattr(compare, "DRAWS", 1 << 18)
    one = spark.range(100_001).select(F.format_string("t%06d", "id").alias("id"), F.lit("m").alias("measure"), (F.col("id") * 7919 % 5 - 2).cast("double").alias("delta"))
    two = spark.range(30).select(F.format_string("t%06d", "id").alias("id"), F.lit("k").alias("measure"), (F.col("id") / 7 - 2).alias("delta"))
    got = {r.measure: r for r in compare.paired_bootstrap(one.union(two).repartition(3), 12).collect()}
    for m, x in (("m", [float(i * 7919 % 5 - 2) for i in range(100_001)]), ("k", [i / 7 - 2 for i in range(30)])):
        rng, n = random.Random(0), len(x)
        means = sorted(sum(x[rng.randrange(n)] for _ in range(n)) / n for _ in range(12))
        r = got[m]
        assert (r.n, r.mean, r.up, r.down, r.equal) == (n, sum(x) / n, sum(v > 0 for v in x), sum(v < 0 for v in x), sum(v == 0 for v in x))
        assert math.isclose(r.low, means[0], rel_tol=1e-15) and math.isclose(r.high, means[11], rel_tol=1e-15)


def test_corpus_edges(spark):
    topic = '<!DOCTYPE t><topic><title>A title here</title><body><p conref="x">This paragraph is reused from elsewhere here.</p><p>This one is long enough to be kept as it is.</p></body></topic>'
    files = spark.createDataFrame([("a", topic), ("b", "<broken"), ("c", topic), ("d", None)], "path string, raw string")
    segs = corpus.segments(files)
    assert [(r.file, r.text) for r in segs.orderBy("file").collect()] == [(f, "This one is long enough to be kept as it is.") for f in "ac"]
    assert corpus.topics(files).count() == 0
    held = files.filter("path = 'c'").select(F.col("path").alias("id"), F.col("raw").alias("src"))
    assert corpus.train_segments(segs, held, 1).count() == 0
    assert corpus.disjoint(files, files.filter("path = 'z'"), "path")
    with pytest.raises(ValueError):
        corpus.assert_disjoint(files, files, "path")
    rows = spark.createDataFrame([("a", 1, None), ("b", None, "x")], "id string, new_tokens int, error string")
    assert summaries.present(rows, ("id", "none")).columns == ["id"]
    assert summaries.with_failures(rows.select("id", "new_tokens"), rows.select("id", "error")).count() == 4
