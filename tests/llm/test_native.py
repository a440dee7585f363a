"""Quality rules, line dedup and decontamination against plain Python."""

import collections
import re

from pyspark.sql import functions as F

from pairgauge.llm import decontam, linededup, quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_quality(docs, nothing, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(quality.measures(docs)).collect())
    want = []
    for d, t, *_ in rows:
        t = t or ""
        ws = [w for w in SPACE.split(t) if w]
        wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        times = collections.Counter(wins)
        covered = {i + k for i, w in enumerate(wins) if times[w] > 1 for k in range(3)}
        ls = [x for x in t.split("\n") if SPACE.sub("", x)]
        n = len(covered)
        want.append((-1 if d is None else d, len(ws), len(SPACE.sub("", t)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), n, len(ws) < 50 or 100 * n > 50 * len(ws)))
    assert got == sorted(want)
    assert quality.verdicts(quality.measures(nothing)).count() == 0
    assert quality.filter_documents(docs).columns == docs.columns


def test_rules_judge_junk(spark):
    clean = "the cat and the dog went to a house in the town of the hill " * 1
    good = " ".join(f"{w}{i}" if i % 3 else "the" for i, w in enumerate((clean * 8).split()))
    junk = " ".join(w + "###" for w in good.split())
    lines = "\n".join(["the cat is on the mat of this big house today"] * 3 + [f"line {i} of the text is here and unlike {i * 7} others" for i in range(4)])
    df = spark.createDataFrame([(1, good), (2, junk), (3, lines)], "doc_id long, text string")
    got = {r.doc_id: r.failed_rules for r in quality.verdicts(quality.measures(df)).collect()}
    assert got[1] == [] and "symbols" in got[2] and ("repetitive" in got[3] or "duplicate_lines" in got[3])


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def test_line_dedup(spark, docs, nothing):
    body = "abcdefghij klmnopqrst uvwxyz 0123456789 " * 9
    more = [body, body[:100] + "!" + body[100:], body[:50] + body[51:], body[:-1] + "?", body + "zz", "aaab" * 12, "aaab" * 11 + "aab", "x" * 25, "x" * 26, "y" + "x" * 25, "short", "short"]
    extra = spark.createDataFrame([(1000 + i, f"{t}\nhead {i} of its own, long enough", "c") for i, t in enumerate(more)], "doc_id long, text string, clash string")
    df = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    docs_once = sorted({(d if d is not None else 2**63 - 1, t) for d, t in rows if t is not None})
    occurrences = [(d, n, x) for d, t in docs_once for n, x in enumerate(t.split("\n"))]
    first = {}
    for d, n, x in occurrences:
        first.setdefault(x, (d, n))
    gone = {(d, n) for d, n, x in occurrences if len(x) >= 20 and ((d, n) != first[x] or any(len(y) >= 20 and f < (d, n) and _near(x, y) for y, f in first.items() if y != x and abs(len(x) - len(y)) < 2))}
    got = linededup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.kept_text is None and r.n_lines == 0
            continue
        d = r.doc_id if r.doc_id is not None else 2**63 - 1
        kept = [x for n, x in enumerate(r.text.split("\n")) if (d, n) not in gone]
        assert (r.kept_text, r.n_lines, r.n_removed) == ("\n".join(kept), len(r.text.split("\n")), len(r.text.split("\n")) - len(kept)), r.doc_id
    assert linededup.dedup_lines(nothing).count() == 0
    assert linededup.clean_documents(docs).columns == docs.columns


def test_short_lines_are_cleaned(spark):
    """Exact copies go at every length; blank lines and short lines one edit apart stay."""
    texts = ["Les.\n\nWh the.\nLes.\n  ", "Les!\n\nWh the.\n  \nx\nx", "Les.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.clean_documents(df).collect()}
    assert got == {0: ("Les.\n\nWh the.\n  ", 16), 1: ("Les!\n\n  \nx", 10), 2: ("", 0), 3: (None, None)}
    assert [r.n_removed for r in linededup.dedup_lines(df).collect()] == [0] * 4


def test_contaminated_rows_without_an_id(spark):
    """Of rows that share an id, or have none, those that hold an item go."""
    item = "this is the secret item of the benchmark with some more words"
    rows = [(None, "begin " + item), (None, "a clean text of no id"), (1, item + " end"), (1, "another clean text"), (2, "more clean words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.remove_contaminated(df, items).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


def test_decontamination(spark, docs, nothing, rows):
    passage = rows[36][1].split()[40:70]
    items = [(1, " ".join(passage)), (2, "never seen words stand in this item of the test"), (3, None), (4, ""), (5, "two words"), (6, " ".join(passage[:12]) + " changed " + " ".join(passage[13:])), (7, "One!")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in decontam.matches(docs, items).collect()}
    want = {}
    norm = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    for it in items.collect():
        w = norm(it.text)
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for d, t, *_ in rows:
            x = norm(t)
            n = len(s & {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}) if s else 0
            if s and 100 * n >= 80 * len(s):
                want[d, it.item_id] = (len(s), n)
    assert got == want and {i for _, i in want} == {1, 5, 6, 7}
    assert decontam.matches(nothing, items).count() == 0 and decontam.matches(docs, items.filter("false")).count() == 0
    left = decontam.remove_contaminated(docs, items)
    assert left.columns == docs.columns and not {r.doc_id for r in left.select("doc_id").collect()} & {d for d, _ in want}
    assert left.filter(F.col("text").isNull()).count() == 1
