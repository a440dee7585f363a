from pyspark.sql import functions as F

from pairgauge.functions import text as X
from pairgauge.functions import trees
from pairgauge.operators import formats, reports

N = "\u00a0"
SRC = '<?xml version="1.0"?>\n<topic id="a"><title>The Tool</title><body><p>You can use the tool with <codeph>x:y</codeph> and this file: then save it.</p></body></topic>'


def _hyp(body: str, title: str = "L’outil") -> str:
    return f'<?xml version="1.0"?>\n<topic id="a"><title>{title}</title><body><p>{body}</p></body></topic>'


def test_report_and_reward(spark):
    good = f"Vous pouvez utiliser l’outil avec <codeph>x:y</codeph> et ce fichier{N}: puis le garder."
    rows = [
        ("ok", SRC, _hyp(good), _hyp(good)),
        ("typo", SRC, _hyp(good.replace(f"{N}:", " :")), _hyp(good)),
        ("code", SRC, _hyp(good.replace("x:y", "x:z")), _hyp(good)),
        ("attr", SRC, _hyp(good).replace('id="a"', 'id="b"'), _hyp(good)),
        ("broken", SRC, _hyp(good)[:-5], _hyp(good)),
        ("fence", SRC, f"<think>hm</think>```xml\n{_hyp(good)}\n```", _hyp(good)),
        ("title", SRC, _hyp(good, "Le Bel Outil"), _hyp(good)),
        ("calque", SRC, _hyp(good.replace("utiliser", "supporter la librairie")), _hyp(good)),
        ("english", SRC, SRC, _hyp(good)),
    ]
    out = reports.reward(reports.check(spark.createDataFrame(rows, "id string, src string, hyp string, ref string")))
    got = {r.id: r for r in out.collect()}
    assert got["ok"].reward == 1.0 and got["ok"].chrf == 100.0 and got["ok"].structure_ok
    assert got["typo"].typo.nbsp_missing == 1 and abs(got["typo"].reward - (got["typo"].chrf / 100 - 0.08)) < 1e-12
    assert got["code"].protected_changed == 1 and not got["code"].structure_ok
    assert got["attr"].reward == -1.0 and not got["attr"].skeleton_ok
    assert not got["broken"].xml_ok and got["broken"].reward == -1.0 and got["broken"].typo is None and got["broken"].chrf is not None
    assert got["fence"].reward == 1.0
    assert got["title"].titlecase == 2
    assert got["calque"].calques == {"supporter=support": 1, "librairie=library": 1}
    assert got["english"].untranslated and got["english"].reward == -0.5
    shown = {r.id: r.problems for r in reports.problems(out).collect()}
    assert shown["ok"] == [] and shown["broken"] == ["xml does not parse"] and "1 protected element(s) changed" in shown["code"]


def test_native_fixer_equals_tree_fixer(spark):
    texts = ["a : b", "10 : c", "10: d", "e!", "f ?!", "« g »", "h;i", "j ;", "«k»", f"l{N}: m", "12:30", "n :", "o»!", " :", "3 ;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fix_spacing(F.col("t")).alias("f"))
    assert {r.t: r.f for r in df.collect()} == {t: trees.spaced(t) for t in texts}


def test_format_scores(spark):
    cut = SRC[: len(SRC) // 2]
    rows = [("same", SRC, SRC, False), ("cut", SRC, cut, True), ("bad", SRC, cut, False), ("attr", SRC, SRC.replace('id="a"', 'id="b"'), False), ("src", "<a", SRC, False)]
    df = spark.createDataFrame(rows, "id string, src string, hyp string, cap boolean")
    got = {r.id: r for r in formats.score_format(df, F.col("cap")).collect()}
    assert got["same"].format_reward == 1.0 and not got["same"].format_broken and got["same"].primary_reason is None
    assert got["cut"].format_reward == -0.7 and got["cut"].primary_reason == "truncated"
    assert got["bad"].format_reward == -1.0 and got["bad"].reasons == ["not_well_formed"]
    assert got["attr"].reasons == ["attr_changed"] and got["attr"].format_reward == round(0.5 * 0.8 + 0.2 * 0 + 0.3, 4)
    v = {r.id: r for r in formats.count_violations(df, F.col("cap")).collect()}
    assert v["same"].schema == 0 and v["same"].punct == 1 and v["attr"].parts["attr_value"] == 1
    assert v["cut"].parts["not_well_formed"] == 1 and v["cut"].parts["truncation"] == 1 and v["src"].violations == 1


def test_differences_name_each_kind():
    parse = trees.parse_document
    kinds = lambda a, b: trees.differences(parse(a), parse(b))
    assert kinds("<a><b/><c/></a>", "<a><c/><b/></a>") == ["sibling_reorder"]
    assert kinds('<a x="1" y="2"/>', '<a y="2" x="1"/>') == ["attr_order"]
    assert kinds("<a><b/></a>", "<a><b/><b/></a>") == ["child_mismatch"]
    assert kinds("<a><b/></a>", "<a><c/></a>") == ["child_mismatch"]
    assert kinds("<a/>", "<b/>") == ["tag_mismatch"]
    assert trees.structure_counts(parse("<a><b/><c/></a>"), parse("<a><c/><b/></a>")) == (0, 0, 2)
