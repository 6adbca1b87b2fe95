import json

from pyspark.sql import functions as F

from quillspark.operators import rewrites as R
from quillspark.plans import runs


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_replacements_and_names(spark):
    t = spark.createDataFrame([(1, "HAI", "旧", "新"), (2, "other", "甲", "乙"), (3, "hai", "新新", "新")], "pos int, term string, old string, new string")
    df = spark.createDataFrame([("about hai", "旧旧甲"), ("nothing", "旧甲")], "s string, t string")
    assert rows(R.apply_dictionary(df, "s", "t", t), "rewritten", "n_replaced") == [("新甲", 3), ("旧甲", 0)]
    n = spark.createDataFrame([("张三（张三（San Zhang））说",)], "t string")
    assert n.select(R.unnest_names(F.col("t"))).first()[0] == "张三（San Zhang）说"
    assert R.map_fragments("Deep Learning for Learning", {"learning": "学习", "deep learning": "深度学习"}) == "深度学习 学习"
    d = spark.createDataFrame([("head", "Table  1", "表 1")], "role string, source string, output string")
    assert rows(R.role_dictionary(spark.createDataFrame([("head", "table 1"), ("body", "table 1")], "role string, text string"), d).orderBy("role"), "direct") == [(None,), ("表 1",)]


def test_model_output(spark):
    assert R.as_json_array('{"id":1}\n{"id":2}') == '[{"id": 1}, {"id": 2}]'
    assert R.as_json_array('{"id":1}') == '[{"id": 1}]' and R.as_json_array("no json") == "no json" and R.as_json_array('{"a":1}') == '{"a": 1}'
    assert R.first_object('x {bad} {"a": {"b": "}"}} y') == '{"a": {"b": "}"}}' and R.first_object("x") is None
    assert R.input_items('## Here is the input: [{"id":1,"input":"x"}] tail') == '[{"id": 1, "input": "x"}]'
    assert R.input_items("## Here is the input: [1]") is None and R.input_items(None) is None
    df = spark.createDataFrame([('```json\n{"id":1}\n```',)], "t string")
    assert rows(R.parse_outputs(df, "t"), "array", "object", "items") == [('[{"id": 1}]', '{"id": 1}', None)]
    shapes = [{"output": [{"type": "message", "content": "a"}, {"type": "message", "content": "b"}]}, {"output": " x "}, {"text": "t"}, {"choices": [{"message": {"content": "m"}}]}, {"choices": [{"message": {"content": [{"text": "p"}, {"content": "q"}]}}]}, {"choices": [{"text": "c"}]}, {"message": {"content": "k"}}, {"choices": [{"message": {"content": "", "reasoning_content": "r"}}]}]
    got = spark.createDataFrame([(json.dumps(s),) for s in shapes], "j string").select(R.response_text(F.col("j")))
    assert [r[0] for r in got.collect()] == ["a\n\nb", "x", "t", "m", "p\n\nq", "c", "k", "r"]
    p = spark.createDataFrame([("译文：<b>你好</b>",), ('{"output":"好"}',)], "t string").select(R.plain_translation(F.col("t")))
    assert [r[0] for r in p.collect()] == ["你好", "好"]


def test_rules_and_scans(spark):
    pages = spark.createDataFrame([(1, 1, "References\n(2001) (2002) 一二三"), (1, 2, "plain")], "doc_id long, page int, text string")
    rules = spark.createDataFrame([("refs_translated", "warn", ["[一-鿿]"], ["2001", "2002", "2003"], 2, None), ("any_refs", "blocking", ["(?i)references"], None, None, ["plain"])], "rule string, severity string, all_of array<string>, any_of array<string>, least int, none_of array<string>")
    assert sorted(rows(R.page_rules(pages, rules), "page", "rule")) == [(1, "any_refs"), (1, "refs_translated")]
    html = spark.createDataFrame([(1, '<div data-hook="save" data-build="b1">x</div><script>fetch("u")</script>'), (2, '<div data-hook="save"></div><i data-hook="export" data-build="b2">TODO</i>')], "page_id long, html string")
    locks = spark.createDataFrame([(1, "b1"), (2, "b1")], "page_id long, build string")
    got = R.scan_candidates(html, locks, {"data-build": "build"}, {"data-hook": ("save", "export")})
    assert sorted(rows(got, "page_id", "code")) == [(1, "forbidden:network"), (1, "missing:data-hook"), (2, "forbidden:unfinished"), (2, "not_exact:data-build")]
    ev = R.judge_evidence(spark.createDataFrame([('{"a":{"b":true},"c":false}',)], "j string"), "j", ("a.b", "c"))
    assert rows(ev, "failed", "passed") == [(["c"], False)]


def test_translation_run(spark):
    docs = spark.createDataFrame([(1, "It may not grow 5% at https://a.b/c\n\n# Head\nAn LLM here")], "doc_id long, text string")
    tr = spark.createDataFrame([(1, "block-0001", "ok", "它增长"), (1, "block-0003", "failed", "法学硕士"), (1, "block-0003", "ok", "法学硕士")], "doc_id long, block_id string, status string, translation string")
    pol = spark.createDataFrame([("LLM", "大型语言模型", "translate", ["法学硕士"])], "term string, expected string, action string, forbidden array<string>")
    issues = runs.translation_issues(docs, tr, pol)
    assert {("block-0002", "omission"), ("block-0003", "addition"), ("block-0003", "term_policy"), ("block-0001", "protected"), ("block-0001", "quantity"), ("block-0001", "drift")} <= set(rows(issues, "block_id", "rule"))
    rollup, repair = runs.translation_report(issues)
    assert dict(rows(rollup, "rule", "status"))["protected"] == "fail" and "block-0001" in {r[0] for r in rows(repair, "block_id")}


def test_nfkc(spark):
    from quillspark.functions import unicode as U
    from quillspark.runtime import prepare

    prepare(spark)
    df = spark.createDataFrame([("ＬＬＭ ﬁne", "LLM"), (None, "x")], "a string, b string")
    assert rows(df.select(U.nfkc(F.col("a")).alias("n"), U.contains_term(F.col("a"), F.col("b")).alias("c")), "n", "c") == [("LLM fine", True), ("", False)]


def test_policy_context(spark):
    b = spark.createDataFrame([("b1", "an LLM and a neural net"), ("b2", "nothing")], "block_id string, text string")
    t = spark.createDataFrame([(i, x, f"x{i}", None) for i, x in enumerate(["alpha", "beta", "LLM", "neural net"])], "pos int, term string, expected string, note string")
    got = dict(rows(R.policy_context(b, t, most=3), "block_id", "context"))
    assert got == {"b1": "- LLM => x2\n- neural net => x3\n- alpha => x0", "b2": "- alpha => x0\n- beta => x1\n- LLM => x2"}
