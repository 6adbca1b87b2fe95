"""Routing of requests, recommendations, catalogs and product contracts, over tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import small

# Risks and the words of a request that raise them.
RISK_WORDS = (
    ("child-data", ("孩子", "儿童", "学生", "未成年", "幼小")),
    ("multi-user", ("家里", "家庭", "共享", "共同", "夫妻", "成员", "多人")),
    ("customer-data", ("客户", "会员", "病人", "患者")),
    ("financial-data", ("财务", "账务", "报税", "发票", "收入", "支出")),
    ("health-data", ("健康", "医疗", "疾病", "用药", "孕期", "症状", "健身")),
    ("account-data", ("账号", "登录", "密码", "令牌", "API key")),
    ("external-side-effect", ("发布", "发送", "下单", "支付", "预约", "退款", "通知", "自动同步")),
)
# Words that alone settle a domain.
ANCHORS = (
    ("travel-planning", ("旅行", "旅游", "行程")),
    ("exam-preparation", ("考公", "备考", "国考", "省考", "事业编")),
    ("household-collaboration", ("家庭共享", "家里", "夫妻", "家务")),
    ("health-pregnancy", ("医疗", "孕期", "用药", "症状")),
    ("finance-tax-contract", ("财务", "报税", "税务", "账务")),
)


def route_scores(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """``request_id, domain_id, score, rank``: 2 for each keyword and 8 for each anchor found in the text."""
    anchors = requests.sparkSession.createDataFrame([(d, w) for d, ws in ANCHORS for w in ws], "domain_id string, word string").withColumn("points", F.lit(8))
    words = packs.select("domain_id", F.explode("keywords").alias("word")).withColumn("points", F.lit(2)).unionByName(anchors.join(packs.select("domain_id"), "domain_id", "left_semi"))
    low = F.when(F.col("points") == 2, F.lower(T.text("text")).contains(F.lower("word"))).otherwise(T.text("text").contains(F.col("word")))
    met = requests.select("request_id", "text").join(small(words), low)
    out = met.groupBy("request_id", "domain_id").agg(F.sum("points").alias("score"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "domain_id")))


def risks(requests: DataFrame, packs: DataFrame) -> DataFrame:
    """``request_id, risks``: raised by words of the text, or by the selected domains."""
    table = requests.sparkSession.createDataFrame([(r, w) for r, ws in RISK_WORDS for w in ws], "risk string, word string")
    by_word = requests.join(small(table), F.lower(T.text("text")).contains(F.lower("word"))).select("request_id", "risk")
    domains = requests.select("request_id", F.explode(F.concat(F.array("primary_domain"), F.coalesce("auxiliary_domains", F.array().cast("array<string>")))).alias("domain_id"))
    by_pack = domains.join(packs.select("domain_id", F.explode("risk_triggers").alias("risk")), "domain_id").select("request_id", "risk")
    return by_word.unionByName(by_pack).groupBy("request_id").agg(F.array_sort(F.collect_set("risk")).alias("risks"))


def route_errors(requests: DataFrame, packs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``request_id, code``: unknown or repeated domains, evidence that the request doesn't contain, foreign profiles."""
    known = packs.select("domain_id").distinct()
    aux = F.coalesce("auxiliary_domains", F.array().cast("array<string>"))
    spans = F.coalesce("evidence_spans", F.array().cast("array<string>"))
    no_primary = requests.join(known, F.col("primary_domain") == F.col("domain_id"), "left_anti").select("request_id", F.lit("primary_domain_invalid").alias("code"))
    bad_aux = requests.where((F.size(aux) > 2) | (F.size(aux) != F.size(F.array_distinct(aux))) | F.array_contains(aux, F.col("primary_domain"))).select("request_id", F.lit("auxiliary_domains_invalid"))
    foreign = requests.select("request_id", F.explode(aux).alias("d")).join(known, F.col("d") == F.col("domain_id"), "left_anti").select("request_id", F.lit("auxiliary_domain_unknown"))
    no_span = requests.where((F.size(spans) == 0) | F.exists(spans, lambda s: (F.trim(s) == "") | ~T.text("text").contains(s))).select("request_id", F.lit("evidence_span_invalid"))
    own = profiles.select(F.col("domain_id").alias("_d"), F.col("profile_id").alias("_p"))
    bad_profile = requests.where("profile_id is not null").join(own, (F.col("primary_domain") == F.col("_d")) & (F.col("profile_id") == F.col("_p")), "left_anti").select("request_id", F.lit("profile_invalid"))
    return no_primary.union(bad_aux).union(foreign).union(no_span).union(bad_profile).distinct()


def recommend(requests: DataFrame, modules: DataFrame, most: int = 8) -> DataFrame:
    """``request_id, core, optional``: explicit modules first, then those of the profile or domain, up to ``most``."""
    own = requests.select("request_id", "primary_domain", F.coalesce("explicit_modules", F.array().cast("array<string>")).alias("explicit"))
    offered = modules.groupBy("domain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "module_id"))), lambda x: x["module_id"]).alias("offer"))
    met = own.join(offered, F.col("primary_domain") == F.col("domain_id"), "left")
    ranked = F.array_distinct(F.concat("explicit", F.coalesce("offer", F.array().cast("array<string>"))))
    return met.select("request_id", F.slice(ranked, 1, most).alias("core"), F.when(F.size(ranked) > most, F.slice(ranked, most + 1, 1 << 20)).otherwise(F.array().cast("array<string>")).alias("optional"))


def snapshot_hash(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return rows.withColumn("sha256", T.canonical_hash(**{c: F.col(c) for c in [key, *cols]}))


def starter_items(modules: DataFrame, items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Items of each module's capabilities, once by item id, with a learning stage's own where it has any."""
    caps = modules.select("module_id", "stage_id", F.explode("capabilities").alias("capability"))
    base = caps.join(items, "capability").withColumn("own", F.lit(0))
    special = caps.join(overrides, ["capability", "stage_id"]).withColumn("own", F.lit(1))
    both = base.select("module_id", "item_id", "question", "pos", "own").unionByName(special.select("module_id", "item_id", "question", "pos", "own"))
    staged = W.partitionBy("module_id")
    kept = both.withColumn("_any", F.max("own").over(staged)).where(F.col("own") == F.col("_any"))
    return kept.groupBy("module_id", "item_id").agg(F.min_by("question", "pos").alias("question"), F.min("pos").alias("pos"))


def match_template(products: DataFrame, templates: DataFrame) -> DataFrame:
    """``product_id, template_id``: the first template that fits domain, profile, modules and markers."""
    none = F.array().cast("array<string>")
    t = templates.select(F.col("pos").alias("_pos"), "template_id", "domains", "profiles", "required_modules", "markers", "excluded")
    fits = (
        F.array_contains("domains", F.col("domain_id"))
        & ((F.size(F.coalesce("profiles", none)) == 0) | F.coalesce(F.array_contains("profiles", F.col("profile_id")), F.lit(False)))
        & (F.size(F.array_except(F.coalesce("required_modules", none), F.col("modules"))) == 0)
        & ((F.size(F.coalesce("markers", none)) == 0) | F.exists(F.coalesce("markers", none), lambda m: T.text("request").contains(m)))
        & ~F.exists(F.coalesce("excluded", none), lambda m: T.text("request").contains(m))
    )
    return products.join(small(t), fits).groupBy("product_id").agg(F.min_by("template_id", "_pos").alias("template_id"))


def product_errors(products: DataFrame, allowed_modules: DataFrame, sources: DataFrame) -> DataFrame:
    """``product_id, code, detail``: required fields, repeated ids, modules that aren't offered, unknown sources."""
    need = [products.where(F.trim(T.text(c)) == "").select("product_id", F.lit("field_missing").alias("code"), F.lit(c).alias("detail")) for c in ("title", "domain_id", "summary")]
    mods = products.select("product_id", "domain_id", F.explode("modules").alias("module_id"))
    twice = mods.groupBy("product_id", "module_id").count().where("count > 1").select("product_id", F.lit("module_duplicate"), "module_id")
    foreign = mods.join(allowed_modules.select("domain_id", "module_id"), ["domain_id", "module_id"], "left_anti").select("product_id", F.lit("module_not_offered"), "module_id")
    lost = products.select("product_id", F.explode("source_ids").alias("source_id")).join(sources.select("source_id"), "source_id", "left_anti").select("product_id", F.lit("source_unknown"), "source_id")
    out = need[0]
    for part in [*need[1:], twice, foreign, lost]:
        out = out.union(part)
    return out


def source_registry_errors(sources: DataFrame) -> DataFrame:
    twice = sources.where("source_id is not null").groupBy("source_id").count().where("count > 1").select("source_id", F.lit("duplicate").alias("code"))
    return twice.union(sources.where("source_id is null").select("source_id", F.lit("missing"))).union(sources.where(F.col("time_sensitive") & (F.trim(T.text("captured_at")) == "")).select("source_id", F.lit("captured_at_missing")))


def catalog_errors(items: DataFrame, per_domain: int = 12, per_module: tuple[int, int] = (6, 10), points: int = 6) -> DataFrame:
    """``key, code, n`` where a catalog (domain_id, module_id, item_id, knowledge_point) is too thin or too thick."""
    d = items.groupBy(F.col("domain_id").alias("key")).agg(F.count("*").alias("n")).where(F.col("n") < per_domain).select("key", F.lit("domain_items").alias("code"), "n")
    m = items.groupBy(F.col("module_id").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("knowledge_point").alias("k"))
    return d.union(m.where(~F.col("n").between(*per_module)).select("key", F.lit("module_items"), "n")).union(m.where(F.col("k") < points).select("key", F.lit("knowledge_points"), "k"))


def critical_decisions(requests: DataFrame, risk_rows: DataFrame, rules: DataFrame, most: int = 3) -> DataFrame:
    """The first three rules (pos, risk, decision_id, question) that a request's risks raise."""
    raised = risk_rows.select("request_id", F.explode("risks").alias("risk")).join(small(rules), "risk")
    once = raised.groupBy("request_id", "decision_id").agg(F.min("pos").alias("pos"), F.min_by("question", "pos").alias("question"))
    return once.withColumn("_n", F.row_number().over(W.partitionBy("request_id").orderBy("pos", "decision_id"))).where(F.col("_n") <= most).drop("_n")


# Dimensions of visual feedback and the words that name them.
FEEDBACK = (
    ("composition", ("布局", "构图", "卡片墙", "首屏", "左右", "上下")),
    ("density", ("太空", "空白", "紧凑", "太挤", "密度")),
    ("tone", ("日记", "幼稚", "严肃", "专业", "温柔", "力量感")),
    ("color", ("颜色", "配色", "粉色", "珊瑚", "绿色", "薄荷", "黄色", "紫色", "深蓝", "黑红", "杏桃", "太暗", "太亮", "高对比", "饱和")),
    ("typography", ("字体", "字号", "字重", "标题")),
    ("asset", ("图标", "插画", "图片", "素材", "角色")),
    ("scene_specificity", ("不像", "健身感", "训练感", "场景", "模板")),
    ("interaction", ("步骤", "主按钮", "动作", "反馈", "进度")),
)


def feedback_dimensions(c: Column) -> Column:
    """Dimensions that a text names, in alphabetical order."""
    return F.array_sort(F.filter(F.array(*[F.when(T.text(c).rlike("|".join(words)), F.lit(name)) for name, words in FEEDBACK]), lambda x: x.isNotNull()))


def feedback_page(c: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(T.text(c), r"第\s*(\d+)\s*页", 1), F.lit("")), F.nullif(F.regexp_extract(T.text(c), r"(?i)\bp\.?\s*(\d+)", 1), F.lit("")))
    return found.cast("int")
