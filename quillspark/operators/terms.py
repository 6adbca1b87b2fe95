"""Terms: candidates ranked by frequency, layered policies, glossary and policy checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import small

# How candidates look, and how many of each kind are kept.
CANDIDATES = (
    ("acronym", r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9]+s?)(?![\p{L}\p{N}_])", 40),
    ("camel", r"(?<![\p{L}\p{N}_])([A-Z][A-Za-z]+[A-Z][A-Za-z0-9]*)(?![\p{L}\p{N}_])", 30),
    ("phrase", r"(?<![\p{L}\p{N}_])((?:[A-Z][a-z]+|[A-Z]{2,}s?)(?:[ \t]+(?:of|for|and|in|to|the|with|[A-Z][a-z]+|[A-Z]{2,}s?)){1,5})(?![\p{L}\p{N}_])", 60),
)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, at, term``: every match of every kind, ``at`` its place among those of the document."""
    def of(kind: str, pattern: str) -> DataFrame:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(T.text(text_col), F.lit(pattern), 1)).alias("at", "term"))

    return reduce(DataFrame.unionByName, [of(k, p) for k, p, _ in CANDIDATES])


# Terms with a settled treatment (translation, action, confidence, type), in their order.
KNOWN_TERMS = (
    ("LLM", "LLM（大型语言模型）", "keep+explain", "high", "abbreviation"),
    ("LLMs", "LLMs（大型语言模型）", "keep+explain", "high", "abbreviation"),
    ("LitLLMs", "LitLLMs", "keep", "high", "name"),
    ("Literature Review", "文献综述", "translate", "high", "concept"),
    ("Literature review", "文献综述", "translate", "high", "section_heading"),
    ("Introduction", "引言", "translate", "high", "section_heading"),
    ("Large Language Model", "大型语言模型", "translate", "high", "concept"),
    ("Large Language Models", "大型语言模型", "translate", "high", "concept"),
    ("Human-Centered AI", "以人为本人工智能", "translate", "high", "concept"),
    ("AI sovereignty", "人工智能主权", "translate", "high", "policy_term"),
    ("Research and Development", "研究与开发", "contextual", "medium", "section_title"),
    ("Hong Kong Polytechnic University", "香港理工大学", "translate", "high", "organization"),
    ("AI Index", "人工智能指数（AI Index）", "first_bilingual", "high", "publication"),
    ("textbase", "文本库", "translate", "medium", "discourse_term"),
    ("Sub-corpus", "子语料库", "translate", "medium", "table_header"),
    ("Number of texts", "文本数量", "translate", "medium", "table_header"),
    ("Competing interests", "竞争利益声明", "translate", "medium", "section_title"),
    ("Retrieval-Augmented Generation", "检索增强生成", "translate", "high", "concept"),
    ("RAG", "RAG（检索增强生成）", "keep+explain", "high", "abbreviation"),
)
# Candidates that are never terms, whatever their case, and how section headings begin.
STOP_TERMS = ("Abstract", "Conclusion", "References", "Related Work", "The", "This", "These", "Figure", "Table")
SECTION_PREFIXES = ("Abstract ", "Introduction ", "Conclusion ", "References ", "Keywords ")
#: Characters of a text that are looked through, beside its title, abstract and keywords.
SCOPE_CHARS = 6000


def term_scope(c: Column) -> Column:
    """What terms are looked for in: the title, the abstract, the keywords, and the text's beginning."""
    body = T.text(c)
    title = F.regexp_extract(body, r"(?:^|\n)[# \t\r]*([^\s#][^\n]*?)[# \t\r]*(?:\n|\z)", 1)
    abstract = F.regexp_extract(body, r"(?is)(?:^|\n)\s*(?:#+\s*)?abstract\s*\n(.*?)(?:\n\s*(?:#+\s*)?(?:introduction|1\.|keywords?)\b|\z)", 1)
    keywords = F.regexp_extract(body, r"(?im)^Keywords?\s*[:：]\s*(.+)$", 1)
    return F.concat_ws("\n", title, abstract, keywords, F.substring(body, 1, SCOPE_CHARS))


def candidate_terms(docs: DataFrame, max_terms: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, kind, n, translation, action, confidence, term_type, rank``: the terms of each document.

    The most frequent of each kind are kept, ties to the first seen; then known terms that occur, whatever their number.
    Phrases of over six words, low-value ones, section headings and parts of known terms are left out. Known terms come
    first, then the others by letter, up to ``max_terms``.
    """
    spark = docs.sparkSession
    scoped = docs.select(F.col(id_col).alias("doc_id"), term_scope(F.col(text_col)).alias("text"))
    counts = occurrences(scoped).groupBy("doc_id", "kind", "term").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = F.create_map(*[F.lit(x) for i, (k, _, _) in enumerate(CANDIDATES) for x in (k, i + 1)])
    most = F.create_map(*[F.lit(x) for k, _, m in CANDIDATES for x in (k, m)])
    placed = counts.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy(F.desc("n"), "first"))).where(F.col("place") <= most[F.col("kind")])
    placed = placed.where((F.col("kind") != "phrase") | (F.size(F.split("term", r"\s+")) <= 6)).withColumn("term", T.term_body(F.col("term")))
    known = F.col("term").isin(*[t for t, *_ in KNOWN_TERMS])
    prefixed = F.lit(False)
    for p in SECTION_PREFIXES:
        prefixed = prefixed | F.col("term").startswith(p)
    good = (F.length("term") >= 2) & ~F.lower("term").isin(*[t.lower() for t in STOP_TERMS]) & (known | (T.low_value_reason(F.col("term")) == "")) & ~prefixed & ~F.col("term").rlike(r"\b[A-Z]{2,}s?\s+for\s+")
    found = placed.where(good).select("doc_id", "term", "kind", "n", order[F.col("kind")].alias("o"), "place")
    # A constant pattern for each, behind a cheap test; the names' own marks are escaped by quoting them whole.
    shown = lambda t: F.col("text").contains(t) & F.col("text").rlike(rf"(?<![A-Za-z0-9])\Q{t}\E(?![A-Za-z0-9])")
    listed = F.array(*[F.when(shown(t), F.struct(F.lit(t).alias("term"), F.lit(i).alias("place"))) for i, (t, *_) in enumerate(KNOWN_TERMS)])
    present = scoped.select("doc_id", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.term", F.lit("known").alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(9).alias("o"), "x.place")
    once = found.unionByName(present).groupBy("doc_id", "term").agg(F.min_by(F.struct("kind", "n", "o", "place"), F.struct("o", "place")).alias("k"), F.max((F.col("kind") == "known").cast("int")).alias("is_known"))
    names = present.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("term").alias("_known"))
    kept = once.join(names, F.col("doc_id") == F.col("_d"), "left").where((F.col("is_known") == 1) | ~F.coalesce(F.exists("_known", lambda x: x.contains(F.col("term"))), F.lit(False)))
    table = spark.createDataFrame(list(KNOWN_TERMS), "_term string, translation string, action string, confidence string, _type string")
    told = kept.join(F.broadcast(table), (F.col("term") == F.col("_term")) & (F.col("is_known") == 1), "left")
    out = told.select("doc_id", "term", "k.kind", "k.n", T.text("translation").alias("translation"), F.coalesce("action", F.lit("decide")).alias("action"), F.coalesce("confidence", F.lit("medium")).alias("confidence"), F.coalesce("_type", T.term_type(F.col("term"))).alias("term_type"), F.col("is_known"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("is_known"), F.lower("term"), "term"))).where(F.col("rank") <= max_terms).drop("is_known")


def merge_layers(layers: list[DataFrame], key: str, fields: list[str], names: list[str]) -> DataFrame:
    """``key``, each field's last non-empty value by layer, and ``policy_source``, the layers that hold the key."""
    stacked = reduce(DataFrame.unionByName, [x.select(F.col(key), *[F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in fields], F.lit(i).alias("_layer"), F.lit(n).alias("_name")) for i, (x, n) in enumerate(zip(layers, names, strict=True))])
    last = [F.coalesce(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_layer"))), F.lit("")).alias(f) for f in fields]
    out = stacked.groupBy(key).agg(*last, F.array_sort(F.collect_set(F.struct("_layer", "_name"))).alias("_from"))
    return out.select(key, *fields, F.array_join(F.transform("_from", lambda x: x["_name"]), "+").alias("policy_source"))


def alternatives(expected: Column) -> Column:
    """An expected translation whole, what its brackets hold, and what stands before them."""
    inside = F.regexp_extract(expected, "[（(]([^）)]+)[）)]", 1)
    before = F.trim(F.regexp_extract(expected, "^([^（(]*)[（(]", 1))
    return F.filter(F.array(expected, F.trim(inside), before), lambda x: x != "")


def term_hits(blocks: DataFrame, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``doc_id, block_id, pos, term`` for terms that a block contains.

    Terms of one plain word meet blocks by an equi-join on words; only the others, phrases and symbols, are tested
    against every block, so their table has to be small enough to broadcast, which Spark checks by its size.
    """
    plain = terms.where(F.col(term_col).rlike("^[A-Za-z0-9]+$")).select(F.col(term_col).alias("term"))
    rest = terms.where(~F.col(term_col).rlike("^[A-Za-z0-9]+$") & (F.col(term_col) != "")).select(F.col(term_col).alias("term"))
    words = blocks.select("doc_id", "block_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all(T.text("text"), F.lit("([A-Za-z0-9]+)"), 1))).alias("word"))
    by_word = words.join(plain, F.col("word") == F.col("term")).select("doc_id", "block_id", "pos", "term")
    by_scan = blocks.join(small(rest), T.contains_term(F.col("text"), F.col("term"))).select("doc_id", "block_id", "pos", "term")
    return by_word.unionByName(by_scan)


def first_seen(blocks: DataFrame, terms: DataFrame, term_col: str = "term") -> DataFrame:
    return term_hits(blocks, terms, term_col).groupBy("doc_id", "term").agg(F.min_by("block_id", "pos").alias("first_seen_block"))


def affected_blocks(blocks: DataFrame, terms: DataFrame, term_col: str = "term") -> DataFrame:
    return term_hits(blocks, terms, term_col).groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def check_policies(pairs: DataFrame, policies: DataFrame) -> DataFrame:
    """Issues of ``pairs`` (block_id, source, translation) against ``policies`` (term, expected, action, forbidden).

    A forbidden wording is high and hides the rest; a missing expected wording is medium; a term without one is low,
    but terms to keep are content with the source wording.
    """
    met = pairs.join(small(policies), T.contains_term(F.col("source"), F.col("term")))
    forbidden = F.exists(F.coalesce("forbidden", F.array().cast("array<string>")), lambda w: (w != "") & T.text("translation").contains(w))
    found = F.exists(alternatives(T.text("expected")), lambda w: T.text("translation").contains(w))
    kept = T.text("action").startswith("keep") & T.contains_term(F.col("translation"), F.col("term"))
    severity = F.when(forbidden, "high").when(T.text("expected") == "", F.when(kept, None).otherwise("low")).when(~found & ~kept, "medium")
    title = F.when(severity == "high", "forbidden wording").when(severity == "low", "no expected wording").otherwise("expected wording missing")
    return met.withColumn("severity", severity).where("severity is not null").select("block_id", "term", "severity", title.alias("title"))


# Words of a translation that must go, that may stay, and that need a policy.
MUST_TRANSLATE = ("sub-corpus", "number", "texts", "tokens", "mean", "length", "translation", "profile", "dimensions", "continuing")
MAY_STAY = ("abstract", "references", "doi", "url", "http", "https", "et", "al", "openai", "latextrans")
NEED_POLICY = ("caption", "captions", "environment", "environments", "eqnarray", "gpt-academic", "pdflatex", "pylatexenc", "subsection", "textbf")
RESIDUE_WORD = r"(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z-]{2,}(?![\p{L}\p{N}_])"


def english_residue(docs: DataFrame, protected: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, bucket, words``: ASCII words left in a translation that must go, may stay, or need a policy, each once,
    in their order; short words in small letters count for nothing.

    A word may stay if it is protected (value) or known to, if it begins like a name, or next to an address: links within
    48 characters, an at sign within 32 after or 16 before it and no CJK between. Words within a term (term) need a
    policy; they meet terms on their first three letters.
    """
    pieces = F.split(T.text(text_col), RESIDUE_WORD)
    words = F.regexp_extract_all(T.text(text_col), F.lit(RESIDUE_WORD), 0)
    laid = docs.select(F.col(id_col).alias("doc_id"), words.alias("w"), pieces.alias("g"))
    # Text and words in turn. A word has three characters and stands apart, so twelve pairs on either side are enough.
    turns = F.flatten(F.zip_with("g", F.concat("w", F.array(F.lit(""))), lambda g, w: F.array(g, w)))
    near = lambda i, n: F.array_join(F.slice("t", F.greatest(F.lit(1), 2 * i - 23), F.least(2 * i + 1, F.lit(25))), "")
    after = lambda i: F.array_join(F.slice("t", 2 * i + 3, 25), "")
    at = laid.withColumn("t", turns).select("doc_id", F.explode(F.transform("w", lambda w, i: F.struct(i.alias("at"), w.alias("word"), near(i, 0).alias("before"), after(i).alias("after")))).alias("x")).select("doc_id", "x.*")
    low = F.lower("word")
    ends, begins = F.left("after", F.lit(32)), F.right("before", F.lit(16))
    around = F.lower(F.concat(F.right("before", F.lit(48)), "word", F.left("after", F.lit(48))))
    address = (ends.contains("@") & ~F.substring_index(ends, "@", 1).rlike(f"[{T.CJK}]")) | (begins.contains("@") & ~F.substring_index(begins, "@", -1).rlike(f"[{T.CJK}]")) | around.rlike(r"https?://|www\.|github\.com|gitlab\.com|doi\.org") | (F.col("word").contains("-") & around.contains("bitbucket.org"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))
    held = terms.select(F.lower("term").alias("_t")).where(F.length("_t") >= 3).distinct()
    keyed = held.select("_t", F.explode(F.array_distinct(grams(F.col("_t")))).alias("_g"))
    distinct = at.select(low.alias("_w")).distinct()
    within = distinct.join(keyed, F.substring("_w", 1, 3) == F.col("_g")).where(F.col("_t").contains(F.col("_w"))).select("_w").distinct().withColumn("_in", F.lit(True))
    kept = protected.select(F.col("value").alias("_v")).distinct()
    met = at.join(within, low == F.col("_w"), "left").join(kept, F.col("word") == F.col("_v"), "left")
    bucket = (
        F.when(low.isin(*MUST_TRANSLATE), "must_translate")
        .when(F.col("_v").isNotNull() | low.isin(*MAY_STAY) | address, "allowed_keep")
        .when(low.isin(*NEED_POLICY) | F.coalesce("_in", F.lit(False)), "needs_term_policy")
        .when(F.col("word").rlike("^[A-Z]"), "allowed_keep")
        .when(F.length("word") >= 8, "must_translate")
    )
    once = met.withColumn("bucket", bucket).where("bucket is not null").groupBy("doc_id", "bucket", "word").agg(F.min("at").alias("at"))
    return once.groupBy("doc_id", "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))


# What a source says, and what its translation must not lose.
DRIFT_RULES = (
    ("negation_lost", r"(?i)\b(?:not|never|no longer|cannot)\b", "[不没未无非否]", False),
    ("hedge_lost", r"(?i)\b(?:may|might|could|possibly|perhaps)\b", "可能|也许|或许|可以", False),
    ("cause_added", r"(?i)\b(?:associated with|correlat\w+)\b", "导致|造成|引起", True),
    ("significance_lost", r"(?i)\bsignificant(?:ly)?\b", "显著|明显|重大", False),
    ("comparison_lost", r"(?i)\b(?:more|less|higher|lower|better|worse) than\b", "比|高于|低于|优于|差于|超过", False),
    ("limitation_lost", r"(?i)\blimitations?\b", "局限|限制|不足", False),
    ("only_lost", r"(?i)\bonly\b", "仅|只|唯", False),
)


def check_drift(pairs: DataFrame) -> DataFrame:
    """``block_id, rule`` where the source matches a rule and the target lacks, or wrongly has, its counterpart."""
    found = F.array(*[F.when(T.text("source").rlike(s) & (T.text("translation").rlike(t) if wrong else ~T.text("translation").rlike(t)), F.lit(name)) for name, s, t, wrong in DRIFT_RULES])
    return pairs.where(T.has_cjk(F.col("translation"))).select("block_id", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def check_quantities(pairs: DataFrame) -> DataFrame:
    a, b = T.percentages(F.col("source")), T.percentages(F.col("translation"))
    out = pairs.select("block_id", F.array_except(a, b).alias("missing"), F.array_except(b, a).alias("added"))
    return out.where((F.size("missing") > 0) | (F.size("added") > 0))


def check_protected(pairs: DataFrame, spans: DataFrame, strict: tuple[str, ...] = ("url", "doi", "citation", "inline_math", "latex_command", "inline_code")) -> DataFrame:
    """Protected values that a block's translation lost: ``block_id, kind, value, severity``."""
    met = spans.where(F.col("kind").isin(*strict)).join(pairs, "block_id", "left")
    lost = met.where(~T.protected_present(F.col("value"), T.text("translation")))
    return lost.select("block_id", "kind", "value", F.when(F.col("kind").isin("url", "doi", "citation"), "high").otherwise("medium").alias("severity"))


# A pattern of the source, the wording that its translation must not have, the severity, and the term.
BAD_ACRONYMS = ((r"\bLLMs?\b", "法学硕士", "high", "LLM"), ("Literature Review", "文学评论", "medium", "Literature Review"))


def check_acronyms(pairs: DataFrame) -> DataFrame:
    """``block_id, severity, term`` where an abbreviation or term took a wording that other fields use."""
    found = F.array(*[F.when(T.text("source").rlike(s) & T.text("translation").contains(t), F.struct(F.lit(level).alias("severity"), F.lit(term).alias("term"))) for s, t, level, term in BAD_ACRONYMS])
    return pairs.select("block_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("block_id", "x.severity", "x.term")


def restore_protected(pairs: DataFrame, lost: DataFrame) -> DataFrame:
    add = lost.groupBy("block_id").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("_add"))
    return pairs.join(add, "block_id", "left").withColumn("translation", F.concat_ws(" ", F.nullif(T.text("translation"), F.lit("")), "_add")).drop("_add")


def check_sections(source: DataFrame, target: DataFrame) -> DataFrame:
    count = F.regexp_count(T.text("text"), F.lit(r"(?m)^#{1,6}\s+\S"))
    met = source.select("doc_id", count.alias("n")).join(target.select("doc_id", count.alias("m")), "doc_id")
    return met.where((F.col("n") >= 3) & (F.col("m") < F.greatest(F.lit(1), F.floor(F.col("n") / 2))))


def upsert(base: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with non-empty edits over it, and rows that only the edits have."""
    e = edits.select(F.col(key).alias("_k"), *[F.nullif(F.col(f), F.lit("")).alias(f"_{f}") for f in fields])
    out = base.join(e, F.col(key) == F.col("_k"), "full_outer")
    return out.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_{f}", f).alias(f) for f in fields])
