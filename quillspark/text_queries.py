"""Queries of the text functions: each calls one function for every row of a table, on made texts that reach its branches
and, where both engines' patterns agree on them, on the table's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions import unicode as U
from .operators import quality, rewrites, routing, terms
from .registry import cases, cases_sql, picked, picked_sql, query, quoted, table
from .sources import readers

# --- SQL forms of small helpers -------------------------------------------------------------------


def q(pattern: str) -> str:
    return quoted(pattern)


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def collapsed(x: str) -> str:
    return f"trim({sub(f'coalesce({x}, {q(chr(0)[:0])})', r'\s+', ' ')})"


def normal(x: str) -> str:
    return f"lower({collapsed(sub(f'coalesce({x}, {q(chr(0)[:0])})', '<[^>]+>', ' '))})"


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def words(x: str, least: int = 2) -> str:
    """ASCII words with inner hyphens; made texts have no hyphen next to a letter beyond ASCII."""
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: ltrim(w, '-')), lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z-]{{{least - 1},}}'))"


CJK = "[\\x{4e00}-\\x{9fff}]"


def english(x: str) -> str:
    prose = r"(?i)(?:^|[^A-Za-z0-9_])(?:the|this|that|these|those|we|our|agent|agents|method|methods|model|models|task|tasks|learn|learning|memory|performance|trajectory|trajectories)(?:[^A-Za-z0-9_]|$)"
    return f"({n_of(x, '[A-Za-z]')} >= 18 AND ({has(x, prose)} OR {has(x, r'[A-Za-z]{4,}(?:[\s,;:()\\/-]+[A-Za-z]{4,}){3,}')}))"


def shown(x: str) -> str:
    """Whether a line may stay as it is."""
    s, n = collapsed(x), normal(x)
    person = r"^(?:[A-Z][A-Za-z'’.-]+|[A-Z]{2,})(?:\s+(?:and\s+)?(?:[A-Z][A-Za-z'’.-]+|[A-Z]{2,})){0,7}$"
    patterns = (r"(?i)^(?:https?://\S+|\S+@\S+)$", r"(?i)\barxiv\s*:\s*\d{4}\.\d{4,5}v?\d*\b", r"\b\d{4}\.\d{4,5}v\d+\s*\[[^\]]+\]\s*\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}\b", person, T.INSTITUTIONS, r"^[A-Z][A-Za-z0-9-]*(?:[,;/\s]+[A-Z][A-Za-z0-9-]*)*$")
    return f"({s} = '' OR {' OR '.join(has(s, p) for p in patterns)} OR {n} IN ('base', 'model', 'environment', 'expert', 'memory', 'skill', 'skills', 'evolution'))"

# --- made texts -------------------------------------------------------------------------------------

MIXED = (
    "The model improves memory performance on 95.5% of tasks (see Table 2).",
    "我们提出了一种方法 with LLMs and 12 ％ 提升",
    "",
    "   ",
    None,
    "https://example.org/a?b=1",
    "AI",
    "GPT-4o",
    "[1, 2; 3]",
    "`code_x` {v1} %s",
    "ST: 你好，世界。",
    "Contact me@site.org or visit www.site.org today",
    "This sentence has many words; four longer words following here.",
    "<style id='1'>Hello {v2} world</style>",
    "arXiv:2301.01234v2 [cs.CL] 5 Jan 2023",
    "University of California",
    "<b>Bold</b> AND <i>it</i>",
    "12.5 % and 7% and 12.5%",
    "John Smith and Mary-Ann O'Neil",
    "We need to translate this",
    "以下是根据您的要求",
    "model",
    "Alpha, Beta; Gamma/Delta",
    "42",
    "\\textbf{only}",
)


_COUNTED = tuple(t for t in MIXED if t != "GPT-4o")  # a word that a hyphen and a digit end has no plain form in SQL


@query(f"""SELECT doc_id, {n_of("coalesce(s, '')", CJK)} AS cjk, coalesce({has("s", CJK)}, false) AS has_cjk, len({words("coalesce(s, '')")}) AS n_words, array_to_string({words("coalesce(s, '')", 4)}, '|') AS long_words FROM {cases_sql("documents", "doc_id", _COUNTED)}""")
def character_counts(spark, sf_dir):
    c, s = cases(spark, sf_dir, "documents", "doc_id", _COUNTED), F.col("s")
    return c.select("doc_id", T.cjk_count(s).cast("long").alias("cjk"), T.has_cjk(s).alias("has_cjk"), F.size(T.ascii_words(s)).cast("long").alias("n_words"), F.array_join(T.ascii_words(s, 4), "|").alias("long_words"))


_TERM_LIST = ("AI", "the", "C++", "世界", "a b", "", "LLM", "x-1", "Table")
_BODIES = ("The AI model", "AIR and OPENAI", "see (AI).", "use C++ here", "你好，世界。", "a b c", "LLMs or LLM-based", "ax-1", "x-1!", "Table 2", "tables", None)


@query(f"""SELECT doc_id, (t <> '') AND CASE WHEN regexp_matches(t, '^[A-Za-z0-9+-]+$') THEN regexp_matches(coalesce(s, ''), '(^|[^A-Za-z0-9])' || regexp_escape(t) || '([^A-Za-z0-9]|$)') ELSE contains(coalesce(s, ''), t) END AS found FROM {cases_sql("documents", "doc_id", _BODIES, _TERM_LIST)}""")
def term_in_text(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _BODIES, _TERM_LIST).select("doc_id", T.contains_term(F.col("s"), F.col("t")).alias("found"))


_WIDE = ("ＡＢＣ１２３", "ﬁne ﬂow oﬀer", "１２％ up", "plain", "ｘ＝２", "x²", None)
_FOLD = "replace(replace(replace(replace(translate(coalesce({}, ''), 'ＡＢＣ１２３％ｘ＝', 'ABC123%x='), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '²', '2')"


@query(f"""WITH n AS (SELECT doc_id, {_FOLD.format("s")} AS folded, {_FOLD.format("t")} AS term FROM {cases_sql("documents", "doc_id", _WIDE, ("ABC123", "ｆine", "１２％", "x", "x=2"))})
SELECT doc_id, folded, term <> '' AND CASE WHEN regexp_matches(replace(term, 'ｆ', 'f'), '^[A-Za-z0-9+-]+$') THEN regexp_matches(folded, '(^|[^A-Za-z0-9])' || regexp_escape(replace(term, 'ｆ', 'f')) || '([^A-Za-z0-9]|$)') ELSE contains(folded, replace(term, 'ｆ', 'f')) END AS found FROM n""")
def compatible_forms(spark, sf_dir):
    c = cases(spark, sf_dir, "documents", "doc_id", _WIDE, ("ABC123", "ｆine", "１２％", "x", "x=2"))
    return c.select("doc_id", U.nfkc(F.col("s")).alias("folded"), U.contains_term(F.col("s"), F.col("t")).alias("found"))


_BROKEN = ("the ﬁrst ﬂow", "trans-\nlation of long-\nterm", "Anglo-\nSaxon and AI-\nbased", "T\nhe start, of it", "eﬃcient baﬄe oﬀ", "plain text", "A \n  few, words here\nnext", None)


@query(f"""WITH a AS (SELECT doc_id, coalesce(s, '') AS s FROM {cases_sql("documents", "doc_id", _BROKEN)}),
b AS (SELECT doc_id, {n_of("s", "[ﬀ-ﬄ]")} AS ligatures, replace(replace(replace(replace(replace(s, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') AS s FROM a),
c AS (SELECT *, {n_of("s", r"\b[A-Za-z]+-\n[A-Za-z]+\b")} AS broken, {sub(sub(sub("s", r"\b([A-Za-z]+)-\n([A-Z][A-Za-z]*)\b", r"\1-\2"), r"\b(AI|NMT|LLM|SMT)-\n([A-Za-z]+)\b", r"\1-\2"), r"\b([A-Za-z]+)-\n([A-Za-z]+)\b", r"\1\2")} AS joined FROM b)
SELECT doc_id, ligatures, broken, {n_of("joined", r"(?m)^[ \t]*([A-Z])[ \t]*\n([ \t]*)([a-z][A-Za-z,;:)][^\n]*?)[ \t]*$")} AS caps, {sub("joined", r"(?m)^[ \t]*([A-Z])[ \t]*\n([ \t]*)([a-z][A-Za-z,;:)][^\n]*?)[ \t]*$", r"\2\1\3")} AS text FROM c""")
def extraction_repair(spark, sf_dir):
    r = T.repair_extraction(F.col("s"))
    return cases(spark, sf_dir, "documents", "doc_id", _BROKEN).select("doc_id", r["ligature_replacements"].cast("long").alias("ligatures"), r["hyphenated_line_break_repairs"].cast("long").alias("broken"), r["drop_cap_line_break_repairs"].cast("long").alias("caps"), r["text"].alias("text"))


_ELEMENTS = ("# Title", "```\ncode\n```", "| a | b |", "$$x$$", "\\begin{align}x\\end{align}", "Figure 3: a", "fig. 2 b", "Table 1", "Introduction", "Results of it", "resultsx", "plain", "  ### deep", "", None, "|", "\\[x\\]", "Proceedings of the Conference on Things", "# one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen")
_ELEMENT_SQL = f"""CASE WHEN starts_with(s, '```') THEN 'code' WHEN {has("s", r"^#{1,6}\s+\S+")} OR {has("s", r"(?i)^(?:abstract|introduction|related work|methodology|methods|experiments|results|discussion|conclusion|references)(?:[^\p{L}\p{N}_]|$)")} THEN 'heading'
 WHEN starts_with(s, '|') AND ends_with(s, '|') THEN 'table' WHEN starts_with(s, '$$') OR starts_with(s, '\\[') OR starts_with(s, '\\begin{{equation') OR starts_with(s, '\\begin{{align') THEN 'equation' WHEN {has("s", r"(?i)^(?:figure|fig\.|table)\s+\d+")} THEN 'caption' ELSE 'paragraph' END""".replace("\\\\", "\\")


@query(f"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(s, ''), '^\\s+|\\s+$', '', 'g') AS s FROM {cases_sql("documents", "doc_id", _ELEMENTS)}), b AS (SELECT *, {_ELEMENT_SQL} AS kind, trim({sub(collapsed("s"), "^[# ]+")}) AS body FROM a)
SELECT doc_id, kind, kind = 'heading' AND body <> '' AND (len(string_split(body, ' ')) > 14 OR regexp_matches(lower(body), '^(?:proceedings of|transactions of|journal of|copyright|published by)')) AS abnormal FROM b""")
def element_types(spark, sf_dir):
    kind = T.element_type(F.col("s"))
    return cases(spark, sf_dir, "documents", "doc_id", _ELEMENTS).select("doc_id", kind.alias("kind"), T.abnormal_heading(kind, F.col("s")).alias("abnormal"))


_TERMS = ("LLM", "LLMs", "GPT4", "BabelDoc", "Journal of Tests", "University of X", "memory", "In this paper", "the model", "model of", "of it", "Competing interests", "Number of texts", "Sub-corpus Number", "Proceedings of the", "Nature Machine Journal of the", " (LLMs and) ", "", None, "Deep Learning", "using GPT", "GPT with", "Big Data for")


@query(f"""WITH a AS (SELECT doc_id, coalesce(s, '') AS s, {sub(collapsed("s"), r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$")} AS b FROM {cases_sql("documents", "doc_id", _TERMS)}), w AS (SELECT *, string_split(lower(b), ' ') AS w FROM a)
SELECT doc_id, CASE WHEN regexp_full_match(s, '[A-Z][A-Z0-9]+s?') THEN 'abbreviation' WHEN regexp_full_match(s, '[A-Z][A-Za-z]+[A-Z][A-Za-z0-9]*') THEN 'name' WHEN regexp_matches(lower(s), 'journal|proceedings|conference|workshop|transactions') THEN 'publication' WHEN regexp_matches(lower(s), 'university|institute|laboratory|department') THEN 'organization' ELSE 'concept' END AS term_type,
 CASE WHEN b = '' THEN 'empty' WHEN lower(b) IN ('proceedings of the','in the','gpt with','llms and','llm and','sub-corpus number','number of texts','competing interests','the paper','this paper','in this paper') THEN 'stop_phrase'
  WHEN w[1] IN ('the','this','these','in','on','for','with','using') OR w[-1] IN ('and','or','with','of','the','in','for','to') THEN 'function_word_boundary'
  WHEN len(w) <= 2 AND list_has_any(w, ['the','this','these','in','on','for','with','using','and','or','of','to']) THEN 'short_function_phrase'
  WHEN regexp_full_match(b, '(?:[A-Z][a-z]+\\s+){{0,2}}(?:Proceedings|Transactions|Journal|Conference|Workshop)\\s+of\\s+the') THEN 'publication_fragment' ELSE '' END AS reason FROM w""")
def term_kinds(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _TERMS).select("doc_id", T.term_type(F.col("s")).alias("term_type"), T.low_value_reason(F.col("s")).alias("reason"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(replace(coalesce(s, ''), '％', '%'), '\\d+(?:\\.\\d+)?\\s*%'), lambda p: regexp_replace(p, '\\s+', '', 'g')))), '|') AS percents FROM {cases_sql("documents", "doc_id", (*MIXED, "3 % 10%, 3%", "0.5％和 99.9 ％"))}""")
def percent_values(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", (*MIXED, "3 % 10%, 3%", "0.5％和 99.9 ％")).select("doc_id", F.array_join(F.array_sort(T.percentages(F.col("s"))), "|").alias("percents"))


_VALUES = ("\\href{https://a.org}{a}", "\\url{https://a.org/x\\_y}", "doi: 10.1/ab.", "a\\textunderscore{}b", "x\\slash{}y", "50\\%", "\\{v1\\}", "a_b", "", None, "plain, text;")
_BODY = ("see https://a.org here", "https://a.org/x_y", "10.1/ab", "ab", "x/y and more", "50 %", "{v1}", "ab c", "nothing", None, "plain, text;")


def _protected(x: str) -> str:
    # The form's own word border before "doi" is the start, or any character that is no letter, digit or underscore.
    out = sub(sub(sub(sub(f"coalesce({x}, '')", r"\\href\{([^{}]*)\}\{([^{}]*)\}", r"\1"), r"\\url\{([^{}]*)\}", r"\1"), r"\\textunderscore(?:\{\})?", "_"), r"\\slash(?:\{\})?", "/")
    out = sub(sub(out, r"\\{1,2}([_%&#$])|\\([{}])", r"\1\2"), r"(?i)(^|[^A-Za-z0-9_])doi\s*:\s*", r"\1")
    return sub(sub(out, r"\s+"), r"[.,;:]+$")


@query(f"""WITH a AS (SELECT doc_id, coalesce(s, '') AS s, coalesce(t, '') AS t, {_protected("s")} AS v, {_protected("t")} AS b FROM {cases_sql("documents", "doc_id", _VALUES, _BODY[1:] + _BODY[:1] + _BODY)})
SELECT doc_id, v AS form, v = '' OR contains(t, s) OR contains(b, v) OR (contains(v, '_') AND replace(v, '_', '') <> '' AND contains(replace(b, '_', ''), replace(v, '_', ''))) AS present FROM a""")
def protected_values(spark, sf_dir):
    c = cases(spark, sf_dir, "documents", "doc_id", _VALUES, _BODY[1:] + _BODY[:1] + _BODY)
    return c.select("doc_id", T.protected_form(F.col("s")).alias("form"), T.protected_present(F.col("s"), F.col("t")).alias("present"))


_SIDE = r"^(?:ST|TT)\s*[:：]\s*[\x{4e00}-\x{9fff}，。、“”‘’；：？！（）《》\s]+$"
_NAMES = r"(?i)^(?:AI|LLMs?|LLM(?:-[A-Za-z0-9]+)?|GPT(?:-?\d+(?:\.\d+)?[A-Za-z]*)?|ChatGPT(?:-?\d+(?:\.\d+)?[A-Za-z]*)?|OpenAI(?:\s+o?\d+[A-Za-z]*)?|Claude(?:\s+\d+(?:\.\d+)?)?|DeepSeek(?:-[A-Za-z0-9]+)?|LaTeX|TeX|PDF|API)$"


def _passes(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    rest = t
    for p in (r"(?i)</?style\b[^>]*>", r"(?i)https?://\S+|www\.\S+", r"\b\d{2}\.\d{4,9}/[-._;()/:A-Za-z0-9]+", r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\{v\d+\}|\{[A-Za-z_][A-Za-z0-9_]*\}|%\d*\$?[sd]|%\w", r"\[[\d,\s;:-]+\]", r"`[^`]*`", r"\\[A-Za-z]+(?:\{[^{}]*\})?"):
        rest = sub(rest, p, " ")
    return f"({t} = '' OR {has(t, _NAMES)} OR {has(t, _SIDE)} OR NOT {has(rest, '[A-Za-z]')})"


def _needs(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return f"({t} <> '' AND NOT {_passes(x)} AND NOT {has(t, _SIDE)} AND ({has(t, '[A-Za-z]')} OR NOT {has(t, CJK)}))"


def _same(x: str, y: str) -> str:
    return f"({collapsed(x)} <> '' AND {collapsed(y)} <> '' AND ({collapsed(x)} = {collapsed(y)} OR ({_needs(x)} AND NOT coalesce({has(y, CJK)}, false))))"


def _visible(x: str) -> str:
    return collapsed(sub(sub(f"coalesce({x}, '')", r"(?i)</?style\b[^>]*>", " "), r"\{v\d+\}", " "))


@query(f"SELECT doc_id, {_passes('s')} AS passes, {_needs('s')} AS needs FROM {cases_sql('documents', 'doc_id', MIXED)}")
def translation_need(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", MIXED).select("doc_id", T.passthrough_only(F.col("s")).alias("passes"), T.needs_translation(F.col("s")).alias("needs"))


_OUTPUTS = ("模型在任务上提升了性能", "我们提出了一种方法 with LLMs and 12 ％ 提升", "x", "", "这里", "https://example.org/a?b=1", "人工智能", "GPT-4o ", "[1, 2; 3]", None, "ST: 你好", "Contact me@site.org or  visit www.site.org today", "这个句子 has many words")


@query(f"SELECT doc_id, {_same('s', 't')} AS same FROM {cases_sql('documents', 'doc_id', MIXED, _OUTPUTS)}")
def same_as_source(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", MIXED, _OUTPUTS).select("doc_id", T.same_as_input(F.col("s"), F.col("t")).alias("same"))


_LONG = "The quick agent learns from many previous trajectories while keeping every useful memory inside the shared store of experience. Another sentence follows with several longer words about learning systems and their general performance across tasks."
_SOURCES = (_LONG, _LONG + " " + _LONG + " " + _LONG, "short text only", _LONG + " 中文")
_HALVES = ("译文 " + _LONG.split(". ")[0] + ". 其余已译", _LONG + " " + _LONG + " " + _LONG, "全部已经翻译成中文", "The quick agent learns", _LONG)


def _partial(x: str, y: str) -> str:
    s, o = _visible(x), _visible(y)
    sentences = f"string_split(regexp_replace({s}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""({_needs(x)} AND len({words(s, 4)}) >= 18 AND ((len({words(s, 4)}) >= 80 AND len({words(o, 4)}) >= floor(len({words(s, 4)}) * 0.55) AND {n_of(o, CJK)} < floor(len({words(s, 4)}) * 0.75))
      OR len(list_filter({sentences}, lambda z: length(z) >= 100 AND len({words("z", 4)}) >= 14 AND contains({o}, trim(z)))) > 0))"""


@query(f"SELECT doc_id, {_partial('s', 't')} AS partial FROM {cases_sql('documents', 'doc_id', _SOURCES, _HALVES)}")
def partly_untranslated(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _SOURCES, _HALVES).select("doc_id", T.partially_untranslated(F.col("s"), F.col("t")).alias("partial"))


@query(f"SELECT doc_id, {shown('s')} AS protected FROM {cases_sql('documents', 'doc_id', MIXED)}")
def protected_lines(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", MIXED).select("doc_id", T.protected_visible(F.col("s")).alias("protected"))


_REFERENCES = ("Smith, J. (2019) Journal of X. https://a.org Miller, K. 2020 Jones, P. 2021, 2022 and 2023", "see [12] and Smith et al. (2020)", "as in \\cite{a}", "Figure 3 shows", "plain words", "doi 10.1/x", "Proceedings 2001 2002 2003 2004 2005 Press doi Conference Journal", None, "20011 2002", "table of 5")


@query(f"""WITH a AS (SELECT doc_id, coalesce(s, '') AS s FROM {cases_sql("documents", "doc_id", _REFERENCES)})
SELECT doc_id, {has("s", r"(?i)\b(?:doi|arxiv)\b|\\(?:cite|ref)|\[\d+\]|[A-Z][a-z]+(?:\s+et\s+al\.?)?\s*\(\d{4}\)|\b(?:figure|table)\s+\d+")} AS context,
 len(list_filter(regexp_extract_all(s, '\\d+'), lambda x: regexp_full_match(x, '(?:19|20)\\d{{2}}'))) >= 5 AND {n_of("s", "(?i)https?://|doi")} >= 1 AND ({n_of("s", r"[A-Z][a-z]+,\s+[A-Z]\.")} >= 3 OR {n_of("s", "(?i)journal|proceedings|conference|transactions|press")} >= 3) AS page FROM a""")
def reference_texts(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _REFERENCES).select("doc_id", T.reference_context(F.col("s")).alias("context"), T.reference_page(F.col("s")).alias("page"))


_HEADINGS = ("1 Introduction", "## 2.3 Related Work ..... 12", "<b>iv.</b> Results", "Appendix  A", "3. Methods 7", None, "2.1.4 Deep Part 103")


@query(f"""SELECT doc_id, trim({sub(sub(normal("s"), r"^(?:#+\s*)?(?:\d+(?:\.\d+)*\.?|[ivx]+\.)\s+"), r"[\s.]+\d{1,3}$")}) AS body, regexp_extract({collapsed("s")}, '^(?:#+\\s*)?(\\d+(?:\\.\\d+)*)', 1) AS number FROM {cases_sql("documents", "doc_id", _HEADINGS)}""")
def heading_forms(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _HEADINGS).select("doc_id", T.heading_body(F.col("s")).alias("body"), T.heading_number(F.col("s")).alias("number"))


@query(f"""WITH a AS (SELECT doc_id, coalesce(s, '') AS s FROM {cases_sql("documents", "doc_id", MIXED)}), n AS (SELECT doc_id, {n_of("s", CJK)} AS c, {n_of("s", r"\s")} AS b, {n_of("s", "[A-Za-z0-9]")} AS w, {n_of("s", r"[\x21-\x7e]")} AS a, length(s) AS n FROM a)
SELECT doc_id, round(c * 1.0::DOUBLE + b * 0.28::DOUBLE + w * 0.55::DOUBLE + (a - w) * 0.35::DOUBLE + (n - c - b - a) * 0.8::DOUBLE, 4) AS width FROM n""")
def display_widths(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", MIXED).select("doc_id", F.round(T.display_width(F.col("s")), 4).alias("width"))


@query(f"""SELECT doc_id, CASE WHEN {n_of("coalesce(s, '')", "�")} > 0 OR {n_of("coalesce(s, '')", "[□■▯]")} >= 3 THEN 'warn' ELSE 'ok' END AS status FROM {cases_sql("documents", "doc_id", ("fine", "bad � char", "□□", "□ ■ ▯", None))}""")
def text_layers(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", ("fine", "bad � char", "□□", "□ ■ ▯", None)).select("doc_id", T.text_layer_status(F.col("s")).alias("status"))


_DATES = ("2024-02-29", "2023-02-29", "2024-13-01", " 2024-01-05 ", "2024-01-05T10:20Z", "2024-01-05T10:20:30+02:00", "2024-01-05T25:20Z", "20240105", "", None, "2024-1-5", "2024-01-05T10:20")


@query(f"""WITH a AS (SELECT doc_id, trim(coalesce(s, '')) AS s FROM {cases_sql("documents", "doc_id", _DATES)}), b AS (SELECT doc_id, s, regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS day, regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}(?::\\d{{2}})?(?:Z|[+-]\\d{{2}}:\\d{{2}})') AS full_ FROM a)
SELECT doc_id, (day AND try_cast(s AS DATE) IS NOT NULL) OR (full_ AND try_cast(substr(s, 1, 10) AS DATE) IS NOT NULL AND substr(s, 12, 2)::INT < 24 AND substr(s, 15, 2)::INT < 60) AS valid FROM b""".replace("substr(s, 12, 2)::INT", "coalesce(try_cast(substr(s, 12, 2) AS INT), 99)").replace("substr(s, 15, 2)::INT", "coalesce(try_cast(substr(s, 15, 2) AS INT), 99)"))
def iso_dates(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _DATES).select("doc_id", T.valid_iso(F.col("s")).alias("valid"))


_MARKDOWN = ("# A\nintro\n## B\nbody b\nmore\n## C\nbody c", "## B\nall of it", "## B \n### sub\ntext\n# A\nend", "## Bx\nno", None, "text ## B\nno", "## B")


@query(f"""SELECT doc_id, regexp_extract(coalesce(s, ''), '(?ms)^[ \\t]*## B[ \\t]*$\\n?(.*?)(?:^\\s*#{{1,2}}\\s+|\\z)', 1) AS body FROM {cases_sql("documents", "doc_id", _MARKDOWN)}""")
def markdown_sections(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _MARKDOWN).select("doc_id", T.sections(F.col("s"), "## B").alias("body"))


_ARXIV = ("arXiv:2301.01234v2 and  2301.01234", "see 1706.03762, , 2005.14165v4", "12301.01234", "2301.012345", "none", None, "0704.0001")


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(s, ''), '(?:^|[^\\d])(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?(?:[^\\d]|$)', 1))), '|') AS ids FROM {cases_sql("documents", "doc_id", _ARXIV)}""")
def arxiv_papers(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _ARXIV).select("doc_id", F.array_join(F.array_sort(T.arxiv_ids(F.col("s"))), "|").alias("ids"))


@query("""SELECT o_orderkey, 'order-' || substr(sha1(o_orderpriority || o_orderkey::VARCHAR), 1, 12) AS id, sha256('{"key":' || o_orderkey::VARCHAR || ',"status":"' || o_orderstatus || '"}') AS sha FROM orders""")
def stable_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.stable_id("order-", F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("id"), T.canonical_hash(status=F.col("o_orderstatus"), key=F.col("o_orderkey")).alias("sha"))


_PAGES = ("1-3,7", "9-8 , x, 2", "", None, "5", "4-4,4,1 - 2", "a-b")


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(s, ''), ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '\\d+(?:\\s*-\\s*\\d+)?')) AS p FROM {cases_sql("documents", "doc_id", _PAGES)})
SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list_transform(p, lambda x: range(least(regexp_extract(x, '^\\d+')::BIGINT, regexp_extract(x, '\\d+$')::BIGINT), greatest(regexp_extract(x, '^\\d+')::BIGINT, regexp_extract(x, '\\d+$')::BIGINT) + 1))))), ',') AS pages FROM p""")
def page_ranges(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _PAGES).select("doc_id", F.array_join(F.array_sort(T.page_selection(F.col("s"))), ",").alias("pages"))


@query(f"SELECT conv_id, turn, sha256(lower({collapsed('text')})) AS answer FROM conversations")
def answer_forms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.answer_form(F.col("text")), 256).alias("answer"))


_FEEDBACK = ("颜色太暗，第 3 页", "布局太挤 p. 12", "主按钮不像 健身感", "all fine", None, "字体和图标 P7", "第12页 深蓝")


def _feedback_sql(x: str) -> str:
    return "[" + ", ".join(f"CASE WHEN {has(x, '|'.join(ws))} THEN {q(n)} END" for n, ws in sorted(routing.FEEDBACK)) + "]"


@query(f"""SELECT doc_id, array_to_string(list_filter({_feedback_sql("coalesce(s, '')")}, lambda x: x IS NOT NULL), ',') AS dimensions, try_cast(coalesce(nullif(regexp_extract(coalesce(s, ''), '第\\s*(\\d+)\\s*页', 1), ''), nullif(regexp_extract(coalesce(s, ''), '(?i)\\bp\\.?\\s*(\\d+)', 1), '')) AS INT) AS page FROM {cases_sql("documents", "doc_id", _FEEDBACK)}""")
def feedback_notes(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _FEEDBACK).select("doc_id", F.array_join(routing.feedback_dimensions(F.col("s")), ",").alias("dimensions"), routing.feedback_page(F.col("s")).alias("page"))


_TITLES = ("Intro ..... 12", "Part 1234", "7", "none", None, "Results 103 ", "v2024")


@query(f"""SELECT doc_id, try_cast(regexp_extract({collapsed("s")}, '(?:^|[^\\d])(\\d{{1,3}})$', 1) AS INT) AS number FROM {cases_sql("documents", "doc_id", _TITLES)}""")
def toc_numbers(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _TITLES).select("doc_id", rewrites.toc_number(F.col("s")).alias("number"))


_LOGS = ("ModuleNotFoundError: No module named x", "not found: tool xelatex", "glossary api request failed", "translate timeout", "HTTP 429 api error", "latexmk: Undefined control sequence", "exit code 2", "exit code 0", None, "nothing")


@query(f"""WITH a AS (SELECT doc_id, lower(coalesce(s, '')) AS s FROM {cases_sql("documents", "doc_id", _LOGS)})
SELECT doc_id, CASE WHEN {has("s", "no module named|not found: tool")} THEN 'dependency' WHEN {has("s", "glossary.*(?:api|request)")} THEN 'glossary_api' WHEN {has("s", r"translat\w*.*(?:timeout|api)")} THEN 'translation_api' WHEN {has("s", r"api (?:error|key)|\b401\b|\b429\b")} THEN 'api'
 WHEN {has("s", "latexmk|pdflatex|undefined control sequence")} THEN 'compile' WHEN {has("s", "exit (?:code|status) [1-9]")} THEN 'process_exit' ELSE 'missing_output' END AS stage FROM a""")
def failure_stages(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _LOGS).select("doc_id", quality.failure_stage(F.col("s")).alias("stage"))


_ROLES = ("body", "doi_line", "author_line", None, "url_line", "plain text", "page_number")
_KINDS = ("protected_or_passthrough", None, "x", "already_translated_passthrough", "ordinary")
_KEPT_ROLES = "('doi_line', 'author_line', 'reference_item', 'url_line', 'page_number')"


@query(f"""SELECT doc_id, CASE WHEN {_passes("s")} OR coalesce(u, '') IN ('protected_or_passthrough', 'layout_role_passthrough', 'already_translated_passthrough') OR coalesce(t, '') IN {_KEPT_ROLES} THEN 'protect' ELSE 'translate' END AS behavior,
 CASE WHEN length({collapsed("s")}) <= 2 THEN 'cover_split_fragment' WHEN coalesce(t, '') IN {_KEPT_ROLES} THEN 'layout_role_passthrough'
  WHEN coalesce({has("s", CJK)}, false) AND NOT {english("coalesce(s, '')")} THEN 'already_translated_passthrough'
  WHEN {_passes("s")} THEN 'protected_or_passthrough' ELSE 'ordinary_same_as_input' END AS class FROM {cases_sql("documents", "doc_id", MIXED, _ROLES, _KINDS)}""")
def line_behaviors(spark, sf_dir):
    c = cases(spark, sf_dir, "documents", "doc_id", MIXED, _ROLES, _KINDS)
    return c.select("doc_id", quality.expected_behavior(F.col("s"), F.col("u"), F.col("t")).alias("behavior"), quality.passthrough_class(F.col("s"), F.col("t")).alias("class"))


_LINES = (*MIXED, "10.1234/abc.def", "DOI: 10.1234/abc", "a@b.org", "arXiv: 2301.1", "References", "3. Conclusions", "Figure 2 shows", "Table 4", "Intro ........ 7", "- item one", "(3) third", "$x$", "one two three four five six seven eight nine ten eleven", "Müller 2019 said so")
_LABELS = ("", "title", None)


@query(f"""WITH a AS (SELECT doc_id, {collapsed("s")} AS s, {normal("s")} AS n, coalesce(t, '') AS label, doc_id % 2 = 0 AS refs FROM {cases_sql("documents", "doc_id", _LINES, _LABELS)})
SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN {has("s", r"^\d{1,4}$")} THEN 'page_number' WHEN {has("s", r"(?i)^(?:https?://\S+|www\.\S+)$")} THEN 'url_line' WHEN {has("s", r"(?i)^(?:doi\s*[:.]?\s*)?(?:https?://doi\.org/)?10\.\d{4,9}/\S+$")} THEN 'doi_line' WHEN {has("s", r"^\S+@\S+\.\S+$")} THEN 'email_line'
 WHEN {has("s", r"(?i)^arxiv\s*:")} THEN 'arxiv_stamp' WHEN {has("n", r"^(?:\d+\.?\s*)?(?:references|bibliography)$")} THEN 'references_heading' WHEN refs AND {has("s", r"(?:19|20)\d{2}")} THEN 'reference_item' WHEN {has("s", r"(?i)^(?:figure|fig\.)\s*\d+")} THEN 'figure_caption' WHEN {has("s", r"(?i)^table\s*\d+")} THEN 'table_caption'
 WHEN {has("n", r"^(?:\d+(?:\.\d+)*\.?\s+)?(?:abstract|introduction|related work|methods?|methodology|experiments?|results|discussion|conclusions?)$")} THEN 'section_heading' WHEN {has("s", r"\.{4,}\s*\d+$")} THEN 'toc_row' WHEN {has("s", r"^(?:[-•*]|\(?\d{1,2}[.)])\s+\S")} THEN 'list_item' WHEN {has("s", r"^\$|\\begin\{(?:equation|align)")} THEN 'equation'
 WHEN {shown("s")} THEN 'protected_line'
 WHEN len(string_split(s, ' ')) >= 10 THEN 'body_prose' WHEN label <> '' THEN 'labelled' ELSE 'unknown_visible_line' END AS role FROM a""")
def layout_roles(spark, sf_dir):
    c = cases(spark, sf_dir, "documents", "doc_id", _LINES, _LABELS)
    return c.select("doc_id", quality.layout_role(F.col("s"), F.col("t"), F.col("doc_id") % 2 == 0).alias("role"))


_LATEX = (
    "% a comment\nSee \\cite{a,b} and \\ref{fig:1}. % tail\n\\section{Intro} \\textbf{bold} 50\\% done",
    "\\begin{figure}\\includegraphics{x}\\caption{A figure}\\label{f}\\end{figure} after",
    "\\href{https://a.org}{site} \\url{https://b.org} \\emph{it}\n\\begin{itemize}\\item one\\item two\\end{itemize}",
    "\\subsection*{Two}\n$x+y$ and $$z$$ and \\[w\\]\n\n\n\nend",
    "\\begin{equation}a=b\\end{equation} \\paragraph{P} \\foo{bar} a\\&b\\_c\\#d",
    "plain",
    None,
)


def _latex(x: str) -> str:
    out = sub(f"coalesce({x}, '')", r"(?m)(^|[^\\\n])%[^\n]*$", r"\1")
    for p, to in (
        (r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}", r"[cite:\1]"), (r"\\(?:eq|auto|c|C|page)?ref\*?\{([^}]*)\}", r"[ref:\1]"), (r"\\href\{([^{}]*)\}\{([^{}]*)\}", r"\2 (\1)"), (r"\\url\{([^{}]*)\}", r"\1"),
        (r"\\(?:textbf|textit|emph|texttt|textsc|underline)\{([^{}]*)\}", r"\1"), (r"\\(?:sub)*section\*?\{([^{}]*)\}", "\n## \\1\n"), (r"\\paragraph\*?\{([^{}]*)\}", "\n### \\1\n"),
        (r"(?s)\\begin\{figure\*?\}.*?\\caption\{([^{}]*)\}.*?\\end\{figure\*?\}", "\n\\1\n"), (r"\\caption\{([^{}]*)\}", "\n\\1\n"), (r"\\item\b\s*", "\n- "),
        (r"(?s)\\begin\{equation\*?\}.*?\\end\{equation\*?\}|\$\$.*?\$\$|\\\[.*?\\\]", " [display_math] "), (r"\$[^$\n]+\$", "[inline_math]"), (r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", ""), (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1"), (r"\\([&%_#])", r"\1"),
    ):
        out = sub(out, p, to)
    return f"trim({sub(out, chr(92) + 'n{3,}', chr(10) * 2)})"


@query(f"SELECT doc_id, {_latex('s')} AS text FROM {cases_sql('documents', 'doc_id', _LATEX)}")
def latex_plain(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _LATEX).select("doc_id", T.latex_to_text(F.col("s")).alias("text"))


_PAPERS = ("\\title{On Things}\\begin{document}\\begin{abstract}Short.\\end{abstract}Body text\\end{document}", "\\title{No Abstract}\n\\begin{document}Only body", "no markup at all", None, "% only\n\\begin{document}x\\end{document} tail")


@query(f"""WITH a AS (SELECT doc_id, {sub("coalesce(s, '')", "(?m)%[^\\n]*$")} AS s FROM {cases_sql("documents", "doc_id", _PAPERS)}), b AS (SELECT doc_id, regexp_extract(s, '\\\\title\\s*\\{{([^{{}}]*)\\}}', 1) AS title, regexp_extract(s, '(?s)\\\\begin\\{{abstract\\}}(.*?)\\\\end\\{{abstract\\}}', 1) AS abstract,
 trim(regexp_replace(CASE WHEN contains(s, '\\begin{{document}}') THEN regexp_extract(s, '(?s)\\\\begin\\{{document\\}}(.*?)(?:\\\\end\\{{document\\}}|\\z)', 1) ELSE s END, '(?s)\\\\begin\\{{abstract\\}}.*?\\\\end\\{{abstract\\}}', '')) AS body FROM a)
SELECT doc_id, {_latex("concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN '# ' || title END, CASE WHEN abstract <> '' THEN '## Abstract' || chr(10) || trim(abstract) END, nullif(body, ''))")} AS text FROM b""")
def latex_documents(spark, sf_dir):
    return readers.latex_document(cases(spark, sf_dir, "documents", "doc_id", _PAPERS).withColumnRenamed("s", "text"))


_ANSWERS = (
    '{"output": "plain answer"}',
    '{"output": [{"type": "message", "content": " one "}, {"type": "tool", "content": "x"}, {"type": "message", "content": "two"}]}',
    '{"response": "resp"}',
    '{"choices": [{"message": {"content": "chat"}}]}',
    '{"choices": [{"message": {"content": [{"text": "a"}, {"content": "b"}]}}]}',
    '{"choices": [{"text": "legacy"}]}',
    '{"message": {"content": "msg"}}',
    '{"text": " t "}',
    "{}",
    None,
    '{"choices": [{"message": {"content": "", "reasoning_content": "why"}}]}',
)
_ANSWER_TEXTS = ("plain answer", "one\n\ntwo", "resp", "chat", "a\n\nb", "legacy", "msg", "t", None, None, "why")


def _json(path: str) -> str:
    return f"nullif(trim(json_extract_string(s, {q(path)})), '')"


@query(f"""WITH a AS (SELECT doc_id, s FROM {cases_sql("documents", "doc_id", _ANSWERS)}), b AS (SELECT *, CASE WHEN json_type(s, '$.output') = 'ARRAY' THEN array_to_string(list_transform(list_filter(from_json(json_extract(s, '$.output'), '[{{"type":"VARCHAR","content":"VARCHAR"}}]'), lambda x: x.type = 'message' AND trim(x.content) <> ''), lambda x: trim(x.content)), chr(10) || chr(10)) END AS listed,
 CASE WHEN json_type(s, '$.choices[0].message.content') = 'ARRAY' THEN array_to_string(list_transform(from_json(json_extract(s, '$.choices[0].message.content'), '[{{"text":"VARCHAR","content":"VARCHAR"}}]'), lambda x: trim(coalesce(x.text, x.content))), chr(10) || chr(10)) ELSE {_json("$.choices[0].message.content")} END AS chosen FROM a)
SELECT doc_id, coalesce(nullif(listed, ''), CASE WHEN json_type(s, '$.output') = 'VARCHAR' THEN {_json("$.output")} END, {_json("$.response")}, {_json("$.text")}, chosen, {_json("$.choices[0].text")}, {_json("$.message.content")}, {_json("$.choices[0].message.reasoning_content")}) AS text FROM b""")
def response_texts(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _ANSWERS).select("doc_id", rewrites.response_text(F.col("s")).alias("text"))


_RAW = ("<json>{\"output\": \"译好\"}</json>", "```json\n{\"translation\": \"好\"}\n```", "译文： 你好", "Translation: hi <b>x</b>", "plain", None, "{\"text\": \"t\"}", "{\"other\": 1}")


@query(f"""WITH a AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(trim(coalesce(s, '')), '^\\s*<json>|</json>\\s*$', '', 'g')), '^```(?:json)?|```$', '', 'g')) AS s FROM {cases_sql("documents", "doc_id", _RAW)}), b AS (SELECT doc_id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM a),
c AS (SELECT doc_id, CASE WHEN starts_with(s, '{{') THEN coalesce(json_extract_string(s, '$.output'), json_extract_string(s, '$.translation'), json_extract_string(s, '$.text'), s) ELSE s END AS s FROM b)
SELECT doc_id, regexp_replace(trim(regexp_replace(s, '<[^>]+>', '', 'g')), '(?i)^(?:译文|翻译|Translation|原文)\\s*[:：]\\s*', '') AS text FROM c""")
def plain_translations(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _RAW).select("doc_id", rewrites.plain_translation(F.col("s")).alias("text"))


_LISTED = ("1. 甲 2. 乙 3) 丙", "Q1: a Q2: b  Q3 ：c", "one 2、two 2.5", "无", None)
_LIST_ROLES = ("question_list", "body", "list_item", "numbered_list")


@query(f"""SELECT doc_id, CASE WHEN coalesce(t, '') IN ('question_list', 'list_item', 'numbered_list') THEN trim(regexp_replace(regexp_replace(coalesce(s, ''), '\\s+(Q[2-9]\\s*[:：.])', chr(10) || '\\1', 'g'), '\\s+([2-9][.)]\\s+)', chr(10) || '\\1', 'g')) ELSE coalesce(s, '') END AS text FROM {cases_sql("documents", "doc_id", _LISTED, _LIST_ROLES)}""")
def list_items(spark, sf_dir):
    return cases(spark, sf_dir, "documents", "doc_id", _LISTED, _LIST_ROLES).select("doc_id", rewrites.after_translation(F.col("t"), F.col("s")).alias("text"))


@query(f"""WITH a AS (SELECT o_orderkey, coalesce({picked_sql("o_orderkey", MIXED)}, '') AS source, coalesce({picked_sql("o_orderkey", _OUTPUTS)}, '') AS target FROM orders),
b AS (SELECT *, CASE WHEN contains(lower(source), 'model') THEN replace(target, '模型', '模型（model）') ELSE target END AS t1, CASE WHEN contains(lower(source), 'model') THEN (length(target) - length(replace(target, '模型', ''))) // 2 ELSE 0 END AS n1 FROM a),
c AS (SELECT *, CASE WHEN contains(lower(source), 'ai') THEN replace(t1, '人工智能', 'AI') ELSE t1 END AS t2, CASE WHEN contains(lower(source), 'ai') THEN (length(t1) - length(replace(t1, '人工智能', ''))) // 4 ELSE 0 END AS n2 FROM b)
SELECT o_orderkey, CASE WHEN contains(lower(source), 'words') THEN replace(t2, '句子', '语句') ELSE t2 END AS rewritten, n1 + n2 + CASE WHEN contains(lower(source), 'words') THEN (length(t2) - length(replace(t2, '句子', ''))) // 2 ELSE 0 END AS n_replaced FROM c""")
def dictionary_rewrites(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", picked("o_orderkey", MIXED).alias("source"), picked("o_orderkey", _OUTPUTS).alias("target"))
    d = spark.createDataFrame([(1, "model", "模型", "模型（model）"), (2, "AI", "人工智能", "AI"), (3, "words", "句子", "语句"), (4, "words", "", "x")], "pos int, term string, old string, new string")
    return rewrites.apply_dictionary(o, "source", "target", d).select("o_orderkey", "rewritten", F.col("n_replaced").cast("long"))


_DRIFT_SOURCE = ("It may not work", "X is associated with Y", "a significant and better than usual result", "the only limitation", "plain", "might improve", None)
_DRIFT_TARGET = ("它不可能工作", "X 导致 Y", "结果很好", "唯一的局限", "普通", "提高了", "Y 与 X 相关", "it works", None)


@query(f"""WITH a AS (SELECT o_orderkey AS block_id, coalesce({picked_sql("o_orderkey", _DRIFT_SOURCE)}, '') AS s, coalesce({picked_sql("o_orderkey", _DRIFT_TARGET)}, '') AS t FROM orders), r AS (
 SELECT block_id, unnest([{", ".join(f"CASE WHEN {has('s', p)} AND {'' if wrong else 'NOT '}{has('t', t)} THEN {q(n)} END" for n, p, t, wrong in terms.DRIFT_RULES)}]) AS rule FROM a WHERE {has("t", CJK)})
SELECT block_id, rule FROM r WHERE rule IS NOT NULL""")
def faithfulness_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_id"), picked("o_orderkey", _DRIFT_SOURCE).alias("source"), picked("o_orderkey", _DRIFT_TARGET).alias("translation"))
    return terms.check_drift(o)
