"""Rewrites of model output and translations, payload parsing, rule tables over pages, and scans of built pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import small
from .terms import term_hits


def apply_dictionary(rows: DataFrame, source: str, target: str, replacements: DataFrame) -> DataFrame:
    """Adds ``rewritten`` and ``n_replaced``: replacements (pos, term, old, new) in order, where the source has their term.

    The table is gathered into one row, as a dictionary that a reader of the source holds (at most ``SMALL_ROWS``
    entries, else an error); each row then folds over the entries that apply to it.
    """
    table = small(replacements).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "old", "new"))).alias("_table"))
    met = rows.crossJoin(F.broadcast(table))  # one row
    own = F.filter("_table", lambda r: F.lower(T.text(source)).contains(F.lower(r["term"])) & (r["old"] != ""))
    zero = F.struct(T.text(target).alias("t"), F.lit(0).alias("n"))

    def step(a: Column, r: Column) -> Column:
        hits = ((F.length(a["t"]) - F.length(F.replace(a["t"], r["old"], F.lit("")))) / F.length(r["old"])).cast("int")
        return F.struct(F.replace(a["t"], r["old"], r["new"]).alias("t"), (a["n"] + hits).alias("n"))

    done = F.aggregate(own, zero, step)
    return met.withColumn("_d", done).withColumn("rewritten", F.col("_d.t")).withColumn("n_replaced", F.col("_d.n")).drop("_table", "_d")


def unnest_names(c: Column, depth: int = 4) -> Column:
    """A name bracketed within its own translation twice or more becomes bracketed once."""
    out = T.text(c)
    for _ in range(depth):
        out = F.regexp_replace(out, r"([一-鿿·]{2,})（\1（([A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+)+)））", "$1（$2）")
    return out


def role_dictionary(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``direct``: the output that a dictionary (role, source, output) fixes for a line, by normal form."""
    d = dictionary.select(F.col("role").alias("_r"), T.normalize(F.col("source")).alias("_s"), F.col("output").alias("direct")).dropDuplicates(["_r", "_s"])
    return rows.join(small(d), (F.col("role") == F.col("_r")) & (T.normalize(F.col("text")) == F.col("_s")), "left").drop("_r", "_s")


def map_fragments(text: str, fragments: dict[str, str]) -> str:
    """Outputs of the fragments that a text holds, longest first, without overlap, in the order of their places."""
    taken: list[tuple[int, int, str]] = []
    low = text.lower()
    for key in sorted(fragments, key=len, reverse=True):
        at = low.find(key.lower())
        while key and at >= 0:
            if all(at + len(key) <= a or z <= at for a, z, _ in taken):
                taken.append((at, at + len(key), fragments[key]))
            at = low.find(key.lower(), at + 1)
    return " ".join(out for _, _, out in sorted(taken))


def fragment_outputs(rows: DataFrame, fragments: dict[str, str], col: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: map_fragments(t, fragments))

    return rows.withColumn("fragments", run(F.col(col)))


def after_translation(role: Column, c: Column) -> Column:
    """List items after the first begin a new line in roles that hold lists."""
    split = F.regexp_replace(F.regexp_replace(T.text(c), r"\s+(Q[2-9]\s*[:：.])", "\n$1"), r"\s+([2-9][.)]\s+)", "\n$1")
    return F.when(T.text(role).isin("question_list", "list_item", "numbered_list"), T.strip(split)).otherwise(T.text(c))


# --- model output ---------------------------------------------------------------------------------


def unwrapped(c: Column) -> Column:
    """Without json tags and code fences."""
    s = F.regexp_replace(T.strip(c), r"^<json>|</json>$", "")
    return T.strip(F.regexp_replace(T.strip(s), r"^```(?:json)?|```$", ""))


def as_json_array(raw: str | None) -> str:
    """Values that follow each other become one array; an object with an id or an output becomes an array of it."""
    s = (raw or "").strip()
    reader, at, values = json.JSONDecoder(), 0, []
    while at < len(s):
        if s[at].isspace():
            at += 1
            continue
        try:
            value, at = reader.raw_decode(s, at)
        except json.JSONDecodeError:
            return s
        values.append(value)
    if not values:
        return s
    one = values[0] if len(values) == 1 else values
    if len(values) == 1 and isinstance(one, dict) and ("id" in one or "output" in one):
        one = [one]
    return json.dumps(one, ensure_ascii=False)


def first_object(raw: str | None) -> str | None:
    """The first balanced JSON object in a text."""
    s = raw or ""
    reader = json.JSONDecoder()
    for m in re.finditer(r"\{", s):
        try:
            value, _ = reader.raw_decode(s, m.start())
        except json.JSONDecodeError:
            continue
        return json.dumps(value, ensure_ascii=False)
    return None


def input_items(prompt: str | None, marker: str = "## Here is the input:") -> str | None:
    """The JSON array after a marker, text after it allowed; null unless every item has an id and an input."""
    _, found, tail = (prompt or "").partition(marker)
    at = tail.find("[")
    if not found or at < 0:
        return None
    try:
        items, _ = json.JSONDecoder().raw_decode(tail[at:])
    except json.JSONDecodeError:
        return None
    good = isinstance(items, list) and all(isinstance(x, dict) and {"id", "input"} <= x.keys() for x in items)
    return json.dumps(items, ensure_ascii=False) if good else None


def parse_outputs(rows: DataFrame, col: str) -> DataFrame:
    """Adds ``array``, ``object`` and ``items`` of a text column, in Arrow batches."""
    def over(f):
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: f(x if isinstance(x, str) else None))

        return run

    clean = rows.withColumn("_u", unwrapped(F.col(col)))
    return clean.select(*rows.columns, over(as_json_array)("_u").alias("array"), over(first_object)("_u").alias("object"), over(input_items)(col).alias("items"))


def response_text(c: Column) -> Column:
    """Text of a model's answer, whichever of the known shapes holds it."""
    v = lambda path: F.nullif(F.trim(F.get_json_object(c, path)), F.lit(""))
    kind = "array<struct<type:string,content:string>>"
    parts = F.filter(F.from_json(F.get_json_object(c, "$.output"), kind), lambda x: (x["type"] == "message") & (F.trim(x["content"]) != ""))
    listed = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: F.trim(x["content"])), "\n\n"))
    plain = F.when(~F.coalesce(v("$.output"), F.lit("")).startswith("["), v("$.output"))
    blocks = F.from_json(F.get_json_object(c, "$.choices[0].message.content"), "array<struct<text:string,content:string>>")
    many = F.array_join(F.filter(F.transform(blocks, lambda b: F.trim(F.coalesce(b["text"], b["content"]))), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    content = v("$.choices[0].message.content")
    chosen = F.when(content.startswith("[{"), F.nullif(many, F.lit(""))).otherwise(content)
    return F.coalesce(listed, plain, v("$.response"), v("$.text"), chosen, v("$.choices[0].text"), v("$.message.content"), v("$.choices[0].message.reasoning_content"))


def plain_translation(c: Column) -> Column:
    """A translation without wrapping, tags and a leading label."""
    s = unwrapped(c)
    inner = F.coalesce(F.get_json_object(s, "$.output"), F.get_json_object(s, "$.translation"), F.get_json_object(s, "$.text"))
    body = F.when(s.startswith("{"), F.coalesce(inner, s)).otherwise(s)
    return F.regexp_replace(F.trim(F.regexp_replace(body, "<[^>]+>", "")), r"(?i)^(?:译文|翻译|Translation|原文)\s*[:：]\s*", "")


def policy_context(blocks: DataFrame, terms: DataFrame, most: int = 16, line: int = 260) -> DataFrame:
    """``block_id, context``: terms (pos, term, expected, note) as lines for a prompt, those the block holds first."""
    t = terms.select("term", "expected", F.substring(T.text("note"), 1, 120).alias("note"), F.col("pos").alias("_p"))
    hits = term_hits(blocks.select(F.lit(0).alias("doc_id"), "block_id", F.lit(0).alias("pos"), "text"), t).select("block_id", "term").distinct()
    held = hits.join(t, "term").select("block_id", "term", "expected", "note", "_p", F.lit(1).alias("_hit"))
    first = t.orderBy("_p").limit(most)  # no block needs more of the terms that it doesn't hold
    rest = blocks.select("block_id").distinct().crossJoin(F.broadcast(first)).join(hits, ["block_id", "term"], "left_anti").select("block_id", "term", "expected", "note", "_p", F.lit(0).alias("_hit"))
    ranked = held.unionByName(rest).withColumn("_n", F.row_number().over(W.partitionBy("block_id").orderBy(F.desc("_hit"), "_p"))).where(F.col("_n") <= most)
    written = F.substring(F.concat_ws(" ", F.concat(F.lit("- "), "term", F.lit(" => "), T.text("expected")), F.nullif(F.col("note"), F.lit(""))), 1, line)
    out = ranked.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("_n", written.alias("w")))).alias("b"))
    return out.select("block_id", F.array_join(F.transform("b", lambda x: x["w"]), "\n").alias("context"))


# --- rules over pages -------------------------------------------------------------------------------


def page_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, page, rule, severity``: rules (rule, severity, all_of, any_of, least, none_of) that a page's text meets.

    Rules are data: patterns that must all match, of which at least ``least`` must, and that mustn't. Rules for one
    document's layout are rows too, never code.
    """
    none = F.array().cast("array<string>")
    r = rules.select("rule", "severity", F.coalesce("all_of", none).alias("_all"), F.coalesce("any_of", none).alias("_any"), F.coalesce("least", F.lit(0)).alias("_least"), F.coalesce("none_of", none).alias("_none"))
    t = T.text("text")
    hits = F.size(F.filter("_any", lambda p: F.regexp_like(t, p)))
    ok = F.forall("_all", lambda p: F.regexp_like(t, p)) & (hits >= F.col("_least")) & ~F.exists("_none", lambda p: F.regexp_like(t, p))
    return pages.join(small(r), ok).select("doc_id", "page", "rule", "severity")


def allowed_by_profile(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines that a rule (profile, page, pattern) of their document's profile lets pass; a null page means any."""
    r = rules.select(F.col("profile").alias("_f"), F.col("page").alias("_p"), F.col("pattern").alias("_x"))
    return lines.join(small(r), (F.col("profile") == F.col("_f")) & (F.col("_p").isNull() | (F.col("page") == F.col("_p"))) & F.regexp_like(T.text("text"), F.col("_x")), "left_semi")


def flag_issues(rows: DataFrame, flags: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """``doc_id, title, severity`` for every flag (condition, severity, title) that a row raises."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity"))) for c, severity, title in flags.values()])
    return rows.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("doc_id", "i.*")


def toc_number(title: Column) -> Column:
    return F.regexp_extract(T.collapse(title), r"(?<!\d)(\d{1,3})$", 1).try_cast("int")


def toc_width(digits: Column) -> Column:
    return F.greatest(F.lit(10.0), F.least(F.lit(28.0), 5.8 * digits + 4))


def layout_id(debug: Column, layout: Column, order: Column) -> Column:
    return F.coalesce(F.nullif(debug, F.lit("")), F.nullif(layout, F.lit("")), F.format_string("order-%04d", order))


# --- scans of built pages ---------------------------------------------------------------------------


class _Attributes(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        self.found += [(k, v or "") for k, v in attrs if k.startswith("data-")]

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def page_attributes(pages: DataFrame) -> DataFrame:
    """``page_id, attributes, visible``: data attributes with their distinct values, and the visible text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, h in zip(f["page_id"], f["html"]):
                p = _Attributes()
                p.feed(h or "")
                p.close()
                have: dict[str, list[str]] = {}
                for k, v in p.found:
                    if v not in have.setdefault(k, []):
                        have[k].append(v)
                out.append((i, list(have.items()), " ".join(" ".join(p.text).split())))
            yield pd.DataFrame(out, columns=["page_id", "attributes", "visible"])

    made = pages.select("page_id", "html").mapInPandas(run, "page_id long, attributes array<struct<key:string,value:array<string>>>, visible string")
    return made.withColumn("attributes", F.map_from_entries("attributes"))


#: What a built page must not hold.
FORBIDDEN = (("unfinished", r"(?i)\b(?:TODO|FIXME)\b|demo\s*only"), ("network", r"(?i)\bfetch\s*\(|XMLHttpRequest|WebSocket|\bsrc\s*=\s*[\"']https?://"))


def scan_candidates(pages: DataFrame, locks: DataFrame, exact: dict[str, str], required: dict[str, tuple[str, ...]]) -> DataFrame:
    """``page_id, code``: attributes that aren't exactly the lock's value, required ones that lack, forbidden content,
    and a page whose hash is not the lock's."""
    none = F.array().cast("array<string>")
    met = pages.select("page_id", "html").join(page_attributes(pages), "page_id").join(locks, "page_id")
    at = lambda k: F.coalesce(F.element_at("attributes", F.lit(k)), none)
    found = [F.when(~F.coalesce(at(a) == F.array(F.col(lock)), F.lit(False)), F.lit(f"not_exact:{a}")) for a, lock in exact.items()]
    found += [F.when(F.size(F.array_except(F.array(*[F.lit(v) for v in values]), at(a))) > 0, F.lit(f"missing:{a}")) for a, values in required.items()]
    found += [F.when(F.col("html").rlike(p), F.lit(f"forbidden:{name}")) for name, p in FORBIDDEN]
    if "candidate_sha256" in locks.columns:
        found.append(F.when(F.sha2("html", 256) != F.col("candidate_sha256"), F.lit("hash_drift")))
    return met.select("page_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("code"))


def judge_evidence(rows: DataFrame, col: str, contract: tuple[str, ...]) -> DataFrame:
    """Adds ``passed`` and ``failed``: which boolean paths of a JSON column hold."""
    lost = F.filter(F.array(*[F.when(F.coalesce(F.get_json_object(col, f"$.{p}"), F.lit("false")) != "true", F.lit(p)) for p in contract]), lambda x: x.isNotNull())
    return rows.withColumn("failed", lost).withColumn("passed", F.size("failed") == 0)
