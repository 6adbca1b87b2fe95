"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base kinds (email, ip, card, phone) are fixed patterns with fixed checks; their spans always stand. Further candidates
come from wider patterns (written-out addresses, grouped identity numbers, credentials). Three labelers vote on every
candidate, base ones too, or abstain:

* regex: does the value have the strict form of its kind?
* gazetteer: is its lead or ending on a list (top-level domains, dialling and card prefixes, credential prefixes)?
* context: does one of the kind's cue words stand shortly before it, and after the match before it?

Candidates are counted by vote pattern: kind, three votes, and two shape features with three values each. The table of
patterns has at most ``len(KINDS) * 27 * 9`` rows whatever the corpus, so the driver can hold it: there
expectation-maximisation estimates each labeler's hit and false-alarm rates and each kind's share of true spans, and a
logistic span classifier is trained on votes and shape against the posteriors. The classifier's verdict on each pattern
then goes back as a literal map, and further candidates are kept where it says so.

Patterns are written with possessive repeats and run-start guards, so they find what the plain patterns find, in time
linear in the text and without deep recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, temporary

BASE = ("email", "ip", "card", "phone")
FURTHER = ("mailto", "idnum", "secret")
KINDS = BASE + FURTHER

#: Where a run of the class may start a match: where the last match ended, or at the run's start.
_RUN = r"(?:\G|(?<![%s]))"

# Patterns of the base kinds, equal in effect to those asked for.
PATTERNS = {
    "email": _RUN % "A-Za-z0-9._%+-" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN % "0-9" + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "mailto": _RUN % "A-Za-z0-9._+-" + r"[A-Za-z0-9._+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "idnum": r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]{0,64}[0-9])(?=[0-9_]{0,64}[A-Za-z])[A-Za-z0-9_]{16,128}(?![A-Za-z0-9_])",
}
# Cheap tests that every text with a match passes.
HINTS = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'",
    "card": r"text rlike '[0-9](?:[ -]?[0-9]){12}'",
    "phone": "contains(text, '+')",
    "mailto": r"text rlike '[\\[(](?:at|AT)[\\])]'",
    "idnum": r"text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
    "secret": r"text rlike '[A-Za-z0-9_]{16}' and text rlike '[0-9]'",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\\.)++[A-Za-z]{2,}$",
    "ip": r"^(?:[1-9][0-9]{0,2})(?:\\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{15,16}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    "mailto": r"(?:\\.|(?i:dot)[\\])]) ?[A-Za-z]{2,}$",
    "idnum": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^(?:[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{16,}|[A-Za-z]{2,5}_[A-Za-z0-9]{16,})$",
}
# Gazetteers, as the starts or ends they put on a value.
GAZETTEER = {
    "email": r"(?i)\\.(?:com|org|net|edu|gov|io|info|co|uk|de|fr|es|it|nl|eu|us|ca|au|jp|cn|in|br|example|test)$",
    "ip": r"^(?:10\\.|127\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "mailto": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "idnum": r"^(?:[0-8])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]|sk_|pk_|rk_|glpat)",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|send|reply|cc|from)\\W*\\w*\\W*$",
    "ip": r"(?i)(?:\\bip\\b|host|server|address|login|client)\\W*\\w*\\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|pay)\\W*\\w*\\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp)\\W*\\w*\\W*$",
    "mailto": r"(?i)(?:mail|contact|write|send|reply)\\W*\\w*\\W*$",
    "idnum": r"(?i)(?:ssn|social|security|tax|ident|\\bid\\b)\\W*\\w*\\W*$",
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|key|auth|bearer|credential)\\W*\\w*\\W*$",
}
CONTEXT_CHARS = 32
KEEP_FROM = 0.5


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _found(kind: str) -> tuple[str, str]:
    """All matches of a kind in ``text``, and the texts before, between and after them; both empty without its hint."""
    p = _quoted(PATTERNS[kind])
    none = "cast(array() as array<string>)"
    there = f"text is not null and {HINTS[kind]}"
    return f"case when {there} then regexp_extract_all(text, '{p}', 0) else {none} end", f"case when {there} then split(text, '{p}', -1) else {none} end"


def _running(of: str, step: str) -> str:
    """Running totals of an array of longs; ``step`` says how a total a takes up an element x.

    A fold that appends to one array would copy it for every element, so elements are taken in runs of about the root
    of their number: first the total before each run, then the totals within it.
    """
    run = f"cast(ceil(sqrt(size({of}))) as int)"
    before = f"aggregate(slice({of}, 1, k * {run}), 0L, (a, x) -> {step.format(a='a')})"
    within = f"(r, x) -> struct({step.format(a='r.at')} as at, concat(r.made, array({step.format(a='r.at')})) as made)"
    none = "cast(array() as array<bigint>)"
    runs = f"transform(sequence(0, cast((size({of}) - 1) / {run} as int)), k -> aggregate(slice({of}, k * {run} + 1, {run}), struct({before} as at, {none} as made), {within}, r -> r.made))"
    return f"case when size({of}) = 0 then {none} else flatten({runs}) end"


SUM, MOST = "{a} + x", "greatest({a}, x)"


def _luhn(d: str) -> str:
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + case when (length({d}) - i) % 2 = 0 then cast(substr({d}, i, 1) as int) else 2 * cast(substr({d}, i, 1) as int) - if(substr({d}, i, 1) > '4', 9, 0) end) % 10 = 0"


_VALID = {
    "email": "true",
    "ip": "forall(split(m.v, '[.]'), p -> coalesce(try_cast(p as bigint) <= 255, false))",
    "card": "case when length(regexp_replace(m.v, '[^0-9]', '')) between 13 and 19 then " + _luhn("regexp_replace(m.v, '[^0-9]', '')") + " else false end",
    "phone": "length(regexp_replace(m.v, '[^0-9]', '')) between 9 and 15",
    "mailto": "true",
    "idnum": "true",
    "secret": "true",
}


def _vote(kind: str) -> str:
    """The pattern of a candidate m: kind, votes (1, 0, or - for none), length and digit shape."""
    return f"""concat('{kind}:', if(m.v rlike '{STRICT[kind]}', '1', '0'), if(m.v rlike '{GAZETTEER[kind]}', '1', '-'), if(m.c rlike '{CONTEXT[kind]}', '1', '-'),
        ':', case when length(m.v) < 12 then 's' when length(m.v) < 20 then 'm' else 'l' end,
        case when length(regexp_replace(m.v, '[^0-9]', '')) * 4 < length(m.v) then 'f' when length(regexp_replace(m.v, '[^0-9]', '')) * 4 < 3 * length(m.v) then 'h' else 'd' end)"""


def candidates(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns (as ``k0``, ``k1``, ...), ``text`` and one array for each kind of structs (kind, s, e, vote)."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    # One step at a time, so that each pattern runs once for the matches and once for what lies between.
    for k in KINDS:
        values, gaps = _found(k)
        rows = rows.withColumns({f"_v_{k}": F.expr(values), f"_g_{k}": F.expr(gaps)})
    rows = rows.withColumns({f"_n_{k}": F.expr(f"transform(_v_{k}, (v, i) -> cast(length(_g_{k}[i]) + length(v) as bigint))") for k in KINDS})
    rows = rows.withColumns({f"_e_{k}": F.expr(_running(f"_n_{k}", SUM)) for k in KINDS})
    rows = rows.withColumns({f"_{k}": F.expr(f"transform(_e_{k}, (e, i) -> struct(e - length(_v_{k}[i]) as s, e as e, _v_{k}[i] as v, right(_g_{k}[i], {CONTEXT_CHARS}) as c))") for k in KINDS})
    found = {k: F.expr(f"transform(filter(_{k}, m -> {_VALID[k]}), m -> struct('{k}' as kind, m.s as s, m.e as e, {_vote(k)} as vote))") for k in KINDS}
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], *[c.alias(k) for k, c in found.items()])


# --- what the driver computes from counts by pattern ----------------------------------------------


def estimate(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of each pattern by expectation-maximisation over labelers that err independently given the truth."""
    share = {k: 0.9 if k in BASE else 0.5 for k in KINDS}
    # How often each labeler fires on true and on false candidates: prior counts, which also say that it beats chance.
    prior_hit, prior_alarm = ((8, 2), (5, 5), (5, 5)), ((2, 8), (1, 9), (1, 9))
    hit = {(k, j): a / (a + b) for k in KINDS for j, (a, b) in enumerate(prior_hit)}
    alarm = {(k, j): a / (a + b) for k in KINDS for j, (a, b) in enumerate(prior_alarm)}
    post: dict[str, float] = {}
    for _ in range(rounds):
        for p in counts:
            kind, votes, _ = p.split(":")
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for j, v in enumerate(votes):
                h, a = hit[kind, j], alarm[kind, j]
                yes += math.log(h if v == "1" else 1 - h)
                no += math.log(a if v == "1" else 1 - a)
            post[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        for kind in {p.split(":")[0] for p in counts}:
            own = [p for p in counts if p.split(":")[0] == kind]
            total = sum(counts[p] for p in own)
            true = sum(counts[p] * post[p] for p in own)
            share[kind] = min(0.98, max(0.02, (true + 1) / (total + 2)))
            for j in range(3):
                fired = [p for p in own if p.split(":")[1][j] == "1"]
                (a, b), (c, d) = prior_hit[j], prior_alarm[j]
                hit[kind, j] = (sum(counts[p] * post[p] for p in fired) + a) / (true + a + b)
                alarm[kind, j] = (sum(counts[p] * (1 - post[p]) for p in fired) + c) / (total - true + c + d)
    return post


def _features(pattern: str) -> list[str]:
    kind, votes, shape = pattern.split(":")
    return ["bias", f"kind {kind}", f"regex {votes[0]}", f"gazetteer {votes[1]}", f"context {votes[2]}", f"{kind} length {shape[0]}", f"{kind} digits {shape[1]}", f"{kind} votes {votes}"]


def classify(counts: dict[str, int], steps: int = 1500, rate: float = 1.0, decay: float = 1e-4) -> dict[str, float]:
    """Probability of each pattern by a logistic classifier trained on the posteriors, patterns weighed by counts."""
    post = estimate(counts)
    total = sum(math.log1p(n) for n in counts.values())
    weight: dict[str, float] = {}
    names = {p: _features(p) for p in counts}

    def score(p: str) -> float:
        z = sum(weight.get(f, 0.0) for f in names[p])
        return 1 / (1 + math.exp(max(-50.0, min(50.0, -z))))

    for _ in range(steps):
        step: dict[str, float] = {}
        for p, n in counts.items():
            g = (post[p] - score(p)) * math.log1p(n) / total
            for f in names[p]:
                step[f] = step.get(f, 0.0) + g
        for f, g in step.items():
            weight[f] = weight.get(f, 0.0) * (1 - decay) + rate * len(KINDS) * g
    return {p: score(p) for p in counts}


def verdicts(found: DataFrame) -> dict[str, float]:
    """Probability of each pattern that occurs in ``found``; the table it collects is bounded by the pattern space."""
    votes = found.select(F.explode(F.concat(*[F.transform(k, lambda m: m["vote"]) for k in KINDS])).alias("vote")).groupBy("vote").agg(F.count("*").alias("n"))
    return classify({r["vote"]: r["n"] for r in votes.orderBy("vote").collect()})


def _spans(chances: dict[str, float]) -> Column:
    """All spans that stand, by kind as listed, then start."""
    kept = [p for p, c in chances.items() if c >= KEEP_FROM and p.split(":")[0] in FURTHER]
    listed = F.array(*[F.lit(p) for p in kept]) if kept else F.expr("cast(array() as array<string>)")
    further = F.filter(F.concat(*FURTHER), lambda m: F.array_contains(listed, m["vote"]))
    return F.concat(*BASE, further)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def find_personal_data(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_further, n_spans``, one row for each row of ``docs``.

    Null and empty texts have no spans: counts 0, the SHA-256 of the empty string, and an empty ``spans``. Offsets
    count code points, end exclusive. The counts and the hash cover base spans; ``spans`` adds those of the further
    kinds that the classifier keeps. Repeated rows give equal rows. Other columns are ignored, whatever their names.
    """
    slim = materialize(spark, candidates(docs, text_col, (id_col,)).drop("text"), "spans")
    spans = _spans(verdicts(slim))
    base = F.concat(*BASE)
    return slim.select(F.col("k0").cast("long").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_written(base), 256).alias("base_sha256"), _written(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_further"), F.size(spans).cast("long").alias("n_spans"))


#: Characters of a piece that a text is cut into when spans are replaced in it.
PIECE = 1024


def _between(start: str, end: str) -> str:
    """The text from ``start`` to ``end`` (longs, code points), put together from ``_pieces``."""
    p, q = f"cast({start} div {PIECE} as int)", f"cast({end} div {PIECE} as int)"
    a, z = f"cast({start} % {PIECE} as int)", f"cast({end} % {PIECE} as int)"
    head, tail = f"coalesce(get(_pieces, {p}), '')", f"coalesce(get(_pieces, {q}), '')"
    return f"if({p} = {q}, substring({head}, {a} + 1, {z} - {a}), concat(substring({head}, {a} + 1), array_join(slice(_pieces, {p} + 2, {q} - {p} - 1), ''), substring({tail}, 1, {z})))"


def redacted(spark: SparkSession, docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans by that of the first. ``chars_col`` follows.

    Rows without spans come back as they were, null texts too.
    """
    columns = docs.columns
    with temporary(spark):
        chances = verdicts(materialize(spark, candidates(docs, text_col).drop("text"), "votes"))
    found = candidates(docs, text_col, tuple(columns))
    ordered = F.array_sort(F.transform(_spans(chances), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["kind"].alias("kind"))))
    out = found.withColumn("_ordered", ordered).withColumn("_ends", F.transform("_ordered", lambda m: m["e"])).withColumn("_most", F.expr(_running("_ends", MOST)))
    # What lies between is taken from pieces of the text, so that no span reads the text from its beginning.
    out = out.withColumn("_pieces", F.expr(f"case when size(_ordered) > 0 then regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0) end"))
    before = "if(i = 0, 0L, _most[i - 1])"
    made = F.expr(f"""array_join(transform(_ordered, (m, i) -> if(m.s < {before}, '', concat({_between(before, "m.s")}, '[', upper(m.kind), ']'))), '')""")
    out = out.withColumn("_new", F.when(F.size("_ordered") > 0, F.concat(made, F.expr(_between("element_at(_most, -1)", "cast(length(text) as bigint)")))).otherwise(F.col("text")))
    pick = []
    for i, c in enumerate(columns):
        if c == text_col:
            pick.append(F.col("_new").alias(c))
        elif c == chars_col and dict(docs.dtypes)[c] in ("int", "bigint"):
            pick.append(F.when(F.size("_ordered") > 0, F.length("_new").cast(dict(docs.dtypes)[c])).otherwise(F.col(f"k{i}")).alias(c))
        else:
            pick.append(F.col(f"k{i}").alias(c))
    return out.select(*pick)
