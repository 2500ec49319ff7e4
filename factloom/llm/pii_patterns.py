"""Personal data: base patterns, and identifiers found by their contexts.

Base patterns give the seeds.  Around each seed the words of its context make
lexical patterns (the word or two words before it, two after it, the one on
either side, and what is attached to it), and every number-like or
address-like token of the corpus is an instance, whether a base pattern takes it
or not.  On the graph of patterns and distinct instances scores go back and
forth, ``ROUNDS`` times:

* a pattern's confidence for a kind is the mean score of its instances
  (``LEAST`` known ones at least, one unknown added), so an instance of another
  kind, a year or a price speaks against it;
* an instance's score for a kind that its form allows is one minus the product
  of the doubts of its trusted patterns (confidence of ``TRUST`` or more), and
  counts from ``ACCEPT`` on; what a base pattern takes scores 1.

What is accepted in the end is a span wherever the token stands in a document
without touching a base span.  An instance is its digits (or its lower-cased
text), so a number seen once as +1 (743) 555-3824 and once without its sign is
known in both contexts.

Built-in expressions only.  A match of a base pattern stays inside a run of
words with a digit or an @ that single blanks, brackets, dots and dashes join;
runs are cut out once, with their offsets, and all further patterns see runs
only.  The patterns are the contract's with possessive repeats and look-behinds
that change no match: they keep long words and numbers linear.  Joins on
patterns and instances are salted on both sides.

Defined results: a null text is empty and has no spans; repeated rows of an id
each get a row (and speak once: instances and patterns are distinct); a null id
is an id like others; base spans of two kinds may overlap, added ones overlap
nothing; of several kinds the one with the higher score is added, ties as
listed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
LEAST, TRUST, ACCEPT = 3, 0.75, 0.75
SALTS = 8
#: Code points of context kept on either side of a run.
CONTEXT = 64

_S = r"\x20\x09-\x0D"
_CHUNK = rf"[^{_S}0-9@]*+[0-9@][^{_S}]*+"
#: Words with a digit or an @, and those that only brackets, dots and dashes stand between.
RUN = rf"(?<![^{_S}]){_CHUNK}(?:\x20[\x20().-]*+{_CHUNK})*+"

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Tokens of a run: addresses with an @, colon-separated hexadecimals, numbers with separators, other words.
TOKEN = (
    r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
    r"|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"
    r"|(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[\x20().\x2F-]{0,3}[0-9])*+(?![A-Za-z0-9])"
    rf"|[^{_S}]++"
)
_DIGITS = "length(regexp_replace({x}, '[^0-9]', ''))"
#: Which kinds the form of a token allows.
FORMS = {
    "email": r"{x} RLIKE '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*$'",
    "ip": r"({x} RLIKE '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$' OR {x} RLIKE '^([0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}$' AND {x} RLIKE '[0-9A-Fa-f]{{2}}')",
    "card": rf"({{x}} RLIKE '^[0-9][0-9\\x20.\\x2F-]+$' AND {_DIGITS} BETWEEN 12 AND 19)",
    "phone": rf"({{x}} RLIKE '^[+(]*[0-9][0-9\\x20().\\x2F-]+$' AND {_DIGITS} BETWEEN 7 AND 15)",
}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_RUNNING = "aggregate({xs}, named_struct('s', 0L, 'a', CAST(array() AS ARRAY<BIGINT>)), (a, x) -> named_struct('s', a.s + x, 'a', concat(a.a, array(a.s))), a -> a.a)"


def _offsets(lengths: str) -> str:
    """Sums of the lengths before each; in blocks of 512, so that long arrays aren't copied as often as they are long."""
    blocks = f"transform(sequence(0, greatest(0, (size({lengths}) - 1) DIV 512)), b -> slice({lengths}, b * 512 + 1, 512))"
    sums = _RUNNING.format(xs="transform(bs, b -> aggregate(b, 0L, (t, x) -> t + x))")
    inner = _RUNNING.format(xs="b")
    return f"transform(array({blocks}), bs -> transform(array({sums}), os -> flatten(transform(bs, (b, j) -> transform({inner}, y -> y + os[j]))))[0])[0]"


def matches(text: str, pattern: str, fields: str) -> str:
    """SQL of an array of structs, one for each match: ``fields`` may use m (the match), at (code points before it), before and after (texts on either side)."""
    gaps, found = f"split({text}, {_sql(pattern)}, -1)", f"regexp_extract_all({text}, {_sql(pattern)}, 0)"
    # each gap with the match after it has one length, so the sums start each gap
    lengths = "transform(gs, (g, i) -> CAST(length(g) + coalesce(length(get(ms, i)), 0) AS BIGINT))"
    whole = f"transform(array({lengths}), ls -> transform(array({_offsets('ls')}), os -> transform(ms, (m, i) -> transform(array(struct(gs[i] AS before, gs[i + 1] AS after, os[i] + length(gs[i]) AS at)), w -> {fields})[0]))[0])[0]"
    return f"transform(array({gaps}), gs -> transform(array({found}), ms -> CASE WHEN size(ms) = 0 THEN array() ELSE {whole} END)[0])[0]"


_LUHN = "aggregate(sequence(1, length(d)), 0, (t, k) -> t + CASE WHEN k % 2 = 1 THEN CAST(substr(d, k, 1) AS INT) ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), CAST(substr(d, k, 1) AS INT) + 1) END) % 10 = 0"
_SOUND = {
    "email": "true",
    "ip": f"s.m RLIKE {_sql(f'^{_OCTET}([.]{_OCTET}){{3}}$')}",
    "card": f"transform(array(reverse(regexp_replace(s.m, '[^0-9]', ''))), d -> length(d) BETWEEN 12 AND 19 AND {_LUHN})[0]",
    "phone": f"{_DIGITS.format(x='s.m')} BETWEEN 9 AND 15",
}


def _base_of(run: str, at: str) -> str:
    """Base spans (start, kind, end) of a run that begins at ``at``."""
    each = []
    for k, kind in enumerate(KINDS):
        all_of = matches(run, BASE[kind], "struct(w.at AS at, m AS m)")
        each.append(f"CASE WHEN {run} RLIKE {_sql(BASE[kind])} THEN transform(filter({all_of}, s -> {_SOUND[kind]}), s -> named_struct('start', CAST({at} + s.at AS BIGINT), 'kind', {k}, 'end', CAST({at} + s.at + length(s.m) AS BIGINT))) ELSE array() END")
    return f"concat({', '.join(each)})"


def found_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, runs (at, run, before, after), base (start, kind, end): one row for each document row."""
    whole = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    fields = f"named_struct('at', CAST(w.at AS BIGINT), 'run', m, 'before', right(w.before, {CONTEXT}), 'after', left(w.after, {CONTEXT}))"
    # most texts have no digit and no @: one quick look, then the runs
    runs = F.expr(f"CASE WHEN _text RLIKE '[0-9@]' THEN {matches('_text', RUN, fields)} ELSE array() END")
    cut = materialise(whole.select(F.monotonically_increasing_id().alias("row"), "doc_id", runs.alias("runs")), "runs")
    runs = cut.withColumn("runs", F.expr(f"transform(runs, r -> named_struct('at', r.at, 'run', r.run, 'before', r.before, 'after', r.after, 'base', {_base_of('r.run', 'r.at')}))"))
    return runs.withColumn("base", F.expr("flatten(transform(runs, r -> r.base))"))


def _words(text: str) -> str:
    """Words in lower case, digits as 0."""
    return f"filter(split(lower(regexp_replace({text}, '[0-9]+', '0')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"


def candidates(found: DataFrame) -> DataFrame:
    """row, start, end, value, known (bits of base kinds), fits (bits of kinds that the form allows), patterns."""
    # no base span leaves its run
    each = found.select("row", F.explode("runs").alias("r")).withColumn("base", F.col("r.base"))
    tokens = each.select("row", "base", "r", F.explode(F.expr(matches("r.run", TOKEN, "struct(w.at AS at, m AS m)"))).alias("t"))
    spans = tokens.select(
        "row",
        (F.col("r.at") + F.col("t.at")).cast("long").alias("start"),
        (F.col("r.at") + F.col("t.at") + F.length("t.m")).cast("long").alias("end"),
        F.col("t.m").alias("token"),
        F.expr(f"concat(r.before, substr(r.run, greatest(CAST(t.at AS INT) - {CONTEXT} + 1, 1), least(CAST(t.at AS INT), {CONTEXT})))").alias("before"),
        F.expr(f"concat(substr(r.run, CAST(t.at AS INT) + length(t.m) + 1, {CONTEXT}), r.after)").alias("after"),
        "base",
    )
    touched = "aggregate(filter(base, b -> b.start < end AND b.end > start), 0, (a, b) -> a | shiftleft(1, b.kind))"
    number = "token RLIKE '^[+(]*[0-9][0-9\\\\x20().\\\\x2F-]*$' AND NOT token RLIKE '^[0-9]+([.][0-9]+)+$'"
    fits = " + ".join(f"CASE WHEN {form.format(x='token')} THEN {1 << k} ELSE 0 END" for k, form in enumerate(FORMS[kind] for kind in KINDS))
    made = spans.select(
        "row",
        "start",
        "end",
        F.expr(f"CASE WHEN {number} THEN regexp_replace(token, '[^0-9]', '') ELSE lower(token) END").alias("value"),
        F.expr(touched).alias("known"),
        F.expr(fits).alias("fits"),
        F.expr(_words(f"right(before, {CONTEXT})")).alias("l"),
        F.expr(_words(f"left(after, {CONTEXT})")).alias("r"),
        F.expr("regexp_extract(before, '[^\\\\x20\\\\x09-\\\\x0D0-9]+$', 0)").alias("attached"),
    )
    patterns = [
        "CASE WHEN size(l) > 0 THEN concat('L1 ', element_at(l, -1)) END",
        "CASE WHEN size(l) > 1 THEN concat('L2 ', element_at(l, -2), ' ', element_at(l, -1)) END",
        "CASE WHEN size(r) > 1 THEN concat('R2 ', r[0], ' ', r[1]) END",
        "CASE WHEN size(l) > 0 AND size(r) > 0 THEN concat('LR ', element_at(l, -1), ' ', r[0]) END",
        "CASE WHEN attached <> '' THEN concat('A ', lower(attached)) END",
    ]
    return made.select("row", "start", "end", "value", "known", "fits", F.expr(f"filter(array({', '.join(patterns)}), p -> p IS NOT NULL)").alias("patterns"))


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _copied(df: DataFrame) -> DataFrame:
    """The small side of a salted join, once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _bits(name: str) -> Column:
    return F.expr(f"filter(sequence(0, {len(KINDS) - 1}), k -> ({name} & shiftleft(1, k)) <> 0)")


def bootstrap(tokens: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(value, kind, score) of accepted instances that no base pattern takes, and (pattern, kind, confidence) of trusted patterns."""
    # distinct links; a frequent pattern or instance is pre-aggregated here
    links = materialise(tokens.select("value", "known", "fits", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.bit_or("known").alias("known"), F.bit_or("fits").alias("fits")), "links")
    values = links.groupBy("value").agg(F.bit_or("known").alias("known"), F.bit_or("fits").alias("fits"))
    seeds = materialise(values.where("known <> 0").select("value", F.explode(_bits("known")).alias("kind"), F.lit(1.0).alias("score")), "seeds")
    sizes = materialise(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "sizes")
    open_links = links.where("fits <> 0 AND known = 0").select("pattern", "value", F.explode(_bits("fits")).alias("kind"))
    scores, trusted = seeds, None
    for k in range(rounds):
        held = _salted(links.select("pattern", "value"), "pattern").join(_copied(scores), ["value", "salt"])
        sums = held.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("known")).where(F.col("known") >= LEAST)
        trusted = sums.join(sizes, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + 1)).where(F.col("confidence") >= TRUST)
        trusted = materialise(trusted.select("pattern", "kind", "confidence"), f"trusted{k}")
        met = _salted(open_links, "value").join(_copied(trusted), ["pattern", "kind", "salt"])
        gained = met.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= ACCEPT)
        # a value that is known elsewhere is a seed already
        gained = materialise(gained.join(seeds.select("value").distinct(), "value", "left_anti"), f"gained{k}")
        scores = seeds.unionByName(gained.select("value", "kind", "score"))
    return gained, trusted


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, base and added: sorted arrays of (start, kind, end)."""
    found = materialise(found_runs(docs, id_col, text_col), "found")
    tokens = materialise(candidates(found), "tokens")
    gained, _ = bootstrap(tokens, rounds)
    known = tokens.where("known <> 0").groupBy("value").agg(F.bit_or("known").alias("bits"))
    taken = gained.select("value", "kind", "score").unionByName(known.select("value", F.explode(_bits("bits")).alias("kind"), F.lit(1.0).alias("score")))
    # one kind for each value; kinds come as listed, so the least of the best is first
    best = taken.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("b")).select("value", (-F.col("b.kind")).alias("kind"))
    free = tokens.where("known = 0 AND fits <> 0").select("row", "start", "end", "value", "fits")
    spans = _salted(free, "row").join(_copied(best), ["value", "salt"]).where("(fits & shiftleft(1, kind)) <> 0")
    added = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    return (
        found.select("row", "doc_id", F.array_sort("base").alias("base"))
        .join(added, "row", "left")
        .withColumn("added", F.coalesce("added", F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind: INT, end: BIGINT>>)")))
    )


def _told(spans: str) -> str:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), n_added."""
    found = extract(docs, id_col, text_col)
    counts = [F.expr(f"CAST(size(filter(base, b -> b.kind = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({_told('base')}, 256)").alias("base_sha256"),
        F.expr(_told("array_sort(concat(base, added))")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )

