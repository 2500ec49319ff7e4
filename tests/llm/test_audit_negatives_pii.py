"""Filter audit, hard negatives and personal data against SQL and plain versions."""

import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import filter_audit, hard_negatives, pii_patterns, queries
from tests.conftest import as_set
from tests.llm.test_llm import ROWS, SCHEMA, check_sql, core, docs, empty, labels, prose  # noqa: F401

AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_matches_sql_on_odd_rows(spark, docs, labels, empty):  # noqa: F811
    more = [(20, "W" * 10 + " " + prose(250, 1), "en", ""), (21, "$ x", "en", None), (22, "$ x", "en", "a"), (22, "$ x", "en", "a"), (None, "$ x", "en", "b"), (3, "$ x", "en", "b"), (23, prose(30000, 5), "en", "b")]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA).withColumns({c: F.lit(-1) for c in docs.columns if c not in ("doc_id", "text", "lang", "source")}))
    more_labels = labels.unionByName(spark.createDataFrame([(22, 0, 1), (14, 1, None), (12, 1, 1), (22, 1, 0)], labels.schema))
    for name in ("_id", "part", "mask", "digest", "n", "cells", "s", "first", "held"):
        both, more_labels = both.withColumn(name, F.lit(-7)), more_labels.withColumn(name, F.lit(-7))
    got = filter_audit.audit(both, more_labels)
    assert got.columns == AUDIT
    check_sql(spark, "op13_filter_audit", got, {"documents": core(both), "labels": more_labels.select("doc_id", "quality", "toxic")})
    rows = got.collect()
    parts = {r.part for r in rows}
    assert parts == {"", "a", "b", "c", "z", "ü"} and len(rows) == 600 * len(parts)
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(core(docs), labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_against_loops(spark):
    """Each order applied by hand to each document; the shapley sum over all orders."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["Ab", "cd", "EF", "g#", "hi"] if k % 2 else [f"w{r.randint(0, 300)}"]) for _ in range(r.choice([3, 199, 200, 201]))) for k in range(14)]
    rows = [(i, texts[r.randrange(len(texts))], "en", r.choice("xy")) for i in range(60)]
    quality = {i: (r.randint(0, 1), r.randint(0, 1)) for i in range(0, 60, 2)}
    found = filter_audit.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, *q) for i, q in quality.items()], "doc_id long, quality int, toxic int"))
    fails, first = {}, {}
    for i, t, _, _ in rows:
        w = t.split(" ")
        first.setdefault(t, i)
        fails[i] = {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum(c.isascii() and c.isupper() for c in t) > 2 * len(t), "#" in t, first[t] < i)) if bad}
    shapley = defaultdict(int)
    want = {}
    for part in "xy":
        for order in filter_audit.ORDERS:
            left = [i for i, _, _, s in rows if s == part]
            for step, x in enumerate(order):
                out = [i for i in left if x in fails[i]]
                gone = [i for i, _, _, s in rows if s == part and i not in left]
                left = [i for i in left if i not in out]
                shapley[part, x] += len(out)
                want[part, order, step + 1] = (len(left), len(out), sum(x in fails[i] for i in gone), sum(fails[i] == {x} and s == part for i, _, _, s in rows), sum(quality.get(i, (0, 0))[0] for i in out), sum(quality.get(i, (0, 0))[1] for i in out))
    got = {(q.part, q.filter_order, q.step): q for q in found.collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        q = got[key]
        assert (q.kept, q.removed, q.redundant, q.unique_fails, q.good_lost, q.toxic_lost) == w
        assert q.shapley == shapley[q.part, q.filter_order[q.step - 1]]


def _mined(rows):
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, shift=F.col("vec_id") % 7 == 0)


def _vectors(n, width, seed, spread=0.0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=width)
    out = []
    for i in range(n):
        v = centre + r.normal(size=width)
        out.append((i * 5, [float(x) for x in v / np.linalg.norm(v) * (1 + spread * r.random())], int(r.integers(0, 10))))
    return out


def _check_negatives(spark, rows, got):
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = con.sql(hard_negatives.ORACLE)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert as_set(got.collect(), got.columns, order) == as_set(want.fetchall(), want.columns, order)


@pytest.mark.parametrize("spread,chunk,block", [(0.0, 1 << 22, 1 << 24), (30.0, 500, 2000)])
def test_hard_negatives_match_sql(spark, monkeypatch, spread, chunk, block):
    """Equal norms and widely spread ones, small chunks, and several blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "CHUNK_CELLS", chunk)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rows = _vectors(900, 8, 3, spread)
    rows += [(i, rows[4][1], 3) for i in range(5000, 5200)]  # one vector many times, ties by id
    rows += [rows[0], rows[1]]  # a repeated anchor and a repeated row
    rows += [(7001, None, 1), (7002, rows[5][1], None), (None, rows[6][1], 1), (7003, [float("nan")] * 8, 2), (7004, [float("inf")] * 8, 2), (7005, [None] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(-1), "norm": F.lit(-1), "q": F.lit(-1), "deal": F.lit(0)}).repartition(5)
    _check_negatives(spark, rows, _mined(df))


def test_hard_negatives_on_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert _mined(spark.createDataFrame([], schema)).count() == 0
    assert _mined(spark.createDataFrame([(1, [1.0], 2), (2, [1.0], 2)], schema)).count() == 0  # no anchor
    assert _mined(spark.createDataFrame([(100, [], 2), (2, [1.0], 2), (3, [], 4)], schema)).collect()[0][:4] == (100, 2, 1, 3)  # an empty vector scores 0, and 0 takes 0
    huge = [(100, [4e6] * 4, 2), (1, [3.9e6] * 4, 2), (2, [3e6] * 4, 5), (3, [1e30], 5)]  # components of 2**30 and more, beyond 53 bits
    got = {(r.negative_id, r.rank, r.negative_score) for r in _mined(spark.createDataFrame(huge, schema)).collect()}
    a = 256 * 4_000_000
    assert got == {(2, 1, 4 * a * 256 * 3_000_000), (3, 2, a * 2**31)}


def test_hard_negatives_read_no_bucket_below_every_limit(spark):
    """The least norm that can matter follows the k-th scores."""
    q = [[100, 0], [0, 50]]
    windows = hard_negatives.Windows(q, np.array([1, 2]), np.array([0, 0]), np.array([0, 1]), np.array([2000, 3000]), np.array([9000, 9000]), False, 10)
    assert 19.99 < windows.least_norm() <= 20.0


# ---- personal data

CONTRACT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(pii_patterns.KINDS):
        for m in CONTRACT[kind].finditer(text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


S = " \t-\r"
TOKEN = re.compile(pii_patterns.TOKEN.replace(r"\x2F", "/"))
RUN = re.compile(pii_patterns.RUN)


def plain_words(text):
    return [w for w in re.split("[ \t-\r]+", re.sub("[0-9]+", "0", text).lower()) if w]


def plain_added(texts, rounds=pii_patterns.ROUNDS):
    """The bootstrap as loops over one process's dicts."""
    n = pii_patterns.CONTEXT
    tokens = []
    for row, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        last = 0
        runs = list(RUN.finditer(text))
        for j, run in enumerate(runs):
            ahead = runs[j + 1].start() if j + 1 < len(runs) else len(text)
            before, after = text[last : run.start()][-n:], text[run.end() : ahead][:n]
            last = run.end()
            for m in TOKEN.finditer(run.group()):
                s, e, t = run.start() + m.start(), run.start() + m.end(), m.group()
                number = re.fullmatch(r"[+(]*[0-9][0-9 ().\-/]*", t) and not re.fullmatch(r"[0-9]+([.][0-9]+)+", t)
                d = re.sub("[^0-9]", "", t)
                fits = [bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", t)), bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", t) or re.fullmatch(r"([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}", t) and re.search("[0-9A-Fa-f]{2}", t)), bool(re.fullmatch(r"[0-9][0-9 ./\-]+", t)) and 12 <= len(d) <= 19, bool(re.fullmatch(r"[+(]*[0-9][0-9 ()./\-]+", t)) and 7 <= len(d) <= 15]
                left_text, right_text = before + run.group()[: m.start()], run.group()[m.end() :] + after
                l, r = plain_words(left_text[-n:]), plain_words(right_text[:n])
                attached = re.search("[^ \t-\r0-9]+$", left_text)
                patterns = set()
                if l:
                    patterns.add(f"L1 {l[-1]}")
                if len(l) > 1:
                    patterns.add(f"L2 {l[-2]} {l[-1]}")
                if len(r) > 1:
                    patterns.add(f"R2 {r[0]} {r[1]}")
                if l and r:
                    patterns.add(f"LR {l[-1]} {r[0]}")
                if attached:
                    patterns.add(f"A {attached.group().lower()}")
                known = {k for b, k, f in base if b < e and f > s}
                tokens.append((row, s, e, d if number else t.lower(), known, {k for k in range(4) if fits[k]}, patterns))
    links, by_pattern, seeds, open_links = set(), defaultdict(set), {}, set()
    link_known = defaultdict(set)
    link_fits = defaultdict(set)
    for _, _, _, v, known, fits, patterns in tokens:
        for p in patterns:
            links.add((p, v))
            by_pattern[p].add(v)
            link_known[p, v] |= known
            link_fits[p, v] |= fits
            for k in known:
                seeds[v, k] = 1.0
    known_values = {v for v, _ in seeds}
    scores, gained = dict(seeds), {}
    for _ in range(rounds):
        trusted = {}
        for p, vs in by_pattern.items():
            for k in range(4):
                held = [scores[v, k] for v in vs if (v, k) in scores]
                if len(held) >= pii_patterns.LEAST and sum(held) / (len(vs) + 1) >= pii_patterns.TRUST:
                    trusted[p, k] = sum(held) / (len(vs) + 1)
        doubt = defaultdict(float)
        for p, v in links:
            if not link_known[p, v]:
                for k in link_fits[p, v]:
                    if (p, k) in trusted:
                        doubt[v, k] += math.log(1 - trusted[p, k])
        gained = {key: 1 - math.exp(x) for key, x in doubt.items() if 1 - math.exp(x) >= pii_patterns.ACCEPT and key[0] not in known_values}
        scores = dict(seeds) | gained
    all_known = {(v, k): 1.0 for _, _, _, v, known, _, _ in tokens for k in known}
    best = {}
    for (v, k), s in (gained | all_known).items():
        best[v] = max(best.get(v, (-1, 0)), (s, -k))
    added = defaultdict(set)
    for row, s, e, v, known, fits, _ in tokens:
        if not known and v in best and -best[v][1] in fits:
            added[row].add((s, -best[v][1], e))
    return added


def told(spans):
    return ",".join(f"{pii_patterns.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _people():
    r = random.Random(5)
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    out = [f"{prose(9, k)} you may call me at {phone()} any day {prose(5, k + 50)}" for k in range(12)]
    out += [f"{prose(4, k)} and from host {ip()} came {prose(5, k + 70)}" for k in range(10)]
    out += ["If not, call me at 743-555-3824 any day.", "Also call me at (743) 555 9911 any time", "The order 743-555-3824 and order 12345678 were late", "seen from host fe80::1ff:fe23:4567:890a came late", "and call me at noon 12 any day", "in the year 1999 or 2001"]
    shared = phone()
    out += [f"call me at {shared} any day", f"his number is {shared[4:]} or {re.sub('[^0-9]', '', shared)}", f"{prose(3, 3)} {shared} {prose(3, 4)}"]
    return out


ODD = [
    None,
    "",
    "x" * 3000 + " 12 " + "a." * 2000 + "@" + "b-" * 2000 + " a@b.c_d@e.f a@b a@b@c.d @x.y a%b@c.d.e.",
    "😀😀 a@b.co 漢字 10.0.0.1 é 999.1.1.1 1.2.3.4.5.6.7.8 007.0.00255.1 0256.1.1.1 1..2.3.4 ٣.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 41111111111111110000000 4111  1111 1111 1111 12 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (743) 555-3824 +1+2+3456789012 +12 + 345 ( ) 6789012 . x +1234567890123456 +1\t2345678901 +12345678",
    "tel:+1.743.555.3824; mail=a.b@c.de,10.1.1.1/24 \n+1\n234567890\n",
    " ".join(str(k * 7919) for k in range(600)),
    "\n".join(f"+1 555 {k:07d}" for k in range(700)),
]


def test_personal_data_against_loops(spark):
    texts = _people() + ODD
    clash = {c: F.lit(-1) for c in ("row", "runs", "base", "added", "start", "value", "kind", "salt", "_text", "token", "n", "score")}
    rows = [(None if k == 3 else k // 2 * 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3)
    got = pii_patterns.digest(df)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    added = plain_added(texts)
    want = []
    for k, (i, t) in enumerate(rows):
        base = base_spans(t)
        counts = [sum(x[1] == j for x in base) for j in range(4)]
        want.append((i, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + sorted(added[k]))), len(added[k])))
    assert as_set(got.collect(), got.columns, got.columns) == sorted((tuple(w) for w in want), key=repr)
    by_text = {rows[k][1]: [rows[k][1][s:e] for s, _, e in sorted(v)] for k, v in added.items()}
    assert by_text["If not, call me at 743-555-3824 any day."] == ["743-555-3824"]
    assert by_text["Also call me at (743) 555 9911 any time"] == ["(743) 555 9911"]
    assert by_text["The order 743-555-3824 and order 12345678 were late"] == ["743-555-3824"]  # known from elsewhere; the other number isn't
    assert by_text["seen from host fe80::1ff:fe23:4567:890a came late"] == ["fe80::1ff:fe23:4567:890a"]
    assert "in the year 1999 or 2001" not in {t for t, v in by_text.items() if v} and "and call me at noon 12 any day" not in {t for t, v in by_text.items() if v}


def test_personal_data_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii_patterns.digest(none).count() == 0
    plain = spark.createDataFrame([(1, "no numbers here"), (1, "no numbers here"), (2, None)], "doc_id long, text string")
    assert [tuple(r)[1:5] + (r.spans,) for r in pii_patterns.digest(plain).collect()] == [(0, 0, 0, 0, "")] * 3


def test_prefix_sums_of_long_arrays(spark):
    """Offsets in blocks equal plain sums."""
    for n in (0, 1, 511, 512, 513, 1500):
        lens = [k % 7 for k in range(n)]
        got = spark.createDataFrame([(lens,)], "x array<long>").select(F.expr(pii_patterns._offsets("x"))).first()[0]
        assert list(got)[: n] == [sum(lens[:k]) for k in range(n)][: n] if n < 600 else got[-1] == sum(lens[:-1])


def test_new_queries_are_registered():
    assert {"op11_pii_patterns", "op12_hard_negatives", "op13_filter_audit"} <= set(queries.QUERIES)
