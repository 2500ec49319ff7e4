"""The ten operators and the pipeline: odd inputs, brute force, SQL."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, hmm_lm, line_dedup, minhash_forest, mixing, quality_rules, queries, rule_classifier, run_index, sharding, site_style
from tests.conftest import as_set
from tests.llm import brute

_rng = random.Random(4)
WORDS = ["".join(_rng.choice("abcdefghij") for _ in range(_rng.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 1)
LONG = prose(6000, 2)
NEAR = prose(200, 3)
ROWS = [
    (1, prose(120, 10) + " " + PASSAGE + " " + prose(40, 11), "en", "a"),
    (2, prose(90, 12) + "\n" + PASSAGE + "\nA common last line.", "en", "a"),
    (3, NEAR, "en", "b"),
    (4, NEAR + " extra", "en", "b"),
    (5, NEAR.upper(), "fr", "b"),
    (6, NEAR, "fr", "c"),
    (7, None, None, None),
    (8, "", "en", "a"),
    (9, " \n\t ", "en", "a"),
    (10, "one two three", "de", "a"),
    (11, "One two THREE", "de", "a"),
    (12, "x " * 400, "de", "a"),
    (13, "a common last line.  \nshort\n" + prose(30, 13) + "\nA common last line.", "en", "z"),
    (14, LONG, "en", "a"),
    (15, "ab" * 300, "en", "a"),
    (16, "Zürich ß 漢字 " * 30 + "😀", "en", "ü"),
    (16, "Zürich ß 漢字 " * 30 + "😀", "en", "ü"),
    (None, "no id here, " + PASSAGE, "en", "a"),
    (18, "$$$ ### *** &&& " * 20, "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit(-1) for c in ("size", "key", "doc", "row", "pos", "host", "hits", "n", "words", "score", "_text", "label", "rank")}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(clash).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "One two three!"), (3, None), (4, " . "), (None, "x x x x"), (10, "One two three?"), (5, prose(30, 77))], "item_id long, text string")


def check_sql(spark, name, got, tables):
    con = duckdb.connect()
    for t, df in tables.items():
        frame = df.toPandas()
        con.register(f"_{t}", frame)
        kinds = ", ".join(f'CAST("{c}" AS {"BIGINT" if k in ("bigint", "int") else "VARCHAR"}) AS "{c}"' for c, k in df.dtypes)
        con.sql(f"CREATE TABLE {t} AS SELECT {kinds} FROM _{t}")
    want = con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert as_set(got.collect(), got.columns, order) == as_set(want.fetchall(), want.columns, order)


def core(docs):
    return docs.select("doc_id", "text", "lang", "source")


def test_columns_of_working_names_stay(spark, benchmark):
    names = ("_id", "_row", "_epoch", "_doc", "_hits", "_copies", "_dropped", "_HITS2")
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in names})
    own = lambda df: {c: {r[0] for r in df.select(c).distinct().collect()} for c in names}
    want = {c: {f"own {c}"} for c in names}
    kept = decontaminate.decontaminate(rows, benchmark)
    assert own(kept) == want and kept.columns == rows.columns
    spans = decontaminate.decontaminate(rows, benchmark, remove="spans")
    assert own(spans) == want and spans.count() == len(ROWS)
    marked = line_dedup.with_bitmaps(rows)
    assert own(marked) == want and marked.count() == len(ROWS)
    plain_rows = line_dedup.with_bitmaps(rows.drop(*names))
    cut = ["doc_id", "n_lines", "n_dropped"]
    assert as_set(marked.select(cut).collect(), cut, cut) == as_set(plain_rows.select(cut).collect(), cut, cut)
    assert own(mixing.mix(rows)) == want and own(minhash_forest.keep_first(rows)) == want


def test_mixing(spark, docs, empty):
    got = mixing.mix_plan(docs)
    check_sql(spark, "op1_mixing", got, {"documents": core(docs)})
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.target].append(r.taken)
    assert all(sum(v) == math.floor(t) for t, v in by_source.items())
    assert as_set(got.collect(), got.columns, got.columns) == as_set(mixing.mix_plan(docs.repartition(7), run_rows=2).collect(), got.columns, got.columns)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(core(docs).where("doc_id <> 16"))
    assert mixed.columns == ["doc_id", "text", "lang", "source"]


def test_site_style(spark):
    menu = "<nav><a href='/x'>Menu</a></nav><div class='cookie-banner'>We use cookies</div>"
    page = "<html><head><title>T</title><style>p{{}}</style></head><body>{menu}<article><h1>Head &amp; line {i}</h1><p>First  par\n{i}.<br>after<p>Second <b>bold</b> &#233; {i} <script>var a='</p>';</script></p><p>Read our other stories and subscribe today.</p><div class='comments'><p>me too</p></div></article><footer>&copy; x</footer></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(menu=menu, i=i)) for i in range(12)]
    rows += [(100, "https://h.example/cut", "<body><article><p>Only begun &am"), (101, None, None), (102, "odd", ""), (103, "https://k.example/1", "<body><div>Some plain text</div><p>More < than</p><form>no</form></body>")]
    rows += [(5, "https://h.example/5", page.format(menu=menu, i=5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("mine"), "paths": F.lit(1), "texts": F.lit(2)})
    got = site_style.extract(pages)
    assert got.columns == [*pages.columns, "main_text"]
    text = defaultdict(set)
    for r in got.collect():
        text[r.page_id].add(r.main_text)
        assert r.host == "mine"
    assert text[3] == {"Head & line 3\nFirst par 3. after\nSecond bold é 3"}
    assert text[100] == {"Only begun &am"} and text[101] == {""} and text[102] == {""}
    assert text[103] == {"Some plain text\nMore < than"}
    assert got.count() == len(rows)
    d = site_style.digest(pages).where("page_id = 100").first()
    assert d.n_chars == len(d.text)
    assert site_style.digest(pages.where("false")).count() == 0


def test_site_style_importance_on_small_hosts_and_articles(spark):
    """A text on m of n pages goes where 1 - log m / log n is under 0.3, from two pages on."""
    rows = [(i, f"https://two.example/{i}", f"<body><div>Weather and markets</div><p>{prose(40, i)}</p></body>") for i in range(2)]
    notes = {"every": 320, "some": 100, "few": 40}
    rows += [(100 + i, f"https://big.example/{i}", f"<body><article><p>{prose(30, 50 + i)}</p>" + "".join(f"<p>{k} note</p>" for k, m in notes.items() if i < m) + "</article></body>") for i in range(320)]
    rows += [(10, "https://one.example/", "<body><div>Weather and markets</div></body>")]
    got = {r.page_id: r.main_text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = [k for k, m in notes.items() if 1 - math.log(m) / math.log(320) >= 0.3]
    assert kept == ["few"]
    want = {i: prose(40, i) for i in range(2)} | {100 + i: "\n".join([prose(30, 50 + i), *[f"{k} note" for k in kept if i < notes[k]]]) for i in range(320)} | {10: "Weather and markets"}
    assert got == want


def test_near_copies_of_a_page_are_no_boilerplate(spark):
    body = [prose(40, 900 + j) for j in range(10)]
    rows = [(i, f"https://h.example/{i}", "<body><article>" + "".join(f"<p>{p}</p>" for p in [*body[: i % 10], f"changed {i}", *body[i % 10 + 1 :]]) + "</article></body>") for i in range(30)]
    rows += [(100 + i, f"https://h.example/o{i}", f"<body><article><p>{prose(300, 950 + i)}</p></article></body>") for i in range(3)]
    got = {r.page_id: r.main_text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].split("\n") == [*body[: i % 10], f"changed {i}", *body[i % 10 + 1 :]] for i in range(30))


def site_pages(n: int) -> list[tuple]:
    """Pages without a tag or class that declares anything: menu, slogan, story of two to eight paragraphs, imprint."""
    r = random.Random(31)
    out = []
    for i in range(n):
        menu = "".join(f"<li><a href='/{k}'>{r.choice(WORDS)}</a></li>" for k in range(5))
        story = [prose(r.randint(30, 150), 10_000 + 10 * i + k) for k in range(r.randint(2, 8))]
        page = f"<body><div class=a><ul>{menu}</ul></div><div class=b>{prose(7, 20_000 + i)}</div><div class=c><h1>{story[0][:30]}</h1>{''.join(f'<p>{x}</p>' for x in story)}</div><div class=d>{r.choice(WORDS)} all rights</div></body>"
        out.append((i, f"https://plain.example/{i}", page, "\n".join([story[0][:30].strip(), *story])))
    return out


def test_style_tree_equals_brute_force(spark):
    """Undeclared menus and slots go by the tree alone, as plain sums over the site say."""
    pages = site_pages(40)
    got = {r.page_id: r.main_text for r in site_style.extract(spark.createDataFrame([x[:3] for x in pages], "page_id long, url string, html string").repartition(4), declared=False).collect()}
    assert got == {i: story for i, _, _, story in pages}
    chains = site_style._Chains()
    read = [site_style.parsed(p, chains, False) for _, _, p, _ in pages]
    assert len({x["key"] for x in read}) == len(read)
    n = len(read)
    has = Counter(c for x in read for c in {c for b in x["blocks"] for c in b["chain"]})
    on = Counter(b for x in read for b in {(b["chain"][-1], b["id"]) for b in x["blocks"]})
    left = lambda k, m: 1 - math.log(k) / math.log(m) if m > 1 else 1.0
    noise = set()
    for node, m in has.items():
        shapes = Counter(y["shape"] for x in read for y in x["nodes"] if y["node"] == node)
        presentation = -sum(c / m * math.log(c / m) for c in shapes.values()) / math.log(m)
        texts = {b["id"]: (b["words"] * on[b["chain"][-1], b["id"]], left(on[b["chain"][-1], b["id"]], has[b["chain"][-1]])) for x in read for b in x["blocks"] if node in b["chain"]}
        content = sum(w * v for w, v in texts.values()) / sum(w for w, _ in texts.values())
        share = sum(y["words"] for x in read for y in x["nodes"] if y["node"] == node) / sum(x["words"] for x in read if any(y["node"] == node for y in x["nodes"]))
        steady = 0.9 ** len(shapes)
        if left(m, n) < 0.3 and (1 - steady) * presentation + steady * content * min(1, share / 0.1) < 0.3:
            noise.add(node)
    assert noise
    want = {i: "\n".join(b["text"] for b in x["blocks"] if not noise & set(b["chain"]) and left(on[b["chain"][-1], b["id"]], n) >= 0.3) for i, x in enumerate(read)}
    assert got == want


def test_run_index_operator(docs, empty, monkeypatch):
    want = Counter((d, *x) for (d, *_), x in zip(ROWS, brute.removed([r[1] for r in ROWS])))
    got = run_index.digest(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    # strings of keys that are too large for an index take the other way, to the same result
    monkeypatch.setattr(run_index, "KEY_BYTES", 100)
    assert Counter(tuple(r) for r in run_index.digest(docs).collect()) == want
    monkeypatch.setattr(run_index, "HELD_BYTES", 300)
    assert Counter(tuple(r) for r in run_index.digest(docs).collect()) == want
    assert run_index.digest(empty).count() == 0


def test_meeting_in_pieces_is_the_same():
    """However the sorted rows are cut to batches, the same rows leave as the same kinds."""
    r = random.Random(3)
    rows = sorted((r.randrange(6), r.randrange(3), 0, i, 7, i, i + 1, r.random() < 0.1) for i in range(120))
    whole = pd.DataFrame(rows, columns=["key", "g1", "g2", "doc", "row", "first", "last", "own"])
    per_key = {k: {x[1] for x in rows if x[0] == k} for k in range(6)}
    per = Counter(x[:3] for x in rows)
    firsts = {x[:3]: x for x in reversed(rows)}
    want = Counter()
    for x in rows:
        several = len(per_key[x[0]]) > 1 or x[7]
        want[0, x[3]] += per[x[:3]] > 1
        want[1, x[3]] += several and per[x[:3]] == 1
        want[2, x[3]] += several and per[x[:3]] > 1 and firsts[x[:3]] is x
    for size in (1, 2, 7, 50, 200):
        got = pd.concat(list(run_index._meet(iter([whole.iloc[i : i + size] for i in range(0, len(whole), size)]))))
        assert Counter(zip(got["kind"], got["doc"])) == +want


def test_digests_tell_apart_what_polynomials_do_not():
    """The Thue-Morse text and its complement agree in polynomial hashes modulo 2^64."""
    text = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8) + 97
    other = (195 - text).astype(np.uint8)
    a, b = (run_index.digests(x.tobytes(), [0], [4096]) for x in (text, other))
    assert (a != b).all()


def test_matching_statistics():
    r = random.Random(6)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(6)] + [b"abab" * 5, b"a"]
    index = run_index.RunIndex(texts)
    got = index.matching_statistics()
    for k, (t, begin) in enumerate(zip(texts, index.starts)):
        for i in range(len(t)):
            longest = 0
            for k2, u in enumerate(texts):
                for j in range(len(u)):
                    if (k, i) != (k2, j):
                        n = 0
                        while i + n < len(t) and j + n < len(u) and t[i + n] == u[j + n]:
                            n += 1
                        longest = max(longest, n)
            assert got[begin + i] == longest
    assert len(index.run_heads) <= index.n


def test_decontaminate(spark, docs, empty, benchmark):
    got = decontaminate.digest(docs, benchmark)
    check_sql(spark, "op4_decontaminate", got, {"documents": core(docs), "benchmark": benchmark})
    blocks = decontaminate.find_hits(core(docs), benchmark, block_bytes=300)
    assert Counter(r.doc_id for r in blocks.where("size(hits.begins) > 0").collect()) == Counter(r.doc_id for r in got.where("contaminated").collect())
    halved = decontaminate.find_hits(core(docs), benchmark, table_bytes=2000)
    assert Counter((r.doc_id, *map(tuple, (r.hits.begins, r.hits.ends, r.hits["items"]))) for r in halved.collect()) == Counter((r.doc_id, *map(tuple, (r.hits.begins, r.hits.ends, r.hits["items"]))) for r in decontaminate.find_hits(core(docs), benchmark).collect())
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("NOT contaminated").count()
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(core(docs), benchmark, remove="spans").collect()}
    assert cut[10] == "" and PASSAGE not in cut[1] and cut[3] == NEAR
    assert decontaminate.digest(empty, benchmark).count() == 0
    assert decontaminate.digest(docs, benchmark.where("false")).where("contaminated").count() == 0


def test_decontamination_table_grows_with_its_text():
    """Few bytes for each byte of a large benchmark, measured as built."""
    items = [(str(k), prose(400, 3000 + k)) for k in range(300)]
    table = decontaminate.Windows(items, 10)
    assert table.nbytes() < 10 * sum(len(t) for _, t in items) + (1 << 22)


def test_line_dedup(spark, docs, empty, monkeypatch):
    got = line_dedup.digest(docs)
    check_sql(spark, "op5_line_dedup", got, {"documents": core(docs)})
    marked = line_dedup.with_bitmaps(docs, partitions=7)
    texts = {r.doc_id: r.t for r in marked.select("doc_id", line_dedup.kept_text(F.coalesce("text", F.lit("")), "keep_bitmap").alias("t")).collect()}
    assert texts[13] == "short\n" + prose(30, 13)
    bitmaps = {r.doc: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert bitmaps[13].n_dropped == 2 and line_dedup.unpack(bitmaps[13].keep_bitmap, 4).tolist() == [False, True, True, False]
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    check_sql(spark, "op5_line_dedup", line_dedup.digest(docs), {"documents": core(docs)})
    assert line_dedup.digest(empty).count() == 0
    many = spark.createDataFrame([(i, f"the very same line\nown line number {i}") for i in range(300)], "doc_id long, text string")
    one = line_dedup.digest(many)
    assert one.where("n_dropped = 1").count() == 299 and one.where("n_dropped = 0").first().doc_id == 0


def test_minhash_forest(spark, docs, empty):
    r = random.Random(8)
    base = [prose(80, 200 + k) for k in range(12)]
    near = []
    for k, text in enumerate(base):
        for m in range(8):
            words = text.split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            near.append((1000 + 10 * k + m, " ".join(words)))
    rows = [(d, t) for d, t, *_ in ROWS if d is not None] + near
    all_docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.createDataFrame([(None, "nobody has this text")], "doc_id long, text string"))
    want = brute.components(rows)
    got = minhash_forest.near_duplicates(all_docs).collect()
    assert len(got) == len(rows) + 1
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
            continue
        assert x.component_id == want[x.doc_id], x.doc_id
        assert x.kept == (want[x.doc_id] == x.doc_id)
        assert x.n_shingles == len(brute.shingles(dict(rows)[x.doc_id]))
    assert len(set(want.values())) < len(want) - 40
    assert minhash_forest.near_duplicates(empty).count() == 0
    kept = minhash_forest.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (4, 5, 6)").count() == 0 and kept.where("doc_id = 16").count() == 1


def test_ids_of_several_texts_lose_no_link(spark):
    """5 stands for two texts, each of which has a near copy: all four rows are one component."""
    one, two = prose(80, 1), prose(80, 2)
    rows = [(5, one), (5, two), (9, one + " more"), (10, two + " more"), (7, prose(80, 3))]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False), (10, 5, False)]
    kept = minhash_forest.keep_first(spark.createDataFrame(rows + rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7]


def test_crowded_regions_are_split(spark, monkeypatch):
    """A family of near copies far above a region's bound: the components are those of brute force."""
    monkeypatch.setattr(minhash_forest, "CROWD", 6)
    r = random.Random(21)
    rows = []
    for f in range(3):
        base = prose(150, 400 + f).split()
        for m in range(40):
            words = list(base)
            words[r.randrange(150)] = r.choice(WORDS)
            rows.append((1000 * f + m, " ".join(words)))
    got = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.components(rows)
    keyed = spark.createDataFrame([(1, d % 2, 0, 0, d, 5, 0, 0) for d in range(200)] + [(2, 0, 0, 0, 999, 5, 0, 0)], "key long, deep long, deeper long, tree int, id long, n long, s1 long, s2 long")
    sizes = minhash_forest.regions(keyed.withColumn("deep", F.col("deep") * (1 << 62))).groupBy("region").count().collect()
    assert sum(x["count"] for x in sizes) == 201 and max(x["count"] for x in sizes) <= 4 * 6


def twins(n):
    """Documents of 200 shingles, 183 in all of them; only twins share one more, which links them (184 of 216)."""
    common = prose(187, 900)
    return [(k, f"{common} twin{k // 2} " + " ".join(f"own{k}x{j}" for j in range(16))) for k in range(n)]


@pytest.mark.parametrize("n,crowd,light", [(60, 6, 4), (700, 256, 64)])
def test_twins_in_a_crowded_region_are_linked(spark, monkeypatch, n, crowd, light):
    """No link is lost in a family whose members are all just under the similarity."""
    monkeypatch.setattr(minhash_forest, "CROWD", crowd)
    monkeypatch.setattr(minhash_forest.crowded, "LIGHT", light)
    rows = twins(n)
    got = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: k // 2 * 2 for k in range(n)}


@pytest.mark.parametrize("percent,light,seed", [(85, 3, 1), (80, 5, 2), (85, 64, 3)])
def test_pairs_of_a_crowded_group_link_all_that_is_similar(spark, percent, light, seed):
    """Random families: shared cores, missing parts, families within families, several groups."""
    r = random.Random(seed)
    sets, groups = {}, {}
    for g in range(4):
        core = [g * 1000 + k for k in range(40)]
        parts = [[g * 1000 + 100 + 20 * p + k for k in range(r.randint(2, 9))] for p in range(3)]
        for m in range(50):
            i = 100 * g + m
            lost = set(r.sample(core, r.choice([0, 0, 1, 2, 4, 5])))
            sets[i] = {x for x in core if x not in lost} | set(r.choice([[], *parts])) | {g * 1000 + 500 + r.randrange(60) for _ in range(r.choice([0, 1, 3, 6]))}
            groups[i] = g
    members = spark.createDataFrame([(g, i, len(sets[i]), 0, 0, i) for i, g in groups.items()], "g long, id long, n long, s1 long, s2 long, component long")
    elements = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, e array<long>")
    found = {(x.a, x.b) for x in minhash_forest.crowded.pairs(members, elements, percent, 128, light).collect()}
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])

    def parts_of(links):
        at = {i: i for i in sets}

        def root(i):
            while at[i] != i:
                i = at[i]
            return i

        for a, b in links:
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
        return {i: root(i) for i in sets}

    whole = [(a, b) for a in sets for b in sets if a < b and groups[a] == groups[b] and similar(a, b)]
    assert whole and parts_of(whole) == parts_of([p for p in found if similar(*p)])
    assert len(found) < 0.8 * sum(a < b and groups[a] == groups[b] for a in sets for b in sets)


def test_rows_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", "a", 1), (2, "one two three four five six", "a", 2), (3, "another text of some words here", "b", 3)]
    names = ["_id", "_row", "_epoch", "_copies", "r", "k", "p", "e", "d"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int").withColumns({n: F.col("mark") for n in names})
    for out in (minhash_forest.keep_first(docs), mixing.mix(docs)):
        assert out.columns == docs.columns
        held = out.collect()
        assert held and all(x[n] == x.mark == x.doc_id for x in held for n in names)


def test_depth_and_sketch_follow_the_similarity():
    for percent in (70, 80, 85, 95):
        d = minhash_forest.least_depth(percent)
        assert (1 - (percent / 100) ** d) ** minhash_forest.TREES <= minhash_forest.MISSED or d == 1
    assert minhash_forest.least_depth(80) < minhash_forest.least_depth(85) <= 4
    assert minhash_forest.sketch_apart(80) > minhash_forest.sketch_apart(85) > 128 * 0.075


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (7, 7)]
    got = {r.node: r.component for r in minhash_forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[60] == 50 and 50 not in got


def test_quality_rules(spark, docs, labels, empty):
    got = quality_rules.quality_verdicts(docs, labels).collect()
    want = Counter((d, *brute.base_statistics(t)) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # two labels certify nothing
    assert quality_rules.quality_verdicts(empty, labels).count() == 0
    assert quality_rules.quality_verdicts(docs, labels.where("false")).count() == len(ROWS)


def test_quality_rules_certify(spark):
    rows = [(i, prose(60, i) + (" $$$ %%% &&&" * 8 if i % 10 == 0 else ""), "en", "a") for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, SCHEMA), labels).collect()
    good = [r.kept for r in got if r.doc_id % 10]
    assert sum(good) >= (1 - quality_rules.RISK) * len(good)
    assert not any(r.kept for r in got if r.doc_id % 10 == 0)


def test_quality_cutoffs_against_plain_tests(spark):
    """Purities on one half, exact tests of the union of rules on the other, redone in plain Python."""
    r = random.Random(9)
    rows = []
    for i in range(1500):
        bad = i % 6 == 0
        marks = r.randint(10, 25) if bad and i % 12 else r.randint(0, 2)
        text = " ".join(w.upper() if bad and i % 12 == 0 and r.random() < 0.8 else w for w in prose(60, i).split()) + " $$$" * marks
        rows.append((i, text, "en" if i // 12 % 3 else "de", "a"))
    quality = {i: int(i % 6 != 0) if i % 97 else int(i % 6 == 0) for i in range(1500)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    raw = docs.select("doc_id", F.col("lang").alias("stratum"), F.col("text").alias("_text"))
    stats = raw.select("doc_id", "stratum", *quality_rules.text_stats("_text")).select("*", "st.*")
    names = [n for n, _ in quality_rules.RULES]
    seen = stats.select("doc_id", "stratum", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), *[quality_rules._level(c).alias(n) for n, c in quality_rules.RULES]).collect()
    verdict = {x.doc_id: x for x in quality_rules.quality_verdicts(docs, labels).collect()}
    assert not any(v.base_failed for v in verdict.values())
    rejected = 0
    for stratum in ("en", "de"):
        here = [x for x in seen if x.stratum == stratum]
        purity = {}
        for n in names:
            for level in {x[n] for x in here if x.half == 0}:
                tail = [quality[x.doc_id] for x in here if x.half == 0 and x[n] >= level]
                purity[n, level] = (len(tail) - sum(tail)) / (len(tail) + 1) if level else 0.0
        reach = lambda x: max([0.0, *(p for (n, level), p in purity.items() if x[n] >= level)])
        held = [(reach(x), quality[x.doc_id]) for x in here if x.half == 1]
        good = sum(q for _, q in held)
        best = (0, None)
        for p in sorted({p for p, _ in held}, reverse=True):
            k, b = sum(q for x, q in held if x >= p), sum(1 - q for x, q in held if x >= p)
            if sum(math.comb(good, i) * 0.05**i * 0.95 ** (good - i) for i in range(k + 1)) > 0.05 / 2:
                break
            if p > 0 and (b - k, p) > best[:1] + ((best[1] or 0),) and b > k:
                best = (b - k, p)
        for x in here:
            out = best[1] is not None and reach(x) >= best[1]
            rejected += out
            assert verdict[x.doc_id].kept == (not out), (stratum, x.doc_id)
    assert rejected > 60


def test_certificate_is_the_binomial_tail(spark):
    for k, n in ((0, 50), (3, 400), (10, 1000), (40, 1000), (25, 1300), (2500, 130_000)):
        term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98))
        exact = math.fsum(term(i) for i in range(k + 1))
        got = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.certificate("k", "n", 0.02)).first()[0]
        assert got == 0.0 if k >= 0.02 * n else math.isclose(math.exp(got), exact, rel_tol=1e-8)


def test_rule_classifier(spark, docs, labels, empty):
    rows = [(i, prose(60, i).upper() if i % 4 == 0 else prose(60, i), "en", "a") for i in range(600)]
    known = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    data = spark.createDataFrame(rows, SCHEMA)
    got = rule_classifier.classify(data, known).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    # labels of held-out rows don't matter
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in rule_classifier.classify(data, flipped).collect()}
    assert again == {r.doc_id: r.score for r in got}
    odd = rule_classifier.classify(docs, labels)
    assert odd.count() == len(ROWS) and odd.where("score IS NULL").count() == 0
    assert rule_classifier.classify(empty, labels).count() == 0
    assert rule_classifier.keep_good(docs, labels).columns == docs.columns


def test_sharding(spark, docs, empty):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(ROWS)
    by_shard, place = defaultdict(list), defaultdict(set)
    text_of = defaultdict(list)
    for d, t, *_ in ROWS:
        text_of[d].append(t or "")
    for r in got:
        by_shard[r.shard].append(r.slot)
        for t in text_of[r.doc_id]:
            place[t].add(r.shard)
            assert (r["size"], r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert all(len(v) == 1 for v in place.values())
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_sharding_is_minimax(spark, seed):
    r = random.Random(seed)
    rows = [(i, "t%d" % r.randrange(60) + "x" * r.randrange(0, 90)) for i in range(150)] + [(1000 + i, "hot") for i in range(r.choice([0, 300]))]
    rows += [(2000, "one text above the mean shard" * 900)] if seed == 5 else []
    slim = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("h"), (F.length("text") + 1).cast("long").alias("size"))
    cuts, capacity = sharding.plan_cuts(slim, 5, first=2, bits=2)
    groups = slim.groupBy("h").agg(F.sum("size").alias("s")).collect()
    ordered = sorted((g.h % (1 << 64), g.s) for g in groups)
    assert capacity == brute.smallest_capacity([s for _, s in ordered], 5)
    loads = Counter()
    for h, s in ordered:
        loads[sum(h >= c for c in cuts)] += s
    assert max(loads.values()) <= capacity and len(cuts) <= 4


def test_sharding_query_columns_against_plain_cuts(spark, docs):
    """Shards, slots and law of the whole result, from the groups in the order of their hashes."""
    rows = [(r.doc_id, r.text or "", r.h % (1 << 64)) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    sizes = Counter()
    for _, t, h in rows:
        sizes[h] += len(t.encode()) + 1
    capacity = brute.smallest_capacity([sizes[h] for h in sorted(sizes)], 4)
    place, shard, filled = {}, 0, 0
    for h in sorted(sizes):
        if filled + sizes[h] > capacity:
            shard, filled = shard + 1, 0
        place[h], filled = shard, filled + sizes[h]
    want = sorted(((d is not None, d or 0), zlib.crc32(t.encode()), len(t.encode()) + 1, place[h]) for d, t, h in rows)
    got = sharding.shard(docs, 4).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.text_crc32, r["size"], r.shard) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sharding_asks_for_few_rows(spark):
    """What the driver gets doesn't follow the rows: the first prefixes, then parts of those that a cut falls in."""
    for n in (100_000, 1_000_000):
        asked = []
        slim = spark.range(n).select(F.xxhash64("id").alias("h"), (F.col("id") * 7919 % 5000 + 1).alias("size"))
        _, capacity = sharding.plan_cuts(slim, 8, first=10, asked=asked)
        total = slim.agg(F.sum("size")).first()[0]
        assert total / 8 <= capacity <= total / 8 + 5000
        assert asked[0] == 1 << 10 and max(asked[1:]) <= sharding.TRIED * sharding.AHEAD**2 // 2 * 256


def test_forward_recursion():
    r = np.random.default_rng(3)
    start, move, emit = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(4), 3).T
    docs = [r.integers(0, 4, n) for n in (1, 5, 3, 6)]
    got = hmm_lm.forward_scores(docs, start, move, emit)
    assert np.allclose(got, [math.log10(brute.likelihood(start, move, emit, d)) for d in docs])
    starts, moves, emissions, loglik = hmm_lm.expect(docs, start, move, emit)
    assert math.isclose(loglik, sum(got) * math.log(10), rel_tol=1e-9)
    assert math.isclose(starts.sum(), 4) and math.isclose(moves.sum(), 11) and math.isclose(emissions.sum(), 15)
    for _ in range(5):
        before = loglik
        start, move, emit = starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0)
        starts, moves, emissions, loglik = hmm_lm.expect(docs, start, move, emit)
        assert loglik >= before - 1e-9
    for x in hmm_lm.maximise(starts, moves, emissions, np.full(4, 0.25), np.array([0, 1, 0, 1])):
        assert np.allclose(x.sum(axis=0 if x.shape == (4, 3) else -1), 1) and (x > 0).all()


def test_pieces_lose_no_move(monkeypatch):
    """Cut to pieces or not, in one group or many: the same expected counts and scores."""
    r = np.random.default_rng(5)
    model = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T
    docs = [r.integers(0, 5, n) for n in (1, 40, 7, 8, 9, 23, 16)]
    whole, scores = hmm_lm.expect(docs, *model), hmm_lm.forward_scores(docs, *model)
    assert math.isclose(whole[1].sum(), sum(len(d) - 1 for d in docs))
    for piece, tokens in ((8, 10**6), (8, 20), (1, 5), (3, 7)):
        monkeypatch.setattr(hmm_lm, "PIECE", piece)
        monkeypatch.setattr(hmm_lm, "BATCH_TOKENS", tokens)
        for got, want in zip(hmm_lm.expect(docs, *model), whole):
            assert np.allclose(got, want)
        assert np.allclose(hmm_lm.forward_scores(docs, *model), scores)


def test_language_model(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(hmm_lm, "TABLE_WORDS", 50)
    got = hmm_lm.score(docs, states=3).collect()
    assert len(got) == len(ROWS)
    words = lambda t: brute.WORD.findall((t or "").translate(brute.UPPER)) + ["\n"]
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 if d is not None else 0
    counts = Counter(w for d, t, *_ in ROWS if fold(d) != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, fold(d) == 1, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm_lm.score(empty, states=2).count() == 0


def test_whole_scores_equal_a_plain_model(spark, monkeypatch):
    """Counts, start, Baum-Welch, classes of rare words and scores, redone without Spark token by token."""
    monkeypatch.setattr(hmm_lm, "TABLE_WORDS", 30)
    monkeypatch.setattr(hmm_lm, "PIECE", 16)
    monkeypatch.setattr(hmm_lm, "SEEDS", 12)
    r = random.Random(12)
    kinds = [[f"{x}{i}{x}" for i in range(40)] for x in "ab"]
    rows = [(i, " ".join(kinds[i % 2][min(int(r.expovariate(0.15)), 39)] for _ in range(r.randint(1, 60)))) for i in range(60)] + [(900, ""), (901, "never seen words")]
    got = {x.doc_id: x for x in hmm_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=2).collect()}

    learn = [t.split() + ["\n"] for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for t in learn for w in t)
    table = [w.decode() for w in sorted((w.encode() for w in counts), key=lambda w: (-counts[w.decode()], w))]
    level = lambda w: math.floor(math.log2(counts[w]) * 32)
    levels = sorted({level(w) for w in table}, reverse=True)
    at = next((x + 1 for x in levels if sum(level(w) >= x for w in table) > 30), 0)
    table = [w for w in table if level(w) >= at]
    assert "\n" in table and 5 < len(table) <= 30
    place = {w: i for i, w in enumerate(table)}
    group = lambda w: zlib.crc32(w.encode()[-3:]) % hmm_lm.CLASSES
    class_total = [0.5 * (1 + sum(group(w) == k for w in counts if w not in place)) + sum(n for w, n in counts.items() if w not in place and group(w) == k) for k in range(hmm_lm.CLASSES)]
    prior = np.array([counts[w] + 0.5 for w in table] + class_total)
    prior /= prior.sum()
    kind = np.array([group(w) for w in table] + list(range(hmm_lm.CLASSES)))
    code = lambda t: [place.get(w, len(table) + group(w)) for w in t]
    seeds = table[:12]
    together = np.array([[sum(a in t and b in t for t in learn) for b in seeds] for a in seeds], float)
    start, move, emit = hmm_lm.first_model(together, prior, 2)
    for _ in range(hmm_lm.PASSES):
        starts, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros(emit.shape)
        for c in map(code, learn):
            forward, back = [start * emit[c[0]]], [np.ones(2)]
            for x in c[1:]:
                forward.append(forward[-1] @ move * emit[x])
            for x in c[:0:-1]:
                back.insert(0, move @ (emit[x] * back[0]))
            p = forward[-1].sum()
            starts += forward[0] * back[0] / p
            for t, x in enumerate(c):
                emissions[x] += forward[t] * back[t] / p
                if t:
                    moves += np.outer(forward[t - 1], emit[x] * back[t]) * move / p
        start, move, emit = hmm_lm.maximise(starts, moves, emissions, prior, kind)
    for d, t in rows:
        tokens = t.split() + ["\n"]
        a, want = start, 0.0
        for i, (w, x) in enumerate(zip(tokens, code(tokens))):
            a = (a @ move if i else a) * emit[x]
            want += math.log10(a.sum()) + (0 if w in place else math.log10((counts[w] + 0.5) / class_total[group(w)]))
            a = a / a.sum()
        assert math.isclose(got[d].score, want, rel_tol=1e-7, abs_tol=1e-7)


def test_word_probabilities_sum_to_one(spark, monkeypatch):
    """Over the vocabulary and one unknown word for each class, one-token texts' probabilities stay below 1."""
    monkeypatch.setattr(hmm_lm, "TABLE_WORDS", 100)
    rows = [(i, prose(50, i)) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    assert len(vocabulary) > 300
    got = hmm_lm.score(train.unionByName(spark.createDataFrame([(10**6 + i, w) for i, w in enumerate(vocabulary)], "doc_id long, text string")), states=2)
    singles = got.where("doc_id >= 1000000")
    assert singles.where("n_tokens <> 2").count() == 0
    assert 0 < singles.select(F.sum(F.pow(F.lit(10.0), "score"))).first()[0] < 1


def test_pipeline(spark):
    import corpus_pipeline

    directory = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{directory}/documents.parquet")
    now = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, directory).cache()
        assert now.columns == documents.columns, name
        assert now.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    last = corpus_pipeline.run(spark, directory)
    assert last.count() == now.count()
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in now.collect())


def test_pipeline_stages_against_plain_versions(spark, docs, tmp_path):
    """Each stage on odd rows: nulls, repeats, ties, empty and long texts."""
    import corpus_pipeline

    directory = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    own = core(docs)
    near = {r.doc_id for r in stages["near-duplicate removal"](spark, own, directory).collect()}
    want = brute.components([(d, t) for d, t, *_ in ROWS if d is not None], 80)
    assert near == {d for d, c in want.items() if d == c} | {None}
    kept = Counter(r.doc_id for r in stages["near-duplicate removal"](spark, own.unionByName(own), directory).where("doc_id IS NOT NULL").collect())
    assert set(kept.values()) == {1}
    clean = Counter(r.doc_id for r in stages["benchmark decontamination"](spark, own, directory).collect())
    assert clean == Counter(d for d, *_ in ROWS)
    plan = Counter()
    for r in mixing.mix_plan(own).collect():
        plan[r.doc_id] = max(plan[r.doc_id], r.copies)
    mixed = Counter(r.doc_id for r in stages["mixing sources"](spark, own, directory).collect())
    rows_of = Counter(d for d, *_ in ROWS)
    assert mixed == Counter({d: n * rows_of[d] for d, n in plan.items() if n})
    assert stages["quality classifier"](spark, own.where("false"), directory).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.where("false"), directory).count() == 0, name


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_match_sql(spark, name):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark")}
    check_sql(spark, name, queries.QUERIES[name](spark, "/root/testdata/sf0.001"), tables)
