"""Exact dedup, line dedup, Jaccard join and decontamination against brute force; odd inputs."""

import hashlib
import html.parser
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
from millrace.llm import decontaminate, exact_dedup, jaccard_join, line_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


ODD = [(900, None), (901, ""), (902, "?! ."), (903, "One"), (904, "one"), (905, "ÀÉ straße"), (906, "àé straße"), (907, "w " * 30_000), (908, "x" * 200_000)]


def near_copies(seed, n=200):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(3, 60))] for _ in range(20)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(["zz", "yy", "x1"])
        out.append((i, " ".join(words) + rng.choice(["", "!", "."])))
    return out


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- exact dedup


def test_exact_dedup_equals_its_definition(spark):
    rows = near_copies(1) + ODD + [(910, "ONE"), (911, "one")]
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    index = exact_dedup.fresh_index(spark)
    got = exact_dedup.decide(docs(spark, rows), index).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert sorted(map(tuple, got.collect())) == want
    kept = exact_dedup.deduplicate(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_batches_through_a_reopened_index_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [f"text {k}" for k in range(40)]
    batches = [[(100 * b + k, rng.choice(texts[: 15 + 12 * b]).upper() if rng.random() < 0.3 else rng.choice(texts[: 15 + 12 * b])) for k in range(60)] for b in range(3)]
    batches.append(batches[0])  # a replay
    index = exact_dedup.fresh_index(spark, 5_000_000)
    assert index.buckets == 16
    keeper, size = {}, {}
    for b, rows in enumerate(batches):
        for t in {low(t) for _, t in rows}:
            keeper.setdefault(t, max(i for i, x in rows if low(x) == t))
            size[t] = size.get(t, 0) + sum(low(x) == t for _, x in rows)
        index = exact_dedup.DigestIndex(spark, index.path, f"{index.name}_{b}")
        assert index.buckets == 16
        got = exact_dedup.decide(docs(spark, rows), index).select("id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, got)) == sorted((i, keeper[low(t)], size[low(t)], i == keeper[low(t)]) for i, t in rows)
        # What a writer that crashed left behind is never read.
        lost = spark.createDataFrame([(bytes(32), 7, 1, "crashed")], "digest binary, keep_id bigint, rows bigint, batch string")
        lost.write.mode("append").partitionBy("batch").parquet(f"{index.path}")
    groups = index.groups().collect()
    assert len(groups) == len({bytes(r.digest) for r in groups}) == len(keeper) and sorted(r.keep_id for r in groups) == sorted(keeper.values())
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, index.name + "_wrong", buckets=64)
    new = exact_dedup.digests_of(docs(spark, [(6, "d")]))
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "EvalPython" not in plan


def test_of_two_writers_of_an_index_one_loses(spark, monkeypatch):
    index = exact_dedup.fresh_index(spark)
    index.append(exact_dedup.digests_of(docs(spark, [(1, "a")])))
    before = index.batches()
    monkeypatch.setattr(exact_dedup.DigestIndex, "batches", lambda self: before[:0])
    with pytest.raises(RuntimeError):
        index.append(exact_dedup.digests_of(docs(spark, [(2, "b")])))
    monkeypatch.undo()
    assert index.batches() == before and [r.keep_id for r in index.groups().collect()] == [1]


def test_exact_dedup_of_odd_tables(spark):
    assert exact_dedup.decide(docs(spark, []), exact_dedup.fresh_index(spark)).count() == 0
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "x", 5), (None, "a", "y", 6), (None, "b", "z", 7)], "doc_id bigint, text string, digest string, keep_id int")
    got = sorted((r.id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.decide(clash, exact_dedup.fresh_index(spark)).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert sorted((r.doc_id or 0, r.digest) for r in exact_dedup.deduplicate(clash).collect()) == [(0, "z"), (1, "x")]


# ---- line dedup


def test_line_dedup_equals_its_definition(spark):
    rng = random.Random(4)
    pages = [(i, f"http://h{i % 3}.org/p{i}", "\n".join([f"Menu {i % 3}", *(f"line {rng.randrange(40)}" for _ in range(rng.randint(0, 6))), "  Foot  er "])) for i in range(60)]
    pages += [(100, None, "a\nb"), (101, "http://h0.org", None), (102, "https://u:p@H1.org:8080/x", "Menu 1\n\n x "), (103, "h1.org", "")]
    host = lambda u: {None: "", "h1.org": ""}.get(u, (u or "").split("//")[-1].split("@")[-1].split("/")[0].split(":")[0].lower())
    lines = lambda t: [x for x in (" ".join(y.split()) for y in (t or "").split("\n")) if x]
    total, held = {}, {}
    for _, u, t in pages:
        total[host(u)] = total.get(host(u), 0) + 1
        for x in set(lines(t)):
            held[host(u), x] = held.get((host(u), x), 0) + 1
    gone = {k for k, n in held.items() if n >= 2 and n > 0.2 * total[k[0]]}
    want = sorted((i, host(u), len(lines(t)), sum((host(u), x) in gone for x in lines(t)), "\n".join(x for x in lines(t) if (host(u), x) not in gone)) for i, u, t in pages)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).repartition(4)
    got = line_dedup.line_dedup(df, "page_id", line_dedup.host_of(F.col("url")), line_dedup.lines_of(F.col("html")))
    assert sorted(map(tuple, got.collect())) == want and any(w[3] for w in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.line_dedup(df.where("false"), "page_id", line_dedup.host_of(F.col("url")), line_dedup.lines_of(F.col("html"))).count() == 0


class Lines(html.parser.HTMLParser):
    """Lines of a page, by a parser that has nothing in common with the patterns."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out += [""] if tag in ("p", "div", "br", "li", "h1", "td", "title") else []

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.out += [""] if tag in ("p", "div", "li", "h1", "td", "title") else []

    def handle_data(self, data):
        parts = [""] if self.hidden else data.split("\n")
        self.out[-1] += parts[0]
        self.out += parts[1:]

    def handle_entityref(self, name):
        self.out[-1] += f"&{name};"


def test_lines_of_html_equal_those_of_a_parser(spark):
    rng = random.Random(9)
    pages = []
    for k in range(200):
        parts = [rng.choice(["<p>", "</p>", "<div class='x'>", "</div>", "<br>", "<b>", "</b>", "<LI>", "<h1 id=a>", "</h1>", "one two", " three\n four ", "&amp;", "<script>var x = '<p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<span title='a'>"]) for _ in range(rng.randint(0, 25))]
        pages.append((k, "".join(parts)))
    got = {r[0]: r[1] for r in spark.createDataFrame(pages, "k int, h string").select("k", line_dedup.html_lines(F.col("h"))).collect()}
    for k, page in pages:
        parser = Lines()
        parser.feed(page)
        parser.close()
        assert got[k] == [x for x in (" ".join(line.split()) for line in parser.out) if x], page


def test_html_becomes_lines(spark):
    page = "<title>T</title><script>var a='</p>';</script><p>One <b>two</b></p><!-- x --><div>  Three\n four</div><br><p></p>"
    got = spark.createDataFrame([(1, page), (2, "a" + "<script>" * 50_000), (3, "a" + "<!--" * 50_000)], "k int, h string").select("k", line_dedup.html_lines(F.col("h")).alias("x"))
    assert {r.k: r.x for r in got.collect()} == {1: ["T", "One two", "Three", "four"], 2: ["a"], 3: ["a"]}


# ---- Jaccard join


@pytest.mark.parametrize("members", [256, 7])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", members)
    rows = near_copies(2, 220) + ODD
    got = jaccard_join.jaccard_join(docs(spark, rows)).select("id", "copy_id", "class_id", "n_links")
    want = brute.jaccard(rows)
    assert sorted(map(tuple, got.collect())) == want and sum(w[3] for w in want) > 50
    kept = jaccard_join.one_of_each(docs(spark, rows))
    assert kept.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_one_large_group_of_near_copies(spark):
    """A chain of links: the ends aren't alike, but belong together; every link is counted once."""
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(words[i : i + 120])) for i in range(60)]
    got = sorted(map(tuple, jaccard_join.jaccard_join(docs(spark, rows)).select("id", "copy_id", "class_id", "n_links").collect()))
    assert got == brute.jaccard(rows) and {g[2] for g in got} == {0}


def test_the_forest_shortens_prefixes_until_the_recall_is_met():
    forest = jaccard_join.Forest()
    assert forest.met(0.8, forest.most) >= 0.9995 > forest.met(0.8, forest.most - 1)
    steps = forest.steps_of
    assert steps[1] == steps[2] == steps[3] == -1  # a set of three has no partner but its equal
    assert 0 <= steps[7] < steps[6] < steps[5] == forest.most  # small sets have partners only well above the threshold
    for n in range(1, 64):  # against all partners of such a set
        found = [i / (n + m - i) for m in range(1, 90) for i in range(1, min(n, m) + 1) if not i == n == m and i / (n + m - i) >= 0.8 - 1e-12]
        assert jaccard_join.least_similarity(n) == pytest.approx(min(found)) if found else steps[n] == -1
    assert sum(forest.bits) == 64 and jaccard_join.Forest(threshold=0.5).most > forest.most > jaccard_join.Forest(threshold=0.95).most


def test_recall_and_links_of_the_given_documents(spark):
    """All links of the table, against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.id: tuple(r) for r in jaccard_join.jaccard_join(table).select("id", "copy_id", "class_id", "n_links").collect()}
    want = {w[0]: w for w in brute.jaccard(rows)}
    links = sum(w[3] for w in want.values())
    assert links > 10 and sum(min(got[i][3], want[i][3]) for i in want) / links >= 0.99
    assert got == want


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, b + " z z")]
    got = sorted(map(tuple, jaccard_join.jaccard_join(docs(spark, rows)).select("id", "copy_id", "class_id", "n_links").collect()))
    assert got == [(1, 1, 1, 1), (1, 1, 1, 2), (2, 2, 1, 1), (3, 3, 1, 2), (4, 4, 1, 2)]


def test_jaccard_join_of_odd_tables(spark):
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 8), (2, "A b, c d e f", 7)], "doc_id bigint, text string, class_id int")
    got = sorted((r.id or 0, r.class_id or 0, r.n_links) for r in jaccard_join.jaccard_join(clash).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0)]
    assert sorted(r.class_id for r in jaccard_join.one_of_each(clash).collect()) == [8, 9, 9]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5001 + k) for k in range(50)]
    root = {x: x for e in edges for x in e}
    while (new := {x: min([root[x], *(root[b] for a, b in edges if a == x), *(root[a] for a, b in edges if b == x)]) for x in root}) != root:
        root = new
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {x: got.get(x, x) for x in root} == root


# ---- decontamination


@pytest.mark.parametrize("shard_words", [1_000_000, 20])
def test_decontamination_equals_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    rows = near_copies(3, 80) + ODD
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(rows)[1].split()[: rng.randint(2, 30)])) for k in range(12) for rng in [random.Random(k)] if rows[k][1]]
    items += [(50, ""), (51, None), (52, "zz yy"), (53, "ONE"), (54, items[0][1])]
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs(spark, rows), it)
    found = sorted((r.id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got.collect())
    want = sorted(brute.decontaminate(rows, items))
    assert found == want and 0 < sum(w[5] for w in want) < len(want)
    clean = decontaminate.remove_contaminated(docs(spark, rows), it)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


def test_windows_that_share_their_rarest_word(spark):
    """Many windows with one prefix token: each place and length is tried once, and every one is found."""
    items = [(k, f"a{k} b{k % 3} c rare d e{k % 5} f g h i") for k in range(300)] + [(1000 + k, " ".join(["rare"] * (k + 1))) for k in range(12)]
    rows = [(k, f"x {items[k * 7 % 300][1]} y" if k % 2 else "rare " * k) for k in range(40)]
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs(spark, rows), it).collect()
    assert sorted((r.id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got) == sorted(brute.decontaminate(rows, items))


def test_documents_are_scanned_once_to_count_and_once_to_mark(spark, tmp_path):
    docs(spark, [(k, f"some words {k}") for k in range(20)]).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    it = spark.createDataFrame([(k, f"item number {k} of many") for k in range(200)], "item_id bigint, text string")
    plan = decontaminate.decontaminate(table, it)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Broadcast" not in plan and "Exchange" not in plan


def test_decontamination_of_odd_tables(spark):
    it = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    none = spark.createDataFrame([], it.schema)
    assert decontaminate.decontaminate(docs(spark, []), it).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(docs(spark, [(1, "a b"), (2, None)]), none).collect()] == [False, False]
    clash = spark.createDataFrame([(None, "a b c d e f g h i j", 1), (1, "A-b c d e f g h i j k", 2), (1, "A-b c d e f g h i j k", 2)], T.StructType.fromDDL("doc_id bigint, text string, hits int"))
    assert sorted((r.id or 0, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(clash, it).collect()) == [(0, 10, True), (1, 11, True), (1, 11, True)]
    assert decontaminate.remove_contaminated(clash, it).count() == 0
    assert [r.hits for r in decontaminate.remove_contaminated(clash.withColumn("text", F.lit("clean")).limit(1), it).collect()] == [1]


def test_an_id_stays_for_one_of_its_texts_only(spark):
    kept = exact_dedup.deduplicate(docs(spark, [(5, "A one"), (7, "A one"), (5, "B two"), (5, "B two")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, "B two"), (7, "A one")]
