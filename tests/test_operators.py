"""Operators against brute force and hand-made cases, including hot keys and the large-data paths."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from catloom.functions import text
from catloom.operators import dedup, extract, graph, joins, patch, rank, resolve, similarity, stats
from catloom.plans import catalog
from catloom.sources import files, publish
from catloom.sources.schemas import ITEM
from catloom.streaming import toggles
from catloom.vocabulary import NAME_PREFIXES

ALIASES = [("nikon corporation", "Nikon"), ("nippon kogaku", "Nikon"), ("nikon", "Nikon"), ("canon", "Canon"), ("sigma", "Sigma"), ("海鸥", "Seagull"), ("asahi optical", "Pentax")]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, canonical string")


def test_aliases(spark, aliases):
    names = ["Nikon Corporation", "Sigma Corporation", "Canon|some junk text", "海鸥", "Unknown Brand", "Unknown GmbH", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, b string")
    got = [r.brand_canonical for r in joins.normalize_alias(df, "b", aliases).orderBy("i").collect()]
    assert got == ["Nikon", "Sigma", "Canon", "Seagull", "Unknown Brand", "Unknown", "", None]
    key = joins.normalize_alias(spark.createDataFrame([("Asahi Optical", "K1000")], "b string, n string"), "b", aliases)
    assert key.select(joins.make_key("brand_canonical", "n")).first()[0] == "pentax|k1000"


@pytest.mark.parametrize("by", [[], ["k"]])
def test_rank_rows(spark, by):
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}"), rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = {r.i: r["rank"] for r in rank.rank_rows(df, [F.col("v").desc(), F.col("i")], by).collect()}
    groups = {}
    for row in sorted(rows, key=lambda r: (-r[1], r[2])):
        groups.setdefault(row[0] if by else 0, []).append(row[2])
    want = {i: n + 1 for members in groups.values() for n, i in enumerate(members)}
    assert got == want


def test_paged_collect_bounds_pages(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise("cold").alias("k"), "id")
    pages = rank.paged_collect(df, ["k"], [F.col("id").desc()], F.col("id"), 64, "ids").collect()
    assert max(len(p.ids) for p in pages) == 64
    hot = [i for p in sorted((p for p in pages if p.k == "hot"), key=lambda p: p.page) for i in p.ids]
    assert hot == list(range(699, -1, -1))


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = rank.top_per_group(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], max(row[j], row[j - 1]) if x != y else prev + 1
    return row[-1]


def ratio(a, b):
    return round(200.0 * lcs(a, b) / (len(a) + len(b)))


@pytest.mark.parametrize("lo", [80, 90])
def test_fuzzy_pairs_against_all_pairs(spark, lo):
    rng = random.Random(7)
    base = ["canon ae-1 program", "leica m3", "nikon f", "zorki 4k", "ab", "rolleiflex 2.8f", "a"]
    texts = set(base)
    while len(texts) < 160:
        t = list(rng.choice(base))
        for _ in range(rng.randrange(1, 5)):
            p = rng.randrange(len(t) + 1)
            if rng.random() < 0.5 and p < len(t):
                del t[p]
            else:
                t.insert(p, rng.choice("abcx 12é"))
        if t:
            texts.add("".join(t))
    rows = [(i, t, "b1" if i % 3 else "b2") for i, t in enumerate(sorted(texts))]
    rows += [(1000 + i, t, b) for i, t, b in rows[:40]]
    got = {(r.id_a, r.id_b): r.ratio for r in similarity.fuzzy_pairs(spark.createDataFrame(rows, "id long, t string, b string"), "b", "t", "id", lo).collect()}
    uniq = [r for r in rows if r[0] < 1000]
    want = {(x[0], y[0]): ratio(x[1], y[1]) for x, y in itertools.combinations(uniq, 2) if x[2] == y[2] and ratio(x[1], y[1]) >= lo}
    assert got == want and want


def test_fuzzy_pairs_builds_few_candidates_in_a_hot_block(spark):
    """One block of 1,500 texts with a common beginning: candidates stay near the results, and hold ids only."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    texts = {f"model {rng.choice(words)} {rng.choice(words)} {rng.randrange(100)}" for _ in range(1400)}
    texts |= {t[:9] + t[10:] for t in list(texts)[:100]}
    rows = [(i, t, "hot") for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "id long, t string, b string")
    base = df.select(F.col("b").alias("_block"), F.col("t").alias("_text"), F.col("id").alias("_id"), F.length("t").alias("_len"), similarity.letter_signature(F.col("t")).alias("_sig"))
    filed = similarity.rare_grams(base, 90)
    candidates = similarity.candidate_pairs(filed, 90)
    assert candidates.columns == ["_ia", "_ib"] and "_text" not in filed.columns
    found, n = similarity.fuzzy_pairs(df, "b", "t", "id", 90).count(), candidates.count()
    assert found >= 100 and n <= 8 * found and n < len(rows) ** 2 / 200


def test_fuzzy_cluster_is_the_greedy_one(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(100, 112)}
    standing, leader = set(range(200)), {}
    for i in range(200):
        if i in standing:
            for j in sorted(b for a, b in edges if a == i and b in standing):
                leader[j] = i
                standing.discard(j)
    df = spark.createDataFrame(sorted(edges), "id_a long, id_b long")
    got = {r.member: r.leader for r in resolve.fuzzy_cluster(df).collect()}
    assert got == leader


def test_fuzzy_cluster_contracts_chains(spark, monkeypatch):
    """A path of 2,000 neighbours in id order, branches and a clash at its end, in well under 20 rounds."""
    edges = [(i, i + 1) for i in range(2000)] + [(1999, 3000), (2000, 3000), (5000, 5001), (5000, 5002), (5001, 5002)]
    standing, leader = set(range(6000)), {}
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, []).append(b)
    for i in range(6000):
        if i in standing:
            for j in nexts.get(i, []):
                if j in standing:
                    leader[j] = i
                    standing.discard(j)
    cuts, cut = [], resolve.cut_lineage
    monkeypatch.setattr(resolve, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    got = {r.member: r.leader for r in resolve.fuzzy_cluster(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    assert got == leader
    assert (len(cuts) - 2) / 4 < 20  # four writes a round
    assert resolve.fuzzy_cluster(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in resolve.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    looped = {a for a, b in edges if a == b}
    assert got == {n: find(n) for n in parent if n in got or n not in looped}
    empty = spark.createDataFrame([], "a long, b long")
    assert resolve.connected_components(empty, "a", "b").count() == 0


def record(seq, source, **kw):
    base = dict(name="", manufacturer="", images=[], sources=[(source, None, None, None)])
    base.update(kw)
    return (seq, *[base.get(f.name) for f in ITEM.fields])


@pytest.fixture(scope="module")
def merged(spark, aliases):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("seq", T.LongType())] + list(ITEM.fields))
    img = lambda u, c=None: (u, "s", None, c, None, None)
    rows = [
        record(1, "wikidata", name="F3 body", manufacturer="Nikon", wikidata_qid="Q123", camera_type="SLR"),
        record(2, "wikipedia", name="Other F3", manufacturer="Nikon Corporation", wikidata_qid="Q123", year_introduced=1980),
        record(3, "wikipedia", name="K1000", manufacturer="Asahi Optical", images=[img("a", "x"), img("a", "y")], camera_type=""),
        record(4, "flickr", name="K1000", manufacturer="asahi optical", images=[img("a", "z"), img("b")], camera_type="SLR", flickr_id="f1"),
        record(5, "wikidata", name="AE-1 Program", manufacturer="Canon"),
        record(6, "flickr", name="AE-1 Programme", manufacturer="Canon", lens_mount="FD"),
        record(7, "flickr", name="AE-1 Program", manufacturer="Nikon"),
        record(8, "flickr", name="PowerShot G1", manufacturer="Canon"),
        record(9, "chinesecamera", name="海鸥4型", manufacturer="海鸥", film_format="120 roll"),
    ]
    records = spark.createDataFrame(rows, schema)
    prefixes = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(NAME_PREFIXES)], "ord int, prefix string, brand string")
    countries = spark.createDataFrame([("Nikon", "Japan"), ("Seagull", "China")], "canonical string, country string")
    items, resolved = catalog.merge_items(records, aliases, prefixes, countries)
    return {r["seq"]: r for r in items.collect()}, resolved


def test_merged_catalog(merged):
    items, resolved = merged
    assert sorted(items) == [1, 3, 5, 7, 9]
    assert (items[1].camera_type, items[1].year_introduced, items[1].launch_date) == ("SLR", 1980, "1980")
    assert items[3].camera_type == "SLR" and items[3].flickr_id == "f1"
    assert items[5].lens_mount == "FD" and items[5].n_records == 2
    assert items[9].name == "Seagull 4型" and items[9].film_format == "120" and items[9].manufacturer_country == "China"
    assert all(len(r.id) == 36 for r in items.values())
    images = [(r.element.url, r.element.caption) for r in resolved.images.where("cluster = 3").orderBy("first_seq", "first_pos").collect()]
    assert images == [("a", "y"), ("b", None)]
    assert resolved.records.count() == 9


def test_substring_join_and_matches(spark):
    names = [(i, n) for i, n in enumerate(["nikon f2as black", "nikon f2", "nikon fm", "leica", "nikon f"])]
    book = [("Nikon", "nikon f", 1.0, "USD", 1959, 1), ("Nikon", "nikon f2as", 2.0, "USD", 1977, 2), ("Nikon", "nikon f2", 3.0, "USD", 1971, 3), ("Leica", "fm", 9.0, "USD", 1950, 4)]
    items = spark.createDataFrame([(i, "Nikon", n) for i, n in names], "id int, brand string, name string")
    entries = spark.createDataFrame(book, "manufacturer string, pattern string, price double, currency string, year int, ord int")
    got = {r.id: r.book_pattern for r in joins.longest_pattern_join(items, entries, "id", "brand", "name").collect()}
    assert got == {0: "nikon f2as", 1: "nikon f2", 2: "nikon f", 3: None, 4: "nikon f"}
    pats = spark.createDataFrame([("on",), ("n f2",), ("a",), ("zz",)], "p string")
    pairs = {(r.id, r.p) for r in joins.substring_join(items.select("id", "name"), pats, "name", "p").collect()}
    assert pairs == {(i, p) for i, n in names for p in ("on", "n f2", "a", "zz") if p in n}


def test_substring_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_bytes", lambda *_: False)
    names = [(i, f"item {i} of lot {i % 7}") for i in range(60)]
    pats = ["em 1", "t", "lot 3", "9 of", "zzz"]
    df = joins.substring_join(spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(p,) for p in pats], "p string"), "name", "p")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.p) for r in df.collect()} == {(i, p) for i, n in names for p in pats if p in n}


def test_nearest_year(spark):
    fx = spark.createDataFrame([("JPY", 1950, 1.0), ("JPY", 1954, 2.0), ("JPY", 1960, 3.0)], "currency string, year int, rate double")
    df = spark.createDataFrame([(1, "JPY", 1900), (2, "JPY", 1952), (3, "JPY", 1953), (4, "JPY", 2000), (5, "XXX", 1950), (6, "JPY", None)], "i int, currency string, year int")
    got = {r.i: r.rate_at for r in joins.nearest_asof_join(df, fx, "currency", "year", "rate").collect()}
    assert got == {1: 1950, 2: 1950, 3: 1954, 4: 1960, 5: None, 6: None}
    cpi = spark.createDataFrame([(1920, 10.0), (1950, 20.0), (2024, 100.0)], "year int, cpi double")
    rows = spark.createDataFrame([(1, 10.0, 1900), (2, 10.0, 1950), (3, 10.0, 2050)], "i int, amount double, year int")
    assert {r.i: r.adjusted for r in joins.adjust_for_inflation(rows, cpi, "amount", "year", 2030).collect()} == {1: 100.0, 2: 50.0, 3: 10.0}


def test_related_items_against_sorting(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if rng.random() < 0.5 else f"b{rng.randrange(9)}", rng.choice([None, *range(1950, 1962)]), f"n{rng.randrange(40)}") for i in range(300)]
    got = {}
    for r in joins.related_items(spark.createDataFrame(rows, "id int, brand string, year int, name string"), "id", "brand", "year", "name").collect():
        got.setdefault(r.id, {})[r.pos] = r.related
    for i, brand, year, _ in rows:
        near = sorted((abs(y - year) if y and year else 999999, n, j) for j, b, y, n in rows if b == brand and j != i)
        assert [got.get(i, {})[p] for p in sorted(got.get(i, {}))] == [j for _, _, j in near[:6]]


def test_exact_median(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(5, 200))) for _ in range(801)] + [(f"k{i}", float(v)) for i in range(4) for v in (6, 10, 20, 5000)[: i + 1]] + [("hot", 3.0)]
    got = {r.k: (r["median"], r.n) for r in stats.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 5, 50_000).collect()}
    for k in {r[0] for r in rows}:
        values = [v for kk, v in rows if kk == k and v >= 5]
        assert got[k] == (statistics.median(values), len(values))


def test_repair_ranges(spark):
    df = spark.createDataFrame([(1, "B", "a", 1960, 1957, "1960"), (2, "B", "b", 1960, 1956, "1960"), (3, "B", "c", 1850, None, "1850"), (4, "V", "d", 1850, None, "1850"), (5, "A", "S", 1960, 1692, "1960"), (6, "B", "e", 1960, 1970, None)],
                               "i int, brand string, name string, y1 int, y2 int, d string")
    fixes = spark.createDataFrame([("A", "S", None, 1962)], "brand string, name string, start int, end int")
    exempt = spark.createDataFrame([("V", "d")], "brand string, name string")
    got = {r.i: (r.rule, r.y1, r.y2, r.d) for r in patch.repair_ranges(df, "brand", "name", "y1", "y2", "d", fixes, exempt).collect()}
    assert got == {1: ("small_diff", 1960, None, "1960"), 2: ("swapped", 1956, 1960, "1956"), 3: ("too_early", None, None, None), 4: (None, 1850, None, "1850"), 5: ("typo", 1960, 1962, "1960"), 6: (None, 1960, 1970, None)}


def test_tree_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")], "parent string, child string")
    got = {r.node: r.depth for r in graph.walk_tree(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_wiki_extraction(spark):
    wiki = "Intro\n{{Infobox camera\n| name = F3 {{nowrap|x {{y|1}}}}\n| Maker = [[Nikon]]\n| year = 1980–2001\n| maker = Nippon\n}}\nbody {{z}}"
    df = spark.createDataFrame([(1, "Nikon F3", wiki), (2, "Canon A1", "nothing")], "i int, title string, w string")
    boxed = df.select("i", "title", extract.kv_block("w", ["Infobox camera"]).alias("p"))
    params = {r.i: r.p for r in boxed.collect()}
    assert params[1]["name"] == "F3 {{nowrap|x {{y|1}}"
    assert params[1]["maker"] == "Nippon" and params[1]["year"] == "1980–2001" and params[2] == {}
    items = {r.i: (r.brand, r.year_from, r.year_to) for r in extract.item_from_params(boxed, "title", "p").collect()}
    assert items == {1: ("Nippon", 1980, 2001), 2: ("Canon", None, None)}
    long = "{{Infobox camera\n|a = " + "x {{b|c}} " * 3000 + "\n}}"
    assert len(spark.createDataFrame([(long,)], "w string").select(extract.kv_block("w", ["Infobox camera"]).alias("p")).first().p["a"]) > 20000
    table = "== [[Kodak|K]] ==\n{| class=x\n! Name !! ISO\n|-\n| [[Tri-X|Tri X]] || 400\n|- style=y\n| a=b | Gold\n| 200\n|}\n=== Agfa ===\n{|\n! Film\n|-\n| APX 100 || extra\n|}"
    rows = extract.explode_tables(spark.createDataFrame([(1, table)], "i int, w string"), "i", "w")
    got = [(r.table_no, r.section, r.cells) for r in rows.orderBy("table_no", "row_no").collect()]
    assert got == [(1, "Kodak", {"Name": "Tri X", "ISO": "400"}), (1, "Kodak", {"Name": "Gold", "ISO": "200"}), (2, "Agfa", {"Film": "APX 100"})]
    films = {r.name: (r.brand, r.iso_speed) for r in extract.films_from_tables(rows).collect()}
    assert films == {"Tri X": ("Kodak", 400), "Gold": ("Kodak", 200), "APX 100": ("Agfa", None)}


def test_labelled_fields_and_intro_images(spark):
    texts = ["品牌型号", "海鸥", "4A", "重量(g)", "--", "相关附件", "junk"]
    df = spark.createDataFrame([(1, texts)], "i int, t array<string>")
    got = {r.label: r.value for r in extract.labelled_fields(df, "i", "t", ["品牌型号", "重量(g)"], ["相关附件"]).collect()}
    assert got == {"品牌型号": "海鸥 4A", "重量(g)": None}
    html = '<img src="https://f/1/22_ab_m.jpg"><img src="https://f/1/22_ab_z.jpg"><img src="https://f/icon/3_c_m.jpg"><h2>x</h2><img src="https://f/1/99_ab_m.jpg">'
    images = spark.createDataFrame([(html,)], "h string").select(extract.intro_images("h", 'src="([^"]+)"')).first()[0]
    assert images == ["https://f/1/22_ab_z.jpg"]


def test_streamed_lists_equal_batch(spark, tmp_path):
    events = [(1, "click", 5), (1, "click", 5), (1, "click", 5), (2, "view", 1), (2, "view", 1), (3, "purchase", 9), (3, "error", 9)]
    lists = {"click": "favorites", "purchase": "owned", "view": "wishlist"}
    schema = "user_id long, event_type string, item long"
    for n, part in enumerate((events[:3], events[3:4], events[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        toggles.stream_membership(toggles.toggle_rows(stream, lists, F.col("item")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    live = {tuple(r) for r in toggles.SavedLists(spark, str(tmp_path / "out")).lists().collect()}
    batch = {tuple(r) for r in toggles.membership(toggles.fold_toggles(toggles.toggle_rows(spark.createDataFrame(events, schema), lists, F.col("item")))).collect()}
    assert live == batch == {(1, "favorites", 5), (3, "owned", 9)}


def test_record_files(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "cameras.json").write_text('[{"name": "F3", "year_introduced": 1980, "images": [{"url": "u"}]}, {"name": "FM"}]')
    got = files.read_source_records(spark, str(tmp_path), ["none", "wiki"], "cameras").orderBy("seq").collect()
    assert [(r.name, r.year_introduced, r.source_name, r.source_rank) for r in got] == [("F3", 1980, "wiki", 1), ("FM", None, "wiki", 1)]
    inventory = files.file_inventory(spark, str(tmp_path))
    assert [r.name for r in inventory.collect()] == ["cameras.json"]


def test_duplicates_and_targets(spark):
    df = spark.createDataFrame([(1, "A", "x", "h1", "web"), (2, "A", "y", "h1", "web"), (3, "B", "z", "h2", "web"), (4, "A", "w", "h2", "web"), (5, "A", "v", "h3", "flickr_search"), (6, "A", "u", "h3", "web")], "id int, brand string, name string, h string, s string")
    groups = {r.h: (r.kind, r.flagged) for r in dedup.hash_duplicate_groups(df, "h", "brand", "name", "s").collect()}
    assert groups == {"h1": ("same-brand duplicate", False), "h2": ("cross-brand duplicate", True), "h3": ("same-brand duplicate", True)}
    orphans = spark.createDataFrame([("a/x.jpg",), ("b/x.jpg",), ("c/x.jpg",), ("c/y.png",)], "p string")
    assert sorted(r.target for r in dedup.plan_orphan_targets(orphans, "p", "_o").collect()) == ["_o/x.jpg", "_o/x_dup2.jpg", "_o/x_dup3.jpg", "_o/y.png"]


def test_landing_export_has_bounded_pages(spark):
    items = spark.range(250).withColumn("name", F.lit("n"))
    out = publish.export_landing(items, [F.col("id")], ["id", "name"], "now", 100).collect()
    assert sorted((r.part, r.page) for r in out) == [("cameras", 0), ("cameras", 1), ("cameras", 2), ("meta", 0)]


def test_deep_templates_and_later_claims(one):
    from catloom.operators import extract

    deep = "{{Box\n| a = {{x|{{y|{{z|{{q|{{r|{{s|1}}}}}}}}}}}}\n| b = 2\n| c = {{t}}\n}} tail | d = 3"
    assert one(lambda t: extract.kv_block(t, ["Box"]), "t string", [(deep,)])[0].keys() == {"a", "b", "c"}
    claims = '{"P1":[{"mainsnak":{"snaktype":"novalue"}},{"mainsnak":{"datavalue":{"type":"string","value":"x"}}}]}'
    assert one(lambda c: extract.claim_value(c, "P1"), "c string", [(claims,)]) == ["x"]


def test_tables_without_end_tags(spark):
    from catloom.operators import extract

    page = "<table><tr><th>Name<th>Year<tr><td>Alpha<td>1950<tr><td>Beta<table><tr><td>inner</table><td>1960</table><table><tr><td>Name<td>Year<tr><td>Gamma<td>1970"
    got = extract.html_table_rows(spark.createDataFrame([("p", page), ("q", None)], "k string, h string"), "k", "h").collect()
    assert sorted((r["name"], r["year_text"]) for r in got) == [("Alpha", "1950"), ("Beta", "1960"), ("Gamma", "1970")]


def test_orphan_names_never_collide(spark):
    paths = [f"{d}/x.jpg" for d in "abcdef"] + ["g/x_dup2.jpg", "h/x_dup2.jpg", "i/x_dup4.jpg", "j/x_dup2_dup2.jpg", "k/y", "l/y", "m/y_dup3"]
    got = [r.target for r in dedup.plan_orphan_targets(spark.createDataFrame([(p,) for p in paths], "p string"), "p", "_o").collect()]
    assert len(set(got)) == len(paths) and {"_o/x.jpg", "_o/x_dup3.jpg", "_o/x_dup5.jpg", "_o/x_dup2.jpg", "_o/y_dup2"} <= set(got)


def test_null_names_are_kept(spark):
    from catloom.functions import rules as rules_mod

    df = spark.createDataFrame([(1, None, "Nikon"), (2, "F3", "Nikon")], "i int, n string, b string")
    rules = df.select("i", rules_mod.is_excluded_tech("n", None, "b").alias("x"), rules_mod.is_non_retail("n", F.lit(None).cast("string"), "b").alias("y")).collect()
    assert all(r["x"] is False and r["y"] is False for r in rules)
    prefixes = spark.createDataFrame([(1, "海鸥", "Seagull")], "ord int, prefix string, brand string")
    assert {r["i"]: r["n"] for r in joins.localized_name(df, "n", "b", prefixes, "i").collect()} == {1: None, 2: "F3"}


def test_record_order_does_not_depend_on_splits(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('item ', id) AS name", "'wiki' AS source")
    rows.coalesce(1).write.json(str(tmp_path / "wiki" / "cameras"))
    orders = []
    for size in ("4m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = files.read_source_records(spark, str(tmp_path), ["wiki"], "cameras", multiline=False)
        orders.append([r["name"] for r in got.orderBy("seq").select("name").collect()])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert orders[0] == orders[1] == [f"item {i}" for i in range(4000)]


def test_shared_beginnings_meet_few_texts(spark):
    pats = [(f"nikon nikkor {i:03d}z",) for i in range(60)]
    texts = [(i, f"nikon nikkor {i % 60:03d}z lens") for i in range(600)]
    df = joins.substring_join(spark.createDataFrame(texts, "id int, name string"), spark.createDataFrame(pats, "p string"), "name", "p")
    assert df.count() == 600


def test_saved_lists_compact_and_repeat(spark, tmp_path):
    """Folders stay few whatever the batches, a repeated batch changes nothing, and keys off their list are gone."""
    rng = random.Random(6)
    path = str(tmp_path / "lists")
    saved = toggles.SavedLists(spark, path, compact_every=4)
    with pytest.raises(FileNotFoundError):
        saved.lists()
    on = set()
    for number in range(11):
        rows = [(rng.randrange(3), rng.choice("ab"), rng.randrange(4)) for _ in range(12)]
        for row in rows:
            on ^= {row}
        batch = spark.createDataFrame(rows, "user_id int, list_name string, item_id int")
        saved.save(batch, number)
        if number in (2, 3, 7, 9):  # run again, also after its compaction
            saved.save(batch, number)
        folders = [p.name for p in (tmp_path / "lists").iterdir()]
        assert len(folders) <= 4 and sum(f.startswith("base=") for f in folders) <= 1
    assert {tuple(r) for r in saved.lists().collect()} == on
    saved.compact(10)
    base = spark.read.parquet(f"{path}/base=10")
    assert base.count() == len(on) and {tuple(r) for r in toggles.SavedLists(spark, path).lists().collect()} == on


def test_substring_join_makes_rows_only_where_a_pattern_may_follow(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcdefghij ") for _ in range(60)), "x" if i % 2 else "y") for i in range(800)]
    patterns = [(j, "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(5, 8))), "x" if j % 2 else "y") for j in range(12)]
    patterns += [(100, texts[3][1][10:22], "x"), (101, "ab", "y"), (102, "c", "x"), (103, "", "x"), (104, None, "x"), (105, texts[4][1][:4], "y")]
    left = spark.createDataFrame(texts + [(900, None, "x"), (901, "", "x"), (902, "c", None)], "i int, t string, b string")
    right = spark.createDataFrame(patterns, "j int, p string, b string")
    for by in ([], ["b"]):
        got = {(r.i, r.j) for r in joins.substring_join(left, right if by else right.drop("b"), "t", "p", by).collect()}
        want = {(i, j) for i, t, b in [*texts, (902, "c", None)] for j, p, c in patterns if p and p in t and (not by or b == c)}
        assert got == want and want
    # All pieces of the 800 texts would be over 140,000 rows.
    rare = right.where("length(p) >= 5")
    df = joins.substring_join(left, rare, "t", "p", ["b"])
    hits = df.count()
    known = rare.count()
    words, bits = None, 1 << max(10, (16 * known).bit_length())
    keys = spark.createDataFrame([(h,) for h in range(0, 4000, 37)], "_hash long")
    words = joins.member_words(keys, bits)
    marks = spark.range(4000).withColumn("w", words).select("id", joins.maybe_member(F.col("id"), F.col("w"), bits).alias("m")).collect()
    assert all(r.m for r in marks if r.id % 37 == 0) and not all(r.m for r in marks)
    rows = df._jdf.queryExecution().executedPlan()
    generated = [m for m in _metrics(rows, "Generate") if m > 0]
    assert hits > 0 and (not generated or max(generated) < 12_000)


def _metrics(plan, node):
    """Output rows of the operators whose name starts with ``node``, also inside adaptive plans."""
    found, stack = [], [plan]
    while stack:
        p = stack.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            stack.append(p.executedPlan())
        elif hasattr(p, "plan") and "QueryStage" in name:
            stack.append(p.plan())
        if name.startswith(node) and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return found


def slow_asof(rows, series):
    out = {}
    for i, k, at in rows:
        points = sorted((abs(p - at), p, v) for c, p, v in series if c == k) if k is not None and at is not None else []
        out[i] = (points[0][2], points[0][1]) if points else (None, None)
    return out


@pytest.mark.parametrize("folded", [None, True, False])
def test_nearest_asof_join(spark, folded):
    rng = random.Random(5)
    series = sorted({(c, rng.randrange(1900, 2020)) for c in ("EUR", "JPY", "GBP") for _ in range(17)} | {("ONE", 1950)})
    series = [(c, p, float(n)) for n, (c, p) in enumerate(series)]
    rows = [(i, rng.choice(["EUR", "EUR", "EUR", "JPY", "ONE", "none", None]), rng.choice([None, *range(1880, 2040)])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, c string, y int")
    rates = spark.createDataFrame(series, "c string, y int, r double")
    got = {r.i: (r.rate, r.rate_at) for r in joins.nearest_asof_join(df, rates, "c", "y", "r", folded=folded).collect()}
    assert got == slow_asof(rows, series)


def test_currency_conversion_moves_no_fact(spark, capsys):
    facts = spark.range(50).select("id", (F.col("id") * 2.0).alias("p"), F.when(F.col("id") % 3 == 0, "usd").when(F.col("id") % 3 == 1, "EUR").alias("c"), (F.col("id") + 1990).cast("int").alias("y"))
    fx = spark.sql("SELECT * FROM VALUES ('EUR', 2000, 2.0D), ('EUR', 2010, 4.0D) AS t(currency, year, rate)")
    out = joins.convert_currency(facts, fx, "p", "c", "y")
    got = {r.id: r.usd for r in out.collect()}
    assert got == {i: 2.0 * i if i % 3 == 0 else round(2.0 * i / (2.0 if i + 1990 <= 2005 else 4.0), 2) if i % 3 == 1 else None for i in range(50)}
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # The series is exchanged before it is broadcast; no exchange lies above the facts.
    assert "Exchange" not in plan[plan.index("BroadcastHashJoin"):plan.index("BroadcastExchange")].replace("ShuffleQueryStage", "")


def test_ordered_distinct_of_a_long_array(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: (i * 7919) % 30_011).alias("v"))
    got = df.select(text.ordered_distinct(F.col("v"), lambda x: x % 20_000).alias("d")).first()["d"]
    want, seen = [], set()
    for i in range(1, 100_001):
        x = i * 7919 % 30_011
        if x % 20_000 not in seen:
            seen.add(x % 20_000)
            want.append(x)
    assert got == want
    some = spark.createDataFrame([(["b", None, "B", "a", None, "A"],), ([],), (None,)], "v array<string>")
    assert [r["d"] for r in some.select(text.ordered_distinct(F.col("v"), F.lower).alias("d")).collect()] == [["b", None, "a"], [], None]
