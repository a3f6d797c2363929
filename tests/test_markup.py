"""Cards of broken pages, answers, file digests and id unions."""

import hashlib

from pyspark.sql import functions as F

from catloom.functions import rules
from catloom.operators import extract, joins
from catloom.operators.markup import CardReader, Field, Mark, card_fields
from catloom.sources import files

CARD = Mark("li", parts=("card",))
FIELDS = (
    Field("title", (Mark("div", classes=("t",)), Mark("span", parts=("main",)))),
    Field("link", (Mark("a"),), "href"),
    Field("picture", (Mark("img"),), "src"),
)
BOX = Mark("div", id="box")

VECTORS = [
    # whole page, and one whose container is missing
    ('<div id="box"><li class="card x"><div class="t"><span class="main">A</span></div><a href="/a">go</a></li></div>', [["A", "/a", None]]),
    ('<li class="card"><div class="t"><span class="main">A</span></div></li>', []),
    # crossed tags and stray end tags inside a card
    ('<div id="box"><li class="card"><b><i><div class="t"></b></i></span><span class="xmain">A</b> B </span></div><img src="p.jpg"></p></li></div>', [["AB", None, "p.jpg"]]),
    # end tags of items are missing; the second item is no card
    ('<div id="box"><ul><li class="card"><div class="t"><span class="main">A<li class="plain">x<li class="card"><div class="t"><span class="main">B</ul></div>',
     [["A", None, None], ["B", None, None]]),
    # only the first match of a field counts, hidden text does not, entities are decoded
    ('<div id="box"><li class="card"><div class="t"><span class="main"><script>no</script>A &amp; B<style>x</style></span><span class="main">C</span></div></li></div>', [["A & B", None, None]]),
    # a title outside its box is none; a longer class name is another class
    ('<div id="box"><li class="card"><div class="tt"><span class="main">A</span></div><div class="t"><span class="m">B</span></div></li></div>', [[None, None, None]]),
    # a list in a card does not end it, a card in a card has fields of its own
    ('<div id="box"><ul><li class="card"><ul><li>x</li></ul><div class="t"><span class="main">A</span></div><ul><li class="card"><div class="t"><span class="main">B</span></div></li></ul><a href="/a">z</a></li></ul></div>',
     [["A", "/a", None], ["B", None, None]]),
    # a card after the container is outside; a page cut in the middle of a tag keeps what came before
    ('<div id="box"></div><li class="card"><div class="t"><span class="main">A</span></div></li>', []),
    ('<div id="box"><li class="card"><div class="t"><span class="main">A</span></div><a hre', [["A", None, None]]),
    ("", []), (None, []), ("no markup at all < > &", []),
]


def test_cards_of_broken_pages():
    reader = CardReader(CARD, FIELDS, BOX)
    for page, want in VECTORS:
        assert reader.rows(page) == want, page


def test_card_fields(spark):
    df = spark.createDataFrame([((i, "k"), page) for i, (page, _) in enumerate(VECTORS)] * 3, "key struct<n:int,s:string>, html string")
    got = sorted((r["key"]["n"], r["pos"], r["title"], r["link"], r["picture"]) for r in card_fields(df, "key", "html", CARD, FIELDS, BOX).collect())
    want = sorted((i, pos, *values) for i, (_, cards) in enumerate(VECTORS) for pos, values in enumerate(cards))
    assert got == sorted(want * 3, key=lambda r: tuple(str(x) for x in r)) or sorted(got, key=str) == sorted(want * 3, key=str)
    assert card_fields(df.limit(0), "key", "html", CARD, FIELDS).count() == 0


def test_listing_titles_leave_out_secondary_text(spark):
    page = ('<div id="srp-river-results"><li class="s-card s-card--x"><div role="heading" class="s-card__title"><span class="su-styled-text primary default">Leica M3</span>'
            '<span class="clipped">Opens in a new window</span></div><span class="su-styled-text positive bold s-card__price">$1,234.56 to $2,000</span></li>'
            '<li class="s-card"><div class="s-card__title"><span class="primary su-styled-text strong">Old</span></div><span class="s-card__price strikethrough bold">$90</span></li>'
            '<li class="s-card"><div class="s-card__title"><span class="clipped">No title</span></div><span class="s-card__price bold">$80</span></li></div>')
    got = extract.html_cards(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h").orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["price"]) for r in got] == [(0, "Leica M3", 1234.56), (1, "Old", None)]


def test_incomplete_ratings_stay_in_the_text(spark):
    full = '{"buildQuality": 4, "value": 9, "collectibility": 0, "historicalSignificance": "2.25"}'
    answers = [
        "A text.\n" + full + " bye", 'A text.\n{"buildQuality": 4, "value": 3} bye', 'A text. RATINGS: {"buildQuality": 4}', "A text.\nRATINGS: " + full + "\nmore",
        'A text.\n{"buildQuality": x}', "A text.\n```\n", None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    got = {r["i"]: (r["text"], tuple(r["ratings"]) if r["ratings"] else None) for r in extract.parse_text_and_ratings(rows, "i", "a").collect()}
    scores = (4.0, 5.0, 1.0, 2.3)
    assert got[0] == ("A text.", scores) and got[3] == ("A text.", scores)
    assert got[1] == (answers[1], None) and got[4] == (answers[4], None)
    assert got[2] == ("A text.", None) and got[5] == ("A text.", None) and got[6] == (None, None) and got[7] == ("", None)


def test_usable_photo(one):
    rows = [
        ("Camera.jpg", "u", 100, 100), ("Camera.jpg", "u", 99, 500), ("Camera.jpg", "u", 500, 99), ("Camera.jpg", "", 500, 500), ("Camera.jpg", None, 500, 500),
        ("A Logo.svg", "u", 500, 500), (None, "u", 500, 500), ("Camera.jpg", "u", None, 500),
    ]
    assert one(rules.usable_photo, "t string, u string, w int, h int", rows) == [True, False, False, False, False, False, True, False]


def test_union_ids(spark):
    a = spark.createDataFrame([("x", "y"), ("x", None), ("", "z")], "p string, q string")
    b = spark.createDataFrame([("y",), (None,), ("w",)], "p string")
    assert sorted(r["id"] for r in joins.union_ids((a, ["p", "q"]), (b, ["p"])).collect()) == ["w", "x", "y", "z"]


def test_file_inventory_digests_in_chunks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b" / "é=1"
    folder.mkdir(parents=True)
    contents = {"one.bin": b"x" * (5 * files.CHUNK + 7), "two.txt": b"", "three %41.dat": bytes(range(256)) * 9}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    (folder / ".DS_Store").write_bytes(b"skip")
    found = {r["name"]: (r["size"], r["digest"]) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert found == {n: (len(c), hashlib.md5(c).hexdigest()) for n, c in contents.items()}
    assert "content" not in files.file_inventory(spark, str(tmp_path), digest=False).columns
    (folder / "deeper" / "still").mkdir(parents=True)
    (folder / "deeper" / "still" / "_hidden").write_bytes(b"h")
    assert files.file_inventory(spark, f"file:{tmp_path}", digest=False).count() == 4
    assert files.file_inventory(spark, f"{tmp_path}/nowhere").count() == 0
    assert files.file_inventory(spark, str(tmp_path)).where(F.col("size") > 100).count() == 2


def test_plain_pages_read_as_the_parser_reads_them(monkeypatch):
    """Random plain, crossed and broken pages: the quick reading gives the parser's cards; plain ones need no parser."""
    import random

    from catloom.operators.markup import CardReader

    choice, pieces = random.Random(5), [
        '<li class="s-card">', "</li>", "<ul>", "</ul>", '<div id="srp-river-results">', "</div>", '<div class="s-card__title x">', "<b>", "</b>", "<br>",
        '<span class="su-styled-text primary">', "</span>", '<span class="s-card__price bold">', "text", " $5 ", "a &amp; b", "&lt", "<script>x & y</script>",
        "<style>p</style>", "<SPAN CLASS=\"s-card__price\">", "\n", "<i>"]
    rough = ["<br/>", "<a href=x>", "<!-- c -->", "<", ">", "<script>a<b</script>", "<title>t</title>", "&", "</b x>", "<p hidden>"]
    page = lambda some: "<div>" + "".join(choice.choices(some, k=40)) + "</div>"
    pages = [page(pieces) for _ in range(600)] + [page(pieces + rough) for _ in range(600)]
    quick = CardReader(extract.LISTING, extract.LISTING_FIELDS, extract.RESULTS)
    slow = CardReader(extract.LISTING, extract.LISTING_FIELDS, extract.RESULTS)
    monkeypatch.setattr(slow, "_read_plain", lambda page: False)
    got = [quick.rows(p) for p in pages]
    assert got == [slow.rows(p) for p in pages] and sum(map(len, got)) > 300
    monkeypatch.setattr(quick, "feed", None)
    assert [quick.rows(p) for p in pages[:600]] == got[:600]


def test_pages_of_one_template_are_followed_through_once(monkeypatch):
    """However many pages share their tags, these are gone through once; texts around and in the tags come out as the parser has them."""
    from catloom.operators import markup

    page = ('{0}<div id="srp-river-results"><ul><li class="s-card"><div class="s-card__title"><script>var {1} > 1;</script>'
            '<span class="su-styled-text primary">{1}</span></div><span class="s-card__price bold">{2}{3}')
    fills = [(" x > y ", f"a &amp; b {i}", f" ${i} > 4 &lt", tail) for i in range(100) for tail in ("", "\n", "</span></li></ul></div>", "</span></li></ul></div> &amp", "<br/>")]
    pages = [page.format(*fill) for fill in fills] + ["", "no tags > &lt", "a<"]
    quick = CardReader(extract.LISTING, extract.LISTING_FIELDS, extract.RESULTS)
    slow = CardReader(extract.LISTING, extract.LISTING_FIELDS, extract.RESULTS)
    monkeypatch.setattr(slow, "_read_plain", lambda page: False)
    want = [slow.rows(p) for p in pages]
    started, start = [], quick._start
    monkeypatch.setattr(quick, "_start", lambda *a: (started.append(a), start(*a)))
    assert [quick.rows(p) for p in pages if "<br/>" not in p] == [w for p, w in zip(pages, want, strict=True) if "<br/>" not in p]
    assert want[0][0][:2] == ["a & b 0", "$0 > 4 <"] and len(started) <= 2 * 7
    # A reader keeps no more than so many characters of templates, and reads on when it is full.
    monkeypatch.setattr(markup, "TEMPLATE_CHARS", 300)
    monkeypatch.setattr(markup, "LONGEST_TEMPLATE", 290)
    assert [quick.rows(p) for p in pages] == want and quick.kept <= 300 and sum(map(len, quick.templates)) == quick.kept


def test_one_file_for_each_text(spark, tmp_path):
    """Equal names, null names and texts; folders stay bounded, and listing spreads over tasks."""
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c"), ("2", None)] + [(f"n{i}", "x") for i in range(2100)], "n string, t string").coalesce(1)
    files.write_texts(rows, str(tmp_path / "out"), "n", "t")
    found = files.file_inventory(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() >= 8
    got = found.collect()
    assert len(got) == 2104 and sorted(r["name"] for r in got if len(r["name"]) < 6 and r["name"][0] in "12.") == [".txt", "1.txt", "1.txt", "2.txt"]
    assert {r["size"] for r in got if r["name"] == "2.txt"} == {0}
    assert max(sum(1 for _ in d.iterdir()) for d in (tmp_path / "out").iterdir()) <= 1001
