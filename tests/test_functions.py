"""Vectors of the scalar functions and classifiers."""

import pytest
from pyspark.sql import functions as F

from catloom import vocabulary as V
from catloom.functions import parse, rules, text


def vectors(one, fn, schema, cases):
    rows = [c[0] if isinstance(c[0], tuple) else (c[0],) for c in cases]
    got = one(fn, schema, rows)
    assert got == [c[1] for c in cases]


def test_names(one):
    vectors(one, text.normalize_name, "a string", [
        ("Canon  AE-1  Program", "canon ae-1 program"), ("Nikon® F3", "nikon f3"), ("", ""), ("  Leica M3\t", "leica m3"),
        ("Contax ™", "contax "), (None, None)])
    vectors(one, text.safe_path, "a string", [('a/b: "c"', "a_b_c"), ("...", "unknown"), ("x" * 300, "x" * 200), ("a  _ b.", "a_b")])
    vectors(one, text.slug, "a string", [("Bell & Howell", "bell-howell"), ("--Zeiss  Ikon!", "zeiss-ikon")])
    vectors(one, text.display_name, "b string, n string", [(("Nikon", "F3"), "Nikon F3"), (("Nikon", "NIKON F3"), "NIKON F3"), (("", "F3"), "F3"), ((None, "F3"), "F3")])
    vectors(one, text.name_from_slug, "a string", [("Nikon-F-301", "Nikon F-301"), ("Instax-Mini-9", "Instax Mini 9"), ("model-b-2", "model b-2")])
    vectors(one, text.strip_accents, "a string", [("Voigtländer é", "Voigtlander e"), ("plain", "plain"), ("ñ́ß", "nß")])
    vectors(one, text.extension, "a string", [("http://x/a.PNG?v=1", "png"), ("http://x/a.exe", "jpg"), ("http://x/a", "jpg"), ("http://x/a.jpeg#t", "jpeg")])
    vectors(one, text.upscale_url, "a string", [("https://h/1_ab_m.jpg", "https://h/1_ab_z.jpg"), ("https://h/1_ab_b.jpg", "https://h/1_ab_b.jpg")])
    vectors(one, text.strip_marketing_terms, "a string", [("MC-A35 mm Film Camera", "MC-A"), ("Diana Mini & Flash", "Diana Mini")])
    vectors(one, text.build_query, "b string, n string", [(("Voigtländer", "Bessa (1930)"), "Voigtlander Bessa"), (("X", "Y"), None)])
    vectors(one, text.query_variants, "b string, n string", [
        (("Fuji", "Fuji DL 200 II (x)"), ["Fuji DL 200 II", "Fuji DL-200 II", "Fuji DL 200", "Fujifilm DL 200 II", "Fujica DL 200 II"]),
        (("Canon", "Canon AE-1"), ["Canon AE-1"]), ((None, "Box"), ["Box"])])


def test_markup_and_years(one):
    vectors(one, parse.clean_markup, "a string", [
        ("[[Nikon F|F]] '''x'''{{cite|1}}", "F x"), ("{{convert|500|g|oz}}", "500 g"), ("a&nbsp;b&ndash;<br>c", "a b-c")])
    vectors(one, parse.year_range, "a string", [("1959–1975", (1959, 1975)), ("1959", (1959, None)), ("", (None, None))])
    vectors(one, parse.leading_year, "a string", [
        ("c1959-1975. 35mm", (1959, 1975)), ("c1960. x", (1960, None)), ("c1950s. Box", (1950, None)), ("1985.", (1985, None)),
        ("1700. old", (None, None)), ("Made 1985", (None, None)), ("1700-1800 x", (1700, 1800))])
    vectors(one, parse.year_in_prose, "a string", [
        ("It was introduced in 1985.", (1985, None)), ("In production from 1970 to 1980", (1970, 1980)),
        ("Between 1955 - 1960 it sold", (1955, 1960)), ("The 1999 and the 1933 model", (1933, None)), ("none", (None, None))])
    vectors(one, parse.price, "a string", [("$399.99", 399.99), ("$1,234.56", 1234.56), ("$10 to $20", 10.0), ("$3", None), ("sold", None), ("1.2.3", None)])
    vectors(one, parse.labelled_price, "a string", [("Average value: $ 1,200", 1200.0), ("price about $75.50", 75.5), ("worth $0", None), ("none", None)])
    vectors(one, lambda c: parse.first_int(c, "g"), "a string", [("about 590 g", 590), ("590", None)])


def test_leads(one):
    short = lambda c: parse.lead_sentences(c, **parse.SHORT_LEAD)
    long = lambda c: parse.lead_sentences(c, **parse.LONG_LEAD)
    vectors(one, short, "a string", [
        ("The F3 (Japanese: x) is an SLR. It sold well! More.", "The F3 is an SLR. It sold well!"), ("Too short.", None),
        ("A" * 240 + ". " + "B" * 20 + ".", "A" * 240 + ".")])
    vectors(one, long, "a string", [("The F3[1] is an SLR camera. It sold well! More text? Rest.", "The F3 is an SLR camera. It sold well! More text?")])


@pytest.mark.parametrize("raw,expected", [
    ("35 mm", "135"), ("full frame", "135"), ("large format", "4x5"), ("weird format", "weird format"), ("", None), (None, None),
    ("35mm half-frame", "135"), ("6 x 7", "120"), ("Half frame", "Half-frame"), ("pack film", "Instant"), ("9.5 mm", "Subminiature")])
def test_format(one, raw, expected):
    assert one(rules.normalize_format, "a string", [(raw,)]) == [expected]


def test_infer_format(one):
    vectors(one, rules.infer_format, "n string, t string, b string", [
        (("X", "SLR", ""), "135"), (("Instax Mini 11", None, ""), "Instant"), (("Mamiya RB67 Pro S", None, ""), "120"),
        (("Minox B", None, None), "Subminiature"), (("EC", None, "Minox"), "Subminiature"), (("F3", None, "Nikon"), "135"), (("Thing", None, "Nobody"), None),
        (("Fuji GW690", None, ""), "120")])


def test_exclusions(one):
    vectors(one, rules.is_excluded_tech, "n string, t string, b string", [
        (("EOS 5D Mark IV", "", ""), True), (("Leica M10", None, None), True), (("C200", "", "hp"), True), (("X", "DSLR", ""), True),
        (("Leica CL", "", ""), False), (("Canon AE-1", "SLR", "canon"), False), (("Leica X", "", ""), True), (("PIXEL 3", None, None), True)])
    vectors(one, rules.is_non_retail, "n string, d string, b string", [
        (("Mars Rover Camera", None, ""), True), (("X", "x-ray imaging device", ""), True), (("X", None, "japan"), True),
        (("Holga 120N", "Toy camera", "Holga"), False), (("Spyder", None, ""), False), (("Barbie cam", "", None), True)])
    vectors(one, lambda n: rules.classify_three_way(n, rules.is_excluded_tech(n)), "n string", [
        ("Canon PowerShot G1", "digital"), ("Canon AE-1", "analogue"), ("Canon canon mx", "uncertain"), ("Pentax MX", "analogue")])
    vectors(one, lambda n: rules.first_matching_pattern(n, V.SUSPECT_PATTERNS), "n string", [("Olympus C-3030 digital", r"\bOlympus\s+C-\d{3,4}"), ("F3", None)])


def test_types(one):
    vectors(one, rules.display_type, "t string", [("slr", "SLR"), (" Toy Camera ", "Toy"), ("point & shoot", "Point & Shoot"), ("x", None), (None, None)])
    vectors(one, rules.type_from_markup, "t string", [("[[Single-lens reflex|35mm SLR]]", "SLR"), ("Odd [[thing]]", "Odd thing"), ("", None)])
    cats = [(["Category:Things", "Category:35mm SLR cameras"],)]
    assert one(lambda c: rules.label_from_categories(c, V.CATEGORY_TYPES), "c array<string>", cats) == ["SLR"]
    assert one(lambda c: rules.label_from_categories(c, V.CATEGORY_FORMATS), "c array<string>", cats) == ["35mm"]
    assert one(rules.is_item_page, "c array<string>", cats + [(["Lenses"],)]) == [True, False]


def test_scores_and_text(one):
    vectors(one, rules.triage, "m double, s int, w int", [((0.04, 30000, 300), "auto"), ((0.07, 30000, 300), "review"), ((0.11, 30000, 300), "drop"), ((0.01, 100, 300), "drop"), ((0.01, 30000, 100), "review")])
    vectors(one, rules.title_relevant, "t string, q string", [(("Nikon F3 body", "nikon f3"), True), (("Nikon", "nikon f3"), False), (("x", ""), False)])
    vectors(one, rules.title_matches, "t string, n string, b string", [
        (("Zenit 12", "Zoom X 70", "Rollei"), False), (("My Rollei", "Zoom X 70", "Rollei"), True), (("zoom in on 70", "Zoom X 70", "Rollei"), True), ((None, "a b", "c"), False)])
    vectors(one, rules.score_url, "u string, b string", [
        (("https://1000logos.net/nikon-logo.svg", "Nikon"), 60), (("https://shop.ebay.com/x.jpg", "Nikon"), -175)])
    vectors(one, rules.template_description, "n string, b string, t string, y int, f string", [
        (("F3", "Nikon", "SLR", 1980, "135"), "The F3 is a SLR produced by Nikon in 1980. It shoots 135 film."),
        (("F3", "Nikon", "camera", None, "135"), "The F3 is a camera by Nikon. 135 format."), (("F3", None, None, 1980, None), "An analogue camera.")])
    vectors(one, rules.year_span_text, "a int, b int", [((1980, 2001), "1980–2001 (21 years)"), ((1980, 1980), "1980–1980"), ((1980, None), "1980"), ((None, 1990), None)])
    vectors(one, rules.is_template_description, "d string", [("The X is a camera produced by Y in 1950.", True), (None, True), ("A long editorial text about history", False)])
    vectors(one, rules.brand_from_prose, "t string, n string", [
        (("It was made by [[Asahi|x]] in 1970.", "Foo 1"), "Asahi"), (("no maker here", "Nikon F3"), "Nikon"), (("made by the makers", "Box"), "Box")])


def test_fold_unicode_takes_rows_in_small_batches(spark):
    """Long texts must not fill an Arrow batch: rows go to Python by the hundred, with the same results."""
    rows = [("Ångström ﬁlm",), ("plain",), (None,), ("",), ("Ⅷ ½ é́",)]
    df = spark.createDataFrame(rows, "t string")
    folded = df.select("t", text.fold_unicode("t").alias("v"))
    assert [r["v"] for r in folded.collect()] == ["Angstrom film", "plain", None, "", "VIII 1⁄2 e"]
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
