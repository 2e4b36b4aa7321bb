from motorfisc.operators import articles, harvest

BRANDS = [("Opel", "Opel", ["Opel ", "Vauxhall "]), ("DS", "DS Automobiles", ["DS "]), ("None", "Nothing there", ["X "])]
TEXTS = [
    ("Opel", "Lead [[Opel Lead]]\n== Modelle ==\n{{Hauptartikel|Personenwagen von Opel}}\n{{Hauptartikel|DS Automobiles}}\n{{Hauptartikel|Liste der Motorräder}}\n<gallery>\nx.jpg|[[Opel_Astra#Astra%20G|Astra]] (since)\n</gallery>\n[[Manta]] [[Corsa]] [[Limousine]] [[:Datei:y.jpg]]\n== Geschichte ==\n[[Opel Kapitän]]\n"),
    ("Personenwagen von Opel", "== A ==\n[[Vauxhall Viva]] [[Opel&nbsp;Astra]]\n== B ==\n{{Hauptartikel|Opel}}{{Hauptartikel|Personenwagen von Opel}}{{Hauptartikel|Noch eine Liste}}\n"),
    ("Noch eine Liste", "== C ==\n[[Opel Weit]]\n"),
    ("DS Automobiles", "== Modellübersicht ==\n[[DS 4]] [[DS 5]] [[DS 7]] [[DS 9]] [[DS 3]] {{Hauptartikel|Opel}}\n"),
    ("Opel Astra", "a"), ("Opel Astra", "a again"), ("Opel Manta", "m"), ("Opel Corsa", None), ("DS 4", "x"), ("Vauxhall Viva", ""),
]
REDIRECTS = [("Manta", "Manta (Auto)", "Erste"), ("Manta (Auto)", "Opel Manta", None), ("Limousine", "Karosserie", None), ("Corsa", "Opel Corsa", "x"), ("DS 5", "DS 4", "DS_5")]


def frames(spark):
    return spark.createDataFrame(BRANDS, "brand string, title string, prefixes array<string>"), spark.createDataFrame(TEXTS, "title string, wikitext string"), spark.createDataFrame(REDIRECTS, "from_title string, to_title string, to_fragment string")


def test_harvest_follows_indexes_once_and_rescues_by_redirect(spark):
    found = harvest.harvest(*frames(spark))
    got = {tuple(r) for r in found.where("brand = 'Opel'").collect()}
    ok, gone = "ok", "missing"
    assert got == {
        ("Opel", "Personenwagen von Opel", None, ok, False, 0), ("Opel", "DS Automobiles", None, ok, False, 0), ("Opel", "Liste der Motorräder", None, gone, False, 0),
        ("Opel", "Opel Astra", "Astra G", ok, False, 0), ("Opel", "Opel Manta", "Erste", ok, True, 0), ("Opel", "Vauxhall Viva", None, ok, False, 1), ("Opel", "Opel Astra", None, ok, False, 1),
        ("Opel", "Opel", None, ok, False, 1), ("Opel", "Noch eine Liste", None, ok, False, 1),
    }
    ds = {tuple(r)[1:] for r in found.where("brand = 'DS'").collect()}
    assert ds == {("DS 4", None, ok, False, 0), ("DS 4", "DS 5", ok, False, 0), ("DS 7", None, gone, False, 0), ("DS 9", None, gone, False, 0), ("DS 3", None, gone, False, 0), ("Opel", None, ok, False, 0)}


def test_more_hops_reach_further_and_circles_end(spark):
    brands, texts, redirects = frames(spark)
    titles = {r.title for r in harvest.harvest(brands, texts, redirects, hops=5).where("brand = 'Opel'").collect()}
    assert "Opel Weit" in titles and "Opel Kapitän" not in titles


def test_report_tells_brands_to_be_looked_at(spark):
    brands, texts, redirects = frames(spark)
    got = {r.brand: r for r in harvest.report(brands, texts, harvest.harvest(brands, texts, redirects)).collect()}
    assert (got["Opel"].pairs, got["Opel"].rescued, got["Opel"].from_index, got["Opel"].missing, got["Opel"].escalate) == (9, 1, 4, 1, True)
    assert (got["DS"].direct, got["DS"].articles, got["DS"].escalate) == (6, 2, False)
    assert (got["None"].pairs, got["None"].escalate) == (0, True)


def test_no_texts_and_no_brands(spark):
    brands, texts, redirects = frames(spark)
    assert harvest.harvest(brands, texts.limit(0), redirects).collect() == [] and harvest.harvest(brands.limit(0), texts, redirects).collect() == []


def test_the_last_fragment_on_a_way_is_kept(spark):
    chain = [(f"t{i}", f"t{i + 1}", f"f{i}" if i in (2, 5) else None) for i in range(9)] + [("a", "b", "x"), ("b", "a", "y")]
    got = articles.resolved(spark.createDataFrame([(t,) for t, _, _ in chain], "title string"), spark.createDataFrame(chain, "from_title string, to_title string, to_fragment string")).collect()
    assert {r.title: r.fragment for r in got} == {f"t{i}": "f5" if i <= 5 else None for i in range(9)} | {"a": None, "b": None}
