"""Articles in wiki markup: sections, links, tables with their heading path, and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorfisc.functions import text as txt
from motorfisc.operators.brands import slug_prefix
from motorfisc.operators.upsert import last_by
from motorfisc.session import settled

c = F.col
LEAST_LINKS, SNIPPET, SAMPLES, MINORITY = 5, 4000, 12, 0.4
# Namespaces and sister projects whose links aren't articles; templates that name a section's main article.
NAMESPACES = "datei file bild image media kategorie category vorlage template wikipedia wp hilfe help portal benutzer user benutzerin diskussion talk spezial special s b q n v wikt commons c d en fr it es nl pl sv hr cs ru ja zh".split()
DENIED = ["konzeptfahrzeug", "konzeptauto", "konzeptstudie", "studien", "motorrad", "motorräder", "motorroller", "lastkraftwagen", "nutzfahrzeug", "omnibus", "traktor", "rennwagen", "rennsport", "formel", "militärfahrzeug"]
# Words that label the attributes of engine tables.
ATTRIBUTES = ["bauzeit", "hubraum", "leistung", "drehmoment", "abgasnorm", "kraftstoff", "verbrauch", "emission", "getriebe", "beschleunigung", "höchstgeschwindigkeit", "motor"]


#: A link, and the template that names a section's main article.
PLAIN_LINK, MAIN_LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", r"(?i)\{\{(?:hauptartikel|main|siehe hauptartikel)\|([^}|]+)[^}]*\}\}"


def sections(articles: DataFrame) -> DataFrame:
    """(title, pos, heading, body) of the level-2 sections."""
    parts = F.split("wikitext", r"(?m)^==(?!=)")
    heads = articles.select("title", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("pos", "part"))
    return heads.select("title", "pos", F.trim(F.regexp_extract("part", r"^([^\n]*?)==[ \t]*(?:\n|$)", 1)).alias("heading"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"))


def model_sections(found: DataFrame) -> DataFrame:
    return found.where(F.contains(F.lower("heading"), F.lit("modell")))


def links(found: DataFrame) -> DataFrame:
    """(title, pos, at, target, anchor): links of section bodies and of their main-article templates, first seen first.

    Links into other namespaces and projects are left out.
    """
    targets = F.concat(F.regexp_extract_all("body", F.lit(MAIN_LINK), F.lit(1)), F.regexp_extract_all("body", F.lit(PLAIN_LINK), F.lit(1)))
    each = found.select("title", "pos", F.posexplode(targets).alias("at", "raw"))
    name, anchor = link_parts(c("raw"))
    each = each.select("title", "pos", "at", name.alias("target"), anchor.alias("anchor")).where(is_article(c("target")))
    return last_by(each, ["title", "target", "anchor"], [c("pos"), c("at")])


def link_parts(raw: Column) -> tuple[Column, Column]:
    """The title that a link names, and its anchor (null without one)."""
    return txt.page_title(F.split_part(raw, F.lit("#"), F.lit(1))), F.nullif(txt.unescaped(F.split_part(raw, F.lit("#"), F.lit(2))), F.lit(""))


def is_article(target: Column) -> Column:
    """Whether a title is one, and not in a namespace or project of its own."""
    space = F.lower(F.trim(F.split_part(target, F.lit(":"), F.lit(1))))
    return (target != "") & ~(F.contains(target, F.lit(":")) & space.isin(NAMESPACES))


def brand_links(found: DataFrame, brand: Column) -> DataFrame:
    """Links that start with the brand and aren't lists of something else."""
    return found.where(F.startswith(F.lower("target"), F.lower(brand)) & ~denied(c("target")))


def denied(target: Column) -> Column:
    """Whether a title lists something else than cars."""
    return F.exists(F.array(*[F.lit(w) for w in DENIED]), lambda w: F.contains(F.lower(target), w))


def outer_tables(part: Column) -> Column:
    """The tables of a text that lie in no other, each whole; what is never closed isn't one.

    The text is cut before every opening and after every closing mark, and the parts are put together again while the
    marks passed say that a table is open.
    """
    parts = F.split(part, r"(?=\{\|)|(?<=\|\})")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.startswith(x, F.lit("{|")).cast("int")
        text = F.when(depth > 0, F.concat(F.when(s["depth"] > 0, s["open"]).otherwise(F.lit("")), x)).otherwise(F.lit(""))
        after = depth - (F.endswith(x, F.lit("|}")) & (depth > 0)).cast("int")
        return F.struct(after.alias("depth"), text.alias("open"), F.when((depth > 0) & (after == 0), F.array_append(s["done"], text)).otherwise(s["done"]).alias("done"))

    return F.aggregate(parts, start, step, lambda s: s["done"])


def crawl_report(articles: DataFrame) -> DataFrame:
    """(title, links, escalate): links of an article's model sections; articles with few or none are to be looked at."""
    counted = links(model_sections(sections(articles))).groupBy("title").agg(F.count(F.lit(1)).cast("int").alias("links"))
    out = articles.select("title").distinct().join(counted, "title", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return out.withColumn("escalate", c("links") < LEAST_LINKS)


def _heading(part: Column) -> Column:
    """The text of the heading that a part begins with, without links and marks."""
    return F.trim(F.regexp_replace(F.regexp_extract(part, r"^=+([^\n]*?)=+[ \t]*(?:\n|$)", 1), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|'{2,}|<[^>]*>", "$1"))


def tables(articles: DataFrame) -> DataFrame:
    """(title, segment, at, heading_path, table, fingerprint): tables of an article, each with the headings above it.

    Headings are folded once over the article with a stack: one of level n closes those of level n and deeper. An article
    is one row's work, so nothing is shuffled, and an article stored several times is read as often. A table that lies
    within another is a part of that one, not one of its own.
    """
    parts = F.split("wikitext", r"(?m)^(?==)")
    heads = F.transform(parts, lambda p: F.struct(F.length(F.regexp_extract(p, "^(=+)", 1)).alias("level"), _heading(p).alias("name")))
    start = F.struct(F.array().cast("array<struct<level:int,name:string>>").alias("stack"), F.array().cast("array<array<string>>").alias("paths"))
    closed = lambda stack, h: F.when(h["level"] == 0, stack).otherwise(F.concat(F.filter(stack, lambda x: x["level"] < h["level"]), F.array(h)))
    told = lambda s, stack: F.struct(stack.alias("stack"), F.concat(s["paths"], F.array(F.transform(stack, lambda x: x["name"]))).alias("paths"))
    paths = F.aggregate(heads, start, lambda s, h: txt.let(closed(s["stack"], h), lambda stack: told(s, stack)), lambda s: s["paths"])
    each = articles.select("title", F.posexplode(F.arrays_zip(parts.alias("part"), paths.alias("path"))).alias("segment", "x"))
    pathed = each.select("title", "segment", c("x.path").alias("heading_path"), outer_tables(c("x.part")).alias("found"))
    out = pathed.select("title", "segment", "heading_path", F.posexplode("found").alias("at", "table"))
    return out.withColumn("fingerprint", F.sha1(F.concat(F.array_join("heading_path", " / "), F.lit("\n"), c("table"))))


def has_co2(table: Column) -> Column:
    return table.rlike(r"(?i)co\s*(<sub>)?\s*2|co₂")


def co2_shaped(table: Column) -> Column:
    """Figures in g/km: a table with some but without the word is to be looked at."""
    return F.slice(F.regexp_extract_all(table, F.lit(r"([0-9]{2,3})\s*g/km"), F.lit(1)), 1, SAMPLES)


def prefilter_yield(articles: DataFrame) -> DataFrame:
    """One row: articles with text, their tables, the different ones of each with emissions, and the share of these.

    An article stored several times, for several anchors, counts once.
    """
    own = articles.where("wikitext <> ''").dropDuplicates(["title"])
    found = tables(own).groupBy("title").agg(F.count(F.lit(1)).alias("_seen"), F.count_distinct(F.when(has_co2(c("table")), c("fingerprint"))).alias("_kept"))
    sums = own.select("title").join(found, "title", "left").agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("_seen"), F.lit(0)).alias("tables_seen"), F.coalesce(F.sum("_kept"), F.lit(0)).alias("tables_kept"))
    return sums.withColumn("share", F.try_divide("tables_kept", "tables_seen"))


def spot_check_sample(results: DataFrame, size: int, order: Column) -> DataFrame:
    """Some ``size`` of (orientation, brand, ...) rows with ``turn``: in each orientation a row of every brand in turn.

    MINORITY of the sample is shared by all orientations but the most frequent one (of equals the first by name), one
    row each at least, as far as they have rows; the most frequent one takes the rest. Brands with most rows come first,
    the rows of a brand by ``order``.
    """
    counts = results.groupBy("orientation").agg(F.count(F.lit(1)).alias("_n"))
    some = Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), "orientation")  # a row for each orientation, of which there are a few
    everything = Window.partitionBy(F.lit(0))
    each = F.greatest(F.lit(1), F.floor(F.lit(int(size * MINORITY)) / (F.count(F.lit(1)).over(everything) - 1)))
    ranked = counts.withColumn("_major", F.row_number().over(some) == 1).withColumn("_quota", F.when(~c("_major"), F.least("_n", each)))
    quota = ranked.withColumn("_quota", F.coalesce("_quota", F.least(c("_n"), size - F.coalesce(F.sum("_quota").over(everything), F.lit(0))))).select("orientation", "_quota")
    by = Window.partitionBy("orientation", "brand")
    brands = results.groupBy("orientation", "brand").agg(F.count(F.lit(1)).alias("_of_brand"))
    first = results.withColumn("_turn", F.row_number().over(by.orderBy(order))).where(c("_turn") <= size)
    first = first.join(brands, first["orientation"].eqNullSafe(brands["orientation"]) & first["brand"].eqNullSafe(brands["brand"])).drop(brands["orientation"]).drop(brands["brand"])
    dealt = first.withColumn("turn", F.row_number().over(Window.partitionBy("orientation").orderBy("_turn", F.desc("_of_brand"), "brand")))
    return dealt.where(c("turn") <= size).join(F.broadcast(quota), "orientation").where(c("turn") <= c("_quota")).select(*results.columns, "turn")


def cells(found: DataFrame) -> DataFrame:
    """(fingerprint, row, col, text, is_header) of each table's cells."""
    rows = found.select("fingerprint", F.posexplode(F.split(F.regexp_replace("table", r"^\{\|[^\n]*\n(\|-[^\n]*\n)?|\n?\|\}$", ""), r"(?m)^\|-[^\n]*\n?")).alias("row", "raw"))
    marked = F.regexp_replace("raw", r"(?m)^([|!])", "\n$1$1")
    each = rows.select("fingerprint", "row", F.posexplode(F.filter(F.split(marked, r"\n?(?=\|\||!!)"), lambda x: F.trim(x) != "")).alias("col", "x"))
    body = F.regexp_replace(F.regexp_replace("x", r"^(\|\||!!)", ""), r"""^[^|\[]*=[^|\[]*\|""", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|'{2,}|<[^>]*>|\{\{[^}]*\}\}", "$1"), r"\s+", " "))
    return each.select("fingerprint", "row", "col", plain.alias("text"), F.startswith("x", F.lit("!")).alias("is_header"))


def orientation(table_cells: DataFrame) -> DataFrame:
    """(fingerprint, orientation): which axis of a table has the attribute labels."""
    label = F.exists(F.array(*[F.lit(w) for w in ATTRIBUTES]), lambda w: F.contains(F.lower("text"), w))
    counted = table_cells.groupBy("fingerprint").agg(F.count_if(label & (c("row") == 0)).alias("across"), F.count_if(label & (c("col") == 0)).alias("down"))
    return counted.select("fingerprint", F.when((c("across") == 0) & (c("down") == 0), "no_header_cells").when(c("down") > c("across"), "transposed").otherwise("normal").alias("orientation"))


def for_anchor(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(title, anchor, fingerprint): tables under the heading asked for, else under one that begins alike, else all."""
    even = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[–—-]", "-"), r"\s+", " "))
    pairs = asked.join(found, "title").withColumn("_a", even(c("anchor")))
    near = F.exists("heading_path", lambda h: F.startswith(even(h), c("_a")) | F.startswith(c("_a"), even(h)))
    tier = F.when(c("anchor").isNull(), 0).when(F.exists("heading_path", lambda h: even(h) == c("_a")), 2).when(near, 1).otherwise(0)
    best = F.max("tier").over(Window.partitionBy("title", "anchor"))
    return pairs.withColumn("tier", tier).withColumn("best", best).where("tier = best").select("title", "anchor", "fingerprint", "tier")


def _followed(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_f, _t, hops, frag) -> the same followed to the end, with the last fragment on the way, and the rows that no end is found for, as they lead into loops.

    Pointers are doubled, so that rounds grow with the logarithm of the longest chain. A round in which no row comes to
    its end proves that the others have none: a longer chain would have its own tail among the rows. The loop rows are
    followed on for as many hops as there are such rows, hence point into loops.
    """
    done, rows, before = None, settled(hops), None
    while True:
        ahead = rows if done is None else rows.unionByName(done)
        step = rows.join(ahead.select(c("_f").alias("_g"), c("_t").alias("_u"), c("hops").alias("_m"), c("frag").alias("_n")), c("_t") == c("_g"), "left")
        step = settled(step.select("_f", F.coalesce("_u", "_t").alias("_t"), (c("hops") + F.coalesce("_m", F.lit(0))).alias("hops"), F.coalesce("_n", "frag").alias("frag"), c("_u").isNotNull().alias("_open")))
        ended = step.where(~c("_open")).drop("_open")
        done, rows = ended if done is None else settled(done.unionByName(ended)), step.where("_open").drop("_open")
        count = rows.count()
        if count in (0, before):
            break
        before = count
    for _ in range(count.bit_length()):
        rows = settled(rows.alias("a").join(rows.alias("b"), c("a._t") == c("b._f")).select("a._f", "b._t", (c("a.hops") + c("b.hops")).alias("hops"), "a.frag"))
    return done, rows


def _loops(r: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Rows of loops, (_f, _t, hops) and their titles (_f) -> (_f, last, turn): the title before it, and hops to it."""
    own = settled(r.join(cyclic, "_f", "left_semi"))
    marked = own.select("_f", "_t", F.least("_f", "_t").alias("_least"))
    for _ in range(own.count().bit_length()):
        marked = settled(marked.alias("a").join(marked.alias("b"), c("a._t") == c("b._f")).select("a._f", "b._t", F.least("a._least", "b._least").alias("_least")))
    turns = marked.groupBy("_least").agg((F.count(F.lit(1)) - 1).alias("turn"))
    return marked.join(turns, "_least").select("_f", "turn").join(own.select(c("_f").alias("last"), c("_t").alias("_f")), "_f")


def resolved(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(title, final, hops, fragment): titles followed through redirects until there is none or the next title was seen before.

    ``fragment`` is the last one that a redirect on the way names, where redirects have such a column (to_fragment); it
    is null for titles that lead into a loop.
    """
    named = c("to_fragment") if "to_fragment" in redirects.columns else F.lit(None)
    first = F.min(F.struct(c("to_title").alias("_t"), F.nullif(named.cast("string"), F.lit("")).alias("frag")))
    given = redirects.where("from_title is not null and to_title is not null and from_title <> to_title").groupBy(c("from_title").alias("_f")).agg(first.alias("x"))
    r = settled(given.select("_f", "x._t", F.lit(1).cast("long").alias("hops"), "x.frag"))
    found, stuck = _followed(r)
    if not stuck.isEmpty():
        cyclic = settled(stuck.select(c("_t").alias("_f")).distinct())
        loops = _loops(r, cyclic)
        tails = _followed(r.join(stuck, "_f", "left_semi").join(cyclic, "_f", "left_anti"))[0]
        entered = tails.drop("frag").unionByName(cyclic.select("_f", c("_f").alias("_t"), F.lit(0).cast("long").alias("hops")))
        ended = entered.alias("a").join(loops.alias("b"), c("a._t") == c("b._f")).select("a._f", c("b.last").alias("_t"), (c("a.hops") + c("b.turn")).alias("hops"), F.lit(None).cast("string").alias("frag"))
        found = found.unionByName(ended)
    out = titles.select("title").join(found, c("title") == c("_f"), "left")
    return out.select("title", F.coalesce("_t", "title").alias("final"), F.coalesce("hops", F.lit(0)).cast("int").alias("hops"), c("frag").alias("fragment"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, text, href, url): links of pages with absolute addresses, each address once a page."""
    pattern = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("text"))
    each = pages.select("page_id", c("url").alias("_base"), F.posexplode(pairs).alias("pos", "x"))
    host = F.regexp_extract("_base", r"^([a-z]+://[^/?#]+)", 1)
    full = F.when(c("x.href").rlike("^[a-z]+://"), c("x.href")).when(F.startswith(c("x.href"), F.lit("/")), F.concat(host, c("x.href"))).otherwise(F.concat(F.regexp_extract("_base", r"^([a-z]+://[^?#]*/)", 1), c("x.href")))
    out = each.select("page_id", "pos", F.trim(F.regexp_replace("x.text", "<[^>]*>", "")).alias("text"), c("x.href").alias("href"), full.alias("url"))
    return last_by(out, ["page_id", "url"], [c("pos")])


# Words of a label, and the attribute of an engine that it stands for.
VARIANT_WORDS = {"motor": "engine_code", "bauzeit": "period", "hubraum": "displacement", "leistung": "power", "kraftstoff": "fuel", "co2": "co2", "emission": "co2"}


def variants(table_cells: DataFrame, orientations: DataFrame) -> DataFrame:
    """(fingerprint, variant_index, engine_code, displacement_cc, power_kw, fuel_type, co2_min, co2_max) of each table.

    By rule: labels stand across or down, each other row or column is a variant. Litres become cubic centimetres, a
    range has two figures, a single figure is both. What isn't understood stays null; tables without labels give none.
    """
    word = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(w)), a) for w, a in VARIANT_WORDS.items()])
    own = table_cells.join(orientations.where("orientation <> 'no_header_cells'"), "fingerprint")
    across = c("orientation") == "normal"
    placed = own.withColumn("_label", F.when(across, c("row")).otherwise(c("col"))).withColumn("_axis", F.when(across, c("col")).otherwise(c("row")))
    labels = placed.where("_label = 0").select("fingerprint", "_axis", word.alias("attribute")).where("attribute is not null")
    values = placed.where("_label > 0").join(labels, ["fingerprint", "_axis"])
    wide = values.groupBy("fingerprint", (c("_label") - 1).alias("variant_index")).pivot("attribute", sorted(set(VARIANT_WORDS.values()))).agg(F.first("text"))
    figure = lambda x, n: F.replace(F.nullif(F.regexp_extract(x, r"([0-9]+(?:[.,][0-9]+)?)(?:[^0-9]+([0-9]+(?:[.,][0-9]+)?))?", n), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    size = figure(F.regexp_replace("displacement", r"(?<=[0-9])\.(?=[0-9]{3})", ""), 1)
    return wide.select(
        "fingerprint", "variant_index", "engine_code", F.when(size < 20, size * 1000).otherwise(size).alias("displacement_cc"), figure(c("power"), 1).alias("power_kw"), F.lower("fuel").alias("fuel_type"),
        figure(c("co2"), 1).alias("co2_min"), F.coalesce(figure(c("co2"), 2), figure(c("co2"), 1)).alias("co2_max"),
    )


def brand_checks(found: DataFrame) -> DataFrame:
    """(id, brand, title) -> also brand_check and filed_under: a title's own marque confirms or refiles the brand."""
    slugs = found.withColumn("_slug", F.replace(txt.corpus_text(c("title")), F.lit(" "), F.lit("-"))).withColumnRenamed("brand", "crawl_brand")
    named = slug_prefix(slugs, "_slug").drop("_slug", "consumed")
    check = F.when(c("brand").isNull(), "unverified").when(c("brand") == c("crawl_brand"), "confirmed").otherwise("refiled")
    return named.withColumn("brand_check", check).withColumn("filed_under", F.coalesce("brand", "crawl_brand")).drop("brand")
