"""From brand articles to model articles: a frontier of index articles, rescue by redirect, and the pairs that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorfisc.functions import text as txt
from motorfisc.operators import articles as art
from motorfisc.session import settled

c = F.col
_LINK = ["brand", "target", "anchor"]


def _of_brand(title: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(F.lower(title), F.lower(p)))


def _links(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(brand, title, depth) -> (brand, title, depth, heading, pos, main, target, anchor): links of the pages' level-2 sections.

    ``main`` links are those of main-article templates. Each article is cut into sections once, whatever brands read it.
    """
    wanted = texts.join(pages.select("title").distinct(), "title", "left_semi").groupBy("title").agg(F.max("wikitext").alias("wikitext"))
    of = lambda pattern, main: F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), lambda raw: F.struct(raw.alias("raw"), F.lit(main).alias("main")))
    each = art.sections(wanted).select("title", "pos", "heading", F.explode(F.concat(of(art.MAIN_LINK, True), of(art.PLAIN_LINK, False))).alias("x"))
    name, anchor = art.link_parts(c("x.raw"))
    found = each.select("title", "pos", "heading", "x.main", name.alias("target"), anchor.alias("anchor")).where(art.is_article(c("target")))
    return pages.join(found, "title")


def _told(brands: DataFrame) -> DataFrame:
    return brands.groupBy("brand").agg(F.max("prefixes").alias("prefixes"))


def frontier(brands: DataFrame, texts: DataFrame, hops: int = 1) -> DataFrame:
    """(brand, title, depth, heading, pos, main, target, anchor, prefixes): the links of brand articles and of the index articles they lead to.

    ``brands`` has (brand, title, prefixes), a row for each of a brand's own articles. Depth 0 are model sections of
    these. A main article that isn't one of the brand's models, lists no other things and is no other brand's own
    article is an index: it is read in the next round, all its sections, and its own indexes in the one after, up to
    ``hops`` rounds. A round starts from the articles found new in the last one only; what was read for a brand before
    is never read again, so circles end.
    """
    own = settled(brands.select("brand", "title").distinct())
    told, visited, rounds = settled(_told(brands)), own, None
    pages = own.withColumn("depth", F.lit(0))
    for depth in range(hops + 1):
        found = _links(pages, texts)
        if depth == 0:
            found = found.where(F.contains(F.lower("heading"), F.lit("modell")))
        found = settled(found.join(told, "brand"))
        rounds = found if rounds is None else rounds.unionByName(found)
        if depth == hops:
            break
        index = found.where(c("main") & ~_of_brand(c("target"), c("prefixes")) & ~art.denied(c("target"))).select("brand", c("target").alias("title")).distinct()
        others = own.select(c("brand").alias("_of"), c("title").alias("_own"))
        index = index.join(others, (c("title") == c("_own")) & (c("brand") != c("_of")), "left_anti").join(visited, ["brand", "title"], "left_anti")
        pages = settled(index.withColumn("depth", F.lit(depth + 1)))
        if pages.isEmpty():
            break
        visited = visited.unionByName(pages.select("brand", "title"))
    return rounds


def model_links(found: DataFrame) -> DataFrame:
    """(brand, target, anchor, depth): a brand's models of a frontier: main articles, and links that begin as the brand's articles do.

    Of a link that is found several times the least depth counts.
    """
    return found.where(c("main") | _of_brand(c("target"), c("prefixes"))).groupBy(*_LINK).agg(F.min("depth").alias("depth"))


def candidates(found: DataFrame) -> DataFrame:
    """(brand, target, anchor, prefixes): plain links of model sections that don't begin as the brand's articles do, such as short names."""
    plain = found.where((c("depth") == 0) & ~c("main") & ~_of_brand(c("target"), c("prefixes")))
    return plain.groupBy(*_LINK).agg(F.max("prefixes").alias("prefixes"))


def harvest(brands: DataFrame, texts: DataFrame, redirects: DataFrame, hops: int = 1) -> DataFrame:
    """(brand, title, anchor, state, rescued, depth): the articles, or parts of articles, that a brand's models are told in.

    Links are resolved through redirects; a link without an anchor gets the last fragment that a redirect names. A
    short name is rescued if it leads to an article that begins as the brand's do. ``state`` is ``ok``, or ``missing``
    for a title that leads to no article, which then stands as it was linked. Links that meet in one title and anchor
    are one row: of the least depth, and rescued only if all are.
    """
    found = settled(frontier(brands, texts, hops))
    links = settled(model_links(found))
    known = links.select(*[c(x).alias(f"_{x}") for x in _LINK])
    short = candidates(found).join(known, [c(x).eqNullSafe(c(f"_{x}")) for x in _LINK], "left_anti")
    both = settled(links.select(*_LINK, "depth", F.lit(False).alias("rescued"), F.lit(None).cast("array<string>").alias("prefixes")).unionByName(short.select(*_LINK, F.lit(0).alias("depth"), F.lit(True).alias("rescued"), "prefixes")))
    ends = art.resolved(both.select(c("target").alias("title")).distinct(), redirects)
    there = texts.where("wikitext is not null").select(c("title").alias("final")).distinct().withColumn("there", F.lit(True))
    ends = ends.join(there, "final", "left").select(c("title").alias("target"), "final", "fragment", F.coalesce("there", F.lit(False)).alias("there"))
    led = both.join(ends, "target").where(~c("rescued") | (c("there") & _of_brand(c("final"), c("prefixes"))))
    anchor = F.when(c("there"), F.coalesce("anchor", F.nullif(txt.unescaped(c("fragment")), F.lit("")))).otherwise(c("anchor"))
    pairs = led.select("brand", F.when(c("there"), c("final")).otherwise(c("target")).alias("title"), anchor.alias("anchor"), F.when(c("there"), "ok").otherwise("missing").alias("state"), "rescued", "depth")
    return pairs.groupBy("brand", "title", "anchor", "state").agg(F.min("rescued").alias("rescued"), F.min("depth").alias("depth"))


def report(brands: DataFrame, texts: DataFrame, harvested: DataFrame) -> DataFrame:
    """One row for each brand: its links by how they were found, pairs and different articles, what is missing, and whether it is to be looked at.

    A brand is to be looked at if its own articles have no model section, or fewer than LEAST_LINKS links there.
    """
    own = frontier(brands, texts, hops=0)
    direct = model_links(own).groupBy("brand").agg(F.count(F.lit(1)).alias("direct"))
    sums = harvested.groupBy("brand").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(c("rescued")).alias("rescued"), F.count_if(c("depth") > 0).alias("from_index"), F.count_if(c("state") == "missing").alias("missing"), F.count_distinct(F.when(c("state") == "ok", c("title"))).alias("articles"),
    )
    out = brands.select("brand").distinct().join(direct, "brand", "left").join(sums, "brand", "left").na.fill(0)
    return out.withColumn("escalate", c("direct") < art.LEAST_LINKS)
