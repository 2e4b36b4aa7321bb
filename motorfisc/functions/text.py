"""Text functions of the catalogue, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorfisc.functions import dims

#: Letters with marks, and the plain letters that they fold to.
MARKED = "àáâãäåāăąçćčďđèéêëēěęìíîïīñńňòóôõöōőŕřśšşťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeeiiiiinnnooooooorrssstuuuuuuuyyzzz"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tokens(text: Column) -> Column:
    """Words between single spaces, none of them empty."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def unmarked(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def fold(text: Column) -> Column:
    """Brand spelling for look-ups: unmarked, single spaces."""
    return F.trim(F.regexp_replace(unmarked(text), r"\s+", " "))


def normalized(text: Column) -> Column:
    """Catalogue text for matching; null counts as empty."""
    plain = F.regexp_replace(unmarked(F.coalesce(text, F.lit(""))), r"([0-9])([a-z]{2,})", "$1 $2")
    plain = F.regexp_replace(plain, r"(^|[^a-z])(xdrive|sdrive)([0-9])", "$1$2 $3")
    found = tokens(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")))
    synonyms = mapping(dims.TOKEN_SYNONYMS)
    return joined(F.transform(found, lambda t: F.coalesce(F.try_element_at(synonyms, t), t)))


def match_key(brand: Column, model: Column, variant: Column) -> Column:
    """Normalized brand, model and variant, each word once, at its first place."""
    return joined(F.array_distinct(tokens(normalized(F.concat_ws(" ", brand, model, variant)))))


def corpus_text(text: Column) -> Column:
    """Article text for look-ups: unmarked ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(unmarked(F.coalesce(text, F.lit(""))), "[^0-9a-z]+", " "))


def brand_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def file_slug(text: Column) -> Column:
    """Lower case, runs of anything but letters, digits, underscore and hyphen as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_-]+", "-"), "^-+|-+$", "")


def ascii_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unmarked(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def header_cell(cell: Column) -> Column:
    """A header cell with white space, case and outer punctuation evened out."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(cell)), r"\s+", " "), r"^[ .:\-]+|[ .:\-]+$", "")


def header_fingerprint(cells: Column) -> Column:
    """sha1 of the distinct non-empty header cells in order, with U+0001 between them."""
    plain = F.filter(F.transform(cells, header_cell), lambda c: c != "")
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(plain)), "\x01"))


def client_hash(forwarded: Column, salt: str) -> Column:
    """Salted sha256 of the first hop of a forwarded list."""
    return F.sha2(F.concat(F.lit(salt), F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))), 256)


def without_noise(key: Column, noise: list[str]) -> Column:
    """The key without noise words, or the key itself if nothing else is left."""
    return let(joined(F.filter(tokens(key), lambda t: ~t.isin(noise))), lambda kept: F.when(kept != "", kept).otherwise(key))


def rewritten(key: Column, synonyms: dict[str, str]) -> Column:
    table = mapping(synonyms)
    return joined(F.transform(tokens(key), lambda t: F.coalesce(F.try_element_at(table, t), t)))


def query_key(brand: Column, key: Column) -> Column:
    """A listing's match key with the habits of its brand's price lists."""
    low = F.lower(F.trim(brand))
    return let(key, lambda k: F.when(low.isin("bmw", "mini"), without_noise(k, dims.BMW_NOISE)).when(low.isin("toyota", "lexus"), rewritten(k, dims.TOYOTA_SYNONYMS)).otherwise(k))


def leading_digits(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), r"^(\d+)", 1), F.lit(""))


def designators(text: Column) -> Column:
    """Model designators of a corpus text: a4, 320d, x530, and three digits if they lead."""
    merged = tokens(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r" ([a-z]) (\d{3})(?= )", " $1$2"))
    shaped = F.filter(merged, lambda t: t.rlike(r"^([a-z]\d{1,2}|\d{3}[a-z]{1,2}|[a-z]\d{3})$"))
    first = F.filter(F.slice(merged, 1, 1), lambda t: t.rlike(r"^\d{3}$"))
    return F.array_distinct(F.concat(shaped, first))


def extra_tokens(query: Column, candidate: Column) -> Column:
    """How many telling words the candidate has that the query lacks."""
    extra = F.array_except(tokens(candidate), tokens(query))
    told = lambda t: (~t.isin(dims.NOISE_TOKENS)) & (~t.rlike("^[ivxl]+$")) & F.when(t.rlike(r"^\p{L}+$"), F.length(t) >= 4).otherwise((F.length(t) >= 5) & t.rlike(r"\p{L}"))
    return F.size(F.filter(extra, told))


def variant_display(brand: Column, variant: Column) -> Column:
    """A spec blob with underscores as readable text."""
    plain = F.trim(F.regexp_replace(F.replace(variant, F.lit("_"), F.lit(" ")), r"\s+", " "))
    segments = F.filter(F.transform(F.split(variant, "_"), lambda s, i: F.struct(F.trim(s).alias("s"), i.alias("i"))), lambda x: (x["s"] != "") & ~F.lower(x["s"]).isin("benzin", "benzina", "diesel", "dizel", "gasoline", "hybrid") & ~x["s"].rlike(r"(?i)^\d+\s*(kw|ccm)$"))

    def shown(x: Column) -> Column:
        s = F.when(x["i"] == 0, F.regexp_replace(x["s"], r"(?i)^(bmw|mini)\s+", "")).otherwise(x["s"])
        title = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 10_000))
        gears = F.regexp_extract(x["s"], r"(?i)^(\d+)\s*stupnjeva.*", 1)
        doors = F.regexp_extract(x["s"], r"(?i)^(\d+)\s*vrata$", 1)
        return F.when(gears != "", F.concat(gears, F.lit("-stup."))).when(doors != "", F.concat(doors, F.lit(" vrata"))).otherwise(title)

    blob = F.array_join(F.transform(segments, shown), " · ")
    return F.when(variant.isNull() | ~F.contains(variant, F.lit("_")), variant).when(F.lower(F.trim(brand)).isin("bmw", "mini"), F.when(F.size(segments) > 0, blob).otherwise(variant)).otherwise(plain)


def corrected_kw(variant: Column, power: Column) -> Column:
    """The variant with a power figure at its end put right."""
    told = F.regexp_extract(variant, r"(?i)(\d+)(kw)$", 1)
    right = F.bround(power, 0).cast("int")
    return F.when((told != "") & power.isNotNull() & (told.cast("int") != right), F.concat(F.regexp_replace(variant, r"(?i)\d+kw$", ""), right.cast("string"), F.regexp_extract(variant, r"(?i)(\d+)(kw)$", 2))).otherwise(variant)


def series_text(text: Column, brand: Column) -> Column:
    """A banner's series: without a chassis code at the end and without the brand before it."""
    cleaned = F.trim(F.regexp_replace(text, r"\(\s*[A-Za-z0-9]+\s*\)\s*$", ""))
    cleaned = F.when(cleaned != "", cleaned).otherwise(F.trim(text))
    rest = F.ltrim(F.substring(cleaned, F.length(brand) + 1, F.lit(10_000)))
    return F.when(F.startswith(F.lower(cleaned), brand) & (rest != ""), rest).otherwise(cleaned)


def site_of(url: Column) -> Column:
    """The listing site that a URL belongs to."""
    has = lambda s: F.contains(F.lower(url), F.lit(s))
    return F.when(has("mobile.de"), "mobile.de").when(has("autoscout24"), "autoscout24").when(has("autobid.de"), "autobid.de").when(has("njuskalo.hr"), "njuskalo")


def listing_id(url: Column) -> Column:
    """The number that a listing's URL has in its query or as the name of a page."""
    asked, path = F.regexp_extract(url, r"[?&]id=(\d+)", 1), F.regexp_extract(url, r"/(\d+)\.html", 1)
    return F.coalesce(F.nullif(asked, F.lit("")), F.nullif(path, F.lit("")))


def vin(text: Column) -> Column:
    up = F.upper(F.trim(text))
    return F.when(up.rlike("^[A-HJ-NPR-Z0-9]{11,17}$"), up)


def unescaped(text: Column) -> Column:
    """A link's text with percent codes decoded (where they are all right), non-breaking spaces and underscores as spaces, single spaces."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    spaced = F.translate(F.regexp_replace(decoded, "(?i)&nbsp;|&#160;", " "), "_\u00a0", "  ")
    return F.trim(F.regexp_replace(F.replace(spaced, F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def page_title(text: Column) -> Column:
    """An article title: as ``unescaped``, without colons before it, first letter upper case."""
    plain = F.ltrim(F.regexp_replace(unescaped(text), "^:+", ""))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 10_000))


def eur(x: Column) -> Column:
    """An amount as 1.234,56 €."""
    return F.concat(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(" €"))


def cleaned_query(text: Column, brand: Column, noise: list[str]) -> Column:
    """A search text without the brand's words, noise words and repeats, in its order."""
    own = F.array_distinct(tokens(corpus_text(text)))
    return joined(F.filter(F.array_except(own, tokens(corpus_text(brand))), lambda t: ~t.isin(noise)))


def folder_year(path: Column) -> Column:
    """The year of the nearest folder of a path that is named for one."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit("/(20[12][0-9])(?=/)"), F.lit(1)), F.lit(-1)).cast("int")


def clipped(text: Column, n: int) -> Column:
    return F.nullif(F.left(F.trim(text), F.lit(n)), F.lit(""))
