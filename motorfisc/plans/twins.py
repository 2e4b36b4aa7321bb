"""DuckDB expressions of the text functions, for the SQL twins."""

from __future__ import annotations

from motorfisc.functions import dims
from motorfisc.functions.text import MARKED, PLAIN


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def case(x: str, values: dict[str, str], other: str) -> str:
    told = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {x} " + " ".join(f"WHEN {told(k)} THEN {told(v)}" for k, v in values.items()) + f" ELSE {other} END"


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def unmarked(x: str) -> str:
    return f"translate(lower({x}), '{MARKED}', '{PLAIN}')"


def fold(x: str) -> str:
    return f"trim({gsub(unmarked(x), '[ \\t\\n\\r]+', ' ')})"


def normalized(x: str) -> str:
    plain = gsub(unmarked(f"coalesce({x}, '')"), "([0-9])([a-z]{2,})", "\\1 \\2")
    plain = gsub(plain, "(^|[^a-z])(xdrive|sdrive)([0-9])", "\\1\\2 \\3")
    plain = gsub(plain, "[^\\p{L}\\p{N}]+", " ")
    return joined(f"list_transform({tokens(f'trim({plain})')}, lambda t: {case('t', dims.TOKEN_SYNONYMS, 't')})")


def distinct(x: str) -> str:
    """Each element once, at its first place."""
    return f"list_transform(list_filter(list_transform({x}, lambda t, i: {{'t': t, 'i': i, 'p': list_position({x}, t)}}), lambda s: s.i = s.p), lambda s: s.t)"


def match_key(brand: str, model: str, variant: str) -> str:
    return joined(distinct(tokens(normalized(f"concat_ws(' ', {brand}, {model}, {variant})"))))


def corpus_text(x: str) -> str:
    return f"trim({gsub(unmarked(f'coalesce({x}, chr(32))'), '[^0-9a-z]+', ' ')})"


def has(x: str, values: list[str]) -> str:
    return f"list_has_any({tokens(x)}, {quoted(values)})"


def one_of(a: str, b: str, first: str, second: str) -> str:
    return f"CASE WHEN ({a}) AND NOT ({b}) THEN '{first}' WHEN ({b}) AND NOT ({a}) THEN '{second}' END"


def engine_word_fuel(x: str) -> str:
    n = normalized(x)
    return one_of(f"{has(n, dims.DIESEL_WORDS)} OR regexp_matches({n}, '\\bskyactiv d\\d{{0,3}}\\b')", f"{has(n, dims.PETROL_WORDS)} OR regexp_matches({n}, '\\bskyactiv [gx]\\d{{0,3}}\\b')", "diesel", "petrol")


def badge_fuel(x: str, brand: str) -> str:
    n, mazda = normalized(x), f"coalesce(lower(trim({brand})) = 'mazda', false)"
    d = f"regexp_matches({n}, '\\b\\d{{2,3}}d\\b') OR regexp_matches(coalesce({x}, ''), '(?i)\\b\\d\\.\\d\\s*d(\\b[^-]|$)') OR ({mazda} AND regexp_matches({n}, '\\b(cd|d)\\d{{2,3}}\\b'))"
    p = f"regexp_matches({n}, '\\b\\d{{2,3}}i\\b') OR regexp_matches(coalesce({x}, ''), '(?i)\\b\\d\\.\\d\\s*i(\\b[^-]|$)') OR ({mazda} AND regexp_matches({n}, '\\b[gx]\\d{{2,3}}\\b'))"
    return one_of(d, p, "diesel", "petrol")


def gearbox(x: str) -> str:
    n = normalized(x)
    return one_of(has(n, dims.MANUAL_WORDS), has(n, dims.AUTO_WORDS), "manual", "auto")


def query_fuel(raw: str, model: str, variant: str, brand: str) -> str:
    text = f"(coalesce({model}, '') || ' ' || coalesce({variant}, ''))"
    return f"coalesce({engine_word_fuel(text)}, {case(f'lower(trim({raw}))', dims.LISTING_FUEL, 'NULL')}, {badge_fuel(text, brand)})"


def without_noise(key: str, noise: list[str]) -> str:
    kept = joined(f"list_filter({tokens(key)}, lambda t: NOT list_contains({quoted(noise)}, t))")
    return f"CASE WHEN {kept} <> '' THEN {kept} ELSE {key} END"


def query_key(brand: str, key: str) -> str:
    rewritten = joined(f"list_transform({tokens(key)}, lambda t: {case('t', dims.TOYOTA_SYNONYMS, 't')})")
    return f"CASE WHEN lower(trim({brand})) IN ('bmw', 'mini') THEN {without_noise(key, dims.BMW_NOISE)} WHEN lower(trim({brand})) IN ('toyota', 'lexus') THEN {rewritten} ELSE {key} END"


NUMBER = "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def double(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{NUMBER}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def display_number(x: str) -> str:
    t = f"trim({x})"
    plain = f"CASE WHEN contains({t}, ',') AND contains({t}, '.') THEN CASE WHEN regexp_matches({t}, ',[^.,]*$') THEN replace(replace({t}, '.', ''), ',', '.') ELSE replace({t}, ',', '') END WHEN contains({t}, ',') THEN CASE WHEN regexp_matches({t}, '^[^,]*,[^,]{{3}}$') THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END WHEN regexp_matches({t}, '^[^.]*\\.[^.]{{3}}$') THEN replace({t}, '.', '') ELSE {t} END"
    return double(f"({plain})")


def sheet_number(x: str) -> str:
    return double(f"replace(trim(regexp_replace(trim({x}), '\\*+$', '')), ',', '.')")


def day(y: str, m: str, d: str) -> str:
    return f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def ramp(diff: str, tolerance: float, gap: float, bonus: float, penalty: float) -> str:
    return f"CASE WHEN {diff} <= {tolerance} THEN {bonus}::DOUBLE WHEN {diff} >= {gap} THEN -{penalty}::DOUBLE ELSE {bonus}::DOUBLE - ({diff} - {tolerance}::DOUBLE) / {gap - tolerance}::DOUBLE * {bonus + penalty}::DOUBLE END"
