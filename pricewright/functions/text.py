"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright import vocabulary as v


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to a plain one and marks, and the plain ones; by rule."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            found[c] = plain
    return "".join(found), "".join(found.values())


_FROM, _TO = _accents()


def squash(text: Column) -> Column:
    """Lower case without accents, possessives and marks other than `. / -`, one blank apart; null is empty."""
    t = F.translate(F.coalesce(text, F.lit("")), _FROM, _TO)
    t = F.regexp_replace(t, r"[̀-ͯ]", "")
    for sign, plain in (("½", "1 2"), ("¼", "1 4"), ("¾", "3 4"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        t = F.replace(t, F.lit(sign), F.lit(plain))
    t = F.regexp_replace(F.lower(t), r"[’']s\b", "")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^a-z0-9./-]+", " ")
    return F.trim(t)


def tokens(text: Column) -> Column:
    """The words of a squashed text: runs of letters, digits and dots."""
    return F.regexp_extract_all(squash(text), F.lit(r"([a-z0-9.]+)"), 1)


def variants(token: Column) -> Column:
    """What a model number with a version may be asked for: `990v6` as 990 and v6; else nothing."""
    hit = token.rlike(r"^\d{2,4}v\d{1,2}$")
    return F.when(hit, F.array(F.regexp_extract(token, r"^(\d+)", 1), F.regexp_extract(token, r"(v\d+)$", 1))).otherwise(F.array().cast("array<string>"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(squash(text), "[^a-z0-9]+", "-"), F.lit("-"))


def style_code(text: Column) -> Column:
    """Canonical code: capitals, no blanks or underscores, single hyphens inside only."""
    t = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[\s_]+", "")
    return F.trim(F.regexp_replace(t, "-{2,}", "-"), F.lit("-"))


def find_style_code(text: Column, brand: Column | None = None) -> Column:
    """The first code in a text, by the brand's formats in their order, or by any format for other brands; '' if none."""
    up = F.upper(F.coalesce(text, F.lit("")))

    def first(formats: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_extract(up, p, 1), F.lit("")) for p in formats), F.lit(""))

    anything = first((v.ANY_CODE,))
    if brand is None:
        return anything
    return reduce(lambda out, b: F.when(brand == b, first(v.CODE_FORMATS[b])).otherwise(out), v.CODE_FORMATS, anything)


def brand_of(text: Column) -> Column:
    """The first brand one of whose names stands in a text as whole words; '' if none."""
    t = F.concat(F.lit(" "), squash(text), F.lit(" "))
    has = lambda names: reduce(lambda a, b: a | b, (F.contains(t, F.lit(f" {n} ")) for n in names))
    return F.coalesce(*(F.when(has(names), F.lit(b)) for b, names in v.BRANDS.items()), F.lit(""))


def gender_of(text: Column) -> Column:
    return F.coalesce(*(F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){p}"), F.lit(g)) for p, g in v.GENDERS), F.lit(""))


def _blank(t: Column, words: tuple[str, ...] | list[str]) -> Column:
    """t with whole words of the list, longest first, blanked."""
    ordered = sorted(words, key=len, reverse=True)
    return F.regexp_replace(t, r"\b(?:" + "|".join(w.replace(".", r"\.") for w in ordered) + r")\b", " ")


def tidy(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "), F.lit(" -/"))


def strip_noise(text: Column) -> Column:
    """A squashed text without phrases of commerce, audiences and kinds of goods."""
    t = F.regexp_replace(squash(text), "|".join(v.NOISE_PHRASES), " ")
    t = F.regexp_replace(t, "|".join(p for p, _ in v.GENDERS), " ")
    return tidy(_blank(t, v.NOISE_WORDS))


def _any_colour(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, v.COLOURS)))


def looks_like_colourway(text: Column) -> Column:
    t = squash(text)
    return (t != "") & (_any_colour(F.split(t, r"[\s/]+")) | (F.contains(t, F.lit("/")) & (F.length(t) <= 40)))


def colourway(text: Column) -> Column:
    """Distinct colours in their order, ` / ` between; `x and y` is two where both sides have a colour."""
    t = F.regexp_replace(squash(text), r"\b(?:colou?r|colorway)\b", " ")
    chunks = F.filter(F.transform(F.split(t, "[/,]"), lambda x: F.trim(x)), lambda c: c != "")
    halves = lambda c: F.filter(F.transform(F.split(c, " and "), lambda x: F.trim(x)), lambda h: h != "")
    both = lambda c: F.contains(c, F.lit(" and ")) & F.forall(halves(c), lambda h: _any_colour(F.split(h, r"\s+")))
    parts = F.flatten(F.transform(chunks, lambda c: F.when(both(c), halves(c)).otherwise(F.array(c))))
    return F.array_join(F.array_distinct(F.transform(parts, lambda p: F.regexp_replace(p, r"\s+", " "))), " / ")


_COLOUR_RUN = "(?:" + "|".join(v.COLOURS) + ")"
_TAIL = rf"^(.*?\S)((?:\s+/*{_COLOUR_RUN}(?:/+{_COLOUR_RUN})*/*)+)$"


def let(x: Column, body) -> Column:
    """body(x) with x computed once, however often body has it."""
    return F.element_at(F.transform(F.array(x), lambda v: body(v)), 1)


def parse_title(title: Column, brand_hint: Column | None = None) -> Column:
    """A title as struct(brand, model, colorway, style_code, gender).

    The code and brackets go first; a last part behind a dash or bar that looks like
    colours is the colourway, else a run of colours at the model's end is.
    The brand's names go before noise words, which has `new` among them.
    """
    raw = F.coalesce(title, F.lit(""))
    hinted = brand_of(raw) if brand_hint is None else F.coalesce(F.nullif(brand_of(brand_hint), F.lit("")), brand_of(raw))

    def with_brand(brand: Column) -> Column:
        return let(style_code(find_style_code(raw, brand)), lambda code: let(without(code), lambda parts: let(looks_last(parts), lambda has: with_parts(brand, code, parts, has))))

    def without(code: Column) -> Column:
        body = F.when(code != "", F.regexp_replace(raw, F.concat(F.lit("(?i)"), F.replace(code, F.lit("-"), F.lit("\\-"))), F.lit(" "))).otherwise(raw)
        return F.filter(F.transform(F.split(F.regexp_replace(body, r"[()\[\]]", " "), r"(?U)\s+[-–—]\s+|\s*\|\s*"), lambda x: F.trim(x)), lambda x: x != "")

    def looks_last(parts: Column) -> Column:
        return (F.size(parts) > 1) & looks_like_colourway(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))

    def with_parts(brand: Column, code: Column, parts: Column, has: Column) -> Column:
        head = F.array_join(F.when(has, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), " ")
        return let(let(squash(head), lambda h: model_of(brand, h)), lambda model: finish(brand, code, parts, has, model))

    def model_of(brand: Column, head: Column) -> Column:
        bare = head
        for b, names in v.BRANDS.items():
            bare = F.when(brand == b, _blank(_blank(head, [n for n in names if n not in v.KEPT_ALIASES]), v.SUBLABELS)).otherwise(bare)
        words = F.filter(F.split(strip_noise(bare), r"\s+"), lambda w: (F.length(w) > 1) | w.rlike(r"^\d$"))
        return F.array_join(words, " ")

    def finish(brand: Column, code: Column, parts: Column, has: Column, model: Column) -> Column:
        tail = F.when(has, F.lit("")).otherwise(F.regexp_extract(model, _TAIL, 2))
        kept = F.when(~has & (F.regexp_extract(model, _TAIL, 2) != ""), F.regexp_extract(model, _TAIL, 1)).otherwise(model)
        shown = F.when(has, F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))).otherwise(tail)
        return F.struct(brand.alias("brand"), tidy(kept).alias("model"), colourway(shown).alias("colorway"), code.alias("style_code"), gender_of(raw).alias("gender"))

    return let(hinted, with_brand)


def price(text: Column) -> Column:
    """A price in a text as struct(amount, currency): the first number, at most two decimals; amount null if there is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    number = r"(US\$|CA\$|[$£€])?\s*(\d[\d,]*(?:\.\d{1,2})?)"
    named = F.coalesce(*(F.when(F.contains(F.upper(t), F.lit(c)), F.lit(c)) for c in ("USD", "GBP", "EUR", "CAD")), F.lit("USD"))
    sign = F.regexp_extract(t, number, 1)
    currency = F.when(sign.isin("$", "US$"), "USD").when(sign == "£", "GBP").when(sign == "€", "EUR").when(sign == "CA$", "CAD").otherwise(named)
    amount = F.replace(F.regexp_extract(t, number, 2), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(amount.alias("amount"), currency.alias("currency"))


def shoe_size(text: Column) -> Column:
    """`US M 10.5`, `10 1/2` or `10½` as 10.5; lower case where there is no number."""
    t = F.replace(F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("½"), F.lit(".5")), F.lit(" 1/2"), F.lit(".5"))
    n = F.regexp_extract(t, r"(\d{1,2}(?:\.5)?)", 1)
    return F.when(n == "", F.lower(t)).otherwise(F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"\.0$", ""))


def shoe_sizes(sizes: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(sizes, F.array().cast("array<string>")), shoe_size), lambda s: s != ""))


def title_case(text: Column) -> Column:
    """Each word with a capital, acronyms in capitals."""
    up = F.array(*map(F.lit, v.ACRONYMS))
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.when(F.array_contains(up, F.lower(w)), F.upper(w)).otherwise(F.initcap(w))), " ")


def money_text(amount: Column, currency: Column) -> Column:
    sign = F.coalesce(*(F.when(F.upper(currency) == c, F.lit(s)) for c, s in v.CURRENCY_SIGNS.items()), F.concat(F.upper(currency), F.lit(" ")))
    return F.when(amount.isNull(), "n/a").otherwise(F.concat(sign, F.format_number(amount, 2)))


def summary(row: str = "") -> Column:
    """What a listing is embedded as: its non-empty fields, a blank apart."""
    at = f"{row}." if row else ""
    return F.concat_ws(" ", *(F.nullif(F.col(at + c), F.lit("")) for c in ("brand", "model", "colorway", "style_code", "gender", "source_name", "title")))
