"""Column functions on text: accents, keys, names, spans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.labpatterns import ACCENTS

# Letters outside ASCII that drug and test names use, with their plain spelling.
PLAIN_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝčďěĺľňŕřšťůžµ"
PLAIN_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYcdellnrrstuzu"
LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) regex rules in order."""
    out = _col(c)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return out


def named(c, f: Callable[[Column], Column]) -> Column:
    """``f`` of an expression that it reads several times and that is worked out once."""
    return F.get(F.transform(F.array(_col(c)), f), F.lit(0))


def holds(c, literals: Iterable[str]) -> Column:
    """The text holds one of the literals; null for a null text."""
    return reduce(Column.__or__, [F.contains(_col(c), F.lit(x)) for x in literals])


def replace_held(c, rules: Iterable[tuple[str, str]], needed: Mapping[str, Sequence[str]]) -> Column:
    """``replace_all`` that searches a text for a pattern only if it holds one of the literals ``needed`` names for it.

    A pattern that is its own needed literal is replaced as plain text; one that is not named is always searched for.
    """
    out = _col(c)
    for pattern, to in rules:
        literals = needed.get(pattern)
        if literals is None:
            out = F.regexp_replace(out, pattern, to)
        elif tuple(literals) == (pattern,):
            out = F.replace(out, F.lit(pattern), F.lit(to))
        else:
            out = named(out, lambda x: F.when(holds(x, literals), F.regexp_replace(x, pattern, to)).otherwise(x))
    return out


def extract_if(c, may: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` of the texts that may match; the others give empty text, null gives null."""
    return F.when(~may, F.lit("")).otherwise(F.regexp_extract(_col(c), pattern, group))


def empty_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def plain_decimal(c) -> Column:
    """A written number as plain decimal text with at least one decimal; null if it is no number.

    Worked out on the text itself, so no value turns into an exponent or is rounded.
    """
    t = F.replace(_col(c), F.lit(","), F.lit("."))
    dotted = F.when(t.contains("."), t).otherwise(F.concat(t, F.lit(".")))
    cut = F.regexp_replace(F.regexp_replace(dotted, r"0+$", ""), r"\.$", ".0")
    led = F.regexp_replace(F.regexp_replace(cut, r"^0+", ""), r"^\.", "0.")
    return F.when(t.rlike(r"^[0-9]*\.?[0-9]*$") & t.rlike(r"[0-9]"), led)


def beyond_ascii(c) -> Column:
    """The text has a character of more than one byte."""
    return F.octet_length(_col(c)) > F.length(_col(c))


def strip_space(c) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def translate_beyond_ascii(c, table: tuple[str, str]) -> Column:
    """``translate`` by a table without ASCII characters: plain texts need no look at each character."""
    return named(c, lambda x: F.when(beyond_ascii(x), F.translate(x, *table)).otherwise(x))


def fold_accents(c) -> Column:
    """Lower case, then the accent table of the mention grammar."""
    return translate_beyond_ascii(F.lower(_col(c)), ACCENTS)


def plain_ascii(c) -> Column:
    """Letters with diacritics and ligatures spelled in ASCII."""
    out = _col(c)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, PLAIN_FROM, PLAIN_TO)


def mention_key(c) -> Column:
    """Lower case, trimmed, plain ASCII: the key drug names are compared on."""
    return plain_ascii(F.trim(F.lower(_col(c))))


def product_key(c) -> Column:
    """First word of a product label, as a mention key."""
    return mention_key(F.element_at(F.split(F.trim(_col(c)), r"\s+"), 1))


def is_combination(c) -> Column:
    """A label that joins two upper-case substances with a slash.

    Words are compared two by two, so a label of one word never counts.
    """
    words = F.split(F.trim(_col(c)), r"\s+")
    return (F.size(words) > 1) & F.array_join(words, " ").rlike(r"[A-Z]+/[A-Z]+")


def sorted_tokens(c) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")), " ")


def test_name(c) -> Column:
    """Short name out of ``CODE: name_suffix``; a value without ``:`` is an error."""
    c = _col(c)
    after = F.substring(c, F.instr(c, ":") + 1, F.length(c))
    name = F.trim(F.substring_index(after, "_", 1))
    missing = c.isNotNull() & (F.instr(c, ":") == 0)
    return F.when(missing, F.raise_error(F.concat(F.lit("no ':' in concept name "), c))).otherwise(name)


def note_id_from_source(c) -> Column:
    """File name to note id: up to the first dot, then up to the first underscore."""
    return F.substring_index(F.substring_index(_col(c), ".", 1), "_", 1)


def drop_extension(c, n: int = 4) -> Column:
    c = _col(c)
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def override_code(code, concept, value: str, to_code: str) -> Column:
    """``to_code`` where the concept column holds ``value``, the given code otherwise."""
    return F.when(_col(concept) == F.lit(value), F.lit(to_code)).otherwise(_col(code))


def span_bounds(c) -> tuple[Column, Column]:
    """Outer bounds of an offsets text such as ``10 14;16 20``."""
    c = _col(c)
    pattern = r"^(\d+).*\s(\d+)$"
    return (
        empty_to_null(F.regexp_extract(c, pattern, 1)).cast("int"),
        empty_to_null(F.regexp_extract(c, pattern, 2)).cast("int"),
    )


def clean_vocab_text(
    c,
    cased: bool = False,
    stopwords: Sequence[str] = (),
    special_characters: bool = True,
) -> Column:
    """Spelling used for both sides of a vocabulary match.

    ``special_characters=True`` blanks everything but letters, digits and spaces.
    Stop words are matched on whole words after accents are gone.
    """
    # Abbreviations spelled out, in order of application.
    spelled = [
        ("-", " "),
        ("ag ", "antigene "),
        ("ac ", "anticorps "),
        ("antigenes ", "antigene "),
        ("anticorps ", "antibody "),
    ]
    if cased:
        spelled += [
            ("Ag ", "Antigene "),
            ("Ac ", "Anticorps "),
            ("Antigenes ", "Antigene "),
            ("Anticorps ", "Antibody "),
        ]
    out = _col(c) if cased else F.lower(_col(c))
    for a, b in spelled:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = plain_ascii(out)
    if stopwords:
        out = F.regexp_replace(out, r"(?i)\b(?:" + "|".join(stopwords) + r")\b", "")
    if special_characters:
        out = F.regexp_replace(out, r"[^a-zA-Z0-9\s]", " ")
    return strip_space(F.regexp_replace(out, " +", " "))


# Words left out of laboratory names before they are compared.
LAB_STOPWORDS = (
    "for", "assay", "by", "tests", "minute", "exam", "with", "human", "moyenne", "in", "to", "from",
    "analyse", "test", "level", "fluid", "laboratory", "determination", "examination", "releasing",
    "quantitative", "screening", "and", "exploration", "factor", "method", "analysis", "laboratoire",
    "specimen", "or", "typing", "of", "concentration", "measurement", "detection", "procedure",
    "identification", "numeration", "hour", "retired", "technique", "count",
)


def code_prefixes(c) -> Column:
    """Every prefix of every code of an array, distinct."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(_col(c), lambda x: x.isNotNull() & (x != "")),
                lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda n: F.substring(x, F.lit(1), n)),
            )
        )
    )


def codes_hit(pred, gold, hierarchical: bool = False) -> Column:
    """Predicted and gold code sets meet; with ``hierarchical`` any prefix of a predicted code counts."""
    pred = code_prefixes(pred) if hierarchical else _col(pred)
    return F.coalesce(F.arrays_overlap(pred, _col(gold)), F.lit(False))


def edit_similarity(a, b) -> Column:
    a, b = _col(a), _col(b)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def unit_vector(c, floor: float = 1e-12) -> Column:
    """Vector divided by its Euclidean norm."""
    c = _col(c)
    norm = F.greatest(F.sqrt(dot(c, c)), F.lit(floor))
    return F.transform(c, lambda x: x.cast("double") / norm)


def snippet(text, start, end, width: int = 50) -> tuple[Column, Column, Column]:
    """Text around a span and the span's offsets inside it.

    The window runs from ``width`` characters before the span to ``width`` after it, the
    character at its end included. Near the start of a note the window is shorter on the
    left and the offsets follow it.
    """
    text, start, end = _col(text), _col(start), _col(end)
    lo = F.greatest(start - width, F.lit(0))
    hi = F.least(end + width + 1, F.length(text))
    cut = F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))
    return cut, start - lo, end - lo


def inner_span(term, inner, start, end) -> tuple[Column, Column, Column]:
    """Offsets and text of ``inner`` inside ``term``; the whole term where it does not occur."""
    term, inner, start, end = _col(term), _col(inner), _col(start), _col(end)
    at = F.coalesce(F.position(inner, term), F.lit(0))
    found = at > 0
    return (
        F.when(found, inner).otherwise(term),
        F.when(found, start + at - 1).otherwise(start),
        F.when(found, start + at - 1 + F.length(inner)).otherwise(end),
    )
