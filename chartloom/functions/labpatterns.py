"""Fixed values of the laboratory-mention grammar: patterns, word lists and translation tables."""

# Every pattern below defines the result and is written for java.util.regex.

FOOTNOTE = r"((\.\.\.|…)\s?([¹²³⁰⁴⁵⁶⁷⁸⁹0-9]))"
ELLIPSIS = "…"
SUPERSCRIPT = r"[⁰¹²³⁴⁵⁶⁷⁸⁹]"
GIGA_PER_LITRE = r"G\/+[lL]\b"
GIGA_PER_LITRE_UNIT = "x10*9/l"

DATE = r"(\d{2}/20\d{2}|\d{2}/\d{2}|20\d{2}-\d{2}-\d{2}|20\d{2}-\d{2}|20\d{2})"

RANGE = (
    r"([|¦][<>]\d+[\.,]?\d*$|"
    r"\(\s?[nN]?\s?:?\s?[<>]\s?\d+[\.\,]?\d*\s?\)?|"
    r"\(?\s?[nN]?\s?[:=]?\s?\d+[\.,]?\d*\s?[\-–]\s?\d+[\.,]?\d*\s?\)?)"
)
NOT_RANGE_CHAR = r"[^\d><\-–\.,]"

SUPERSCRIPT_DIGITS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
ACCENTS = ("ãäöüáàäčçďéêěèïíîĺľňóôŕšťúûůýž", "aaouaaaccdeeeeiiillnoorstuuuyz")

# (pattern, replacement) in order of application
MENTION_NOISE = (
    ("…", " "),
    (r"\\n", " "),
    (r"\n", " "),
    (r"\best\b", " "),
    (r"[\:\\]", " "),
    (r"\bcomprise?\b", " "),
    (r"\bavec\b", ""),
    (r"\bpour\b", ""),
    (r"\bsoit\b", ""),
    (r"\bdans\b", ""),
    (r"\bsans\b", ""),
    (r"\bselon\b", " "),
    (r"\s*\/\s*", "/"),
    (r"rapp?orts?", " "),
    (r"dosages?", " "),
    (r"numerations?", " "),
    (r"\bratio?\b", " "),
    ("µ", "micro"),
)

# qualitative result families, in order of precedence
QUALITATIVE = {
    "positif": (
        r"(?i)([¦|]?positifs?|[¦|]pos?i?t?\b|[¦|]?positiv?e?s?|\bpos\b|"
        r"[^a-zA-Z0-9]+(?:\+|p)[^a-zA-Z0-9]*$|^\+)"
    ),
    "negatif": (
        r"(?i)([¦|]?negatifs?|[¦|]neg?a?\b|[¦|]?negati?v?e?s?|\bneg\b|"
        r"[^a-zA-Z0-9]+(?:\-|n)[^a-zA-Z0-9]*$|^\-|^pas\sd[e'])"
    ),
    "augmente": r"(?i)(augmentee?s?|aug)",
    "dimunue": r"(?i)(diminuee?s?|dim)",
    "depasse": r"(?i)(depassee?s?)",
    "normal": r"(?i)(normale?s?|normaux?|correcte?s?|stable?s?|normo|normes?|\bnle\b)",
    "eleve": r"(?i)(elevee?s?)",
    "basse": r"(?i)(basse?s?|\bbas\b)",
    "absent": r"(?i)(absente?s?|absences?|indetectables?)",
    "present": r"(?i)(presente?s?|presences?)",
    "non significatif": r"(?i)(non\s*sign?i?f?i?c?a?t?i?f?|\bns\b)",
    "physiologique": r"(?i)(physiol?o?g?i?q?u?e?s?|physio)",
    "fluctuante": r"(?i)(fluctuante?s?|fluctuen?t?e?s?|fluctuee?s?)",
    "hemolyse": r"(?i)(hemolysee?s?)",
}
NOT_QUALITATIVE_CHAR = r"[^\w+-]"

# (pattern, replacement) in order of application
UNIT_SPELLING = (
    (r"gramm?es?", "g"),
    (r"micr?o?", "µ"),
    (r"micor", "µ"),
    (r"moles?", "mol"),
    (r"molaires?", "mol"),
    (r"mill?i", "m"),
    (r"litres?", "l"),
    (r"secondes?", "sec"),
    (r"secs?", "sec"),
    (r"jours?", "j"),
    (r"par", "/"),
    (r"minutes?", "min"),
    (r"heures?", "h"),
    (r"\_", ""),
    (r"\n", ""),
    ("ℓ", "l"),
)
POWER_UNIT_GLUED = r"(?i)(\d+(?:\.\d+)?)(x?10\*\d+\/[A-Za-z]+)"
UNIT_GLUED = (
    r"(?i)(\d+)"
    r"(g?\/mm3|ml\s?\/\s?mi?n\s?\/\s?m2|ml\s?\/\s?mi?n\s?\/\s?1[.,]73\s?m2|"
    r"ml\s?\/\s?mi?n|µ?m?n?p?g\/24h|µ?u?m?n?p?g\s?\/\s?d?m?l|m?mol/24h|"
    r"seco?n?d?e?s?|minu?t?e?s?|µ?u?m?n?p?g\s?\/\s?mmol?|µ?u?m?n?p?mol\s?\/\s?"
    r"[a-z0-9µ]+|µ?u?m?n?p?g\s?\/\s?\w+?|mm\s?h\s?g\.?|µ?u?m?n?p?mol|\%|fl\b|"
    r"mgy\.cm|gigas?\s*\/?\w+?|µ?u?m?n?p?g\b|\/?mm\b|gl\b|mil?li\s*grammes?|"
    r"grammes?\s*\/?\s*\w*|micro\s*mol\/?\w*|\/?p?g?ml|m?osmol\/?\w*|molaires?|"
    r"u\s*\/\s*l|m?ui\s*\/\s*m?l|k?pa\b|[a-zA-Zµ]+\/\w+|µ?u?m?n?m\b|[|¦]µ?u?m?n?s\b|"
    r"\/[a-zA-Zµ]+\b)"
)
UNIT = (
    r"(?i)(x?10\*\d+\s?\/[a-z]{1,2}|g?\/mm3|ml\s?\/\s?mi?n\s?\/\s?m2|"
    r"ml\s?\/\s?mi?n\s?\/\s?1[.,]73\s?m2|ml\s?\/\s?mi?n|μ?µ?m?n?p?g\/24h|"
    r"µ?u?m?n?p?g\s?\/\s?d?m?l|m?mol/24h|seco?n?d?e?s?|\bminu?t?e?s?|"
    r"µ?u?m?n?p?g\s?\/\s?mmol?|μ?µ?u?m?n?p?mol\s?\/\s?[a-z0-9µμ]+|"
    r"μ?µ?u?m?n?p?g\s?\/\s?\w+|mm\s?h\s?g\.?|μ?µ?u?m?n?p?mol|\%|\bfl\b|"
    r"mgy\.cm|gigas?\s*\/?\w+|\bμ?µ?u?m?n?p?g\b|\/?mm\b|gl\b|mil?li\s*grammes?|"
    r"grammes?\s*\/?\s*\w*|micro\s*mol\/?\w*|\/?p?g?ml|m?osmol\/?\w*|molaires?|"
    r"u\s*\/\s*l|m?ui\s*\/\s*m?l|\bk?pa\b|[a-zA-Zµμμ]+\/\w+|\bµ?u?m?n?m\b|"
    r"[|¦]μ?µ?u?m?n?s\b|[\s|¦]\/[a-zA-Zµμ]+\b)"
)
UNIT_EDGE = "-,.¦| "

VALUE = r"([<>]?\s?\d+[\.\,]?\s?\d*\/\d+[\.\,]?\s?\d*|[<>]?\s?\d+[\.\,]?\s?\d*|\d)"
NOT_VALUE_CHAR = r"[^\d.,/<>]+"

SPECIMEN = (
    r"(?i)(sang\w*|urine\w*|serique\w*|plasma\w*|foetal\w*|capill?air\w*|serum|"
    r"urinaire\w*|\bur\b|selle\w*|vessie|veineux|veineuse|\blcr\b)"
)
FIRST_WORD = r"(?i)(\b[A-Za-z]+(\.[A-Za-z]+)*\b)"


def led(pattern: str, first: str) -> str:
    """The same pattern, tried only where a text goes on with ``first``: what every match of it begins with."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flags}(?={first})(?:{pattern[len(flags):]})"


# The patterns above as they are searched for: same matches, fewer tries. No unit begins with a digit, so the
# digits before a glued one are never given back; a letter no other unit begins with can only begin a rate.
DATE_SEARCH = led(DATE, r"\d\d")
RANGE_SEARCH = led(RANGE, r"[|¦(nN:=\s\d]")
QUALITATIVE_SEARCH = led("|".join(QUALITATIVE.values()), r"[^gjklmoqrtuvwxyz0-9]")
UNIT_GLUED_SEARCH = UNIT_GLUED.replace(r"(\d+)", r"(\d++)(?=[a-zµ%/|¦])", 1)
_RATE = r"[a-zA-Zµμμ]+\/\w+"
_RATE_SEARCH = r"[a-zA-Zµμμ]++\/\w+"
UNIT_SEARCH = (
    r"(?i)((?=[fgkmnopsuxµμ%/|¦1]|\s/)(?:"
    + UNIT[len("(?i)(") : -1].replace(_RATE, _RATE_SEARCH)
    + r")|(?=[abcdehijlqrtvwyz])"
    + _RATE_SEARCH
    + ")"
)
VALUE_SEARCH = led(VALUE, r"[<>\s\d]")

# Literals of which a text must hold one for the pattern to match.
NEEDED = {
    FOOTNOTE: ("...", "…"),
    ELLIPSIS: (ELLIPSIS,),
    SUPERSCRIPT: tuple("⁰¹²³⁴⁵⁶⁷⁸⁹"),
    GIGA_PER_LITRE: ("G/",),
    **{x: (x,) for x in ("⁹", "m²", "m³", "à", "µ", "ℓ", "micor", "par")},
    r"(\:)": (":",),
    r"\\n": ("\\n",),
    r"\n": ("\n",),
    r"\best\b": ("est",),
    r"[\:\\]": (":", "\\"),
    r"\bcomprise?\b": ("compris",),
    r"\bavec\b": ("avec",),
    r"\bpour\b": ("pour",),
    r"\bsoit\b": ("soit",),
    r"\bdans\b": ("dans",),
    r"\bsans\b": ("sans",),
    r"\bselon\b": ("selon",),
    r"\s*\/\s*": ("/",),
    r"rapp?orts?": ("rap",),
    r"dosages?": ("dosage",),
    r"numerations?": ("numeration",),
    r"\bratio?\b": ("rati",),
    r"gramm?es?": ("gram",),
    r"micr?o?": ("mic",),
    r"moles?": ("mole",),
    r"molaires?": ("molaire",),
    r"mill?i": ("mil",),
    r"litres?": ("litre",),
    r"secondes?": ("seconde",),
    r"secs?": ("sec",),
    r"jours?": ("jour",),
    r"minutes?": ("minute",),
    r"heures?": ("heure",),
    r"\_": ("_",),
    POWER_UNIT_GLUED: ("10*",),
    r"\bsur\b": ("sur",),
    "[<>-]": ("<", ">", "-"),
}
RANGE_NEEDS = ("-", "–", "(", "|", "¦")
# in lower case; a result may also be a sign or letter at an end of the text
QUALITATIVE_NEEDS = (
    "pos", "|po", "¦po", "neg", "|ne", "¦ne", "pas", "aug", "dim", "depasse", "norm", "correct", "stabl", "nle", "eleve", "bas",
    "absen", "indetectable", "presen", "sig", "ns", "physio", "fluctu", "hemolyse",
)
QUALITATIVE_EDGE = r"(?i)[^a-z0-9][-+pn][^a-z0-9]*$|^[-+]"

FIRST_NUMBER = r"(\d+[,\.]?\d*)"
POSITIVE_PREFIX = (
    r"([¦|]?positifs?|[¦|]pos?i?t?\b|[¦|]?positiv?e?s?|\bpos\b|"
    r"[^a-zA-Z0-9]+(?:\+|p)[^a-zA-Z0-9]*$|^\+|presente?s?|presences?)"
)
NEGATIVE_PREFIX = (
    r"([¦|]?negatifs?|[¦|]neg?a?\b|[¦|]?negati?v?e?s?|\bneg\b|"
    r"[^a-zA-Z0-9]+(?:\-|n)[^a-zA-Z0-9]*$|^\-|^pas\sd[e']|absente?s?|absences?|indetectables?)"
)

# words whose prefixes of two letters or more stand for a yes / no / normal result
POSITIVE_WORDS = ("positifs", "positives", "positivites", "presence", "presences")
NEGATIVE_WORDS = ("negatifs", "negatives", "negativites", "absences", "absents")
NORMAL_WORDS = ("normales", "normaux", "normalisations", "normalites")
POSITIVE_SIGNS = (r"\+", "p")
NEGATIVE_SIGNS = (r"\-", "n")
