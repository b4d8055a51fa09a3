"""Normalisation of names and addresses as Column expressions.

Nulls are the empty text throughout.  Everything runs in the JVM except
Unicode composition and decomposition, which Spark lacks: one Arrow UDF, and
none for ASCII-only text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Abbreviations of legal forms, in the order they are expanded.
LEGAL_FORMS = {
    "corp": "corporation",
    "pvt": "private",
    "ltd": "limited",
    "inc": "incorporated",
    "llc": "limited liability company",
    "llp": "limited liability partnership",
    "pllc": "professional limited liability company",
    "plc": "public limited company",
    "co": "company",
}
# Abbreviations of street words.
STREET_WORDS = {
    "rd": "road",
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "ln": "lane",
    "dr": "drive",
    "ct": "court",
    "pl": "place",
    "ter": "terrace",
    "pkwy": "parkway",
}
# Words that are no blocking tokens.
STOPWORDS = ["the", "a", "an", "and", "or", "in", "on", "at", "to", "of", "for", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might"]
# Words left out of acronyms.
ACRONYM_STOP = ["inc", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "sarl", "sasu", "eurl", "sa", "and", "&", "de", "du", "la", "le", "the", "of", "co", "company"]
# Devanagari letters, signs and digits in Latin.
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ॠ": "ree", "ऌ": "li", "ॡ": "lee", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o",
    "क": "ka", "ख": "kha", "ग": "ga", "घ": "gha", "ङ": "nga", "च": "cha", "छ": "chha", "ज": "ja", "झ": "jha", "ञ": "nya",
    "ट": "ta", "ठ": "tha", "ड": "da", "ढ": "dha", "ण": "na", "त": "ta", "थ": "tha", "द": "da", "ध": "dha", "न": "na",
    "प": "pa", "फ": "pha", "ब": "ba", "भ": "bha", "म": "ma", "य": "ya", "र": "ra", "ल": "la", "व": "va", "श": "sha", "ष": "sha", "स": "sa", "ह": "ha",
    "ः": "h", "ं": "n",
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}
#: Vowel signs and the virama, which end the inherent vowel: our own rule.
VOWEL_SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "्": ""}
WORD = r"[\p{L}\p{N}_]+"


# Latin letters that have no decomposition, lower case.
LATIN = {"æ": "ae", "œ": "oe", "ø": "o", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĸ": "k", "ſ": "s", "ə": "e", "ƒ": "f"}

# Greek and Cyrillic letters in Latin, lower case.
GREEK = {"α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o"}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "ђ": "dj", "є": "ye", "і": "i", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ґ": "g",
}
LETTERS = LATIN | GREEK | CYRILLIC


def indic_letter(c: str) -> tuple[str, bool] | None:
    """The Latin form of an Indic letter or sign from its Unicode name, and
    whether it replaces the inherent vowel before it; None for other characters."""
    if not "\u0900" <= c <= "\u0dff":
        return None
    if c in DEVANAGARI:
        return DEVANAGARI[c], False
    name = unicodedata.name(c, "")
    if "VIRAMA" in name or "AL-LAKUNA" in name:
        return "", True
    if " VOWEL SIGN " in name:
        return VOWEL_SIGNS.get(c, name.rsplit(" ", 1)[1].lower()), True
    if " DIGIT " in name:
        return str(unicodedata.digit(c)), False
    if " SIGN ANUSVARA" in name or " SIGN CANDRABINDU" in name:
        return "n", False
    if " SIGN VISARGA" in name:
        return "h", False
    return (name.rsplit(" ", 1)[1].lower(), False) if " LETTER " in name else ("", False)


def transliterated(text: str) -> str:
    """N2 of a string: a consonant's vowel gives way to a vowel sign.  Indic
    scripts other than Devanagari go by the names of their letters."""
    out: list[str] = []
    for c in text:
        found = indic_letter(c)
        if found is None:
            out.append(c)
            continue
        if found[1] and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1]
        out.append(found[0])
    return "".join(out)


def latin_letter(c: str) -> str:
    """A letter in Latin; one of a script without a table stays as it is."""
    if c < "\u0080":
        return c
    low = c.lower()
    found = LETTERS.get(low)
    if found is None:
        return c if c.isalpha() or c.isdigit() else ""
    return found if c == low else found.capitalize()


def plain_latin(text: str) -> str:
    """N13 of a string: signs dropped, letters in Latin.  Letters of scripts
    without a table (Chinese, Arabic and others) are kept, so that no name is lost."""
    known = "".join(latin_letter(c) if c.lower() in CYRILLIC else c for c in transliterated(text))
    plain = "".join(c for c in unicodedata.normalize("NFKD", known) if not unicodedata.combining(c))
    return "".join(map(latin_letter, plain))


def composed(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _unless_ascii(text: Column, function) -> Column:
    """``text``, or ``function`` of it where it has other characters; an Arrow
    UDF, made on the driver, gets only those."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    udf = F.pandas_udf(run, StringType())
    other = ~text.rlike(r"^[\x00-\x7F]*$")
    return F.when(other, udf(F.when(other, text))).otherwise(text)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalize_unicode(text: Column) -> Column:
    """Compatibility composition (NFKC)."""
    return _unless_ascii(blank(text), composed)


def to_ascii(text: Column) -> Column:
    """Indic, Greek and Cyrillic letters in Latin, accents dropped, other scripts kept."""
    return _unless_ascii(text, plain_latin)


def expand_legal_forms(text: Column) -> Column:
    """N3."""
    for short, full in LEGAL_FORMS.items():
        text = F.regexp_replace(text, rf"(?i)\b{short}\b", full)
    return text


def strip_legal_form(text: Column) -> Column:
    """Each full form once, in order, at the end and at the start."""
    for form in LEGAL_FORMS.values():
        text = F.regexp_replace(F.regexp_replace(text, rf"\s+{form}\s*$", ""), rf"^{form}\s+", "")
    return F.trim(text)


def numeric_signature(text: Column) -> Column:
    """All runs of digits."""
    return F.array_join(F.regexp_extract_all(blank(text), F.lit(r"(\p{Nd}+)"), F.lit(1)), " ")


def street_number(text: Column) -> Column:
    """N6."""
    return F.regexp_extract(F.trim(blank(text)), r"^(\p{Nd}+)", 1)


def postal_code(text: Column) -> Column:
    """The first number of five or six digits."""
    return F.regexp_extract(blank(text), r"\b(\d{5,6})\b", 1)


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _python_name(name: str) -> str:
    text = composed(name).lower().strip()
    for short, full in LEGAL_FORMS.items():
        text = re.sub(rf"\b{short}\b", full, text)
    return " ".join(plain_latin(text).replace("&", "and").replace("'", "").replace('"', "").split())


def _python_address(address: str) -> str:
    text = plain_latin(composed(address).lower().strip())
    for short, full in STREET_WORDS.items():
        text = re.sub(rf"\b{short}\b", full, text)
    return " ".join(text.replace("&", "and").split())


def _by_script(raw: Column, ascii_: Column, function) -> Column:
    """``ascii_`` for ASCII texts; the rest go whole through one Arrow UDF, so
    that no expression is repeated inside another."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    other = ~raw.rlike(r"^[\x00-\x7F]*$")
    return F.when(other, F.pandas_udf(run, StringType())(F.when(other, raw))).otherwise(ascii_)


def normalize_name(name: Column) -> Column:
    """Compose, lower-case, expand legal forms, Latin letters, ``&`` as
    "and", no quotes, single blanks."""
    raw = blank(name)
    text = F.regexp_replace(expand_legal_forms(F.trim(F.lower(raw))), "&", "and")
    return _by_script(raw, _collapsed(F.translate(text, "'\"", "")), _python_name)


def name_variants(name: Column) -> Column:
    """Normalized, root, raw, ascii and ascii_root."""
    normal, plain = normalize_name(name), to_ascii(blank(name))
    return F.struct(normal.alias("normalized"), strip_legal_form(normal).alias("root"), blank(name).alias("raw"), plain.alias("ascii"), strip_legal_form(F.lower(plain)).alias("ascii_root"))


def normalize_address(address: Column) -> Column:
    """Compose, lower-case, Latin letters, street words in full, ``&`` as
    "and", single blanks."""
    raw = blank(address)
    text = F.trim(F.lower(raw))
    for short, full in STREET_WORDS.items():
        text = F.regexp_replace(text, rf"(?i)\b{short}\b", full)
    return _by_script(raw, _collapsed(F.regexp_replace(text, "&", "and")), _python_address)


def address_parts(address: Column) -> Column:
    """Normalized, street_num, postal_code and raw; numbers before transliteration."""
    first = F.trim(F.lower(normalize_unicode(address)))
    return F.struct(normalize_address(address).alias("normalized"), street_number(first).alias("street_num"), postal_code(first).alias("postal_code"), blank(address).alias("raw"))


def simple_text(text: Column) -> Column:
    """Lower case, letters a-z and digits."""
    return _collapsed(F.regexp_replace(F.lower(blank(text)), r"[^a-z0-9\s]", " "))


def simple_tokens(text: Column) -> Column:
    """The distinct words of two characters and more."""
    return F.array_distinct(F.filter(F.split(simple_text(text), " "), lambda t: F.length(t) >= 2))


def tokens(text: Column, least: int = 2) -> Column:
    """Words that aren't stopwords, repeats kept."""
    found = F.regexp_extract_all(F.lower(blank(text)), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(STOPWORDS))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams without blanks; a text shorter than n is one."""
    dense = F.replace(text, F.lit(" "), F.lit(""))
    last = F.length(dense) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(dense, i, F.lit(n)))
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) < n, F.array(text)).when(last < 1, empty).otherwise(F.array_distinct(grams))


def words(text: Column) -> Column:
    return F.filter(F.split(blank(text), r"\s+"), lambda w: w != "")


def field_terms(name: Column, address: Column) -> Column:
    """Name words, address words and single digits, with their prefixes."""
    digits = F.filter(F.split(numeric_signature(address), ""), lambda d: d != "")
    mark = lambda p, ws: F.transform(ws, lambda w: F.concat(F.lit(p), w))
    return F.concat(mark("n:", words(name)), mark("a:", words(address)), mark("d:", digits))


def exact_key(name: Column) -> Column:
    """The sorted words of more than two characters, else the name."""
    key = F.array_join(F.array_sort(F.filter(words(name), lambda w: F.length(w) > 2)), " ")
    return F.when(key != "", key).otherwise(name)


def is_indic(text: Column) -> Column:
    """N20."""
    return blank(text).rlike(r"[ऀ-ൿ]")


def acronym(name: Column) -> Column:
    """First letters of the meaningful words, of all if there are none."""
    all_ = F.regexp_extract_all(F.lower(blank(name)), F.lit("([a-z]+)"), F.lit(1))
    main = F.filter(all_, lambda w: ~w.isin(ACRONYM_STOP))
    return F.array_join(F.transform(F.when(F.size(main) > 0, main).otherwise(all_), lambda w: F.substring(w, 1, 1)), "")


def acronym_match(a: Column, b: Column) -> Column:
    """b's letters are a's acronym, the acronyms agree, or b is short and inside it."""
    letters, of_a, of_b = F.regexp_replace(F.lower(blank(b)), "[^a-z]", ""), acronym(a), acronym(b)
    return ((letters != "") & (letters == of_a)) | ((of_a != "") & (of_a == of_b)) | ((letters != "") & (F.length(letters) <= 5) & F.contains(of_a, letters))


def integers(text: Column) -> Column:
    """The distinct integers among whole words; those too long for a long are left out."""
    found = F.regexp_extract_all(blank(text), F.lit(r"\b(\d+)\b"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()))


def country_from_id(number: Column) -> Column:
    """The country that a range of numeric ids stands for."""
    return F.when((number >= 700_000_000) & (number < 800_000_000), "France").when((number >= 400_000_000) & (number < 600_000_000), "India").otherwise("US")
