"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Function words of the two document languages, in the order that breaks ties.
STOPWORDS = {
    "ro": "și si de la cu pe care este sunt pentru din sau nu al ale unei unui se prin privind".split(),
    "en": "the and of to is are for with that this be by on as or an which from at it".split(),
}
# Function words of questions.
RO_QUESTION = """a al ale am ar are as au ca care ce cel cea cei cele cand când cat cât cate câte cine cu cum da dar de
din dupa după e ea el este eu fi fie fost in în inca încă intre între la le lui mai ma mă mi ne nici nu o ori pe pentru
pot poate prin sa să se si și sunt sau spre tot toate un una unde unei unui va vor""".split()
EN_QUESTION = """a about all an and any are as at be been but by can could did do does for from has have how i if in
into is it its may me my no not of on or our should so than that the their them then there these they this to was we
were what when where which who why will with would you your""".split()
RO_ENDINGS = "(ul|ului|lor|ile|ele|ea|ii|ție|tie|eaza|ează|esc)$"
EN_ENDINGS = "(ing|ed|tion|ly|ness|ment|ies|ship)$"


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


# Fixed value: the name space of point ids.
POINT_SPACE = "6f9b1d9e2f4a4c7e9f1b3a7c5d8e0f21"


def point_id(chunk_id: Column) -> Column:
    """The UUID (version 5) of a chunk's id in the points' name space; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_SPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.when(chunk_id.isNotNull(), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def norm(text: Column) -> Column:
    """White space collapsed and stripped, lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" ")))


def repeat_key(text: Column) -> Column:
    return F.regexp_replace(norm(text), "[0-9]+", "#")


def _folds() -> tuple[str, str]:
    """Composed letters below U+2000 (Latin, Greek, Cyrillic ...) and the letter each folds to, by canonical decomposition."""
    apart = ((c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x2000)))
    pairs = [(c, d[0]) for c, d in apart if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents or combining marks (ß and œ stay)."""
    a, b = _folds()
    return F.regexp_replace(F.translate(F.lower(text), a, b), r"\p{Mn}+", "")


def accented_words(text: Column) -> Column:
    """Words in lower case, accents kept, without the signs inside them (combining marks are signs); words of signs only go."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda w: w != "")


_folded = str.maketrans(*_folds())


def fold_words(words: pa.Array) -> pa.Array:
    """Lower-case words without accents; Python sees only those that aren't ASCII."""
    odd = pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(words, odd, pa.array([w.translate(_folded) for w in words.filter(odd).to_pylist()], pa.string()))


def tokens(text: Column) -> Column:
    """Folded words without the signs inside them; words of signs only go."""
    cleaned = F.regexp_replace(F.regexp_replace(fold(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " ")
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


# The same in two parts: a column's words, and what they become.  Where words are counted, the second part sees distinct ones only.
tokens.parts = (accented_words, fold_words)


def document_language(text: Column) -> Column:
    """The language whose function words are more; the first one on a tie."""
    words = F.split(F.regexp_replace(F.lower(text), r"\s+", " "), " ")

    def count(stop: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stop)))

    return F.when(count(STOPWORDS["en"]) > count(STOPWORDS["ro"]), "en").otherwise("ro")


def question_language(text: Column) -> Column:
    """ro, en, or null when the question gives no clear signal."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)

    def points(stop: list[str], endings: str) -> Column:
        hits = F.size(F.filter(words, lambda w: w.isin(*stop)))
        ends = F.size(F.filter(words, lambda w: (F.length(w) > 4) & F.regexp_like(w, F.lit(endings))))
        return hits + ends * 0.5

    ro, en = points(RO_QUESTION, RO_ENDINGS), points(EN_QUESTION, EN_ENDINGS)
    return F.when(F.regexp_like(text, F.lit("[ăâîșțşţĂÂÎȘȚŞŢ]")), "ro").when(ro > en, "ro").when(en > ro, "en")


def roman_number(text: Column) -> Column:
    """Roman numerals, a letter before a larger one subtracted, without validation; Arabic digits are read as they are."""
    values = F.create_map(*[F.lit(x) for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in (k, v)])
    digits = F.transform(F.split(F.upper(text), ""), lambda c: F.element_at(values, c))
    value = F.aggregate(
        F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("right")),
        lambda a, d: F.struct(F.when(d < a["right"], a["sum"] - d).otherwise(a["sum"] + d).alias("sum"), d.alias("right")),
        lambda a: a["sum"],
    )
    return F.when(F.regexp_like(text, F.lit("^[0-9]+$")), text.try_cast("int")).otherwise(value)


def page_at(starts: Column, position: Column) -> Column:
    """The 1-based page of a position: how many pages start at or before it."""
    return F.size(F.filter(starts, lambda s: s <= position))


# Letters with a cedilla and the comma-below letters meant; ligatures and their letters.
CEDILLA = ("şŞţŢ", "șȘțȚ")
SPACES, UNSEEN = "\u00a0\u202f\u2007\u2009", "\u00ad\u200b\u200c\u200d\ufeff"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "œ": "oe", "Œ": "Oe"}


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    """A hundred texts at a time are Python's; the others stay Arrow's."""
    slices = (text.slice(lo, 100).to_pylist() for lo in range(0, len(text), 100))
    return pa.concat_arrays([pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in part], pa.string()) for part in slices] or [text])


def clean_text(text: Column, from_pdf: bool = False, compose: bool = True) -> Column:
    """Line ends, Unicode composition, unseen characters, ligatures and blank lines normalised.

    Composition (NFC) is the one step Spark has no function for; it is an Arrow UDF that `compose` leaves out for text
    known to be composed.
    """
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = _nfc(out) if compose else out
    out = F.regexp_replace(out, "\u00ad[ \t]*\n[ \t]*", "")
    out = F.translate(out, CEDILLA[0] + SPACES + UNSEEN, CEDILLA[1] + " " * len(SPACES))
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    if from_pdf:
        out = F.regexp_replace(F.regexp_replace(out, r"(?U)(\w)-\n(\w)", "$1$2"), "[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def embedding_text(text: Column, heading_path: Column) -> Column:
    """The parts of the heading path that are no heading lines of the text, a blank line, the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*#")))
    shown = F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, r"^\s*#+", "")))
    missing = F.filter(F.split(heading_path, " > "), lambda p: ~F.array_contains(shown, p))
    return F.when((heading_path != "") & (F.size(missing) > 0), F.concat(F.array_join(missing, " > "), F.lit("\n\n"), text)).otherwise(text)


def folder_of(source: Column) -> Column:
    return F.split_part(source, F.lit("/"), F.lit(1))


# Words that name a document's divisions, from the widest to the narrowest.
DIVISIONS = ["partea|titlul|cartea|part|title|book", r"capitolul|cap\.|chapter", "sec[țt]iunea|section|subcapitolul", r"articolul|art\.|article|§", "anexa|annex|appendix"]
HEADING_MAX = 120


def pattern_rank(line: Column) -> Column:
    """How deep a line's wording puts it (0 is widest), null for ordinary text.

    0-4: a division's word and number; 10-15: numbered titles by their dots; 20: capitals only.
    """
    t = F.btrim(line)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\p{Lu}", 1)
    rank = F.when((F.length(t) < 2) | (F.length(t) > HEADING_MAX) | F.right(t, F.lit(1)).isin(*".,;:"), F.lit(None))
    for i, words in enumerate(DIVISIONS):
        rank = rank.when(F.regexp_like(t, F.lit(rf"(?iu)^({words})\s*[:.]?\s*([IVXLCDM]+|[0-9]+)\b")), i)
    rank = rank.when(number != "", 10 + F.least(F.length(number) - F.length(F.replace(number, F.lit("."))), F.lit(5)))
    return rank.when(F.regexp_like(t, F.lit(r"^(\P{L}*\p{Lu}){3}")) & ~F.regexp_like(t, F.lit(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")), 20)


def pattern_levels(lines: Column) -> Column:
    """One level or null per line: the ranks in use, made dense, six at most; numbered titles count from two on."""
    ranks = F.transform(lines, pattern_rank)
    numbered = lambda r: (r >= 10) & (r < 20)
    used = F.when(F.size(F.filter(ranks, numbered)) < 2, F.transform(ranks, lambda r: F.when(~numbered(r), r))).otherwise(ranks)
    order = F.array_sort(F.array_distinct(F.filter(used, lambda r: r.isNotNull())))
    return F.transform(used, lambda r: F.when(r.isNotNull(), F.least(F.array_position(order, r), F.lit(6))))


def mark_headings(text: Column) -> Column:
    """Lines that read like headings get "#" by level; the document stays one row."""
    lines = F.split(text, "\n")
    marked = F.zip_with(lines, pattern_levels(lines), lambda x, n: F.when(n.isNull(), x).otherwise(F.concat(F.repeat(F.lit("#"), n.cast("int")), F.lit(" "), F.btrim(x))))
    return F.array_join(marked, "\n")


def clean_heading(text: Column) -> Column:
    """Without emphasis, leading numbers and the signs around it."""
    bare = F.btrim(F.regexp_replace(text, "[*_`]+", ""))
    return F.btrim(F.regexp_replace(bare, r"^([0-9]+(\.[0-9]+)*|[A-Z]|[IVXLC]+)[.)]\s+", ""), F.lit(" .:-–"))


def usable_heading(text: Column) -> Column:
    """Whether a heading reads as a topic: a few words, a capital first, no digits or abbreviations."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    like = lambda p: F.regexp_like(text, F.lit(p))
    return (
        F.size(words).between(3, 10) & F.length(text).between(15, 80)
        & (F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, r"\P{L}", "")) >= 4)) >= 2)
        & like(r"^\p{Lu}") & like(r"\p{Ll}") & ~like("[0-9]") & ~like(r"(?U)\b\w{1,5}\.\s") & ~like("[?;,]$")
        & ~like(r"(?iU)^(art|articolul|article|capitolul|chapter|anexa|annex)\b")
    )
