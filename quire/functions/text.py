"""Text functions as Column expressions.

White space is one explicit class on every engine: the ASCII blanks and the
Unicode ones that common browsers count as such. Patterns that need a word
boundary use ``EDGE``, which knows ASCII words only, as Java's own is wider.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of white space, as a class for Java and RE2 alike.
BLANKS = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BLANK = f"[{BLANKS}]"
WORDCHAR = "[A-Za-z0-9_]"
EDGE = f"(?:(?<!{WORDCHAR})(?={WORDCHAR})|(?<={WORDCHAR})(?!{WORDCHAR}))"
TERM = "[a-z0-9]{3,}"

#: Words that a question is searched without.
QUESTION_WORDS = ("the", "and", "for", "what", "when", "where", "how", "who", "why", "does", "this", "that", "with", "from", "about", "please")

#: Typographic characters and their plain spelling.
FOLDED = {
    0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201B: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"',
    0x2013: "-", 0x2014: "-", 0x2212: "-", 0x00AD: "", 0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: "",
    0x00A0: " ", 0x202F: " ", 0x2009: " ", 0x2007: " ", 0x2026: "...", 0x2192: "->", 0x2190: "<-",
    0x00B7: ".", 0x2044: "/",
}

#: Patterns that a whole token or text must match.
LIST_MARKER = r"^(?:[•▪◦‣∙·●○■□–—*-]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxlcdmIVXLCDM]{1,6}[.)])$"
PAGE_REFERENCE = r"(?i)^(?:[0-9]{1,4}|[ivxlcdm]{1,9})(?:[ \t]*[,–—-][ \t]*(?:[0-9]{1,4}|[ivxlcdm]{1,9}))*$"
PLAIN_NUMBER = r"^[-+]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?$|^[-+]?[0-9]*\.?[0-9]+$"
#: What tells a font's family.
MONO = "mono|courier|consol|menlo|monaco|cascadia|typewriter|code|fixed"
SERIF = "times|serif|roman|georgia|garamond|cambria|palatino|book antiqua|minion"


#: The same code points, one by one.
BLANK_CHARS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def normalized(text: Column) -> Column:
    """Line ends as newlines, runs of spaces and tabs as one space, ends trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "[ \t]+", " "))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(f"([^{BLANKS}]+)"), F.lit(1))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def punctuated(text: Column) -> Column:
    """Pieces of a normalized text that end at ``.``, ``!`` or ``?`` before white space."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?]){BLANK}+"), trimmed), lambda s: s != "")


def long_lines(text: Column, least: int = 8) -> Column:
    return F.filter(F.transform(F.split(text, "\n+"), trimmed), lambda s: F.length(s) >= least)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, wherever ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(array: Column) -> Column:
    """0 to one less than the size of an array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def chunks(text: Column, size: int = 18, step: int = 12, least: int = 8) -> Column:
    """Overlapping runs of words."""

    def made(w: Column) -> Column:
        starts = F.filter(indices(w), lambda i: i % step == 0)
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")), lambda s: F.length(s) >= least)

    return let(words(F.when(F.length(text) >= least, text).otherwise("")), made)


def question_terms(question: Column) -> Column:
    return F.filter(terms(question), lambda w: ~w.isin(*QUESTION_WORDS))


def containment(sentence: Column, keywords: Column) -> Column:
    """How many of the keywords stand somewhere in the sentence."""
    low = F.lower(sentence)
    return F.aggregate(keywords, F.lit(0), lambda n, w: n + F.contains(low, w).cast("int"))


def word_offsets(text: Column) -> Column:
    """Words with their begin and end: array of (word, start, stop), 0-based, stop exclusive."""
    return matches(text, f"[^{BLANKS}]+")


#: Set on both sides of every match; texts that hold it are cut by the pattern itself.
MARK = "\x01"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups, in order: array of (value, start, stop)."""
    item = "struct<value:string,start:int,stop:int>"
    kind = f"struct<at:int,out:array<{item}>>"
    none = F.array().cast(f"array<{item}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out")).cast(kind)

    def placed(pairs: Column) -> Column:
        # what stands before each match, and the match
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["before"])
            stop = start + F.length(x["value"])
            one = F.struct(x["value"].alias("value"), start.alias("start"), stop.alias("stop"))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    def in_turn(pieces: Column) -> Column:
        # a piece between matches, a match, a piece, and so on to a last piece
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("value")))
        return F.when(F.size(pieces) == 1, none).when(F.size(pieces) > 1, placed(pairs))

    # a cut at one character needs no pattern, and one pass finds all matches
    marked = let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK), in_turn)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.filter(F.zip_with(F.split(text, pattern), found, lambda b, v: F.struct(b.alias("before"), v.alias("value"))), lambda x: x["value"].isNotNull())
    return F.when(F.contains(text, F.lit(MARK)), placed(pairs)).otherwise(marked)


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase, ignoring case, none within another."""
    low = F.lower(text)
    plain = phrase.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(plain), F.lit("")))) / len(plain)).cast("int")


def without_joiners(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{BLANKS}\x{{200b}}\x{{ad}}]", "")


def plain_markdown(text: Column) -> Column:
    """Inline marks taken off: bold, italic, code, links."""
    out = F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1")
    out = F.regexp_replace(out, r"\*(.+?)\*", "$1")
    out = F.regexp_replace(out, r"`(.+?)`", "$1")
    return F.regexp_replace(out, r"\[(.+?)\]\((.+?)\)", "$1")


def folded(text: Column) -> Column:
    one = {chr(k): v for k, v in FOLDED.items() if len(v) == 1}
    none = "".join(chr(k) for k, v in FOLDED.items() if not v)
    out = F.translate(text, "".join(one) + none, "".join(one.values()))
    for k, v in FOLDED.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(chr(k)), F.lit(v))
    return out


def latin1(text: Column) -> Column:
    """Only what Latin-1 fonts can spell."""
    return F.regexp_replace(text, r"[^\x{20}-\x{7e}\x{a0}-\x{ff}]", "")


def closed_up(text: Column, size: Column) -> Column:
    """A heading set with a space after each letter, closed up if it is large and long enough."""
    spaced = trimmed(text).rlike(f"^(?:[^{BLANKS}] )+[^{BLANKS}]$") & (size >= 14) & (F.length(text) >= 7)
    return F.when(spaced, F.regexp_replace(text, f" (?=[^{BLANKS}])", "")).otherwise(text)


def rejoined(lines: Column) -> Column:
    """Lines of a paragraph as one text; a word broken by a hyphen before a small letter is mended."""

    def glued(ls: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.try_element_at(ls, F.greatest(i, F.lit(1)))), F.try_element_at(ls, i + 2)
            breaks = lambda a, b: F.coalesce(a.rlike("[a-z][-\u2010\u00ad]$") & b.rlike("^[a-z]"), F.lit(False))
            own = F.when(breaks(line, after), F.regexp_replace(line, "[-\u2010\u00ad]$", "")).otherwise(line)
            return F.concat(F.when((i == 0) | breaks(before, line), "").otherwise(" "), own)

        return F.array_join(F.transform(ls, one), "")

    full = lambda ls: F.slice(ls, F.greatest(F.coalesce(F.array_position(F.transform(ls, lambda x: x != ""), True), F.lit(1)), F.lit(1)).cast("int"), F.size(ls))
    return let(let(lines, full), glued)


def escaped(text: Column) -> Column:
    """For XML; control characters that it forbids are dropped."""
    out = F.regexp_replace(text, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sheet_name(name: Column, number: Column) -> Column:
    """A worksheet name: forbidden characters as spaces, 31 characters at most, never empty. Numbers start at 1."""
    spare = F.concat(F.lit("Sheet"), number.cast("string"))
    full = F.when(name.isNull() | (name == ""), spare).otherwise(name)
    out = trimmed(F.substring(F.regexp_replace(full, r"[\\/*?:\[\]]", " "), 1, 31))
    return F.when(out == "", spare).otherwise(out)


def field_label(name: Column) -> Column:
    """Last part of a dotted field name, underscores as spaces."""
    out = trimmed(F.replace(F.element_at(F.split(name, r"\."), -1), F.lit("_"), F.lit(" ")))
    return F.when(out == "", name).otherwise(out)


def font_family(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike(MONO), "mono").when(low.rlike(SERIF), "serif").otherwise("sans")


def font_name(raw: Column) -> Column:
    """Subset prefix and style words taken off, humps spaced: (family, bold, italic)."""
    bare = F.trim(F.regexp_replace(raw, r"^[A-Z]{6}\+", ""))
    low = F.lower(bare)
    base = F.element_at(F.split(bare, "[-_,]"), 1)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(base, r"([a-z0-9])([A-Z])", "$1 $2"), " +", " "))
    family = F.when(spaced == "", F.when(low.rlike(MONO), "Courier New").otherwise("Arial")).otherwise(spaced)
    return F.struct(family.alias("family"), low.rlike("bold|black|heavy|semibold|demi").alias("bold"), low.rlike("italic|oblique").alias("italic"))


def plain_number(text: Column) -> Column:
    """The number that a text spells, if it is nothing else and short; commas group."""
    return F.when(text.rlike(PLAIN_NUMBER) & (F.length(text) < 16), F.replace(text, F.lit(","), F.lit("")).cast("double"))


def list_marker(token: Column) -> Column:
    return token.rlike(LIST_MARKER)


def page_reference(token: Column) -> Column:
    return token.rlike(PAGE_REFERENCE)


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    hundreds = [F.element_at(F.array(*map(F.lit, digits)), ((n / unit).cast("int") % 10) + 1) for unit, digits in ROMAN.items()]
    return F.concat(*hundreds)


#: Roman digits by place.
ROMAN = {
    1000: ("", "M", "MM", "MMM", "", "", "", "", "", ""),
    100: ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    10: ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    1: ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
}


def letters(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA, up to three letters; less than 1 counts as 1."""
    m = F.greatest(n, F.lit(1)) - 1
    one = lambda x: F.chr((65 + x).cast("int"))
    two, three = m - 26, m - 702
    return (
        F.when(m < 26, one(m))
        .when(m < 702, F.concat(one(F.floor(two / 26)), one(two % 26)))
        .otherwise(F.concat(one(F.floor(three / 676)), one(F.floor(three / 26) % 26), one(three % 26)))
    )


def list_number(kind: Column, n: Column) -> Column:
    """A list counter in the named format; other names mean decimal."""
    return (
        F.when(kind == "lowerLetter", F.lower(letters(n)))
        .when(kind == "upperLetter", letters(n))
        .when(kind == "lowerRoman", F.lower(roman(F.greatest(n, F.lit(1)))))
        .when(kind == "upperRoman", roman(F.greatest(n, F.lit(1))))
        .when(kind.isin("bullet", "none"), "")
        .otherwise(n.cast("string"))
    )


def tenth(x: Column) -> Column:
    """One decimal, half away from zero, as text."""
    n = F.floor(x * 10 + 0.5).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(tenth(n / 1024), F.lit(" KB"))).otherwise(F.concat(tenth(n / 1048576), F.lit(" MB")))


def renamed(name: Column, suffix: str) -> Column:
    """``x.pdf`` as ``x-suffix.pdf``; a name without it gets it."""
    base = F.regexp_replace(name, r"(?i)\.pdf$", "")
    return F.concat(F.when(base == "", "document").otherwise(base), F.lit(f"-{suffix}.pdf"))


def resolved_path(folder: Column, target: Column) -> Column:
    """A relative path against a folder, with ``.`` and ``..`` taken away; one that begins with a slash starts at the root."""
    steps = F.split(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", folder, target)), "/")

    def step(path: Column, name: Column) -> Column:
        down = F.concat(path, F.array(name))
        return F.when(name.isin("", "."), path).when(name == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(down)

    return F.when(target.isNotNull(), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/"))
