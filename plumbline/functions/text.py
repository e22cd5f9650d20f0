"""Text expressions: one place for the rules of white space, words, sentences and citations.

All are Spark columns. `(?U)` gives Java's classes their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words after which a full stop ends no sentence.
ABBREVIATIONS = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "e.g.", "i.e.", "fig.", "eq.", "eqs.", "al.", "no.",
    "nos.", "vol.", "pp.", "p.", "st.", "approx.", "cf.", "inc.", "ltd.", "co.", "corp.", "a.m.", "p.m.", "u.s.", "u.k.",
)
#: Stands between pieces of a text while they are put together, and what stands for it, and for itself,
#: where the text holds either.
CUT, ESCAPE = "\u0001", "\u0002"
#: White space of Unicode, as `(?U)\\s` has it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(x: Column, body) -> Column:
    """body(x) with x computed once: what a lambda takes from outside is computed for each element."""
    return F.transform(F.array(x), body)[0]


def escaped(c: Column) -> Column:
    """Without CUT; `unescaped` gives the text back."""
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(CUT), F.lit(ESCAPE + "a"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "a"), F.lit(CUT)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _cut_again(pieces: Column, glued) -> Column:
    """Joins each piece for which glued(piece, the piece before) holds to the piece before it."""
    def joined(ps: Column) -> Column:
        before = F.concat(F.array(F.lit("")), ps)
        marked = F.zip_with(ps, F.slice(before, 1, F.size(ps)), lambda p, b: F.concat(F.when(glued(p, b), F.lit(" ")).otherwise(F.lit(CUT)), escaped(p)))
        again = F.transform(F.split(F.substring(F.array_join(marked, ""), 2, 1 << 30), CUT), unescaped)
        return F.when(F.size(ps) == 0, F.array().cast("array<string>")).otherwise(again)

    return let(pieces, joined)


def sentences(c: Column, min_chars: int = 20) -> Column:
    """Sentences: cut after `.`, `!` or `?`; not after an abbreviation; short ones join the one before.

    Both merges look at one neighbour alone (a merged text ends as its last piece does, and a
    short piece is judged by itself), so each is one linear pass.
    """
    pieces = F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda p: p != "")
    last = lambda p: F.lower(F.element_at(F.split(p, " "), -1))
    whole = _cut_again(pieces, lambda p, before: last(before).isin(*ABBREVIATIONS))
    return _cut_again(whole, lambda p, before: F.length(p) < min_chars)


def first_sentence(c: Column) -> Column:
    return let(sentences(c), lambda found: F.when(F.size(found) > 0, found[0]).otherwise(strip(c)))


def or_whole(pieces: Column, c: Column) -> Column:
    """The pieces; where there are none, the stripped text, unless that is empty."""
    rest = F.when(strip(c) != "", F.array(strip(c))).otherwise(F.array().cast("array<string>"))
    rest = F.coalesce(rest, F.array().cast("array<string>"))
    return let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(rest))


def tokens(c: Column) -> Column:
    """Search terms: runs of a-z and 0-9 in the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def word_set(c: Column) -> Column:
    """Distinct words (Unicode) of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(c), " "), lambda w: w != ""))


def markdown_sections(c: Column) -> Column:
    """Sections that start with `## `; what stands before the first heading goes, empty ones too."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?m)^##\s+")
    texts = F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.filter(F.transform(texts, strip), lambda s: s != "")


def citations(c: Column) -> Column:
    """(claim, passage), both from 0: the first `[n]` of each raw sentence; `[0]` cites nothing.

    Raw sentences are counted, not merged ones, as a citing writer would.
    """
    raw = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+")
    found = F.transform(raw, lambda s, i: F.struct(i.alias("claim"), (F.regexp_extract(s, r"\[(\d{1,9})\]", 1).try_cast("int") - 1).alias("passage")))
    return F.filter(found, lambda x: x["passage"] >= 0)


def citation_markers(c: Column) -> Column:
    """Sorted distinct numbers of `[2]`, `[1, 2]` and `[1-4]`; ranges span 0 to 50."""
    groups = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([0-9][0-9,\s\-]*)\]"), F.lit(1))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), strip)

    def numbers(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(\d{1,9})\s*-\s*\d{1,9}$", 1).try_cast("int")
        high = F.regexp_extract(p, r"^\d{1,9}\s*-\s*(\d{1,9})$", 1).try_cast("int")
        one = F.when(p.rlike(r"^\d{1,9}$"), F.array(p.try_cast("int")))
        span = F.when((high - low).between(0, 50), F.sequence(low, high))
        return F.coalesce(span, one, F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def question_lines(c: Column, n: int) -> Column:
    """The first n non-empty lines, without list markers."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), r"^\s*(?:\d+[.)]|[-*•])\s*", "")))
    return F.slice(F.filter(bare, lambda x: x != ""), 1, n)


#: Openings of a situating sentence that are cut off.
PREAMBLES = ("context:", "this chunk", "this passage", "this section", "here is", "here's", "the following")


def situating_sentence(c: Column, most_words: int = 60) -> Column:
    """A model's situating sentence without preamble, of at most most_words words."""
    text = strip(F.coalesce(c, F.lit("")))
    opens = F.lit(False)
    for p in PREAMBLES:
        opens = opens | F.startswith(F.lower(text), F.lit(p))
    cut = F.when(opens & F.contains(F.left(text, F.lit(40)), F.lit(":")), strip(F.regexp_replace(text, r"(?s)^[^:]*:", ""))).otherwise(text)
    words = F.filter(F.split(squeeze(cut), " "), lambda w: w != "")
    return F.when(F.size(words) > most_words, F.array_join(F.slice(words, 1, most_words), " ")).otherwise(cut)


def display_name(c: Column) -> Column:
    """A file name that is safe to show: its last part, printable, single spaces, 128 characters."""
    base = F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/]*)/*$", 1)
    return F.coalesce(F.nullif(F.left(squeeze(F.regexp_replace(base, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]", "")), F.lit(128)), F.lit("")), F.lit("document"))


def question_hash(c: Column) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(12))


def client_key(forwarded: Column, host: Column, trusted: bool) -> Column:
    """The leftmost forwarded entry if proxies are trusted, else the host, else `unknown`."""
    first = F.nullif(strip(F.split(forwarded, ",")[0]), F.lit(""))
    own = F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))
    return F.coalesce(first, own) if trusted else own


def cache_key(model: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\u0000"), c).cast("binary"), 256)
