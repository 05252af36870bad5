"""Text expressions: clean, chunk, tag, identify. Lengths are in code points."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

MAX_CHARS = 1500
MAX_TAGS = 10
ID_STOP_WORDS = tuple("a an and at for in is it of on that the this to".split())
TAG_STOP_WORDS = tuple(
    (
        "own need used like same time some none here were more dure have each much such with both well will them from than been then when "
        "even upon also into onto over your this thus that what most just they only many very could would since while there where these "
        "those above being among which until again under other after yours about below should before itself having within either cannot "
        "because through between neither another further however against without therefore otherwise "
    ).split()
)
#: Split pattern between words, and marks trimmed off their ends, of the content signature.
SPACE = r"[\p{Z}\n-\r\x85\t]+"
#: Punctuation with white space or an end of the text on one side.
EDGES = r"(?<![^\p{Z}\n-\r\x85\t])\p{P}+|\p{P}+(?![^\p{Z}\n-\r\x85\t])"
NOT_ALNUM = r"[^\p{L}\p{M}\p{N}]+"


#: Texts of an Arrow batch that are Python strings at a time: a batch holds up to 64 MB, and strings of it twice that and more.
TEXTS_AT_ONCE = 64


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        yield texts.slice(at, TEXTS_AT_ONCE).to_pylist()


def _mapped(f: Callable[[str], object], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """f of each text that isn't null."""
    parts = [pa.array([None if t is None else f(t) for t in some], kind) for some in _slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


# --- content identity ---------------------------------------------------------------
#: White space and separators that trim() takes off, as characters.
_SEPARATORS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TRIM = " \t\n\x0b\x0c\r" + _SEPARATORS
_ID_SPLIT = re.compile(f"[ \\t\\n-\\r\\x85{_SEPARATORS}]+")
_TAG_SPLIT = regex.compile(NOT_ALNUM)
_MARK, _WORDS = regex.compile(r"\p{M}"), re.compile(r"[^\W_]+")
_TOP = ArrayType(StructType().add("n", LongType()).add("word", StringType()))
_ENDS = regex.compile(r"\A\p{P}+|\p{P}+\Z")


def signature_words(text: Column) -> Column:
    """Words between white space, lower-cased and trimmed of punctuation, without empty and stop words."""
    words = F.split(F.regexp_replace(F.lower(text), EDGES, ""), SPACE)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*ID_STOP_WORDS))


def tag_words(text: Column) -> Column:
    """Alphanumeric runs of more than three characters that are no stop words."""
    return F.filter(F.split(F.lower(text), NOT_ALNUM), lambda w: (F.length(w) > 3) & ~w.isin(*TAG_STOP_WORDS))


def _most(count: dict[str, int], n: int) -> list[tuple[int, str]]:
    """The n most frequent, by name (in order of its UTF-8 bytes, which is that of its characters) on a tie."""
    least = sorted(count.values())[-n] if len(count) > n else 0
    return sorted((-k, w) for w, k in count.items() if k >= least)[:n]


def _tag_words(t: str) -> list[str]:
    """Runs of letters, marks and numbers; without marks the quicker class of word characters is the same but for the underscore."""
    return _WORDS.findall(t) if t.isascii() or not _MARK.search(t) else _TAG_SPLIT.split(t)


@F.arrow_udf(_TOP)
def _top_tags(lowered: pa.Array) -> pa.Array:
    stop = frozenset(TAG_STOP_WORDS)

    def one(t: str) -> list[dict]:
        count = Counter(_tag_words(t))
        for w in [w for w in count if len(w) < 4 or w in stop]:
            del count[w]
        return [{"n": -k, "word": w} for k, w in _most(count, MAX_TAGS)]

    return _mapped(one, lowered, pa.list_(pa.struct([("n", pa.int64()), ("word", pa.string())])))


@F.arrow_udf(StringType())
def _signature(lowered: pa.Array) -> pa.Array:
    stop, bare = frozenset(ID_STOP_WORDS), {}

    def one(t: str) -> str:
        count: dict[str, int] = {}
        for w, k in Counter(_ID_SPLIT.split(t)).items():
            # most words are letters and have nothing to trim
            if not w.isalnum():
                if len(bare) > 20_000:
                    bare.clear()
                got = bare.get(w)
                w = bare.setdefault(w, _ENDS.sub("", w)) if got is None else got
            if w and w not in stop:
                count[w] = count.get(w, 0) + k
        return " ".join(sorted(w for _, w in _most(count, MAX_TAGS)))

    return _mapped(one, lowered, pa.string())


def top_tags(text: Column) -> Column:
    """top_words(tag_words(text)), counted in one pass over the text."""
    return _top_tags(F.lower(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def top_words(words: Column, n: int = MAX_TAGS) -> Column:
    """array<struct<n, word>>: the n most frequent words, by name on a tie. Sorted runs are counted inside the row, so nothing is shuffled."""

    def count(s: Column) -> Column:
        size = F.size(s)
        heads = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def pairs(h: Column) -> Column:
            runs = F.transform(h, lambda i, k: F.struct((i - F.coalesce(F.get(h, k + 1), size)).alias("less"), F.get(s, i).alias("word")))
            return F.transform(F.slice(F.sort_array(runs), 1, n), lambda r: F.struct((-r["less"]).cast("bigint").alias("n"), r["word"].alias("word")))

        return F.when(size > 0, let(heads, pairs)).otherwise(F.array().cast("array<struct<n:bigint,word:string>>"))

    return let(F.sort_array(words), count)


def signature(text: Column) -> Column:
    """The ten most frequent words (see signature_words) in order of name, counted in one pass over the text; of a null text empty."""
    return _signature(F.lower(F.coalesce(text, F.lit(""))))


def numeric_hash(text: Column) -> Column:
    """SHA-256 with each byte in decimal, two digits at least; 64 to 96 digits."""

    def byte(h: Column, i: Column) -> Column:
        return let(F.conv(F.substr(h, i, F.lit(2)), 16, 10), lambda n: F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))

    return let(F.sha2(text, 256), lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: byte(h, i)), ""))


def scoped_id(node: Column | str, local: Column) -> Column:
    return F.concat_ws("-", F.lit(node) if isinstance(node, str) else node, local)


def tag_string(tags: Column, query: bool = False) -> Column:
    """Tags in one string to be embedded: as given for a document, sorted for a query."""
    return F.array_join(F.array_sort(tags) if query else tags, " ")


def preview(text: Column, full: bool = False) -> Column:
    return text if full else F.substring(text, 1, 200)


# --- cleaning -----------------------------------------------------------------------
LIGATURES = (
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
    ("Ĳ", "IJ"), ("ĳ", "ij"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"),
)
SPACES = "      　"


def ligatures(t: Column) -> Column:
    for a, b in LIGATURES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def soft_hyphens(t: Column) -> Column:
    return F.replace(t, F.lit("­"), F.lit(""))


def plain_spaces(t: Column) -> Column:
    return F.translate(t, SPACES, " " * len(SPACES))


def controls(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def dehyphenate(t: Column) -> Column:
    return F.regexp_replace(t, r"([a-z])-\n([a-z])", "$1$2")


def lines(t: Column) -> Column:
    """Line ends unified, lines trimmed, runs of spaces made one, two blank lines in a row at most."""
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r"\n{4,}", "\n\n\n")


def trim(t: Column) -> Column:
    return F.regexp_replace(t, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


_CHARS = {ord(a): b for a, b in LIGATURES} | {0xAD: ""} | {ord(c): " " for c in SPACES} | {c: "" for c in [*range(9), 0x0B, 0x0C, *range(0x0E, 0x20)]}
_ODD = re.compile("[" + re.escape("".join(map(chr, _CHARS))) + "]")
_LINE_END = re.compile(r"\r\n?")
_OTHER_LINE_END = re.compile("[\x85\u2028\u2029]")
# line ends are those that trimming by line looks at
_EDGE = re.compile("(?:(?<=[\n\x85\u2028\u2029])|\\A)[ \t]+|[ \t]+(?=[\n\x85\u2028\u2029]|\\Z)")
_SPACES, _BLANKS = re.compile(" {2,}"), re.compile("\n{4,}")


def sanitized(t: str) -> str:
    """trim(lines(dehyphenate(controls(plain_spaces(soft_hyphens(ligatures(t)))))))"""
    # most texts have none of these
    t = _ODD.sub(lambda m: _CHARS[ord(m[0])], t)
    if "-\n" in t:
        t = re.sub(r"([a-z])-\n([a-z])", r"\1\2", t)
    if "\r" in t:
        t = _LINE_END.sub("\n", t)
    t = _EDGE.sub("", t) if _OTHER_LINE_END.search(t) else "\n".join([line.strip(" \t") for line in t.split("\n")])
    return _BLANKS.sub("\n\n\n", _SPACES.sub(" ", t)).strip(_TRIM)


@F.arrow_udf(StringType())
def _sanitize(texts: pa.Array) -> pa.Array:
    return _mapped(sanitized, texts, pa.string())


def sanitize(t: Column) -> Column:
    """All steps of cleaning in one pass over the text."""
    return _sanitize(t)


# --- HTML ---------------------------------------------------------------------------
DROPPED = "script style head noscript nav footer".split()
BLOCKS = "article blockquote br div figcaption figure h1 h2 h3 h4 h5 h6 header hr li main p pre section tr".split()
ENTITIES = (
    ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("mdash", "—"), ("ndash", "–"), ("lsquo", "‘"),
    ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("hellip", "…"), ("copy", "©"), ("reg", "®"), ("trade", "™"),
)


def html_blocks(t: Column) -> Column:
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return t


def html_breaks(t: Column) -> Column:
    """Each block tag, opening or closing, becomes a line end."""
    return F.regexp_replace(t, rf"(?i)</?\s*(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?>", "\n")


def html_tags(t: Column) -> Column:
    return F.regexp_replace(t, "<[^>]+>", "")


def named_entities(t: Column) -> Column:
    for name, c in ENTITIES:
        t = F.regexp_replace(t, rf"(?i)&{name};", c.replace("\\", "\\\\").replace("$", "\\$"))
    return t


@F.pandas_udf(StringType())
def numeric_entities(t: pd.Series) -> pd.Series:
    """Decimal, then hexadecimal character references; those that name no character stay."""
    import re

    def char(digits, base, whole):
        n = int(digits, base) if len(digits) < 12 else 1 << 32
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else whole

    def one(s):
        if s is None or "&#" not in s:
            return s
        s = re.sub(r"&#([0-9]+);", lambda m: char(m[1], 10, m[0]), s)
        return re.sub(r"&#x([0-9a-fA-F]+);", lambda m: char(m[1], 16, m[0]), s)

    return t.map(one, na_action="ignore")


def html_spaces(t: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def html_text(html: Column, entities: bool = True) -> Column:
    """Readable text of a page; the page itself if nothing is left."""
    t = html_tags(html_breaks(html_blocks(html)))
    t = named_entities(t)
    out = html_spaces(numeric_entities(t) if entities else t)
    return F.coalesce(F.nullif(out, F.lit("")), html)


# --- chunking -----------------------------------------------------------------------
_STOP = re.compile(r"(?<=\.)(?=[ \n]|\x85?\Z)")


def _packed(parts: list[str], joint: str, limit: int) -> list[str]:
    """Greedy: a part is joined to the one before while both and the joint fit."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in parts:
        if held and size + len(joint) + len(p) <= limit:
            held.append(p)
            size += len(joint) + len(p)
        else:
            if held:
                out.append(joint.join(held))
            held, size = [p], len(p)
    return [*out, joint.join(held)] if held else out


def sentences(t: str, limit: int = MAX_CHARS) -> list[str]:
    """Pieces that end behind a full stop before a space, line end or the end; longer ones cut, short ones packed."""
    pieces = []
    for p in _STOP.split(t):
        p = p.strip(_TRIM)
        pieces += [p[i : i + limit] for i in range(0, len(p), limit)]
    return _packed(pieces, " ", limit)


def chunked(t: str, limit: int = MAX_CHARS) -> list[str]:
    """Paragraphs packed up to the limit; a longer one is split into sentences first."""
    segments = []
    for p in t.split("\n\n"):
        p = p.strip(_TRIM)
        if p:
            segments += sentences(p, limit) if len(p) > limit else [p]
    return _packed(segments, "\n\n", limit)


def chunk(t: Column, limit: int = MAX_CHARS, clean: bool = False) -> Column:
    """chunked() of each text, cleaned before that if asked; a null text has none."""

    @F.arrow_udf(ArrayType(StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return _mapped(lambda x: chunked(sanitized(x) if clean else x, limit), texts, pa.list_(pa.string()))

    return split(t)
