"""Personal data by anchor expansion: an automaton finds anchors, local parsers expand and validate them."""

from __future__ import annotations

import functools
import ipaddress
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

#: Words that announce a secret or an identifier, matched in lower, upper and title case.
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "auth_key", "private_key", "bearer")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta", "routing")
#: Beginnings of keys that need no cue, and what follows them.
KEYS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36,}", "gho_": r"[A-Za-z0-9]{36,}", "ghs_": r"[A-Za-z0-9]{36,}", "github_pat_": r"\w{40,}",
    "sk_live_": r"[A-Za-z0-9]{16,}", "rk_live_": r"[A-Za-z0-9]{16,}", "xoxb-": r"[A-Za-z0-9-]{20,}", "xoxp-": r"[A-Za-z0-9-]{20,}", "AIza": r"[\w-]{35}",
}
STREETS = ("street", "st.", "avenue", "ave.", "road", "rd.", "boulevard", "blvd.", "lane", "drive")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&'*+/=?^_`{|}~.-")
_LOCAL_TRIM = "!#$%&'*/=?^`{|}~.-"
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_URL_RUN = re.compile(r"""[^ \t\r\n"'<>`{}|\\^]*""")
_URL_HOST = re.compile(r"""[^ \t\r\n"'<>`{}|\\^/?\#]*""")
_SEPARATOR = re.compile(r"""["']?[ \t]*(?:[:=]|is\b)[ \t]*""")
_QUOTED = re.compile(r"""(["'])((?:\\.|(?!\1)[^\\\r\n]){4,})\1""")
_BARE = re.compile(r"""[^\s"',;]*""")
_BEARER = re.compile(r"[ \t]+(?=[\w~+/-])")
_TOKEN_LIKE = re.compile(r"[\d_~+=]|[a-z][A-Z]|.{20}")
_ACCOUNT = re.compile(r"""[ \t]*(?:number|no\.?|nr\.?|\#)?[ \t]*[:=#]?[ \t]*([A-Za-z]{0,3}\d[\dA-Za-z]{0,3}(?:[ -]?[\dA-Za-z]{1,5}){1,8})""", re.I)
_HOUSE = re.compile(r"(?<!\d)\d{1,5}\Z")
_NAME = re.compile(r"[A-Z][\w.'-]*")
_FIRST = re.compile(r"\d[\d.-]{0,39}")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w.]*\d)|\+\d{8,15}(?!\w)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}")


_KEYS = {k: re.compile(rf"{k}{v}(?!\w)") for k, v in KEYS.items()}
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_HEXES = re.compile(r"[0-9A-Fa-f:]+(?:(?:\.\d{1,3}){3})?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def card(digits: str) -> bool:
    """A number in an issuer's range, of a length it uses, with a right check digit. Other long numbers aren't personal data by themselves."""
    n = len(digits)
    six = int(digits[:6])
    known = (
        digits[0] == "4" and n in (13, 16, 19)
        or n == 16 and (51 <= six // 10000 <= 55 or 222100 <= six <= 272099 or 3528 <= six // 100 <= 3589)
        or n == 15 and six // 10000 in (34, 37)
        or n == 14 and (six // 10000 in (36, 38, 39) or 300 <= six // 1000 <= 305)
        or 16 <= n <= 19 and (six // 100 == 6011 or six // 10000 in (62, 65) or 644 <= six // 1000 <= 649)
    )
    return known and luhn(digits)


def iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, words in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for w in words:
            for form in {w, w.upper(), w.title(), w.capitalize()}:
                a.add_word(form, (kind, len(form)))
    for k in KEYS:
        a.add_word(k, ("key", len(k)))
    a.add_word("-----BEGIN ", ("pem", 11))
    a.add_word(":", ("colon", 1))
    for w in STREETS:
        for form in {" " + w.title(), " " + w.upper()}:
            a.add_word(form, ("street", len(form)))
    a.make_automaton()
    return a


def _email(t: str, at: int):
    """Both parts reach as far as their characters do; neither holds an at-sign, so no byte is read for two of them."""
    a = at
    while a > 0 and t[a - 1] in _LOCAL:
        a -= 1
    local = t[a:at]
    skip = len(local) - len(local.lstrip(_LOCAL_TRIM))
    a, local = a + skip, local[skip:]
    b = at + 1
    while b < len(t) and t[b] in _HOST:
        b += 1
    host = t[at + 1 : b].rstrip(".-")
    labels = host.split(".")
    if not local or local[-1] == "." or ".." in local or len(labels) < 2:
        return None
    if any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels) or not labels[-1].isalpha() or len(labels[-1]) < 2:
        return None
    return "email", a, at + 1 + len(host)


class _Urls:
    """Addresses behind ``://``. One that lies in an address already found is part of it, so that a run is read to its end once."""

    def __init__(self, t: str):
        self.t = t
        self.end = 0

    def at(self, at: int):
        t = self.t
        if at < self.end:
            return None
        a = at
        while a > 0 and (t[a - 1].isascii() and t[a - 1].isalnum() or t[a - 1] in "+.-"):
            a -= 1
        while a < at and not t[a].isalpha():
            a += 1
        host = _URL_HOST.match(t, at + 3).group(0)
        if a == at or not host:
            return None
        b = _URL_RUN.match(t, at + 3 + len(host)).end()
        self.end = b
        while b > at + 3 and t[b - 1] in ".,;:!?)]":
            b -= 1
        if b == at + 3:
            return None
        # an address with a name or password in it is an account, any other a plain address
        return "url_account" if "@" in host else "url", a, b


def _street(t: str, start: int, end: int):
    """Number and one to four capitalised words before the street word t[start + 1:end], whatever their length."""
    if t[end : end + 1].isalnum():
        return None
    found, b = None, start
    for n in range(5):
        while b > 0 and t[b - 1] == " ":
            b -= 1
        a = b
        while a > 0 and not t[a - 1].isspace():
            a -= 1
        word = t[a:b]
        number = _HOUSE.search(word) if n else None
        if number:
            found = a + number.start()
        if not _NAME.fullmatch(word) or t[a - 1 : a] != " ":
            break
        b = a - 1
    return None if found is None else ("street_address", found, end)


def _free(t: str, a: int) -> bool:
    """Whether a number may begin at a: not inside a word or right behind one joined by a dot or hyphen."""
    before = t[a - 1 : a] if a else ""
    return not (before.isalnum() or before == "_" or before in (".", "-") and t[max(0, a - 2) : a - 1].isalnum())


def _plain(t: str, a: int):
    """Address, SSN or card that begins with the digit at ``a``."""
    if not _free(t, a):
        return None
    first = _FIRST.match(t, a).group(0).rstrip(".-")
    end = a + len(first)
    follow = t[end : end + 1]
    if first.count(".") == 3 and first.replace(".", "").isdigit() and not follow.isalnum():
        octets = first.split(".")
        if all(o and len(o) <= 3 and int(o) < 256 and (len(o) == 1 or o[0] != "0") for o in octets):
            return "ip_address", a, end
    digits = re.sub(r"\D", "", first)
    if re.fullmatch(r"[\d-]+", first) and not follow.isalnum():
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", first) and first[:3] not in ("000", "666") and first[0] != "9":
            return "ssn", a, end
        if re.fullmatch(r"\d{13,19}|\d{4}-\d{4}-\d{4}-\d{1,7}", first) and card(digits):
            return "card", a, end
    g = re.match(r"\d{4} \d{4} \d{4} \d{1,7}(?!\w)", t[a : a + 24])
    if g and card(g.group(0).replace(" ", "")):
        return "card", a, a + g.end()
    return None


def _phone(t: str, starts: list[int]):
    for a in reversed(starts):
        if _free(t, a):
            p = _PHONE.match(t[a : a + 32])
            if p and 9 <= len(re.sub(r"\D", "", p.group(0))) <= 15:
                return "phone", a, a + p.end()
    return None


def _number(t: str, at: int):
    """Address, card and phone numbers at the digit at ``at``; only a phone number may begin before it, with a plus or parenthesis."""
    starts = [at]
    while starts[-1] > 0 and len(starts) < 3 and t[starts[-1] - 1] in "+(":
        starts.append(starts[-1] - 1)
    # a plus right before the digits makes a phone number of what might be a card's
    if at and t[at - 1] == "+":
        return _phone(t, starts) or _plain(t, at)
    return _plain(t, at) or _phone(t, starts)


def _iban(t: str, at: int):
    """A check number is two digits after two capitals; the anchor is its first digit."""
    a = at - 2
    if a < 0 or (a and t[a - 1].isalnum()):
        return None
    m = _IBAN.match(t, a)
    if not m:
        return None
    value = m.group(0)
    while len(value) >= 15:
        if (a + len(value) == len(t) or not t[a + len(value)].isalnum()) and iban(value):
            return "iban", a, a + len(value)
        value = value[:-1].rstrip()
    return None


class _Hexes:
    """IPv6 addresses: a run of hexadecimal digits and colons, read once, of three groups and a digit at least."""

    def __init__(self, t: str):
        self.t = t
        self.end = 0

    def at(self, at: int):
        t = self.t
        if at < self.end or t[at + 1 : at + 2] in " /":
            return None
        a = at
        while a > self.end and t[a - 1] in "0123456789abcdefABCDEF":
            a -= 1
        m = _HEXES.match(t, a)
        self.end = m.end()
        value = m.group(0)
        b = a + len(value)
        if value.endswith(":") and not value.endswith("::"):
            value, b = value[:-1], b - 1
        if a and (t[a - 1].isalnum() or t[a - 1] in "_.") or t[b : b + 1].isalnum() or not 2 <= value.count(":") <= 7 or len(value) > 45:
            return None
        if len([x for x in re.split("[:.]", value) if x]) < 3 or not any(c.isdigit() for c in value):
            return None
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return None
        return "ip_address", a, b


class _Blocks:
    """Private key blocks; one without an end is its first line."""

    def __init__(self, t: str):
        self.t = t
        self.ended = True

    def at(self, at: int):
        m = _PEM.match(self.t, at)
        if not m:
            return None
        end = _PEM_END.search(self.t, m.end()) if self.ended else None
        self.ended = end is not None
        return "secret", at, (end or m).end()


class _Secrets:
    """Values behind secret cues. The end of an unquoted run is kept, so that one with many cues in it is read once."""

    def __init__(self, t: str):
        self.t = t
        self.end = 0

    def _bare(self, at: int) -> int:
        if at >= self.end:
            self.end = _BARE.match(self.t, at).end()
        return self.end

    def after(self, start: int, end: int):
        """The value of the cue t[start:end]: to its closing quote, or unquoted to white space, a quote, comma or semicolon."""
        m = _SEPARATOR.match(self.t, end)
        if m:
            q = _QUOTED.match(self.t, m.end())
            if q:
                return "secret", q.start(2), q.end(2)
            b = self._bare(m.end())
            return ("secret", m.end(), b) if b - m.end() >= 4 else None
        if self.t[start:end].lower() == "bearer":
            m = _BEARER.match(self.t, end)
            # "bearer" is also a word of prose: what follows white space alone must look like a token
            if m and (b := self._bare(m.end())) - m.end() >= 4 and _TOKEN_LIKE.search(self.t, m.end(), b):
                return "secret", m.end(), b
        return None


def find(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the findings in a text, in order and apart from each other.

    Where two would overlap the one that begins first stays, of those that begin
    together the longer, of equal ones the first of its kind by name. Every
    parser keeps in mind how far it has read, so time is in proportion to the
    text whatever it holds; no value is cut at a length.
    """
    found = []
    secrets, urls, hexes, blocks = _Secrets(t), _Urls(t), _Hexes(t), _Blocks(t)
    over = -1  # digits before this place were read already
    for end, (kind, size) in automaton().iter(t):
        start = end - size + 1
        hit = None
        if kind == "digit":
            if start < over:
                continue
            if start and "A" <= t[start - 1] <= "Z":
                hit = _iban(t, start)
            if not hit and not (start and (t[start - 1].isalnum() or t[start - 1] == "_")):
                hit = _number(t, start)
            if hit:
                over = hit[2]
            else:
                over = start + 1
                while over < len(t) and t[over].isascii() and t[over].isdigit():
                    over += 1
        elif kind == "at":
            hit = _email(t, end)
        elif kind == "scheme":
            hit = urls.at(start)
        elif kind == "colon":
            hit = hexes.at(start)
        elif kind == "pem":
            hit = blocks.at(start)
        elif kind == "key":
            m = _KEYS[t[start : end + 1]].match(t, start) if not (start and (t[start - 1].isalnum() or t[start - 1] == "_")) else None
            hit = ("secret", start, m.end()) if m else None
        elif kind == "street":
            hit = _street(t, start, end + 1)
        elif not (start and t[start - 1].isalnum()) or kind == "secret" and t[start - 1] == "_":
            if kind == "secret":
                hit = secrets.after(start, end + 1)
            else:
                m = _ACCOUNT.match(t, end + 1)
                if m and sum(c.isdigit() for c in m.group(1)) >= 6 and not t[m.end(1) : m.end(1) + 1].isalnum():
                    hit = "account", m.start(1), m.end(1)
        if hit:
            found.append(hit)
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda f: (f[1], -f[2], f[0])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


_FOUND = "doc_id bigint, kind string, start int, end int, value string"


def _scan(batches):
    for b in batches:
        rows = []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if t:
                rows += [(i, k, s, e, t[s:e]) for k, s, e in find(t)]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc_id", "kind", "start", "end", "value"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value): the personal data and secrets in every text, by code point offsets.

    Kinds: email, url, url_account, ip_address (v4 and v6), phone, card, account,
    iban, ssn, street_address, secret (behind a cue, or a key of a known form).
    Street addresses are found only in the English order
    with the words in STREETS, in title or upper case, and phone numbers only in
    groups of 2-4, 3-4 and 3-4 digits or as a plus and 8 to 15 digits; German,
    French and Spanish forms of both are missed. A very long text is read whole,
    in time in proportion to its length. Of findings that overlap one is reported
    (see find). Null and empty texts have none; a null identifier stays null;
    repeated rows are each reported; an empty table gives no rows; other columns,
    whatever their names, are not looked at. One pass, no shuffle.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan, _FOUND)


def redact(t: str | None) -> str | None:
    """The text with each finding replaced by its kind in brackets; a null text stays null, one without findings as it is."""
    if t is None:
        return None
    out, at = [], 0
    for kind, a, b in find(t):
        out += [t[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, t[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(util.table(spark, sf_dir, "documents"))
