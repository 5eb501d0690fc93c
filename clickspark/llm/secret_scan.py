"""Secret scans: pattern rules plus dictionary-primed zstandard novelty.

The base rules are three patterns.  The method looks further: any unbroken
string of 16 characters that follows a sensitive word in its paragraph (up to
the next blank line, however far that is) is a candidate, as is a value of 8
right after its assignment mark, of any characters, and the whole body of a
private key between its BEGIN and END lines (without an END line: all lines of
base64 that follow).  A candidate's novelty is the number of bytes it adds to a zstandard stream primed with a dictionary made
of common identifiers and of the text around it, with all candidates blanked
out (a key that stands twice is no less a key).  Strings that compress (names,
words) add few bytes; strings whose
added bytes come to ``min_novelty`` of what their own characters add in a
shuffled order (a random string of that length and alphabet) are reported as
kind ``novel``, unless a base span covers them.  Every distinct string is
judged once, where it first follows a sensitive word, and reported wherever it
stands in the text.  As zstandard cannot match under three bytes, a word that
the dictionary lacks looks new to it: a string that passes is then spelt as
words and numbers by the dictionary's letter pairs, and dropped when that takes
fewer bits than uniform draws from its alphabet.  That spelling is a proper
code, so it can beat uniform draws on few random strings.  Passphrases made of
plain words are words to it; so are letters of other scripts in one case.

One scan, no shuffle.  Null and empty texts have no spans; long texts are
searched whole; repeated rows give equal rows; other columns are ignored; an
empty table gives an empty result."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import unicodedata
from bisect import bisect_right
from collections import Counter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import DOCUMENT_COLUMNS, DOCUMENTS, map_rows, table

#: Contract patterns, and the fewest characters (assign: of group 2).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of hex digits, shorter runs dropped
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows sensitive, and their regular expression.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "private_key",
             "private-key", "private key", "access_key", "access-key", "access key", "credential", "authorization",
             "bearer", "signature", "session_id", "sessionid", "auth_key", "client_id", "pwd")
_CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.I | re.A)
#: Where a sensitive word's context ends.
_BLANK_LINE = re.compile(r"\n[ \t\r\f\v]*\n")
#: Private keys: the body up to the END line, or lines of base64.
_KEY = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----(?:(?P<body>(?:(?!-----).)*?)-----END (?P=what)-----|"
                  r"(?P<open>(?:\r?\n[ \t]*[A-Za-z0-9+/=]{16,}[ \t]*)+(?:\r?\n[ \t]*[A-Za-z0-9+/]{1,15}={0,2}[ \t]*(?=\r?\n|\Z))?))", re.S)
#: An ampersand, unless it starts the next parameter or a character entity.
_AND = r"&(?![A-Za-z_]\w*[=;]|#\w{1,6};)"
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_~!#$%^*@-](?:[A-Za-z0-9+/_=.~!#$%^*?@-]|{_AND}){{14,}}"
                        r"[A-Za-z0-9+/_=~!#$%^*@-]")
#: A value after a sensitive word's assignment mark: in quotes, or unbroken.
MIN_VALUE = 8
_SCHEME = r"(?:(?:basic|bearer|token)[ \t]{1,8})?"
#: Characters beyond ASCII that are no white space.
_WIDE = r"[^\x00-\x7f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_VALUE = re.compile(r"""[A-Za-z0-9_-]{0,32}["'\])]{0,2}[ \t]{0,8}(?::=|=>|==?|:)[ \t]{0,8}"""
                    rf"""(?:(["'`]){_SCHEME}((?:(?!\1)(?:[ -~]|{_WIDE})){{8,}})\1|"""
                    rf"""(?:["'`]|&quot;|&#39;)?{_SCHEME}((?:[!#-%(-+\--:=?-_a-~]|{_WIDE}|{_AND}){{8,}}))""", re.I | re.A)
#: What names a candidate in the same unbroken run: ``client_id=``.
_NAME = re.compile(rf"[a-z_.-]{{0,64}}(?:{_CONTEXT.pattern})[a-z_.-]{{0,64}}=+", re.I | re.A)
#: Least added bytes (as a share of those of the shuffled candidate), least
#: bits per character (order 0), and characters of text around a candidate.
MIN_NOVELTY, MIN_BITS, AROUND = 0.85, 1.5, 1024

#: Identifiers that code and configuration share, the fixed part of the dictionary.
IDENTIFIERS = (
    "password passwd passphrase secret token access_token refresh_token id_token api_key apikey private_key public_key "
    "access_key credential credentials authorization bearer basic signature session_id client_id client_secret "
    "username user_name user_id account config settings environment production development staging localhost "
    "example.com https:// http:// ssh-rsa -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- "
    "null none true false undefined changeme placeholder your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 "
    "1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ getElementById addEventListener "
    "import from return function class public static void const string integer boolean application controller "
    "repository service manager factory handler provider configuration authentication").encode()

#: Common words of several languages, for letter pairs beside the identifiers.
WORDS = (
    "the and that have with this from they would there their what about which when make like time just know people into "
    "year your good some could them other than then look only come over think also back after work first well even want "
    "because these give most required expired missing invalid certificate signature unknown disabled enabled optional "
    "encrypted protected department government international understanding development information university community "
    "president management experience different important company business question national something available "
    "technology education performance environment individual organization particular production security standard "
    "johnson williams anderson thompson martinez robinson michael jennifer elizabeth christopher alexander katherine "
    "string number object request response header server client database password username email address message default "
    "value index file path token session user service python javascript library package module version release update "
    "der die und das nicht eine werden sein haben wurde durch zwischen gesellschaft verwaltung wissenschaft entwicklung "
    "schreiben freundlich zugangsdaten kennwort berechtigung beispiel les des une pour dans avec sont cette comme mais "
    "plus tout entre gouvernement connaissance utilisateur identifiant maintenant toujours quelque los las una para por "
    "como pero todos cuando desde entonces siempre nosotros informacion contrasena usuario ejemplo gobierno trabajo "
    "questo della sono anche perche sempre lavoro tempo").encode()
#: Also runs of other letters.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_\x00-\x7f]+|.", re.S)
#: Bits of a letter of another script in a word (order 0, about).
_LETTER = 4.0
#: Alphabets a random string may be drawn from, the narrowest first.
_ALPHABETS = [(len(a), frozenset(a)) for a in (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase,
    string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters,
    string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/",
    string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/=-_.",
    string.ascii_letters + string.digits + string.punctuation)]


def _pair_bits() -> list[list[float]]:
    """-log2 P(second letter | first), 0 for a word's edge."""
    count = [[0.25] * 27 for _ in range(27)]
    for word in re.findall("[a-z]+", (IDENTIFIERS + b" " + WORDS).decode().lower()):
        if word not in (string.ascii_lowercase, "x" * 16):
            codes = [0, *(ord(c) - 96 for c in word), 0]
            for a, b in zip(codes, codes[1:]):
                count[a][b] += 1
    return [[math.log2(sum(row) / n) for n in row] for row in count]


_PAIRS = _pair_bits()


def _plain(s: str) -> str:
    """Without marks over letters: ``é`` is spelt like ``e``."""
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _cases(letters: str) -> list[str]:
    """A run of letters cut before every capital that follows a small letter
    and before the last of several capitals."""
    cuts = [0]
    for i in range(1, len(letters)):
        a, b = letters[i - 1].isupper(), letters[i].isupper()
        if b and not a:
            cuts.append(i)
        elif a and not b and i - 1 > cuts[-1]:
            cuts.append(i - 1)
    return [letters[x:y] for x, y in zip(cuts, [*cuts[1:], None])]


def spelt_bits(s: str) -> float:
    """Bits of ``s`` as words, numbers and signs: the kind of every piece,
    letters by pairs, digits with their end, signs (the common ones shorter)."""
    bits = 0.0
    for piece in _PIECE.findall(_plain(s)):
        bits += math.log2(5)
        if not piece.isascii() and piece.isalpha():
            # by case: five letters and more in one, or small after a capital, are like a word
            for n, run in ((len(r), r) for r in _cases(piece)):
                bits += _LETTER * n if n >= 5 else 6 * n
                bits += 0 if run is piece else math.log2(5)
            continue
        if piece.isalpha() and piece.isascii():
            codes = [0, *(ord(c) - 96 for c in piece.lower()), 0]
            bits += sum(_PAIRS[a][b] for a, b in zip(codes, codes[1:]))
        elif piece.isdigit() and piece.isascii():
            bits += len(piece) * (1 + math.log2(10))
        else:
            bits += len(piece) * (1 + math.log2(6 if piece in "_-./= " else 27))
    return bits


def is_spelt(s: str) -> bool:
    """Whether ``s`` is shorter as words and numbers than drawn at random."""
    drawn = set(_plain(s))
    wide = {c for c in drawn if not c.isascii()}
    if wide:  # 32 letters a case, 10 digits, 16 signs, of what occurs
        kinds = {(c.isascii(), c.isalpha(), c.isdigit(), c.isupper()) for c in drawn}
        size = sum(32 if letter else 10 if digit else 16 for _, letter, digit, _ in kinds)
    else:
        size = next((n for n, a in _ALPHABETS if drawn <= a), 95)
    return spelt_bits(s) < len(s) * math.log2(size)



def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of the base rules."""
    out = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _primed(around: str) -> zstandard.ZstdCompressor:
    primer = IDENTIFIERS + b" " + around.encode("utf-8", "surrogatepass")
    return zstandard.ZstdCompressor(
        level=19, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def _added(primed: zstandard.ZstdCompressor, data: bytes) -> int:
    return len(primed.compress(data)) - len(primed.compress(b""))


def novelty(candidate: str, around: str) -> float:
    """Bytes per character that ``candidate`` adds to a stream primed with
    the identifiers and the text ``around`` it."""
    data = candidate.encode("utf-8", "surrogatepass")
    return _added(_primed(around), data) / len(data)


def is_novel(candidate: str, around: str, min_novelty: float = MIN_NOVELTY) -> bool:
    """Whether ``candidate`` adds about as much as its characters do in any
    order: long random strings are entropy-coded to what their alphabet
    allows, so the bound follows length and alphabet."""
    data = candidate.encode("utf-8", "surrogatepass")
    n = len(data)
    if -sum(k * math.log2(k / n) for k in Counter(data).values()) < MIN_BITS * n:
        return False
    primed = _primed(around)
    mixed = "".join(random.Random(n).sample(candidate, len(candidate))).encode("utf-8", "surrogatepass")
    return _added(primed, data) >= min_novelty * min(n, _added(primed, mixed))


def occurrences(text: str, strings) -> list[tuple[int, int]]:
    """Spans of ``strings`` in the text from left to right, the longest first
    where several start."""
    if not strings:
        return []
    head = min(map(len, strings))
    by_head: dict[str, dict[int, set[str]]] = {}
    for s in strings:
        by_head.setdefault(s[:head], {}).setdefault(len(s), set()).add(s)
    by_head = {h: sorted(by.items(), reverse=True) for h, by in by_head.items()}
    out, i, last = [], 0, len(text) - head
    while i <= last:
        for n, same in by_head.get(text[i:i + head], ()):
            if text[i:i + n] in same:
                out.append((i, i + n))
                i += n - 1
                break
        i += 1
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the strings that follow a sensitive word; whole private keys."""
    out, done, until, keys = [], 0, -1, []
    if "-----BEGIN " in text:
        for m in _KEY.finditer(text):
            a, b = m.span("body") if m["body"] is not None else m.span("open")
            inside = text[a:b].strip()
            a = text.index(inside, a)
            if len(inside) >= MIN_VALUE:
                keys.append((a, a + len(inside)))
    out += keys

    def in_key(a: int) -> bool:
        k = bisect_right(keys, (a, len(text) + 1)) - 1
        return k >= 0 and a < keys[k][1]

    for word in _CONTEXT.finditer(text):
        if word.end() > until:
            blank = _BLANK_LINE.search(text, word.end())
            until = blank.start() if blank else len(text)
        if in_key(word.start()):
            continue
        value = _VALUE.match(text, word.end())
        if value:
            a, b = value.span(2 if value[2] else 3)
            if not value[2]:
                while b > a and (text[b - 1] in ".:" or text[b - 1] in ")]}" and not
                                 any(c in "([{" for c in text[a:b])):
                    b -= 1
            if b - a >= MIN_VALUE:
                out.append((a, b))  # and the unbroken strings in it, below
        for m in _CANDIDATE.finditer(text, max(done, word.end()), until):
            a, b = m.span()
            done = b
            if in_key(a):
                continue
            name = _NAME.match(text, a, b)
            a = name.end() if name else a
            if b - a >= MIN_VALUE:
                out.append((a, b))
        done = max(done, until)
    return out


def novel_spans(text: str, base: list[tuple[int, str, int, int]], min_novelty: float = MIN_NOVELTY,
                around: int = AROUND) -> list[tuple[int, str, int, int]]:
    low = text.lower()
    if not any(k in low for k in SENSITIVE):
        return []

    covers: list[list[int]] = []  # base spans, joined
    for x, _, y, _ in base:
        if covers and x <= covers[-1][1]:
            covers[-1][1] = max(covers[-1][1], y)
        else:
            covers.append([x, y])

    def free(a: int, b: int) -> bool:
        k = bisect_right(covers, [a, len(text) + 1]) - 1
        return k < 0 or covers[k][1] < b

    first: dict[str, tuple[int, int]] = {}
    for a, b in candidates(text):
        if free(a, b):
            first.setdefault(text[a:b], (a, b))
    if not first:
        return []
    parts, at = [], 0
    for a, b in occurrences(text, first):
        parts += [text[at:a], " " * (b - a)]
        at = b
    blank = "".join(parts) + text[at:]
    found = {s for s, (a, b) in first.items()
             if is_novel(s, blank[max(0, a - around):a] + " " + blank[b:b + around], min_novelty) and not is_spelt(s)}
    return [(a, "novel", b, a) for a, b in occurrences(text, found) if free(a, b)]


def scan(text: str | None, min_novelty: float = MIN_NOVELTY) -> tuple[list, list]:
    """Base spans and all spans, each sorted by start, then kind."""
    text = text or ""
    base = base_spans(text)
    every = sorted(base + novel_spans(text, base, min_novelty), key=lambda s: (s[0], KINDS.index(s[1])))
    return base, every


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b, _ in spans)


def secret_scan(docs: DataFrame, min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """One row per document: doc_id, counts per base kind, base_sha256 and
    ``spans`` (kind:start:end, code points)."""

    def run(batches):
        for b in batches:
            found = [scan(t, min_novelty) for t in b["text"]]
            yield {"doc_id": b["doc_id"],
                   **{f"n_{k}": [sum(s[1] == k for s in base) for base, _ in found] for k in KINDS[:3]},
                   "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found],
                   "spans": [_joined(every) for _, every in found]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret (of assignments, the value) replaced."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b, secret in sorted(scan(text)[1], key=lambda s: s[3]):
        if secret >= at:
            out += [text[at:secret], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def query(spark, sf_dir: str) -> DataFrame:
    """op10: contract columns over all documents."""
    return secret_scan(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced."""

    def run(batches):
        for b in batches:
            texts = [redact(t) for t in b["text"]]
            yield {**b, "text": texts, "n_chars": [None if t is None else len(t) for t in texts]}

    return map_rows(docs.select(*DOCUMENT_COLUMNS), run, DOCUMENTS)
