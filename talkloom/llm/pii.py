"""Personal information in free text: found however it is written, replaced by typed placeholders.

Text passes through transducers that keep, for every character they emit, the span of source characters
it came from: stand-ins are folded, letters typed for digits and spelled digits become digits, and
disguises of "at" and "dot" become signs. Detectors run on the normalised text; their spans are mapped
back, so that placeholders replace exactly the source characters and all else stays as stored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkloom.llm.canonical import SOFT, tables

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# ---- transducers: (text, spans) -> (text, spans); spans is None while text and source agree -------------

Spans = list[tuple[int, int]] | None


@cache
def _folded() -> frozenset[str]:
    """Characters that a fold changes, but for those of pictures."""
    t = tables()
    changed = t.invisible | t.is_joined | t.hyphen | t.mark | (t.script == SOFT) | (t.single != np.arange(len(t.single)))
    changed[0x1100:0x1200] = True
    changed[[0x09, 0x0B, 0x0C, 0x200D, 0xFE0F]] = False
    return frozenset(map(chr, np.flatnonzero(changed)))


_JOINED_WORD = re.compile(r"[\u200d\ufe0f](?<=\w.)")


def fold(text: str) -> tuple[str, Spans]:
    """Full-width and other stand-ins, letters in pieces, look-alikes and invisible characters."""
    if text.isascii() or _folded().isdisjoint(text) and not _JOINED_WORD.search(text):
        return text, None
    t = tables()
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        x = ord(c)
        if t.invisible[x]:
            continue
        if t.is_joined[x]:
            for y in t.joined[x]:
                out.append(chr(y))
                spans.append((i, i + 1))
            continue
        c = chr(t.single[x])
        if t.script[ord(c)] == SOFT:
            c = chr(t.latin[ord(c)])
        if t.hyphen[ord(c)]:
            c = "-"
        # A vowel, a final consonant or a mark joins the character before it, if both compose.
        if out and (0x1161 <= x <= 0x11C2 or t.mark[x]):
            whole = unicodedata.normalize("NFC", out[-1] + c)
            if len(whole) == 1:
                out[-1] = whole
                spans[-1] = (spans[-1][0], i + 1)
                continue
        out.append(c)
        spans.append((i, i + 1))
    return "".join(out), spans


def rewrite(text: str, spans: Spans, pattern: re.Pattern, by) -> tuple[str, Spans]:
    """Replaces each match by ``by(match)``: pieces (string, start, end) whose characters span start..end of ``text``."""
    out, new, last = [], [], 0
    source = (lambda a, b: (a, b)) if spans is None else (lambda a, b: (spans[a][0], spans[b - 1][1]))
    for m in pattern.finditer(text):
        pieces = by(m)
        if pieces is None:
            continue
        out.append(text[last : m.start()])
        new += [source(i, i + 1) for i in range(last, m.start())]
        for piece, a, b in pieces:
            out.append(piece)
            # Characters copied one for one keep their places; others get the whole.
            new += [source(a + k, a + k + 1) for k in range(len(piece))] if len(piece) == b - a else [source(a, b)] * len(piece)
        last = m.end()
    if not out:
        return text, spans
    out.append(text[last:])
    new += [source(i, i + 1) for i in range(last, len(text))]
    return "".join(out), new


# Digits as they are spelled.
KOREAN_DIGITS = {"공": "0", "영": "0", "일": "1", "이": "2", "삼": "3", "사": "4", "오": "5", "육": "6", "륙": "6", "칠": "7", "팔": "8", "구": "9"}
ENGLISH_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_KOREAN = "".join(KOREAN_DIGITS)
_ENGLISH = "|".join(ENGLISH_DIGITS)
# Endings that follow a Korean number or name without a blank.
_PARTICLE = r"(?:입니다|이에요|예요|이고|이며|인데|이라고|라고|으로|로|에서|에게|에|은|는|이|가|을|를|의|와|과|도|번|께|한테|씨|님)"
#: Digits spelled, or some spelled and some typed, with at least two of them spelled.
_SPELLED = re.compile(
    rf"(?<![가-힣0-9])(?=[0-9\s.\-]*[{_KOREAN}][0-9\s.\-]*[{_KOREAN}])[0-9{_KOREAN}](?:[\s.\-]{{0,3}}[0-9{_KOREAN}]){{8,14}}(?![0-9])(?=[^가-힣]|$|{_PARTICLE})"
    rf"|(?<![A-Za-z0-9])(?=[0-9\s.\-]*(?:{_ENGLISH})[0-9\s.\-]+(?:{_ENGLISH}))(?:[0-9]|{_ENGLISH})(?:[\s.\-]{{0,3}}(?:[0-9]|{_ENGLISH})){{6,14}}(?![A-Za-z0-9])",
    re.I,
)
_KOREAN_HINT = re.compile(rf"[0-9{_KOREAN}](?:[\s.\-]{{0,3}}[0-9{_KOREAN}]){{8}}")
_DIGIT_WORD = re.compile(rf"[0-9{_KOREAN}]|{_ENGLISH}|[\s.\-]+", re.I)
#: Numbers in which some digits were typed as letters; at least half of the characters must be digits.
_TYPED = re.compile(r"(?<![\w#@.])[0-9OoIl|][0-9OoIl|\-. ]{7,16}[0-9OoIl|](?![\w@])")


def _spelled(m: re.Match) -> list[tuple[str, int, int]]:
    # Digits spelled in English are words: the blanks between them separate nothing.
    pieces, english = [], m[0].isascii()
    for w in _DIGIT_WORD.finditer(m[0]):
        word = w[0].lower()
        to = word if "0" <= word <= "9" else KOREAN_DIGITS.get(word) or ENGLISH_DIGITS.get(word) or ("-" if "-" in word else "" if english else " ")
        pieces.append((to, m.start() + w.start(), m.start() + w.end()))
    return pieces


def _typed(m: re.Match) -> list[tuple[str, int, int]] | None:
    s = m[0]
    if not re.search(r"[OoIl|]", s) or 2 * sum(c.isdigit() for c in s) < sum(c not in "-. " for c in s):
        return None
    return [(s.translate(str.maketrans("OoIl|", "00111")), m.start(), m.end())]


_LOCAL, _LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?", r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
_AT = r"(?:\s{0,2}@\s{0,2}|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\s?골뱅이\s?|\s?앳\s?|(?P<plain>\sat\s))"
_DOT = r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s|\s?[(\[{<]\s?점\s?[)\]}>]\s?|\s점\s|\s쩜\s)"
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+\-])(?P<local>{_LOCAL}){_AT}(?P<domain>{_LABEL}(?:{_DOT}{_LABEL}){{1,5}})", re.I)
#: What some form of "at" or "dot" needs.
_DISGUISES = re.compile(r"\s@|@\s|골뱅이|앳|쩜|[(\[{<]\s?(?:at|dot|점)\s?[)\]}>]|\sdot\s|\s점\s|\sat\s\S+\.", re.I)
_MAIL_CUE = re.compile(r"\b(?:e-?mail|mail|write|reach)(?:\s(?:me|us|him|her|them|is|to|at))*\s?:?\s$", re.I)
_SPACED = re.compile(r"(?<![\w@])(?:[A-Za-z0-9]\s){2,30}[A-Za-z0-9](?=\s{0,2}@)")
_DOT_SIGN = re.compile(_DOT, re.I)


def _address_sign(m: re.Match) -> list[tuple[str, int, int]] | None:
    dots = list(_DOT_SIGN.finditer(m["domain"]))
    # A bare "at" is one only if a dot is disguised too, or after a word for mail.
    if m["plain"] and all(d[0] == "." for d in dots) and not _MAIL_CUE.search(m.string, max(0, m.start() - 40), m.start()):
        return None
    at = m.start("domain")
    pieces, last = [(m["local"], m.start("local"), m.end("local")), ("@", m.end("local"), at)], 0
    for d in dots:
        pieces += [(m["domain"][last : d.start()], at + last, at + d.start()), (".", at + d.start(), at + d.end())]
        last = d.end()
    return [*pieces, (m["domain"][last:], at + last, m.end("domain"))]


def _joined(m: re.Match) -> list[tuple[str, int, int]]:
    """Letters typed with blanks between them."""
    return [(m[0][k], m.start() + k, m.start() + k + 1) for k in range(0, len(m[0]), 2)]


def normalise(text: str) -> tuple[str, Spans]:
    """All transducers in turn."""
    out, spans = fold(text)
    low = out.lower()
    if sum(w in low for w in ENGLISH_DIGITS) > 1 or not out.isascii() and _KOREAN_HINT.search(out):
        # Both kinds of spelling, alone or mixed with typed digits.
        out, spans = rewrite(out, spans, _SPELLED, _spelled)
    if _TYPED.search(out):
        out, spans = rewrite(out, spans, _TYPED, _typed)
    if "@" in out:
        out, spans = rewrite(out, spans, _SPACED, _joined)
    if _DISGUISES.search(out):
        out, spans = rewrite(out, spans, _DISGUISED, _address_sign)
    return out, spans


# ---- detectors on normalised text ------------------------------------------------------------------------

_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-]){_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9@])")
# Hangul may stand right before or behind a number, but for what makes it an amount.
_NO_DIGIT, _NO_MORE = r"(?<![A-Za-z0-9_#@+.,\-/])", r"(?![A-Za-z0-9_@]|[\-.,/]\d|[ ]?(?:원|달러)|(?:개|주|명|건|위|톤|억|만|천|포인트|퍼센트))"
_PHONE = re.compile(
    rf"{_NO_DIGIT}(?:"
    r"(?:\+?82[\s.\-]?\(?0?\)?|0)1[016789][\s.\-]{0,3}\d{3,4}[\s.\-]{0,3}\d{4}"  # Korean mobile
    r"|(?:\+?82[\s.\-]?|0)(?:2|[3-6]\d|70)[\s.\-)]{1,2}\d{3,4}[\s.\-]\d{4}"  # Korean land line
    r"|\+\d{1,3}(?:[\s.\-]?\(?\d{1,4}\)?){1,4}[\s.\-]?\d{3,6}"  # with a country code
    r"|(?:1[\s.\-])?\([2-9]\d{2}\)\s?\d{3}[\s.\-]\d{4}"  # North American
    r"|(?:1[\s.\-])?[2-9]\d{2}([\-.])\d{3}\1\d{4}"
    rf"){_NO_MORE}"
)
_ID = re.compile(
    rf"{_NO_DIGIT}(?:\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?[\-~]?\s?[1-8]\d{{6}}"  # birth date and serial
    rf"|(?!000|666)\d{{3}}(?P<s>[\-\s])(?!00)\d{{2}}(?P=s)(?!0000)\d{{4}}){_NO_MORE}"  # three groups
)
_PASSPORT = re.compile(r"(?:여권(?:\s?번호)?|\b[Pp]assport(?:\s(?:no|number))?)\s?[.:#은는]?\s?(?P<n>[A-Z]{1,2}\d{7,8}|[A-Z]\d{3}[A-Z]\d{4})(?![A-Za-z0-9])")
# Words of street addresses.
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Place|Pl|Terrace|Ter|Square|Sq|Close|Crescent|Row|Parkway|Pkwy)"
_WESTERN = re.compile(
    rf"\d{{1,5}}[A-Za-z]?\s(?:[A-Z][\w'’\-]{{1,20}}\s){{1,3}}{_STREET}\b\.?"
    r"(?:,?\s(?:Apt|Unit|Suite|Ste|Floor|Room|No)\.?\s?#?\w{1,6})?"
    r"(?:,\s[A-Z][a-z]+(?:\s[A-Z][a-z]+){0,2}(?:,?\s[A-Z]{2})?(?:\s\d{5}(?:-\d{4})?)?)?"
    rf"|\d{{1,5}}\s(?:[a-z'’]+\s){{1,2}}(?:street|avenue|road|lane|court|boulevard)\b(?:,\s(?:apt|unit|suite)\.?\s?\w{{1,6}})|\d{{1,5}}\s(?:[A-Z'’]+\s){{1,3}}{_STREET.upper()}\b\.?(?:,\s(?:APT|UNIT|SUITE)\.?\s?\w{{1,6}})?"
)
_KOREAN_ADDRESS = re.compile(
    r"[가-힣]{1,8}(?:특별자치시|특별자치도|특별시|광역시|시|도|군|구)\s?(?:[가-힣]{1,6}(?:시|군|구)\s)?(?:[가-힣]{1,6}(?:구|읍|면|동|군)\s)?(?:[가-힣]{1,6}(?:읍|면|동|리)\s)?"
    r"[가-힣]{1,9}\d{0,3}(?:대로|로|길|들로)(?:\s?\d{1,4}번?길)?\s?\d{1,4}(?:-\d{1,4})?(?!\d|[%.,]\d)(?:번지)?"
    r"(?:,?\s?(?:지하\s?)?\d{1,4}동(?:\s?\d{1,5}호)?|,?\s?\d{1,3}층(?:\s?\d{1,5}호)?|,?\s?\d{1,5}호)?"
)
_KOREAN_ADDRESS_HINT = re.compile(r"(?:로|길)\s?\d")
# Korean surnames.
_SURNAME = "(?:김|이|박|최|정|강|조|윤|장|임|한|오|서|신|권|황|안|송|류|유|전|홍|고|문|양|손|배|백|허|남|심|노|하|곽|성|차|주|우|구|민|진|지|엄|채|원|천|방|공|현|함|변|염|여|추|도|소|석|선|설|마|길|연|위|표|명|기|반|왕|금|옥|육|인|맹|제|모|남궁|황보|제갈|선우|독고|사공)"
_UPPER, _LOWER = ("".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and getattr(c, f"is{k}")()) for k in ("upper", "lower"))
_KO_NAME = rf"{_SURNAME}[가-힣]{{1,2}}"
_KO_END = rf"(?=[^가-힣]|$|{_PARTICLE})"
_WORD = rf"(?:[{_UPPER}][{_LOWER}]{{1,15}}(?:['’\-][{_UPPER}]?[{_LOWER}]{{1,15}})?|[{_UPPER}]{{2,16}})"
_EN_NAME = rf"{_WORD}(?:\s[{_UPPER}]\.)?(?:\s(?:van|von|de|da|del|la))?\s{_WORD}"
_TITLE = r"(?:Mr|Ms|Mrs|Miss|Dr|Prof)\.?\s"
_NAME = re.compile(
    # A cue before the name; after the surest, the first name may be in small letters.
    rf"(?:(?i:\bmy\sname\sis|\bname\s?:|\bI\s?am|\bI['’]m|\bthe\stenant\sis|\btenant\s?:|\bask\sfor|\bspoke\s(?:with|to)|\bsigned\sby|\bcontact\s(?:person)?\s?:|\battn\.?:?|\bdear)|예약자명?\s?:?|담당자는?\s?:?|성함은?\s?:?|이름은?\s?:?|수신인\s?:?|받는\s?(?:분|사람)\s?:?)\s(?:{_TITLE})?(?P<a>{_EN_NAME}|{_KO_NAME}{_KO_END})"
    rf"|\b(?i:my\sname\sis)\s(?P<g>[{_LOWER}]{{2,16}}\s{_WORD})"
    rf"|(?i:\b(?:best|kind|warm)?\s?regards|\bsincerely|\bthanks|\bcheers|\byours)\s?,\s{{0,2}}\n\s?(?P<b>{_EN_NAME}|{_KO_NAME}(?![가-힣]))"
    # Who is speaking.
    rf"|\b[Tt]his\sis\s(?P<h>{_EN_NAME})(?=,\s(?:the|your|from|a|an)\b|\s(?:speaking|calling|here)\b)"
    rf"|(?<![\w])(?P<f>{_EN_NAME})\s(?:here|speaking)(?=[.,!]|$)"
    # A title before or an honorific after it.
    rf"|\b{_TITLE}(?P<c>{_EN_NAME}|{_KO_NAME}(?![가-힣]))"
    rf"|(?<![가-힣])(?P<d>{_EN_NAME}|{_KO_NAME})\s(?:씨|님|드림|올림|배상|귀하)(?=[가이께은는을를의와과도]|에게|[\s.,!]|$)"
    rf"|(?<![가-힣])(?P<e>{_KO_NAME})(?:씨|님|드림|올림)(?=[가이께은는을를의와과도]|에게|[\s.,!]|$)"
)
# Words by which a name is an organisation's.
_ORGANISATION = re.compile(
    r"\b(?:Holdings|Network|Technologies|Exchange|Foundation|Logistics|Semiconductor|Protocol|Laboratories|Biosciences|Motors|Capital|Inc|Ltd|LLC|Corp|Group|Bank|Labs?|Team|Desk|Support)\b"
)
_NAME_WORDS = ("name", "tenant", "ask for", "spoke", "signed by", "regards", "sincerely", "thanks,", "cheers,", "yours", "contact", "attn", "dear", "i am", "iam", "i'm", "i’m", "this is", " here", " speaking", "예약자", "담당자", "성함", "이름", "수신인", "받는", "씨", "님", "드림", "올림", "배상", "귀하", "mr", "ms", "miss", "dr", "prof")
_LONG_NUMBER = re.compile(r"\d[\d\s.\-()~]{5,}\d|[A-Z]\d{3}[A-Z]\d{4}")
_NUMBER_WORD = re.compile(r"\d[A-Za-z]?\s[A-Za-z]")
_NEXT_WORD = re.compile(r" [A-Z][a-z]+")
_DIGITS = re.compile(r"\d")


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in normalised text, in order and without overlap; of overlapping ones the earlier detector wins."""
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y, _ in found):
            found.append((a, b, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email")
    if _DIGITS.search(text):
        if _LONG_NUMBER.search(text):
            for m in _ID.finditer(text):
                add(*m.span(), "id_number")
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add(*m.span(), "phone")
            for m in _PASSPORT.finditer(text):
                add(*m.span("n"), "id_number")
        if _NUMBER_WORD.search(text):
            for m in _WESTERN.finditer(text):
                if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "$.,-_"):
                    add(*m.span(), "address")
        if _KOREAN_ADDRESS_HINT.search(text):
            for m in _KOREAN_ADDRESS.finditer(text):
                add(*m.span(), "address")
    low = text.lower()
    if any(w in low for w in _NAME_WORDS):
        for m in _NAME.finditer(text):
            a, b = m.span(m.lastgroup)
            following = _NEXT_WORD.match(text, b)
            if not _ORGANISATION.search(text, a, following.end() if following else b):
                add(a, b, "name")
    return sorted(found)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the characters of ``text`` as stored."""
    out, spans = normalise(text)
    found = detect(out)
    return found if spans is None else [(spans[a][0], spans[b - 1][1], kind) for a, b, kind in found]


def redact(text: str, found: list[tuple[int, int, str]] | None = None) -> str:
    """``text`` with every finding replaced by its placeholder."""
    parts, last = [], 0
    for a, b, kind in find(text) if found is None else found:
        parts += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*parts, text[last:]])


@cache
def _gates() -> tuple[str, ...]:
    """What a text must hold for any transducer or detector to find something, as patterns for Arrow's linear matcher:
    most texts hold none of it and never come to the detectors. Wider than these, never narrower."""
    folded = sorted(map(ord, _folded()))
    ends = [i for i, c in enumerate(folded) if i + 1 == len(folded) or folded[i + 1] != c + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    stand_ins = "".join(rf"\x{{{folded[a]:x}}}-\x{{{folded[b]:x}}}" for a, b in zip(starts, ends, strict=True))
    return (
        rf"[{stand_ins}]|[\pL\pN\pM_][\x{{200d}}\x{{fe0f}}]",
        r"@|골뱅이|앳|(?i:[(\[{<]\s?at\s?[)\]}>]|\sat\s\S+(?:\.|\s?[(\[{<]?\s?(?:dot|점|쩜)))",
        r"\d[\d\s.\-()~]{5,}\d|[0-9OoIl|][0-9OoIl|\-. ]{7,16}[0-9OoIl|]|[A-Z]\d{3}[A-Z]\d{4}",
        rf"[0-9{_KOREAN}](?:[\s.\-]{{0,3}}[0-9{_KOREAN}]){{8}}|(?i:{_ENGLISH})[\s.\-]{{0,3}}(?i:[0-9\s.\-]*(?:{_ENGLISH}))",
        rf"\d[A-Za-z]?\s(?:\S+\s){{1,3}}(?i:{_STREET[3:]}|(?:로|길)\s?\d",
        r"(?i:\b(?:name|tenant|ask for|spoke|signed by|regards|sincerely|thanks|cheers|yours|contact|attn|dear|i ?am|i['’]m|this is|mr|ms|mrs|miss|dr|prof)\b)",
        r"예약자|담당자|성함|이름|수신인|받는|\S\s?(?:씨|님|드림|올림|배상|귀하)(?:[가이께은는을를의와과도\s.,!]|에게|$)|\S\s(?:here|speaking)(?:[.,!]|$)",
    )


def _worth_a_look(texts: pa.Array) -> np.ndarray:
    hit = np.zeros(len(texts), bool)
    for pattern in _gates():
        rest = np.flatnonzero(~hit)
        hit[rest] = pc.fill_null(pc.match_substring_regex(texts.take(pa.array(rest)), pattern), False).to_numpy(zero_copy_only=False)
    return hit


def find_personal(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text``, once per kind found in it, with the column ``kind``. Null and empty text
    give none; a column that is named ``kind`` already is replaced."""
    others = [f for f in rows.schema.fields if f.name not in (text, "kind")]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds = [], []
            rows_at = np.flatnonzero(_worth_a_look(b.column(text)))
            for i, t in zip(rows_at.tolist(), b.column(text).take(pa.array(rows_at)).to_pylist(), strict=True):
                for kind in {k for _, _, k in find(t)}:
                    at.append(i)
                    kinds.append(kind)
            if at:
                took = b.select(names).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(kinds)], [*names, "kind"])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField("kind", T.StringType())]))


def redact_column(rows: DataFrame, text: str, to: str = "redacted") -> DataFrame:
    """``rows`` with ``to``, the text with placeholders, and n_<kind>, the number of findings. Null gives null and 0.
    Columns that have the new names already are replaced."""
    rows = rows.drop(*({to, *(f"n_{k}" for k in KINDS)} - {text}))
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType()), *(T.StructField(f"n_{k}", T.IntegerType()) for k in KINDS)])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, counts = [], {k: [] for k in KINDS}
            for t, look in zip(b.column(text).to_pylist(), _worth_a_look(b.column(text)).tolist(), strict=True):
                found = find(t) if look else []
                out.append(redact(t, found) if found else t)
                for k in KINDS:
                    counts[k].append(sum(kind == k for _, _, kind in found))
            columns = [*b.columns, pa.array(out, pa.string()), *(pa.array(counts[k], pa.int32()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


