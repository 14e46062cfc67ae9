"""Personal information in free text: e-mail addresses, phone and identity numbers, street addresses, names.

A skip-chain conditional random field labels every token of every document; the stretches found are the runs
of its labels. Forms and cue words of ``candidates`` are features of the field beside words, shapes, word lists
and neighbours, and repeated words of a document share evidence. The field is fitted on all documents
themselves, whose labels come from the candidates; in half of them it does not see these, so that
the other features learn to do without.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.crf import Graph, Model
from loomline.llm.names import GIVEN_NAMES, ORGANISATIONS, STREET_WORDS, TITLES, UNIT_WORDS
from loomline.llm.textbatch import LETTER, NUMBER, OTHER, SPACE, TextBatch, folded, mix, slices, within
from loomline.session import cut

LABELS = ("other", "person", "address", "email", "phone", "national_id")
PERSON, ADDRESS, EMAIL, PHONE, ID = 1, 2, 3, 4, 5
#: Documents of one part, about; each part is fitted by one task, and the parts' fields are averaged.
PART_DOCUMENTS = 20_000
#: Rounds over each further slice of a part; over its first there are those of the field's own fit.
LATER_ROUNDS = 6
BUCKETS = 1 << 17
#: Code points on either side of a trigger in which forms are looked for; what they find is a feature of the field.
REACH = 70
#: A token is none from this logarithm of its odds on, by its own features; it tells its neighbours so.
CLEAR = 7.0

_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|a|arroba|et)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|nokta|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|nokta|punkt|point|punto)\s)"
_SPELT = r"(?:\s?[\[({]\s?(?:dot|nokta|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|nokta|punkt|point|punto)\s)"
_MAIL = rf"\w[\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\w[\w.+-]*\s(?:at|arroba|chez)\s[\w-]+(?:\.[\w-]+)*(?:{_SPELT}[\w-]+)+"
#: Numbers of identity cards: letters and digits in any mix.
_MIX = r"(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{9,10}"
_NUMBER = rf"(?<!\w){_MIX}(?!\w)|" + r"(?<![\w.@/:#+-])(?:\+\s?)?\(?\d(?:[ .\-/()  ]{0,2}\d){6,16}(?![\d:])(?:[ -]?[A-Z](?!\w))?"
_WORD = r"[^\W\d_](?:[^\W\d_]|[̀-ͯ​-‍])*(?:-[^\W\d_]+)*"
TOKEN = re.compile(rf"(?P<mail>{_MAIL})|(?P<number>{_NUMBER})|(?P<word>(?:(?-i:[OD])['’](?=(?-i:[A-Z])))?{_WORD})|(?P<digits>\d+\w*)|(?P<sign>[^\w\s])", re.IGNORECASE)

_FOLD = {x: chr(y) for x, y in enumerate(folded()[:0x2000]) if x != y} | {0x307: None, 0x200B: None, 0x200C: None, 0x200D: None}
fold = lambda s: s.translate(_FOLD)
_set = lambda words: frozenset(fold(w) for w in words.split())
GIVEN = frozenset().union(*map(_set, GIVEN_NAMES.values()))
STREET = frozenset().union(*map(_set, STREET_WORDS.values()))
UNITS, TITLE, ORGANISATION = _set(UNIT_WORDS), _set(TITLES), _set(ORGANISATIONS)
#: Words near what they announce.
CUES = {
    "id": _set("kimlik tckn tc ssn id identity dni nie nif ausweis ausweisnummer personalausweis ausweisnr personalausweisnummer personalausweises identité identidad securite sociale kimlikno social security"),
    "number": _set("sipariş order serial seri document belge commande pedido bestellung documento dokument versiyon sürüm version release paket package kayıt entry invoice fatura ref eintrag entrada entrée série numero_serie seriennummer paquet paquete"),
    "phone": _set("tel telefon phone móvil movil hat hattını numarasını call ring téléphone teléfono nummer acil emergency urgence notfall llame appelez arayın mobil mobile gsm cep"),
    "mail": _set("mail email eposta posta correo courriel mailim"),
    "name": _set("name ad soyad adı isim nom nombre autor auteur author yazar contact iletişim sahibi applicant demandeur solicitante antragsteller kontakt contacto sayın musteri customer cliente kunde client"),
    "address": _set("adres adresi address anschrift adresse dirección direccion lives oturuyor wohnt habite vive ship_to ship to teslimat"),
}

#: Articles, after which names of persons do not stand.
ARTICLES = _set("das den dem der die des ein eine einen einem le la les un une el los las una the a an bir")

_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ][^\W\d_'’-]*"
_GAP = r"[   ]"
#: Words that come before an address and are no part of it.
_BEFORE = r"(?!(?i:kargo|paket|koli|adres\w*|ev|at|in|on|address|anschrift|adresse|dirección|paquet|paquete|colis)\b)"
_HOUSE = rf"(?:(?i:no|nr|numara)\b\.?{_GAP}?:?{_GAP}?)?\d+(?:{_GAP}?/{_GAP}?\d+|[a-zA-Z]\b)?"
_FLAT_TR = rf"(?:,?{_GAP}(?i:d|daire|kat)\b\.?{_GAP}?:?{_GAP}?\d+)*"
_ROAD_TR = r"(?i:caddesi|cadde|cad|cd|sokağı|sokak|sok|sk|bulvarı|bulvar|blv)\b\.?"
_NAMES_TR = rf"{_BEFORE}{_CAP}(?:{_GAP}{_CAP}){{0,2}}?{_GAP}"
#: Forms of addresses: district and street with house number and unit, in the word orders of the languages.
ADDRESS_FORMS = re.compile(
    "|".join(
        (
            rf"{_NAMES_TR}(?i:mahallesi|mah)\b\.?,?{_GAP}(?:\d+\.{_GAP}|{_NAMES_TR}){_ROAD_TR},?{_GAP}{_HOUSE}{_FLAT_TR}",
            rf"(?:{_NAMES_TR}){_ROAD_TR},?{_GAP}{_HOUSE}{_FLAT_TR}",
            rf"\b\d+{_GAP}?(?:(?i:bis|ter|quater)\b)?,?{_GAP}(?i:rue|avenue|av|boulevard|bd|place|pl|chemin|allée|impasse|quai|cours|route|passage|sentier)\b\.?{_GAP}(?:(?i:de la|de l['’]|des|du|de|d['’]|aux?|la|le|les){_GAP}?)?{_CAP}(?:[ -](?:(?:de la|de|du|des) )?{_CAP}){{0,3}}(?:,{_GAP}(?i:bât|appt|apt|app|étage|bâtiment|esc)\b\.?{_GAP}?\w+)*",
            rf"\b\d+[a-zA-Z]?{_GAP}{_CAP}(?:{_GAP}{_CAP}){{0,2}}?{_GAP}(?i:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|boulevard|blvd|way|place|pl|terrace|close|crescent|square|sq|parkway|row|mews)\b(?:\.(?=,)|\.(?={_GAP}[A-Z]?[a-z]*{_GAP}?\d))?(?:,?{_GAP}(?i:apt|apartment|unit|flat|suite)\.?{_GAP}?\d+(?:{_GAP}?[A-Z]\b)?)?",
            rf"\b(?i:calle|c/|avenida|avda\.?|av\.|paseo|plaza|pza\.?|camino|carretera|ronda|travesía){_GAP}?(?:(?i:de la|de los|de las|del|de){_GAP})?{_CAP}(?:{_GAP}(?:(?:de la|de los|de las|del|de|y) )?{_CAP}){{0,2}},?{_GAP}(?:(?i:n\.?º|núm\.){_GAP}?)?\d+(?:{_GAP}?(?i:bis)\b|[A-Z]\b)?(?:,{_GAP}?\d+{_GAP}?\.?{_GAP}?[ºª°](?:{_GAP}(?:[A-Z]\b|(?i:izq|dcha)\w*\.?))?)*",
            rf"\b(?:(?:Am|An der|An den|Auf der|Auf dem|In der|Im|Zum|Zur|Unter den|Alter?|Neuer?|Große|Kleine){_GAP})?(?:{_CAP}[ -])?(?!(?:ring|weg|platz|damm) )[^\W\d_'’-]*(?i:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad){_GAP}\d+{_GAP}?(?:[a-zA-Z]\b)?(?:,{_GAP}(?i:wohnung|whg|stock|hinterhaus|haus|etage)\.?{_GAP}?\d*\w*)*",
        )
    )
)

PHONE_FORM = re.compile(
    r"(?:\+|00)\s?\d[\d\s().\-/]{7,20}|0\s?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}|\(?0\d{1,4}\)?[\s./-]?\d{3,8}(?:[\s.-]\d{2,6})*|0\d(?:[\s.-]?\d{2}){4}|"
    r"\(?\d{3}\)?[\s.-]\s?\d{3}[\s.-]\d{4}|5\d{2}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}|[5-9]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}|[5-9]\d{2}(?:[\s.-]\d{2}){3}"
)
ID_FORM = re.compile(r"[1-9]\d{10}|[1-9]\d{2}\s\d{3}\s\d{3}\s\d{2}|[1-9]\d{4}[\s-]\d{6}|[1-9]\d{2}[\s-]\d{3}[\s-]\d{5}|\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}|\d{9}|\d{8}[\s-]?[A-Z]|\d{2}\.\d{3}\.\d{3}[\s-]?[A-Z]|[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?|\d{12,15}|\d{4}\s\d{4}\s\d{4}|[1-9]\d{3}[\s-]\d{3}[\s-]\d{4}|[1-9](?:[\s-]?\d){9,12}")

#: Mixes that other forms do not have; they need an identity cue, and one that also names other keys only goes with capitals.
MIX_FORM = re.compile(rf"(?!\d{{8}}[A-Z]$){_MIX}", re.IGNORECASE)
WEAK_CUES = _set("id tc social security sociale securite")
OTHER_CUES = CUES["number"] | CUES["phone"] - _set("nummer numarasını")


#: Letters without which no address form fits.
_STREET_HINT = re.compile(r"(?i)mah|cad|cd\b|sok|sk\b|bul|blv|rue|av|bd\b|pl\b|pla|chem|all|imp|quai|cours|route|pass|sent|st|r(?:oa)?d\b|lane|ln\b|dr|co?u?r?t\b|way|terr|clos|cresc|sq|park|row|mews|calle|c/|pas|pza|cam|carr|ronda|trav|str|gas|weg|ring|damm|ufer|steig|pfad")
#: Code points of signs that a name or an address may end with: a full stop and the signs of numbers.
_CLOSERS = (46, 0xBA, 0xB0, 0xAA)


class Tokens:
    """Tokens of the windows of a batch, as parallel lists."""

    def __init__(self):
        self.doc, self.window, self.start, self.end, self.kind, self.text, self.fold = [], [], [], [], [], [], []

    def add(self, doc: int, window: int, base: int, text: str) -> None:
        for m in TOKEN.finditer(text):
            t = m.group()
            kind = m.lastgroup
            if kind == "mail" and not re.search(r"[^\W\d_]{2,}$", t):
                kind = "digits"
            self.doc.append(doc)
            self.window.append(window)
            self.start.append(base + m.start())
            self.end.append(base + m.end())
            self.kind.append(kind)
            self.text.append(t)
            self.fold.append(fold(t))


def hashes(words) -> np.ndarray:
    return np.unique(TextBatch(pa.array([" ".join(sorted(words))])).words().hash)


@functools.lru_cache(1)
def _trigger_hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    near = {"dot", "nokta", "punkt", "point", "punto", "arroba", "chez"} | CUES["name"] | TITLE
    return hashes(GIVEN), hashes(STREET), hashes(near - {"av", "ad", "to"}), hashes(CUES["id"])


@functools.lru_cache(1)
def _street_tails() -> np.ndarray:
    """Last three folded letters of German street words, packed as in ``windows``."""
    words = ("straße", "strasse", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig", "pfad", "str")
    return np.unique([ord(f[-1]) | ord(f[-2]) << 21 | ord(f[-3]) << 42 for f in map(fold, words)])


def windows(text: TextBatch, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the stretches that can hold personal information: around given names and cue
    words beside a word that is not common, at-signs, numbers of seven digits and more, words of nine or ten letters
    and digits mixed, and street words and identity cues beside a number."""
    words = text.words()
    given, street, near, identity = _trigger_hashes()
    number = text.cls == NUMBER
    digits = text.sum_in(number, words.start, words.end)
    has_digit = digits > 0
    mixed = has_digit & (digits < words.length) & (words.length >= 9) & (words.length <= 10)
    beside = np.zeros(len(words.start), bool)
    for k in range(1, 8):
        beside[k:] |= has_digit[:-k]
        beside[:-k] |= has_digit[k:]
    # German street names end in the street word and have their number after them.
    long_street = np.zeros(len(words.start), bool)
    if len(words.start):
        end = words.end
        tail = text.fold[end - 1].astype(np.int64)
        for k in (2, 3):
            tail = tail | text.fold[np.maximum(end - k, words.start)].astype(np.int64) << 21 * (k - 1)
        soon = np.zeros(len(words.start), bool)
        soon[:-1] |= has_digit[1:]
        soon[:-2] |= has_digit[2:]
        long_street = (words.length > 5) & soon & within(tail, _street_tails()) & (text.cp[words.start] != text.fold[words.start])
    rare = ~within(words.hash, common) & ~has_digit & (words.length > 1)
    beside_rare = np.zeros(len(rare), bool)
    for k in (1, 2, 3):
        beside_rare[k:] |= rare[:-k]
        beside_rare[:-k] |= rare[k:]
    hit = within(words.hash, given) & beside_rare & _rare_near(rare) | within(words.hash, near) & beside_rare | within(words.hash, street) & beside | long_street
    hit |= mixed | within(words.hash, identity) & (beside | has_digit)
    member = number | text.among(" ()+.-/ ")
    rs, re_ = text.runs(member)
    rich = text.sum_in(number, rs, re_) >= 7
    at = np.flatnonzero(text.among("@"))
    start = np.concatenate([words.start[hit], rs[rich], at])
    end = np.concatenate([words.end[hit], re_[rich], at + 1])
    if not len(start):
        return start, start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    doc = text.doc[start]
    start = np.maximum(start - REACH, text.starts[doc])
    end = np.minimum(end + REACH, text.starts[doc + 1])
    top = np.maximum.accumulate(end)
    new = np.append(True, (start[1:] > top[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(start) - 1)
    return doc[first], start[first], top[last]


def _rare_near(rare: np.ndarray) -> np.ndarray:
    """True where one of the two words before or after is rare."""
    out = np.zeros(len(rare), bool)
    for k in (1, 2):
        out[k:] |= rare[:-k]
        out[:-k] |= rare[k:]
    return out


def tokens_of(text: TextBatch, common: np.ndarray) -> tuple[Tokens, list[tuple[int, int, str]]]:
    """Tokens of all windows; offsets count code points of the document. Windows grow to whole words."""
    out, spans = Tokens(), []
    doc, start, end = windows(text, common)
    raw = text.cp
    word = (text.cls < 4) & (text.cls != 3)
    for w, (d, a, b) in enumerate(zip(doc.tolist(), start.tolist(), end.tolist())):
        lo, hi = int(text.starts[d]), int(text.starts[d + 1])
        while a > lo and word[a - 1] and word[a]:
            a -= 1
        while b < hi and word[b] and word[b - 1]:
            b += 1
        s = raw[a:b].tobytes().decode("utf-32-le", "replace")
        out.add(d, w, a - lo, s)
        spans.append((d, a - lo, s))
    return out, spans


def _shape(t: str) -> int:
    if not t[:1].isalpha():
        return 0
    return 1 if t.islower() else 2 if t.isupper() and len(t) > 1 else 3


_BREAKS = frozenset("\n;{}<>|=")


def rule_spans(t: Tokens, common: frozenset[str]) -> list[tuple[int, int, int]]:
    """Label and first and last token of the stretches that rules find: names by given-name lists, numbers by form and cue."""
    n, out = len(t.fold), []
    shapes = [_shape(x) for x in t.text]
    is_word = [k == "word" for k in t.kind]
    given = given_flags(t)
    surname = [w and len(f) > 2 and f not in common and f not in ORGANISATION and f not in STREET and f not in TITLE and f not in GIVEN for w, f in zip(is_word, t.fold)]
    i = 0
    while i < n:
        label, stop = 0, i + 1
        if t.kind[i] == "mail":
            label = EMAIL
        elif t.kind[i] == "number":
            label = number_kind(t, i)
        elif given[i] or surname[i] and i + 1 < n and (given[i + 1] or i + 2 < n and t.text[i + 1] == "," and given[i + 2]):
            stop = name_end(t, i, given, surname, shapes)
            label, stop = (PERSON, stop) if stop > i else (0, i + 1)
        if label:
            out.append((label, i, stop - 1))
        i = stop
    return out


def given_flags(t: Tokens) -> list[bool]:
    """Words of the given-name lists, hyphenated ones by their parts."""
    return [k == "word" and len(f) > 1 and all(p in GIVEN for p in f.split("-")) for k, f in zip(t.kind, t.fold)]


def mix_kind(t: Tokens, i: int) -> int:
    """Identity number for a mix of letters and digits with an identity cue before it or right after, else 0."""

    def cue(j: int) -> bool:
        return t.fold[j] in CUES["id"] and (t.fold[j] not in WEAK_CUES or t.text[i].isupper())

    for j in range(i - 1, max(-1, i - 9), -1):
        if t.window[j] != t.window[i] or t.kind[j] in ("number", "mail") or t.fold[j] in OTHER_CUES:
            break
        if cue(j):
            return ID
    return ID if any(t.window[j] == t.window[i] and cue(j) for j in range(i + 1, min(i + 3, len(t.fold)))) else 0


def number_kind(t: Tokens, i: int) -> int:
    """Phone or identity number by form and by the cue nearest before it; 0 for neither."""
    text = t.text[i].strip()
    if MIX_FORM.fullmatch(text):
        return mix_kind(t, i)
    digits = sum(c.isdigit() for c in text)
    cue = None
    for j in range(i - 1, max(-1, i - 9), -1):
        if t.window[j] != t.window[i]:
            break
        cue = next((k for k in ("id", "number", "phone") if t.fold[j] in CUES[k]), None)
        if cue or t.kind[j] in ("number", "mail"):
            break
    phone, ident = bool(PHONE_FORM.fullmatch(text)), bool(ID_FORM.fullmatch(text))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{1,2}(?:\.\d+)?|[12]\d{3}[-/][12]\d{3}|\d+\.\d+\.\d+(?:\.\d+)?", text) and not (phone and cue == "phone"):
        if not re.fullmatch(r"\d{3}\.\d{3}\.\d{2}\.\d{2}|\d{3}\.\d{3}\.\d{4}|0\d\.\d{2}\.\d{2}\.\d{2}\.\d{2}|\d{3}\.\d{3}\.\d{3}", text):
            return 0
    if cue == "number":
        return PHONE if text[0] == "+" and phone else 0
    if text[0] in "+(" or text.startswith("00") and phone:
        return PHONE if phone else 0
    if cue == "id" and ident:
        return ID
    if cue == "phone" and phone:
        return PHONE
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}|[1-9]\d{10}|[1-9]\d{2} \d{3} \d{3} \d{2}|[1-9]\d{4}-\d{6}|\d{8}[ -]?[A-Z]", text):
        return ID
    if digits == 9 and text.isdigit():
        return ID if i and any(t.kind[j] == "mail" for j in range(max(0, i - 4), i)) else PHONE if phone and cue is None and text[0] in "567" else 0
    return PHONE if phone and not text.isdigit() or phone and text[0] == "0" and digits in (10, 11) else 0


def name_end(t: Tokens, i: int, given: list[bool], surname: list[bool], shapes: list[int]) -> int:
    """End of a name that begins at token i, or i. Given names, a middle name or initial and a surname, or the
    surname first; parts share a line and a style of case, and no organisation word follows."""
    n, w = len(t.fold), t.window[i]

    def near(j: int) -> bool:
        return j < n and t.window[j] == w and t.start[j] - t.end[j - 1] <= 3 and not t.broken[j]

    def initial(j: int) -> int:
        if near(j) and t.kind[j] == "word" and len(t.text[j]) == 1:
            return j + 2 if near(j + 1) and t.text[j + 1] == "." and t.start[j + 1] == t.end[j] else j + 1
        return j

    def after(j: int) -> bool:  # a word that makes the run something else
        return near(j) and t.kind[j] == "word" and (t.fold[j] in ORGANISATION or t.fold[j] in STREET and t.fold[j] not in ("c", "d"))

    def style(a: int, b: int) -> bool:
        s = {shapes[k] for k in range(a, b) if t.kind[k] == "word" and len(t.text[k]) > 1}
        return len(s) == 1 or s == {2, 3}

    if given[i]:
        j = i + 1
        while near(j) and given[j]:
            j += 1
        j = initial(j)
        ends = j
        while near(ends) and surname[ends] and ends < j + 2 and (ends == j or shapes[ends] == shapes[j] and shapes[j] != 1):
            ends += 1
        if ends > j and style(i, ends) and not after(ends):
            return ends
        if ends - 1 > j and style(i, ends - 1):
            return ends - 1
        return i
    j = i + 1
    comma = near(j) and t.text[j] == ","
    if comma:
        j += 1
    if near(j) and given[j] and (comma or shapes[i] in (2, 3)):
        k = j + 1
        while near(k) and given[k]:
            k += 1
        k = initial(k)
        if near(k) and surname[k] and not comma:
            return i
        if style(i, k) and not after(k):
            return k
    return i


def mark_breaks(t: Tokens, spans: list[tuple[int, int, str]]) -> None:
    """Whether a line end lies between a token and the one before it."""
    base = {w: a for w, (_, a, _) in enumerate(spans)}
    t.broken = [False] * len(t.fold)
    for j in range(1, len(t.fold)):
        w = t.window[j]
        if w == t.window[j - 1]:
            between = spans[w][2][t.end[j - 1] - base[w] : t.start[j] - base[w]]
            t.broken[j] = "\n" in between or "\t" in between


def candidates(text: TextBatch, common: frozenset[str], common_hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """Label, start and end (code points of the batch) of the stretches that rules and forms find."""
    t, spans = tokens_of(text, common_hashes)
    mark_breaks(t, spans)
    begin = text.starts
    out = [(label, int(begin[t.doc[i]]) + t.start[i], int(begin[t.doc[i]]) + t.start[j] + len(t.text[j].rstrip())) for label, i, j in rule_spans(t, common)]
    for d, a, s in spans:
        if _STREET_HINT.search(s):
            out += [(ADDRESS, int(begin[d]) + a + m.start(), int(begin[d]) + a + m.end()) for m in ADDRESS_FORMS.finditer(s)]
    return out


@functools.lru_cache(1)
def _upper() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[x for x in range(0x3000) if chr(x).isupper()]] = True
    return table


@functools.lru_cache(1)
def _word_bits() -> tuple[np.ndarray, np.ndarray]:
    """Ordered hashes of the words of all lists, and for each a bit for every list it is in and, from bit 8 on, the
    number of the first kind of cue it is."""
    bits: dict[int, int] = {}
    for k, words in enumerate((GIVEN, STREET, UNITS, TITLE, ORGANISATION)):
        for h in hashes(words).tolist():
            bits[h] = bits.get(h, 0) | 1 << k
    for k, words in enumerate(CUES.values(), 1):
        for h in hashes(words).tolist():
            if bits.get(h, 0) < 256:
                bits[h] = bits.get(h, 0) | k << 8
    ordered = np.array(sorted(bits), np.uint64)
    return ordered, np.array([bits[h] for h in ordered.tolist()], np.int64)


class Nodes:
    """All words and signs of a batch in order, with what the features are made of."""

    def __init__(self, text: TextBatch, common: np.ndarray, frequent: np.ndarray, spans: list[tuple[int, int, int]]):
        words = text.words()
        sign = np.flatnonzero(text.cls == OTHER)
        start = np.concatenate([words.start, sign])
        order = np.argsort(start, kind="stable")
        self.start, self.end = start[order], np.concatenate([words.end, sign + 1])[order]
        self.n, self.doc, self.word = len(start), text.doc[start[order]], order < len(words.start)
        self.hash = np.concatenate([words.hash, mix(text.cp[sign].astype(np.uint64))])[order]
        n_digits = text.sum_in(text.cls == NUMBER, self.start, self.end)
        length = text.sum_in((text.cls == LETTER) | (text.cls == NUMBER), self.start, self.end)
        capital = _upper()[text.cp] & (text.cls == LETTER)
        upper = text.sum_in(capital, self.start, self.end)
        first = capital[self.start] if self.n else np.zeros(0, bool)
        self.digits, letters = n_digits, length - n_digits
        self.shape = np.select([~self.word, letters == 0, n_digits > 0, (length == 1) & first, length == 1, upper == length, first], [0, 4, 5, 6, 7, 2, 3], 1)
        self.size = np.where(n_digits > 0, np.minimum(length, 15), 0)
        known, bits = _word_bits()
        at = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
        bits = np.where(known[at] == self.hash, bits[at], 0)
        flags = bits & 255 | within(self.hash, common).astype(np.int64) << 5 | within(self.hash, frequent).astype(np.int64) << 6
        self.flags = np.where(self.word, flags, 128 + (self.hash % np.uint64(61)).astype(np.int64)) * 8 + self.shape
        cue = bits >> 8
        last = np.maximum.accumulate(np.where(cue > 0, np.arange(self.n), -1)) if self.n else np.zeros(0, np.int64)
        last = np.append(-1, last[:-1]) if self.n else last
        near = (last >= 0) & (np.arange(self.n) - last <= 8) & (self.doc[last] == self.doc) if self.n else np.zeros(0, bool)
        self.cue = np.where(near, cue[last], 0) if self.n else cue
        lines = np.append(0, np.cumsum(text.among("\n\r\t")))
        spaces = np.append(0, np.cumsum(text.cls == SPACE))
        before = np.append(0, self.end[:-1])
        self.broken = (lines[self.start] > lines[before]) | np.append(True, self.doc[1:] != self.doc[:-1]) if self.n else np.zeros(0, bool)
        self.apart = spaces[self.start] - spaces[before] if self.n else np.zeros(0, np.int64)
        # The last letters of each word.
        tail = np.zeros(self.n, np.uint64)
        for k in range(1, 4):
            inside = self.end - k >= self.start
            tail = tail * np.uint64(0x110000) + np.where(inside, text.fold[np.maximum(self.end - k, 0)] if len(text.fold) else 0, 0).astype(np.uint64)
        self.tail = tail
        # Candidates: twice the label, plus one at the first token.
        self.candidate = np.zeros(self.n, np.int64)
        if spans:
            label, a, b = (np.array(x) for x in zip(*spans))
            lo, hi = np.searchsorted(self.start, a), np.searchsorted(self.start, b)
            size = np.maximum(hi - lo, 0)
            inside = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
            self.candidate[inside] = np.repeat(label * 2, size)
            self.candidate[lo[size > 0]] += 1

    def near(self, values: np.ndarray, step: int) -> np.ndarray:
        """Values of the tokens some places away in the same document; 0 beyond its ends."""
        out = np.zeros_like(values)
        if self.n > abs(step):
            here, there = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            out[here] = np.where(self.doc[here] == self.doc[there], values[there], 0)
        return out

    def doubtful(self) -> np.ndarray:
        """Words that may be a name which no list has: beside another one, capital,
        not frequent, after no article and of no list of other things."""
        some = self.word & np.isin(self.shape, (2, 3)) & (self.flags // 8 & 0b1111010 == 0) & (self.candidate == 0)
        after = self.near(within(self.hash, hashes(ARTICLES)), -1)
        some &= ~after & ~self.near(some & after, -1)
        return some & (self.near(some, 1) | self.near(some, -1))

    def features(self, seen: np.ndarray | None = None, listed: np.ndarray | None = None) -> np.ndarray:
        """Hashed features of each token. ``seen`` marks the tokens that see candidates, ``listed`` those that see the
        list of given names (all, if not given)."""
        flags = self.flags if listed is None else np.where(listed | ~self.word, self.flags, self.flags & ~8)
        f, h, shape = flags.astype(np.uint64), self.hash, self.shape.astype(np.uint64)
        c = self.candidate if seen is None else np.where(seen, self.candidate, 99)
        c = c.astype(np.uint64)
        u = lambda x: x.astype(np.uint64)
        left, right = self.near(f, -1), self.near(f, 1)
        size, broken = u(self.size), u(self.broken)
        after = self.near(broken, 1)
        parts = (
            (shape,), (h,), (self.tail, shape), (f, broken), (c,), (self.near(c, -1), c, self.near(c, 1)), (self.near(h, -1), f), (self.near(h, 1), f), (left, f, broken), (right, f, after),
            (self.near(shape, -1), shape, self.near(shape, 1), broken, after), (self.near(f, -2), left, f), (self.near(f, 2), right, f), (u(self.cue), shape, size), (self.near(size, -1), size, self.near(size, 1), left, right),
            (u(self.apart > 0), left, right, f),
        )
        out = np.empty((len(parts), self.n), np.int32).T
        with np.errstate(over="ignore"):
            for k, part in enumerate(parts):
                x = np.full(self.n, k + 1, np.uint64) if len(part) > 1 else np.uint64(k + 1)
                for value in part:
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + value * np.uint64(0x9E3779B97F4A7C15)
                out[:, k] = ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) % np.uint64(BUCKETS)
        return out

    def keys(self, common: np.ndarray) -> np.ndarray:
        """Equal for repetitions of one word that may be part of a name; 0 for all other tokens."""
        some = np.isin(self.shape, (2, 3)) & (self.flags & 256 == 0) & (self.end - self.start > 3)
        return np.where(some, self.hash.view(np.int64), 0)


class Finder:
    """The fitted field with the words that are common in the documents, and those that are frequent in any case there."""

    def __init__(self, model: Model, common: frozenset[str], frequent: frozenset[str]):
        self.model, self.common, self.common_hashes, self.frequent_words, self.frequent = model, common, hashes(common), frequent, hashes(frequent)

    @classmethod
    def of_words(cls, counts: dict[str, tuple[int, int]], documents: int) -> Finder:
        """An empty field with the words that so many documents hold: ``counts`` has in how many a word is in small
        letters, and in how many in any case."""
        least = max(3, documents // 400)
        common = frozenset(w for w, (c, _) in counts.items() if c >= least and w not in GIVEN or c >= 10 * least)
        return cls(Model(len(LABELS), BUCKETS), common, frozenset(w for w, (_, c) in counts.items() if c >= 3 * least and w not in GIVEN))

    @classmethod
    def fit(cls, texts: list[str]) -> Finder:
        out = cls.of_words(word_counts(texts), len(texts))
        if example := out.examples(TextBatch(pa.array(texts, pa.string()))):
            out.model.fit(*example)
        return out

    def examples(self, text: TextBatch) -> tuple[np.ndarray, np.ndarray, Graph] | None:
        """Features, labels and edges of the tokens that the field is fitted on."""
        nodes = Nodes(text, self.common_hashes, self.frequent, candidates(text, self.common, self.common_hashes))
        if not nodes.n:
            return None
        labels = nodes.candidate // 2
        # Tokens beside candidates, numbers, given names and pairs of capital words, and all of every twentieth document.
        capital = nodes.word & np.isin(nodes.shape, (2, 3))
        pair = capital & (nodes.near(capital, 1) | nodes.near(capital, -1))
        mark = (labels > 0) | (nodes.digits > 3) | (nodes.flags // 8 % 2 == 1) & nodes.word | (nodes.doc % 20 == 0) | pair & ~nodes.doubtful()
        close = np.zeros(nodes.n + 1, np.int64)
        at = np.flatnonzero(mark)
        np.add.at(close, np.maximum(at - 6, 0), 1)
        np.add.at(close, np.minimum(at + 7, nodes.n), -1)
        # What may be a name outside the lists is no example of anything.
        use = (np.cumsum(close[:-1]) > 0) & ~nodes.doubtful()
        if not use.any():
            return None
        window = np.cumsum(use & ~np.append(False, use[:-1]) | np.append(True, nodes.doc[1:] != nodes.doc[:-1]))
        features = nodes.features(seen=nodes.doc % 2 == 0, listed=nodes.doc % 4 != 3)
        return features[use], labels[use], Graph(window[use], nodes.doc[use], nodes.keys(self.common_hashes)[use])

    def labels(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Label of each token by the field's marginals, and its probability."""
        scores = self.model.scores(nodes.features())
        open_ = scores[:, 0] - scores[:, 1:].max(1) < CLEAR
        # What clear tokens tell their neighbours; skip edges join open tokens only.
        chain = self.model.pair[0]
        base = scores.astype(np.float64)
        inner = nodes.doc[1:] == nodes.doc[:-1]
        clear = ~open_
        base[1:][inner & clear[:-1]] += chain[0]
        base[:-1][inner & clear[1:]] += chain[:, 0]
        at = np.flatnonzero(open_)
        window = np.cumsum(np.append(True, (np.diff(at) > 1) | (nodes.doc[at[1:]] != nodes.doc[at[:-1]]))) if len(at) else at
        p = np.zeros((nodes.n, len(LABELS)))
        p[:, 0] = 1.0
        if len(at):
            p[at] = self.model.beliefs(base[at], Graph(window, nodes.doc[at], nodes.keys(self.common_hashes)[at]))
        # Tokens of one candidate have one label: its own if that is the likelier for its tokens together.
        begin = np.flatnonzero(nodes.candidate % 2 == 1)
        if len(begin):
            group = np.cumsum(nodes.candidate % 2 == 1) - 1
            inside = nodes.candidate > 0
            mean = np.bincount(group[inside], p[inside, nodes.candidate[inside] // 2], len(begin)) / np.bincount(group[inside], minlength=len(begin))
            whole = inside & (mean[np.maximum(group, 0)] > 0.5)
            p[whole] = 0
            p[whole, nodes.candidate[whole] // 2] = 1
        return p.argmax(1), p.max(1)

    def find(self, text: TextBatch) -> list[tuple[int, int, int, int]]:
        """(document, label, start, end) of each stretch, in order: the runs of the field's labels, on one line, without
        outer signs. A run is parted where a candidate begins in it. A name has two words, a number and an address digits."""
        nodes = Nodes(text, self.common_hashes, self.frequent, candidates(text, self.common, self.common_hashes))
        if not nodes.n:
            return []
        label, _ = self.labels(nodes)
        new = (label != np.append(0, label[:-1])) | nodes.broken & (label != ADDRESS) | (nodes.candidate == label * 2 + 1) & (label > 0) | np.append(True, nodes.doc[1:] != nodes.doc[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], nodes.n)
        some = label[begin] > 0
        out = []
        for a, b in zip(begin[some].tolist(), stop[some].tolist()):
            k = int(label[a])
            opening = (40, 43) if k == PHONE else ()
            while a < b and not nodes.word[a] and int(text.cp[nodes.start[a]]) not in opening:
                a += 1
            while a < b and not nodes.word[b - 1] and not (k in (PERSON, ADDRESS) and int(text.cp[nodes.start[b - 1]]) in _CLOSERS and nodes.candidate[b - 1] // 2 == k):
                b -= 1
            if a == b:
                continue
            n_words, n_digits = int(nodes.word[a:b].sum()), int(nodes.digits[a:b].sum())
            if (n_words >= 2) if k == PERSON else (n_digits >= 1) if k == ADDRESS else (n_digits >= 7) if k == PHONE else (n_digits >= 1 and b - a <= 16) if k == ID else (n_words >= 2):
                d = int(nodes.doc[a])
                out.append((d, k, int(nodes.start[a] - text.starts[d]), int(nodes.end[b - 1] - text.starts[d])))
        return out


def word_counts(texts: Iterable[str]) -> dict[str, tuple[int, int]]:
    """In how many texts each folded word is in small letters, and in how many in any case."""
    low: Counter[str] = Counter()
    every: Counter[str] = Counter()
    plain: dict[str, str] = {}
    for x in texts:
        found = set(re.findall(_WORD, x))
        for w in found:
            if w not in plain:
                plain[w] = fold(w)
        low.update({plain[w] for w in found if w.islower()})
        every.update({plain[w] for w in found})
    return {w: (low[w], n) for w, n in every.items()}


def _word_table(rows: DataFrame) -> DataFrame:
    """``word, low, every`` of all texts, from one row for each word of an array batch; the row of the word '' counts
    the texts. Rarer words than any threshold are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = word_counts(x.as_py() for x in batch.column(0)) | {"": (0, batch.num_rows)}
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["word", "low", "every"])

    counts = rows.select("text").mapInArrow(run, "word string, low bigint, every bigint").groupBy("word").agg(F.sum("low").alias("low"), F.sum("every").alias("every"))
    return cut(counts.where("every >= 3 or word = ''"))


def fit_finder(documents: DataFrame, id_column: str, text: str) -> Finder:
    """A finder fitted on all documents. Words are counted over all of them. A hash deals the documents into parts of
    about PART_DOCUMENTS; each part's field is fitted slice by slice, going on from one slice to the next, and the
    fields are averaged, each feature by the tokens that have it. The parts don't depend on how the table is stored.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(id_column, text).alias("hash"))
    words = _word_table(rows)
    total = words.where("word = ''").first()
    n = total["every"] if total else 0
    some = words.where((F.col("every") >= max(3, n // 400)) & (F.col("word") != "")).toArrow().to_pydict()  # so many that a text of average length has, 400 times at most
    out = Finder.of_words({w: (a, b) for w, a, b in zip(some["word"], some["low"], some["every"])}, n)
    shared = documents.sparkSession.sparkContext.broadcast((out.common, out.frequent_words))
    k = len(LABELS)
    names = ["bucket", "n", *(f"w{c}" for c in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Model(k, BUCKETS), *shared.value)
        model, gains, used, tokens = finder.model, finder.model.gains(), np.zeros(BUCKETS), 0
        for _, texts in slices(batches, "text"):
            if example := finder.examples(texts):
                model.fit(*example, **({"rounds": LATER_ROUNDS} if tokens else {}), gains=gains)
                used += np.bincount(example[0].reshape(-1), minlength=BUCKETS)
                tokens += len(example[1])
        if tokens:
            at = np.append(np.flatnonzero(used), BUCKETS + np.arange(2 * k))
            weight = np.append(used[used > 0], np.full(2 * k, float(tokens)))
            values = np.concatenate([model.unary[used > 0], model.pair.reshape(2 * k, k)]) * weight[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight), *(pa.array(values[:, c]) for c in range(k))], names)

    parts = rows.repartition(max(1, -(-n // PART_DOCUMENTS)), "hash").sortWithinPartitions("hash").select("text")
    sums = parts.mapInArrow(run, "bucket int, " + ", ".join(f"{c} double" for c in names[1:])).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()  # bounded by BUCKETS
    if sums.num_rows:
        every = np.zeros((BUCKETS + 2 * k, k))
        every[sums["bucket"].to_numpy()] = np.stack([sums[c].to_numpy() for c in names[2:]], 1) / sums["n"].to_numpy()[:, None]
        out.model.unary[:] = every[:BUCKETS]
        out.model.pair[:] = every[BUCKETS:].reshape(2, k, k)
    return out


def find_personal(documents: DataFrame, id_column: str, text: str, finder: Finder) -> DataFrame:
    """``doc_id, text, found ARRAY<STRUCT<kind, start, end, found>>``: stretches of personal information in each
    text, in order and without overlaps; offsets count code points.

    Null, empty and blank texts have an empty array and stay as they are. Each row is handled on its own and
    whole. Repeated rows give repeated results; other columns are ignored.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(finder)  # bounded by the common words and BUCKETS
    ddl = "doc_id bigint, text string, found array<struct<kind:string,start:int,end:int,found:string>>"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            lists: list[list[dict]] = [[] for _ in range(texts.n)]
            for d, label, a, b in shared.value.find(texts):
                at = int(texts.starts[d])
                found = texts.cp[at + a : at + b].tobytes().decode("utf-32-le")
                lists[d].append({"kind": LABELS[label], "start": a, "end": b, "found": found})
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(kind))], ["doc_id", "text", "found"])

    return rows.mapInArrow(run, ddl)


def redacted(text: Column, found: Column) -> Column:
    """The text with each stretch replaced by its kind in brackets, such as ``[EMAIL]``."""
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.concat(a["done"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("done"), x["end"].alias("at")
    )
    return F.aggregate(found, empty, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))
