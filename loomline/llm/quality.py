"""Text statistics of documents, published fixed-threshold rules, and the kind of text that follows from the failed ones."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomline.llm.language import FREQUENT_WORDS
from loomline.llm.textbatch import IGNORED, LETTER, NUMBER, OTHER, SPACE, TextBatch, hash_spans, mix, slices, within

#: Phrases of site menus, by language.
MENU = {
    "en": "home|next|previous|back|share|contact|about|search|menu|login|log in|log out|sign in|sign up|register|subscribe|sitemap|cart|comments|read more|show more|cookie settings|cookies|accept all|accept|decline|privacy policy|terms of use|help|faq|follow us|download|print|top|skip to content|newsletter",
    "tr": "ana sayfa|sonraki|önceki|geri|paylaş|iletişim|hakkımızda|ara|menü|giriş|giriş yap|çıkış|üye ol|kayıt ol|abone ol|site haritası|sepet|yorumlar|devamını oku|daha fazla|çerez ayarları|çerezler|tümünü kabul et|kabul et|reddet|gizlilik politikası|kullanım koşulları|yardım|sss|bizi takip edin|indir|yazdır|yukarı|bülten",
    "de": "startseite|weiter|zurück|teilen|kontakt|über uns|suche|menü|anmelden|abmelden|registrieren|abonnieren|sitemap|warenkorb|kommentare|weiterlesen|mehr lesen|mehr anzeigen|cookie-einstellungen|alle akzeptieren|akzeptieren|ablehnen|datenschutz|impressum|nutzungsbedingungen|hilfe|folgen sie uns|herunterladen|drucken|nach oben",
    "fr": "accueil|suivant|précédent|retour|partager|contact|à propos|rechercher|recherche|menu|connexion|se connecter|déconnexion|s'inscrire|inscription|s'abonner|plan du site|panier|commentaires|lire la suite|voir plus|paramètres des cookies|tout accepter|accepter|refuser|mentions légales|confidentialité|aide|suivez-nous|télécharger|imprimer|haut de page",
    "es": "inicio|siguiente|anterior|volver|compartir|contacto|acerca de|buscar|menú|iniciar sesión|cerrar sesión|registrarse|suscribirse|mapa del sitio|carrito|comentarios|leer más|ver más|configuración de cookies|aceptar todo|aceptar todas|aceptar|rechazar|política de privacidad|aviso legal|ayuda|síguenos|descargar|imprimir|arriba",
}

#: Signs that end a sentence, quotes and brackets that may follow, and marks of entries.
ENDS, CLOSERS, BULLETS, BETWEEN = ".!?…", "\"'”’»)]}*_~“", "-*•▪+●◦‣·–—", ",;/|•·»>"

#: Part of a text that is no prose for the text to be none.
LEAST = 0.5
#: Rules of published filters of web text with their thresholds. A text that fails none of them is prose.
#: Gopher: Rae et al. 2021, table A1; C4: Raffel et al. 2020, section 2.2; FineWeb: Penedo et al. 2024, section 3.6.
PUBLISHED = {
    "few_words": "C4: fewer than 5 words",
    "mean_word_length": "Gopher: mean word length outside 3 to 10",
    "symbols": "Gopher: more than 0.1 symbols (# and ellipses) for each word",
    "bullets": "Gopher: more than 0.9 of the lines begin with a bullet",
    "ellipses": "Gopher: more than 0.3 of the lines end with an ellipsis",
    "few_alphabetic_words": "Gopher: fewer than 0.8 of the words have a letter",
    "few_common_words": "Gopher: fewer than two common words",
    "duplicate_lines": "Gopher: more than 0.3 of the lines repeat another",
    "duplicate_ngrams": "Gopher: more than 0.15 of the runs of five words repeat an earlier one",
    "dropped_lines": "C4: more than half of the signs are on lines that do not end in punctuation, which that filter drops",
    "unended_lines": "FineWeb: at most 0.12 of the lines end in punctuation",
    "short_lines": "FineWeb: at least 0.67 of the lines are shorter than 30 characters",
}
#: Measures that say what kind a text is that fails a published rule. All but the last two mean junk.
KINDS = {
    "repeated_words": "fewer than half of the word triples are distinct",
    "encoded_data": "more than half of the signs are in unbroken stretches of more than 60 that are hardly parted into words",
    "mostly_symbols": "more than 0.45 of the signs are symbols",
    "unreadable_words": "more than 0.4 of the letters are in words with hardly a vowel",
    "log_lines": "more than half of the signs are on lines that begin with a time",
    "menu_phrases": "at least half of the words are in phrases of site menus",
    "no_letters": "no letter, and no rows of cells",
    "table_lines": "more than half of the signs are in rows of cells and fields, or in those and entries, and more in rows",
    "list_lines": "more than half of the signs are in entries, or in those and rows, and more in entries",
}
RULES = PUBLISHED | KINDS

SCHEMA = (
    "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "ended_line_share double, bullet_line_share double, common_word_share double, distinct_triple_share double, "
    "short_line_share double, duplicate_line_share double, prose_share double, list_share double, table_share double, kind string, failures array<string>"
)


def _codes(signs: str) -> np.ndarray:
    return np.frombuffer(signs.encode("utf-32-le"), np.uint32)


@functools.lru_cache(1)
def common_hashes() -> np.ndarray:
    return np.unique(TextBatch(pa.array([" ".join(FREQUENT_WORDS.values())])).words().hash)


def _phrase_hashes(words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the sequence of words first..last of each phrase."""
    with np.errstate(over="ignore"):
        rank = np.arange(len(words.hash), dtype=np.uint64)
        total = np.zeros(len(rank) + 1, np.uint64)
        np.cumsum(words.hash, out=total[1:])
        order = np.zeros(len(rank) + 1, np.uint64)
        np.cumsum(words.hash * rank, out=order[1:])
        s, e = start.astype(np.int64), end.astype(np.int64)
        first = rank[np.minimum(s, max(len(rank) - 1, 0))] if len(rank) else np.zeros(len(s), np.uint64)
        return mix((order[e] - order[s]) - first * (total[e] - total[s]) + (total[e] - total[s]) * np.uint64(31) + (e - s).astype(np.uint64))


@functools.lru_cache(1)
def menu_hashes() -> np.ndarray:
    text = TextBatch(pa.array([p for v in MENU.values() for p in v.split("|")]))
    words = text.words()
    at = np.arange(text.n)
    return np.unique(_phrase_hashes(words, np.searchsorted(words.doc, at), np.searchsorted(words.doc, at, "right")))


class Lines:
    """Statistics of the lines that have anything on them."""

    def __init__(self, text: TextBatch):
        b, cp = text, text.cp
        space = b.cls == SPACE
        start, end = b.runs(~b.among("\n\r\v\f\x85\u2028\u2029"))
        ink = ~space & (b.cls != 5)
        some = b.sum_in(ink, start, end) > 0
        self.start, self.end = start, end = start[some], end[some]
        self.doc = b.doc[start] if len(start) else np.zeros(0, np.int32)
        n = lambda flags: b.sum_in(flags, start, end)
        prev = lambda x: np.append(False, x[:-1]) & ~b.first
        nxt = lambda x: np.append(x[1:], False)
        self.ink = n(ink)
        self.letters, self.digits = n(b.cls == LETTER), n(b.cls == NUMBER)
        self.text_words = words = b.words()
        wstart = np.zeros(len(cp) + 1, bool)
        wstart[words.start] = True
        self.words = n(wstart[:-1])
        common = within(words.hash, common_hashes())
        flag = np.zeros(len(cp) + 1, bool)
        flag[words.start[common]] = True
        self.common = n(flag[:-1])
        at = np.flatnonzero(ink)
        before = np.append(0, np.cumsum(ink))
        first_at = at[before[start]] if len(start) else start
        # the last sign that is no closing quote or bracket, if the line has another sign
        closer = b.among(CLOSERS) & ink
        solid = ink & ~closer
        upto = np.append(0, np.cumsum(solid))
        solid_at = np.flatnonzero(solid)
        has = upto[end] > upto[start]
        last_at = np.where(has, solid_at[np.maximum(upto[end] - 1, 0)] if len(solid_at) else 0, first_at)
        dot = cp == 46
        self.ended = b.among(ENDS)[last_at] if len(start) else np.zeros(0, bool)
        self.ellipsis = (cp[last_at] == 0x2026) | (dot & prev(dot) & prev(prev(dot)))[last_at] if len(start) else np.zeros(0, bool)
        self.chars = end - start
        self.hash = hash_spans(b.fold, ink, start, end)
        self.leader = n(dot & prev(dot) & prev(prev(dot)) & prev(prev(prev(dot)))) > 0
        bullet = b.among(BULLETS)
        follows_space = space | (np.arange(len(cp)) == len(cp) - 1)
        mark = bullet & nxt(follows_space)
        self.bullet = mark[first_at] if len(start) else np.zeros(0, bool)
        number = (b.cls == NUMBER) & (nxt(cp == 46) | nxt(cp == 41)) & nxt(nxt(space))
        near = np.append(0, np.cumsum(number))
        self.numbered = ((b.cls[first_at] == NUMBER) & (near[np.minimum(first_at + 3, end)] > near[first_at])) if len(start) else np.zeros(0, bool)
        self.link = n((cp == 93) & nxt(cp == 40)) > 0
        self.pipes, self.tabs = n(cp == 124), n(cp == 9)
        tight = ~nxt(space)
        self.tight = n(((cp == 44) | (cp == 59)) & tight)
        self.semicolons = n(cp == 59)
        ends = b.among(ENDS) & prev((b.cls == LETTER) | b.among(CLOSERS)) & (nxt(space) | (np.append(b.first[1:], True)))
        self.sentences = n(ends)
        blank = space & (cp != 9)
# wide gaps between cells, not before the first or after the last
        self.gaps = b.sum_in(blank & prev(blank) & nxt(ink), first_at, end) if len(start) else np.zeros(0, np.int64)
        separators = b.among(BETWEEN) & (nxt(space) | (cp == 124))
        self.separators = n(separators)
        colon = (cp == 58) & (nxt(space) | nxt(b.among("\n\r")) | (np.append(b.first[1:], True)))
        self.colon = n(colon) > 0
        ca = np.flatnonzero(colon)
        cb = np.append(0, np.cumsum(colon))
        colon_at = ca[np.minimum(cb[start], max(len(ca) - 1, 0))] if len(ca) else start
        wb = np.append(0, np.cumsum(wstart[:-1]))
        self.label_words = np.where(self.colon, wb[np.maximum(colon_at, start)] - wb[start], 99)
        clock = (cp == 58) & prev(b.cls == NUMBER) & nxt(b.cls == NUMBER)
        opening = np.minimum(first_at + 22, end) if len(start) else start
        cl = np.append(0, np.cumsum(clock))
        self.stamped = ((b.cls[first_at] == NUMBER) | (cp[first_at] == 91)) & (cl[opening] > cl[first_at]) if len(start) else np.zeros(0, bool)
        self.words_per_part = self.words / (self.separators + 1)


def _menu_share(text: TextBatch, words) -> np.ndarray:
    """Share of the words with letters of each text that belong to phrases of site menus."""
    n = len(words.start)
    if not n:
        return np.zeros(text.n)
    mark = np.zeros(n + 4, np.int64)
    for size in (1, 2, 3):
        at = np.arange(max(n - size + 1, 0))
        at = at[words.doc[at + size - 1] == words.doc[at]]
        at = at[within(_phrase_hashes(words, at, at + size), menu_hashes())]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
    alpha = TextBatch.sum_in(text.cls == LETTER, words.start, words.end) > 0
    hit = (np.cumsum(mark)[:n] > 0) & alpha
    return np.bincount(words.doc, hit, text.n) / np.maximum(np.bincount(words.doc, alpha, text.n), 1)


def _distinct_runs(words, n: int, size: int, of: np.ndarray) -> np.ndarray:
    """Share of distinct runs among all runs of so many words, in the texts marked by ``of``; 1 for the others."""
    out = np.ones(n)
    at = np.arange(max(len(words.doc) - size + 1, 0))
    at = at[(words.doc[at + size - 1] == words.doc[at]) & of[words.doc[at]]]
    if len(at):
        doc, value = words.doc[at].astype(np.int64), np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                value = mix(value) + words.hash[at + k]
        _, first = np.unique(mix(value) ^ mix(doc.astype(np.uint64)), return_index=True)
        all_ = np.bincount(doc, minlength=n)
        out = np.where(all_ > 0, np.bincount(doc[first], minlength=n) / np.maximum(all_, 1), 1.0)
    return out


@functools.lru_cache(1)
def _vowel_of() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[_codes("aeiouy")] = True
    return table


def kind_of(fails: np.ndarray) -> np.ndarray:
    """Kind of each text from the rules it fails (texts x RULES): prose if it fails no published rule or no measure of
    a kind, else junk if it fails a measure of junk, else table or list."""
    n = len(PUBLISHED)
    suspect = fails[:, :n].any(1)
    junk, table, list_ = fails[:, n:-2].any(1), fails[:, -2], fails[:, -1]
    return np.where(suspect & junk, "junk", np.where(suspect & table, "table", np.where(suspect & list_, "list", "prose"))).astype(object)


def statistics(text: TextBatch) -> dict[str, np.ndarray]:
    """All statistics and the kind of each text of a batch."""
    n, lines = text.n, Lines(text)
    words = lines.text_words
    by = lambda values, doc=lines.doc: np.bincount(doc, values, n)
    ratio = lambda a, b: a / np.maximum(b, 1)
    n_words, n_lines = np.bincount(words.doc, minlength=n), np.bincount(lines.doc, minlength=n)
    ink, letters, digits = by(lines.ink), by(lines.letters), by(lines.digits)
    symbols = text.count(text.cls == OTHER)
    plain = text.count(text.among("|.,;:!?'\"“”’«»()-–—…¿¡"))
    # Unbroken stretches of more than 60 signs with few words in them.
    solid_start, solid_end = text.runs((text.cls != SPACE) & (text.cls != IGNORED))
    word_start = np.zeros(len(text.cp) + 1, bool)
    word_start[words.start] = True
    long_ = solid_end - solid_start > 60
    solid_start, solid_end = solid_start[long_], solid_end[long_]
    dense = solid_end - solid_start > 12 * text.sum_in(word_start[:-1], solid_start, solid_end)
    blob = np.bincount(text.doc[solid_start[dense]], (solid_end - solid_start)[dense], n) if dense.any() else np.zeros(n)
    length = ratio(np.bincount(words.doc, words.length, n), n_words)
    common = ratio(by(lines.common), n_words)

    distinct = _distinct_runs(words, n, 3, np.ones(n, bool))
    fives = _distinct_runs(words, n, 5, distinct < 0.9)  # other texts cannot fail that rule

    # Words of four letters or more in which vowels are rare.
    vowel = _vowel_of()[text.fold] & (text.cls == LETTER)
    latin = (text.fold >= 97) & (text.fold <= 122) & (text.cls == LETTER)
    vowels, latins = text.sum_in(vowel, words.start, words.end), text.sum_in(latin, words.start, words.end)
    hard = (latins >= 4) & (latins == words.length) & (vowels * 6 < latins)
    hard_share = ratio(np.bincount(words.doc, hard * words.length, n), np.bincount(words.doc, words.length, n))

    # Kinds of lines. Spoken: common words or an ended sentence of some length.
    w = lines.words
    spoken = ((w >= 4) & (lines.common > 0) & (lines.common * 12 >= w)) | (lines.ended & (w >= 4)) | (lines.ended & (lines.common > 0) & (w >= 2))
    spoken |= (lines.sentences > 0) & (w >= 4)
    # Rows of cells come at least three to a text; one line of parts is a list in a row.
    quiet = (lines.sentences == 0) & (lines.common * 3 <= w) & ~(lines.ended & (w >= 6))
    split = (lines.pipes >= 2) | (lines.tight >= 2) | (lines.semicolons >= 2)
    spaced = ((lines.tabs >= 1) | (lines.gaps >= 1)) & (w <= 20) & (lines.common * 6 <= w)
    row = (split | spaced) & quiet
    row &= by(row * 1.0)[lines.doc] >= 3
    record = lines.colon & (lines.label_words <= 3) & (w - lines.label_words <= 4) & ~(lines.ended & (w > 5))
    in_a_row = ~row & (lines.separators >= 4) & (lines.words_per_part <= 3) & (lines.common * 8 <= w) & (lines.sentences == 0)
    entry = ((lines.bullet | lines.numbered | lines.link) & ~(lines.ended & (w >= 5)) & ~(spoken & (w >= 6))) | lines.leader | in_a_row
    short = (w <= 6) & ~lines.ended & ~((lines.common > 0) & (w >= 4))
    table_line = row | record & ~entry
    list_line = ~table_line & (entry | short & ~spoken)
    weight = lines.ink.astype(np.float64)
    # A text whose short lines go on into each other is prose in an odd layout.
    breaks = by((short & ~entry & ~table_line) * 1.0)
    broken = short & ~entry & ~table_line
    spoken_breaks = ratio(by(lines.common * broken), by(w * broken))
    flowing = (common >= 0.07) & (spoken_breaks >= 0.04) & (breaks * 2 > n_lines) & (by(lines.ended * 1.0) + by((w > 6) * 1.0) > 0)
    loose = flowing[lines.doc] & ~entry & ~record & (lines.pipes < 2)
    table_line, list_line = table_line & ~loose, list_line & ~loose
    table_share, list_share = ratio(by(weight * table_line), ink), ratio(by(weight * list_line), ink)

    stamped = ratio(by(lines.ink * lines.stamped), ink)
    _, kept = np.unique(lines.hash ^ mix(lines.doc.astype(np.uint64)), return_index=True)
    same_lines = 1 - ratio(np.bincount(lines.doc[kept], minlength=n), n_lines)
    short_lines = ratio(by((lines.chars < 30) * 1.0), n_lines)
    symbol_ratio = ratio(symbols - plain, ink)
    bullets = ratio(by((lines.bullet | lines.numbered) * 1.0), n_lines)
    ended = ratio(by(lines.ended * 1.0), n_lines)
    alphabetic = ratio(np.bincount(words.doc, text.sum_in(text.cls == LETTER, words.start, words.end) > 0, n), n_words)
    hashes_ = text.count(text.among("#…")) + text.count((text.cp == 46) & np.append(text.cp[1:] == 46, False) & np.append(text.cp[2:] == 46, [False, False])[: len(text.cp)])
    share = table_share + list_share
    failed = {
        "few_words": n_words < 5,
        "mean_word_length": (length < 3) | (length > 10),
        "symbols": hashes_ > 0.1 * n_words,
        "bullets": bullets > 0.9,
        "ellipses": ratio(by(lines.ellipsis * 1.0), n_lines) > 0.3,
        "few_alphabetic_words": alphabetic < 0.8,
        "few_common_words": by(lines.common) < 2,
        "duplicate_lines": same_lines > 0.3,
        "duplicate_ngrams": fives < 0.85,
        "dropped_lines": by(lines.ink * ~lines.ended) > LEAST * ink,
        "unended_lines": ended <= 0.12,
        "short_lines": short_lines >= 0.67,
        "repeated_words": (n_words >= 12) & (distinct < 0.5),
        "encoded_data": blob > LEAST * ink,
        "mostly_symbols": symbol_ratio > 0.45,
        "unreadable_words": hard_share > 0.4,
        "log_lines": ratio(by(lines.ink * lines.stamped), ink) > LEAST,
        "menu_phrases": (_menu_share(text, words) >= LEAST) & (n_words > 3),
        "no_letters": (letters == 0) & (ink > 0) & (table_share < LEAST),
        "table_lines": (share > LEAST) & (table_share >= list_share),
        "list_lines": (share > LEAST) & (table_share < list_share),
    }
    fails = np.stack([failed[k] & (ink > 0) for k in RULES], 1)
    kind = kind_of(fails)
    kind[ink == 0] = ""

    return {
        "n_chars": np.diff(text.starts), "n_words": n_words, "n_lines": n_lines, "mean_word_length": length, "symbol_ratio": symbol_ratio,
        "digit_ratio": ratio(digits, ink), "ended_line_share": ended, "bullet_line_share": bullets, "common_word_share": common,
        "distinct_triple_share": distinct, "short_line_share": short_lines, "duplicate_line_share": same_lines, "prose_share": np.where(ink > 0, 1 - table_share - list_share, 0.0), "list_share": list_share,
        "table_share": table_share, "kind": kind, "failures": fails,
    }


def text_statistics(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Statistics of each text, the rules of ``RULES`` it fails, and its ``kind``: prose, list, table or junk.

    The kind is a function of the failed rules alone (``kind_of``), so ``failures`` has the reasons of every kind.

    Null, empty and blank texts have zero counts, a null kind and no failures. Each row is measured on its own and
    whole; there is no shuffle. Other columns are ignored. Repeated rows give repeated results.
    """
    rows = df.select(id_column, text)
    schema = StructType([rows.schema[0], *StructType.fromDDL(SCHEMA).fields])
    arrow = to_arrow_schema(schema)
    names = list(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            out = statistics(texts)
            flags = out.pop("failures")
            kind = pa.array(out.pop("kind").tolist())
            kind = pc.if_else(pc.equal(kind, ""), None, kind)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(flags.sum(1))), pa.int32()), pa.array(names).take(pa.array(np.nonzero(flags)[1])))
            columns = [part.column(0), *map(pa.array, out.values()), kind, lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)
