"""Language of texts and of their segments by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its
letters, each permuted by its place; a text's vector bundles (adds) those of its n-grams, and so does a
language's prototype. A text has the language whose prototype has the largest cosine with it.

Bundling is linear, so a text's product with a prototype is the sum of its n-grams' products with it, which
are computed once for all n-grams over the alphabet. Vectors of different n-grams are all but orthogonal, so
the length of a text's vector is the root of its n-grams' squared counts. Both give the cosine of a text, a
part or a segment of any length without forming its vector.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.llm.textbatch import IGNORED, LETTER, MARK, SPACE, TextBatch, slices
from loomline.session import bounded_sample

DIMENSION = 8192
#: Shares of the frequent words, the clean samples and the labelled rows in the prototypes.
EVIDENCE = (0.3, 0.3, 0.4)
#: Labelled rows that take part in fitting, at most; all rows are scored.
LABELLED_ROWS = 4000
#: Shortest and longest text among them, in characters.
LABELLED_CHARS = (40, 20_000)
LETTERS = 27  # a to z, and 0 for what lies between words
GRAM = 3

#: Frequent words of each language, for the prototypes beside the labelled samples.
FREQUENT_WORDS = {
    "tr": "ve bir bu da de için ile çok daha olarak gibi kadar sonra önce her ne ama en var yok olan oldu değil ben sen biz siz onlar şu ki mi mı evet hayır gün yıl saat zaman yer iyi büyük küçük yeni eski ilk son bin yüz iki üç dört beş altı yedi sekiz dokuz on kırk pazartesi salı çarşamba perşembe cuma cumartesi pazar günü kuzey güney doğu batı kapısı lütfen nasıl neden nerede kim hangi olduğu tarafından göre üzere ancak fakat veya hem bunun onun şey diye arasında üzerinde içinde",
    "en": "the of and to in is that it was for on are with as his they be at one have this from or had by not but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could people my than first been who its now find long down day did get come made may part yes monday tuesday wednesday thursday friday saturday sunday north south east west gate forty please why where because",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ja nein ich wir ihr kein keine wenn dann hier jetzt immer zwei drei vier fünf zwanzig vierzig montag dienstag mittwoch donnerstag freitag samstag sonntag norden süden osten westen bitte warum wo wer welche",
    "fr": "le la les de des du et un une est en que qui dans pour pas au sur se ne ce il elle par plus avec tout faire son sa ses mais comme on ou si leur y dit nous vous ils elles bien être cette ces aux même aussi après avant très sans sous entre peut deux trois quatre cinq vingt quarante lundi mardi mercredi jeudi vendredi samedi dimanche nord sud est ouest porte oui non pourquoi où quel quelle je tu moi toi fait temps jour",
    "es": "el la los las de que y en un una es por con no para se su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho dos tres cuatro cinco veinte cuarenta lunes martes miércoles jueves viernes sábado domingo norte sur este oeste puerta aquí cómo",
}


@functools.lru_cache(1)
def _letter_of() -> np.ndarray:
    """Letter number by folded code point; 0 for everything else."""
    table = np.zeros(0x110000, np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(20240229).choice(np.array([-1.0, 1.0], np.float32), (LETTERS, DIMENSION))


def _gram_vectors(gram: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams: the product of their letters' vectors, each rotated by its place."""
    v = _letter_vectors()
    out = np.ones((len(gram), DIMENSION), np.float32)
    for place in range(GRAM):
        out *= np.roll(v, place, 1)[gram // LETTERS**place % LETTERS]
    return out


class Grams:
    """Letter n-grams of a batch: whatever is no letter separates words and counts once."""

    def __init__(self, text: TextBatch, skip: np.ndarray | None = None):
        ignore = (text.cls == MARK) | (text.cls == IGNORED)
        letter = _letter_of()[text.fold]
        letter[text.cls != LETTER] = 0
        if skip is not None:
            letter[skip] = 0
        use = ~ignore
        gap = use & (letter == 0)
        before = np.zeros(len(use), bool)
        before[1:] = gap[:-1]
        self.at = np.flatnonzero((letter > 0) | gap & (~before | text.first))  # code points that count
        x = letter[self.at].astype(np.int64)
        self.letter = x
        pad = np.concatenate([[0] * (GRAM - 1), x])
        number = np.zeros(len(x), np.int64)
        for k in range(GRAM):
            number = number * LETTERS + pad[k : k + len(x)]
        first = np.flatnonzero(text.first[self.at]) if len(self.at) else np.zeros(0, np.int64)
        fresh = np.ones(len(x), bool)
        for k in range(GRAM - 1):  # n-grams do not reach from one text into the next
            fresh[np.minimum(first + k, len(x) - 1)] = False
        self.gram, self.valid = number, fresh & (x + (number // LETTERS) % LETTERS > 0)


class Profiles:
    """Prototypes of languages, and the products of every n-gram's vector with them."""

    def __init__(self, languages: list[str], products: np.ndarray):
        self.languages, self.products = languages, products

    @classmethod
    def fit(cls, samples: Iterable[tuple[str, str]], labelled: Iterable[tuple[str, str]] = ()) -> Profiles:
        """From (language, text) pairs: clean samples, the frequent words, and rows with labels, which may be wrong.

        An n-gram enters a language's bundle with the logarithm of how much more frequent it is there than
        on average; each kind of evidence has its share of the frequencies.
        """
        kinds = [{k: [v] for k, v in FREQUENT_WORDS.items()}, {}, {}]
        for texts, pairs in zip(kinds[1:], (samples, labelled)):
            for lang, text in pairs:
                texts.setdefault(lang, []).append(text)
        languages = sorted(kinds[0].keys() | kinds[1].keys())
        frequency = np.zeros((len(languages), LETTERS**GRAM))
        for texts, share in zip(kinds, EVIDENCE):
            for k, lang in enumerate(languages):
                if lang in texts:
                    g = Grams(TextBatch(pa.array(texts[lang])))
                    count = np.bincount(g.gram[g.valid], minlength=LETTERS**GRAM)
                    frequency[k] += share * count / max(count.sum(), 1)
        frequency /= np.maximum(frequency.sum(1, keepdims=True), 1e-9)
        weight = np.log((frequency + 1e-4) / (frequency.mean(0) + 1e-4)).astype(np.float32)
        common = np.log1p(frequency.mean(0) / 1e-4).astype(np.float32)
        bundles = np.zeros((len(languages) + 1, DIMENSION), np.float32)
        for part in np.array_split(np.arange(LETTERS**GRAM), 32):
            vectors = _gram_vectors(part)
            bundles[:-1] += weight[:, part] @ vectors
            bundles[-1] += common[part] @ vectors
        bundles /= np.linalg.norm(bundles, axis=1, keepdims=True)
        prototypes = bundles[:-1]
        centred = prototypes - prototypes.mean(0)
        centred /= np.linalg.norm(centred, axis=1, keepdims=True)
        both = np.concatenate([centred, bundles[-1:]])
        every = np.arange(LETTERS**GRAM)
        products = [_gram_vectors(part) @ both.T for part in np.array_split(every, 32)]
        return cls(languages, (np.concatenate(products) / np.sqrt(DIMENSION)).astype(np.float32))

    def score(self, text: TextBatch) -> Segments:
        return Segments(self, text)


#: Letters of running text that a chunk aims at; chunks also end where sentences, lines and quotations do.
CHUNK_LETTERS = 32
#: Products that a change of language must gain: where a sentence or line ends, and elsewhere.
CHANGE_AT_END, CHANGE_INSIDE = 0.7, 2.5
#: Quotation marks.
QUOTES = '"“”„«»'
#: Signs that end a sentence or clause.
ENDS = ".!?…;:\n|•"


class Segments:
    """Chunks of the running text of each row, each with its language."""

    def __init__(self, profiles: Profiles, text: TextBatch):
        self.text, self.profiles = text, profiles
        quoted = self._quoted(text)
        grams = Grams(text, quoted)
        values = profiles.products[grams.gram]
        values[~grams.valid] = 0
        n_lang = len(profiles.languages)
        letters = np.append(0, np.cumsum(grams.letter > 0))
        # Chunks: cut at sentence ends, and at the first word gap after each CHUNK_LETTERS letters.
        cut = np.zeros(len(grams.at) + 1, bool)
        doc = text.doc[grams.at] if len(grams.at) else np.zeros(0, np.int32)
        edge = text.among(ENDS + QUOTES) | text.first
        edges = np.append(0, np.cumsum(edge))
        at_end = np.zeros(len(grams.at) + 1, bool)
        if len(grams.at):
            word = np.flatnonzero((grams.letter > 0) & np.append(True, grams.letter[:-1] == 0))
            if len(word):
                ended = np.append(True, edges[grams.at[word[1:]] + 1] > edges[grams.at[word[:-1]] + 1])
                run = np.maximum.accumulate(np.where(ended, letters[word], 0))
                part = (letters[word] - run) // CHUNK_LETTERS
                cut[word[ended | np.append(True, part[1:] != part[:-1])]] = True
                at_end[word[ended]] = True
        self.begin = np.flatnonzero(cut[:-1])
        stop = np.append(self.begin[1:], len(grams.at))
        self.doc = doc[self.begin]
        self.start = grams.at[self.begin]
        self.letters = letters[stop] - letters[self.begin]
        self.grams = TextBatch.sum_in(grams.valid, self.begin, stop)
        both = np.add.reduceat(values, self.begin, axis=0) if len(self.begin) else np.zeros((0, n_lang + 1))
        self.scores, self.generic = both[:, :n_lang], both[:, n_lang]
        self.soft = at_end[self.begin]
        self.language = self._best_path()
        chunk = np.repeat(np.arange(len(self.begin)), stop - self.begin)
        first = int(self.begin[0]) if len(self.begin) else len(grams.at)
        use = grams.valid[first:]
        self.gram, self.gram_chunk = grams.gram[first:][use], chunk[use]

    def norms(self, part: np.ndarray, n: int) -> np.ndarray:
        """Length of the bundle of each of n parts, given the part of every chunk (negative: of none)."""
        part = part[self.gram_chunk]
        use = part >= 0
        key, count = np.unique(part[use].astype(np.int64) * LETTERS**GRAM + self.gram[use], return_counts=True)
        return np.sqrt(np.bincount(key // LETTERS**GRAM, count.astype(np.float64) ** 2, n))

    @staticmethod
    def _quoted(text: TextBatch) -> np.ndarray:
        """Code points of quotations of one sentence: between two quotation marks of a text, the marks taken in pairs,
        with no sentence after another in them. They are no running text, unless they hold most of its letters."""
        marks = np.flatnonzero(text.among(QUOTES))
        out = np.zeros(len(text.cp) + 1, np.int64)
        if len(marks):
            doc = text.doc[marks]
            place = np.arange(len(marks)) - np.searchsorted(doc, doc)
            opens = np.flatnonzero((place % 2 == 0) & np.append(doc[1:] == doc[:-1], False))
            a, b = marks[opens], marks[opens + 1]
            stop = text.among(".!?…\n")
            stop[:-1] &= (text.cls[1:] == SPACE) | (text.cp[:-1] == 10)
            stops = np.append(0, np.cumsum(stop))
            last = np.maximum(b - 2, a)  # the sign that ends the quoted sentence is no break
            short = stops[last] == stops[a]
            np.add.at(out, a[short], 1)
            np.add.at(out, b[short], -1)
        inside = np.cumsum(out[:-1]) > 0
        letter = text.cls == LETTER
        most = text.count(inside & letter) * 2 > text.count(letter)
        return inside & ~most[text.doc]

    def _best_path(self) -> np.ndarray:
        """Language of each chunk on its text's best path, all texts at once, one chunk of each at a time."""
        n, k = self.scores.shape
        out = np.zeros(n, np.int64)
        if not n:
            return out
        docs, first, size = np.unique(self.doc, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        back = np.zeros((n, k), np.int8)
        best = self.scores[first].copy()
        for step in range(1, size[0]):
            live = int(np.searchsorted(-size, -step, "left"))
            at = first[:live] + step
            prior = best[:live]
            top = prior.argmax(1)
            jump = prior[np.arange(live), top] - np.where(self.soft[at], CHANGE_AT_END, CHANGE_INSIDE)
            stay = prior >= jump[:, None]
            back[at] = np.where(stay, np.arange(k), top[:, None])
            best[:live] = np.where(stay, prior, jump[:, None]) + self.scores[at]
        state = best.argmax(1)
        for step in range(size[0] - 1, -1, -1):
            live = int(np.searchsorted(-size, -step, "left"))
            at = first[:live] + step
            out[at] = state[:live]
            if step:
                state[:live] = back[at, state[:live]]
        return out


#: Least cosine that a text's main language has with its part of the text, for the text to have words of a language
#: at all; or, for short texts, a lower one that makes up a sum with the cosine with what all languages share. Logs,
#: encoded data and other noise stay below both at every length.
LEAST_COSINE, LEAST_OWN, LEAST_SUM = 0.12, 0.04, 0.185
#: By how much the cosines must favour another language over the row's label, and over the main language
#: of a mixed row for each of its other languages.
AGAINST_LABEL, FOR_PART = 0.05, 0.12
#: Logarithm of the odds that the best language is right, by how much its cosine exceeds the next best: measured
#: on held-out labelled texts and pieces of them.
ODDS_SLOPE = 69.0


def _sure(margin: np.ndarray) -> np.ndarray:
    """Probability that a language is right whose cosine exceeds all others by the margin."""
    return 1 / (1 + np.exp(-ODDS_SLOPE * np.maximum(margin, 0)))


def _margin(cosines: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By how much the cosine of one language of each row exceeds the best of the others."""
    rows = np.arange(len(cosines))
    others = cosines.copy()
    others[rows, at] = -np.inf
    return cosines[rows, at] - others.max(1) if len(cosines) else np.zeros(0)


def _rows_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index."""
    return np.stack([np.bincount(index, rows[:, c], n) for c in range(rows.shape[1])], 1)


def _detector(profiles, schema: pa.Schema, keep: Sequence[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles.value
        names = pa.array(p.languages)
        for part, texts in slices(batches, text):
            s = p.score(texts)
            n, k = texts.n, len(p.languages)
            cell = s.doc.astype(np.int64) * k + s.language
            letters = np.bincount(cell, s.letters, n * k).reshape(n, k)
            norm_of_text = np.maximum(s.norms(s.doc, n), 1e-9)
            cosines = _rows_by(s.doc, s.scores, n) / norm_of_text[:, None]
            # Products of each part, the chunks of one language, with its own language and with the main one.
            main = letters.argmax(1)
            norm = np.maximum(s.norms(cell, n * k), 1e-9)
            chunk = np.arange(len(s.doc))
            own = np.bincount(cell, s.scores[chunk, s.language], n * k) / norm if len(chunk) else np.zeros(n * k)
            rival = np.bincount(cell, s.scores[chunk, main[s.doc]], n * k) / norm if len(chunk) else np.zeros(n * k)
            own, gain = own.reshape(n, k), (own - rival).reshape(n, k)
            common = np.bincount(s.doc, s.generic, n) / norm_of_text
            own_main = own[np.arange(n), main]
            real = (own_main >= LEAST_COSINE) | (own_main >= LEAST_OWN) & (own_main + common >= LEAST_SUM)
            # A language is part of a mixed text if it has enough of the letters and of the evidence there.
            total = letters.sum(1, keepdims=True)
            has = (letters * 6 >= total) & (gain >= FOR_PART) & real[:, None] & (total > 0)
            has[np.arange(n), main] |= real
            mixed = has.sum(1) > 1
            alone = np.flatnonzero(real & ~mixed)  # one language: the best over the whole text
            has[alone] = False
            has[alone, cosines.argmax(1)[alone]] = True
            doc, lang = np.nonzero(has)
            share = letters[doc, lang] / np.maximum(total[doc, 0], 1)
            sure = _sure(np.where(mixed[doc], np.where(lang == main[doc], own[doc, lang], gain[doc, lang]), _margin(cosines[doc], lang)))
            at = pa.array(np.append(0, np.cumsum(has.sum(1))), pa.int32())
            found = pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(share), pa.array(sure)], ["lang", "share", "confidence"])
            # Neighbouring chunks of one language are one segment.
            new = np.append(True, (s.doc[1:] != s.doc[:-1]) | (s.language[1:] != s.language[:-1])) if len(s.doc) else np.zeros(0, bool)
            new &= real[s.doc]
            b = np.flatnonzero(new)
            live = real[s.doc]
            group = np.cumsum(new) - 1
            sd = s.doc[b]
            seg = _rows_by(group[live], s.scores[live], len(b)) / np.maximum(s.norms(np.where(live, group, -1), len(b)), 1e-9)[:, None]
            start = s.start[b] - texts.starts[sd]
            last = np.append(sd[1:] != sd[:-1], True) if len(sd) else np.zeros(0, bool)
            end = np.where(last, np.diff(texts.starts)[sd], np.append(start[1:], 0)) if len(sd) else start
            seg_at = pa.array(np.append(0, np.cumsum(np.bincount(sd, minlength=n))), pa.int32())
            segments = pa.StructArray.from_arrays(
                [pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(s.language[b])), pa.array(_sure(_margin(seg, s.language[b])))],
                ["start", "end", "lang", "confidence"],
            )
            flat = pa.array(np.where(real[:, None], cosines, 0.0).reshape(-1))
            columns = [part.column(c) for c in keep]
            columns += [pa.ListArray.from_arrays(at, found), pa.ListArray.from_arrays(seg_at, segments), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


#: Beginnings and ends of lines of program code.
CODE_LINE = (
    r"(?m)^[ \t]*(?:(?:def|class|func|public|private|static|import|package|return|elif|else:|for \w+(?:, \w+)* in|if \w+.*:$|while \(|switch \(|#include|@\w+$|//|\x22{3}|\w+ :?= ).*"
    r"|(?:break|continue|pass|return|else|try:)|[\w.]+\(.*\)|.*(?:[;{}]|\):|\]\)?,?|\),)[ \t]*)$"
)


#: Where a JSON object begins, and the strings and braces in it.
_JSON = r'\{\s*"'
_JSON_SIGN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.DOTALL)


def without_json_text(text: str) -> str:
    """The text with a line end for each JSON object. An object that is not closed goes to the last closing brace
    after it, and where there is none to the end."""
    out, at = [], 0
    while start := re.compile(_JSON).search(text, at):
        out.append(text[at : start.start()])
        depth, at = 0, 0
        for sign in _JSON_SIGN.finditer(text, start.start()):
            depth += {"{": 1, "}": -1}.get(sign.group(), 0)
            if depth == 0:
                at = sign.end()
                break
        at = at or text.rfind("}", start.start()) + 1 or len(text)
        out.append("\n")
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _without_json(texts: pd.Series) -> pd.Series:
    return texts.map(without_json_text, na_action="ignore")


def without_code(text: Column) -> Column:
    """The text without fenced code, tool calls, JSON values and lines of code. Texts that show none stay untouched."""
    bare = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", "\n")
    bare = F.regexp_replace(bare, r"(?s)<\|tool_call\|>.*?(?:<\|tool_end\|>|\z)", "\n")
    bare = F.coalesce(_without_json(F.when(bare.rlike(_JSON), bare)), bare)  # only texts with such a value go through Python
    bare = F.regexp_replace(bare, CODE_LINE, "")
    return F.when(text.rlike(r"```|<\|tool|[{}]|\);|\):|:= "), bare).otherwise(text)


def fit_profiles(samples: DataFrame, labelled: DataFrame | None = None) -> Profiles:
    """Prototypes from clean ``lang, text`` samples and, if given, at most LABELLED_ROWS of ``id, lang, text``."""
    clean = [(r.lang, r.text) for r in samples.select("lang", "text").dropna().limit(LABELLED_ROWS).collect()]
    rows = []
    if labelled is not None:
        known = sorted({k for k, _ in clean} | FREQUENT_WORDS.keys())
        fits = F.col("lang").isin(known) & F.col("text").isNotNull() & F.length("text").between(*LABELLED_CHARS)
        rows = [(r.lang, r.text) for r in bounded_sample(labelled, "id", LABELLED_ROWS, fits).select("lang", "text").collect()]
    return Profiles.fit(clean, rows)


def detect_languages(df: DataFrame, keep: Sequence[str], text: str, profiles: Profiles) -> DataFrame:
    """The columns ``keep`` and the languages of each text.

    ``languages ARRAY<STRUCT<lang, share, confidence>>``: one entry for a text in one language; one per
    language for running text in several, each with a sixth of the letters or more. ``segments``: stretches
    of the text (code point offsets) with their language and confidence. ``scores``: cosines with each
    prototype, in order of ``profiles.languages``. A confidence is the probability that the language is right,
    by how far its cosine is above the others'.

    Quoted sentences are no running text. Null, empty and blank texts, and texts without words of a
    language, have empty arrays and zero scores. Each row is scored on its own and whole.
    """
    rows = df.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    ddl = f"{fields}, languages array<struct<lang:string,share:double,confidence:double>>, segments array<struct<start:int,end:int,lang:string,confidence:double>>, scores array<double>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # fixed size: products of all n-grams
    return rows.mapInArrow(_detector(shared, schema, list(keep), "__text"), ddl)


def wrong_labels(detected: DataFrame, label: Column, profiles: Profiles) -> DataFrame:
    """Rows of ``detected`` whose label is missing, wrong or too few, one per true language, as ``lang, confidence``.

    A label that names another language than the text's is wrong if the cosines favour the text's
    language clearly; a text in several languages is always listed.
    """
    known = F.array(*map(F.lit, profiles.languages))
    place = F.array_position(known, label)
    best = F.col("languages")[0]["lang"]
    favour = F.array_max("scores") - F.when(place > 0, F.col("scores")[(place - 1).cast("int")])
    wrong = label.isNull() | (place == 0) | ((best != label) & (favour >= AGAINST_LABEL))
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & wrong)
    return detected.where(case).withColumn("found", F.explode("languages"))
