"""Missing or wrong document language labels (problem 4)."""

from __future__ import annotations

import base64
import json
import math
import os
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from skein.llm.sentences import boundaries
from skein.session import spread

LANGS = ("en", "ru", "uk", "de", "es", "pt", "zh", "ja", "hi", "th")
#: Spellings of a label besides the two-letter code (fixed values: ISO 639-2 codes, terminological and bibliographic).
LONG_CODES = {"eng": "en", "rus": "ru", "ukr": "uk", "deu": "de", "ger": "de", "spa": "es", "por": "pt", "zho": "zh", "chi": "zh", "jpn": "ja", "hin": "hi", "tha": "th"}
#: Function words that vote for a language (fixed values); they only weigh the labels of the fitting sample and serve the votes of the prompt-pair checks.
STOPWORDS = {
    "en": "the of and to in is that it was for on are as with they at be this from by not have but or an were which when there their its had what how why did who about into than then only",
    "ru": "и в не на что с как это по из у за от так но же для был было если уже или чем нет когда чтобы при до ещё раз почему где этой были который потому только мы много никто почти",
    "uk": "і в не на що з як це та у за від так але для був було якщо вже або ніж немає коли щоб при до ще раз чому де цій були який бо тільки ми й із та про хто ніхто майже",
    "de": "der die das und ist in zu den mit von nicht ein eine dem des auf für im sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man wurde weil warum ob wo wenn ohne",
    "es": "el la de que y en un una los las se del por con no es para al lo como más su pero sus le ya este sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos qué cómo hacia hace fue aunque nadie según antes ese esa",
    "pt": "o a os as de que e em um uma do da dos das no na nos nas se por com não é para ao como mais seu mas já porque esta entre quando muito sem sobre também até há onde quem desde tudo nos qual foi embora ninguém segundo antes pelo pela são à às isso você",
    "hi": "के का की है में और से को पर यह कि हैं ने एक नहीं भी हो था थी वह इस अब क्या हम लिए साथ सब कुछ कोई",
    "zh": "的 了 是 在 我 们 这 那 他 把 和 就 也 不 没 有 为 什么 因 说 只 能 里 被",
    "ja": "の は を に が と で た て も な だ る い か ら れ し こ",
    "th": "ที่ และ ใน ของ ไม่ เป็น ได้ มี ว่า ไว้ เรา ให้ จะ การ จาก ไป",
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _l in LANGS:
    for _w in STOPWORDS[_l].split():
        _VOTES[_w] = (*_VOTES.get(_w, ()), _l)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[ऀ-ॿ]+|[฀-๿]+")


def script_of(ch: str) -> str:
    """latin, cyrillic, deva, thai, kana, han or other."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x900 <= o < 0x980:
        return "deva"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0x3100 or 0xFF66 <= o < 0xFFA0:
        return "kana"
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x40000:
        return "han"
    return "other"


#: The languages each script can write.
WRITES = {"latin": ("en", "de", "es", "pt"), "cyrillic": ("ru", "uk"), "deva": ("hi",), "thai": ("th",), "kana": ("ja",), "han": ("zh", "ja"), "other": LANGS}
_RUNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)|([Ѐ-ԯ]+)|([ऀ-ॿ]+)|([฀-๿]+)|([぀-ヿｦ-ﾟ]+)|([㐀-鿿豈-﫿]+)")


_ANY_RUN = re.compile("[a-zß-öø-ɏ]+|[Ѐ-ԯ]+|[ऀ-ॿ]+|[฀-๿]+|[぀-ヿｦ-ﾟ]+|[㐀-鿿豈-﫿]+")


def script_counts(text: str) -> dict[str, int]:
    """Letters by script."""
    out = dict.fromkeys(("latin", "cyrillic", "deva", "thai", "kana", "han"), 0)
    names = tuple(out)
    for m in _RUNS.finditer(text):
        out[names[m.lastindex - 1]] += m.end() - m.start()
    return out


def stopword_votes(text: str) -> dict[str, float]:
    """Votes per language: its function words among the words, a word of several languages counting for each in part."""
    votes = dict.fromkeys(LANGS, 0.0)
    for w in _WORD.findall(text.lower()):
        for lang in _VOTES.get(w, ()):
            votes[lang] += 1.0 / len(_VOTES[w])
    n = script_counts(text)
    if n["deva"]:
        votes["hi"] += n["deva"] / 4
    if n["thai"]:
        votes["th"] += n["thai"] / 6
    if n["kana"] * 8 >= n["han"] and n["kana"]:
        votes["ja"] += (n["kana"] + n["han"]) / 3
    elif n["han"]:
        votes["zh"] += n["han"] / 2
    if n["cyrillic"]:
        low = text.lower()
        votes["uk"] += sum(map(low.count, "іїєґ"))
        votes["ru"] += sum(map(low.count, "ыэъё"))
    return votes


def vote(text: str, least: float = 1.5, lead: float = 1.4) -> str | None:
    """The language with the most votes if it has enough and leads clearly, else None."""
    (a, x), (_, y) = sorted(stopword_votes(text).items(), key=lambda p: -p[1])[:2]
    return a if x >= least and x >= lead * y else None


def normalise_label(label: Column) -> Column:
    """Two-letter code of a label whatever its letter case, region suffix or code length; null if missing (null, blank, und) or unknown."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    expr = base
    for long, short in LONG_CODES.items():
        expr = F.when(base == long, F.lit(short)).otherwise(expr)
    return F.when(expr.isin(*LANGS), expr)


# ---- the vocabulary and the unigram models -------------------------------------------------------------


def vocabulary_file(path: str | None = None) -> str:
    """Path of the vocabulary of a public tokenizer: the parameter, else SKEIN_VOCAB, else the usual folder."""
    return path or os.environ.get("SKEIN_VOCAB") or "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def load_pieces(path: str) -> set[str]:
    """Pieces of a vocabulary file (tiktoken ranks or a tokenizers JSON) that are whole lower-case text, without the mark of a word start."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            raw = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        words = (b.decode("utf-8", "ignore") for b in raw if b)
    else:
        with open(path, encoding="utf-8") as f:
            words = (w.replace("</w>", "") for w in json.load(f)["model"]["vocab"])
    return {p for w in words if (p := w.strip().lower()) and all(c.isalpha() or c in "'’" or "ऀ" <= c <= "๿" for c in p)}


class UnigramModels:
    """Per-language piece probabilities; score(word) sums the probability of every segmentation of the word."""

    KNOWN = 200_000
    KNOWN_LETTERS = 24  # longer runs hardly come again and aren't remembered
    FLOOR = 1e-7  # of a character outside the pieces seen in a language

    def __init__(self, pieces: dict[str, tuple[float, ...]]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        # beginnings of pieces, None where they are no piece themselves: a walk along a word ends where no piece goes on
        self._walk: dict[str, tuple[float, ...] | None] = {p[:n]: None for p in pieces for n in range(1, len(p))} | pieces
        self._known: dict[tuple[str, ...], dict[str, tuple[float, ...]]] = {}

    def __getstate__(self):
        return self.pieces

    def __setstate__(self, state):
        self.__init__(state)

    def scores(self, words: list[str], langs: tuple[str, ...]) -> list[tuple[float, ...]]:
        """_score of each word; scored words are remembered, at most KNOWN of them."""
        known = self._known.setdefault(langs, {})
        if len(known) > self.KNOWN:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = self._score(w, langs)
                    if len(w) <= self.KNOWN_LETTERS:
                        known[w] = out[i]
        return out

    def _score(self, word: str, langs: tuple[str, ...] = LANGS) -> tuple[float, ...]:
        """Log probability of word in each of langs by the forward algorithm over all its segmentations."""
        n, walk, floor = len(word), self._walk, self.FLOOR
        arcs = []
        for i in range(n):
            own = []
            for j in range(i + 1, n + 1):
                p = walk.get(word[i:j], walk)
                if p is walk:
                    break
                if p is not None:
                    own.append((j, p))
            arcs.append(own)
        out = []
        for li in map(LANGS.index, langs):
            a, log = [1.0] + [0.0] * n, 0.0
            for i, own in enumerate(arcs):  # arcs come by start, so a[i] is complete
                here = a[i]
                if i % 16 == 15:  # keep the numbers in range
                    end = min(n, i + self.longest) + 1
                    a[i:end] = [x / here for x in a[i:end]]
                    log += math.log(here)
                    here = 1.0
                a[i + 1] += here * floor
                for j, p in own:
                    a[j] += here * p[li]
            out.append(math.log(a[n]) + log)
        return tuple(out)

    @classmethod
    def fit(cls, texts: list[tuple[str, str]], vocabulary: set[str], rounds: int = 1, smooth: float = 0.2) -> UnigramModels:
        """From (language, text) rows: expected piece counts over all segmentations (forward-backward), a few rounds.

        Runs of scripts without spaces are fitted in stretches of KNOWN_LETTERS; they are scored whole.
        """
        words: Counter = Counter()
        for lang, text in texts:
            li = LANGS.index(lang)
            for w in pieces_of(text):
                for i in range(0, len(w), cls.KNOWN_LETTERS):
                    words[li, w[i : i + cls.KNOWN_LETTERS]] += 1
        chars = {c for _, w in words for c in w}
        usable = vocabulary | chars
        long = max(map(len, usable), default=1)

        def arcs(w: str) -> list[tuple[int, int, str]]:
            n = len(w)
            return [(i, j, p) for i in range(n) for j in range(i + 1, min(n, i + long) + 1) if (p := w[i:j]) in usable]

        model: dict[tuple[int, str], float] = {}
        for r in range(rounds + 1):
            counts: dict[tuple[int, str], float] = {}
            for (li, w), c in words.items():
                n, own = len(w), arcs(w)
                if r == 0:  # start: every piece occurrence counts by its length
                    for i, j, p in own:
                        counts[li, p] = counts.get((li, p), 0.0) + c * (j - i) / n
                    continue
                f, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
                prob = [model[li, p] for _, _, p in own]
                for (i, j, _), q in zip(own, prob):  # arcs come by start, so f[i] is complete
                    f[j] += f[i] * q
                for (i, j, _), q in zip(reversed(own), reversed(prob)):
                    b[i] += q * b[j]
                if f[n] > 0:
                    for (i, j, p), q in zip(own, prob):
                        counts[li, p] = counts.get((li, p), 0.0) + c * f[i] * q * b[j] / f[n]
            total = [0.0] * len(LANGS)
            for (li, _), v in counts.items():
                total[li] += v
            model = {k: v / total[k[0]] for k, v in counts.items()}
        table: dict[str, list[float]] = {}
        size = max(1, len({p for _, p in model}))
        for (li, p), q in model.items():
            if p not in table:
                table[p] = [smooth / size / (t + smooth) for t in total]
            table[p][li] += q * total[li] / (total[li] + smooth)
        return cls({p: tuple(v) for p, v in table.items()})


def pieces_of(text: str) -> list[str]:
    """Runs of letters that the models score, in lower case: words, and whole runs of scripts without spaces."""
    return _ANY_RUN.findall(text.lower())


#: A term in brackets or quotation marks; longer quotations, or such with sentence marks, are text of their sentence.
_IN = r"[^\s()（）\[\]“”„«»「」『』\".!?。！？।][^()（）\[\]“”„«»「」『』\".!?。！？।\n]{0,39}"
_ASIDE = re.compile(rf"\(\s*[“\"„«「]?{_IN}[”“\"»」]?\s*\)|（{_IN}）|\[{_IN}\]|“{_IN}”|„{_IN}[“”]|«{_IN}»|「{_IN}」|『{_IN}』|\"{_IN}\"")
_QUOTES = re.compile("[(（\\[“„«「『\"]")
_ASCII = re.compile("[a-z]+")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_BEYOND_LATIN = re.compile("[Ѐ-ԯऀ-ॿ฀-๿぀-ヿｦ-ﾟ㐀-鿿豈-﫿]")
_BEYOND_CYRILLIC = re.compile("[A-Za-zÀ-ÖØ-öø-ɏऀ-ॿ฀-๿぀-ヿｦ-ﾟ㐀-鿿豈-﫿]")
#: Words of plain text without a capital: names don't count, and neither does the capitalised first word.
_ASCII_WORD = re.compile("(?<![A-Za-z])[a-z]+")
_NAME = re.compile(r"(?<=[\w,;:—–-] )[A-ZА-ЯІЇЄ][\w'’-]+|[A-Za-z]+(?=[぀-鿿ऀ-๿])|(?<=[぀-鿿ऀ-๿])[A-Za-z]+")


class Identifier:
    """Language and confidence of a sentence, and of a text by its sentences."""

    def __init__(self, models: UnigramModels, least_letters: int = 4, least_confidence: float = 0.8):
        self.models, self.least_letters, self.least_confidence = models, least_letters, least_confidence

    def sentence(self, text: str) -> tuple[str, float] | None:
        """(language, confidence) of one sentence unit; names, and terms in brackets or quotation marks don't count; None without enough letters.

        The script decides which languages can have written it; their unigram models share the confidence, where it is
        one language with the models of all others, to which its letters are unknown.
        """
        core = _ASIDE.sub(" ", text) if _QUOTES.search(text) else text
        if core.isascii():
            words = _ASCII_WORD.findall(core) or _ASCII.findall(core.lower())
            if sum(map(len, words)) < self.least_letters:
                return None
            return self._best(words, WRITES["latin"])
        one = "cyrillic" if not _BEYOND_CYRILLIC.search(core) else "latin" if not _BEYOND_LATIN.search(core) else None
        if one:
            words = pieces_of(_NAME.sub(" ", core)) or pieces_of(core)
            if sum(map(len, words)) >= self.least_letters:
                return self._best(words, WRITES[one])
        counts = script_counts(core)
        if sum(counts.values()) < self.least_letters:
            core = text
            counts = script_counts(core)
            if sum(counts.values()) < self.least_letters:
                return None
        latin = counts.pop("latin")
        other = sum(counts.values())
        if other and latin and (other >= 0.25 * latin or other >= 12):  # Latin letters inside another script are names
            core, latin = _LATIN.sub(" ", core), 0
        if latin:
            allowed = WRITES["latin"]
        else:
            script = max(counts, key=counts.get)
            if script in ("kana", "han"):
                allowed = ("ja",) if counts["kana"] * 10 >= counts["han"] else WRITES["han"]
            else:
                allowed = WRITES[script]
        words = pieces_of(_NAME.sub(" ", core)) or pieces_of(core)
        return self._best(words, allowed) if words else None

    def _best(self, words: list[str], allowed: tuple[str, ...]) -> tuple[str, float]:
        own = [sum(column) for column in zip(*self.models.scores(words, allowed))]
        if len(allowed) == 1:  # the models of other scripts have none of the letters, so each gives them the floor
            own += [sum(map(len, words)) * math.log(self.models.FLOOR)] * (len(LANGS) - 1)
        top = max(own)
        return allowed[min(own.index(top), len(allowed) - 1)], 1.0 / sum([math.exp(max(-700.0, v - top)) for v in own])

    def text(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of each maximal run of sentences in one language.

        A unit without a clear language, or a heading (few letters, no final mark), joins the run before it, at
        the start the run behind it; it names a language only if the text holds nothing else.
        """
        if not text:
            return []
        units, begin = [], 0
        for end in boundaries(text):
            known = self.sentence(text[begin:end])
            weak = known is None or known[1] < self.least_confidence
            units.append((begin, end, known, weak or _is_heading(text[begin:end])))
            begin = end
        if all(weak for *_, weak in units):
            units = [(a, b, known, known is None) for a, b, known, _ in units]
        out: list[list] = []
        lead = None
        for a, b, known, weak in units:
            if weak:
                if out:
                    out[-1][1] = b
                elif lead is None:
                    lead = a
            elif out and out[-1][2] == known[0]:
                out[-1][1] = b
                out[-1][3].append(known[1])
            else:
                out.append([a if lead is None or out else lead, b, known[0], [known[1]]])
        return [(a, b, lang, sum(c) / len(c)) for a, b, lang, c in out]


_FINAL = re.compile(r"[.!?…。！？．｡।॥|:][\"”’»)\]」』“]*\s*\Z")


def _is_heading(unit: str) -> bool:
    """A short unit without a final mark that is no sentence of a script without such marks."""
    unit = unit.strip()
    if _FINAL.search(unit):
        return False
    if any("฀" <= c <= "๿" for c in unit[:40]):
        return len(unit) <= 18
    return len(unit) <= 32 and len(unit.split()) <= 5


# ---- Spark ---------------------------------------------------------------------------------------------


def fit_identifier(labelled: DataFrame, text: str, label: str, key: str, per_label: int = 200, vocabulary: str | None = None) -> Identifier:
    """Fit the models on a bounded sample: at most per_label rows of each label (missing labels are one), taken by hash of key, so at most 11 * per_label rows.

    The label of a row counts for a sentence of it only where the votes of function words and letters agree or the
    script leaves no choice; sentences that the votes give to another language are fitted there. So wrong labels
    don't spoil the models.
    """
    rows = labelled.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.coalesce(normalise_label(F.col(label)), F.lit("?")).alias("l"), F.xxhash64(F.col(key)).alias("h"))
    pick = rows.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= per_label)
    fit: list[tuple[str, str]] = []
    for r in pick.select("t", "l").collect():
        begin = 0
        for end in boundaries(r.t):
            unit = _NAME.sub(" ", _ASIDE.sub(" ", r.t[begin:end]))
            begin = end
            v = stopword_votes(unit)
            best = max(v, key=v.get)
            if v[best] >= 1.5 and v[best] >= 1.25 * max((x for k, x in v.items() if k != best), default=0):
                fit.append((best, unit))
            elif r.l != "?" and v[r.l] > 0 and v[r.l] >= 0.8 * v[best]:
                fit.append((r.l, unit))
    return Identifier(UnigramModels.fit(fit, load_pieces(vocabulary_file(vocabulary))))


def _segment_udf(spark: SparkSession, identifier: Identifier):
    shared = spark.sparkContext.broadcast(identifier)

    def segments(texts: pd.Series) -> pd.Series:
        own = shared.value
        return texts.map(lambda t: [{"start_pos": a, "end_pos": b, "lang": x, "confidence": c} for a, b, x, c in own.text(t)])

    kind = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    return F.pandas_udf(segments, kind)


def language_segments(df: DataFrame, text: str, identifier: Identifier, *keep: str) -> DataFrame:
    """(keep..., start_pos, end_pos, lang, confidence): one row per segment of a text in one language.

    Method: per-language unigram models over the pieces of a fixed public vocabulary; the forward algorithm sums
    all segmentations of a word (each word is scored once per task and remembered); a sentence goes to the best
    model its script allows, with the share of the models as confidence; neighbouring sentences of one language
    are one segment. Null, empty and letterless texts have no segment; a repeated row has its own segments.
    """
    segments = _segment_udf(df.sparkSession, identifier)(F.col(text))
    return df.select(*keep, segments.alias("_segments")).select(*keep, F.explode("_segments").alias("_s")).select(*keep, "_s.*")


def document_languages(df: DataFrame, text: str, identifier: Identifier, *keep: str) -> DataFrame:
    """(keep..., langs, lang, confidence): the set of languages of each row, its main one by length, and the confidence of that; [] and nulls without any."""
    shared = df.sparkSession.sparkContext.broadcast(identifier)

    def languages(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found: dict[str, list[float]] = {}
            for a, b, lang, c in shared.value.text(t):
                part = found.setdefault(lang, [0.0, 0.0])
                part[0] += b - a
                part[1] += c * (b - a)
            main = max(found, key=lambda x: (found[x][0], x), default=None)
            rows.append((sorted(found), main, found[main][1] / found[main][0] if main else None))
        return pd.DataFrame(rows, columns=["langs", "lang", "confidence"])

    kind = T.StructType([T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return spread(df.select(*keep, text)).select(*keep, F.pandas_udf(languages, kind)(F.col(text)).alias("_d")).select(*keep, "_d.*")


def wrong_labels(chunks: DataFrame, vault_config: DataFrame, identifier: Identifier) -> DataFrame:
    """(chunk_id, lang): for each chunk whose languages aren't exactly the label of its vault, one row for each language in it.

    A missing label (null, blank, und, unknown code, or a vault without configuration) makes every chunk a case.
    vault_config is small by nature (one row per vault); it is joined as it is, so the planner broadcasts it only
    while its size allows. Chunks without any language give no row.
    """
    labels = vault_config.groupBy(F.col("vault").alias("_vault")).agg(F.max(normalise_label(F.col("lang"))).alias("_label"))
    found = document_languages(chunks, "text", identifier, "chunk_id", "vault")
    joined = found.join(labels, F.col("vault") == F.col("_vault"), "left")
    case = F.col("_label").isNull() | (F.size("langs") != 1) | (F.col("langs")[0] != F.col("_label"))
    return joined.filter(case).select("chunk_id", F.explode("langs").alias("lang")).distinct()
