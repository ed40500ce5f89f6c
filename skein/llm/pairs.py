"""Broken prompt and response pairs (problem 1)."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from skein.llm.language import script_counts, stopword_votes
from skein.llm.sentences import ALWAYS, BEFORE_NAME, boundaries
from skein.session import spread

DEFECTS = ("empty", "refusal", "copied", "other_language", "truncated")

# Stand-ins for an answer (fixed values), compared after trimming marks and case.
STAND_IN_PHRASES = {"none", "null", "nil", "nan", "n/a", "na", "n.a", "tbd", "tba", "todo", "no answer", "no response", "empty", "undefined", "answer", "response", "output", "keine antwort", "нет ответа", "немає відповіді", "sin respuesta", "sem resposta", "无", "無", "回答なし", "なし", "ответ", "antwort", "respuesta", "resposta", "відповідь", "回答", "答案", "उत्तर", "คำตอบ", "-"}

# Phrases by which an answer declines or says that the context can't answer (fixed values, lower case, straight quotes).
REFUSALS = [
    "can't help with", "cannot help with", "can not help with", "unable to help with", "can't assist", "cannot assist", "unable to assist", "i'm unable to", "i am unable to", "i am not able to", "i'm not able to",
    "i cannot answer", "i can't answer", "i can not answer", "cannot be answered", "can't be answered", "can't answer that", "cannot answer that", "cannot answer this", "can't answer this", "won't be able to", "i cannot share", "i can't share", "i cannot provide", "i can't provide", "i cannot discuss", "i can't discuss", "i cannot comply", "i can't comply", "i must decline", "i have to decline", "i won't answer", "i will not answer",
    "i'd rather not", "i would rather not", "i prefer not to", "beyond what i am able", "beyond what i'm able", "outside what i am able", "not something i can", "i'm not allowed", "i am not allowed", "i am not permitted", "i'm not permitted",
    "as a language model", "as an ai", "as a large language model", "i'm just an ai", "i am just an ai", "i do not have access to", "i don't have access to", "i don't have enough information", "i do not have enough information",
    "no answer can be given", "does not contain enough information", "doesn't contain enough information", "do not contain enough information", "don't contain enough information", "does not contain the answer", "doesn't contain the answer", "context does not provide", "context doesn't provide", "not enough context", "not enough information to answer", "insufficient context", "insufficient information", "context is insufficient", "passages don't mention", "passages do not mention", "context does not mention", "context doesn't mention", "cannot be determined from the", "can't be determined from the", "the given context does not", "the given context doesn't", "the given context can't", "the given context cannot", "based on the provided context, i can't", "based on the provided context, i cannot", "not mentioned in the provided", "not found in the provided",
    "не могу ответить", "не могу помочь", "не могу обсуждать", "не могу поделиться", "не могу комментировать", "не вправе обсуждать", "я не вправе", "как языковая модель", "не имею доступа", "недостаточно данных для ответа", "недостаточно информации", "контексте нет", "контексте недостаточно", "нет ответа на этот вопрос", "не в состоянии ответить",
    "не можу відповісти", "не можу допомогти", "як мовна модель", "не маю доступу", "контексту недостатньо", "недостатньо інформації", "недостатньо даних", "не маю права обговорювати", "не маю змоги відповісти",
    "kann ich nicht beantworten", "kann ich leider nicht", "nicht beantworten", "kann dabei nicht helfen", "kann ich nicht helfen", "als sprachmodell", "als ki-modell", "keinen zugriff auf", "reicht für eine antwort", "kontext reicht", "nicht genügend informationen", "nicht genug informationen", "darf ich nicht beantworten", "darf ich nicht besprechen", "darf ich nicht teilen", "möchte ich nicht spekulieren",
    "no puedo responder", "no puedo ayudar", "como modelo de lenguaje", "no tengo acceso", "no contiene información suficiente", "información insuficiente", "contexto insuficiente", "no hay suficiente información", "no puedo compartir", "no me es posible responder",
    "não posso responder", "não posso ajudar", "como modelo de linguagem", "não tenho acesso", "não chega para responder", "não é suficiente para responder", "não contém informação suficiente", "não contém informações suficientes", "informação insuficiente", "contexto insuficiente", "não consigo responder",
    "无法回答", "不能回答", "作为一个语言模型", "作为语言模型", "作为一个ai", "作为ai", "不足以回答", "没有足够的信息", "信息不足", "无法提供", "不便讨论", "不方便透露",
    "言語モデルとして", "aiとして", "お答えできません", "回答できません", "答えることができません", "お答えすることはできません", "情報が不足", "情報が足りません", "お手伝いできません",
    "उत्तर नहीं दे सकता", "उत्तर नहीं दे सकती", "जवाब नहीं दे सकता", "जवाब नहीं दे सकती", "भाषा मॉडल के रूप में", "पर्याप्त जानकारी नहीं", "जानकारी पर्याप्त नहीं", "मदद नहीं कर सकता", "मदद नहीं कर सकती", "संदर्भ पर्याप्त नहीं",
    "ไม่สามารถตอบ", "ไม่สามารถช่วย", "ในฐานะโมเดลภาษา", "ในฐานะแบบจำลองภาษา", "ข้อมูลไม่เพียงพอ", "ไม่มีข้อมูลเพียงพอ", "บริบทไม่เพียงพอ", "ตอบคำถามนี้ไม่ได้",
]
# Frames in which an answer may hand back its question (fixed values).
ECHO_FRAMES = {"you", "ask", "asked", "are", "asking", "your", "the", "question", "is", "was", "q", "a", "answer", "du", "fragst", "sie", "fragen", "die", "frage", "lautet", "ist", "вы", "спрашиваете", "ты", "вопрос", "ви", "питаєте", "питання", "preguntas", "la", "pregunta", "es", "perguntas", "pergunta", "respuesta", "resposta", "antwort", "ответ", "відповідь", "你", "问", "您", "的", "问题", "是", "質", "問", "は", "so", "well"}
# Names of languages by which a question asks for one (fixed values).
ASKS_LANGUAGE = re.compile(r"(?i)\b(?:translat\w*|quot\w+|in (?:english|russian|ukrainian|german|spanish|portuguese|chinese|japanese|hindi|thai)|(?:english|russian|ukrainian|german|spanish|portuguese|chinese|japanese|hindi|thai) (?:sentence|word|phrase|text|passage|note|title|original|version|name)\w*|übersetz\w*|zitier\w*|auf (?:englisch|russisch|ukrainisch|deutsch|spanisch|portugiesisch|chinesisch|japanisch|hindi|thai)|(?:englische|russische|ukrainische|deutsche|spanische|portugiesische|chinesische|japanische)\w* (?:satz|wort|text)\w*|traduc\w*|traduz\w*|cita\w*|en (?:inglés|ruso|ucraniano|alemán|español|portugués|chino|japonés|hindi|tailandés)|em (?:inglês|russo|ucraniano|alemão|espanhol|português|chinês|japonês|hindi|tailandês)|перевед\w*|перевод\w*|процитир\w*|цитат\w*|по-(?:английски|русски|украински|немецки|испански|португальски|китайски|японски)|на (?:английском|русском|украинском|немецком|испанском|португальском|китайском|японском|хинди|тайском)|перекла\w*|(?:англійською|російською|українською|німецькою|іспанською|португальською|китайською|японською))\b|翻译|引用|(?:用|写出?)(?:英|俄|德|西班牙|葡萄牙|日|中)[语文]|[英俄德日中]文|英語|ロシア語|ドイツ語|スペイン語|中国語|日本語で|अंग्रेज़ी|अनुवाद|แปล|ภาษา(?:อังกฤษ|รัสเซีย|เยอรมัน|จีน|ญี่ปุ่น)")

_LETTERS = r"[^\W_\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]+"
_WORDLIKE = rf"[\u3040-\u30ff\u3400-\u9fff]|[\u0e00-\u0e7f]|{_LETTERS}(?:['’-]{_LETTERS})*|[\u0900-\u097f]+"
_TOKEN = re.compile(_WORDLIKE)
_EDGES = re.compile(r"\A[\W_]+|[\W_]+\Z")
_EMPTY_TAG = re.compile(r"<(\w+)>\s*</\1>|<\w+\s*/>|```\w*\s*```|\[\s*\]|\{\s*\}")
_ITEM = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])(?:\s+|$)")
_END = re.compile(r"[.!?。！？।｡．॥|][\"”’»)\]」』“*_`~]*\s*$")
_DOTS = re.compile(r"(?:\.\.\.|…)[\"”’»)\]」』]*\s*$")


def _build():
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(p, p)
    a.make_automaton()
    return a


_REFUSAL = _build()


def tokens_of(text: str) -> list[str]:
    """Case-folded words; letters one by one in scripts without spaces."""
    return _TOKEN.findall(text.casefold())


class SuffixAutomaton:
    """All token substrings of one prompt; longest_matches walks a response through it."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def longest_matches(self, tokens: list[str]) -> list[int]:
        """For each position of tokens: the length of the longest piece of the prompt that ends there."""
        state = run = 0
        out = []
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if t in self.next[state]:
                state, run = self.next[state][t], run + 1
            out.append(run)
        return out


def copied_coverage(prompt: list[str], response: list[str], least: int = 3) -> tuple[float, float, list[str]]:
    """Share of the response in pieces of at least `least` tokens of the prompt, the longest such piece as a share of the prompt, and the tokens outside."""
    if not prompt or not response:
        return 0.0, 0.0, response
    runs = SuffixAutomaton(prompt).longest_matches(response)
    covered = [False] * len(response)
    for i, n in enumerate(runs):
        if n >= min(least, len(prompt)) and (i + 1 == len(runs) or runs[i + 1] <= n):
            covered[i - n + 1 : i + 1] = [True] * n
    return sum(covered) / len(response), max(runs) / len(prompt), [t for t, c in zip(response, covered) if not c]


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only a stand-in for an answer."""
    if answer is None:
        return True
    bare = _EDGES.sub("", _EMPTY_TAG.sub("", answer)).casefold()
    return not bare or bare in STAND_IN_PHRASES


_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|(?<!\w)\"[^\"]*\"")


# Words that turn to the answer behind a phrase of regret (fixed values), and starts of a clause that is no answer.
TURNS = "but however yet though still instead но однако зато але проте однак aber jedoch doch allerdings pero sino aunque mas porém contudo но 但 但是 不过 然而 しかし ただし でも लेकिन परंतु मगर แต่"
_TURN = re.compile("|".join(rf"(?<!\w){w}(?!\w)" if ord(w[0]) < 0x900 else w for w in sorted(set(TURNS.split()), key=len, reverse=True)))
_NO_ANSWER = re.compile(r"\W*(?:i|we|you|please|feel|if|let|я|мы|вы|если|можете|ich|sie|wenn|bitte|yo|usted|puede|puedes|si|eu|você|pode|se|ви|якщо|我|您|你|如果|私|もし|मैं|आप|यदि|ฉัน|คุณ|หาก)(?!\w)|\W*(?:我|您|你|如果|私|もし|ฉัน|คุณ|หาก)")


def _answers_behind(low: str, end: int) -> bool:
    """Whether a clause behind the refusing phrase turns to an answer after all."""
    m = _TURN.search(low, end)
    return bool(m) and not _NO_ANSWER.match(low, m.end()) and len(tokens_of(low[m.end() :])) >= 3


def is_refusal(answer: str) -> bool:
    """Whether a refusal phrase of whole words stands outside quotations with no answer behind it; the automaton reads the whole answer once."""
    low = answer.casefold().replace("’", "'").replace("ʼ", "'")
    low = re.sub(r"\s+", " ", low)
    hits = [(end - len(p) + 1, end + 1) for end, p in _REFUSAL.iter(low)]
    hits = [(s, e) for s, e in hits if not (_joined(low, s) or _joined(low, e))]
    if not hits:
        return False
    quotes = [m.span() for m in _QUOTED.finditer(low)]
    hits = [(s, e) for s, e in hits if not any(a <= s and e <= b for a, b in quotes)]
    return bool(hits) and not _answers_behind(low, max(e for _, e in hits))


def _joined(low: str, at: int) -> bool:
    """Whether letters of a script with spaces stand on both sides of a position, so that a word goes on there."""
    return 0 < at < len(low) and all(c.isalpha() and ord(c) < 0x900 for c in low[at - 1 : at + 1])


def is_copied(question: str | None, answer: str) -> bool:
    """Whether the answer only repeats the question, perhaps twice, in other case or in a short frame."""
    if not question:
        return False
    q, a = tokens_of(question), tokens_of(answer)
    if len(q) < 3 or len(a) < 3:
        return bool(q) and q == a
    share, piece, rest = copied_coverage(q, a)
    if piece < 0.6:
        return False
    if share >= 0.9 or (len(rest) <= 6 and all(t in ECHO_FRAMES for t in rest)):
        return True
    # the whole question behind a lead-in of a few words, with nothing after it
    return piece >= 0.95 and len(rest) <= LEAD_IN and a[: len(rest)] == rest


#: So many words may lead into a repeated question.
LEAD_IN = 10


_FAMILY = (("cyrillic", ("ru", "uk")), ("deva", ("hi",)), ("thai", ("th",)), ("kana", ("ja",)), ("han", ("zh", "ja")), ("latin", ("en", "de", "es", "pt")))


def language_vote(text: str) -> tuple[str | None, str | None]:
    """(script family, language by the votes of function words, None where they don't lead clearly)."""
    core = _QUOTED.sub(" ", text)
    if len(tokens_of(core)) < 5:
        core = text
    n = script_counts(core)
    total = sum(n.values())
    if not total:
        return None, None
    latin = n["latin"]
    rest = {k: v for k, v in n.items() if k != "latin"}
    rest["cjk"] = rest.pop("han") + rest.pop("kana")
    big = max(rest, key=rest.get)
    family = big if rest[big] * 2 >= latin or (big == "cjk" and rest[big] * 4 >= latin) else "latin"
    if family in ("deva", "thai"):
        return family, "hi" if family == "deva" else "th"
    if family == "cjk":
        return family, "ja" if n["kana"] * 10 >= n["han"] and n["kana"] else "zh"
    allowed = dict(_FAMILY)[family]
    votes = stopword_votes(core)
    (a, x), (_, y) = sorted(((k, votes[k]) for k in allowed), key=lambda p: -p[1])[:2]
    return family, a if x >= 2 and x >= 1.5 * y else None


def is_other_language(question: str | None, answer: str) -> bool:
    """Whether the answer is in another language than the question, which didn't ask for it; quotations and names don't vote."""
    if not question or ASKS_LANGUAGE.search(question):
        return False
    (qf, ql), (af, al) = language_vote(question), language_vote(answer)
    if not qf or not af:
        return False
    if len(tokens_of(answer)) < 4:
        return False
    if qf != af:
        return af != "latin" or al is not None
    return ql is not None and al is not None and ql != al


# Words after which no sentence ends (fixed values), and marks that open something.
DANGLING = set("the a an of and or to in on for with by at from than that which who whose because although though while if as into onto their its his her my your our is are was were be been has have had der die das den dem des ein eine einen einem einer und oder mit von zu im am auf für weil dass ob wenn obwohl wie als el la los las un una de del y o en que con por para porque aunque cuando si al su sus os um uma e do da dos das no na nos nas com porque embora quando se ao и в на с к по из у за от до не что как но для или чтобы который хотя і та у з до від за що як але або щоб бо який хоча का की के को से में पर और कि".split())
_OPEN_CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』"}
_CLOSERS = {c for v in _OPEN_CLOSE.values() for c in v}


def unclosed(text: str) -> bool:
    """Whether a delimiter stack over the last paragraph ends with something open (brackets, quotations, code fences, formulas)."""
    if text.count("```") % 2 or text.count("$$") % 2:
        return True
    stack: list[str] = []
    last = text.rsplit("\n\n", 1)[-1]
    for ch in last:
        if stack and ch in stack[-1]:
            stack.pop()
        elif ch in _OPEN_CLOSE:
            stack.append(_OPEN_CLOSE[ch])
        elif ch == '"':
            stack.append('"')
    return bool(stack)


#: An item mark with nothing behind it, the item before it somewhere in the text; an abbreviation that something always follows.
_LAST_ITEM = re.compile(r"(?:\A|\s)(?:1[.)]\s.*\s[2-9]\d?[.)]|[-*•])\Z", re.S)
_ABBREVIATION = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(set((ALWAYS + ' ' + BEFORE_NAME).split()) - {'D', 'ст', 'им', 'св'} | {'fig'})))})\.\Z")


def ending(answer: str) -> tuple[str, list[str]]:
    """("done" | "cut" | "open", last tokens): open means that only the words of the last sentence can tell.

    cut: the delimiter stack isn't empty, an ellipsis cuts a word, the last item is a bare list mark, or the
    last word can't end a sentence.
    """
    text = answer.rstrip(" \t\r\n ​*_`~")
    if not text:
        return "done", []
    if unclosed(answer):
        return "cut", []
    if _ITEM.fullmatch(text.rsplit("\n", 1)[-1]):
        return "cut", []
    if _LAST_ITEM.search(text) or _ABBREVIATION.search(text):
        return "cut", []
    if _DOTS.search(text):
        return "open", last_tokens(_DOTS.sub("", text))
    if _END.search(text):
        return "done", []
    if text[-1] in ",;:-–—/&+=(“„«「（，、；：" or (text[-1] in "-" and len(text) > 1):
        return "cut", []
    return "open", last_tokens(text)


_SENT = re.compile(r"[.!?…。！？।｡．॥|\n]+[\"”’»)\]」』]*\s*")
_LAST = re.compile(_WORDLIKE + r"|[,;:，、：；(“„«]")
#: Longest suffix of tokens that is looked up.
DEPTH = 5


def shape(token: str) -> str:
    """A token as the ending statistics see it: numbers and capitalised words by kind, others as they are."""
    if token[0].isdigit():
        return "#"
    return "^" if token[0].isupper() and len(token) > 1 else token.lower()


def last_tokens(text: str) -> list[str]:
    """The last DEPTH + 1 tokens of the text in their shapes, commas included, not crossing a sentence mark; the word itself first."""
    cut = max((m.end() for m in _SENT.finditer(text)), default=0)
    tail = text[cut:] or text
    raw = _LAST.findall(tail)
    if not raw:
        return []
    return [("<s>" if len(raw) <= DEPTH else "")] + [shape(t) for t in raw[-DEPTH - 1 :]] + [raw[-1]]


def _suffixes(shapes: list[str]) -> list[str]:
    """The last one to DEPTH shapes, and three shapes followed by any one or two words."""
    out = [" ".join(shapes[-n:]) for n in range(min(DEPTH, len(shapes)), 0, -1)]
    out += ["~" + " ".join(shapes[-3 - n : -n]) + " *" * n for n in (1, 2) if len(shapes) >= 3 + n]
    return out


def sentence_ngrams(text: str) -> list[tuple[str, bool]]:
    """(n-gram of shapes that ends at a token, whether that token ends its sentence) over the finished sentences of a text, n = 1 … DEPTH, and the plain last words."""
    out = []
    begin = 0
    for end in boundaries(text):
        unit = text[begin:end]
        begin = end
        if _DOTS.search(unit) or not _END.search(unit):
            continue
        raw = _LAST.findall(_END.sub("", unit))
        shapes = ["<s>"] + [shape(t) for t in raw]
        for i in range(1, len(shapes)):
            final = i == len(shapes) - 1
            out += [(g, final) for g in _suffixes(shapes[max(0, i - DEPTH) : i + 1])]
        out += [("=" + t, i == len(raw) - 1) for i, t in enumerate(raw)]
    return out


# ---- Spark ---------------------------------------------------------------------------------------------

_JUDGED = T.StructType([T.StructField("defect", T.StringType()), T.StructField("tail", T.ArrayType(T.StringType())), T.StructField("short", T.BooleanType())])


def judge(question: str | None, answer: str | None) -> tuple[str | None, list[str] | None, bool]:
    """(defect, tail, short): tail holds the last tokens where only the statistics of endings can tell whether the answer was cut."""
    if is_empty(answer):
        return "empty", None, False
    if is_refusal(answer):
        return "refusal", None, False
    if is_copied(question, answer):
        return "copied", None, False
    if is_other_language(question, answer):
        return "other_language", None, False
    state, tail = ending(answer)
    if state == "cut":
        return "truncated", None, False
    if state == "open" and tail:
        return None, tail, len(tokens_of(answer)) <= 4
    return None, None, False


def _judge(questions: pd.Series, answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(q, a) for q, a in zip(questions, answers)], columns=["defect", "tail", "short"])


def _count_endings(batches):
    """Partial counts of n-grams (final, total), merged inside a task before they are shuffled."""
    counts: dict[str, list[int]] = {}
    for pdf in batches:
        for text in pdf["a"]:
            for gram, final in sentence_ngrams(text):
                c = counts.get(gram)
                if c is None:
                    c = counts[gram] = [0, 0]
                c[0] += final
                c[1] += 1
        if len(counts) > 300_000:
            yield pd.DataFrame([(g, f, n) for g, (f, n) in counts.items()], columns=["gram", "n_final", "n_total"])
            counts = {}
    if counts:
        yield pd.DataFrame([(g, f, n) for g, (f, n) in counts.items()], columns=["gram", "n_final", "n_total"])


def _grams_of_tail(tails: pd.Series) -> pd.Series:
    """The suffixes of a tail, longest first, then the plain last word."""

    def grams(tail):
        return _suffixes([t for t in tail[:-1] if t]) + ["=" + tail[-1]]

    return tails.map(lambda t: None if t is None else grams(list(t)))


def _is_cut(grams: pd.Series, finals: pd.Series, totals: pd.Series, shorts: pd.Series) -> pd.Series:
    """Whether an open ending was cut: the longest suffix seen often enough decides by how often it ends a sentence."""
    out = []
    for gs, fs, ns, short in zip(grams, finals, totals, shorts):
        seen = {g: (f, n) for g, f, n in zip(gs, fs, ns) if n}
        word = next(g for g in gs if g[0] == "=")[1:]
        known = seen.get("=" + word, (0, 0))
        alien = (word[0].islower() or len(word) == 1 and ord(word) < 0x900) and word.isalpha() and known[1] < 2  # no word of the corpus: a piece of one
        if short:  # a complete short answer needs no verb
            out.append(alien or (len(gs) > 2 and word.lower() in DANGLING and known[0] == 0))
            continue
        grams_seen = [g for g in seen if g[0] != "=" and seen[g][1] >= LEAST_SEEN]
        best = max(grams_seen, key=_specific, default=None)
        if alien or len(word) == 1 and word.islower() and word not in LETTER_WORDS and ord(word) < 0x900:
            out.append(True)
        elif word.lower() in DANGLING and not any(_specific(g) >= 3 and g[0] != "~" for g in grams_seen):
            out.append(True)
        elif best and _specific(best) >= 3:
            out.append(seen[best][0] < FINAL_SHARE * seen[best][1])
        elif best is None:
            out.append(False)
        else:
            out.append(seen[best][0] < (FINAL_SHARE if best.count(" ") else 0.02) * seen[best][1])
    return pd.Series(out, dtype=bool)


#: Words of one letter that can end a sentence.
LETTER_WORDS = frozenset("яaxyzn")


def _specific(gram: str) -> float:
    """How much of its context a suffix fixes: its length, with those that leave words open between three and four."""
    n = gram.count(" ") + 1
    return 3.5 + n / 100 if gram[0] == "~" else n


#: So often must a suffix of an answer occur elsewhere to tell whether sentences end with it.
LEAST_SEEN = 6
#: A suffix that ends its sentence in fewer of its occurrences doesn't end one here.
FINAL_SHARE = 0.12


#: Places a gram of many open endings is spread over.
SALTS = 16


def broken_pairs(pairs: DataFrame, key: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, defect): one row for each defective question-answer pair, with its one defect type.

    Method: a suffix automaton of the prompt is walked by the response to measure how much of it is copied; an
    automaton of refusal phrases reads the response; a delimiter stack finds what was left open; votes of function
    words (and scripts) tell the languages. Where an answer lacks its final mark, the endings of all finished
    sentences of the corpus tell whether it stops inside a sentence: n-grams are counted over all answers, merged
    per task before the shuffle, and the longest suffix that was seen decides.

    The first type that holds counts, in the order of DEFECTS. A null or blank question leaves only the checks of
    the answer alone. Repeated rows are judged like their originals; other columns are ignored.
    """
    rows = spread(pairs.select(F.col(key).alias("_k"), F.col(question).alias("_q"), F.col(answer).alias("_a")))
    judged = rows.select("_k", "_a", F.pandas_udf(_judge, _JUDGED)("_q", "_a").alias("_j"))
    known = judged.filter(F.col("_j.defect").isNotNull()).select("_k", F.col("_j.defect").alias("defect"))
    open_ = judged.filter(F.col("_j.defect").isNull() & F.col("_j.tail").isNotNull()).select("_k", F.col("_j.tail").alias("_t"), F.col("_j.short").alias("_short"))
    grams = open_.select("_k", "_short", F.posexplode(F.pandas_udf(_grams_of_tail, T.ArrayType(T.StringType()))("_t")).alias("_i", "gram"))
    counts = rows.filter(F.col("_a").isNotNull()).select(F.col("_a").alias("a")).mapInPandas(_count_endings, "gram string, n_final long, n_total long")
    counts = counts.groupBy("gram").agg(F.sum("n_final").alias("n_final"), F.sum("n_total").alias("n_total"))
    # a gram of many endings is asked for in SALTS places, each once, and its count goes back to each of them
    grams = grams.withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int"))
    asked = grams.select("gram", "_salt").distinct().join(counts, "gram")
    seen = grams.join(asked, ["gram", "_salt"], "left").groupBy("_k").agg(
        F.collect_list(F.struct("_i", "gram", F.coalesce("n_final", F.lit(0)).alias("f"), F.coalesce("n_total", F.lit(0)).alias("n"))).alias("_g"), F.first("_short").alias("_short")
    )
    cut = F.pandas_udf(_is_cut, T.BooleanType())(F.col("_g.gram"), F.col("_g.f"), F.col("_g.n"), F.col("_short"))
    truncated = seen.filter(cut).select("_k", F.lit("truncated").alias("defect"))
    return known.unionByName(truncated).select(F.col("_k").alias(key), "defect").distinct()
