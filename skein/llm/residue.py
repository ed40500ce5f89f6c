"""Template residue and error-page text (problem 10)."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from skein.llm.language import STOPWORDS
from skein.llm.markup import TAGS
from skein.llm.sentences import boundaries
from skein.session import spread

KINDS = ("placeholder", "script_notice", "error_page", "filler")

# Labelled exemplars (fixed values): phrases that such records are made of in general, one a line, several phrases of a
# line between bars. "#" stands for a number, code or path.
EXEMPLARS = {
    "script_notice": """
enable javascript | turn on javascript | javascript must be enabled | javascript must be switched on to use | javascript is disabled | javascript seems to be off | javascript is required | requires javascript and cookies
allow scripts to run | scripts are blocked | unblock scripts | scripting must be enabled | works only with scripting | viewer | scripts are turned off | turn scripts on and reload | if nothing happens | need to run a script | protection from robots
your browser does not support scripts | your browser blocked it | checking your browser | can't be displayed without it | without js this app doesn't work properly | enable it to continue | run this app | use this site | view this page | noscript
javascript aktivieren | javascript einschalten | javascript ist im browser deaktiviert | ihr browser unterstützt kein javascript | für diese anwendung muss javascript eingeschaltet sein | um die seite anzuzeigen
включите javascript | javascript отключен в браузере | необходимо включить сценарии | включите поддержку сценариев | страница не работает без сценариев | для просмотра страницы
увімкніть javascript | javascript вимкнено у браузері | потрібна підтримка сценаріїв | не працює без сценаріїв | щоб переглянути сторінку
active javascript | habilitar javascript | javascript está desactivado | su navegador no admite scripts | es necesario para ver esta página
ative o javascript | ativar o javascript | javascript está desativado | o seu navegador não suporta scripts | é necessário para continuar | para ver esta página
启用 javascript | 请启用脚本 | 浏览器不支持脚本 | 脚本已被禁用 | 需要 javascript 才能浏览本页 | 启用后请刷新 | 后再浏览
javascriptを有効にしてください | スクリプトが無効です | ページを表示するには | 有効にしてから再読み込み | ブラウザが対応していません
javascript सक्षम करें | जावास्क्रिप्ट चालू करें | ब्राउज़र में स्क्रिप्ट बंद है | पृष्ठ देखने के लिए
เปิดใช้งาน javascript | เปิดใช้จาวาสคริปต์ | เบราว์เซอร์ไม่รองรับสคริปต์ | เพื่อดูหน้านี้ | โปรดเปิดใช้""",
    "error_page": """
not found | page # does not exist | could not be found on this server | has been moved or deleted | has been removed | isn't here any more | removed # days ago | never existed | the page you were looking for
internal server error | please try again later | error # | error code # | reference # | status # | bad gateway | no answer from upstream | upstream reset | request # failed | after # retries | gateway timeout | took too long to respond | reload to try again
service temporarily unavailable | down for maintenance until # | too many requests | slow down and retry after # seconds | rate limit exceeded
access denied | you don't have permission to view # | forbidden | this page is private | ask the owner for access to #
site can't be reached | connection timed out after # s | connection refused | no results | an unexpected error occurred while rendering # | something went wrong | oops | we could not load this page
your session has expired | sign in again to see this page | you have been logged out because of inactivity | please log in | you must be logged in to view
database error | could not connect to the database | db errno # | ssl handshake failed for #
error code message trace # | error code accessdenied requestid # | access denied request id # | bad request # | # bad request | http # error | content length #
traceback most recent call last | file # py line # in load | file line # in module | keyerror # | valueerror | typeerror | indexerror | attributeerror
java lang exception | java lang illegalstateexception closed | at java util # | at read java # | store closed | exception in thread main | nullpointerexception | fatal error uncaught exception in # on line # | segmentation fault core dumped
ошибка # | страница # не найдена | внутренняя ошибка сервера | попробуйте обновить страницу позже | код # | невозможно подключиться к базе | повторите попытку через # мин | доступ запрещён | нет прав для просмотра | сервис временно недоступен | время сеанса истекло | войдите снова
помилка # | сторінку не знайдено | внутрішня помилка сервера | спробуйте пізніше | доступ заборонено | немає прав для перегляду | сервіс тимчасово недоступний
fehler # | seite wurde nicht gefunden | interner serverfehler | vorübergehend nicht erreichbar | bitte versuchen sie es später noch einmal | zugriff verweigert | keine berechtigung | sitzung ist abgelaufen | melden sie sich erneut an
error # | no tiene permiso para ver esta página | la página solicitada no existe | ha sido eliminada | error interno del servidor | inténtelo más tarde | página no encontrada | su sesión ha caducado
erro # | o serviço está indisponível | página não encontrada | erro interno do servidor | tente novamente mais tarde | a sessão expirou | sem permissão para ver esta página
页面不存在 | 找不到页面 | 服务器内部错误 | 请稍后再试 | 访问被拒绝 | 没有权限查看 | 会话已过期 | 请重新登录 | 服务暂时不可用 | # 错误
ページが見つかりません | urlをご確認ください | サーバーエラーが発生しました | アクセスが拒否されました | セッションの有効期限が切れました | もう一度ログインしてください | しばらくしてからお試しください
त्रुटि # | पृष्ठ नहीं मिला | सर्वर त्रुटि | बाद में पुनः प्रयास करें | देखने की अनुमति नहीं है
ข้อผิดพลาด # | ไม่พบหน้าที่คุณต้องการ | เซิร์ฟเวอร์ขัดข้อง | โปรดลองใหม่ภายหลัง | ไม่มีสิทธิ์เข้าถึงหน้านี้""",
    "filler": """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque vivamus ornare curabitur tristique faucibus donec integer mauris nunc vitae lacus mattis
sample text | replace it later | your text goes here | content coming soon | placeholder paragraph | please ignore | dummy content for layout purposes only | this is placeholder text
test # | blah | foo bar baz | asdf jkl | qwe rty | qwerty | xxxx | xxx | text text
hier steht bald ein text | blindtext | platzhaltertext
здесь будет текст | текст рыба для проверки вёрстки | тут буде текст | текст заглушка для перевірки верстки
texto de relleno | aquí va el texto | texto de exemplo | substituir depois | aqui vai o texto de preenchimento
占位文字 | 此处为示例文本 | 这里是文字 | ダミーの文章が入ります | サンプルテキスト | ここに文章
नमूना पाठ | यहाँ भराव पाठ आएगा | ข้อความตัวอย่าง | ใส่ข้อความที่นี่""",
    "chrome": """
home notes about | skip to content | menu | start archive note | back to start page | contact the administrator if this goes on | notes service | all rights reserved | reload this page | #""",
}
_GLUE = frozenset(" ".join(STOPWORDS.values()).split()) | {"#"}

# Names of fields that templates leave to be filled (fixed values), compared without case.
FIELDS = "title date name author topic project summary text tags tag link url email phone address company city country subject body content description heading header footer id user username first_name last_name note vault file path source titel datum autor thema nombre fecha autor título tema resumen nome data имя дата автор тема название ім'я назва 题 题目 标题 作者 日期 題名 著者 日付 タイトル 本文 शीर्षक नाम ชื่อ"
# Words by which a template asks to be filled (fixed values).
ASKS = r"insert|enter|your|add|type|fill in|tbd|todo|fixme|placeholder|replace|choose|eingeben|einfügen|hier|ihr(?:e|en)?|dein(?:e|en)?|inserte|insertar|introduzca|escriba|aquí|su|tu|insira|inserir|digite|escreva|seu|sua|введите|вставить|вставьте|укажите|ваше|ваш|ваша|введіть|вставте|вставити|вкажіть|на?пишіть"
_FIELD = "|".join(sorted(map(re.escape, set(FIELDS.split())), key=len, reverse=True))
_IDENT = rf"(?:[^\W\d]\w*_\w+|{_FIELD})"
_SWITCH = "NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NOGALLERY|HIDDENCAT|INDEX|NOINDEX"
_HTML = "|".join(TAGS.split())
_PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*[^{{}}\s][^{{}}\n]*\}}\}}\}}?|[$#]\{{\s*[^\W\d][\w. :|-]*\}}|%\([^\W\d]\w*\)[sdfr]|%%[^\W\d][\w ]+%%|@@[^\W\d][\w ]+@@"
    rf"|(?<!\w)__(?!(?:{_SWITCH})__)[A-Z][A-Z_ ]{{2,}}__(?!\w)|(?<![\w$])\$[A-Z][A-Z_]{{2,}}\$|<%=?-?\s*[^%\n]+%>|\{{%-?\s*[^%\n]+%\}}|<<\s*[^\W\d]\w+\s*>>"
    rf"|<(?!(?:(?i:{_HTML}))\b)(?:[A-Z]{{2,}}(?:_[A-Z]+)*)>|<(?i:(?:{ASKS})\s[^<>\n/=]{{2,}}|[^<>\n/=]{{2,}}\s(?:{ASKS}))>"
    rf"|\[(?!\s)(?:[A-Z]+_[A-Z_]+|(?i:{_FIELD}))\](?!\()(?=[^\[]|\Z)|\[\s*(?i:(?:{ASKS})[\s:]\s*[^\[\]\n]+|[^\[\]\n]+\s(?:{ASKS}|here|aquí|aqui|сюда|тут))\](?!\()"
    rf"|\(\s*(?i:(?:insert|enter|your|type|tu|su|ihr|dein|введите|ваше)\s[^()\n]+\s(?:here|aquí|aqui|hier|сюда))\)|(?<![\w$#{{])\{{{_IDENT}\}}(?![\w}}])"
    r"|[【\[（(［](?=[^】\]）)］\n]*(?:在此|请输入|请填写|填写|ここに|入力|記入|題名|标题|タイトル|यहाँ|लिखें|दर्ज करें|ใส่|กรอก|พิมพ์))[^】\]）)］\n]+[】\]）)］]"
)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|<(code|pre)\b.*?</\1>", re.S)
_QUOTED = re.compile(r"“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|(?<![\w\"=])\"[^\"\n]*\"(?!\w)")
_NUMBER = re.compile(r"(?<!\w)(?:/[\w%.-]+)+/?|\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\b[a-f]{8,}\b|\d+(?:[.:,]\d+)*")
_TERM = re.compile(r"#|[぀-ヿ㐀-鿿]{1,2}|[฀-๿]{1,3}|[ऀ-ॿ]+|[^\W\d_ऀ-ॿ฀-๿぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)*")


def terms_of(text: str) -> list[str]:
    """Terms of a passage: folded words, letter groups of scripts without spaces, "#" for numbers, codes and paths."""
    out = []
    for t in _TERM.findall(_NUMBER.sub(" # ", text.casefold().replace("’", "'").replace("_", " "))):
        out.append(t)
    return out


def _cjk_terms(text: str) -> set[str]:
    """All pairs (Thai: triples) of neighbouring letters; a passage of such a script is compared by these."""
    out = set()
    for run in re.findall(r"[぀-ヿ㐀-鿿]+", text):
        out |= {run[i : i + 2] for i in range(max(1, len(run) - 1))}
    for run in re.findall(r"[฀-๿]+", text):
        out |= {run[i : i + 3] for i in range(max(1, len(run) - 2))}
    return out


def bag_of(text: str) -> set[str]:
    terms = terms_of(text)
    if any(ord(t[0]) > 0xDFF for t in terms):
        return {t for t in terms if ord(t[0]) <= 0xDFF} | _cjk_terms(text)
    return set(terms)


def placeholders(text: str) -> list[tuple[int, int]]:
    """Spans of unfilled placeholders outside code and quotations."""
    if not _HINT.search(text):
        return []
    shown = [m.span() for m in _CODE.finditer(text)] + [m.span() for m in _QUOTED.finditer(text)]
    return [m.span() for m in _PLACEHOLDER.finditer(text) if not any(a <= m.start() and m.end() <= b for a, b in shown)]


_HINT = re.compile(r"[{}<>\[@%$【（(［]|__")


#: An exemplar of more terms than that is a vocabulary: passages are made of its words in any order and choice.
VOCABULARY = 40


class ResidueIndex:
    """Inverted index over the labelled exemplars with the idf of their terms in the corpus.

    contained: TF-IDF share of an exemplar that a passage must hold; covered: TF-IDF share of the passage that the exemplars
    of that kind must make up of which it holds at least half as much. Function words and numbers weigh GLUE of a term.
    """

    GLUE = 0.25

    def __init__(self, df: dict[str, int] | None = None, n_docs: int = 0, contained: float = 0.5, covered: float = 0.35):
        self.contained, self.covered = contained, covered
        self.weight: dict[str, float] = {}
        self.exemplars: list[tuple[str, set[str], float]] = []
        self.postings: dict[str, list[int]] = {}
        self.other = (math.log(n_docs + 1) + 2.0) / 2  # of terms that no exemplar has: halfway between the commonest and the rarest
        df = df or {}
        for kind, lines in EXEMPLARS.items():
            for phrase in re.split(r"[|\n]", lines):
                bag = bag_of(phrase)
                if not bag:
                    continue
                for t in bag:
                    idf = math.log((n_docs + 1) / (df.get(t, 0) + 1)) + 1.0
                    self.weight[t] = idf * self.GLUE if t in _GLUE else idf
                    self.postings.setdefault(t, []).append(len(self.exemplars))
                self.exemplars.append((kind, bag, sum(self.weight[t] for t in bag)))
        self.vocabulary = frozenset(self.weight)

    def match(self, passage: str, bag: set[str] | None = None) -> str | None:
        """The kind whose exemplars, those that the passage holds to a high degree, cover it to a high degree. bag: bag_of(passage), if known."""
        bag = bag_of(passage) if bag is None else bag
        known = bag & self.vocabulary
        if not known:
            return None
        if _QUOTED.search(passage):  # a passage that quotes in passing doesn't say it itself; one of quotations only does
            own = bag_of(_QUOTED.sub(" ", passage))
            if 2 * len(own) > len(bag):
                known &= own
        weight, glue = self.weight, self.other * self.GLUE
        whole = sum(weight[t] for t in known) + sum(glue if t in _GLUE else self.other for t in bag - known)
        if sum(weight[t] for t in known) < self.covered * whole:
            return None
        hits: Counter = Counter()
        for t in known:
            for e in self.postings[t]:
                hits[e] += weight[t]
        union: dict[str, set[str]] = {}
        sure = set()
        for e, mass in hits.items():
            kind, ex, full = self.exemplars[e]
            if len(ex) > VOCABULARY:
                held = len(bag) > 1 and len(bag & ex) >= 0.8 * len(bag)
            else:
                held = mass >= self.contained * full and not known & ex <= _GLUE
            if held:
                sure.add(kind)
            if held or mass >= self.contained / 2 * full:
                union.setdefault(kind, set()).update(ex)
        best, kind = self.covered, None
        for k in sure:
            share = sum(weight[t] for t in known & union[k]) / whole
            if share >= best:
                best, kind = share, k
        return kind

    def kind(self, text: str | None) -> str | None:
        """placeholder | script_notice | error_page | filler if the text lacks proper content, else None."""
        if not text or not text.strip():
            return None
        if placeholders(text):
            return "placeholder"
        mass: Counter = Counter()
        rest = 0
        for line in _LINES.split(_MARKS.sub(" ", text) if "<" in text else text):
            line = line.strip()
            if not line:
                continue
            units, begin = [], 0
            for end in boundaries(line):
                unit = line[begin:end].strip()
                units.append((unit, bag_of(unit)))
                begin = end
            whole = self.match(line, set().union(*(bag for _, bag in units)))
            if whole:
                mass[whole] += len(line)
                continue
            for unit, bag in units:
                k = self.match(unit, bag) if len(units) > 1 else None
                if k:
                    mass[k] += len(unit)
                elif not _is_title(unit):
                    rest += len(unit)
            if rest > 0.4 * len(text):  # matching passages can't reach 0.6 of the whole any more
                return None
        mass.pop("chrome", None)
        if not mass:
            return None
        kind, n = mass.most_common(1)[0]
        total = sum(mass.values()) + rest
        return kind if n >= (0.85 if kind == "filler" else 0.6) * total else None


_LINES = re.compile(r"[\r\n]+")
_MARKS = re.compile(rf"</?(?:{_HTML})\b[^<>]*>", re.I)
_FINAL = re.compile(r"[.!?…。！？।｡．]['\"”’»)\]]*\s*\Z")


def _is_title(unit: str) -> bool:
    return len(unit) <= 60 and len(unit.split()) <= 6 and not _FINAL.search(unit) and not (len(unit) > 24 and any("฀" <= c <= "๿" for c in unit))


def _document_frequencies(vocabulary: frozenset):
    def count(batches):
        df: Counter = Counter()
        n = 0
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                df.update(vocabulary & (bag_of(text)))
        yield pd.DataFrame({"term": [*df, ""], "n": [*df.values(), n]})

    return count


def content_free(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind): one row for each document without proper content.

    Method: the document frequencies of the exemplars' terms are counted over all documents (one row for each
    term and task is shuffled, a few hundred sums come to the driver, as many as there are exemplar terms); an
    inverted index over the labelled exemplars retrieves those that share terms with a passage; a passage
    matches by TF-IDF containment; a document of which matching passages cover a high share, headings and page
    furniture aside, is excluded. Placeholders are passages by their shape, one is enough; those shown as code or
    in quotation marks don't count.

    Null and blank texts are no case (they hold no residue); copies are judged like their originals; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()))
    plain = ResidueIndex()
    counted = rows.select("text").mapInPandas(_document_frequencies(plain.vocabulary), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r.term: r.n for r in counted.collect()}
    index = documents.sparkSession.sparkContext.broadcast(ResidueIndex(df, df.pop("", 0)))
    kind = F.pandas_udf(lambda texts: texts.map(lambda t: index.value.kind(t)).astype(object), T.StringType())
    return rows.select(F.col("key").alias(key), kind("text").alias("kind")).filter(F.col("kind").isNotNull()).distinct()
