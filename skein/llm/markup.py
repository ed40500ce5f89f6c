"""Markup residue in text documents (problem 6)."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skein.session import materialize, spread

KINDS = ("html", "markdown", "wiki", "latex")
#: Pages a host must have before a share of them means anything.
RECURRING = 3

# Names of HTML elements (fixed values).
TAGS = "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q ref rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
_NAMES = "|".join(sorted(TAGS.split(), key=len, reverse=True))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that site template may consist of; headings, list items, cells, paragraphs and code are never deleted by themselves.
BLOCKS = {"aside", "div", "dl", "footer", "form", "header", "menu", "nav", "ol", "section", "table", "ul"}
# LaTeX commands that need no brace (fixed values).
COMMANDS = "alpha beta gamma delta epsilon varepsilon zeta eta theta lambda mu nu xi pi rho sigma tau phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega le leq ge geq ne neq approx equiv sim times cdot pm mp div sum prod int oint infty partial nabla forall exists in notin subset subseteq cup cap to rightarrow leftarrow Rightarrow mapsto ldots cdots dots quad qquad item hline newline linebreak noindent maketitle tableofcontents centering par LaTeX TeX sin cos tan log ln exp lim max min sqrt left right bigl bigr ell hbar circ"

_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<(/?)({_NAMES})(?:\s*/?>|\s[^<>]*>|(?=\s+[\w-]+\s*=)[^<>\n]*|(?<=[a-z][a-z0-9])(?=\n|\Z))", re.I | re.S)
_ESCAPED_TAG = re.compile(rf"&lt;/?(?:{_NAMES})\b(?:(?!&[lg]t;)[^<>])*&gt;", re.I)
_REF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

_FENCE = re.compile(r"^(```+|~~~+)[^\n`]*\n.*?(?:^\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_MATH_ENV = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)", re.S)
_MATH = re.compile(r"\$\$(?=[^$])(.+?)\$\$|\\\((.+?)\\\)|\\\[(.+?)\\\]|(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\]|[^\s$])\$(?![\w$])", re.S)
_MATHY = re.compile(r"[\\^_=+<>{}*/|]|\A[A-Za-z]\Z|\A[A-Za-z]\s*[-+]\s*\d|\d\s*[-+]\s*[A-Za-z]")
_COMMAND = re.compile(rf"\\(?:begin|end)\s*\{{[A-Za-z]+\*?\}}|(?<![\w:\\])~?\\[A-Za-z]+\*?\s?(?:\[[^\]\n]*\])?\{{|(?<![\w:\\])\\(?:{'|'.join(COMMANDS.split())})(?![A-Za-z\\])|(?<![\w:\\])\\[A-Za-z]+(?=[\^_{{])|(?<=[\w\s)])\\[%&#$](?=[\s.,;:)\]\w]|\Z)")

_WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+(?:\[[^\[\]\n]*\][^\[\]\n]*)*\]\]")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_QUOTES = re.compile(r"(?<!')('{5}|'{3}|'{2})(?=[^'\s])(.+?)(?<=[^\s'])\1(?!')")
_WIKI_TEMPLATE = re.compile(r"\{\{(?![{\s]*\})[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}")
_LATEX_BEFORE = re.compile(r"(?<![\w:\\])\\(?!(?:item|hline|newline|noindent|par|centering)(?![A-Za-z]))[A-Za-z]+\*?(?:\[[^\]\n]*\])*\Z")
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
_WIKI_SWITCH = re.compile(r"(?<![A-Za-z0-9_])__[A-Z]{3,}__(?![A-Za-z0-9_])")

_MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_SETEXT = re.compile(r"^([^\s|>*+#-][^\n]*)\n(=+|-{2,})[ \t]*$", re.M)
_MD_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_MD_STRONG = re.compile(r"(?<!\*)(\*\*\*?)(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)|(?<![\w_])(__)(?=[^\s_])(.+?)(?<=[^\s_])__(?![\w_])")
_MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_MD_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?!~)")
_MD_TASK = re.compile(r"^([ \t]*)[-*+][ \t]+\[([ xX])\][ \t]+(?=\S)", re.M)
_MD_LIST = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,3}[.)])[ \t]+(?=[^\s\d]|\d+[A-Za-z])", re.M)
_MONTH = re.compile(r"\s*(?:Jan|Feb|Mär|Mar|Apr|Mai|May|Jun|Jul|Aug|Sep|Okt|Oct|Nov|Dez|Dec)[a-zäé]*\b")
_MD_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\[\]\n]*\])")
_MD_LINK = re.compile(r"(?<!!)\[((?!\^)[^\[\]\n]+)\](?:\([^()\s][^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\[\]\n]*\])")
_MD_REFDEF = re.compile(r"^ {0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
_MD_AUTO = re.compile(r"<(?:https?|ftp|mailto):[^\s<>]+>")
_MD_QUOTE = re.compile(r"^ {0,3}>+[ \t]?(?=[^\s\d=<>-])", re.M)
_MD_NOTE = re.compile(r"\[\^[^\]\s]+\]:?")
_MD_TABLE = re.compile(r"^[ \t]*\|?[^\n|]+\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$(?:\n[ \t]*\|[^\n]*)*", re.M)

_HINT = re.compile(r"[<&\[{|\\$*_#=`~]|''|^[ \t]*(?:[-+>]|\d{1,3}[.)])[ \t]|^-{2,}$", re.M)
_KEEP = "\ue000"  # marks the place of a code block or formula while the text around it is read


def _known_ref(m: re.Match) -> bool:
    return m.group(1) is None or f"{m.group(1)};" in html5


class _Reader:
    """Reads one text: the kinds of markup in it and its clean pieces."""

    def __init__(self, text: str):
        self.kinds: set[str] = set()
        self.kept: list[str] = []
        self.text = text

    def keep(self, canonical: str) -> str:
        self.kept.append(canonical)
        return f"{_KEEP}{len(self.kept) - 1}{_KEEP}"

    def restore(self, s: str) -> str:
        return re.sub(rf"{_KEEP}(\d+){_KEEP}", lambda m: self.kept[int(m.group(1))], s) if _KEEP in s else s

    # -- code and formulas come first: what stands in them is no markup of another kind

    def protect(self) -> None:
        s = self.text
        if "`" in s or "~~~" in s:
            s = _FENCE.sub(self._fence, s)
            s = _CODE.sub(self._code, s)
        if "\\" in s or "$" in s:
            s = _MATH_ENV.sub(self._formula_env, s)
            s = _MATH.sub(self._formula, s)
        self.text = s

    def _fence(self, m: re.Match) -> str:
        self.kinds.add("markdown")
        return self.keep(m.group().rstrip())

    def _code(self, m: re.Match) -> str:
        self.kinds.add("markdown")
        return self.keep(m.group(2).strip())

    def _formula_env(self, m: re.Match) -> str:
        self.kinds.add("latex")
        body = re.sub(r"\\(?:begin|end)\{[^}]*\}|\\label\{[^}]*\}", "", m.group()).strip()
        return self.keep(f"\n$$ {body} $$\n")

    def _formula(self, m: re.Match) -> str:
        body = next(g for g in m.groups() if g is not None)
        if m.group(4) is not None and not _MATHY.search(body):
            return m.group()
        self.kinds.add("latex")
        return self.keep(f"$$ {body.strip()} $$" if m.group(1) is not None or m.group(3) is not None else f"${body.strip()}$")

    # -- HTML: a tree of elements; block subtrees of several children have a hash, every piece of text the hashes of its ancestors

    def pieces(self) -> list[tuple[list[int], str]]:
        s = self.text
        if "&" in s:
            if _ESCAPED_TAG.search(s):
                self.kinds.add("html")
                s = _ESCAPED_TAG.sub(lambda m: html.unescape(m.group()), s)
            if any(_known_ref(m) for m in _REF.finditer(s)):
                self.kinds.add("html")
        if "<" not in s or not (marks := list(_TAG.finditer(s))):
            return [([], s)]
        self.kinds.add("html")
        runs: list[tuple[int, int, str]] = []  # start, end, what the tag before it leaves
        elements: list[list] = []  # tag, start, end, children (elements and runs of text)
        stack: list[int] = []
        at, lead = 0, ""
        for m in marks:
            runs.append((at, m.start(), lead))
            if stack and s[at : m.start()].strip():
                elements[stack[-1]][3] += 1
            at, lead = m.end(), ""
            name = (m.group(2) or "").lower()
            if not name:
                elements.append(["!", m.start(), m.end(), 0])
                continue
            closing = bool(m.group(1))
            if name in ("pre", "code", "script", "style") and not closing:
                lead = "" if name == "code" else "\n"
            elif name[0] == "h" and name[1:].isdigit():
                lead = "\n\n" if closing else "\n\n" + "#" * int(name[1:]) + " "
            elif name == "li":
                lead = "" if closing else "\n- "
            elif name in ("td", "th"):
                lead = "" if closing else " | "
            elif name in ("br", "p", "div", "tr", "table", "ul", "ol", "section", "article", "blockquote", "dl", "dd", "dt", "figure", "nav", "header", "footer"):
                lead = "\n"
            elif name == "img":
                alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", m.group())
                lead = (alt.group(1) or alt.group(2) or "") if alt else ""
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if elements[stack[k]][0] == name:
                        for e in stack[k:]:
                            elements[e][2] = m.end()
                        del stack[k:]
                        break
                continue
            if stack and name not in ("br", "hr"):
                elements[stack[-1]][3] += 1
            if name in VOID or m.group().endswith("/>"):
                elements.append([name, m.start(), m.end(), 0])
            else:
                stack.append(len(elements))
                elements.append([name, m.start(), len(s), 0])
        runs.append((at, len(s), lead))
        hashes = [(a, b, xxhash.xxh64_intdigest(_shape(s[a:b])) - (1 << 63) if tag in BLOCKS and n > 1 else None, tag) for tag, a, b, n in elements]
        out = []
        for a, b, lead in runs:
            over = [(h, tag) for x, y, h, tag in hashes if x < a and b <= y and y - x > 0 and not (y <= a)]
            body = lead + s[a:b]
            if any(tag in ("pre",) for _, tag in over):
                body = self.keep(f"\n```\n{html.unescape(s[a:b]).strip()}\n```\n") if s[a:b].strip() else ""
            elif any(tag in ("script", "style") for _, tag in over):
                body = ""
            if body:
                out.append(([h for h, _ in over if h is not None], body))
        return out

    # -- the other kinds, in one piece

    def clean(self, s: str) -> str:
        add, sub = self.kinds.add, self._sub
        if "[[" in s:
            s = sub("wiki", _WIKI_LINK, self._wiki_link, s)
        if "{|" in s:
            s = sub("wiki", _WIKI_TABLE, self._wiki_table, s)
        if "{{" in s:
            s = self._wiki_templates(s)
        if "==" in s:
            s = sub("wiki", _WIKI_HEAD, lambda m: "\n" + "#" * len(m.group(1)) + f" {m.group(2)}\n", s, heading=True)
        if "''" in s:
            s = sub("wiki", _WIKI_QUOTES, r"\2", s)
        if "__" in s:
            s = sub("wiki", _WIKI_SWITCH, "", s)
        if "\\" in s and _COMMAND.search(s):
            add("latex")
            s = self._latex(s)
        if "&" in s:
            s = _REF.sub(lambda m: html.unescape(m.group()) if _known_ref(m) else m.group(), s).replace("\xa0", " ")
        if "|" in s and "--" in s:
            s = sub("markdown", _MD_TABLE, self._md_table, s)
        if "[" in s:
            s = sub("markdown", _MD_TASK, r"\1- ", s, listing=True)
            s = sub("markdown", _MD_IMAGE, r"\1", s)
            s = sub("markdown", _MD_LINK, r"\1", s)
            s = sub("markdown", _MD_NOTE, "", s)
            s = sub("markdown", _MD_REFDEF, "", s)
        if "<" in s:
            s = sub("markdown", _MD_AUTO, lambda m: m.group()[1:-1], s)
        if "*" in s or "__" in s:
            s = sub("markdown", _MD_RULE, "", s)
            s = sub("markdown", _MD_STRONG, lambda m: m.group(2) or m.group(4), s)
        if "*" in s or "_" in s:
            s = sub("markdown", _MD_EM, lambda m: m.group(1) or m.group(2), s)
        if "~~" in s:
            s = sub("markdown", _MD_STRIKE, r"\1", s)
        if ">" in s:
            s = sub("markdown", _MD_QUOTE, "", s)
        if "==" in s or "--" in s:
            s = sub("markdown", _MD_SETEXT, lambda m: ("\n# " if m.group(2)[0] == "=" else "\n## ") + self.keep(m.group(1)) + "\n", s, heading=True)
            s = sub("markdown", _MD_RULE, "", s)
        return s

    def _sub(self, kind: str, pattern: re.Pattern, to, s: str, heading: bool = False, listing: bool = False) -> str:
        new, n = pattern.subn(to, s)
        if n:
            self.kinds.add(kind)
            self.structure = getattr(self, "structure", 0) + n if heading or listing else getattr(self, "structure", 0)
        return new

    def _wiki_templates(self, s: str) -> str:
        """Takes templates out; double braces that open the argument of a LaTeX command, or start with one, are no template."""

        def to(m: re.Match) -> str:
            nonlocal n
            if s[m.start() + 2 : m.end()].lstrip().startswith("\\") or _LATEX_BEFORE.search(s, s.rfind("\n", 0, m.start()) + 1, m.start()):
                return m.group()
            n += 1
            return ""

        n = 0
        out = _WIKI_TEMPLATE.sub(to, s)
        if n:
            self.kinds.add("wiki")
        return out

    def _wiki_link(self, m: re.Match) -> str:
        body = m.group()[2:-2]
        space, colon, _ = body.partition(":")
        if colon and space.strip().lower() in ("file", "image", "category", "datei", "bild", "kategorie", "файл", "изображение", "категория", "категорія", "archivo", "categoría", "ficheiro", "categoria", "ファイル", "カテゴリ", "文件", "分类"):
            return body.rsplit("|", 1)[1] + "\n" if "|" in body and not space.strip().lower().startswith(("cat", "kat", "кат", "カテ", "分类")) else ""
        return body.rsplit("|", 1)[-1]

    def _wiki_table(self, m: re.Match) -> str:
        rows = []
        for line in m.group().split("\n"):
            line = line.strip()
            if line.startswith(("{|", "|}", "|-")):
                continue
            rows.append(re.sub(r"^[|!+]+\s*", "", line).replace("||", " | ").replace("!!", " | "))
        return "\n" + "\n".join(rows) + "\n"

    def _md_table(self, m: re.Match) -> str:
        lines = [x.strip().strip("|").strip() for x in m.group().split("\n")]
        return "\n".join(re.sub(r"\s*\|\s*", " | ", x) for i, x in enumerate(lines) if i != 1)

    def _latex(self, s: str) -> str:
        s = re.sub(r"\\begin\{(?:itemize|enumerate|description)\}|\\end\{[A-Za-z]+\*?\}|\\begin\{[A-Za-z]+\*?\}(?:\[[^\]]*\]|\{[^}]*\})*", "\n", s)
        s = re.sub(r"\\item\s*(?:\[([^\]]*)\])?\s*", lambda m: "\n- " + (f"{m.group(1)} " if m.group(1) else ""), s)
        s = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * (1 + max(0, ["chapter", "section", "subsection", "subsubsection", "paragraph"].index(m.group(1)) if m.group(1) != "part" else 0)) + f" {m.group(2)}\n", s)
        s = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref|label|pageref|index|bibliography[a-z]*|usepackage|documentclass)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", s)
        s = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", s)
        n = 1
        while n:  # from the innermost command outwards
            s, n = re.subn(r"\\[A-Za-z]+\*?\s?(?:\[[^\]\n]*\])*\{([^{}]*)\}", r"\1", s)
        s = re.sub(r"\\([%&#$_{}])", r"\1", s)
        return re.sub(rf"(?<![\w:\\])\\(?:{'|'.join(COMMANDS.split())})(?![A-Za-z])\s?", "", s)


_ATTRIBUTES = re.compile(r"<(/?\w+)[^<>]*>")
_DIGITS = re.compile(r"\d+")


def _shape(element: str) -> str:
    """An element as its recurrence is counted: tags without attributes, folded text, numbers alike, white space single."""
    return " ".join(_DIGITS.sub("#", _ATTRIBUTES.sub(r"<\1>", element).casefold()).split())


def read_markup(text: str | None) -> tuple[list[str], list[tuple[list[int], str]]]:
    """(kinds, pieces): the kinds of markup in a text, and its clean text in pieces with the hashes of the block subtrees they stand in."""
    if text is None:
        return [], []
    text = text.replace("\r\n", "\n")
    if not _HINT.search(text):
        return [], [([], text)]
    r = _Reader(text)
    r.protect()
    if _MD_HEAD.search(r.text):
        r.kinds.add("markdown")
    if any(not _MONTH.match(r.text, m.end()) for m in _MD_LIST.finditer(r.text)):
        r.kinds.add("markdown")
    out = [(over, r.clean(body)) for over, body in r.pieces()]
    done = [(over, r.restore(r.restore(s))) for over, s in out]
    return [k for k in KINDS if k in r.kinds], [(over, s) for over, s in done if s]


_READ = T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("over", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])))])


def _read(texts: pd.Series) -> pd.DataFrame:
    kinds, pieces = [], []
    for t in texts:
        k, p = read_markup(t)
        kinds.append(k)
        pieces.append([{"over": over, "text": s} for over, s in p])
    return pd.DataFrame({"kinds": kinds, "pieces": pieces})


def clean_markup(fields: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(tbl, row_id, field, kinds, clean_text, n_template): clean text of every field, and the kinds of markup it held.

    fields: (tbl, row_id, field, host, page, content). Method: markup is read into a tree; every block
    subtree with several children (BLOCKS) is hashed; the pages of each host that hold a subtree are counted in
    Spark; subtrees on at least min_share of the host's pages are site template and are deleted, whatever the
    size of the table. Subtrees are the same if their tags are and their text is but for letter case and numbers, so an
    attribute that marks the page one is on, or a counter, doesn't hide a menu. Hosts with fewer than RECURRING pages show no recurrence and keep everything. What remains
    keeps its structure: "# " headings, "- " lists, fenced code, $ formulas; tables become rows with " | ".

    The counts join back on (host, hash, salt): the recurring subtrees, few for each host (at most the number of
    subtrees a page holds on average, divided by min_share), are repeated for each salt, so a subtree that a third
    of all rows holds is spread. Null content gives no kinds and null text; blank content stays blank; repeated
    rows are cleaned each; a null host is a host of its own.
    """
    salts = 8
    own = fields.select("tbl", "row_id", "field", F.coalesce("host", F.lit("")).alias("_host"), F.coalesce("page", F.lit("")).alias("_page"), "content")
    read = spread(own).select("tbl", "row_id", "field", "_host", "_page", F.col("content").isNull().alias("_null"), F.pandas_udf(_read, _READ)("content").alias("_r"))
    # every text is read once: the counts below and the clean text both come from what is written here
    read = materialize(read, "markup-read")
    held = read.select("tbl", "row_id", "field", "_host", "_page", F.explode(F.array_distinct(F.flatten("_r.pieces.over"))).alias("_hash"))
    per_hash = held.select("_host", "_page", "_hash").distinct().groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    pages = own.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    template = per_hash.join(pages, "_host").filter((F.col("_pages") >= RECURRING) & (F.col("_n") >= min_share * F.col("_pages")))
    salted = template.select(F.col("_host").alias("_th"), F.col("_hash").alias("_tx"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_ts"))
    hits = held.withColumn("_salt", F.pmod(F.xxhash64("tbl", "row_id", "field"), F.lit(salts)).cast("int"))
    hits = hits.join(salted, (F.col("_host") == F.col("_th")) & (F.col("_hash") == F.col("_tx")) & (F.col("_salt") == F.col("_ts")), "left_semi")
    per_row = hits.groupBy("tbl", "row_id", "field").agg(F.collect_set("_hash").alias("_gone"))
    out = read.join(per_row, ["tbl", "row_id", "field"], "left")
    pieces = F.col("_r.pieces")
    kept = F.when(F.col("_gone").isNull(), pieces).otherwise(F.filter(pieces, lambda p: ~F.arrays_overlap(p["over"], F.col("_gone"))))
    text = F.array_join(F.transform(kept, lambda p: p["text"]), "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    # a deleted subtree was markup of the field as well
    kinds = F.when(F.size("_gone") > 0, F.array_union("_r.kinds", F.array(F.lit("html")))).otherwise(F.col("_r.kinds"))
    return out.select("tbl", "row_id", "field", kinds.alias("kinds"), F.when(~F.col("_null"), F.regexp_replace(text, r"\A\s+|\s+\z", "")).alias("clean_text"), F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).alias("n_template"))


def text_fields(candidates: DataFrame, search_hits: DataFrame) -> DataFrame:
    """The three fields with markup as (tbl, row_id, field, host, page, content)."""

    def host(c: str) -> Column:
        return F.substring_index(c, "/", 1)

    def of(df: DataFrame, tbl: str, key: str, field: str, page: str) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.lit(field).alias("field"), host(page).alias("host"), F.col(page).alias("page"), F.col(field).alias("content"))

    return of(candidates, "candidates", "pair_id", "source_content", "source_path").unionByName(of(candidates, "candidates", "pair_id", "target_content", "target_path")).unionByName(of(search_hits, "search_hits", "hit_id", "text", "file_path"))
