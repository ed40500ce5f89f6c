"""Text scalars over notes: Column in, Column out, all of it inside code generation unless marked otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

LINK_HEADER = "\n\n## Related Connections\n\n"
# Relation names a link may have by default (fixed values).
LINK_TYPES = ["Is a", "Part of", "Uses", "Solves", "Originates from", "Precedes", "Influences", "Contradicts", "Compared with", "Mentions"]
# Words left out of full-text queries (fixed values).
QUERY_STOPWORDS = "the and for are was were has had have his her its our their this that these those with from into upon what when who how did not but all can also than как что это был была были его её они все при для над под или уже еще ещё вот так где там тем тот та те".split()
# Headings behind which an encyclopedia page holds no text of its own (fixed values).
STOP_SECTIONS = ["См. также", "Литература", "Примечания", "Ссылки", "See also", "References", "Notes", "External links", "Bibliography", "Further reading"]
# Function words that belong to a phrase (fixed values).
PHRASE_WORDS = ["без", "не", "ни", "с", "по", "для", "из", "от", "до", "под", "над", "через", "между", "против", "вне", "при", "without", "not", "with", "by", "according to", "for", "from", "of", "before", "until", "under", "over", "through", "between", "against", "outside", "at", "during"]
NO_CONTEXT = "No relevant context found."

# Formats of links in notes (fixed values): "- relation:: [[target]]" anywhere, [[target|label]], a link line with any list mark.
TYPED_LINK = r"(?d)-?\s*(.+?)\s*::\s*\[\[\s*(.+?)\s*\]\]"
WIKILINK = r"\[\[\s*([^\]|\n]+)(?:\|[^\]]+)?\s*\]\]"
LINE_LINK = r"(?md)^\s*(?:[-*+]\s+)?([^\n]*?)\s*::\s*\[\[([^\n]*?)\]\]"
TOKEN = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """All white space off both ends (trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def note_body(content: Column, header: str = LINK_HEADER) -> Column:
    """The part before the first link header, right-trimmed; the whole content where there is none."""
    return F.when(content.contains(header), rstrip(F.substring_index(content, header, 1))).otherwise(content)


def note_links(content: Column, header: str = LINK_HEADER) -> Column:
    """The part behind the last link header, trimmed; empty where there is none."""
    return F.when(content.contains(header), strip(F.substring_index(content, header, -1))).otherwise(F.lit(""))


def cut_at(content: Column, header: str = LINK_HEADER) -> Column:
    """Content before the header, untrimmed."""
    return F.substring_index(content, header, 1)


def content_hash(c: Column) -> Column:
    return F.sha2(normalise_newlines(c), 256)


def pair_key(source: Column, target: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("|", source, target, content))


def _pairs(text: Column, pattern: str) -> Column:
    first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(first, second, lambda r, t: F.struct(F.trim(r).alias("relation"), F.trim(t).alias("target")))


def typed_links(text: Column) -> Column:
    """array<struct<relation, target>> of "- relation:: [[target]]" anywhere in the text."""
    return _pairs(text, TYPED_LINK)


def line_links(text: Column) -> Column:
    """array<struct<relation, target>> of link lines with any list mark, one a line."""
    return _pairs(text, LINE_LINK)


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]] in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda t: F.trim(t))


def split_label(target: Column) -> Column:
    """struct<name, label> of a link target "name|label"; label is null where there is none."""
    return F.struct(F.substring_index(target, "|", 1).alias("name"), F.when(F.contains(target, F.lit("|")), F.substring(target, F.instr(target, "|") + 1, F.length(target))).alias("label"))


def clean_for_model(text: Column, header_line: str = "## Related Connections") -> Column:
    """Front matter, everything from the link header on, and link lines removed; three or more newlines squeezed; trimmed."""
    c = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    if header_line.strip():
        c = F.regexp_replace(c, r"(?imsd)^\s*\Q" + header_line.strip() + r"\E\s*$.*\z", "")
    c = F.regexp_replace(c, r"(?md)^\s*(?:[-*+]\s+)?[^\n:]{1,120}::\s*\[\[[^\]]+\]\]\s*$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def reference_text(text: Column) -> Column:
    """A note as reference context: without front matter and without a closing section of links."""
    c = strip(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", ""))
    return strip(F.regexp_replace(c, r"(?imsd)^\s*#{1,3}\s*(?:Related Connections|Connections|Links)\s*$.*\z", ""))


def clean_wiki(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", ""), r"\n{3,}", "\n\n"))


def strip_stop_sections(text: Column) -> Column:
    """The text before the first closing section of an encyclopedia page."""
    heads = "|".join(rf"\Q{s}\E" for s in STOP_SECTIONS)
    return strip(F.regexp_replace(text, r"(?imsud)^(?:#{1,6}\s+|={1,6}\s*)?(?:" + heads + r")(?:\s*[:\-])?\s*$.*\z", ""))


def file_name(title: Column, apostrophes: bool = True) -> Column:
    """A page title as file name; apostrophes=False drops them as well."""
    c = F.replace(F.replace(F.replace(strip(title), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-")), F.lit('"'), F.lit(""))
    return c if apostrophes else F.replace(c, F.lit("'"), F.lit(""))


def spaced(c: Column) -> Column:
    """Underscores to spaces, white space collapsed and trimmed."""
    return strip(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def entity_key(c: Column) -> Column:
    """Case-folded entity name; the sharp s folds to ss as in full case folding."""
    return F.replace(F.lower(spaced(c)), F.lit("ß"), F.lit("ss"))


def title_case(c: Column) -> Column:
    """A capital behind every character that is no letter (initcap looks at white space only)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def node_id(c: Column) -> Column:
    return title_case(spaced(c))


def camel_label(c: Column) -> Column:
    """CamelCase label of a name: parts between underscores, hyphens and spaces capitalised and joined."""
    parts = F.filter(F.split(c, r"(?U)[_\-\s]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def alias_key(c: Column) -> Column:
    """Alias for matching: underscore, backslash and hyphen to space, trimmed, lower case."""
    return F.lower(strip(F.translate(c, "_\\-", "   ")))


def title_of(path: Column) -> Column:
    """The title a file path stands for: its stem with spaces."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.trim(F.replace(stem, F.lit("_"), F.lit(" ")))


def title_summary(path: Column, content: Column) -> Column:
    """Query text of a note: title and first block; a heading block alone wins; a note without text gives its title."""
    title, block = title_of(path), strip(F.substring_index(strip(F.coalesce(content, F.lit(""))), "\n\n", 1))
    return F.when(block == "", title).when(block.startswith("#"), block).when(title == "", block).otherwise(F.concat(title, F.lit("\n"), block))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def lemma_text(c: Column) -> Column:
    """The default lemma provider: lower-case tokens of letters and digits, joined by spaces."""
    return F.array_join(tokens(c), " ")


def lemma_set(c: Column) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: ~t.isin(QUERY_STOPWORDS)))


def phrase_lemmas(c: Column, keep_function_words: bool = False) -> Column:
    """struct<lemmas, head>: lemmas of a phrase without stop words, and its head, the first of them."""
    return phrase_of(tokens(c), keep_function_words)


def phrase_of(lemmas: Column, keep_function_words: bool = False) -> Column:
    """phrase_lemmas of an array of lemmas, whatever made them."""
    drop = [w for w in QUERY_STOPWORDS if not (keep_function_words and w in PHRASE_WORDS)]
    lemmas = F.filter(lemmas, lambda t: ~t.isin(drop))
    return F.struct(lemmas.alias("lemmas"), F.get(F.filter(lemmas, lambda t: ~t.isin(QUERY_STOPWORDS)), 0).alias("head"))


def query_terms(c: Column) -> Column:
    """Terms of a full-text query: tokens of four or more letters or digits, no stop words, each once (compared without case)."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-zА-Яа-яЁё0-9]{4,}"), F.lit(0)), lambda t: F.lower(t))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(QUERY_STOPWORDS)))


def query_string(c: Column) -> Column:
    """The same query spelled out: terms joined by OR, those over five letters also with one edit allowed."""
    raw = F.regexp_extract_all(c, F.lit(r"[A-Za-zА-Яа-яЁё0-9]{4,}"), F.lit(0))
    kept = F.aggregate(
        raw,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(F.lower(t).isin(QUERY_STOPWORDS) | F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))),
    )
    return F.array_join(F.transform(kept, lambda t: F.when(F.length(t) > 5, F.concat(t, F.lit(" OR "), t, F.lit("~1"))).otherwise(t)), " OR ")


def link_line(relation: Column, target_path: Column) -> Column:
    """"- relation:: [[stem]]"."""
    stem = F.regexp_replace(F.substring_index(target_path, "/", -1), r"\.[^.]*$", "")
    return F.format_string("- %s:: [[%s]]", relation, stem)


def prompt_item(number: Column, source: Column, target: Column, contexts: Column) -> Column:
    """One numbered item of a classification prompt: the two notes and their numbered snippets."""
    lines = F.transform(contexts, lambda x, i: F.format_string("  [%d] %s", i + 1, x))
    return F.concat(F.format_string("Item %d\nSource: %s\nTarget: %s\n", number, source, target), F.array_join(lines, "\n"))


def parse_answer(raw: Column) -> Column:
    """The text behind the last <answer> tag up to its end; without the tag, the raw text less any <reasoning> block."""
    tagged = F.regexp_replace(F.element_at(F.split(raw, r"(?i)<answer>"), -1), r"(?is)</answer>.*\z", "")
    plain = F.regexp_replace(raw, r"(?is)<reasoning>.*?(?:</reasoning>|\z)", "")
    return strip(F.when(F.lower(raw).contains("<answer>"), tagged).otherwise(plain))


def join_contexts(contexts: Column) -> Column:
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) <= 0, F.lit(NO_CONTEXT)).otherwise(F.array_join(contexts, "\n\n---\n\n"))


def retry_delay(message: Column, default: float = 30.0) -> Column:
    """Seconds to wait that an error message asks for, and one more; the default where it names none."""
    got = F.regexp_extract(message, RETRY_DELAY, 1)
    return F.when(got != "", got.cast("double") + 1.0).otherwise(F.lit(default))


# Marks of errors that pass by themselves, and of the delay a message asks for (fixed values: formats of the services).
TRANSIENT = "RESOURCE_EXHAUSTED|429|UNAVAILABLE|503"
RETRY_DELAY = r"""retryDelay['"]:\s*['"](\d+(?:\.\d+)?)s['"]"""


def is_transient(message: Column) -> Column:
    return message.rlike(TRANSIENT)


def parse_aliases(content: Column) -> Column:
    """aliases of a front-matter block: a comma-separated string, an inline list or a block list; trimmed, blanks dropped; none where it can't be read."""
    block = F.regexp_extract(normalise_newlines(content), r"(?s)\A---\n(.*?)\n---", 1)
    inline = F.regexp_extract(block, r"(?md)^aliases:[ \t]*(\S[^\n]*)$", 1)
    items = F.regexp_extract(block, r"(?md)^aliases:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*\n?)+)", 1)
    flat = F.split(F.regexp_replace(inline, r"\A\[|\]\s*\z", ""), ",")
    listed = F.regexp_extract_all(items, F.lit(r"(?md)^[ \t]*-[ \t]+([^\n]*)$"), F.lit(1))
    bare = F.transform(F.when(items != "", listed).otherwise(flat), lambda a: F.regexp_replace(strip(a), r"""\A['"]|['"]\z""", ""))
    broken = inline.startswith("[") & ~F.rtrim(inline).endswith("]")
    return F.when(broken, F.array().cast("array<string>")).otherwise(F.filter(bare, lambda a: strip(a) != ""))


_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def lenient_json(raw: Column) -> Column:
    """array<struct<id, relation_type, reasoning>> of a model's output (a Pandas UDF: repair has no built-in).

    A list, an object keyed by number, or an object holding such a list; fences and a leading <think> block are
    skipped, a truncated tail is closed as far as whole objects go; a missing type is null, types are lower-case.
    """
    import json

    import pandas as pd

    def items_of(data) -> list:
        if isinstance(data, dict):
            data = {k: v for k, v in data.items() if k != "thinking"}
            lists = [v for v in data.values() if isinstance(v, list)]
            if len(lists) == 1 and len(data) == 1:
                data = lists[0]
            else:
                data = [v | {"id": int(k)} if isinstance(v, dict) and str(k).isdigit() else v for k, v in data.items()] if all(isinstance(v, dict) for v in data.values()) and data else [data]
        return [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []

    def one(text):
        if not text:
            return []
        text = re.sub(r"(?is)\A\s*<think>.*?</think>", "", text)
        if m := _FENCED.search(text):
            text = m.group(1)
        data = None
        for candidate in (text, text[min((i for i in (text.find("["), text.find("{")) if i >= 0), default=0) :]):
            try:
                data = json.loads(candidate)
                break
            except ValueError:
                continue
        found = items_of(data) if data is not None else []
        if data is None:
            decoder, at = json.JSONDecoder(), 0
            while (at := text.find("{", at)) >= 0:
                try:
                    obj, end = decoder.raw_decode(text, at)
                    found += items_of([obj])
                    at = end
                except ValueError:
                    at += 1
        out = []
        for n, x in enumerate(found):
            rel = x.get("relation_type", x.get("type", x.get("relation")))
            ident = x.get("id", n)
            out.append({"id": int(ident) if str(ident).lstrip("-").isdigit() else n, "relation_type": str(rel).lower() if rel is not None else None, "reasoning": x.get("reasoning")})
        return out

    kind = "array<struct<id: int, relation_type: string, reasoning: string>>"
    return F.pandas_udf(lambda s: pd.Series([one(t) for t in s]), kind)(raw)
