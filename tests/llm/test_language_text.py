"""Sentences, languages, markup, residue and prompt pairs."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm import language as L, markup as M, pairs as P, residue as R, sentences as S


def units(text):
    ends = S.boundaries(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize(
    "expected",
    [
        ["Dr. Low of X & Sons Ltd. tested it at 35.56 volts.", "On most days it ran."],
        ['"Is it ready?" Ann asked before noon.', "Next."],
        ["“We sold it!” said Mrs. Ray, “and we kept that.”", "Nobody knew."],
        ["It closed at 6 p.m.", "When the frost came, J. R. Vale left (incl. the dog) ... or so Kim says."],
        ["„Wo ist es?“, fragte Anna.", "Er schrieb: „Es läuft. Aber nicht gut.“", "Am 23. März 1886 ging es, d. h. spät, z. B. für 9,2 Mio. Taler.", "Gut."],
        ["«Где он?» — спросил Пётр.", "И. О. Лебедев передал его городу, см. рис. 1 и т. д.", "В 1870 г. инж. Попов писал."],
        ["Ana escribió: «Funciona. Pero no muy bien».", "—¿Y el horno? —preguntó Juan.", "El Sr. Gil vendió mesas, sillas, etc. antes de 1984.", "Fin."],
        ["他们在7点走了……后来又回来。", "“在哪里？”李一边锁门一边问。", "他写道：“能用。但是不好用。”", "好。"],
        ["「直ったのか？」と彼は尋ねた。", "重さは約30.0キロだ！", "春だ"],
        ['"कहाँ है?" मोहन ने पूछा।', "प्रो. राव 59.3 किलो का है।", "ठीक।"],
        ["ไม่มีใครรู้ว่าทำไม", "คุณ Ann เก็บไว้ 22 ชิ้น", "เราขายแล้ว"],
    ],
)
def test_sentences(expected):
    sep = "" if any("぀" <= c <= "鿿" for c in expected[0]) else " "
    assert units(sep.join(expected)) == expected


def test_headings_breaks_and_positions(spark, rows):
    assert units("Repairs\n1905–1992\nSome readers think that the\nrope walk burned.\nAnother") == ["Repairs", "1905–1992", "Some readers think that the\nrope walk burned.", "Another"]
    assert units("First part\n\nSecond.No space.") == ["First part", "Second.", "No space."]
    for t in (None, "", "  \n "):
        assert S.boundaries(t) == []
    long = "The mill stood still. " * 20_000
    assert len(S.boundaries(long)) == 20_000 and S.boundaries(long)[-1] == len(long) - 1
    df = spark.createDataFrame([(1, "Ä 😀. B.", "x"), (1, "Ä 😀. B.", "x"), (2, None, None)], "id int, t string, unit_no string")
    assert rows(S.sentence_units(df, "t", "id")) == [(1, 0, 0, 4), (1, 0, 0, 4), (1, 1, 4, 7), (1, 1, 4, 7)]
    assert S.sentence_units(df.limit(0), "t", "id").count() == 0


TEXTS = {
    "en": "The mill was built by the river and nobody knows why it stopped. When the frost came, they used the wheel to keep it running.",
    "de": "Die Mühle wurde am Fluss gebaut und niemand weiß, warum sie stehen blieb. Als der Frost kam, hat man das Rad mit der Hand gedreht.",
    "es": "El molino fue construido junto al río y nadie sabe por qué se paró. Cuando llegó el frío, usaron la rueda para mover el agua.",
    "pt": "O moinho foi construído junto ao rio e ninguém sabe por que parou. Quando chegou o frio, usaram a roda para não deixar a água.",
    "ru": "Мельница была построена у реки, и никто не знает, почему она стоит. Когда пришёл мороз, мы крутили колесо рукой.",
    "uk": "Млин збудували біля річки, і ніхто не знає, чому він зупинився. Коли прийшов мороз, ми крутили колесо рукою, бо не було води.",
    "zh": "磨坊建在河边，没有人知道它为什么停了。天冷的时候我们用手转动轮子。",
    "ja": "水車小屋は川のそばに建てられ、なぜ止まったのかは誰も知らない。寒くなると手で回した。",
    "hi": "चक्की नदी के किनारे बनाई गई थी और कोई नहीं जानता कि वह क्यों रुक गई।",
    "th": "โรงสีสร้างขึ้นริมแม่น้ำและไม่มีใครรู้ว่าทำไมมันจึงหยุด",
}


@pytest.fixture(scope="module")
def identifier(spark):
    rows_ = [(i, t, lang) for i, (lang, t) in enumerate((k, v) for k, v in TEXTS.items() for _ in range(3))]
    rows_ += [(1000, TEXTS["en"], "de"), (1001, None, "en"), (1002, "", None)]
    return L.fit_identifier(spark.createDataFrame(rows_, "id int, t string, l string"), "t", "l", "id")


def test_forward_sums_all_segmentations():
    m = L.UnigramModels({"ab": (0.5,) * 10, "a": (0.25,) * 10, "b": (0.125,) * 10})
    import math

    assert abs(m._score("ab", ("en",))[0] - math.log(0.5 + 0.25 * 0.125 + (0.25 + m.FLOOR) * m.FLOOR + m.FLOOR * 0.125)) < 1e-4
    assert math.isfinite(m._score("ab" * 4000, ("en",))[0])


def test_languages(spark, rows, identifier):
    for lang, t in TEXTS.items():
        assert {x for _, _, x, _ in identifier.text(t)} == {lang}, lang
    held_out = {"en": "This was not what they had built for the river.", "es": "Nadie usaba la rueda cuando llegó el agua del río.", "pt": "Ninguém usava a roda quando chegou a água do rio.", "uk": "Ніхто не крутив колесо, бо прийшла вода."}
    for lang, t in held_out.items():
        assert identifier.sentence(t)[0] == lang
    mixed = TEXTS["en"] + "\n\n" + TEXTS["de"]
    segs = identifier.text(mixed)
    assert [x for _, _, x, _ in segs] == ["en", "de"] and segs[0][0] == 0 and segs[-1][1] == len(mixed) and segs[0][1] == segs[1][0]
    assert [x for _, _, x, _ in identifier.text("The mill (“водяное колесо”) was built by the river.")] == ["en"]
    for t in (None, "", "12 34", "…"):
        assert identifier.text(t) == []


def test_wrong_labels(spark, rows, identifier):
    c = spark.createDataFrame([(1, "a", TEXTS["en"]), (2, "a", TEXTS["en"] + "\n\n" + TEXTS["ru"]), (3, "b", TEXTS["de"]), (4, "c", TEXTS["es"]), (5, "none", TEXTS["th"]), (6, "b", None), (7, "a", TEXTS["de"])], "chunk_id int, vault string, text string")
    v = spark.createDataFrame([("a", "EN-us"), ("b", "ger"), ("c", "und")], "vault string, lang string")
    assert rows(L.wrong_labels(c, v, identifier)) == [(2, "en"), (2, "ru"), (4, "es"), (5, "th"), (7, "de")]
    assert L.wrong_labels(c.limit(0), v, identifier).count() == 0


MARKED = [
    ("<p>x", ["html"]), ("a &lt;b&gt;c&lt;/b&gt;", ["html"]), ("x&nbsp;y", ["html"]), ('<img src="a" alt="b"\n\nx', ["html"]), ("<!-- nav -->x", ["html"]),
    ("# Head\n\nx", ["markdown"]), ("Head\n----\nx", ["markdown"]), ("**x** y", ["markdown"]), ("_x_ y", ["markdown"]), ("- x\n- y", ["markdown"]), ("- [ ] x", ["markdown"]), ("`x`", ["markdown"]), ("[x](y.md)", ["markdown"]), ("> x", ["markdown"]), ("| a | b |\n| --- | --- |\n| c | d |", ["markdown"]), ("x[^1]", ["markdown"]), ("```\n<b> {{x}} $a_b$\n```", ["markdown"]), ("1. x", ["markdown"]), ("~~x~~", ["markdown"]),
    ("[[a|b]] x", ["wiki"]), ("== H ==\nx", ["wiki"]), ("''x'' y", ["wiki"]), ("x {{cite|a=1}}", ["wiki"]), ('{| class="w"\n|-\n| a\n|}', ["wiki"]), ("__NOTOC__\nx", ["wiki"]),
    (r"\textbf{x}", ["latex"]), (r"$x_{1} = \frac{a}{b}$", ["latex"]), (r"where \(\lambda \le 2\) holds", ["latex"]), ("$$\\sum_{i} w_i$$", ["latex"]), ("\\begin{itemize}\n\\item x\n\\end{itemize}", ["latex"]),
    ("(3 < 5)", []), ("10 > 9", []), ("$40 to $55", []), ("a_b_c", []), ("5 * 3 * 2", []), ("C:\\new\\list", []), ("holds it all [1]", []), ("{see the next page}", []), ("R&D & co.", []), ("Line #3 on the C# list", []), ("a == b, stop => c", []), ("~40 %", []), ("file_a_log", []), ("'x'", []), (None, []), ("", []),
]


@pytest.mark.parametrize("text,kinds", MARKED)
def test_markup_kinds(text, kinds):
    assert M.read_markup(text)[0] == kinds


TEMPLATES = [
    ("x \\footnote{a}\n\ny.{{cite note|title=b|year=1957}}", ["wiki", "latex"], "x  (a)\n\ny."), ("see \\emph{a} b {{cite|b=1}} c", ["wiki", "latex"], "see a b  c"), ("C:\\new\\list {{stub}}", ["wiki"], "C:\\new\\list "),
    ("{{cite|a=1}} \\textbf{{b}}", ["wiki", "latex"], None), ("x \\textbf{{b}} y", ["latex"], None), ("x \\section[a]{{b}} y", ["latex"], None), ("{{\\bf b}} C:\\x", [], None), ("$\\frac{{a}}{{b}}$", ["latex"], None),
]


@pytest.mark.parametrize("text,kinds,clean", TEMPLATES)
def test_templates_beside_backslashes(text, kinds, clean):
    got, pieces = M.read_markup(text)
    assert got == kinds and (clean is None or "".join(s for _, s in pieces) == clean)


def test_clean_markup_keeps_structure_and_drops_template(spark):
    page = "<h2>Head</h2><ul><li>one</li><li>two</li></ul><pre>a < b</pre>\n\n$x^2$ and **bold**"
    rows_ = [("c", i, "f", "h", f"h/{i}", "<nav>Home <b>About</b></nav>Own text number %d" % i) for i in range(30)]
    rows_ += [("c", 99, "f", "h", "h/99", page), ("c", 100, "f", None, None, None), ("c", 101, "f", "g", "g/1", "<nav>Home <b>About</b></nav>Other"), ("c", 102, "f", "g", "g/1", "")]
    df = spark.createDataFrame(rows_, "tbl string, row_id int, field string, host string, page string, content string")
    got = {r.row_id: r for r in M.clean_markup(df).collect()}
    assert len(got) == 34
    assert got[5].clean_text == "Own text number 5" and got[5].n_template > 0
    assert got[101].clean_text == "Home About\nOther" and got[101].n_template == 0  # rare on its host
    assert got[99].clean_text.startswith("## Head\n\n") and "- one\n- two" in got[99].clean_text and "```\na < b\n```" in got[99].clean_text and got[99].clean_text.endswith("$x^2$ and bold")
    assert got[100].clean_text is None and got[100].kinds == [] and got[102].clean_text == ""
    assert M.clean_markup(df.limit(0)).count() == 0


def test_clean_markup_is_the_same_at_two_sizes(spark):
    nav = '<div class="menu"><a>Home</a> <a>About</a></div>'
    parts = ("<h2>Background</h2>", "<ul><li>mill</li><li>mill</li></ul>", "<table><tr><th>Repairs</th><td>none</td></tr></table>", "<p>by <code>run()</code></p>")
    got = []
    for n in (12, 120):
        rows_ = [("c", i, "f", "h", f"h/{i}", f"{nav}{parts[i % 4]} own text <h3>Notes</h3>") for i in range(n)]
        rows_ += [("c", n + i, "f", None, None, f"{nav}{parts[i]} own text <h3>Notes</h3>") for i in range(4)] + [("c", n + 4 + i, "f", "few", f"few/{i}", nav) for i in range(2)]
        out = {r.row_id: r for r in M.clean_markup(spark.createDataFrame(rows_, "tbl string, row_id int, field string, host string, page string, content string")).collect()}
        got.append({out[i].clean_text for i in range(n)})
        assert all(out[i].n_template == 1 and "Home" not in out[i].clean_text and out[i].clean_text.endswith("### Notes") for i in range(n))
        assert all(out[i].n_template == 0 and "Home About" in out[i].clean_text for i in range(n, n + 6))
    assert got[0] == got[1] and len(got[0]) == 4
    assert all(any(w in t for t in got[0]) for w in ("## Background", "- mill\n- mill", "Repairs | none", "by run()"))


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Please enable JavaScript to view this page.", "script_notice"), ("Mill\n\nBITTE AKTIVIEREN SIE JAVASCRIPT, UM DIESE SEITE ANZUZEIGEN.\n© notes service", "script_notice"),
        ("404 Not Found\nThe page /notes/x-1 could not be found on this server.", "error_page"), ('Traceback (most recent call last):\n  File "sync.py", line 5, in load\nKeyError: \'d0d254a24a\'', "error_page"), ("Ошибка 404. Страница /notes/a-1 не найдена.", "error_page"),
        ("Lorem ipsum dolor sit amet. Magna dolor velit cupidatat officia nostrud.", "filler"), ("blah blah blah\nblah blah blah", "filler"),
        ("Real note about the mill. {{date}} the wheel was oiled and nobody wrote down why.", "placeholder"), ("[INSERT TITLE HERE]", "placeholder"), ("<%= author %> wrote it.", "placeholder"), ("Hello (your name here)", "placeholder"),
        ("In a template the mark `{{title}}` stands for the file name.", None), ("The set {a, b} has two members.", None), ("The viewer asks people to enable JavaScript, which Ann thinks is a poor choice.", None),
        ("Printers have used lorem ipsum as filler for a long time; Ann set 3 pages of it.", None), ("The phrase “page not found” appears 8 times in the log.", None), ("The mill stood still.", None), ("", None), (None, None),
    ],
)
def test_residue(text, kind):
    assert R.ResidueIndex().kind(text) == kind


def test_residue_over_a_table(spark, rows):
    d = spark.createDataFrame([(1, "404 Not Found", "x"), (2, "404 Not Found", None), (3, None, None), (4, "A real note about the old mill.", "k")], "doc_id int, text string, kind string")
    assert rows(R.content_free(d)) == [(1, "error_page"), (2, "error_page")]
    assert R.content_free(d.limit(0)).count() == 0
    assert R.ResidueIndex().kind("The mill stood still near the river. " * 20_000 + "404 Not Found") is None


Q = "Why did Ann move the old mill next to the river in 1905?"
ANSWERS = [
    (None, "empty"), ("", "empty"), ("\u00a0\u200b", "empty"), ("N/A", "empty"), ("<answer></answer>", "empty"), ("(no answer)", "empty"), ("...", "empty"),
    ("I'm sorry, but I can’t help with that question.", "refusal"), ("insufficient context - cannot determine", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("There was not enough information on the mill in 1871; Ann therefore measured it again.", None),
    (Q, "copied"), (Q.upper(), "copied"), (Q + " " + Q, "copied"), ("You ask why did Ann move the old mill next to the river in 1905.", "copied"), ("Good question! " + Q, "copied"), (Q + " The river froze and the wheel stood still.", None),
    ("Die Mühle wurde umgebaut, weil der Fluss zu langsam war.", "other_language"), ("Мельницу перестроили, потому что река замёрзла.", "other_language"), ("The river (“река замёрзла”) froze and the wheel stood still.", None),
    ("The wheel stood still because of the", "truncated"), ("1. The wheel stood still.\n2. ", "truncated"), ("The wheel stood (see", "truncated"), ("Yes", None), ("The old mill", None), ("In 1905", None), ("The wheel stood still near the river", None),
]


def test_pairs(spark):
    corpus = ["The river froze and the wheel stood still near the river. The wheel stood still near the river."] * 5
    rows_ = [(i, Q, a) for i, (a, _) in enumerate(ANSWERS)] + [(100 + i, Q, a) for i, a in enumerate(corpus)] + [(200, None, "The wheel stood still near the river."), (201, "Quote the German sentence about the mill.", "Die Mühle wurde umgebaut, weil der Fluss zu langsam war.")]
    got = dict(P.broken_pairs(spark.createDataFrame(rows_, "qa_id int, question string, answer string").withColumn("defect", F.lit(1)), "qa_id").collect())
    for i, (a, want) in enumerate(ANSWERS):
        assert got.get(i) == want, (a, got.get(i))
    assert 200 not in got and 201 not in got and not set(range(100, 105)) & set(got)
    assert P.broken_pairs(spark.createDataFrame([], "qa_id int, question string, answer string"), "qa_id").count() == 0


def test_suffix_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        p, r = [rng.choice("abc") for _ in range(12)], [rng.choice("abcd") for _ in range(20)]
        subs = {tuple(p[i:j]) for i in range(12) for j in range(i, 13)}
        want = [max(n for n in range(i + 2) if tuple(r[i + 1 - n : i + 1]) in subs) for i in range(20)]
        assert P.SuffixAutomaton(p).longest_matches(r) == want


def test_sentence_abbreviations_before_numbers_and_line_breaks():
    assert units("The label reads v.\n18.4.1, see fig. 2 for details. I said no. Then it went.") == ["The label reads v.\n18.4.1, see fig. 2 for details.", "I said no.", "Then it went."]
    assert units("According to Dr.\nVel it can be trusted.A short test. He has a Ph.D in it.") == ["According to Dr.\nVel it can be trusted.", "A short test.", "He has a Ph.D in it."]
    assert units("น้ำหนักคือประมาณ 27.8 กิโลกรัมซึ่งหนัก ดร. Kin เขียน") == ["น้ำหนักคือประมาณ 27.8 กิโลกรัมซึ่งหนัก", "ดร. Kin เขียน"]


def test_residue_in_words_of_its_own_and_beyond_old_bounds():
    index = R.ResidueIndex()
    for text, kind in [
        ("The server is down for maintenance. Please try again later.", "error_page"), ("You don't have permission to open this page.", "error_page"), ("Die Sitzung ist leider abgelaufen, melden Sie sich bitte an.", "error_page"),
        ("Scripts are off: turn them on in your browser and reload.", "script_notice"), ("Для работы сайта включите JavaScript в браузере.", "script_notice"), ("Placeholder text, please replace later.", "filler"),
        ("We read “" + "page not found " * 12 + "” on the old screen, and nobody in the archive knew which of the many clocks had shown it or what for.", None),
        ("The note says “{{" + "title of the note " * 8 + "}}” as a joke.", None), ("A real note. {{" + "title of the note " * 8 + "}} It goes on.", "placeholder"),
        ("This page could not be found on this server. " * 30, "error_page"),
    ]:
        assert index.kind(text) == kind, text


def test_refusals_are_whole_phrases_without_an_answer_behind_them():
    for t in (
        "As an airline pilot she flew to Rome every week.", "As an aim of the project, the mill was moved.", "Photosynthesis works best in the given context of strong light and water.", "Эта сеть ведёт себя как модель мозга и учится.",
        "Я не могу сказать точно, но столица Франции — Париж.", "I can't answer that exactly, but the mill was moved in 1905.", "The sign said “I cannot answer that question” in red.", "Das darf ich nicht vergessen: die Mühle steht am Fluss.",
    ):
        assert not P.is_refusal(t), t
    for t in ("As an AI, I can't share this.", "I'm sorry, but I can't help with that question.", "I cannot answer this, but you can ask someone else.", "Извините, но я не могу ответить на этот вопрос.", "抱歉，我无法回答这个问题。", "Leider darf ich nicht besprechen, was dort steht."):
        assert P.is_refusal(t), t


def test_a_long_last_sentence_keeps_its_start():
    words = "the wheel turned and the river ran " * 20
    assert P.last_tokens("It began. " + words + "because of")[0] == "" and P.last_tokens("It began. Near the mill")[0] == "<s>"
    assert P.last_tokens("mill" * 200)[0] == "<s>"  # one word longer than any window


def test_template_with_small_differences_goes_and_recurring_words_stay(spark):
    menu = lambda i: "<nav>" + "".join(f'<a href="/{n}"{" class=active" if n == i % 3 else ""}>Part {n}</a>' for n in range(3)) + f"<i>{i} visitors</i></nav>"
    rows_ = [("c", i, "f", "h", f"h/{i}", f"{menu(i)}<p>The <b>mill</b> text {'abcdefgh'[i]}</p>") for i in range(8)]
    out = M.clean_markup(spark.createDataFrame(rows_, "tbl string, row_id int, field string, host string, page string, content string")).collect()
    assert {r.clean_text for r in out} == {f"The mill text {c}" for c in "abcdefgh"} and all(r.n_template == 1 and r.kinds == ["html"] for r in out)


def test_markup_beyond_old_bounds():
    assert M.read_markup("x &lt;a href=" + "y" * 400 + "&gt;z")[0] == ["html"]
    assert M.read_markup("$a_{1} + " + "b + " * 100 + "c$")[0] == ["latex"]
    deep = "\\textbf{" * 9 + "x" + "}" * 9
    assert "".join(t for _, t in M.read_markup(deep)[1]) == "x"
