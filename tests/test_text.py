from pyspark.sql import functions as F

from skein.functions import scores as S, text as X, vectors as V

H = X.LINK_HEADER


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_split_keeps_body_before_first_and_links_behind_last_header(spark):
    text = "Body  " + H + "- a:: [[X]]" + H + " - b:: [[Y]] \n"
    assert one(spark, X.note_body(F.col("c")), c=text) == "Body"
    assert one(spark, X.note_links(F.col("c")), c=text) == "- b:: [[Y]]"
    assert one(spark, X.note_body(F.col("c")), c="No header  ") == "No header  "
    assert one(spark, X.note_links(F.col("c")), c="No header") == ""
    assert one(spark, X.cut_at(F.col("c")), c="a  " + H + "b") == "a  "


def test_hash_ignores_line_ends(spark):
    assert one(spark, X.content_hash(F.col("c")), c="a\r\nb") == one(spark, X.content_hash(F.col("c")), c="a\nb")


def test_links(spark):
    got = one(spark, X.typed_links(F.col("c")), c="- Is a:: [[ X ]]\n* Uses :: [[Y|z]]")
    assert [(r.relation, r.target) for r in got] == [("Is a", "X"), ("* Uses", "Y|z")]
    got = one(spark, X.line_links(F.col("c")), c="- Is a:: [[X]]\n+ Uses:: [[Y]]\nplain [[Z]]")
    assert [(r.relation, r.target) for r in got] == [("Is a", "X"), ("Uses", "Y")]
    assert one(spark, X.wikilinks(F.col("c")), c="see [[A]] and [[B|label]] and [[ C ]]") == ["A", "B", "C"]


def test_cleaning(spark):
    text = "---\naliases: x\n---\nText\n- rel:: [[Y]]\n\n\n\nmore\n\n## Related Connections\n- a:: [[b]]\n"
    assert one(spark, X.clean_for_model(F.col("c")), c=text) == "Text\n\nmore"
    assert one(spark, X.reference_text(F.col("c")), c="---\na\n---\nT\n# Links\n- x") == "T"
    assert one(spark, X.clean_wiki(F.col("c")), c=" a[12]\n\n\n\nb ") == "a\n\nb"
    assert one(spark, X.strip_stop_sections(F.col("c")), c="Text\n== see also\nmore") == "Text"
    assert one(spark, X.strip_stop_sections(F.col("c")), c="Текст\n## См. также\nещё") == "Текст"


def test_names(spark):
    assert one(spark, X.title_case(F.col("c")), c="o'neil 3d model") == "O'Neil 3D Model"
    assert one(spark, X.node_id(F.col("c")), c=" big_red  fox ") == "Big Red Fox"
    assert one(spark, X.camel_label(F.col("c")), c="part_of-the WHOLE") == "PartOfTheWhole"
    assert one(spark, X.entity_key(F.col("c")), c=" Große_Straße ") == "grosse strasse"
    assert one(spark, X.file_name(F.col("c")), c=' A/B "c" d ') == "A-B_c_d"
    assert one(spark, X.file_name(F.col("c"), apostrophes=False), c="o'neil") == "oneil"
    assert one(spark, X.alias_key(F.col("c")), c=" A_b\\c-D ") == "a b c d"


def test_title_summary(spark):
    e = X.title_summary(F.col("p"), F.col("c"))
    assert one(spark, e, p="v/My_note.md", c="First block\n\nsecond") == "My note\nFirst block"
    assert one(spark, e, p="v/My_note.md", c="# Head\n\nsecond") == "# Head"
    assert spark.createDataFrame([("v/My_note.md", None)], "p string, c string").select(e.alias("x")).first().x == "My note"


def test_queries_and_lemmas(spark):
    assert one(spark, X.query_string(F.col("c")), c="What about the Stencils with stencils and maps") == "about OR Stencils OR Stencils~1 OR maps"
    assert one(spark, X.query_terms(F.col("c")), c="What about the Stencils with stencils") == ["about", "stencils"]
    assert one(spark, X.lemma_text(F.col("c")), c="A-b, C3!") == "a b c3"
    assert one(spark, X.lemma_set(F.col("c")), c="the cat and the cat") == ["cat"]
    got = one(spark, X.phrase_lemmas(F.col("c")), c="the house with rooms")
    assert (got.lemmas, got.head) == (["house", "rooms"], "house")
    assert one(spark, X.phrase_lemmas(F.col("c"), keep_function_words=True), c="house with rooms").lemmas == ["house", "with", "rooms"]


def test_prompts_and_answers(spark):
    assert one(spark, X.link_line(F.lit("Is a"), F.lit("v/x/Big_note.md"))) == "- Is a:: [[Big_note]]"
    assert one(spark, X.prompt_item(F.lit(2), F.lit("a"), F.lit("b"), F.array(F.lit("s"), F.lit("t")))) == "Item 2\nSource: a\nTarget: b\n  [1] s\n  [2] t"
    assert one(spark, X.parse_answer(F.col("c")), c="<reasoning>x</reasoning> <ANSWER> yes </answer>") == "yes"
    assert one(spark, X.parse_answer(F.col("c")), c="<reasoning>x</reasoning> plain ") == "plain"
    assert one(spark, X.parse_answer(F.col("c")), c="<answer></answer>") == ""
    assert one(spark, X.join_contexts(F.array(F.lit("a"), F.lit("b")))) == "a\n\n---\n\nb"
    assert one(spark, X.join_contexts(F.array().cast("array<string>"))) == X.NO_CONTEXT
    assert one(spark, X.retry_delay(F.lit("'retryDelay': '12s'"))) == 13.0
    assert one(spark, X.retry_delay(F.lit("no"))) == 30.0
    assert one(spark, X.is_transient(F.lit("got 429")))


def test_lenient_json(spark):
    cases = [
        '[{"id": 1, "relation_type": "Is A", "reasoning": "r"}]',
        '```json\n{"0": {"relation_type": "Uses"}, "thinking": "x"}\n```',
        '<think>[1]</think>{"results": [{"relation_type": "Uses"}]}',
        '[{"id": 0, "relation_type": "Uses"}, {"id": 1, "relat',
        "nothing",
        None,
        '[{"id": 9}]',
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: [(x.id, x.relation_type) for x in r.x] for r in df.select("i", X.lenient_json(F.col("c")).alias("x")).collect()}
    assert got == {0: [(1, "is a")], 1: [(0, "uses")], 2: [(0, "uses")], 3: [(0, "uses")], 4: [], 5: [], 6: [(9, None)]}


def test_aliases(spark):
    cases = ["---\naliases: a, b , \n---\nx", "---\naliases: [a, 'b c']\n---\n", "---\naliases:\n  - a\n  - \"b\"\n---\n", "---\naliases: [a, b\n---\n", "no front matter", "---\naliases: 5\n---\n"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r.x for r in df.select(X.parse_aliases(F.col("c")).alias("x")).collect()] == [["a", "b"], ["a", "b c"], ["a", "b"], [], [], ["5"]]


def test_vectors_and_scores(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, V.dot(a, b)) == 4.0 and one(spark, V.squared_l2(a, b)) == 18.0 and one(spark, V.cosine(a, b)) == 0.8
    assert one(spark, V.unit(a)) == [0.6, 0.8]
    assert one(spark, S.f1(F.lit(0), F.lit(0), F.lit(0))) == 0.0
    assert abs(one(spark, S.f1(F.lit(1), F.lit(1), F.lit(0))) - 2 / 3) < 1e-12
