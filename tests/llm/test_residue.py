import pytest

from querymill.llm import residue

CUE = "{0}\n00:00:0{0},000 --> 00:00:0{0},900\n{1}\n\n"


def sub(*texts):
    return "".join(CUE.format(i + 1, t) for i, t in enumerate(texts))


CASES = [
    "- <title> -",
    "Hello, {{ firstName }}!", "Previously on ${title}", "- %city% -", "__line__", "@@cue.text@@", "[[speaker]]: I never said that.", "<%= season %>", "[INSERT line HERE]", "<episode_name>", "#{title}", "{CHARACTER}: no",
    "Lorem ipsum magna dolor.", "elit sed magna nostrud.", "xxx XXXXX xxxx", "asdf jkl", "test test test", "dummy subtitle 1 2 3", "Sample text", "Text goes here", "TODO: translate this line", "TBD", "[noch zu übersetzen]", "à traduire",
    "404 Not Found", "HTTP error 503", "Fehler 500: Seite nicht gefunden", "Access denied. You do not have permission to open this file.", "Please enable JavaScript to view this subtitle.", "Internal Server Error\nThe server could not complete your request.",
    "<html><body><h1>Bad gateway</h1></body></html>", "Traceback (most recent call last): KeyError: 'cues'", "Включите JavaScript, чтобы продолжить.", "Cookies must be allowed to open this page.", "Typc your subtitle here",
]
NO_CASES = [
    "He said the page was not found, then he hung up on me.", "Access denied? It's my own kitchen, Carla!", "Error after error, and you call it a plan.", "TODO is what it said on the fridge.", "The server is on her break.", "Insert the key here and turn it twice.",
    "I came to fill in, not to be a placeholder.", "Your name goes here, on the dotted line.", "Too many requests, Lucia. One coffee, please.", "Enable what? I can't even find the switch.", "She works on the script, so don't disable her desk lamp.", "Please wait while I check your coat.",
    "<i>Is there any coffee left?</i>", '<font color="#ffff00">No.</font>', "{\\an8}[static]", "[ERROR BUZZER]", "Advertise your product or brand here: contact www.foo.example today", "Untertitel von foo", "I typed lorem something and went to lunch.", "100% sure, 50% off", "The template for the dress is missing.", "$5 or $10?",
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, f"s{i % 3}", "x") for i, t in enumerate(texts)], "d long, t string, s string, doc_id string")
    return {r.doc_id for r in residue.residue_documents(df.drop("doc_id"), "d", "t", "s").collect()}


@pytest.mark.parametrize("wrap", [lambda t: t, lambda t: sub("Hello there.", t, "Bye."), lambda t: ("﻿" + sub(t)).replace("\n", "\r\n")])
def test_cases(spark, wrap):
    got = found(spark, [wrap(t) for t in CASES + NO_CASES])
    assert [CASES[i] for i in range(len(CASES)) if i not in got] == []
    assert [NO_CASES[i - len(CASES)] for i in sorted(got) if i >= len(CASES)] == []


def test_phrases_encoded_wrongly_twice(spark):
    twice = lambda t, read: t.encode().decode(read, "replace").encode().decode(read, "replace")
    phrases = ["включите javascript, чтобы продолжить.", "Включите JavaScript, чтобы продолжить.", "ошибка 404: страница не найдена", "Ошибка 404: Страница не найдена"]
    texts = [sub("Hello there.", twice(p, read)) for p in phrases for read in ("latin-1", "cp1252")]
    assert found(spark, texts) == set(range(len(texts)))


def test_widely_recurring_page_messages(spark):
    page = "We moved. This request needs another server, see {}"
    texts = [page.format(i) for i in range(4)] + ["This request needs another waiter, see 7", sub("We moved. This request needs another server, see 9")]
    assert found(spark, texts) == {0, 1, 2, 3, 5}
    assert found(spark, texts[:2]) == set()


def test_a_null_source_is_a_source(spark):
    page = "We moved. This request needs another server, see {}"
    rows = [(i, page.format(i), "a" if i else None) for i in range(3)]
    got = lambda r: {x.d for x in residue.residue_documents(spark.createDataFrame(r, "d long, t string, s string"), "d", "t", "s").withColumnRenamed("doc_id", "d").collect()}
    assert got(rows) == {0, 1, 2}
    assert got([(d, t, None) for d, t, _ in rows]) == set()


def test_notes_and_placeholders_of_any_length(spark):
    long = "ask the second translator about it again and " * 4
    texts = [f"TODO: {long}", f"FIXME {long}", f"Error 500: {long}", f"<% {long} %>", f"[insert {long}]", f"[your {long}]"]
    assert found(spark, [sub("Hello there.", t) for t in [*texts, "Error after error, " + long]]) == set(range(len(texts)))


def test_nulls_empty_and_long(spark):
    assert found(spark, [None, "", "﻿", "1\n", sub(*["No."] * 5000) + "{{ x }}"]) == {4}
    assert found(spark, []) == set()


def test_clean_documents_and_report(spark):
    df = spark.createDataFrame([(1, "404 Not Found", None), (2, "Hello.", "a"), (3, "404 Not Found", "a"), (4, None, "b")], "d long, t string, s string")
    assert {r.d for r in residue.clean_documents(df, "d", "t", "s").collect()} == {2, 4}
    row = residue.residue_report(df, "d", "t", "s").first()
    assert (row.message, row.documents, row.sources) == ("# Not Found", 2, 2)


PAGES = [
    "Verify you are human by completing the action below", "You must be signed in to see this content", "Sitio en mantenimiento, vuelva pronto", "Attention Required! One more step", "at com.foo.Bar.run(Bar.java:12)",
    "[Translator: fill this in]", "{0}", "XX_TITLE_XX", "Bitte melden Sie sich an, um fortzufahren", "Quota reached for today", "This video is private",
]


def test_pages_of_unknown_words_are_found_by_their_recurrence(spark):
    rows = [(100 * k + i, p, f"s{i % 2}") for k, p in enumerate(PAGES) for i in range(4)] + [(9000 + k, sub("Hello there.", p, "Bye."), "s3") for k, p in enumerate(PAGES)]
    # talk recurs too, and a page may hold only that; what recurs in one source only isn't wide
    rows += [(5000 + i, sub("Hello there.", "Thank you.", f"It is {i}."), f"s{i % 3}") for i in range(200)] + [(6000, "Thank you.", "s1"), *[(7000 + i, "Nobody wrote this one", "s1") for i in range(5)]]
    df = spark.createDataFrame(rows, "d long, t string, s string")
    got = {r.doc_id for r in residue.residue_documents(df, "d", "t", "s").collect()}
    assert got == {100 * k + i for k in range(len(PAGES)) for i in range(4)} | {9000 + k for k in range(len(PAGES))}


def test_confused_and_misread_forms_join_the_message_that_recurs(spark):
    rows = [(i, "Veuillez rouvrir la page demandée", f"s{i}") for i in range(4)]
    rows += [(10, sub("Hello there.", "Veuillez rouvrir la page demandÃ©e"), "s1"), (11, sub("Hello there.", "Vcuillez rouvrir 1a page demandée."), "s1"), (12, sub("Hello there.", "Veuillez rouvrir la porte demandée"), "s1")]
    df = spark.createDataFrame(rows, "d long, t string, s string")
    assert {r.doc_id for r in residue.residue_documents(df, "d", "t", "s").collect()} == {0, 1, 2, 3, 10, 11}
