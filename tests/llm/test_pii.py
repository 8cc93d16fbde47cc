import pytest

from querymill.llm import pii, pii_table
from querymill.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("Anna", "given"), ("jonas", "given"), ("vandrellik", "family"), (None, "given"), ("rose", "given")], "name_part string, kind string")


@pytest.fixture(scope="module")
def model(lexicon):
    return pii.tagger(lexicon)


def test_held_out_accuracy(model):
    held = pii_table.expand([("anna", "given"), ("vandrellik", "family")], 2, seed=77)
    right = wrong = missed = 0
    for (text, marked), found in zip(held, model.items([t for t, _ in held])):
        want, got = {(k, a, b) for a, b, k in marked}, {(k, a, b) for k, a, b in found}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.96 and right / (right + missed) > 0.96


def rows(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string").withColumnRenamed("record_id", "i")
    return {(r.record_id, r.pii_type, r.surface) for r in pii.find_pii(df, "i", "text", model).collect()}


def test_items_as_written(spark, model):
    texts = ["write to Anna.Vandrellik@foo.example about cake", "who called me from +49 (0)30 23125-415", "lost passport number C12X19T11", "directions to 76 orchard street", "wer ist anna vandrellik",
             "login at foo dot example", "anna bakery", "tracking 750985543855", "36 hour birch street parking Ratoburg", None, "", "   ", "vandrellik, jonas obituary", "who is anna k. vandrellik"]
    got = rows(spark, model, texts)
    assert got == {(0, "email", "Anna.Vandrellik@foo.example"), (1, "phone", "+49 (0)30 23125-415"), (2, "id_number", "C12X19T11"), (3, "address", "76 orchard street"), (4, "name", "anna vandrellik"), (12, "name", "vandrellik, jonas"), (13, "name", "anna k. vandrellik")}


def test_capitals_and_wrongly_decoded_items(spark, model):
    texts = ["directions to 12 PEÑALVER street", "directions to 12 mühlen street", "directions to 12 mühlen street".encode().decode("latin-1"), "погода в москве 12 завтра".encode().decode("latin-1")]
    got = rows(spark, model, texts)
    assert got == {(0, "address", "12 PEÑALVER street"), (1, "address", "12 mühlen street"), (2, "address", "12 mÃ¼hlen street")}


def test_repeated_items_once_and_long_texts_whole(spark, model):
    long = "red car " * 5000 + "email jonas.vandrellik@foo.example"
    assert rows(spark, model, [long, "email a_b@foo.example write to a_b@foo.example"]) >= {(0, "email", "jonas.vandrellik@foo.example"), (1, "email", "a_b@foo.example")}


def test_redaction_keeps_the_rest(spark, model):
    df = spark.createDataFrame([(1, "who is anna vandrellik"), (2, None), (3, "red car"), (4, "")], "i long, t string")
    got = {r.record_id: r.redacted for r in pii.redact(df, "i", "t", model).collect()}
    assert got == {1: "who is [NAME]", 2: None, 3: "red car", 4: ""}
    assert pii.redact(df.limit(0), "i", "t", model).count() == 0 and pii.find_pii(df.limit(0), "i", "t", model).count() == 0


def test_empty_lexicon(spark, lexicon):
    assert pii.tagger(lexicon.limit(0)).items(["email anna.b@foo.example"])[0][0][0] == "email"


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    emit, move = rng.standard_normal((1, 4, pii.N)), pii.ALLOWED + rng.standard_normal((pii.N, pii.N))
    keep = [0, 1, 2, 3, 4]
    best = max(itertools.product(keep, repeat=4), key=lambda y: pii.START[y[0]] + sum(emit[0, t, k] for t, k in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
    barred = np.full(pii.N, -1e6)
    barred[keep] = 0
    assert tuple(pii.viterbi((emit + barred).astype(np.float32), move)[0]) == best


def test_query_log_rows(spark):
    df = table(spark, SF, "query_log")
    got = pii.find_pii(df, "record_id", "serp_query_text_url", pii.tagger(table(spark, SF, "name_lexicon"))).collect()
    assert got and all(r.surface for r in got)


#: sentences of kinds that the table of labelled rows doesn't hold
UNSEEN = [
    ("Please call Robert Johnson at 555-212-0199 about the invoice", [("name", "Robert Johnson"), ("phone", "555-212-0199")]),
    ("Herr Jürgen Müller, Hauptstraße 12, kommt morgen", [("address", "Hauptstraße 12"), ("name", "Jürgen Müller")]),
    ("the party is at 7 Baker Street tonight", [("address", "7 Baker Street")]),
    ("talk by Rajesh Kumar on databases", [("name", "Rajesh Kumar")]),
    ("kenji tanaka called me twice", [("name", "kenji tanaka")]),
    ("appointment with Fatima Al-Hassan moved to friday", [("name", "Fatima Al-Hassan")]),
    ("ruf mich an 0151 23456789", [("phone", "0151 23456789")]),
    ("you can reach maria.schneider@posteo.example or her office", [("email", "maria.schneider@posteo.example")]),
    ("neighbours complained about 221 cedar avenue apt 4", [("address", "221 cedar avenue apt 4")]),
    ("does anyone know Olena Smirnov from school", [("name", "Olena Smirnov")]),
    ("my SSN 912-34-5678 got leaked", [("id_number", "912-34-5678")]),
    ("signed, Emma Thompson", [("name", "Emma Thompson")]),
    ("j'ai rencontré Camille Moreau hier soir", [('name', 'Camille Moreau')]),
    ("envoyer le colis au 14 rue Pasteur", [("address", "14 rue Pasteur")]),
    ("mi vecino Santiago Hernandez tiene un perro", [("name", "Santiago Hernandez")]),
    ("llámame al +34 612 345 678", [("phone", "+34 612 345 678")]),
    ("passport C12X45T67 stolen in rome", [("id_number", "C12X45T67")]),
    ("drop by via Garibaldi 8 after work", [("address", "via Garibaldi 8")]),
    ("contact jane(at)corp.example for tickets", [("email", "jane(at)corp.example")]),
    ("the lake house has a blue door", []),
    ("Grand Canyon travel guide 2019", []),
    ("how many people live in New York City", []),
    ("buy nike air max 90 size 12", []),
    ("king street market opening hours", []),
    ("cheap flights from London to Madrid in march", []),
    ("error code 80072 windows update", []),
    ("Lincoln movie cast and crew", []),
    ("Anna dress pattern free", []),
    ("invoice for Siobhan O'Brien, 9 Castle Road", [('address', '9 Castle Road'), ('name', "Siobhan O'Brien")]),
    ("has Dmitri Petrov paid the rent", [("name", "Dmitri Petrov")]),
    ("thanks, Wei Zhang", [("name", "Wei Zhang")]),
    ("Schillerstr. 5b ist zu vermieten", [("address", "Schillerstr. 5b")]),
]


def test_unseen_sentences(model):
    right = wrong = missed = 0
    for (text, marked), found in zip(UNSEEN, model.items([t for t, _ in UNSEEN])):
        want, got = set(marked), {(k, text[a:b]) for k, a, b in found}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.8
