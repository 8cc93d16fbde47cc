import pytest

from querymill.llm import language as la


@pytest.fixture(scope="module")
def model():
    return la.train([])


def test_labels():
    want = {"en": "en", "EN": "en", "en-GB": "en", "de_AT": "de", "deu": "de", "German": "de", "xx": None, "": None, None: None, "null": None, "und": None, "pt": None, "English": "en", " fr ": "fr"}
    assert {k: la.label_language(k) for k in want} == want


def test_repair():
    for s in ("où est la théière", "как почистить чайник", "qué año"):
        once = s.encode("utf-8").decode("latin-1")
        assert la.repair(once) == s and la.repair(once.encode("utf-8").decode("latin-1")) == s
    assert la.repair("plain") == "plain"


def test_held_out_sentences(model):
    held = {"en": "which of the two trains would you rather take", "de": "warum ist der zug heute schon wieder zu spät", "nl": "waarom heeft de trein vandaag weer vertraging", "fr": "pourquoi le train est encore en retard aujourd'hui",
            "es": "por qué el tren llega tarde otra vez", "it": "perché il treno è di nuovo in ritardo oggi", "ru": "почему поезд сегодня опять опаздывает"}
    for lang, text in held.items():
        (got,) = la.segments(model, [text])[0]
        assert got[0] == lang and got[1] > 0.5


def test_mixed_texts_have_two_segments(model):
    text = "where is the old house that they have built | wo ist das alte haus das sie gebaut haben"
    got = la.segments(model, [text])[0]
    assert [s[0] for s in got] == ["en", "de"] and abs(got[0][3] - 9) <= 1
    assert len(la.segments(model, ["where is the old restaurant Zum Löwen in Berlin"])[0]) == 1


def test_third_segment(model):
    third = la.segments(model, ["where is the old house that they have built | почему поезд сегодня опять опаздывает | wo ist das alte haus das sie gebaut haben"])[0]
    assert [s[0] for s in third] == ["en", "ru", "de"] and third[0][2] == 0 and third[2][3] == 23


def test_wrong_labels(spark, model):
    rows = [(1, "where is the old house", "en-GB"), (2, "where is the old house", "de"), (3, "where is the old house", None), (4, "where is the old house that they have built / wo ist das alte haus das sie gebaut haben", "en"), (5, None, "en"), (6, "", None), (7, "123 ...", "xx")]
    df = spark.createDataFrame(rows, "i long, t string, l string")
    assert sorted(tuple(r) for r in la.wrong_labels(df, "i", "t", "l", model).collect()) == [(2, "en"), (3, "en"), (4, "de"), (4, "en")]
    assert la.identify(df, "i", "t", "l", model).count() == 8
    assert la.wrong_labels(df.limit(0), "i", "t", "l", model).count() == 0


def test_long_text(model):
    assert la.segments(model, ["where is the old house that they have built " * 3000])[0][0][0] == "en"


def test_sample_is_bounded_and_wrong_labels_do_no_harm(spark):
    good = [(f"{t} {k}", c) for c, rows in la.SEED.items() for t in rows.split("|") for k in ("red", "car", "dog")]
    rows = [(t, c if i % 10 else "en") for i, (t, c) in enumerate(good)] + [(None, "en"), ("x", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    sample = la.sample_labels(df, "t", "l", 9)
    assert max(sum(c == k for _, c in sample) for k in la.LANGUAGES) <= 9
    model = la.train(la.sample_labels(df, "t", "l"))
    right = sum(la.segments(model, [t])[0][0][0] == c for t, c in good)
    assert right / len(good) > 0.97


def test_confidence_is_lower_for_short_and_unknown_texts(spark, model):
    sure = {t: la.segments(model, [t])[0][0][1] for t in ("where is the old house that they have built", "house", "こんにちは 世界")}
    assert sure["where is the old house that they have built"] > sure["house"] > sure["こんにちは 世界"]
    df = spark.createDataFrame([(1, "where is the old house that they have built", "en"), (2, "こんにちは 世界", "en")], "i long, t string, l string")
    assert {r.record_id: r.decided for r in la.identify(df, "i", "t", "l", model).collect()} == {1: "en", 2: "other"}


def test_confidence_follows_held_out_accuracy():
    import random

    r = random.Random(2)
    bags = {c: [w for t in rows.split("|") for w in t.split()] for c, rows in la.SEED.items()}
    texts = [(" ".join(r.choice(bags[c] if r.random() < 0.8 else bags[r.choice(la.LANGUAGES)]) for _ in range(r.randint(1, 6))), c) for c in la.LANGUAGES for _ in range(400)]
    model = la.train(texts[::2])
    pairs = [(la.segments(model, [t])[0][0][:2], c) for t, c in texts[1::2]]
    high, low = ([lang == c for (lang, sure), c in pairs if (sure >= 0.9) == side] for side in (True, False))
    assert len(high) > 100 and sum(high) / len(high) > 0.85 and (not low or sum(low) / len(low) < sum(high) / len(high))
