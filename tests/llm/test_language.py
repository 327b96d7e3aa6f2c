import random

import numpy as np
import pytest

from proofmill.llm import language as lg
from proofmill.llm.language import label_code
from pyspark.sql import functions as F

SENTENCES = {
    "en": ["The outer carton keeps the safe zone free of ink.", "As agreed last week, the colour proof shows the batch code.", "Store the set away from heat.", "The back panel repeats the wording of the front."],
    "de": ["Der äußere Karton bleibt nach dem Laminieren lesbar.", "Die Rückseite wiederholt den Wortlaut der Vorderseite.", "Das Set vor Hitze geschützt lagern.", "Laut dem Layoutteam sitzt die Lasche zu weit links."],
    "fr": ["Le carton extérieur reste lisible après le pelliculage.", "Vider le réservoir après chaque usage.", "Le panneau arrière répète le texte de la face avant.", "Pour la petite boîte, le rabat est trop à gauche."],
    "es": ["El cartón exterior sigue legible después del laminado.", "Guardar el juego lejos del calor.", "El panel trasero repite el texto de la cara frontal.", "Para la caja pequeña, la solapa queda a la izquierda."],
    "it": ["Il cartone esterno resta leggibile dopo la plastificazione.", "Svuotare il serbatoio dopo ogni uso.", "Il pannello posteriore ripete il testo della parte frontale.", "Per la scatola più piccola, la prova è sbagliata."],
    "nl": ["De buitenste doos blijft leesbaar na het lamineren.", "De grendel na elk gebruik nakijken.", "Het achterpaneel herhaalt de tekst van de voorkant.", "Volgens de opmaakgroep staat het etiket te ver naar links."],
    "pl": ["Karton zewnętrzny zostaje czytelny po laminacji.", "Sprawdzać zatrzask po każdym użyciu.", "Tylny panel powtarza treść z przodu pudełka.", "Według zespołu projektowego próba jest dobra."],
    "ru": ["Внешняя коробка остаётся читаемой после ламинации.", "Проверять защёлку после каждой игры.", "Задняя панель повторяет текст лицевой стороны.", "По словам группы вёрстки, ярлык стоит левее."],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    texts = []
    for code, sents in SENTENCES.items():
        for i in range(30):
            label = code if i % 10 else rng.choice(lg.LANGS)  # a tenth of the labels is wrong
            texts.append((" ".join(rng.choices(sents[:3], k=4)), label))
    return lg.fit(texts, epochs=20)


def test_features_are_of_the_whole_word():
    import zlib

    long = "abc" * 20 + "heitsung"
    want = {zlib.crc32(x.encode()) % lg.FEATURES for x in (f"w{long}", "pabc", "sg", "ssung", "neits", "nng$")}
    assert want <= set(lg._features(long)) and lg._features("abc" * 20 + "x") != lg._features("abc" * 20 + "y")


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(7, 8)), rng.normal(size=(3, 8, 8))
    kinds, lengths = np.array([3, 0, 1, 2, 3, 2, 0]), np.array([4, 3])
    post, *_ = lg._forward_backward(emit, kinds, lengths, trans)
    for start, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 8))
        for path in np.ndindex(*[8] * n):
            p = np.exp(sum(emit[start + t, k] for t, k in enumerate(path)) + sum(trans[kinds[start + t], path[t - 1], path[t]] for t in range(1, n)))
            for t, k in enumerate(path):
                total[t, k] += p
        assert np.allclose(post[start : start + n], total / total.sum(axis=1, keepdims=True))


def test_held_out_sentences(model):
    labeller = lg.Labeller(*model)
    held = [(s[3], code) for code, s in SENTENCES.items()]
    assert [p[0][0] for p in labeller.segments([t for t, _ in held])] == [c for _, c in held]


def test_mixed_and_odd_texts(spark, model):
    s = SENTENCES
    texts = [
        s["en"][0] + "\n" + s["en"][1] + " " + s["de"][0] + "\n\n" + s["en"][2] + "\nLOT 26-073\n<end 8>", s["fr"][1], "", None, "LOT 22-585 [1/1]", "ห้ามพับการ์ดที่พิมพ์แล้ว", "Μην διπλώνετε την κάρτα", s["ru"][0].replace("о", "о​"), s["pl"][2] * 400, "12 34",
    ]
    df = spark.createDataFrame([(i, t, "xx", "clash") for i, t in enumerate(texts)], "row_id bigint, text string, label string, lang string")
    got: dict[int, list] = {}
    for r in sorted(lg.label_segments(df, ["row_id", "label"], "text", model).collect(), key=lambda r: (r.row_id, r.segment_no)):
        assert r.label == "xx" and 0 < r.confidence <= 1
        got.setdefault(r.row_id, []).append(r.lang)
    assert got == {0: ["en", "de", "en"], 1: ["fr"], 7: ["ru"], 8: ["pl"]}


def test_labels(spark, model):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["en", "EN", "en_US", "de-AT", " German ", "deu", "??", "", None, "sv", "und"])], "i int, l string")
    assert [r[0] for r in df.orderBy("i").select(label_code(F.col("l"))).collect()] == ["en", "en", "en", "de", "de", "de", None, None, None, None, None]
    rows = [(1, SENTENCES["en"][0], "English"), (2, SENTENCES["en"][0], "fr"), (3, SENTENCES["en"][0], None), (4, SENTENCES["en"][0] + " " + SENTENCES["fr"][0], "en"), (2, SENTENCES["en"][0], "fr")]
    seg = lg.label_segments(spark.createDataFrame(rows, "row_id bigint, text string, label string"), ["row_id", "label"], "text", model)
    assert sorted((r.row_id, r.segment_no, r.lang) for r in lg.mislabelled(seg, "label").collect()) == [(2, 1, "en"), (2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "fr")]


def test_training_from_table(spark):
    rows = [(i, " ".join(SENTENCES[c][:3]), c, "clash") for i, c in enumerate(list(SENTENCES) * 4)] + [(900, None, "en", "x"), (901, "abc", None, "x")]
    weights, trans = lg.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, code string").drop("code"), "doc_id", "text", "lang")
    assert weights.shape == (lg.FEATURES, 8) and trans.shape == (3, 8, 8)
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert lg.label_segments(empty.select("doc_id", "text"), ["doc_id"], "text", (weights, trans)).collect() == []


def test_nothing_labelled():
    (((lang, confidence, words),),) = lg.Labeller(*lg.fit([])).segments([SENTENCES["en"][0]])
    assert lang == "de" and abs(confidence - 1 / 8) < 1e-6 and words == 10


def test_texts_are_not_searched_in_the_jvm(spark):
    # Invisible characters go where the texts are labelled; a pattern for them over every text took a third of the JVM's time.
    model = lg.fit([("Der Hund ist im Haus und die Katze schläft.", "de"), ("The dog is in the house and the cat sleeps.", "en")] * 5)
    rows = [(1, "Der Hu­nd ist im​ Haus und die Katze schläft."), (2, "​​"), (3, "​12"), (4, None)]
    got = lg.label_segments(spark.createDataFrame(rows, "id bigint, text string"), ["id"], "text", model)
    assert [(r.id, r.n_words) for r in got.collect()] == [(1, 9)]
    assert "translate" not in got._jdf.queryExecution().optimizedPlan().toString()
