import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import lang

TEXT = {
    "en": "The invoice was paid before the end of the month. We returned the old pallets to the warehouse.",
    "de": "Die Rechnung wurde vor dem Ende des Monats bezahlt. Wir haben die alten Paletten an das Lager zurückgegeben.",
    "fr": "La facture a été payée avant la fin du mois. Nous avons rendu les anciennes palettes à l'entrepôt.",
    "es": "La factura fue pagada antes del fin de mes. Hemos devuelto los palés viejos al almacén.",
    "nl": "De rekening is voor het einde van de maand betaald. Wij hebben de oude pallets aan het magazijn teruggegeven.",
    "pt": "A fatura foi paga antes do fim do mês. Devolvemos as paletes velhas ao armazém.",
}
SCHEMA = "doc_id long, text string, lang string, segment_no string"


def model():
    return lang.fit([Counter(w.lower() for w in lang.WORD.findall(TEXT[x])) for x in lang.LANGS])


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 5, 3)
        scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
        starts = rng.random(lengths.sum()) < 0.4
        got, at = lang.viterbi(scores, lengths, starts, 0.7, 1.5), 0
        for n in lengths:
            s, b = scores[at : at + n], starts[at : at + n]

            def value(path):
                return sum(s[i][x] for i, x in enumerate(path)) - sum((0.7 if b[i] else 1.5) for i in range(1, n) if path[i] != path[i - 1])

            if n:
                assert abs(value(got[at : at + n]) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-4
            at += n


def test_mixed_text_and_edge_cases():
    mixed = TEXT["en"] + " " + TEXT["de"]
    out = lang.label_texts([mixed, None, "", "  \n", "12 34;56", "Съд и право на всички хора."], model(), 3.0, 8.0, 4)
    assert [(s[3], s[6]) for s in out[0]] == [("en", 2), ("de", 2)] and out[1:5] == [[]] * 4
    assert [(s[3], s[4] > 0.9, s[6]) for s in out[5]] == [("und", True, 0)]
    assert "".join(mixed[s[1] : s[2]] for s in out[0]) == mixed
    long = " ".join([TEXT["fr"]] * 3000)
    (seg,) = lang.label_texts([long], model(), 3.0, 8.0, 4)[0]
    assert seg[3] == "fr" and seg[6] == 6000


def test_spark(spark):
    rows = [(i, TEXT[x], lab, "clash") for i, (x, lab) in enumerate([("en", "en_GB"), ("de", "English"), ("fr", None), ("es", "Spanish"), ("nl", "??"), ("pt", "pt-BR"), ("pt", "pt-BR")])] + [(9, None, "en", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    seg = lang.label_segments(df.select("doc_id", "text", "lang"), model())
    assert {tuple(r) for r in lang.found(seg).collect()} == {(1, "de"), (2, "fr"), (4, "nl")}
    assert {(r.doc_id, r.main_lang) for r in lang.label_documents(seg).collect()} >= {(0, "en"), (6, "pt")}
    assert lang.found(lang.label_segments(df.where("false"), model())).count() == 0
    clean = spark.createDataFrame([(i, t, x, None) for i, (x, t) in enumerate(TEXT.items())], SCHEMA)
    assert lang.label_segments(df, lang.train(clean)).where("doc_id = 1 and seg_lang = 'de' and n_sentences = 2").count() == 1


def test_named(spark):
    df = spark.createDataFrame([("en-US,fr",), ("Portuguese",), (None,), ("und",), ("NL_be",)], "lang string")
    assert [sorted(r[0]) for r in df.select(lang.named_langs(F.col("lang"))).collect()] == [["en", "fr"], ["pt"], [], [], ["nl"]]


def test_scripts_and_letters_narrow():
    fits = lambda w: {x for x, y in zip(lang.LANGS, lang.candidates(w)) if y}
    assert fits("Straße") == {"de"} and fits("señor") == {"en", "es"} and fits("não") == {"pt"} and fits("œuvre") == {"fr"} and fits("plain") == set(lang.LANGS) and fits("право") == set() == fits("書類")
    m = model()
    assert int(np.argmax(lang.word_score(m, "größße"))) == lang.LANGS.index("de") and int(np.argmax(lang.word_score(m, "право"))) == len(lang.LANGS)


def test_a_seventh_language_and_other_scripts_are_und():
    text = TEXT["en"] + " Съд и право на всички хора. " + "Wszystkie zamówienia dostarczono wczoraj rano przed południem pociągiem. " + TEXT["fr"]
    out = lang.label_texts([text], model(), 3.0, 8.0, 4)[0]
    assert [s[3] for s in out] == ["en", "und", "fr"] and out[1][6] == 0 and "".join(text[s[1] : s[2]] for s in out) == text


def test_wrapped_lines_are_one_sentence():
    for text, want in (("We met. The new invoices were postponed against the external\npolicy of Skakos.", [(0, 7), (7, 78)]), ("TERMS\nThe goods were returned on time.", [(0, 6), (6, 38)]), ("One line here\n\nanother line there", None)):
        got = [(a, b) for a, b, _ in lang.sentences(text)]
        assert "".join(text[a:b] for a, b in got) == text
        if want:
            assert got == want
    german = "Wir haben die Rechnung vor dem Ende des Monats bezahlt und den externen\nVertrag gekündigt."
    assert len(lang.sentences(german)) == 1
    (seg,) = lang.label_texts(["Die Rechnung wurde vor dem Ende des Monats\nbezahlt."], model(), 3.0, 8.0, 4)[0]
    assert seg[3] == "de" and seg[6] == 1


def test_confidence_grows_with_the_lead(spark):
    clean = spark.createDataFrame([(i, t, x, None) for i, (x, t) in enumerate(TEXT.items())], SCHEMA)
    m = lang.train(clean)
    (plain,), (loose,) = lang.label_texts([TEXT["de"], "Nr Skakos, Trebol, Lager."], m, 3.0, 8.0, 4)
    assert 0 < loose[4] < plain[4] <= 1
    assert len(lang.known_rows(clean, "doc_id", 1)) == 6 and lang.train(clean.where("false"))["words"] == {}
