import datetime as dt
import random

import numpy as np
import pytest

from editrail.llm import languages as lg

SENTENCES = {
    "en": ["The committee directs the office to submit a plan within ninety days.", "No funds may be used until the audit has been closed.", "The residents depend on this service and the harbor."],
    "es": ["La comisión ordena a la oficina que presente un plan en un plazo de noventa días.", "Ninguna parte de esta partida podrá gastarse hasta que cierre la auditoría.", "Los vecinos dependen de este servicio y del puerto."],
    "fr": ["La commission demande à l'office de remettre un plan sous quatre-vingt-dix jours.", "Aucun crédit ne peut être engagé tant que la vérification n'est pas close.", "Les habitants comptent sur ce service et sur le port."],
    "de": ["Der Ausschuss weist die Behörde an, binnen neunzig Tagen einen Plan vorzulegen.", "Es darf kein Betrag ausgegeben werden, solange die Prüfung nicht abgeschlossen ist.", "Die Einwohner sind auf diesen Dienst und den Hafen angewiesen."],
    "pt": ["A comissão determina que a secretaria apresente um plano no prazo de noventa dias.", "Nenhuma quantia poderá ser gasta enquanto a auditoria não for encerrada.", "Os moradores precisam deste serviço e do porto, mas não têm."],
    "it": ["La commissione chiede all'agenzia di presentare un piano entro novanta giorni.", "Nessuna somma può essere impiegata finché la verifica non è chiusa.", "Gli abitanti contano su questo servizio e sul porto."],
}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(SENTENCES[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labeller():
    return lg.fit([(text(c, 8, s), c, True) for c in SENTENCES for s in range(6)])


def test_probabilities_sum_to_one(labeller):
    """After a history seen in training, over all symbols."""
    model = labeller.models[0]
    symbols = sorted({c for s in SENTENCES["en"] for c in s.lower() if c.isalpha()})
    for prefix in ("", "t", "th", "comm"):
        total = 0.0
        for c in symbols + ["\x03"]:
            grams, word, contexts = lg._ngrams([prefix + c] if c != "\x03" else [prefix or "q"], labeller.order)
            at = len(prefix) if c != "\x03" else len(prefix or "q")
            if c == "\x03" and not prefix:
                continue
            total += float(lg.np.exp(model.log_probabilities(grams, contexts))[at])
        assert 0.5 < total <= 1.0 + 1e-9


def test_held_out_accuracy(labeller):
    for c in SENTENCES:
        sums, chars = labeller.texts([lg.spoken(text(c, 2, s)) for s in range(50, 60)])
        assert [labeller.languages[k] for k in sums.argmax(axis=1)] == [c] * 10
        assert (chars > 0).all()


def test_blocks():
    assert lg.blocks_of("\n \na\r\nb\r\n \t\r\n\r\nc\n") == ["a\r\nb", "c"]
    assert lg.blocks_of(" \n") == []


def test_documents_and_blocks(spark):
    docs = [(100 * k + s, text(c, 6, s), c) for k, c in enumerate(SENTENCES) for s in range(10)]
    docs += [
        (1000, text("en", 3, 99), None), (1001, text("fr", 3, 98), "en_US"), (1002, text("de", 3, 97), "DE-at"), (1003, None, "en"), (1004, "", None), (1005, " 12,000\n\n34", None),
        (1006, text("en", 6, 1) + "\n\n" + text("it", 2, 2) + "\r\n \r\nok", "it"), (1007, "<html><body><pre>\n\n 1,200 \n\n</pre></body></html>", None),
        (1008, text("en", 3, 5) + ' He said "' + SENTENCES["fr"][0] + '" twice.', "xx"), (1000, text("en", 3, 99), None),
    ]
    d = spark.createDataFrame([(*x, "z", dt.datetime(2024, 1, 1)) for x in docs], "doc_id long, text string, lang string, block_no string, confidence timestamp_ntz")
    labels = spark.createDataFrame([(100 * k + s, c, "r") for k, c in enumerate(SENTENCES) for s in range(5)], "doc_id long, lang string, reviewer string")
    rows = lg.document_languages(d, labels).collect()
    got = {(r["doc_id"], r["block_no"]): r["lang"] for r in rows}
    assert got[1000, 0] == "en" and got[1001, 0] == "fr" and got[1002, 0] == "de" and got[1008, 0] == "en"
    assert not {1003, 1004, 1005, 1007} & {k for k, _ in got}
    assert {k: v for k, v in got.items() if k[0] == 1006} == {(1006, 0): "en", (1006, 1): "en", (1006, 2): "it"}
    assert all(0 <= r["confidence"] <= 1 for r in rows)
    unsure = lg.document_languages(d, labels, reject_below=1.1).where("lang IS NOT NULL").count()
    assert unsure == 0
    assert lg.document_languages(d, labels.where("false").select("doc_id", "lang")).where("block_no = 0").count() > 0
    assert lg.document_languages(d.where("false"), labels.where("false")).count() == 0


def test_long_quotations_and_tags_are_no_own_words():
    quoted = "La commission demande un plan. " * 60
    assert len(quoted) > 1000
    own = "The committee directs the office to submit a plan within ninety days."
    assert lg.spoken(f'{own} "{quoted}"') == lg.spoken(own)
    assert lg._TAG.sub(" ", "<a " + "x" * 900 + ">b") == " b"


def test_rejection_is_calibrated_both_ways(labeller):
    """Texts of a language that no model knows are refused, those of the six aren't."""
    finnish = "Valiokunta kehottaa virastoa toimittamaan suunnitelman yhdeksankymmenen paivan kuluessa ja raportoimaan menoista kunnille."
    for texts, foreign in (([text(c, 2, 77) for c in SENTENCES], False), ([finnish, "Xqz vwkkj zzhq pwrtg kjhgf qwrtp zxcvb mnbvc lkjhg fdsaq wrtyp zzxcv bnmlk jhgfd"], True)):
        sums, chars = labeller.texts([lg.spoken(t) for t in texts])
        assert (labeller.foreign(labeller.entropies(sums, chars), chars) == foreign).all()
    assert labeller.bound[0] < float("inf") and max(labeller.errors) < 0.2


def test_confidence_is_low_where_texts_are_mistaken(labeller):
    cut = [(p, c) for c in SENTENCES for p in lg.pieces(lg.spoken(text(c, 6, 88)))]
    sums, chars = labeller.texts([p for p, _ in cut])
    entropy = labeller.entropies(sums, chars)
    sure = labeller.confidences(entropy, chars).max(axis=1)
    right = np.array([labeller.languages[k] == c for k, (_, c) in zip(entropy.argmin(axis=1), cut)])
    assert sure[right].mean() > (sure[~right].mean() if (~right).any() else 0)
