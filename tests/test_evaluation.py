"""Evaluation on a 12-row fixture against brute-force metric definitions."""

import pytest

from ticketflow.operators import evaluation as EV

ROWS = [
    ("billing", "billing", "en", 0.9), ("account", "account", "en", 0.8),
    ("complaint", "billing", "en", 0.5), ("feedback", "feedback", "en", 0.95),
    ("billing", "billing", "es", 0.85), ("account", "complaint", "es", 0.6),
    ("technical_support", "technical_support", "es", 0.9), ("general_inquiry", "general_inquiry", "es", 0.65),
    ("billing", "billing", "fr", 0.92), ("complaint", "complaint", "fr", 0.55),
    ("feedback", "account", "fr", 0.88), ("technical_support", "technical_support", "fr", 0.97),
]


def brute(rows):
    labels = sorted({r[0] for r in rows} | {r[1] for r in rows})
    n = len(rows)
    res = {}
    for lab in labels:
        tp = sum(1 for t, p, *_ in rows if t == lab and p == lab)
        sup = sum(1 for t, *_ in rows if t == lab)
        pred = sum(1 for _, p, *_ in rows if p == lab)
        prec = tp / pred if pred else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * tp / (sup + pred) if sup + pred else 0.0
        res[lab] = (prec, rec, f1, sup)
    acc = sum(1 for t, p, *_ in rows if t == p) / n
    f1_macro = sum(v[2] for v in res.values()) / len(labels)
    f1_w = sum(v[2] * v[3] for v in res.values()) / n
    return acc, f1_macro, f1_w, res


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(ROWS, "y_true string, y_pred string, language string, confidence double")


def test_overall(preds):
    acc, f1m, f1w, _ = brute(ROWS)
    r = EV.eval_overall(preds).first()
    assert r.accuracy == pytest.approx(acc) and r.f1_macro == pytest.approx(f1m)
    assert r.f1_weighted == pytest.approx(f1w)


def test_per_language_and_gaps(preds):
    per = {r.language: r for r in EV.eval_per_language(preds).collect()}
    gaps = {r.language: r for r in EV.transfer_gaps(preds).collect()}
    overall = brute(ROWS)[0]
    for lang in ("en", "es", "fr"):
        sub = [r for r in ROWS if r[2] == lang]
        acc, f1m, _, _ = brute(sub)
        assert per[lang].accuracy == pytest.approx(acc)
        assert per[lang].f1_macro == pytest.approx(f1m)
        assert per[lang].sample_count == 4
        assert gaps[lang].accuracy_gap == pytest.approx(round(acc - overall, 4))


def test_confusion_matrix_square_and_filled(preds):
    cm = EV.confusion_matrix(preds).collect()
    labels = sorted({r[0] for r in ROWS} | {r[1] for r in ROWS})
    assert len(cm) == len(labels) ** 2
    assert sum(r.n for r in cm) == len(ROWS)
    wide = EV.confusion_matrix_wide(preds)
    assert wide.columns == ["y_true"] + labels


def test_low_confidence(preds, spark):
    r = EV.low_confidence_analysis(preds).first()
    low = [x for x in ROWS if x[3] < 0.7]
    assert r["count"] == len(low) == 4
    assert r.accuracy == pytest.approx(sum(1 for x in low if x[0] == x[1]) / len(low))
    none = spark.createDataFrame([("a", "a", "en", 0.9)], preds.schema)
    assert EV.low_confidence_analysis(none).first().accuracy is None


def test_report_rows(preds):
    rep = {r.label: r for r in EV.eval_report(preds).collect()}
    _, _, _, res = brute(ROWS)
    for lab, (p, rc, f1, sup) in res.items():
        assert rep[lab].precision == pytest.approx(p) and rep[lab].support == sup
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rep)
